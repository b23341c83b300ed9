"""Operator 2: language identification by rank-order profiles of character n-grams.

Profile of a language: its ``size`` most frequent 1- to 3-grams over all documents to learn from. A document's own most
frequent n-grams are compared with each profile by out-of-place distance: the sum of rank differences, ``size`` for an
n-gram that the profile lacks. The nearest language wins; ties go to the smaller name.

N-grams run over lower-cased letters with one blank around each word; an n-gram is one long (three code points of 21
bits), so counting is sorting of integers. Learning sends one row for each n-gram and language of a task, not of a
document; texts are cut into slices and counts are merged as they come, so a task holds a bounded number of codes. The
profiles are broadcast as (n-gram, language, rank) rows: ``size`` a language, and ``max_languages`` bounds the languages
(more is an error, never a silent cut).

Defined cases: null text or text without a letter is ``und`` with score 0; documents with null lang teach nothing; if
nothing can be learned every document is ``und``. Score: second distance / (first + second), from 0.5 (no difference) to
1; with one language known, its share of n-grams in place.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import crc_mod, cut, small_batches, table

NOT_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


#: Characters whose codes are worked out at once.
SLICE = 1 << 20


def grams(text: str | None, step: int = SLICE):
    """Codes of all 1- to 3-grams in slices; none where the text has no letter."""
    words = NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    if not words or not has_letter(words):
        return
    whole = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), "<u4")
    for at in range(0, len(whole) - 2, step):  # a slice overlaps the next by two characters
        c = whole[at : at + step + 2].astype(np.int64)
        one, two, three = c[1:-1], c[:-2] << 21 | c[1:-1], c[:-2] << 42 | c[1:-1] << 21 | c[2:]
        parts = [one[one != 32], two, three]
        if at + step + 2 >= len(whole):
            parts.append(c[-2:-1] << 21 | c[-1:])  # the last pair has no triple
        yield np.concatenate(parts)


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def counted(parts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of several arrays with their counts."""
    found = [np.unique(p, return_counts=True) for p in parts]
    if len(found) == 1:
        return found[0]
    return summed(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def gram_counts(docs: DataFrame) -> DataFrame:
    """docs (lang, text) -> lang, gram, n, summed for each task."""

    def of(batches):
        total: dict = {}
        waiting: dict = {}
        size = 0

        def flush() -> None:
            for lang, parts in waiting.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                if lang in total:
                    codes, n = summed(np.concatenate([total[lang][0], codes]), np.concatenate([total[lang][1], n]))
                total[lang] = codes, n
            waiting.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for codes in grams(text.as_py()):
                    waiting.setdefault(lang, []).append(codes)
                    size += len(codes)
                    if size > 4 * SLICE:
                        flush()
                        size = 0
        flush()
        for lang, (codes, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return docs.select("lang", "text").where("lang is not null and text is not null").mapInArrow(of, "lang string, gram long, n long")


def profiles(docs: DataFrame, size: int = 400) -> DataFrame:
    """lang, gram, rank (from 0; ties to the smaller code)."""
    small_batches(docs.sparkSession)
    total = gram_counts(docs).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    nth = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    # the filter stands on the place itself, so each task sends its own first ``size`` n-grams of a language only
    return total.withColumn("nth", nth).where(F.col("nth") <= size).select("lang", "gram", (F.col("nth") - 1).alias("rank"))


class RankOrder:
    """Profiles as sparse rows: the languages and ranks of each n-gram, one n-gram after the other."""

    def __init__(self, rows, size: int):
        self.size, self.langs = size, sorted({r[0] for r in rows})
        of = {lang: k for k, lang in enumerate(self.langs)}
        flat = np.array(sorted((r[1], of[r[0]], r[2]) for r in rows), np.int64).reshape(-1, 3)
        self.codes, first = np.unique(flat[:, 0], return_index=True)
        self.first, self.lang, self.rank = np.append(first, len(flat)), flat[:, 1].astype(np.int32), flat[:, 2].astype(np.int32)

    def distances(self, top: np.ndarray) -> np.ndarray:
        """Out-of-place distance of each language to n-grams in order of rank."""
        at = np.searchsorted(self.codes, top)
        at[at == len(self.codes)] = 0
        place = np.flatnonzero(self.codes[at] == top)
        begin, n = self.first[at[place]], self.first[at[place] + 1] - self.first[at[place]]
        entry = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        # an n-gram that a profile lacks costs ``size``; those it has save what they are nearer
        saved = np.bincount(self.lang[entry], self.size - np.abs(self.rank[entry] - np.repeat(place, n)), minlength=len(self.langs))
        return self.size * len(top) - saved

    def judge(self, text: str | None) -> tuple[str, float]:
        codes, n = counted(grams(text)) if self.langs else (np.zeros(0), None)
        if not len(codes):
            return UNKNOWN, 0.0
        if len(codes) > self.size:  # ranks count for the most frequent only
            line = np.partition(n, len(n) - self.size)[len(n) - self.size]
            codes, n = codes[n >= line], n[n >= line]
        top = codes[np.lexsort((codes, -n))][: self.size]
        distance = self.distances(top)
        order = np.argsort(distance, kind="stable")
        if len(order) == 1:
            return self.langs[0], float(1 - distance[0] / (self.size * len(top)))
        first, second = float(distance[order[0]]), float(distance[order[1]])
        return self.langs[order[0]], second / (first + second) if second else 0.5


def identify(profile: DataFrame, text: Column, size: int = 400, max_languages: int = 2000) -> Column:
    """struct(lang, score) of a text column."""
    profile = cut(profile, "profiles")
    n = profile.select("lang").distinct().count()
    if n > max_languages:
        raise ValueError(f"{n} languages to learn; max_languages is {max_languages}")
    model = profile.sparkSession.sparkContext.broadcast(RankOrder([tuple(r) for r in profile.collect()], size))

    @F.arrow_udf("struct<lang: string, score: double>")
    def of(texts: pa.Array) -> pa.Array:
        found = [model.value.judge(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang", "score"])

    return of(text)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; documents with remainder 2 teach nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    found = identify(profiles(docs.where(~held_out)), F.col("text"))
    return docs.select("doc_id", held_out.alias("held_out"), found.alias("f")).select("doc_id", "held_out", F.col("f.lang").alias("lang_pred"), "f.score")
