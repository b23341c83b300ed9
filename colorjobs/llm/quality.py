"""Operator 6: quality by nearest-neighbour voting over latent-semantic vectors.

Terms of a document, hashed into ``DIMENSIONS`` columns: its words, the three-character sequences of its character
classes (case, digits, each punctuation mark), and bins of a few whole-text shares (distinct words, most frequent word,
upper case, punctuation, word length). Weights: (1 + log count) times inverse document frequency over all documents, each
kind of term scaled to unit length. A truncated singular value decomposition of a bounded sample of labelled documents
(``sample`` rows a label, those with the smallest hash of the id) gives the latent space. Their term vectors come to the
driver, not their texts: at most 2 * sample * DIMENSIONS pairs of 8 bytes, however long the texts are. The sample's latent
vectors and labels are broadcast (sample * labels * rank floats, a fixed bound). Every document's vector is compared with
all of them by exact cosine in blocks, and its ``k`` nearest vote for their labels, weighted by similarity.

Defined cases: null and empty texts have the bins only and get a score like any other; a document with several labels
teaches the smallest; null labels teach nothing; with no label, or one label only, every score is that label (0.5 for none);
equal similarities at the last place are settled by the order of the sample; rows that repeat are scored one by one, and
each teaches as far as the sample's bound goes; the stage keeps all columns, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import WORD, crc_mod, cut, small_batches, table, unused

WORDS, SHAPES, BINS = 2048, 2048, 64
DIMENSIONS = WORDS + SHAPES + BINS
CLASSES = 40
#: Words whose place a worker remembers.
MEMORY = 60_000


def _class_table() -> np.ndarray:
    """Code point below 256 -> character class; classes of others are 'letter'."""
    out = np.zeros(256, np.int64)
    for c in range(256):
        s = chr(c)
        out[c] = 0 if s.islower() else 1 if s.isupper() else 2 if s.isdigit() else 3 if s == " " else 4 if s.isspace() else 5 + c % (CLASSES - 5)
    return out


CLASS = _class_table()
_word_slot: dict[str, int] = {}


def slot_of(word: str) -> int:
    k = _word_slot.get(word)
    if k is None:
        if len(_word_slot) >= MEMORY:
            _word_slot.clear()
        k = _word_slot[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS
    return k


def binned(share: float, bins: int = 8) -> int:
    return min(bins - 1, int(share * bins))


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(columns, weights before idf) of a document, columns ascending."""
    text = text or ""
    words = WORD.findall(text)
    n, chars = len(words), max(1, len(text))
    slots = np.bincount(np.fromiter(map(slot_of, words), np.int64, n), minlength=WORDS) if n else np.zeros(WORDS, np.int64)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    shape = CLASS[np.where(code < 256, code, 97)]
    trigrams = np.bincount((shape[:-2] * CLASSES * CLASSES + shape[1:-1] * CLASSES + shape[2:]) % SHAPES,
        minlength=SHAPES) if len(code) > 2 else np.zeros(SHAPES, np.int64)
    kinds = np.bincount(shape, minlength=CLASSES)
    top = Counter(words).most_common(1)[0][1] / n if n else 0.0
    values = (
        binned(np.log2(n + 1) / 16), binned(len(set(words)) / n if n else 0.0), binned(top), binned(kinds[1] / chars), binned(kinds[5:].sum() / chars * 2),
        binned(kinds[2] / chars * 4), binned((kinds[0] + kinds[1]) / max(1, n) / 16), binned(kinds[4] / chars * 8),
    )
    at = [np.flatnonzero(slots), np.flatnonzero(trigrams)]
    columns = np.concatenate([at[0], WORDS + at[1], WORDS + SHAPES + 8 * np.arange(8) + np.array(values)])
    weights = np.concatenate([1 + np.log(slots[at[0]]), 1 + np.log(trigrams[at[1]]), np.ones(8)])
    return columns, weights


def terms_column(text: Column) -> Column:
    @F.arrow_udf("struct<columns: array<int>, weights: array<double>>")
    def of(texts: pa.Array) -> pa.Array:
        found = [terms(t.as_py()) for t in texts]
        columns = pa.array([c.astype(np.int32) for c, _ in found], pa.list_(pa.int32()))
        return pa.StructArray.from_arrays([columns, pa.array([w for _, w in found], pa.list_(pa.float64()))], ["columns", "weights"])

    return of(text)


def document_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each column occurs, over all documents, and the number of documents."""

    def of(batches):
        seen = np.zeros(DIMENSIONS + 1, np.int64)
        for b in batches:
            for text in b.column(0):
                seen[terms(text.as_py())[0]] += 1
            seen[-1] += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1)), pa.array(seen)], ["k", "n"])

    rows = docs.select("text").mapInArrow(of, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # one row a column
    out = np.zeros(DIMENSIONS + 1, np.int64)
    for r in rows:
        out[r.k] = r.n
    return out[:-1], int(out[-1])


def leading(x: np.ndarray, rank: int, rounds: int = 8) -> np.ndarray:
    """The right singular vectors of the ``rank`` largest singular values, by subspace iteration (no n-by-n matrix)."""
    width = min(rank + 16, *x.shape)
    if not width:
        return np.zeros((x.shape[1], 1), np.float32)
    q = np.linalg.qr(x.T @ np.random.default_rng(11).standard_normal((len(x), width)).astype(np.float32))[0]
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    return q @ np.linalg.svd(x @ q, full_matrices=False)[2].T[:, :rank]


class NearestVote:
    def __init__(self, idf: np.ndarray, documents: list[tuple[np.ndarray, np.ndarray]], labels: list[int], rank: int, k: int):
        """documents: what terms() says of each."""
        self.idf, self.k, self.labels = idf, k, np.array(labels, np.float64)
        x = np.zeros((len(documents), DIMENSIONS), np.float32)
        for i, (columns, weights) in enumerate(documents):
            x[i, columns] = self.weigh(columns, weights)
        self.basis = leading(x, rank)
        self.known = self.unit(x @ self.basis)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def weigh(self, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
        w = weights * self.idf[columns]
        for low, high in ((0, WORDS), (WORDS, WORDS + SHAPES), (WORDS + SHAPES, DIMENSIONS)):
            a, b = np.searchsorted(columns, (low, high))
            w[a:b] /= max(1e-9, np.sqrt((w[a:b] ** 2).sum()))
        return w

    def latent(self, text: str | None) -> np.ndarray:
        columns, weights = terms(text)
        return self.weigh(columns, weights).astype(np.float32) @ self.basis[columns]

    def scores(self, texts) -> np.ndarray:
        """A block of documents."""
        if not len(self.labels) or self.labels.min() == self.labels.max():
            return np.full(len(texts), self.labels[0] if len(self.labels) else 0.5)
        if not len(texts):
            return np.zeros(0)
        near = self.unit(np.stack([self.latent(t) for t in texts])) @ self.known.T
        k = min(self.k, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(near, best, axis=1), 1e-6).astype(np.float64) ** 4
        return np.clip((w * self.labels[best]).sum(axis=1) / w.sum(axis=1), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = 1500, rank: int = 64, k: int = 15) -> NearestVote:
    """docs (doc_id, text); labels (doc_id, label 0/1); learn: condition on doc_id of the rows to learn from.

    At most ``sample`` documents of each label are fitted to, the same ones on every run."""
    small_batches(docs.sparkSession)
    seen, n = document_counts(docs)
    known = labels.where(learn & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"))
    by_hash = [F.xxhash64("doc_id", F.lit(6)), F.col("doc_id")]
    chosen = [known.where(F.col("label") == v).orderBy(*by_hash).limit(sample) for v in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * sample rows at most
    # equal rows are one, and the bound holds for each label: however often a document repeats, it crowds out no label
    found = docs.join(few, "doc_id").select("doc_id", "label", F.xxhash64("text").alias("h"), "text").dropDuplicates(["doc_id", "h"])
    found = cut(found.select("doc_id", "label", "h", terms_column(F.col("text")).alias("t")), "sample")
    rows = [r for v in (0, 1) for r in found.where(F.col("label") == v).orderBy(*by_hash, "h").limit(sample).select("label", "t").collect()]
    documents = [(np.array(r.t.columns, np.int64), np.array(r.t.weights, np.float64)) for r in rows]
    return NearestVote(np.log((1 + n) / (1 + seen)) + 1e-3, documents, [r.label for r in rows], rank, k)


def score_column(spark: SparkSession, model: NearestVote, text: Column) -> Column:
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        found = [held.value.scores(texts[at : at + 256].to_pylist()) for at in range(0, len(texts), 256)]
        return pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return of(text)


def quality_scores(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Column:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    learn = F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(False))
    return score_column(spark, fit(docs.select("doc_id", "text"), labels, learn), F.col("text"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document; labels of documents with remainder 1 teach nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = docs.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), quality_scores(spark, docs, sf_dir).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5 go."""
    score = unused(docs.columns, "score")
    return docs.withColumn(score, quality_scores(spark, docs, sf_dir)).where(F.col(score) >= 0.5).drop(score)
