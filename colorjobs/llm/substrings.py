"""Operator 5: removal of word sequences that appeared earlier, by suffix automata of reference shards.

A window is ``window`` consecutive words. A window whose word sequence also starts earlier (smaller doc_id, or earlier in
the same document) is a repeat, and the words of repeats are removed.

Routing. One automaton over everything cannot be broadcast, because the reference is the corpus itself, and every shard's
automaton against every document would be quadratic. So windows are routed to shards by their minimizer, the smallest hash
among the ``gram``-word sequences inside: equal windows have equal minimizers and always meet. Neighbouring windows with the
same minimizer form a segment (at most 2 * window - gram words). Minimizers seen once cannot hold a repeat and are dropped
by a count; segments with equal words have equal matching statistics, so they are streamed once, for their earliest
occurrence (a map-side aggregate: copies, however many, stay one row), and the answer holds for all.

Shards. A shard holds all segments of many minimizers, about ``shard_rows`` / 2 segments; a minimizer with more than
``shard_rows`` different segments is cut into shards of its own, so an automaton is bounded whatever the data. The task that
owns a shard builds the automaton over its segments, earliest first, and streams every one of them through it for matching
statistics. Where the match is at least a window long, the automaton's state names the earliest start of that window in the
shard; segments that are themselves the earliest in all their windows need no more than that word. A minimizer with
several shards has the shards' answers merged by window hash, again map-side first.

The earliest start of each window of each different segment is then joined back to the occurrences, maximal removable
spans are gathered for each document, and the texts are cut.

Defined cases: null text has no words; a null doc_id sorts first; rows that share a doc_id are ordered by a 64-bit hash of
their text, and rows that repeat both are one document (each keeps what the first would keep). Two segments count as
equal when both their minimizers and their word hashes, 64 bits each, are equal. Other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import WORD, WordHashes, cut, drop, small_batches, table

_ODD = np.uint64(0x9E3779B97F4A7C15)


class SuffixAutomaton:
    """Of a list of word sequences, added in order of first occurrence; each state keeps the earliest (row, end) it stands for."""

    def __init__(self):
        self.next, self.link, self.length, self.first = [{}], [-1], [0], [None]

    def add(self, words, row: int) -> None:
        """Add one sequence; earlier sequences come before later ones."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for end, w in enumerate(words):
            q = nxt[last].get(w)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, w, q)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            first.append((row, end))
            link.append(0)
            p = last
            while p >= 0:
                q = nxt[p].get(w)
                if q is not None:
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
                    break
                nxt[p][w] = cur
                p = link[p]
            last = cur

    def _clone(self, p: int, w, q: int) -> int:
        nxt, link = self.next, self.link
        new = len(nxt)
        nxt.append(nxt[q].copy())
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        self.first.append(self.first[q])
        link[q] = new
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def matches(self, words, least: int):
        """Matching statistics of a sequence, as far as they reach ``least``: (end, earliest (row, end)) of the last ``least``
        words wherever the longest match that ends there is at least that long."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state, n, out = 0, 0, []
        for end, w in enumerate(words):
            q = nxt[state].get(w)
            while q is None and state:
                state = link[state]
                n = length[state]
                q = nxt[state].get(w)
            if q is None:
                continue
            state, n = q, n + 1
            if n >= least:
                s = state
                while length[link[s]] >= least:
                    s = link[s]
                out.append((end, first[s]))
        return out


_BASE = 0xD6E8FEB86659FD93
_powers = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, at least n of each."""
    if len(_powers.get("up", ())) < n:
        size = max(4096, 2 * n)
        _powers["up"] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _BASE, np.uint64))])
        _powers["down"] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, pow(_BASE, -1, 1 << 64), np.uint64))])
    return _powers["up"], _powers["down"]


def span_hashes(sums: np.ndarray, first: np.ndarray, n) -> np.ndarray:
    """A hash of n words from each first word; sums: prefix sums of the words' hashes times powers of the base."""
    out = (sums[first + n] - sums[first]) * powers(len(sums))[1][first]
    out = (out ^ (out >> np.uint64(29))) * _ODD + np.asarray(n).astype(np.uint64)
    return out ^ (out >> np.uint64(32))


def minimizers(words: list[str], window: int, gram: int, known: WordHashes):
    """Prefix sums of word hashes; minimizer of each run of windows that share its occurrence, the run's first window and
    number of words."""
    h = known.of(words)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(len(h))[0][: len(h)], out=sums[1:])
    g, w = span_hashes(sums, np.arange(len(h) - gram + 1), gram), window - gram + 1
    least = np.lib.stride_tricks.sliding_window_view(g, w).argmin(axis=1) + np.arange(len(h) - window + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    n = np.concatenate([first[1:], [len(least)]]) - 1 - first + window
    return sums, g[least[first]], first, n


def segment_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """m: minimizer, a: hash of the words, doc and high: the row, start: first word, n: words."""

    def of(batches):
        known = WordHashes()
        for b in batches:
            parts = []
            for doc, high, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if len(words := WORD.findall(text.as_py() or "")) >= window:
                    sums, m, first, n = minimizers(words, window, gram, known)
                    a = span_hashes(sums, first, n).view(np.int64)
                    parts.append((m.view(np.int64), a, np.full(len(m), doc, np.int64), np.full(len(m), high, np.int64), first.astype(np.int32),
                        n.astype(np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["m", "a", "doc", "high", "start", "n"])

    return docs.select("doc", "high", "text").mapInArrow(of, "m long, a long, doc long, high long, start int, n int")


WORDS = "m long, a long, shard long, shards int, doc long, high long, start int, words string"


def with_words(segments: DataFrame, docs: DataFrame) -> DataFrame:
    """segments (m, a, shard, shards, doc, high, start, n) with their words, joined by one space."""
    kind = pa.schema([("m", pa.int64()), ("a", pa.int64()), ("shard", pa.int64()), ("shards", pa.int32()), ("doc", pa.int64()), ("high", pa.int64()),
        ("start", pa.int32()), ("words", pa.string())])
    wanted = segments.groupBy("doc", "high").agg(F.collect_list(F.struct("m", "a", "shard", "shards", "start", "n")).alias("s"))  # a row's own segments

    def of(batches):
        for b in batches:
            out = []
            for doc, high, text, segs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                words = WORD.findall(text.as_py())
                for s in segs:
                    out.append(s | {"doc": doc, "high": high, "words": " ".join(words[s["start"] : s["start"] + s["n"]])})
            if out:
                yield pa.RecordBatch.from_pylist(out, kind)

    rows = docs.dropDuplicates(["doc", "high"]) if "high_used" in docs.columns else docs
    return rows.select("doc", "high", "text").join(wanted, ["doc", "high"]).select("doc", "high", "text", "s").mapInArrow(of, WORDS)


STARTS = "m long, a long, shards int, docs array<long>, highs array<long>, starts array<int>, hashes array<long>"


def automaton_starts(window: int):
    """For one shard: the earliest (doc, high, start) of every window of every segment. Of a minimizer with one shard only
    segments are named that have a window which starts earlier in another one."""
    kind = pa.schema([("m", pa.int64()), ("a", pa.int64()), ("shards", pa.int32()), ("docs", pa.list_(pa.int64())), ("highs", pa.list_(pa.int64())),
        ("starts", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64()))])

    def of(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["doc"], r["high"], r["start"]))
        automaton, texts = SuffixAutomaton(), [r["words"].split(" ") for r in rows]
        for k, words in enumerate(texts):
            automaton.add(words, k)
        out = []
        for k, (r, words) in enumerate(zip(rows, texts, strict=True)):
            found = automaton.matches(words, window)
            if r["shards"] == 1 and all(at == (k, end) for end, at in found):
                continue
            first = [rows[at[0]] for _, at in found]
            hashes = [xxhash.xxh3_64_intdigest(" ".join(words[e - window + 1 : e + 1])) - (1 << 63) for e, _ in found] if r["shards"] > 1 else []
            out.append({"m": r["m"], "a": r["a"], "shards": r["shards"], "docs": [x["doc"] for x in first], "highs": [x["high"] for x in first],
                "starts": [x["start"] + at[1] - window + 1 for x, (_, at) in zip(first, found, strict=True)], "hashes": hashes})
        return pa.Table.from_pylist(out, kind)

    return of


def earliest_starts(content: DataFrame, docs: DataFrame, window: int, shard_rows: int) -> DataFrame:
    """(m, a, docs, highs, starts): the earliest start of each window, for segments with a window that starts earlier in another segment."""
    large = cut(content.groupBy("m").agg(F.count("*").alias("kinds")).where(F.col("kinds") > shard_rows), "large")
    buckets = max(1, -(-2 * content.count() // shard_rows))
    shards = F.coalesce(F.ceil(F.col("kinds") / shard_rows).cast("int"), F.lit(1))
    shared = F.when(F.col("kinds").isNull(), F.pmod(F.xxhash64("m"), F.lit(buckets))).otherwise(F.xxhash64("m", F.pmod("a", shards)))
    dealt = content.join(large, "m", "left").select("m", "a", shared.alias("shard"), shards.alias("shards"), "rep.doc", "rep.high", "rep.start", "n")
    found = cut(with_words(dealt, docs).groupBy("shard").applyInArrow(automaton_starts(window), STARTS), "starts")
    if not large.take(1):
        return found.select("m", "a", "docs", "highs", "starts")
    many = found.where("shards > 1").select("m", "a", F.posexplode(F.arrays_zip("docs", "highs", "starts", "hashes")).alias("i", "w")).select("m",
        "a", "i", "w.*")
    least = cut(many.groupBy("m", "hashes").agg(F.min(F.struct("docs", "highs", "starts")).alias("least")), "least")
    merged = many.join(least, ["m", "hashes"]).groupBy("m", "a").agg(F.array_sort(F.collect_list(F.struct("i", "least"))).alias("w"))  # a segment's windows
    merged = merged.select("m", "a", *(F.col(f"w.least.{c}").alias(c) for c in ("docs", "highs", "starts")))
    return found.where("shards = 1").select("m", "a", "docs", "highs", "starts").unionByName(merged)


def removable(occurrences: DataFrame, content: DataFrame, starts: DataFrame, window: int) -> DataFrame:
    """(doc, high, spans): flat [start, end) word spans that repeats cover."""
    answer = cut(content.select("m", "a", "rep").join(starts, ["m", "a"], "left"), "answers")
    joined = occurrences.join(answer, ["m", "a"])
    # a segment with no answer is the earliest in all its windows: they are repeats wherever else it occurs
    whole = F.when(F.struct("doc", "high", "start") > F.col("rep"), F.array(F.struct(F.lit(0).alias("from"), F.col("n").alias("to"))))

    def repeat(x: Column, i: Column) -> Column:
        earlier = (x["highs"] < F.col("high")) | ((x["highs"] == F.col("high")) & (x["starts"] < F.col("start") + i))
        return F.when((x["docs"] < F.col("doc")) | ((x["docs"] == F.col("doc")) & earlier), F.struct(i.alias("from"), (i + window).alias("to")))

    each = F.transform(F.arrays_zip("docs", "highs", "starts"), repeat)
    spans = joined.select("doc", "high", "start", F.when(F.col("docs").isNull(), whole).otherwise(F.array_compact(each)).alias("s")).where(F.size("s") > 0)

    def joined_to(acc: Column, x: Column) -> Column:  # runs of neighbouring windows as one span
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["from"].alias("from"), x["to"].alias("to"))))
        return F.when((F.size(acc) > 0) & (x["from"] <= last["to"]), longer).otherwise(F.concat(acc, F.array(x)))

    runs = F.aggregate("s", F.expr("cast(array() as array<struct<from:int,to:int>>)"), joined_to)
    flat = spans.select("doc", "high", "start", F.explode(runs).alias("r"))
    span = F.struct((F.col("start") + F.col("r.from")).alias("from"), (F.col("start") + F.col("r.to")).alias("to"))
    return flat.groupBy("doc", "high").agg(F.collect_list(span).alias("spans"))  # a row's own spans


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, doc (never null), high (a hash that tells rows of one doc_id apart; 0 where ids are unique), text."""
    base = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), "text")
    if base.groupBy("doc").count().where("count > 1").take(1):
        return base.withColumn("high", F.xxhash64("text")).withColumn("high_used", F.lit(True))
    return base.withColumn("high", F.lit(0).cast("long"))


def remove_repeats(docs: DataFrame, window: int = 20, gram: int = 6, shard_rows: int = 2000) -> DataFrame:
    """doc_id, text, spans (array of from, to: word positions to remove; null if none), one row for each row of docs."""
    if not 0 < gram <= window:
        raise ValueError("gram must lie between 1 and window")
    small_batches(docs.sparkSession)
    rows = keyed(docs)
    found = cut(segment_rows(rows, window, gram), "segments")
    repeated = cut(found.groupBy("m").agg(F.count("*").alias("c")).where("c > 1").select("m"), "repeated")
    occurrences = cut(found.join(repeated, "m", "left_semi"), "occurrences")
    drop(found, repeated)
    content = cut(occurrences.groupBy("m", "a").agg(F.min(F.struct("doc", "high", "start")).alias("rep"), F.first("n").alias("n")), "content")
    spans = removable(occurrences, content, earliest_starts(content, rows, window, shard_rows), window)
    return rows.join(spans, ["doc", "high"], "left").select("doc_id", "text", "spans")


def kept_words(text: str | None, spans) -> tuple[int, list[str]]:
    """Number of words, and those outside the spans (pairs of from, to)."""
    words = WORD.findall(text or "")
    if not spans:
        return len(words), words
    gone = np.zeros(len(words) + 1, np.int32)
    for a, b in spans:
        gone[a] += 1
        gone[b] -= 1
    gone = np.cumsum(gone)
    return len(words), [w for w, g in zip(words, gone.tolist(), strict=False) if not g]


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its words, how many are repeats, and a digest of what is kept."""
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))

    @F.arrow_udf("struct<n_words: long, n_removed: long, kept_sha256: string>")
    def digest(texts: pa.Array, spans: pa.Array) -> pa.Array:
        n, removed, sha = [], [], []
        for t, s in zip(texts, spans.to_pylist(), strict=True):
            count, kept = kept_words(t.as_py(), [(x["from"], x["to"]) for x in s or ()])
            n.append(count)
            removed.append(count - len(kept))
            sha.append(hashlib.sha256(" ".join(kept).encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
            ["n_words", "n_removed", "kept_sha256"])

    return found.select("doc_id", digest("text", "spans").alias("d")).select("doc_id", "d.*")


def op5_sql() -> str:
    """The repeat rule in DuckDB's SQL: every window of every document as a text."""
    windows = "range(1, greatest(len(w) - 18, 1))"
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
seen AS (SELECT doc_id, unnest({windows}) AS i, unnest(list_transform({windows}, lambda i: array_to_string(w[i:i + 19], ' '))) AS t FROM d),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS k FROM seen) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM again),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS text FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d) ANTI
  JOIN gone USING (doc_id, k) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)"""
