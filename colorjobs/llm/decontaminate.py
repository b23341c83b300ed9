"""Operator 8: benchmark decontamination as a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` consecutive words (a shorter item is one window). The tokens of the
join are shingles of ``gram`` words (the whole window where it is shorter). A window is contained in a document only if
all of its shingles are, so by the prefix principle for containment 1.0 a prefix of one shingle is enough: its rarest. The
rarity of a shingle is its count over all documents, kept in 2**20 hashed buckets, one pass for all of the benchmark; it
decides the order only, never the result. The join looks document shingles up among the prefix shingles; the shingle's
position in the window says where the window would have to start (positional bound) and whether it fits into the document
(length bound), and the words themselves are compared at the end, so hashes never decide.

The benchmark is the broadcast side. Long items are cut into pieces that overlap by a window less one word, the pieces'
size is summed, and they are dealt into blocks of about ``block_chars`` characters. Documents are streamed once for each
block, one block after the other: its findings are written by the hash of the text, its index is dropped, and in the end the
findings of all blocks are merged. So neither a broadcast nor a worker grows with the benchmark. Equal windows of a block are one.

Defined cases: a null or empty text has no words, is never contaminated and gets the digest of the empty string; items
with no words have no windows; repeated documents are judged one by one; item ids that repeat count once; an item with
a null id contaminates like any other, but is not among the ids that are listed and counted; columns of documents are kept
whatever their names; an empty table of documents gives no rows, an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import WordHashes, cut, lower_ascii, small_batches, table, unused

#: Words of the contamination rule: ASCII letters and digits, and everything beyond ASCII.
TOKEN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
JAVA_WORDS = r"[0-9A-Za-z[^\x00-\x7F]]+"
HITS = "struct<n_words: long, spans: array<int>, items: array<string>>"
BUCKETS, PIECE = 1 << 20, 20_000
#: Words whose hash a task remembers.
MEMORY = 100_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(lower_ascii(text)) if text else []


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ hashes[i : i + n]) * _ODD
        out ^= out >> np.uint64(31)
    return out


def buckets(shingle_hashes: np.ndarray) -> np.ndarray:
    return (shingle_hashes >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1)


def item_pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, text): the words of items, joined by one space, in pieces that share no window."""

    def of(batches):
        for b in batches:
            ids, texts = [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = tokens(text.as_py())
                for at in range(0, max(1, len(words) - window + 1) if words else 0, PIECE):
                    ids.append(item)
                    texts.append(" ".join(words[at : at + PIECE + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["item_id", "text"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    return cut(items.mapInArrow(of, "item_id string, text string").distinct(), "items")


def item_blocks(pieces: DataFrame, block_chars: int) -> list[DataFrame]:
    """Pieces in blocks of about ``block_chars`` characters, dealt by a hash."""
    chars = pieces.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    return [pieces.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def bucket_counts(texts: DataFrame, size: int, only: np.ndarray | None) -> np.ndarray:
    """How many shingles of ``text`` fall into each bucket (of ``only``, if given). One row a bucket moves."""
    wanted = None if only is None else texts.sparkSession.sparkContext.broadcast(np.packbits(only))

    def of(batches):
        known, total = WordHashes(MEMORY), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for text in b.column(0):
                h = known.of(tokens(text.as_py()))
                if len(h):
                    np.add.at(total, buckets(shingles(h, min(size, len(h)))), 1)
        if wanted is not None:
            total *= np.unpackbits(wanted.value, count=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(of, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        out[r.k] = r.n
    return out


class PrefixIndex:
    """Windows of a block by the hash of their rarest shingle. Arrays, sorted by that hash, one set for each shingle size."""

    def __init__(self, items: list[tuple[str | None, list[str]]], window: int, gram: int, counts: np.ndarray):
        holders: dict[tuple[str, ...], set[str]] = defaultdict(set)
        entries: dict[int, list[tuple]] = defaultdict(list)
        self.words: list[str] = []
        known = WordHashes()
        for item_id, words in items:
            length, size = min(window, len(words)), min(gram, len(words))
            s = shingles(known.of(words), size)
            rare = np.lib.stride_tricks.sliding_window_view(counts[buckets(s)], length - size + 1).argmin(axis=1)
            base, new = len(self.words), False
            for i, offset in enumerate(rare.tolist()):
                w = tuple(words[i : i + length])
                if w not in holders:
                    entries[size].append((int(s[i + offset]), offset, base + i, length, w))
                    new = True
                holders[w].update(() if item_id is None else (item_id,))
            if new:
                self.words += words
        self.tables = {}
        for size, found in entries.items():
            found.sort(key=lambda e: e[:4])
            self.tables[size] = (np.array([e[0] for e in found], np.uint64), *(np.array([e[i] for e in found], np.int64) for i in (1, 2, 3)),
                [tuple(sorted(holders[e[4]])) for e in found])

    def scan(self, words: list[str], hashes: np.ndarray) -> tuple[list[int], set[str]]:
        """Flat list of [start, end) spans of occurring windows, merged, and the ids of their items."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for size, (keys, offsets, ats, lengths, ids) in self.tables.items():
            s = shingles(hashes, size)
            low, high = np.searchsorted(keys, s, side="left"), np.searchsorted(keys, s, side="right")
            for p in np.flatnonzero(high > low).tolist():
                for e in range(low[p], high[p]):
                    start = p - int(offsets[e])
                    end = start + int(lengths[e])
                    if start >= 0 and end <= len(words) and words[start:end] == self.words[ats[e] : ats[e] + end - start]:
                        items.update(ids[e])
                        spans.append((start, end))
        return merged(spans), items


def merged(spans) -> list[int]:
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def hits_column(held, text: Column) -> Column:
    """held: broadcast prefix index of one block. Hashes of words are remembered for a task, not for the worker's life."""
    known = WordHashes(MEMORY)

    @F.arrow_udf(HITS)
    def hits(texts: pa.Array) -> pa.Array:
        n, spans, found = [], [], []
        for t in texts:
            words = tokens(t.as_py())
            s, i = held.value.scan(words, known.of(words)) if words else ([], ())
            n.append(len(words))
            spans.append(s)
            found.append(sorted(i))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))],
            ["n_words", "spans", "items"])

    return hits(text)


def verdict(n_words: Column, found: Column, share: int) -> Column:
    """struct(n_words, n_hit, n_items, items_sha256, spans, contaminated). found: array of struct(spans, items), one a block that hit."""
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()),
        ("spans", pa.list_(pa.int32())), ("contaminated", pa.bool_())])

    @F.arrow_udf("struct<n_words: long, n_hit: long, n_items: long, items_sha256: string, spans: array<int>, contaminated: boolean>")
    def of(sizes: pa.Array, lists: pa.Array) -> pa.Array:
        rows = []
        for n, blocks in zip(sizes.to_pylist(), lists.to_pylist(), strict=True):
            spans = merged([s for f in blocks for s in zip(f["spans"][::2], f["spans"][1::2], strict=True)])
            items = sorted({i for f in blocks for i in f["items"]})
            hit = sum(spans[1::2]) - sum(spans[::2])
            digest = hashlib.sha256(",".join(items).encode()).hexdigest()
            rows.append({"n_words": n, "n_hit": hit, "n_items": len(items), "items_sha256": digest, "spans": spans,
                "contaminated": hit > 0 and share * hit >= n})
        return pa.array(rows, kind)

    return of(n_words, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, gram: int = 3, block_chars: int = 2_000_000,
    name: str = "verdict") -> DataFrame:
    """``docs`` with struct ``name``(n_words, n_hit, n_items, items_sha256, spans, contaminated); contaminated: any word is
    hit and at least one in ``share`` words is. ``name`` must not be a column of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = item_pieces(benchmark, window)
    counts = bucket_counts(docs, gram, bucket_counts(pieces, gram, None) > 0)
    blocks = item_blocks(pieces, block_chars)

    def hits(block: DataFrame):
        items = [(r.item_id, r.text.split(" ")) for r in block.collect()]  # about block_chars characters
        held = spark.sparkContext.broadcast(PrefixIndex(items, window, gram, counts))
        return held, hits_column(held, F.col("text"))

    pick = lambda h: F.struct(h["spans"].alias("spans"), h["items"].alias("items"))
    if len(blocks) == 1:
        h = hits(blocks[0])[1]
        return docs.withColumn(name, verdict(h["n_words"], F.array(pick(h)), share))
    # block by block: what a block finds depends on the text alone and is written by the text's hash, then its index goes
    key, own = unused(docs.columns, "key"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    found = None
    for block in blocks:
        held, h = hits(block)
        hit = docs.select(own.alias(key), pick(h).alias("found")).where(F.size("found.spans") > 0)
        part = cut(hit.groupBy(key).agg(F.first("found").alias("found")), "hits")
        held.unpersist()
        found = part if found is None else found.unionByName(part)
    lists = cut(found.groupBy(key).agg(F.collect_list("found").alias(name)), "found")  # at most one a block
    none = F.array().cast("array<struct<spans: array<int>, items: array<string>>>")
    joined = docs.withColumn(key, own).join(lists, key, "left")
    return joined.withColumn(name, verdict(F.coalesce(F.regexp_count("text", F.lit(JAVA_WORDS)).cast("long"), F.lit(0).cast("long")), F.coalesce(F.col(name), none), share)).select(
        *(f"`{c}`" for c in docs.columns), f"`{name}`")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *(f"verdict.{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))


def op8_sql() -> str:
    """The contamination rule in DuckDB's SQL: every window of every document as a text, no index."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w, least(len(w), 13) AS n FROM benchmark),
held AS (SELECT DISTINCT item, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS t FROM b WHERE n > 0),
sizes AS (SELECT DISTINCT n FROM held),
seen AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS t
  FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, item FROM seen JOIN held USING (n, t)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    name = unused(docs.columns, "verdict")
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), name=name).where(~F.col(f"{name}.contaminated")).drop(name)
