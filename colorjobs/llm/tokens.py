"""Operator 4: token ids in Parquet list columns, for selective token and metadata reads.

Layout: documents in ascending doc_id order over shards (files); each row holds the ids of one document. The list column
is delta-encoded or dictionary-encoded as asked; row groups are bounded in bytes and pages in rows, so the column and
page indexes of each file let a reader fetch a range of doc_ids, or only the metadata columns, without the other pages.
Spark's own Parquet writer makes the files under its commit protocol, so lost executors leave no half-written shard.

The tokenizer is called for distinct pieces of text only (see Encoder); the ids are those of the whole text, whatever its
characters (letters newer than Python's Unicode, numerals, special tokens).

Shards are ranges of (doc_id, first characters of the text), so a doc_id that very many rows share is not one task.

Defined cases: null text is empty and yields the end id alone; equal doc_ids are ordered by text (null first); null doc_id
comes first; rows that repeat are encoded one by one; other columns are not read; an empty table gives an empty file set
that reads back as no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import fresh_path, small_batches, table
from .pieces import Cutter

#: Words whose ids a worker remembers: where the encoder has the executor to itself, and where other stages went before it.
CACHE, STAGE_CACHE = 800_000, 120_000
_encoders: dict = {}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    The tokenizer sees each distinct word about once: texts are split at blanks, words that are not known are cut by the
    tokenizer's own pre-token pattern (see pieces.Cutter), their pieces go to it as one text, and the ids are dealt back by the
    end-of-word mark. Texts where that would not be exact, and whole batches if the ids do not come back piece by piece, are
    encoded as they are."""

    def __init__(self, path: str):
        self.cutter, self.most = Cutter(path), CACHE
        self.tokenizer, self.known = self.cutter.tokenizer, {}
        suffix, vocab = self.cutter.told["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.cutter.told, self.cuts = {}, bool(suffix)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for text, k in vocab.items():
            self.ends[k] = bool(suffix) and text.endswith(suffix)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> bool:
        """Remember the ids of these words. False if they do not come back piece by piece."""
        cut = [self.cutter.cut(w) for w in words]
        pieces = list(dict.fromkeys(p for c in cut for p in c))
        raw = self.whole([" ".join(pieces)])[0]
        ends = np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1
        if len(ends) != len(pieces) or len(ends) and 4 * ends[-1] != len(raw):
            return False
        at = [0, *(4 * ends).tolist()]
        ids = {p: raw[a:e] for p, a, e in zip(pieces, at, at[1:], strict=False)}
        for w, c in zip(words, cut, strict=True):
            self.known[w] = b"".join([ids[p] for p in c])
        return True

    def ids(self, texts: list[str]) -> list[bytes]:
        fine = [self.cuts and self.cutter.plain(t) for t in texts]
        words = [self.cutter.words(t) if ok else () for t, ok in zip(texts, fine, strict=True)]
        unseen = set().union(*words).difference(self.known)
        if len(self.known) + len(unseen) > self.most:
            self.known.clear()
            unseen = set().union(*words)
        if unseen and not self.learn(list(unseen)):
            return self.whole(texts)
        of = self.known.__getitem__
        rest = iter(self.whole([t for t, ok in zip(texts, fine, strict=True) if not ok]))
        return [b"".join(map(of, w)) if ok else next(rest) for w, ok in zip(words, fine, strict=True)]


def encoder(path: str, most: int = CACHE) -> Encoder:
    """The worker's encoder, which from now on remembers at most so many words."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].most = most
    return _encoders[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, encoding: str = "delta", row_group_bytes: int = 32 << 20,
    page_rows: int = 500, words: int = CACHE) -> None:
    """Columns doc_id, shard, at (ids before the document in its shard), n_tokens, tokens.

    delta: DELTA_BINARY_PACKED ids; dictionary: RLE_DICTIONARY ids, which falls back to plain where a row group has too many.
    words: how many a worker remembers, which changes time and memory only."""
    small_batches(docs.sparkSession)

    def encode(batches):
        from pyspark import TaskContext

        own, at, end = encoder(tokenizer, words), 0, np.array([end_id], "<u4").tobytes()
        shard = TaskContext.get().partitionId()
        for b in batches:
            ids = [x + end for at_ in range(0, b.num_rows, 500) for x in own.ids([t or "" for t in b.column(1)[at_ : at_ + 500].to_pylist()])]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), shard), pa.int32()), pa.array(at + ends - n, pa.int64()),
                pa.array(n, pa.int64()), lists], ["doc_id", "shard", "at", "n_tokens", "tokens"])
            at += int(ends[-1]) if len(n) else 0

    schema = "doc_id long, shard int, at long, n_tokens long, tokens array<int>"
    by_id = F.col("doc_id").asc_nulls_first()
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(by_id, F.substring("text", 1, 40).asc_nulls_first())
    ordered = ordered.sortWithinPartitions(by_id, F.col("text").asc_nulls_first())
    writer = ordered.mapInArrow(encode, schema).write.option("parquet.block.size", row_group_bytes).option("parquet.page.row.count.limit", page_rows)
    if encoding == "delta":
        writer = writer.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false")
    elif encoding == "dictionary":
        writer = writer.option("parquet.enable.dictionary", "true")
    else:
        raise ValueError(f"encoding must be delta or dictionary, not {encoding!r}")
    writer.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "tokens"),
    ids: tuple[int, int] | None = None) -> DataFrame:
    """Only the asked columns are read, and with ``ids`` (first, last) only pages that can hold them. start: ids of all
    documents before this one, from the files' own columns: one total for each shard is summed, not the documents."""
    files = spark.read.parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    first = shards.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    rows = files if ids is None else files.where(F.col("doc_id").between(*ids))
    if "start" in columns:
        rows = rows.join(F.broadcast(first), "shard").withColumn("start", F.col("first") + F.col("at"))  # one row a file
    return rows.select(*columns)


def digest(ids) -> "F.Column":
    """Unsigned crc32 of a list column's ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("long")
    def crc(lists: pa.Array) -> pa.Array:
        values = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
        at = lists.offsets.to_numpy()
        return pa.array([zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())

    return crc(ids)


def token_table(spark: SparkSession, docs: DataFrame, words: int = CACHE) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), words=words)
    back = read_tokens(spark, path)
    return back.select("doc_id", "start", F.size("tokens").cast("long").alias("n_tokens"), digest(F.col("tokens")).alias("ids_crc32"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: written as token ids, read back from the files."""
    return token_table(spark, table(spark, sf_dir, "documents"))


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: every row of docs (copies too) written as token ids, then what the files say of each."""
    return token_table(spark, docs, STAGE_CACHE)
