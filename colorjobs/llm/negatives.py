"""Operator 13: hard negatives by a secondary sort.

Every anchor is scored against all rows, block by block: anchors are broadcast in blocks of a fixed number (a stated query
set against all rows), and rows are streamed past them where they lie. A pair is packed into one key of bytes, (anchor,
descending score, positives first, id, row), whose order as bytes is the order that is wanted; repartitionAndSortWithinPartitions
deals the keys by anchor and sorts them, and an iterator reads each anchor's pairs once, from the highest score down: a
positive opens a window of scores, a negative goes to each open window that holds it, and a window that is full or passed
closes. So no anchor is ever held whole; the iterator knows its open windows only.

Two passes over the rows keep the shuffle small without leaving out what could be asked for. The first finds each anchor's
positives: a task sends its own best few. The second knows all windows, and a task sends, of each window, its own first few:
the first few of all tasks are among them. So a task sends a fixed number of pairs for each anchor, however many rows,
copies or rows of one label it has read.

Scores are whole numbers: components become floor(256 * x). Products are exact: as doubles where no sum can pass 2^53, else as 64-bit
integers, else as Python's integers, and what passes 64 bits counts as the nearest 64-bit integer but one.

Defined cases: rows with a null label, a null vector, a null or non-finite component, or a length other than the most common
take no part; a row with a null id takes part, last among equals, and is no anchor; rows that repeat an id are rows
of their own, so each of them is an anchor and each may be another's positive; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import cut, small_batches, table

NONE = np.iinfo(np.int64).min
MOST = np.iinfo(np.int64).max
#: Pairs that are scored at a time (32 MB of scores).
PAIRS = 4 << 20
KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("negative", "u1"), ("unnamed", "u1"), ("id", ">u8"), ("row", ">u8")])
UNPACK = ">QQBBQQ"
BIAS = 1 << 63
FIELDS = ("score", "unnamed", "id", "row")


def usable(vectors: DataFrame) -> DataFrame:
    """id, label, v (whole numbers), row: what can take part."""
    good = vectors.where(F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    size = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    good = good.where(F.size("v") == (size[0].d if size else 0))
    return good.select("id", "label", F.transform("v", lambda x: F.floor(x * 256.0)).alias("v"), F.monotonically_increasing_id().alias("row"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of ``a`` with rows of ``b``, as 64-bit integers."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -MOST, MOST).astype(np.int64)


class Firsts:
    """For each list of a block: its first ``k`` rows by descending score, then id (null last), then row."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.score, self.unnamed = np.full((lists, k), NONE), np.ones((lists, k), bool)
        self.id, self.row = np.zeros((lists, k), np.int64), np.zeros((lists, k), np.int64)

    def see(self, some: slice, scores: np.ndarray, rows: dict[str, np.ndarray]) -> None:
        """scores: lists by rows, NONE for rows that are not asked for; it is used up. Rows come by id, then row, so of equal scores the first is best."""
        every = np.arange(len(scores))
        found = []
        for _ in range(min(self.k, scores.shape[1])):
            at = scores.argmax(axis=1)
            found.append((scores[every, at], at))
            scores[every, at] = NONE
        score, at = (np.stack(x, axis=1) for x in zip(*found, strict=True))
        both = {"score": np.concatenate([self.score[some], score], axis=1)}
        for name in FIELDS[1:]:
            both[name] = np.concatenate([getattr(self, name)[some], rows[name][at]], axis=1)
        order = np.lexsort((both["row"], both["id"], both["unnamed"], ~both["score"]), axis=-1)[:, : self.k]
        for name in FIELDS:
            getattr(self, name)[some] = np.take_along_axis(both[name], order, axis=1)


def keys(anchor: np.ndarray, negative: bool, score: np.ndarray, unnamed: np.ndarray, id: np.ndarray, row: np.ndarray) -> list[bytes]:
    """Packed so that bytes compare as (anchor, descending score, positives first, id with null last, row)."""
    out = np.zeros(len(anchor), KEY)
    flip = lambda x: x.astype(np.uint64) ^ np.uint64(BIAS)
    out["anchor"], out["score"], out["negative"], out["unnamed"] = anchor, ~flip(score), negative, unnamed
    out["id"], out["row"] = flip(np.where(unnamed, 0, id)), row
    raw = out.tobytes()
    return [raw[i : i + KEY.itemsize] for i in range(0, len(raw), KEY.itemsize)]


def blocks_of(batches, row_block: int):
    """Arrow batches of id, label, v, row as blocks of about ``row_block`` rows, by id (null last), then row."""
    waiting, count = [], 0

    def joined() -> dict[str, np.ndarray]:
        got = {n: np.concatenate([w[n] for w in waiting]) for n in waiting[0]}
        order = np.lexsort((got["row"], got["id"], got["unnamed"]))
        return {n: x[order] for n, x in got.items()}

    for b in batches:
        if b.num_rows:
            ids = b.column("id")
            waiting.append({"id": ids.fill_null(0).to_numpy(), "unnamed": ids.is_null().to_numpy(zero_copy_only=False), "row": b.column("row").to_numpy(),
                "label": b.column("label").to_numpy(), "v": b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)})
            count += b.num_rows
        if count >= row_block:
            yield joined()
            waiting, count = [], 0
    if waiting:
        yield joined()


def pack_firsts(rows: DataFrame, held, k: int, row_block: int, windows: bool) -> DataFrame:
    """One column of keys: of each list of the block, the first ``k`` rows that a task has read.

    held: broadcast (row, label, v) of anchors and, with ``windows``, their bounds (anchors, lists, 2). Without, an anchor has one
    list, of the other rows of its label; with them, one list a window, of the rows of other labels inside."""

    def of(batches):
        own, label, v, bounds = held.value
        lists = bounds.shape[1] if windows else 1
        best = Firsts(len(own) * lists, k)
        for block in blocks_of(batches, row_block):
            step = max(1, PAIRS // (len(block["row"]) * lists))
            where = {r: i for i, r in enumerate(block["row"].tolist())}
            for a in range(0, len(own), step):
                some = slice(a, min(a + step, len(own)))
                score = products(v[some], block["v"])
                same = label[some][:, None] == block["label"]
                if windows:
                    each = np.repeat(np.where(same, NONE, score)[:, None], lists, axis=1)
                    each[(each < bounds[some, :, :1]) | (each > bounds[some, :, 1:])] = NONE
                    best.see(slice(some.start * lists, some.stop * lists), each.reshape(-1, each.shape[2]), block)
                else:
                    score[~same] = NONE
                    for i, r in enumerate(own[some].tolist()):
                        if r in where:
                            score[i, where[r]] = NONE
                    best.see(some, score, block)
        i, j = np.nonzero(best.score != NONE)
        packed = keys(own[i // lists], windows, *(getattr(best, n)[i, j] for n in FIELDS))
        for at in range(0, len(packed), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(packed[at : at + 10_000], pa.binary())], ["key"])
        if not packed:
            yield pa.RecordBatch.from_arrays([pa.array([], pa.binary())], ["key"])

    return rows.mapInArrow(of, "key binary")


def bounds_of(score: int, least: int, most: int) -> tuple[int, int]:
    """Whole scores s with least * score <= 100 * s <= most * score."""
    return max(-(-least * score // 100), -MOST), min(most * score // 100, MOST)


def emitter(positives: int, negatives: int, least: int, most: int):
    """Sorted keys in, one row for each negative of a window out. It knows only the windows of the anchor at hand that are open."""

    def emit(sorted_keys):
        now, before, met, open_ = None, None, 0, []
        for key, _ in sorted_keys:
            if key == before:  # a row that lay in several windows was sent for each
                continue
            before = key
            anchor, score, negative, unnamed, id, _ = struct.unpack(UNPACK, key)
            if anchor != now:
                now, met, open_ = anchor, 0, []
            score, id = ~score % (1 << 64) - BIAS, None if unnamed else id - BIAS
            if not negative:
                if met < positives:
                    met += 1
                    open_.append([*bounds_of(score, least, most), score, id, 0])
                continue
            for w in open_:
                if w[0] <= score <= w[1]:
                    w[4] += 1
                    yield anchor, w[3], w[4], id, w[2], score
            open_ = [w for w in open_ if w[4] < negatives and w[0] <= score]

    return emit


FOUND = "anchor long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
    row_block: int = 16_384, anchor_block: int = 4096, parts: int | None = None) -> DataFrame:
    """vectors: id, label (whole number), v. Returns anchor_id, positive_id, rank, negative_id and both scores."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = cut(usable(vectors.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
        F.col("v").cast("array<double>").alias("v"))), "vectors")
    anchors = cut(rows.where(is_anchor), "anchors")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, found = -(-anchors.count() // anchor_block), None
    by_score = W.partitionBy("anchor").orderBy("key")
    for b in range(blocks):
        block = anchors.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).collect()  # about anchor_block rows
        if not block:
            continue
        own, label, v = (np.array([r[n] for r in block], np.int64) for n in ("row", "label", "v"))
        first = pack_firsts(rows, spark.sparkContext.broadcast((own, label, v, None)), positives, row_block, False)
        first = first.withColumn("anchor", F.substring("key", 1, 8)).withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= positives)
        first = cut(first.select("key"), "positives")
        bounds = np.full((len(own), positives, 2), MOST)
        bounds[:, :, 1] = NONE
        at, used = {r: i for i, r in enumerate(own.tolist())}, [0] * len(own)
        for r in first.collect():  # a fixed number for each anchor of the block
            anchor, score, *_ = struct.unpack(UNPACK, r.key)
            i = at[anchor]
            bounds[i, used[i]] = bounds_of(~score % (1 << 64) - BIAS, least, most)
            used[i] += 1
        second = pack_firsts(rows, spark.sparkContext.broadcast((own, label, v, bounds)), negatives, row_block, True)
        records = first.unionByName(second).rdd.map(lambda r: (bytes(r[0]), None))
        dealt_out = records.repartitionAndSortWithinPartitions(parts, lambda key: int.from_bytes(key[:8], "big") * 0x9E3779B1 >> 16)
        some = cut(spark.createDataFrame(dealt_out.mapPartitions(emitter(positives, negatives, least, most)), FOUND), "negatives")
        found = some if found is None else found.unionByName(some)
    if found is None:
        return spark.createDataFrame([], FOUND).withColumnRenamed("anchor", "anchor_id")
    return found.join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector is an anchor; the label of every seventh is moved on by one."""
    label = F.col("label").cast("long")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.col("embedding").alias("v"))
    return mine(vectors, F.col("id") % 50 == 0)


def op13_sql() -> str:
    return """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q, row_number() OVER () AS n FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.n AS an, a.id AS anchor_id, r.id, r.n, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score
    FROM v a JOIN v r ON a.n <> r.n WHERE a.id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY an ORDER BY score DESC, id, n) <= 5),
w AS (SELECT p.an, p.anchor_id, p.id AS positive_id, p.n AS pn, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.an, p.n ORDER BY s.score DESC, s.id, s.n) AS rank
    FROM p JOIN s ON p.an = s.an AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 3"""
