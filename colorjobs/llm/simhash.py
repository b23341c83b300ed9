"""Operator 9: SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprint: 64 bits, each the majority of that bit over the XXH64 values of the text's word shingles. Two fingerprints
at distance <= 4 both reach some 64-bit value by flipping at most two bits each, so every fingerprint emits its ball of
2,081 variants and fingerprints that meet on a variant are linked (and checked by popcount).

Writing 2,081 rows for each fingerprint would be the whole cost, so the shuffle carries the ball by the leading bits
only: a fingerprint goes once to each value that its first ``p`` bits can take with at most two flips (1 + p + C(p, 2)
rows), and the rest of the ball is enumerated where the leading bits meet. ``p`` follows the number of distinct
fingerprints, so a group holds about ``cap`` variants; a group that holds more (dense clusters) is split by the next
bits, again and again, down to single variants, so no group is unbounded and no ball is cut.

A group returns a spanning forest of its links, never pairs: every member with its smallest linked fingerprint. The
forests are joined into components by alternating large-star and small-star steps, each written to the shared folder.
Equal fingerprints are folded to one before anything else.

Defined cases: no words (null or blank text) gives fingerprint zero, linked like any other; fewer words than a shingle:
the whole sequence is the one shingle; a null doc_id takes part but never names a component unless all its ids are null,
and then the component's id is null; rows that repeat are members like others; other columns are not read by the operator,
and the stage keeps them, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import WORD, cut, drop, lower_ascii, row_text, small_batches, table, unused

BITS = 64


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    words = WORD.findall(lower_ascii(text)) if text else []
    if not words:
        return 0
    raw = [w.encode() for w in words]
    joined = b" ".join(raw)
    ends = np.cumsum([len(w) + 1 for w in raw]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(raw))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[: len(raw) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)),
        np.uint64, len(raw) - k + 1)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(((2 * counts > len(hashes)).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprint_column(text, shingle: int = 4):
    """The fingerprint of a text column as a signed long."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64), pa.int64())

    return of(text)


def flips(n: int, most: int) -> np.ndarray:
    """All n-bit masks with at most ``most`` bits, lightest first."""
    one = np.uint64(1) << np.arange(n, dtype=np.uint64)
    out = [np.zeros(1, np.uint64)]
    if most >= 1:
        out.append(one)
    if most >= 2 and n > 1:
        i, j = np.triu_indices(n, 1)
        out.append(one[i] | one[j])
    return np.concatenate(out)


def ball_size(n: int, most) -> int:
    return [1, 1 + n, 1 + n + n * (n - 1) // 2][most]


def forest(fp: np.ndarray, spent: np.ndarray, low_bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of one group with the smallest fingerprint each is linked to. fp: signed; spent: flips used so far."""
    bits = fp.view(np.uint64)
    low = bits & np.uint64((1 << low_bits) - 1)
    values, owner = [], []
    for left in range(radius // 2 + 1):
        at = np.flatnonzero(spent == radius // 2 - left)
        masks = flips(low_bits, left)
        values.append((low[at, None] ^ masks[None, :]).ravel())
        owner.append(np.repeat(at, len(masks)))
    value, who = np.concatenate(values), np.concatenate(owner)
    order = np.argsort(value, kind="stable")
    value, who = value[order], who[order]
    same = np.flatnonzero(value[1:] == value[:-1])
    a, b = who[same], who[same + 1]
    del value, who, order
    ok = (a != b) & (np.bitwise_count(bits[a] ^ bits[b]) <= radius)
    code = np.unique(np.minimum(a, b)[ok] * np.int64(len(fp)) + np.maximum(a, b)[ok])
    a, b = code // len(fp), code % len(fp)
    rank = np.argsort(np.argsort(fp, kind="stable"), kind="stable")  # so that the smallest fingerprint is the root
    by_rank = np.sort(fp)
    label = np.arange(len(fp))
    a, b = rank[a], rank[b]
    while len(a):
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    child = np.flatnonzero(label != np.arange(len(fp)))
    return by_rank[child], by_rank[label[child]]


def group_forest(low_bits: int, radius: int):
    def of(group: pa.Table) -> pa.Table:
        child, root = forest(group.column("fp").to_numpy(), group.column("spent").to_numpy(), low_bits, radius)
        return pa.table({"u": child, "v": root})

    return of


def ball_links(fps: DataFrame, radius: int = 4, cap: int = 2_000_000) -> DataFrame:
    """(u, v) with u > v: links among the distinct longs of column fp that connect what lies within ``radius`` (4 at most)."""
    if not 0 <= radius <= 4 or radius % 2:
        raise ValueError("radius must be 0, 2 or 4")
    spark, half = fps.sparkSession, radius // 2
    n = fps.count()
    bits = min(32, max(2, int(np.ceil(np.log2(max(1, n * ball_size(BITS, half)) / (cap / 2))))))
    entries, depth, found = fps.select("fp", F.lit(0).alias("spent"), F.lit(0).cast("long").alias("key")), 0, []

    def grow(df: DataFrame, depth: int, step: int) -> DataFrame:
        """Each entry once for each value that the next ``step`` bits can take within what flips are left."""
        masks = [(int(m), int(m).bit_count()) for m in flips(step, half)]
        options = F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit(w).alias("w")) for m, w in masks))
        nxt = F.shiftrightunsigned("fp", BITS - depth - step).bitwiseAND(F.lit((1 << step) - 1).cast("long")) if step < 64 else F.col("fp")
        return df.select("fp", "spent", "key", F.explode(options).alias("o")).where(F.col("spent") + F.col("o.w") <= half).select("fp",
            (F.col("spent") + F.col("o.w")).alias("spent"), F.shiftleft("key", step).bitwiseOR(nxt.bitwiseXOR(F.col("o.m"))).alias("key"))

    step = bits
    while True:
        entries, depth = grow(entries, depth, step), depth + step
        low = BITS - depth
        weight = F.element_at(F.array(*(F.lit(ball_size(low, half - s)) for s in range(half + 1))), F.col("spent") + 1)
        heavy = entries.groupBy("key").agg(F.sum(weight).alias("w")).where(F.col("w") > cap).select("key") if low else None
        heavy = cut(heavy, "heavy") if heavy is not None else None
        more = heavy is not None and bool(heavy.take(1))
        light = entries.join(heavy, "key", "left_anti") if more else entries

        found.append(light.groupBy("key").applyInArrow(group_forest(low, radius), "u long, v long"))
        if not more:
            break
        entries, step = cut(entries.join(heavy, "key", "left_semi"), "dense"), min(6, low)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root): every node that has a link, with the smallest node of its component. links: (u, v), u > v, longs.

    Alternating large-star and small-star; ends when a round changes nothing. Rounds grow with the logarithm of the nodes.
    """
    now, seen = cut(links.select("u", "v"), "links"), None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # cut, so that both sides of the join are plain exchanges: a node with very many links is split by adaptive execution
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = cut(large.join(least, "u").select(F.explode(pair).alias("e")).select("e.*").where("u > v").distinct(), "links")
        drop(now, low)
        now = small
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
    raise RuntimeError(f"components did not settle in {most} rounds")


def rooted(firsts: DataFrame, radius: int = 4, cap: int = 2_000_000) -> DataFrame:
    """fp, first and root: the smallest fingerprint of its component. firsts: (fp, first), one row a fingerprint."""
    roots = components(ball_links(firsts.select("fp"), radius, cap))
    return firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, cap: int = 2_000_000) -> DataFrame:
    """doc_id, fp (signed long), component_id: the smallest doc_id that links of at most ``radius`` bits reach. One row for each row of docs."""
    small_batches(docs.sparkSession)
    own = cut(docs.select("doc_id", fingerprint_column(F.col("text"), shingle).alias("fp")), "fingerprints")
    firsts = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    tree = cut(rooted(firsts, radius, cap), "tree")
    lowest = cut(tree.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    member = tree.join(lowest, "root").select("fp", "component_id")
    return own.join(member, "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one row stays: the smallest doc_id (null last), then the smallest hash of the text (null first), then
    the other columns as text. Rows with equal ids in different groups do not compete.

    The choice is made on ids and hashes. Rows that are equal in every column become one (before they move, where they lie
    together), and documents move once, to meet the chosen keys."""
    small_batches(spark)
    names, key = [f"`{c}`" for c in docs.columns], unused(docs.columns, "key")
    digest, rest = F.sha2("text", 256), row_text(docs, leave_out=("doc_id", "text"))
    own = F.sha2(row_text(docs), 256)
    seen = cut(docs.select("doc_id", digest.alias("h"), rest.alias("rest"), own.alias("key"), fingerprint_column(F.col("text")).alias("fp")), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "h", "rest", "key")
    firsts = cut(seen.groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    stay = rooted(firsts).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias(key))
    return docs.withColumn(key, own).dropDuplicates([key]).join(cut(stay, "stay"), key).select(*names)
