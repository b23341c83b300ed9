"""Operator 7: nearest neighbours by multi-index hashing of learned, rotated binary codes.

Fit (bounded): principal axes of a documented sample of vectors, then the rotation that loses least when coordinates are
cut to signs (iterative quantization), from one half of the sample. The relation of cosine and Hamming distance is learned
from the other half: ``reach[c]`` is the distance within which the share ``recall`` of the pairs with cosine c or more lie.

Index: every row's code is split into substrings of ``sub_bits`` bits, and each substring has its table of values. Two
codes at distance r agree in some substring up to r // substrings bits (pigeonhole), so probing each table with all values
that close to the query's finds every code within r.

Search: the radius is each query's own. What its k best in the sample have in cosine is a floor for what its k best have,
so ``reach`` of that floor is the most it can need; inside a block of rows the radius grows step by step from the nearest
codes and ends as soon as ``reach`` of the k-th cosine found is within it. Codes found are reranked by the exact cosine of
the original vectors in double precision. The more rows, the nearer the neighbours and the smaller the radii.

Distribution: queries are broadcast in blocks of a fixed number (a stated query set against all rows, in blocks), and rows
are streamed past them where they lie: no row is copied or shuffled. A task indexes ``row_block`` rows at a time, keeps
the best ``k`` of each query, and only those move on. A query that found fewer than ``k`` is searched again with the whole
range as radius, so no query goes short.

Defined cases: vectors that are null, zero, hold null or non-finite components, or differ in length from the most common
length take no part; vectors are scaled by a power of two before norms, which changes no cosine, so very large and very
small components are as good as others; equal cosines go to the smaller id; repeated ids are vectors of their own, so a row
with the query's id is found like any other, only the query's own row is not; a null id takes part as a row of its own,
last among equals; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import cut, small_batches, table



def fine(v: Column) -> Column:
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """id, v (array of double): only what can take part."""
    good = vectors.where(fine(F.col("v")))
    size = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return good.where(F.size("v") == (size[0].d if size else 0))


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component near one. Exact."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Codes:
    """Centre, rotation, and the learned relation of cosine and distance."""

    def __init__(self, sample: np.ndarray, bits: int, k: int, recall: float, rounds: int = 40, steps: int = 64):
        self.known = unit(sample)
        # codes are fitted to one half, and what they are worth is learned on the other, which they have not seen
        halves = (self.known[::2], self.known[1::2]) if len(self.known) >= 100 else (self.known, self.known)
        x = halves[0]
        self.mean = x.mean(axis=0)
        _, _, axes = np.linalg.svd(x - self.mean, full_matrices=True)
        self.bits = min(bits, axes.shape[0])
        projected = (x - self.mean) @ axes[: self.bits].T
        rotation = np.linalg.qr(np.random.default_rng(7).standard_normal((self.bits, self.bits)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(projected @ rotation > 0, 1.0, -1.0).T @ projected)
            rotation = (u @ w).T
        self.map, self.k = axes[: self.bits].T @ rotation, k
        self.least, self.reach = self.relation(halves[1], recall, steps)

    def relation(self, x: np.ndarray, recall: float, steps: int, pairs: int = 200) -> tuple[np.ndarray, np.ndarray]:
        """Rising cosines, and for each the distance that ``recall`` of the sample's pairs with at least that cosine keep
        to. A level with under ``pairs`` pairs above it takes those of the level below, which reach farther."""
        q = np.arange(min(len(x), 800))
        near = x[q] @ x.T
        near[q, q] = -np.inf
        code = self.signs(x)
        away = np.bitwise_count(code[q][:, None] ^ code).ravel()
        cosine, order = near.ravel(), np.argsort(-near.ravel(), kind="stable")
        levels, out = np.linspace(-1.0, 1.0, steps + 1), np.full(steps + 1, self.bits)
        sorted_cosine, sorted_away = cosine[order], away[order]
        for i, level in enumerate(levels):
            n = int((sorted_cosine >= level).sum())
            out[i] = int(np.ceil(np.quantile(sorted_away[:n], recall))) if n >= pairs else out[i - 1] if i else self.bits
        return levels, np.minimum.accumulate(out)

    def radius(self, cosine: np.ndarray) -> np.ndarray:
        """How far a neighbour with at least this cosine may be; the whole range where none is known."""
        at = np.clip(np.searchsorted(self.least, np.nan_to_num(cosine, neginf=-1.0), side="right") - 1, 0, len(self.least) - 1)
        return np.where(np.isfinite(cosine), self.reach[at], self.bits)

    def signs(self, x: np.ndarray) -> np.ndarray:
        """Unsigned 64-bit codes of unit vectors."""
        on = ((x - self.mean) @ self.map > 0).astype(np.uint64)
        return (on << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def floors(self, queries: np.ndarray) -> np.ndarray:
        """The k-th cosine of each query (unit vectors) in the sample. A query may be in the sample itself: one more is taken."""
        if len(self.known) <= self.k:
            return np.full(len(queries), -np.inf)
        near = queries @ self.known.T
        return np.partition(near, near.shape[1] - self.k - 1, axis=1)[:, near.shape[1] - self.k - 1]


def masks(width: int, ones: int) -> np.ndarray:
    """All numbers of ``width`` bits with exactly so many ones."""
    every = np.arange(1 << width, dtype=np.uint32)
    return every[np.bitwise_count(every) == ones]


class SubstringTables:
    """For each substring of the codes a table from its value to the rows that hold it."""

    def __init__(self, codes: np.ndarray, bits: int, sub_bits: int):
        self.codes, self.tables = codes, []
        for low in range(0, bits, sub_bits):
            width = min(sub_bits, bits - low)
            value = ((codes >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
            first = np.zeros((1 << width) + 1, np.int64)
            np.cumsum(np.bincount(value, minlength=1 << width), out=first[1:])
            self.tables.append((low, width, np.argsort(value, kind="stable"), first))
        self.flips = {(w, n): masks(w, n) for w in {t[1] for t in self.tables} for n in range(w + 1)}

    def probe(self, code: np.uint64, ones: int, only: int) -> np.ndarray:
        """Rows whose substring ``only`` differs from the code's in exactly ``ones`` bits."""
        low, width, order, first = self.tables[only]
        if ones > width:
            return np.zeros(0, np.int64)
        values = (np.uint32((int(code) >> low) & ((1 << width) - 1)) ^ self.flips[width, ones]).astype(np.int64)
        begin, n = first[values], first[values + 1] - first[values]
        begin, n = begin[n > 0], n[n > 0]
        if not len(n):
            return np.zeros(0, np.int64)
        return order[np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]

    def rings(self, code: np.uint64):
        """Rows by growing radius: (radius, rows at exactly that distance). Radius r adds substring r mod m at r // m bits:
        with it every code within r has been met in some table."""
        m, seen = len(self.tables), np.zeros(len(self.codes), bool)
        waiting: dict[int, list[np.ndarray]] = {}
        for r in range(sum(t[1] for t in self.tables) + 1):
            new = self.probe(code, r // m, r % m)
            new = new[~seen[new]]
            seen[new] = True
            away = np.bitwise_count(self.codes[new] ^ code)
            for d in np.unique(away):
                waiting.setdefault(int(d), []).append(new[away == d])
            yield r, np.concatenate(waiting.pop(r, [np.zeros(0, np.int64)]))


class Best:
    """The k best rows of every query of a block, over all rows seen so far."""

    def __init__(self, codes: Codes, own: np.ndarray, queries: np.ndarray, sub_bits: int, whole: bool):
        """own: the place of each query's own row, or -1."""
        self.model, self.k, self.sub_bits, self.own = codes, codes.k, sub_bits, own
        self.q = scaled(queries)
        self.norm = np.sqrt((self.q * self.q).sum(axis=1))
        directions = self.q / self.norm[:, None]
        self.code = codes.signs(directions)
        self.most = np.full(len(own), codes.bits) if whole else codes.radius(codes.floors(directions))
        self.score, self.id = np.full((len(own), self.k), -np.inf), np.zeros((len(own), self.k), np.int64)
        self.unnamed = np.ones((len(own), self.k), bool)

    def see(self, place: np.ndarray, rid: np.ndarray, unnamed: np.ndarray, rows: np.ndarray) -> None:
        """place: of each row; rid: its id, where it has one (not ``unnamed``)."""
        r = scaled(rows)
        norm = np.sqrt((r * r).sum(axis=1))
        tables = SubstringTables(self.model.signs(r / norm[:, None]), self.model.bits, self.sub_bits)
        for i, code in enumerate(self.code):
            score, row, null, radius = self.score[i], self.id[i], self.unnamed[i], self.most[i]
            for at_radius, new in tables.rings(code):
                new = new[place[new] != self.own[i]]
                if len(new):
                    cosine = (r[new] * self.q[i]).sum(axis=1) / (norm[new] * self.norm[i])
                    score, row, null = np.concatenate([score, cosine]), np.concatenate([row, rid[new]]), np.concatenate([null, unnamed[new]])
                    best = np.lexsort((row, null, -score))[: self.k]
                    score, row, null = score[best], row[best], null[best]
                    radius = min(radius, int(self.model.radius(score[-1:])[0]))
                if at_radius >= radius:
                    break
            self.score[i], self.id[i], self.unnamed[i] = score, row, null


FOUND = "n long, vec_id long, score double"


def search_block(rows: DataFrame, codes: Codes, block: list, sub_bits: int, row_block: int, whole: bool) -> DataFrame:
    """block: (n, own, v) of some queries. Rows stream past them; a task yields its best of each query."""
    held = rows.sparkSession.sparkContext.broadcast((codes, np.array([r.n for r in block], np.int64),
        np.array([r.own for r in block], np.int64), np.array([r.v for r in block], np.float64)))

    def of(batches):
        model, n, own, queries = held.value
        best, waiting, count = Best(model, own, queries, sub_bits, whole), [], 0

        def flush() -> None:
            if waiting:
                best.see(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
                waiting.clear()

        for b in batches:
            if b.num_rows:
                ids = b.column(1)
                waiting.append((b.column(0).to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)))
                count += b.num_rows
            if count >= row_block:
                flush()
                count = 0
        flush()
        i, j = np.nonzero(np.isfinite(best.score))
        yield pa.RecordBatch.from_arrays([pa.array(n[i]), pa.array(best.id[i, j], mask=best.unnamed[i, j]), pa.array(best.score[i, j])], ["n", "vec_id", "score"])

    return rows.select("place", "id", "v").mapInArrow(of, FOUND)


def search(vectors: DataFrame, queries: Column | DataFrame, k: int = 5, bits: int = 64, sub_bits: int = 16, sample: int = 4000, recall: float = 0.985,
    row_block: int = 16_384, query_block: int = 8192) -> DataFrame:
    """vectors: (id, v). queries: a condition on the vectors' id, whose rows do not find themselves, or a table (id, v) of
    other vectors. Returns query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    small_batches(spark)
    plain = F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")
    rows = cut(usable(vectors.select(*plain)).withColumn("place", F.monotonically_increasing_id()), "vectors")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = rows.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(sample).select("v").collect()  # the bounded sample
    if not fitted:
        return empty
    codes = Codes(np.array([r.v for r in fitted], np.float64), bits, k, recall)
    if isinstance(queries, DataFrame):
        asked = queries.select(*plain, F.lit(-1).cast("long").alias("own")).where(fine(F.col("v")) & (F.size("v") == len(fitted[0].v)))
    else:
        asked = rows.where(queries).select("id", "v", F.col("place").alias("own"))
    asked = cut(asked.withColumn("n", F.monotonically_increasing_id()), "queries")
    nearest = W.partitionBy("n").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())

    def meet(some: DataFrame, whole: bool) -> DataFrame | None:
        blocks, found = -(-some.count() // query_block), None
        for b in range(blocks):
            block = some.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == b).collect()  # about query_block rows
            if block:
                best = cut(search_block(rows, codes, block, sub_bits, row_block, whole).withColumn("rank",
                    F.row_number().over(nearest)).where(F.col("rank") <= k), "found")
                found = best if found is None else found.unionByName(best)
        return found

    found = meet(asked, False)
    if found is None:
        return empty
    full = found.groupBy("n").agg(F.count("*").alias("c")).where(F.col("c") >= k).select("n")
    short = cut(asked.join(full, "n", "left_anti"), "short")
    again = meet(short, True)
    if again is not None:
        found = found.join(full, "n", "left_semi").unionByName(again)
    return found.join(asked.select("n", F.col("id").alias("query_id")), "n").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector against all the others."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search(vectors, F.col("id") % 50 == 0)
