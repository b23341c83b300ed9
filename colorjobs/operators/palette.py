"""Shared palettes: k-means over distinct colours in Lab.

Coordinates are counted in steps of 2**-30, so sums are whole numbers and no result depends on order or partitions. Colours
lie in boxes of Lab space, one row a box with its count, sums and corners; a box is small (at most some 1,500 of the 2**24
colours fall into one), so no row grows with the input. In a round a box counts as a whole where every place of it is
nearest to the same centre; only colours of the other boxes meet all centres. The means are those of plain Lloyd rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colorjobs.functions.colors import auto_label, hex_to_lab
from colorjobs.session import ship
from colorjobs.sources.shared import cut

#: Steps of a coordinate to one unit of Lab, and the side of a box in units.
STEPS, SIDE = 1 << 30, 2
#: Colours of one task of a round.
TASK = 100_000


def kmeans_palette(colors: DataFrame, k: int, most_rounds: int = 50, still: float = 0.5) -> DataFrame:
    """Colors (hex) -> id, source_hex (the member nearest the mean), label, n_members, L, a, b of the mean; members are
    in kmeans_members().

    Starts from the k colours with the smallest SHA-256 of their hex, so the result depends neither on order nor on
    partitions; k at least the number of colours gives singletons. Lloyd rounds end when no mean moves ``still`` or more
    and no assignment changes. An empty cluster starts again from the next colour in hash order, however often. A round is
    one job without a shuffle; at most k rows a task come to the driver."""
    return _clusters(colors, k, most_rounds, still)[0]


def kmeans_members(colors: DataFrame, k: int, most_rounds: int = 50, still: float = 0.5) -> DataFrame:
    """hex -> id of its cluster."""
    return _clusters(colors, k, most_rounds, still)[1]


def sole_owners(low: np.ndarray, high: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each box the centre that is nearest to all of its places, or -1. Distances that are close to equal own nothing."""
    near, far = np.zeros((len(low), len(centres))), np.zeros((len(low), len(centres)))
    for x in range(3):
        below, above = low[:, x, None] - centres[:, x], centres[:, x] - high[:, x, None]
        near += np.maximum(0.0, np.maximum(below, above)) ** 2
        far += np.maximum(-below, -above) ** 2
    best = far.argmin(axis=1)
    rows = np.arange(len(low))
    near[rows, best] = np.inf
    return np.where(far[rows, best] + 1e-6 < near.min(axis=1, initial=np.inf), best, -1)


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point, the first of equally near ones, and the squared distance."""
    own, away = np.zeros(len(points), np.int64), np.zeros(len(points))
    step = max(1, 2_000_000 // len(centres))
    for at in range(0, len(points), step):
        p = points[at : at + step]
        d = sum((p[:, x, None] - centres[:, x]) ** 2 for x in range(3))
        own[at : at + step] = d.argmin(axis=1)
        away[at : at + step] = d.min(axis=1)
    return own, away



def _sums(boxes: DataFrame, centres: np.ndarray) -> dict[int, tuple[int, int, tuple[int, int, int]]]:
    """One round: cluster -> (number, xor of hashes, sums of steps). Clusters without a colour are left out."""

    def of(batches):
        k = len(centres)
        n, who, total = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, 3), np.int64)

        def add(own, counts, hashes, steps):
            np.add.at(n, own, counts)
            np.bitwise_xor.at(who, own, hashes)
            np.add.at(total, own, steps)

        for b in batches:
            of = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            corner = lambda what: np.stack([of[f"{what}{x}"].to_numpy() for x in range(3)], axis=1) / STEPS  # noqa: B023, E731
            own = sole_owners(corner("low"), corner("high"), centres)
            whole = own >= 0
            steps = np.stack([of[f"sum{x}"].to_numpy() for x in range(3)], axis=1)
            add(own[whole], of["n"].to_numpy()[whole], of["who"].to_numpy()[whole], steps[whole])
            if not whole.all():
                rest = of["points"].filter(pa.array(~whole)).flatten()
                steps = np.stack([rest.field(f"x{x}").to_numpy() for x in range(3)], axis=1)
                add(nearest(steps / STEPS, centres)[0], 1, rest.field("who").to_numpy(), steps)
        at = np.flatnonzero(n)
        columns = [at, n[at], who[at], *(total[at, x] for x in range(3))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "n", "who", "sum0", "sum1", "sum2"])

    found: dict = {}
    for r in boxes.mapInArrow(of, "i long, n long, who long, sum0 long, sum1 long, sum2 long").collect():  # at most k rows a task
        n, who, total = found.get(r.i, (0, 0, (0, 0, 0)))
        found[r.i] = n + r.n, who ^ r.who, (total[0] + r.sum0, total[1] + r.sum1, total[2] + r.sum2)
    return found


def _boxes(colors: DataFrame) -> DataFrame:
    """One row a box: n, who, sum0..2, low0..2, high0..2 (steps), points (array of hex, who, x0, x1, x2)."""
    axes = [F.round(F.col(f"p.{c}") * STEPS).cast("long").alias(f"x{x}") for x, c in enumerate("Lab")]
    points = colors.select("hex").distinct().select("hex", hex_to_lab(F.col("hex")).alias("p")).where("p.L is not null").select("hex",
        F.xxhash64("hex").alias("who"), *axes)
    box = [F.floor(F.col(f"x{x}") / F.lit(STEPS * SIDE)).alias(f"box{x}") for x in range(3)]
    what = [F.count("*").alias("n"), F.bit_xor("who").alias("who")]
    for x in range(3):
        what += [F.sum(f"x{x}").alias(f"sum{x}"), F.min(f"x{x}").alias(f"low{x}"), F.max(f"x{x}").alias(f"high{x}")]
    grouped = points.groupBy(*box).agg(*what, F.collect_list(F.struct("hex", "who", "x0", "x1", "x2")).alias("points"))
    boxes = cut(grouped.drop("box0", "box1", "box2"), "boxes")
    many = boxes.agg(F.sum("n")).first()[0] or 0
    return boxes.coalesce(max(1, many // TASK))  # a round is short: no more tasks than the colours need


def _clusters(colors: DataFrame, k: int, most_rounds: int, still: float) -> tuple[DataFrame, DataFrame]:
    if k < 1:
        raise ValueError("k must be at least 1")
    ship(colors.sparkSession)
    boxes = _boxes(colors)
    points = boxes.select(F.explode("points").alias("p")).select("p.hex", "p.x0", "p.x1", "p.x2", F.sha2("p.hex", 256).alias("h"))

    def from_hash(after: str, n: int) -> list:
        """The next n points in hash order, from the beginning again after the last."""
        rows = points.where(F.col("h") > after).orderBy("h").limit(n).collect()
        return rows if len(rows) == n or not after else rows + points.orderBy("h").limit(n - len(rows)).collect()

    first = from_hash("", k)
    if not first:
        empty = points.select(F.lit("").alias("id"), F.col("hex").alias("source_hex"), F.lit("").alias("label"),
            F.lit(0).cast("long").alias("n_members"), *(F.lit(0.0).alias(c) for c in "Lab"))
        return empty, points.select("hex", F.lit("").alias("id"))
    centres = np.array([(r.x0, r.x1, r.x2) for r in first], np.float64) / STEPS
    last, before = first[-1].h, None
    for _ in range(most_rounds):
        found, after = _sums(boxes, centres), []
        for i in range(len(centres)):
            if i in found:
                after.append([s / found[i][0] / STEPS for s in found[i][2]])
            else:
                (seed,) = from_hash(last, 1)
                last = seed.h
                after.append([seed.x0 / STEPS, seed.x1 / STEPS, seed.x2 / STEPS])
        drift = np.sqrt(((np.array(after) - centres) ** 2).sum(axis=1)).max()
        now = {i: (n, who) for i, (n, who, _) in found.items()}
        centres, same, before = np.array(after), now == before, now
        if drift < still and same:
            break

    def assign(batches):
        for b in batches:
            rows = b.column(0).flatten()
            steps = [rows.field(f"x{x}") for x in range(3)]
            own, away = nearest(np.stack([s.to_numpy() for s in steps], axis=1) / STEPS, centres)
            yield pa.RecordBatch.from_arrays([rows.field("hex"), *steps, pa.array(own), pa.array(away)], ["hex", "x0", "x1", "x2", "i", "d"])

    out = cut(boxes.select("points").mapInArrow(assign, "hex string, x0 long, x1 long, x2 long, i long, d double"), "assigned")
    means = [(F.sum(f"x{x}") / F.count("*") / F.lit(float(STEPS))).alias(c) for x, c in enumerate("Lab")]
    stats = out.groupBy("i").agg(*means, F.count("*").alias("n_members"), F.min_by("hex", F.struct("d", "hex")).alias("source_hex"))
    order = sorted(((r.L, r.a, r.b, r.source_hex), r.i) for r in stats.collect())  # k rows
    ids = F.create_map(*(F.lit(x) for n, (_, i) in enumerate(order) for x in (i, f"p_{n + 1:03d}")))
    swatches = stats.select(ids[F.col("i")].alias("id"), "source_hex", auto_label(F.col("source_hex")).alias("label"), "n_members", "L", "a", "b")
    return swatches, out.select("hex", ids[F.col("i")].alias("id"))
