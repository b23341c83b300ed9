"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from colorjobs.session import ship
from colorjobs.sources.shared import cut, drop, fresh_path

__all__ = ["WORD", "WordHashes", "crc_mod", "cut", "drop", "fresh_path", "join_nulls", "lower_ascii", "numbered", "row_text", "small_batches",
    "table", "unused"]

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = re.compile("[^\x20\x09-\x0d]+")


def lower_ascii(text: str) -> str:
    """A-Z in lower case, every other character as it is (bytes.lower knows ASCII letters only)."""
    return text.encode().lower().decode()


class WordHashes(dict):
    """word -> 64-bit hash of at most ``most`` words."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """For Python workers: the package itself, and (texts may be long) fewer rows in an Arrow batch."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)


def crc_mod(col: str, n: int) -> Column:
    """crc32(id as text) mod n; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def unused(columns: Iterable[str], name: str) -> str:
    """A column name that none of ``columns`` has, in any spelling."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_text(df: DataFrame, leave_out: Iterable[str] = ()) -> Column:
    """Columns of a row as one text, in order of their names; equal where all of them are equal. Nulls differ from texts."""
    parts = [F.coalesce(F.concat(F.length(t), F.lit(":"), t),
        F.lit("-")) for t in (F.col(f"`{c}`").cast("string") for c in sorted(df.columns) if c not in set(leave_out))]
    return F.concat_ws("|", *parts) if parts else F.lit("")


def join_nulls(left: DataFrame, right: DataFrame, *on: str, how: str = "inner") -> DataFrame:
    """An equi-join on columns of both sides where null equals null; the key columns appear once."""
    r = right.select(*(F.col(c).alias(f"_right_{c}") if c in on else F.col(c) for c in right.columns))
    held = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on]
    condition = held[0]
    for h in held[1:]:
        condition = condition & h
    return left.join(r, condition, how).drop(*(f"_right_{c}" for c in on))


def numbered(rows: DataFrame, key: str, *order: Column, name: str = "nth") -> DataFrame:
    """``rows``, cut, with their place (from 0) among the rows of their key, however many those are.

    Rows are sorted by range over (key, order), nulls first; a place is the number of rows before it in its partition and in
    the partitions before, less the key's first, so no key has to fit one task. Only a count for each partition (driver) and the first
    place of each key (a join) are gathered."""
    at, part, first = unused(rows.columns, "at"), unused(rows.columns, "part"), unused(rows.columns, "first")
    by = [F.col(key).asc_nulls_first(), *order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id())
    placed = cut(placed.withColumn(part, F.shiftright(at, 33).cast("int")).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1))), "placed")
    before, starts = 0, []
    for r in placed.groupBy(part).agg(F.count("*").alias("n")).orderBy(part).collect():  # one row a partition
        starts.append((r[part], before))
        before += r.n
    shift = unused(rows.columns, "shift")
    starts = rows.sparkSession.createDataFrame(starts, f"`{part}` int, `{shift}` long")
    whole = placed.join(F.broadcast(starts), part).withColumn(at, F.col(at) + F.col(shift)).drop(part, shift)
    least = cut(whole.groupBy(key).agg(F.min(at).alias(first)), "first")
    return join_nulls(whole, least, key).withColumn(name, F.col(at) - F.col(first)).drop(at, first)
