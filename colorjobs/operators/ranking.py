"""Places in an order over a whole table, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colorjobs.sources.shared import cut


def ranked(rows: DataFrame, *order: Column, name: str = "nth") -> DataFrame:
    """``rows``, cut, with their place (from 1) in the order, which should have no ties.

    Rows are dealt by range and sorted where they lie; a place is the number of rows before it in its partition and in the
    partitions before. Only one count a partition is gathered."""
    shift = 33  # of monotonically_increasing_id: the partition stands above, the place in it below
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("_part", F.shiftright("_at", shift).cast("int")), "ranked")
    before, starts = 0, []
    for r in placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # one row a partition
        starts.append((r["_part"], before - (r["_part"] << shift) + 1))
        before += r["n"]
    starts = rows.sparkSession.createDataFrame(starts, "_part int, _shift long")
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
