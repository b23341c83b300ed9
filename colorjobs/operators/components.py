"""Connected components of a graph in a table, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colorjobs.sources.shared import cut, drop


def components(edges: DataFrame, scope: str) -> DataFrame:
    """edges (scope, a, b), undirected, within a scope -> (scope, a, root) for each node that is not the smallest of its component;
    root is the smallest.

    Rounds of large stars (each node's larger neighbours move to the smallest of its neighbourhood) and small stars (its
    smaller ones do) until nothing moves. A neighbourhood is never gathered: its minimum is an aggregate that combines before it
    is exchanged, and it meets the edges by a join."""

    def tidy(rows: DataFrame) -> DataFrame:
        return rows.where("a != b").select(scope, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count("*"), F.bit_xor(F.xxhash64(scope, "a", "b"))).first())

    now = cut(tidy(edges), "edges")
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(scope, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(scope, "a").agg(F.min("b").alias("m")).select(scope, "a", F.least("a", "m").alias("m"))
        large = cut(tidy(both.where("b > a").join(least, [scope, "a"]).select(scope, F.col("b").alias("a"), F.col("m").alias("b"))), "edges")
        least = large.groupBy(scope, "a").agg(F.min("b").alias("m"))
        small = large.join(least, [scope, "a"]).select(scope, F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(tidy(small.unionByName(least.select(scope, "a", F.col("m").alias("b")))), "edges")
        was, seen = seen, state(after)
        drop(now, large)
        now = after
        if seen == was:
            break
    return now.select(scope, "a", F.col("b").alias("root"))
