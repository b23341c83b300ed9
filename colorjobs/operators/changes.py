"""U1 to U7 in place: the changes of mapping.py on the tables of a store, where only the buckets with hits are read and written.

Each takes the name of its commit: run again after a crash, or twice by mistake, it gives the same tables. Several tables
change in one commit or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colorjobs.operators import mapping
from colorjobs.sources.store import Spec, Store

LIBRARY = {
    "global_map": Spec("pipeline string, source string, target string, label string, notes string, ord long", ("pipeline", "source")),
    "overrides": Spec("file string, pipeline string, source string, target string", ("file",)),
    "device": Spec("file string, source string, cmyk struct<c:double,m:double,y:double,k:double>", ("file",)),
    "illustrations": Spec("file string, status string, cmyk_status string, cmyk_auto_fix boolean, updated_at timestamp, notes string", ("file",)),
}


def library_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, LIBRARY)


def load(store: Store, commit: str, tables: dict[str, DataFrame]) -> bool:
    """The first commit, or new units on top of what is there."""
    return store.upsert(commit, tables)


def upsert_map(store: Store, commit: str, rows: DataFrame, keep_old: bool = False) -> bool:
    """U1."""
    return store.change(commit, {"global_map": rows}, lambda t: {"global_map": mapping.upsert_map(t["global_map"], rows, keep_old)})


def remove_map(store: Store, commit: str, keys: DataFrame) -> bool:
    """U1. keys: pipeline, source."""
    return store.change(commit, {"global_map": keys}, lambda t: {"global_map": mapping.remove_map(t["global_map"], keys)})


def cleanup_identity(store: Store, commit: str, pipeline: str) -> bool:
    """U2."""
    same = (F.col("pipeline") == pipeline) & (F.col("target") == F.col("source"))
    hits = {name: store.read(name).where(same) for name in ("global_map", "overrides")}
    return store.change(commit, hits, lambda t: dict(zip(("global_map", "overrides"), mapping.cleanup_identity(t["global_map"], t["overrides"],
        pipeline)[:2], strict=True)))


def wipe_pipeline(store: Store, commit: str, files: DataFrame, pipeline: str) -> bool:
    """U3. files: (file)."""
    names = ("illustrations", "overrides", "device")

    def wiped(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
        done = mapping.wipe_pipeline(t["illustrations"], t["overrides"], t["device"], files, pipeline)
        return {n: done[n] for n in names}

    return store.change(commit, {n: files for n in names}, wiped)


def replace_globally(store: Store, commit: str, swatches: DataFrame, pipeline: str = "cmyk") -> bool:
    """U4: the map gets its members, and only the buckets of files that override one of them are written anew."""
    members = swatches.select(F.lit(pipeline).alias("pipeline"), F.explode("members").alias("source"), "source_hex").where("source != source_hex")
    members = members.select("pipeline", "source").distinct()
    hits = {"global_map": members, "overrides": store.read("overrides").join(members, ["pipeline", "source"], "left_semi")}
    return store.change(commit, hits, lambda t: dict(zip(("global_map", "overrides"), mapping.replace_globally(t["global_map"], t["overrides"],
        swatches, pipeline), strict=True)))


def mapping_diff(before: Store, after: Store, pipeline: str) -> DataFrame:
    """U5 between two stores' own overrides: (file, source, before, after) where they differ."""
    b, a = (s.read("overrides").where(F.col("pipeline") == pipeline).select("file", "source", F.col("target").alias(n)) for s, n in ((before, "before"), (after, "after")))
    return b.join(a, ["file", "source"], "full").where(~F.col("before").eqNullSafe(F.col("after")))


def reset_colors(store: Store, commit: str, resets: DataFrame, pipeline: str) -> bool:
    """U6. resets: (file, hex). The CMYK side also loses exact quads of these colours, in every file that has one."""
    sources = resets.select(F.lit(pipeline).alias("pipeline"), F.col("hex").alias("source")).distinct()
    pairs = resets.select("file", F.lit(pipeline).alias("pipeline"), F.col("hex").alias("source"))
    hits = {"global_map": store.read("global_map").join(sources, ["pipeline", "source"], "left_semi"),
        "overrides": store.read("overrides").join(pairs, ["file", "pipeline", "source"], "left_semi")}
    if pipeline == "cmyk":
        hits["device"] = store.read("device").join(sources, "source", "left_semi")

    def reset(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
        g, o, d = mapping.reset_colors(t["global_map"], t["overrides"], t.get("device", store.read("device", [])), resets, pipeline)
        return {"global_map": g, "overrides": o} | ({"device": d} if "device" in t else {})

    return store.change(commit, hits, reset)


def mark_status(store: Store, commit: str, files: DataFrame, status: str, stamp: Column, field: str = "status") -> bool:
    """U7. files: (file)."""
    known = store.read("illustrations").join(files.select("file").distinct(), "file", "left_semi")
    return store.change(commit, {"illustrations": known}, lambda t: {"illustrations": mapping.mark_status(t["illustrations"], files, status, stamp, field)})
