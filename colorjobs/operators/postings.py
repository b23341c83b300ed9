"""C7 as an index: which files hold a colour, in posting lists that can be probed and refreshed.

Files are numbered. A colour's list is cut into blocks of ``SPAN`` numbers; a block is one row with the places of its files in
order, so no row grows with the library, and it is one unit of a store that is bucketed by the colour: a probe reads the
buckets of its colours only, and a changed file touches the blocks of the colours that it has gained or lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colorjobs.operators.ranking import ranked
from colorjobs.sources.shared import cut, scratch, tasks_for
from colorjobs.sources.store import Spec, Store

SPAN = 4096
INDEX = {
    "numbers": Spec("file string, number long", ("file",)),
    "postings": Spec("hex string, block long, n int, places array<int>", ("hex", "block"), dealt_by=("hex",)),
}


def index_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, INDEX)


def refresh(store: Store, commit: str, before: DataFrame, after: DataFrame) -> bool:
    """Bring the index up to date. before and after: (file, hex) of the files that changed, as they were and as they are; for a
    new index ``before`` is empty. Files that are new get the next numbers."""
    if store.manifest()["commit"] == commit:
        return False
    with scratch(store.spark):
        tasks = tasks_for(store.spark, before.count() + after.count())
        was, now = (x.select("file", "hex").where("hex is not null").repartition(tasks, "file").distinct() for x in (before, after))
        changed = before.select("file").unionByName(after.select("file")).distinct()
        held = store.read("numbers", store.touched("numbers", changed)).join(changed, "file", "left_semi")
        most = store.read("numbers").agg(F.max("number")).first()[0]
        new = ranked(changed.join(held, "file", "left_anti"), F.col("file").asc(), name="number")
        new = new.select("file", (F.col("number") + (-1 if most is None else most)).alias("number"))
        numbers = cut(held.unionByName(new), "numbers")
        place = [F.floor(F.col("number") / SPAN).cast("long").alias("block"), (F.col("number") % SPAN).cast("int").alias("place")]
        gone = cut(was.join(numbers, "file").select("hex", *place), "gone")
        come = cut(now.join(numbers, "file").select("hex", *place), "come")
        units = cut(gone.unionByName(come).select("hex", "block").repartition(tasks, "hex", "block").distinct(), "units")
        old = store.read("postings", store.touched("postings", units)).join(units, ["hex", "block"], "left_semi")
        old = old.select("hex", "block", F.explode("places").alias("place")).join(gone, ["hex", "block", "place"], "left_anti")
        lists = old.unionByName(come).repartition(tasks, "hex", "block").groupBy("hex", "block").agg(F.array_sort(F.collect_set("place")).alias("places"))  # at most SPAN places
        none = F.array().cast("array<int>")
        rows = units.join(lists, ["hex", "block"], "left").select("hex", "block", F.coalesce("places", none).alias("places"))
        return store.upsert(commit, {"numbers": new, "postings": cut(rows.select("hex", "block", F.size("places").alias("n"), "places"), "postings")})


def probe(store: Store, colors: DataFrame) -> DataFrame:
    """colors (hex) -> (hex, number) of each file that holds one; only the buckets of these colours are read."""
    wanted = colors.select("hex").distinct()
    rows = store.read("postings", store.touched("postings", wanted)).join(wanted, "hex", "left_semi")
    return rows.select("hex", "block", F.explode("places").alias("place")).select("hex", (F.col("block") * SPAN + F.col("place")).alias("number"))


def files_of(store: Store, colors: DataFrame) -> DataFrame:
    """(hex, file)."""
    return probe(store, colors).join(store.read("numbers"), "number").select("hex", "file")


def document_frequency(store: Store) -> DataFrame:
    """C9 from the index: (hex, n_files), from the blocks' own counts."""
    return store.read("postings").groupBy("hex").agg(F.sum("n").cast("long").alias("n_files")).where("n_files > 0")


def palette_usage(store: Store, swatches: DataFrame) -> DataFrame:
    """J13 from the index: files of each swatch over all its members; names are not needed."""
    members = swatches.select("id", F.explode("members").alias("hex")).distinct()
    hits = probe(store, members).join(members, "hex").select("id", "number").distinct().groupBy("id").agg(F.count("*").alias("n"))
    return swatches.select("id").distinct().join(hits, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_files"))


def overridden_files(store: Store, swatches: DataFrame, overrides: DataFrame) -> DataFrame:
    """(id, file): files that use a member of a swatch and override it, found by probing for the members first."""
    members = swatches.select("id", "source_hex", F.explode("members").alias("hex")).where("hex != source_hex").select("id", "hex").distinct()
    used = files_of(store, members).join(members, "hex")
    return used.join(overrides.select("file", F.col("source").alias("hex")).distinct(), ["file", "hex"], "left_semi").select("id", "file").distinct()
