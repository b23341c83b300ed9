"""Incremental jobs as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colorjobs.functions.svg import extract
from colorjobs.sources.shared import cut, scratch
from colorjobs.sources.store import Spec, Store
from colorjobs.sources.tables import basename, status_of


def stream_svgs(spark: SparkSession, path: str) -> DataFrame:
    """A streaming source of a folder's SVG documents."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", "*.[sS][vV][gG]").load(path)
    return files.select(basename(F.col("path")).alias("file"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("mtime"))


USAGE = {
    "seen": Spec("file string, mtime timestamp", ("file",)),
    "usage": Spec("file string, hex string, n long", ("file",)),
}
STATUS = {"status": Spec("file string, ts timestamp, status string", ("file",))}


def usage_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, USAGE)


def newest_of(files: DataFrame, seen: DataFrame) -> DataFrame:
    """(file, mtime) of the newest version of each file that is newer than what was seen of it."""
    newest = files.groupBy("file").agg(F.max("mtime").alias("mtime"))
    return newest.join(seen.withColumnRenamed("mtime", "before"), "file", "left").where("before is null or mtime > before").select("file", "mtime")


def stream_usage(svgs: DataFrame, target: str, checkpoint: str, few: int = 100_000):
    """Usage of new or newer documents, kept up to date in a store (see sources.store): its tables ``seen`` (file, mtime)
    and ``usage`` (file, hex, n) hold the newest version of each file, so they grow with files and not with versions, and a
    micro-batch reads and writes only the buckets of its own files. A version that is older than the one held is left out, in
    whatever order they come. Returns the started query (all that is available, then it ends).

    Which versions count is settled on (file, mtime) alone. Contents are never exchanged: up to ``few`` files are sent to where
    their contents lie; beyond that all documents of the batch are read where they lie, and their counts, which are narrow,
    meet the files. A batch that is tried again has the same commit name and changes nothing."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = usage_store(spark, target)
        with scratch(spark):
            known = store.read("seen", store.touched("seen", batch.select("file")))
            fresh = cut(newest_of(batch.select("file", "mtime"), known), "fresh")
            docs = batch.select("file", "mtime", "content")
            count = fresh.count()
            if count <= few:  # narrow rows of a checked number
                docs = docs.join(F.broadcast(fresh), ["file", "mtime"], "left_semi")
            counts = document_counts(docs)
            if count > few:
                counts = counts.join(fresh, ["file", "mtime"], "left_semi")
            # of several documents with one name and time, the one with the largest counts stands for all
            one = cut(counts.groupBy("file").agg(F.max("counts").alias("counts")), "counts")
            rows = one.select("file", F.explode("counts").alias("c")).select("file", "c.hex", "c.n")
            gone = one.where(F.size("counts") == 0).select("file", F.lit(None).cast("string").alias("hex"), F.lit(0).cast("long").alias("n"))
            store.upsert(f"batch-{number}", {"seen": fresh, "usage": rows.unionByName(gone)})

    return svgs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def document_counts(docs: DataFrame) -> DataFrame:
    """docs (file, mtime, content) -> file, mtime, counts (array of hex and n, by hex), one row a document, made where it lies."""
    keyed = docs.withColumn("file", F.to_json(F.struct("file", F.unix_micros("mtime").alias("at"), F.monotonically_increasing_id().alias("row"))))
    tokens = extract(keyed.select("file", "content"), ("token", "fact", "error"))
    per = tokens.groupBy("file", F.when(F.col("kind") == "token", F.col("hex")).alias("hex")).agg(F.count("*").alias("n"))
    lists = per.groupBy("file").agg(F.array_sort(F.collect_list(F.when(F.col("hex").isNotNull(), F.struct("hex", "n")))).alias("counts"))
    told = F.from_json("file", "file string, at long, row long")
    return lists.select(told.alias("k"), "counts").select("k.file", F.timestamp_micros("k.at").alias("mtime"), "counts")


def current_usage(spark: SparkSession, target: str) -> DataFrame:
    """file, hex, n of the newest state of each file."""
    return usage_store(spark, target).read("usage").where("hex is not null")


def latest_status(events: DataFrame, late: str = "1 hour", span: str = "1 day") -> DataFrame:
    """Events (file, ts, status) -> newest status by event time of each file; of equal times the larger status text.

    Of a table, one row a file. Of a stream (update mode), the newest of each file and ``span`` of event time that has changed:
    spans give the state an end, so events later than ``late`` are dropped and the state of old spans goes. store_status()
    keeps the newest of them."""
    rows = events.withColumn("status", status_of(F.col("status")))
    best = F.max(F.struct("ts", "status")).alias("m")
    if events.isStreaming:
        found = rows.withWatermark("ts", late).groupBy(F.window("ts", span), "file").agg(best)
    else:
        found = rows.groupBy("file").agg(best)
    return found.select("file", F.col("m.ts").alias("ts"), F.col("m.status").alias("status"))


def status_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, STATUS)


def stream_status(events: DataFrame, target: str, checkpoint: str, late: str = "1 hour", span: str = "1 day"):
    """T2 as a stream in update mode into a store: a micro-batch reads and writes only the buckets of the files that changed, and
    an event older than what a file has changes nothing. Returns the started query (all that is available, then it ends)."""

    def put(batch: DataFrame, number: int) -> None:
        store = status_store(batch.sparkSession, target)
        with scratch(batch.sparkSession):
            new = cut(latest_status(batch), "status")
            held = store.read("status", store.touched("status", new))
            old = held.select("file", F.struct("ts", "status").alias("old"))
            newer = new.join(old, "file", "left").where(F.col("old").isNull() | (F.struct("ts", "status") > F.col("old")))
            store.upsert(f"batch-{number}", {"status": cut(newer.select("file", "ts", "status"), "newer")})

    stream = latest_status(events, late, span).writeStream.outputMode("update").foreachBatch(put)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_status(spark: SparkSession, target: str) -> DataFrame:
    return status_store(spark, target).read("status")
