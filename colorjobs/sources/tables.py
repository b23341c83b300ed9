"""Sources and sinks: SVG folders, mapping documents, colour-map configurations, delivery manifests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colorjobs.functions.colors import cmyk_label, normalize_hex, parse_cmyk

STATUSES = ("pending", "in_progress", "reviewed", "exported")
MAPPING = (
    "filename string, status string, overrides map<string,string>, cmyk_status string, cmyk_overrides map<string,string>, "
    "cmyk_device_overrides map<string,string>, cmyk_auto_fix boolean, updated_at string, notes string"
)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)$", 1)


def status_of(text: Column) -> Column:
    return F.when(text.isin(*STATUSES), text).otherwise("pending")


def read_svgs(spark: SparkSession, path: str) -> DataFrame:
    """File, content, size_bytes, mtime of every .svg (any case) directly in a folder, in no order: contents stay where
    they are read. Names in order: svg_names()."""
    from colorjobs.sources import files  # it imports this module

    if files.readable(spark, path):
        rows = files.read_files(spark, path, ".svg").where("size_bytes > 0")
        return rows.select("file", F.decode("content", "UTF-8").alias("content"), "size_bytes", "mtime")
    return svg_rows(spark.read.format("binaryFile").option("pathGlobFilter", "*.[sS][vV][gG]").load(path))


def svg_names(svgs: DataFrame) -> DataFrame:
    """File, size_bytes and mtime in order of their names, case aside; contents are not read for it."""
    return svgs.select("file", "size_bytes", "mtime").orderBy(F.lower("file"), "file")


def svg_rows(files: DataFrame) -> DataFrame:
    """Rows of the file source (path, modificationTime, length, content) that are SVG documents, as the library's table."""
    return files.where(F.lower("path").endswith(".svg")).select(basename(F.col("path")).alias("file"), F.decode("content", "UTF-8").alias("content"),
        F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))


def mapping_texts(spark: SparkSession, path: str) -> DataFrame:
    """value: the text of each *.mapping.json of a folder."""
    from colorjobs.sources import files

    if files.readable(spark, path):
        return files.read_files(spark, path, ".mapping.json").where(F.col("file").endswith(".mapping.json")).select(F.col("content").cast("string").alias("value"))
    return spark.read.option("wholetext", "true").option("pathGlobFilter", "*.mapping.json").text(path)


def _documents(texts: DataFrame) -> DataFrame:
    return texts.select(F.from_json("value", MAPPING, {"mode": "PERMISSIVE"}).alias("d")).where("d.filename is not null")


def read_mappings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(illustrations, overrides) from *.mapping.json; documents that are not JSON are skipped. Their exact CMYK
    overrides: read_device_overrides()."""
    return parse_mappings(mapping_texts(spark, path))


def read_device_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(file, source, cmyk): the exact CMYK overrides of *.mapping.json."""
    return parse_device_overrides(mapping_texts(spark, path))


def parse_device_overrides(texts: DataFrame) -> DataFrame:
    """texts (value) -> file, source, cmyk. Sources that are no colour and values that are no quad are left out."""
    rows = _documents(texts).select(F.col("d.filename").alias("file"), F.explode(F.map_entries("d.cmyk_device_overrides")).alias("e"))
    rows = rows.select("file", normalize_hex(F.col("e.key")).alias("source"), parse_cmyk(F.col("e.value")).alias("cmyk"))
    return rows.where("source is not null and cmyk is not null")


def parse_mappings(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts (value) -> illustrations and overrides."""
    docs = _documents(texts)
    illustrations = docs.select(
        F.col("d.filename").alias("file"), status_of(F.col("d.status")).alias("status"), status_of(F.col("d.cmyk_status")).alias("cmyk_status"),
        F.coalesce("d.cmyk_auto_fix", F.lit(False)).alias("cmyk_auto_fix"), F.col("d.updated_at").alias("updated_at"),
            F.coalesce("d.notes", F.lit("")).alias("notes"),
    )

    def side(field: str, pipeline: str) -> Column:
        entries = F.transform(F.map_entries(f"d.{field}"), lambda e: F.struct(F.lit(pipeline).alias("pipeline"), e["key"].alias("k"), e["value"].alias("v")))
        return F.coalesce(entries, F.array().cast("array<struct<pipeline:string,k:string,v:string>>"))

    both = F.concat(side("overrides", "grayscale"), side("cmyk_overrides", "cmyk"))  # one explode: documents are read once
    rows = docs.select(F.col("d.filename").alias("file"), F.explode(both).alias("e"))
    return illustrations, rows.select("file", "e.pipeline", F.upper("e.k").alias("source"), F.upper("e.v").alias("target"))


def read_color_maps(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """S3: global_map, device_overrides, slots and themes of a configuration document; entries of another shape are left out."""
    return parse_color_maps(spark.read.option("wholetext", "true").text(path))


def parse_color_maps(doc: DataFrame) -> dict[str, DataFrame]:
    """doc (value): the text of a configuration."""
    entry = "struct<target:string,label:string,notes:string>"
    get = lambda p, kind: F.from_json(F.get_json_object("value", p), kind)

    def one(field: str, pipeline: str) -> DataFrame:
        keys = F.json_object_keys(F.get_json_object("value", f"$.{field}"))
        rows = doc.select(get(f"$.{field}", "map<string,string>").alias("m"), F.posexplode(keys).alias("ord", "k")).select("ord", "k",
            F.from_json(F.element_at("m", F.col("k")), entry).alias("e"))
        return rows.where("e.target is not null").select(F.lit(pipeline).alias("pipeline"), F.upper("k").alias("source"),
            F.upper("e.target").alias("target"), F.coalesce("e.label", F.lit("")).alias("label"), F.coalesce("e.notes", F.lit("")).alias("notes"), "ord")

    device = doc.select(F.explode(F.map_entries(get("$.cmyk_device_overrides", "map<string,string>"))).alias("e"))
    slots = doc.select(F.posexplode(F.map_entries(get("$.semantic_palette.slots",
        "map<string,struct<authored:string,label:string,notes:string>>"))).alias("ord", "e"))
    themes = doc.select(F.explode(F.map_entries(get("$.semantic_palette.themes", "map<string,map<string,map<string,string>>>"))).alias("t"))
    themes = themes.select(F.col("t.key").alias("theme"), F.explode(F.map_entries("t.value")).alias("p")).select("theme",
        F.col("p.key").alias("pipeline"), F.explode(F.map_entries("p.value")).alias("s"))
    return {
        "global_map": one("global_color_map", "grayscale").unionByName(one("cmyk_correction_map", "cmyk")),
        "device_overrides": device.select(F.lit(None).cast("string").alias("file"), normalize_hex(F.col("e.key")).alias("source"),
            F.col("e.value").alias("raw"), parse_cmyk(F.col("e.value")).alias("cmyk")),
        "slots": slots.where("e.value.authored is not null").select(F.col("e.key").alias("name"), F.upper("e.value.authored").alias("authored"),
            "e.value.label", "e.value.notes", "ord"),
        "themes": themes.select("theme", "pipeline", F.col("s.key").alias("slot"), F.upper("s.value").alias("target")),
    }


def output_file(file: Column, suffix: str) -> Column:
    """The name of a recoloured document."""
    return F.concat(F.regexp_replace(file, r"(?i)\.svg$", ""), F.lit(f"{suffix}.svg"))


def write_svgs(df: DataFrame, path: str, suffix: str = "_grayscale", buckets: int = 64) -> None:
    """(file, content) under their output names, as Parquet split by a hash of the name; content is not shuffled."""
    df.select(output_file(F.col("file"), suffix).alias("file"), "content",
        F.pmod(F.xxhash64("file"), F.lit(buckets)).alias("bucket")).write.partitionBy("bucket").mode("overwrite").parquet(path)


def mapping_documents(illustrations: DataFrame, overrides: DataFrame, stamp: str, device: DataFrame | None = None) -> DataFrame:
    """One JSON document for each file, keys in order. A file's overrides are few: they are one document in the end.
    device: (file, source, cmyk), its exact CMYK overrides."""

    def side(pipeline: str, name: str) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.struct("source", "target")))
        return overrides.where(F.col("pipeline") == pipeline).groupBy("file", "pipeline",
            "source").agg(F.max("target").alias("target")).groupBy("file").agg(F.map_from_entries(pairs).alias(name))

    j = illustrations.join(side("grayscale", "overrides"), "file", "left").join(side("cmyk", "cmyk_overrides"), "file", "left")
    exact = F.lit(None).cast("map<string,string>")
    if device is not None:
        quads = device.groupBy("file", "source").agg(F.max(cmyk_label(F.col("cmyk"))).alias("quad")).groupBy("file")
        j, exact = j.join(quads.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "quad")))).alias("exact")), "file",
            "left"), F.col("exact")
    empty = F.create_map().cast("map<string,string>")
    doc = F.struct(
        F.col("file").alias("filename"), "status", F.coalesce("overrides", empty).alias("overrides"), "cmyk_status",
            F.coalesce("cmyk_overrides", empty).alias("cmyk_overrides"),
        F.coalesce(exact, empty).alias("cmyk_device_overrides"), "cmyk_auto_fix", F.lit(stamp).alias("updated_at"), "notes",
    )
    return j.select("file", F.to_json(doc).alias("document"))


def write_mappings(illustrations: DataFrame, overrides: DataFrame, path: str, stamp: str, device: DataFrame | None = None) -> None:
    mapping_documents(illustrations, overrides, stamp, device).write.mode("overwrite").parquet(path)


def slug(label: str) -> str:
    return re.sub("-+", "-", re.sub("[^a-z0-9]+", "-", label.lower())).strip("-")


def manifest(files: DataFrame, label: str, stamp: str) -> DataFrame:
    """Files (file, content BINARY) -> delivery_id, label, ts, file, sha256, bytes. stamp: UTC, as text."""
    if not label.strip():
        raise ValueError("a delivery needs a label")
    return files.select(F.lit(f"{stamp}-{slug(label)}").alias("delivery_id"), F.lit(label).alias("label"), F.lit(stamp).alias("ts"), "file",
        F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("bytes"))
