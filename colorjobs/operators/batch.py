"""Selection of files, and per-file and per-batch reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colorjobs.functions.svg import recolored
from colorjobs.operators.usage import folded


def select_for_convert(library: DataFrame, unmapped: DataFrame, overrides: DataFrame, only_reviewed: bool = False, force: bool = False,
    files: DataFrame | None = None) -> DataFrame:
    """(file, convert, reason): a file with unmapped colours is skipped unless it has overrides, is reviewed or is forced."""
    chosen = library.where("status = 'reviewed'") if only_reviewed else library
    chosen = chosen if files is None else chosen.join(files.select("file").distinct(), "file", "left_semi")
    n = unmapped.groupBy("file").agg(F.count("*").alias("n"))
    own = overrides.select("file").distinct().withColumn("own", F.lit(True))
    skip = (F.coalesce("n", F.lit(0)) > 0) & F.col("own").isNull() & (F.col("status") != "reviewed") & F.lit(not force)
    return chosen.join(n, "file", "left").join(own, "file", "left").select("file", (~skip).alias("convert"),
        F.when(skip, F.format_string("%d unmapped colors", "n")).alias("reason"))


def recolor_svgs(svgs: DataFrame, merged: DataFrame) -> DataFrame:
    """Merged (file, source, target); of a repeated source the last counts. The maps (small) are brought to the
    documents; one join on the file."""
    maps = folded(merged, "file", "source").groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("source",
        "target"))).alias("m"))  # a document's own colours
    done = svgs.select("file", "content").join(maps, "file", "left").select("file", recolored(F.col("content"), F.col("m")).alias("r"))
    return done.select("file", "r.*")


def batch_files(files: DataFrame, report: DataFrame, facts: DataFrame, force_k: DataFrame, tac: DataFrame | None = None) -> DataFrame:
    """One quality row a file; all sides are keyed on the file, so the joins share one partitioning."""
    j = files.select("file").join(report, "file", "left").join(facts, "file", "left").join(force_k, "file", "left")
    j = j.join(tac.select(F.col("page").alias("file"), "max_pct", F.col("status").alias("tac_status")), "file",
        "left") if tac is not None else j.withColumn("max_pct", F.lit(None).cast("double")).withColumn("tac_status", F.lit(None).cast("string"))
    warn = F.array_compact(F.array(
        F.when(F.col("has_text"), "contains <text>"), F.when(F.col("has_image"), "contains <image>"),
            F.when(F.coalesce("unmapped_colors", F.lit(0)) > 0, F.format_string("%d unmapped colors", "unmapped_colors")),
        F.when(F.coalesce("stroke_count", F.lit(0)) + F.coalesce("text_count", F.lit(0)) > 0,
            F.format_string("fine black: %d strokes, %d texts", F.coalesce("stroke_count", F.lit(0)), F.coalesce("text_count", F.lit(0)))),
        F.when(F.col("tac_status").isin("warn", "fail"), F.concat(F.lit("ink coverage "), "tac_status")),
    ))
    bad = F.col("parse_error").isNotNull()
    return j.select("file", F.when(bad, "error").otherwise("ok").alias("status"),
        F.coalesce("replacements", F.lit(0)).cast("long").alias("replacements"),
            F.coalesce("unmapped_colors", F.lit(0)).cast("long").alias("unmapped"),
                F.concat(F.coalesce("color_space_warnings", F.array().cast("array<string>")), warn).alias("warnings"), "max_pct", "tac_status",
                    F.coalesce("stroke_count", F.lit(0)).cast("long").alias("stroke_count"),
                        F.coalesce("text_count", F.lit(0)).cast("long").alias("text_count"), F.col("parse_error").alias("error"))


def batch_summary(files: DataFrame) -> DataFrame:
    """A17."""
    return files.agg(F.count("*").alias("total"), F.coalesce(F.sum((F.col("status") == "ok").cast("int")), F.lit(0)).cast("long").alias("succeeded"),
        F.coalesce(F.sum((F.col("status") != "ok").cast("int")), F.lit(0)).cast("long").alias("failed"))


def run_summary(outcomes: DataFrame, warnings: DataFrame, warn_only: bool = False) -> DataFrame:
    """Outcomes (file, outcome: converted, skipped or failed) -> counts and the exit decision (3, 4 or 0)."""
    n = lambda k: F.coalesce(F.sum((F.col("outcome") == k).cast("int")), F.lit(0)).cast("long").alias(k)
    w = warnings.agg(F.count("*").alias("safety_warnings"))
    s = outcomes.agg(n("converted"), n("skipped"), n("failed")).join(F.broadcast(w))  # one row each
    return s.withColumn("exit_code", F.when(F.col("failed") > 0, 3).when((F.col("safety_warnings") > 0) & F.lit(not warn_only), 4).otherwise(0))
