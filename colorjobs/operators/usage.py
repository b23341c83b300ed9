"""Colour usage over a library: counts, inverted index, document frequency, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from colorjobs.functions.colors import FAMILIES, color_sort_key, family_of, hex_to_lab
from colorjobs.sources.shared import cut, tasks_for


def folded(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each key: the last by column ord, or, without one, the one with the largest target."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(*(c for c in ("ord", "target") if c in rest))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, "_last.*")


def color_usage(tokens: DataFrame) -> DataFrame:
    """N, contexts and raw forms of each (file, hex)."""
    return tokens.groupBy("file", "hex").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("context")).alias("contexts"),
        F.array_sort(F.collect_set("raw")).alias("raw_forms"))


def usage_counts(tokens: DataFrame, tasks: int | None = None) -> DataFrame:
    """file, hex, n: C5 without the sets. Nearly every token is a row of its own, so a task holds as many rows as it gets: with
    ``tasks`` (see shared.tasks_for) these are few."""
    tokens = tokens if tasks is None else tokens.select("file", "hex").repartition(tasks, "file", "hex")
    return tokens.groupBy("file", "hex").agg(F.count("*").alias("n"))


def svg_facts(rows: DataFrame) -> DataFrame:
    """One row a file from extract()'s rows. Colours of a file are counted map-side first."""
    colours = rows.where("kind = 'token'").select("file", "hex").distinct().groupBy("file").agg(F.count("*").cast("int").alias("n_colors"))
    facts = rows.where("kind in ('fact', 'error')").select("file", "profiles", "spaces", "has_image", "has_text", F.col("error").alias("parse_error"))
    profile = F.when(F.col("profiles") > 0, F.format_string("%d <color-profile> element(s)", "profiles"))
    space = F.when(F.size("spaces") > 0, F.concat(F.lit("non-sRGB interpolation: "), F.array_join("spaces", ", ")))
    return facts.join(colours, "file", "left").select("file", F.coalesce("n_colors", F.lit(0)).alias("n_colors"),
        F.array_compact(F.array(profile, space)).alias("color_space_warnings"), F.coalesce("has_image", F.lit(False)).alias("has_image"),
            F.coalesce("has_text", F.lit(False)).alias("has_text"), "parse_error")


def color_files(usage: DataFrame) -> DataFrame:
    """(hex, file), distinct; every file, one row each, so a colour may be in most files."""
    return usage.select("hex", "file").distinct()


def files_by_color(usage: DataFrame, listed: int = 1000) -> DataFrame:
    """Preview of C7: hex -> number of files and the first ``listed`` of them by name; color_files has all."""
    pairs = color_files(usage)
    ranked = pairs.withColumn("k", F.row_number().over(W.partitionBy("hex").orderBy("file"))).where(F.col("k") <= listed)
    lists = ranked.groupBy("hex").agg(F.array_sort(F.collect_list("file")).alias("files"))
    return pairs.groupBy("hex").agg(F.count("*").alias("n_files")).join(lists, "hex")


def distinct_colors(usage: DataFrame) -> DataFrame:
    """C8."""
    return usage.select("hex").distinct()


def batch_palette(usage: DataFrame) -> DataFrame:
    """Number of files of each colour. usage has one row a (file, hex), so counting rows is enough."""
    return usage.groupBy("hex").agg(F.count("*").alias("n_files"))


def palette_report(palette: DataFrame, corrections: DataFrame, pipeline: str = "cmyk") -> DataFrame:
    """C10. Only the pipeline's rows are corrections (a table without that column has no others); of a source that occurs
    twice the last one counts."""
    corrections = corrections.where(F.col("pipeline") == pipeline) if "pipeline" in corrections.columns else corrections
    t = folded(corrections, "source").select(F.col("source").alias("hex"), F.col("target").alias("t"))
    return palette.join(t, "hex", "left").select("hex", "n_files", F.coalesce("t", "hex").alias("target"),
        (F.col("t").isNull() | (F.col("t") == F.col("hex"))).alias("unchanged"))


def top_colors(usage: DataFrame, n: int = 10) -> DataFrame:
    """C11: ties by hex."""
    k = F.row_number().over(W.partitionBy("file").orderBy(F.desc("n"), "hex"))
    return usage.select("file", "hex", "n", k.alias("rank")).where(F.col("rank") <= n)


def sort_colors(usage: DataFrame) -> DataFrame:
    """Perceptual order inside a file."""
    keyed = usage.select("hex").distinct().select("hex", color_sort_key(F.col("hex")).alias("key"))
    return usage.select("file", "hex").join(keyed, "hex").select("file", "hex",
        F.row_number().over(W.partitionBy("file").orderBy("key", "hex")).alias("position"))


def hue_lightness_histogram(usage: DataFrame, bins: int = 6) -> DataFrame:
    """Family x lightness bin -> colours, tokens, files; every cell is present. The cells of the distinct colours are
    written once with their counts, so the formula runs once a colour; files are counted exactly over (cell, file), in tasks of
    a fixed number of rows."""
    if bins < 2:
        raise ValueError("bins must be at least 2")
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("lab.L") / 100 * bins))).cast("int")
    per = usage.groupBy("hex").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    cells = per.select("*", hex_to_lab(F.col("hex")).alias("lab")).select("hex", "n", "rows", family_of(F.col("lab")).alias("family"), bin_.alias("bin"))
    cells = cut(cells.repartition(int(usage.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "cells")
    tasks = tasks_for(usage.sparkSession, cells.agg(F.sum("rows")).first()[0] or 0)
    pairs = usage.select("hex", "file").repartition(tasks, "hex").join(cells.select("hex", "family", "bin"), "hex").select("family", "bin", "file")
    files = pairs.repartition(tasks, "family", "bin", "file").distinct().groupBy("family", "bin").agg(F.count("*").alias("files"))
    colours = cells.groupBy("family", "bin").agg(F.count("*").alias("colors"), F.sum("n").alias("tokens"))
    grid = usage.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, FAMILIES))).alias("family")).select("family",
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return grid.join(colours, ["family", "bin"], "left").join(files, ["family", "bin"], "left").select("family", "bin", zero("colors"),
        zero("tokens"), zero("files"))
