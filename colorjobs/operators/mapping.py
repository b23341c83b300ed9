"""Mapping resolution: suggestions, layers, history, corrections, and changes of the mapping tables.

Small sides (global maps, slots, themes) are left to the optimizer, which broadcasts them by their size in bytes. A source
that occurs more than once in a map, or in a file's overrides, counts once: the last one (see usage.folded).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from colorjobs.functions.colors import channels, delta_e76, gray_value, hex_to_lab, hex_to_rgb, is_grayscale, let, normalize_hex
from colorjobs.operators.ranking import ranked
from colorjobs.operators.usage import folded
from colorjobs.sources.shared import cut
from colorjobs.sources.tables import STATUSES


def first_by(df: DataFrame, key: str, order: str = "ord", last: bool = False) -> DataFrame:
    """One row for each key: the one with the smallest (or largest) order."""
    cols = F.struct(*(c for c in df.columns if c != key))
    pick = F.max_by(cols, order) if last else F.min_by(cols, order)
    return df.groupBy(key).agg(pick.alias("_p")).select(key, "_p.*")


# --- nearest -----------------------------------------------------------------------------------------------------------


def nearest_color(colors: DataFrame, keys: DataFrame, metric: str = "lab", most_keys: int = 50_000, side: float = 16.0, usual: int = 256) -> DataFrame:
    """Colors (hex), keys (source, ord): hex, via, distance of the nearest key; ties to the smallest ord, then source.

    Colour space is cut into cells of ``side``, halved down to 1 for as long as a cell and those around it hold more than
    ``most_keys`` keys, or more than ``usual`` for the mean key (there are 24 bits of colours, so a cell of side 1 has few): what a
    colour meets does not grow with the keys. Every cell has the keys in and around it as one array, in order, and a colour meets
    its own cell's array by an equi-join: the first place of the smallest distance is its answer, final if that distance is at
    most the side. Arrays are read where they meet, and never move with the colours. The colours left over go down a tree of
    cells (see _far)."""
    if metric not in ("lab", "rgb"):
        raise ValueError(f"metric must be lab or rgb, not {metric!r}")
    axes = ("L", "a", "b") if metric == "lab" else ("r", "g", "b")
    place = hex_to_lab(F.col("hex")) if metric == "lab" else hex_to_rgb(F.col("hex")).cast("struct<r:double,g:double,b:double>")
    parts = int(colors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = keys.groupBy(F.col("source").alias("hex")).agg(F.min("ord").alias("ord")).select("ord", F.col("hex").alias("source"), place.alias("q"))
    keyed = cut(keyed.where(f"q.{axes[0]} is not null").select("ord", "source", "q.*"), "keys")
    # distinct colours are written with their places: a filter on what follows would otherwise go below the distinct, and the
    # places would be worked out for each key
    own = cut(colors.select("hex").distinct().select("hex", place.alias("p")).select("hex", "p.*").repartition(parts), "colors").where(f"{axes[0]} is not null")
    around = F.array(*(F.struct(*(F.lit(x).alias(f"x{i}") for i, x in enumerate(step))) for step in itertools.product((-1, 0, 1), repeat=3)))
    beside = [(F.col(f"c{i}") + F.col(f"x.x{i}")).alias(f"c{i}") for i in range(3)]
    while True:
        cell = [F.floor(F.col(k) / side).cast("int").alias(f"c{i}") for i, k in enumerate(axes)]
        here = F.when((F.col("x.x0") == 0) & (F.col("x.x1") == 0) & (F.col("x.x2") == 0), F.col("n")).otherwise(0)
        sizes = keyed.groupBy(*cell).agg(F.count("*").alias("n")).select("*", F.explode(around).alias("x")).groupBy(*beside)
        sizes = sizes.agg(F.sum("n").alias("n"), F.sum(here).alias("here"))
        most, mean = sizes.agg(F.max("n"), F.sum(F.col("n") * F.col("here")) / F.sum("here")).first()
        if most is None:
            return own.where(F.lit(False)).select("hex", F.lit("").alias("via"), F.lit(0.0).alias("distance"))
        if (most <= most_keys and mean <= usual) or side <= 1:
            break
        side = max(1.0, side / 2)
    key = F.struct("ord", "source", *axes).alias("key")
    cells = keyed.select(key, *cell, F.explode(around).alias("x")).groupBy(*beside).agg(F.array_sort(F.collect_list("key")).alias("k"))
    met = own.select("hex", *axes, *cell).join(cells, ["c0", "c1", "c2"], "left")
    met = cut(met.select("hex", *axes, _nearest_of("k", axes).alias("m")), "near")
    far = _far(met.where(f"m is null or m.d > {side}").select("hex", *axes), keyed, axes, side)
    return met.where(f"m.d <= {side}").select("hex", "m").unionByName(far).select("hex", F.col("m.source").alias("via"), F.col("m.d").alias("distance"))


def _away(axes: tuple[str, ...], x: Column) -> Column:
    """Distance of a row's place from that in struct ``x``."""
    one, two, three = (F.col(k) - x[k] for k in axes)
    return F.sqrt(one * one + two * two + three * three)


def _nearest_of(array: str, axes: tuple[str, ...]) -> Column:
    """struct(d, ord, source) of the nearest key in an array column, or null."""

    def first(d: Column) -> Column:
        key = lambda m: F.get(F.col(array), (F.array_position(d, m) - 1).cast("int"))
        return let(F.array_min(d), lambda m: F.when(m.isNotNull(), F.struct(m.alias("d"), key(m)["ord"].alias("ord"), key(m)["source"].alias("source"))))

    return let(F.transform(array, lambda x: _away(axes, x)), first)


def _far(colors: DataFrame, keyed: DataFrame, axes: tuple[str, ...], side: float) -> DataFrame:
    """hex, m (struct of d, ord, source): the nearest key of colours that may lie anywhere, over a tree of cells.

    Each level has the cells that hold keys, each with one of its keys. A colour meets the cells around it on the level whose
    side spans all of colour space, then the halves of those that it keeps, by equi-joins on the parent. It keeps a cell if
    the cell's box is no farther than the nearest of the keys that were shown so far on this level, which rules out no nearest key,
    nor one that is as near. On the last level it meets the keys of the cells that are left."""
    levels = 0
    while side * 2**levels < 256:
        levels += 1
    cell = [F.floor(F.col(k) / side).cast("int").alias(f"c{i}") for i, k in enumerate(axes)]
    placed = keyed.select(F.struct("ord", "source", *axes).alias("key"), *cell)
    leaves = placed.groupBy("c0", "c1", "c2").agg(F.array_sort(F.collect_list("key")).alias("k"))
    at = [f"c{i}" for i in range(3)]
    shown = cut(leaves.select(*at, F.col("k")[0].alias("key")), "cells")
    near = (F.array(*(F.lit(x) for x in (-1, 0, 1))) for _ in at)
    open_ = colors
    for c, k, steps in zip(at, axes, near, strict=True):
        open_ = open_.select("*", F.explode(steps).alias("x")).withColumn(c, F.floor(F.col(k) / (side * 2**levels)).cast("int") + F.col("x")).drop("x")
    for level in range(levels, -1, -1):
        width = side * 2**level
        cells = shown.select(*(F.shiftright(c, level).alias(c) for c in at), "key").groupBy(*at).agg(F.min("key").alias("key"))
        if level == levels:
            open_ = open_.join(cells, at)
        else:
            halves = cells.select(*(F.shiftright(c, 1).alias(f"p{c}") for c in at), *at, "key")
            above = open_.select("hex", *axes, *(F.col(c).alias(f"p{c}") for c in at))
            open_ = above.join(halves, [f"p{c}" for c in at])
        out = [F.greatest(F.col(c) * width - F.col(k), F.col(k) - (F.col(c) + 1) * width, F.lit(0.0)) for c, k in zip(at, axes, strict=True)]
        box = F.sqrt(sum((x * x for x in out[1:]), out[0] * out[0]))
        bounded = open_.select("hex", *axes, *at, box.alias("box"), F.min(_away(axes, F.col("key"))).over(W.partitionBy("hex")).alias("least"))
        open_ = bounded.where("box <= least + 1e-6").select("hex", *axes, *at)
    ends = open_.join(leaves, at).select("hex", _nearest_of("k", axes).alias("m"))
    return ends.groupBy("hex").agg(F.min("m").alias("m"))


def nearest_swatch(colors: DataFrame, swatches: DataFrame) -> DataFrame:
    """Hex -> swatch_id, distance; null ids when there are no swatches. Ties go to the smallest source colour, then id."""
    keys = swatches.groupBy(F.col("source_hex").alias("source")).agg(F.min("id").alias("swatch_id"))
    near = nearest_color(colors, keys.select("source", F.col("source").alias("ord")))
    named = near.join(keys.withColumnRenamed("source", "via"), "via")
    return colors.select("hex").distinct().join(named, "hex", "left").select("hex", "swatch_id", "distance")


def of_pipeline(rows: DataFrame, pipeline: str) -> DataFrame:
    """Rows of one pipeline that have a target; a table without the column has those of one pipeline only."""
    rows = rows.where("target != ''")
    return rows.where(F.col("pipeline") == pipeline) if "pipeline" in rows.columns else rows


def suggest(usage: DataFrame, global_map: DataFrame, overrides: DataFrame, metric: str = "lab", threshold: float = 10.0, nearest: bool = True,
    pipeline: str = "grayscale") -> DataFrame:
    """Override, exact, nearest within the threshold, or none; all of one pipeline."""
    colors = usage.select("hex").distinct()
    g = folded(of_pipeline(global_map, pipeline).select("source", "target", "label", "notes", "ord"), "source")
    exact = colors.join(g, colors.hex == g.source).select("hex",
        F.struct("target", F.lit("exact").alias("kind"), F.lit(0.0).alias("distance"), F.col("source").alias("via"), "label", "notes").alias("s"))
    if nearest:
        left = colors.join(g.select(F.col("source").alias("hex")), "hex", "left_anti")
        near = nearest_color(left, g.select("source", "ord"), metric).where(F.col("distance") <= threshold)
        near = near.join(g, near.via == g.source).select("hex", F.struct("target", F.lit("near").alias("kind"), "distance", "via", "label", "notes").alias("s"))
        exact = exact.unionByName(near)
    o = folded(of_pipeline(overrides, pipeline).select("file", "source", "target"), "file", "source")
    o = o.select("file", F.col("source").alias("hex"), F.struct("target", F.lit("exact").alias("kind"), F.lit(0.0).alias("distance"),
        F.col("source").alias("via"), F.lit("override").alias("label"), F.lit("").alias("notes")).alias("o"))
    none = F.struct(F.lit(None).cast("string").alias("target"), F.lit("none").alias("kind"), F.lit(None).cast("double").alias("distance"),
        F.lit(None).cast("string").alias("via"), F.lit("").alias("label"), F.lit("").alias("notes"))
    return usage.select("file", "hex").join(o, ["file", "hex"], "left").join(exact, "hex", "left").select("file", "hex",
        F.coalesce("o", "s", none).alias("s")).select("file", "hex", "s.*")


# --- layers ------------------------------------------------------------------------------------------------------------


def merge_mappings(usage: DataFrame, global_map: DataFrame, overrides: DataFrame, pipeline: str = "grayscale") -> DataFrame:
    """J4 for the colours in use, in one pipeline: (file, source, target); entries with an empty target are dropped, overrides win."""
    o = folded(of_pipeline(overrides, pipeline).select("file", "source", "target"), "file", "source").withColumnRenamed("target", "o")
    g = folded(of_pipeline(global_map, pipeline), "source").select("source", F.col("target").alias("g"))
    return usage.select("file", F.col("hex").alias("source")).join(o, ["file", "source"], "left").join(g, "source", "left").select("file", "source",
        F.coalesce("o", "g").alias("target")).where("target is not null")


def theme_resolve(slots: DataFrame, themes: DataFrame, active: str, pipeline: str) -> DataFrame:
    """J6 with W5: hex -> owning slot (the first by ord) and its target, null where theme or target are missing."""
    own = first_by(slots.select(F.col("authored").alias("hex"), F.col("name").alias("slot"), "ord"), "hex")
    t = themes.where((F.col("theme") == active) & (F.col("pipeline") == pipeline) & (F.col("target") != "")).select("slot", "target")
    return own.select("hex", "slot").join(t, "slot", "left").select("hex", "slot", "target")


def theme_overrides(slots: DataFrame, themes: DataFrame, active: str, pipeline: str) -> DataFrame:
    """hex -> target by the active theme: of several slots the last one that has a target."""
    t = themes.where((F.col("theme") == active) & (F.col("pipeline") == pipeline) & (F.col("target") != "")).select("slot", "target")
    return first_by(slots.join(t, slots.name == t.slot).select(F.col("authored").alias("hex"), "target", "ord"), "hex", last=True).select("hex", "target")


def merge_with_semantic(usage: DataFrame, global_map: DataFrame, slots: DataFrame, themes: DataFrame, active: str, overrides: DataFrame,
    pipeline: str = "grayscale") -> DataFrame:
    """Override > theme > global > none, exact only. (file, hex, n, layer, target): target is the colour itself for none."""
    mine = (F.col("pipeline") == pipeline) & (F.col("target") != "")
    g = folded(global_map.where(mine), "source").select(F.col("source").alias("hex"), F.col("target").alias("g"))
    t = theme_overrides(slots, themes, active, pipeline).withColumnRenamed("target", "t")
    o = folded(overrides.where(mine).select("file", "source", "target"), "file", "source").select("file", F.col("source").alias("hex"),
        F.col("target").alias("o"))
    layer = F.when(F.col("o").isNotNull(), "override").when(F.col("t").isNotNull(), "theme").when(F.col("g").isNotNull(), "global").otherwise("none")
    return usage.join(g, "hex", "left").join(t, "hex", "left").join(o, ["file", "hex"], "left").select("file", "hex",
        *(c for c in ("n",) if c in usage.columns), layer.alias("layer"), F.coalesce("o", "t", "g", "hex").alias("target"))


def resolve_palette(suggestions: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual pick > suggestion > null; a pick that is no #RRGGBB is marked in ``rejected``."""
    m = manual.select("file", F.col("source").alias("hex"), F.upper("target").alias("pick"))
    fine = F.col("pick").rlike("^#[0-9A-F]{6}$")
    return suggestions.select("file", "hex", F.col("target").alias("suggested")).join(m, ["file", "hex"], "left").select("file", "hex",
        F.coalesce(F.when(fine, F.col("pick")), F.col("suggested")).alias("target"), F.when(~fine, F.col("pick")).alias("rejected"))


def persistable_overrides(picks: DataFrame, global_map: DataFrame, pipeline: str = "grayscale") -> DataFrame:
    """Picks that change something: neither the colour itself nor what the pipeline's map says of it."""
    g = folded(of_pipeline(global_map, pipeline), "source").select("source", F.col("target").alias("g"))
    return picks.join(g, "source", "left").where((F.col("target") != F.col("source")) & ~F.col("target").eqNullSafe(F.col("g"))).select("file",
        "source", "target")


def unmapped_colors(resolved: DataFrame) -> DataFrame:
    """J9 on J5's rows."""
    return resolved.where("layer = 'none'").select("file", "hex")


def device_merge(global_device: DataFrame, per_file: DataFrame, files: DataFrame) -> DataFrame:
    """(file, source, cmyk): for each of ``files`` the global overrides, its own on top; sources that are no colour go. Of
    sources that are one colour in other spellings the last counts: by ord where there is one, else the largest spelling."""
    key = normalize_hex(F.col("source"))

    def last(rows: DataFrame, *by: str) -> DataFrame:
        order = F.struct(*(["ord"] if "ord" in rows.columns else []), F.col("source").alias("spelled"), "cmyk")
        return rows.select(*by, key.alias("hex"), "cmyk", order.alias("o")).where("hex is not null").groupBy(*by,
            F.col("hex").alias("source")).agg(F.max_by("cmyk", "o").alias("cmyk"))

    g, o = last(global_device), last(per_file, "file").withColumnRenamed("cmyk", "own")
    used = files.select("file", F.col("hex").alias("source")).distinct()
    return used.join(g, "source", "left").join(o, ["file", "source"], "left").select("file", "source",
        F.coalesce("own", "cmyk").alias("cmyk")).where("cmyk is not null")


def effective_corrections(merged: DataFrame, device: DataFrame) -> DataFrame:
    """J11."""
    return merged.join(device.select("file", "source"), ["file", "source"], "left_anti")


def library(svgs: DataFrame, illustrations: DataFrame, overrides: DataFrame, status: str | None = None) -> DataFrame:
    """Every file with its metadata (defaults where it has none) and override counts of both pipelines."""
    counts = overrides.groupBy("file").agg(*(F.sum((F.col("pipeline") == p).cast("int")).alias(f"{p}_overrides") for p in ("grayscale", "cmyk")))
    j = svgs.select("file").join(illustrations.withColumn("has_metadata", F.lit(True)), "file", "left").join(counts, "file", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = j.select("file", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("cmyk_status", F.lit("pending")).alias("cmyk_status"),
        F.coalesce("cmyk_auto_fix", F.lit(False)).alias("cmyk_auto_fix"), F.coalesce("has_metadata", F.lit(False)).alias("has_metadata"),
            F.coalesce("notes", F.lit("")).alias("notes"), zero("grayscale_overrides"), zero("cmyk_overrides"))
    return out if status is None else out.where(F.col("status") == status)


def palette_usage(swatches: DataFrame, usage: DataFrame) -> DataFrame:
    """Files of each swatch over all its members."""
    members = swatches.select("id", F.explode("members").alias("hex"))
    hits = members.join(usage.select("hex", "file"), "hex").select("id", "file").distinct().groupBy("id").agg(F.count("*").alias("n_files"))
    return swatches.select("id").join(hits, "id", "left").select("id", F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"))


def auto_migrate(slots: DataFrame, global_map: DataFrame, pipeline: str) -> tuple[DataFrame, DataFrame]:
    """(new slots, new theme targets) for unclaimed sources, in map order; each takes the lowest free number.

    Sources and free numbers are ranked alike, each over the whole table by ranges, and the n-th source meets the n-th number by
    an equi-join: neither has to fit one task."""
    mapped = folded(global_map.where((F.col("pipeline") == pipeline) & (F.col("target") != "")), "source")
    open_ = mapped.join(slots.select(F.col("authored").alias("source")).distinct(), "source", "left_anti")
    rows = ranked(open_.select("source", "target", "label", "notes", "ord"), F.col("ord").asc_nulls_first(), F.col("source").asc())
    named = F.format_string("auto.%03d", "number")
    number = F.regexp_extract("name", r"^auto\.(\d{1,18})$", 1).try_cast("long").alias("number")
    used = slots.select("name", number).where((F.col("number") > 0) & (named == F.col("name"))).select("number").distinct()
    # with so many numbers in use, the n-th free one is at most n + that many
    most = rows.count() + used.count()
    free = ranked(rows.sparkSession.range(1, most + 1).toDF("number").join(used, "number", "left_anti"), F.col("number").asc())
    made = rows.join(free, "nth").withColumn("name", named)
    label = F.when(F.coalesce("label", F.lit("")) == "", F.col("source")).otherwise(F.col("label"))
    new = made.select("name", F.col("source").alias("authored"), label.alias("label"), "notes", "ord")
    return new, made.select(F.col("name").alias("slot"), F.lit(pipeline).alias("pipeline"), "target")


def promote_overrides(overrides: DataFrame, global_map: DataFrame, pipeline: str, everything: bool = False) -> DataFrame:
    """The new global map. Reviewed: sources that are not yet global, first file wins; everything: all sources, upserted."""
    label = "auto-promoted from editor" if pipeline == "grayscale" else "auto-promoted from CMYK editor"
    picked = overrides.where(F.col("pipeline") == pipeline).groupBy("source").agg(F.min_by("target", F.struct("file", "target")).alias("target"))
    rows = picked.select(F.lit(pipeline).alias("pipeline"), "source", "target", F.lit(label).alias("label"), F.lit("").alias("notes"))
    return upsert_map(global_map, rows, keep_old=not everything)


def match_paint_operators(ops: DataFrame, overrides: DataFrame, tolerance: float = 0.002) -> DataFrame:
    """Ops (doc, page, stream, idx, op, operands), overrides (source, cmyk, ord). rg/RG within the tolerance of a
    source become k/K with its exact quad; k/K within it snap to the quad. The first override by ord wins.

    Distinct operands are matched once and joined back. The match is a band join: the first two channels are cut into cells
    of the tolerance's size, an override is put into the neighbouring cells, and the rest is compared."""
    width = 2 * tolerance
    cell = lambda a, i: F.floor(F.get(a, F.lit(i)) / width).cast("long")
    around = lambda a, i: F.array(*(cell(a, i) + k for k in (-1, 0, 1)))
    quad = F.array(*(F.col(f"cmyk.{k}") / 100 for k in ("c", "m", "y", "k")))
    rgb = F.array(*(c / 255.0 for c in channels(F.col("source"))))
    o = overrides.select("source", "ord", quad.alias("quad"), rgb.alias("rgb"))
    keys = o.select("source", "ord", "quad", F.explode(F.array(F.struct(F.lit(3).alias("dims"), F.col("rgb").alias("at")),
        F.struct(F.lit(4).alias("dims"), F.col("quad").alias("at")))).alias("k"))
    keys = keys.select("source", "ord", "quad", "k.*").withColumn("c0", F.explode(around(F.col("at"), 0))).withColumn("c1", F.explode(around(F.col("at"), 1)))
    dims = F.when(F.lower("op") == "rg", 3).when(F.lower("op") == "k", 4)
    own = ops.withColumn("dims", dims)
    seen = own.where(F.size("operands") == F.col("dims")).select("dims", "operands").distinct()
    close = F.forall(F.zip_with("operands", "at", lambda x, y: F.abs(x - y)), lambda d: d <= tolerance + 1e-12)
    hits = seen.withColumn("c0", cell(F.col("operands"), 0)).withColumn("c1", cell(F.col("operands"), 1)).join(keys, ["dims", "c0", "c1"]).where(close)
    best = hits.groupBy("dims", "operands").agg(F.min_by(F.struct("source", "quad"), F.struct("ord", "source")).alias("m"))
    j = own.join(best, ["dims", "operands"], "left")
    new_op = F.when(F.col("m").isNull(), F.col("op")).when(F.col("op").isin("RG", "K"), "K").otherwise("k")
    return j.select("doc", "page", "stream", "idx", "op", "operands", F.col("m.source").alias("source"), new_op.alias("new_op"),
        F.coalesce("m.quad", "operands").alias("new_operands"))


def paint_report(matched: DataFrame, overrides: DataFrame) -> DataFrame:
    """Matches of each source, zero for those missing."""
    n = matched.where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    return overrides.select("source").distinct().join(n, "source", "left").select("source", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        F.col("n").isNull().alias("missing"))


def printed_appearance(colors: DataFrame, icc: DataFrame, signature: str) -> DataFrame:
    """Colors (hex), icc (icc_signature, hex, printed_hex): printed colour and how far it is; null without profile."""
    p = icc.where(F.col("icc_signature") == signature).select("hex", "printed_hex")
    return colors.join(p, "hex", "left").withColumn("delta_e", delta_e76(F.col("hex"), F.col("printed_hex")))


def stale_appearance(colors: DataFrame, cache: DataFrame, signature: str) -> DataFrame:
    """Colours that the cache does not hold for this (non-empty) signature."""
    held = cache.where((F.col("icc_signature") == signature) & F.lit(signature != "")).select("hex")
    return colors.select("hex").distinct().join(held, "hex", "left_anti")


def refresh_appearance(colors: DataFrame, cache: DataFrame, icc: DataFrame, signature: str) -> DataFrame:
    """The cache (icc_signature, hex, printed_hex) after a refresh for ``signature``: what it holds already stays, what
    it lacks of ``colors`` comes from the profile's table; entries of other signatures go."""
    held = cache.where((F.col("icc_signature") == signature) & F.lit(signature != "")).select("icc_signature", "hex", "printed_hex")
    made = stale_appearance(colors, cache, signature).join(icc.where(F.col("icc_signature") == signature).select("hex", "printed_hex"), "hex")
    return held.unionByName(made.select(F.lit(signature).alias("icc_signature"), "hex", "printed_hex"))


def press_preview_map(resolved: DataFrame, icc: DataFrame, signature: str) -> DataFrame:
    """Correction, then round trip; only what changes."""
    p = icc.where(F.col("icc_signature") == signature).select(F.col("hex").alias("target"), "printed_hex")
    return resolved.join(p, "target", "left").select("file", "hex", F.coalesce("printed_hex", "target").alias("shown")).where("shown != hex")


# --- aggregates --------------------------------------------------------------------------------------------------------


def mapping_history(global_map: DataFrame, overrides: DataFrame, pipeline: str = "grayscale") -> DataFrame:
    """A1."""
    both = global_map.where((F.col("pipeline") == pipeline) & (F.col("target") != "")).select("source",
        "target").unionByName(overrides.where((F.col("pipeline") == pipeline) & (F.col("target") != "")).select("source", "target"))
    return both.groupBy("source", "target").agg(F.count("*").alias("n"))


def override_usage(overrides: DataFrame, pipeline: str = "grayscale") -> DataFrame:
    """A2: (file, source) is unique, so rows are files."""
    return overrides.where(F.col("pipeline") == pipeline).groupBy("source").agg(F.count("*").alias("n_files"))


def suggest_from_history(history: DataFrame, top: int = 5) -> DataFrame:
    """W1."""
    k = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), "target"))
    return history.where("target != source").withColumn("rank", k).where(F.col("rank") <= top)


def status_counts(files: DataFrame) -> DataFrame:
    """A3: both pipelines in one pass; all four statuses are there."""
    rows = files.select(F.explode(F.array(F.struct(F.lit("grayscale").alias("pipeline"), F.col("status").alias("status")),
        F.struct(F.lit("cmyk").alias("pipeline"), F.col("cmyk_status").alias("status")))).alias("e")).select("e.*")
    grid = files.sparkSession.range(1).select(F.explode(F.array(F.lit("grayscale"), F.lit("cmyk"))).alias("pipeline")).select("pipeline",
        F.explode(F.array(*map(F.lit, STATUSES))).alias("status"))
    n = rows.groupBy("pipeline", "status").agg(F.count("*").alias("n"))
    return grid.join(n, ["pipeline", "status"], "left").select("pipeline", "status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def next_pending(files: DataFrame) -> DataFrame:
    """W2."""
    return files.where("status = 'pending'").orderBy(F.lower("file"), "file").limit(1)


def print_safety(merged: DataFrame, min_gray: str = "#EEEEEE") -> DataFrame:
    """A4: merged (file, source, target) -> one warning for each (file, target): too light, or else not gray."""
    per = merged.groupBy("file", "target").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    lum, limit = gray_value(F.col("target")), gray_value(F.lit(min_gray))
    r, g, b = channels(F.col("target"))
    light = F.format_string(f"too light to print: %d, at most %d ({min_gray}) shows", lum, limit)
    tint = F.format_string("tinted: red %d, green %d, blue %d", r, g, b)
    return per.select("file", "target", "sources", lum.alias("luminance"),
        F.when(lum > limit, light).when(~is_grayscale(F.col("target"), 4), tint).alias("reason")).where("reason is not null")


def recolor_detail(usage: DataFrame, resolved: DataFrame) -> DataFrame:
    """A5, by colour: (file, hex, n, mapped)."""
    return resolved.select("file", "hex", "n", (F.col("layer") != "none").alias("mapped"))


def recolor_report(resolved: DataFrame) -> DataFrame:
    """A5: replaced and unmapped tokens of each file. resolved has one row a (file, hex) with its n."""
    hit = F.col("layer") != "none"
    return resolved.groupBy("file").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("replacements"),
        F.sum(F.when(hit, 0).otherwise(F.col("n"))).alias("unmapped_tokens"), F.sum((~hit).cast("int")).alias("unmapped_colors"))


def shift_table(resolved: DataFrame) -> DataFrame:
    """A6."""
    return resolved.where("layer != 'none'").groupBy(F.col("hex").alias("source"), "target").agg(F.sum("n").alias("n"))


def unmapped_preview(resolved: DataFrame, n: int = 8) -> DataFrame:
    """The first n unmapped colours of a file and how many more there are."""
    u = unmapped_colors(resolved)
    total = u.groupBy("file").agg(F.count("*").alias("total"))
    kth = F.row_number().over(W.partitionBy("file").orderBy("hex"))
    first = u.withColumn("k", kth).where(F.col("k") <= n).groupBy("file").agg(F.array_sort(F.collect_list("hex")).alias("first"))
    return first.join(total, "file").select("file", "first", (F.col("total") - F.size("first")).alias("more"))


def replace_preflight(global_map: DataFrame, overrides: DataFrame, swatches: DataFrame, pipeline: str = "cmyk") -> DataFrame:
    """For each swatch what replace_globally would change in that pipeline. A member, and a source of the map, counts once."""
    m = swatches.select("id", "source_hex", F.explode("members").alias("source")).where("source != source_hex").distinct()
    g = folded(of_pipeline(global_map, pipeline), "source")
    overrides = overrides.where(F.col("pipeline") == pipeline) if "pipeline" in overrides.columns else overrides
    g = m.join(g.select("source", F.col("target").alias("g")), "source",
        "left").groupBy("id").agg(F.sum((~F.col("g").eqNullSafe(F.col("source_hex"))).cast("int")).cast("long").alias("global_changes"))
    o = m.join(overrides.select("file", "source").distinct(), "source")
    gone = o.groupBy("id").agg(F.count("*").alias("overrides_deleted"))
    files = o.select("id", "file").distinct().groupBy("id").agg(F.count("*").alias("files"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return swatches.select("id").join(g, "id", "left").join(gone, "id", "left").join(files, "id", "left").select("id", zero("global_changes"),
        zero("overrides_deleted"), zero("files"))


# --- changes -----------------------------------------------------------------------------------------------------------


def upsert_map(table: DataFrame, rows: DataFrame, keep_old: bool = False) -> DataFrame:
    """Keyed on (pipeline, source). rows: distinct keys; new ones go to the end of the order."""
    key = ["pipeline", "source"]
    old = table.withColumn("ord", F.col("ord").cast("long")) if "ord" in table.columns else table.withColumn("ord", F.lit(None).cast("long"))
    if keep_old:
        return old.unionByName(rows.join(table.select(*key), key, "left_anti"), allowMissingColumns=True)
    kept = rows.join(old.select(*key, "ord"), key, "left")
    return old.join(rows.select(*key), key, "left_anti").unionByName(kept, allowMissingColumns=True)


def remove_map(table: DataFrame, keys: DataFrame) -> DataFrame:
    """U1."""
    on = [c for c in ("pipeline", "source") if c in keys.columns]
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def cleanup_identity(global_map: DataFrame, overrides: DataFrame, pipeline: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both tables without target = source, and a report."""
    same = (F.col("pipeline") == pipeline) & (F.col("target") == F.col("source"))
    o = overrides.where(same).agg(F.count("*").alias("overrides_removed"), F.count_distinct("file").alias("files"))
    g = global_map.where(same).agg(F.count("*").alias("global_removed"))
    return global_map.where(~same), overrides.where(~same), g.join(F.broadcast(o))  # one row each


def wipe_pipeline(illustrations: DataFrame, overrides: DataFrame, device: DataFrame, files: DataFrame, pipeline: str) -> dict[str, DataFrame]:
    """For the files that have metadata: this pipeline's overrides go (for cmyk device overrides too), its status is
    pending again, and metadata that says nothing any more goes. cmyk_auto_fix is left alone and does not keep a row."""
    touched = files.select("file").distinct().join(illustrations.select("file"), "file", "left_semi")
    mine = F.col("pipeline") == pipeline
    left = overrides.where(~mine).unionByName(overrides.where(mine).join(touched, "file", "left_anti"))
    dev = device.join(touched, "file", "left_anti") if pipeline == "cmyk" else device
    field = "status" if pipeline == "grayscale" else "cmyk_status"
    reset = illustrations.join(touched, "file", "left_semi").withColumn(field, F.lit("pending"))
    kept = left.select("file").unionByName(dev.where("file is not null").select("file")).distinct().withColumn("_has", F.lit(True))
    empty = F.col("_has").isNull() & (F.col("status") == "pending") & (F.col("cmyk_status") == "pending") & (F.coalesce("notes", F.lit("")) == "")
    rest = reset.join(kept, "file", "left").where(~empty).drop("_has")
    return {"illustrations": illustrations.join(touched, "file", "left_anti").unionByName(rest), "overrides": left, "device": dev, "touched": touched}


def replace_globally(global_map: DataFrame, overrides: DataFrame, swatches: DataFrame, pipeline: str = "cmyk") -> tuple[DataFrame, DataFrame]:
    """U4: members go to their swatch's colour in the map, and files lose their own overrides of them."""
    m = swatches.select(F.lit(pipeline).alias("pipeline"), F.explode("members").alias("source"), F.col("source_hex").alias("target"), "label",
        "notes").where("source != target")
    m = m.groupBy("pipeline", "source").agg(F.min(F.struct("target", "label", "notes")).alias("m")).select("pipeline", "source", "m.*")
    return upsert_map(global_map,
        m), overrides.where(F.col("pipeline") != pipeline).unionByName(overrides.where(F.col("pipeline") == pipeline).join(m.select("source"),
            "source", "left_anti").select(*overrides.columns))


def mapping_diff(before: DataFrame, after: DataFrame, members: DataFrame) -> DataFrame:
    """(file, hex, before, after) for member colours whose effective target changes. Both sides: J5's rows."""
    b, a = (x.join(members.select("hex"), "hex", "left_semi").select("file", "hex", F.col("target").alias(n)) for x,
        n in ((before, "before"), (after, "after")))
    return b.join(a, ["file", "hex"], "full").where(~F.col("before").eqNullSafe(F.col("after")))


def reset_colors(global_map: DataFrame, overrides: DataFrame, device: DataFrame, resets: DataFrame, pipeline: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resets (file, hex): the files' overrides and the global entries go; for cmyk the device entries too."""
    r = resets.select("file", F.col("hex").alias("source")).distinct()
    mine = F.col("pipeline") == pipeline
    o = overrides.where(~mine).unionByName(overrides.where(mine).join(r, ["file", "source"], "left_anti").select(*overrides.columns))
    g = global_map.where(~mine).unionByName(global_map.where(mine).join(r.select("source").distinct(), "source", "left_anti").select(*global_map.columns))
    d = device.join(r.select("source").distinct(), "source", "left_anti").select(*device.columns) if pipeline == "cmyk" else device
    return g, o, d


def mark_status(illustrations: DataFrame, files: DataFrame, status: str, stamp: Column, field: str = "status") -> DataFrame:
    """U7."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    hit = F.col("_hit").isNotNull()
    return illustrations.join(files.select("file").distinct().withColumn("_hit", F.lit(True)), "file", "left").withColumn(field,
        F.when(hit, status).otherwise(F.col(field))).withColumn("updated_at", F.when(hit, stamp).otherwise(F.col("updated_at"))).drop("_hit")
