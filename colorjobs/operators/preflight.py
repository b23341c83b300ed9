"""Press preflight: fine black lines, ink coverage, content boxes, render differences, page geometry, output names."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from colorjobs.functions.colors import delta_e76, parse_length_pt, user_units_per_pt, viewbox
from colorjobs.functions.svg import STROKED
from colorjobs.operators.components import components
from colorjobs.session import ship
from colorjobs.sources.shared import cut

# --- fine black lines --------------------------------------------------------------------------------------------------


def force_k_hits(rows: DataFrame, trim_width: float, min_stroke: float = 0.5, min_text: float = 9.0) -> DataFrame:
    """A10 on extract()'s rows: (file, ord, element, kind, color_hex, size_pt, sample)."""
    units = rows.where("kind = 'fact'").select("file", user_units_per_pt(F.col("viewbox"), trim_width).alias("u"))
    e = rows.where("kind = 'element'").join(units, "file")
    # red from 96, green from 48 or blue from 144 on alone make L more than 15, so most colours need no formula
    low = lambda c: (F.substring(F.upper(c), 2, 2) <= "5F") & (F.substring(F.upper(c), 4, 2) <= "2F") & (F.substring(F.upper(c), 6, 2) <= "8F")
    black = lambda c: low(c) & (delta_e76(c, F.lit("#000000")) <= 15)
    size = lambda c, default: F.when(F.col(c).isNull(), F.lit(default) / F.col("u")).otherwise(F.coalesce(parse_length_pt(F.col(c), F.col("u")),
        F.lit(0.0)))
    stroke = e.where(F.col("element").isin(*STROKED) & black(F.col("stroke"))).select("file", "ord", "element", F.lit("stroke").alias("kind"),
        F.col("stroke").alias("color_hex"), size("stroke_width", 1.0).alias("size_pt"), F.lit(min_stroke).alias("limit"),
            F.format_string("%s, line %s, width %s", "element", "stroke", F.coalesce("stroke_width", F.lit("not given"))).alias("sample"))
    fill = F.coalesce("fill", F.lit("#000000"))
    shown = F.coalesce(F.substring("text", 1, 24), F.lit(""))
    text = e.where((F.col("element") == "text") & black(fill)).select("file", "ord", "element", F.lit("text").alias("kind"), fill.alias("color_hex"),
        size("font_size", 16.0).alias("size_pt"), F.lit(min_text).alias("limit"),
            F.format_string("text %s, size %s: %s", fill, F.coalesce("font_size", F.lit("not given")), shown).alias("sample"))
    hits = stroke.unionByName(text).where((F.col("size_pt") > 0) & (F.col("size_pt") <= F.col("limit"))).drop("limit")
    return cut(hits, "fine")  # few, and read more than once


def force_k_report(files: DataFrame, hits: DataFrame, limit: int = 10) -> DataFrame:
    """Counts and the first samples in document order of every file."""
    counts = hits.groupBy("file").agg(F.sum((F.col("kind") == "stroke").cast("int")).alias("s"), F.sum((F.col("kind") == "text").cast("int")).alias("t"))
    kth = F.row_number().over(W.partitionBy("file").orderBy("ord"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", "sample"))), lambda x: x["sample"])
    first = hits.withColumn("k", kth).where(F.col("k") <= limit).groupBy("file").agg(listed.alias("samples"))
    zero = lambda c, n: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(n)
    return files.select("file").join(counts, "file", "left").join(first, "file", "left").select("file", zero("s", "stroke_count"),
        zero("t", "text_count"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


# --- pixels ------------------------------------------------------------------------------------------------------------


def tac_report(pixels: DataFrame, threshold: float = 320.0) -> DataFrame:
    """Pixels (page, c, m, ye, k in 0..255). A histogram of at most 1,021 sums a page comes first, so what moves does
    not grow with the pixels; the percentile on it is exact."""
    h = pixels.groupBy("page", (F.col("c") + F.col("m") + F.col("ye") + F.col("k")).cast("long").alias("s")).agg(F.count("*").alias("n"))
    ink = F.col("s") * 100.0 / 255.0
    out = h.groupBy("page").agg(F.max(ink).alias("max_pct"), (F.sum(F.col("s") * F.col("n")) * 100.0 / 255.0 / F.sum("n")).alias("mean_pct"),
        (F.expr("percentile(s, 0.99, n)") * 100.0 / 255.0).alias("p99_pct"),
            (F.sum(F.when(ink >= threshold, F.col("n")).otherwise(0)) / F.sum("n")).alias("violation_fraction"))
    return out.withColumn("status", F.when(F.col("violation_fraction") <= 0, "ok").when(F.col("violation_fraction") < 0.001, "warn").otherwise("fail"))


def trimmed(x: Column) -> Column:
    """A number with at most four decimals."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.4f", x), "0+$", ""), r"\.$", "")


def content_bbox(pages: DataFrame, pixels: DataFrame, padding_pt: float = 0.0) -> DataFrame:
    """Pages (page, vx, vy, vw, vh, px_w, px_h), pixels (page, x, y, alpha): the box of what is visible, in user units."""
    box = pixels.where("alpha > 0").groupBy("page").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"),
        (F.max("y") + 1).alias("y1"))
    pad = padding_pt * 96 / 72
    sx, sy = F.col("vw") / F.col("px_w"), F.col("vh") / F.col("px_h")
    x, y = F.col("vx") + F.col("x0") * sx - pad, F.col("vy") + F.col("y0") * sy - pad
    w, h = (F.col("x1") - F.col("x0")) * sx + 2 * pad, (F.col("y1") - F.col("y0")) * sy + 2 * pad
    had = F.col("x0").isNotNull()
    return pages.join(box, "page", "left").select("page", had.alias("had_content"),
        F.when(had, F.concat_ws(" ", *map(trimmed, (x, y, w, h)))).alias("viewbox"), F.when(had, w / 96).alias("width_in"),
            F.when(had, h / 96).alias("height_in"))


def diff_mask(left: DataFrame, right: DataFrame, over: int = 96) -> DataFrame:
    """Pixels (page, x, y) whose largest channel difference is above ``over``; a pixel missing on one side is white there."""
    r = right.select("page", "x", "y", *(F.col(c).alias(f"{c}2") for c in "rgb"))
    white = F.lit(255)
    d = F.greatest(*(F.abs(F.coalesce(c, white) - F.coalesce(f"{c}2", white)) for c in "rgb"))
    return left.select("page", "x", "y", "r", "g", "b").join(r, ["page", "x", "y"], "full").where(d > over).select("page", "x", "y")


def eroded(mask: DataFrame, pages: DataFrame) -> DataFrame:
    """A pixel stays if all its neighbours inside the page are in the mask. pages: (page, px_w, px_h).

    Each pixel votes for its neighbours; votes are counted, which needs no self-join."""
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))
    votes = mask.withColumn("s", F.explode(steps)).groupBy("page", (F.col("x") + F.col("s.dx")).alias("x"),
        (F.col("y") + F.col("s.dy")).alias("y")).agg(F.count("*").alias("n"), F.max(((F.col("s.dx") == 0) & (F.col("s.dy") == 0)).cast("int")).alias("own"))
    inside = lambda p, size: F.lit(3) - (p == 0).cast("int") - (p == F.col(size) - 1).cast("int")
    return votes.where("own = 1").join(pages, "page").where(F.col("n") == inside(F.col("x"), "px_w") * inside(F.col("y"), "px_h")).select("page", "x", "y")


def blob_strips(mask: DataFrame, tile: int) -> DataFrame:
    """Horizontal runs of a mask, cut where tiles end: (page, tx, ty, y, x0, x1), x1 excluded. Far fewer rows than pixels."""
    w = W.partitionBy("page", "y", "tx").orderBy("x")
    placed = mask.withColumn("tx", F.floor(F.col("x") / tile).cast("int")).withColumn("run", F.col("x") - F.row_number().over(w))
    return placed.groupBy("page", "y", "tx", "run").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).select(
        F.col("page").cast("string").alias("page"), "tx", F.floor(F.col("y") / tile).cast("int").alias("ty"), F.col("y").cast("int").alias("y"),
        F.col("x0").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1"))


PART = "page string, id long, seam boolean, tx int, x0 int, y0 int, x1 int, y1 int, area long"


def tile_parts(strips: DataFrame, tile: int) -> DataFrame:
    """Blobs inside each tile, and their runs on the tile's edges (seam). A blob's id is the place of its first pixel, so it is
    one of a kind in its page. A tile has at most tile * tile / 2 runs, whatever the page's size."""
    ship(strips.sparkSession)
    kinds = [pa.string(), pa.int64(), pa.bool_(), *[pa.int32()] * 5, pa.int64()]
    names = [c.split()[0] for c in PART.split(", ")]

    def of(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("y", "x0", "x1")), strict=True))
        page, tx = group.column("page")[0].as_py(), group.column("tx")[0].as_py()
        root = list(range(len(rows)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        line: dict[int, list[int]] = {}
        for i, (y, x0, x1) in enumerate(rows):
            for j in line.get(y - 1, ()):
                if rows[j][1] < x1 and x0 < rows[j][2]:
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
            line.setdefault(y, []).append(i)
        blobs: dict[int, list[int]] = {}
        out = []
        for i, (y, x0, x1) in enumerate(rows):
            k = find(i)
            first = rows[k][0] << 32 | rows[k][1]
            box = blobs.setdefault(first, [x0, y, x1, y + 1, 0])
            box[:] = min(box[0], x0), min(box[1], y), max(box[2], x1), max(box[3], y + 1), box[4] + x1 - x0
            if y % tile in (0, tile - 1) or x0 % tile == 0 or x1 % tile == 0:
                out.append((page, first, True, tx, x0, y, x1, y + 1, x1 - x0))
        out += [(page, first, False, tx, *box) for first, box in blobs.items()]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, zip(*out, strict=True), kinds, strict=True)})

    return strips.groupBy("page", "ty", "tx").applyInArrow(of, PART)


def seam_edges(parts: DataFrame, tile: int) -> DataFrame:
    """(page, a, b): blobs of neighbouring tiles that touch: one run below another, or one that goes on in the next tile."""
    runs = parts.where("seam").select("page", "id", "tx", "x0", "x1", "y0")
    up = runs.where(F.col("y0") % tile == tile - 1).select("page", "tx", (F.col("y0") + 1).alias("y0"), F.col("id").alias("a"), F.col("x0").alias("u0"),
        F.col("x1").alias("u1"))
    below = up.join(runs.where(F.col("y0") % tile == 0), ["page", "tx", "y0"]).where("u0 < x1 and x0 < u1").select("page", "a", F.col("id").alias("b"))
    left = runs.where(F.col("x1") % tile == 0).select("page", "y0", F.col("x1").alias("x0"), F.col("id").alias("a"))
    return below.unionByName(left.join(runs.where(F.col("x0") % tile == 0), ["page", "y0", "x0"]).select("page", "a", F.col("id").alias("b")))


def diff_regions(mask: DataFrame, least: int = 16, most: int | None = 6, tile: int = 256) -> DataFrame:
    """4-connected blobs of at least ``least`` pixels, the largest ``most`` of a page (a report; None for all).

    Blobs are found inside tiles of ``tile`` by ``tile`` pixels, which are tasks' groups however large a page is; those that
    touch across a seam are edges of a graph whose components are the page's blobs."""
    parts = cut(tile_parts(blob_strips(mask, tile), tile), "parts")
    roots = components(seam_edges(parts, tile), "page").withColumnRenamed("a", "id")
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("area").alias("area")]
    whole = parts.where("not seam").join(roots, ["page", "id"], "left").groupBy("page", F.coalesce("root", "id").alias("root")).agg(*box)
    regions = whole.where(F.col("area") >= least).drop("root")
    if most is None:
        return regions
    k = F.row_number().over(W.partitionBy("page").orderBy(F.desc("area"), "y0", "x0", "x1", "y1"))
    return regions.withColumn("k", k).where(F.col("k") <= most).drop("k")


def render_summary(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """Centres in whole percent of the page, each once, and the number of regions."""
    centre = lambda lo, hi, size: F.rint((F.col(lo) + F.col(hi)) / 2 / F.col(size) * 100).cast("int")
    j = regions.join(pages.withColumn("page", F.col("page").cast("string")), "page").select("page",
        F.struct(centre("x0", "x1", "px_w").alias("x"), centre("y0", "y1", "px_h").alias("y")).alias("at"))
    return j.groupBy("page").agg(F.count("*").alias("regions"), F.array_sort(F.collect_set("at")).alias("spots"))


# --- pages and names ---------------------------------------------------------------------------------------------------


def page_geometry(facts: DataFrame, trim_w: float, trim_h: float, bleed: float, safety: float, dpi: float) -> DataFrame:
    """Facts (file, viewbox, aspect): page and natural size in inches, guide boxes in pixels."""
    box = viewbox(F.col("viewbox"))
    vw, vh, longest = F.get(box, F.lit(2)), F.get(box, F.lit(3)), max(trim_w, trim_h)
    fine = (vw > 0) & (vh > 0)
    full_w = F.when(fine & (vw >= vh), F.lit(longest)).when(fine, longest * vw / vh).otherwise(F.lit(trim_w))
    full_h = F.when(fine & (vw >= vh), longest * vh / vw).when(fine, F.lit(longest)).otherwise(F.lit(trim_h))
    aspect = F.coalesce(F.trim("aspect"), F.lit(""))
    page_w, page_h = trim_w + 2 * bleed, trim_h + 2 * bleed
    px = lambda v: int(round(v * dpi))  # noqa: E731  half-even
    rect = lambda m: F.struct(F.lit(px(m)).alias("x0"), F.lit(px(m)).alias("y0"), F.lit(px(page_w - m)).alias("x1"),
        F.lit(px(page_h - m)).alias("y1"))
    kind = "struct<x0:int,y0:int,x1:int,y1:int>"
    inner = bleed + safety
    fits = 2 * inner < page_w and 2 * inner < page_h
    return facts.select(
        "file", F.lit(f"{page_w}in").alias("width"), F.lit(f"{page_h}in").alias("height"),
            F.when(aspect.isin("") | (F.lower(aspect) == "none"), "xMidYMid meet").otherwise(F.col("aspect")).alias("aspect"),
        full_w.alias("full_w_in"), full_h.alias("full_h_in"), rect(bleed).cast(kind).alias("trim_box"),
            (rect(0) if bleed > 0 else F.lit(None)).cast(kind).alias("bleed_box"),
                (rect(inner) if safety > 0 and fits else F.lit(None)).cast(kind).alias("safety_box"),
    )


#: Chapter and figure at the start of a name: two numbers with one of . - _ between them, and no letter or digit after.
PREFIX = r"^([0-9]+)[-._]([0-9]+)(?![\p{L}\p{N}])"
TOKENS = ("stem", "chapter", "figure", "description", "slug")


def slug_column(text: Column) -> Column:
    """Words of ASCII letters and digits in lower case, joined by single dashes; diacritics and all else are dropped."""

    @F.arrow_udf("string")
    def plain(texts: pa.Array) -> pa.Array:
        return pa.array([None if t.as_py() is None else "".join(c for c in unicodedata.normalize("NFKD",
            t.as_py()) if not unicodedata.combining(c)) for t in texts], pa.string())

    words = F.transform(F.split(F.lower(plain(text)), r"[\s_-]+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    return F.array_join(F.filter(words, lambda w: w != ""), "-")


def output_name(stems: DataFrame, template: str) -> DataFrame:
    """Stems (stem) -> stem, name, warning. A template that the stem cannot fill gives <stem>_CMYK and a warning; an
    empty one gives <stem>_CMYK, a blank one the stem."""
    stem = F.col("stem")
    has = stem.rlike(PREFIX)
    description = F.when(has, F.ltrim(F.regexp_replace(stem, PREFIX, ""), F.lit(" -_"))).otherwise(stem)
    fallback = F.concat(stem, F.lit("_CMYK"))
    none = F.lit(None).cast("string")
    if not template.strip():
        return stems.select("stem", (fallback if not template else stem).alias("name"), none.alias("warning"))
    used = set()

    def value(name: str, spec: str) -> Column:
        used.add(name)
        if name in ("chapter", "figure"):
            raw = F.regexp_extract(stem, PREFIX, 1 if name == "chapter" else 2)
            return F.format_string(f"%{spec}", raw.try_cast("long")) if spec else raw
        if name == "slug":
            s = slug_column(description)
            return F.when(s == "", slug_column(stem)).otherwise(s)
        return {"stem": stem, "description": description}[name]

    parts, unknown = [], None
    for text, name, spec in re.findall(r"([^{}]*)(?:\{(\w*)(?::(\w*))?\})?", template):
        if text:
            parts.append(F.lit(text))
        if name:
            if name not in TOKENS:
                unknown = unknown or name
            else:
                parts.append(value(name, spec))
    if unknown:
        return stems.select("stem", fallback.alias("name"), F.lit(f"the template has no value for {{{unknown}}}").alias("warning"))
    if used & {"chapter", "figure"}:
        return stems.select("stem", F.when(has, F.concat(*parts)).otherwise(fallback).alias("name"),
            F.when(~has, F.concat(F.lit("no chapter and figure in "), stem)).alias("warning"))
    return stems.select("stem", F.concat(*parts).alias("name"), none.alias("warning"))
