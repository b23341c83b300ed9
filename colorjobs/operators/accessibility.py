"""Colour-blind collapse of a library's colour pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from colorjobs.functions.colors import CB_TYPES, place_distance, simulate_cb, with_places
from colorjobs.functions.svg import recolored_by
from colorjobs.sources.shared import cut, tasks_for


def _colours(usage: DataFrame, block: int, tasks: int | None = None) -> DataFrame:
    """(file, hex, palette, own), distinct, a file's rows together. A set of colours is known by its size and two independent
    64-bit sums over its colours (palette); its colours in order go into blocks of at most ``block`` (own: which)."""
    of_file = W.partitionBy("file")
    sums = [F.bit_xor(h).over(of_file) for h in (F.xxhash64("hex"), F.xxhash64("hex", F.lit("again")))]
    palette = F.struct(F.count("*").over(of_file).alias("n"), *(x.alias(k) for x, k in zip(sums, "xy", strict=True))).alias("palette")
    own = F.floor((F.row_number().over(of_file.orderBy("hex")) - 1) / block).cast("int").alias("own")
    rows = usage.select("file", "hex").distinct()
    return (rows if tasks is None else rows.repartition(tasks, "file")).select("file", "hex", palette, own)


def _shared(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    sets = blocks.groupBy("palette", "own").agg(F.first("hexes").alias("hexes"))
    return blocks.where("own = 0").select("file", "palette"), sets.select("palette", "own", F.explode("hexes").alias("hex"))


def palettes(usage: DataFrame, block: int = 512) -> tuple[DataFrame, DataFrame]:
    """(file, palette) and (palette, own, hex): files with the same set of colours share a palette, whose colours are listed once.

    It is kept in blocks (see _colours), so no more of a file's colours are gathered, and equal sets have equal blocks."""
    return _shared(cut(_colours(usage, block).groupBy("file", "palette", "own").agg(F.collect_list("hex").alias("hexes")), "palettes"))


def collapsed(items: Column, distinct: float, collapse: float) -> Column:
    """The pairs (cb, hex_a, hex_b, de_orig, de_sim) of an array of (hex, place) that collapse, as an array."""

    def pair(x: Column, y: Column) -> Column:
        seen = F.array(*(F.struct(F.lit(k).alias("cb"), place_distance(x["place"], y["place"], f"_{k}").alias("de_sim")) for k in CB_TYPES))
        return F.transform(F.filter(seen, lambda e: e["de_sim"] < collapse), lambda e: F.struct(e["cb"].alias("cb"), x["hex"].alias("hex_a"),
            y["hex"].alias("hex_b"), place_distance(x["place"], y["place"]).alias("de_orig"), e["de_sim"].alias("de_sim")))

    def of(x: Column) -> Column:
        far = F.filter(items, lambda y: (x["hex"] < y["hex"]) & (place_distance(x["place"], y["place"]) >= distinct))
        return F.flatten(F.transform(far, lambda y: pair(x, y)))

    return F.flatten(F.transform(items, of))


def judged(usage: DataFrame, severity: float, distinct: float, collapse: float, block: int, small: int, tasks: int | None,
        kept: Callable[[Column], Column] = lambda found: found) -> DataFrame:
    """(file, palette, own, hexes, found), once a file and block, written.

    A file of at most ``small`` colours is judged in the task that gathers it: found is what ``kept`` makes of its pairs, and
    palette and hexes are null. Of other files the blocks are kept. So a colour of a small file moves once more than its usage
    does, and as a name. Rows with places are the widest: ``tasks`` bounds how many of them a task holds."""
    few = F.col("palette.n") <= small
    rows = _colours(usage, block, tasks).select("file", "palette", "own", F.col("hex").alias("name"), F.when(few, F.col("hex")).alias("hex"))
    items = with_places(rows, severity).groupBy("file", "palette", "own").agg(F.collect_list(F.struct(F.col("name").alias("hex"), "place")).alias("items"))
    found = kept(F.when(few & F.col("file").isNotNull(), collapsed(F.col("items"), distinct, collapse)))
    return cut(items.select("file", F.when(~few, F.col("palette")).alias("palette"), "own", F.when(~few, F.col("items.hex")).alias("hexes"),
        found.alias("found")), "palettes")


def palette_pairs(sets: DataFrame, severity: float, distinct: float, collapse: float, block: int, tasks: int) -> DataFrame:
    """sets (palette, own, hex) -> (palette, cb, hex_a, hex_b, de_orig, de_sim).

    Blocks of a palette meet two by two, each also itself: a file of very many colours is many groups, and each of its colours
    is sent once for each block. Names of colours are all that moves; places are worked out where colours meet."""
    others = F.sequence(F.lit(0), (F.ceil(F.col("palette.n") / block) - 1).cast("int"))
    meets = F.transform(others, lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"), (k < F.col("own")).cast("int").alias("side")))
    rows = sets.select("palette", "hex", F.explode(meets).alias("m")).select("palette", "m.*", "hex").repartition(tasks, "palette", "i", "j")
    items = with_places(rows, severity).groupBy("palette", "i", "j").agg(F.collect_list(F.struct("side", "hex", "place")).alias("items"))
    two = items.select("palette", "i", "j", "items", F.explode("items").alias("x")).where("x.side = 0")
    two = two.select("palette", "i", "j", "x", F.explode("items").alias("y")).where("if(i < j, y.side = 1, x.hex < y.hex)")
    seen = [place_distance("x.place", "y.place", f"_{k}").alias(k) for k in CB_TYPES]
    far = two.select("palette", F.least("x.hex", "y.hex").alias("hex_a"), F.greatest("x.hex", "y.hex").alias("hex_b"),
        place_distance("x.place", "y.place").alias("de_orig"), *seen).where(F.col("de_orig") >= distinct)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("cb"), F.col(k).alias("de_sim")) for k in CB_TYPES)))
    return far.select("palette", "hex_a", "hex_b", "de_orig", each.alias("e")).select("palette", "e.cb", "hex_a", "hex_b", "de_orig",
        "e.de_sim").where(F.col("de_sim") < collapse)


def _large(rows: DataFrame, severity: float, distinct: float, collapse: float, block: int) -> tuple[DataFrame, DataFrame]:
    """judged() -> (file, palette) of the files that are not small, and the pairs of their palettes, each judged once."""
    blocks = rows.where("palette is not null")
    sent = blocks.select(F.sum(F.size("hexes") * F.ceil(F.col("palette.n") / block))).first()[0] or 0  # no fewer than palette_pairs sends
    files, sets = _shared(blocks)
    return files, palette_pairs(sets, severity, distinct, collapse, block, tasks_for(rows.sparkSession, int(sent), 250_000))


def cb_collapsed_pairs(usage: DataFrame, severity: float = 1.0, distinct: float = 25.0, collapse: float = 10.0, block: int = 512, small: int = 32,
        tasks: int | None = None) -> DataFrame:
    """(file, cb, hex_a, hex_b, de_orig, de_sim): pairs of a file's colours at least ``distinct`` apart that fall below
    ``collapse`` for a type of colour blindness.

    Files of at most ``small`` colours are judged where they lie. Larger ones that share a palette are judged once; only pairs
    that collapse go out to all of its files."""
    rows = judged(usage, severity, distinct, collapse, block, small, tasks)
    near = rows.where("palette is null").select("file", F.inline("found"))
    files, pairs = _large(rows, severity, distinct, collapse, block)
    return near.unionByName(files.where("file is not null").join(pairs, "palette").drop("palette"))


def cb_risk(usage: DataFrame, pairs: DataFrame | None = None, only_affected: bool = False, severity: float = 1.0, distinct: float = 25.0,
        collapse: float = 10.0, block: int = 512, small: int = 32, tasks: int | None = None) -> DataFrame:
    """One row a file with a flag for each type; clean files are there, unless only affected ones are asked for.

    Without ``pairs`` flags are all that is kept of a file of at most ``small`` colours, and all that a larger palette sends to
    its files; no pair moves."""
    flags = [F.bool_or(F.col("cb") == k).alias(k) for k in CB_TYPES]
    if pairs is not None:
        out = usage.select("file").distinct().join(pairs.groupBy("file").agg(*flags), "file", "inner" if only_affected else "left")
        return out.select("file", *(F.coalesce(k, F.lit(False)).alias(k) for k in CB_TYPES))
    rows = judged(usage, severity, distinct, collapse, block, small, tasks, lambda found: F.array_distinct(found["cb"]))
    near = rows.where("palette is null").select("file", *(F.array_contains("found", k).alias(k) for k in CB_TYPES))
    files, large = _large(rows, severity, distinct, collapse, block)
    far = files.join(large.groupBy("palette").agg(*flags), "palette", "left").drop("palette")
    out = near.unionByName(far).select("file", *((F.coalesce(k, F.lit(False)) & F.col("file").isNotNull()).alias(k) for k in CB_TYPES))
    return out.where(" or ".join(CB_TYPES)) if only_affected else out


def cb_mapping(colors: DataFrame, kind: str, severity: float = 1.0) -> DataFrame:
    """Hex -> as seen, identities left out."""
    return colors.select("hex").distinct().select("hex", simulate_cb(F.col("hex"), kind, severity).alias("target")).where("target != hex")


def cb_variants(svgs: DataFrame, usage: DataFrame, types=CB_TYPES, severity: float = 1.0) -> DataFrame:
    """(file, cb, content): one recoloured copy of a document for each type; content moves and is parsed once, the maps are small."""
    colours = usage.select("hex").where(F.col("hex").rlike(r"^#[0-9a-fA-F]{6}\z")).distinct()
    lines = colours.select("hex", F.concat_ws(" ", "hex", *(simulate_cb(F.col("hex"), k, severity) for k in types)).alias("line"))
    own = usage.select("file", "hex").join(lines, "hex").groupBy("file").agg(F.array_join(F.collect_list("line"), "\n").alias("lines"))  # a document's own colours
    done = svgs.select("file", "content").join(own, "file", "left").select("file", "content",
        recolored_by(F.col("content"), F.col("lines"), len(types)).alias("made"))
    copies = done.select("file", "content", F.posexplode(F.array(*map(F.lit, types))).alias("k", "cb"), "made")
    return copies.select("file", "cb", F.coalesce(F.get("made", F.col("k")), "content").alias("content"))
