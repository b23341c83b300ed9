"""Work that once met in one task: numbering, regions of large pages; and maps that hold both pipelines."""

import random

import pytest
from pyspark.sql import functions as F

from colorjobs.operators import accessibility, mapping, preflight, usage
from colorjobs.operators.components import components
from colorjobs.operators.ranking import ranked


def test_ranked(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(7)
    assert [(r.k, r.nth) for r in ranked(rows, F.col("k").asc()).orderBy("k").collect()] == [(k, n + 1) for n, k in enumerate(sorted(i * 7919 % 5003 for i in range(5000)))]
    assert ranked(rows.limit(0), F.col("k").asc()).count() == 0


def tables(spark, n, used=()):
    g = spark.range(n).select(F.lit("grayscale").alias("pipeline"), F.format_string("#%06X", "id").alias("source"), F.lit("#111111").alias("target"),
        F.lit("").alias("label"), F.lit("").alias("notes"), (F.lit(n) - F.col("id")).alias("ord"))
    slots = spark.createDataFrame([(name, f"#F{i:05X}", "", "", i) for i, name in enumerate(used)], "name string, authored string, label string, notes string, ord long")
    return slots, g


def test_auto_migrate_takes_free_numbers(spark):
    slots, g = tables(spark, 6, ("auto.001", "auto.003", "auto.3", "auto.0004", "auto.000", "mine", "auto.006", "auto.999", "auto.99999999999999999999"))
    new, themes = mapping.auto_migrate(slots, g, "grayscale")
    assert [(r.name, r.authored) for r in new.orderBy("ord").collect()] == [(f"auto.{i:03d}", f"#{5 - k:06X}") for k, i in enumerate((2, 4, 5, 7, 8, 9))]
    assert themes.count() == 6
    again, _ = mapping.auto_migrate(slots.unionByName(new.select("name", "authored", "label", "notes", "ord")), g, "grayscale")
    assert again.count() == 0


def test_auto_migrate_large(spark):
    """Once quadratic: 8,000 sources took 47 seconds."""
    slots, g = tables(spark, 100_000, [f"auto.{i:03d}" for i in range(1, 3000, 2)])
    new, _ = mapping.auto_migrate(slots, g, "grayscale")
    got = new.agg(F.count("*").alias("n"), F.count_distinct("name").alias("d"), F.max(F.substring("name", 6, 9).cast("long")).alias("m")).first()
    assert tuple(got) == (100_000, 100_000, 101_500)


def flood(cells):
    out, left = [], set(cells)
    while left:
        todo, blob = [left.pop()], []
        while todo:
            x, y = todo.pop()
            blob.append((x, y))
            for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        xs, ys = [p[0] for p in blob], [p[1] for p in blob]
        out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(blob)))
    return sorted(out)


@pytest.mark.parametrize("tile", [2, 5, 16, 256])
def test_regions_in_tiles(spark, tile):
    r = random.Random(3)
    pages = {f"p{d}": {(x, y) for x in range(40) for y in range(30) if r.random() < d / 10} for d in (3, 5, 6, 9)}
    pages["snake"] = {(x, y) for x in range(40) for y in range(30) if y % 2 == 0 or x == (39 if y % 4 == 1 else 0)}
    mask = spark.createDataFrame([(p, x, y) for p, cells in pages.items() for x, y in cells], "page string, x int, y int").repartition(3)
    got = {}
    for row in preflight.diff_regions(mask, least=1, most=None, tile=tile).collect():
        got.setdefault(row.page, []).append((row.x0, row.y0, row.x1, row.y1, row.area))
    assert {p: sorted(b) for p, b in got.items()} == {p: flood(cells) for p, cells in pages.items()}
    assert preflight.diff_regions(mask.limit(0), least=1, tile=tile).count() == 0


def test_one_page_is_many_groups(spark):
    mask = spark.range(64 * 64).select(F.lit("p").alias("page"), (F.col("id") % 64).cast("int").alias("x"), F.floor(F.col("id") / 64).cast("int").alias("y"))
    assert preflight.blob_strips(mask, 16).select("page", "tx", "ty").distinct().count() == 16
    assert [tuple(r) for r in preflight.diff_regions(mask, tile=16).select("x0", "y0", "x1", "y1", "area").collect()] == [(0, 0, 64, 64, 4096)]


def test_components(spark):
    chain = [("s", i, i + 1) for i in range(300)] + [("s", 1000 + i, 1000) for i in range(200)] + [("t", 5, 3), ("t", 3, 5), ("t", 7, 7)]
    r = random.Random(1)
    r.shuffle(chain)
    got = {(x.scope, x.a): x.root for x in components(spark.createDataFrame(chain, "scope string, a long, b long"), "scope").collect()}
    assert got == {("s", i): 0 for i in range(1, 301)} | {("s", 1000 + i): 1000 for i in range(1, 200)} | {("t", 5): 3}


def test_pipelines_stay_apart(spark):
    """A map as read_color_maps gives it holds both pipelines; repeated sources and other spellings count once."""
    kind = "pipeline string, source string, target string, label string, notes string, ord long"
    g = spark.createDataFrame([("grayscale", "#AA0000", "#111111", "", "", 1), ("grayscale", "#AA0000", "#222222", "", "", 2), ("cmyk", "#AA0000", "#EE0000", "", "", 3),
        ("cmyk", "#BB0000", "#CC0000", "", "", 4)], kind)
    u = spark.createDataFrame([("a", "#AA0000", 1), ("a", "#BB0000", 2)], "file string, hex string, n long")
    o = spark.createDataFrame([("a", "cmyk", "#BB0000", "#00FF00")], "file string, pipeline string, source string, target string")
    got = lambda df: {(r.hex, r.target, r.kind) for r in df.collect()}
    assert got(mapping.suggest(u, g, o, nearest=False)) == {("#AA0000", "#222222", "exact"), ("#BB0000", None, "none")}
    assert got(mapping.suggest(u, g, o, nearest=False, pipeline="cmyk")) == {("#AA0000", "#EE0000", "exact"), ("#BB0000", "#00FF00", "exact")}
    merged = lambda p: {(r.source, r.target) for r in mapping.merge_mappings(u, g, o, p).collect()}
    assert merged("grayscale") == {("#AA0000", "#222222")} and merged("cmyk") == {("#AA0000", "#EE0000"), ("#BB0000", "#00FF00")}
    picks = spark.createDataFrame([("a", "#AA0000", "#EE0000"), ("b", "#AA0000", "#222222"), ("c", "#AA0000", "#AA0000")], "file string, source string, target string")
    assert [r.file for r in mapping.persistable_overrides(picks, g).collect()] == ["a"]
    assert [r.file for r in mapping.persistable_overrides(picks, g, "cmyk").collect()] == ["b"]
    report = lambda p: {(r.hex, r.target, r.unchanged) for r in usage.palette_report(usage.batch_palette(u), g, p).collect()}
    assert report("cmyk") == {("#AA0000", "#EE0000", False), ("#BB0000", "#CC0000", False)}
    assert report("grayscale") == {("#AA0000", "#222222", False), ("#BB0000", "#BB0000", True)}
    swatches = spark.createDataFrame([("p_1", "#EE0000", ["#AA0000", "#BB0000", "#BB0000"])], "id string, source_hex string, members array<string>")
    assert tuple(mapping.replace_preflight(g.unionByName(g), o.unionByName(o), swatches).first()) == ("p_1", 1, 1, 1)


def test_device_spellings(spark):
    quad = lambda c: (float(c), 0.0, 0.0, 0.0)
    kind = "source string, cmyk struct<c:double,m:double,y:double,k:double>"
    files = spark.createDataFrame([("a", "#000000"), ("b", "#000000"), ("b", "#FFFFFF")], "file string, hex string")
    g = spark.createDataFrame([("#000", quad(1), 2), ("#000000", quad(9), 1), ("nothing", quad(3), 3)], f"{kind}, ord long")
    own = spark.createDataFrame([("b", "#000", quad(5)), ("b", "#000000", quad(4)), ("b", "black", quad(6))], f"file string, {kind}")
    got = sorted((r.file, r.source, r.cmyk.c) for r in mapping.device_merge(g, own, files).collect())
    assert got == [("a", "#000000", 1.0), ("b", "#000000", 6.0)]


def plain_pairs(spark, colours):
    """Every pair of some colours, judged one by one."""
    from colorjobs.functions.colors import CB_TYPES, delta_e76, simulate_cb

    df = spark.createDataFrame([(a, b) for a in colours for b in colours if a < b], "a string, b string")
    seen = [F.struct(F.lit(k).alias("cb"), delta_e76(simulate_cb(F.col("a"), k), simulate_cb(F.col("b"), k)).alias("d")) for k in CB_TYPES]
    rows = df.withColumn("o", delta_e76(F.col("a"), F.col("b"))).where("o >= 25").select("a", "b", F.explode(F.array(*seen)).alias("e")).where("e.d < 10")
    return {(r.cb, r.a, r.b) for r in rows.select("e.cb", "a", "b").collect()}


@pytest.mark.parametrize("block", [7, 512])
def test_collapsed_pairs_in_blocks(spark, block):
    """A palette of many blocks, palettes that files share, and one that differs from another by a colour."""
    r = random.Random(2)
    large = [f"#{r.randrange(1 << 24):06X}" for _ in range(90)]
    sets = {"a": large, "b": large, "c": large[:-1], "d": ["#FF0000", "#808000"], "e": ["#808000", "#FF0000"], "f": ["#000000"]}
    usage_ = spark.createDataFrame([(f, h, 1) for f, hs in sets.items() for h in hs for _ in range(2)], "file string, hex string, n long")
    files, distinct = accessibility.palettes(usage_)
    assert files.select("palette").distinct().count() == 4 and distinct.count() == 90 + 89 + 2 + 1
    got = {}
    for x in accessibility.cb_collapsed_pairs(usage_, block=block).collect():
        assert (x.cb, x.hex_a, x.hex_b) not in got.setdefault(x.file, set())
        got[x.file].add((x.cb, x.hex_a, x.hex_b))
    for f, hs in sets.items():
        assert got.get(f, set()) == plain_pairs(spark, sorted(set(hs))), f


def test_risk_of_small_and_large_files(spark):
    """Flags of files judged where they lie and of files whose palettes meet in blocks; a usage without a file has none."""
    from colorjobs.functions.colors import CB_TYPES

    r = random.Random(3)
    large = [f"#{r.randrange(1 << 24):06X}" for _ in range(20)]
    sets = {"a": large, "b": large, "c": large[:5], "d": ["#E74C3C", "#46AA3A"], "e": ["#46AA3A", "#E74C3C"], "f": ["#000000"], "g": ["none", "#0066CC", "#FFCC00"]}
    rows = [(f, h) for f, hs in sets.items() for h in hs for _ in range(2)] + [(None, "#E74C3C"), (None, "#46AA3A"), ("d", None)]
    usage_ = spark.createDataFrame(rows, "file string, hex string")
    pairs = plain_pairs(spark, sorted({h for hs in sets.values() for h in hs} - {"none"}))
    want = {f: {k for k, a, b in pairs if a in hs and b in hs} for f, hs in sets.items()} | {None: set()}
    assert want["a"] and want["d"] and not want["g"]
    for small in (1, 4):
        got = accessibility.cb_risk(usage_, block=7, small=small, tasks=3).collect()
        assert len(got) == len(want) and {x.file: {k for k in CB_TYPES if x[k]} for x in got} == want
    got = accessibility.cb_collapsed_pairs(usage_, block=7, small=4).collect()
    assert {(x.file, x.cb, x.hex_a, x.hex_b) for x in got} == {(f, k, a, b) for f, hs in sets.items() for k, a, b in pairs if a in hs and b in hs}


def test_risk_moves_no_pairs(spark):
    """Flags of small files are made in the task that gathers a file, in as many tasks as are asked for; no exchange follows."""
    u = spark.range(40).select(F.format_string("f%d", F.expr("id div 4")).alias("file"), F.format_string("#%06X", F.col("id") * 99991).alias("hex"))
    rows = accessibility.judged(u, 1.0, 25.0, 10.0, 512, 32, 9)
    assert rows.count() == rows.where("palette is null and hexes is null and found is not null").count() == 10
    assert accessibility._colours(u, 512, 9).rdd.getNumPartitions() == 9
    plan = accessibility.cb_risk(u)._jdf.queryExecution().executedPlan().toString().split("\n")
    assert len([n for n in plan if "Exchange hashpartitioning" in n]) <= 3  # all of them of larger files: blocks, their meetings, flags


def test_sql_normalize(spark):
    from colorjobs.functions import color_sql
    from colorjobs.functions.colors import normalize_hex

    color_sql.register(spark)
    values = [" #abc ", "#ABCD", "#12345678", "#12345", "#1234567", "rgb(0%, 50%,100%)", "RGBA(1,2,3,.5)", "rgb(300,-5,2.5)", "rgb(1.5,2.5,3.5)", "rgb(123)", "Navy",
        "none", "currentColor", "URL(#x)", "", "  ", None, "hsl(1,2,3)", "nosuch", "inherit"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select("v", F.expr("cj_normalize(v)").alias("a"), normalize_hex(F.col("v")).alias("b")).collect()
    assert [(r.v, r.a) for r in rows] == [(r.v, r.b) for r in rows]
    bad = spark.createDataFrame([("x", "<svg")], "file string, content string")
    assert spark.sql("SELECT * FROM {bad}, LATERAL cj_tokens(content)", bad=bad).count() == 0


def test_places_of_rows(spark):
    """Places in plain columns are the places of the formulas, to the last bit, and colours meet without an exchange for places."""
    from colorjobs.functions.colors import CB_TYPES, channels, lab_of_rgb, simulate_rgb, with_places

    r = random.Random(5)
    rows = [(f"#{r.randrange(1 << 24):06X}",) for _ in range(300)] + [("#000000",), ("#FFFFFF",), ("#0a0B0c",), ("none",), (None,)]
    df = with_places(spark.createDataFrame(rows, "hex string"), 0.7)
    rgb = F.array(*channels(F.col("hex")))
    want = F.struct(lab_of_rgb(rgb), *(lab_of_rgb(simulate_rgb(rgb, k, 0.7)) for k in CB_TYPES))
    for x in df.select("hex", "place", want.alias("want")).collect():
        if x.hex and x.hex[0] == "#":
            assert tuple(x.place) == tuple(v for lab in x.want for v in lab), x.hex
    u = spark.range(40).select(F.format_string("f%d", F.expr("id div 4")).alias("file"), F.format_string("#%06X", F.col("id") * 99991).alias("hex"))
    pairs = accessibility.cb_collapsed_pairs(u)
    for df, most in ((pairs, 4), (accessibility.cb_risk(u, pairs), 6)):  # 6 and 8 when colours met their places, then each other
        plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
        assert len([n for n in plan if "Exchange hashpartitioning" in n]) <= most
