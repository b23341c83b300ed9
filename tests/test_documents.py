import os

import pytest
from pyspark.sql import functions as F

from colorjobs.functions.svg import extract, recolored, rows_of
from colorjobs.operators import accessibility, mapping, palette, preflight, usage
from colorjobs.operators import batch
from colorjobs.plans import queries
from colorjobs.sources import shared, tables
from colorjobs.streaming import streams

NS = 'xmlns="http://www.w3.org/2000/svg"'
INLINE = f'<svg {NS}><rect fill="#E74C3C" stroke="#333"/><circle style="fill: rgb(46, 204, 113); stroke:#F00"/><text fill="cornflowerblue">x</text></svg>'
BLOCK = f"<svg {NS}><style><![CDATA[.bad{{fill:#E74C3C}} .good{{fill:rgb(46,204,113);stroke:cornflowerblue}}]]></style></svg>"
GRADIENT = f'<svg {NS}><stop stop-color="#ABCDEF"/><stop stop-color="rgb(0%, 50%, 100%)"/><rect fill="url(#g)" stroke="none"/></svg>'


def tokens(text):
    return [(r["hex"], r["context"]) for r in rows_of("f", text) if r["kind"] == "token"]


def test_extract():
    assert tokens(INLINE) == [("#E74C3C", "@fill"), ("#333333", "@stroke"), ("#2ECC71", "style.fill"), ("#FF0000", "style.stroke"), ("#6495ED", "@fill")]
    assert [h for h, _ in tokens(BLOCK)] == ["#E74C3C", "#2ECC71", "#6495ED"]
    assert [h for h, _ in tokens(GRADIENT)] == ["#ABCDEF", "#0080FF"]
    for bad in ("<svg><not-closed>", "", None):
        assert rows_of("f", bad)[0]["kind"] == "error"


def test_bad_file_does_not_stop_the_job(spark):
    df = spark.createDataFrame([("a", INLINE), ("b", "<svg><not-closed>"), ("c", None)], "file string, content string")
    facts = {r.file: r for r in usage.svg_facts(extract(df)).collect()}
    assert facts["a"].n_colors == 5 and facts["a"].has_text and facts["a"].parse_error is None
    assert facts["b"].parse_error and facts["c"].parse_error


def test_recolor_is_simultaneous(spark):
    df = spark.createDataFrame([(INLINE, {"#E74C3C": "#333333", "#333333": "#222222"}), ("<broken", {}), (BLOCK, None)], "content string, m map<string,string>")
    a, b, c = (r.r for r in df.select(recolored(F.col("content"), F.col("m")).alias("r")).collect())
    assert 'fill="#333333"' in a.content and 'stroke="#222222"' in a.content and a.replacements == 2
    assert dict(a.unmapped) == {"#2ECC71": 1, "#FF0000": 1, "#6495ED": 1}
    assert b.error and b.content is None
    assert c.replacements == 0 and sum(c.unmapped.values()) == 3


def test_fine_lines(spark):
    doc = f'<svg {NS} viewBox="0 0 100 100">{{}}</svg>'
    cases = {"thin": '<line stroke="#000" stroke-width="0.5"/>', "thick": '<line stroke="#000" stroke-width="2"/>',
        "red": '<line stroke="#F00" stroke-width="0.5"/>', "soft": '<line stroke="#1A1A1A" stroke-width="0.5"/>',
            "text": '<text font-size="10">t</text>', "bad": '<line stroke="#000" stroke-width="x"/>'}
    df = spark.createDataFrame([(k, doc.format(v)) for k, v in cases.items()], "file string, content string")
    hits = {r.file: round(r.size_pt, 2) for r in preflight.force_k_hits(extract(df), 1.0).collect()}
    assert hits == {"thin": 0.36, "soft": 0.36, "text": 7.2}


def test_names(spark):
    stems = spark.createDataFrame([("04.03 - Venn Diágram two",), ("v2 final",)], "stem string")
    out = [tuple(r) for r in preflight.output_name(stems, "c{chapter:03d}-{figure}-{slug}").collect()]
    assert out[0] == ("04.03 - Venn Diágram two", "c004-03-venn-diagram-two", None)
    assert out[1][1] == "v2 final_CMYK" and out[1][2]
    assert preflight.output_name(stems, "{nope}").first().warning and preflight.output_name(stems, "").first().name.endswith("_CMYK")


def test_regions(spark):
    pages = spark.createDataFrame([("p", 120, 120)], "page string, px_w int, px_h int")
    white = spark.range(120 * 120).select(F.lit("p").alias("page"), (F.col("id") % 120).cast("int").alias("x"),
        (F.col("id") / 120).cast("int").alias("y"), *(F.lit(255).alias(c) for c in "rgb"))
    block = (F.col("x").between(10, 29)) & (F.col("y").between(40, 59))
    line = F.col("y") == 100
    ink = white.select("page", "x", "y", *(F.when(block | line, 0).otherwise(255).alias(c) for c in "rgb"))
    found = preflight.diff_regions(preflight.eroded(preflight.diff_mask(white, ink), pages))
    assert [tuple(r) for r in found.collect()] == [("p", 11, 41, 29, 59, 324)]
    assert preflight.render_summary(found, pages).first().regions == 1


def test_kmeans_splits_two_clusters(spark):
    reds, blues = ["#FF0000", "#FA0505", "#F50A0A"], ["#0000FF", "#0505FA", "#0A0AF5"]
    df = spark.createDataFrame([(h,) for h in reds + blues + reds], "hex string")
    groups = {}
    for r in palette.kmeans_members(df, 2).collect():
        groups.setdefault(r.id, set()).add(r.hex)
    assert sorted(map(sorted, groups.values())) == sorted([sorted(reds), sorted(blues)])
    assert palette.kmeans_palette(df, 50).count() == 6 and palette.kmeans_palette(df.limit(0), 3).count() == 0


def test_colour_blind_pairs(spark):
    df = spark.createDataFrame([("a", "#E74C3C"), ("a", "#46AA3A"), ("b", "#0066CC"), ("b", "#FFCC00"), ("c", "#000000")],
        "file string, hex string").withColumn("n", F.lit(1))
    risk = {r.file: r for r in accessibility.cb_risk(df, accessibility.cb_collapsed_pairs(df)).collect()}
    assert (risk["a"].deutan or risk["a"].protan) and not (risk["b"].deutan or risk["b"].protan) and not risk["c"].tritan


def test_print_safety(spark):
    df = spark.createDataFrame([("f", "#FF0000", "#FAFAFA"), ("f", "#00FF00", "#FAFAFA"), ("f", "#0000FF", "#222222")],
        "file string, source string, target string")
    (w,) = mapping.print_safety(df).collect()
    assert w.sources == ["#00FF00", "#FF0000"] and "too light" in w.reason


def test_color_files_has_every_file(spark, tmp_path):
    row = "cast(id as int) as l_orderkey, 1 as l_linenumber, 7 as l_partkey, 1 as l_suppkey, 1.0d as l_extendedprice, 'O' as l_linestatus, 1.0d as l_quantity"
    spark.range(1200).selectExpr(*row.split(", ")).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = queries.QUERIES["color_files"](spark, str(tmp_path)).collect()
    assert len(out) == 1200 == len({r.file for r in out}) and len({r.hex for r in out}) == 1


def test_empty_tables(spark):
    u = spark.createDataFrame([], "file string, hex string, n long")
    g = spark.createDataFrame([], "pipeline string, source string, target string, label string, notes string, ord long")
    o = spark.createDataFrame([], "file string, pipeline string, source string, target string")
    assert mapping.suggest(u, g, o).count() == 0 and usage.hue_lightness_histogram(u).count() == 48 and mapping.nearest_color(u, g).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "B.SVG").write_text(INLINE)
    (tmp_path / "a.svg").write_text(BLOCK)
    (tmp_path / "x.txt").write_text("no")
    (tmp_path / "a.mapping.json").write_text('{"filename": "a.svg", "status": "odd", "overrides": {"#ff0000": "#111111"}, "cmyk_overrides": {}}')
    (tmp_path / "b.mapping.json").write_text("{broken")
    svgs = tables.read_svgs(spark, str(tmp_path))
    assert [r.file for r in tables.svg_names(svgs).collect()] == ["a.svg", "B.SVG"] and svgs.count() == 2
    ill, own = tables.read_mappings(spark, str(tmp_path))
    assert [(r.file, r.status) for r in ill.collect()] == [("a.svg", "pending")] and [tuple(r) for r in own.collect()] == [("a.svg", "grayscale",
        "#FF0000", "#111111")]
    tables.write_svgs(svgs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    (tmp_path / "config.json").write_text('{"global_color_map": {"#e74c3c": {"target": "#333333", "label": "bad"}, "#1": "no"}, "cmyk_device_overrides": {"#E74C3C": "0/85/85/0"}, "semantic_palette": {"slots": {"status.bad": {"authored": "#e74c3c"}}, "themes": {"print": {"cmyk": {"status.bad": "#d14b3c"}}}}}')
    maps = tables.read_color_maps(spark, str(tmp_path / "config.json"))
    assert [(r.source, r.target, r.label) for r in maps["global_map"].collect()] == [("#E74C3C", "#333333", "bad")]
    assert maps["slots"].first().authored == "#E74C3C" and maps["themes"].first().target == "#D14B3C" and maps["device_overrides"].count() == 1
    with pytest.raises(ValueError):
        tables.manifest(svgs, " ", "t")


def test_stream_keeps_the_newest(spark, tmp_path):
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    (folder / "a.svg").write_text(INLINE)
    streams.stream_usage(streams.stream_svgs(spark, str(folder)), out, check).awaitTermination()
    assert streams.current_usage(spark, out).count() == 5
    (folder / "b.svg").write_text(BLOCK)
    os.utime(folder / "b.svg", (2e9, 2e9))
    streams.stream_usage(streams.stream_svgs(spark, str(folder)), out, check).awaitTermination()
    assert streams.current_usage(spark, out).count() == 8


def test_repeated_sources_count_once(spark):
    """A source that occurs twice in a map, or in a file's overrides, neither doubles rows nor fails a rewrite."""
    u = spark.createDataFrame([("a", "#E74C3C", 3)], "file string, hex string, n long")
    rows = [("grayscale", "#E74C3C", t, "", "", n) for t, n in (("#111111", 1), ("#222222", 2))]
    g = spark.createDataFrame(rows, "pipeline string, source string, target string, label string, notes string, ord long")
    none = spark.createDataFrame([], "file string, pipeline string, source string, target string")
    twice = spark.createDataFrame([("a", "grayscale", "#E74C3C", t) for t in ("#333333", "#444444")], none.schema)
    assert [r.target for r in mapping.suggest(u, g, none).collect()] == ["#222222"]
    assert [r.target for r in mapping.suggest(u, g, twice).collect()] == ["#444444"]
    assert [r.target for r in mapping.merge_mappings(u, g, twice).collect()] == ["#444444"]
    assert [r.target for r in usage.palette_report(usage.batch_palette(u), g, "grayscale").collect()] == ["#222222"]
    svg = spark.createDataFrame([("a", INLINE)], "file string, content string")
    assert 'fill="#444444"' in batch.recolor_svgs(svg, twice.select("file", "source", "target")).first().content


def test_nearest_ties_and_blocks(spark):
    colors = spark.createDataFrame([("#808080",), ("#FF0000",), ("bad",), (None,)], "hex string")
    keys = spark.createDataFrame([("#828282", 2), ("#7E7E7E", 3), ("#FE0000", 1), ("#FF0001", 9), ("#828282", 5)], "source string, ord long")
    for block in (50_000, 1):
        out = {r.hex: (r.via, round(r.distance, 6)) for r in mapping.nearest_color(colors, keys, "rgb", block).collect()}
        assert out == {"#808080": ("#828282", 3.464102), "#FF0000": ("#FE0000", 1.0)}, block
    with pytest.raises(ValueError):
        mapping.nearest_color(colors, keys, "xyz")


def test_kmeans_seeds_empty_clusters(spark):
    """More clusters than there are distinct places: seeds go on in hash order until every cluster that can live does."""
    near = [f"#0000{i:02X}" for i in range(200, 206)]
    df = spark.createDataFrame([(h,) for h in ["#FFFFFF", *near]], "hex string")
    out = palette.kmeans_palette(df, 5).collect()
    assert sum(r.n_members for r in out) == 7 and len(out) <= 5 and {r.id for r in out} == {f"p_{i + 1:03d}" for i in range(len(out))}
    members = {r.hex: r.id for r in palette.kmeans_members(df.repartition(5), 5).collect()}
    assert members == {r.hex: r.id for r in palette.kmeans_members(df.coalesce(1), 5).collect()}


def test_device_overrides_both_ways(spark, tmp_path):
    text = '{"filename": "a.svg", "status": "reviewed", "cmyk_device_overrides": {"#e74c3c": "0/85/85/0", "red": [1, 2, 3, 4], "#00F": {"c": 9, "K": 1.5}, "none": "0/0/0/0", "#111111": "0/0/0/101"}}'
    (tmp_path / "a.mapping.json").write_text(text)
    found = tables.read_device_overrides(spark, str(tmp_path))
    got = {r.source: tuple(r.cmyk) for r in found.collect()}
    assert got == {"#E74C3C": (0, 85, 85, 0), "#FF0000": (1, 2, 3, 4), "#0000FF": (9, 0, 0, 1.5)}
    ill, own = tables.read_mappings(spark, str(tmp_path))
    again = tables.mapping_documents(ill, own, "t", found).select(F.col("document").alias("value"))
    assert {r.source: tuple(r.cmyk) for r in tables.parse_device_overrides(again).collect()} == got


def test_scratch_tables_go(spark):
    import os
    from urllib.parse import urlparse

    at = lambda t: urlparse(t._cut_at).path
    with shared.scratch(spark):
        a, b = shared.cut(spark.range(3)), shared.keep(shared.cut(spark.range(4)))
        assert os.path.exists(at(a)) and b.count() == 4
    assert not os.path.exists(at(a)) and b.count() == 4
    shared.drop(b, spark.range(1))
    assert not os.path.exists(at(b))
