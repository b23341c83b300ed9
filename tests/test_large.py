"""What must not grow faster than the input: shapes of plans, and results beside them."""

from pyspark.sql import functions as F

from colorjobs.functions import colors as C
from colorjobs.functions.svg import extract, recolor, recolored_each
from colorjobs.operators import mapping, usage
from colorjobs.sources import shared


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_arrays_of_keys_never_move_with_the_colours(spark, monkeypatch):
    """A colour and the array of keys around it are not exchanged together."""
    plans, real = {}, mapping.cut
    monkeypatch.setattr(mapping, "cut", lambda df, what="cut": (plans.__setitem__(what, plan_of(df)), real(df, what))[1])
    keys = spark.range(4000).select(F.format_string("#%06X", F.col("id") * 4099).alias("source"), F.col("id").alias("ord"))
    colours = keys.select(F.col("source").alias("hex"))
    got = mapping.nearest_color(colours, keys)
    assert got.where("hex = via and distance = 0").count() == 4000
    assert "Repartition" not in plans["near"]


def test_quads_are_parsed_once(spark):
    """what parsing and labelling say of a text does not grow with each use of it."""
    rows = spark.createDataFrame([("1/2/0.5/7",), ('{"x": 1, "M": 2}',), ("[1, 2]",), (None,), ('"4, 5/6,7"',), ("1/2/3/101",)], "t string")
    label = C.let(C.parse_cmyk(F.col("t")), lambda q: F.when(q.isNotNull(), C.cmyk_label(q)))
    df = rows.select(label.alias("label"))
    assert [r.label for r in df.collect()] == ["1/2/0.5/7", "0/2/0/0", None, None, "4/5/6/7", None]
    plain = rows.select(C.cmyk_label(C.parse_cmyk(F.col("t"))))
    assert plan_of(plain).count("from_json") <= 4


def test_only_what_is_asked_for_is_extracted(spark):
    """Kinds that nobody reads are neither made nor sent, and the rest is the same."""
    text = '<svg viewBox="0 0 1 1"><rect fill="red" style="stroke: #ABC; x: y"/><line stroke="#00f" stroke-width="2"/><text>a</text></svg>'
    svgs = spark.createDataFrame([("a", text), ("b", "<svg"), ("c", None)], "file string, content string")
    order = lambda rows: sorted(map(str, rows))
    everything = extract(svgs).collect()
    for kinds in (("token",), ("element", "fact"), ("token", "fact", "error")):
        assert order(extract(svgs, kinds).collect()) == order(r for r in everything if r.kind in kinds)
    assert [r.ord for r in everything if r.kind == "element"] == [3, 4, 5]


def test_several_mappings_take_one_parse(spark):
    """each copy is of the document as it was."""
    text = '<svg><rect fill="#FF0000" style="stroke:#FF0000"/></svg>'
    df = spark.createDataFrame([(text, [{"#FF0000": "#00FF00"}, {}, {"#00FF00": "#0000FF", "#FF0000": "#111111"}])], "t string, m array<map<string,string>>")
    alone = [recolor(text, m)["content"] for m in df.first().m]
    assert df.select(recolored_each(F.col("t"), F.col("m")).alias("r")).first().r == alone
    assert "#00FF00" in alone[0] and "#FF0000" in alone[1] and "#0000FF" not in alone[2]


def test_a_task_holds_a_fixed_number_of_rows(spark):
    """Exchanges get more tasks where there are more rows."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [shared.tasks_for(spark, n) for n in (0, 10, 40_000_001)] == [usual, usual, 41]
    tokens = spark.range(300).select(F.col("id").cast("string").alias("file"), F.lit("#112233").alias("hex"))
    counts = usage.usage_counts(tokens.unionByName(tokens), 9)
    assert counts.rdd.getNumPartitions() == 9 and counts.where("n = 2").count() == 300


def test_marks_give_what_the_tree_gives(spark):
    """A document is written once and its marks filled; where that is not exact, the tree is written for each mapping."""
    from collections import Counter
    from xml.etree import ElementTree as ET

    from colorjobs.functions.svg import recolor_each, recolored_by, sites, spliced

    ns = 'xmlns="http://www.w3.org/2000/svg"'
    docs = [
        f'<svg {ns} xmlns:x="u"><rect style="stroke:#333;fill: #e74c3c" x:a="1" fill=" #333 " id="&lt;&#10;"/><stop stop-color="rgb(1,2,\n3)"/></svg>',
        f'<svg {ns}><style>.a{{fill:#E74C3C;stroke:rgb(51, 51,51)}} &gt; <b>red</b> blue</style><style><style>red</style></style></svg>',
        f'<svg {ns} id="\ue0000\ue001"><rect fill="#333"/>\ue0001\ue001</svg>', f'<svg {ns} id="\ue000"><rect fill="red" stroke="red"/></svg>', "<svg/>",
    ]
    maps = [{}, {"#333333": "#111111", "#E74C3C": "#333333", "#FF0000": ""}, {"#333333": 'a"<&>\n', "#FF0000": "0", "#010203": "#333333"}]

    def plain(text, mapping):
        root = ET.fromstring(text)
        for s in [s for s in sites(root) if s.tokens]:
            s.put(spliced(s.text, s.tokens, mapping, Counter(), Counter()))
        return ET.tostring(root, encoding="unicode")

    for text in docs:
        assert [r["content"] for r in recolor_each(text, maps)] == [plain(text, m) for m in maps]
    lines = "#333333 #111111 #222222\n#FF0000 #333333 red"
    df = spark.createDataFrame([(d, lines) for d in docs] + [("<broken", lines), (docs[0], None), (None, None)], "t string, m string")
    two = [{"#333333": "#111111", "#FF0000": "#333333"}, {"#333333": "#222222", "#FF0000": "red"}]
    got = [r.r for r in df.coalesce(1).select(recolored_by(F.col("t"), F.col("m"), 2).alias("r")).collect()]
    assert got == [[plain(d, m) for m in two] for d in docs] + [None, [plain(docs[0], {})] * 2, None]


def test_variants_write_a_document_once(spark, monkeypatch):
    """Four variants of a document cost one writing of its tree (four before), and their colours are counted without an exchange."""
    from colorjobs.functions import svg
    from colorjobs.functions.svg import document_colors

    written = []
    monkeypatch.setattr(svg.ET, "tostring", lambda *a, f=svg.ET.tostring, **b: written.append(1) or f(*a, **b))
    made = [r["content"] for r in svg.recolor_each('<svg><rect fill="#333"/></svg>', [{"#333333": f"#{k}{k}{k}{k}{k}{k}"} for k in range(4)])]
    assert len(set(made)) == 4 and len(written) == 1
    df = spark.createDataFrame([("a", '<svg><rect fill="#333" stroke="#333333"/><line stroke="red"/></svg>'), ("b", "<broken"), ("c", None), ("d", "<svg/>")], "file string, content string")
    found = document_colors(df)
    assert sorted(map(tuple, found.collect())) == [("a", "#333333", 2), ("a", "#FF0000", 1)]
    assert "Exchange" not in found._jdf.queryExecution().toString()


def test_variants_simulate_a_colour_once(spark):
    """Colours are told apart before they are simulated, and texts that are no colour are passed over."""
    from colorjobs.operators.accessibility import cb_variants

    svgs = spark.createDataFrame([("a", '<svg><rect fill="#E74C3C"/></svg>'), ("b", "<broken"), ("c", "<svg/>")], "file string, content string")
    usage = spark.createDataFrame([("a", "#E74C3C"), ("a", "red"), ("a", None), ("b", "#E74C3C")], "file string, hex string")
    rows = {(r.file, r.cb): r.content for r in cb_variants(svgs, usage).collect()}
    assert len(rows) == 12 and rows["b", "deutan"] == "<broken" and rows["c", "tritan"] == "<svg />"
    assert len({v for (f, _), v in rows.items() if f == "a"}) == 4 and not any("#E74C3C" in v for (f, _), v in rows.items() if f == "a")
