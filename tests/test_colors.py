import pytest
from pyspark.sql import functions as F

from colorjobs.functions import color_sql, colors as C
from colorjobs.functions.css_names import NAMES
from colorjobs.functions.svg import hex_of

VALID = {
    "#abc": "#AABBCC", "#abcd": "#AABBCC", "#E74C3C": "#E74C3C", "#e74c3cff": "#E74C3C", "  #333 ": "#333333", "rgb(46, 204, 113)": "#2ECC71",
        "rgb(0%, 50%, 100%)": "#0080FF",
    "RGBA(1,2,3,0.5)": "#010203", "rgb(300, -5, 2.5)": "#FF0002", "CornflowerBlue": "#6495ED", "red": "#FF0000", "rgb(123)": "#010203",
        "rgb(0.5 1.5 2.5)": "#000202",
}
INVALID = ["", "  ", "none", "transparent", "currentColor", "inherit", "url(#g)", "#12345", "#1234567", "hsl(1,2%,3%)", "notacolor", "rgb(red)", None]


def test_normalize(spark):
    rows = [(x,) for x in [*VALID, *INVALID]]
    out = [r.h for r in spark.createDataFrame(rows, "raw string").select(C.normalize_hex(F.col("raw")).alias("h")).collect()]
    assert out == [*VALID.values(), *[None] * len(INVALID)]
    assert [hex_of(r) for (r,) in rows] == out


def test_names():
    assert len(NAMES) == 148


def test_spaces(spark):
    row = spark.createDataFrame([("#000000", "#FFFFFF")], "k string, w string").select(C.hex_to_lab(F.col("k")).alias("k"),
        C.hex_to_lab(F.col("w")).alias("w"), C.delta_e76(F.col("k"), F.col("w")).alias("d"), C.gray_value(F.col("w")).alias("g")).first()
    assert abs(row.k.L) < 1e-6 and abs(row.w.L - 100) < 0.01 and abs(row.d - 100) < 0.05 and row.g == 255
    with pytest.raises(ValueError):
        C.color_distance(F.col("k"), F.col("w"), "xyz")


def test_not_a_colour_is_null(spark):
    df = spark.createDataFrame([(None,), ("",), ("#12",)], "h string")
    row = df.select(C.gray_value(F.col("h")).alias("a"), C.simulate_cb(F.col("h"), "deutan").alias("b"), C.hex_to_lab(F.col("h"))["L"].alias("c")).collect()
    assert all(x is None for r in row for x in r)


def test_severity_zero_is_identity(spark):
    df = spark.createDataFrame([("#E74C3C",)], "h string").select(*(C.simulate_cb(F.col("h"), k, 0.0).alias(k) for k in C.CB_TYPES))
    assert set(df.first()) == {"#E74C3C"}


def test_sql_functions(spark):
    color_sql.register(spark)
    df = spark.createDataFrame([("#E74C3C",), ("#46AA3A",), ("#808080",)], "h string")
    a = df.selectExpr("cj_gray(h)", "cj_lab(h).L", "cj_family(h)", "cj_deutan(h)", "cj_achromat(h)", "cj_delta_e(h, '#000000')").collect()
    h = F.col("h")
    b = df.select(C.gray_value(h), C.lab_columns(h)[0], C.hue_family(h), C.simulate_cb(h, "deutan"), C.simulate_cb(h, "achromat"),
        C.delta_e76(h, F.lit("#000000"))).collect()
    for x, y in zip(a, b, strict=True):
        assert all(abs(p - q) < 1e-9 if isinstance(p, float) else p == q for p, q in zip(x, y, strict=True))


def test_cmyk(spark):
    df = spark.createDataFrame([("0/85/85/0",), ("0, 85.5,85,0",), ("1/2/3",), ("0/0/0/101",), (None,)], "t string")
    out = df.select(C.parse_cmyk(F.col("t")).alias("q")).select(F.when(F.col("q").isNotNull(), C.cmyk_label(F.col("q"))).alias("l")).collect()
    assert [r.l for r in out] == ["0/85/85/0", "0/85.5/85/0", None, None, None]


def test_cmyk_lists_and_maps(spark):
    rows = [([1.0, 2.0, 3.0, 4.0], {"c": "1", "M": "2.5"}), ([1.0, 2.0, 3.0], {"k": "101"}), (None, None)]
    df = spark.createDataFrame(rows, "a array<double>, m map<string,string>")
    out = df.select(C.parse_cmyk_array(F.col("a")).alias("a"), C.parse_cmyk_map(F.col("m")).alias("m")).collect()
    assert [r.a and tuple(r.a) for r in out] == [(1, 2, 3, 4), None, None]
    assert [r.m and tuple(r.m) for r in out] == [(1, 2.5, 0, 0), None, None]
