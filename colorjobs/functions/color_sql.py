"""The colour formulas as SQL text, for Spark's and DuckDB's dialects."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from colorjobs.session import ship

from .colors import LUMA, MACHADO, NAMES, NO_COLOUR, RGB, TO_XYZ, WHITE


class TokenRows:
    """cj_tokens: the walk of extract() over one document; one that cannot be parsed has no rows."""

    def eval(self, content: str):
        from colorjobs.functions.svg import rows_of

        for r in rows_of("", content, frozenset(("token",))):
            yield r["ord"], r["context"], r["raw"], r["hex"]


def num(x: float) -> str:
    """A double literal in both dialects."""
    return f"{float(x):.17g}e0" if "e" not in f"{float(x):.17g}" else f"{float(x):.17g}"


def channel(h: str, i: int, dialect: str = "duckdb") -> str:
    at = 2 * i + 2
    return f"CAST(conv(substring({h}, {at}, 2), 16, 10) AS INT)" if dialect == "spark" else f"CAST(concat('0x', substring({h}, {at}, 2)) AS INT)"


def linear(c: str) -> str:
    a = f"({c} / 255e0)"
    return f"(CASE WHEN {a} <= 0.04045e0 THEN {a} / 12.92e0 ELSE pow(({a} + 0.055e0) / 1.055e0, 2.4e0) END)"


def lab(h: str, dialect: str = "duckdb") -> tuple[str, str, str]:
    lin = [linear(channel(h, i, dialect)) for i in range(3)]

    def f(row, white) -> str:
        t = f"((({lin[0]} * {num(row[0])} + {lin[1]} * {num(row[1])}) + {lin[2]} * {num(row[2])}) * 100e0 / {num(white)})"
        return f"(CASE WHEN {t} > {num((6 / 29) ** 3)} THEN pow({t}, {num(1 / 3)}) ELSE {t} / {num(3 * (6 / 29) ** 2)} + {num(4 / 29)} END)"

    x, y, z = (f(r, w) for r, w in zip(TO_XYZ, WHITE, strict=True))
    return f"({y} * 116e0 - 16e0)", f"(({x} - {y}) * 500e0)", f"(({y} - {z}) * 200e0)"


def gray(h: str, dialect: str = "duckdb") -> str:
    r, g, b = (channel(h, i, dialect) for i in range(3))
    total = f"(({r} * {num(LUMA[0])} + {g} * {num(LUMA[1])}) + {b} * {num(LUMA[2])})"
    return f"CAST(rint({total}) AS INT)" if dialect == "spark" else f"CAST(round_even({total}, 0) AS INT)"


def family(a: str, b: str) -> str:
    angle = f"(CASE WHEN degrees(atan2({b}, {a})) < 0 THEN degrees(atan2({b}, {a})) + 360e0 ELSE degrees(atan2({b}, {a})) END)"
    return (
        f"(CASE WHEN sqrt({a} * {a} + {b} * {b}) < 8 THEN 'neutral' WHEN {angle} < 50 OR {angle} >= 340 THEN 'red' WHEN {angle} < 80 THEN 'orange'"
        f" WHEN {angle} < 115 THEN 'yellow' WHEN {angle} < 200 THEN 'green' WHEN {angle} < 250 THEN 'cyan' WHEN {angle} < 310 THEN 'blue' ELSE 'purple' END)"
    )


def simulated(h: str, kind: str, dialect: str = "duckdb") -> str:
    """Severity 1."""
    whole = (lambda x: f"CAST(rint({x}) AS INT)") if dialect == "spark" else (lambda x: f"CAST(round_even({x}, 0) AS INT)")
    rgb = [channel(h, i, dialect) for i in range(3)]
    if kind == "achromat":
        luma = f"(({rgb[0]} * {num(LUMA[0])} + {rgb[1]} * {num(LUMA[1])}) + {rgb[2]} * {num(LUMA[2])})"
        out = [whole(f"greatest(0e0, least(255e0, {luma}))")] * 3
    else:
        lin, out = [linear(c) for c in rgb], []
        for row in MACHADO[kind]:
            c = f"greatest(0e0, least(1e0, ({lin[0]} * {num(row[0])} + {lin[1]} * {num(row[1])}) + {lin[2]} * {num(row[2])}))"
            out.append(whole(f"(CASE WHEN {c} <= 0.0031308e0 THEN {c} * 12.92e0 ELSE pow({c}, {num(1 / 2.4)}) * 1.055e0 - 0.055e0 END) * 255e0"))
    return f"{'format_string' if dialect == 'spark' else 'printf'}('#%02X%02X%02X', {', '.join(out)})"


def normalized(v: str) -> str:
    """C1 in Spark's SQL. v: the trimmed value."""
    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    whole = text(f"(?i)^{RGB}$")

    def channel(i: int) -> str:
        part = f"regexp_extract({v}, {whole}, {i})"
        number = f"try_cast(replace({part}, '%', '') AS DOUBLE)"
        return f"CAST(greatest(0e0, least(255e0, rint(CASE WHEN endswith({part}, '%') THEN {number} * 255 / 100 ELSE {number} END))) AS INT)"

    names = ", ".join(f"'{k}', '{c}'" for k, c in NAMES.items())
    none = ", ".join(f"'{x}'" for x in NO_COLOUR)
    return (f"CASE WHEN lower({v}) IN ('', {none}) OR lower({v}) LIKE 'url(%' THEN NULL"
        f" WHEN {v} RLIKE '^#[0-9a-fA-F]{{3,4}}$' THEN upper(concat('#', repeat(substring({v}, 2, 1), 2), repeat(substring({v}, 3, 1), 2), repeat(substring({v}, 4, 1), 2)))"
        f" WHEN {v} RLIKE '^#([0-9a-fA-F]{{6}}|[0-9a-fA-F]{{8}})$' THEN upper(substring({v}, 1, 7))"
        f" WHEN {v} RLIKE {whole} THEN format_string('#%02X%02X%02X', {channel(1)}, {channel(2)}, {channel(3)})"
        f" ELSE try_element_at(map({names}), lower({v})) END")


def register(spark: SparkSession) -> None:
    """SQL functions: cj_normalize (any CSS paint value as #RRGGBB, or null), the table function cj_tokens(content), for
    LATERAL, with one row for each colour token of a document (ord, context, raw, hex), and over #RRGGBB text: cj_gray, cj_lab, cj_delta_e, cj_family, cj_deutan, cj_protan, cj_tritan, cj_achromat."""
    L, a, b = lab("h", "spark")
    make = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(f"{make} cj_normalize(raw STRING) RETURNS STRING RETURN {normalized('trim(raw)')}")
    ship(spark)
    spark.udtf.register("cj_tokens", udtf(TokenRows, returnType="ord int, context string, raw string, hex string", useArrow=True))
    spark.sql(f"{make} cj_gray(h STRING) RETURNS INT RETURN {gray('h', 'spark')}")
    spark.sql(f"{make} cj_lab(h STRING) RETURNS STRUCT<L: DOUBLE, a: DOUBLE, b: DOUBLE> RETURN named_struct('L', {L}, 'a', {a}, 'b', {b})")
    spark.sql(f"{make} cj_lab_distance(p STRUCT<L: DOUBLE, a: DOUBLE, b: DOUBLE>, q STRUCT<L: DOUBLE, a: DOUBLE, "
        f"b: DOUBLE>) RETURNS DOUBLE RETURN sqrt(pow(p.L - q.L, 2) + pow(p.a - q.a, 2) + pow(p.b - q.b, 2))")
    spark.sql(f"{make} cj_delta_e(h STRING, k STRING) RETURNS DOUBLE RETURN cj_lab_distance(cj_lab(h), cj_lab(k))")
    spark.sql(f"{make} cj_family(h STRING) RETURNS STRING RETURN {family('cj_lab(h).a', 'cj_lab(h).b')}")
    for kind in (*MACHADO, "achromat"):
        spark.sql(f"{make} cj_{kind}(h STRING) RETURNS STRING RETURN {simulated('h', kind, 'spark')}")
