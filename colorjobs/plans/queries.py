"""Every job of the library as a query over the star-schema tables, with the same answer as DuckDB SQL where SQL can give it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from colorjobs.functions import color_sql as S
from colorjobs.functions import colors as C
from colorjobs.functions.svg import document_colors, extract, recolored_css
from colorjobs.operators import accessibility, batch, mapping, palette, preflight, usage
from colorjobs.plans import convert as plan
from colorjobs.sources import adapters as A
from colorjobs.sources import tables
from colorjobs.sources.shared import cut, tasks_for
from colorjobs.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HEX = "printf('#%06X', ({key} * 7919 + 104729) % 16777216)".format
_L, _a, _b = S.lab("hex")
PRE = f"""WITH tokens AS (SELECT CAST(l_orderkey AS VARCHAR) AS file, {HEX(key='l_partkey')} AS hex, CASE WHEN l_linestatus = 'O' THEN '@fill'
  ELSE '@stroke' END AS context, l_quantity, l_suppkey,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord FROM lineitem),
usage AS (SELECT file, hex, count(*) AS n FROM tokens GROUP BY ALL),
colors AS (SELECT DISTINCT hex FROM usage),
lab AS (SELECT hex, {_L} AS L, {_a} AS a, {_b} AS b FROM colors),
gmap AS (SELECT {HEX(key='p_partkey')} AS source, printf('#%02X%02X%02X', (p_size * 5) % 256, (p_size * 5) % 256,
  (p_size * 5) % 256) AS target, p_type AS label, p_partkey AS ord FROM part WHERE p_partkey % 5 = 0),
glab AS (SELECT hex AS source, target, label, ord, {_L} AS L, {_a} AS a, {_b} AS b FROM (SELECT *, source AS hex FROM gmap)),
ovr AS (SELECT CAST(l_orderkey AS VARCHAR) AS file, {HEX(key='l_partkey')} AS source, max(printf('#%06X', (l_suppkey * 50021) % 16777216)) AS target
  FROM lineitem WHERE (l_orderkey + l_linenumber) % 7 = 0 GROUP BY ALL),
slots AS (SELECT concat('slot.', p_partkey) AS name, {HEX(key='p_partkey')} AS authored, p_type AS label, p_partkey AS ord FROM part WHERE p_partkey % 11 = 0),
themes AS (SELECT concat('slot.', p_partkey) AS slot, printf('#%06X', (p_partkey * 104651) % 16777216) AS target FROM part WHERE p_partkey % 11 = 0),
thm AS (SELECT authored AS hex, max_by(target, ord) AS target FROM slots JOIN themes ON name = slot GROUP BY ALL),
resolved AS (SELECT u.file, u.hex, u.n, CASE WHEN o.target IS NOT NULL THEN 'override' WHEN t.target IS NOT NULL THEN 'theme'
  WHEN g.target IS NOT NULL THEN 'global' ELSE 'none' END AS layer, coalesce(o.target, t.target, g.target, u.hex) AS target
  FROM usage u LEFT JOIN ovr o ON u.file = o.file AND u.hex = o.source LEFT JOIN thm t ON u.hex = t.hex LEFT JOIN gmap g ON u.hex = g.source),
illus AS (SELECT CAST(o_orderkey AS VARCHAR) AS file, CASE o_orderstatus WHEN 'F' THEN 'reviewed' WHEN 'P' THEN 'in_progress' ELSE 'pending' END AS status,
  CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'reviewed' WHEN o_orderpriority[1] = '3' THEN 'exported'
  ELSE 'pending' END AS cmyk_status, o_orderkey % 3 = 0 AS cmyk_auto_fix FROM orders),
files AS (SELECT DISTINCT file FROM usage),
swatches AS (SELECT concat('p_', p_partkey) AS id, {HEX(key='p_partkey')} AS source_hex, [{HEX(key='(p_partkey + 1)')},
  {HEX(key='(p_partkey + 2)')}, {HEX(key='p_partkey')}] AS members FROM part WHERE p_partkey % 50 = 0),
mem AS (SELECT id, source_hex, unnest(members) AS hex FROM swatches),
icc AS (SELECT hex, printf('#%02X%02X%02X', {S.channel('hex', 0)} // 2, {S.channel('hex', 1)} // 2, {S.channel('hex',
    2)} // 2) AS printed_hex FROM colors WHERE {S.channel('hex', 0)} % 2 = 0),
hist AS (SELECT source, target, count(*) AS n FROM (SELECT source, target FROM gmap UNION ALL SELECT source, target FROM ovr) GROUP BY ALL)
"""


def query(sql: str | None = None, name: str | None = None, recursive: bool = False):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = (PRE.replace("WITH", "WITH RECURSIVE", 1) if recursive else PRE) + sql
        return f

    return add


class T:
    """The tables of one run."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    tokens = property(lambda t: A.color_tokens(t.spark, t.d))
    tasks = property(lambda t: tasks_for(t.spark, A.read(t.spark, t.d, "lineitem").count()))  # from the files' footers
    wide_tasks = property(lambda t: tasks_for(t.spark, A.read(t.spark, t.d, "lineitem").count(), 250_000))  # where rows carry places
    usage = property(lambda t: usage.usage_counts(t.tokens, t.tasks))
    colors = property(lambda t: t.tokens.select("hex").distinct())
    gmap = property(lambda t: A.global_map(t.spark, t.d))
    ovr = property(lambda t: A.overrides(t.spark, t.d))
    slots = property(lambda t: A.slots(t.spark, t.d))
    themes = property(lambda t: A.themes(t.spark, t.d))
    illus = property(lambda t: A.illustrations(t.spark, t.d))
    files = property(lambda t: t.tokens.select("file").distinct())
    part = property(lambda t: A.read(t.spark, t.d, "part"))
    svgs = property(lambda t: A.svgs(t.spark, t.d))

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {"global_map": self.gmap, "overrides": self.ovr, "slots": self.slots, "themes": self.themes, "illustrations": self.illus}

    @property
    def resolved(self) -> DataFrame:
        return plan.resolve(self.tokens, self.tables, "print", tasks=self.tasks)

    @property
    def swatches(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.part.where("p_partkey % 50 = 0").select(F.concat(F.lit("p_"), k).alias("id"), A.part_hex(k).alias("source_hex"),
            F.lit("").alias("label"), F.lit("").alias("notes"), F.array(A.part_hex(k + 1), A.part_hex(k + 2), A.part_hex(k)).alias("members"))

    @property
    def icc(self) -> DataFrame:
        r, g, b = C.channels(F.col("hex"))
        half = lambda c: F.floor(c / 2).cast("int")
        return self.colors.where(r % 2 == 0).select(F.lit("sig").alias("icc_signature"), "hex",
            F.format_string("#%02X%02X%02X", half(r), half(g), half(b)).alias("printed_hex"))

    @property
    def device(self) -> DataFrame:
        """(source, cmyk, ord)."""
        k = F.col("p_partkey")
        quad = C.cmyk_struct((k % 101), (k * 7 % 101), (k * 3 % 101), (k * 11 % 101))
        return self.part.where("p_partkey % 9 = 0").select(A.part_hex(k).alias("source"), quad.alias("cmyk"), k.alias("ord"))


def flat_cmyk(c: str = "cmyk"):
    return [F.col(f"{c}.{k}").alias(k) for k in ("c", "m", "y", "k")]


# --- colours -----------------------------------------------------------------------------------------------------------


@query("SELECT file, hex, count(*) AS n, string_agg(DISTINCT context, ',' ORDER BY context) AS contexts, hex AS raw_forms FROM tokens GROUP BY file, hex")
def color_usage(spark, d):
    return usage.color_usage(T(spark, d).tokens).select("file", "hex", "n", F.array_join("contexts", ",").alias("contexts"),
        F.array_join("raw_forms", ",").alias("raw_forms"))


@query("SELECT DISTINCT hex, file FROM usage")
def color_files(spark, d):
    return usage.color_files(T(spark, d).usage)


@query("SELECT hex, count(*) AS n_files, array_to_string(list(file ORDER BY file)[1:1000], ',') AS files FROM usage GROUP BY hex")
def files_by_color(spark, d):
    return usage.files_by_color(T(spark, d).usage).select("hex", "n_files", F.array_join("files", ",").alias("files"))


@query("SELECT hex FROM colors")
def distinct_colors(spark, d):
    return usage.distinct_colors(T(spark, d).usage)


@query("SELECT hex, count(*) AS n_files FROM usage GROUP BY hex")
def batch_palette(spark, d):
    return usage.batch_palette(T(spark, d).usage)


@query("SELECT hex, n_files, coalesce(target, hex) AS target, target IS NULL OR target = hex AS unchanged FROM (SELECT hex, count(*) AS n_files"
    " FROM usage GROUP BY hex) LEFT JOIN gmap ON hex = source")
def palette_report(spark, d):
    t = T(spark, d)
    return usage.palette_report(usage.batch_palette(t.usage), t.gmap, "grayscale")


@query("SELECT file, hex, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY file ORDER BY n DESC, hex) AS INT) AS rank FROM usage) WHERE rank <= 3")
def top_colors(spark, d):
    return usage.top_colors(T(spark, d).usage, 3)


_FAMILY = S.family("a", "b")


@query(f"SELECT file, hex, CAST(row_number()"
    f" OVER (PARTITION BY file ORDER BY list_position(['red','orange','yellow','green','cyan','blue','purple','neutral'], {_FAMILY}),"
    f" L, a, b, hex) AS INT) AS position FROM usage JOIN lab USING (hex)")
def sort_colors(spark, d):
    return usage.sort_colors(T(spark, d).usage)


@query(
    f""", cells AS (SELECT hex, {_FAMILY} AS family, greatest(0, least(5, CAST(floor(L / 100 * 6) AS INT))) AS bin FROM lab),
grid AS (SELECT family, bin FROM (SELECT unnest(['red','orange','yellow','green','cyan','blue','purple','neutral']) AS family), (SELECT
  CAST(unnest(range(6)) AS INT) AS bin)),
s AS (SELECT family, bin, count(DISTINCT hex) AS colors, sum(n) AS tokens, count(DISTINCT file) AS files FROM usage JOIN cells USING (hex) GROUP BY ALL)
SELECT family, bin, CAST(coalesce(colors, 0) AS BIGINT) AS colors, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens,
  CAST(coalesce(files, 0) AS BIGINT) AS files FROM grid LEFT JOIN s USING (family, bin)"""
)
def hue_lightness_histogram(spark, d):
    return usage.hue_lightness_histogram(T(spark, d).usage)


_LABEL = (
    f"CASE WHEN {_FAMILY} = 'neutral' THEN CASE WHEN L > 85 THEN 'near white' WHEN L < 15 THEN 'near black' ELSE 'neutral gray' END"
    f" ELSE concat(CASE WHEN L > 75 THEN 'light ' WHEN L < 35 THEN 'dark ' ELSE '' END, {_FAMILY}) END"
)
_OWN_LABEL = _LABEL.replace("atan2(b", "atan2(lab.b").replace("b * b", "lab.b * lab.b")
_RGB = [S.channel("hex", i) for i in range(3)]


@query(f"SELECT hex, {_RGB[0]} AS r, {_RGB[1]} AS g, {_RGB[2]} AS b, round(L, 6) AS lab_l, round(a, 6) AS lab_a,"
    f" round(lab.b, 6) AS lab_b, {S.gray('hex')} AS gray, greatest({', '.join(_RGB)}) - least({', '.join(_RGB)}) <= 2"
    f" AS is_gray, {_FAMILY.replace('b,', 'lab.b,').replace('b * b', 'lab.b * lab.b')}"
    f" AS family, {_OWN_LABEL} AS label FROM lab")
def color_math(spark, d):
    h = F.col("hex")
    r, g, b = C.channels(h)
    lab = C.lab_columns(h)
    return T(spark, d).colors.select("hex", r.alias("r"), g.alias("g"), b.alias("b"),
        *(F.round(x, 6).alias(n) for x, n in zip(lab, ("lab_l", "lab_a", "lab_b"), strict=True)), C.gray_value(h).alias("gray"),
            C.is_grayscale(h).alias("is_gray"), C.hue_family(h).alias("family"), C.auto_label(h).alias("label"))


_GRAY = S.lab("'#808080'")


@query(f"SELECT hex, round(sqrt(pow(L - {_GRAY[0]}, 2) + pow(a - {_GRAY[1]}, 2) + pow(b - {_GRAY[2]}, 2)), 6) AS delta_e,"
    f" round(sqrt(pow({_RGB[0]} - 128, 2) + pow({_RGB[1]} - 128, 2) + pow({_RGB[2]} - 128, 2)), 6) AS rgb FROM lab")
def color_distances(spark, d):
    h, gray = F.col("hex"), F.lit("#808080")
    return T(spark, d).colors.select("hex", F.round(C.color_distance(h, gray, "lab"), 6).alias("delta_e"),
        F.round(C.color_distance(h, gray, "rgb"), 6).alias("rgb"))


@query("SELECT hex, " + ", ".join(f"{S.simulated('hex', k)} AS {k}" for k in C.CB_TYPES) + " FROM colors")
def simulate_cb(spark, d):
    return T(spark, d).colors.select("hex", *(C.simulate_cb(F.col("hex"), k).alias(k) for k in C.CB_TYPES))


@query(f"SELECT hex, CAST(form AS BIGINT) AS form, CASE form WHEN 4 THEN NULL ELSE hex END AS norm FROM colors, (SELECT unnest(range(5)) AS form)")
def normalize_hex(spark, d):
    h = F.col("hex")
    forms = F.array(F.lower(h), F.format_string("RGB(%d, %d,%d)", *C.channels(h)), F.concat(h, F.lit("80")), F.concat(F.lit("  "), h, F.lit(" ")),
        F.concat(F.lit("url("), h, F.lit(")")))
    rows = T(spark, d).colors.select("hex", F.posexplode(forms).alias("form", "raw"))
    return rows.select("hex", F.col("form").cast("long").alias("form"), C.normalize_hex(F.col("raw")).alias("norm"))


@query(
    ", words AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '(?i)" + C.RGB.replace("(" + C.NUMBER + ")",
        C.NUMBER) + "', ' ', 'g'), '#[0-9a-fA-F]{3,8}\\b', ' ', 'g'), '\\b([a-zA-Z]{3,30})\\b', 1)) AS w FROM documents), names AS (SELECT unnest(["
    + ", ".join(f"{{'k': '{k}', 'v': '{v}'}}" for k, v in C.NAMES.items())
    + "]) AS e) SELECT doc_id, e.v AS hex, count(*) AS n FROM words JOIN names ON lower(w) = e.k GROUP BY ALL"
)
def free_text_tokens(spark, d):
    docs = A.read(spark, d, "documents").select("doc_id", F.explode(C.css_color_tokens(F.col("text"))).alias("t"))
    return docs.groupBy("doc_id", F.col("t.hex").alias("hex")).agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey, prop, value, CAST(pos AS INT) AS pos"
    f" FROM (SELECT p_partkey, unnest(['fill', 'stroke-width']) AS prop, unnest([{HEX(key='p_partkey')},"
        f" CAST(p_size AS VARCHAR)]) AS value, unnest([0, 1]) AS pos FROM part)")
def parse_style(spark, d):
    text = F.format_string(" FILL : %s;; stroke-width:%d ;x", A.part_hex(F.col("p_partkey")), F.col("p_size"))
    return T(spark, d).part.select("p_partkey", F.posexplode(C.parse_style(text)).alias("pos", "s")).select("p_partkey", "s.prop", "s.value", "pos")


@query("SELECT p_partkey, round(CASE p_partkey % 6 WHEN 0 THEN p_size / (4e0 / 3e0) WHEN 1 THEN CAST(p_size AS DOUBLE)"
    " WHEN 2 THEN p_size * 72e0 / 25.4e0 WHEN 3 THEN p_size * 72e0 / 2.54e0 WHEN 4 THEN p_size * 72e0 END, 9) AS pt FROM part")
def parse_length(spark, d):
    unit = F.element_at(F.array(*map(F.lit, ("px", "pt", "MM", "cm", "in", "%"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return T(spark, d).part.select("p_partkey", F.round(C.parse_length_pt(F.concat(F.col("p_size"), unit),
        C.user_units_per_pt(F.lit("0 0 0 1"), 1.0)), 9).alias("pt"))


@query("SELECT p_partkey, CASE WHEN p_size * 3 <= 100 THEN CAST(p_size * 3 AS DOUBLE) END AS c, CASE WHEN p_size * 3 <= 100 THEN"
    " concat(p_size * 3, '/', p_size, '/0.5/', p_partkey % 7) END AS label FROM part")
def parse_cmyk(spark, d):
    text = F.format_string("%d, %d/0.5,%d", F.col("p_size") * 3, F.col("p_size"), F.col("p_partkey") % 7)
    return T(spark, d).part.select("p_partkey", C.parse_cmyk(text).alias("q")).select("p_partkey", "q.c",
        F.when(F.col("q").isNotNull(), C.cmyk_label(F.col("q"))).alias("label"))


@query("SELECT hex, CASE WHEN de <= 2 THEN 'ok' WHEN de <= 5 THEN 'review' ELSE 'flag' END AS band"
    " FROM (SELECT hex, min(sqrt(pow(l.L - g.L, 2) + pow(l.a - g.a, 2) + pow(l.b - g.b, 2))) AS de FROM lab l, glab g GROUP BY hex)")
def delta_band(spark, d):
    t = T(spark, d)
    return mapping.nearest_color(t.colors, t.gmap).select("hex", C.delta_band(F.col("distance")).alias("band"))


# --- resolution --------------------------------------------------------------------------------------------------------

_NEAR = (
    "SELECT hex, min_by(struct_pack(source := g.source, target := g.target, label := g.label), struct_pack(d := {d}, o := g.ord)) AS m, "
    "min({d}) AS d FROM {colors} c, glab g GROUP BY hex"
)
_DLAB = "sqrt((c.L - g.L) * (c.L - g.L) + (c.a - g.a) * (c.a - g.a) + (c.b - g.b) * (c.b - g.b))"


@query(", near AS (" + _NEAR.format(d=_DLAB, colors="lab") + ") SELECT hex, m.source AS via, round(d, 6) AS distance FROM near")
def nearest_color(spark, d):
    t = T(spark, d)
    return mapping.nearest_color(t.colors, t.gmap).select("hex", "via", F.round("distance", 6).alias("distance"))


@query(f", sw AS (SELECT id, hex AS source, {_L} AS L, {_a} AS a, {_b} AS b FROM (SELECT id, source_hex AS hex FROM swatches))"
    f" SELECT hex, min_by(id, struct_pack(d := sqrt(pow(c.L - s.L, 2) + pow(c.a - s.a, 2) + pow(c.b - s.b, 2)), i := s.source)) AS swatch_id"
        f" FROM lab c, sw s GROUP BY hex")
def nearest_swatch(spark, d):
    t = T(spark, d)
    return mapping.nearest_swatch(t.colors, t.swatches).select("hex", "swatch_id")


@query(
    ", near AS (" + _NEAR.format(d=_DLAB, colors="lab")
    + """) SELECT u.file, u.hex, CASE WHEN o.target IS NOT NULL THEN o.target WHEN g.target IS NOT NULL THEN g.target WHEN near.d <= 10
  THEN near.m.target END AS target,
CASE WHEN o.target IS NOT NULL OR g.target IS NOT NULL THEN 'exact' WHEN near.d <= 10 THEN 'near' ELSE 'none' END AS kind,
round(CASE WHEN o.target IS NOT NULL OR g.target IS NOT NULL THEN 0e0 WHEN near.d <= 10 THEN near.d END, 6) AS distance,
CASE WHEN o.target IS NOT NULL THEN 'override' WHEN g.target IS NOT NULL THEN g.label WHEN near.d <= 10 THEN near.m.label ELSE '' END AS label
FROM usage u LEFT JOIN ovr o ON u.file = o.file AND u.hex = o.source LEFT JOIN gmap g ON u.hex = g.source LEFT JOIN near ON u.hex = near.hex"""
)
def suggest(spark, d):
    t = T(spark, d)
    return mapping.suggest(t.usage, t.gmap, t.ovr).select("file", "hex", "target", "kind", F.round("distance", 6).alias("distance"), "label")


@query("SELECT u.file, u.hex AS source, coalesce(o.target, g.target) AS target FROM usage u LEFT JOIN ovr o ON u.file = o.file AND u.hex = o.source"
    " LEFT JOIN gmap g ON u.hex = g.source WHERE coalesce(o.target, g.target) IS NOT NULL")
def merge_mappings(spark, d):
    t = T(spark, d)
    return mapping.merge_mappings(t.usage, t.gmap, t.ovr)


@query("SELECT authored AS hex, name AS slot, target FROM slots LEFT JOIN themes ON name = slot")
def theme_resolve(spark, d):
    t = T(spark, d)
    return mapping.theme_resolve(t.slots, t.themes, "print", "grayscale")


@query("SELECT file, hex, n, layer, target FROM resolved")
def resolve_layers(spark, d):
    return T(spark, d).resolved


@query("SELECT u.file, u.hex, CASE WHEN o.target IS NOT NULL AND length(u.file) % 2 = 0 THEN o.target ELSE g.target END AS target, CASE"
    " WHEN o.target IS NOT NULL AND length(u.file) % 2 = 1 THEN substring(o.target, 1, 4) END AS rejected FROM usage u LEFT"
        " JOIN ovr o ON u.file = o.file AND u.hex = o.source LEFT JOIN gmap g ON u.hex = g.source")
def resolve_palette_exact(spark, d):
    t = T(spark, d)
    suggested = mapping.suggest(t.usage, t.gmap, t.ovr.limit(0), nearest=False)
    manual = t.ovr.withColumn("target", F.when(F.length("file") % 2 == 0, F.col("target")).otherwise(F.substring("target", 1, 4)))
    return mapping.resolve_palette(suggested, manual)


@query(
    ", near AS (" + _NEAR.format(d=_DLAB, colors="lab")
    + """) SELECT u.file, u.hex, coalesce(o.target, g.target, CASE WHEN near.d <= 10 THEN near.m.target END) AS target, CASE
  WHEN length(u.file) % 2 = 1 THEN substring(o.target, 1, 4) END AS rejected
FROM usage u LEFT JOIN ovr o ON u.file = o.file AND u.hex = o.source LEFT JOIN gmap g ON u.hex = g.source LEFT JOIN near ON u.hex = near.hex"""
)
def resolve_palette(spark, d):
    """J7 with every step: pick, override, exact, nearest. A file's picks are its overrides, cut short where its name has odd length."""
    t = T(spark, d)
    manual = t.ovr.withColumn("target", F.when(F.length("file") % 2 == 0, F.col("target")).otherwise(F.substring("target", 1, 4)))
    return mapping.resolve_palette(mapping.suggest(t.usage, t.gmap, t.ovr), manual)


@query("SELECT o.file, o.source, o.target FROM ovr o LEFT JOIN gmap g ON o.source = g.source"
    " WHERE o.target <> o.source AND (g.target IS NULL OR o.target <> g.target)")
def persistable_overrides(spark, d):
    t = T(spark, d)
    return mapping.persistable_overrides(t.ovr, t.gmap)


@query("SELECT file, hex FROM resolved WHERE layer = 'none'")
def unmapped_colors(spark, d):
    return mapping.unmapped_colors(T(spark, d).resolved)


_DEV = (
    f"dev AS (SELECT {HEX(key='p_partkey')} AS source, p_partkey % 101 AS c, p_partkey * 7 % 101 AS m, p_partkey * 3 % 101 AS y, "
    f"p_partkey * 11 % 101 AS k FROM part WHERE p_partkey % 9 = 0)"
)


@query(f", {_DEV} SELECT file, hex AS source, CAST(CASE WHEN CAST(file AS BIGINT) % 4 = 0 THEN y ELSE c END AS DOUBLE) AS c, CAST(m AS DOUBLE) AS m,"
    f" CAST(y AS DOUBLE) AS y, CAST(k AS DOUBLE) AS k FROM usage JOIN dev ON hex = source")
def device_merge(spark, d):
    t = T(spark, d)
    own = t.usage.where("cast(file as long) % 4 = 0").join(t.device, F.col("hex") == F.col("source")).select("file",
        F.lower("source").alias("source"), C.cmyk_struct(F.col("cmyk.y"), F.col("cmyk.m"), F.col("cmyk.y"), F.col("cmyk.k")).alias("cmyk"))
    return mapping.device_merge(t.device, own, t.usage).select("file", "source", *flat_cmyk())


@query(f", {_DEV} SELECT file, hex AS source, target FROM resolved WHERE layer <> 'none' AND hex NOT IN (SELECT source FROM dev)")
def effective_corrections_global(spark, d):
    t = T(spark, d)
    merged = t.resolved.where("layer != 'none'").select("file", F.col("hex").alias("source"), "target")
    return mapping.effective_corrections(merged, mapping.device_merge(t.device, t.device.limit(0).withColumn("file", F.lit("")), t.usage))


@query("SELECT f.file, coalesce(status, 'pending') AS status, coalesce(cmyk_status, 'pending') AS cmyk_status,"
    " coalesce(cmyk_auto_fix, false) AS cmyk_auto_fix, i.file IS NOT NULL AS has_metadata, '' AS notes, coalesce(c.n, 0) AS grayscale_overrides,"
        " CAST(0 AS BIGINT) AS cmyk_overrides FROM files f LEFT JOIN illus i ON f.file = i.file LEFT JOIN (SELECT file, count(*) AS n FROM ovr"
            " GROUP BY file) c ON f.file = c.file")
def library(spark, d):
    t = T(spark, d)
    return mapping.library(t.files, t.illus, t.ovr)


@query("SELECT id, CAST(count(DISTINCT file) AS BIGINT) AS n_files FROM mem LEFT JOIN usage USING (hex) GROUP BY id")
def palette_usage(spark, d):
    t = T(spark, d)
    return mapping.palette_usage(t.swatches, t.usage)


@query("SELECT printf('auto.%03d', row_number() OVER (ORDER BY ord)) AS name, source AS authored, label FROM gmap"
    " WHERE source NOT IN (SELECT authored FROM slots)")
def auto_migrate(spark, d):
    t = T(spark, d)
    return mapping.auto_migrate(t.slots, t.gmap, "grayscale")[0].select("name", "authored", "label")


@query("SELECT source, target, label FROM gmap UNION ALL"
    " SELECT source, min_by(target, struct_pack(f := file, t := target)), 'auto-promoted from editor' FROM ovr WHERE source NOT IN (SELECT source"
        " FROM gmap) GROUP BY source")
def promote_overrides(spark, d):
    t = T(spark, d)
    return mapping.promote_overrides(t.ovr, t.gmap, "grayscale").select("source", "target", "label")


def paint_ops(t: T) -> DataFrame:
    tokens = A.color_tokens(t.spark, t.d, ordered=True)
    ch = F.array(*(F.round(c / 255.0, 4) for c in C.channels(F.col("hex"))))
    return tokens.select(F.col("file").alias("doc"), F.lit(1).alias("page"), F.lit(0).alias("stream"), F.col("ord").alias("idx"),
        F.when(F.col("context") == "@fill", "rg").otherwise("RG").alias("op"), ch.alias("operands"))


_CLOSE = " AND ".join(f"abs(round({S.channel('t.hex', i)} / 255e0, 4) - {S.channel('v.source', i)} / 255e0) <= 0.002000000001e0" for i in range(3))


@query(f", {_DEV}, dist AS (SELECT t.hex, min_by(v.source, v.o) AS source FROM colors t, (SELECT *, row_number()"
    f" OVER (ORDER BY source) AS q, (SELECT min(p_partkey) FROM part p WHERE {HEX(key='p.p_partkey')} = dev.source) AS o FROM dev) v"
        f" WHERE {_CLOSE} GROUP BY t.hex) SELECT d.source, count(t.hex) AS n, count(t.hex) = 0 AS missing FROM dev d LEFT"
            f" JOIN dist x ON x.source = d.source LEFT JOIN tokens t ON t.hex = x.hex GROUP BY d.source")
def match_paint_operators(spark, d):
    t = T(spark, d)
    return mapping.paint_report(mapping.match_paint_operators(cut(paint_ops(t), "ops"), t.device), t.device)


_ICCLAB = (
    f", pl AS (SELECT printed, {S.lab('printed')[0]} AS L, {S.lab('printed')[1]} AS a, {S.lab('printed')[2]} AS b"
    f" FROM (SELECT DISTINCT printed_hex AS printed FROM icc))"
)


@query(_ICCLAB + " SELECT c.hex, printed_hex, round(sqrt(pow(c.L - p.L, 2) + pow(c.a - p.a, 2) + pow(c.b - p.b, 2)), 6) AS delta_e FROM lab c LEFT"
    " JOIN icc i ON c.hex = i.hex LEFT JOIN pl p ON i.printed_hex = p.printed")
def printed_appearance(spark, d):
    t = T(spark, d)
    return mapping.printed_appearance(t.colors, t.icc, "sig").withColumn("delta_e", F.round("delta_e", 6))


@query("SELECT hex FROM colors WHERE hex NOT IN (SELECT hex FROM icc)")
def stale_appearance(spark, d):
    t = T(spark, d)
    return mapping.stale_appearance(t.colors, t.icc, "sig")


@query("SELECT file, r.hex, coalesce(printed_hex, target) AS shown FROM resolved r LEFT JOIN icc i ON r.target = i.hex WHERE"
    " coalesce(printed_hex, target) <> r.hex")
def press_preview_map(spark, d):
    t = T(spark, d)
    return mapping.press_preview_map(t.resolved, t.icc, "sig")


# --- aggregates --------------------------------------------------------------------------------------------------------


@query("SELECT source, target, n FROM hist")
def mapping_history(spark, d):
    t = T(spark, d)
    return mapping.mapping_history(t.gmap, t.ovr)


@query("SELECT source, count(*) AS n_files FROM ovr GROUP BY source")
def override_usage(spark, d):
    return mapping.override_usage(T(spark, d).ovr)


@query("SELECT * FROM (SELECT source, target, n, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, target) AS INT) AS rank FROM hist"
    " WHERE source <> target) WHERE rank <= 5")
def suggest_from_history(spark, d):
    t = T(spark, d)
    return mapping.suggest_from_history(mapping.mapping_history(t.gmap, t.ovr))


@query("SELECT pipeline, status, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest(['grayscale', 'cmyk']) AS pipeline) CROSS"
    " JOIN (SELECT unnest(['pending', 'in_progress', 'reviewed', 'exported']) AS status) LEFT"
        " JOIN (SELECT 'grayscale' AS pipeline, status, count(*) AS n FROM illus GROUP BY ALL UNION ALL SELECT 'cmyk', cmyk_status, count(*)"
            " FROM illus GROUP BY ALL) USING (pipeline, status)")
def status_counts(spark, d):
    return mapping.status_counts(T(spark, d).illus)


@query("SELECT file FROM illus WHERE status = 'pending' ORDER BY lower(file), file LIMIT 1")
def next_pending(spark, d):
    return mapping.next_pending(T(spark, d).illus).select("file")


@query(
    f""", m AS (SELECT file, target AS hex, string_agg(DISTINCT hex, ',' ORDER BY hex) AS sources FROM resolved WHERE layer <> 'none' GROUP BY ALL),
g AS (SELECT *, {S.gray('hex')} AS lum, greatest({', '.join(_RGB)}) - least({', '.join(_RGB)}) AS spread FROM m)
SELECT file, hex AS target, sources, lum AS luminance, CASE WHEN lum > 238 THEN printf('too light to print: %d, at most 238 (#EEEEEE) shows', lum)
  ELSE printf('tinted: red %d, green %d, blue %d', {', '.join(_RGB)}) END AS reason FROM g WHERE lum > 238 OR spread > 4"""
)
def print_safety(spark, d):
    merged = T(spark, d).resolved.where("layer != 'none'").select("file", F.col("hex").alias("source"), "target")
    return mapping.print_safety(merged).withColumn("sources", F.array_join("sources", ","))


@query("SELECT file, hex, n, layer <> 'none' AS mapped FROM resolved")
def recolor_detail(spark, d):
    t = T(spark, d)
    return mapping.recolor_detail(t.usage, t.resolved)


@query("SELECT file, CAST(sum(CASE WHEN layer <> 'none' THEN n ELSE 0 END) AS BIGINT) AS replacements, CAST(sum(CASE WHEN layer = 'none' THEN n"
    " ELSE 0 END) AS BIGINT) AS unmapped_tokens, CAST(sum(CASE WHEN layer = 'none' THEN 1 ELSE 0 END) AS BIGINT) AS unmapped_colors FROM resolved"
        " GROUP BY file")
def recolor_report(spark, d):
    return mapping.recolor_report(T(spark, d).resolved)


@query("SELECT hex AS source, target, CAST(sum(n) AS BIGINT) AS n FROM resolved WHERE layer <> 'none' GROUP BY ALL")
def shift_table(spark, d):
    return mapping.shift_table(T(spark, d).resolved)


@query("SELECT file, array_to_string(list(hex ORDER BY hex)[1:8], ',') AS first, greatest(count(*) - 8, 0) AS more FROM resolved WHERE layer = 'none'"
    " GROUP BY file")
def unmapped_preview(spark, d):
    return mapping.unmapped_preview(T(spark, d).resolved).withColumn("first", F.array_join("first", ","))


@query("SELECT s.id, CAST((SELECT count(*) FROM mem m LEFT JOIN gmap g ON m.hex = g.source"
    " WHERE m.id = s.id AND m.hex <> m.source_hex AND (g.target IS NULL OR g.target <> m.source_hex)) AS BIGINT) AS global_changes,"
        " CAST((SELECT count(*) FROM mem m JOIN ovr o ON m.hex = o.source"
            " WHERE m.id = s.id AND m.hex <> m.source_hex) AS BIGINT) AS overrides_deleted, CAST((SELECT count(DISTINCT o.file) FROM mem m"
                " JOIN ovr o ON m.hex = o.source WHERE m.id = s.id AND m.hex <> m.source_hex) AS BIGINT) AS files FROM swatches s")
def replace_preflight(spark, d):
    t = T(spark, d)
    return mapping.replace_preflight(t.gmap, t.ovr, t.swatches, "grayscale")


_PAIRS = f""", sim AS MATERIALIZED (SELECT hex, {", ".join(f"{S.simulated('hex', k)} AS {k}" for k in C.CB_TYPES)} FROM colors),
allhex AS (SELECT hex FROM colors UNION SELECT unnest([{', '.join(C.CB_TYPES)}]) FROM sim),
al AS MATERIALIZED (SELECT hex, {_L} AS L, {_a} AS a, {_b} AS b FROM allhex),
seen AS MATERIALIZED (SELECT s.hex, cb, l.L, l.a, l.b
  FROM (SELECT hex, unnest(['deutan', 'protan', 'tritan', 'achromat']) AS cb, unnest([deutan, protan, tritan, achromat]) AS shown FROM sim) s
  JOIN al l ON s.shown = l.hex),
far AS MATERIALIZED (SELECT x.file, x.hex AS hex_a, y.hex AS hex_b, sqrt(pow(p.L - q.L, 2) + pow(p.a - q.a, 2) + pow(p.b - q.b, 2)) AS de_orig
  FROM usage x JOIN usage y ON x.file = y.file AND x.hex < y.hex JOIN al p ON p.hex = x.hex JOIN al q ON q.hex = y.hex),
pairs AS (SELECT * FROM (SELECT file, p.cb, hex_a, hex_b, de_orig, sqrt(pow(p.L - q.L, 2) + pow(p.a - q.a, 2) + pow(p.b - q.b, 2)) AS de_sim FROM far
  JOIN seen p ON p.hex = hex_a JOIN seen q ON q.hex = hex_b AND q.cb = p.cb WHERE de_orig >= 25) WHERE de_sim < 10)"""


@query(_PAIRS + " SELECT file, cb, hex_a, hex_b, round(de_orig, 5) AS de_orig, round(de_sim, 5) AS de_sim FROM pairs")
def cb_collapsed_pairs(spark, d):
    t = T(spark, d)
    return accessibility.cb_collapsed_pairs(t.usage, tasks=t.wide_tasks).withColumn("de_orig", F.round("de_orig", 5)).withColumn("de_sim", F.round("de_sim", 5))


@query(_PAIRS + " SELECT f.file, " + ", ".join(f"coalesce(bool_or(cb = '{k}'), false) AS {k}" for k in C.CB_TYPES) + " FROM files f LEFT JOIN pairs p ON f.file = p.file GROUP BY f.file")
def cb_risk(spark, d):
    t = T(spark, d)
    return accessibility.cb_risk(t.usage, tasks=t.wide_tasks)


@query(f"SELECT * FROM (SELECT hex, {S.simulated('hex', 'deutan')} AS target FROM colors) WHERE hex <> target")
def cb_mapping(spark, d):
    return accessibility.cb_mapping(T(spark, d).colors, "deutan")


# Lloyd rounds as a recursion: a row is a mean (L, a, b) with what its round found; it goes on until all means are still and
# no colour has moved. A cluster without colours would start again from the next colour; with these tables none is empty.
_STEPS = f"{palette.STEPS}e0"
_LLOYD = f""", pts AS MATERIALIZED (SELECT hex, sha256(hex) AS h, hash(hex) AS who, {", ".join(f"CAST(round(lab.{c} * {_STEPS}) AS BIGINT) AS {c}" for c in "Lab")} FROM lab),
rounds AS (
  SELECT 0 AS nth, i, L, a, b, 1e9 AS drift, CAST(0 AS BIGINT) AS n, CAST(0 AS UBIGINT) AS who, false AS same FROM (
    SELECT row_number() OVER (ORDER BY h) - 1 AS i, L / {_STEPS} AS L, a / {_STEPS} AS a, pts.b / {_STEPS} AS b FROM pts ORDER BY h LIMIT 12)
  UNION ALL
  SELECT nth + 1, i, m.L, m.a, m.b, sqrt(pow(m.L - r.L, 2) + pow(m.a - r.a, 2) + pow(m.b - r.b, 2)), m.n, m.who, m.n = r.n AND m.who = r.who
  FROM (SELECT own.i AS i, sum(L) / count(*) / {_STEPS} AS L, sum(a) / count(*) / {_STEPS} AS a, sum(near.b) / count(*) / {_STEPS} AS b,
      count(*) AS n, bit_xor(who) AS who FROM (
    SELECT p.hex, any_value(p.L) AS L, any_value(p.a) AS a, any_value(p.b) AS b, any_value(p.who) AS who,
      min({{'d': pow(p.L / {_STEPS} - c.L, 2) + pow(p.a / {_STEPS} - c.a, 2) + pow(p.b / {_STEPS} - c.b, 2), 'i': c.i}}) AS own
    FROM pts p, rounds c GROUP BY p.hex) near GROUP BY own.i) m JOIN rounds r USING (i)
  WHERE nth < 50 AND (SELECT max(drift) >= 0.5 OR NOT bool_and(same) FROM rounds)),
final AS (SELECT * FROM rounds WHERE nth = (SELECT max(nth) FROM rounds)),
held AS (SELECT p.hex, any_value(p.L) AS L, any_value(p.a) AS a, any_value(p.b) AS b,
    min({{'d': pow(p.L / {_STEPS} - c.L, 2) + pow(p.a / {_STEPS} - c.a, 2) + pow(p.b / {_STEPS} - c.b, 2), 'i': c.i}}) AS own FROM pts p, final c GROUP BY p.hex),
means AS (SELECT own.i AS i, sum(L) / count(*) / {_STEPS} AS ml, sum(a) / count(*) / {_STEPS} AS ma, sum(held.b) / count(*) / {_STEPS} AS mb,
    count(*) AS n_members, min({{'d': own.d, 'hex': hex}}).hex AS source_hex FROM held GROUP BY own.i)
SELECT printf('p_%03d', row_number() OVER (ORDER BY ml, ma, mb, source_hex)) AS id, source_hex, label, n_members, round(ml, 5) AS L, round(ma, 5) AS a,
  round(mb, 5) AS b FROM means JOIN (SELECT hex AS source_hex, {_OWN_LABEL} AS label FROM lab) USING (source_hex)"""


@query(_LLOYD, recursive=True)
def kmeans_palette(spark, d):
    found = palette.kmeans_palette(T(spark, d).colors, 12)
    return found.select("id", "source_hex", "label", "n_members", *(F.round(c, 5).alias(c) for c in "Lab"))


# --- changes -----------------------------------------------------------------------------------------------------------


@query("SELECT source, target FROM gmap WHERE source NOT IN (SELECT authored FROM slots) UNION ALL SELECT authored, printf('#%06X', ord) FROM slots")
def upsert_map(spark, d):
    t = T(spark, d)
    rows = t.slots.select(F.lit("grayscale").alias("pipeline"), F.col("authored").alias("source"), A.hexed(F.col("ord")).alias("target"), "label", "notes")
    return mapping.upsert_map(t.gmap, rows).select("source", "target")


@query("SELECT source, target FROM gmap WHERE source NOT IN (SELECT authored FROM slots)")
def remove_map(spark, d):
    t = T(spark, d)
    return mapping.remove_map(t.gmap, t.slots.select(F.col("authored").alias("source"))).select("source", "target")


def identical(t: T) -> DataFrame:
    return t.ovr.withColumn("target", F.when(F.length("file") % 2 == 0, F.col("source")).otherwise(F.col("target")))


@query("SELECT CAST(0 AS BIGINT) AS global_removed, count(*) AS overrides_removed, count(DISTINCT file) AS files FROM ovr"
    " WHERE length(file) % 2 = 0 OR source = target")
def cleanup_identity(spark, d):
    t = T(spark, d)
    return mapping.cleanup_identity(t.gmap, identical(t), "grayscale")[2]


@query("SELECT file, CASE WHEN CAST(file AS BIGINT) % 2 = 0 THEN 'pending' ELSE status END AS status, cmyk_status FROM illus"
    " WHERE NOT (CAST(file AS BIGINT) % 2 = 0 AND cmyk_status = 'pending')")
def wipe_pipeline(spark, d):
    t = T(spark, d)
    none = t.device.limit(0).select(F.lit("").alias("file"), "source", "cmyk")
    return mapping.wipe_pipeline(t.illus, t.ovr, none, t.illus.where("cast(file as long) % 2 = 0"), "grayscale")["illustrations"].select("file",
        "status", "cmyk_status")


_MEMBERS = "m AS (SELECT hex, min(source_hex) AS source_hex FROM mem WHERE hex <> source_hex GROUP BY hex)"


@query(f", {_MEMBERS} SELECT file, source, target FROM ovr WHERE source NOT IN (SELECT hex FROM m)")
def replace_globally(spark, d):
    t = T(spark, d)
    return mapping.replace_globally(t.gmap, t.ovr, t.swatches, "grayscale")[1].select("file", "source", "target")


@query(f", {_MEMBERS} SELECT r.file, r.hex, r.target AS before, CASE WHEN t.target IS NOT NULL THEN t.target ELSE m.source_hex END AS after"
    f" FROM resolved r JOIN m USING (hex) LEFT JOIN thm t ON r.hex = t.hex WHERE r.target <> CASE WHEN t.target IS NOT NULL THEN t.target"
        f" ELSE m.source_hex END")
def mapping_diff(spark, d):
    t = T(spark, d)
    g, o = mapping.replace_globally(t.gmap, t.ovr, t.swatches, "grayscale")
    after = plan.resolve(t.tokens, t.tables | {"global_map": g, "overrides": o}, "print")
    return mapping.mapping_diff(t.resolved, after,
        t.swatches.select("source_hex", F.explode("members").alias("hex")).where("hex != source_hex").select("hex").distinct())


@query("SELECT file, source, target FROM ovr o WHERE NOT (CAST(file AS BIGINT) % 5 = 0)")
def reset_colors(spark, d):
    t = T(spark, d)
    resets = t.usage.where("cast(file as long) % 5 = 0").select("file", "hex")
    return mapping.reset_colors(t.gmap, t.ovr, t.device, resets, "grayscale")[1].select("file", "source", "target")


@query("SELECT file, CASE WHEN file IN (SELECT file FROM ovr) THEN 'exported' ELSE status END AS status FROM illus")
def mark_status(spark, d):
    t = T(spark, d)
    return mapping.mark_status(t.illus, t.ovr, "exported", F.lit("2024-01-01").cast("timestamp")).select("file", "status")


# --- documents ---------------------------------------------------------------------------------------------------------

#: The kinds of rows that the facts of a file, and its fine lines, are made of.
FACTS, FINE = ("token", "fact", "error"), ("element", "fact")


@query("SELECT file, hex, context, count(*) AS n FROM tokens GROUP BY ALL")
def extract_tokens(spark, d):
    return extract(T(spark, d).svgs, ("token",)).groupBy("file", "hex", "context").agg(F.count("*").alias("n"))


@query("SELECT file, CAST(count(*) AS INT) AS n_colors, false AS has_image, false AS has_text, CAST(NULL AS VARCHAR) AS parse_error FROM usage GROUP BY file")
def svg_facts(spark, d):
    return usage.svg_facts(cut(extract(T(spark, d).svgs, FACTS), "rows")).drop("color_space_warnings")


_FORCE = f""", el AS (SELECT file, ord, hex, CAST(printf('%.2f', l_quantity / 50) AS DOUBLE) AS width FROM tokens WHERE context = '@stroke'),
hits AS (SELECT file, ord, hex, width / (100e0 / 72e0) AS size_pt FROM el JOIN lab USING (hex)
  WHERE sqrt(L * L + a * a + b * b) <= 15 AND width > 0 AND width / (100e0 / 72e0) <= 0.5)"""


@query(_FORCE + " SELECT file, hex AS color_hex, round(size_pt, 6) AS size_pt FROM hits")
def force_k_hits(spark, d):
    return preflight.force_k_hits(cut(extract(T(spark, d).svgs, FINE), "rows"), 1.0).select("file", "color_hex", F.round("size_pt", 6).alias("size_pt"))


@query(_FORCE + " SELECT f.file, count(h.ord) AS stroke_count, CAST(0 AS BIGINT) AS text_count FROM files f LEFT JOIN hits h ON f.file = h.file"
    " GROUP BY f.file")
def force_k_report(spark, d):
    t = T(spark, d)
    return preflight.force_k_report(t.files, preflight.force_k_hits(cut(extract(t.svgs, FINE), "rows"), 1.0)).drop("samples")


@query("SELECT CAST(page AS BIGINT) AS page, round(max(s) * 100e0 / 255e0, 6) AS max_pct, round(avg(s) * 100e0 / 255e0, 6) AS mean_pct,"
    " round(quantile_cont(s, 0.99) * 100e0 / 255e0, 6) AS p99_pct, round(avg(CASE WHEN s * 100e0 / 255e0 >= 320 THEN 1e0"
        " ELSE 0e0 END), 9) AS violation_fraction, CASE WHEN avg(CASE WHEN s * 100e0 / 255e0 >= 320 THEN 1e0 ELSE 0e0 END) <= 0 THEN 'ok'"
            " WHEN avg(CASE WHEN s * 100e0 / 255e0 >= 320 THEN 1e0 ELSE 0e0 END) < 0.001 THEN 'warn' ELSE 'fail' END AS status"
                " FROM (SELECT l_suppkey AS page, l_partkey % 256 + l_orderkey % 256 + (l_partkey * 7) % 256 + (l_orderkey * 3) % 256 AS s"
                    " FROM lineitem) GROUP BY page")
def tac_report(spark, d):
    out = preflight.tac_report(A.pixels_cmyk(spark, d))
    return out.select("page", *(F.round(c, 6).alias(c) for c in ("max_pct", "mean_pct", "p99_pct")),
        F.round("violation_fraction", 9).alias("violation_fraction"), "status")


def page_pixels(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = A.read(spark, d, "lineitem")
    px = rows.select(F.col("l_suppkey").cast("string").alias("page"), (F.col("l_partkey") % 8).cast("int").alias("x"),
        (F.col("l_orderkey") % 8).cast("int").alias("y"), F.col("l_linenumber").alias("alpha")).groupBy("page", "x", "y").agg(F.min("alpha").alias("alpha"))
    pages = rows.select(F.col("l_suppkey").cast("string").alias("page")).distinct().select("page", F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"),
        F.lit(80.0).alias("vw"), F.lit(80.0).alias("vh"), F.lit(8).alias("px_w"), F.lit(8).alias("px_h"))
    return pages, px


@query("SELECT CAST(l_suppkey AS VARCHAR) AS page, true AS had_content,"
    " round((max(l_partkey % 8) + 1 - min(l_partkey % 8)) * 10e0 / 96e0, 6) AS width_in,"
        " round((max(l_orderkey % 8) + 1 - min(l_orderkey % 8)) * 10e0 / 96e0, 6) AS height_in FROM lineitem WHERE l_linenumber > 0 GROUP BY l_suppkey")
def content_bbox(spark, d):
    pages, px = page_pixels(spark, d)
    return preflight.content_bbox(pages, px).select("page", "had_content", F.round("width_in", 6).alias("width_in"), F.round("height_in", 6).alias("height_in"))


def page_mask(spark, d) -> DataFrame:
    pages, px = page_pixels(spark, d)
    white = px.select("page", "x", "y", *(F.lit(255).alias(c) for c in "rgb"))
    ink = px.select("page", "x", "y", *(F.when(F.col("alpha") <= 2, 0).otherwise(255).alias(c) for c in "rgb"))
    return preflight.eroded(cut(preflight.diff_mask(white, ink), "mask"), pages)


@query()
def render_diff(spark, d):
    return preflight.diff_regions(page_mask(spark, d), least=1)


@query("SELECT page, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT"
    " CAST(l_suppkey AS VARCHAR) AS page, l_partkey % 8 AS x, l_orderkey % 8 AS y, min(l_linenumber) AS alpha FROM lineitem GROUP BY ALL) WHERE alpha <= 2")
def render_mask(spark, d):
    _, px = page_pixels(spark, d)
    return preflight.diff_mask(px.select("page", "x", "y", *(F.lit(255).alias(c) for c in "rgb")),
        px.select("page", "x", "y", *(F.when(F.col("alpha") <= 2, 0).otherwise(255).alias(c) for c in "rgb")))


@query()
def render_summary(spark, d):
    pages, _ = page_pixels(spark, d)
    out = preflight.render_summary(render_diff(spark, d), pages.select("page", "px_w", "px_h"))
    return out.select("page", "regions", F.size("spots").alias("spots"))


@query("SELECT p_partkey, '8.25in' AS width, '10.25in' AS height, round(CASE WHEN p_size + 1 >= 25 THEN 10e0"
    " ELSE 10e0 * (p_size + 1) / 25e0 END, 9) AS full_w_in, round(CASE WHEN p_size + 1 >= 25 THEN 10e0 * 25e0 / (p_size + 1)"
        " ELSE 10e0 END, 9) AS full_h_in, 38 AS trim_x0, 2438 AS trim_x1 FROM part")
def page_geometry(spark, d):
    facts = T(spark, d).part.select(F.col("p_partkey").cast("string").alias("file"),
        F.format_string("0 0 %d 25", F.col("p_size") + 1).alias("viewbox"), F.lit(None).cast("string").alias("aspect"))
    g = preflight.page_geometry(facts, 8.0, 10.0, 0.125, 0.25, 300)
    return g.select(F.col("file").cast("long").alias("p_partkey"), "width", "height", F.round("full_w_in", 9).alias("full_w_in"),
        F.round("full_h_in", 9).alias("full_h_in"), F.col("trim_box.x0").alias("trim_x0"), F.col("trim_box.x1").alias("trim_x1"))


@query("SELECT concat(p_size, '.', p_partkey % 100, ' - ', p_name) AS stem,"
    " concat('Ch', printf('%02d', p_size), '_fig', p_partkey % 100, '_', replace(p_name, ' ', '-')) AS name, CAST(NULL AS VARCHAR) AS warning FROM part")
def output_name(spark, d):
    stems = T(spark, d).part.select(F.format_string("%d.%d - %s", F.col("p_size"), F.col("p_partkey") % 100, F.col("p_name")).alias("stem"))
    return preflight.output_name(stems, "Ch{chapter:02d}_fig{figure}_{slug}")


# --- batch -------------------------------------------------------------------------------------------------------------

_SELECT = (
    "sel AS (SELECT f.file, NOT (coalesce(u.n, 0) > 0 AND o.file IS NULL AND coalesce(i.status, 'pending') <> 'reviewed') AS convert, CASE"
    " WHEN coalesce(u.n, 0) > 0 AND o.file IS NULL AND coalesce(i.status, 'pending') <> 'reviewed' THEN printf('%d unmapped colors', "
    "u.n) END AS reason FROM files f LEFT JOIN illus i ON f.file = i.file LEFT JOIN (SELECT file, count(*) AS n FROM resolved"
    " WHERE layer = 'none' GROUP BY file) u ON f.file = u.file LEFT JOIN (SELECT DISTINCT file FROM ovr) o ON f.file = o.file)"
)


@query(f", {_SELECT} SELECT file, convert, reason FROM sel")
def select_for_convert(spark, d):
    t = T(spark, d)
    return batch.select_for_convert(mapping.library(t.files, t.illus, t.ovr), mapping.unmapped_colors(t.resolved), t.ovr)


@query(f", {_SELECT} SELECT file, CAST(sum(CASE WHEN layer <> 'none' THEN n ELSE 0 END) AS INT) AS replacements, CAST(sum(CASE"
    f" WHEN layer = 'none' THEN n ELSE 0 END) AS BIGINT) AS unmapped, CAST(NULL AS VARCHAR) AS error FROM resolved WHERE file IN (SELECT file"
        f" FROM sel WHERE convert) GROUP BY file")
def convert_svgs(spark, d):
    t = T(spark, d)
    out = plan.convert(t.svgs, t.tokens, t.tables, "print")["documents"]
    return out.select("file", "replacements", F.aggregate(F.map_values("unmapped"), F.lit(0).cast("long"), lambda x, y: x + y).alias("unmapped"), "error")


@query("SELECT file, target AS hex, CAST(sum(n) AS BIGINT) AS n FROM resolved GROUP BY ALL")
def recolored_tokens(spark, d):
    """Recoloured documents, read again: every token is its target."""
    t = T(spark, d)
    merged = t.resolved.where("layer != 'none'").select("file", F.col("hex").alias("source"), "target")
    done = cut(batch.recolor_svgs(t.svgs, merged).select("file", "content"), "recolored")
    return usage.usage_counts(extract(done, ("token",)))


@query("SELECT file, css FROM (SELECT file, concat('.a{fill:', coalesce(max(CASE WHEN ord = 1 THEN target END), ''), '}') AS css"
    " FROM (SELECT t.file, t.ord, r.target FROM tokens t JOIN resolved r ON t.file = r.file AND t.hex = r.hex) GROUP BY file)")
def recolor_css(spark, d):
    t = T(spark, d)
    first = A.color_tokens(spark, d, ordered=True).where("ord = 1").select("file", "hex").join(t.resolved, ["file", "hex"])
    return first.select("file", recolored_css(F.format_string(".a{fill:%s}", "hex"), F.create_map("hex", "target")).alias("css"))


@query(f", s AS (SELECT hex, {S.simulated('hex',
    'protan')} AS shown FROM colors) SELECT file, shown AS hex, CAST(sum(n) AS BIGINT) AS n FROM usage JOIN s USING (hex) GROUP BY ALL")
def cb_variants_protan(spark, d):
    t = T(spark, d)
    v = cut(accessibility.cb_variants(t.svgs, t.usage, ("protan",)).select("file", "content"), "variants")
    return document_colors(v)


def batch_table(t: T) -> DataFrame:
    rows = cut(extract(t.svgs), "rows")
    return batch.batch_files(t.files, mapping.recolor_report(t.resolved), usage.svg_facts(rows),
        preflight.force_k_report(t.files, preflight.force_k_hits(rows, 1.0)))


@query(_FORCE + " SELECT r.file, 'ok' AS status, CAST(sum(CASE WHEN layer <> 'none' THEN n ELSE 0 END) AS BIGINT) AS replacements, CAST(sum(CASE"
    " WHEN layer = 'none' THEN 1 ELSE 0 END) AS BIGINT) AS unmapped, coalesce(max(h.k), 0) AS stroke_count, CAST(max(CASE WHEN layer = 'none' THEN 1"
        " ELSE 0 END) + (coalesce(max(h.k), 0) > 0)::INT AS INT) AS n_warnings FROM resolved r LEFT JOIN (SELECT file, count(*) AS k FROM hits"
            " GROUP BY file) h ON r.file = h.file GROUP BY r.file")
def batch_files(spark, d):
    return batch_table(T(spark, d)).select("file", "status", "replacements", "unmapped", "stroke_count", F.size("warnings").alias("n_warnings"))


@query("SELECT count(*) AS total, count(*) AS succeeded, CAST(0 AS BIGINT) AS failed FROM files")
def batch_summary(spark, d):
    return batch.batch_summary(batch_table(T(spark, d)))


@query(f", {_SELECT}, w AS (SELECT count(*) AS n FROM (SELECT file, target AS hex FROM resolved WHERE layer <> 'none' GROUP BY ALL)"
    f" WHERE {S.gray('hex')} > 238 OR greatest({', '.join(_RGB)}) - least({', '.join(_RGB)}) > 4)"
        f" SELECT count(*) FILTER (convert) AS converted, count(*) FILTER (NOT convert) AS skipped, CAST(0 AS BIGINT) AS failed, (SELECT n"
            f" FROM w) AS safety_warnings, CASE WHEN (SELECT n FROM w) > 0 THEN 4 ELSE 0 END AS exit_code FROM sel")
def run_summary(spark, d):
    t = T(spark, d)
    chosen = select_for_convert(spark, d).select("file", F.when(F.col("convert"), "converted").otherwise("skipped").alias("outcome"))
    merged = t.resolved.where("layer != 'none'").select("file", F.col("hex").alias("source"), "target")
    return batch.run_summary(chosen, mapping.print_safety(merged))


# --- sources, sinks, streams -------------------------------------------------------------------------------------------


@query("SELECT 'delivery-1-docs' AS delivery_id, CAST(doc_id AS VARCHAR) AS file, sha256(text) AS sha256, octet_length(encode(text)) AS bytes FROM documents")
def manifest(spark, d):
    files = A.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.encode("text", "UTF-8").alias("content"))
    return tables.manifest(files, "Docs", "delivery-1").select("delivery_id", "file", "sha256", "bytes")


@query("SELECT i.file, i.status, coalesce(n, 0) AS overrides FROM illus i LEFT JOIN (SELECT file, count(*) AS n FROM ovr GROUP BY file) o ON i.file = o.file")
def mapping_documents(spark, d):
    t = T(spark, d)
    docs = tables.mapping_documents(t.illus, t.ovr, "2024-01-01T00:00:00Z").select("file", F.from_json("document", tables.MAPPING).alias("m"))
    return docs.select("file", "m.status", F.size("m.overrides").cast("long").alias("overrides"))


_STATUS = "CASE event_type WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'reviewed' WHEN 'signup' THEN 'exported' ELSE 'pending' END"


@query(f"SELECT CAST(user_id AS VARCHAR) AS file, max(ts) AS ts, max_by({_STATUS}, struct_pack(t := ts, s := {_STATUS})) AS status FROM events"
    f" GROUP BY user_id")
def latest_status(spark, d):
    return streams.latest_status(A.status_events(spark, d))


@query(SQL["latest_status"][len(PRE) :], name="stream_status")
def stream_status(spark, d):
    """The same through a stream over the events table."""
    import uuid

    from colorjobs.sources.shared import shared_dir

    kinds = A.read(spark, d, "events").schema
    raw = spark.readStream.schema(kinds).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*.parquet")
    events = raw.select(F.col("user_id").cast("string").alias("file"), F.col("ts").cast("timestamp").alias("ts"), F.expr(_STATUS).alias("status"))
    target = f"{shared_dir(spark)}/latest-{uuid.uuid4().hex}"
    streams.stream_status(events, f"{target}/out", f"{target}/checkpoint").awaitTermination()
    return streams.current_status(spark, f"{target}/out")


@query("SELECT file, hex, n FROM usage")
def stream_usage(spark, d):
    """Documents arrive as a stream of Parquet files; their usage is kept up to date."""
    import uuid

    from colorjobs.sources.shared import shared_dir

    base = f"{shared_dir(spark)}/usage-{uuid.uuid4().hex}"
    T(spark, d).svgs.withColumn("mtime", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{base}/in")
    svgs = spark.readStream.schema("file string, content string, mtime timestamp").parquet(f"{base}/in")
    streams.stream_usage(svgs, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return streams.current_usage(spark, f"{base}/out")
