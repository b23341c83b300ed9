"""More queries over the star-schema tables: sources and sinks read back, and the cases that the plain inputs do not hold
(repeated keys, used names, CMYK sides, broken documents, every type of a simulation). They join those of queries.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colorjobs.functions import color_sql as S
from colorjobs.functions import colors as C
from colorjobs.functions.svg import document_colors, extract
from colorjobs.operators import accessibility, batch, changes, mapping, postings, preflight, usage
from colorjobs.plans import convert as plan
from colorjobs.plans.queries import _DEV, _FORCE, _NEAR, FACTS, FINE, HEX, PRE, QUERIES, SQL, T, page_mask, page_pixels, query
from colorjobs.sources import adapters as A
from colorjobs.sources import files, tables
from colorjobs.sources.shared import cut, fresh_path

__all__ = ["QUERIES", "SQL"]

EVEN = "cast(file as long) % 2 = 0"

# --- sources and sinks -------------------------------------------------------------------------------------------------

_TAGS = """CASE WHEN context = '@fill' THEN printf('<rect fill="%s" width="1" height="1"/>', hex)
  ELSE printf('<line stroke="%s" stroke-width="%.2f"/>', hex, l_quantity / 50e0) END"""
_SVGS = f""", docs AS (SELECT file,
  concat('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 100 100">', string_agg({_TAGS}, '' ORDER BY ord), '</svg>') AS content FROM tokens
  GROUP BY file)"""


@query(_SVGS + " SELECT concat(file, '.SVG') AS file, sha256(content) AS sha256, CAST(length(content) AS BIGINT) AS size_bytes FROM docs")
def read_svgs(spark, d):
    """S1 on rows as the file source gives them: (path, modificationTime, length, content), other files among them."""
    svgs = T(spark, d).svgs
    each = svgs.select("file", "content", F.explode(F.array(F.lit(".SVG"), F.lit(".txt"))).alias("end"))
    path, stamp = F.concat(F.lit("file:/in/"), "file", "end"), F.lit("2024-01-01").cast("timestamp")
    files = each.select(path.alias("path"), stamp.alias("modificationTime"), F.length("content").cast("long").alias("length"),
        F.encode("content", "UTF-8").alias("content"))
    return tables.svg_rows(files).select("file", F.sha2("content", 256).alias("sha256"), "size_bytes")


@query(_SVGS + " SELECT concat(file, '_grayscale.svg') AS file, sha256(content) AS sha256 FROM docs")
def write_svgs(spark, d):
    """S4, read back."""
    path = fresh_path(spark, "svgs")
    tables.write_svgs(T(spark, d).svgs.withColumn("file", F.concat("file", F.lit(".svg"))), path)
    return spark.read.parquet(path).select("file", F.sha2("content", 256).alias("sha256"))


@query(_SVGS + " SELECT concat(file, '_grayscale.svg') AS file, sha256(content) AS sha256 FROM docs")
def svg_files(spark, d):
    """S4 as files, read by S1."""
    docs = files.named_svgs(T(spark, d).svgs.withColumn("file", F.concat("file", F.lit(".svg"))))
    return files.read_back(docs, lambda folder: tables.read_svgs(spark, folder).select("file", F.sha2("content", 256).alias("sha256")))


@query("SELECT file, 'grayscale' AS pipeline, source, target FROM ovr WHERE file IN (SELECT file FROM illus)")
def mapping_files(spark, d):
    """S5 as files, read by S2."""
    t = T(spark, d)
    docs = files.named_mappings(t.illus, t.ovr, "2024-01-01T00:00:00Z")
    return files.read_back(docs, lambda folder: tables.read_mappings(spark, folder)[1])


def own_device(t: T) -> DataFrame:
    """(file, source, cmyk): exact quads of the colours in every fourth file."""
    used = t.usage.where("cast(file as long) % 4 = 0").select("file", F.col("hex").alias("source"))
    return used.join(t.device.select("source", "cmyk"), "source").select("file", "source", "cmyk")


_OWN_DEV = "own_dev AS (SELECT file, hex AS source, concat(c, '/', m, '/', y, '/', k) AS quad FROM usage JOIN dev ON hex = source WHERE CAST(file AS BIGINT) % 4 = 0)"


@query(f", {_DEV}, {_OWN_DEV} SELECT file, 'grayscale' AS pipeline, source, target FROM ovr UNION ALL SELECT file, 'device', source, quad"
    f" FROM own_dev WHERE file IN (SELECT file FROM illus)")
def read_mappings(spark, d):
    """Mapping documents, written, read back and taken apart, exact CMYK overrides among them."""
    t = T(spark, d)
    texts = cut(tables.mapping_documents(t.illus, t.ovr, "2024-01-01T00:00:00Z", own_device(t)).select(F.col("document").alias("value")), "mappings")
    exact = tables.parse_device_overrides(texts).select("file", F.lit("device").alias("pipeline"), "source", C.cmyk_label(F.col("cmyk")).alias("target"))
    return tables.parse_mappings(texts)[1].unionByName(exact)


@query("SELECT file, status, cmyk_status, cmyk_auto_fix FROM illus")
def read_illustrations(spark, d):
    """S5 and S2, the other table."""
    t = T(spark, d)
    texts = cut(tables.mapping_documents(t.illus, t.ovr, "2024-01-01T00:00:00Z").select(F.col("document").alias("value")), "mappings")
    return tables.parse_mappings(texts)[0].select("file", "status", "cmyk_status", "cmyk_auto_fix")


@query(
    f", {_DEV} SELECT 'map' AS kind, source, target FROM gmap UNION ALL SELECT 'device', source, concat(c, '/', m, '/', y, '/', k) FROM dev"
    " UNION ALL SELECT 'slot', authored, name FROM slots UNION ALL SELECT 'theme', slot, target FROM themes"
)
def read_color_maps(spark, d):
    """S3: configurations of up to 1,000 parts each, written as JSON and read back."""
    t, key = T(spark, d), F.col("p_partkey")
    rows = t.part.select(F.floor(key / 1000).alias("doc"), key.alias("k"), A.part_hex(key).alias("hex"), (key % 5 == 0).alias("m"),
        (key % 9 == 0).alias("d"), (key % 11 == 0).alias("s"), "p_size")
    v, q = F.pmod(F.col("p_size") * 5, F.lit(256)).cast("int"), [F.pmod(F.col("k") * f, F.lit(101)) for f in (1, 7, 3, 11)]
    entry = F.struct(F.format_string("#%02x%02x%02x", v, v, v).alias("target"))
    slot, goal = F.concat(F.lit("slot."), "k"), F.format_string("#%06x", F.pmod(F.col("k") * 104651, F.lit(16777216)))
    pairs = lambda flag, key, value: F.map_from_entries(F.collect_list(F.when(F.col(flag), F.struct(key, value))))  # noqa: E731  at most 1,000
    docs = rows.groupBy("doc").agg(
        pairs("m", F.lower("hex"), entry).alias("global_color_map"), pairs("d", F.col("hex"), F.to_json(F.array(*q))).alias("quads"),
        pairs("s", slot, F.struct(F.col("hex").alias("authored"))).alias("slots"), pairs("s", slot, goal).alias("goals"),
    )
    palette = F.struct("slots", F.create_map(F.lit("print"), F.create_map(F.lit("grayscale"), F.col("goals"))).alias("themes"))
    texts = cut(docs.select(F.to_json(F.struct("global_color_map", F.col("quads").alias("cmyk_device_overrides"),
        palette.alias("semantic_palette"))).alias("value")), "configurations")
    found = tables.parse_color_maps(texts)
    parts = (
        found["global_map"].select(F.lit("map").alias("kind"), "source", "target"),
            found["device_overrides"].select(F.lit("device"), "source", C.cmyk_label(F.col("cmyk"))),
        found["slots"].select(F.lit("slot"), "authored", "name"), found["themes"].select(F.lit("theme"), "slot", "target"),
    )
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


_BLACK = S.lab("'#000000'")


@query(f"SELECT hex, {S.gray('hex')} AS gray, {S.family('a', 'lab.b')} AS family, {S.simulated('hex',
    'tritan')} AS tritan, round(sqrt(pow(L - {_BLACK[0]}, 2) + pow(a - {_BLACK[1]}, 2) + pow(lab.b - {_BLACK[2]}, 2)), 6) AS away FROM lab")
def sql_functions(spark, d):
    """2.10: the registered SQL functions."""
    S.register(spark)
    return T(spark, d).colors.selectExpr("hex", "cj_gray(hex) AS gray", "cj_family(hex) AS family", "cj_tritan(hex) AS tritan",
        "round(cj_delta_e(hex, '#000000'), 6) AS away")


@query("SELECT file, hex, context, count(*) AS n FROM tokens GROUP BY ALL")
def sql_tokens(spark, d):
    """2.10: colour tokens of documents in plain SQL, through a table function."""
    S.register(spark)
    t = T(spark, d)
    return spark.sql("SELECT file, cj_normalize(concat(' ', t.raw)) AS hex, t.context, count(*) AS n FROM {docs}, LATERAL cj_tokens(content) t GROUP BY ALL", docs=t.svgs)


# --- colours -----------------------------------------------------------------------------------------------------------

def indexed(t: T):
    """The posting index of a library whose even files came later, in place of other colours."""
    store = postings.index_store(t.spark, fresh_path(t.spark, "index"))
    used = cut(t.usage.select("file", "hex"), "used")
    stale = used.where(EVEN).select("file", F.lit("#ABCDEF").alias("hex"))
    postings.refresh(store, "first", used.limit(0), used.where(f"not ({EVEN})").unionByName(stale))
    postings.refresh(store, "second", stale, used.where(EVEN))
    return store


@query(SQL["color_files"][len(PRE) :])
def color_files_indexed(spark, d):
    """C7 from the index, every colour probed."""
    t = T(spark, d)
    return postings.files_of(indexed(t), t.colors)


@query(SQL["batch_palette"][len(PRE) :])
def batch_palette_indexed(spark, d):
    return postings.document_frequency(indexed(T(spark, d)))


@query(SQL["palette_usage"][len(PRE) :])
def palette_usage_indexed(spark, d):
    t = T(spark, d)
    return postings.palette_usage(indexed(t), t.swatches)


_PLANTED = ["Navy", "tomato", "REBECCAPURPLE", "teal"]
_PLANTED_HEX = [C.NAMES[n.lower()] for n in _PLANTED]


@query(
    SQL["free_text_tokens"].split(", words AS",
        1)[1].join((", words AS", "")).replace("SELECT doc_id, e.v AS hex, count(*) AS n FROM words JOIN names ON lower(w) = e.k GROUP BY ALL", "")
    + f""" SELECT doc_id, hex, count(*) AS n FROM (SELECT doc_id, e.v AS hex FROM words JOIN names ON lower(w) = e.k
UNION ALL SELECT doc_id, printf('#%06X', (doc_id * 7919) % 16777216) FROM documents UNION ALL SELECT doc_id, printf('#%02X00FF', doc_id % 256) FROM documents
UNION ALL SELECT doc_id, {_PLANTED_HEX!r}[doc_id % 4 + 1] FROM documents) GROUP BY ALL"""
)
def css_color_tokens(spark, d):
    """Prose with a rule and a colour's name at its end."""
    k = F.col("doc_id")
    name = F.element_at(F.array(*map(F.lit, _PLANTED)), (k % 4 + 1).cast("int"))
    rule = F.format_string(" .a{fill:#%06x;stroke:rgb(%d, 0,255)} %s", F.pmod(k * 7919, F.lit(16777216)), k % 256, name)
    docs = A.read(spark, d, "documents").select("doc_id", F.explode(C.css_color_tokens(F.concat(F.coalesce("text", F.lit("")), rule))).alias("t"))
    return docs.groupBy("doc_id", F.col("t.hex").alias("hex")).agg(F.count("*").alias("n"))


@query(
    "SELECT p_partkey, CAST(form AS BIGINT) AS form, CASE form WHEN 3 THEN concat('0/', p_size, '/0/0') ELSE"
        " concat(p_partkey % 101, '/', p_size, '/0.5/7') END AS label"
    " FROM part, (SELECT unnest(range(5)) AS form) WHERE form < 4 UNION ALL SELECT p_partkey, 4, NULL FROM part"
)
def parse_cmyk_forms(spark, d):
    """Text, JSON text, JSON list, JSON object with parts missing, and a list of three."""
    c, m = F.col("p_partkey") % 101, F.col("p_size")
    forms = ("%d/%d/0.5/7", '"%d, %d/0.5,7"', "[%d, %d, 0.5, 7]", '{"x": %d, "M": %d}', "[%d, %d, 0.5]")
    part = T(spark, d).part.select("p_partkey", "p_size").repartition("p_partkey")  # a row costs more to parse than to move
    rows = part.select("p_partkey", F.posexplode(F.array(*(F.format_string(f, c, m) for f in forms))).alias("form", "text"))
    label = C.let(C.parse_cmyk(F.col("text")), lambda q: F.when(q.isNotNull(), C.cmyk_label(q)))
    return rows.select("p_partkey", F.col("form").cast("long").alias("form"), label.alias("label"))


@query("SELECT hex, CASE WHEN de >= 6 THEN 'warn' WHEN de >= 2 THEN 'slight' ELSE 'in gamut' END AS band"
    " FROM (SELECT hex, min(sqrt(pow(l.L - g.L, 2) + pow(l.a - g.a, 2) + pow(l.b - g.b, 2))) AS de FROM lab l, glab g GROUP BY hex)")
def delta_band_editor(spark, d):
    t = T(spark, d)
    return mapping.nearest_color(t.colors, t.gmap).select("hex", C.delta_band(F.col("distance"), "editor").alias("band"))


_RGB2 = [S.channel("c.hex", i) for i in range(3)]
_RGB3 = [S.channel("g.source", i) for i in range(3)]
_DRGB = "sqrt(" + " + ".join(f"pow({x} - {y}, 2)" for x, y in zip(_RGB2, _RGB3, strict=True)) + ")"


@query(", near AS (" + _NEAR.format(d=_DRGB, colors="lab") + ") SELECT hex, m.source AS via, round(d, 6) AS distance FROM near")
def nearest_color_rgb(spark, d):
    t = T(spark, d)
    return mapping.nearest_color(t.colors, t.gmap, "rgb", most_keys=150).select("hex", "via", F.round("distance", 6).alias("distance"))


# --- resolution --------------------------------------------------------------------------------------------------------


@query(
    "SELECT u.file, u.hex, u.n, CASE WHEN o.target IS NOT NULL THEN 'override' WHEN t.target IS NOT NULL THEN 'theme'"
        " WHEN g.target IS NOT NULL THEN 'global' ELSE 'none' END AS layer,"
    " CASE WHEN o.target IS NOT NULL THEN CASE WHEN length(u.file) % 2 = 0 THEN '#FFFFFF' ELSE o.target END WHEN t.target IS NOT NULL THEN t.target"
    " WHEN g.target IS NOT NULL THEN CASE WHEN g.ord % 3 = 0 THEN '#010101' ELSE g.target END ELSE u.hex END AS target"
    " FROM usage u LEFT JOIN ovr o ON u.file = o.file AND u.hex = o.source LEFT JOIN thm t ON u.hex = t.hex LEFT JOIN gmap g ON u.hex = g.source"
)
def resolve_repeated(spark, d):
    """J5 with sources that occur twice in the map and among a file's overrides: the last one counts, and no token twice."""
    t = T(spark, d)
    again = t.gmap.where("ord % 3 = 0").withColumn("target", F.lit("#010101")).withColumn("ord", F.col("ord") + 1_000_000_000)
    twice = t.ovr.where("length(file) % 2 = 0").withColumn("target", F.lit("#FFFFFF"))
    return plan.resolve(t.tokens, t.tables | {"global_map": again.unionByName(t.gmap), "overrides": twice.unionByName(t.ovr)}, "print")


@query(f", {_DEV}, {_OWN_DEV} SELECT file, hex AS source, target FROM resolved r WHERE layer <> 'none' AND NOT EXISTS (SELECT 1 FROM own_dev o"
    f" WHERE o.file = r.file AND o.source = r.hex)")
def effective_corrections(spark, d):
    """J10 and J11 with exact quads of single files only."""
    t = T(spark, d)
    merged = t.resolved.where("layer != 'none'").select("file", F.col("hex").alias("source"), "target")
    return mapping.effective_corrections(merged, mapping.device_merge(t.device.where("ord < 0"), own_device(t), t.usage))


@query(
    ", own AS (SELECT CASE WHEN ord % 22 = 0 THEN printf('auto.%03d', ord // 11) ELSE name END AS name, authored FROM slots),"
    " free AS (SELECT printf('auto.%03d', i) AS name, row_number() OVER (ORDER BY i) AS n FROM range(1, (SELECT count(*) FROM part) + 2) t(i)"
        " WHERE printf('auto.%03d', i) NOT IN (SELECT name FROM own)),"
    " new AS (SELECT source, label, row_number() OVER (ORDER BY ord) AS n FROM gmap WHERE source NOT IN (SELECT authored FROM own))"
        " SELECT name, source AS authored, label FROM new JOIN free USING (n)"
)
def auto_migrate_free(spark, d):
    """J14 where some numbers are taken: the lowest free ones go first."""
    t = T(spark, d)
    taken = t.slots.withColumn("name", F.when(F.col("ord") % 22 == 0, F.format_string("auto.%03d", F.floor(F.col("ord") / 11))).otherwise(F.col("name")))
    return mapping.auto_migrate(taken, t.gmap, "grayscale")[0].select("name", "authored", "label")


@query("SELECT source, target, label FROM gmap WHERE source NOT IN (SELECT source FROM ovr) UNION ALL"
    " SELECT source, min_by(target, struct_pack(f := file, t := target)), 'auto-promoted from editor' FROM ovr GROUP BY source")
def promote_everything(spark, d):
    """J15 with every source."""
    t = T(spark, d)
    return mapping.promote_overrides(t.ovr, t.gmap, "grayscale", everything=True).select("source", "target", "label")


@query(
    f""", q AS (SELECT p_partkey AS doc, p_partkey % 101 AS c, p_partkey * 7 % 101 AS m, p_partkey * 3 % 101 AS y, p_partkey * 11 % 101 AS k
  FROM part WHERE p_partkey % 9 = 0),
first AS (SELECT doc % 101 AS r, min(doc) AS f FROM q GROUP BY ALL)
SELECT doc, CASE WHEN doc % 2 = 0 THEN 'k' ELSE 'K' END AS new_op, CASE WHEN doc % 4 < 3 THEN {HEX(key='f')} END AS source, CASE
  WHEN doc % 4 < 3 THEN c / 100e0 ELSE round(c / 100e0 + 0.004e0, 4) END AS c FROM q JOIN first ON doc % 101 = r"""
)
def snap_device_operators(spark, d):
    """J16, second pass: k and K near an exact quad snap to it; a fourth of them are too far away."""
    t = T(spark, d)
    off = F.when(F.col("ord") % 4 < 3, 0.0015).otherwise(0.004)
    operands = F.array(*(F.round(F.col(f"cmyk.{x}") / 100 + off, 4) for x in "cmyk"))
    op = F.when(F.col("ord") % 2 == 0, "k").otherwise("K")
    ops = t.device.select(F.col("ord").alias("doc"), F.lit(1).alias("page"), F.lit(0).alias("stream"), F.lit(0).alias("idx"), op.alias("op"),
        operands.alias("operands"))
    out = mapping.match_paint_operators(ops, t.device)
    return out.select("doc", "new_op", "source", F.col("new_operands")[0].alias("c"))


@query(f"SELECT hex, CASE WHEN {S.channel('hex', 1)} % 2 = 0 THEN '#010203' ELSE printed_hex END AS printed_hex FROM icc")
def refresh_appearance(spark, d):
    """What the cache holds stays, the rest is worked out, other signatures go."""
    t = T(spark, d)
    held = t.icc.where(C.channels(F.col("hex"))[1] % 2 == 0).withColumn("printed_hex", F.lit("#010203"))
    old = t.icc.withColumn("icc_signature", F.lit("old")).withColumn("printed_hex", F.lit("#FFFFFF"))
    return mapping.refresh_appearance(t.colors, held.unionByName(old), t.icc, "sig").select("hex", "printed_hex")


# --- changes -----------------------------------------------------------------------------------------------------------


@query("SELECT (SELECT count(*) FROM gmap"
    " WHERE ord % 10 = 0 OR source = target) AS global_removed, count(*) AS overrides_removed, count(DISTINCT file) AS files FROM ovr"
        " WHERE length(file) % 2 = 0 OR source = target")
def cleanup_identity_both(spark, d):
    t = T(spark, d)
    same = lambda df, when: df.withColumn("target", F.when(F.expr(when), F.col("source")).otherwise(F.col("target")))
    return mapping.cleanup_identity(same(t.gmap, "ord % 10 = 0"), same(t.ovr, "length(file) % 2 = 0"), "grayscale")[2]


@query(
    f""", {_DEV}, {_OWN_DEV}, co AS (SELECT * FROM ovr WHERE CAST(file AS BIGINT) % 3 = 0), t AS (SELECT file FROM illus WHERE CAST(file AS BIGINT) % 2 = 0)
SELECT file, status, CASE WHEN file IN (SELECT file FROM t) THEN 'pending' ELSE cmyk_status END AS cmyk_status,
  CASE WHEN file IN (SELECT file FROM t) THEN 0 ELSE (SELECT count(*) FROM co WHERE co.file = i.file) END AS cmyk_overrides,
  CASE WHEN file IN (SELECT file FROM t) THEN 0 ELSE (SELECT count(*) FROM own_dev WHERE own_dev.file = i.file) END AS device
FROM illus i WHERE NOT (file IN (SELECT file FROM t) AND status = 'pending' AND file NOT IN (SELECT file FROM ovr))"""
)
def wipe_pipeline_cmyk(spark, d):
    """U3 on the CMYK side: overrides and exact quads go, the grayscale side stays."""
    t = T(spark, d)
    both = t.ovr.unionByName(t.ovr.where("cast(file as long) % 3 = 0").withColumn("pipeline", F.lit("cmyk")))
    done = mapping.wipe_pipeline(t.illus, both, own_device(t), t.illus.where(EVEN), "cmyk")
    left = done["overrides"].where("pipeline = 'cmyk'").groupBy("file").agg(F.count("*").alias("o"))
    device = done["device"].groupBy("file").agg(F.count("*").alias("q"))
    zero = lambda c, n: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(n)
    j = done["illustrations"].join(left, "file", "left").join(device, "file", "left")
    return j.select("file", "status", "cmyk_status", zero("o", "cmyk_overrides"), zero("q", "device"))


@query(", m AS (SELECT hex, min(source_hex) AS source_hex FROM mem WHERE hex <> source_hex GROUP BY hex) SELECT source, target FROM gmap"
    " WHERE source NOT IN (SELECT hex FROM m) UNION ALL SELECT hex, source_hex FROM m")
def replace_globally_map(spark, d):
    """U4, the map."""
    t = T(spark, d)
    return mapping.replace_globally(t.gmap, t.ovr, t.swatches, "grayscale")[0].select("source", "target")


def stored(t: T, *names: str):
    """A store with the run's tables in it."""
    store = changes.library_store(t.spark, fresh_path(t.spark, "library"))
    have = {"global_map": t.gmap, "overrides": t.ovr, "illustrations": t.illus, "device": own_device(t)}
    changes.load(store, "load", {n: have[n].select(*store.read(n).columns) for n in names})
    return store


@query(SQL["replace_globally"][len(PRE) :] + " UNION ALL SELECT 'map', source, target FROM (SELECT source, target FROM gmap WHERE source NOT IN (SELECT hex FROM m)"
    " UNION ALL SELECT hex, source_hex FROM m)")
def replace_globally_stored(spark, d):
    """U4 in place, run twice."""
    t = T(spark, d)
    store = stored(t, "global_map", "overrides")
    for _ in range(2):
        changes.replace_globally(store, "merge", t.swatches, "grayscale")
    return store.read("overrides").select("file", "source", "target").union(store.read("global_map").select(F.lit("map"), "source", "target"))


@query(SQL["wipe_pipeline"][len(PRE) :])
def wipe_pipeline_stored(spark, d):
    """U3 in place."""
    t = T(spark, d)
    store = stored(t, "overrides", "illustrations")
    changes.wipe_pipeline(store, "wipe", t.illus.where(EVEN).select("file"), "grayscale")
    return store.read("illustrations").select("file", "status", "cmyk_status")


@query(SQL["mark_status"][len(PRE) :])
def mark_status_stored(spark, d):
    """U7 in place."""
    t = T(spark, d)
    store = stored(t, "illustrations")
    changes.mark_status(store, "mark", t.ovr.select("file"), "exported", F.lit("2024-01-01").cast("timestamp"))
    return store.read("illustrations").select("file", "status")


@query(SQL["upsert_map"][len(PRE) :])
def upsert_map_stored(spark, d):
    """U1 in place."""
    t = T(spark, d)
    store = stored(t, "global_map")
    rows = t.slots.select(F.lit("grayscale").alias("pipeline"), F.col("authored").alias("source"), A.hexed(F.col("ord")).alias("target"), "label", "notes")
    changes.upsert_map(store, "upsert", rows)
    return store.read("global_map").select("source", "target")


_RESET = "(SELECT hex FROM usage WHERE CAST(file AS BIGINT) % 500 = 0)"


@query(f", {_DEV} SELECT 'map' AS kind, source FROM gmap WHERE source NOT IN {_RESET} UNION ALL SELECT 'device', source FROM dev WHERE source NOT IN {_RESET}")
def reset_colors_maps(spark, d):
    """U6 on the CMYK side: the map and the exact quads."""
    t = T(spark, d)
    resets = t.usage.where("cast(file as long) % 500 = 0").select("file", "hex")
    g, _, device = mapping.reset_colors(t.gmap.withColumn("pipeline", F.lit("cmyk")), t.ovr, t.device, resets, "cmyk")
    return g.select(F.lit("map").alias("kind"), "source").union(device.select(F.lit("device"), "source"))


# --- documents ---------------------------------------------------------------------------------------------------------


def mixed_svgs(t: T) -> DataFrame:
    """Documents with images, texts and profiles in some, and some that are broken."""
    k = F.col("file").cast("long")
    part = lambda n, text: F.when(k % n == 0, F.lit(text)).otherwise("")
    more = F.concat(part(3, "<image/>"), part(5, '<text font-size="5">t</text>'), part(11, "<color-profile/>"),
        part(13, '<g color-interpolation="linearRGB"/>'), part(7, "<open>"), F.lit("</svg>"))
    return t.svgs.withColumn("content", F.concat(F.regexp_replace("content", "</svg>", ""), more))


_K = "CAST(file AS BIGINT)"


@query(
    f"""SELECT file, CASE WHEN {_K} % 7 = 0 THEN 0 ELSE
  CAST(count(*) AS INT) END AS n_colors, {_K} % 3 = 0 AND {_K} % 7 <> 0 AS has_image, {_K} % 5 = 0 AND {_K} % 7 <> 0 AS has_text, {_K} % 7 = 0 AS broken,
concat_ws('; ', CASE WHEN {_K} % 11 = 0 AND {_K} % 7 <> 0 THEN '1 <color-profile> element(s)' END, CASE
  WHEN {_K} % 13 = 0 AND {_K} % 7 <> 0 THEN 'non-sRGB interpolation: linearRGB' END) AS warnings FROM usage GROUP BY file"""
)
def svg_facts_mixed(spark, d):
    """C6 with every fact."""
    facts = usage.svg_facts(cut(extract(mixed_svgs(T(spark, d)), FACTS), "rows"))
    return facts.select("file", "n_colors", "has_image", "has_text", F.col("parse_error").isNotNull().alias("broken"),
        F.array_join("color_space_warnings", "; ").alias("warnings"))


@query(
    f"""SELECT r.file, CASE WHEN CAST(r.file AS BIGINT) % 7 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN CAST(r.file AS BIGINT) % 5 = 0 AND
  CAST(r.file AS BIGINT) % 7 <> 0 THEN 1 ELSE 0 END AS text_count,
CASE WHEN CAST(r.file AS BIGINT) % 2 = 0 THEN 'fail' END AS tac_status FROM resolved r GROUP BY r.file"""
)
def batch_files_mixed(spark, d):
    """A16 with broken documents, fine texts and ink coverage of half of the files."""
    t = T(spark, d)
    rows = cut(extract(mixed_svgs(t)), "rows")
    ink = t.files.where(EVEN).select(F.col("file").alias("page"), *(F.lit(250).alias(c) for c in ("c", "m", "ye", "k")))
    out = batch.batch_files(t.files, mapping.recolor_report(t.resolved), usage.svg_facts(rows),
        preflight.force_k_report(t.files, preflight.force_k_hits(rows, 1.0)), preflight.tac_report(ink))
    return out.select("file", "status", F.col("text_count").cast("int").alias("text_count"), "tac_status")


@query(
    _FORCE + """, first AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ord) AS k FROM hits JOIN el USING (file, ord, hex))
SELECT f.file, string_agg(printf('line, line %s, width %.2f', h.hex, h.width), '; ' ORDER BY h.k) FILTER (h.k <= 2) AS samples FROM files f JOIN first h ON f.file = h.file GROUP BY f.file"""
)
def force_k_samples(spark, d):
    """The first two samples of every file that has fine lines."""
    t = T(spark, d)
    hits = preflight.force_k_hits(cut(extract(t.svgs, FINE), "rows"), 1.0)
    return preflight.force_k_report(hits.select("file").distinct(), hits, 2).select("file", F.array_join("samples", "; ").alias("samples"))


_ALL = ", ".join(f"{S.simulated('hex', k)} AS {k}" for k in C.CB_TYPES)


@query(f", s AS (SELECT hex, {_ALL} FROM colors), v AS (SELECT hex, unnest({list(C.CB_TYPES)!r}) AS cb, unnest([{', '.join(C.CB_TYPES)}]) AS shown"
    f" FROM s) SELECT file, cb, shown AS hex, CAST(sum(n) AS BIGINT) AS n FROM usage JOIN v USING (hex) GROUP BY ALL")
def cb_variants(spark, d):
    """R4 for all four types."""
    t = T(spark, d)
    v = accessibility.cb_variants(t.svgs, t.usage).select(F.concat_ws("/", "file", "cb").alias("file"), "content")
    found = document_colors(cut(v, "variants"))
    return found.select(F.substring_index("file", "/", 1).alias("file"), F.substring_index("file", "/", -1).alias("cb"), "hex", "n")


@query(
    "SELECT CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE concat(p_size, '.', p_partkey % 100, ' - ', p_name) END AS stem,"
    " CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, '_CMYK') ELSE concat(p_size, '-', p_name) END AS name, p_partkey % 3 = 0 AS warned FROM part"
)
def output_name_fallback(spark, d):
    """Names without a prefix fall back."""
    prefix = F.format_string("%d.%d - ", F.col("p_size"), F.col("p_partkey") % 100)
    stems = T(spark, d).part.select(F.concat(F.when(F.col("p_partkey") % 3 == 0, "").otherwise(prefix), "p_name").alias("stem"))
    out = preflight.output_name(stems, "{chapter}-{description}")
    return out.select("stem", "name", F.col("warning").isNotNull().alias("warned"))


# --- pixels ------------------------------------------------------------------------------------------------------------

_REGIONS = """, mask AS (SELECT page, x, y FROM (SELECT CAST(l_suppkey AS VARCHAR) AS page, l_partkey % 8 AS x, l_orderkey % 8 AS y,
  min(l_linenumber) AS alpha FROM lineitem GROUP BY ALL) WHERE alpha <= 2),
kept AS (SELECT m.page, m.x, m.y FROM mask m JOIN mask n ON m.page = n.page AND abs(m.x - n.x) <= 1 AND abs(m.y - n.y) <= 1 GROUP BY ALL
  HAVING count(*) = (3 - (m.x = 0)::INT - (m.x = 7)::INT) * (3 - (m.y = 0)::INT - (m.y = 7)::INT)),
met AS (SELECT page, x AS fx, y AS fy, x, y FROM kept UNION SELECT r.page, r.fx, r.fy, k.x, k.y FROM met r JOIN kept k ON r.page = k.page
  AND abs(r.x - k.x) + abs(r.y - k.y) = 1),
named AS (SELECT page, fx AS x, fy AS y, min(y * 8 + x) AS blob FROM met GROUP BY ALL),
boxes AS (SELECT page, CAST(min(x) AS INT) AS x0, CAST(min(y) AS INT) AS y0, CAST(max(x) + 1 AS INT) AS x1, CAST(max(y) + 1 AS INT) AS y1,
  count(*) AS area FROM named GROUP BY page, blob),
regions AS (SELECT page, x0, y0, x1, y1, area FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY area DESC, y0, x0, x1, y1) AS k
  FROM boxes) WHERE k <= 6)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH tokens", "WITH RECURSIVE tokens", 1)


SQL["render_diff"] = _recursive(SQL["color_files"].split("SELECT DISTINCT hex, file")[0] + _REGIONS + " SELECT * FROM regions")
SQL["render_summary"] = _recursive(
    SQL["color_files"].split("SELECT DISTINCT hex, file")[0] + _REGIONS
    + " SELECT page, count(*) AS regions,"
        " CAST(count(DISTINCT struct_pack(x := round_even((x0 + x1) / 2 / 8 * 100, 0), y := round_even((y0 + y1) / 2 / 8 * 100, 0))) AS INT) AS spots"
            " FROM regions GROUP BY page"
)


@query(name="render_diff_tiles")
def render_diff_tiles(spark, d):
    """A14 in tiles of three pixels: most blobs cross a seam."""
    return preflight.diff_regions(page_mask(spark, d), least=1, tile=3)


SQL["render_diff_tiles"] = SQL["render_diff"]


@query("SELECT CAST(l_suppkey AS VARCHAR) AS page, l_suppkey % 2 = 0 AS had_content, CASE WHEN l_suppkey % 2 = 0 THEN"
    " round((max(l_partkey % 8) + 1 - min(l_partkey % 8)) * 10e0 / 96e0 + 8e0 / 72e0, 6) END AS width_in FROM lineitem GROUP BY l_suppkey")
def content_bbox_empty(spark, d):
    """A13 with padding, and pages where nothing shows."""
    pages, px = page_pixels(spark, d)
    shown = px.withColumn("alpha", F.when(F.col("page").cast("long") % 2 == 0, F.lit(9)).otherwise(0))
    return preflight.content_bbox(pages, shown, padding_pt=4.0).select("page", "had_content", F.round("width_in", 6).alias("width_in"))
