"""The library's tables, derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hexed(n: Column) -> Column:
    return F.format_string("#%06X", n)


def part_hex(key: Column) -> Column:
    return hexed(F.pmod(key * 7919 + 104729, F.lit(16777216)))


def color_tokens(spark, sf_dir, ordered: bool = False) -> DataFrame:
    """file, hex, context, raw and, if asked for (it costs a shuffle), ord."""
    rows = read(spark, sf_dir, "lineitem")
    out = rows.select(F.col("l_orderkey").cast("string").alias("file"), part_hex(F.col("l_partkey")).alias("hex"),
        F.when(F.col("l_linestatus") == "O", "@fill").otherwise("@stroke").alias("context"), part_hex(F.col("l_partkey")).alias("raw"),
            *(("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity") if ordered else ()))
    if ordered:
        out = out.withColumn("ord", F.row_number().over(W.partitionBy("file").orderBy("l_linenumber", "l_partkey", "l_suppkey",
            "l_extendedprice"))).drop("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return out


def global_map(spark, sf_dir) -> DataFrame:
    v = F.pmod(F.col("p_size") * 5, F.lit(256)).cast("int")
    return read(spark, sf_dir, "part").where("p_partkey % 5 = 0").select(F.lit("grayscale").alias("pipeline"),
        part_hex(F.col("p_partkey")).alias("source"), F.format_string("#%02X%02X%02X", v, v, v).alias("target"), F.col("p_type").alias("label"),
            F.lit("").alias("notes"), F.col("p_partkey").alias("ord"))


def overrides(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").where("(l_orderkey + l_linenumber) % 7 = 0")
    target = hexed(F.pmod(F.col("l_suppkey") * 50021, F.lit(16777216)))
    return rows.groupBy(F.col("l_orderkey").cast("string").alias("file"),
        part_hex(F.col("l_partkey")).alias("source")).agg(F.max(target).alias("target")).withColumn("pipeline", F.lit("grayscale"))


def slots(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").where("p_partkey % 11 = 0").select(F.concat(F.lit("slot."), F.col("p_partkey")).alias("name"),
        part_hex(F.col("p_partkey")).alias("authored"), F.col("p_type").alias("label"), F.lit("").alias("notes"), F.col("p_partkey").alias("ord"))


def themes(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").where("p_partkey % 11 = 0").select(F.lit("print").alias("theme"), F.lit("grayscale").alias("pipeline"),
        F.concat(F.lit("slot."), F.col("p_partkey")).alias("slot"), hexed(F.pmod(F.col("p_partkey") * 104651, F.lit(16777216))).alias("target"))


def illustrations(spark, sf_dir) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("file"), F.when(F.col("o_orderstatus") == "F", "reviewed").when(F.col("o_orderstatus") == "P",
            "in_progress").otherwise("pending").alias("status"),
        F.when(first.isin("1", "2"), "reviewed").when(first == "3", "exported").otherwise("pending").alias("cmyk_status"),
            (F.col("o_orderkey") % 3 == 0).alias("cmyk_auto_fix"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), F.lit("").alias("notes"),
    )


def svgs(spark, sf_dir) -> DataFrame:
    """One document a file, built from its ordered tokens (a file is small: its tokens are one document in the end)."""
    t = color_tokens(spark, sf_dir, ordered=True)
    width = F.format_string("%.2f", F.col("l_quantity").cast("double") / 50)
    rect = F.when(F.col("context") == "@fill", F.format_string('<rect fill="%s" width="1" height="1"/>',
        "hex")).otherwise(F.format_string('<line stroke="%s" stroke-width="%s"/>', F.col("hex"), width))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", rect.alias("x")))), lambda e: e["x"]), "")
    return t.groupBy("file").agg(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 100 100">'), body, F.lit("</svg>")).alias("content"))


def pixels_cmyk(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.pmod("l_partkey", F.lit(256)).alias("c"),
        F.pmod("l_orderkey", F.lit(256)).alias("m"), F.pmod(F.col("l_partkey") * 7, F.lit(256)).alias("ye"),
            F.pmod(F.col("l_orderkey") * 3, F.lit(256)).alias("k"))


def status_events(spark, sf_dir) -> DataFrame:
    kinds = {"view": "pending", "click": "in_progress", "purchase": "reviewed", "signup": "exported"}
    status = F.coalesce(F.create_map(*(F.lit(x) for p in kinds.items() for x in p))[F.col("event_type")], F.lit("unknown"))
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file"), F.col("ts"), status.alias("status"))
