"""The generated tables as tiers of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import iso


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def references(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("seq"), F.col("lang").alias("tenant_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("doc_key"), F.col("text").alias("body"), F.lit("2024-01-01T00:00:00.000Z").alias("updated_at"))


def parts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    body = F.concat(F.lit('{"name":"'), "p_name", F.lit('","type":"'), "p_type", F.lit('","size":'), F.col("p_size").cast("string"), F.lit("}"))
    return p.select(F.col("p_partkey").alias("seq"), F.lit("shop").alias("tenant_id"), F.concat(F.lit("part/"), "p_brand").alias("category"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.lit(None).cast("string").alias("status"), body.alias("body"), F.lit("2024-01-01T00:00:00.000Z").alias("updated_at"), F.lit("2024-01-01T00:00:00.000Z").alias("created_at"))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    body = F.concat(F.lit('{"priority":"'), "o_orderpriority", F.lit('"}'))
    ts = iso(F.col("o_orderdate"))
    return o.select(F.col("o_orderkey").alias("seq"), F.lit("shop").alias("tenant_id"), F.lit("order").alias("category"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderstatus").alias("status"), body.alias("body"), ts.alias("updated_at"), ts.alias("created_at"))


def journal(spark: SparkSession, sf: str) -> DataFrame:
    """Events: acted is a list of the type and a tenth of k, evaluated an object keyed by both."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    acted = F.concat(F.lit('["'), "event_type", F.lit(" "), F.floor(k / 10).cast("string"), F.lit('x"]'))
    evaluated = F.concat(F.lit('{"'), "event_type", F.lit('":1,"bucket-'), F.floor(k / 25).cast("string"), F.lit('":'), k.cast("string"), F.lit("}"))
    nothing = F.lit(None).cast("string")
    return e.select(F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("id"), (F.col("user_id") % 3).cast("string").alias("tenant_id"), iso(F.col("ts")).alias("ts"), evaluated.alias("evaluated"), acted.alias("acted"), nothing.alias("forward"), nothing.alias("extra"))


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as entities under region/nation/segment."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    small = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # 25 rows at any scale
    path = F.concat_ws("/", "r_name", "n_name", "c_mktsegment")
    rows = c.join(F.broadcast(small), c.c_nationkey == small.n_nationkey)
    body = F.concat(F.lit('{"kind":"'), F.lower("c_mktsegment"), F.lit('","nation":'), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, ',"vip":true').otherwise(""), F.when(F.col("c_custkey") % 5 == 0, ',"nation_text":"x"').otherwise(""), F.lit("}"))
    return rows.select(F.col("c_custkey").alias("seq"), F.lit("shop").alias("tenant_id"), path.alias("category"), F.col("c_name").alias("name"), body.alias("body"), F.lit("2024-01-01T00:00:00.000Z").alias("updated_at"), F.lit("2024-01-01T00:00:00.000Z").alias("created_at"))
