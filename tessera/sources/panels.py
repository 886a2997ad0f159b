"""Adapters from stored tables to the engine's inputs (bars, macro series, scored news)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of each brand: asset, date, open, high, low, close, adj_close, volume."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("asset"))
    line = read(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
    x = line.join(part, line["l_partkey"] == part["p_partkey"]).withColumn("date", F.trunc("l_shipdate", "week"))
    by_day = x.groupBy("asset", "date", "l_shipdate").agg(
        F.sum("l_extendedprice").alias("ep"), F.sum("l_quantity").alias("q"), F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("hi"),
        F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("lo"), F.sum("l_discount").alias("d"), F.count("l_discount").alias("n"),
    )
    return by_day.groupBy("asset", "date").agg(
        F.min_by(F.col("ep") / F.col("q"), "l_shipdate").alias("open"), F.max("hi").alias("high"), F.min("lo").alias("low"),
        (F.sum("ep") / F.sum("q")).alias("close"), (F.sum("ep") / F.sum("q") * (1 - F.sum("d") / F.sum("n"))).alias("adj_close"), F.sum("q").alias("volume"),
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series of each market segment: indicator, date, adj_close, source."""
    o = read(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"), "o_totalprice")
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("indicator"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("indicator", "date").agg(F.avg("o_totalprice").alias("adj_close")).withColumn("source", F.lit("yf"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored news: article_id, ticker, group_key, valid_time, raw_score and class probabilities."""
    e = read(spark, sf_dir, "events")
    v = F.when(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") > 0), F.col("value"))
    s = F.coalesce((v - 50) / (v + 50), F.lit(0.0))
    pos, neg = F.greatest(s, F.lit(0.0)), F.greatest(-s, F.lit(0.0))
    return e.select(
        F.col("event_id").alias("article_id"), F.col("user_id").alias("ticker"), F.col("event_type").alias("group_key"), F.col("ts").cast("timestamp").alias("valid_time"),
        s.alias("raw_score"), pos.alias("p_pos"), neg.alias("p_neg"), (1 - pos - neg).alias("p_neu"),
    )


# The same adapters as DuckDB common table expressions, for the oracle.
BARS_SQL = """px AS (SELECT p_brand AS asset, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_shipdate, l_quantity AS q, l_extendedprice AS ep, l_discount AS d
  FROM lineitem JOIN part ON l_partkey = p_partkey),
dy AS (SELECT asset, date, l_shipdate, sum(ep) / sum(q) AS vwap FROM px GROUP BY ALL),
op AS (SELECT asset, date, arg_min(vwap, l_shipdate) AS open FROM dy GROUP BY ALL),
bars AS (SELECT asset, date, any_value(open) AS open, max(ep / q) AS high, min(ep / q) AS low, sum(ep) / sum(q) AS close, sum(ep) / sum(q) * (1 - avg(d)) AS adj_close, sum(q) AS volume
  FROM px JOIN op USING (asset, date) GROUP BY asset, date)"""
MACRO_SQL = """macro AS (SELECT c_mktsegment AS indicator, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS adj_close FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
NEWS_SQL = """news AS (SELECT event_id AS article_id, user_id AS ticker, event_type AS group_key, ts AS valid_time, s AS raw_score, greatest(s, 0.0) AS p_pos, greatest(-s, 0.0) AS p_neg, 1 - greatest(s, 0.0) - greatest(-s, 0.0) AS p_neu
  FROM (SELECT *, coalesce((v - 50) / (v + 50), 0.0) AS s FROM (SELECT *, CASE WHEN value IS NOT NULL AND NOT isnan(value) AND value > 0 THEN value END AS v FROM events)))"""
