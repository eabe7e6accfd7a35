"""Networks built from the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str, value: str = "count") -> DataFrame:
    """(t, i, j, y): items, or their price, from supplier nation i to customer nation j in year t; absent pairs are not rows."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("t"))
    buyers = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("j"))
    sellers = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("i"))
    # orders are cut down to year and nation first, so the large side is joined with narrow rows
    placed = orders.join(buyers, orders.o_custkey == buyers.c_custkey).select("o_orderkey", "t", "j")
    joined = items.join(sellers, items.l_suppkey == sellers.s_suppkey).join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    y = F.count("*").cast("double") if value == "count" else F.sum("l_extendedprice")
    return joined.groupBy("t", "i", "j").agg(y.alias("y"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(actor, region, w_acctbal, w_nsupp): mean customer balance and number of suppliers."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("actor"), F.col("n_regionkey").cast("string").alias("region"))
    balance = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("actor")).agg(F.avg("c_acctbal").alias("w_acctbal"))
    supply = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("actor")).agg(F.count("*").cast("double").alias("w_nsupp"))
    return n.join(balance, "actor", "left").join(supply, "actor", "left").select("actor", "region", "w_acctbal", F.coalesce("w_nsupp", F.lit(0.0)).alias("w_nsupp"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, i, j, y): 1 for each customer i and supplier j with a common item."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    pairs = items.join(orders, items.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").cast("string").alias("i"), F.col("l_suppkey").cast("string").alias("j")).distinct()
    return pairs.select(F.lit(0).alias("t"), "i", "j", F.lit(1.0).alias("y"))


def spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, items, price, discount): customer i's items from supplier j, what they cost, and their mean discount in tenths."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    pairs = items.join(orders, items.l_orderkey == orders.o_orderkey).groupBy(F.col("o_custkey").cast("string").alias("i"), F.col("l_suppkey").cast("string").alias("j"))
    return pairs.agg(F.count("*").cast("double").alias("items"), F.sum("l_extendedprice").cast("double").alias("price"), (10 * F.avg("l_discount")).cast("double").alias("discount"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, i, j, y, x): events of user i of type j in week t, and the sum of their values."""
    e = read(spark, sf_dir, "events")
    week = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01")) / 7).cast("int")
    return e.groupBy(week.alias("t"), F.col("user_id").cast("string").alias("i"), F.col("event_type").alias("j")).agg(F.count("*").cast("double").alias("y"), F.sum("value").alias("x"))


def nested_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chain, draw, term, value): event values as draws of one parameter, a chain for each event type."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events")
    order = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return e.select(F.col("event_type").alias("chain"), F.row_number().over(order).alias("draw"), F.lit("value").alias("term"), "value")


#: The same networks as DuckDB or Spark SQL.
TRADE_SQL = """trade AS (
  SELECT CAST(year(o.o_orderdate) AS INTEGER) AS t, CAST(s.s_nationkey AS VARCHAR(9)) AS i, CAST(c.c_nationkey AS VARCHAR(9)) AS j, CAST(count(*) AS DOUBLE) AS y
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
  GROUP BY 1, 2, 3
)"""
PURCHASES_SQL = """purchases AS (
  SELECT DISTINCT CAST(o.o_custkey AS VARCHAR(9)) AS i, CAST(l.l_suppkey AS VARCHAR(9)) AS j FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
)"""
SPENDING_SQL = """spending AS (
  SELECT CAST(o.o_custkey AS VARCHAR(9)) AS i, CAST(l.l_suppkey AS VARCHAR(9)) AS j, CAST(count(*) AS DOUBLE) AS items, CAST(sum(l.l_extendedprice) AS DOUBLE) AS price, CAST(10 * avg(l.l_discount) AS DOUBLE) AS discount
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2
)"""
ACTIVITY_SQL = """activity AS (
  SELECT CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7.0) AS INTEGER) AS t, CAST(user_id AS VARCHAR(9)) AS i, event_type AS j, CAST(count(*) AS DOUBLE) AS y, sum(value) AS x
  FROM events GROUP BY 1, 2, 3
)"""
DRAWS_SQL = """draws AS (
  SELECT event_type AS chain, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INTEGER) AS draw, 'value' AS term, value FROM events
)"""
