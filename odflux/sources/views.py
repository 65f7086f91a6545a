"""Trip, event and zone views over the star-schema tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trips from customer nation to supplier nation; days between order and shipping are read as minutes."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    order = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    fare = F.col("l_extendedprice") / 100
    return joined.select(
        (F.col("c_nationkey") + 1).alias("pu"),
        (F.col("s_nationkey") + 1).alias("do"),
        F.col("o_orderdate").alias("t0"),
        F.expr("o_orderdate + make_dt_interval(0, 0, datediff(l_shipdate, o_orderdate), 0)").alias("t1"),
        fare.alias("fare"),
        (fare * (1 + F.col("l_tax"))).alias("total"),
        F.col("l_quantity").alias("dist"),
        (fare * F.col("l_discount")).alias("tip"),
        F.col("l_linenumber").alias("rate"),
    )


ORDER_TRIPS = """raw AS (
  SELECT c_nationkey + 1 AS pu, s_nationkey + 1 AS do_, o_orderdate AS t0, o_orderdate + to_minutes(date_diff('day', o_orderdate, l_shipdate)) AS t1,
    l_extendedprice / 100 AS fare, (l_extendedprice / 100) * (1 + l_tax) AS total, l_quantity AS dist, (l_extendedprice / 100) * l_discount AS tip, l_linenumber AS rate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


def event_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions between a user's consecutive events: o and d are numbers of event types in alphabetical order."""
    events = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    types = events.select("event_type").distinct().select("event_type", F.row_number().over(Window.orderBy("event_type")).alias("zone"))
    numbered = events.join(F.broadcast(types), "event_type")
    later = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = numbered.select("user_id", F.col("zone").alias("o"), F.lead("zone").over(later).alias("d"), F.col("ts").alias("t0"), F.lead("ts").over(later).alias("t1"), "value").where("d is not null")
    return pairs.select("o", "d", "t0", "t1", "value", F.weekday("t0").alias("wd"), F.hour("t0").alias("hr"), F.month("t0").alias("mo"))


EVENT_TRIPS = """types AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) AS INTEGER) AS zone FROM (SELECT DISTINCT event_type FROM events)),
paired AS (SELECT zone AS o, lead(zone) OVER w AS d, ts AS t0, lead(ts) OVER w AS t1, value FROM events JOIN types USING (event_type) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
ev AS (SELECT *, CAST(isodow(t0) - 1 AS INTEGER) AS wd, CAST(hour(t0) AS INTEGER) AS hr, CAST(month(t0) AS INTEGER) AS mo FROM paired WHERE d IS NOT NULL)"""


def sparse_edges(spark: SparkSession, sf_dir: str, modulus: int = 200) -> DataFrame:
    """Edges between customer and part classes: a sparser graph than that of nations."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    order = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    keyed = joined.select((F.col("o_custkey") % modulus).cast("int").alias("o"), (F.col("l_partkey") % modulus).cast("int").alias("d"))
    return keyed.groupBy("o", "d").agg(F.count(F.lit(1)).alias("trips"))


SPARSE_EDGES = """sparse AS (SELECT CAST(o_custkey % 200 AS INTEGER) AS o, CAST(l_partkey % 200 AS INTEGER) AS d, count(*) AS trips FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone dimension from nations; two zones have no coordinates."""
    nation = read(spark, sf_dir, "nation")
    region = read(spark, sf_dir, "region")
    n = F.col("n_nationkey")
    known = ~n.isin(3, 17)
    service = F.when(n % 3 == 0, "Yellow Zone").when(n % 3 == 1, "Boro Zone").otherwise("Airports")
    return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(
        (n + 1).alias("zone_id"),
        F.col("n_name").alias("zone"),
        F.col("r_name").alias("borough"),
        service.alias("service_zone"),
        F.when(known, ((n * 7919) % 25) * 5280.0).alias("cx_ft"),
        F.when(known, ((n * 104729) % 23) * 5280.0).alias("cy_ft"),
    )


ZONES = """zones AS (
  SELECT n_nationkey + 1 AS zone_id, n_name AS zone, r_name AS borough,
    CASE n_nationkey % 3 WHEN 0 THEN 'Yellow Zone' WHEN 1 THEN 'Boro Zone' ELSE 'Airports' END AS service_zone,
    CASE WHEN n_nationkey NOT IN (3, 17) THEN CAST((n_nationkey * 7919) % 25 AS DOUBLE) * 5280 END AS cx_ft,
    CASE WHEN n_nationkey NOT IN (3, 17) THEN CAST((n_nationkey * 104729) % 23 AS DOUBLE) * 5280 END AS cy_ft
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
