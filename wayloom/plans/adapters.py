"""The engine's tables made from the driver's: the same mapping as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"
OBS_NOW = "1997-06-01 00:00:00"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def samples(self) -> DataFrame:
        e = self.read("events").where("value > 0 and value < 250")
        return e.select(F.col("user_id").alias("sensor_key"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("observed_at"), F.col("value").alias("speed_kph"))

    def events(self) -> DataFrame:
        return self.read("events").withColumn("ts", F.col("ts").cast("timestamp"))

    def segments(self) -> DataFrame:
        k = F.col("s_suppkey")
        ax, ay = F.lit(4.0) + (k % 97) * 0.01, F.lit(50.0) + (k % 89) * 0.01
        s = self.read("supplier").select(k.alias("sid"), ax.alias("ax"), ay.alias("ay"), (ax + 0.004 + (k % 5) * 0.001).alias("bx"), (ay + (k % 7) * 0.001).alias("by"), (k % 6).cast("int").alias("class"), (k % 3).cast("int").alias("ref_no"))
        return s.withColumns({"highway": F.element_at(F.array(*[F.lit(x) for x in HIGHWAYS]), F.col("class") + 1), "ref": F.concat(F.lit("A"), F.col("ref_no"))})

    def obs(self) -> DataFrame:
        o = self.read("orders")
        ts = F.col("o_orderdate").cast("timestamp")
        sev = F.when(F.col("o_orderpriority").startswith("1"), "critical").when(F.col("o_orderpriority").startswith("2"), "high").when(F.col("o_orderpriority").startswith("3"), "medium").when(F.col("o_orderpriority").startswith("4"), "low").otherwise("unknown")
        lon, lat = F.lit(4.0) + (F.col("o_custkey") % 1000) * 0.002, F.lit(50.0) + (F.col("o_custkey") % 777) * 0.002
        return o.select(
            F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("type"), sev.alias("severity"), ts.alias("valid_from"), (ts + F.expr("interval 90 days")).alias("valid_to"),
            F.when(F.col("o_orderkey") % 3 == 0, ts + F.expr("interval 60 days")).alias("expires_at"), F.when(F.col("o_orderkey") % 10 == 0, "suspended").otherwise("active").alias("status"), F.when(F.col("o_orderkey") % 4 == 0, "crowd").otherwise("feed").alias("origin_kind"),
            (F.col("o_orderkey") % 8 == 0).alias("routing_eligible"), F.when(F.col("o_orderkey") % 5 == 0, "authoritative").when(F.col("o_orderkey") % 5 == 1, "restricted").alias("privacy_class"), F.col("o_totalprice").alias("price"),
            lon.alias("min_lon"), lon.alias("max_lon"), lat.alias("min_lat"), lat.alias("max_lat"), F.col("o_custkey").alias("cust"),
        )


HIGHWAYS = ["motorway", "trunk", "primary", "secondary", "tertiary", "residential"]

SAMPLES = "samples AS (SELECT user_id AS sensor_key, event_type AS source, ts AS observed_at, value AS speed_kph FROM events WHERE value > 0 AND value < 250)"
BINS = SAMPLES + """,
bins AS (SELECT sensor_key, date_trunc('hour', observed_at) AS hour, least(greatest(floor(speed_kph / 2.0), 0), 127)::INTEGER AS bin, count(*)::BIGINT AS c, min(source) AS source
  FROM samples GROUP BY 1, 2, 3)"""
SEGMENTS = """segments AS (SELECT *, ['motorway', 'trunk', 'primary', 'secondary', 'tertiary', 'residential'][class + 1] AS highway, 'A' || ref_no AS ref FROM (
  SELECT s_suppkey AS sid, 4.0::DOUBLE + (s_suppkey % 97) * 0.01::DOUBLE AS ax, 50.0::DOUBLE + (s_suppkey % 89) * 0.01::DOUBLE AS ay,
  4.0::DOUBLE + (s_suppkey % 97) * 0.01::DOUBLE + 0.004::DOUBLE + (s_suppkey % 5) * 0.001::DOUBLE AS qx, 50.0::DOUBLE + (s_suppkey % 89) * 0.01::DOUBLE + (s_suppkey % 7) * 0.001::DOUBLE AS qy,
  (s_suppkey % 6)::INTEGER AS class, (s_suppkey % 3)::INTEGER AS ref_no FROM supplier))"""
OBS = """obs AS (SELECT o_orderkey AS id, o_orderpriority AS source, o_orderstatus AS type,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'unknown' END AS severity,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 4 WHEN '2' THEN 3 WHEN '3' THEN 2 WHEN '4' THEN 1 ELSE 0 END AS rank,
  o_orderdate AS valid_from, o_orderdate + INTERVAL 90 DAY AS valid_to, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 60 DAY END AS expires_at,
  CASE WHEN o_orderkey % 10 = 0 THEN 'suspended' ELSE 'active' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN 'crowd' ELSE 'feed' END AS origin_kind, o_orderkey % 8 = 0 AS routing_eligible,
  CASE o_orderkey % 5 WHEN 0 THEN 'authoritative' WHEN 1 THEN 'restricted' END AS privacy_class, o_totalprice AS price,
  4.0::DOUBLE + (o_custkey % 1000) * 0.002::DOUBLE AS lon, 50.0::DOUBLE + (o_custkey % 777) * 0.002::DOUBLE AS lat, o_custkey AS cust, TIMESTAMP '1997-06-01 00:00:00' AS now FROM orders)"""
LIVE = "status = 'active' AND valid_to > now AND (expires_at IS NULL OR expires_at > now)"


def haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"(2 * 6371000.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"
