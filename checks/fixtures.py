"""The given tables in the roles the operators expect (see FIXTURES.md).

``Tables`` is the Spark form, ``BASE_SQL`` the same definitions for the SQL side.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcurve.functions.times import as_timestamp
from loadcurve.operators.timeseries import deduplicate_ordered

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

# Readings are taken as kBTU and converted to kWh.
KBTU_PER_KWH = 3.412142

DAILY_MEASURES = ["temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m"]
DAILY_TIES = ["l_orderkey", "l_linenumber", "relative_humidity_2m", "l_partkey", "l_suppkey"]

BASE_SQL = """
WITH readings AS (
  SELECT user_id AS unique_id, ts AS "timestamp",
         CASE WHEN event_type <> 'error' THEN value / CAST(3.412142 AS DOUBLE) END AS y
  FROM events
), demand AS (
  SELECT user_id AS unique_id, ts AS "timestamp",
         CASE WHEN event_type <> 'error' THEN value / CAST(3.412142 AS DOUBLE) END AS y
  FROM events WHERE event_type <> 'click'
), metadata AS (
  SELECT c_custkey AS unique_id,
         CASE WHEN c_nationkey <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS location_id,
         CASE WHEN c_nationkey <> 0 THEN n_name END AS location,
         r_name AS dataset, c_mktsegment AS building_class, c_acctbal AS cluster_size
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), weather_raw AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS location_id, date_trunc('hour', ts) AS "timestamp",
         value AS temperature_2m, event_id
  FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'click'
), weather AS (
  SELECT location_id, "timestamp", temperature_2m FROM weather_raw
  QUALIFY row_number() OVER (PARTITION BY location_id, "timestamp" ORDER BY event_id) = 1
), orders_demand AS (
  SELECT o_custkey AS unique_id, o_orderdate AS "timestamp",
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / CAST(3.412142 AS DOUBLE) END AS y, o_orderkey
  FROM orders
), daily_raw AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS location_id, l_shipdate AS "timestamp",
         l_quantity AS temperature_2m, l_extendedprice AS relative_humidity_2m,
         l_discount AS precipitation, l_tax AS wind_speed_10m,
         l_linenumber AS weather_code, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS is_day,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
), daily AS (
  SELECT location_id, "timestamp", temperature_2m, relative_humidity_2m, precipitation, wind_speed_10m
  FROM daily_raw
  QUALIFY row_number() OVER (PARTITION BY location_id, "timestamp"
    ORDER BY l_orderkey, l_linenumber, relative_humidity_2m, l_partkey, l_suppkey) = 1
), merged AS (
  SELECT d.unique_id, d."timestamp", d.y, d.o_orderkey, m.location_id, m.building_class, m.cluster_size,
         w.temperature_2m, w.relative_humidity_2m, w.precipitation, w.wind_speed_10m
  FROM orders_demand d LEFT JOIN metadata m ON d.unique_id = m.unique_id
  LEFT JOIN daily w ON m.location_id = w.location_id AND date_trunc('hour', d."timestamp") = w."timestamp"
)
"""


class Tables:
    """One scale's tables; every attribute is a lazy frame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}.parquet"

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def _events(self) -> DataFrame:
        return as_timestamp(self.raw("events").withColumnRenamed("ts", "timestamp"))

    def _as_readings(self, events: DataFrame) -> DataFrame:
        y = F.when(F.col("event_type") != "error", F.col("value") / KBTU_PER_KWH)
        return events.select(F.col("user_id").alias("unique_id"), "timestamp", y.alias("y"))

    @cached_property
    def readings(self) -> DataFrame:
        """Irregular readings; faulty ones have no value."""
        return self._as_readings(self._events())

    @cached_property
    def demand(self) -> DataFrame:
        """Readings without the events that play the weather."""
        return self._as_readings(self._events().filter(F.col("event_type") != "click"))

    @cached_property
    def metadata(self) -> DataFrame:
        located = F.col("c_nationkey") != 0
        return (
            self.raw("customer")
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("c_custkey").alias("unique_id"),
                F.when(located, F.col("c_nationkey").cast("string")).alias("location_id"),
                F.when(located, F.col("n_name")).alias("location"),
                F.col("r_name").alias("dataset"),
                F.col("c_mktsegment").alias("building_class"),
                F.col("c_acctbal").alias("cluster_size"),
            )
        )

    @cached_property
    def weather_raw(self) -> DataFrame:
        clicks = self._events().filter(F.col("event_type") == "click")
        return clicks.join(self.raw("customer"), F.col("user_id") == F.col("c_custkey")).select(
            F.col("c_nationkey").cast("string").alias("location_id"),
            F.date_trunc("hour", "timestamp").alias("timestamp"),
            F.col("value").alias("temperature_2m"),
            "event_id",
        )

    @cached_property
    def weather(self) -> DataFrame:
        return deduplicate_ordered(self.weather_raw, ["location_id", "timestamp"], ["event_id"]).drop("event_id")

    @cached_property
    def orders_demand(self) -> DataFrame:
        """Order totals per customer; pending ones have no value."""
        y = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / KBTU_PER_KWH)
        return as_timestamp(self.raw("orders").withColumnRenamed("o_orderdate", "timestamp")).select(
            F.col("o_custkey").alias("unique_id"), "timestamp", y.alias("y"), "o_orderkey"
        )

    @cached_property
    def daily_raw(self) -> DataFrame:
        lines = as_timestamp(self.raw("lineitem").withColumnRenamed("l_shipdate", "timestamp"))
        return lines.join(self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
            F.col("s_nationkey").cast("string").alias("location_id"),
            "timestamp",
            F.col("l_quantity").alias("temperature_2m"),
            F.col("l_extendedprice").alias("relative_humidity_2m"),
            F.col("l_discount").alias("precipitation"),
            F.col("l_tax").alias("wind_speed_10m"),
            F.col("l_linenumber").alias("weather_code"),
            F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("is_day"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        )

    @cached_property
    def daily(self) -> DataFrame:
        """One measurement row per location and day."""
        unique = deduplicate_ordered(self.daily_raw, ["location_id", "timestamp"], DAILY_TIES)
        return unique.select("location_id", "timestamp", *DAILY_MEASURES)

    @cached_property
    def merged(self) -> DataFrame:
        from loadcurve.operators.joins import METADATA_COLUMNS, join_metadata, join_weather

        located = join_metadata(self.orders_demand, self.metadata, METADATA_COLUMNS)
        return join_weather(located, self.daily, size_bound=self.daily_raw)
