"""The driver's tables as the operators' inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.time import epoch_us

HOUR = 3_600_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed_events(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """Events as timed blocks: a user is a file, an event lasts round(value * 600) seconds."""
    e = read(spark, sf_dir, "events")
    if kinds:
        e = e.where(F.col("event_type").isin(*kinds))
    start = epoch_us("ts")
    return e.select(
        F.col("user_id").alias("file"), F.col("event_id").alias("pos"), F.lit(None).cast("int").alias("ordinal"), start.alias("start_us"),
        (start + F.round(F.col("value") * 600).cast("long") * 1_000_000).alias("end_us"), F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")).alias("text"), "event_type", "value", "props", "ts",
    )


#: The same in SQL.
EVENTS_SQL = """ev AS (
  SELECT user_id AS file, event_id AS pos, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 600) AS BIGINT) * 1000000 AS e,
         event_type, event_type || ' ' || event_id AS text, value, props, ts FROM events
)"""
