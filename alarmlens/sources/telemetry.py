"""The long telemetry table: one row a sample, with its index t inside its segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


def in_segment() -> WindowSpec:
    """A segment's samples in order."""
    return Window.partitionBy("channel", "segment").orderBy("t")


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as telemetry: a channel is an event type, a segment a calendar day (counted from 1970); every fifth day counts as anomalous, every fourth as held out."""
    day = F.unix_date(F.col("ts").cast("date")).cast("long")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("channel"), day.alias("segment"), "ts", "event_id", "user_id", "value")
    t = F.row_number().over(Window.partitionBy("channel", "segment").orderBy("ts", "event_id")) - 1
    return rows.select(
        "channel",
        "segment",
        t.cast("long").alias("t"),
        "value",
        F.when(F.col("segment") % 5 == 0, 1).otherwise(0).alias("anomaly"),
        F.when(F.col("segment") % 4 != 0, 1).otherwise(0).alias("train"),
        (F.col("user_id") % 28).alias("cluster"),
    )


def differences(samples: DataFrame) -> DataFrame:
    """Adds d (first difference) and d2 (second), each on the later sample of its pair."""
    rows = samples.withColumn("d", F.col("value") - F.lag("value").over(in_segment()))
    return rows.withColumn("d2", F.col("d") - F.lag("d").over(in_segment()))


#: The same in SQL, for oracles.
TELEMETRY_SQL = """days AS (SELECT *, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS dy FROM events),
tele AS (
  SELECT event_type AS channel, CAST(dy AS BIGINT) AS segment,
    row_number() OVER (PARTITION BY event_type, dy ORDER BY ts, event_id) - 1 AS t, value,
    CASE WHEN dy % 5 = 0 THEN 1 ELSE 0 END AS anomaly, CASE WHEN dy % 4 <> 0 THEN 1 ELSE 0 END AS train, user_id % 28 AS cluster
  FROM days),
dif1 AS (SELECT *, value - lag(value) OVER (PARTITION BY channel, segment ORDER BY t) AS d FROM tele),
dif AS (SELECT *, d - lag(d) OVER (PARTITION BY channel, segment ORDER BY t) AS d2 FROM dif1)"""
