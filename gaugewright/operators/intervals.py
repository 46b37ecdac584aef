"""Interval joins: events with a time range against readings inside it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.functions.stats import DAY, micros


def interval_join(events: DataFrame, readings: DataFrame, keys: Sequence[str], low: str, high: str, bucket_us: int = DAY) -> DataFrame:
    """Readings (keys, ts, value as r_ts, r_value) within [low, high] (microseconds) of each event with the same keys. (JN-09, JN-10)

    Both sides meet on the keys and the time bucket, so the join is an equi join whose partitions
    hold a bucket's rows, however long the series; an event goes to each bucket that it touches.
    """
    touched = F.explode(F.sequence(F.floor(F.col(low) / bucket_us), F.floor(F.col(high) / bucket_us)))
    left = events.withColumn("_bucket", touched)
    right = readings.select(*keys, F.col("ts").alias("r_ts"), F.col("value").alias("r_value"), micros("ts").alias("r_us"))
    right = right.withColumn("_bucket", F.floor(F.col("r_us") / bucket_us))
    joined = left.join(right, [*keys, "_bucket"]).where((F.col("r_us") >= F.col(low)) & (F.col("r_us") <= F.col(high)))
    return joined.drop("_bucket")
