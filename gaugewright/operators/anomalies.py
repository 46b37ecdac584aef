"""The one shape of an anomaly, its description and its order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("rule", "type", "severity", "station", "sensor", "ts", "n_points", "metric", "threshold")

SEVERITY = {"high": 0, "medium": 1, "low": 2}


def anomaly(df: DataFrame, rule: str, kind: str, severity: str | Column, ts: Column, n_points: Column | None = None, metric: Column | None = None, threshold: float | Column | None = None) -> DataFrame:
    """Rows of df (with station and sensor) as anomalies; the numeric evidence stays in columns."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        F.lit(rule).alias("rule"), F.lit(kind).alias("type"), lit(severity).alias("severity"), "station", "sensor", ts.alias("ts"),
        (n_points if n_points is not None else F.lit(None)).cast("long").alias("n_points"), (metric if metric is not None else F.lit(None)).cast("double").alias("metric"), lit(threshold).cast("double").alias("threshold"),
    )


def described(anomalies: DataFrame) -> DataFrame:
    """With a rendered description."""
    return anomalies.withColumn("description", F.format_string("%s %s/%s: %s (%s; limit %s)", "type", "station", "sensor", F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("-")), F.coalesce(F.format_number("metric", 2), F.lit("-")), F.coalesce(F.format_number("threshold", 2), F.lit("-"))))


def by_severity(df: DataFrame, *then: str) -> DataFrame:
    """Sorted high, medium, low, then by other columns. (SRT-02)"""
    rank = F.lit(len(SEVERITY))
    for name, k in SEVERITY.items():
        rank = F.when(F.col("severity") == name, k).otherwise(rank)
    return df.orderBy(rank, *then)


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Value counts, the most frequent first, with each one's share. (AGG-24, AGG-35)"""
    total = df.agg(F.count("*").alias("_total"))
    counts = df.groupBy(*keys).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))  # one row
    return counts.select(*keys, "n", (F.col("n") / F.col("_total")).alias("share")).orderBy(F.desc("n"), *keys)


def first_detection(members: DataFrame, m: DataFrame) -> DataFrame:
    """When each anomaly first shows: its earliest member's time, else its series' first. (AGG-34)

    ``members``: rule, station, sensor and ts of the readings that an anomaly names (null for none).
    """
    starts = m.groupBy("station", "sensor").agg(F.min("ts").alias("_first"))
    first = members.groupBy("rule", "station", "sensor").agg(F.min("ts").alias("ts"))
    return first.join(starts, ["station", "sensor"], "left").select("rule", "station", "sensor", F.coalesce("ts", "_first").alias("ts"))


def counters(states: DataFrame, *dims: str) -> DataFrame:
    """Stations by every combination of dimensions, with totals; a null dimension in the result is the total over it. (AGG-29)"""
    return states.cube(*dims).agg(F.count_distinct("station").alias("n"), F.grouping_id(*dims).alias("level"))
