"""Exact quantiles of groups that no task could hold: a bracket by mergeable sketches, then counts inside it.

``percentile`` keeps every distinct value of a group in one task. Here a group's values are first
summarised (each task a bounded sketch), which gives two values that the quantile's neighbours lie
between for certain; rows below are counted, and only those between, some thousandths of the group,
are counted by value. No pass holds a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.operators.pieces import meet
from gaugewright.session import stored

#: A sketch's ranks are off by less than one in this many rows.
ACCURACY = 10_000


def exact_quantile_of(df: DataFrame, keys: Sequence[str], value: str, p: float = 0.5, name: str = "quantile", accuracy: int = ACCURACY) -> DataFrame:
    """The keys, ``n`` (values that aren't null) and the quantile of each group, interpolated between its neighbours as ``percentile`` does. (AGG-06)

    A group without values has no row. A NaN counts as greater than any number. All values of a group
    of up to 4 * accuracy are its bracket. That the bracket holds both neighbours is checked by exact
    counts; a sketch that broke its promise would be an error, not a wrong result.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    margin = 2.0 / accuracy
    at = F.array(F.lit(max(0.0, p - margin)), F.lit(min(1.0, p + margin)))
    known = df.groupBy(*keys).agg(F.count(value).alias("n"), F.percentile_approx(F.col(value).cast("double"), at, F.lit(accuracy)).alias("_b"), F.min(F.col(value).cast("double")).alias("_lo"), F.max(F.col(value).cast("double")).alias("_hi"))
    # the sketch's error and the margin leave room for the neighbours from some 3 / error rows on; fewer are all counted
    few = F.col("n") <= 4 * accuracy
    known = stored(known.select(*keys, "n", F.when(few, F.col("_lo")).otherwise(F.col("_b")[0]).alias("_lo"), F.when(few, F.col("_hi")).otherwise(F.col("_b")[1]).alias("_hi")))  # a row a group: Spark knows its size and broadcasts it if it is small
    # the quantile lies between the ranks floor and ceil of (n - 1) * p, counted from 0
    placed = meet(rows, known, keys).where("_v <= _hi or isnan(_hi)")
    inside = F.when(F.col("_v") < F.col("_lo"), F.lit(None)).otherwise(F.col("_v"))
    counted = placed.groupBy(*keys, inside.alias("_v")).agg(F.count("*").alias("_c"), F.first("n").alias("n"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    rank = (F.col("n") - 1) * F.lit(p)
    low, high = F.floor(rank), F.ceil(rank)
    holds = lambda r: (F.col("_upto") > r) & (F.col("_upto") - F.col("_c") <= r)
    found = counted.withColumn("_upto", upto).groupBy(*keys).agg(F.first("n").alias("n"), F.max(F.when(holds(low), F.struct("_v"))).alias("_a"), F.max(F.when(holds(high), F.struct("_v"))).alias("_z"))
    a, z = F.col("_a._v"), F.col("_z._v")
    between = F.when(low == high, a).otherwise((high - rank) * a + (rank - low) * z)
    checked = F.when(a.isNull() | z.isNull(), F.raise_error(F.lit("the bracket misses the quantile")).cast("double")).otherwise(between)
    return found.select(*keys, "n", checked.alias(name))


def exact_median_of(df: DataFrame, keys: Sequence[str], value: str, name: str = "median_value", accuracy: int = ACCURACY) -> DataFrame:
    """The keys, ``n`` and the exact median of each group; of an even count the mean of the two middle values. (AGG-06)"""
    return exact_quantile_of(df, keys, value, 0.5, name, accuracy)


def median_mad_of(df: DataFrame, keys: Sequence[str], value: str = "value", accuracy: int = ACCURACY) -> DataFrame:
    """The keys, ``med`` and ``mad``, the median absolute deviation, of each group. (AGG-07)"""
    med = stored(exact_median_of(df, keys, value, "med", accuracy).drop("n"))  # a row a group
    off = meet(df.select(*keys, value), med, keys).withColumn("_off", F.abs(F.col(value) - F.col("med")))
    return meet(med, exact_median_of(off, keys, "_off", "mad", accuracy).drop("n"), keys)


def lowest_mode_of(df: DataFrame, keys: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """The keys and the most frequent value of each group that isn't null, the lowest of several, from counts by value. (AGG-09)"""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("_c"), (-F.col(value)).alias("back"))).alias(name))


def with_median_mad(df: DataFrame, keys: Sequence[str], value: str = "value", prefix: str = "", accuracy: int = ACCURACY) -> DataFrame:
    """Median and median absolute deviation of each group, beside its rows. (AGG-07)"""
    found = median_mad_of(df, keys, value, accuracy)
    return meet(df, found.withColumnsRenamed({"med": f"{prefix}med", "mad": f"{prefix}mad"}), keys)
