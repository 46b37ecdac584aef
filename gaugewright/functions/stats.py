"""Statistics of series as columns and aggregates: time arithmetic, median and MAD, OLS, change point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000_000, 86_400_000_000


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp (the session's zone is UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def hours_between(a: Column, b: Column) -> Column:
    return (micros(b) - micros(a)) / F.lit(float(HOUR))


def days_between(a: Column, b: Column) -> Column:
    return (micros(b) - micros(a)) / F.lit(float(DAY))


def exact_median(value: Column | str) -> Column:
    """The exact median; of an even count the mean of the two middle values. (AGG-06)"""
    return F.percentile(value, F.lit(0.5))


def lowest_mode(value: Column | str) -> Column:
    """The most frequent value, the lowest of several. (AGG-09)"""
    return F.mode(value, True)


def slope(x: Column, y: Column) -> Column:
    """Least-squares slope of y over x. (AGG-13)"""
    return F.regr_slope(y, x)


def r_squared(x: Column, y: Column) -> Column:
    """Coefficient of determination; 0 where y is constant. (AGG-13)"""
    return F.when(F.max(y) == F.min(y), F.lit(0.0)).otherwise(F.coalesce(F.regr_r2(y, x), F.lit(0.0)))


def average_rank(keys: Sequence[str], value: str) -> Column:
    """Rank within the group, ties at their mean. (WIN-10)"""
    tied = Window.partitionBy(*keys, value)
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(tied) - 1) / F.lit(2.0)


def pettitt(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Pettitt's change-point test of each group: n, k, idx (position of the first segment's last row, from 0), at and p. (WIN-10, WIN-11, L6)

    The greatest absolute statistic wins, the earliest on ties.
    """
    by = list(keys)
    ranked = df.withColumn("_r", average_rank(by, value)).withColumns({"_t": F.row_number().over(Window.partitionBy(*by).orderBy(order)), "_n": F.count("*").over(Window.partitionBy(*by))})
    run = F.sum("_r").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    stat = ranked.withColumn("_u", 2 * run - F.col("_t") * (F.col("_n") + 1)).where(F.col("_t") < F.col("_n"))
    best = stat.groupBy(*by).agg(F.max(F.struct(F.abs("_u").alias("k"), (-F.col("_t")).alias("back"), F.col(order).alias("at"), F.col("_n").alias("n"))).alias("b"))
    n, k = F.col("b.n").cast("double"), F.col("b.k")
    p = F.least(F.lit(1.0), 2 * F.exp(-6 * k * k / (n * n * n + n * n)))
    return best.select(*by, F.col("b.n").alias("n"), k.alias("k"), (-F.col("b.back") - 1).cast("long").alias("idx"), F.col("b.at").alias("at"), p.alias("p"))


def weighted_mean(weight: Column, value: Column) -> Column:
    return F.sum(weight * value) / F.sum(weight)


def inverse_square(distance_km: Column) -> Column:
    """Weight 1 / d squared with d at least 1 km. (AGG-19)"""
    return 1 / F.pow(F.greatest(distance_km, F.lit(1.0)), F.lit(2.0))


def first_few(item: Column, n: int) -> Column:
    """The n smallest values, without nulls, of a group whose size is bounded, such as a station's neighbours on a day. (SRT-04)"""
    return F.slice(F.array_sort(F.collect_list(item)), 1, n)
