"""Lists and filters of stations and series: what tables on a page show."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.functions.stats import exact_median
from gaugewright.operators.series import SERIES
from gaugewright.params import DEFAULTS, Params


def series_scan(m: DataFrame, station: str, sensor: str) -> DataFrame:
    """One series in order of time. Both conditions reach the scan; facts laid out by sensor are pruned by folder. (SRC-08)"""
    return m.where((F.col("sensor") == sensor) & (F.col("station") == station)).orderBy("ts")


def between_times(m: DataFrame, start=None, end=None) -> DataFrame:
    """Rows from start to end, both included; None leaves a side open. (FLT-05)"""
    for bound, inside in ((start, lambda t, x: t >= x), (end, lambda t, x: t <= x)):
        if bound is not None:
            m = m.where(inside(F.col("ts"), F.lit(bound).cast("timestamp_ntz")))
    return m


def search(df: DataFrame, pattern: str, name: str = "nom", code: str = "code_station") -> DataFrame:
    """Rows whose name in lower case, or code, has a match of the pattern, a regular expression in lower case. Blank finds all. (FLT-08)"""
    wanted = pattern.strip().lower()
    return df.where(F.lower(name).rlike(wanted) | F.col(code).rlike(wanted)) if wanted else df


def in_state(df: DataFrame, state: str | None = None, region: str | None = None) -> DataFrame:
    """Stations of one state and region (columns etat and gouvernorat), in the order of region and name. (FLT-09, SRT-07)"""
    for column, wanted in (("etat", state), ("gouvernorat", region)):
        if wanted is not None:
            df = df.where(F.col(column) == wanted)
    return df.orderBy("gouvernorat", "nom")


def measures(kind: Column) -> tuple[Column, Column]:
    """Whether a station of this kind measures rain, and whether levels, by a part of the kind's name. (FLT-10)"""
    return F.contains(kind, F.lit("luvio")), F.contains(kind, F.lit("ydro"))


def with_altitude(states: DataFrame, altitudes: DataFrame) -> DataFrame:
    """States with the station's altitude_m, null where it isn't known. (JN-02)"""
    return states.join(altitudes.select("code_station", "altitude_m"), "code_station", "left")


def not_among(df: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are not among the known ones: stations seen and not configured, or without an origin. (JN-07, SET-03)"""
    return df.join(known.select(*keys), list(keys), "left_anti")


def series_list(m: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """The series that there are, in order. (AGG-03)"""
    return m.select(*keys).distinct().orderBy(*keys)


def change_signature(m: DataFrame, *keys: str) -> DataFrame:
    """What tells whether anything was added: the count and the last time, of all rows or of each key's. (AGG-05)"""
    return m.groupBy(*keys).agg(F.concat_ws("|", F.count("*").cast("string"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss")).alias("signature"))


def sensor_extremes(m: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = SERIES) -> DataFrame:
    """Least, median, greatest and 0.95 quantile of each series, its amplitude, and for rain the total and the wet steps (else null). (AGG-26, AGG-28)"""
    v, rain = F.col("value"), F.col("sensor") == params.rain
    s = m.groupBy(*keys).agg(F.count("*").alias("n"), F.min(v).alias("low"), exact_median(v).alias("med"), F.max(v).alias("high"), F.percentile(v, F.lit(0.95)).alias("q95"), F.sum(v).alias("_total"), F.count_if(v > 0).alias("_wet"))
    return s.select(*keys, "n", "low", "med", "high", "q95", (F.col("high") - F.col("low")).alias("amplitude"), F.when(rain, F.col("_total")).alias("rain_total"), F.when(rain, F.col("_wet")).alias("n_wet"))


def worst_sensors(lags: DataFrame, by: str = "lag_h") -> DataFrame:
    """Each station's sensor of the greatest delay, the first by name on ties. (WIN-13)"""
    order = Window.partitionBy("station").orderBy(F.desc(by), "sensor")
    return lags.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
