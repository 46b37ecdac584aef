"""Instant rules on one file or day of series: battery, correction and R1 to R9.

Input rows are (station, sensor, ts, value), with low, high and corrects for the bounds rules and
code for silence; each rule gives anomalies of the one shape. ``keys`` may add a block column, so
that the same rules run per block or on merged series (Q-16).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.functions.selection import exact_median_of, lowest_mode_of
from gaugewright.operators.anomalies import anomaly
from gaugewright.operators.pieces import meet
from gaugewright.operators.series import SERIES, out_of_range, value_runs, with_step
from gaugewright.params import DEFAULTS, Params


def battery_levels(m: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = SERIES) -> DataFrame:
    """Battery beyond return, else on alert; and overcharged. ``battery_details`` has the rows behind an alert. (BAT-a, BAT-b, BAT-c)"""
    v = F.col("value")
    dead, alert, over = v <= params.battery_no_return, (v > params.battery_no_return) & (v <= params.battery_alert), v > params.battery_overcharge
    s = m.groupBy(*keys).agg(*[x for n, p in (("dead", dead), ("alert", alert), ("over", over)) for x in (F.count_if(p).alias(f"n_{n}"), F.min(F.when(p, F.col("ts"))).alias(f"ts_{n}"))], F.min("value").alias("lowest"), F.max("value").alias("highest"))
    a = anomaly(s.where("n_dead > 0"), "BAT-a", "batterie_non_retour", "high", F.col("ts_dead"), F.col("n_dead"), F.col("lowest"), params.battery_no_return)
    b = anomaly(s.where("n_dead = 0 and n_alert > 0"), "BAT-b", "batterie_decharge", "high", F.col("ts_alert"), F.col("n_alert"), F.col("lowest"), params.battery_alert)
    c = anomaly(s.where("n_over > 0"), "BAT-c", "batterie_surcharge", "medium", F.col("ts_over"), F.col("n_over"), F.col("highest"), params.battery_overcharge)
    return a.unionByName(b).unionByName(c)


def battery_details(m: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = SERIES, first: int = 10) -> DataFrame:
    """The first readings on alert of each battery that never was beyond return: keys, rank, ts, value. (BAT-b, SRT-04)"""
    v = F.col("value")
    order = Window.partitionBy(*keys).orderBy("ts", "value")
    dead = m.groupBy(*keys).agg(F.min("value").alias("_low")).where(F.col("_low") > params.battery_no_return).select(*keys)
    alert = m.where((v > params.battery_no_return) & (v <= params.battery_alert)).join(dead, list(keys), "left_semi")
    return alert.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first).select(*keys, "rank", "ts", "value")


def correct(m: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Values out of bounds replaced where the sensor corrects: value_raw, value, corrected. (R8, AGG-08, FLT-02)

    The replacement is the rounded median of the series' valid values; 0 if the series has no other
    row, null if its other rows have no values.
    """
    bad = out_of_range() & F.coalesce(F.col("corrects"), F.lit(False))
    flagged = m.withColumn("_bad", bad)
    others = flagged.groupBy(*keys).agg(F.count_if(~F.col("_bad")).alias("_others"))
    valid = meet(others, exact_median_of(flagged.where("not _bad"), keys, "value", "_med").drop("n"), keys)
    replacement = F.when(F.col("_others") == 0, F.lit(0.0)).otherwise(F.bround("_med", 2))
    joined = flagged.join(valid, list(keys))
    return joined.withColumnRenamed("value", "value_raw").withColumns({"value": F.when(F.col("_bad"), replacement).otherwise(F.col("value_raw")), "corrected": F.col("_bad")}).drop("_bad", "_med", "_others")


def _counted(df: DataFrame, keys: Sequence[str], rule: str, kind: str, severity: str, metric: Column, threshold=None) -> DataFrame:
    s = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("ts").alias("at"), metric.alias("metric"))
    return anomaly(s, rule, kind, severity, F.col("at"), F.col("n"), F.col("metric"), threshold)


def range_anomalies(m: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Values out of bounds that are only flagged. (R2)"""
    return _counted(m.where(out_of_range() & ~F.coalesce(F.col("corrects"), F.lit(False))), keys, "R2", "out_of_range", "high", F.max(F.abs("value")))


def corrected_anomalies(m: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Values that ``correct`` replaced. (R8)"""
    return _counted(m.where("corrected"), keys, "R8", "out_of_range_corrected", "high", F.max(F.abs("value_raw")))


def silent_codes(m: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Count, distinct sorted codes and first and last time of rows with a code. (R9, AGG-30)"""
    return m.where("code is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("code")), ", ").alias("codes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def negative_values(m: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Values below zero; not for sensors whose lower bound is negative. (R1, Q-21)"""
    return _counted(m.where("value < 0 and coalesce(low, 0) >= 0"), keys, "R1", "negative_value", "high", F.min("value"), 0.0)


def flatline_full(m: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = SERIES, quiet_zero: Sequence[str] | None = None, min_rows: int = 3) -> DataFrame:
    """Series of one single value, but for sensors that rest at zero. (R3, AGG-11)"""
    quiet = list(quiet_zero if quiet_zero is not None else (params.rain, params.discharge))
    s = m.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("value").alias("d"), F.min("value").alias("v"), F.min("ts").alias("at"))
    resting = F.col("sensor").isin(quiet) & (F.col("v") == 0) if quiet else F.lit(False)
    return anomaly(s.where((F.col("n") >= min_rows) & (F.col("d") == 1) & ~resting), "R3", "flatline_full", "high", F.col("at"), F.col("n"), F.col("v"))


def flatline_longest(m: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = SERIES, quiet_zero: Sequence[str] | None = None) -> DataFrame:
    """The longest run of equal values of each series that is not wholly flat, if it lasts long enough; the first on ties. (R3, WIN-03, AGG-16)"""
    quiet = list(quiet_zero if quiet_zero is not None else (params.rain, params.discharge))
    runs = value_runs(m, keys)
    runs = runs.where(~(F.col("sensor").isin(quiet) & (F.col("value") == 0))) if quiet else runs
    best = runs.groupBy(*keys).agg(F.max_by(F.struct("value", "n", "first_ts", "hours"), F.struct(F.col("hours"), (-F.unix_micros(F.col("first_ts").cast("timestamp"))).alias("back"))).alias("r"))
    varied = m.groupBy(*keys).agg(F.count_distinct("value").alias("d")).where("d > 1").select(*keys)
    s = best.join(varied, list(keys), "left_semi").where(F.col("r.hours") >= params.flatline_part_h)
    return anomaly(s, "R3", "flatline_partial", "medium", F.col("r.first_ts"), F.col("r.n"), F.col("r.hours"), params.flatline_part_h)


def all_zeros(m: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Series of zeros only; a null value breaks it. (R4, AGG-12)"""
    s = m.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("value") == 0, F.lit(False))).alias("zero"), F.count("*").alias("n"), F.min("ts").alias("at"))
    return anomaly(s.where("zero"), "R4", "all_zeros", "low", F.col("at"), F.col("n"), F.lit(0.0))


def duplicate_timestamps(m: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """All rows that share their time with another of the series. (R5, WIN-12)"""
    return m.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "ts"))).where("_n > 1").drop("_n")


def steps_against_mode(m: DataFrame, factor: float = 1.5, keys: Sequence[str] = SERIES) -> DataFrame:
    """Rows with step_s, the series' mode step and ``kind``: irregular (R6), gap (R7) or null. (AGG-09)"""
    stepped = with_step(m, keys)
    usual = meet(stepped.groupBy(*keys).agg(F.count("*").alias("_n")), lowest_mode_of(stepped, keys, "step_s", "mode_s"), keys)
    far = F.col("step_s") > factor * F.col("mode_s")
    kind = F.when(F.col("_n") > 2, F.when(far, "gap").when(F.col("step_s") != F.col("mode_s"), "irregular"))
    return stepped.join(usual, list(keys)).withColumn("kind", kind).drop("_n")


def step_anomalies(m: DataFrame, factor: float = 1.5, keys: Sequence[str] = SERIES) -> DataFrame:
    """Irregular steps and gaps of each series. (R6, R7)"""
    rows = steps_against_mode(m, factor, keys)
    odd = _counted(rows.where("kind = 'irregular'"), keys, "R6", "irregular_timestep", "medium", F.max("step_s"))
    return odd.unionByName(_counted(rows.where("kind = 'gap'"), keys, "R7", "missing_data_gap", "high", F.max("step_s")))


def instant_anomalies(m: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = SERIES) -> DataFrame:
    """All instant rules after correction, with those disabled that a sensor rules out: flatlines and zeros for batteries."""
    fixed = correct(m, keys)
    live = fixed.where(F.col("sensor") != params.battery)
    parts = [
        battery_levels(fixed.where(F.col("sensor") == params.battery), params, keys), range_anomalies(fixed, keys), corrected_anomalies(fixed, keys), negative_values(fixed, keys),
        flatline_full(live, params, keys), flatline_longest(live, params, keys), all_zeros(live, keys), step_anomalies(fixed, 1.5, keys),
        _counted(duplicate_timestamps(fixed, keys), keys, "R5", "duplicate_timestamps", "medium", F.count("*").cast("double")),
        _counted(fixed.where("code is not null"), keys, "R9", "capteur_muet_ponctuel", "medium", F.count("*").cast("double")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
