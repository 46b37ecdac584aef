"""Rules on a series' history: L1 to L6, and silence against the network (L3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.functions.selection import median_mad_of, with_median_mad
from gaugewright.functions.stats import DAY, HOUR, micros, pettitt, r_squared, slope
from gaugewright.operators.anomalies import anomaly
from gaugewright.operators.pieces import meet
from gaugewright.operators.series import SERIES, daily_median, last_days, trailing_run, with_last
from gaugewright.params import DEFAULTS, Params
from gaugewright.session import checkpointed


def _recent(m: DataFrame, span_us: int, keys: Sequence[str], open_start: bool = False) -> DataFrame:
    """Rows with ``age_us`` before the series' last and ``recent``: within the span, its start included or not. (FLT-04)"""
    aged = with_last(m, keys).withColumn("age_us", F.col("_last") - micros("ts")).drop("_last")
    return aged.withColumn("recent", F.col("age_us") < span_us if open_start else F.col("age_us") <= span_us)


def long_flatline(m: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = SERIES, sensors: Sequence[str] | None = None) -> DataFrame:
    """Level and discharge that end with a long run of one value; discharge may rest at zero. (L1, WIN-04)"""
    sensors = sensors if sensors is not None else (params.level, params.discharge)
    runs = trailing_run(m.where(F.col("sensor").isin(list(sensors))), keys)
    resting = (F.col("sensor") == params.discharge) & (F.col("value") == 0)
    return anomaly(runs.where((F.col("hours") >= params.flatline_long_h) & ~resting), "L1", "flatline_longue", "high", F.col("first_ts"), F.col("n"), F.col("hours"), params.flatline_long_h)


def drift(m: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = SERIES) -> DataFrame:
    """Slope per day of each series over its last days, and the days until the no-return and alert levels. (L2, AGG-13)"""
    recent = _recent(m, params.drift_window_days * DAY, keys).where("recent")
    x = -F.col("age_us") / float(DAY)
    s = recent.groupBy(*keys).agg(F.count("*").alias("n"), (F.max("age_us") / float(DAY)).alias("span_days"), slope(x, F.col("value")).alias("slope"), F.max_by("value", "ts").alias("last_value"), F.max("ts").alias("last_ts"))
    s = s.where((F.col("n") >= params.drift_min_rows) & (F.col("span_days") >= params.drift_min_days))
    falling = F.col("slope") < 0
    until = lambda level: F.when(falling & (F.col("last_value") > level), (F.col("last_value") - level) / -F.col("slope"))
    return s.withColumns({"days_to_no_return": F.when(falling, (F.col("last_value") - params.battery_no_return) / -F.col("slope")), "days_to_alert": until(params.battery_alert)})


def battery_drift(m: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = SERIES) -> DataFrame:
    """Batteries that fall by the drift or more; urgent within the given days. (L2)"""
    s = drift(m, params, keys).where(F.col("slope") <= -params.drift_per_day)
    severity = F.when(F.col("days_to_no_return") <= params.drift_urgent_days, "high").otherwise("medium")
    return anomaly(s, "L2", "batterie_derive", severity, F.col("last_ts"), F.col("n"), F.col("slope"), -params.drift_per_day)


def no_recharge(m: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = SERIES) -> DataFrame:
    """Batteries that used to reach the charging level and no longer do. (L2b, AGG-14, AGG-15)"""
    rows = _recent(m, params.drift_window_days * DAY, keys)
    charged = F.col("value") >= params.recharge_level
    s = rows.groupBy(*keys).agg(
        F.count_if("recent").alias("n_recent"), F.count_if(~F.col("recent")).alias("n_older"), F.max(F.when(F.col("recent"), F.col("value"))).alias("max_recent"),
        F.avg(F.when(~F.col("recent"), charged.cast("int"))).alias("share"), F.max(F.when(charged, F.col("ts"))).alias("last_charged"),
    )
    s = s.where((F.col("n_recent") >= params.drift_min_rows) & (F.col("n_older") >= params.recharge_min_rows) & (F.col("max_recent") < params.recharge_level) & (F.col("share") > params.recharge_share))
    return anomaly(s, "L2b", "batterie_charge_absente", "medium", F.col("last_charged"), F.col("n_recent"), F.col("max_recent"), params.recharge_level)


def silent_series(m: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = SERIES, hours: float | None = None) -> DataFrame:
    """Series whose last row lies hours or more before the network's. (L3, AGG-04)

    Each series is reduced to its last time before the network's clock, one row, joins it.
    """
    hours = params.silence_h if hours is None else hours
    last = m.groupBy(*keys).agg(F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    clock = last.agg(F.max("last_ts").alias("_now"))
    lag = (micros("_now") - micros("last_ts")) / float(HOUR)
    s = last.crossJoin(F.broadcast(clock)).withColumn("lag_h", lag).where(F.col("lag_h") >= hours)  # one row
    return anomaly(s, "L3", "station_muette", "high", F.col("last_ts"), F.col("n"), F.col("lag_h"), hours)


def recent_outliers(m: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = SERIES, recent_h: float = 24.0) -> DataFrame:
    """The most extreme recent value far from the history's median, in scaled MADs. (L4, AGG-07)"""
    rows = _recent(m, int(recent_h * HOUR), keys, open_start=True)
    old = rows.where("not recent")
    older = meet(old.groupBy(*keys).agg(F.count("*").alias("n_older")), median_mad_of(old, keys), keys)
    far = rows.where("recent").join(older.where((F.col("n_older") >= params.outlier_min_rows) & (F.col("mad") > 0)), list(keys)).withColumn("off", F.abs(F.col("value") - F.col("med"))).where(F.col("off") > params.outlier_k * params.mad_scale * F.col("mad"))
    s = far.groupBy(*keys).agg(F.count("*").alias("n"), F.min("ts").alias("at"), F.max_by("value", F.struct("off", (-micros("ts")).alias("back"))).alias("extreme"), F.first("med").alias("med"))
    return anomaly(s, "L4", "valeur_inhabituelle", "medium", F.col("at"), F.col("n"), F.col("extreme"), F.col("med"))


def trend(m: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = SERIES) -> DataFrame:
    """Recent slope per day, R squared and span of each series against its history's MAD and range. (L5, AGG-13)"""
    rows = _recent(m, params.drift_window_days * DAY, keys)
    x, v = -F.col("age_us") / float(DAY), F.col("value")
    now = rows.where("recent").groupBy(*keys).agg(F.count("*").alias("n"), (F.max("age_us") / float(DAY)).alias("span_days"), slope(x, v).alias("slope"), r_squared(x, v).alias("r2"), F.min("ts").alias("at"))
    old = rows.where("not recent")
    older = meet(old.groupBy(*keys).agg(F.count("*").alias("n_older"), (F.max("value") - F.min("value")).alias("range")), median_mad_of(old, keys), keys)
    return now.join(older, list(keys))


def continuous_trend(m: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = SERIES) -> DataFrame:
    """Steady recent trends that leave the history's spread behind. (L5)"""
    s = trend(m, params, keys).withColumn("move", F.abs(F.col("slope") * F.col("span_days")))
    limit = F.greatest(5 * params.mad_scale * F.col("mad"), 0.1 * F.col("range"))
    s = s.withColumn("limit", limit).where((F.col("n") >= params.trend_min_rows) & (F.col("span_days") >= params.trend_min_days) & (F.col("n_older") >= params.trend_min_history) & (F.col("r2") >= params.trend_r2) & (F.col("move") > F.col("limit")))
    return anomaly(s, "L5", "tendance_continue", "medium", F.col("at"), F.col("n"), F.col("move"), F.col("limit"))


def mean_shift(m: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = SERIES) -> DataFrame:
    """Change point of each series' daily medians with both segments' median and MAD, and whether it is a rupture. (L6)

    Columns: n, idx, at, p, med1, med2, shift, limit, rupture.
    """
    days = daily_median(m, keys)
    value_range = days.groupBy(*keys).agg((F.max("median_value") - F.min("median_value")).alias("range"))
    test = pettitt(days, keys, "day", "median_value").where(F.col("n") >= params.shift_min_days)
    cut = days.join(test.select(*keys, "at"), list(keys)).withColumn("seg", F.when(F.col("day") <= F.col("at"), 1).otherwise(2))
    spread = with_median_mad(cut, [*keys, "seg"], "median_value")
    pick = lambda seg, c: F.max(F.when(F.col("seg") == seg, F.col(c)))
    both = spread.groupBy(*keys).agg(pick(1, "med").alias("med1"), pick(2, "med").alias("med2"), pick(1, "mad").alias("mad1"), pick(2, "mad").alias("mad2"))
    s = test.join(both, list(keys)).join(value_range, list(keys)).withColumns({"shift": F.abs(F.col("med2") - F.col("med1")), "limit": F.greatest((F.col("mad1") + F.col("mad2")) * params.mad_scale, 0.05 * F.col("range"))})
    inside = (F.col("idx") >= params.shift_margin_days) & (F.col("idx") <= F.col("n") - params.shift_margin_days)
    return s.withColumn("rupture", (F.col("p") < params.shift_p) & inside & (F.col("shift") > F.col("limit")))


def mean_shift_anomalies(m: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = SERIES) -> DataFrame:
    """Ruptures of the mean. (L6)"""
    s = mean_shift(m, params, keys).where("rupture")
    return anomaly(s, "L6", "rupture_moyenne", "medium", F.col("at").cast("timestamp_ntz"), F.col("n"), F.col("shift"), F.col("limit"))


def rule_applicability(m: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = SERIES) -> DataFrame:
    """Which history rules each series has enough data for, by the audit's own approximations."""
    s = m.groupBy(*keys).agg(F.count("*").alias("n"), ((micros(F.max("ts")) - micros(F.min("ts"))) / float(DAY)).alias("days"))
    return s.withColumns({
        "can_l1": F.col("days") * 24 >= params.flatline_long_h, "can_l2": (F.col("n") >= params.drift_min_rows) & (F.col("days") >= params.drift_min_days), "can_l4": (F.col("n") >= params.outlier_min_rows) & (F.col("days") >= 1),
        "can_l5": (F.col("n") >= params.trend_min_rows + params.trend_min_history) & (F.col("days") >= params.drift_window_days + params.trend_min_days), "can_l6": F.col("days") >= params.shift_min_days,
    })


def long_term_anomalies(m: DataFrame, params: Params = DEFAULTS, keys: Sequence[str] = SERIES) -> DataFrame:
    """All history rules: each sensor's own on the last days of its history, the mean shift on all of it.

    A series of fewer than three readings in those days is not judged, but for its silence. The tail is
    written once, for five rules read it.
    """
    tail = last_days(m, params.history_days, keys).where("value is not null")
    tail = checkpointed(meet(tail, tail.groupBy(*keys).agg(F.count("*").alias("_n")), keys).where(F.col("_n") >= params.history_min_rows).drop("_n"))
    enough = tail.select(*keys).distinct()
    water = F.col("sensor").isin(params.level, params.discharge)
    power = tail.where(F.col("sensor") == params.battery)
    out = long_flatline(tail, params, keys)
    for part in (battery_drift(power, params, keys), no_recharge(power, params, keys), recent_outliers(tail.where(water), params, keys), continuous_trend(tail.where(water), params, keys), mean_shift_anomalies(m.where(water).join(enough, list(keys), "left_semi"), params, keys), silent_series(m, params, keys)):
        out = out.unionByName(part)
    return out
