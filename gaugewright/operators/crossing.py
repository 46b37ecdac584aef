"""Rain against the level of the same station: rain without a response (L7)."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.functions.selection import exact_median_of
from gaugewright.functions.stats import DAY, HOUR, micros
from gaugewright.operators.anomalies import anomaly
from gaugewright.operators.pieces import meet
from gaugewright.operators.series import last_before, rolling_sum
from gaugewright.params import DEFAULTS, Params
from gaugewright.session import stored


#: Microseconds of rain whose surroundings one task looks at.
_SPAN = 2 * DAY


def _windows(asked: dict[str, np.ndarray], us: np.ndarray, values: np.ndarray, null: np.ndarray) -> dict[str, list]:
    """Of readings sorted by time: rows and median over [a, d], rows and greatest over (d, b], for each (a, d, b) in order of d.

    Windows slide: each reading enters and leaves a sorted list, or a queue of falling values, once. A NaN
    is greater than any number.
    """
    order = np.lexsort((values, np.isnan(values)))
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    low, mid = np.searchsorted(us, asked["a"], "left"), np.searchsorted(us, asked["d"], "right")
    high = np.maximum(np.searchsorted(us, asked["b"], "right"), mid)
    by_rank, ranks = values[order].tolist(), rank.tolist()
    held: list[int] = []
    falling: deque[int] = deque()
    out: dict[str, list] = {"n_before": (mid - low).tolist(), "base": [], "n_after": (high - mid).tolist(), "peak": []}
    left, entered, seen = 0, 0, 0
    for lo, at, hi in zip(low.tolist(), mid.tolist(), high.tolist()):  # noqa: B905
        for i in range(entered, at):
            if not null[i]:
                insort(held, ranks[i])
        for i in range(left, lo):
            if not null[i]:
                del held[bisect_left(held, ranks[i])]
        for i in range(seen, hi):
            if not null[i]:
                while falling and ranks[falling[-1]] <= ranks[i]:
                    falling.pop()
                falling.append(i)
        while falling and falling[0] < at:
            falling.popleft()
        left, entered, seen, k = lo, at, hi, len(held)
        one, two = (by_rank[held[(k - 1) // 2]], by_rank[held[k // 2]]) if k else (None, None)
        out["base"].append(one if one == two or k % 2 else 0.5 * one + 0.5 * two)
        out["peak"].append(by_rank[ranks[falling[0]]] if falling else None)
    return out


def _around(asked: DataFrame, level: DataFrame, before_h: int, window: int, after_h: int) -> DataFrame:
    """What the level did around each time of rain (station, ts, u, d): station, ts, n_before and base over [d - before_h, d], n_after and peak over (d, u + after_h].

    ``asked`` has a row a station and time, ``window`` is u - d. Rain is dealt by spans of d, and a
    reading goes to the spans from which it is reached; no pair of the two is a row.
    """
    lead, reach = before_h * HOUR, window + after_h * HOUR
    span = lambda c: F.floor(c / _SPAN)
    left = asked.select("station", "ts", "d", "u", span(F.col("d")).alias("_span"))
    right = level.where("ts is not null").select("station", micros("ts").alias("us"), F.col("value").cast("double").alias("value"))
    right = right.withColumn("_span", F.explode(F.sequence(span(F.col("us") - reach), span(F.col("us") + lead))))

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        one, two = one.sort_by("d"), two.sort_by("us")
        d = one["d"].to_numpy()
        found = _windows({"a": d - lead, "d": d, "b": one["u"].to_numpy() + after_h * HOUR}, two["us"].to_numpy(), two["value"].to_numpy(), two["value"].is_null().to_numpy())
        return pa.table({"station": one["station"], "ts": one["ts"], "n_before": pa.array(found["n_before"], pa.int64()), "base": pa.array(found["base"], pa.float64()), "n_after": pa.array(found["n_after"], pa.int64()), "peak": pa.array(found["peak"], pa.float64())})

    schema = "station string, ts timestamp_ntz, n_before long, base double, n_after long, peak double"
    by = ["station", "_span"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema)


def response_candidates(rain: DataFrame, level: DataFrame, params: Params = DEFAULTS, min_rain: int = 10, min_level: int = 50) -> DataFrame:
    """Every time of heavy rain with its ``verdict``, before suppression: signal, response, or the guard that abstains. (WIN-08, JN-08, JN-11)

    Rows: station, ts, mm, base, peak, verdict. Rain and level are (station, ts, value), uncleaned
    (Q-15). Guards are those of the rule: a drought before the rain, too few readings before or
    after it, and a level that is already high.
    """
    window = params.response_rain_h * HOUR
    wet = rolling_sum(rain, params.response_rain_h, ["station"], "mm").withColumn("u", micros("ts"))
    enough = rain.groupBy("station").agg(F.count("*").alias("n")).where(F.col("n") >= min_rain).select("station")
    stats = level.groupBy("station").agg(F.count("*").alias("_n"), F.min("value").alias("low")).where(F.col("_n") >= min_level).drop("_n")
    stats = meet(stats, exact_median_of(level, ["station"], "value", "med").drop("n"), ["station"])
    heavy = wet.where(F.round("mm", 9) >= params.response_rain_mm).join(enough, "station", "left_semi").join(stats, "station")
    # the last rain before a window is looked for from its start
    begins = heavy.select("station", F.timestamp_micros(F.col("u") - window).cast("timestamp_ntz").alias("ts")).distinct()
    last = last_before(begins, rain.select("station", "ts", "value"), F.col("value") > 0, ["station"]).select("station", micros("ts").alias("d"), micros("last_ts").alias("last_wet"))
    heavy = heavy.select("station", "ts", "mm", "med", "low", "u", (F.col("u") - window).alias("d")).join(last, ["station", "d"], "left")
    heavy = stored(heavy)
    # rain of one time is asked for once; its readings count for each row, as a join would pair them
    asked = heavy.groupBy("station", "ts", "u", "d").agg(F.count("*").alias("_rows"))
    around = _around(asked, level, 12, window, params.response_h)
    around = around.join(asked.select("station", "ts", "_rows"), ["station", "ts"]).withColumns({c: F.col(c) * F.col("_rows") for c in ("n_before", "n_after")}).drop("_rows")
    s = heavy.join(around, ["station", "ts"], "left")
    dry = (F.col("d") - F.col("last_wet")) > params.response_drought_days * DAY
    verdict = (
        F.when(F.coalesce(dry, F.lit(False)), "drought")
        .when(F.coalesce(F.col("n_before"), F.lit(0)) < 3, "few_before")
        .when(F.col("base") > F.col("med") + params.already_high * (F.col("med") - F.col("low")), "already_high")
        .when(F.col("n_after") < 5, "few_after")
        .when(F.col("peak") - F.col("base") < params.response_rise, "signal")
        .otherwise("response")
    )
    return s.select("station", "ts", "mm", "base", "peak", verdict.alias("verdict"))


def suppress(signals: DataFrame, hours: float, keys: tuple[str, ...] = ("station",)) -> DataFrame:
    """Of each key's signals in order, those at least ``hours`` after the last one that stayed.

    Each verdict depends on the last, so times are folded in order. A signal that comes as long after
    its predecessor stays whatever became of that one, so a fold never goes beyond such a gap.
    """
    gap, at = int(hours * HOUR), micros("ts")
    order = Window.partitionBy(*keys).orderBy("_u")
    times = signals.select(*keys, at.alias("_u")).distinct()
    begins = F.coalesce((F.col("_u") - F.lag("_u").over(order) >= gap).cast("int"), F.lit(1))
    stretches = times.withColumn("_b", begins).withColumn("_s", F.sum("_b").over(order)).groupBy(*keys, "_s").agg(F.array_sort(F.collect_list("_u")).alias("t"))
    empty = F.array().cast("array<bigint>")
    kept = F.aggregate(F.col("t"), empty, lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) >= gap), F.array_append(acc, x)).otherwise(acc))
    stays = stretches.select(*keys, F.explode(kept).alias("_u"))
    return signals.withColumn("_u", at).join(stays, [*keys, "_u"], "left_semi").drop("_u")


def rain_without_response(rain: DataFrame, level: DataFrame, params: Params = DEFAULTS, min_rain: int = 10, min_level: int = 50) -> DataFrame:
    """Heavy rain that the level does not answer; signals suppress those soon after them. (L7)"""
    signals = response_candidates(rain, level, params, min_rain, min_level).where("verdict = 'signal'")
    s = suppress(signals, params.response_h).withColumn("sensor", F.lit(params.level))
    severity = F.when(F.col("mm") >= 2 * params.response_rain_mm, "high").otherwise("medium")
    return anomaly(s, "L7", "pluie_sans_reponse", severity, F.col("ts"), None, F.col("mm"), params.response_rain_mm)
