"""Primitives on series: rows (station, sensor, ts, value) keyed by station and sensor.

Every function takes and returns DataFrames. What looks along a series works on its pieces (see
``operators.pieces``), so that no task needs to hold or sort a whole one; ``width`` is a piece's span.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.functions.selection import exact_median_of, lowest_mode_of
from gaugewright.functions.stats import DAY, HOUR, exact_median, micros
from gaugewright.operators import pieces
from gaugewright.params import DEFAULTS, Params
from gaugewright.session import stored

SERIES = ("station", "sensor")


def daily_median(m: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Exact median of each series and day. (AGG-06)"""
    return m.groupBy(*keys, F.to_date("ts").alias("day")).agg(exact_median("value").alias("median_value"), F.count("*").alias("n"))


def network_stats(m: DataFrame) -> DataFrame:
    """Readings, stations and the first and last time. (AGG-01)"""
    return m.agg(F.count("*").alias("n"), F.count_distinct("station").alias("n_stations"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def series_summary(m: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Rows, first and last time and mean step in minutes of each series. (AGG-02, AGG-31)"""
    span = (micros(F.max("ts")) - micros(F.min("ts"))) / 60e6
    return m.groupBy(*keys).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), (span / F.nullif(F.count("*") - 1, F.lit(0))).alias("step_min"))


def with_last(m: DataFrame, keys: Sequence[str] = SERIES, name: str = "_last") -> DataFrame:
    """Rows with the microseconds of their series' last time."""
    return pieces.meet(m, m.groupBy(*keys).agg(F.max(micros("ts")).alias(name)), keys)


def last_days(m: DataFrame, days: int, keys: Sequence[str] = SERIES) -> DataFrame:
    """The rows of each series in the days up to its own last one, bounds included. (SRC-09, SRC-10)"""
    return with_last(m, keys).where(micros("ts") >= F.col("_last") - days * DAY).drop("_last")


def with_step(m: DataFrame, keys: Sequence[str] = SERIES, name: str = "step_s", width: int = pieces.WIDTH) -> DataFrame:
    """Seconds since the previous row of the series. (WIN-01)"""
    told = pieces.with_previous(pieces.cut(m, width), keys, micros("ts"), "_before_us")
    return told.withColumn(name, (micros("ts") - F.col("_before_us")) / F.lit(1e6)).drop("_before_us", "_piece")


def value_runs(m: DataFrame, keys: Sequence[str] = SERIES, width: int = pieces.WIDTH) -> DataFrame:
    """Maximal runs of equal consecutive values: value, n, first_ts, last_ts and hours. A null belongs to none. (WIN-03)"""
    other = lambda p, c: ~(p["value"].eqNullSafe(c["value"]) & c["value"].isNotNull())
    runs = pieces.run_numbers(pieces.cut(m, width), keys, ["value"], other).where("value is not null")
    out = runs.groupBy(*keys, "_run").agg(F.first("value").alias("value"), F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.withColumn("hours", (micros("last_ts") - micros("first_ts")) / float(HOUR)).drop("_run")


def trailing_run(m: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """The run of equal values that each series ends with: value, first_ts, last_ts, n, hours. (WIN-04)

    Two aggregations and no window: the last value, and the last time at which the value was another;
    of rows of one time the greatest value counts as the last.
    """
    at = F.struct("ts", "value")
    last = m.groupBy(*keys).agg(F.max(at)["value"].alias("last_value"))
    joined = m.join(last, list(keys))
    other = joined.groupBy(*keys).agg(F.max(F.when(~F.col("value").eqNullSafe(F.col("last_value")), at)).alias("_other"))
    tail = joined.join(other, list(keys)).where(F.col("_other").isNull() | (at > F.col("_other")))
    out = tail.groupBy(*keys).agg(F.first("last_value").alias("value"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return out.withColumn("hours", (micros("last_ts") - micros("first_ts")) / float(HOUR))


def predicate_runs(df: DataFrame, predicate: Column, keys: Sequence[str] = SERIES, aggregates: Sequence[Column] = (), width: int = pieces.WIDTH) -> DataFrame:
    """Maximal runs of consecutive rows that satisfy a predicate: first_ts, last_ts, n and further aggregates. (WIN-05)"""
    flagged = pieces.cut(df.withColumn("_in", F.coalesce(predicate, F.lit(False))), width)
    runs = pieces.run_numbers(flagged, keys, ["_in"], lambda p, c: c["_in"] & ~p["_in"]).where("_in")
    return runs.groupBy(*keys, "_run").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), *aggregates).drop("_run")


def continuous_blocks(m: DataFrame, factor: float = 1.5, keys: Sequence[str] = SERIES, step: str = "median", width: int = pieces.WIDTH) -> DataFrame:
    """Blocks between gaps larger than factor times the series' usual step: first_ts, last_ts, n. (WIN-06)"""
    steps = with_step(m, keys, width=width).where("step_s is not null")
    usual = exact_median_of(steps, keys, "step_s", name="_usual") if step == "median" else lowest_mode_of(steps, keys, "step_s", "_usual")
    usual = stored(usual)  # a row a series
    rows = pieces.cut(pieces.meet(m, usual.select(*keys, "_usual"), keys), width).withColumn("_u", micros("ts"))
    gap = lambda p, c: (c["_u"] - p["_u"]) / F.lit(1e6) > factor * c["_usual"]
    blocks = pieces.run_numbers(rows, keys, ["_u", "_usual"], gap, "block").withColumn("block", F.col("block") - 1)
    return blocks.groupBy(*keys, "block").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def rolling_sum(m: DataFrame, hours: float, keys: Sequence[str] = SERIES, name: str = "rolling", width: int = pieces.WIDTH) -> DataFrame:
    """Sum over the half-open time frame (ts - hours, ts]. (WIN-08)

    Series are cut into buckets of a 24th of the frame at most. A frame is the end of the bucket that
    it begins in, whole buckets, and the start of its row's own: the two ends are running sums within a
    bucket and the middle is summed over buckets, so that a row costs the same however many its frame
    holds. Nothing is subtracted. Rows without a time are one frame.
    """
    keys, reach = list(keys), int(hours * HOUR) - 1
    bucket = max(1, min(width, (reach + 1) // 24))
    many = reach // bucket  # a frame begins so many buckets before its row's, or one more
    by, kept = [*keys, "_bucket"], list(m.columns)
    rows = m.withColumn("_u", micros("ts")).withColumn("_bucket", F.floor(F.col("_u") / bucket).cast("long"))
    along = Window.partitionBy(*keys).orderBy("_bucket")
    middle = lambda n: F.sum("_sum").over(along.rangeBetween(-n, -1)) if n > 0 else F.lit(None).cast("double")
    buckets = rows.where("_bucket is not null").groupBy(*by).agg(F.sum("value").alias("_sum"))
    # a bucket's own row comes before all others in it
    heads = buckets.select(*by, middle(many - 1).alias("_less"), middle(many).alias("_more"), F.lit(-(1 << 62)).alias("_u"))
    upto = Window.partitionBy(*by).orderBy("_u").rangeBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_row", F.lit(True)).unionByName(heads, allowMissingColumns=True)
    placed = placed.withColumns({"_start": F.sum(F.when(F.col("_row"), F.col("value"))).over(upto), "_less": F.max("_less").over(upto), "_more": F.max("_more").over(upto)}).where("_row")
    begin = F.floor((F.col("_u") - reach) / bucket).cast("long")
    placed = placed.withColumn("_mid", F.when(F.col("_bucket") - begin > many, F.col("_more")).otherwise(F.col("_less"))).drop("_less", "_more")
    asked = placed.withColumns({"_bucket": begin, "_u": F.col("_u") - reach})
    ends = rows.where("_bucket is not null").select(*by, "_u", F.col("value").alias("_end"))
    down = Window.partitionBy(*by).orderBy(F.desc("_u")).rangeBetween(Window.unboundedPreceding, 0)
    told = asked.unionByName(ends, allowMissingColumns=True).withColumn("_end", F.sum("_end").over(down)).where("_row")
    parts = [F.col(c) for c in ("_end", "_mid", "_start")]
    known = F.coalesce(*parts).isNotNull()
    return told.select(*[c for c in kept if c != name], F.when(known, sum((F.coalesce(c, F.lit(0.0)) for c in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))).alias(name))


def dense_daily(m: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Sum and count of every day between a series' first and last; 0 and 0 where it has no row. (AGG-17)"""
    days = m.groupBy(*keys, F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    range_ = days.groupBy(*keys).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    grid = range_.select(*keys, F.explode(F.sequence("a", "b")).alias("day"))
    return grid.join(days, [*keys, "day"], "left").select(*keys, "day", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("n", F.lit(0)).alias("n"))


def hourly_sum(m: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Sum of each tumbling hour. (AGG-18)"""
    return m.groupBy(*keys, F.window("ts", "1 hour").alias("w")).agg(F.sum("value").alias("total"), F.count("*").alias("n")).select(*keys, F.col("w.start").alias("hour"), "total", "n")


def with_limits(m: DataFrame, defaults: DataFrame, own: DataFrame) -> DataFrame:
    """Each row's bounds: the station's pair if both are set, else the sensor's default pair, else none. (PRJ-02, JN-01)

    ``defaults`` (sensor, d_low, d_high) and ``own`` (station, sensor, s_low, s_high) are dimensions;
    Spark broadcasts them when they are small enough.
    """
    pair = F.col("s_low").isNotNull() & F.col("s_high").isNotNull()
    joined = m.join(own, ["station", "sensor"], "left").join(defaults, "sensor", "left")
    return joined.withColumns({"low": F.when(pair, F.col("s_low")).otherwise(F.col("d_low")), "high": F.when(pair, F.col("s_high")).otherwise(F.col("d_high"))}).drop("s_low", "s_high", "d_low", "d_high")


def out_of_range() -> Column:
    """Outside low and high; a null value or a missing bound is not. (FLT-01)"""
    return F.coalesce((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")), F.lit(False))


def clean_split(m: DataFrame) -> DataFrame:
    """Rows (with low and high) with ``reason``: not finite, out of bounds, or null for those to keep. (SRC-11)"""
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    return m.withColumn("reason", F.when(~F.coalesce(finite, F.lit(False)), "not_finite").when(out_of_range(), "out_of_bounds"))


def drop_retransmissions(m: DataFrame) -> DataFrame:
    """Distinct station, sensor, ts and value. (SET-02)"""
    return m.dropDuplicates(["station", "sensor", "ts", "value"])


def insert_if_absent(facts: DataFrame, batch: DataFrame, ordinal: str, keys: Sequence[str] = ("station", "sensor", "ts")) -> DataFrame:
    """The rows of a batch that the fact table lacks, the first by ordinal of each key; null values never enter. (SNK-01, JN-06, FLT-03)"""
    first = Window.partitionBy(*keys).orderBy(ordinal)
    fresh = batch.where("value is not null").withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    return fresh.join(facts.select(*keys), list(keys), "left_anti")


def reconstruct(m: DataFrame, step_us: int, max_steps: int = DEFAULTS.max_filled_steps, keys: Sequence[str] = SERIES, width: int = pieces.WIDTH) -> DataFrame:
    """The series on a regular grid from its first point: value, and filled where it was interpolated. (WIN-16, WIN-17)

    Points off the grid are dropped (Q-24); gaps of up to ``max_steps`` grid points are filled by
    linear interpolation in time, points of longer ones are left out.
    """
    at = m.select(*keys, micros("ts").alias("u"), "value").groupBy(*keys, "u").agg(F.first("value").alias("value"))
    ends = at.groupBy(*keys).agg(F.min("u").alias("a"), F.max("u").alias("b"))
    spans = ends.withColumn("_piece", F.explode(F.sequence(F.floor(F.col("a") / width).cast("long"), F.floor(F.col("b") / width).cast("long"))))
    first = F.col("a") + F.ceil(F.greatest(F.col("_piece") * width - F.col("a"), F.lit(0)) / step_us) * step_us
    spans = spans.withColumn("_from", first.cast("long")).withColumn("_to", F.least("b", (F.col("_piece") + 1) * width - 1)).where("_from <= _to")
    grid = spans.select(*keys, "_piece", F.explode(F.sequence("_from", "_to", F.lit(step_us))).alias("u"))
    on = grid.join(at, [*keys, "u"], "left").withColumn("_known", F.when(F.col("value").isNotNull(), F.struct("u", "value")))
    told = pieces.handed_on(on, keys, {"_last": F.max("_known"), "_first": F.min("_known")}, {"_p0": lambda w: F.last("_last", True).over(pieces.before(w)), "_n0": lambda w: F.first("_first", True).over(pieces.after(w))})
    rows = pieces.within(keys, "u")
    back, ahead = rows.rowsBetween(Window.unboundedPreceding, 0), rows.rowsBetween(0, Window.unboundedFollowing)
    near = told.withColumns({"_p": F.coalesce(F.last("_known", True).over(back), F.col("_p0")), "_n": F.coalesce(F.first("_known", True).over(ahead), F.col("_n0"))})
    missing = (F.col("_n.u") - F.col("_p.u")) / step_us - 1
    line = F.col("_p.value") + (F.col("_n.value") - F.col("_p.value")) * (F.col("u") - F.col("_p.u")) / (F.col("_n.u") - F.col("_p.u"))
    filled = F.col("value").isNull() & F.coalesce(missing <= max_steps, F.lit(False))
    out = near.select(*keys, F.timestamp_micros("u").cast("timestamp_ntz").alias("ts"), F.when(filled, line).otherwise(F.col("value")).alias("value"), filled.alias("filled"))
    return out.where("value is not null")


def common_window(m: DataFrame, keys: Sequence[str] = SERIES, group: str = "station") -> DataFrame:
    """The time that all series of a group share; empty (null) where it ends before it starts. (JN-21)"""
    spans = m.groupBy(*keys).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    out = spans.groupBy(group).agg(F.max("a").alias("start_ts"), F.min("b").alias("end_ts"), F.count("*").alias("n_series"))
    empty = F.col("end_ts") <= F.col("start_ts")
    return out.withColumns({"start_ts": F.when(~empty, F.col("start_ts")), "end_ts": F.when(~empty, F.col("end_ts"))})


def last_before(events: DataFrame, m: DataFrame, predicate: Column, keys: Sequence[str] = SERIES, width: int = pieces.WIDTH) -> DataFrame:
    """As-of backward: the last time strictly before each event's ts at which the predicate held. (JN-11)"""
    marks = m.where(predicate).select(*keys, "ts", F.lit(0).alias("_e"))
    both = pieces.cut(events.select(*keys, "ts", F.lit(1).alias("_e")).unionByName(marks), width)
    mark = F.when(F.col("_e") == 0, F.col("ts"))
    told = pieces.handed_on(both, keys, {"_marks": F.max(mark)}, {"_before": lambda w: F.max("_marks").over(pieces.before(w))})
    frame = Window.partitionBy(*keys, "_piece").orderBy(micros("ts")).rangeBetween(Window.unboundedPreceding, -1)
    return told.withColumn("last_ts", F.coalesce(F.max(mark).over(frame), F.col("_before"))).where("_e = 1").drop("_e", "_before", "_piece")


def lagged(m: DataFrame, steps: int, keys: Sequence[str] = SERIES, width: int = pieces.WIDTH) -> DataFrame:
    """The value of ``steps`` rows before, the series' first value where there is none. (WIN-19)"""
    first = m.groupBy(*keys).agg(F.min_by(F.struct("value"), F.struct("ts", "value"))["value"].alias("_first"))
    wide = pieces.widened_by_rows(pieces.cut(m, width), keys, back=steps).withColumn("lagged", F.lag("value", steps).over(pieces.within(keys)))
    return pieces.meet(wide.where("_own"), first, keys).withColumn("lagged", F.coalesce("lagged", "_first")).drop("_first", "_own", "_piece")


def _falling_greatest(fall: float, over: Column, position: Column) -> tuple[Column, Column, Column]:
    """For the greatest of over[s] * a**(position - s), as aggregates of logarithms: what lies over 0, at 0 and under it."""
    log = F.ln(F.abs(over)) - position * fall
    return F.max(F.when(over > 0, log)), F.max(F.when(over == 0, F.lit(1))), F.min(F.when(over < 0, log))


def recursive_filter(m: DataFrame, a: float, b: float, keys: Sequence[str] = SERIES, width: int = pieces.WIDTH) -> DataFrame:
    """q[t] = max(value[t], a * q[t - 1] + b) along each series, for a between 0 and 1. (WIN-20)

    The linear recession makes it a running maximum, which a window can say: with c = b / (1 - a),
    q[t] = c + the greatest (value[s] - c) * a**(t - s) for s up to t. The powers are taken as
    logarithms, so that a long series keeps its numbers in range; what lies under c counts only while
    nothing has reached it. A piece hands on its row count and its own last q.
    """
    c, fall = b / (1 - a), math.log(a)
    order = pieces.within(keys)
    n = pieces.cut(m, width).withColumns({"_t": F.row_number().over(order), "_over": F.col("value") - c})

    def greatest(df: DataFrame, over: str, at: str, window, now: Column) -> DataFrame:
        up, flat, down = (x.over(window) for x in _falling_greatest(fall, F.col(over), F.col(at)))
        df = df.withColumns({"_up": up, "_at": flat, "_down": down})
        grown = lambda x: F.exp(F.col(x) + now * fall)
        return df.withColumn("_q", F.when(F.col("_up").isNotNull(), grown("_up")).when(F.col("_at").isNotNull(), F.lit(0.0)).otherwise(-grown("_down"))).drop("_up", "_at", "_down")

    local = greatest(n, "_over", "_t", order.rowsBetween(Window.unboundedPreceding, 0), F.col("_t"))
    by = [*keys, "_piece"]
    ends = local.groupBy(*by).agg(F.max("_t").alias("_rows"), F.max_by("_q", "_t").alias("_end"))
    scan = pieces.along(keys)
    ends = ends.withColumn("_upto", F.sum("_rows").over(scan.rowsBetween(Window.unboundedPreceding, 0)))
    told = greatest(ends, "_end", "_upto", pieces.before(scan), F.col("_upto") - F.col("_rows")).select(*by, F.col("_q").alias("_in"))
    out = pieces.meet(local, told, by)
    return out.withColumn("filtered", c + F.greatest(F.col("_q"), F.col("_in") * F.exp(F.col("_t") * fall))).drop("_t", "_over", "_q", "_in", "_piece")


def usable_share(m: DataFrame, keys: Sequence[str] = SERIES, tail_h: float = 1.0) -> DataFrame:
    """Share of kept rows of each series (with reason), and whether the fault is at its end. (AGG-32)"""
    kept = F.col("reason").isNull()
    out = m.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(kept).alias("n_kept"), F.max("ts").alias("last_ts"), F.max(F.when(kept, F.col("ts"))).alias("last_kept_ts"))
    late = (micros("last_ts") - micros("last_kept_ts")) / float(HOUR) > tail_h
    return out.withColumns({"share": F.col("n_kept") / F.col("n"), "fault_at_end": F.coalesce(late, F.lit(True))})


def limits_frame(spark, params: Params = DEFAULTS) -> DataFrame:
    """The default limits as a dimension."""
    return spark.createDataFrame([(s, lo, hi, fix) for s, (lo, hi, fix) in params.limits.items()], "sensor string, d_low double, d_high double, corrects boolean")


def centred_mean(m: DataFrame, rows: int = 72, keys: Sequence[str] = SERIES, width: int = pieces.WIDTH) -> DataFrame:
    """Mean over a centred frame of rows, as many as there are at the ends; an even frame leans back. (WIN-09)"""
    back, ahead = rows // 2, rows - rows // 2 - 1
    wide = pieces.widened_by_rows(pieces.cut(m, width), keys, back, ahead)
    return wide.withColumn("centred", F.avg("value").over(pieces.within(keys).rowsBetween(-back, ahead))).where("_own").drop("_own", "_piece")


def convolve(m: DataFrame, kernel: Sequence[float], keys: Sequence[str] = SERIES, width: int = pieces.WIDTH) -> DataFrame:
    """The series' past weighted by a kernel of fixed length: sum of kernel[k] * value[t - k]. (WIN-21)"""
    order = pieces.within(keys)
    total = F.lit(0.0)
    for k, weight in enumerate(kernel):
        total = total + F.lit(float(weight)) * F.coalesce(F.lag("value", k).over(order) if k else F.col("value"), F.lit(0.0))
    return pieces.widened_by_rows(pieces.cut(m, width), keys, back=len(kernel) - 1).withColumn("convolved", total).where("_own").drop("_own", "_piece")


def split_at(m: DataFrame, day: str) -> dict[str, DataFrame]:
    """History before a day, the day itself and the rest. (SET-06)"""
    at = F.to_date("ts")
    pivot = F.lit(day).cast("date")
    return {"history": m.where(at < pivot), "day": m.where(at == pivot), "rest": m.where(at > pivot)}
