"""Series longer than a task: piecewise scans equal plain windows, selection equals sorting, and no task gets much more than another."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugewright.functions.selection import exact_median_of, exact_quantile_of, lowest_mode_of, median_mad_of
from gaugewright.functions.stats import HOUR, micros
from gaugewright.operators import pieces, series

KIND = "station string, sensor string, ts timestamp_ntz, value double, id long"
MINUTE = HOUR // 60
WIDTHS = [pieces.WIDTH, 7 * MINUTE]


@pytest.fixture(scope="module")
def readings(spark):
    """A hot series, sparse ones, nulls, repeated times, a null key; ties in time have different values."""
    rng = random.Random(4)
    rows, n = [], 0
    for station, count in (("hot", 700), ("b", 40), ("c", 1), (None, 30)):
        minute, value = 0, 0.0
        for _ in range(count):
            minute += rng.choice([0, 1, 1, 1, 2, 30])
            value = rng.choice([value, value, float(rng.randrange(5)), None]) if value is not None else float(rng.randrange(5))
            rows.append((station, "s", f"2024-01-01 00:00:00+{minute}", value, n))
            n += 1
    df = spark.createDataFrame([(a, b, t.split("+")[0], int(t.split("+")[1]), v, i) for a, b, t, v, i in rows], "station string, sensor string, t string, minute long, value double, id long")
    ts = F.timestamp_micros(F.unix_micros(F.to_timestamp("t")) + F.col("minute") * MINUTE).cast("timestamp_ntz")
    df = df.select("station", "sensor", ts.alias("ts"), "value", "id")
    # rows equal in time and value are in no order: keep one
    return df.dropDuplicates(["station", "sensor", "ts", "value"]).cache()


def same(a, b):
    plain = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
    assert plain(a) == plain(b)


def whole():
    return Window.partitionBy("station", "sensor").orderBy("ts", "value")


@pytest.mark.parametrize("width", WIDTHS)
def test_steps_and_lags(readings, width):
    at = micros("ts")
    same(series.with_step(readings, width=width).select("id", "step_s"), readings.select("id", (at - F.lag(at).over(whole())) / F.lit(1e6)))
    for k in (1, 5):
        same(series.lagged(readings, k, width=width).select("id", "lagged"), readings.select("id", F.coalesce(F.lag("value", k).over(whole()), F.first("value").over(whole()))))


@pytest.mark.parametrize("width", WIDTHS)
def test_frames(readings, width):
    frame = Window.partitionBy("station", "sensor").orderBy(micros("ts")).rangeBetween(-2 * HOUR + 1, 0)
    same(series.rolling_sum(readings, 2, width=width).select("id", "rolling"), readings.select("id", F.sum("value").over(frame)))
    for rows in (1, 6, 9):
        same(series.centred_mean(readings, rows, width=width).select("id", "centred"), readings.select("id", F.avg("value").over(whole().rowsBetween(-(rows // 2), rows - rows // 2 - 1))))
    kernel = [0.5, 0.25, 0.125, 0.0625]
    total = sum((w * F.coalesce(F.lag("value", k).over(whole()) if k else F.col("value"), F.lit(0.0)) for k, w in enumerate(kernel)), F.lit(0.0))
    same(series.convolve(readings, kernel, width=width).select("id", "convolved"), readings.select("id", total))


@pytest.mark.parametrize("width", WIDTHS)
def test_runs(readings, width):
    order = whole()
    change = F.when(F.lag("value").over(order).eqNullSafe(F.col("value")) & F.col("value").isNotNull(), 0).otherwise(1)
    plain = readings.withColumn("c", change).withColumn("r", F.sum("c").over(order)).where("value is not null").groupBy("station", "sensor", "r").agg(F.first("value"), F.count("*"), F.min("ts"), F.max("ts")).drop("r")
    same(series.value_runs(readings, width=width).drop("hours"), plain)
    high = F.col("value") >= 2
    flagged = readings.withColumn("f", F.coalesce(high, F.lit(False)))
    starts = (F.col("f") & ~F.coalesce(F.lag("f").over(order), F.lit(False))).cast("int")
    plain = flagged.withColumn("s", starts).withColumn("r", F.sum("s").over(order)).where("f").groupBy("station", "sensor", "r").agg(F.min("ts"), F.max("ts"), F.count("*"), F.max("value").alias("top")).drop("r")
    same(series.predicate_runs(readings, high, aggregates=[F.max("value").alias("top")], width=width), plain)


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("step", ["median", "mode"])
def test_blocks(readings, width, step):
    at, order = micros("ts"), whole()
    stepped = readings.withColumn("s", (at - F.lag(at).over(order)) / 1e6)
    usual = stepped.where("s is not null").groupBy("station", "sensor").agg((F.percentile("s", F.lit(0.5)) if step == "median" else F.mode("s", True)).alias("u"))
    joined = stepped.alias("a").join(usual.alias("b"), F.expr("a.station <=> b.station and a.sensor = b.sensor"), "left").select("a.*", "u")
    plain = joined.withColumn("g", F.coalesce((F.col("s") > 1.5 * F.col("u")).cast("int"), F.lit(0))).withColumn("block", F.sum("g").over(order)).groupBy("station", "sensor", "block").agg(F.min("ts"), F.max("ts"), F.count("*"))
    same(series.continuous_blocks(readings, step=step, width=width), plain)


@pytest.mark.parametrize("width", WIDTHS)
def test_recursion(readings, width):
    rows = readings.where("value is not null").withColumn("value", F.col("value") - 2.5)
    got = {r["id"]: r["filtered"] for r in series.recursive_filter(rows, 0.9, -0.3, width=width).collect()}
    by = {}
    for r in sorted(rows.collect(), key=lambda r: (str(r["station"]), r["ts"], r["value"])):
        q = by.get(r["station"])
        by[r["station"]] = q = r["value"] if q is None else max(r["value"], 0.9 * q - 0.3)
        assert got[r["id"]] == pytest.approx(q, rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("width", WIDTHS)
def test_last_before_and_grid(readings, width):
    rows = readings.where("station is not null")
    got = series.last_before(rows.where("value = 1"), rows, F.col("value") >= 3, width=width)
    plain = rows.where("value = 1").alias("a").join(rows.where("value >= 3").alias("b"), F.expr("a.station = b.station and b.ts < a.ts"), "left").groupBy("a.id").agg(F.first("a.station"), F.first("a.sensor"), F.first("a.ts"), F.max("b.ts")).drop("id")
    same(got.select("station", "sensor", "ts", "last_ts"), plain)
    same(series.reconstruct(rows.where("value is not null"), 3 * MINUTE, max_steps=2, width=width), series.reconstruct(rows.where("value is not null"), 3 * MINUTE, max_steps=2, width=10**15))


def brute_reconstruct(points, step, longest):
    out = {}
    known = [(u, v) for u, v in sorted(points.items()) if (u - min(points)) % step == 0]
    for (a, x), (b, y) in zip(known, known[1:] + [(None, None)], strict=True):
        out[a] = x
        if b is not None and (b - a) // step - 1 <= longest:
            out |= {u: x + (y - x) * (u - a) / (b - a) for u in range(a + step, b, step)}
    return out


def test_grid_against_brute_force(readings):
    one = readings.where("station = 'hot' and value is not null").groupBy("station", "sensor", "ts").agg(F.min("value").alias("value"))
    points = {r["u"]: r["value"] for r in one.select(micros("ts").alias("u"), "value").collect()}
    got = {r["u"]: r["value"] for r in series.reconstruct(one, 3 * MINUTE, 2, width=11 * MINUTE).select(micros("ts").alias("u"), "value").collect()}
    assert got == pytest.approx(brute_reconstruct(points, 3 * MINUTE, 2))


def test_tasks_of_a_hot_series_are_even(spark):
    """One series of 400,000 seconds: no task's share of the windows is beyond twice the median."""
    m = spark.range(400_000).select(F.lit("x").alias("station"), F.lit("s").alias("sensor"), F.timestamp_micros(F.col("id") * 1_000_000).cast("timestamp_ntz").alias("ts"), F.floor(F.col("id") / 7).cast("double").alias("value"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = pieces.run_numbers(pieces.cut(m, 2 * HOUR // 60), ["station", "sensor"], ["value"], lambda p, c: p["value"] != c["value"])
        sizes = sorted(r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
        assert sizes[-1] <= 2 * statistics.median(sizes) and len(sizes) == 4
        assert rows.agg(F.max("_run")).first()[0] == math.ceil(400_000 / 7)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_no_window_goes_along_the_rows_of_a_series(readings):
    for df in (series.with_step(readings), series.value_runs(readings), series.rolling_sum(readings, 2), series.lagged(readings, 3), series.recursive_filter(readings, 0.9, 0.1), series.centred_mean(readings, 5), series.convolve(readings, [1.0, 2.0]), series.continuous_blocks(readings)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        # along the pieces of a series: only states, never a reading's own columns
        assert windows and all("_piece" in line for line in windows)


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_selection_equals_sorting(spark, accuracy):
    rng = np.random.default_rng(8)
    groups = {"hot": rng.normal(size=3000).round(2), "ties": np.repeat([1.0, 2.0], [900, 900]), "one": np.array([5.0]), "two": np.array([1.0, 4.0]), "flat": np.full(500, 7.0), "few": rng.random(9), "odd": np.array([3.0, -1.0, 2.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None), ("none", None), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, value double").repartition(7)
    groups[None] = np.array([1.0, 3.0])
    for p in (0.0, 0.25, 0.5, 0.95, 1.0):
        got = {r["k"]: (r["n"], r["quantile"]) for r in exact_quantile_of(df, ["k"], "value", p, accuracy=accuracy).collect()}
        assert got == {k: (len(v), pytest.approx(float(np.quantile(v, p)), abs=1e-12)) for k, v in groups.items()}
    got = {r["k"]: (r["med"], r["mad"]) for r in median_mad_of(df, ["k"], "value", accuracy).collect()}
    assert got == {k: (pytest.approx(np.median(v)), pytest.approx(np.median(np.abs(v - np.median(v))))) for k, v in groups.items()}
    modes = {r["k"]: r["mode"] for r in lowest_mode_of(df, ["k"], "value").collect()}
    assert modes["ties"] == 1.0 and modes["flat"] == 7.0 and modes["two"] == 1.0 and "none" not in modes


def test_only_a_bracket_is_counted_by_value(spark):
    """A group of 200,000 distinct values: what is counted by value is some thousandths of it."""
    df = spark.range(200_000).select(F.lit("k").alias("k"), ((F.col("id") * 7919) % 200_003).cast("double").alias("value"))
    found = exact_median_of(df, ["k"], "value")
    assert found.first()["median_value"] == statistics.median((i * 7919) % 200_003 for i in range(200_000))
    assert "percentile(" not in found._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(Exception, match="bracket"):  # a broken promise is an error, never a wrong value
        from gaugewright.functions import selection

        real = selection.F.percentile_approx
        try:
            selection.F.percentile_approx = lambda c, p, a: F.array(F.lit(1.0), F.lit(2.0))
            exact_median_of(df, ["k"], "value").collect()
        finally:
            selection.F.percentile_approx = real


def test_a_frame_of_very_many_rows_costs_no_more_a_row(spark):
    rows = spark.range(200_000).select(F.lit("a").alias("station"), F.lit("s").alias("sensor"), F.timestamp_micros(F.col("id") * 360_000).cast("timestamp_ntz").alias("ts"), F.lit(1.0).alias("value"), "id")
    got = series.rolling_sum(rows, 24).where("rolling <> id + 1")  # a row every 0.36 s: the frame holds all before
    assert got.count() == 0
    hour = series.rolling_sum(rows, 1).where("rolling <> least(id + 1, 10000)")
    assert hour.count() == 0
