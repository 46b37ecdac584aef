"""Rules across stations: false zeros of rain (I1) and floods that do not pass on (I2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.functions.selection import exact_median_of, with_median_mad
from gaugewright.functions.stats import HOUR, exact_median, first_few, inverse_square, micros, weighted_mean
from gaugewright.operators import pieces
from gaugewright.operators.anomalies import anomaly
from gaugewright.operators.intervals import interval_join
from gaugewright.operators.series import dense_daily, predicate_runs
from gaugewright.params import DEFAULTS, Params
from gaugewright.session import stored


def nearest_neighbours(stations: DataFrame, params: Params = DEFAULTS, among: DataFrame | None = None) -> DataFrame:
    """Up to k neighbours of each station (station, x, y in metres, altitude, origin): station, neighbour, km, rank. (JN-12, WIN-14, FLT-11, FLT-12)

    Stations meet by grid cell: a cell is as wide as the radius, so a neighbour lies in one of the
    nine cells around. The radius applies to the exact distance, the rank to the rounded one, ties
    to the smaller name. Altitudes count if both are known, origins if both are. ``among`` (station)
    limits who can be a neighbour, before the k nearest are chosen.
    """
    size = params.neighbour_km * 1000
    cell = stations.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)}).where("x is not null and y is not null")
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = cell.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).withColumns({"cx": F.col("cx") + F.col("dx"), "cy": F.col("cy") + F.col("dy")}).drop("dx", "dy")
    other = cell.select(*[F.col(c).alias(f"{c}_n") for c in ("station", "x", "y", "altitude", "origin")], "cx", "cy")
    if among is not None:
        other = other.join(among.select(F.col("station").alias("station_n")).distinct(), "station_n", "left_semi")
    pairs = spread.join(other, ["cx", "cy"]).where("station <> station_n")
    km = F.hypot(F.col("x") - F.col("x_n"), F.col("y") - F.col("y_n")) / 1000
    alt = F.abs(F.col("altitude") - F.col("altitude_n")) <= params.neighbour_alt_m
    kept = pairs.withColumn("exact", km).where((F.col("exact") <= params.neighbour_km) & F.coalesce(alt, F.lit(True)) & F.coalesce(F.col("origin") == F.col("origin_n"), F.lit(True)))
    ranked = kept.select("station", F.col("station_n").alias("neighbour"), F.bround("exact", 1).alias("km"))
    order = Window.partitionBy("station").orderBy("km", "neighbour")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= params.neighbours)


def expected_rain(days: DataFrame, neighbours: DataFrame, params: Params = DEFAULTS, full_days: bool = False) -> DataFrame:
    """Inverse-distance mean of the neighbours' daily totals: station, day, expected, n_wet, n_neighbours and wet, the three nearest wet ones. (AGG-19, SRT-04)

    A neighbour silent within its range counts as 0 mm (Q-05) unless ``full_days`` asks for whole days.
    """
    theirs = days.where(F.col("n") >= params.full_day_rows) if full_days else days
    joined = neighbours.join(theirs.select(F.col("station").alias("neighbour"), "day", "total"), "neighbour")
    return joined.groupBy("station", "day").agg(weighted_mean(inverse_square(F.col("km")), F.col("total")).alias("expected"), F.count_if(F.col("total") >= params.wet_mm).alias("n_wet"), F.count("*").alias("n_neighbours"), first_few(F.when(F.col("total") >= params.wet_mm, F.struct("km", "neighbour", "total")), 3).alias("wet"))


def false_zero_days(rain: DataFrame, stations: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Full days without rain where wet neighbours expect it: station, day, expected and the first three wet neighbours. (I1)

    Neighbours are the nearest of the stations that have rain readings at all, so that a silent gauge takes no place among them.
    """
    neighbours = nearest_neighbours(stations, params, rain)
    days = dense_daily(rain, ["station"])
    enough = neighbours.groupBy("station").agg(F.count("*").alias("k")).where(F.col("k") >= params.neighbour_min).select("station")
    dry = days.where((F.col("total") == 0) & (F.col("n") >= params.full_day_rows)).join(enough, "station", "left_semi").select("station", "day")
    return dry.join(expected_rain(days, neighbours, params), ["station", "day"]).where((F.col("n_wet") >= params.neighbour_min) & (F.col("expected") >= params.expected_mm)).select("station", "day", "expected", "wet")


def false_zero_episodes(rain: DataFrame, stations: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Consecutive false-zero days as one episode: station, first_day, last_day, n_days, expected, wet (of the worst day) and severity. (I1, WIN-07)"""
    days = false_zero_days(rain, stations, params)
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("station").orderBy("day")))
    s = days.withColumn("_i", island).groupBy("station", "_i").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_days"), F.max("expected").alias("expected"), F.max_by("wet", F.struct("expected", (-F.unix_date("day")).alias("back"))).alias("wet"))
    return s.drop("_i").withColumn("severity", F.when(F.col("expected") >= params.expected_severe_mm, "high").otherwise("medium"))


def false_zero_anomalies(rain: DataFrame, stations: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Episodes of false zeros as anomalies of the one shape. (I1)"""
    s = false_zero_episodes(rain, stations, params).withColumn("sensor", F.lit(params.rain))
    return anomaly(s, "I1", "I1_faux_zero_pluie", F.col("severity"), F.col("first_day").cast("timestamp_ntz"), F.col("n_days"), F.col("expected"), params.expected_mm)


def flood_events(level: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Islands above the median by scaled MADs: station, first_ts, last_ts, n, peak, peak_ts, rise. (WIN-05, AGG-16)"""
    stats = with_median_mad(level, ["station"])
    high = F.col("value") > F.col("med") + F.greatest(params.flood_k * params.mad_scale * F.col("mad"), F.lit(params.flood_rise_up))
    top = F.max(F.struct("value", (-micros("ts")).alias("back"), "ts", "med")).alias("_top")
    runs = predicate_runs(stats, high, ["station"], [top])
    return runs.select("station", "first_ts", "last_ts", "n", F.col("_top.value").alias("peak"), F.col("_top.ts").alias("peak_ts"), (F.col("_top.value") - F.col("_top.med")).alias("rise"))


def flood_propagation(level: DataFrame, pairs: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """What each upstream flood did downstream: verdict (anomaly, confirmation or decline) with its reason. (I2)

    ``pairs``: up, down, km, reliability, same_origin. Rows: up, down, first_ts (null for declines of
    a whole pair), verdict, reason, lag_h, peak, threshold. The order of the guards decides which
    reason is given, so they are one chain of conditions and no filters.
    """
    stats = level.groupBy("station").agg(F.count("*").alias("n"), F.min("value").alias("low"))
    stats = pieces.meet(stats, exact_median_of(level, ["station"], "value", "med").drop("n"), ["station"])
    stepped = pieces.with_previous(pieces.cut(level), ["station"], micros("ts"), "_was").withColumn("_s", micros("ts") - F.col("_was"))
    stats = stored(pieces.meet(stats, exact_median_of(stepped, ["station"], "_s", "step_us").drop("n"), ["station"]))  # a row a station
    floods = stored(flood_events(level, params))
    count = floods.groupBy("station").agg(F.count("*").alias("n_floods"))
    up = stats.join(count, "station", "left").select(F.col("station").alias("up"), F.col("n").alias("n_up"), "n_floods")
    down = stats.select(F.col("station").alias("down"), F.col("n").alias("n_down"), "med", "low", "step_us")
    known = pairs.join(up, "up", "left").join(down, "down", "left")
    reason = (
        F.when(F.col("reliability") != "haute", "reliability")
        .when(F.col("km") > params.flood_max_km, "distance")
        .when(~F.col("same_origin"), "origin")
        .when(F.col("n_up").isNull() | F.col("n_down").isNull(), "no_level")
        .when((F.col("n_up") < params.flood_min_rows) | (F.col("n_down") < params.flood_min_rows), "few_rows")
        .when(F.coalesce(F.col("n_floods"), F.lit(0)) == 0, "no_flood")
    )
    judged = known.withColumn("reason", reason)
    declined = judged.where("reason is not null").select("up", "down", F.lit(None).cast("timestamp_ntz").alias("first_ts"), F.lit("decline").alias("verdict"), "reason", *[F.lit(None).cast("double").alias(c) for c in ("lag_h", "peak", "threshold")])
    margin = params.wave_margin_h
    events = judged.where("reason is null").join(floods.select(F.col("station").alias("up"), "first_ts", "peak_ts", "rise"), "up").withColumns({
        "f0": micros("first_ts") + (F.greatest(F.col("km") / params.wave_fast_kmh - margin, F.lit(0.0)) * HOUR).cast("long"), "f1": micros("peak_ts") + ((F.col("km") / params.wave_slow_kmh + margin) * HOUR).cast("long"),
    }).withColumn("f00", F.col("f0") - 24 * HOUR)
    near = interval_join(events.withColumn("station", F.col("down")), level, ["station"], "f00", "f1")
    prior, inside = F.col("r_us") < F.col("f0"), F.col("r_us") >= F.col("f0")
    value_at = lambda f, p: f(F.when(p, F.col("r_value")), F.when(p, F.col("r_us")))
    seen = near.groupBy("up", "down", "first_ts").agg(
        F.count_if(prior).alias("n_prior"), exact_median(F.when(prior, F.col("r_value"))).alias("prior_med"), value_at(F.min_by, prior).alias("v0"), value_at(F.max_by, prior).alias("v1"),
        F.min(F.when(prior, F.col("r_us"))).alias("u0"), F.max(F.when(prior, F.col("r_us"))).alias("u1"), F.count_if(inside).alias("n_in"), F.max(F.when(inside, F.struct("r_value", (-F.col("r_us")).alias("back")))).alias("top"),
    )
    full = events.join(seen, ["up", "down", "first_ts"], "left")
    n_prior, n_in = F.coalesce("n_prior", F.lit(0)), F.coalesce("n_in", F.lit(0))
    local = F.when(n_prior >= 10, F.col("prior_med")).otherwise(F.col("med"))
    threshold = local + F.greatest(F.lit(params.flood_rise_down), params.flood_share * F.col("rise"))
    recession = (F.col("v1") - F.col("v0")) / F.nullif((F.col("u1") - F.col("u0")) / float(HOUR), F.lit(0.0))
    full = full.withColumns({"local": local, "threshold": threshold, "peak": F.col("top.r_value"), "lag_h": (-F.col("top.back") - micros("peak_ts")) / float(HOUR)})
    guard = (
        F.when((n_prior >= 10) & (F.col("local") > F.col("med") + params.already_high * (F.col("med") - F.col("low"))), "already_high")
        .when((n_prior >= 10) & F.coalesce(recession <= params.recession_per_h, F.lit(False)), "recession")
        .when(n_in / ((F.col("f1") - F.col("f0")) / F.col("step_us")) < params.flood_coverage, "coverage")
        .when(n_in == 0, "empty")
    )
    verdict = F.when(guard.isNotNull(), "decline").when(F.col("peak") >= F.col("threshold"), "confirmation").otherwise("anomaly")
    decided = full.select("up", "down", "first_ts", verdict.alias("verdict"), guard.alias("reason"), "lag_h", "peak", "threshold")
    return declined.unionByName(decided)


def flood_anomalies(propagation: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Floods that did not pass on, as anomalies of the downstream station. (I2)"""
    s = propagation.where("verdict = 'anomaly'").withColumns({"station": F.col("down"), "sensor": F.lit(params.level)})
    return anomaly(s, "I2", "I2_crue_non_propagee", "high", F.col("first_ts"), None, F.col("peak"), F.col("threshold"))


def decline_reasons(declines: DataFrame, text: str = "reason") -> DataFrame:
    """Reasons by what stands before `` du `` or a colon, with their number and one example. (AGG-25)"""
    head = F.substring_index(F.substring_index(text, " du ", 1), " : ", 1)
    return declines.groupBy(head.alias("kind")).agg(F.count("*").alias("n"), F.min(text).alias("example")).orderBy(F.desc("n"), "kind")


def peak_lag(level: DataFrame, pairs: DataFrame) -> DataFrame:
    """Peaks of two stations' series compared: lag, relative amplitudes over their medians, and a verdict in four. (AGG-33)"""
    peaks = level.groupBy("station").agg(F.max(F.struct("value", (-micros("ts")).alias("back"))).alias("t"))
    peaks = pieces.meet(peaks, exact_median_of(level, ["station"], "value", "med").drop("n"), ["station"])
    one = lambda side: peaks.select(F.col("station").alias(side), (-F.col("t.back")).alias(f"{side}_us"), ((F.col("t.value") - F.col("med")) / F.nullif(F.abs("med"), F.lit(0.0))).alias(f"{side}_amp"))
    s = pairs.select("up", "down").join(one("up"), "up").join(one("down"), "down").withColumn("lag_h", (F.col("down_us") - F.col("up_us")) / float(HOUR))
    verdict = F.when(F.col("lag_h") < 0, "before").when(F.col("down_amp") < 0.1 * F.col("up_amp"), "flat").when(F.col("lag_h") > 72, "late").otherwise("follows")
    return s.select("up", "down", "lag_h", "up_amp", "down_amp", verdict.alias("verdict"))


def origin_pairs(pairs: DataFrame, origins: DataFrame) -> DataFrame:
    """Pairs counted by the origins of their ends. (JN-20)"""
    side = lambda c: origins.select(F.col("station").alias(c), F.coalesce("origin", F.lit("unknown")).alias(f"{c}_origin"))
    joined = pairs.join(side("up"), "up", "left").join(side("down"), "down", "left")
    label = F.concat_ws(" > ", F.coalesce("up_origin", F.lit("unknown")), F.coalesce("down_origin", F.lit("unknown")))
    return joined.groupBy(label.alias("origins")).agg(F.count("*").alias("n"))
