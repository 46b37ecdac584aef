"""Series primitives and rules on hand-made series with known results."""

import math
import random
import statistics
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugewright.functions import scalar, stats
from gaugewright.functions.stats import HOUR, micros
from gaugewright.operators import anomalies, crossing, instant, interstation, listing, longterm, series, state
from gaugewright.params import BATTERY, DEFAULTS, DISCHARGE, LEVEL, RAIN
from gaugewright.sources import synthetic

T0 = datetime(2024, 1, 1)
SCHEMA = "station string, sensor string, ts timestamp_ntz, value double"


def make(spark, values, sensor=LEVEL, minutes=60, station="A", start=T0):
    return spark.createDataFrame([(station, sensor, start + timedelta(minutes=minutes * i), None if v is None else float(v)) for i, v in enumerate(values)], SCHEMA)


def bounded(df, low=0.0, high=2000.0, corrects=False, code=None):
    return df.withColumns({"low": F.lit(low), "high": F.lit(high), "corrects": F.lit(corrects), "code": F.lit(code).cast("string")})


def rules(df):
    return sorted(r["rule"] for r in df.collect())


def test_runs_break_on_null_not_on_gap(spark):
    runs = {(r["value"], r["n"]) for r in series.value_runs(make(spark, [1, 1, None, 1, 2, 2, 2])).collect()}
    assert runs == {(1.0, 2), (1.0, 1), (2.0, 1 + 2)}


def test_trailing_run(spark):
    r = series.trailing_run(make(spark, [5, 5, 4, 5, 5, 5])).first()
    assert (r["value"], r["n"], r["hours"]) == (5.0, 3, 2.0)
    whole = series.trailing_run(make(spark, [7, 7])).first()
    assert (whole["n"], whole["hours"]) == (2, 1.0)


def test_rolling_sum_is_half_open(spark):
    got = [r["rolling"] for r in series.rolling_sum(make(spark, [1] * 26), 24).orderBy("ts").collect()]
    assert got[23] == 24 and got[24] == 24 and got[25] == 24


def test_dense_daily_fills_empty_days(spark):
    m = make(spark, [2], RAIN).union(make(spark, [3], RAIN, start=T0 + timedelta(days=3)))
    assert [(r["total"], r["n"]) for r in series.dense_daily(m).orderBy("day").collect()] == [(2, 1), (0, 0), (0, 0), (3, 1)]


def test_reconstruct_fills_short_gaps_only(spark):
    m = make(spark, [0, 1]).union(make(spark, [4], start=T0 + timedelta(hours=4))).union(make(spark, [20], start=T0 + timedelta(hours=20)))
    got = {r["ts"].hour: r["value"] for r in series.reconstruct(m, stats.HOUR).collect()}
    assert got[2] == pytest.approx(2) and got[3] == pytest.approx(3) and 10 not in got and len(got) == 6


def test_recursive_filter_over_blocks(spark):
    values = [10] + [0] * 150 + [3] + [0] * 60
    want, q = [], None
    for v in values:
        q = v if q is None else max(v, 0.95 * q + 0.01)
        want.append(q)
    got = [r["filtered"] for r in series.recursive_filter(make(spark, values), 0.95, 0.01).orderBy("ts").collect()]
    assert got == pytest.approx(want)


def test_correct_replaces_by_rounded_median(spark):
    fixed = instant.correct(bounded(make(spark, [1, 2, 2.005, 99], RAIN), 0, 25, True))
    bad = fixed.where("corrected").first()
    assert bad["value_raw"] == 99 and bad["value"] == 2.0
    alone = instant.correct(bounded(make(spark, [99], RAIN), 0, 25, True)).first()
    assert alone["value"] == 0.0
    empty = instant.correct(bounded(make(spark, [99, None], RAIN), 0, 25, True)).where("corrected").first()
    assert empty["value"] is None


def test_battery_levels_exclude_each_other(spark):
    assert rules(instant.battery_levels(make(spark, [12, 10.5, 7.9, 16], BATTERY))) == ["BAT-a", "BAT-c"]
    assert rules(instant.battery_levels(make(spark, [12, 10.5, 8.1], BATTERY))) == ["BAT-b"]


def test_flatlines(spark):
    assert rules(instant.flatline_full(make(spark, [3, 3, 3]))) == ["R3"]
    assert rules(instant.flatline_full(make(spark, [0, 0, 0], RAIN))) == []
    partial = instant.flatline_longest(make(spark, [1, 2, 2, 2, 2, 2, 2, 2, 3])).first()
    assert partial["metric"] == 6.0 and partial["n_points"] == 7
    assert rules(instant.flatline_longest(make(spark, [1, 2, 2, 2, 2, 2, 2, 3]))) == []


def test_zeros_need_every_value(spark):
    assert rules(instant.all_zeros(make(spark, [0, 0]))) == ["R4"]
    assert rules(instant.all_zeros(make(spark, [0, None]))) == []


def test_steps(spark):
    m = make(spark, range(5)).union(make(spark, [9], start=T0 + timedelta(hours=5, minutes=12))).union(make(spark, [9], start=T0 + timedelta(hours=9)))
    kinds = [r["kind"] for r in instant.steps_against_mode(m).orderBy("ts").collect()]
    assert kinds == [None] * 5 + ["irregular", "gap"]


def test_instant_rules_disable_flatlines_of_batteries(spark):
    out = instant.instant_anomalies(bounded(make(spark, [12, 12, 12], BATTERY), None, None))
    assert "R3" not in rules(out)
    assert anomalies.described(out).columns[-1] == "description"


def test_long_flatline_threshold(spark):
    m = make(spark, [1] + [2] * 73)
    assert rules(longterm.long_flatline(m)) == ["L1"]
    assert rules(longterm.long_flatline(make(spark, [1] + [2] * 72))) == []
    assert rules(longterm.long_flatline(make(spark, [1] + [0] * 100, DISCHARGE))) == []


def test_battery_drift(spark):
    got = longterm.battery_drift(make(spark, [12.6 - 0.12 * i / 24 for i in range(24 * 30)], BATTERY)).first()
    assert got["rule"] == "L2" and got["metric"] == pytest.approx(-0.12)
    assert rules(longterm.battery_drift(make(spark, [12.6 - 0.04 * i / 24 for i in range(24 * 30)], BATTERY))) == []


def test_recent_outlier(spark):
    m = make(spark, [1 + 0.1 * (i % 5) for i in range(200)] + [180])
    got = longterm.recent_outliers(m).first()
    assert got["rule"] == "L4" and got["metric"] == 180
    assert rules(longterm.recent_outliers(make(spark, [1] * 200 + [180]))) == []  # no spread, no verdict


def test_trend_of_constant_series_has_no_r2(spark):
    s = longterm.trend(make(spark, [5] * 24 * 20)).first()
    assert s["r2"] == 0.0


def test_mean_shift_finds_the_step(spark):
    m = make(spark, [10 + i % 3 for i in range(40)] + [60 + i % 3 for i in range(40)], minutes=1440)
    got = longterm.mean_shift(m).first()
    assert got["rupture"] and got["idx"] == 39 and got["med2"] - got["med1"] > 45
    assert not longterm.mean_shift(make(spark, [10 + i % 3 for i in range(80)], minutes=1440)).first()["rupture"]


def test_silence_is_measured_against_the_network(spark):
    m = make(spark, range(12)).union(make(spark, range(6), station="B"))
    got = longterm.silent_series(m).collect()
    assert [(r["station"], r["metric"]) for r in got] == [("B", 6.0)]


def test_rain_without_response_and_suppression(spark):
    hours = 24 * 20
    rain = make(spark, [6 if i in (240, 241, 245, 330) else 0 for i in range(hours)], RAIN).drop("sensor")
    flat = make(spark, [100] * hours).drop("sensor")
    got = [r["ts"] for r in crossing.rain_without_response(rain, flat).orderBy("ts").collect()]
    assert got == [T0 + timedelta(hours=241)]  # 245 lies within 36 hours; at 330 one hour of 6 mm is too little
    rises = make(spark, [100 if i < 245 else 110 for i in range(hours)]).drop("sensor")
    assert crossing.rain_without_response(rain, rises).count() == 0


def test_drought_and_high_water_abstain(spark):
    hours = 24 * 60
    rain = make(spark, [6 if i in (10, 1000, 1001) else 0 for i in range(hours)], RAIN).drop("sensor")
    flat = make(spark, [100] * hours).drop("sensor")
    verdicts = {r["ts"]: r["verdict"] for r in crossing.response_candidates(rain, flat).collect()}
    assert set(verdicts.values()) == {"drought"}
    high = make(spark, [100 if i < 900 else 400 for i in range(hours)]).drop("sensor")
    wet = make(spark, [6 if i in (900, 1000, 1001) else 0 for i in range(hours)], RAIN).drop("sensor")
    low = high.withColumn("value", F.when(F.col("ts") < T0 + timedelta(hours=5), 50.0).otherwise(F.col("value")))
    assert {r["verdict"] for r in crossing.response_candidates(wet, low).collect()} == {"already_high"}


def test_neighbours_and_false_zeros(spark):
    rows = [("A", 0.0, 0.0, 100.0, "real"), ("B", 10e3, 0.0, 100.0, "real"), ("C", 0.0, 20e3, None, "real"), ("D", 15e3, 15e3, 90.0, "real"), ("E", 5e3, 5e3, 900.0, "real"), ("F", 500e3, 0.0, 100.0, "real")]
    stations = spark.createDataFrame(rows, "station string, x double, y double, altitude double, origin string")
    near = interstation.nearest_neighbours(stations)
    assert [(r["neighbour"], r["km"]) for r in near.where("station = 'A'").orderBy("rank").collect()] == [("B", 10.0), ("C", 20.0), ("D", 21.2)]
    rain = make(spark, [0] * 72, station="A")
    for s in "BCD":
        rain = rain.union(make(spark, [1] * 48 + [0] * 24, station=s))
    got = interstation.false_zero_episodes(rain.drop("sensor"), stations).where("station = 'A'").collect()
    assert len(got) == 1 and got[0]["n_days"] == 2 and got[0]["severity"] == "high" and [w["neighbour"] for w in got[0]["wet"]] == ["B", "C", "D"]
    assert tuple(interstation.false_zero_anomalies(rain.drop("sensor"), stations).columns) == anomalies.COLUMNS
    # a silent gauge nearby takes no place among the neighbours
    crowd = stations.union(spark.createDataFrame([(f"Z{i}", 100.0 * i, 50.0, 100.0, "real") for i in range(1, 9)], stations.schema))
    assert interstation.false_zero_episodes(rain.drop("sensor"), crowd).where("station = 'A'").count() == 1


def test_flood_propagation_verdicts(spark):
    base = [100 + (i % 3) for i in range(400)]
    flood = [v + (80 if 200 <= i < 210 else 0) for i, v in enumerate(base)]
    answer = [v + (40 if 203 <= i < 215 else 0) for i, v in enumerate(base)]
    level = make(spark, flood, station="U").union(make(spark, answer, station="D")).union(make(spark, base, station="Q")).drop("sensor")
    pairs = spark.createDataFrame([("U", "D", 20.0, "haute", True), ("U", "Q", 20.0, "haute", True), ("D", "X", 20.0, "haute", True), ("U", "D2", 500.0, "moyenne", True)], "up string, down string, km double, reliability string, same_origin boolean")
    spread = interstation.flood_propagation(level, pairs)
    assert [(r["station"], r["type"]) for r in interstation.flood_anomalies(spread).collect()] == [("Q", "I2_crue_non_propagee")]
    got = {(r["up"], r["down"]): (r["verdict"], r["reason"]) for r in spread.collect()}
    assert got == {("U", "D"): ("confirmation", None), ("U", "Q"): ("anomaly", None), ("D", "X"): ("decline", "no_level"), ("U", "D2"): ("decline", "reliability")}


def test_states_and_proposals(spark):
    m = make(spark, [12] * 200, BATTERY).union(make(spark, [5 + i % 2 for i in range(200)])).union(make(spark, [1 + i for i in range(100)], station="B"))
    sensors = state.sensor_state(m)
    stations = {r["station"]: r["state"] for r in state.station_state(sensors).collect()}
    assert stations == {"A": "marche", "B": "arret"}
    declared = spark.createDataFrame([("A", "critique"), ("B", "arret")], "station string, state string")
    div = state.divergence(state.station_state(sensors), declared)
    found = state.justified(div, state.active_coverage(m, sensors)).withColumn("provenance", F.lit(None).cast("string"))
    pending = spark.createDataFrame([("B", "arret", "x")], "station string, proposed string, provenance string")
    got = {r["station"]: (r["action"], r["provenance"]) for r in state.proposal_merge(pending, found).collect()}
    assert got == {"A": ("open", None), "B": ("close", "x")}


def test_scalars(spark):
    df = spark.createDataFrame([("12.5", " Modem + Batterie +"), ("12,5", "À côté"), ("---/[10]", None), ("1.5d", "")], "v string, t string")
    got = df.select(scalar.number_or_null(F.col("v")).alias("n"), scalar.state_code(F.col("v")).alias("c"), scalar.fold_accents(F.col("t")).alias("f"), scalar.split_faults(F.col("t")).alias("s")).collect()
    assert [(r["n"], r["c"]) for r in got] == [(12.5, None), (None, "12,5"), (None, "10"), (None, "1.5d")]
    assert got[1]["f"] == "a cote" and got[0]["s"] == ["Modem", "Batterie"]
    assert str(spark.range(1).select(scalar.excel_date(F.lit("45292")).alias("d")).first()["d"]) == "2024-01-01"
    folded = spark.createDataFrame([("E\u0301te\u0301 Šž ő",)], "t string").select(scalar.fold_accents(F.col("t")).alias("f")).first()["f"]
    assert folded == "ete sz o"


def test_general_numbers_are_those_of_c(spark):
    values = [0.0, 1.0, -3.0, 0.2, 245.3, 12.345678, 1234567.0, 999999.4, 999999.6, 1e-4, 9.99e-5, 1.5e-7, 100000.0, 1e6, -0.00012345678, 1e22]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", scalar.general_number(F.col("v")).alias("g")).collect()
    assert {r["v"]: r["g"] for r in rows} == {v: "%g" % v for v in values}


# Published check points of the projection on this ellipsoid (zone, easting, northing, latitude, longitude), to a metre.
POINTS = [(31, 448251.8, 5411932.7, 48.8582, 2.2945), (18, 583960.0, 4507523.0, 40.713, -74.0059 + 0.0)]


def test_geographic_coordinates(spark):
    for zone, east, north, lat, lon in POINTS:
        a, b = scalar.geographic(F.lit(east), F.lit(north), zone)
        r = spark.range(1).select(a.alias("a"), b.alias("b")).first()
        assert r["a"] == pytest.approx(lat, abs=2e-3) and r["b"] == pytest.approx(lon, abs=2e-3)
    # on the central meridian the northing is the scaled meridian arc, by numerical integration
    e2, deg, n = 0.0066943799901413165, 37.0, 4000
    radius = lambda p: 6378137.0 * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5
    h = math.radians(deg) / n
    arc = 0.9996 * h * sum(radius((i + 0.5) * h) for i in range(n))
    a, b = scalar.geographic(F.lit(500_000.0), F.lit(arc), 32)
    r = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert r["a"] == pytest.approx(deg, abs=1e-7) and r["b"] == pytest.approx(9.0, abs=1e-9)
    south, _ = scalar.geographic(F.lit(500_000.0), F.lit(10_000_000.0 - arc), 32, south=True)
    assert spark.range(1).select(south.alias("a")).first()["a"] == pytest.approx(-deg, abs=1e-7)


def test_series_of_fewer_than_three_readings_are_not_judged(spark):
    two = make(spark, [5, 5], minutes=6000)
    assert rules(longterm.long_term_anomalies(two)) == []
    assert rules(longterm.long_term_anomalies(make(spark, [5, None, 5], minutes=6000))) == []
    assert rules(longterm.long_term_anomalies(make(spark, [5, 5, 5], minutes=6000))) == ["L1"]


def test_runs_of_equal_times_are_determined(spark):
    rows = [("A", LEVEL, T0, 2.0), ("A", LEVEL, T0, 1.0), ("A", LEVEL, T0 + timedelta(hours=1), 2.0), ("A", LEVEL, T0 + timedelta(hours=1), 1.0)]
    m = spark.createDataFrame(rows, SCHEMA)
    assert series.trailing_run(m).first()["value"] == 2.0 and series.trailing_run(m).first()["n"] == 1
    assert sorted((r["value"], r["n"]) for r in series.value_runs(m.repartition(3)).collect()) == [(1.0, 1), (1.0, 1), (2.0, 1), (2.0, 1)]


def test_recursive_filter_against_a_loop(spark):
    import random

    rng = random.Random(5)
    values = [rng.uniform(-20, 40) if rng.random() < 0.3 else 0.0 for _ in range(3000)]
    for a, b in ((0.9, 0.5), (0.99, -0.2), (0.5, 0.0)):
        q, want = None, []
        for v in values:
            q = v if q is None else max(v, a * q + b)
            want.append(q)
        got = [r["filtered"] for r in series.recursive_filter(make(spark, values), a, b).orderBy("ts").collect()]
        assert got == pytest.approx(want, abs=1e-6)


def test_suppression_against_a_loop(spark):
    import random

    rng = random.Random(6)
    hours, at = [], 0.0
    for _ in range(200):
        at += rng.choice([0.5, 3, 10, 35, 36, 40, 100])
        hours.append(at)
    signals = spark.createDataFrame([("A", T0 + timedelta(hours=h)) for h in hours], "station string, ts timestamp_ntz")
    kept = []
    for h in hours:
        if not kept or h - kept[-1] >= 36:
            kept.append(h)
    assert [r["ts"] for r in crossing.suppress(signals, 36).orderBy("ts").collect()] == [T0 + timedelta(hours=h) for h in kept]


def test_lists_and_filters(spark):
    rows = [("0001", "Oued Béja", "marche", "B"), ("0002", "oued A", "arret", "A"), ("0010", "Mejerda", "arret", "A"), ("0011", None, "arret", None)]
    st = spark.createDataFrame(rows, "code_station string, nom string, etat string, gouvernorat string")
    assert [r["code_station"] for r in listing.search(st, " OUED ").orderBy("code_station").collect()] == ["0001", "0002"]
    assert [r["code_station"] for r in listing.search(st, "^001").orderBy("code_station").collect()] == ["0010", "0011"] and listing.search(st, " ").count() == 4
    assert [r["nom"] for r in listing.in_state(st, "arret", "A").collect()] == ["Mejerda", "oued A"] and listing.in_state(st).count() == 4
    kinds = spark.createDataFrame([("Pluviométrique",), ("Hydrométrique",), (None,)], "k string").select(*[c.alias(f"c{i}") for i, c in enumerate(listing.measures(F.col("k")))]).collect()
    assert [tuple(r) for r in kinds] == [(True, False), (False, True), (None, None)]
    alt = spark.createDataFrame([("0001", 12.0)], "code_station string, altitude_m double")
    assert {r["code_station"]: r["altitude_m"] for r in listing.with_altitude(st, alt).collect()} == {"0001": 12.0, "0002": None, "0010": None, "0011": None}
    m = make(spark, range(5)).union(make(spark, [0, 2, 1], RAIN))
    assert listing.between_times(m, T0 + timedelta(hours=1), T0 + timedelta(hours=2)).count() == 4 and listing.between_times(m, end=T0).count() == 2
    assert [r["value"] for r in listing.series_scan(m, "A", LEVEL).collect()] == [0, 1, 2, 3, 4]
    ext = {r["sensor"]: (r["amplitude"], r["rain_total"], r["n_wet"]) for r in listing.sensor_extremes(m).collect()}
    assert ext == {LEVEL: (4.0, None, None), RAIN: (2.0, 3.0, 2)}
    lags = spark.createDataFrame([("A", "1", 2.0), ("A", "2", 2.0), ("B", "1", 0.0)], "station string, sensor string, lag_h double")
    assert sorted((r["station"], r["sensor"]) for r in listing.worst_sensors(lags).collect()) == [("A", "1"), ("B", "1")]


def test_battery_details_are_ten_at_most(spark):
    m = make(spark, [10.5] * 15 + [12], BATTERY).union(make(spark, [10.5, 7.0], BATTERY, station="B"))
    got = instant.battery_details(m).collect()
    assert len(got) == 10 and {r["station"] for r in got} == {"A"} and sorted(r["rank"] for r in got) == list(range(1, 11))


def proposal(spark, rows):
    base = spark.createDataFrame(rows, "id string, station string, proposed string, provenance string, created_at timestamp_ntz, status string, sensors map<string,string>")
    extra = {c: F.lit(None).cast("string") for c in ("declared", "reason", "rules", "answered_by", "comment")} | {c: F.lit(None).cast("timestamp_ntz") for c in ("updated_at", "answered_at")}
    return base.withColumns(extra)


def test_proposals_are_synchronised(spark):
    t = lambda h: T0 + timedelta(hours=h)
    log = proposal(spark, [("p1", "A", "critique", "real", t(1), "en_attente", {"0001": "old"}), ("p2", "A", "arret", None, t(2), "en_attente", None), ("p3", "B", "arret", "real", t(3), "en_attente", None), ("p4", "C", "arret", None, t(0), "confirme", None)])
    detected = spark.createDataFrame([("A", "arret", "marche", True, "why", {"0001": "new"}, "L1", None), ("B", "marche", "marche", False, None, None, None, None), ("D", "critique", "marche", True, "new", {}, "L3", "real"), ("E", "marche", "arret", False, None, None, None, None)], "station string, state string, declared string, justified boolean, reason string, sensors map<string,string>, rules string, provenance string")
    now = F.lit(t(9)).cast("timestamp_ntz")
    assert {r["station"]: r["action"] for r in state.synchronise(log, detected, now, dry_run=True).collect()} == {"A": "enrich", "B": "close", "D": "open", "E": "ignore"}
    after = state.synchronise(log, detected, now)
    got = {r["id"] if r["station"] != "D" else "new": (r["station"], r["proposed"], r["status"], r["provenance"]) for r in after.collect()}
    assert got == {"p1": ("A", "arret", "en_attente", "real"), "p2": ("A", "arret", "caduque", None), "p3": ("B", "arret", "caduque", "real"), "p4": ("C", "arret", "confirme", None), "new": ("D", "critique", "en_attente", "real")}
    assert {r["action"] for r in state.synchronise(after, detected, now, dry_run=True).where("station in ('A', 'D')").collect()} == {"enrich"}
    waiting = state.pending_proposals(state.encoded(after)).collect()
    assert [(r["station"], r["sensors"], r["status_label"]) for r in waiting] == [("A", {"0001": "new"}, "En attente de vérification"), ("D", {}, "En attente de vérification")]
    assert [r["id"] for r in state.proposal_journal(after, "A").collect()] == ["p2", "p1"] and state.proposal_journal(after, limit=2).count() == 2


def test_what_is_enriched_takes_what_is_new_even_nothing(spark):
    t = lambda h: T0 + timedelta(hours=h)
    log = proposal(spark, [("p1", "A", "critique", "real", t(1), "en_attente", {"0001": "old"})]).withColumns({"declared": F.lit("marche"), "reason": F.lit("old"), "rules": F.lit("L1")})
    kind = "station string, state string, declared string, justified boolean, reason string, sensors map<string,string>, rules string, provenance string"
    now = F.lit(t(9)).cast("timestamp_ntz")
    after = state.synchronise(log, spark.createDataFrame([("A", "arret", "critique", True, None, None, None, None)], kind), now).first()
    assert (after["proposed"], after["declared"], after["reason"], after["sensors"], after["rules"], after["provenance"], after["created_at"]) == ("arret", "marche", None, {}, "", "real", t(1))
    strange = spark.createDataFrame([("A", "panne", "marche", True, None, None, None, None)], kind)
    with pytest.raises(Exception, match="unknown state: panne"):
        state.synchronise(log, strange, now).collect()
    assert state.synchronise(log, strange.withColumn("justified", F.lit(False)), now).first()["status"] == "caduque"


def test_history_rules_give_one_schema(spark):
    out = longterm.long_term_anomalies(make(spark, [1] + [2] * 80), replace(DEFAULTS, shift_min_days=2))
    assert tuple(out.columns) == anomalies.COLUMNS and "L1" in rules(out)


def test_injected_faults_are_found_and_healthy_series_are_not(spark):
    n = 16
    clean = synthetic.healthy(spark, n, days=90).persist()
    journal = {(r["station"], r["rule"]) for r in synthetic.fault_journal(spark, n).collect()}
    broken = synthetic.inject(clean, synthetic.fault_journal(spark, n)).persist()
    params = replace(DEFAULTS, silence_h=48.0)

    def found(m):
        rows = {(r["station"], r["rule"]) for r in longterm.long_term_anomalies(m, params).collect()}
        gaps = instant.steps_against_mode(m).where("kind = 'gap'").select("station").distinct().collect()
        return rows | {(r["station"], "R7") for r in gaps}

    assert found(clean) == set()
    assert journal <= found(broken)


def _brute_around(rain, level, before, window, after):
    out = {}
    for u in rain:
        d = u - window
        first, last = [v for t, v in level if d - before <= t <= d], [v for t, v in level if d < t <= u + after]
        known, later = [v for v in first if v is not None], [v for v in last if v is not None]
        out[u] = (len(first), statistics.median(known) if known else None, len(last), max(later, default=None))
    return out


def test_level_around_rain_against_brute_force(spark):
    rng = random.Random(9)
    rain = sorted({rng.randrange(20 * 24) for _ in range(60)})
    level = [(rng.randrange(-48, 20 * 24), rng.choice([None, float(rng.randrange(7)), rng.random()])) for _ in range(300)]
    at = F.timestamp_micros(F.col("h") * HOUR + 1_704_067_200_000_000).cast("timestamp_ntz")
    asked = spark.createDataFrame([("A", h) for h in rain] + [("B", 5)], "station string, h long").select("station", "h", at.alias("ts"), micros(at).alias("u"), (micros(at) - 24 * HOUR).alias("d"))
    readings = spark.createDataFrame([("A", h, v) for h, v in level] + [("C", 1, 1.0)], "station string, h long, value double").select("station", at.alias("ts"), "value")
    got = crossing._around(asked, readings, 12, 24 * HOUR, 36).join(asked.select("station", "ts", "h"), ["station", "ts"]).collect()
    want = _brute_around(rain, level, 12, 24, 36)
    assert {r["h"]: (r["n_before"], r["base"], r["n_after"], r["peak"]) for r in got if r["station"] == "A"} == want
    assert [(r["n_before"], r["base"], r["n_after"], r["peak"]) for r in got if r["station"] == "B"] == [(0, None, 0, None)]


def test_rain_and_level_are_not_paired(spark):
    each = lambda step, value: spark.range(40_000).select(F.lit("A").alias("station"), F.timestamp_micros(F.col("id") * step).cast("timestamp_ntz").alias("ts"), value.alias("value"))
    rain, level = each(5_400_000, F.lit(1.0)), each(5_400_001, F.col("id").cast("double"))  # 60 hours: most of 1.6 billion pairs are near
    got = crossing.response_candidates(rain, level, replace(DEFAULTS, response_rain_mm=10.0)).groupBy("verdict").agg(F.count("*").alias("n"), F.max("mm").alias("mm"), F.max("peak").alias("peak"))
    assert {r["verdict"]: r["n"] for r in got.collect()}.keys() <= {"few_before", "already_high", "response"}
    assert got.agg(F.sum("n"), F.max("mm"), F.max("peak")).first() == (40_000 - 9, 16_000.0, 39_999.0)
