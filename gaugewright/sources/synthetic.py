"""Synthetic readings and injected faults with a ground-truth journal, for tests and demonstrations.

Everything is a function of the row's station, sensor and time and of a seed, by hashes, so that any
number of stations can be made in parallel and again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.functions.stats import DAY, HOUR, micros
from gaugewright.params import BATTERY, DISCHARGE, LEVEL, RAIN

START = "2024-01-01 00:00:00"

#: What each fault does, by the rule that should find it, and the sensor that it strikes.
FAULTS = {"L1": LEVEL, "L2": BATTERY, "L3": LEVEL, "L4": DISCHARGE, "L5": LEVEL, "L6": LEVEL, "R7": LEVEL, "L2b": BATTERY}


def _noise(*keys: Column | str) -> Column:
    """A number from -1 to 1 that depends on the keys alone."""
    return F.pmod(F.xxhash64(*keys), F.lit(2_000_001)) / 1_000_000.0 - 1.0


def healthy(spark: SparkSession, stations: int, days: int = 120, step_h: int = 1, seed: int = 1) -> DataFrame:
    """Readings of level, battery, rain and discharge of healthy stations, each at a regular step."""
    rows = days * 24 // step_h
    grid = spark.range(stations * rows).select(F.format_string("ST%05d", F.floor(F.col("id") / rows)).alias("station"), (F.col("id") % rows).alias("_i"))
    hour = F.col("_i") * step_h
    grid = grid.withColumn("ts", (F.timestamp_micros(micros(F.expr(f"timestamp_ntz'{START}'")) + hour * HOUR)).cast("timestamp_ntz")).withColumn("_h", hour)
    day = F.floor(F.col("_h") / 24)
    storm = F.when((F.abs(_noise(F.lit(seed), day)) > 0.85) & (F.col("_h") % 24 < 6), 2.0 + F.abs(_noise(F.lit(seed), "station", day))).otherwise(0.0)
    level = 100 + 8 * F.sin(2 * math.pi * F.col("_h") / (24 * 9)) + 6 * _noise(F.lit(seed + 1), "station", "_i")
    battery = 12.45 + 0.25 * F.sin(2 * math.pi * (F.col("_h") % 24) / 24) + 0.05 * _noise(F.lit(seed + 2), "station", "_i")
    discharge = 0.02 * F.pow(F.greatest(level - 60, F.lit(0.0)), F.lit(1.5))
    each = F.array(*[F.struct(F.lit(s).alias("sensor"), v.cast("double").alias("value")) for s, v in ((LEVEL, level), (BATTERY, battery), (RAIN, storm), (DISCHARGE, discharge))])
    return grid.select("station", "ts", F.explode(each).alias("s")).select("station", "s.sensor", "ts", "s.value")


def fault_journal(spark: SparkSession, stations: int) -> DataFrame:
    """One fault a station, in turn, so that none masks another: station, sensor, rule."""
    names = F.array(*[F.lit(r) for r in FAULTS])
    sensor = F.create_map(*[F.lit(x) for kv in FAULTS.items() for x in kv])
    rows = spark.range(stations).select(F.format_string("ST%05d", "id").alias("station"), F.element_at(names, (F.col("id") % len(FAULTS) + 1).cast("int")).alias("rule"))
    return rows.select("station", F.element_at(sensor, F.col("rule")).alias("sensor"), "rule")


def inject(m: DataFrame, journal: DataFrame) -> DataFrame:
    """Readings with the journal's faults: frozen, drifting, silent, spiked, ramping, shifted or missing tails."""
    spans = m.groupBy("station", "sensor").agg(F.max(micros("ts")).alias("_last"), F.min(micros("ts")).alias("_first"), F.avg("value").alias("_mean"))
    joined = m.join(journal, ["station", "sensor"], "left").join(spans, ["station", "sensor"])
    age = (F.col("_last") - micros("ts")) / float(DAY)
    tail = lambda days: age <= days
    rule = F.col("rule")
    value = (
        F.when((rule == "L1") & tail(5), 245.3)
        .when((rule == "L2") & tail(30), F.col("value") - 0.08 * (30 - age))
        .when((rule == "L2b") & tail(12), F.least(F.col("value"), F.lit(12.0)))
        .when((rule == "L4") & (age <= 0.25), 20 * F.col("_mean") + 50)
        .when((rule == "L5") & tail(7), F.col("value") + 90 * (7 - age) / 7)
        .when((rule == "L6") & (micros("ts") > (F.col("_first") + F.col("_last")) / 2), F.col("value") + 60)
        .otherwise(F.col("value"))
    )
    lost = ((rule == "L3") & tail(3)) | ((rule == "R7") & (age > 10) & (age < 10.5))
    return joined.withColumn("value", value).where(~F.coalesce(lost, F.lit(False))).select("station", "sensor", "ts", "value")


def inject_instant(m: DataFrame, seed: int = 1) -> DataFrame:
    """Readings with faults of single rows, chosen by hash: no value but a code, rain and level out of bounds, repeated times. (SNK-04)

    Rows: station, sensor, ts, value, code; ``write_telemetry`` makes files of them.
    """
    draw = F.abs(_noise(F.lit(seed), "station", "sensor", micros("ts")))
    size = F.abs(_noise(F.lit(seed + 1), "station", "sensor", micros("ts")))
    silent = draw < 0.004
    value = F.when(silent, None).when((draw < 0.007) & (F.col("sensor") == RAIN), 26 + 19 * size).when((draw < 0.009) & (F.col("sensor") == LEVEL), -1 - 19 * size).otherwise(F.col("value"))
    rows = m.withColumns({"value": value, "code": F.when(silent, "10")})
    again = F.abs(_noise(F.lit(seed + 2), "station", "sensor", micros("ts"))) < 0.002
    times = F.when(again, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("_copy", F.explode(times)).select("station", "sensor", "ts", "value", "code")
