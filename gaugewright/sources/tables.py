"""Dimension tables and reports: semicolon-separated CSV with identifiers as strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the station and pair tables.
STATION_CONFIG = "code_station string, nom string, gouvernorat string, type_station string, pluie_min double, pluie_max double, cote_min double, cote_max double, debit_min double, debit_max double, altitude_m double, x double, y double"
PAIRS = "station_amont string, nom_amont string, station_aval string, nom_aval string, distance_km double, barrages_entre int, franchit string, fiabilite string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table by the names in its header, in any order; columns that it lacks are null. (SRC-03, SRC-05)

    Everything is read as text first, so that identifiers keep their zeros; a byte-order mark is no part of the header.
    """
    raw = spark.read.csv(path, sep=";", header=True, inferSchema=False, encoding="UTF-8")
    names = {c.lstrip("﻿").strip().lower(): c for c in raw.columns}
    wanted = [f.strip().split(" ") for f in schema.split(",")]
    return raw.select(*[(F.col(f"`{names[n]}`").try_cast(t) if n in names else F.lit(None).cast(t)).alias(n) for n, t in wanted])


def station_limits(config: DataFrame, sensors: dict[str, tuple[str, str]]) -> DataFrame:
    """Each station's bounds by sensor, where both are given: station, sensor, s_low, s_high. (SRC-03)"""
    each = F.array(*[F.struct(F.lit(s).alias("sensor"), F.col(a).alias("s_low"), F.col(b).alias("s_high")) for s, (a, b) in sensors.items()])
    return config.select(F.col("code_station").alias("station"), F.explode(each).alias("l")).select("station", "l.*").where("s_low is not null and s_high is not null")


def station_label(code, name):
    """``code (name)``, or a name that says it isn't listed. (PRJ-03)"""
    return F.concat(code, F.lit(" ("), F.coalesce(name, F.lit("hors liste")), F.lit(")"))


def write_csv(df: DataFrame, path: str) -> None:
    """A report as semicolon-separated CSV with a byte-order mark and a header. (SNK-05)"""
    first, *rest = df.columns
    df.withColumnRenamed(first, "\ufeff" + first).select("\ufeff" + first, *rest).write.mode("overwrite").csv(path, sep=";", header=True, encoding="UTF-8")


def context(stations: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """What rules across stations need: station, x, y (both known), altitude (null if it is no number) and origin. (SRC-04)

    ``stations`` has the columns of the station table; ``origins``, if given, station and origin.
    """
    found = stations.where("x is not null and y is not null").select(F.col("code_station").alias("station"), F.col("x").try_cast("double").alias("x"), F.col("y").try_cast("double").alias("y"), F.col("altitude_m").try_cast("double").alias("altitude"))
    return found.join(origins.select("station", "origin"), "station", "left") if origins is not None else found.withColumn("origin", F.lit(None).cast("string"))


def write_facts(m: DataFrame, path: str) -> None:
    """A fact table laid out by sensor and sorted by station and time, so that scans of one sensor or station read little. (SNK-06)"""
    m.repartitionByRange("sensor", "station").sortWithinPartitions("sensor", "station", "ts").write.mode("overwrite").partitionBy("sensor").parquet(path)
