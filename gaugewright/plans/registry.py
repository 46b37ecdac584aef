"""Named queries with their SQL, and the views of the driver tables that they run over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its DuckDB SQL if SQL can express it."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings from the event table: 20 stations by user, sensors by event type."""
    e = table(spark, sf_dir, "events")
    station = F.concat(F.lit("S"), F.lpad((F.col("user_id") % 20).cast("string"), 2, "0"))
    return e.select(station.alias("station"), F.col("event_type").alias("sensor"), F.col("ts").cast("timestamp_ntz").alias("ts"), "value", "props", "event_id")


#: The same view in SQL.
M = "m AS (SELECT 'S' || lpad((user_id % 20)::VARCHAR, 2, '0') AS station, event_type AS sensor, ts, value, props, event_id FROM events)"


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same readings under the sensor codes that the rules know; levels and discharges in steps of 20."""
    m = measurements(spark, sf_dir)
    code = F.when(F.col("sensor") == "click", "0001").when(F.col("sensor") == "view", "0002").when(F.col("sensor") == "error", "0006").when(F.col("sensor") == "purchase", "0007").otherwise("0099")
    value = F.when(F.col("sensor").isin("click", "purchase"), F.floor(F.col("value") / 20).cast("double")).otherwise(F.col("value"))
    return m.withColumns({"sensor": code, "value": value})


#: The same in SQL, under the same name as the plain view.
GAUGES = """m AS (SELECT 'S' || lpad((user_id % 20)::VARCHAR, 2, '0') AS station, CASE event_type WHEN 'click' THEN '0001' WHEN 'view' THEN '0002' WHEN 'error' THEN '0006' WHEN 'purchase' THEN '0007' ELSE '0099' END AS sensor, ts,
CASE WHEN event_type IN ('click', 'purchase') THEN floor(value / 20) ELSE value END AS value, props, event_id FROM events)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A station for every user, so that the network grows with the table."""
    return table(spark, sf_dir, "events").select(F.concat(F.lit("S"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("station"))


#: The same in SQL, under the same name as the readings.
NODES = "m AS (SELECT 'S' || lpad(user_id::VARCHAR, 6, '0') AS station FROM events)"


def _number() -> Column:
    return F.substring("station", 2, 9).cast("int")


def stations_frame(m: DataFrame) -> DataFrame:
    """Coordinates (metres), altitude and origin of the stations, from their numbers: a hundred on each map sheet."""
    n = _number()
    s = m.select("station").distinct()
    return s.select("station", ((n * 37) % 100 * 1000.0 + F.floor(n / 100) * 100_000.0).alias("x"), ((n * 61) % 100 * 1000.0).alias("y"), F.when(n % 5 != 0, (n * 53 % 400).cast("double")).alias("altitude"), F.when(n % 2 == 0, "real").otherwise("simulated").alias("origin"))


N = "substr(station, 2)::INT"
STATIONS = f"st AS (SELECT station, ({N} * 37) % 100 * 1000.0::DOUBLE + ({N} // 100) * 100000.0::DOUBLE AS x, ({N} * 61) % 100 * 1000.0::DOUBLE AS y, CASE WHEN {N} % 5 <> 0 THEN ({N} * 53 % 400)::DOUBLE END AS altitude, CASE WHEN {N} % 2 = 0 THEN 'real' ELSE 'simulated' END AS origin FROM (SELECT DISTINCT station FROM m))"


def tree_edges(m: DataFrame) -> DataFrame:
    """Directed edges of a binary tree of stations (child to parent), with lengths and some obstacles."""
    e = m.select(_number().alias("n"), F.length("station").alias("w")).distinct().where("n > 1")
    name = lambda c: F.concat(F.lit("S"), F.lpad(c.cast("string"), F.col("w") - 1, F.lit("0")))
    obstacle = F.when(F.col("n") % 7 == 0, "barrage").when(F.col("n") % 5 == 0, "plan_eau").when(F.col("n") % 6 == 0, "gap")
    return e.select(name(F.col("n")).alias("src"), name(F.floor(F.col("n") / 2)).alias("dst"), (F.col("n") * 1371.7).alias("length"), obstacle.alias("obstacle"))


EDGES = "e AS (SELECT 'S' || lpad(n::VARCHAR, w - 1, '0') AS src, 'S' || lpad((n // 2)::VARCHAR, w - 1, '0') AS dst, n * 1371.7::DOUBLE AS length, CASE WHEN n % 7 = 0 THEN 'barrage' WHEN n % 5 = 0 THEN 'plan_eau' WHEN n % 6 = 0 THEN 'gap' END AS obstacle FROM (SELECT DISTINCT substr(station, 2)::INT AS n, length(station)::INT AS w FROM m) WHERE n > 1)"


def rounded(df: DataFrame, digits: int = 4, *names: str) -> DataFrame:
    """Some double columns rounded (all of them without names), days as text and counts as long."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float") and (not names or name in names):
            c = F.round(c, digits)
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind == "boolean":
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)
