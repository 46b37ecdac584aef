"""Queries that run a stream over a driver table to its end, and what SQL says of the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.functions.selection import lowest_mode_of
from gaugewright.operators import series
from gaugewright.plans.registry import M, measurements, query, rounded, table
from gaugewright.session import shared_path
from gaugewright.streaming import keyed, monitor


def _readings(spark, sf_dir) -> DataFrame:
    """The readings as a stream of the event table's files."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a stream takes one file by a pattern only
    station = F.concat(F.lit("S"), F.lpad((F.col("user_id") % 20).cast("string"), 2, "0"))
    return events.select(station.alias("station"), F.col("event_type").alias("sensor"), F.col("ts").cast("timestamp").alias("ts"), "value")


def _to_its_end(stream: DataFrame) -> DataFrame:
    """What a stream gives until all files are read, from a table in the shared folder."""
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, "stream")
    running = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


_GAPS = f"WITH {M}, t AS (SELECT DISTINCT station, sensor, ts FROM m), g AS (SELECT *, lead(ts) OVER (PARTITION BY station, sensor ORDER BY ts) AS next FROM t), c AS (SELECT max(ts) - INTERVAL 10 MINUTE AS now FROM m)"


@query(f"""{_GAPS}, s AS (SELECT station, sensor, ts AS last_ts, next FROM g, c WHERE next - ts >= INTERVAL 6 HOUR OR (next IS NULL AND ts + INTERVAL 6 HOUR <= now))
SELECT station, sensor, 'silent' AS verdict, last_ts, last_ts + INTERVAL 6 HOUR AS at FROM s UNION ALL SELECT station, sensor, 'returned', last_ts, next FROM s WHERE next IS NOT NULL""")
def stream_silence(spark, sf_dir):
    return _plain(_to_its_end(keyed.silence(_readings(spark, sf_dir))))


@query(f"""WITH {M}, r AS (SELECT station, sensor, ts, value, sum(value) OVER w AS rolling, count(value) OVER w AS n FROM m WINDOW w AS (PARTITION BY station, sensor ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW))
SELECT station, sensor, ts, value, round(rolling, 4) AS rolling, n FROM r WHERE ts < (SELECT max(ts) - INTERVAL 1 DAY FROM m)""")
def stream_sliding_sums(spark, sf_dir):
    return rounded(_plain(_to_its_end(keyed.sliding_sums(_readings(spark, sf_dir)))), 4, "rolling")


@query(f"""WITH {M}, s AS (SELECT station, sensor, ts, value, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY station, sensor ORDER BY ts, value) AS step FROM m), k AS (SELECT station, sensor, step, count(*) AS c FROM s WHERE step IS NOT NULL GROUP BY ALL), u AS (SELECT station, sensor, step AS usual FROM (SELECT *, row_number() OVER (PARTITION BY station, sensor ORDER BY c DESC, step) AS rn FROM k) WHERE rn = 1),
b AS (SELECT *, sum(coalesce((step > 1.5 * usual)::INT, 0)) OVER (PARTITION BY station, sensor ORDER BY ts, value) AS block FROM s LEFT JOIN u USING (station, sensor))
SELECT station, sensor, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM b GROUP BY station, sensor, block""")
def sessions_by_step(spark, sf_dir):
    m = measurements(spark, sf_dir)
    usual = lowest_mode_of(series.with_step(m).where("step_s is not null"), ["station", "sensor"], "step_s", "usual_s")
    return monitor.sessions_by_step(m, usual, late=None)


def _plain(df: DataFrame) -> DataFrame:
    """Times without a zone, as the tables have them."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])
