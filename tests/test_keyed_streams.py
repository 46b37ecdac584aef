"""Silence, sliding sums and sessions over streams that come in pieces, late, shuffled and twice."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewright.functions.selection import lowest_mode_of
from gaugewright.operators import series
from gaugewright.streaming import keyed, monitor

KIND = "station string, sensor string, ts timestamp_ntz, value double"
T0 = datetime(2024, 1, 1)


@pytest.fixture
def river(spark, tmp_path):
    """put(rows) adds a file; run(name, f) reads what is new into a table that it returns."""

    class River:
        def put(self, rows):
            spark.createDataFrame([(a, "s", T0 + timedelta(minutes=m), v) for a, m, v in rows], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))

        def run(self, name, f, files=100):
            stream = f(spark.readStream.schema(KIND).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "src")))
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"state-{name}")).trigger(availableNow=True).start()
            q.awaitTermination()
            return spark.read.schema(stream.schema).parquet(str(tmp_path / name))

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield River()
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def verdicts(df):
    return sorted((r["station"], r["verdict"], (r["last_ts"] - T0).seconds // 60 + (r["last_ts"] - T0).days * 1440, (r["at"] - T0).seconds // 60 + (r["at"] - T0).days * 1440) for r in df.collect())


def test_silence_is_told_once_and_so_is_the_return(river):
    river.put([("A", 0, 1.0), ("B", 0, 1.0)])
    assert verdicts(river.run("s", keyed.silence)) == []
    river.put([("B", 300, 1.0)])
    assert verdicts(river.run("s", keyed.silence)) == []
    river.put([("B", 400, 1.0)])  # the network's clock passes A's limit
    told = [("A", "silent", 0, 360)]
    assert verdicts(river.run("s", keyed.silence)) == told
    river.put([("B", 401, 1.0), ("A", 0, 1.0)])  # nothing new of A
    assert verdicts(river.run("s", keyed.silence)) == told
    river.put([("A", 700, 2.0), ("B", 900, 1.0)])  # A is back; B was away, which the same batch shows
    told += [("A", "returned", 0, 700), ("B", "returned", 401, 900), ("B", "silent", 401, 761)]
    assert verdicts(river.run("s", keyed.silence)) == sorted(told)
    river.put([("A", 700, 2.0), ("B", 900, 1.0)])  # the same readings again
    assert verdicts(river.run("s", keyed.silence)) == sorted(told)


@pytest.mark.parametrize("pieces", [1, 4])
def test_sliding_sums_equal_the_batch_frame(spark, river, pieces):
    rng = random.Random(pieces)
    rows = [(rng.choice("ab"), m, float(rng.randrange(9)) if rng.random() > 0.1 else None) for m in sorted(rng.randrange(1000) for _ in range(120))]
    arrival = sorted(rows, key=lambda r: r[1] + rng.randrange(100))  # out of order by less than the lateness
    for k in range(pieces):
        river.put(arrival[k * len(rows) // pieces : (k + 1) * len(rows) // pieces])
        if k < pieces - 1:
            river.run("w", lambda s: keyed.sliding_sums(s, 2, "2 hours"))
    river.put([("clock", 5000, 0.0)])
    got = river.run("w", lambda s: keyed.sliding_sums(s, 2, "2 hours")).where("station <> 'clock'")
    plain = spark.createDataFrame([(a, "s", T0 + timedelta(minutes=m), v) for a, m, v in rows], KIND)
    want = series.rolling_sum(plain, 2)
    key = lambda df: sorted(((r["station"], r["ts"], r["value"], r["rolling"]) for r in df.collect()), key=str)
    assert key(got.withColumn("ts", F.col("ts").cast("timestamp_ntz"))) == key(want)


def test_sessions_are_the_blocks_of_a_history(spark, river):
    rng = random.Random(3)
    minute, rows = 0, []
    for _ in range(80):
        minute += rng.choice([10, 10, 10, 15, 16, 45])  # a gap of exactly 1.5 steps stays inside
        rows.append(("a", minute, 1.0))
    river.put(rows)
    river.put([("clock", 9000, 0.0)])
    plain = spark.createDataFrame([(a, "s", T0 + timedelta(minutes=m), v) for a, m, v in rows], KIND)
    usual = lowest_mode_of(series.with_step(plain).where("step_s is not null"), ["station", "sensor"], "step_s", "usual_s")
    got = river.run("b", lambda s: monitor.sessions_by_step(s, usual), files=1).where("station = 'a'")
    key = lambda df: sorted((r["first_ts"], r["last_ts"], r["n"]) for r in df.collect())
    assert key(got) == key(series.continuous_blocks(plain, step="mode")) and got.count() > 5


def test_frame_sums_against_brute_force():
    rng = np.random.default_rng(5)
    for size in (1, 30, 400):
        us = np.sort(rng.integers(-3000, 3000, size))
        values = np.where(rng.random(size) < 0.1, np.nan, rng.integers(0, 9, size).astype(float))
        for span in (10, 240, 1000):
            total, n = keyed.frame_sums(us, values, span)
            inside = [(us > t - span) & (us <= t) & ~np.isnan(values) for t in us]
            assert total.tolist() == [values[i].sum() for i in inside] and n.tolist() == [i.sum() for i in inside]


def test_a_long_frame_of_a_stream_costs_no_more_a_row(spark, river, tmp_path):
    at = F.timestamp_micros(F.col("id") * 360_000 + 1_704_067_200_000_000).cast("timestamp_ntz")
    rows = spark.range(100_000).select(F.lit("a").alias("station"), F.lit("s").alias("sensor"), at.alias("ts"), F.lit(1.0).alias("value"))
    rows.write.mode("append").parquet(str(tmp_path / "src"))
    river.put([("clock", 10_000_000, 0.0)])
    got = river.run("long", lambda s: keyed.sliding_sums(s, 24)).where("station = 'a'")
    assert got.agg(F.count("*"), F.sum("rolling"), F.max("n")).first() == (100_000, 100_000 * 100_001 / 2, 100_000)
