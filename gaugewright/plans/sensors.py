"""Queries over the measurement view: summaries, primitives and the instant and history rules."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.functions.scalar import fold_accents, geographic, normalise_faults, split_faults
from gaugewright.functions.stats import DAY, micros
from gaugewright.operators import anomalies, instant, listing, longterm, series
from gaugewright.params import DEFAULTS
from gaugewright.plans.registry import GAUGES, M, gauges, measurements, query, rounded, table

BUCKET = "b AS (SELECT station, sensor, ts, floor(value / 20) AS value FROM m)"
_BY = "PARTITION BY station, sensor"


def _bucketed(spark: SparkSession, sf_dir: str, width: float = 20.0) -> DataFrame:
    return measurements(spark, sf_dir).select("station", "sensor", "ts", F.floor(F.col("value") / width).cast("double").alias("value"))


@query(f"WITH {M} SELECT station, sensor, strftime(ts::DATE, '%Y-%m-%d') AS day, round(median(value), 4) AS median_value, count(*) AS n FROM m GROUP BY ALL")
def daily_median(spark, sf_dir):
    return rounded(series.daily_median(measurements(spark, sf_dir)))


@query(f"WITH {M} SELECT count(*) AS n, count(DISTINCT station) AS n_stations, min(ts) AS first_ts, max(ts) AS last_ts FROM m")
def network_stats(spark, sf_dir):
    return series.network_stats(measurements(spark, sf_dir))


@query(f"WITH {M} SELECT station, sensor, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6 / nullif(count(*) - 1, 0), 4) AS step_min FROM m GROUP BY ALL")
def series_summary(spark, sf_dir):
    return rounded(series.series_summary(measurements(spark, sf_dir)))


@query(f"WITH {M} SELECT DISTINCT station, sensor FROM m")
def series_list(spark, sf_dir):
    return listing.series_list(measurements(spark, sf_dir))


@query(f"WITH {M} SELECT station, count(*) || '|' || strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS signature FROM m GROUP BY ALL")
def change_signature(spark, sf_dir):
    return listing.change_signature(measurements(spark, sf_dir), "station")


def _limits(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    defaults = spark.createDataFrame([("click", 1.0, 150.0), ("view", 2.0, 100.0), ("error", 0.5, 120.0), ("purchase", 1.0, 200.0)], "sensor string, d_low double, d_high double")
    own = spark.createDataFrame([("S00", "click", 5.0, 90.0), ("S01", "click", 3.0, None), ("S02", "view", 0.0, 60.0)], "station string, sensor string, s_low double, s_high double")
    return defaults, own


_LIMITED = f"""WITH {M}, d AS (SELECT * FROM (VALUES ('click', 1.0::DOUBLE, 150.0::DOUBLE), ('view', 2.0, 100.0), ('error', 0.5, 120.0), ('purchase', 1.0, 200.0)) t(sensor, d_low, d_high)),
o AS (SELECT * FROM (VALUES ('S00', 'click', 5.0::DOUBLE, 90.0::DOUBLE), ('S01', 'click', 3.0, NULL), ('S02', 'view', 0.0, 60.0)) t(station, sensor, s_low, s_high)),
l AS (SELECT m.*, CASE WHEN s_low IS NOT NULL AND s_high IS NOT NULL THEN s_low ELSE d_low END AS low, CASE WHEN s_low IS NOT NULL AND s_high IS NOT NULL THEN s_high ELSE d_high END AS high FROM m LEFT JOIN o USING (station, sensor) LEFT JOIN d USING (sensor))"""


def _limited(spark, sf_dir):
    return series.with_limits(measurements(spark, sf_dir), *_limits(spark))


@query(f"{_LIMITED} SELECT DISTINCT station, sensor, low, high FROM l")
def limits_lookup(spark, sf_dir):
    return _limited(spark, sf_dir).select("station", "sensor", "low", "high").distinct()


@query(f"{_LIMITED} SELECT station, sensor, count(*) AS n, round(max(abs(value)), 4) AS metric, min(ts) AS ts FROM l WHERE value < low OR value > high GROUP BY ALL")
def out_of_range_flag(spark, sf_dir):
    found = instant.range_anomalies(_limited(spark, sf_dir).withColumn("corrects", F.lit(False)))
    return rounded(found.select("station", "sensor", F.col("n_points").alias("n"), "metric", "ts"))


@query(f"WITH {M} SELECT station, sensor, count(*) AS n, round(min(value - 20), 4) AS metric, min(ts) AS ts FROM m WHERE value - 20 < 0 GROUP BY ALL")
def negative_value(spark, sf_dir):
    m = measurements(spark, sf_dir).withColumns({"value": F.col("value") - 20, "low": F.lit(0.0)})
    return rounded(instant.negative_values(m).select("station", "sensor", F.col("n_points").alias("n"), "metric", "ts"))


@query(f"""{_LIMITED}, v AS (SELECT event_id, station, sensor, value * 1.0003 AS value, low, high FROM l), g AS (SELECT station, sensor, median(value) FILTER (WHERE NOT coalesce(value < low OR value > high, false)) AS med FROM v GROUP BY ALL)
SELECT event_id, round(value, 8) AS value_raw, round(CASE WHEN coalesce(value < low OR value > high, false) THEN round(med, 2) ELSE value END, 8) AS value, coalesce(value < low OR value > high, false)::VARCHAR AS corrected FROM v JOIN g USING (station, sensor)""")
def rain_correction(spark, sf_dir):
    rows = _limited(spark, sf_dir).withColumns({"value": F.col("value") * 1.0003, "corrects": F.lit(True)})
    return rounded(instant.correct(rows).select("event_id", "value_raw", "value", "corrected"), 8)


@query(f"""WITH {M}, s AS (SELECT station, sensor, count(*) FILTER (WHERE value <= 8) AS a, count(*) FILTER (WHERE value > 8 AND value <= 11) AS b, count(*) FILTER (WHERE value > 200) AS c, min(ts) FILTER (WHERE value <= 8) AS ta, min(ts) FILTER (WHERE value > 8 AND value <= 11) AS tb, min(ts) FILTER (WHERE value > 200) AS tc FROM m GROUP BY ALL)
SELECT station, sensor, 'BAT-a' AS rule, a AS n_points, ta AS ts FROM s WHERE a > 0 UNION ALL SELECT station, sensor, 'BAT-b', b, tb FROM s WHERE a = 0 AND b > 0 UNION ALL SELECT station, sensor, 'BAT-c', c, tc FROM s WHERE c > 0""")
def battery_levels(spark, sf_dir):
    params = replace(DEFAULTS, battery_overcharge=200.0)
    return instant.battery_levels(measurements(spark, sf_dir), params).select("station", "sensor", "rule", "n_points", "ts")


@query(f"WITH {M}, c AS (SELECT *, CASE WHEN value < 5 THEN json_extract_string(props, '$.k') END AS code FROM m) SELECT station, sensor, count(*) AS n, string_agg(DISTINCT code, ', ' ORDER BY code) AS codes, min(ts) AS first_ts, max(ts) AS last_ts FROM c WHERE code IS NOT NULL GROUP BY ALL")
def silent_codes(spark, sf_dir):
    m = measurements(spark, sf_dir).withColumn("code", F.when(F.col("value") < 5, F.get_json_object("props", "$.k")))
    return instant.silent_codes(m)


@query(f"WITH {M} SELECT station, sensor, strftime(ts::DATE, '%Y-%m-%d') AS day, count(*) AS n_points, min(ts) AS ts FROM m GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT floor(value / 60)) = 1")
def flatline_full(spark, sf_dir):
    m = _bucketed(spark, sf_dir, 60.0).withColumn("day", F.to_date("ts"))
    found = instant.flatline_full(m, keys=("station", "sensor", "day"), quiet_zero=())
    return rounded(found.select("station", "sensor", F.to_date("ts").alias("day"), "n_points", "ts"))


_RUNS = f"""{BUCKET}, c AS (SELECT *, CASE WHEN lag(value) OVER w IS NOT DISTINCT FROM value THEN 0 ELSE 1 END AS ch FROM b WINDOW w AS ({_BY} ORDER BY ts, value)),
i AS (SELECT *, sum(ch) OVER ({_BY} ORDER BY ts) AS run FROM c), r AS (SELECT station, sensor, run, any_value(value) AS value, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS hours FROM i GROUP BY station, sensor, run)"""


@query(f"WITH {M}, {_RUNS} SELECT station, sensor, value, n, first_ts, last_ts, round(hours, 4) AS hours FROM r WHERE n >= 3")
def value_runs(spark, sf_dir):
    return rounded(series.value_runs(_bucketed(spark, sf_dir)).where("n >= 3"))


@query(f"WITH {M}, {_RUNS}, k AS (SELECT *, row_number() OVER ({_BY} ORDER BY hours DESC, first_ts) AS rn FROM r) SELECT station, sensor, n AS n_points, first_ts AS ts, round(hours, 4) AS metric FROM k WHERE rn = 1 AND hours >= 6")
def flatline_longest(spark, sf_dir):
    found = instant.flatline_longest(_bucketed(spark, sf_dir), quiet_zero=())
    return rounded(found.select("station", "sensor", "n_points", "ts", "metric"))


@query(f"WITH {M} SELECT station, sensor, strftime(ts::DATE, '%Y-%m-%d') AS day, count(*) AS n FROM m GROUP BY ALL HAVING bool_and(coalesce(floor(value / 20) = 0, false))")
def all_zero_series(spark, sf_dir):
    m = _bucketed(spark, sf_dir).withColumn("day", F.to_date("ts"))
    found = instant.all_zeros(m, ("station", "sensor", "day"))
    return rounded(found.select("station", "sensor", F.to_date("ts").alias("day"), F.col("n_points").alias("n")))


@query("SELECT l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_shipdate HAVING count(*) > 1")
def duplicate_timestamps(spark, sf_dir):
    rows = instant.duplicate_timestamps(table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_shipdate").alias("ts")), ["l_suppkey"])
    return rows.groupBy("l_suppkey", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


_STEPS = f"""WITH {M}, h AS (SELECT station, sensor, date_trunc('hour', ts) AS ts, value FROM m), s AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER ({_BY} ORDER BY ts, value)) / 1e6 AS step_s FROM h),
f AS (SELECT station, sensor, step_s, count(*) AS c FROM s WHERE step_s IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER ({_BY} ORDER BY c DESC, step_s) AS rn FROM f), j AS (SELECT s.*, k.step_s AS mode_s FROM s JOIN k USING (station, sensor) WHERE rn = 1)"""


def _hourly_steps(spark, sf_dir):
    m = measurements(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return instant.steps_against_mode(m)


@query(f"{_STEPS} SELECT station, sensor, count(*) AS n, max(step_s) AS longest_s, min(mode_s) AS mode_s FROM j WHERE step_s <= 1.5 * mode_s AND step_s <> mode_s GROUP BY ALL")
def irregular_step(spark, sf_dir):
    return _hourly_steps(spark, sf_dir).where("kind = 'irregular'").groupBy("station", "sensor").agg(F.count("*").alias("n"), F.max("step_s").alias("longest_s"), F.min("mode_s").alias("mode_s"))


@query(f"{_STEPS} SELECT station, sensor, count(*) AS n, max(step_s) AS longest_s, min(mode_s) AS mode_s FROM j WHERE step_s > 1.5 * mode_s GROUP BY ALL")
def data_gap(spark, sf_dir):
    return _hourly_steps(spark, sf_dir).where("kind = 'gap'").groupBy("station", "sensor").agg(F.count("*").alias("n"), F.max("step_s").alias("longest_s"), F.min("mode_s").alias("mode_s"))


@query(f"WITH {M}, {_RUNS}, k AS (SELECT *, row_number() OVER ({_BY} ORDER BY run DESC) AS rn FROM r) SELECT station, sensor, value, n, first_ts, last_ts, round(hours, 4) AS hours FROM k WHERE rn = 1")
def trailing_flatline(spark, sf_dir):
    return rounded(series.trailing_run(_bucketed(spark, sf_dir)))


_RECENT = f"a AS (SELECT *, max(epoch_us(ts)) OVER ({_BY}) - epoch_us(ts) AS age FROM m)"
_WEEK = 7 * DAY


@query(f"""WITH {M}, {_RECENT}, s AS (SELECT station, sensor, count(*) AS n, max(age) / 86.4e9 AS span_days, regr_slope(value, -age / 86.4e9) AS slope, arg_max(value, ts) AS last_value FROM a WHERE age <= {_WEEK} GROUP BY ALL)
SELECT station, sensor, n, round(span_days, 6) AS span_days, round(slope, 6) AS slope, round(CASE WHEN slope < 0 THEN (last_value - 8) / -slope END, 4) AS days_to_no_return FROM s WHERE n >= 10 AND span_days >= 2""")
def drift_projection(spark, sf_dir):
    s = longterm.drift(measurements(spark, sf_dir))
    return s.select("station", "sensor", "n", F.round("span_days", 6).alias("span_days"), F.round("slope", 6).alias("slope"), F.round("days_to_no_return", 4).alias("days_to_no_return"))


@query(f"""WITH {M}, {_RECENT}, s AS (SELECT station, sensor, count(*) FILTER (WHERE age <= {_WEEK}) AS nr, count(*) FILTER (WHERE age > {_WEEK}) AS no, max(value) FILTER (WHERE age <= {_WEEK}) AS mx, avg((value >= 150)::INT) FILTER (WHERE age > {_WEEK}) AS share, max(ts) FILTER (WHERE value >= 150) AS ts FROM a GROUP BY ALL)
SELECT station, sensor, ts, nr AS n_points, round(mx, 4) AS metric FROM s WHERE nr >= 10 AND no >= 50 AND mx < 150 AND share > 0.01""")
def no_recharge(spark, sf_dir):
    params = replace(DEFAULTS, recharge_level=150.0, recharge_share=0.01)
    return rounded(longterm.no_recharge(measurements(spark, sf_dir), params).select("station", "sensor", "ts", "n_points", "metric"))


@query(f"""WITH {M}, {_RECENT}, n AS (SELECT station, sensor, count(*) AS n, max(age) / 86.4e9 AS span_days, regr_slope(value, -age / 86.4e9) AS slope, CASE WHEN max(value) = min(value) THEN 0 ELSE coalesce(regr_r2(value, -age / 86.4e9), 0) END AS r2 FROM a WHERE age <= {_WEEK} GROUP BY ALL),
o AS (SELECT station, sensor, value, median(value) OVER ({_BY}) AS med FROM a WHERE age > {_WEEK}), d AS (SELECT station, sensor, count(*) AS n_older, median(abs(value - med)) AS mad, max(value) - min(value) AS range FROM o GROUP BY ALL)
SELECT station, sensor, n, n_older, round(slope, 6) AS slope, round(r2, 6) AS r2, round(mad, 4) AS mad, round(range, 4) AS range FROM n JOIN d USING (station, sensor)""")
def trend_r2(spark, sf_dir):
    s = longterm.trend(measurements(spark, sf_dir))
    return s.select("station", "sensor", "n", "n_older", F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"), F.round("mad", 4).alias("mad"), F.round("range", 4).alias("range"))


@query(f"""WITH {M}, d AS (SELECT station, sensor, ts::DATE AS day, median(value) AS v FROM m GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY station, sensor ORDER BY v) + (count(*) OVER (PARTITION BY station, sensor, v) - 1) / 2.0 AS rk, row_number() OVER ({_BY} ORDER BY day) AS t, count(*) OVER ({_BY}) AS n FROM d),
u AS (SELECT *, 2 * sum(rk) OVER ({_BY} ORDER BY day) - t * (n + 1) AS u FROM r), b AS (SELECT *, row_number() OVER ({_BY} ORDER BY abs(u) DESC, t) AS rn FROM u WHERE t < n),
c AS (SELECT station, sensor, n, t - 1 AS idx, day AS at_day, abs(u) AS k, least(1.0, 2 * exp(-6 * u * u / (n::DOUBLE ** 3 + n::DOUBLE ** 2))) AS p FROM b WHERE rn = 1 AND n >= 20),
g AS (SELECT d.station, d.sensor, median(v) FILTER (WHERE day <= at_day) AS med1, median(v) FILTER (WHERE day > at_day) AS med2, max(v) - min(v) AS range FROM d JOIN c USING (station, sensor) GROUP BY ALL),
h AS (SELECT d.station, d.sensor, median(abs(v - med1)) FILTER (WHERE day <= at_day) AS mad1, median(abs(v - med2)) FILTER (WHERE day > at_day) AS mad2 FROM d JOIN c USING (station, sensor) JOIN g USING (station, sensor) GROUP BY ALL)
SELECT station, sensor, n, idx, strftime(at_day, '%Y-%m-%d') AS at_day, round(k, 2) AS k, round(p, 6) AS p, round(med1, 4) AS med1, round(med2, 4) AS med2, (p < 0.2 AND idx >= 3 AND idx <= n - 3 AND abs(med2 - med1) > greatest((mad1 + mad2) * 1.4826 * 0.25, 0.05 * range))::VARCHAR AS rupture FROM c JOIN g USING (station, sensor) JOIN h USING (station, sensor)""")
def mean_shift(spark, sf_dir):
    s = longterm.mean_shift(measurements(spark, sf_dir), replace(DEFAULTS, shift_min_days=20, shift_margin_days=3, shift_p=0.2, mad_scale=1.4826 * 0.25))
    return s.select("station", "sensor", "n", "idx", F.date_format("at", "yyyy-MM-dd").alias("at_day"), F.round("k", 2).alias("k"), F.round("p", 6).alias("p"), F.round("med1", 4).alias("med1"), F.round("med2", 4).alias("med2"), F.col("rupture").cast("string").alias("rupture"))


@query(f"""WITH {M}, {_RECENT}, o AS (SELECT station, sensor, value, median(value) OVER ({_BY}) AS med FROM a WHERE age >= 86400000000), d AS (SELECT station, sensor, count(*) AS n_older, any_value(med) AS med, median(abs(value - med)) AS mad FROM o GROUP BY ALL),
f AS (SELECT a.*, d.med, abs(value - med) AS off FROM a JOIN d USING (station, sensor) WHERE age < 86400000000 AND n_older >= 30 AND mad > 0 AND abs(value - med) > 3 * 1.4826 * mad), k AS (SELECT *, row_number() OVER ({_BY} ORDER BY off DESC, ts) AS rn, count(*) OVER ({_BY}) AS n, min(ts) OVER ({_BY}) AS first_ts FROM f)
SELECT station, sensor, first_ts AS ts, n AS n_points, round(value, 4) AS metric, round(med, 4) AS threshold FROM k WHERE rn = 1""")
def recent_outliers(spark, sf_dir):
    params = replace(DEFAULTS, outlier_k=3.0, outlier_min_rows=30)
    return rounded(longterm.recent_outliers(measurements(spark, sf_dir), params).select("station", "sensor", "ts", "n_points", "metric", "threshold"))


@query(f"WITH {M}, l AS (SELECT station, sensor, max(ts) AS ts, count(*) AS n FROM m GROUP BY ALL), c AS (SELECT max(ts) AS now FROM m) SELECT station, sensor, ts, n AS n_points, round((epoch_us(now) - epoch_us(ts)) / 3.6e9, 4) AS metric FROM l, c WHERE (epoch_us(now) - epoch_us(ts)) / 3.6e9 >= 6")
def silent_series(spark, sf_dir):
    return rounded(longterm.silent_series(measurements(spark, sf_dir)).select("station", "sensor", "ts", "n_points", "metric"))


@query(f"WITH {M} SELECT event_id, round(sum(value) OVER (PARTITION BY station, sensor ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW), 4) AS rolling FROM m")
def rolling_24h(spark, sf_dir):
    return rounded(series.rolling_sum(measurements(spark, sf_dir), 24).select("event_id", "rolling"))


@query(f"""WITH {M}, d AS (SELECT station, sensor, ts::DATE AS day, sum(value) AS total, count(value) AS n FROM m GROUP BY ALL), r AS (SELECT station, sensor, min(day) AS a, max(day) AS b FROM d GROUP BY ALL), g AS (SELECT station, sensor, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM r)
SELECT station, sensor, strftime(day, '%Y-%m-%d') AS day, round(coalesce(total, 0), 4) AS total, coalesce(n, 0) AS n FROM g LEFT JOIN d USING (station, sensor, day)""")
def dense_daily(spark, sf_dir):
    return rounded(series.dense_daily(measurements(spark, sf_dir)))


@query(f"WITH {M} SELECT station, sensor, date_trunc('hour', ts) AS hour, round(sum(value), 4) AS total, count(*) AS n FROM m GROUP BY ALL")
def hourly_sum(spark, sf_dir):
    return rounded(series.hourly_sum(measurements(spark, sf_dir)))


@query(f"""{_LIMITED}, c AS (SELECT *, CASE WHEN value IS NULL THEN 'not_finite' WHEN value < low OR value > high THEN 'out_of_bounds' END AS reason FROM l)
SELECT station, sensor, count(*) AS n, count(*) FILTER (WHERE reason IS NULL) AS n_kept, round(count(*) FILTER (WHERE reason IS NULL) / count(*), 6) AS share, max(ts) FILTER (WHERE reason IS NULL) AS last_kept_ts FROM c GROUP BY ALL""")
def clean_split(spark, sf_dir):
    s = series.usable_share(series.clean_split(_limited(spark, sf_dir)))
    return rounded(s.select("station", "sensor", "n", "n_kept", "share", "last_kept_ts"), 6)


@query(f"""WITH {M}, s AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER ({_BY} ORDER BY ts)) / 1e6 AS step_s FROM m), u AS (SELECT station, sensor, median(step_s) AS usual FROM s GROUP BY ALL),
b AS (SELECT s.*, sum(CASE WHEN step_s > 1.5 * usual THEN 1 ELSE 0 END) OVER ({_BY} ORDER BY ts) AS block FROM s JOIN u USING (station, sensor)) SELECT station, sensor, block::BIGINT AS block, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM b GROUP BY ALL""")
def continuous_blocks(spark, sf_dir):
    return rounded(series.continuous_blocks(measurements(spark, sf_dir)))


@query(f"""WITH {M}, h AS (SELECT station, sensor, date_trunc('day', ts) + INTERVAL 6 HOUR * (hour(ts) // 6) AS ts, avg(value) AS value FROM m GROUP BY ALL), r AS (SELECT station, sensor, min(ts) AS a, max(ts) AS b FROM h GROUP BY ALL), g AS (SELECT station, sensor, unnest(generate_series(a, b, INTERVAL 6 HOUR)) AS ts FROM r),
o AS (SELECT g.*, value FROM g LEFT JOIN h USING (station, sensor, ts)), w AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN ts END) OVER ({_BY} ORDER BY ts) AS p, min(CASE WHEN value IS NOT NULL THEN ts END) OVER ({_BY} ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM o),
j AS (SELECT w.*, x.value AS pv, y.value AS nv FROM w LEFT JOIN h x ON x.station = w.station AND x.sensor = w.sensor AND x.ts = w.p LEFT JOIN h y ON y.station = w.station AND y.sensor = w.sensor AND y.ts = w.nx)
SELECT station, sensor, ts, round(CASE WHEN value IS NULL AND epoch_us(nx) - epoch_us(p) <= 5 * 21600000000 THEN pv + (nv - pv) * (epoch_us(ts) - epoch_us(p)) / (epoch_us(nx) - epoch_us(p)) ELSE value END, 6) AS value, (value IS NULL AND epoch_us(nx) - epoch_us(p) <= 5 * 21600000000)::VARCHAR AS filled FROM j WHERE value IS NOT NULL OR epoch_us(nx) - epoch_us(p) <= 5 * 21600000000""")
def reconstruct(spark, sf_dir):
    six = F.timestamp_micros(F.floor(micros("ts") / 21_600_000_000) * 21_600_000_000).cast("timestamp_ntz")
    m = measurements(spark, sf_dir).groupBy("station", "sensor", six.alias("ts")).agg(F.avg("value").alias("value"))
    return rounded(series.reconstruct(m, 21_600_000_000), 6)


@query(f"WITH {M}, s AS (SELECT station, sensor, min(ts) AS a, max(ts) AS b FROM m GROUP BY ALL), w AS (SELECT station, max(a) AS a, min(b) AS b, count(*) AS n_series FROM s GROUP BY ALL) SELECT station, CASE WHEN b > a THEN a END AS start_ts, CASE WHEN b > a THEN b END AS end_ts, n_series FROM w")
def common_window(spark, sf_dir):
    return series.common_window(measurements(spark, sf_dir))


@query(f"WITH {M}, x AS (SELECT event_id, station, sensor, ts FROM m WHERE value < 10), y AS (SELECT station, sensor, ts FROM m WHERE value > 50) SELECT x.event_id, max(y.ts) AS last_ts FROM x LEFT JOIN y ON x.station = y.station AND x.sensor = y.sensor AND y.ts < x.ts GROUP BY x.event_id")
def last_high_before(spark, sf_dir):
    m = measurements(spark, sf_dir)
    low = m.where("value < 10")
    found = series.last_before(low, m, F.col("value") > 50)
    return low.select("event_id", "station", "sensor", "ts").join(found, ["station", "sensor", "ts"]).select("event_id", "last_ts")


@query(f"WITH {M} SELECT event_id, coalesce(lag(value, 3) OVER w, first_value(value) OVER w) AS lagged FROM m WINDOW w AS ({_BY} ORDER BY ts, value)")
def lagged_series(spark, sf_dir):
    return series.lagged(measurements(spark, sf_dir), 3).select("event_id", "lagged")


@query(f"""WITH RECURSIVE {M}, o AS (SELECT event_id, station, sensor, value, row_number() OVER ({_BY} ORDER BY ts) AS t FROM m),
q AS (SELECT event_id, station, sensor, t, value AS filtered FROM o WHERE t = 1 UNION ALL SELECT o.event_id, o.station, o.sensor, o.t, greatest(o.value, (10.0 / 11.0)::DOUBLE * q.filtered + 0.5) FROM q JOIN o ON o.station = q.station AND o.sensor = q.sensor AND o.t = q.t + 1) SELECT event_id, round(filtered, 4) AS filtered FROM q""")
def recursive_filter(spark, sf_dir):
    return rounded(series.recursive_filter(measurements(spark, sf_dir), 10 / 11, 0.5).select("event_id", "filtered"))


@query(f"""WITH {M}, s AS (SELECT station, sensor, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86.4e9 AS days FROM m GROUP BY ALL)
SELECT station, sensor, n, round(days, 4) AS days, (days * 24 >= 72)::VARCHAR AS can_l1, (n >= 10 AND days >= 2)::VARCHAR AS can_l2, (n >= 100 AND days >= 1)::VARCHAR AS can_l4, (n >= 230 AND days >= 11)::VARCHAR AS can_l5, (days >= 60)::VARCHAR AS can_l6 FROM s""")
def rule_applicability(spark, sf_dir):
    return rounded(longterm.rule_applicability(measurements(spark, sf_dir)))


@query("WITH d AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem), a AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) SELECT d.l_suppkey, any_value(a.n) AS n, any_value(a.n) - count(*) AS n_removed FROM d JOIN a USING (l_suppkey) GROUP BY d.l_suppkey")
def retransmissions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("station"), F.col("l_partkey").alias("sensor"), F.col("l_suppkey").alias("ts"), F.col("l_quantity").alias("value"))
    kept = series.drop_retransmissions(rows).groupBy("ts").agg(F.count("*").alias("k"))
    return rows.groupBy("ts").agg(F.count("*").alias("n")).join(kept, "ts").select(F.col("ts").alias("l_suppkey"), "n", (F.col("n") - F.col("k")).alias("n_removed"))


@query("""WITH f AS (SELECT DISTINCT l_suppkey, l_shipdate FROM lineitem WHERE l_linenumber = 1), b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem WHERE l_linenumber > 1 AND l_quantity IS NOT NULL)
SELECT l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS day, l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM b WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM f WHERE f.l_suppkey = b.l_suppkey AND f.l_shipdate = b.l_shipdate)""")
def insert_if_absent(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("value")).withColumn("o", F.struct("l_orderkey", "l_linenumber"))
    added = series.insert_if_absent(rows.where("l_linenumber = 1"), rows.where("l_linenumber > 1"), "o", ["l_suppkey", "l_shipdate"])
    return added.select("l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


_RANK = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"


@query(f"WITH {M}, s AS (SELECT event_id, station, sensor, ts, value, CASE WHEN value > 200 THEN 'high' WHEN value > 100 THEN 'medium' ELSE 'low' END AS severity FROM m) SELECT event_id, severity, value FROM s ORDER BY {_RANK}, value DESC, event_id LIMIT 200")
def severity_sort_topk(spark, sf_dir):
    severity = F.when(F.col("value") > 200, "high").when(F.col("value") > 100, "medium").otherwise("low")
    s = measurements(spark, sf_dir).withColumns({"severity": severity, "back": -F.col("value")})
    return anomalies.by_severity(s, "back", "event_id").limit(200).select("event_id", "severity", "value")


@query(f"WITH {M} SELECT sensor, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM m GROUP BY sensor")
def value_counts(spark, sf_dir):
    return rounded(anomalies.count_by(measurements(spark, sf_dir), "sensor"), 6)


@query(f"""WITH {GAUGES}, x AS (SELECT station, sensor, count(*) AS n, min(value) AS low, median(value) AS med, max(value) AS high, quantile_cont(value, 0.95) AS q95, sum(value) AS total, count(*) FILTER (WHERE value > 0) AS wet FROM m GROUP BY ALL)
SELECT station, sensor, n, round(low, 4) AS low, round(med, 4) AS med, round(high, 4) AS high, round(q95, 4) AS q95, round(high - low, 4) AS amplitude, CASE WHEN sensor = '0006' THEN round(total, 4) END AS rain_total, CASE WHEN sensor = '0006' THEN wet END AS n_wet FROM x""")
def sensor_extremes(spark, sf_dir):
    return rounded(listing.sensor_extremes(gauges(spark, sf_dir)))


@query("WITH w AS (SELECT o_orderkey, unnest(string_split(o_orderpriority || ' + ' || o_orderstatus, '+')) AS f FROM orders) SELECT trim(f) AS fault, count(*) AS n FROM w WHERE trim(f) <> '' GROUP BY ALL")
def fault_counts(spark, sf_dir):
    text = F.concat_ws(" + ", "o_orderpriority", "o_orderstatus")
    return table(spark, sf_dir, "orders").select(F.explode(split_faults(text)).alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'building' THEN 'Bâtiment' WHEN 'machinery' THEN 'Machine' WHEN 'household' THEN '' ELSE c_mktsegment END AS faults, lower(trim(c_mktsegment)) AS folded FROM customer")
def normalise_fault_names(spark, sf_dir):
    names = {"building": "Bâtiment", "machinery": "Machine", "household": None}
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.array_join(normalise_faults(F.col("c_mktsegment"), names), " + ").alias("faults"), fold_accents(F.col("c_mktsegment")).alias("folded"))


@query("SELECT s_suppkey::VARCHAR AS code_station, s_name AS nom FROM supplier WHERE regexp_matches(lower(s_name), '0{4}[1-3]') OR regexp_matches(s_suppkey::VARCHAR, '0{4}[1-3]')")
def search_filter(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("code_station"), F.col("s_name").alias("nom"))
    return listing.search(s, " 0{4}[1-3] ")


@query("SELECT c_custkey::VARCHAR AS code_station, c_name AS nom, c_mktsegment AS etat, c_nationkey::VARCHAR AS gouvernorat, c_custkey % 3 <> 1 AS rain, c_custkey % 3 > 0 AS levels FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def stations_in_state(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("code_station"), F.col("c_name").alias("nom"), F.col("c_mktsegment").alias("etat"), F.col("c_nationkey").cast("string").alias("gouvernorat"))
    n = F.col("code_station").cast("long") % 3
    rain, levels = listing.measures(F.when(n == 0, "Pluviométrique").when(n == 1, "Hydrométrique").otherwise("Pluvio-hydrométrique"))
    return listing.in_state(c, "BUILDING", "7").withColumns({"rain": rain, "levels": levels})


@query("SELECT s_suppkey::VARCHAR AS code_station, s_nationkey AS etat, CASE WHEN p_partkey IS NOT NULL THEN p_size::DOUBLE END AS altitude_m FROM supplier LEFT JOIN part ON p_partkey = s_suppkey AND p_size > 25")
def altitudes_of_states(spark, sf_dir):
    states = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("code_station"), F.col("s_nationkey").alias("etat"))
    known = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").cast("string").alias("code_station"), F.col("p_size").cast("double").alias("altitude_m"))
    return listing.with_altitude(states, known)


@query(f"WITH {M} SELECT event_id, ts, value FROM m WHERE station = 'S07' AND sensor = 'view' AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'")
def series_in_period(spark, sf_dir):
    return listing.between_times(listing.series_scan(measurements(spark, sf_dir), "S07", "view"), "2024-01-05 00:00:00", "2024-01-20 12:00:00").select("event_id", "ts", "value")


# Scaled meridian arcs from the equator to whole degrees, in metres, from the numerical integral of the
# meridian's radius of curvature: on the central meridian they are northings whose latitude is known without the projection.
_ARCS = {5: 552664.2969, 10: 1105412.4913, 15: 1658325.9936, 20: 2211481.3077, 25: 2764947.7475, 30: 3318785.3526, 35: 3873043.0645, 40: 4427757.2187, 45: 4982950.4002, 50: 5538630.7029, 55: 6094791.421, 60: 6651411.1904}


@query("SELECT s_suppkey, (5 * (s_suppkey % 12 + 1))::DOUBLE AS lat, 9.0::DOUBLE AS lon FROM supplier")
def utm_coordinates(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    arcs = F.create_map(*[F.lit(x) for pair in _ARCS.items() for x in pair])
    lat, lon = geographic(F.lit(500_000.0), F.element_at(arcs, (5 * (F.col("s_suppkey") % 12 + 1)).cast("int")), zone=32)
    return s.select("s_suppkey", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query(f"WITH {M} SELECT event_id, round(avg(value) OVER ({_BY} ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 6) AS centred FROM m")
def centred_mean(spark, sf_dir):
    return rounded(series.centred_mean(measurements(spark, sf_dir), 6).select("event_id", "centred"), 6)


@query(f"WITH {M} SELECT event_id, round(0.53 * value + 0.31 * coalesce(lag(value, 1) OVER w, 0) + 0.17 * coalesce(lag(value, 2) OVER w, 0), 6) AS convolved FROM m WINDOW w AS ({_BY} ORDER BY ts)")
def convolution(spark, sf_dir):
    return rounded(series.convolve(measurements(spark, sf_dir), (0.53, 0.31, 0.17)).select("event_id", "convolved"), 6)


@query(f"WITH {M}, f AS (SELECT station, sensor, min(ts) AS a FROM m GROUP BY ALL), x AS (SELECT station, sensor, min(ts) FILTER (WHERE value > 200) AS b FROM m GROUP BY ALL) SELECT station, sensor, coalesce(b, a) AS ts FROM f JOIN x USING (station, sensor)")
def first_detection(spark, sf_dir):
    m = measurements(spark, sf_dir)
    members = m.select(F.lit("R2").alias("rule"), "station", "sensor", F.when(F.col("value") > 200, F.col("ts")).alias("ts"))
    return anomalies.first_detection(members, m).drop("rule")


@query("SELECT n_regionkey::BIGINT AS region, c_mktsegment AS segment, count(DISTINCT c_custkey) AS n, (GROUPING(n_regionkey) * 2 + GROUPING(c_mktsegment))::BIGINT AS level FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_regionkey, c_mktsegment)")
def dashboard_counters(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return anomalies.counters(joined.select(F.col("c_custkey").alias("station"), F.col("n_regionkey").cast("long").alias("region"), F.col("c_mktsegment").alias("segment")), "region", "segment")


@query(f"WITH {M} SELECT CASE WHEN ts::DATE < DATE '2024-01-15' THEN 'history' WHEN ts::DATE = DATE '2024-01-15' THEN 'day' ELSE 'rest' END AS part, count(*) AS n, round(sum(value), 4) AS total FROM m GROUP BY ALL")
def pivot_date_split(spark, sf_dir):
    parts = [df.select(F.lit(name).alias("part"), "value") for name, df in series.split_at(measurements(spark, sf_dir), "2024-01-15").items()]
    return rounded(parts[0].union(parts[1]).union(parts[2]).groupBy("part").agg(F.count("*").alias("n"), F.sum("value").alias("total")))
