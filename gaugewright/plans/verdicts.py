"""Queries of whole rule sets: every instant rule and every history rule decides in one result."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from gaugewright.functions.stats import DAY
from gaugewright.operators import instant, longterm
from gaugewright.params import DEFAULTS
from gaugewright.plans.registry import GAUGES, gauges, query, rounded

_SERIES = "PARTITION BY station, sensor"
_OUT = "rule, type, severity, station, sensor, ts, n_points, round(metric, 4) AS metric, round(threshold, 4) AS threshold"

# History rules: thresholds at which a month of these readings gives every verdict.
_LT = replace(DEFAULTS, flatline_long_h=12.0, recharge_level=150.0, recharge_share=0.01, mad_scale=1.4826 * 0.24, outlier_min_rows=30, trend_r2=0.05, trend_min_rows=8, trend_min_history=30, shift_p=0.2, shift_min_days=20, shift_margin_days=3)
_WEEK, _DAY = 7 * DAY, DAY


@query(f"""WITH {GAUGES}, t AS (SELECT * FROM (SELECT *, count(*) OVER ({_SERIES}) AS c FROM (SELECT *, max(epoch_us(ts)) OVER ({_SERIES}) - epoch_us(ts) AS age FROM m) WHERE age <= {120 * DAY} AND value IS NOT NULL) WHERE c >= 3),
w AS (SELECT * FROM t WHERE sensor IN ('0001', '0007')), p AS (SELECT * FROM t WHERE sensor = '0002'),
fv AS (SELECT station, sensor, arg_max(value, ts) AS lv FROM w GROUP BY ALL), fo AS (SELECT station, sensor, lv, max(ts) FILTER (WHERE value <> lv) AS o FROM w JOIN fv USING (station, sensor) GROUP BY ALL),
l1 AS (SELECT 'L1' AS rule, 'flatline_longue' AS type, 'high' AS severity, station, sensor, min(ts) AS ts, count(*) AS n_points, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS metric, 12.0::DOUBLE AS threshold FROM w JOIN fo USING (station, sensor) WHERE o IS NULL OR ts > o GROUP BY station, sensor, lv HAVING (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 >= 12 AND NOT (sensor = '0007' AND lv = 0)),
d2 AS (SELECT station, sensor, count(*) AS n, max(age) AS span, regr_slope(value, -age / 86.4e9) AS slope, arg_max(value, ts) AS last_value, max(ts) AS ts FROM p WHERE age <= {_WEEK} GROUP BY ALL),
l2 AS (SELECT 'L2', 'batterie_derive', CASE WHEN (last_value - 8) / -slope <= 14 THEN 'high' ELSE 'medium' END, station, sensor, ts, n, slope, -0.05 FROM d2 WHERE n >= 10 AND span >= {2 * DAY} AND slope <= -0.05),
d3 AS (SELECT station, sensor, count(*) FILTER (WHERE age <= {_WEEK}) AS nr, count(*) FILTER (WHERE age > {_WEEK}) AS no, max(value) FILTER (WHERE age <= {_WEEK}) AS mx, avg((value >= 150)::INT) FILTER (WHERE age > {_WEEK}) AS share, max(ts) FILTER (WHERE value >= 150) AS ts FROM p GROUP BY ALL),
l2b AS (SELECT 'L2b', 'batterie_charge_absente', 'medium', station, sensor, ts, nr, mx, 150.0 FROM d3 WHERE nr >= 10 AND no >= 50 AND mx < 150 AND share > 0.01),
l3 AS (SELECT 'L3', 'station_muette', 'high', station, sensor, ts, n, (epoch_us(now) - epoch_us(ts)) / 3.6e9, 6.0 FROM (SELECT station, sensor, max(ts) AS ts, count(*) AS n FROM m GROUP BY ALL), (SELECT max(ts) AS now FROM m) WHERE (epoch_us(now) - epoch_us(ts)) / 3.6e9 >= 6),
o4 AS (SELECT station, sensor, value, median(value) OVER ({_SERIES}) AS med FROM w WHERE age >= {_DAY}), d4 AS (SELECT station, sensor, count(*) AS n, any_value(med) AS med, median(abs(value - med)) AS mad FROM o4 GROUP BY ALL),
f4 AS (SELECT w.*, med, abs(value - med) AS off FROM w JOIN d4 USING (station, sensor) WHERE age < {_DAY} AND d4.n >= 30 AND mad > 0 AND abs(value - med) > 6 * {_LT.mad_scale} * mad), k4 AS (SELECT *, row_number() OVER ({_SERIES} ORDER BY off DESC, ts) AS rn, count(*) OVER ({_SERIES}) AS n, min(ts) OVER ({_SERIES}) AS first_ts FROM f4),
l4 AS (SELECT 'L4', 'valeur_inhabituelle', 'medium', station, sensor, first_ts, n, value, med FROM k4 WHERE rn = 1),
n5 AS (SELECT station, sensor, count(*) AS n, max(age) / 86.4e9 AS span, regr_slope(value, -age / 86.4e9) AS slope, CASE WHEN max(value) = min(value) THEN 0 ELSE coalesce(regr_r2(value, -age / 86.4e9), 0) END AS r2, min(ts) AS ts FROM w WHERE age <= {_WEEK} GROUP BY ALL),
o5 AS (SELECT station, sensor, value, median(value) OVER ({_SERIES}) AS med FROM w WHERE age > {_WEEK}), d5 AS (SELECT station, sensor, count(*) AS n_older, median(abs(value - med)) AS mad, max(value) - min(value) AS range FROM o5 GROUP BY ALL),
l5 AS (SELECT 'L5', 'tendance_continue', 'medium', station, sensor, ts, n, abs(slope * span), greatest(5 * {_LT.mad_scale} * mad, 0.1 * range) FROM n5 JOIN d5 USING (station, sensor) WHERE n >= 8 AND span >= 4 AND n_older >= 30 AND r2 >= 0.05 AND abs(slope * span) > greatest(5 * {_LT.mad_scale} * mad, 0.1 * range)),
dd AS (SELECT station, sensor, ts::DATE AS day, median(value) AS v FROM m WHERE sensor IN ('0001', '0007') GROUP BY ALL), r6 AS (SELECT *, rank() OVER ({_SERIES} ORDER BY v) + (count(*) OVER (PARTITION BY station, sensor, v) - 1) / 2.0 AS rk, row_number() OVER ({_SERIES} ORDER BY day) AS i, count(*) OVER ({_SERIES}) AS n FROM dd),
u6 AS (SELECT *, 2 * sum(rk) OVER ({_SERIES} ORDER BY day) - i * (n + 1) AS u FROM r6), b6 AS (SELECT *, row_number() OVER ({_SERIES} ORDER BY abs(u) DESC, i) AS rn FROM u6 WHERE i < n), c6 AS (SELECT station, sensor, n, i - 1 AS idx, day AS at_day, least(1.0, 2 * exp(-6 * u * u / (n::DOUBLE ** 3 + n::DOUBLE ** 2))) AS p FROM b6 WHERE rn = 1 AND n >= 20),
g6 AS (SELECT dd.station, dd.sensor, median(v) FILTER (WHERE day <= at_day) AS m1, median(v) FILTER (WHERE day > at_day) AS m2, max(v) - min(v) AS range FROM dd JOIN c6 USING (station, sensor) GROUP BY ALL), h6 AS (SELECT dd.station, dd.sensor, median(abs(v - m1)) FILTER (WHERE day <= at_day) AS s1, median(abs(v - m2)) FILTER (WHERE day > at_day) AS s2 FROM dd JOIN c6 USING (station, sensor) JOIN g6 USING (station, sensor) GROUP BY ALL),
l6 AS (SELECT 'L6', 'rupture_moyenne', 'medium', station, sensor, at_day::TIMESTAMP, n, abs(m2 - m1), greatest((s1 + s2) * {_LT.mad_scale}, 0.05 * range) FROM c6 JOIN g6 USING (station, sensor) JOIN h6 USING (station, sensor) WHERE p < 0.2 AND idx >= 3 AND idx <= n - 3 AND abs(m2 - m1) > greatest((s1 + s2) * {_LT.mad_scale}, 0.05 * range))
SELECT {_OUT} FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l2b UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4 UNION ALL SELECT * FROM l5 UNION ALL SELECT * FROM l6)""")
def long_term_anomalies(spark, sf_dir):
    return rounded(longterm.long_term_anomalies(gauges(spark, sf_dir), _LT))


# Instant rules: a file is a station's day, its times are full hours so that some repeat.
_KEYS = ("station", "sensor", "day")


def _day_files(spark, sf_dir):
    g = gauges(spark, sf_dir)
    level, flow, rain = (F.col("sensor") == s for s in ("0001", "0007", "0006"))
    value = F.when(level, F.col("value") - 1).when(flow, F.floor(F.col("value") / 4).cast("double")).otherwise(F.col("value"))
    dims = {"low": F.when(level | flow, 0.0).when(rain, 2.0), "high": F.when(level, 6.0).when(flow, 2.0).when(rain, 60.0), "corrects": rain, "code": F.when(F.col("value") < 1, F.get_json_object("props", "$.k"))}
    return g.withColumns({"ts": F.date_trunc("hour", "ts").cast("timestamp_ntz"), "day": F.to_date("ts"), "value": value, **dims})


_FILES = f"""{GAUGES}, i AS (SELECT station, sensor, ts::DATE AS day, date_trunc('hour', ts) AS ts, CASE sensor WHEN '0001' THEN value - 1 WHEN '0007' THEN floor(value / 4) ELSE value END AS value, CASE WHEN sensor IN ('0001', '0007') THEN 0.0 WHEN sensor = '0006' THEN 2.0 END AS low, CASE sensor WHEN '0001' THEN 6.0 WHEN '0007' THEN 2.0 WHEN '0006' THEN 60.0 END AS high, sensor = '0006' AS corrects, CASE WHEN value < 1 THEN json_extract_string(props, '$.k') END AS code FROM m),
b AS (SELECT *, coalesce(value < low OR value > high, false) AS bad FROM i), g AS (SELECT station, sensor, day, count(*) FILTER (WHERE NOT (bad AND corrects)) AS others, median(value) FILTER (WHERE NOT (bad AND corrects)) AS med FROM b GROUP BY ALL),
f AS (SELECT b.* EXCLUDE (value), value AS raw, bad AND corrects AS corrected, CASE WHEN bad AND corrects THEN CASE WHEN others = 0 THEN 0 ELSE round_even(med, 2) END ELSE value END AS value FROM b JOIN g USING (station, sensor, day))"""
_FILE = "PARTITION BY station, sensor, day"


def _group(rule, kind, severity, metric, where, threshold="NULL", having="true"):
    return f"SELECT '{rule}' AS rule, '{kind}' AS type, '{severity}' AS severity, station, sensor, min(ts) AS ts, count(*) AS n_points, ({metric})::DOUBLE AS metric, ({threshold})::DOUBLE AS threshold FROM {where} GROUP BY station, sensor, day HAVING {having}"


_INSTANT = " UNION ALL ".join(
    [
        _group("BAT-a", "batterie_non_retour", "high", "(SELECT min(value) FROM f y WHERE y.station = f.station AND y.sensor = f.sensor AND y.day = f.day)", "f WHERE sensor = '0002' AND value <= 8", "8"),
        _group("BAT-b", "batterie_decharge", "high", "min(value)", "f WHERE sensor = '0002' AND value > 8 AND value <= 11 AND NOT EXISTS (SELECT 1 FROM f y WHERE y.station = f.station AND y.sensor = f.sensor AND y.day = f.day AND y.value <= 8)", "11"),
        _group("BAT-c", "batterie_surcharge", "medium", "max(value)", "f WHERE sensor = '0002' AND value > 15", "15"),
        _group("R2", "out_of_range", "high", "max(abs(value))", "f WHERE bad AND NOT corrects"),
        _group("R8", "out_of_range_corrected", "high", "max(abs(raw))", "f WHERE corrected"),
        _group("R1", "negative_value", "high", "min(value)", "f WHERE value < 0 AND coalesce(low, 0) >= 0", "0"),
        _group("R3", "flatline_full", "high", "min(value)", "f WHERE sensor <> '0002'", having="count(*) >= 3 AND count(DISTINCT value) = 1 AND NOT (sensor IN ('0006', '0007') AND min(value) = 0)"),
        _group("R4", "all_zeros", "low", "0", "f WHERE sensor <> '0002'", having="bool_and(coalesce(value = 0, false))"),
        _group("R5", "duplicate_timestamps", "medium", "count(*)", f"(SELECT *, count(*) OVER (PARTITION BY station, sensor, day, ts) AS c FROM f) WHERE c > 1"),
        _group("R9", "capteur_muet_ponctuel", "medium", "count(*)", "f WHERE code IS NOT NULL"),
        _group("R6", "irregular_timestep", "medium", "max(step)", "j WHERE c > 2 AND step <= 1.5 * mode AND step <> mode"),
        _group("R7", "missing_data_gap", "high", "max(step)", "j WHERE c > 2 AND step > 1.5 * mode"),
        "SELECT 'R3', 'flatline_partial', 'medium', station, sensor, first_ts, n, hours, 6.0 FROM k WHERE rn = 1 AND hours >= 6",
    ]
)


@query(f"""WITH {_FILES}, s AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER ({_FILE} ORDER BY ts, value)) / 1e6 AS step, count(*) OVER ({_FILE}) AS c FROM f), md AS (SELECT station, sensor, day, step AS mode, row_number() OVER ({_FILE} ORDER BY count(*) DESC, step) AS rn FROM s WHERE step IS NOT NULL GROUP BY station, sensor, day, step), j AS (SELECT s.*, mode FROM s JOIN md USING (station, sensor, day) WHERE rn = 1),
ch AS (SELECT *, CASE WHEN lag(value) OVER ({_FILE} ORDER BY ts, value) = value THEN 0 ELSE 1 END AS ch FROM f WHERE sensor <> '0002'), rn AS (SELECT *, sum(ch) OVER ({_FILE} ORDER BY ts, value ROWS UNBOUNDED PRECEDING) AS run FROM ch), vr AS (SELECT station, sensor, day, run, any_value(value) AS value, count(*) AS n, min(ts) AS first_ts, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS hours FROM rn WHERE value IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER ({_FILE} ORDER BY hours DESC, first_ts, value) AS rn FROM vr WHERE NOT (sensor IN ('0006', '0007') AND value = 0) AND (SELECT count(DISTINCT y.value) FROM f y WHERE y.station = vr.station AND y.sensor = vr.sensor AND y.day = vr.day) > 1)
SELECT {_OUT} FROM ({_INSTANT})""")
def instant_anomalies(spark, sf_dir):
    return rounded(instant.instant_anomalies(_day_files(spark, sf_dir), keys=_KEYS))


@query(f"WITH {_FILES}, k AS (SELECT *, row_number() OVER ({_FILE} ORDER BY ts, value) AS rank, min(value) OVER ({_FILE}) AS low_value FROM f WHERE sensor = '0002'), a AS (SELECT *, row_number() OVER ({_FILE} ORDER BY ts, value) AS r FROM k WHERE low_value > 8 AND value > 8 AND value <= 11) SELECT station, sensor, strftime(day, '%Y-%m-%d') AS day, r AS rank, ts, round(value, 4) AS value FROM a WHERE r <= 10")
def battery_details(spark, sf_dir):
    m = _day_files(spark, sf_dir).where("sensor = '0002'")
    return rounded(instant.battery_details(m, keys=_KEYS))
