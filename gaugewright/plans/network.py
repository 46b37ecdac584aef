"""Queries across stations: crossing rule, neighbours, floods, graph, state, proposals and ingestion."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from gaugewright.functions.stats import HOUR
from gaugewright.operators import crossing, forest, graph, interstation, listing, state
from gaugewright.params import DEFAULTS
from gaugewright.plans.registry import EDGES, GAUGES, NODES, STATIONS, M, gauges, measurements, nodes, query, rounded, stations_frame, table, tree_edges
from gaugewright.session import checkpointed, shared_path
from gaugewright.sources import schemas, telemetry
from gaugewright.sources.geometry import polygons_from, with_wkb

_BY = "PARTITION BY station"


def _sensor(spark, sf_dir, name):
    return measurements(spark, sf_dir).where(F.col("sensor") == name).select("station", "ts", "value", "event_id")


# L7: the rain is the clicks, the level the views; thresholds that give each verdict on this view.
_L7 = replace(DEFAULTS, response_rain_mm=150.0, response_rise=60.0, response_drought_days=3)

_CANDIDATES = f"""WITH {M}, rain AS (SELECT station, ts, epoch_us(ts) AS u, value FROM m WHERE sensor = 'click'), lev AS (SELECT station, epoch_us(ts) AS u, value FROM m WHERE sensor = 'view'),
w AS (SELECT *, sum(value) OVER ({_BY} ORDER BY u RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS mm, max(CASE WHEN value > 0 THEN u END) OVER ({_BY} ORDER BY u RANGE BETWEEN UNBOUNDED PRECEDING AND 86400000001 PRECEDING) AS last_wet FROM rain),
s AS (SELECT station, median(value) AS med, min(value) AS low FROM lev GROUP BY station HAVING count(*) >= 10), h AS (SELECT w.*, med, low, u - 86400000000 AS d FROM w JOIN s USING (station) WHERE round(mm, 9) >= 150),
n AS (SELECT h.station, h.ts, count(*) FILTER (WHERE l.u <= d) AS nb, median(l.value) FILTER (WHERE l.u <= d) AS base, count(*) FILTER (WHERE l.u > d) AS na, max(l.value) FILTER (WHERE l.u > d) AS peak FROM h JOIN lev l ON l.station = h.station AND l.u BETWEEN d - 43200000000 AND h.u + 129600000000 GROUP BY ALL)
SELECT h.station, h.ts, round(mm, 4) AS mm, round(base, 4) AS base, round(peak, 4) AS peak, CASE WHEN coalesce(d - last_wet > 3 * 86400000000, false) THEN 'drought' WHEN coalesce(nb, 0) < 3 THEN 'few_before' WHEN base > med + 1.5 * (med - low) THEN 'already_high' WHEN na < 5 THEN 'few_after' WHEN peak - base < 60 THEN 'signal' ELSE 'response' END AS verdict FROM h LEFT JOIN n USING (station, ts)"""


@query(_CANDIDATES)
def rain_response_guards(spark, sf_dir):
    found = crossing.response_candidates(_sensor(spark, sf_dir, "click"), _sensor(spark, sf_dir, "view"), _L7, min_level=10)
    return rounded(found)


_GREEDY = _CANDIDATES.replace("WITH m AS", "WITH RECURSIVE m AS", 1)
_GREEDY = _GREEDY[: _GREEDY.rindex("SELECT h.station, h.ts")]


@query(f"""{_GREEDY.rstrip()},
g AS (SELECT h.station, h.ts, h.u, h.mm FROM h JOIN n USING (station, ts) WHERE NOT coalesce(d - last_wet > 3 * 86400000000, false) AND nb >= 3 AND NOT base > med + 1.5 * (med - low) AND na >= 5 AND peak - base < 60),
kept AS (SELECT station, min(u) AS u FROM g GROUP BY station UNION ALL SELECT k.station, (SELECT min(g.u) FROM g WHERE g.station = k.station AND g.u >= k.u + 129600000000) AS u FROM kept k WHERE k.u IS NOT NULL)
SELECT g.station, g.ts, CASE WHEN mm >= 300 THEN 'high' ELSE 'medium' END AS severity, round(mm, 4) AS metric FROM g JOIN kept ON kept.station = g.station AND kept.u = g.u""")
def rain_no_response(spark, sf_dir):
    found = crossing.rain_without_response(_sensor(spark, sf_dir, "click"), _sensor(spark, sf_dir, "view"), _L7, min_level=10)
    return rounded(found.select("station", "ts", "severity", "metric"))


# I1
_NEIGHBOURS = f"""{STATIONS}, p AS (SELECT a.station, b.station AS neighbour, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 1000 AS exact FROM st a JOIN st b ON a.station <> b.station WHERE a.origin = b.origin AND (a.altitude IS NULL OR b.altitude IS NULL OR abs(a.altitude - b.altitude) <= 300)),
nb AS (SELECT station, neighbour, round_even(exact, 1) AS km, row_number() OVER ({_BY} ORDER BY round_even(exact, 1), neighbour) AS rank FROM p WHERE exact <= 80), nk AS (SELECT * FROM nb WHERE rank <= 8)"""


@query(f"WITH {NODES}, {_NEIGHBOURS} SELECT station, neighbour, round(km, 1) AS km, rank FROM nk")
def nearest_neighbours(spark, sf_dir):
    return rounded(interstation.nearest_neighbours(stations_frame(nodes(spark, sf_dir))), 1)


# Rain from the clicks, with days under a threshold set to zero so that exact zeros exist.
_RAIN = "rn AS (SELECT station, ts, CASE WHEN value < 25 THEN 0 ELSE value END AS value FROM m WHERE sensor = 'click')"
_DAYS = """dd AS (SELECT station, ts::DATE AS day, sum(value) AS total, count(value) AS n FROM rn GROUP BY ALL), dr AS (SELECT station, min(day) AS a, max(day) AS b FROM dd GROUP BY ALL), dg AS (SELECT station, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM dr),
dy AS (SELECT station, day, coalesce(total, 0) AS total, coalesce(n, 0) AS n FROM dg LEFT JOIN dd USING (station, day)),
ex AS (SELECT nk.station, dy.day, sum(dy.total / greatest(km, 1) ** 2) / sum(1 / greatest(km, 1) ** 2) AS expected, count(*) FILTER (WHERE dy.total >= 3) AS n_wet, count(*) AS n_neighbours FROM nk JOIN dy ON dy.station = nk.neighbour GROUP BY ALL)"""


def _rain(spark, sf_dir):
    return _sensor(spark, sf_dir, "click").withColumn("value", F.when(F.col("value") < 25, 0.0).otherwise(F.col("value")))


@query(f"WITH {M}, {_NEIGHBOURS}, {_RAIN}, {_DAYS} SELECT station, strftime(day, '%Y-%m-%d') AS day, round(expected, 4) AS expected, n_wet, n_neighbours FROM ex")
def idw_expected(spark, sf_dir):
    near = interstation.nearest_neighbours(stations_frame(measurements(spark, sf_dir)))
    days = interstation.dense_daily(_rain(spark, sf_dir), ["station"])
    return rounded(interstation.expected_rain(days, near).drop("wet"))


_HEARD = "rn AS (SELECT * FROM (SELECT station, ts, CASE WHEN value < 25 THEN 0 ELSE value END AS value FROM m WHERE sensor = 'click') WHERE station NOT IN ('S03', 'S08'))"
_HEARD_NEIGHBOURS = _NEIGHBOURS.replace("FROM p WHERE exact <= 80", "FROM p WHERE exact <= 80 AND neighbour IN (SELECT station FROM rn)")


@query(f"""WITH {M}, {_HEARD}, {_HEARD_NEIGHBOURS}, {_DAYS}, en AS (SELECT station FROM nk GROUP BY station HAVING count(*) >= 3), f AS (SELECT dy.station, dy.day, ex.expected FROM dy JOIN en USING (station) JOIN ex USING (station, day) WHERE dy.total = 0 AND dy.n >= 1 AND n_wet >= 3 AND expected >= 4),
i AS (SELECT *, day - (row_number() OVER ({_BY} ORDER BY day))::INT AS isl FROM f), ep AS (SELECT station, isl, min(day) AS first_day, max(day) AS last_day, count(*) AS n_days, max(expected) AS expected, arg_max(day, (expected, -(day - DATE '1970-01-01'))) AS worst FROM i GROUP BY station, isl),
wt AS (SELECT ep.station, ep.isl, nk.neighbour, row_number() OVER (PARTITION BY ep.station, ep.isl ORDER BY nk.km, nk.neighbour) AS rn FROM ep JOIN nk ON nk.station = ep.station JOIN dy ON dy.station = nk.neighbour AND dy.day = ep.worst WHERE dy.total >= 3),
wj AS (SELECT station, isl, string_agg(neighbour, ',' ORDER BY rn) AS wet FROM wt WHERE rn <= 3 GROUP BY ALL)
SELECT station, strftime(first_day, '%Y-%m-%d') AS first_day, strftime(last_day, '%Y-%m-%d') AS last_day, n_days, round(expected, 4) AS expected, wet, CASE WHEN expected >= 15 THEN 'high' ELSE 'medium' END AS severity FROM ep LEFT JOIN wj USING (station, isl)""")
def false_zero_episodes(spark, sf_dir):
    rain = _rain(spark, sf_dir).where(~F.col("station").isin("S03", "S08"))  # two silent gauges, which are nobody's neighbours
    found = interstation.false_zero_episodes(rain, stations_frame(measurements(spark, sf_dir)), replace(DEFAULTS, full_day_rows=1))
    wet = F.array_join(F.transform("wet", lambda x: x["neighbour"]), ",")
    return rounded(found.withColumn("wet", wet))


# I2: levels are all sensors of a station but errors, pairs are the tree's relations.
_LEVEL = "lv AS (SELECT station, ts, epoch_us(ts) AS u, value FROM m WHERE sensor <> 'error')"
_FLOODS = f"""fm AS (SELECT *, median(value) OVER ({_BY}) AS med FROM lv), fd AS (SELECT station, any_value(med) AS med, median(abs(value - med)) AS mad, count(*) AS n, min(value) AS low FROM fm GROUP BY station),
fi AS (SELECT lv.*, fd.med, lv.value > fd.med + greatest(6 * 1.4826 * mad, 10) AS hi FROM lv JOIN fd USING (station)), fs AS (SELECT *, CASE WHEN hi AND NOT coalesce(lag(hi) OVER ({_BY} ORDER BY ts, value), false) THEN 1 ELSE 0 END AS s FROM fi), fr AS (SELECT *, sum(s) OVER ({_BY} ORDER BY ts, value) AS run FROM fs),
fl AS (SELECT station, run, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, max(value) AS peak, arg_max(ts, value) AS peak_ts, max(value) - any_value(med) AS rise FROM fr WHERE hi GROUP BY station, run)"""


def _level(spark, sf_dir):
    return measurements(spark, sf_dir).where("sensor <> 'error'").select("station", "ts", "value")


@query(f"WITH {M}, {_LEVEL}, {_FLOODS} SELECT station, first_ts, last_ts, n, round(peak, 4) AS peak, peak_ts, round(rise, 4) AS rise FROM fl")
def flood_events(spark, sf_dir):
    return rounded(interstation.flood_events(_level(spark, sf_dir)))


_PAIRS = """pr AS (SELECT src AS up, dst AS down, length / 100 AS km, CASE WHEN obstacle = 'barrage' THEN 'à valider' ELSE 'haute' END AS reliability, substr(src, 2, 2)::INT % 4 <> 3 AS same_origin FROM e)"""


def _pairs(spark, sf_dir):
    e = tree_edges(measurements(spark, sf_dir))
    return e.select(F.col("src").alias("up"), F.col("dst").alias("down"), (F.col("length") / 100).alias("km"), F.when(F.col("obstacle") == "barrage", "à valider").otherwise("haute").alias("reliability"), (F.substring("src", 2, 2).cast("int") % 4 != 3).alias("same_origin"))


_PROPAGATION = f"""WITH {M}, {EDGES}, {_LEVEL}, {_FLOODS}, {_PAIRS}, ls AS (SELECT station, u - lag(u) OVER ({_BY} ORDER BY ts) AS d FROM lv), lt AS (SELECT station, median(d) AS step FROM ls GROUP BY station), lf AS (SELECT station, count(*) AS nf FROM fl GROUP BY station),
pj AS (SELECT pr.*, a.n AS n_up, b.n AS n_down, b.med, b.low, lt.step, coalesce(lf.nf, 0) AS nf FROM pr LEFT JOIN fd a ON a.station = up LEFT JOIN fd b ON b.station = down LEFT JOIN lt ON lt.station = down LEFT JOIN lf ON lf.station = up),
pg AS (SELECT *, CASE WHEN reliability <> 'haute' THEN 'reliability' WHEN km > 100 THEN 'distance' WHEN NOT same_origin THEN 'origin' WHEN n_up IS NULL OR n_down IS NULL THEN 'no_level' WHEN n_up < 100 OR n_down < 100 THEN 'few_rows' WHEN nf = 0 THEN 'no_flood' END AS reason FROM pj),
ev AS (SELECT pg.*, fl.first_ts, epoch_us(fl.peak_ts) AS pu, fl.rise, epoch_us(fl.first_ts) + (greatest(km / 10 - 2, 0) * {HOUR})::DOUBLE AS f0, epoch_us(fl.peak_ts) + ((km / 2 + 2) * {HOUR})::DOUBLE AS f1 FROM pg JOIN fl ON fl.station = up WHERE reason IS NULL),
ez AS (SELECT * EXCLUDE (f0, f1), trunc(f0)::BIGINT AS f0, trunc(f1)::BIGINT AS f1 FROM ev),
nr AS (SELECT ez.up, ez.down, ez.first_ts, count(*) FILTER (WHERE u < f0) AS np, median(value) FILTER (WHERE u < f0) AS pm, arg_min(value, u) FILTER (WHERE u < f0) AS v0, arg_max(value, u) FILTER (WHERE u < f0) AS v1, min(u) FILTER (WHERE u < f0) AS u0, max(u) FILTER (WHERE u < f0) AS u1, count(*) FILTER (WHERE u >= f0) AS ni, max(value) FILTER (WHERE u >= f0) AS pk, arg_max(u, (value, -u)) FILTER (WHERE u >= f0) AS pku FROM ez JOIN lv ON lv.station = down AND u BETWEEN f0 - 86400000000 AND f1 GROUP BY ALL),
fu AS (SELECT ez.*, coalesce(np, 0) AS np, coalesce(ni, 0) AS ni, CASE WHEN coalesce(np, 0) >= 10 THEN pm ELSE med END AS local, v0, v1, u0, u1, pk, pku FROM ez LEFT JOIN nr USING (up, down, first_ts)),
fg AS (SELECT *, local + greatest(5, 0.1 * rise) AS threshold, CASE WHEN np >= 10 AND local > med + 1.5 * (med - low) THEN 'already_high' WHEN np >= 10 AND coalesce((v1 - v0) / nullif((u1 - u0) / 3.6e9, 0) <= -0.5, false) THEN 'recession' WHEN ni / ((f1 - f0) / step) < 0.5 THEN 'coverage' WHEN ni = 0 THEN 'empty' END AS guard FROM fu)
SELECT up, down, NULL::TIMESTAMP AS first_ts, 'decline' AS verdict, reason, NULL::DOUBLE AS lag_h, NULL::DOUBLE AS peak, NULL::DOUBLE AS threshold FROM pg WHERE reason IS NOT NULL
UNION ALL SELECT up, down, first_ts, CASE WHEN guard IS NOT NULL THEN 'decline' WHEN pk >= threshold THEN 'confirmation' ELSE 'anomaly' END, guard, round((pku - pu) / 3.6e9, 4), round(pk, 4), round(threshold, 4) FROM fg"""


@query(_PROPAGATION)
def flood_propagation(spark, sf_dir):
    found = interstation.flood_propagation(_level(spark, sf_dir), _pairs(spark, sf_dir))
    return rounded(found.select("up", "down", "first_ts", "verdict", "reason", "lag_h", "peak", "threshold"))


# downstream has to rise so much that some floods don't pass on
@query(_PROPAGATION.replace("greatest(5, 0.1 * rise)", "greatest(150, 0.1 * rise)").replace("SELECT up, down, NULL::TIMESTAMP", "SELECT count(*) AS n, verdict, max(peak) AS peak FROM (SELECT up, down, NULL::TIMESTAMP") + ") GROUP BY verdict")
def flood_verdicts(spark, sf_dir):
    found = interstation.flood_propagation(_level(spark, sf_dir), _pairs(spark, sf_dir), replace(DEFAULTS, flood_rise_down=150.0))
    return rounded(found.groupBy("verdict").agg(F.count("*").alias("n"), F.max("peak").alias("peak")))


@query("""WITH r AS (SELECT CASE WHEN l_quantity < 10 THEN 'rows missing du order' || (l_orderkey % 7) WHEN l_quantity < 30 THEN 'distance : ' || (l_orderkey % 5) ELSE 'no level' END AS reason FROM lineitem),
q AS (SELECT replace(reason, 'missing du', 'missing du ') AS reason FROM r) SELECT split_part(split_part(reason, ' du ', 1), ' : ', 1) AS kind, count(*) AS n, min(reason) AS example FROM q GROUP BY ALL""")
def decline_reasons(spark, sf_dir):
    key = lambda n: (F.col("l_orderkey") % n).cast("string")
    reason = F.when(F.col("l_quantity") < 10, F.concat(F.lit("rows missing du  order"), key(7))).when(F.col("l_quantity") < 30, F.concat(F.lit("distance : "), key(5))).otherwise("no level")
    return interstation.decline_reasons(table(spark, sf_dir, "lineitem").select(reason.alias("reason")))


@query(f"""WITH {M}, {EDGES}, {_LEVEL}, {_PAIRS}, pk AS (SELECT station, arg_max(u, value) AS u, max(value) AS v, median(value) AS med FROM lv GROUP BY station), a AS (SELECT station, u, (v - med) / nullif(abs(med), 0) AS amp FROM pk)
SELECT up, down, round((y.u - x.u) / 3.6e9, 4) AS lag_h, round(x.amp, 4) AS up_amp, round(y.amp, 4) AS down_amp, CASE WHEN y.u < x.u THEN 'before' WHEN y.amp < 0.1 * x.amp THEN 'flat' WHEN (y.u - x.u) / 3.6e9 > 72 THEN 'late' ELSE 'follows' END AS verdict FROM pr JOIN a x ON x.station = up JOIN a y ON y.station = down""")
def peak_lag(spark, sf_dir):
    return rounded(interstation.peak_lag(_level(spark, sf_dir), _pairs(spark, sf_dir)))


@query(f"WITH {M}, {EDGES}, {STATIONS} SELECT coalesce(a.origin, 'unknown') || ' > ' || coalesce(b.origin, 'unknown') AS origins, count(*) AS n FROM e LEFT JOIN st a ON a.station = src LEFT JOIN st b ON b.station = dst GROUP BY ALL")
def origin_pairs(spark, sf_dir):
    m = measurements(spark, sf_dir)
    return interstation.origin_pairs(tree_edges(m).select(F.col("src").alias("up"), F.col("dst").alias("down")), stations_frame(m))


# Graph
_PATHS = f"""WITH RECURSIVE {NODES}, {EDGES}, r AS (SELECT src, dst, length, 1 AS hops, CASE WHEN obstacle IS NULL THEN []::VARCHAR[] ELSE [obstacle] END AS obs FROM e UNION ALL SELECT r.src, e.dst, r.length + e.length, r.hops + 1, CASE WHEN e.obstacle IS NULL OR list_contains(r.obs, e.obstacle) THEN r.obs ELSE list_append(r.obs, e.obstacle) END FROM r JOIN e ON r.dst = e.src WHERE r.src <> e.dst)"""


@query(f"{_PATHS} SELECT src, dst, round(length, 2) AS length, hops::BIGINT AS hops, array_to_string(list_sort(obs), ',') AS obstacles FROM r")
def reachability(spark, sf_dir):
    paths = graph.reachable(tree_edges(nodes(spark, sf_dir)))
    return paths.select("src", "dst", F.round("length", 2).alias("length"), F.col("hops").cast("long").alias("hops"), F.array_join("obstacles", ",").alias("obstacles"))


@query(f"{_PATHS}, q AS (SELECT *, list_filter(obs, lambda x: x <> 'gap') AS real_obs FROM r) SELECT src AS up, dst AS down, round(length / 1000, 1) AS km, len(list_filter(obs, lambda x: x = 'barrage'))::BIGINT AS n_dams, array_to_string(list_sort(obs), ', ') AS crosses, CASE WHEN len(real_obs) = 0 THEN 'haute' WHEN real_obs = ['plan_eau'] THEN 'moyenne' ELSE 'à valider' END AS reliability FROM q")
def relations(spark, sf_dir):
    m = nodes(spark, sf_dir)
    stations = m.select("station").distinct().withColumn("node", F.col("station"))
    return rounded(graph.relations(graph.reachable(tree_edges(m)), stations), 1)


@query(f"{_PATHS}, a AS (SELECT src, dst FROM r) SELECT src, dst FROM a WHERE NOT EXISTS (SELECT 1 FROM a x JOIN a y ON x.dst = y.src WHERE x.src = a.src AND y.dst = a.dst)")
def direct_links(spark, sf_dir):
    return graph.direct_links(graph.reachable(tree_edges(nodes(spark, sf_dir))))


@query(f"WITH {NODES}, {EDGES}, d AS (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM d GROUP BY node")
def degree(spark, sf_dir):
    return graph.degrees(tree_edges(nodes(spark, sf_dir)))


@query("""WITH RECURSIVE k AS (SELECT c_custkey::BIGINT AS a, (c_custkey - c_custkey % 7 + (c_nationkey % 7))::BIGINT AS b FROM customer), b2 AS (SELECT a, b FROM k UNION SELECT b, a FROM k), r AS (SELECT a AS node, a AS other FROM b2 UNION SELECT r.node, b2.b FROM r JOIN b2 ON r.other = b2.a) SELECT node, min(other) AS component FROM r GROUP BY node""")
def components(spark, sf_dir):
    key = F.col("c_custkey")
    return graph.weak_components(table(spark, sf_dir, "customer").select(key.cast("long").alias("src"), (key - key % 7 + F.col("c_nationkey") % 7).cast("long").alias("dst")))


@query(f"{_PATHS} SELECT dst AS down, count(DISTINCT src) AS n_up FROM r GROUP BY dst")
def upstream_count(spark, sf_dir):
    m = nodes(spark, sf_dir)
    return graph.upstream_count(tree_edges(m), m.select("station", F.col("station").alias("node")).distinct())


# every station's way to the one of a third of its number, if its water goes there
_ASKED = "k AS (SELECT DISTINCT station AS a, 'S' || lpad((substr(station, 2)::INT // 4 + substr(station, 2)::INT % 3)::VARCHAR, 6, '0') AS b FROM m)"


@query(f"{_PATHS}, {_ASKED} SELECT a, b, r.src IS NOT NULL AS leads, round(r.length, 2) AS length, r.hops::BIGINT AS hops FROM k LEFT JOIN r ON r.src = a AND r.dst = b")
def leads_to(spark, sf_dir):
    m = nodes(spark, sf_dir)
    n = F.substring("station", 2, 9).cast("int")
    asked = m.select(F.col("station").alias("a"), F.concat(F.lit("S"), F.lpad((F.floor(n / 4) + n % 3).cast("string"), 6, "0")).alias("b")).distinct()
    return forest.leads_to(asked, forest.forest_index(tree_edges(m))).withColumn("length", F.round("length", 2))


@query(f"{_PATHS} SELECT 'up' AS way, src AS node, round(length, 2) AS length, hops::BIGINT AS hops FROM r WHERE dst = 'S000003' UNION ALL SELECT 'down', dst, round(length, 2), hops::BIGINT FROM r WHERE src = (SELECT max(src) FROM e)")
def upstream_and_downstream(spark, sf_dir):
    edges = tree_edges(nodes(spark, sf_dir))
    index = forest.forest_index(edges)
    last = edges.agg(F.max("src")).first()[0]
    both = forest.upstream_of(index, "S000003").select(F.lit("up").alias("way"), "*").unionByName(forest.downstream_of(index, last).select(F.lit("down").alias("way"), "*"))
    return both.withColumn("length", F.round("length", 2))


@query(f"WITH RECURSIVE {NODES}, {EDGES}, l AS (SELECT src AS node, 0 AS level FROM e UNION SELECT dst, level + 1 FROM l JOIN e ON l.node = e.src) SELECT node, max(level)::BIGINT AS level FROM l GROUP BY node")
def topological_levels(spark, sf_dir):
    return rounded(graph.topological_levels(tree_edges(nodes(spark, sf_dir))))


@query(f"""WITH {NODES}, {STATIONS}, s AS (SELECT DISTINCT (s_suppkey % 50)::BIGINT AS id, (s_suppkey % 50) * 2000.0 AS ax, (s_suppkey * 7 % 50) * 2000.0 AS ay FROM supplier), g AS (SELECT DISTINCT ON (id) id, ax, ay FROM s ORDER BY id),
d AS (SELECT station, id, x - ax AS px, y - ay AS py, x, y, ax, ay FROM st, g), c AS (SELECT station, id, least(1, greatest(0, (px * 3000 + py * 1000) / 1e7)) AS t, px, py FROM d), k AS (SELECT station, id, sqrt((px - t * 3000) ** 2 + (py - t * 1000) ** 2) AS meters FROM c),
b AS (SELECT *, row_number() OVER ({_BY} ORDER BY meters, id) AS rn FROM k WHERE meters <= 3000) SELECT st.station, b.id AS seg_id, round(b.meters, 3) AS meters FROM st LEFT JOIN b ON b.station = st.station AND rn = 1""")
def snap_stations(spark, sf_dir):
    k = F.col("s_suppkey")
    seg = table(spark, sf_dir, "supplier").select((k % 50).cast("long").alias("seg_id"), ((k % 50) * 2000.0).alias("ax"), ((k * 7 % 50) * 2000.0).alias("ay")).dropDuplicates(["seg_id"])
    point = lambda dx, dy: F.struct((F.col("ax") + dx).alias("x"), (F.col("ay") + dy).alias("y"))
    lines = seg.select("seg_id", F.array(point(0.0, 0.0), point(3000.0, 1000.0)).alias("coords"), F.col("seg_id").cast("string").alias("dst"))
    return rounded(graph.snap_stations(stations_frame(nodes(spark, sf_dir)), lines, 3000.0).select("station", "seg_id", "meters"), 3)


# State
_ST = replace(DEFAULTS, flatline_long_h=12.0)
_STATE = f"""WITH {GAUGES}, s AS (SELECT station, sensor, max(ts) AS last_ts, arg_max(value, ts) AS last_value FROM m GROUP BY ALL), c AS (SELECT max(ts) AS now FROM m), a14 AS (SELECT * FROM (SELECT *, max(epoch_us(ts)) OVER (PARTITION BY station, sensor) - epoch_us(ts) AS age FROM m) WHERE age <= 14 * 86400000000),
dr AS (SELECT station, sensor, regr_slope(value, -age / 86.4e9) AS slope FROM a14 WHERE sensor = '0002' AND age <= 7 * 86400000000 GROUP BY ALL HAVING count(*) >= 10 AND max(age) >= 2 * 86400000000),
fv AS (SELECT station, sensor, arg_max(value, ts) AS lv FROM a14 WHERE sensor IN ('0001', '0007') GROUP BY ALL), fo AS (SELECT station, sensor, lv, max(ts) FILTER (WHERE value <> lv) AS o FROM a14 JOIN fv USING (station, sensor) GROUP BY ALL),
ft AS (SELECT station, sensor, lv, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS hours FROM a14 JOIN fo USING (station, sensor) WHERE o IS NULL OR ts > o GROUP BY ALL), q AS (SELECT station, sensor, last_ts, last_value, slope, hours, lv, (epoch_us(now) - epoch_us(last_ts)) / 3.6e9 AS lag_h FROM s LEFT JOIN dr USING (station, sensor) LEFT JOIN ft USING (station, sensor), c),
y AS (SELECT *, CASE WHEN lag_h >= 6 THEN 'L3' WHEN sensor = '0002' AND last_value <= 11 THEN 'BAT' WHEN slope <= -0.05 THEN 'L2' WHEN hours >= 12 AND NOT (sensor = '0007' AND lv = 0) THEN 'L1' END AS rule FROM q), z AS (SELECT *, CASE WHEN rule = 'L3' THEN 'muet' WHEN rule IS NOT NULL THEN 'degrade' ELSE 'ok' END AS state FROM y),
t AS (SELECT station, CASE WHEN bool_and(state = 'muet') THEN 'arret' WHEN bool_or(state <> 'ok') THEN 'critique' ELSE 'marche' END AS state, count(*) AS n_sensors, count(*) FILTER (WHERE state <> 'ok') AS n_unwell FROM z GROUP BY station),
dc AS (SELECT DISTINCT station, CASE substr(station, 2, 2)::INT % 3 WHEN 0 THEN 'marche' WHEN 1 THEN 'critique' ELSE 'arret' END AS declared FROM m WHERE substr(station, 2, 2)::INT % 7 <> 0)"""


def _sensors(spark, sf_dir):
    return state.sensor_state(gauges(spark, sf_dir), _ST, silence_h=6.0)


def _declared(spark, sf_dir):
    n = F.substring("station", 2, 2).cast("int")
    return measurements(spark, sf_dir).select("station").distinct().where(n % 7 != 0).withColumn("state", F.when(n % 3 == 0, "marche").when(n % 3 == 1, "critique").otherwise("arret"))


@query(f"{_STATE} SELECT station, sensor, last_ts, round(lag_h, 4) AS lag_h, state, rule FROM z")
def sensor_state(spark, sf_dir):
    return rounded(_sensors(spark, sf_dir))


@query(f"{_STATE}, wr AS (SELECT *, row_number() OVER ({_BY} ORDER BY lag_h DESC, sensor) AS rn FROM z) SELECT station, sensor, last_ts, round(lag_h, 4) AS lag_h FROM wr WHERE rn = 1")
def worst_sensors(spark, sf_dir):
    return rounded(listing.worst_sensors(_sensors(spark, sf_dir)).select("station", "sensor", "last_ts", "lag_h"))


@query(f"{_STATE} SELECT * FROM t")
def station_state(spark, sf_dir):
    return state.station_state(_sensors(spark, sf_dir))


@query(f"{_STATE} SELECT t.station, t.state, declared, coalesce(t.state <> declared, false)::VARCHAR AS diverges FROM t LEFT JOIN dc USING (station)")
def state_divergence(spark, sf_dir):
    found = state.divergence(state.station_state(_sensors(spark, sf_dir)), _declared(spark, sf_dir))
    return rounded(found.select("station", "state", "declared", "diverges"))


_COVERAGE = "cv AS (SELECT m.station, (epoch_us(max(m.ts)) - epoch_us(min(m.ts))) / 3.6e9 AS hours FROM m JOIN z ON z.station = m.station AND z.sensor = m.sensor AND z.state <> 'muet', c WHERE epoch_us(m.ts) >= epoch_us(now) - 604800000000 GROUP BY m.station)"


@query(f"{_STATE}, {_COVERAGE} SELECT station, round(hours, 4) AS hours FROM cv")
def active_coverage(spark, sf_dir):
    return rounded(state.active_coverage(gauges(spark, sf_dir), _sensors(spark, sf_dir)))


@query(f"""{_STATE}, {_COVERAGE}, j AS (SELECT t.station, t.state, coalesce(t.state <> declared, false) AND (list_position(['marche', 'critique', 'arret'], t.state) >= list_position(['marche', 'critique', 'arret'], declared) OR coalesce(hours, 0) >= 24) AS justified FROM t LEFT JOIN dc USING (station) LEFT JOIN cv USING (station)),
pn AS (SELECT DISTINCT station, 'critique' AS proposed, 'old' AS provenance FROM m WHERE substr(station, 2, 2)::INT % 2 = 0)
SELECT coalesce(j.station, pn.station) AS station, CASE WHEN justified AND pn.station IS NOT NULL THEN 'enrich' WHEN justified THEN 'open' WHEN pn.station IS NOT NULL THEN 'close' ELSE 'ignore' END AS action, CASE WHEN justified THEN j.state ELSE proposed END AS proposed, coalesce(CASE WHEN substr(j.station, 2, 2)::INT % 3 = 0 THEN 'new' END, pn.provenance) AS provenance FROM j FULL JOIN pn USING (station)""")
def proposal_merge(spark, sf_dir):
    m, sensors = gauges(spark, sf_dir), _sensors(spark, sf_dir)
    n = F.substring("station", 2, 2).cast("int")
    pending = m.select("station").distinct().where(n % 2 == 0).withColumns({"proposed": F.lit("critique"), "provenance": F.lit("old")})
    diverging = state.divergence(state.station_state(sensors), _declared(spark, sf_dir))
    found = state.justified(diverging, state.active_coverage(m, sensors)).withColumn("provenance", F.when(n % 3 == 0, "new"))
    return state.proposal_merge(pending, found)


_STATUS = "['en_attente', 'confirme', 'repare', 'faux_positif', 'caduque']"
_PROPOSALS = f"pp AS (SELECT event_id AS id, station, ts AS at_ts, {_STATUS}[(event_id % 5 + 1)::INT] AS status, ['marche', 'critique', 'arret'][(event_id % 3 + 1)::INT] AS state, value AS high FROM m)"


def _proposals(spark, sf_dir, readings=measurements):
    pick = lambda names, k: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("event_id") % k + 1).cast("int"))
    return readings(spark, sf_dir).select(F.col("event_id").alias("id"), "station", F.col("ts").alias("at"), pick(("en_attente", "confirme", "repare", "faux_positif", "caduque"), 5).alias("status"), pick(state.STATES, 3).alias("state"), F.col("value").alias("high"))


@query(f"WITH {M}, {_PROPOSALS}, k AS (SELECT *, row_number() OVER ({_BY} ORDER BY at_ts DESC, id DESC) AS rn FROM pp WHERE status = 'confirme') SELECT id, station, at_ts, status, state FROM k WHERE rn = 1")
def latest_state(spark, sf_dir):
    return state.latest_state(_proposals(spark, sf_dir).where("status = 'confirme'").drop("high")).withColumnRenamed("at", "at_ts")


@query(f"WITH {M}, {_PROPOSALS} SELECT count(*) AS n, count(*) FILTER (WHERE status = 'en_attente') AS n_en_attente, count(*) FILTER (WHERE status = 'confirme') AS n_confirme, count(*) FILTER (WHERE status = 'repare') AS n_repare, count(*) FILTER (WHERE status = 'faux_positif') AS n_faux_positif, count(*) FILTER (WHERE status = 'caduque') AS n_caduque, round(100.0 * count(*) FILTER (WHERE status IN ('confirme', 'repare')) / nullif(count(*) FILTER (WHERE status IN ('confirme', 'repare', 'faux_positif')), 0), 4) AS precision_pct FROM pp")
def proposal_stats(spark, sf_dir):
    return rounded(state.proposal_stats(_proposals(spark, sf_dir)))


@query(f"WITH {M}, {_PROPOSALS} SELECT round((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(min(at_ts) FILTER (WHERE status = 'en_attente'))) / 86.4e9, 6) AS days FROM pp")
def oldest_pending(spark, sf_dir):
    return rounded(state.oldest_pending(_proposals(spark, sf_dir), F.expr("timestamp_ntz'2024-02-01 00:00:00'")), 6)


@query(f"WITH {M}, {_PROPOSALS}, g AS (SELECT id // 4 AS pid, station, state, status, at_ts, row_number() OVER (PARTITION BY id // 4 ORDER BY at_ts, status) AS rn, count(*) OVER (PARTITION BY id // 4) AS c FROM pp WHERE status <> 'en_attente') SELECT pid::BIGINT AS proposal_id, station, status, c - 1 AS n_late, (status = 'confirme')::VARCHAR AS takes_effect FROM g WHERE rn = 1")
def proposal_answers(spark, sf_dir):
    p = _proposals(spark, sf_dir).select(F.floor(F.col("id") / 4).alias("proposal_id"), "station", F.col("state").alias("proposed"), "status", "at")
    return rounded(state.answers(p).select("proposal_id", "station", "status", "n_late", "takes_effect"))


@query(f"""{_STATE}, {_PROPOSALS}, k AS (SELECT *, row_number() OVER ({_BY} ORDER BY at_ts DESC, id DESC) AS rn FROM pp WHERE status = 'confirme' AND high > 200), pe AS (SELECT DISTINCT station FROM pp WHERE status = 'en_attente' AND high > 200)
SELECT dc.station, coalesce(k.state, declared) AS state, (k.state IS NOT NULL)::VARCHAR AS validated, (pe.station IS NOT NULL)::VARCHAR AS pending FROM dc LEFT JOIN k ON k.station = dc.station AND rn = 1 LEFT JOIN pe ON pe.station = dc.station""")
def effective_states(spark, sf_dir):
    p = _proposals(spark, sf_dir, gauges)
    latest = state.latest_state(p.where("status = 'confirme' and high > 200"))
    return rounded(state.effective_states(_declared(spark, sf_dir), latest, p.where("status = 'en_attente' and high > 200")))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def not_configured(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return listing.not_among(table(spark, sf_dir, "customer").select("c_custkey"), urgent, "c_custkey")


@query(f"WITH {M}, {STATIONS} SELECT count(DISTINCT station) AS n FROM m WHERE station NOT IN (SELECT station FROM st WHERE altitude IS NOT NULL)")
def no_provenance(spark, sf_dir):
    m = measurements(spark, sf_dir)
    return listing.not_among(m, stations_frame(m).where("altitude is not null"), "station").agg(F.count_distinct("station").alias("n"))


# Files
_NAMES = "f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'notes.txt' ELSE lpad((o_orderkey % 50)::VARCHAR, 10, '0') || '_' || strftime(o_orderdate, '%Y%m%d') || '101500.MIS' END AS name, (o_orderkey % 97)::BIGINT AS size FROM orders)"


def _files(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 10 == 0, "notes.txt").otherwise(F.concat(F.lpad((F.col("o_orderkey") % 50).cast("string"), 10, "0"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("101500.MIS")))
    return o.select("o_orderkey", name.alias("name"), (F.col("o_orderkey") % 97).cast("long").alias("size"))


@query(f"WITH {_NAMES} SELECT o_orderkey, name FROM f WHERE (name = 'notes.txt' OR (substr(name, 12, 8) >= '19970101' AND substr(name, 1, 10)::INT < 25))")
def name_pruning(spark, sf_dir):
    wanted = [str(i).zfill(10) for i in range(25)]
    return telemetry.prune_names(_files(spark, sf_dir), since="1997-01-01 00:00:00", stations=wanted).select("o_orderkey", "name")


@query(f"""WITH {_NAMES}, g AS (SELECT *, md5(name) AS digest, lpad(o_orderkey::VARCHAR, 12, '0') AS path FROM f), s AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY path) AS rn FROM g),
t AS (SELECT CASE WHEN size = 0 THEN 'vide' WHEN name LIKE '%0105%' OR rn > 1 THEN 'doublon' WHEN o_orderkey % 13 = 0 THEN 'illisible' WHEN o_orderkey % 20 = 5 THEN 'refuse_provenance' ELSE 'ingere' END AS status FROM s) SELECT status, count(*) AS n FROM t GROUP BY status""")
def journal_status(spark, sf_dir):
    files = _files(spark, sf_dir).withColumns({"digest": F.md5(F.col("name").cast("binary")), "path": F.lpad(F.col("o_orderkey").cast("string"), 12, "0")})
    readings = files.where("o_orderkey % 13 <> 0").select("path", (F.col("o_orderkey") % 20).cast("string").alias("station"))
    simulated = spark.createDataFrame([("5",)], "station string")
    status = telemetry.file_status(files, readings, files.where(F.col("name").contains("0105")).select("digest"), simulated)
    return status.groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {M} SELECT station, sensor, date_trunc('second', ts) AS ts, CASE WHEN event_id % 9 <> 0 THEN round(value, 2) END AS value, CASE WHEN event_id % 9 = 0 THEN (event_id % 4)::VARCHAR END AS code FROM m")
def parse_telemetry(spark, sf_dir):
    m = measurements(spark, sf_dir)
    silent = F.col("event_id") % 9 == 0
    sent = m.select("station", "sensor", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"), F.when(~silent, F.round("value", 2)).alias("value"), F.when(silent, (F.col("event_id") % 4).cast("string")).alias("code"))
    files = telemetry.telemetry_lines(sent).select(F.concat_ws("/", "station", F.date_format("day", "yyyyMMdd")).alias("path"), "text")
    return telemetry.parse_telemetry(files).select("station", "sensor", "ts", "value", "code")


@query(f"""WITH {M}, r AS (SELECT station, sensor, date_trunc('second', ts) AS ts, round(value, 2) AS value FROM m WHERE event_id % 9 <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY station, sensor, ts ORDER BY value) AS rn FROM r)
SELECT station, sensor, ts, value FROM k WHERE rn = 1""")
def ingest_campaign(spark, sf_dir):
    m = measurements(spark, sf_dir)
    sent = m.select("station", "sensor", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"), F.when(F.col("event_id") % 9 != 0, F.round("value", 2)).alias("value"), F.lit("10").alias("code"))
    name = F.concat(F.col("station"), F.lit("_"), F.date_format("day", "yyyyMMdd"), F.lit("000000.MIS"))
    files = checkpointed(telemetry.telemetry_lines(sent).select(name.alias("path"), name.alias("name"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("digest"), "text"))
    facts, journal = shared_path(spark, "facts"), shared_path(spark, "journal")
    for _ in range(2):  # the second campaign finds everything done
        telemetry.store(files, facts, journal)
    return schemas.read_facts(spark, facts).select("station", "sensor", "ts", "value")


@query(f"""WITH {NODES}, {EDGES}, {STATIONS}, bb AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM st), k AS (SELECT e.*, src AS s, dst AS d FROM e WHERE obstacle IS DISTINCT FROM 'barrage')
SELECT st.station AS node, x, y, (SELECT max(length) FROM k WHERE k.d = st.station) AS stream_order FROM st, bb WHERE station IN (SELECT d FROM k) AND station NOT IN (SELECT s FROM k) AND x > x0 + 3000 AND x < x1 - 3000 AND y > y0 + 3000 AND y < y1 - 3000""")
def unexplained_stops(spark, sf_dir):
    m = nodes(spark, sf_dir)
    e = tree_edges(m).where("obstacle is distinct from 'barrage'").withColumn("stream_order", F.col("length"))  # dams stop the river
    return graph.unexplained_stops(e, stations_frame(m).select(F.col("station").alias("node"), "x", "y"))


# River map: a segment for each edge of the network, straight from node to node; the dams' edges are missing from the map.
def _river(spark, sf_dir):
    m = nodes(spark, sf_dir)
    at = stations_frame(m).select("station", F.col("x"), F.col("y"))
    end = lambda c: at.select(F.col("station").alias(c), F.struct("x", "y").alias(f"{c}_at"))
    e = tree_edges(m).join(end("src"), "src").join(end("dst"), "dst")
    return at.withColumnRenamed("station", "node"), e.where("obstacle is distinct from 'barrage'"), e.where("obstacle = 'barrage'")


_SINKS = "k AS (SELECT * FROM e WHERE obstacle IS DISTINCT FROM 'barrage'), sk AS (SELECT DISTINCT dst AS node FROM k WHERE dst NOT IN (SELECT src FROM k)), so AS (SELECT DISTINCT src AS node FROM k WHERE src NOT IN (SELECT dst FROM k))"


@query(f"""WITH {NODES}, {EDGES}, {STATIONS}, {_SINKS}, pl AS (SELECT DISTINCT floor(x / 50000)::BIGINT * 1000 + floor(y / 50000)::BIGINT AS poly_id, floor(x / 50000) * 50000 AS px, floor(y / 50000) * 50000 AS py FROM st),
nn AS (SELECT station AS node, x, y FROM st WHERE station IN (SELECT src FROM k UNION SELECT dst FROM k)), ins AS (SELECT nn.node, pl.poly_id FROM nn JOIN pl ON x >= px + 400 AND x <= px + 49600 - 1 AND y >= py + 400 AND y <= py + 49600 - 1)
SELECT a.node AS src, b.node AS dst, a.poly_id FROM (SELECT * FROM ins WHERE node IN (SELECT node FROM sk)) a JOIN (SELECT * FROM ins WHERE node IN (SELECT node FROM so)) b USING (poly_id) WHERE a.node <> b.node""")
def reservoir_links(spark, sf_dir):
    at, edges, _ = _river(spark, sf_dir)
    used = at.join(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "node", "left_semi")
    px, py = (F.floor(F.col(c) / 50_000) * 50_000 for c in "xy")
    corner = lambda dx, dy: F.struct((F.col("px") + dx).cast("double").alias("x"), (F.col("py") + dy).cast("double").alias("y"))
    # squares of 49.2 km less their buffer: coordinates are whole kilometres, so none lies on a border
    polygons = at.select(px.alias("px"), py.alias("py")).distinct().select((F.col("px") / 50_000 * 1000 + F.col("py") / 50_000).cast("long").alias("poly_id"), F.lit("plan_eau").alias("kind"), F.lit(1).alias("rank"), F.array(corner(900, 900), corner(49_100, 900), corner(49_100, 49_100), corner(900, 49_100)).alias("ring"))
    return graph.reservoir_links(edges, used, polygons).select("src", "dst", "poly_id")


@query()
def repair_gaps(spark, sf_dir):
    at, edges, missing = _river(spark, sf_dir)
    number = F.substring("src", 2, 9).cast("long")
    segments = edges.select(number.alias("seg_id"), (number % 3).cast("string").alias("name"), F.array("src_at", "dst_at").alias("coords"), "dst")
    # the lowest dams' nodes are the points that were checked
    gaps = missing.select(number.alias("num"), (number % 3).cast("string").alias("name"), F.col("src_at.x").alias("x"), F.col("src_at.y").alias("y"), "src").orderBy("num")
    keyed = at.withColumn("node", graph.node_key(F.col("x"), F.col("y")))
    name = lambda c: graph.node_key(F.col(f"{c}_at.x"), F.col(f"{c}_at.y"))
    named = edges.select(name("src").alias("src"), name("dst").alias("dst"))
    return graph.repair_gaps(named, segments.withColumn("dst", graph.node_key(F.col("coords")[1]["x"], F.col("coords")[1]["y"])), keyed, gaps, same_name_m=20_000.0, other_m=8_000.0)


@query(
    """WITH p AS (SELECT s_suppkey AS poly_id, (s_suppkey * 37 % 100 * 700)::DOUBLE AS px, (s_suppkey * 61 % 100 * 700)::DOUBLE AS py FROM supplier),
n AS (SELECT c_custkey AS node, c_custkey * 7919 % 70000 + 0.25 AS x, c_custkey * 10473 % 70000 + 0.25 AS y FROM customer)
SELECT poly_id::BIGINT AS poly_id, count(*)::BIGINT AS n_nodes, min(node)::BIGINT AS first_node, max(node)::BIGINT AS last_node FROM p JOIN n ON x BETWEEN px AND px + 4000 AND y BETWEEN py AND py + 4000
WHERE NOT (x BETWEEN px + 1000 AND px + 3000 AND y BETWEEN py + 1000 AND py + 3000) OR (x BETWEEN px + 1500 AND px + 2500 AND y BETWEEN py + 1500 AND py + 2500) GROUP BY poly_id"""
)
def nodes_in_wkb_polygons(spark, sf_dir):
    """Nodes inside polygons that come as binary geometry, each with a hole and an island in it. (SRC-07, JN-15)"""
    k = F.col("s_suppkey").cast("long")
    at = table(spark, sf_dir, "supplier").select(k.alias("poly_id"), (k * 37 % 100 * 700).cast("double").alias("px"), (k * 61 % 100 * 700).cast("double").alias("py"))
    corner = lambda dx, dy: F.struct((F.col("px") + dx).alias("x"), (F.col("py") + dy).alias("y"))
    ring = lambda a, b: F.array(corner(a, a), corner(b, a), corner(b, b), corner(a, b), corner(a, a))
    blobs = with_wkb(at.select("poly_id", F.array(F.array(ring(0.0, 4000.0), ring(1000.0, 3000.0)), F.array(ring(1500.0, 2500.0))).alias("parts")))
    c = F.col("c_custkey").cast("long")
    points = table(spark, sf_dir, "customer").select(c.alias("node"), (c * 7919 % 70000 + 0.25).cast("double").alias("x"), (c * 10473 % 70000 + 0.25).cast("double").alias("y"))
    counts = graph.count_in_polygons(points, polygons_from(blobs), 0.0)
    return counts.groupBy("poly_id").agg(F.sum("n_nodes").alias("n_nodes"), F.min("first_node").alias("first_node"), F.max("last_node").alias("last_node"))
