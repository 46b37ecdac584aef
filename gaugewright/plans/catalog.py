"""Queries of scans, dimensions, files, map building, streams' batch forms and the proposals' table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugewright.functions.scalar import excel_date
from gaugewright.operators import graph, series, state
from gaugewright.plans.network import _STATE, _declared, _sensors
from gaugewright.plans.registry import EDGES, GAUGES, NODES, STATIONS, M, gauges, measurements, nodes, query, rounded, stations_frame, table, tree_edges
from gaugewright.session import shared_path
from gaugewright.sources import tables
from gaugewright.streaming import monitor


@query(f"WITH {M}, a AS (SELECT *, max(ts) OVER (PARTITION BY station, sensor) AS last FROM m) SELECT station, sensor, count(*) AS n, min(ts) AS first_ts FROM a WHERE epoch_us(ts) >= epoch_us(last) - 7 * 86400000000 GROUP BY ALL")
def bounded_scan(spark, sf_dir):
    return series.last_days(measurements(spark, sf_dir), 7).groupBy("station", "sensor").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


@query("SELECT s_suppkey::VARCHAR || ' (' || coalesce(n_name, 'hors liste') || ')' AS label FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON s_nationkey = n_nationkey")
def station_labels(spark, sf_dir):
    known = table(spark, sf_dir, "nation").where("n_regionkey = 1")
    s = table(spark, sf_dir, "supplier").join(known, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return s.select(tables.station_label(F.col("s_suppkey").cast("string"), F.col("n_name")).alias("label"))


@query("WITH l AS (SELECT c_custkey::VARCHAR AS station, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS low, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal + 100 END AS high FROM customer) SELECT station, '0001' AS sensor, round(low, 2) AS s_low, round(high, 2) AS s_high FROM l WHERE low IS NOT NULL AND high IS NOT NULL")
def configured_limits(spark, sf_dir):
    c, path = table(spark, sf_dir, "customer"), shared_path(spark, "limits")
    low, high = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal") + 100)
    tables.write_csv(c.select(F.col("c_custkey").alias("code_station"), low.cast("double").alias("cote_min"), high.cast("double").alias("cote_max")), path)
    config = tables.read_csv(spark, path, tables.STATION_CONFIG)
    return rounded(tables.station_limits(config, {"0001": ("cote_min", "cote_max"), "0006": ("pluie_min", "pluie_max")}), 2)


@query("SELECT o_orderkey, CASE WHEN coalesce(o_orderstatus = 'F', false) THEN 'arret' WHEN o_orderpriority = '1-URGENT' THEN 'critique' ELSE 'marche' END AS state FROM orders")
def declared_states(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", state.declared_state(F.col("o_orderstatus") != "F", (F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("state"))


@query("SELECT c_custkey, strftime(DATE '1899-12-30' + (40000 + c_custkey % 5000)::INT, '%Y-%m-%d') AS day, sha256(c_name) AS digest FROM customer")
def excel_dates_and_digests(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return rounded(c.select("c_custkey", excel_date((40_000 + F.col("c_custkey") % 5000).cast("string")).alias("day"), F.sha2(F.col("c_name").cast("binary"), 256).alias("digest")))


@query(f"WITH {M} SELECT station, sensor, count(*) AS n, round(sum(value), 4) AS total FROM m WHERE sensor = 'view' GROUP BY ALL")
def fact_table(spark, sf_dir):
    path = shared_path(spark, "facts")
    m = measurements(spark, sf_dir).select("station", "sensor", "ts", "value")
    tables.write_facts(m, path)
    facts = spark.read.schema(m.schema).parquet(path)
    return rounded(facts.where("sensor = 'view'").groupBy("station", "sensor").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


@query(f"WITH {M}, s AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 21600000000 THEN 0 ELSE 1 END AS b FROM m WINDOW w AS (PARTITION BY station, sensor ORDER BY ts)), g AS (SELECT *, sum(b) OVER (PARTITION BY station, sensor ORDER BY ts) AS k FROM s) SELECT station, sensor, min(ts) AS start_ts, max(ts) + INTERVAL 6 HOUR AS silent_from, count(*) AS n FROM g GROUP BY station, sensor, k")
def reading_sessions(spark, sf_dir):
    return monitor.sessions(measurements(spark, sf_dir))


@query(f"WITH {M} SELECT station, sensor, date_trunc('hour', ts) AS start_ts, round(sum(value), 4) AS total, count(*) AS n FROM m GROUP BY ALL")
def stream_window_sums(spark, sf_dir):
    return rounded(monitor.window_sums(measurements(spark, sf_dir)))


# Map building: a segment from station to station, and a second one beside every third, of which the later counts.
_MAP = f"""{NODES}, {EDGES}, {STATIONS}, sg AS (SELECT substr(src, 2)::BIGINT AS n, a.x AS ax, a.y AS ay, b.x AS ex, b.y AS ey FROM e JOIN st a ON a.station = src JOIN st b ON b.station = dst),
se AS (SELECT n AS seg_id, * FROM sg UNION ALL SELECT n + 1000000, * FROM sg WHERE n % 3 = 0)"""


def _segments(spark, sf_dir):
    m = nodes(spark, sf_dir)
    at = lambda c: stations_frame(m).select(F.col("station").alias(c), F.struct("x", "y").alias(f"{c}_at"))
    e = tree_edges(m).join(at("src"), "src").join(at("dst"), "dst")
    one = e.select(F.substring("src", 2, 9).cast("long").alias("seg_id"), F.array("src_at", "dst_at").alias("coords"))
    return one.unionByName(one.where("seg_id % 3 = 0").withColumn("seg_id", F.col("seg_id") + 1_000_000))


@query(f"""WITH {_MAP}, k AS (SELECT seg_id, round_even(ax, 0)::BIGINT || '_' || round_even(ay, 0)::BIGINT AS src, round_even(ex, 0)::BIGINT || '_' || round_even(ey, 0)::BIGINT AS dst FROM se)
SELECT src, dst, max(seg_id) AS seg_id FROM k WHERE src <> dst GROUP BY ALL""")
def map_edges(spark, sf_dir):
    return graph.build_edges(_segments(spark, sf_dir)).select("src", "dst", "seg_id")


@query(f"""WITH {_MAP}, d AS (SELECT station, x + 300 AS x, y + 200 AS y FROM st), p AS (SELECT station, seg_id, x - ax AS px, y - ay AS py, ex - ax AS dx, ey - ay AS dy FROM d, se), t AS (SELECT *, coalesce(least(1, greatest(0, (px * dx + py * dy) / nullif(dx * dx + dy * dy, 0))), 0) AS t FROM p),
m2 AS (SELECT station, seg_id, sqrt((px - t * dx) ** 2 + (py - t * dy) ** 2) AS meters FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY meters, seg_id) AS rn FROM m2 WHERE meters <= 1000)
SELECT se.seg_id, CASE WHEN se.seg_id IN (SELECT seg_id FROM r WHERE rn = 1) THEN 'barrage' END AS obstacle FROM se""")
def marked_dams(spark, sf_dir):
    seg = _segments(spark, sf_dir)
    dams = stations_frame(nodes(spark, sf_dir)).select(F.col("station").alias("dam_id"), (F.col("x") + 300).alias("x"), (F.col("y") + 200).alias("y"))
    return graph.mark_dams(seg.withColumn("dst", graph.node_key(F.col("coords")[1]["x"], F.col("coords")[1]["y"])), dams).select("seg_id", "obstacle")


# Proposals: high readings of the past opened some, the network's state of today decides on them.
_OPEN = "po AS (SELECT event_id, station, ts, CASE WHEN event_id % 2 = 0 AND substr(station, 2, 2)::INT % 4 <> 1 THEN 'en_attente' ELSE 'confirme' END AS status FROM m WHERE sensor = '0002' AND value > 150)"


# every order is a proposal for its customer; those that are open wait
_ORDERS = "SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS station, o_orderdate::TIMESTAMP AS created_at, CASE o_orderstatus WHEN 'O' THEN 'en_attente' WHEN 'P' THEN 'caduque' ELSE 'confirme' END AS status, json_object('0001', o_orderpriority)::VARCHAR AS sensors FROM orders"


def _orders(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "en_attente").when(F.col("o_orderstatus") == "P", "caduque").otherwise("confirme")
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("station"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"), status.alias("status"), F.to_json(F.create_map(F.lit("0001"), F.col("o_orderpriority"))).alias("sensors"))


def _shown(df):
    return df.select("id", "station", "created_at", "status_label", F.col("sensors")["0001"].alias("sensor"))


_LABEL = "CASE status WHEN 'en_attente' THEN 'En attente de vérification' WHEN 'caduque' THEN 'Sans objet (problème disparu)' ELSE status END AS status_label, json_extract_string(sensors, '$.0001') AS sensor"


@query(f"SELECT id, station, created_at, {_LABEL} FROM ({_ORDERS}) WHERE status = 'en_attente'")
def waiting_proposals(spark, sf_dir):
    return _shown(state.pending_proposals(_orders(spark, sf_dir)))


@query(f"SELECT id, station, created_at, {_LABEL} FROM ({_ORDERS}) ORDER BY created_at DESC, id DESC LIMIT 200")
def proposal_journal(spark, sf_dir):
    return _shown(state.proposal_journal(_orders(spark, sf_dir)))


@query(f"""{_STATE}, cv AS (SELECT m.station, (epoch_us(max(m.ts)) - epoch_us(min(m.ts))) / 3.6e9 AS hours FROM m JOIN z ON z.station = m.station AND z.sensor = m.sensor AND z.state <> 'muet', c WHERE epoch_us(m.ts) >= epoch_us(now) - 604800000000 GROUP BY m.station), {_OPEN},
j AS (SELECT t.station, t.state, coalesce(t.state <> declared, false) AND (list_position(['marche', 'critique', 'arret'], t.state) >= list_position(['marche', 'critique', 'arret'], declared) OR coalesce(hours, 0) >= 24) AS wanted FROM t LEFT JOIN dc USING (station) LEFT JOIN cv USING (station)),
op AS (SELECT *, CASE WHEN status = 'en_attente' AND row_number() OVER (PARTITION BY station, status ORDER BY ts, event_id) > 1 THEN 'caduque' ELSE status END AS now_status FROM po),
told AS (SELECT *, CASE WHEN substr(station, 2, 2)::INT % 2 = 0 THEN '{{}}' ELSE json_object('station', state)::VARCHAR END AS said, CASE WHEN substr(station, 2, 2)::INT % 3 = 0 THEN 'seen as ' || state END AS why FROM j LEFT JOIN dc USING (station)), ev AS (SELECT op.*, coalesce(now_status = 'en_attente' AND wanted, false) AS enriched, told.* EXCLUDE (station) FROM op LEFT JOIN told USING (station))
SELECT station, 'old' AS declared, CASE WHEN enriched THEN state ELSE 'critique' END AS proposed, CASE WHEN now_status = 'en_attente' AND NOT coalesce(wanted, false) THEN 'caduque' ELSE now_status END AS status, CASE WHEN enriched THEN why ELSE 'high' END AS reason, CASE WHEN enriched THEN said ELSE json_object('0002', event_id::VARCHAR)::VARCHAR END AS sensors, CASE WHEN enriched THEN '' ELSE 'BAT' END AS rules FROM ev
UNION ALL SELECT station, declared, state, 'en_attente', why, said, '' FROM told WHERE wanted AND station NOT IN (SELECT station FROM op WHERE now_status = 'en_attente')""")
def synchronised_proposals(spark, sf_dir):
    g, sensors = gauges(spark, sf_dir), _sensors(spark, sf_dir)
    n = F.substring("station", 2, 2).cast("int")
    old = g.where((F.col("sensor") == "0002") & (F.col("value") > 150))
    open_ = (F.col("event_id") % 2 == 0) & (n % 4 != 1)
    log = old.select(F.col("event_id").cast("string").alias("id"), "station", F.lit("old").alias("declared"), F.lit("critique").alias("proposed"), F.lit("high").alias("reason"), F.create_map(F.lit("0002"), F.col("event_id").cast("string")).alias("sensors"), F.lit("BAT").alias("rules"), F.lit(None).cast("string").alias("provenance"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), F.when(open_, "en_attente").otherwise("confirme").alias("status"))
    found = state.justified(state.divergence(state.station_state(sensors), _declared(spark, sf_dir)), state.active_coverage(g, sensors))
    # of some stations nothing is told: an enriched proposal loses what it had
    told = F.when(n % 2 == 1, F.create_map(F.lit("station"), F.col("state")))
    detected = found.select("station", "state", "declared", "justified", F.when(n % 3 == 0, F.concat(F.lit("seen as "), "state")).alias("reason"), told.alias("sensors"), F.lit(None).cast("string").alias("rules"), F.lit(None).cast("string").alias("provenance"))
    after = state.synchronise(log, detected, F.expr("timestamp_ntz'2024-02-01 00:00:00'"))
    return after.select("station", "declared", "proposed", "status", "reason", F.to_json("sensors").alias("sensors"), "rules")
