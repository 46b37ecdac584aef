"""Graph operators, components, telemetry files, tables and streams."""

import random

import pytest
from pyspark.sql import functions as F

from gaugewright.operators import graph
from gaugewright.operators.components import connected_components
from gaugewright.sources import campaign, schemas, synthetic, tables, telemetry
from gaugewright.streaming import monitor


def brute_components(pairs):
    parent = {x: x for p in pairs for x in p}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, 500)] + [(i, i + 1) for i in range(300, 340)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == brute_components(pairs)


def test_components_of_nothing_nulls_and_repeats(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    got = connected_components(spark.createDataFrame([("a", None), ("b", "c"), ("c", "b"), ("b", "c")], "src string, dst string")).collect()
    assert sorted(tuple(r) for r in got) == [("b", "b"), ("c", "b")]


def test_paths_take_the_shorter_way_and_survive_cycles(spark):
    edges = spark.createDataFrame([("a", "b", 1.0, None), ("b", "c", 1.0, "barrage"), ("a", "c", 5.0, None), ("c", "a", 1.0, "gap")], "src string, dst string, length double, obstacle string")
    got = {(r["src"], r["dst"]): (r["length"], r["obstacles"]) for r in graph.reachable(edges).collect()}
    assert got[("a", "c")] == (2.0, ["barrage"]) and got[("b", "a")] == (2.0, ["barrage", "gap"]) and len(got) == 6
    stations = spark.createDataFrame([("S", "a"), ("T", "c")], "station string, node string")
    rel = {(r["up"], r["down"]): r["reliability"] for r in graph.relations(graph.reachable(edges), stations).collect()}
    assert rel == {("S", "T"): "à valider", ("T", "S"): "haute"}


def test_edges_links_levels_and_snapping(spark):
    coords = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    seg = spark.createDataFrame([(1, coords((0, 0), (1000, 0))), (2, coords((0, 0), (500, 400), (1000, 0))), (3, coords((5, 5), (5.2, 5.1)))], "seg_id long, coords array<struct<x:double,y:double>>")
    edges = graph.build_edges(seg)
    assert [r["seg_id"] for r in edges.collect()] == [2]
    st = spark.createDataFrame([("A", 500.0, 100.0), ("B", 9e5, 9e5)], "station string, x double, y double")
    got = {r["station"]: (r["seg_id"], r["meters"]) for r in graph.snap_stations(st, seg.where("seg_id = 1").withColumn("dst", F.lit("n"))).collect()}
    assert got == {"A": (1, 100.0), "B": (None, None)}
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")
    assert sorted(tuple(r) for r in graph.direct_links(e).collect()) == [("a", "b"), ("b", "c")]
    assert {r["node"]: r["level"] for r in graph.topological_levels(e).collect()} == {"a": 0, "b": 1, "c": 2}


def square(x, y, size):
    return [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + size, y), (x + size, y + size), (x, y + size))]


def test_points_in_buffered_polygons(spark):
    notch = [{"x": float(a), "y": float(b)} for a, b in ((0, 0), (10_000, 0), (10_000, 10_000), (5000, 3000), (0, 10_000))]
    poly = spark.createDataFrame([(1, notch)], "poly_id long, ring array<struct<x:double,y:double>>")
    pts = {"inside": (5000, 1000), "edge": (10_400, 5000), "out": (10_600, 5000), "notch": (5000, 6000), "near": (5000, 3400), "corner": (-300, -300), "far": (-400, -400)}
    nodes = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in pts.items()], "node string, x double, y double")
    assert {r["node"] for r in graph.in_polygons(nodes, poly, 500.0, 3000.0).collect()} == {"inside", "edge", "near", "corner"}


def test_reservoirs_link_ends_to_starts_in_turn(spark):
    at = {"a": (-5000, 0), "in": (100, 0), "out": (300, 0), "b": (5000, 0), "out2": (700, 0), "c": (9000, 0), "far": (90_000, 0), "z": (95_000, 0)}
    nodes = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in at.items()], "node string, x double, y double")
    edges = spark.createDataFrame([("a", "in"), ("out", "b"), ("out2", "c"), ("far", "z")], "src string, dst string")
    poly = spark.createDataFrame([(7, "plan_eau", 2, square(0, -200, 800)), (3, "barrage", 1, square(0, -200, 250)), (4, "plan_eau", 2, square(89_900, 0, 100))], "poly_id long, kind string, rank int, ring array<struct<x:double,y:double>>")
    got = sorted((r["src"], r["dst"], r["kind"]) for r in graph.reservoir_links(edges, nodes, poly, buffer_m=60.0).collect())
    assert got == [("in", "out", "barrage")]  # the lake comes later: its one entry has gone
    assert sorted((r["src"], r["dst"]) for r in graph.reservoir_links(edges, nodes, poly.where("poly_id = 7"), buffer_m=60.0).collect()) == [("in", "out"), ("in", "out2")]
    assert graph.reservoir_links(edges, nodes, poly.limit(0)).count() == 0


def test_gaps_are_repaired_without_cycles(spark):
    line = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    segments = [(1, "Oued X", line((0, 0), (1000, 0))), (2, "Oued X", line((1500, 100), (1500, -900), (3000, -900))), (3, None, line((1200, 0), (1200, 500))), (4, "Oued Y", line((-500, 2000), (0, 2000))), (5, None, line((100, 2000), (-500, 2000))), (6, "Oued X", line((9000, 0), (9500, 0)))]
    seg = spark.createDataFrame(segments, "seg_id long, name string, coords array<struct<x:double,y:double>>")
    edges = graph.build_edges(seg)
    named = edges.select("seg_id", "name", "coords", "dst")
    ends = edges.select(F.col("src").alias("node"), F.element_at("coords", 1).alias("p")).union(edges.select("dst", F.element_at("coords", -1))).select("node", "p.x", "p.y").distinct()
    gaps = spark.createDataFrame([(1, "Oued X", 1000.0, 0.0), (2, None, 4.0, 2003.0), (3, None, 50_000.0, 0.0), (4, None, 9500.0, 0.0)], "num long, name string, x double, y double")
    got = {r["num"]: (r["src"], r["dst"], r["seg_id"], r["length"], r["reason"]) for r in graph.repair_gaps(edges, named, ends, gaps).collect()}
    # the same name wins over the nearer nameless one; the length is the way to the segment and along it
    assert got[1] == ("1000_0", "3000_-900", 2, 500.0 + 900 + 1500, None)
    # the only way on from the end of 4 leads back to its own start
    assert got[2][1:] == (None, None, None, "cycle") and got[2][0] == "0_2000"
    assert got[3] == (None, None, None, None, "no_node") and got[4][4] == "no_candidate"
    assert graph.repair_gaps(edges, named, ends, gaps.limit(0)).count() == 0


def test_a_repair_sees_those_before_it(spark):
    line = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    seg = spark.createDataFrame([(1, None, line((0, 0), (100, 0))), (2, None, line((200, 0), (300, 0)))], "seg_id long, name string, coords array<struct<x:double,y:double>>")
    edges = graph.build_edges(seg)
    ends = spark.createDataFrame([("0_0", 0.0, 0.0), ("100_0", 100.0, 0.0), ("200_0", 200.0, 0.0), ("300_0", 300.0, 0.0)], "node string, x double, y double")
    gaps = spark.createDataFrame([(1, None, 100.0, 0.0), (2, None, 300.0, 0.0)], "num long, name string, x double, y double")
    got = {r["num"]: (r["dst"], r["reason"]) for r in graph.repair_gaps(edges, edges.select("seg_id", "name", "coords", "dst"), ends, gaps).collect()}
    assert got == {1: ("300_0", None), 2: (None, "cycle")}


TEXT = """20260830;09:00:00;1.5
<STATION>1000000001</STATION><SENSOR>0006</SENSOR>
20260831;10:00:00;0.20
20260831;10:05:00;---/[10]
20260831;10:10;7
20260831;10:10:00;12,5

a;b
<STATION>1000000001</STATION><SENSOR>0001</SENSOR>
20260831;10:00:00;245.3
20261399;10:00:00;1
"""


def test_parse_telemetry(spark):
    files = spark.createDataFrame([("a", TEXT), ("bad", "<STATION>1</STATION>\n20260831;10:00:00;1"), ("none", "20260831;10:00:00;1"), ("empty", "")], "path string, text string")
    got = [(r["block"], r["sensor"], r["value"], r["code"]) for r in telemetry.parse_telemetry(files).orderBy("path", "line").collect()]
    assert got == [(1, "0006", 1.5, None), (1, "0006", 0.2, None), (1, "0006", None, "10"), (1, "0006", None, "12,5"), (2, "0001", 245.3, None)]


def test_ingestion_is_idempotent(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "1000000001_20260831101500.MIS").write_text(TEXT)
    (tmp_path / "in" / "deep" / "1000000001_20260831101501.mis").write_text(TEXT)
    (tmp_path / "in" / "1000000002_20260831101500.MIS").write_text("no header\n")
    paths = [str(tmp_path / p) for p in ("in", "facts", "journal")]
    assert telemetry.ingest(spark, *paths, dry_run=True).count() == 3 and not (tmp_path / "facts").exists()
    first = {r["name"][:10] + r["path"][-7:]: r["status"] for r in telemetry.ingest(spark, *paths, rejects_path=str(tmp_path / "rejects")).collect()}
    assert sorted(first.values()) == ["doublon", "illisible", "ingere"]
    assert spark.read.parquet(paths[1]).count() == 3
    assert [(r["name"][:10], r["reason"], r["text"]) for r in spark.read.parquet(str(tmp_path / "rejects")).collect()] == [("1000000002", "no header", "no header\n")]
    assert telemetry.ingest(spark, *paths).count() == 0
    assert spark.read.parquet(paths[1]).count() == 3
    assert telemetry.latest_journal(spark.read.parquet(paths[2])).count() == 2
    old = telemetry.prune_names(telemetry.read_files(spark, paths[0]), since="2027-01-01 00:00:00")
    assert old.count() == 0
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "1000000003_20260901101500.MIS").write_text(TEXT.replace("1000000001", "1000000003"))
    assert telemetry.ingest(spark, [paths[0], str(tmp_path / "more")], *paths[1:]).count() == 1 and spark.read.parquet(paths[1]).count() == 6


def test_growing_files_wait(spark):
    files = spark.createDataFrame([("a", "a", 5, 9, "d1"), ("b", "b", 5, 5, "d2"), ("c", "c", 0, 0, "d3")], "path string, name string, size long, size_now long, digest string")
    readings = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, station string")
    journal = spark.createDataFrame([], "digest string")
    assert {r["path"]: r["status"] for r in telemetry.file_status(files, readings, journal).collect()} == {"a": "instable", "b": "ingere", "c": "vide"}


def test_a_late_holder_leaves_its_successor_alone(spark, tmp_path):
    lock = str(tmp_path / "lock")
    first, second, third = campaign.campaign_lock(spark, lock), campaign.campaign_lock(spark, lock, expiry_h=0.0), campaign.campaign_lock(spark, lock)
    assert first.__enter__() and second.__enter__()
    first.__exit__(None, None, None)
    assert (tmp_path / "lock").exists() and not third.__enter__()
    third.__exit__(None, None, None)
    second.__exit__(None, None, None)
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == []


def test_outdated_results_are_removed(spark, tmp_path):
    facts = spark.createDataFrame([("A", "0001", 1.0)], "station string, sensor string, value double").withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    kept = campaign.KeptResults(str(tmp_path / "kept"), keep_s=0.0, size=1)
    for name, df in (("n", facts), ("n", facts.union(facts)), ("other", facts)):
        kept.get(name, df, lambda m: m.groupBy("station").count())
        assert len(list((tmp_path / "kept").glob("*"))) == 1


def test_lock_snapshot_and_kept_results(spark, tmp_path):
    lock = str(tmp_path / "lock")
    with campaign.campaign_lock(spark, lock) as mine:
        assert mine
        with campaign.campaign_lock(spark, lock) as other:
            assert not other
        assert (tmp_path / "lock").exists()
        with campaign.campaign_lock(spark, lock, expiry_h=0.0) as late:
            assert late  # taken over from a run that was cut off
    assert not (tmp_path / "lock").exists()
    facts = spark.createDataFrame([("A", "0001", 1.0)], "station string, sensor string, value double").withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    facts.write.partitionBy("sensor").parquet(str(tmp_path / "facts"))
    copy = campaign.snapshot(spark, str(tmp_path / "facts"), str(tmp_path / "backups"), "v1")
    assert [(r["sensor"], r["value"]) for r in schemas.read_facts(spark, copy).collect()] == [("0001", 1.0)]
    with pytest.raises(FileExistsError):
        campaign.snapshot(spark, str(tmp_path / "facts"), str(tmp_path / "backups"), "v1")
    made = []
    kept = campaign.KeptResults(str(tmp_path / "kept"))
    count = lambda m: (made.append(1), m.groupBy("station").count())[1]
    assert kept.get("n", facts, count).first()["count"] == kept.get("n", facts, count).first()["count"] == 1 and len(made) == 1
    assert kept.get("n", facts.union(facts), count).first()["count"] == 2 and len(made) == 2


def test_schemas_are_created_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert schemas.read_or_empty(spark, path, schemas.JOURNAL).count() == 0
    for _ in range(2):
        schemas.create_if_absent(spark, path, schemas.JOURNAL)
    assert schemas.read_or_empty(spark, path, schemas.JOURNAL).columns[0] == "path"


def test_telemetry_files_go_round(spark, tmp_path):
    m = synthetic.inject_instant(synthetic.healthy(spark, 2, days=3)).where("sensor in ('0001', '0006')")
    telemetry.write_telemetry(m, str(tmp_path / "out"))
    texts = spark.read.text(str(tmp_path / "out"), wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    back = telemetry.parse_telemetry(texts)
    assert texts.count() == 6 and back.count() == m.count()
    same = back.join(m.withColumnRenamed("value", "was").withColumnRenamed("code", "code_was").distinct(), ["station", "sensor", "ts"]).where("(was is null and value is null and code = '10') or abs(value - was) <= 1e-3")
    assert same.count() == back.count()


def test_csv_dimensions(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿code_station;nom;cote_min;cote_max;pluie_min\n0006;Oued;1;300;\n", encoding="utf-8")
    config = tables.read_csv(spark, str(tmp_path / "c.csv"), tables.STATION_CONFIG)
    assert config.first()["code_station"] == "0006" and config.first()["altitude_m"] is None
    limits = tables.station_limits(config, {"0001": ("cote_min", "cote_max"), "0006": ("pluie_min", "pluie_max")}).collect()
    assert [(r["sensor"], r["s_high"]) for r in limits] == [("0001", 300.0)]
    tables.write_csv(config, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), sep=";", header=True).count() == 1
    assert next((tmp_path / "out").glob("*.csv")).read_bytes().startswith("\ufeffcode_station;nom;".encode())
    assert tables.read_csv(spark, str(tmp_path / "out"), tables.STATION_CONFIG).first()["code_station"] == "0006"
    place = config.withColumns({"x": F.lit(1.0), "y": F.lit(2.0), "altitude_m": F.lit("n/a")})
    origins = spark.createDataFrame([("0006", "real")], "station string, origin string")
    assert tuple(tables.context(place, origins).first()) == ("0006", 1.0, 2.0, None, "real") and tables.context(config).count() == 0


def test_streams(spark, tmp_path):
    rows = [("A", "0006", f"2024-01-01 {h:02d}:{m:02d}:00", 1.0) for h in range(6) for m in (0, 0, 30)]
    spark.createDataFrame(rows, "station string, sensor string, t string, value double").select("station", "sensor", F.col("t").cast("timestamp").alias("ts"), "value").write.parquet(str(tmp_path / "in"))
    stream = monitor.read_stream(spark, str(tmp_path / "in"), "station string, sensor string, ts timestamp, value double")
    q = monitor.window_sums(monitor.distinct_readings(stream, "1 hour"), late=None).writeStream.format("memory").queryName("sums").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["start_ts"].hour: r["n"] for r in spark.table("sums").collect()}
    assert got and set(got.values()) == {2}


def test_telemetry_stream_survives_a_replayed_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    paths = [str(tmp_path / p) for p in ("facts", "journal")]
    rejects = str(tmp_path / "rejects")
    name = lambda i: tmp_path / "in" / f"{i}_20260831101500.MIS"

    def run(checkpoint):
        files = monitor.read_telemetry_stream(spark, str(tmp_path / "in"))
        monitor.ingest_stream(files, *paths, str(tmp_path / checkpoint), rejects).awaitTermination(120)
        return schemas.read_facts(spark, paths[0])

    name(1).write_text(TEXT)
    name(2).write_text("<STATION>1</STATION>\n20260831;10:00:00;1")
    assert run("cp").count() == 3
    assert [r["name"] for r in spark.read.parquet(rejects).collect()] == ["2_20260831101500.MIS"]
    assert run("other").count() == 3  # the whole stream again, as after a lost commit
    # a later file has another value of a known key and a new one: the first value stays
    name(3).write_text("<STATION>1000000001</STATION><SENSOR>0006</SENSOR>\n20260831;10:00:00;9.5\n20260831;11:00:00;0.5")
    got = {(r["ts"].hour, r["sensor"]): r["value"] for r in run("cp").where("sensor = '0006'").collect()}
    assert got == {(9, "0006"): 1.5, (10, "0006"): 0.2, (11, "0006"): 0.5}
    assert spark.read.parquet(rejects).count() == 1


def test_facts_written_without_a_journal_are_found_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1_20260831101500.MIS").write_text(TEXT)
    files = telemetry.read_files(spark, str(tmp_path / "in"))
    for k in range(2):  # the journal of the first run is lost
        telemetry.store(files, str(tmp_path / "facts"), str(tmp_path / f"journal{k}"))
    assert spark.read.parquet(str(tmp_path / "facts")).count() == 3


def test_readings_of_one_second_are_written_by_value(spark, tmp_path):
    m = spark.createDataFrame([("S1", "10", v, "0") for v in (100.5, 20.25, None, 3.0)], "station string, sensor string, value double, code string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    files = telemetry.telemetry_lines(m).select(F.lit("a").alias("path"), F.lit("a").alias("name"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("digest"), "text")
    assert [r["value"] for r in telemetry.parse_telemetry(files).orderBy("line").collect()] == [None, 3.0, 20.25, 100.5]
    telemetry.store(files, str(tmp_path / "facts"), str(tmp_path / "journal"))
    assert [r["value"] for r in schemas.read_facts(spark, str(tmp_path / "facts")).collect()] == [3.0]  # as text, 100.5 came first
