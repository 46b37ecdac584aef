"""Rivers as forests: pointer jumping and intervals against brute force, long chains, hot junctions, cycles; doubled paths on any graph."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gaugewright.operators import forest, graph

EDGES = "src string, dst string, length double, obstacle string"


def tree(rng, n, reach):
    return [(f"n{i}", f"n{rng.randrange(max(0, i - reach), i)}", float(rng.randrange(1, 9)), None) for i in range(1, n) if rng.random() > 0.02]


def ways(edges):
    """Each node's downstream: node -> (length, hops)."""
    down = {a: (b, w) for a, b, w, _ in edges}
    out = {}
    for a in {x for e in edges for x in e[:2]}:
        at, length, hops, seen = a, 0.0, 0, {}
        while at in down:
            at, length, hops = down[at][0], length + down[at][1], hops + 1
            seen[at] = (length, hops)
        out[a] = seen
    return out


@pytest.mark.parametrize(("n", "reach"), [(120, 3), (150, 150), (60, 1)])
def test_index_against_brute_force(spark, n, reach):
    rng = random.Random(n)
    edges = tree(rng, n, reach)
    want = ways(edges)
    index = forest.forest_index(spark.createDataFrame(edges, EDGES).repartition(3))
    rows = {r["node"]: r for r in index.collect()}
    assert rows.keys() == want.keys()
    for node, seen in want.items():
        r = rows[node]
        assert r["depth"] == len(seen) and r["length"] == max((x for x, _ in seen.values()), default=0.0)
        assert r["size"] == r["weight"] == 1 + sum(node in s for s in want.values())
        assert r["root"] == max(seen, key=lambda x: seen[x][1], default=node)
    for root in {r["root"] for r in rows.values()}:  # every entry of a river is taken once
        own = [r for r in rows.values() if r["root"] == root]
        assert sorted(r["entry"] for r in own) == list(range(len(own)))
    pairs = [(a, b) for a in want for b in want] + [("n1", "elsewhere"), ("elsewhere", "elsewhere")]
    for r in forest.leads_to(spark.createDataFrame(pairs, "a string, b string"), index).collect():
        found = want.get(r["a"], {}).get(r["b"])
        assert r["leads"] == (found is not None) and (r["length"], r["hops"]) == (found or (None, None))
    node = max(want, key=lambda x: sum(x in s for s in want.values()))
    assert [(r["node"], r["length"], r["hops"]) for r in forest.upstream_of(index, node).collect()] == sorted(((a, *s[node]) for a, s in want.items() if node in s), key=lambda x: (x[1], x[0]))
    leaf = max(want, key=lambda x: len(want[x]))
    assert [(r["node"], r["length"], r["hops"]) for r in forest.downstream_of(index, leaf).collect()] == sorted(((b, *w) for b, w in want[leaf].items()), key=lambda x: (x[1], x[0]))


def test_a_long_chain_settles_in_few_rounds(spark, monkeypatch):
    n = 100_000
    rounds = []
    plain = forest.stored
    monkeypatch.setattr(forest, "stored", lambda *a: (rounds.append(1), plain(*a))[1])
    chain = spark.range(1, n + 1).select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"), F.lit(1.0).alias("length"))
    index = forest.forest_index(chain)
    assert len(rounds) < 2 * 20  # two runs of pointers, of less than 20 rounds each
    assert index.where("depth = node and length = node and size = 100000 - node + 1 and entry = node and root = 0").count() == n + 1


def test_a_hot_junction(spark):
    star = spark.range(1, 5001).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(2.0).alias("length"))
    index = forest.forest_index(star)
    assert index.where("parent = 0").agg(F.count_distinct("entry"), F.min("entry"), F.max("entry")).first()[0:3] == (5000, 1, 5000)
    counts = forest.upstream_counts(star, star.select(F.concat(F.lit("s"), "src").alias("station"), F.col("src").alias("node")).unionByName(spark.createDataFrame([("r", 0), ("r2", 0)], "station string, node long")))
    assert {(r["down"], r["n_up"]) for r in counts.collect()} == {("r", 5000), ("r2", 5000)}


def test_what_is_no_forest(spark):
    for edges in ([("a", "b"), ("b", "c"), ("c", "a")], [("a", "b"), ("a", "c")], [("a", "a")], [("a", "b"), ("b", "a"), ("x", "y")]):
        with pytest.raises(forest.NotAForest):
            forest.forest_index(spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src string, dst string, length double"))
    assert forest.forest_index(spark.createDataFrame([], "src string, dst string, length double")).count() == 0


def test_upstream_counts_of_any_graph(spark):
    """A river that parts and meets again is counted by its paths."""
    edges = spark.createDataFrame([("a", "b", 1.0, None), ("a", "c", 1.0, None), ("b", "d", 1.0, None), ("c", "d", 1.0, None)], EDGES)
    stations = spark.createDataFrame([(x, x) for x in "abcd"], "station string, node string")
    assert {r["down"]: r["n_up"] for r in graph.upstream_count(edges, stations).collect()} == {"b": 1, "c": 1, "d": 3}
    assert {r["down"]: r["n_up"] for r in graph.upstream_count(edges.where("dst <> 'c'"), stations).collect()} == {"b": 1, "d": 3}


@pytest.mark.parametrize("seed", range(3))
def test_doubled_paths_against_brute_force(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(14)]
    edges = {(a, b): float(rng.choice([1, 2, 4, 8.5])) for a, b in ((rng.choice(nodes), rng.choice(nodes)) for _ in range(26))}
    dist = {(a, b): (w, 1) for (a, b), w in edges.items() if a != b}
    for k in nodes:
        for a in nodes:
            for b in nodes:
                if a != b and (a, k) in dist and (k, b) in dist:
                    way = tuple(x + y for x, y in zip(dist[a, k], dist[k, b], strict=True))
                    dist[a, b] = min(dist.get((a, b), way), way)
    df = spark.createDataFrame([(a, b, w, None) for (a, b), w in edges.items()], EDGES)
    got = {(r["src"], r["dst"]): (r["length"], r["hops"]) for r in graph.reachable(df).collect()}
    assert got == dist
    starts = spark.createDataFrame([(x,) for x in nodes[:3]], "node string")
    assert {(r["src"], r["dst"]): (r["length"], r["hops"]) for r in graph.reachable(df, starts).collect()} == {k: v for k, v in dist.items() if k[0] in nodes[:3]}


def brute_repair(edges, gaps, candidates):
    """Gaps in order; a candidate is refused if its end leads back to the stop by edges or connectors made."""
    made, out = [], {}
    for num, stop in gaps:
        out[num] = "no_candidate" if not candidates[num] else "cycle"
        for _, seg, dst in sorted(candidates[num]):
            seen, open_ = set(), [dst]
            while open_:
                at = open_.pop()
                if at not in seen:
                    seen.add(at)
                    open_ += [b for a, b in [*edges, *made] if a == at]
            if stop not in seen and (stop, dst) not in made:
                made.append((stop, dst))
                out[num] = seg
                break
    return out


@pytest.mark.parametrize(("seed", "split"), [(1, False), (2, False), (3, True), (4, True)])
def test_repairs_against_brute_force(spark, seed, split):
    """Short pieces of river in a field, gaps at their ends; with ``split`` some node flows two ways."""
    rng = random.Random(seed)
    rivers = []
    for i in range(14):
        x, y = rng.randrange(0, 3000), rng.randrange(0, 3000)
        rivers.append((i, rng.choice(["A", "B", None]), (x, y), (x + rng.randrange(-600, 600), y + rng.randrange(-600, 600))))
    if split:
        i, name, a, _ = rivers[0]
        rivers.append((99, name, a, (a[0] + 333, a[1] + 77)))
    key = lambda p: f"{p[0]}_{p[1]}"
    point = lambda p: {"x": float(p[0]), "y": float(p[1])}
    seg = spark.createDataFrame([(i, n, [point(a), point(b)]) for i, n, a, b in rivers], "seg_id long, name string, coords array<struct<x:double,y:double>>")
    edges = graph.build_edges(seg)
    nodes = spark.createDataFrame(sorted({(key(p), float(p[0]), float(p[1])) for _, _, *ends in rivers for p in ends}), "node string, x double, y double")
    gaps = [(k, n, b) for k, (_, n, _, b) in enumerate(rivers[:12])]
    got = graph.repair_gaps(edges, edges.select("seg_id", "name", "coords", "dst"), nodes, spark.createDataFrame([(k, n, *map(float, b)) for k, n, b in gaps], "num long, name string, x double, y double"), same_name_m=900.0, other_m=700.0)

    def far(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = min(1.0, max(0.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / ((dx * dx + dy * dy) or 1)))
        return ((p[0] - a[0] - t * dx) ** 2 + (p[1] - a[1] - t * dy) ** 2) ** 0.5

    flows = [(key(a), key(b)) for _, _, a, b in rivers]
    candidates = {}
    for k, name, p in gaps:
        near = [(far(p, a, b), i, key(b), n == name and name is not None) for i, n, a, b in rivers if 1.0 < far(p, a, b) and key(b) != key(p)]
        same = [c[:3] for c in near if c[3] and c[0] <= 900]
        candidates[k] = [c for c in (same or [c[:3] for c in near if not c[3] and c[0] <= 700]) if (key(p), c[2]) not in flows]
    want = brute_repair(flows, [(k, key(p)) for k, _, p in gaps], candidates)
    assert {r["num"]: r["seg_id"] if r["reason"] is None else r["reason"] for r in got.collect()} == want


def test_segments_of_any_length_and_slope_against_brute_force(spark):
    rng = random.Random(11)
    lines = [(k, [(rng.uniform(0, 3000), rng.uniform(0, 3000)) for _ in range(rng.choice([2, 2, 4]))]) for k in range(120)] + [(200, [(5.0, 5.0), (5.0, 5.0)]), (201, [(100.0, 0.0), (100.0, 2000.0)]), (202, [(0.0, 700.0), (3000.0, 700.0)])]
    points = [(str(k), rng.uniform(-50, 3050), rng.uniform(-50, 3050)) for k in range(150)] + [("end", 5.0, 8.0)]

    def far(path, x, y):
        best = math.inf
        for (ax, ay), (bx, by) in zip(path, path[1:]):  # noqa: B905
            dx, dy = bx - ax, by - ay
            t = min(1.0, max(0.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            best = min(best, math.hypot(x - ax - t * dx, y - ay - t * dy))
        return best

    segments = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in p], "n") for k, p in lines], "seg_id long, coords array<struct<x:double,y:double>>, dst string")
    nodes = spark.createDataFrame(points, "station string, x double, y double")
    for reach in (7.0, 60.0, 5000.0):
        got = {(r["station"], r["seg_id"]) for r in graph.segments_near(nodes, segments, reach).select("station", "seg_id").collect()}
        assert got == {(n, k) for n, x, y in points for k, p in lines if far(p, x, y) <= reach}, reach


def test_long_slanting_segments_cost_no_plane_of_cells(spark):
    # 60 lines of 5,000 km: their boxes have 10**13 cells of a metre
    segments = spark.range(60).select(F.col("id").alias("seg_id"), F.array(F.struct(F.lit(0.0).alias("x"), (F.col("id") * 10.0).alias("y")), F.struct(F.lit(5e6).alias("x"), (F.col("id") * 10.0 + 5000.0).alias("y"))).alias("coords"), F.lit("n").alias("dst"))
    dams = spark.createDataFrame([("a", 1e6, 1000.4), ("b", 4e6, 4029.9), ("c", 4e6, 9000.0)], "station string, x double, y double")
    assert {(r["station"], r["seg_id"]) for r in graph.snap_stations(dams, segments, 1.0).collect()} == {("a", 0), ("b", 3), ("c", None)}


def test_more_gaps_than_ten_thousand(spark):
    # each gap lies beside a line of its own
    n = F.col("id")
    at = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    segments = spark.range(10_400).select(n.alias("seg_id"), F.lit("r").alias("name"), F.array(at(100, n * 1000), at(200, n * 1000)).alias("coords"), F.format_string("d%d", n).alias("dst"))
    edges = spark.range(10_400).select(F.format_string("u%d", n).alias("src"), F.format_string("d%d", n).alias("dst"))
    nodes = spark.range(10_400).select(F.concat(F.lit("0_"), (n * 1000).cast("string")).alias("node"), F.lit(0.0).alias("x"), (n * 1000.0).alias("y"))
    gaps = nodes.select((F.col("y") / 1000).cast("long").alias("num"), F.lit("r").alias("name"), "x", "y")
    got = graph.repair_gaps(edges, segments, nodes, gaps, same_name_m=300.0)
    assert got.where("reason is null and dst = 'd' || num and length = 200").count() == 10_400


def test_a_gap_asks_for_candidates_beyond_the_first(spark):
    # the nearest 80 lines all lead back to the gap, the next doesn't
    segments = spark.range(82).select(F.col("id").alias("seg_id"), F.lit("r").alias("name"), F.array(F.struct((F.col("id") + 2.0).alias("x"), F.lit(0.0).alias("y")), F.struct((F.col("id") + 2.0).alias("x"), F.lit(9.0).alias("y"))).alias("coords"), F.format_string("d%02d", "id").alias("dst"))
    edges = spark.range(80).select(F.format_string("d%02d", "id").alias("src"), F.lit("0_0").alias("dst"))
    nodes = spark.createDataFrame([("0_0", 0.0, 0.0)], "node string, x double, y double")
    gaps = spark.createDataFrame([(1, "r", 0.0, 0.0)], "num long, name string, x double, y double")
    assert [(r["dst"], r["reason"]) for r in graph.repair_gaps(edges, segments, nodes, gaps, same_name_m=500.0).collect()] == [("d80", None)]
    assert [r["reason"] for r in graph.repair_gaps(edges, segments.where("seg_id < 80"), nodes, gaps, same_name_m=500.0).collect()] == ["cycle"]
