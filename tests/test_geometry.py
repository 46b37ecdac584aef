"""Geometry columns: parts, holes, both byte orders, heights, and bytes that are none."""

import random
import struct

from pyspark.sql import functions as F

from gaugewright.operators import graph
from gaugewright.sources import geometry


def path(points, order="<"):
    return struct.pack(f"{order}I", len(points)) + b"".join(struct.pack(f"{order}{len(p)}d", *p) for p in points)


def wkb(kind, *inner, order="<", count=True, srid=None):
    head = struct.pack("<B" if order == "<" else ">B", order == "<") + struct.pack(f"{order}I", kind | (0x20000000 if srid else 0)) + (struct.pack(f"{order}I", srid) if srid else b"")
    return head + (struct.pack(f"{order}I", len(inner)) if count else b"") + b"".join(inner)


def line(points, order="<", kind=2, **more):
    return wkb(kind, path(points, order), order=order, count=False, **more)


def polygon(*rings, order="<", kind=3):
    return wkb(kind, *[path(r, order) for r in rings], order=order)


def square(x, y, d):
    return [(x, y), (x + d, y), (x + d, y + d), (x, y + d), (x, y)]


SHAPES = [
    (line([(0, 0), (3, 4)]), 2, [[(0, 0), (3, 4)]], []),
    (line([(0, 0), (3, 4)], ">", srid=32632), 2, [[(0, 0), (3, 4)]], []),
    (line([(1, 2, 9), (3, 4, 9)], kind=1002), 2, [[(1, 2), (3, 4)]], []),
    (line([(1, 2, 9), (3, 4, 9)], kind=2 | 0x80000000), 2, [[(1, 2), (3, 4)]], []),
    (line([(1, 2, 8, 9), (3, 4, 8, 9)], kind=3002), 2, [[(1, 2), (3, 4)]], []),
    (wkb(5, line([(0, 0), (1, 0)]), line([(5, 0), (6, 0), (7, 1)], ">")), 5, [[(0, 0), (1, 0)], [(5, 0), (6, 0), (7, 1)]], []),
    (polygon(square(0, 0, 9), square(3, 3, 2)), 3, [], [square(0, 0, 9), square(3, 3, 2)]),
    (wkb(6, polygon(square(0, 0, 1)), polygon(square(5, 5, 1), order=">")), 6, [], [square(0, 0, 1), square(5, 5, 1)]),
    (wkb(7, line([(0, 0), (1, 1)]), polygon(square(0, 0, 1))), 7, [[(0, 0), (1, 1)]], [square(0, 0, 1)]),
    (wkb(1, struct.pack("<2d", 4, 5), count=False), 1, [[(4, 5)]], []),
    (wkb(1, struct.pack("<2d", float("nan"), float("nan")), count=False), 1, [], []),
    (wkb(2, count=True), 2, [], []),
    (None, None, [], []),
    (b"", None, [], []),
]
BROKEN = [b"\x01", line([(0, 0), (3, 4)])[:-1], line([(0, 0), (3, 4)]) + b"x", wkb(17), wkb(5, wkb(99))]


def test_shapes_of_every_kind(spark):
    rows = [(k, s[0], "clash") for k, s in enumerate(SHAPES)] + [(100 + k, b, "clash") for k, b in enumerate(BROKEN)]
    got = {r["id"]: r for r in geometry.with_geometry(spark.createDataFrame(rows, "id int, geometry binary, shape string")).collect()}
    plain = lambda paths: [[(p["x"], p["y"]) for p in one] for one in paths]
    for k, (_, kind, lines, rings) in enumerate(SHAPES):
        assert (got[k]["shape"], plain(got[k]["lines"]), plain(got[k]["rings"]), got[k]["flaw"]) == (kind, lines, rings, None), k
    for k in range(len(BROKEN)):
        assert got[100 + k]["flaw"] and not got[100 + k]["lines"] and not got[100 + k]["rings"], k
    assert geometry.with_geometry(spark.createDataFrame([], "geometry binary")).count() == 0


def test_network_from_lines_of_several_parts(spark):
    rows = [(1, "a", line([(0, 0), (10, 0)])), (2, "b", wkb(5, line([(10, 0), (20, 0)]), line([(50, 0), (53, 4)]))), (3, "c", None), (4, "d", line([(1, 1)]))]
    segments = geometry.segments_from(spark.createDataFrame(rows, "seg_id int, name string, geometry binary"))
    assert {(r["seg_id"], r["name"], r["length"]) for r in segments.collect()} == {(1, "a", 10.0), (2, "b", 15.0)}
    assert {(r["src"], r["dst"]) for r in graph.build_edges(segments).collect()} == {("0_0", "10_0"), ("10_0", "20_0")}


def _inside(rings, x, y):
    """Winding parity by ring, each ring by itself."""
    def odd(ring):
        return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in zip(ring, ring[1:])) % 2  # noqa: B905

    return sum(odd(r) for r in rings) % 2 == 1


def test_holes_islands_and_parts(spark):
    shapes = {1: [square(0, 0, 9000), square(2000, 2000, 5000), square(3000, 3000, 1000)], 2: [square(20_000, 0, 3000)], 3: [square(20_000, 9000, 100), square(30_000, 9000, 4000)]}
    blobs = [(1, polygon(*shapes[1])), (2, polygon(*shapes[2], order=">")), (3, wkb(6, *[polygon(r) for r in shapes[3]])), (4, None), (5, b"bad")]
    rng = random.Random(2)
    points = [(str(k), rng.uniform(-500, 35_000), rng.uniform(-500, 14_000)) for k in range(1500)]
    nodes = spark.createDataFrame(points, "node string, x double, y double")
    polygons = geometry.polygons_from(spark.createDataFrame(blobs, "poly_id int, geometry binary"))
    got = {(r["node"], r["poly_id"]) for r in graph.in_polygons(nodes, polygons, 0.0, 3000.0).collect()}
    assert got == {(n, p) for n, x, y in points for p, rings in shapes.items() if _inside(rings, x, y)}
    # in the hole, but within the buffer of its border
    near = spark.createDataFrame([("deep", 4500.0, 4700.0), ("edge", 2300.0, 5000.0), ("island", 3500.0, 3500.0)], "node string, x double, y double")
    assert {r["node"] for r in graph.in_polygons(near, polygons, 500.0).collect()} == {"edge", "island"}


def test_reservoirs_with_a_hole_link_nodes(spark):
    nodes = spark.createDataFrame([("in", 100.0, 100.0), ("out", 8000.0, 8000.0), ("hole", 4500.0, 6000.0)], "node string, x double, y double")
    edges = spark.createDataFrame([("a", "in"), ("out", "b"), ("hole", "c")], "src string, dst string")
    table = spark.createDataFrame([(1, polygon(square(0, 0, 9000), square(2000, 2000, 5000)))], "poly_id int, geometry binary").select("poly_id", "geometry", F.lit("plan_eau").alias("kind"), F.lit(1).alias("rank"))
    polygons = geometry.polygons_from(table)
    assert [(r["src"], r["dst"]) for r in graph.reservoir_links(edges, nodes, polygons, 100.0).collect()] == [("in", "out")]


def test_polygons_written_and_read_again(spark):
    rows = [(1, [[square(0.0, 0.0, 9.0), square(2.0, 2.0, 5.0)]]), (2, [[square(0.0, 0.0, 9.0), square(2.0, 2.0, 5.0)], [square(20.0, 0.0, 1.0)]]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "id int, parts array<array<array<struct<x:double,y:double>>>>")
    got = {r["id"]: (r["shape"], [[tuple(q) for q in p] for p in r["rings"]]) for r in geometry.with_geometry(geometry.with_wkb(df)).collect()}
    assert got == {1: (3, rows[0][1][0]), 2: (6, rows[1][1][0] + rows[1][1][1]), 3: (6, []), 4: (None, [])}


def test_copies_of_nodes_and_polygons_are_counted_not_paired(spark):
    rings = "array(array(struct(0d as x, 0d as y), struct(900d as x, 0d as y), struct(900d as x, 900d as y), struct(0d as x, 900d as y)), array(struct(200d as x, 200d as y), struct(400d as x, 200d as y), struct(400d as x, 400d as y), struct(200d as x, 400d as y)))"
    polygons = spark.range(30_000).select(F.col("id").alias("poly_id"), F.expr(rings).alias("rings"))
    nodes = spark.range(60_000).select(F.col("id").alias("node"), F.when(F.col("id") % 2 == 0, 300.5).otherwise(100.5).alias("x"), F.lit(300.5).alias("y"))
    got = graph.count_in_polygons(nodes, polygons, 0.0)  # 900 million pairs
    assert got.agg(F.count("*"), F.min("n_nodes"), F.max("n_nodes"), F.min("first_node"), F.max("last_node")).first() == (30_000, 30_000, 30_000, 1, 59_999)
    few = polygons.where("poly_id < 3").unionByName(polygons.where("poly_id = 0"))  # a repeated id is a row of its own
    pairs = graph.in_polygons(nodes.where("node < 100"), few, 0.0).groupBy("poly_id").agg(F.count("*").alias("n"))
    assert {(r["poly_id"], r["n"]) for r in pairs.collect()} == {(0, 100), (1, 50), (2, 50)}
    assert sorted((r["poly_id"], r["n_nodes"]) for r in graph.count_in_polygons(nodes.where("node < 100"), few, 0.0).collect()) == [(0, 50), (0, 50), (1, 50), (2, 50)]
