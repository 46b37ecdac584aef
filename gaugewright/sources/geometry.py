"""Geometry columns in well-known binary: lines and polygons with all their parts, as arrays of points.

The layout is that of the OGC's simple features: a byte of byte order, a 32-bit kind, then counts and
coordinates as doubles. Kinds with heights or measures are read and their further ordinates dropped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

# The kinds of geometry.
POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = range(1, 8)

_EXTENDED_Z, _EXTENDED_M, _EXTENDED_SRID = 0x80000000, 0x40000000, 0x20000000

_POINTS = "array<struct<x:double,y:double>>"


def read_wkb(data: bytes) -> tuple[int, list[tuple[int, list[np.ndarray]]]]:
    """The kind of a geometry, and its simple parts: each the part's kind and its paths (a polygon's rings, else one)."""
    parts: list[tuple[int, list[np.ndarray]]] = []

    def read(at: int) -> tuple[int, int]:
        order = "<" if data[at] else ">"
        (code,) = struct.unpack_from(f"{order}I", data, at + 1)
        at += 5 + 4 * bool(code & _EXTENDED_SRID)
        thousands, kind = divmod(code & 0x0FFFFFFF, 1000)
        wide = 2 + (bool(code & _EXTENDED_Z) + bool(code & _EXTENDED_M) or (0, 1, 1, 2)[thousands])

        def path(at: int, n: int | None = None) -> tuple[np.ndarray, int]:
            if n is None:
                (n,) = struct.unpack_from(f"{order}I", data, at)
                at += 4
            return np.frombuffer(data, f"{order}f8", n * wide, at).reshape(n, wide)[:, :2].astype(np.float64), at + 8 * wide * n

        if kind == POINT:
            own, at = path(at, 1)
            parts.append((kind, [own[~np.isnan(own).any(axis=1)]]))
        elif kind == LINE:
            own, at = path(at)
            parts.append((kind, [own]))
        elif kind in (POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION):
            (n,) = struct.unpack_from(f"{order}I", data, at)
            at, rings = at + 4, []
            for _ in range(n):
                if kind == POLYGON:
                    own, at = path(at)
                    rings.append(own)
                else:
                    _, at = read(at)
            if kind == POLYGON:
                parts.append((kind, rings))
        else:
            raise ValueError(f"geometry of kind {kind}")
        return kind, at

    kind, end = read(0)
    if end != len(data):
        raise ValueError("bytes after a geometry")
    return kind, parts


def with_geometry(df: DataFrame, wkb: str = "geometry") -> DataFrame:
    """All columns of df, with ``shape`` (the kind of geometry), ``lines``, ``rings`` and ``flaw`` from a binary column. (SRC-07)

    ``lines`` are the paths of its points and lines, ``rings`` those of its polygons, all parts in
    order, each an array of points (x, y). Null and empty geometries have empty arrays; bytes that are
    no geometry too, with the reason in ``flaw``. Columns of df with these names are replaced.
    """
    df = df.drop("shape", "lines", "rings", "flaw")
    at, points = df.columns.index(wkb), pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    def nested(rows: list[list[np.ndarray]]) -> pa.Array:
        paths = [p for row in rows for p in row]
        flat = np.concatenate([np.zeros((0, 2)), *paths])
        each = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["x", "y"])
        inner = pa.ListArray.from_arrays(np.cumsum([0, *map(len, paths)], dtype=np.int32), each).cast(points)
        return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)], dtype=np.int32), inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, lines, rings, flaws = [], [], [], []
            for value in batch.column(at).to_pylist():
                kind, parts, flaw = None, [], None
                try:
                    kind, parts = read_wkb(value) if value else (None, [])
                except (ValueError, IndexError, struct.error) as error:
                    parts, flaw = [], str(error)
                kinds.append(kind)
                lines.append([p for k, paths in parts if k != POLYGON for p in paths if len(p)])
                rings.append([p for k, paths in parts if k == POLYGON for p in paths if len(p)])
                flaws.append(flaw)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.int32()), nested(lines), nested(rings), pa.array(flaws, pa.string())], names=[*batch.schema.names, "shape", "lines", "rings", "flaw"])

    paths = ArrayType(StructType.fromDDL(f"p {_POINTS}")["p"].dataType)
    schema = StructType([*df.schema.fields, *StructType.fromDDL("shape int").fields, StructField("lines", paths), StructField("rings", paths), StructField("flaw", StringType())])
    return df.mapInArrow(run, schema)


def write_wkb(parts: list[list[np.ndarray]]) -> bytes:
    """A polygon of its rings, or a multipolygon if there are several parts."""
    each = [struct.pack("<BII", 1, POLYGON, len(rings)) + b"".join(struct.pack("<I", len(p)) + np.ascontiguousarray(p, dtype="<f8").tobytes() for p in rings) for rings in parts]
    return each[0] if len(each) == 1 else struct.pack("<BII", 1, MULTIPOLYGON, len(each)) + b"".join(each)


def with_wkb(df: DataFrame, parts: str = "parts", wkb: str = "geometry") -> DataFrame:
    """All columns of df but ``parts`` (an array of parts, each an array of closed rings), with the polygon in binary; null stays null."""
    kept = [c for c in df.columns if c not in (parts, wkb)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(parts).to_pylist()
            blobs = [None if row is None else write_wkb([[np.array([(q["x"], q["y"]) for q in ring]).reshape(-1, 2) for ring in rings] for rings in row]) for row in rows]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(blobs, pa.binary())], names=[*kept, wkb])

    return df.select(*kept, parts).mapInArrow(run, StructType([*df.select(*kept).schema.fields, StructField(wkb, BinaryType())]))


def segments_from(df: DataFrame, wkb: str = "geometry") -> DataFrame:
    """Segments of a line table: its columns with ``coords``, the path by whose ends the network is built, and ``length``. (SRC-07, GR-02)

    Of a line with several parts the ends are those of the first; the length is that of all parts.
    Rows without a line of two points or more go.
    """
    path_length = lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(0.0), lambda n, i: n + F.hypot(F.get(p, i)["x"] - F.get(p, i - 1)["x"], F.get(p, i)["y"] - F.get(p, i - 1)["y"]))
    whole = with_geometry(df.drop("coords", "length"), wkb).withColumn("lines", F.filter("lines", lambda p: F.size(p) > 1)).where(F.size("lines") > 0)
    return whole.select(*[c for c in df.columns if c not in (wkb, "coords", "length", "shape", "lines", "rings", "flaw")], F.get("lines", F.lit(0)).alias("coords"), F.aggregate("lines", F.lit(0.0), lambda n, p: n + path_length(p)).alias("length"))


def polygons_from(df: DataFrame, wkb: str = "geometry") -> DataFrame:
    """Polygons of a table: its columns with ``rings``, those of all parts and holes, as ``in_polygons`` takes them. (SRC-07, GR-05)"""
    return with_geometry(df, wkb).where(F.size("rings") > 0).drop(wkb, "shape", "lines", "flaw")
