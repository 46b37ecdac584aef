"""Sharding by histogram sort: exact byte counts below candidate boundaries, then one exchange.

Rows are ordered by a group hash and, within a group, by a tie key. Each round counts, exactly and
across all partitions, the bytes below a few hundred candidate boundaries (probes); only those sums
reach the driver. A splitter is settled when the bytes below one of its probes lie within the
tolerance of its target; else its probes are refined between the two that enclose the target. While
two group hashes remain between them, probes lie between groups, so a group is cut only where
keeping it whole would break the tolerance.

Slots are numbered in parts of a shard. Their boundaries are found by the same search over row
counts, so that a hot group is cut into even parts as well; a row's part is a binary search among
the boundaries, which are 16 bytes each.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.llm.words import fresh
from gaugewright.session import checkpointed

LOW, HALF, WIDE = 0, 1 << 63, 1 << 64
#: Rows of one shard that are sorted and numbered in one task, about.
PART_ROWS = 2_000_000

Histogram = list[tuple[int, int, int | None, int | None]]  # bytes, rows, least and greatest key of each interval


def _join(h: int, i: int) -> int:
    return ((h + HALF) << 64) | (i + HALF)


def _split(key: int) -> tuple[int, int]:
    return (key >> 64) - HALF, (key & (WIDE - 1)) - HALF


def _histogram(keys: DataFrame, probes: list[int]) -> Histogram:
    """Counts of the intervals that sorted probes cut the keys into; a key equal to a probe lies above it."""
    pairs = [_split(min(p, (1 << 128) - 1)) for p in probes]
    heads, ties = np.array([p[0] for p in pairs], dtype=np.int64), np.array([p[1] for p in pairs], dtype=np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h, i, size = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("_h", "_i", "_size"))
            order = np.lexsort((i, h))
            h, i, below = h[order], i[order], np.concatenate(([0], np.cumsum(size[order])))
            left, right = np.searchsorted(h, heads, "left"), np.searchsorted(h, heads, "right")
            cuts = [int(a + np.searchsorted(i[a:b], t, "left")) for a, b, t in zip(left.tolist(), right.tolist(), ties.tolist(), strict=True)]
            cuts = np.array([0, *cuts, len(h)])
            full = np.flatnonzero(np.diff(cuts))
            a, b = cuts[full], cuts[full + 1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (full.astype(np.int64), below[b] - below[a], b - a, h[a], i[a], h[b - 1], i[b - 1])], names=["k", "bytes", "rows", "h0", "i0", "h1", "i1"])

    parts = keys.mapInArrow(count, "k long, bytes long, rows long, h0 long, i0 long, h1 long, i1 long")
    sums = parts.groupBy("k").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min(F.struct("h0", "i0")).alias("a"), F.max(F.struct("h1", "i1")).alias("b"))
    out: Histogram = [(0, 0, None, None)] * (len(probes) + 1)
    for r in sums.collect():  # one row per probe at most
        out[r["k"]] = (r["bytes"], r["rows"], _join(*r["a"]), _join(*r["b"]))
    return out


def find_splitters(keys: DataFrame, shards: int, tolerance: float, probes: int = 32, max_rounds: int = 128) -> list[int]:
    """Shards - 1 boundaries (ascending 128-bit keys) for rows _h, _i, _size of equal total size, within tolerance of a shard.

    Every round narrows each open boundary's range of keys by the number of probes, so that even one
    probe settles in 128 rounds; a search that doesn't is an error.
    """
    everything = _histogram(keys, [])[0]
    total = everything[0]
    if not everything[1]:
        return [0] * (shards - 1)
    targets = [total * s // shards for s in range(1, shards)]
    slack = tolerance * total / shards
    # of each target: key and bytes below, of the nearest boundary at or under it and of the nearest over it
    brackets = [((everything[2], 0), (everything[3] + 1, total)) for _ in targets]
    done: dict[int, int] = {}
    for _ in range(max_rounds):
        wanted: set[int] = set()
        for s, ((lo, below), (hi, above)) in enumerate(brackets):
            if s in done:
                continue
            key, miss = min(((lo, targets[s] - below), (hi, above - targets[s])), key=lambda x: x[1])
            if miss <= slack or hi - lo <= 1:
                done[s] = key
            elif (hi - 1) >> 64 > lo >> 64:  # more than one group: probe between groups
                a, b = (lo >> 64) + 1, (hi - 1) >> 64
                wanted |= {(a + (b - a) * j // max(1, probes - 1)) << 64 for j in range(min(probes, b - a + 1) if b > a else 1)} | {b << 64}
            else:
                wanted |= {lo + (hi - lo) * j // (probes + 1) for j in range(1, probes + 1)} - {lo}
        if not wanted:
            break
        edges = sorted(wanted)
        counts = _histogram(keys, edges)
        below, sums = 0, []
        for n, _, _, _ in counts[:-1]:
            below += n
            sums.append(below)
        for s, target in enumerate(targets):
            if s in done:
                continue
            (lo, lo_n), (hi, hi_n) = brackets[s]
            j = bisect_right(sums, target)  # sums[j - 1] <= target < sums[j]
            if j and edges[j - 1] > lo:
                lo, lo_n = edges[j - 1], sums[j - 1]
            if j < len(edges) and edges[j] < hi:
                hi, hi_n = edges[j], sums[j]
            first, last = counts[j][2], counts[j][3]
            if lo == (edges[j - 1] if j else None) and first is not None and hi == (edges[j] if j < len(edges) else None):
                lo, hi = max(lo, first), min(hi, last + 1)  # no row lies between these and the probes
            brackets[s] = (lo, lo_n), (hi, hi_n)
    else:
        raise RuntimeError(f"boundaries did not settle in {max_rounds} rounds")
    return sorted(done.values())


def _placed(edges: list[int], shard_of: list[int], first: list[int]) -> Callable[[Column, Column], Column]:
    """A row's part among boundaries, with the part's shard and first slot, by a binary search in the task."""
    pairs = [_split(min(e, (1 << 128) - 1)) for e in edges]
    heads, ties = np.array([x[0] for x in pairs], dtype=np.int64), np.array([x[1] for x in pairs], dtype=np.int64)
    shards, firsts = np.array(shard_of, dtype=np.int32), np.array(first, dtype=np.int64)

    @F.pandas_udf("part int, shard int, first long")
    def place(h: pd.Series, i: pd.Series) -> pd.DataFrame:
        own, tie = h.to_numpy(), i.to_numpy()
        part = np.searchsorted(heads, own, "left")
        open_ = np.flatnonzero((part < len(heads)) & (heads[np.minimum(part, len(heads) - 1)] == own)) if len(heads) else part[:0]
        for head in np.unique(own[open_]):  # groups that a boundary cuts
            rows = open_[own[open_] == head]
            a, b = np.searchsorted(heads, head, "left"), np.searchsorted(heads, head, "right")
            part[rows] = a + np.searchsorted(ties[a:b], tie[rows], "right")
        return pd.DataFrame({"part": part.astype(np.int32), "shard": shards[part], "first": firsts[part]})

    return place


def shard(df: DataFrame, size: Column, group: Column, tie: Column, shards: int = 24, tolerance: float = 0.002, probes: int = 32) -> DataFrame:
    """All rows and columns of df with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in a shard).

    Shards' total sizes differ from an equal share by the tolerance (a part of a share) and what
    one indivisible row weighs. ``group`` is a 64-bit hash of what is to stay together, ``tie`` a
    long that orders a group's rows; ``size`` a non-negative long. Null size counts as 0, null group
    or tie as the smallest. Rows equal in group and tie share a shard unless they are too many for
    that; then rows are written once with an ordinal, whose hash takes the place of the tie, and cut
    by it. An empty table gives no rows; columns of df named shard or slot are replaced, all others
    may have any name.
    """
    h, i, s, p = fresh("h", "i", "size", "p")
    own = df.drop("shard", "slot").withColumns({h: F.coalesce(group.cast("long"), F.lit(-HALF)), i: F.coalesce(tie.cast("long"), F.lit(-HALF)), s: F.coalesce(size.cast("long"), F.lit(0))})

    def search(rows: DataFrame) -> tuple[list[int], list[int], Histogram, bool]:
        """Splitters, all boundaries, the counts between these, and whether rows of one key weigh on a boundary."""
        keys = checkpointed(rows.select(F.col(h).alias("_h"), F.col(i).alias("_i"), F.col(s).alias("_size")))
        splitters = find_splitters(keys, shards, tolerance, probes)
        edges, parts = set(splitters), -(-keys.count() // PART_ROWS)
        if parts > 1:
            edges |= set(find_splitters(keys.withColumn("_size", F.lit(1).cast("long")), parts, 0.25, 4))
        edges = sorted(edges)
        # the one key on either side of each boundary is counted by itself
        fine = sorted({e + d for e in edges for d in (-1, 0, 1) if 0 <= e + d < WIDE * WIDE})
        counts = _histogram(keys, fine)
        share = sum(c[0] for c in counts) / shards
        alone = [counts[k + 1] for k in range(len(fine) - 1) if fine[k + 1] - fine[k] == 1]
        heavy = any(n > 1 and (size > tolerance * share or n > PART_ROWS // 4) for size, n, _, _ in alone)
        merged: Histogram = []
        for k, c in enumerate(counts):
            if not k or fine[k - 1] in edges:
                merged.append(c)
            else:
                merged[-1] = (merged[-1][0] + c[0], merged[-1][1] + c[1], None, None)
        return splitters, edges, merged, heavy

    splitters, edges, counts, heavy = search(own)
    if heavy:
        own = checkpointed(own.withColumn(i, F.xxhash64(i, F.monotonically_increasing_id())))
        splitters, edges, counts, _ = search(own)
    shard_of, first, seen = [], [], 0
    for k, (_, rows, _, _) in enumerate(counts):
        if k and edges[k - 1] in splitters:
            seen = 0
        shard_of.append(bisect_right(splitters, edges[k - 1]) if k else 0)
        first.append(seen)
        seen += rows
    numbered = own.withColumn(p, _placed(edges, shard_of, first)(F.col(h), F.col(i)))
    order = Window.partitionBy(f"{p}.part").orderBy(h, i, s)
    numbered = numbered.withColumns({"shard": F.col(f"{p}.shard"), "slot": F.row_number().over(order) - 1 + F.col(f"{p}.first")})
    return numbered.drop(h, i, s, p)
