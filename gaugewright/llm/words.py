"""Words, lines and shingles of Arrow text batches, found with numpy on the UTF-8 bytes.

All functions work on one batch inside a task. A null text counts as an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text handled at a time, so that temporaries stay near 20 times this (a longer text goes alone).
CHUNK_BYTES = 1 << 20

#: Bytes of an Arrow batch that goes to a Python worker, about (a longer row goes alone).
BATCH_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64: a bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """n fixed pseudo-random 64-bit integers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 20)) * np.uint64(0x9E3779B97F4A7C15))


ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Everything in ASCII but digits and letters.
ASCII_NOT_ALNUM = np.array([c < 128 and not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122) for c in range(256)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one after the other, and the offset of each row (and the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows (from, to, bytes, offsets) of about ``limit`` bytes."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, to, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def fresh(*names: str) -> list[str]:
    """Names for helper columns that no caller's column has."""
    mark = uuid.uuid4().hex[:12]
    return [f"_{name}_{mark}" for name in names]


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches of bounded bytes, so that what a task holds doesn't grow with the length of its texts.

    The bound is a setting of the session; one that the session already has stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(work, schema)


def map_chunks(work: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch], text: str = "text"):
    """A function for mapInArrow that applies ``work`` to slices of each batch with the text's bytes and offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                data, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
                for a, b, part, starts in chunks(data, offsets):
                    yield work(batch.slice(a, b - a), part, starts)

    return run


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that are no separators and lie in one row.

    Returns their starts, their ends and, for each row and the end, the index of its first run.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def byte_words(data: np.ndarray) -> np.ndarray:
    """A view of the bytes: at each place the little-endian number of the eight bytes from there on, zeros after the end."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


#: Keeps the first k bytes of a little-endian number.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; with fold_case, A-Z count as a-z.

    A span's length and its bytes, eight at a time, go through two chains of bijections that are
    joined at the end. Every byte changes both chains by a permutation of all their bits, so that no
    pattern of bytes cancels out; two different spans agree with a chance of about 2**-64.
    """
    at = byte_words(LOWER[data] if fold_case else data)
    left = (ends - starts).astype(np.int64)
    one, two = mix(left.astype(np.uint64) + np.uint64(0x243F6A8885A308D3)), mix(~left.astype(np.uint64))
    live, place = np.flatnonzero(left > 0), np.asarray(starts, dtype=np.int64)
    everyone = len(live) == len(left)
    while len(live):
        word = (at[place] if everyone else at[place[live]]) & FIRST_BYTES[np.minimum(left if everyone else left[live], 8)]
        a, b = (one, two) if everyone else (one[live], two[live])
        a, b = mix(a ^ word), mix((b + word) * np.uint64(0x9E3779B97F4A7C15) ^ (a >> np.uint64(32)))
        if everyone:
            one, two = a, b
        else:
            one[live], two[live] = a, b
        place, left = place + 8, left - 8
        live = live[left[live] > 0]
        everyone = False
    return mix(one + (two << np.uint64(32) | two >> np.uint64(32)))


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a row, and each row's first run (and the end).

    A row of fewer words, but not none, has one run: the whole row.
    """
    counts = np.diff(first)
    runs = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.concatenate(([0], np.cumsum(runs)))
    weights = seeds(k, salt=11)
    out = np.zeros(begin[-1], dtype=np.uint64)
    if len(words) >= k:
        rolled = np.zeros(len(words) - k + 1, dtype=np.uint64)
        for j in range(k):
            rolled += words[j : len(words) - k + 1 + j] * weights[j]
        row = np.repeat(np.arange(len(counts)), counts)
        whole = row[: len(rolled)] == row[k - 1 :]
        to = np.repeat(counts >= k, runs)
        out[to] = mix(rolled[whole])
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = words[first[i] : first[i + 1]]
        out[begin[i]] = mix((own * weights[: len(own)]).sum(keepdims=True) + np.uint64(len(own)))[0]
    return out, begin


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    values = np.sort(values)
    new = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def unique_runs(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each row, and each row's first (and the end)."""
    parts = [distinct(values[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))


def list_column(values: np.ndarray, begin: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column of the rows' values."""
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values, type=kind))


def binary_column(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """A binary column: each row's values as their bytes."""
    data = np.ascontiguousarray(values)
    offsets = begin.astype(np.int64) * data.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())
