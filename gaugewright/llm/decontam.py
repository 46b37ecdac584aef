"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows.

Words are runs of ASCII digits and letters (case folded) and of any other non-ASCII characters. The
texts are normalised to words between single spaces, byte by byte, and scanned once; the matches'
positions are counted back to words and, for the documents that have any, to the original text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.llm.words import ASCII_NOT_ALNUM, chunks, map_batches, spans, text_buffer

#: Benchmark text that one automaton may hold; a larger benchmark is scanned for in parts.
AUTOMATON_BYTES = 4 << 20

#: Bytes of rows that a task holds while it scans them for a benchmark's parts, about.
HELD_BYTES = 32 << 20

#: Items (item_id and text) of one automaton.
Part = list[tuple[int | None, str]]

_FOLD = bytes(32 if ASCII_NOT_ALNUM[c] else c + 32 if 65 <= c <= 90 else c for c in range(256))

SCHEMA = "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<start:int,end:int>>"


def normalise(text: bytes) -> bytes:
    """Words between single spaces, with a space at either end."""
    return b" " + b" ".join(text.translate(_FOLD).split()) + b" "


def windows(text: str | None, size: int) -> list[bytes]:
    """The windows of one item: all runs of ``size`` words, or all its words if fewer."""
    words = (text or "").encode().translate(_FOLD).split()
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))]


def _patterns(items: Part, size: int) -> dict[str, list[int]]:
    """The windows of some items, each with the sorted ids of its items; those without an id give windows alone."""
    patterns: dict[str, set[int]] = {}
    for item, text in items:
        for w in windows(text, size):
            ids = patterns.setdefault(w.decode("latin-1"), set())
            if item is not None:
                ids.add(item)
    return {w: sorted(ids) for w, ids in sorted(patterns.items())}


_automata: dict[str, object] = {}


def _automaton(items: Part, size: int):
    """This process's automaton for some items, None if they have no words; only the last is remembered."""
    digest = hashlib.sha256(repr((size, items)).encode()).hexdigest()
    if digest not in _automata:
        import ahocorasick

        _automata.clear()
        patterns = _patterns(items, size)
        tool = ahocorasick.Automaton() if patterns else None
        for pattern, ids in patterns.items():
            tool.add_word(pattern, (len(pattern), ids))
        if tool:
            tool.make_automaton()
        _automata[digest] = tool
    return _automata[digest]


def _groups(batches: Iterator[pa.RecordBatch], parts: list[Part]) -> Iterator[list[pa.RecordBatch]]:
    """Batches to scan together: each alone for one part, about HELD_BYTES for several, so that automata are built seldom."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if len(parts) == 1 or size >= HELD_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    """The number and the bytes of each text of a batch."""
    data, offsets = text_buffer(batch.column("text"))
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        yield i, data[a:b].tobytes()


def _scan(parts: list[Part], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, parts):
            found: dict[tuple[int, int], list] = {}
            for part in parts:
                tool = _automaton(part, window)
                for k, batch in enumerate(group if tool else []):
                    for i, own in _texts(batch):
                        if hits := list(tool.iter(normalise(own).decode("latin-1"))):
                            found.setdefault((k, i), []).extend(hits)
                tool = None  # the next part's takes its place
            for k, batch in enumerate(group):
                yield from _rows(batch, {i: hits for (g, i), hits in found.items() if g == k})

    return run


def _rows(batch: pa.RecordBatch, found: dict[int, list]) -> Iterator[pa.RecordBatch]:
    """A row for each of a batch's texts, with the matches found in it."""
    data, offsets = text_buffer(batch.column("text"))
    for a, b, part, begin in chunks(data, offsets):
        n_words = np.diff(spans(part, begin, ASCII_NOT_ALNUM)[2])
        hits, items, places = np.zeros(b - a, dtype=np.int64), [[]] * (b - a), [[]] * (b - a)
        for i in range(b - a):
            if own := found.get(a + i):
                original = part[begin[i] : begin[i + 1]].tobytes()
                items[i] = sorted({x for _, (_, ids) in own for x in ids})
                hits[i], places[i] = _covered(original, normalise(original).decode("latin-1"), own)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").slice(a, b - a), pa.array(n_words), pa.array(hits), pa.array(items, type=pa.list_(pa.int64())), pa.array(places, type=pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
            names=["doc_id", "n_words", "n_hit", "items", "spans"],
        )


def _covered(original: bytes, text: str, found: list) -> tuple[int, list[dict]]:
    """Words under any match, and the stretches of the original's characters from the first to the last word of such runs."""
    gaps = np.flatnonzero(np.frombuffer(text.encode("latin-1"), dtype=np.uint8) == 32).tolist()  # word w lies after gap w
    runs: list[list[int]] = []
    for a, b in sorted((bisect_left(gaps, end - length + 1), bisect_right(gaps, end - 1)) for end, (length, _) in found):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    starts, ends, _ = spans(np.frombuffer(original, dtype=np.uint8), np.array([0, len(original)]), ASCII_NOT_ALNUM)
    before = np.concatenate(([0], np.cumsum((np.frombuffer(original, dtype=np.uint8) & 0xC0) != 0x80)))  # characters before each byte
    return sum(b - a for a, b in runs), [{"start": int(before[starts[a]]), "end": int(before[ends[b - 1]])} for a, b in runs]


def _parts(benchmark: DataFrame, automaton_bytes: int) -> list[Part]:
    """The benchmark's items, in parts of about ``automaton_bytes`` of text; one part at least."""
    items = benchmark.select("item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // automaton_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [[(r["item_id"], r["text"]) for r in items.where(part == k).collect()] for k in range(n)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """One row per document: n_words, n_hit (words inside any window's occurrence), items and spans.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored. ``items``
    are the sorted ids of items with occurring windows, ``spans`` the stretches of hit words in
    characters of the original text. A null or empty text has no words; an item without words
    matches nothing; items of one text are all reported; an item without an id hits words but has
    none to report. An empty benchmark hits nothing. Repeated rows get a row each.

    The benchmark's size is checked: up to ``automaton_bytes`` of its text goes into the automaton
    that every task builds. A larger one is cut by items, and a task scans the rows that it holds
    with the parts' automata in turn, one at a time; the result is the same.
    """
    return map_batches(docs.select("doc_id", "text"), _scan(_parts(benchmark, automaton_bytes), window), SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The rows of docs whose text has no occurrence of a benchmark window, with all their columns.

    A row is judged by its own text and passed on by the task that read it, so nothing is shuffled.
    A null or empty text stays; so does everything if the benchmark is empty. The benchmark's size
    is checked as in ``find_contamination``; items without an id count as any.
    """
    parts = _parts(benchmark, automaton_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, parts):
            clean = [np.ones(batch.num_rows, dtype=bool) for batch in group]
            for part in parts:
                tool = _automaton(part, window)
                for k, batch in enumerate(group if tool else []):
                    left = clean[k]
                    for i, own in _texts(batch):
                        left[i] = left[i] and next(tool.iter(normalise(own).decode("latin-1")), None) is None
                tool = None  # the next part's takes its place
            for batch, left in zip(group, clean, strict=True):
                yield batch.filter(pa.array(left))

    return map_batches(docs, run, docs.schema)
