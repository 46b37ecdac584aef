"""Packing: Karmarkar-Karp multiway differencing of token pieces into near-equal windows.

Each document's ids are cut at the window length; whole windows stand alone. What is left over is
cut again into pieces of at most ``piece`` ids. Each task gathers such pieces until they fill
``group`` windows, or are ``GROUP_PIECES``, and then splits them by multiway differencing: every piece begins as a partial
partition, and the two partial partitions of the largest imbalance are merged, the fullest window of
one with the emptiest of the other, until one is left. If any of its windows exceeds the capacity,
the window count rises by one and the group is split anew. Nothing is shuffled, and a task holds one
group at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gaugewright.llm.tokens import encoder, with_end
from gaugewright.llm.words import CHUNK_BYTES, map_batches

#: Pieces of one group at most, so that very short documents don't make its differencing long.
GROUP_PIECES = 32_768

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def difference(weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Splits weights into k windows by multiway differencing.

    A partial partition holds only its windows that differ from its emptiest one, as their loads above
    that one's and the bundles of weights in them, so that all of them together never hold more than
    one load a weight. Returns each weight's window and the windows' sums. Ties go to the earlier
    partial partition.
    """
    n = len(weights)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(k, dtype=np.int64)
    none = np.zeros(0, dtype=np.int64)
    # of each partial partition: loads over the least, descending, and their bundles; then the bundles of the windows at the least
    parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {i: (weights[i : i + 1].astype(np.int64), np.array([i]), none) for i in range(n)}
    halves: list[tuple[int, int]] = []  # bundles from n on are two others together
    heap = [(-int(w) if k > 1 else 0, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    last = n
    while len(heap) > 1:
        (loads_a, full_a, rest_a), (loads_b, full_b, rest_b) = parts.pop(heapq.heappop(heap)[1]), parts.pop(heapq.heappop(heap)[1])
        # a's windows from the fullest, then those at its least, meet b's from the emptiest
        a, b = np.concatenate((full_a, rest_a)), np.concatenate((full_b, rest_b))
        over = max(0, len(a) + len(b) - k)  # the last of a's windows with bundles meet as many of b's
        heads = np.zeros(len(a), dtype=np.int64)
        heads[: len(loads_a)] = loads_a
        tails = np.zeros(len(b), dtype=np.int64)
        tails[: len(loads_b)] = loads_b
        loads = np.concatenate((heads[: len(a) - over], heads[len(a) - over :] + tails[len(b) - over :][::-1], tails[: len(b) - over]))
        met = np.arange(n + len(halves), n + len(halves) + over)
        halves += zip(a[len(a) - over :].tolist(), b[len(b) - over :][::-1].tolist(), strict=True)
        bundles = np.concatenate((a[: len(a) - over], met, b[: len(b) - over]))
        order = np.argsort(-loads, kind="stable")
        loads, bundles = loads[order], bundles[order]
        if len(loads) == k:
            loads = loads - loads[-1]
        above = int(np.searchsorted(-loads, 0, "left"))
        parts[last] = loads[:above], bundles[:above], bundles[above:]
        heapq.heappush(heap, (-int(loads[0]), last))
        last += 1
    _, full, rest = parts.popitem()[1]
    window = np.zeros(n + len(halves), dtype=np.int64)
    window[np.concatenate((full, rest))] = np.arange(len(full) + len(rest))
    for node in range(len(halves) - 1, -1, -1):
        window[list(halves[node])] = window[n + node]
    return window[:n], np.bincount(window[:n], weights=weights, minlength=k).astype(np.int64)


def windows_for(weights: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Each weight's window and the window count, from the least that could do upwards."""
    k = max(1, -(-int(weights.sum()) // capacity))
    while True:
        window, sums = difference(weights, k)
        if sums.max() <= capacity:
            return window, k
        k += 1


class _Packer:
    """The pieces of one task: its numbering of sequences and the group being gathered."""

    def __init__(self, first: int, capacity: int, piece: int, group: int):
        self.next, self.capacity, self.piece, self.group = first, capacity, piece, group
        self.parts: list[tuple] = []  # doc_id, start, length, doc_tokens, ids
        self.gathered = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        n, out = len(ids), []
        whole = n - n % self.capacity
        for a in range(0, whole, self.capacity):
            out.append((doc_id, a, self.capacity, n, self.next, 0, ids[a : a + self.capacity]))
            self.next += 1
        for a in range(whole, n, self.piece):
            own = ids[a : a + self.piece]
            self.parts.append((doc_id, a, len(own), n, own))
            self.gathered += len(own)
        if self.gathered >= self.group * self.capacity or len(self.parts) >= GROUP_PIECES:
            out += self.flush()
        return out

    def flush(self) -> list[tuple]:
        if not self.parts:
            return []
        weights = np.array([x[2] for x in self.parts], dtype=np.int64)
        window, k = windows_for(weights, self.capacity)
        order = np.argsort(window, kind="stable")
        before = np.cumsum(weights[order]) - weights[order]
        first = np.searchsorted(window[order], np.arange(k))
        offset = before - before[np.minimum(first, len(order) - 1)][window[order]]
        used = np.unique(window)  # a window stays empty only where a group has fewer pieces than windows
        number = np.searchsorted(used, window)
        out = [(*self.parts[i][:4], self.next + int(number[i]), int(o), self.parts[i][4]) for i, o in zip(order.tolist(), offset.tolist(), strict=True)]
        self.next, self.parts, self.gathered = self.next + len(used), [], 0
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(c, type=pa.int64()) for c in columns[:6]]
    arrays.append(pa.array([x.astype("<u4").tobytes() for x in columns[6]], type=pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, piece: int = 256, group: int = 256) -> DataFrame:
    """The pieces of all documents with their place in sequences of at most ``capacity`` tokens.

    ``docs`` has doc_id and text (other columns are ignored); ``tokenizer`` is the path of a
    tokenizer file on every executor. Returns one row per piece: doc_id, start (ids of the document
    before it), length, doc_tokens, sequence_id, offset (gapless from 0 in a sequence) and ids
    (little-endian unsigned 32-bit integers). Sequences are numbered within a task, from the task's
    partition times 2**33.

    A null or empty text gives the end id alone. A null doc_id stays null. Repeated rows are packed
    once each. An empty table gives no rows. Only each task's last group can leave more than a
    window's share of padding.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        packer = _Packer(TaskContext.get().partitionId() << 33, capacity, piece, group)
        for batch in batches:
            for part in text_slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, begin = with_end(*tool.encode(texts), end_id)
                out = []
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    out += packer.add(doc_id, ids[a:b])
                    if len(out) >= 4096:
                        yield _batch(out)
                        out = []
                packer.parts = [(*x[:4], x[4].copy()) if x[4].base is not None else x for x in packer.parts]
                if out:
                    yield _batch(out)
        if out := packer.flush():
            yield _batch(out)

    return map_batches(docs.select("doc_id", "text"), run, SCHEMA)


def text_slices(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text."""
    if not batch.num_rows:
        return
    lengths = np.array(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    row = 0
    while row < batch.num_rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield batch.slice(row, to - row)
        row = to
