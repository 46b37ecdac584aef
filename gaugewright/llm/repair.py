"""Re-Pair grammar compression of token ids, and the byte layout of a compressed block.

A block holds the ids of whole documents in order. In rounds, every pair of neighbouring symbols is
ranked by how often it occurs in the block; where a pair outranks the pairs that overlap it, it is
replaced by a nonterminal, if enough of its occurrences are. The rounds end when hardly anything is
replaced. No pair spans two documents, so one document, or a range of its ids found from the
expansion lengths, can be decoded without the rest.

Layout (little endian): magic ``RPG1``; four 32-bit unsigned numbers: documents, rules, symbols and
terminals (ids below that number stand for themselves); bytes per symbol (3 or 4) and the number of
rounds, both 32-bit; rules of each round (32-bit); a byte per document that is 1 where its id is
null; document ids (64-bit signed); ids and symbols of each document (64-bit each); expansion
lengths of the rules (32-bit); the rules' left and right symbols and the document symbols.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"RPG1"
#: log2 of the table that ranks pairs, at most; a block of few ids has a smaller one.
_SLOT_BITS = 20
_HASH = np.uint64(0x9E3779B97F4A7C15)


def compress(ids: np.ndarray, doc_tokens: np.ndarray, min_count: int = 4, max_rounds: int = 16, least_gain: float = 0.01):
    """Returns symbols, symbols of each document, left and right of each rule, rules of each round and terminals."""
    terminals = int(ids.max()) + 1 if len(ids) else 1
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(ids), dtype=bool)
    last[np.cumsum(doc_tokens)[doc_tokens > 0] - 1] = True
    next_symbol, left, right, rounds = terminals, [], [], []
    bits = min(_SLOT_BITS, len(ids).bit_length() + 1)
    slots, shift = 1 << bits, np.uint64(64 - bits)
    for _ in range(max_rounds):
        n = len(symbols) - 1
        if n < 1:
            break
        keys = (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:]
        slot = ((keys * _HASH) >> shift).view(np.int64)
        slot[last[:-1]] = slots  # no pair spans two documents
        counts = np.bincount(slot, minlength=slots + 1)
        rank = (counts << bits) | np.arange(slots + 1)
        rank[counts < min_count] = 0
        rank[slots] = 0
        rank = rank[slot]
        # positions that outrank both neighbours; in a run of one pair, every second from its start
        chosen = rank > 0
        chosen[1:] &= rank[1:] >= rank[:-1]
        chosen[:-1] &= rank[:-1] >= rank[1:]
        same = np.flatnonzero(chosen)
        tied = same[(same > 0) & (rank[same - 1] == rank[same])]
        if len(tied):
            changes = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
            begun = changes[np.searchsorted(changes, tied, "right") - 1]
            chosen[tied[(tied - begun) % 2 == 1]] = False
            same = np.flatnonzero(chosen)
        own = slot[same]
        key_of = np.zeros(slots, dtype=np.uint64)
        key_of[own] = keys[same]
        agrees = key_of[own] == keys[same]  # of two pairs in one slot, one waits for a later round
        same, own = same[agrees], own[agrees]
        often = np.bincount(own, minlength=slots) >= min_count
        kept = often[own]
        same, own = same[kept], own[kept]
        if len(same) < max(1, least_gain * n):
            break
        used = np.flatnonzero(often)
        number = np.zeros(slots, dtype=np.uint32)
        number[used] = next_symbol + np.arange(len(used))
        left.append((key_of[used] >> np.uint64(32)).astype(np.uint32))
        right.append((key_of[used] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        rounds.append(len(used))
        next_symbol += len(used)
        symbols[same] = number[own]
        last[same] = last[same + 1]
        keep = np.ones(len(symbols), dtype=bool)
        keep[same + 1] = False
        symbols, last = symbols[keep], last[keep]
    ends = np.zeros(len(doc_tokens), dtype=np.int64)
    ends[doc_tokens > 0] = np.flatnonzero(last) + 1
    ends = np.maximum.accumulate(ends) if len(ends) else ends
    none = np.zeros(0, dtype=np.uint32)
    return symbols, np.diff(ends, prepend=0), np.concatenate([none, *left]), np.concatenate([none, *right]), rounds, terminals


def expansions(left: np.ndarray, right: np.ndarray, rounds: list[int], terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols' expansions in one array, and where each symbol's starts and how long it is."""
    lengths = np.ones(terminals + len(left), dtype=np.int64)
    starts = np.arange(terminals + len(left), dtype=np.int64)
    flats, size, at = [np.arange(terminals, dtype=np.uint32)], terminals, 0
    for count in rounds:
        flat = np.concatenate(flats)
        sides = np.stack((left[at : at + count], right[at : at + count]), axis=1).ravel().astype(np.int64)
        pieces = lengths[sides]
        done = np.cumsum(pieces)
        flats = [flat, flat[np.repeat(starts[sides] - (done - pieces), pieces) + np.arange(done[-1])]]
        own = slice(terminals + at, terminals + at + count)
        lengths[own] = pieces[::2] + pieces[1::2]
        starts[own] = size + np.cumsum(lengths[own]) - lengths[own]
        size, at = size + int(done[-1]), at + count
    return np.concatenate(flats), starts, lengths


def encode_block(doc_ids: list[int | None], doc_tokens: np.ndarray, ids: np.ndarray) -> tuple[bytes, int, int]:
    """The bytes of one block, its symbols and its rules."""
    symbols, doc_symbols, left, right, rounds, terminals = compress(ids, doc_tokens)
    _, _, lengths = expansions(left, right, rounds, terminals)
    wide = 3 if terminals + len(left) < 1 << 24 else 4
    narrow = lambda a: np.ascontiguousarray(a.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :wide].tobytes()
    data = b"".join([
        MAGIC, struct.pack("<6I", len(doc_ids), len(left), len(symbols), terminals, wide, len(rounds)),
        np.array(rounds, dtype="<u4").tobytes(), np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), doc_tokens.astype("<i8").tobytes(), doc_symbols.astype("<i8").tobytes(),
        lengths[terminals:].astype("<u4").tobytes(), narrow(left), narrow(right), narrow(symbols),
    ])
    return data, len(symbols), len(left)


class Block:
    """A block that was read: its documents and their ids."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        docs, rules, symbols, terminals, wide, rounds = struct.unpack_from("<6I", data, 4)
        at = 28

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        def widen(count: int) -> np.ndarray:
            out = np.zeros((count, 4), dtype=np.uint8)
            out[:, :wide] = take("u1", count * wide).reshape(count, wide)
            return out.view("<u4").ravel()

        per_round = take("<u4", rounds).tolist()
        nulls, doc_ids = take("u1", docs), take("<i8", docs)
        self.doc_ids = [None if n else d for n, d in zip(nulls.tolist(), doc_ids.tolist(), strict=True)]
        self.doc_tokens, self.doc_symbols = take("<i8", docs), take("<i8", docs)
        self.rule_lengths = take("<u4", rules)
        left, right = widen(rules), widen(rules)
        self.symbols = widen(symbols)
        self._flat, self._starts, self._lengths = expansions(left, right, per_round, terminals)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        lengths = self._lengths[symbols]
        done = np.cumsum(lengths)
        at = np.repeat(self._starts[symbols] - (done - lengths), lengths)
        return self._flat[at + np.arange(len(at))]

    def ids(self) -> np.ndarray:
        """The ids of all documents."""
        return self._expand(self.symbols)

    def document(self, number: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of one document; only the symbols that cover them are expanded."""
        first = int(self.doc_symbols[:number].sum())
        symbols = self.symbols[first : first + int(self.doc_symbols[number])]
        ends = np.cumsum(self._lengths[symbols])
        stop = int(self.doc_tokens[number]) if stop is None else min(stop, int(self.doc_tokens[number]))
        if start >= stop:
            return np.zeros(0, dtype=np.uint32)
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        before = int(ends[a - 1]) if a else 0
        return self._expand(symbols[a:b])[start - before : stop - before]
