"""Token ids of whole texts by a public tokenizer file, for use inside tasks.

Most of a tokenizer's time goes into merging the pieces of words that it has met before. Here numpy
cuts a batch of texts at the same places as the tokenizer's own pre-tokenizer, the library encodes
each distinct piece once per worker process, and the ids are then laid out by indexing. Pieces are
looked up by a 64-bit hash and compared byte by byte with the piece remembered, so that two pieces of
one hash keep their own ids. Texts with any character outside well-settled ranges, or with a special
token's string, are encoded whole by the library. For tokenizer files with another pre-tokenizer
every text is.
"""

from __future__ import annotations

import json
import os

import numpy as np
import regex

from gaugewright.llm.words import FIRST_BYTES, byte_words, span_hashes

#: Distinct pieces that a worker process remembers (about 80 bytes each) before it starts again.
MEMORY_PIECES = 2_000_000

#: Pieces given to the library in one call.
CALL_PIECES = 20_000

LETTER, NUMBER, SPACE, OTHER, UNSAFE = range(5)

# How the two public tokenizer files split words.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]

# Ranges of characters whose class, lower case and normal form are the same in all versions of Unicode.
_SAFE_BYTE = [(0x9, 0xA), (0xD, 0xD), (0x20, 0x7E), (0xA1, 0x17F), (0x391, 0x3A1), (0x3A3, 0x3C9), (0x410, 0x44F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC)]
_SAFE_WORD = [(0x9, 0xA), (0xD, 0xD), (0x20, 0x7E), (0xA1, 0x12F), (0x131, 0x148), (0x14A, 0x17E)]


def _classes(ranges: list[tuple[int, int]]) -> np.ndarray:
    table = np.full(0x110000, UNSAFE, dtype=np.uint8)
    for a, b in ranges:
        for c in range(a, b + 1):
            table[c] = LETTER if regex.match(r"\p{L}", chr(c)) else NUMBER if regex.match(r"\p{N}", chr(c)) else SPACE if chr(c).isspace() else OTHER
    return table


class Encoder:
    """Encodes lists of texts with one tokenizer file; made once per worker process by ``encoder``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens") or []]
        self.kind = self._kind(spec)
        if self.kind:
            self.classes = _classes(_SAFE_BYTE if self.kind == "byte" else _SAFE_WORD)
            self.lower = np.arange(0x250, dtype=np.uint32)
            for c in range(0x250):
                if len(chr(c).lower()) == 1:
                    self.lower[c] = ord(chr(c).lower())
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            self.edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that begin (byte) or end (word) a piece
            for token, i in vocabulary.items():
                self.edge[i] = token.startswith("\u0120") if self.kind == "byte" else token.endswith("</w>")
        self._forget()

    @staticmethod
    def _kind(spec: dict) -> str | None:
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        if model.get("type") != "BPE" or model.get("dropout"):
            return None
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            return "byte"
        normalizers = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (pre.get("pretokenizers") or [{}])[0]
        if normalizers == _WORD_NORMALIZERS and split.get("pattern", {}).get("Regex") == _WORD_SPLIT and split.get("behavior") == "Removed" and split.get("invert"):
            return "word"
        return None

    def _forget(self) -> None:
        self.keys = np.zeros(1 << 16, dtype=np.uint64)  # open addressing; 0 is an empty slot
        self.numbers = np.zeros(1 << 16, dtype=np.int32)
        self.flat, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bytes, self.place, self.size = np.zeros(8, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)  # the pieces themselves, with room for one look beyond

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of the texts in their order, and where each text's begin (and the end)."""
        plain = [i for i, t in enumerate(texts) if not self.kind or any(s in t for s in self.special)]
        if self.kind:
            codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
            classes = [self.classes[c] for c in codes]
            plain = sorted({*plain, *(i for i, c in enumerate(classes) if (c == UNSAFE).any())})
        ids: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        skip = set(plain)
        fast = [i for i in range(len(texts)) if i not in skip]
        for i in plain:
            ids[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32)
        if fast:
            offsets = np.concatenate(([0], np.cumsum([len(codes[i]) for i in fast])))
            flat, begin = self._encode_safe(np.concatenate([codes[i] for i in fast]), np.concatenate([classes[i] for i in fast]), offsets)
            if not plain:
                return flat, begin
            for i, a, b in zip(fast, begin[:-1], begin[1:], strict=True):
                ids[i] = flat[a:b]
        begin = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64)))
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), begin

    def _encode_safe(self, codes: np.ndarray, classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = self._pieces(codes, classes, offsets)
        if self.kind == "word":
            codes = self.lower[codes]
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        places = np.concatenate(([0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800))))
        data = codes.tobytes().decode("utf-32-le").encode("utf-8")
        begins, stops = places[starts], places[ends]
        text = np.frombuffer(data, dtype=np.uint8)
        hashes = span_hashes(text, begins, stops) | np.uint64(1)
        numbers = self._find(hashes)
        if len(missing := np.flatnonzero(numbers < 0)):
            if len(self.start) + len(missing) > MEMORY_PIECES:
                self._forget()
                missing = np.arange(len(hashes))
            new, first = np.unique(hashes[missing], return_index=True)
            at = missing[first]
            self._learn([data[a:b].decode() for a, b in zip(begins[at].tolist(), stops[at].tolist(), strict=True)], new)
            numbers = self._find(hashes)
        if len(others := self._unlike(numbers, text, begins, stops)):  # another piece has this hash
            numbers[others] = self._learn([data[a:b].decode() for a, b in zip(begins[others].tolist(), stops[others].tolist(), strict=True)])
        lengths = self.length[numbers]
        done = np.concatenate(([0], np.cumsum(lengths)))
        at = np.repeat(self.start[numbers] - done[:-1], lengths)
        at += np.arange(done[-1])
        return self.flat[at], done[np.searchsorted(starts, offsets)]

    def _pieces(self, codes: np.ndarray, classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pre-tokenizer's pieces start and end."""
        n = len(codes)
        begins = np.zeros(n + 1, dtype=bool)  # a new text
        begins[offsets] = True
        start = begins[:n].copy()
        start[1:] |= classes[1:] != classes[:-1]
        begins, space = begins[:n], classes == SPACE
        if self.kind == "word":
            start |= classes == NUMBER
        # 's 't 'm 'd 're 've 'll where a piece starts with the quote
        quotes = np.flatnonzero((codes == 0x27) & start)
        if self.kind == "byte":
            after = quotes > 0
            after[after] = (codes[quotes[after] - 1] == 0x20) & ~begins[quotes[after]]
            quotes = quotes[~after]
        text_end = offsets[np.searchsorted(offsets, quotes, "right")]
        # a quote at the very end of a text has no letter after it
        second = np.where(quotes + 1 < text_end, codes[np.minimum(quotes + 1, n - 1)], 0)
        third = np.where(quotes + 2 < text_end, codes[np.minimum(quotes + 2, n - 1)], 0)
        if self.kind == "word":
            second, third = self.lower[np.minimum(second, 0x24F)], self.lower[np.minimum(third, 0x24F)]
        one = np.isin(second, [ord(c) for c in "stmd"])
        two = ((second == ord("r")) & (third == ord("e"))) | ((second == ord("v")) & (third == ord("e"))) | ((second == ord("l")) & (third == ord("l")))
        start[quotes[one | two] + 1] = False
        for at in (quotes[one] + 2, quotes[two] + 3):
            start[at[(at < n)]] = True  # the rest of the letters is a piece of its own; what else stands there starts one anyway
        if self.kind == "byte":
            # the last space of a run goes to the piece after it, or stands alone if it isn't a plain one
            heads = np.flatnonzero(start & ~space)
            heads = heads[heads > 0]
            heads = heads[space[heads - 1] & ~begins[heads]]
            start[heads - 1] = True
            start[heads[codes[heads - 1] == 0x20]] = False
            starts = np.flatnonzero(start)
            return starts, np.append(starts[1:], n)
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], n)
        real = ~space[starts]
        return starts[real], ends[real]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each remembered piece; -1 for others."""
        mask = np.uint64(len(self.keys) - 1)
        slots = (hashes >> np.uint64(8)) & mask
        out = np.full(len(hashes), -1, dtype=np.int32)
        found = self.keys[slots]
        hit = found == hashes
        out[hit] = self.numbers[slots[hit]]
        open_ = np.flatnonzero(~hit & (found != 0))
        while len(open_):
            slots[open_] = (slots[open_] + np.uint64(1)) & mask
            found = self.keys[slots[open_]]
            hit = found == hashes[open_]
            out[open_[hit]] = self.numbers[slots[open_[hit]]]
            open_ = open_[~hit & (found != 0)]
        return out

    def _unlike(self, numbers: np.ndarray, text: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Which spans differ in some byte from the remembered pieces of these numbers."""
        left = stops - begins
        differ = self.size[numbers] != left
        here, there = byte_words(text), np.ndarray((len(self.bytes) - 7,), dtype="<u8", buffer=self.bytes, strides=(1,))
        live, k = np.flatnonzero(~differ), 0
        while len(live):
            differ[live] = ((here[begins[live] + k] ^ there[self.place[numbers[live]] + k]) & FIRST_BYTES[np.minimum(left[live] - k, 8)]) != 0
            k += 8
            live = live[~differ[live] & (left[live] > k)]
        return np.flatnonzero(differ)

    def _learn(self, pieces: list[str], hashes: np.ndarray | None = None) -> np.ndarray:
        """Encodes new pieces, remembers them under their hashes, if given, and returns their numbers."""
        order = np.arange(len(pieces))
        if self.kind == "byte":  # in a row, pieces of a space and letters stay apart, and their first ids show it
            joins = np.array([p[0] == " " and p[1:].isalpha() for p in pieces], dtype=bool)
        else:  # between spaces, pieces stay apart, and their last ids show it
            joins = np.ones(len(pieces), dtype=bool)
        joined, alone = order[joins], order[~joins]
        lengths, flat = np.zeros(len(pieces), dtype=np.int64), []
        for a in range(0, len(joined), CALL_PIECES):
            part = joined[a : a + CALL_PIECES]
            text = ("" if self.kind == "byte" else " ").join(pieces[i] for i in part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            edges = np.flatnonzero(self.edge[ids])
            assert len(edges) == len(part), "the tokenizer's pieces aren't those expected"
            lengths[part] = np.diff(edges, append=len(ids)) if self.kind == "byte" else np.diff(edges, prepend=-1)
            flat.append(ids)
        for a in range(0, len(alone), CALL_PIECES):
            part = alone[a : a + CALL_PIECES]
            found = [x.ids for x in self.tokenizer.encode_batch_fast([pieces[i] for i in part], add_special_tokens=False)]
            lengths[part] = [len(x) for x in found]
            flat.append(np.array([i for x in found for i in x], dtype=np.uint32))
        order = np.concatenate((joined, alone)).astype(np.int64)
        lengths = lengths[order]
        at = len(self.start)
        own = [pieces[i].encode() for i in order.tolist()]
        sizes = np.array([len(p) for p in own], dtype=np.int64)
        self.place = np.append(self.place, len(self.bytes) - 8 + np.cumsum(sizes) - sizes)
        self.size = np.append(self.size, sizes)
        self.bytes = np.concatenate([self.bytes[:-8], np.frombuffer(b"".join(own) + bytes(8), dtype=np.uint8)])
        self.start = np.append(self.start, len(self.flat) + np.cumsum(lengths) - lengths)
        self.length = np.append(self.length, lengths)
        self.flat = np.concatenate([self.flat, *flat])
        numbers = np.empty(len(pieces), dtype=np.int32)
        numbers[order] = np.arange(at, at + len(pieces))
        if hashes is None:
            return numbers
        if 2 * len(self.start) > len(self.keys):
            kept = self.keys != 0
            known = self.keys[kept], self.numbers[kept]
            size = 1 << (4 * len(self.start)).bit_length()
            self.keys, self.numbers = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int32)
            self._insert(*known)
        self._insert(hashes, numbers)
        return numbers

    def _insert(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        slots = (hashes >> np.uint64(8)) & mask
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.keys[slots[left]] == 0]
            self.keys[slots[free]] = hashes[free]  # of several, one stays
            won = self.keys[slots[left]] == hashes[left]
            self.numbers[slots[left[won]]] = numbers[left[won]]
            left = left[~won]
            slots[left] = (slots[left] + np.uint64(1)) & mask


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file, which must exist at the same path on every executor."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, begin: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each text."""
    texts = len(begin) - 1
    out = np.empty(len(ids) + texts, dtype=np.uint32)
    ends = begin[1:] + np.arange(texts)
    keep = np.ones(len(out), dtype=bool)
    keep[ends] = False
    out[keep] = ids
    out[ends] = end_id
    return out, begin + np.arange(texts + 1)
