"""Quality rules as a short-circuit cascade ordered by rejection per cost.

Every rule is first run on a hash-chosen sample, where its time per row and the share of rows that
it rejects are measured; the words, which all rules share, are found before the clock starts. The
cascade then applies the rules by rejected share per second, the highest first, and each rule sees
only the rows that all before it let pass. The order changes the time taken, never the verdict: a
row is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.llm.words import ASCII_SPACE, chunks, map_batches, shingles, span_hashes, spans, text_buffer

#: Rows of the sample on which rules are measured, about.
SAMPLE_ROWS = 2000

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True

_LETTERS = np.array([c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 for c in range(256)])
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True


#: Counts of a text, one number each; what was counted stays when some of the texts go.
PER_TEXT = {"n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stutters", "n_letter_words", "n_bullets"}

#: Texts are copied together once fewer than this share of them are left; until then those that went are passed over.
COMPACT = 0.5


class Texts:
    """Some texts of a batch with what rules count in them; each count is made when first asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self._made = data, offsets, {}

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def of(self, rows: np.ndarray) -> Texts:
        """Only some of the texts, with what was counted in each of them."""
        if len(rows) == len(self):
            return self
        pieces = [self.data[self.offsets[i] : self.offsets[i + 1]] for i in rows.tolist()]
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        some = Texts(np.concatenate(pieces) if pieces else self.data[:0], np.concatenate(([0], np.cumsum(lengths))))
        some._made = {name: made[rows] for name, made in self._made.items() if name in PER_TEXT}
        return some

    def with_words(self) -> Texts:
        """The same texts with their words found and nothing else."""
        fresh = Texts(self.data, self.offsets)
        fresh._made["words"] = self.words
        return fresh

    def _once(self, name: str, make: Callable):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def _per_text(self, flags: np.ndarray, first: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[first[1:]] - sums[first[:-1]]

    @property
    def words(self):
        return self._once("words", lambda: spans(self.data, self.offsets, ASCII_SPACE))

    @property
    def n_words(self) -> np.ndarray:
        return self._once("n_words", lambda: np.diff(self.words[2]))

    @property
    def hashes(self) -> np.ndarray:
        return self._once("hashes", lambda: span_hashes(self.data, self.words[0], self.words[1]))

    @property
    def word_chars(self) -> np.ndarray:
        """Code points inside words."""
        return self._once("word_chars", lambda: self._per_text(((self.data & 0xC0) != 0x80) & ~ASCII_SPACE[self.data], self.offsets))

    @property
    def n_symbols(self) -> np.ndarray:
        return self._once("n_symbols", lambda: self._per_text(SYMBOLS[self.data], self.offsets))

    @property
    def lines(self):
        """Lines with a word: starts, ends, each text's first."""

        def make():
            starts, ends, _ = spans(self.data, self.offsets, _NEWLINE)
            inked = np.concatenate(([0], np.cumsum(~ASCII_SPACE[self.data])))
            real = inked[ends] > inked[starts]
            starts, ends = starts[real], ends[real]
            return starts, ends, np.searchsorted(starts, self.offsets)

        return self._once("lines", make)

    @property
    def n_lines(self) -> np.ndarray:
        return self._once("n_lines", lambda: np.diff(self.lines[2]))

    @property
    def n_dup_lines(self) -> np.ndarray:
        """Lines equal to an earlier line of the text."""

        def make():
            starts, ends, first = self.lines
            hashes = span_hashes(self.data, starts, ends)
            return np.array([b - a - len(set(hashes[a:b].tolist())) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], dtype=np.int64)

        return self._once("n_dup_lines", make)

    @property
    def n_repeat_words(self) -> np.ndarray:
        """Words in 5-word windows that the text has twice or more."""

        def make():
            first = self.words[2]
            runs, begin = shingles(self.hashes, first, 5)
            out = np.zeros(len(self), dtype=np.int64)
            counts = np.diff(first)
            for i in np.flatnonzero(counts > 5).tolist():
                own = runs[begin[i] : begin[i + 1]]
                order = np.sort(own)
                twice = order[1:][order[1:] == order[:-1]]
                if len(twice):
                    at = np.flatnonzero(np.isin(own, twice))
                    covered = np.zeros(counts[i] + 1, dtype=np.int64)
                    np.add.at(covered, at, 1)
                    np.add.at(covered, at + 5, -1)
                    out[i] = np.count_nonzero(np.cumsum(covered))
            return out

        return self._once("n_repeat_words", make)

    @property
    def n_stutters(self) -> np.ndarray:
        """Words equal to the word before them."""

        def make():
            first = self.words[2]
            same = np.zeros(len(self.hashes), dtype=bool)
            same[1:] = self.hashes[1:] == self.hashes[:-1]
            same[first[:-1][first[:-1] < len(same)]] = False
            return self._per_text(same, first)

        return self._once("n_stutters", make)

    @property
    def n_letter_words(self) -> np.ndarray:
        """Words with a letter or a character outside ASCII."""

        def make():
            starts, ends, first = self.words
            sums = np.concatenate(([0], np.cumsum(_LETTERS[self.data])))
            return self._per_text(sums[ends] > sums[starts], first)

        return self._once("n_letter_words", make)

    @property
    def n_bullets(self) -> np.ndarray:
        """Lines that begin with -, *, + or the bullet sign, after white space if any."""

        def make():
            starts, _, first = self.lines
            words = self.words[0]
            starts = words[np.searchsorted(words, starts)]
            head = self.data[starts]
            sign = np.isin(head, np.frombuffer(b"-*+", dtype=np.uint8))
            longer = np.minimum(starts + 2, max(0, len(self.data) - 1))
            sign |= (head == 0xE2) & (self.data[longer - 1] == 0x80) & (self.data[longer] == 0xA2) if len(starts) else sign
            return self._per_text(sign, first)

        return self._once("n_bullets", make)


@dataclass(frozen=True)
class Rule:
    """A rule rejects texts: ``reject`` gives a boolean for each text."""

    name: str
    reject: Callable[[Texts], np.ndarray]


def base_rule(min_words: int = 10, repeat_percent: int = 20) -> Rule:
    return Rule("base", lambda t: (t.n_words < min_words) | (100 * t.n_repeat_words > repeat_percent * t.n_words))


def default_rules(dup_percent: int = 30) -> list[Rule]:
    """Thresholds in the manner of published rule sets for web text; all are shares of words or lines."""
    return [
        Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
        Rule("dup_lines", lambda t: 100 * t.n_dup_lines > dup_percent * t.n_lines),
        Rule("stutter", lambda t: 10 * t.n_stutters > 3 * t.n_words),
        Rule("word_length", lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 14 * t.n_words)),
        Rule("letters", lambda t: 10 * t.n_letter_words < 6 * t.n_words),
        Rule("bullets", lambda t: 10 * t.n_bullets > 9 * t.n_lines),
    ]


def measure_rules(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """Seconds per row, beyond finding words, and share of rejected rows of each rule, on about ``sample_rows`` rows drawn at random.

    Rows are drawn whatever they hold, so that null or equal ids, or one text in very many rows, bias
    nothing. The draw bears on the order of rules alone.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for _, _, part, begin in chunks(data, offsets):
                shared = Texts(part, begin)
                for rule in rules:
                    texts, began = shared.with_words(), time.perf_counter()
                    rejected = int(np.count_nonzero(rule.reject(texts)))
                    yield pa.RecordBatch.from_pydict({"rule": [rule.name], "rows": [len(texts)], "rejected": [rejected], "seconds": [time.perf_counter() - began]})

    sample = docs.select("text").sample(share, seed=9)
    found = map_batches(sample, run, "rule string, rows long, rejected long, seconds double").groupBy("rule").agg(F.sum("rows").alias("rows"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))
    return {r["rule"]: (r["seconds"] / r["rows"], r["rejected"] / r["rows"]) for r in found.collect()}


def order_rules(rules: Sequence[Rule], measured: dict[str, tuple[float, float]]) -> list[Rule]:
    """The rules by rejected share per second, highest first; unmeasured ones last, ties by name."""

    def key(rule: Rule):
        seconds, share = measured.get(rule.name, (1.0, 0.0))
        return -share / max(seconds, 1e-12), seconds, rule.name

    return sorted(rules, key=key)


def cascade(texts: Texts, rules: Sequence[Rule]) -> np.ndarray:
    """For each text the number of the rule that rejects it first; -1 if none does."""
    verdict, place, alive = np.full(len(texts), -1, dtype=np.int64), np.arange(len(texts)), np.ones(len(texts), dtype=bool)
    for k, rule in enumerate(rules):
        if np.count_nonzero(alive) < COMPACT * len(alive):
            left = np.flatnonzero(alive)
            texts, place, alive = texts.of(left), place[left], np.ones(len(left), dtype=bool)
        if not len(alive):
            break
        rejected = rule.reject(texts) & alive
        verdict[place[rejected]] = k
        alive &= ~rejected
    return verdict


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None, base: Rule | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document with its base counts, base_failed, kept and the rule that rejected it.

    ``docs`` has doc_id and text; other columns are ignored. The base rule comes first, for every row
    gets its counts and its verdict; the others follow in their measured order, on what is left. (``keep_good``
    owes no counts, and orders the base rule among the others.) Which of several rejecting rules is named
    depends on that order, kept doesn't. A null or empty text has no words and fails the base rule.
    Lines and windows are compared by 64-bit hashes. Repeated rows are judged once each; an empty
    table gives no rows.
    """
    rules, base = default_rules() if rules is None else list(rules), base or base_rule()
    ordered = order_rules(rules, measure_rules(docs, rules, sample_rows))
    names = [base.name, *(r.name for r in ordered)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for a, b, part, begin in chunks(data, offsets):
                texts = Texts(part, begin)
                failed = base.reject(texts)
                verdict = np.zeros(len(texts), dtype=np.int64)
                left = np.flatnonzero(~failed)
                passed = cascade(texts.of(left), ordered)
                verdict[left] = np.where(passed >= 0, passed + 1, -1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), *(pa.array(x) for x in (texts.n_words, texts.word_chars, texts.n_symbols, texts.n_dup_lines, texts.n_repeat_words, failed, verdict < 0)), pa.array([names[v] if v >= 0 else None for v in verdict], type=pa.string())],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"],
                )

    return map_batches(docs.select("doc_id", "text"), run, SCHEMA)


def keep_good(docs: DataFrame, rules: Sequence[Rule] | None = None, base: Rule | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with all their columns, by the same cascade as ``judge``.

    Every row is judged by its own text and passed on by the task that read it, so nothing is
    shuffled. Rows of one doc_id are judged each; a null or empty text goes; an empty table gives no
    rows. Columns other than text may have any name and type.
    """
    rules, base = default_rules() if rules is None else list(rules), base or base_rule()
    cheap_first = order_rules([base, *rules], measure_rules(docs, [base, *rules], sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for a, b, part, begin in chunks(data, offsets):
                yield batch.slice(a, b - a).filter(pa.array(cascade(Texts(part, begin), cheap_first) < 0))

    return map_batches(docs, run, docs.schema)
