"""Language-model scores by a lattice of subwords: the probability of a text over all its segmentations.

The vocabulary is an existing one, of a public tokenizer file; its scores, ranks of merges, give each
piece a first probability. Rounds of expectation maximisation over the words of the documents to learn
from turn these into the model: a text is a sequence of independent pieces and an end. Its probability
sums over every way to cut it into pieces, by a forward recursion in log space. No piece reaches
across the start of a word, so a text's sum is the product of its words', and each distinct word is
worked out once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.llm.words import ASCII_SPACE, LOWER, binary_column, map_batches, spans, text_buffer
from gaugewright.session import checkpointed, shared_path

#: Bytes of text whose distinct words ask for their counts together, about.
BLOCK_BYTES = 16 << 20

#: Rounds of expectation maximisation.
ROUNDS = 3

#: Weight of the vocabulary's own scores beside the corpus, in pieces.
PRIOR_PIECES = 1000.0

#: Added to each count of the base score.
BASE_ADDED = 0.1

#: Stands before each word; UTF-8 has no such byte.
START = 0xFF

#: Cells (word, end, length of a piece) worked on at a time.
CELLS = 2_000_000

#: Words worked on at a time.
WORDS = 50_000


@dataclass(frozen=True)
class Model:
    """Pieces as bytes and the natural logarithms of their probabilities; ``end`` is that of a text's end."""

    pieces: tuple[bytes, ...]
    logs: np.ndarray
    end: float


def from_vocabulary(path: str) -> Model:
    """The model before any learning: a sentencepiece vocabulary whose piece of rank r weighs 1 / (r + 2.7).

    Byte pieces, which make every text possible, and the end of a text weigh as the last rank. Pieces
    with a space inside, which no word has, and control pieces are left out.
    """
    from sentencepiece import SentencePieceProcessor

    file = SentencePieceProcessor(model_file=path)
    size = file.get_piece_size()
    weights: dict[bytes, float] = {bytes([b]): 1 / (size + 2.7) for b in range(256)}
    for i in range(size):
        piece = file.id_to_piece(i)
        if not (file.is_control(i) or file.is_unknown(i) or file.is_unused(i) or file.is_byte(i) or "▁" in piece[1:]):
            name = (bytes([START]) if piece[0] == "▁" else b"") + piece.removeprefix("▁").encode()
            weights[name] = weights.get(name, 0.0) + 1 / (max(-file.get_score(i), 0.0) + 2.7)
    end = 1 / (size + 2.7)
    total = math.fsum(weights.values()) + end
    names = tuple(sorted(weights))
    return Model(names, np.log(np.array([weights[n] for n in names]) / total), math.log(end / total))


class Trie:
    """The pieces as a table of nodes by byte; only nodes with a child have a row."""

    def __init__(self, pieces: tuple[bytes, ...]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for i, piece in enumerate(pieces):
            node = 0
            for b in piece:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                node = children[node][b]
            ends[node] = i
        inner = [n for n, c in enumerate(children) if c]
        number = {n: k for k, n in enumerate([*inner, *(n for n, c in enumerate(children) if not c)])}
        self.inner = len(inner)
        self.next = np.full((len(inner), 256), -1, dtype=np.int32)
        for n in inner:
            for b, child in children[n].items():
                self.next[number[n], b] = number[child]
        self.piece = np.full(len(children), -1, dtype=np.int32)
        for n, i in ends.items():
            self.piece[number[n]] = i
        self.longest = max(map(len, pieces), default=1)

    def ending(self, words: np.ndarray, a: int, b: int, longest: int) -> np.ndarray:
        """The pieces that end at a + 1 to b of each row of bytes: (row, end, longest - length), -1 where none does."""
        out = np.full((len(words), b - a, longest), -1, dtype=np.int32)
        first = max(0, a + 1 - longest)
        row, start = (x.ravel() for x in np.indices((len(words), b - first)))
        start = start + first
        node = np.zeros(len(row), dtype=np.int32)
        for size in range(1, longest + 1):
            live = (start + size <= b) & (node < self.inner)
            row, start, node = row[live], start[live], node[live]
            node = self.next[node, words[row, start + size - 1]]
            live = node >= 0
            row, start, node = row[live], start[live], node[live]
            if not len(row):
                break
            found = self.piece[node]
            done = (found >= 0) & (start + size > a)
            out[row[done], start[done] + size - a - 1, longest - size] = found[done]
        return out


_tries: dict[int, Trie] = {}


def _trie(pieces: tuple[bytes, ...]) -> Trie:
    """This process's table for the pieces."""
    key = hash(pieces)
    if key not in _tries:
        _tries.clear()
        _tries[key] = Trie(pieces)
    return _tries[key]


def word_logs(model: Model, words: list[bytes], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The log probability of each word (with its start) over all segmentations; with counts, also how often each piece is expected.

    Words of one length go through the recursion side by side. A piece's share of the paths into a
    place is passed back from each word's end, which gives the expected counts.
    """
    trie = _trie(model.pieces)
    logs = np.append(model.logs, -np.inf)
    out = np.zeros(len(words))
    expected = None if counts is None else np.zeros(len(model.pieces) + 1)
    sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    bounds = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
    for x, y in zip(bounds[:-1], bounds[1:], strict=True):
        size = int(sizes[order[x]])
        longest = min(trie.longest, size)
        step = max(1, CELLS // (min(size, CELLS // longest) * longest))
        for k in range(x, y, step):
            part = order[k : min(k + step, y)]
            letters = np.frombuffer(b"".join(bytes([START]) + words[i] for i in part.tolist()), dtype=np.uint8).reshape(len(part), size)
            width = max(1, CELLS // (longest * len(part)))
            alpha = np.full((len(part), longest + size), -np.inf)
            alpha[:, longest - 1] = 0.0
            for a in range(0, size, width):
                b = min(a + width, size)
                ending = logs[trie.ending(letters, a, b, longest)]
                for j in range(a, b):
                    paths = alpha[:, j : j + longest] + ending[:, j - a]
                    best = paths.max(axis=1)
                    alpha[:, j + longest] = best + np.log(np.exp(paths - best[:, None]).sum(axis=1))
            out[part] = alpha[:, -1]
            if counts is None:
                continue
            passed = np.zeros_like(alpha)
            passed[:, -1] = counts[part]
            for a in reversed(range(0, size, width)):
                b = min(a + width, size)
                pieces = trie.ending(letters, a, b, longest)
                share = np.empty(pieces.shape)
                for j in reversed(range(a, b)):
                    share[:, j - a] = np.exp(alpha[:, j : j + longest] + logs[pieces[:, j - a]] - alpha[:, j + longest, None]) * passed[:, j + longest, None]
                    passed[:, j : j + longest] += share[:, j - a]
                real = pieces >= 0
                expected += np.bincount(pieces[real], share[real], minlength=len(expected))
    return out, None if expected is None else expected[:-1]


def _cut(block_bytes: int, kind: pa.DataType):
    """Blocks of rows: each row's tokens as numbers of the block's distinct words, and those words with their occurrences in rows to learn from."""
    names = ["block", "doc_id", "learn", "tokens", "word", "number", "n"]

    def rows(block: int, held: pa.Table) -> Iterator[pa.RecordBatch]:
        data, offsets = text_buffer(held.column("text"))
        _, _, first = spans(data, offsets, ASCII_SPACE)
        starts, ends, _ = spans(data, offsets, ASCII_SPACE)
        place = np.concatenate(([0], np.cumsum(ends - starts)))
        letters = LOWER[data[~ASCII_SPACE[data]]]
        said = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(place.astype(np.int64)), pa.py_buffer(letters)).dictionary_encode()
        number, words = said.indices.to_numpy().astype(np.int32), said.dictionary.cast(pa.string())
        learn = held.column("learn").to_numpy().astype(bool)
        n = np.bincount(number[np.repeat(learn, np.diff(first))], minlength=len(words))
        none = lambda k, t: pa.nulls(k, t)
        size = held.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([block] * size, pa.int64()), held.column("doc_id").combine_chunks(), pa.array(learn), binary_column(number, first), none(size, pa.string()), none(size, pa.int32()), none(size, pa.int64())], names)
        for a in range(0, len(words), WORDS):
            part = words.slice(a, WORDS)
            k = len(part)
            yield pa.RecordBatch.from_arrays([pa.array([block] * k, pa.int64()), none(k, kind), none(k, pa.bool_()), none(k, pa.binary()), part, pa.array(np.arange(a, a + k, dtype=np.int32)), pa.array(n[a : a + k].astype(np.int64))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            if held and size + batch.nbytes > block_bytes:
                yield from rows(block, pa.Table.from_batches(held))
                block, held, size = block + 1, [], 0
            held.append(batch)
            size += batch.nbytes
        if held and sum(b.num_rows for b in held):
            yield from rows(block, pa.Table.from_batches(held))

    return run


def _in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined to tables of about ``WORDS`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= WORDS:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def learn(counts: DataFrame, start: Model, texts: int, rounds: int = ROUNDS, prior: float = PRIOR_PIECES) -> Model:
    """The model after some rounds over ``counts`` (word, c) of ``texts`` texts; a task returns one row a piece, at most."""

    def expect(model: Model):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(model.pieces))
            for held in _in_groups(batches):
                total += word_logs(model, [w.encode() for w in held.column("word").to_pylist()], held.column("c").to_numpy().astype(float))[1]
            piece = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(total[piece])], ["piece", "times"])

        return run

    model, first, first_end = start, np.exp(start.logs), math.exp(start.end)
    for _ in range(rounds):
        times = np.zeros(len(model.pieces))
        for r in counts.mapInArrow(expect(model), "piece int, times double").groupBy("piece").agg(F.sum("times").alias("times")).collect():  # one row a piece of the vocabulary
            times[r["piece"]] = r["times"]
        whole = times.sum() + texts + prior
        model = replace(model, logs=np.log((times + prior * first) / whole), end=math.log((texts + prior * first_end) / whole))
    return model


def _score_words(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _in_groups(batches):
            found = word_logs(model, [w.encode() for w in held.column("word").to_pylist()])[0]
            yield from held.append_column("log", pa.array(found)).combine_chunks().to_batches()

    return run


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The sum of each row's values; 0 for a row of none."""
    out = np.zeros(len(begin) - 1, dtype=values.dtype)
    full = np.flatnonzero(np.diff(begin))
    if len(full):
        out[full] = np.add.reduceat(values, begin[full])
    return out


def _score_rows(model: Model, total: int, kinds: int, texts: int):
    """A block's rows with what its words were told: the sums over their tokens."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        tokens = rows.column("tokens").combine_chunks()
        data = np.frombuffer(b"".join(tokens.to_pylist()), dtype=np.int32)
        begin = np.concatenate(([0], np.cumsum(pa.compute.binary_length(tokens).to_numpy().astype(np.int64) // 4)))
        c, log = np.zeros((2, told.num_rows))
        number = told.column("number").to_numpy()
        c[number], log[number] = told.column("c").to_numpy(), told.column("log").to_numpy()
        base = lambda n: np.log10((n + BASE_ADDED) / (total + BASE_ADDED * (kinds + 1)))
        n = np.diff(begin) + 1
        known = _sums((c > 0).astype(np.int64)[data], begin) + (texts > 0)
        return pa.table({
            "doc_id": rows.column("doc_id"), "learned": rows.column("learn"), "n_tokens": pa.array(n), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(n), total, dtype=np.int64)),
            "base_score": pa.array(_sums(base(c)[data], begin) + base(float(texts))), "score": pa.array((_sums(log[data], begin) + model.end) / math.log(10)),
        })

    return run


def score_documents(docs: DataFrame, vocabulary: Model, learn_from: Column, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text, ...): doc_id, learned, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are the words between ASCII white space, A-Z as a-z, and one end. ``learn_from`` says which
    rows are learned from (a null: not). base_score is the sum of log10 of (count + 0.1) out of
    (N + 0.1 * (V + 1)) over the tokens; score is the model's log10 probability of the same tokens by
    the lattice. A null or empty text is its end alone. Rows are told apart by where they stand, not by
    doc_id, so null and repeated ids keep their own scores. Other columns are ignored. Without rows to
    learn from, the vocabulary's own scores are the model and every token of the base has equal weight.

    Texts are cut once, into blocks whose distinct words alone are shuffled to be counted and scored;
    the answers meet a block's rows again, as numbers. A frequent word is one row a block, and no word
    list is ever broadcast or held whole in a task; only the vocabulary's expected counts are.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(learn_from, F.lit(False)).alias("learn"))
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

    schema = StructType([StructField(n, t) for n, t in (("block", LongType()), ("doc_id", kind), ("learn", BooleanType()), ("tokens", BinaryType()), ("word", StringType()), ("number", IntegerType()), ("n", LongType()))])
    path = shared_path(spark, "blocks")
    map_batches(rows, _cut(block_bytes, to_arrow_type(kind)), schema).write.parquet(path)
    cut = lambda: spark.read.schema(schema).parquet(path)
    texts, words = cut().where("number is null").select("block", "doc_id", "learn", "tokens"), cut().where("number is not null").select("block", "number", "word", "n")
    counts = checkpointed(words.groupBy("word").agg(F.sum("n").alias("c")))
    sums = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count("*").alias("kinds")).first()
    learned = texts.where("learn").count()
    total, kinds = sums["total"] + learned, sums["kinds"] + (learned > 0)
    model = learn(counts.where("c > 0"), vocabulary, learned, rounds) if learned else vocabulary
    scored = counts.mapInArrow(_score_words(model), "word string, c long, log double")
    told = words.select("block", "number", "word").join(scored, "word").select("block", "number", "c", "log")
    result = StructType([StructField("doc_id", kind), *(StructField(n, t) for n, t in (("learned", BooleanType()), ("n_tokens", LongType()), ("n_known", LongType()), ("train_tokens", LongType()))), *StructType.fromDDL("base_score double, score double").fields])
    return texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_score_rows(model, total, kinds, learned), result)
