"""Tokens, token files, packing and sharding: exact round trips and the laws of their results."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaugewright.llm import packing, sharding, tokenfiles
from gaugewright.llm.repair import Block, compress, encode_block
from gaugewright.llm.tokens import Encoder, with_end

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = ["", "'s", "it's 'start I'M we're they'll'd ' 's\n's", " a\n\n b \n", "x  ", "  'll", "'", "''s", "!'s", "a'", "d'été L'OR 12 345½²", "日本 text", "<|endoftext|> hi", "’s “q” €5", "tab\tx\r\n\ry", "İstanbul ſ Ÿ", "\x0b\x0cz", "a\xa0b", "n't can't'", "\U0001f600", "é", "x" * 4000, "wordword " * 900]


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    path = public_tokenizers.path(request.param)
    return Encoder(path), Tokenizer.from_file(path)


def same(pair, texts):
    ids, begin = pair[0].encode(texts)
    want = [x.ids for x in pair[1].encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == want


def test_odd_texts(pair):
    assert pair[0].kind
    same(pair, ODD)
    same(pair, [])
    same(pair, ODD[::-1])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet=" '\nstremvlda.1é2,", max_size=30)), max_size=6))
def test_any_texts(pair, texts):
    same(pair, [t.encode("utf-8", "ignore").decode() for t in texts])


def test_memory_starts_again(pair, monkeypatch):
    monkeypatch.setattr("gaugewright.llm.tokens.MEMORY_PIECES", 300)
    rng = random.Random(1)
    for _ in range(4):
        same(pair, [" ".join("".join(rng.choices("abcdef", k=4)) for _ in range(100)) for _ in range(3)])


def test_other_tokenizers_are_used_plainly(tmp_path):
    tool = Tokenizer.from_file(public_tokenizers.path(FILES[1]))
    from tokenizers import normalizers

    tool.normalizer = normalizers.Lowercase()
    tool.save(str(tmp_path / "t.json"))
    own = Encoder(str(tmp_path / "t.json"))
    assert own.kind is None
    same((own, tool), ODD)


ids_lists = st.lists(st.lists(st.integers(0, 6), max_size=60), min_size=1, max_size=6)


@settings(max_examples=120, deadline=None)
@given(ids_lists, st.data())
def test_blocks_round_trip(docs, data):
    docs = [np.array([*d, 2], dtype=np.uint32) for d in docs]
    names = [None if i == 1 else i - 3 for i in range(len(docs))]
    block = Block(encode_block(names, np.array([len(d) for d in docs]), np.concatenate(docs))[0])
    assert block.doc_ids == names and block.ids().tolist() == np.concatenate(docs).tolist()
    i = data.draw(st.integers(0, len(docs) - 1))
    a, b = sorted(data.draw(st.tuples(st.integers(0, len(docs[i])), st.integers(0, len(docs[i])))))
    assert block.document(i, a, b).tolist() == docs[i][a:b].tolist()
    assert block.document(i).tolist() == docs[i].tolist()


def test_frequent_pairs_become_rules():
    ids = np.array([5, 7, 9] * 400 + [3] * 101 + [2], dtype=np.uint32)
    symbols, _, left, right, rounds, terminals = compress(ids, np.array([len(ids)]))
    assert len(symbols) < len(ids) / 8 and sum(rounds) == len(left) == len(right)
    assert terminals == 10
    with pytest.raises(ValueError):
        Block(b"none" + bytes(40))


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


@pytest.fixture(scope="module")
def texts(spark):
    some = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    return ODD + [None] + some + [some[0]] * 5 + [" ".join(some)]


def test_token_files_round_trip(spark, texts, tmp_path):
    path, tool = str(tmp_path / "f"), Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    rng = random.Random(2)
    names = rng.sample(range(-500, 500), len(texts))
    tokenfiles.write_token_files(frame(spark, texts, names).repartition(3), path, public_tokenizers.path(FILES[0]), 2, block_ids=500, shards=4)
    got = tokenfiles.read_token_files(spark, path).orderBy("doc_id").collect()
    start = 0
    for r, (name, text) in zip(got, sorted(zip(names, texts, strict=True), key=lambda x: x[0]), strict=True):
        want = [*tool.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (name, start, len(want))
        assert np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist() == want
        start += len(want)


def test_token_files_of_nothing_and_of_repeated_rows(spark, tmp_path):
    tokenizer = public_tokenizers.path(FILES[0])
    tokenfiles.write_token_files(frame(spark, []), str(tmp_path / "a"), tokenizer)
    assert tokenfiles.read_token_files(spark, str(tmp_path / "a")).count() == 0
    tokenfiles.write_token_files(frame(spark, ["a b", "a b", None], [1, 1, None]), str(tmp_path / "b"), tokenizer)
    got = [(r["doc_id"], r["start"], r["n_tokens"]) for r in tokenfiles.read_token_files(spark, str(tmp_path / "b")).orderBy("start").collect()]
    assert got == [(None, 0, 1), (1, 1, 3), (1, 4, 3)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=40), st.integers(1, 8))
def test_differencing_places_every_weight(weights, k):
    window, sums = packing.difference(np.array(weights), k)
    assert window.min() >= 0 and window.max() < k and sums.sum() == sum(weights)
    assert sums.max() - sums.min() <= max(weights)
    window, k = packing.windows_for(np.array(weights), 100)
    assert np.bincount(window, weights=weights).max() <= 100 and k >= -(-sum(weights) // 100)


def test_packing(spark, texts):
    tool = Tokenizer.from_file(public_tokenizers.path(FILES[1]))
    got = packing.pack_documents(frame(spark, texts).repartition(2), public_tokenizers.path(FILES[1]), 0, 128, piece=32, group=8).toPandas()
    for i, text in enumerate(texts):
        want = np.array([*tool.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = got[got.doc_id == i].sort_values("start")
        assert (own.doc_tokens == len(want)).all() and own.length.sum() == len(want)
        assert b"".join(map(bytes, own.ids)) == want.tobytes() and own.start.tolist() == (own.length.cumsum() - own.length).tolist()
    by = got.sort_values(["sequence_id", "offset"])
    assert (by.groupby("sequence_id").length.cumsum() - by.length == by.offset).all()
    full = by.groupby("sequence_id").length.sum()
    assert full.max() <= 128 and full.sum() / (128 * len(full)) > 0.95
    assert packing.pack_documents(frame(spark, []), public_tokenizers.path(FILES[1])).count() == 0


def test_with_end():
    ids, begin = with_end(np.array([1, 2, 3], dtype=np.uint32), np.array([0, 2, 2, 3]), 9)
    assert ids.tolist() == [1, 2, 9, 9, 3, 9] and begin.tolist() == [0, 3, 4, 6]


def deal(spark, rows, monkeypatch=None, shards=6, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    text = F.coalesce("text", F.lit(""))
    return sharding.shard(df, F.octet_length(text) + 8, F.xxhash64(text), F.col("doc_id"), shards=shards, **options).toPandas()


def check_shards(got, rows, shards, slack):
    assert len(got) == len(rows)
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    sizes = got.assign(n=[len((t or "").encode()) + 8 for t in got.text]).groupby("shard").n.sum().reindex(range(shards), fill_value=0)
    assert sizes.max() - sizes.min() <= slack, sizes.tolist()


def test_shards_are_near_equal_and_keep_groups(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randrange(1, 60) + str(i // 3), None) for i in range(3000)]
    got = deal(spark, rows, tolerance=0.02)
    share = sum(len(r[1]) + 8 for r in rows) / 6
    check_shards(got, rows, 6, 2 * 0.02 * share + 300)
    assert (got.groupby("text").shard.nunique() == 1).all()


def test_a_hot_group_is_cut(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 100)
    rows = [(i, "hot" if i % 2 else f"cold {i}", "clash") for i in range(2000)]
    got = deal(spark, rows, tolerance=0.01)
    share = sum(len(r[1]) + 8 for r in rows) / 6
    check_shards(got, rows, 6, 2 * 0.01 * share + 60)
    assert got[got.text == "hot"].shard.nunique() >= 2


def test_shards_of_odd_tables(spark):
    assert len(deal(spark, [])) == 0
    rows = [(None, None, None), (1, None, None), (1, "", None), (2, "é" * 500, None), (2, "é" * 500, None)]
    got = deal(spark, rows)
    check_shards(got, rows, 6, 10**6)
    assert set(got.shard) <= set(range(6))


def test_a_hot_text_is_cut_evenly(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 100)
    rows = [(i, "hot" if i % 3 else f"cold {i}", None) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    keys = df.select(F.xxhash64("text").alias("_h"), F.col("doc_id").alias("_i"), F.lit(1).cast("long").alias("_size"))
    counts = [c[1] for c in sharding._histogram(keys, sharding.find_splitters(keys, 30, 0.25, 4))]
    assert max(counts) <= 150 and sum(counts) == 3000
    check_shards(deal(spark, rows), rows, 6, 400)


def test_very_many_boundaries_plan_and_place(spark):
    rng = random.Random(3)
    keys = sorted(rng.sample(range(1 << 40), 20_000))
    edges = [sharding._join(k >> 8, k & 255) for k in keys]
    place = sharding._placed(edges, [0] * 20_001, list(range(20_001)))
    probe = [rng.randrange(1 << 40) for _ in range(500)] + keys[:200]
    df = spark.createDataFrame([(k >> 8, k & 255, k) for k in probe], "h long, i long, k long")
    import bisect

    assert all(r["p"]["part"] == r["p"]["first"] == bisect.bisect_right(keys, r["k"]) for r in df.select("k", place(F.col("h"), F.col("i")).alias("p")).collect())


def test_one_token_documents_pack_in_bounded_memory():
    import tracemalloc

    packer = packing._Packer(0, 1024, 256, 256)
    ids, out = np.zeros(1, dtype=np.uint32), 0
    tracemalloc.start()
    for i in range(100_000):
        out += len(packer.add(i, ids))
    out += len(packer.flush())
    assert out == 100_000 and packer.next <= 102 and tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_packing_of_repeated_rows_and_null_ids(spark):
    got = packing.pack_documents(frame(spark, ["a b", "a b", None, "x " * 30_000], [1, 1, None, None]), public_tokenizers.path(FILES[1])).toPandas()
    assert got[got.doc_id == 1].length.sum() == 2 * got[got.doc_id == 1].doc_tokens.iloc[0] and got[got.doc_id.isna()].length.sum() == 1 + got.doc_tokens.max()


def test_compression_is_reported(spark, tmp_path):
    path = str(tmp_path / "r")
    tokenfiles.write_token_files(frame(spark, ["the same words again " * 50] * 40), path, public_tokenizers.path(FILES[0]), shards=2)
    rows = tokenfiles.compression(spark, path).collect()
    assert sum(r["n_tokens"] for r in rows) == tokenfiles.read_token_files(spark, path).groupBy().sum("n_tokens").first()[0] and all(r["ratio"] > 10 and r["n_rules"] > 0 for r in rows)
