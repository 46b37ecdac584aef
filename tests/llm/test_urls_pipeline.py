"""URL decisions, the pipeline's stages and the driver contract's guard."""

import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from gaugewright.llm import linededup, urlfilter
from gaugewright.llm.queries import QUERIES, URL_RULES
from gaugewright.llm.sql import ORACLES
from tests.llm.test_text_operators import ALNUM_WORDS, LOWER, brute_components, brute_kept, brute_lines
from tests.test_oracles import SF, duck, rows  # noqa: F401  a fixture

PAGES = [
    (0, "https://A.Example.ORG/es/1?x#y", None), (1, "http://example.org/en/12", ""), (2, "http://x.org/", "<p>"), (3, "http://x.org", None), (4, "https://shop.com/fr/1", None), (5, "https://com/de/", None), (6, None, None), (7, "no scheme", None),
    (8, "http://notorg/a", None), (9, "http://m.net/a", '<LINK rel="canonical" href="http://shop.com/de/9">'), (10, "http://other.net/b", "<meta http-equiv='refresh' content='0; url=http://m.net/a'>"),
    (11, "http://mixed.net/", '<link href="http://shop.com/de/7" rel=canonical><link rel=canonical href="http://fine.org/z">'), (12, "http://m.net/c", '<link rel="canonical" href="/a">'), (13, "http://m.net/a#top", None), (14, "http://free.net/", '<link rel="stylesheet" href="http://shop.com/de/7">'),
]


@pytest.mark.parametrize("chain", [64, 0])
def test_verdicts(spark, monkeypatch, chain):
    monkeypatch.setattr(urlfilter, "CHAIN_RULES", chain)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["by"]) for r in urlfilter.filter_urls(pages, URL_RULES).collect()}
    assert got == {
        0: ("a.example.org", "/es/1", "example.org/es/", "block", "rule"), 1: ("example.org", "/en/12", "example.org/en/1", "block", "rule"), 2: ("x.org", "/", "org/", "allow", "rule"), 3: ("x.org", "", None, "allow", "default"),
        4: ("shop.com", "/fr/1", "com/fr/", "allow", "rule"), 5: ("com", "/de/", "com/de/", "block", "rule"), 6: ("", "", None, "allow", "default"), 7: ("", "", None, "allow", "default"), 8: ("notorg", "/a", None, "allow", "default"),
        9: ("m.net", "/a", None, "block", "alias"), 10: ("other.net", "/b", None, "block", "alias"), 11: ("mixed.net", "/", None, "allow", "alias"), 12: ("m.net", "/c", None, "block", "alias"), 13: ("m.net", "/a", None, "block", "alias"), 14: ("free.net", "/", None, "allow", "default"),
    }


@pytest.mark.parametrize(
    "url,target,node",
    [
        ("http://H.net/a/b/p.html?q=1", "page2.html", "h.net/a/b/page2.html"), ("http://h.net/a/b/p", "../c", "h.net/a/c"), ("http://h.net/a/b/p", "./x", "h.net/a/b/x"), ("http://h.net/a/b/p?i=1", "?id=3", "h.net/a/b/p?id=3"),
        ("http://h.net", "?id=3", "h.net/?id=3"), ("http://h.net", "x", "h.net/x"), ("http://h.net/a", "../../x?u=/../y#z", "h.net/x?u=/../y"), ("http://h.net/a/b/", "..", "h.net/a/"), ("http://h.net/a/b/c", ".", "h.net/a/b/"),
        ("http://h.net/a", "/b/./c/../d", "h.net/b/d"), ("http://h.net/a", "//k.net/../e", "k.net/e"), ("http://h.net/a", "https://k.net", "k.net/"), ("http://h.net/a", "https://k.net/f//../g/..", "k.net/f/"), ("http://h.net/a/..b/c", ".d", "h.net/a/..b/.d"),
        ("http://h.net/a", "#top", None), ("http://h.net/a", "mailto:x@y.net", None), ("http://h.net/x/../a", "b:c/d", None), ("http://h.net/x/../a", "b", "h.net/b"),
    ],
)
def test_links_of_every_form(spark, url, target, node):
    pages = spark.createDataFrame([(url, f'<link rel="canonical" href="{target}">'), (url, f"<meta http-equiv=refresh content='0; url={target}'>")], "url string, html string")
    found = urlfilter.alias_edges(pages).collect()
    assert [r["dst"] for r in found] == ([node] * 2 if node else [])


def test_relative_links_and_bare_hosts_spread_verdicts(spark):
    pages = [(1, "http://shop.com/de/x/1", '<link rel="canonical" href="../../z">'), (2, "http://shop.com/z", None), (3, "http://m.net", None), (4, "http://n.net/a", '<link rel="canonical" href="http://m.net/">'), (5, "http://m.net/./b/..", '<link rel="canonical" href="http://shop.com/de/9">')]
    got = {r["page_id"]: (r["verdict"], r["by"]) for r in urlfilter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()}
    assert got == {1: ("block", "rule"), 2: ("block", "alias"), 3: ("block", "alias"), 4: ("block", "alias"), 5: ("block", "alias")}


TIED = [("allow", "org", "/xy"), ("block", "b.org", "/"), ("block", "a.net", "/q"), ("allow", "a.net", "/q"), ("block", "c.net", "/ab"), ("block", "x.c.net", "/")]


@pytest.mark.parametrize("chain", [64, 0])
def test_rules_of_equal_length_and_repeated_pages(spark, monkeypatch, chain):
    monkeypatch.setattr(urlfilter, "CHAIN_RULES", chain)
    rows_ = [(1, "http://b.org/xy", None), (2, "http://a.net/q", None), (3, "http://x.c.net/ab", None), (1, "http://b.org/xy", None), (None, "http://b.org/z" + "z" * 100_000, None), (1, "http://free.com/", None)]
    got = [(r["page_id"], r["rule"], r["verdict"]) for r in urlfilter.filter_urls(spark.createDataFrame(rows_, "page_id long, url string, html string"), TIED).collect()]
    want = [(1, "org/xy", "allow"), (2, "a.net/q", "allow"), (3, "x.c.net/", "block"), (1, "org/xy", "allow"), (None, "b.org/", "block"), (1, None, "allow")]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_redirect_table_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", None, "clash")], "page_id long, url string, html string, verdict string")
    redirects = spark.createDataFrame([("http://a.net/", "http://b.net/"), ("http://b.net/", "https://shop.com/de/1"), (None, "http://b.net/")], "src string, dst string")
    assert urlfilter.filter_urls(pages, URL_RULES, redirects).first()["verdict"] == "block"
    assert urlfilter.filter_urls(pages.limit(0), URL_RULES).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLES[name]).df())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, left = docs.count(), docs
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SF)
        assert left.columns == corpus_pipeline.COLUMNS, name
        now = left.count()
        assert 0 < now <= n
        n = now
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in left.select("doc_id").collect()}


def test_pipeline_on_odd_documents(spark):
    good = " ".join(f"word{i}" for i in range(40))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    near = good.replace("word39", "x")
    rows_ = [(1, good, "en", "a", 1), (2, good, "en", "b", 1), (3, None, None, None, None), (4, "# " * 30, "en", "a", 1), (5, near, None, "c", 1), (6, " ".join(f"other{i}" for i in range(30)) + "\n" + bench, "en", "d", 1), (7, " ".join(f"third{i}" for i in range(30)), "en", "d", 1), (None, near + " tail", "en", None, 1), (7, " ".join(f"fourth{i}" for i in range(30)), None, "d", 1)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 7, 7]


def test_pipeline_keeps_clean_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, SF).select("doc_id").withColumn("kept", F.lit(True))
    share = {r["quality"]: r["s"] for r in labels.join(docs, "doc_id", "left_semi").join(kept, "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(False)).cast("int")).alias("s")).collect()}
    assert share[1] > 0.95 and share[0] < 0.02


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def brute_pipeline(docs, bench):
    """doc_id -> text of what the four filtering stages leave, by plain loops."""
    left = [(i, t, s) for i, t, s in docs if brute_kept(t, 3, 50, 50)]
    lines = brute_lines(left, linededup.MIN_SITES)
    left = [(i, lines[i][2], s) for i, _, s in left if not lines[i][1] or re.search(r"[^ \t\n\r]", lines[i][2])]
    found = brute_components([t for _, t, _ in left], 80)
    left = [(i, t) for k, (i, t, _) in enumerate(left) if found[k][1] == k]
    return {i: t for i, t in left if not brute_hit(t, bench)}


def brute_hit(text, windows, size=10):
    words = ALNUM_WORDS.findall((text or "").translate(LOWER))
    grams = {tuple(words[i : i + k]) for k in range(1, size + 1) for i in range(len(words) - k + 1)}
    return bool(grams & windows)


def test_pipeline_against_brute_force(spark):
    docs = sorted((r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = ALNUM_WORDS.findall((r["text"] or "").translate(LOWER))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    want = brute_pipeline(docs, windows)
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packed(corpus_pipeline.run(spark, SF).toPandas(), {i: [*tool.encode(t or "", add_special_tokens=False).ids, 0] for i, t in want.items()}, 1024)


def check_packed(got, want, capacity):
    """Every id lies in one piece, pieces give the documents, sequences have no gaps and little padding."""
    assert set(got.doc_id) == set(want)
    for i, own in got.sort_values("start").groupby("doc_id"):
        ids, at = want[i], 0
        for r in own.itertuples():
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    by = got.sort_values(["sequence_id", "offset"])
    assert (by.groupby("sequence_id").length.cumsum() - by.length == by.offset).all()
    full = by.groupby("sequence_id").length.sum()
    assert full.max() <= capacity and full.sum() / (capacity * len(full)) > 0.95


def documents(spark):
    return {r["doc_id"]: (r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op2_query(spark):
    docs = documents(spark)
    got = {r["doc_id"]: r for r in QUERIES["op2_language_id"](spark, SF).collect()}
    assert set(got) == set(docs) and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    langs = {x for _, x in docs.values() if x}
    assert all(r["lang_pred"] in langs if regex.search(r"\p{L}", docs[i][0] or "") else r["lang_pred"] == "und" for i, r in got.items()) and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i, r in got.items() if r["held_out"] and docs[i][1]]
    assert sum(got[i]["lang_pred"] == docs[i][1] for i in held) / len(held) > 0.9


def test_op3_query(spark):
    tool, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got, docs = {r["doc_id"]: r for r in QUERIES["op3_token_files"](spark, SF).collect()}, documents(spark)
    assert len(got) == len(docs)
    for i in sorted(docs):
        ids = np.array([*tool.encode(docs[i][0] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op4_query(spark):
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packed(QUERIES["op4_pack_sequences"](spark, SF).toPandas(), {i: [*tool.encode(t or "", add_special_tokens=False).ids, 0] for i, (t, _) in documents(spark).items()}, 1024)


def test_op5_query(spark):
    docs, got = documents(spark), QUERIES["op5_shard_by_bytes"](spark, SF).toPandas()
    assert set(got.doc_id) == set(docs) and len(got) == len(docs) and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    for r in got.itertuples():
        data = (docs[r.doc_id][0] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
    sums = got.groupby("shard")["size"].sum().reindex(range(24), fill_value=0)
    assert abs(sums - got["size"].sum() / 24).max() <= 0.002 * got["size"].sum() / 24 + got["size"].max()
    assert all(sorted(own.slot) == list(range(len(own))) for _, own in got.groupby("shard"))


def test_pipeline_removes_short_boilerplate(spark):
    footer = "版权所有不得转载" * 8
    rows_ = [(i, f"own text number {i}\nLes.\n{footer}\n\nonly {i % 3}", "en", f"s{i}", 1) for i in range(9)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()}
    assert got == {i: rows_[i][1] if i == 0 else f"own text number {i}\n\nonly {i % 3}" for i in range(9)}


def test_entry_works_without_the_subpackage(monkeypatch):
    assert "pipeline" in entry.queries()
    monkeypatch.setitem(sys.modules, "gaugewright.llm.queries", None)
    assert entry.queries() and not any(n.startswith("op") and n[2].isdigit() for n in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
