"""Rows that can't be told apart, columns of any name, samples without ids, and markup of every form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewright.llm import langid, linededup, neardup, quality, sharding, urlfilter


@pytest.mark.parametrize("part_rows", [2_000_000, 100])
def test_equal_rows_spread_over_all_shards(spark, monkeypatch, part_rows):
    monkeypatch.setattr(sharding, "PART_ROWS", part_rows)
    rows = [(None, "the same text") for _ in range(3000)] + [(k, f"other {k:03d}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard(df, F.octet_length("text") + 8, F.xxhash64("text"), F.col("doc_id"), shards=24).toPandas()
    sizes = got.text.str.len().add(8).groupby(got.shard).sum()
    share = sizes.sum() / 24
    assert len(got) == 3600 and len(sizes) == 24 and sizes.max() - sizes.min() <= 2 * (0.002 * share + 21)
    assert (got[got.doc_id.isna()].groupby("shard").size() > 0).sum() >= 18
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_one_row_larger_than_a_share_is_not_cut(spark):
    df = spark.createDataFrame([(1, "x" * 100_000), (2, "a"), (3, "b")], "doc_id long, text string")
    got = sharding.shard(df, F.octet_length("text"), F.xxhash64("text"), F.col("doc_id"), shards=4)
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2, 3]


NAMES = ["_h", "_i", "_size", "_p", "_nd_id", "_nd_th", "_id", "_th", "_gone", "th", "key", "h", "g"]


def named(spark, texts):
    df = spark.createDataFrame([(k, t, f"site{k}") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    return df.select("*", *[F.concat(F.lit(n), "doc_id").alias(n) for n in NAMES])


@pytest.mark.parametrize("limit", [500_000, 0])
def test_columns_of_any_name_stay(spark, limit):
    texts = ["a shared line\nown " + str(k) for k in range(9)]
    df = named(spark, texts)

    def intact(out, n):
        got = out.select("doc_id", *NAMES).collect()
        assert len(got) == n and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in NAMES)

    intact(sharding.shard(df, F.octet_length("text"), F.xxhash64("text"), F.col("doc_id"), shards=3), 9)
    intact(linededup.remove_boilerplate(df, 8, broadcast_lines=limit), 9)
    intact(neardup.drop_near_duplicates(named(spark, ["one two three four five six"] * 4 + ["another text altogether, of other words"]), broadcast_ids=limit), 2)
    intact(quality.keep_good(df, base=quality.base_rule(1, 100), rules=[]), 9)


def test_lines_in_place_equal_lines_by_join(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k) if k % 7 else None, "\n".join(f"line {rng.integers(40)}" if rng.random() < 0.7 else f" {k} own " for _ in range(12)), f"s{k % 30}") for k in range(200)]
    df = spark.createDataFrame(rows + rows[:20], "doc_id long, text string, source string")
    a, b = (sorted(map(str, linededup.remove_boilerplate(df, 8, broadcast_lines=n).collect())) for n in (500_000, 0))
    assert a == b and len(a) == 220


def test_rules_are_measured_without_ids_and_on_one_repeated_text(spark):
    text = F.when(F.col("id") % 3 > 0, "the very same words again and again").otherwise(F.concat(F.lit("words of number "), "id"))
    docs = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"))
    measured = quality.measure_rules(docs, quality.default_rules(), sample_rows=500)
    assert set(measured) == {r.name for r in quality.default_rules()}
    assert all(0 <= share <= 1 and seconds > 0 for seconds, share in measured.values())


def test_dictionaries_do_not_depend_on_ids(spark):
    rows = [(k, f"text {chr(97 + k % 26)} of some words " + "und so weiter " * (k % 9), "de") for k in range(300)] + [(1001, None, "fr"), (1002, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.learn_dictionaries(docs, sample_docs=50, dictionary_bytes=1500)
    assert set(got) == {"de"} and got == langid.learn_dictionaries(docs.withColumn("doc_id", F.lit(None).cast("long")).repartition(3), sample_docs=50, dictionary_bytes=1500)


TAGS = [
        ('<!-- <link rel="canonical" href="/c"> -->', None), ("<!-- <link rel=canonical href=/c>", None), ('<script>var a = \'<link rel="canonical" href="/c">\'</script>', None), ('<!-- x --><link rel="canonical" href="/c"><!-- y -->', "h.net/c"),
        ('<link data-rel="canonical" href="/c">', None), ('<link rel="canonical" data-href="/no" href="/c">', "h.net/c"), ('<link rel="alternate canonical" href="/c">', "h.net/c"), ('<link rel="canonicals" href="/c">', None),
        ('<base href="http://k.net/x/y"><link rel=canonical href=c>', "k.net/x/c"), ('<base target=_top><base href="/d/"><base href="/e/"><link rel=canonical href=c>', "h.net/d/c"),
        ('<link rel="canonical" href="/a b">', "h.net/a b"), ('<link rel="canonical" href="http&#58;//k.net/c?a=1&amp;b=2">', "k.net/c?a=1&b=2"), ('<link rel="canonical" href="/&#xe9;&#x1F600;&#0;&#99999999;">', "h.net/é\U0001f600�&"),
        ('<LINK HREF = \'/c\' REL = Canonical >', "h.net/c"), ('<link title="a > b" rel="canonical" href="/c"/>', "h.net/c"), ("<link rel=canonical href=/c?q='>", "h.net/c?q='"), ('<links rel="canonical" href="/c">', None), ('<a rel="canonical" href="/c">', None),
        ('<meta http-equiv="Refresh" content="5; URL=\'/c\'">', "h.net/c"), ('<meta http-equiv=refresh content="0;url=/c d">', "h.net/c d"), ('<meta http-equiv=refresh content="30">', None), ('<meta name="x" content="0; url=/c" data-http-equiv="refresh">', None), ("<link rel=canonical " + "x=1 " * 3000 + "href=/c>", "h.net/c"), (None, None), ("", None),
]


def test_tags_of_every_form(spark):
    pages = spark.createDataFrame([(f"http://h.net/a/{k}", html) for k, (html, _) in enumerate(TAGS)], "url string, html string")
    got = {r["src"]: r["dst"] for r in urlfilter.alias_edges(pages).collect()}
    assert got == {f"h.net/a/{k}": node for k, (_, node) in enumerate(TAGS) if node}
