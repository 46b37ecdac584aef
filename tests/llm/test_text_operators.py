"""Quality, decontamination, line dedup, near duplicates, licenses and languages against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugewright.llm import decontam, langid, licenses, linededup, neardup, quality
from gaugewright.llm.words import ASCII_NOT_ALNUM, ASCII_SPACE, chunks, shingles, span_hashes, spans, text_buffer

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \n\t ", "one", "ONE two\x0bthree\x0cfour", "é è　x y\xa0z", "日本 語 テキスト", "a b c d e f", "A b C d e f", "#*$ %&| <>", "\n\nline\nline\n line \n", "x" * 5000, "w " * 3000, "\U0001f600 ok"]


def frame(spark, texts, **more):
    rows = [(i, t, *[v[i] for v in more.values()]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {k} string" for k in more))


def prose(rng, words):
    return " ".join(rng.choice(VOCABULARY) for _ in range(words))


VOCABULARY = ["".join(random.Random(i).choices("abcdefghijklmnoprstuvwz", k=4 + i % 5)) for i in range(800)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet=" \n\ta#é日", max_size=20)), max_size=8), st.integers(1, 60))
def test_spans_are_those_of_the_patterns(texts, limit):
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    seen = 0
    for a, b, part, begin in chunks(data, offsets, limit):
        for separator, pattern in ((ASCII_SPACE, SPACE_WORDS), (ASCII_NOT_ALNUM, ALNUM_WORDS)):
            starts, ends, first = spans(part, begin, separator)
            for i in range(b - a):
                words = [bytes(part[s:e]).decode().translate(LOWER) for s, e in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)]
                assert words == pattern.findall((texts[a + i] or "").translate(LOWER))
        seen += b - a
    assert seen == len(texts)


def test_equal_spans_have_equal_hashes_wherever_they_lie():
    data, offsets = text_buffer(pa.array(["ab AB ab", "xx ab", "ba"]))
    starts, ends, first = spans(data, offsets, ASCII_SPACE)
    h = span_hashes(data, starts, ends)
    assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 4
    assert len(set(span_hashes(data, starts, ends, fold_case=True).tolist())) == 3
    runs, begin = shingles(h, first, 2)
    assert np.diff(begin).tolist() == [2, 1, 1]


def brute_quality(text):
    t = text or ""
    w = SPACE_WORDS.findall(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, hit = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            hit |= set(range(i, i + 5))
    lines = [x for x in t.split("\n") if SPACE_WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def brute_kept(text, min_words=10, repeat_percent=20, dup_percent=30):
    n, chars, symbols, dups, repeats = brute_quality(text)
    w, t = SPACE_WORDS.findall(text or ""), text or ""
    lines = [x for x in t.split("\n") if SPACE_WORDS.search(x)]
    if n < min_words or 100 * repeats > repeat_percent * n or 10 * symbols > n or 100 * dups > dup_percent * len(lines):
        return False
    if 10 * sum(a == b for a, b in zip(w, w[1:])) > 3 * n or not 2 * n <= chars <= 14 * n:
        return False
    if 10 * sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", x)) for x in w) < 6 * n:
        return False
    return 10 * sum(x.lstrip(" \t\r\x0b\x0c")[0] in "-*+•" for x in lines) <= 9 * len(lines)


def test_quality_against_brute_force(spark):
    rng = random.Random(3)
    texts = ODD + [prose(rng, n) for n in (9, 10, 50, 200)] + ["\n".join([prose(rng, 12)] * 3 + [prose(rng, 12)]), "\n".join("- " + prose(rng, 6) for _ in range(5)), "\n".join("• " + prose(rng, 6) for _ in range(5))]
    texts += [" ".join(w for w in prose(rng, 40).split() for _ in range(2)), prose(rng, 40).replace(" ", " # "), "1 2 3 4 5 6 7 8 9 10 11 12"]
    got = {r["doc_id"]: r for r in quality.judge(frame(spark, texts, kept=["clash"] * len(texts))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_quality(t), repr(t)[:80]
        assert r["kept"] == brute_kept(t), repr(t)[:80]
    assert quality.judge(frame(spark, [])).count() == 0
    left = quality.keep_good(frame(spark, texts, kept=texts))
    assert left.columns == ["doc_id", "text", "kept"] and {r["doc_id"] for r in left.collect()} == {i for i in got if got[i]["kept"]}


def test_indented_bullets(spark):
    rng = random.Random(9)
    texts = ["\n".join(indent + sign + " " + prose(rng, 6) for _ in range(5)) for indent in ("", "  ", "\t", " \t\r\x0b\x0c") for sign in "-*+•"] + ["\n".join("  a- " + prose(rng, 6) for _ in range(5))]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(frame(spark, texts)).collect()}
    assert got == {i: brute_kept(t) for i, t in enumerate(texts)} and sum(got.values()) == 1
    assert [r["doc_id"] for r in quality.keep_good(frame(spark, texts)).collect()] == [len(texts) - 1]


def test_cascade_order_changes_cost_not_verdict():
    data, offsets = text_buffer(pa.array(ODD + ["# " * 30, "word " * 30, "a b c d e f g h i j k l m n"]))
    rules = quality.default_rules()
    first = quality.cascade(quality.Texts(data, offsets), rules) < 0
    for k in range(len(rules)):
        turned = quality.cascade(quality.Texts(data, offsets), rules[k:] + rules[:k]) < 0
        assert (turned == first).all()
    seen = []
    spy = quality.Rule("spy", lambda t: (seen.append(len(t)), np.zeros(len(t), dtype=bool))[1])
    quality.cascade(quality.Texts(data, offsets), [quality.Rule("all", lambda t: np.ones(len(t), dtype=bool)), spy])
    assert seen == []  # nothing was left for it
    a, b = quality.Rule("a", None), quality.Rule("b", None)
    assert quality.order_rules([a, b], {"a": (1.0, 0.1), "b": (0.1, 0.1)}) == [b, a]


def brute_contamination(text, items, size=10):
    w = ALNUM_WORDS.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        iw = ALNUM_WORDS.findall((t or "").translate(LOWER))
        for k in range(max(1, len(iw) - size + 1) if iw else 0):
            window = iw[k : k + size]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("automaton_bytes", [1 << 20, 300])
def test_contamination_against_brute_force(spark, automaton_bytes):
    rng = random.Random(5)
    items = [(1, prose(rng, 30)), (2, prose(rng, 10)), (3, "Short One!"), (4, None), (5, "..."), (6, "Éé 日本 q"), (20, "short one")]
    items.append((7, items[0][1]))
    texts = ODD + [prose(rng, 50), "x " + items[0][1].upper() + " y", "...".join(items[0][1].split()[3:15]), " ".join(items[1][1].split()[:9]), "a short, ONE short one", prose(rng, 20) + " éÉ", "zz Éé, 日本;q! " + items[1][1] + " " + items[1][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.find_contamination(frame(spark, texts), bench, automaton_bytes=automaton_bytes).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == brute_contamination(t, items), repr(t)[:90]
        under = " ".join(t[s["start"] : s["end"]] for s in got[i]["spans"]) if t else ""
        assert len(ALNUM_WORDS.findall(under.translate(LOWER))) == got[i]["n_hit"]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_contamination(frame(spark, texts), empty).where("n_hit > 0").count() == 0
    assert decontam.find_contamination(frame(spark, []), bench).count() == 0
    left = decontam.drop_contaminated(frame(spark, texts, n_hit=texts), bench, automaton_bytes=automaton_bytes)
    assert left.columns == ["doc_id", "text", "n_hit"] and {r["doc_id"] for r in left.collect()} == {i for i in got if not got[i]["n_hit"]}
    assert decontam.drop_contaminated(frame(spark, texts), empty).count() == len(texts)


@pytest.mark.parametrize("automaton_bytes", [1 << 20, 100])
def test_contamination_of_repeated_rows_and_items_without_id(spark, automaton_bytes):
    rng = random.Random(6)
    items = [(1, prose(rng, 15)), (2, prose(rng, 12)), (None, prose(rng, 14)), (None, "nameless short")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [(1, "x " + items[0][1]), (1, "clean one"), (1, None), (1, "clean one"), (None, items[1][1] + " " + items[0][1]), (None, "no hit"), (2, items[2][1]), (2, "a nameless short b")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontam.find_contamination(docs, bench, automaton_bytes=automaton_bytes).collect()]
    want = [(i, *brute_contamination(t, items)) for i, t in texts]
    assert sorted(map(str, got)) == sorted(str((i, n, hit, [x for x in found if x is not None])) for i, n, hit, found in want)
    left = decontam.drop_contaminated(docs, bench, automaton_bytes=automaton_bytes).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in left))) == sorted(str(x) for x, w in zip(texts, want, strict=True) if not w[2])


def brute_lines(docs, min_sites, min_words=1):
    sites, first = collections.defaultdict(set), {}
    trim = " \t\r\x0b\x0c"
    real = lambda x: len(x.strip(trim).split()) >= min_words
    for i, t, s in docs:
        for p, line in enumerate((t or "").split("\n") if t is not None else []):
            if real(line):
                key = line.strip(trim)
                if s is not None:
                    sites[key].add(s)
                first.setdefault(key, (i, p))
    out = {}
    for i, t, _ in docs:
        lines = t.split("\n") if t is not None else []
        gone = [p for p, x in enumerate(lines) if real(x) and len(sites[x.strip(trim)]) >= min_sites and first[x.strip(trim)] != (i, p)]
        out[i] = (len(lines), len(gone), None if t is None else t if not gone else "\n".join(x for p, x in enumerate(lines) if p not in gone))
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(7)
    common, rare = "Share this page with friends", "seen on few sites only"
    texts, sources = [None, "", "\n\n", "one line"], ["s1", "s2", "s3", None]
    for i in range(60):
        lines = [prose(rng, 8) for _ in range(rng.randrange(1, 5))]
        lines.insert(rng.randrange(len(lines) + 1), rng.choice([common, "  " + common + "\t", rare if i % 20 < 7 else common, "ok"]))
        texts.append("\n".join(lines))
        sources.append(rng.choice([None, f"s{i % 20}", "s0", "s0"]) if i % 3 else f"s{i % 20}")
    docs = list(zip(range(len(texts)), texts, sources, strict=True))
    for min_sites, min_words, limit in ((3, 1, 10**6), (8, 1, 10**6), (8, 1, 0), (3, 3, 0)):
        got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in linededup.remove_boilerplate(frame(spark, texts, source=sources, n_lines=["clash"] * len(texts)), min_sites, min_words=min_words, broadcast_lines=limit).collect()}
        assert got == brute_lines(docs, min_sites, min_words)
    assert linededup.remove_boilerplate(frame(spark, [], source=[])).count() == 0


def brute_components(texts, numerator=85, denominator=100, k=5):
    sets = []
    for t in texts:
        w = SPACE_WORDS.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and denominator * both >= numerator * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near_copies(rng, n, words, changes):
    base = prose(rng, words).split()
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(changes + 1)):
            own[rng.randrange(len(own))] = rng.choice(VOCABULARY)
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block_docs,broadcast_ids", [(1024, 10**6), (7, 0)])
def test_near_duplicates_against_brute_force(spark, block_docs, broadcast_ids):
    rng = random.Random(11)
    texts = ODD + [prose(rng, rng.randrange(3, 80)) for _ in range(40)] + near_copies(rng, 40, 150, 4) + near_copies(rng, 25, 60, 1)
    texts += [texts[30], texts[30].upper(), texts[-1]] + ["same same same same same same"] * 30 + [" ".join(VOCABULARY[:500])] * 2
    rng.shuffle(texts)
    docs = frame(spark, texts, kept=["clash"] * len(texts))
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs, block_docs=block_docs, broadcast_ids=broadcast_ids).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(texts)
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    twice = frame(spark, ["a b c d e f g", None]).union(frame(spark, ["a b c d e f g", None]))
    assert [r["kept"] for r in neardup.near_duplicates(twice).collect()] == [True] * 4
    assert neardup.drop_near_duplicates(twice).count() == 2
    assert neardup.drop_near_duplicates(frame(spark, ["a b c d e f g", "x", "A b c d e f G"])).count() == 2


def test_signatures_keep_least_and_greatest():
    work = neardup._signatures(5, 2, 2)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "th": pa.array([7, 8], pa.int64()), "text": pa.array(["a b c d e f", None])})
    out = list(work(iter([batch])))[0].to_pydict()
    assert len(out["bands"][0]) == 2 and out["bands"][1] == [] and out["n_shingles"] == [2, 0]


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"][2]
    texts = [None, "", "Released under the MIT License.", "some prose here\nReleased under the mit license\nmore", "other words\n\n" + mit.replace(", ", ",\n") + "\n\nend of it", "This work is licensed under the GNU General Public License, version 3.", "the the the the the", "Released under the Foo License.", "unrelated words of no interest at all"]
    got = {r["doc_id"]: (r["license"], round(r["dice"], 3), r["n_licenses"]) for r in licenses.license_of_documents(frame(spark, texts, license=["clash"] * len(texts))).collect()}
    assert got[2] == ("MIT", 1.0, 1) and got[3] == ("MIT", 1.0, 1) and got[4][0] == "MIT" and got[5][:2] == ("GPL-3.0", 1.0)
    assert all(got[i] == (None, 0.0, 0) for i in (0, 1, 6, 7, 8))
    assert licenses.license_of_documents(frame(spark, [])).count() == 0
    assert licenses.license_of_documents(frame(spark, texts[:1])).count() == 1


def test_required_words():
    single, double = licenses.required_words(tuple(licenses.template_rows(licenses.TEMPLATES)), 0.8)
    assert "license" in single and not set(single) & licenses._COMMON and len(double) < 20
    for text, bigrams in (("a b c d e f g h i j", 9), ("licensed under nothing here", 3)):
        single, double = licenses.required_words(tuple(licenses.template_rows({"L": [text]})), 0.8)
        words = text.split()
        held = sum(bool({a, b} & set(single)) or f"{a} {b}" in double for a, b in zip(words, words[1:]))
        assert held > bigrams - bigrams * 0.8 / 1.2


def brute_licenses(text, templates, threshold):
    """(kind, pos) -> (license, dice) of a text's units."""
    plain = lambda t: re.sub("[^a-z0-9]+", " ", t).split()
    low = (text or "").lower()
    units = {("text", 0): low}
    for kind, pattern in (("paragraph", r"\n[ \t\r]*\n"), ("line", "\n"), ("sentence", r"[.!?;:][ \t\r\n]+|\n[ \t\r]*\n")):
        parts = re.split(pattern, low)
        units |= {(kind, i): x for i, x in enumerate(parts)} if len(parts) > 1 else {}
    out = {}
    for at, unit in units.items():
        own = collections.Counter(zip(plain(unit), plain(unit)[1:]))
        scores = []
        for name, wordings in templates.items():
            for wording in wordings:
                theirs = collections.Counter(zip(plain(wording.lower()), plain(wording.lower())[1:]))
                scores.append((-2 * (own & theirs).total() / (own.total() + theirs.total()), name) if own else (0, name))
        if (best := min(scores))[0] <= -threshold:
            out[at] = best[1], round(-best[0], 6)
    return out


def test_licenses_against_brute_force(spark):
    rng = random.Random(8)
    wordings = [w for ws in licenses.TEMPLATES.values() for w in ws]
    texts = list(ODD) + wordings
    for _ in range(150):
        words = rng.choice(wordings).split(" ")
        for _ in range(rng.randrange(0, 1 + len(words) // 6)):
            words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        gap = lambda: rng.choice(["\n", " ", "\n\n", ". ", " \n \t\n"])
        texts.append(prose(rng, rng.randrange(12)) + gap() + rng.choice([" ", "\n"]).join(words) + gap() + prose(rng, rng.randrange(12)) + gap() + rng.choice(wordings))
    texts += ["the text is long. Licensed under CC BY-NC 4.0. And more prose follows it here", "x " * 40_000 + "\nReleased under the MIT License.\n" + "y " * 40_000]
    got = collections.defaultdict(dict)
    for r in licenses.scan_licenses(frame(spark, texts)).collect():
        got[r["doc_id"]][r["kind"], r["pos"]] = r["license"], round(r["dice"], 6)
    for i, t in enumerate(texts):
        assert got[i] == brute_licenses(t, licenses.TEMPLATES, licenses.THRESHOLD), t[:200]
    assert got[len(texts) - 2]["sentence", 1] == ("CC-BY-NC-4.0", 1.0)


def test_licenses_are_judged_by_row(spark):
    half = "redistribute it and/or modify it under the terms of the GNU General Public License as published by"
    rows = [(1, half), (1, "This program is free software: you can " + "x " * 10), (1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "Licensed under CC0 1.0."), (None, None)]
    got = [(r["doc_id"], r["license"], r["dice"], r["n_licenses"]) for r in licenses.license_of_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, None, 0.0, 0), (1, None, 0.0, 0), (1, "MIT", 1.0, 1), (1, "MIT", 1.0, 1), (None, "CC0-1.0", 1.0, 1), (None, None, 0.0, 0)]))


def test_size_bounds_lose_no_match(spark):
    rng = random.Random(2)
    templates = {"L": ["a b c d e f g h i j", "k l m n"]}
    texts = [" ".join(rng.choice("abcdefghijklmn") for _ in range(rng.randrange(1, 14))) for _ in range(300)] + ["a b c d e f g h", "a b c d e f g h i j x y", "k l m n k"]
    for threshold in (0.6, 0.8):
        want = {i: found["text", 0][1] for i, t in enumerate(texts) if ("text", 0) in (found := brute_licenses(t, templates, threshold))}
        got = {r["doc_id"]: round(r["dice"], 6) for r in licenses.scan_licenses(frame(spark, texts), templates, threshold).where("kind = 'text'").collect()}
        assert got == want and want


def test_language_by_compression(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = langid.fold_of(F.col("doc_id"))
    dictionaries = langid.learn_dictionaries(docs.where(fold != 1))
    assert set(dictionaries) == {"de", "en", "es", "fr"} and all(len(d) <= langid.DICTIONARY_BYTES for d in dictionaries.values())
    assert dictionaries == langid.learn_dictionaries(docs.where(fold != 1).repartition(7))
    held = docs.where(fold == 1)
    found = langid.identify(held, dictionaries).join(held.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.97
    assert found.score.between(0, 1).all()
    sure = found[~found.rejected]
    assert (sure.lang_pred == sure.lang).mean() >= (found.lang_pred == found.lang).mean()
    odd = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in langid.identify(frame(spark, [None, "", "12 34 !?", "x"], lang=["de"] * 4), dictionaries).collect()}
    assert odd[0] == odd[1] == odd[2] == ("und", True) and odd[3][0] in dictionaries
    assert langid.identify(frame(spark, []), dictionaries).count() == 0
    assert langid.identify(frame(spark, ["hello"]), {}).first()["lang_pred"] == "und"


def test_languages_of_repeated_rows(spark):
    rows = [(1, f"der die das und nicht {i} {prose(random.Random(i), 5)}", "de") for i in range(400)] + [(2, "the and not of", "en")] * 50 + [(None, "le la les et des", "fr"), (3, None, "xx"), (4, "no label", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dictionaries = langid.learn_dictionaries(docs, sample_docs=20, dictionary_bytes=600)
    assert set(dictionaries) == {"de", "en", "fr"} and dictionaries["en"] == b"the and not of " and len(dictionaries["de"]) <= 600
    assert dictionaries["de"].count(b"der die das") == 20  # every chosen text has its share
    assert dictionaries == langid.learn_dictionaries(docs.repartition(5), sample_docs=20, dictionary_bytes=600)
    found = langid.identify(docs, dictionaries)
    assert found.count() == len(rows) and found.where("doc_id is null").first()["lang_pred"] == "fr"
    with pytest.raises(ValueError):
        langid.learn_dictionaries(docs, max_languages=2)


def test_language_ties_go_to_the_smaller_name(spark):
    same = {"b": b"one two three ", "a": b"one two three "}
    got = langid.identify(frame(spark, ["one two three", "w " * 100_000]), same).collect()
    assert [(r["lang_pred"], r["score"], r["rejected"]) for r in got] == [("a", 0.5, True)] * 2


def test_quality_of_repeated_rows_and_null_ids(spark):
    rng = random.Random(10)
    rows = [(1, prose(rng, 30)), (1, "too short"), (1, prose(rng, 30)), (None, prose(rng, 20)), (None, None), (2, "w " * 200_000), (2, prose(rng, 30_000))]
    rows += rows[:2]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_repeat_words"], r["kept"]) for r in quality.judge(docs).collect()]
    want = [(i, brute_quality(t)[0], brute_quality(t)[4], brute_kept(t)) for i, t in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert quality.keep_good(docs).count() == sum(w[3] for w in want)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_lines_of_repeated_rows_and_null_ids(spark, limit):
    common = "share this page"
    rows = [(5, f"{common}\nown line {i}", f"s{i}") for i in range(4)] + [(5, "a precious line only here\nand another", "s9"), (5, f"{common}\nown line 0", "s0"), (None, f"x\n {common} ", "s5"), (None, None, "s6"), (7, "\n" * 50_000 + common, "s7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(str((r["doc_id"], r["n_removed"], (r["text"] or "")[-30:])) for r in linededup.remove_boilerplate(docs, 3, broadcast_lines=limit).collect())
    # the first occurrence is that of the null id
    want = [(5, 1, f"own line {i}") for i in range(4)] + [(5, 0, "a precious line only here\nand another"[-30:]), (5, 1, "own line 0"), (None, 0, f"x\n {common} "), (None, 0, ""), (7, 1, "\n" * 30)]
    want[-1] = (7, 1, ("\n" * 49_999)[-30:])
    assert got == sorted(map(str, want))


@pytest.mark.parametrize("block_docs", [1024, 3])
def test_near_duplicates_of_null_and_repeated_ids(spark, block_docs):
    rng = random.Random(12)
    a, b, c = (prose(rng, 60) for _ in range(3))
    edit = lambda t, k: " ".join(w if i != k else "changed" for i, w in enumerate(t.split()))
    rows = [(None, edit(a, 0)), (2, a), (None, edit(b, 59)), (None, b), (4, c), (4, edit(c, 0)), (4, "alone " + prose(rng, 20)), (9, edit(c, 59)), (None, ""), (None, None), (4, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, block_docs=block_docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None, 2, False), (2, 2, True), (None, None, True), (None, None, False), (4, 4, True), (4, 4, True), (4, 4, True), (9, 4, False), (None, None, True), (None, None, True), (4, 4, True)]))
    left = [(r["doc_id"], r["text"]) for r in neardup.drop_near_duplicates(docs).collect()]
    assert (2, a) in left and rows[6] in left and len([x for x in left if x[0] == 4]) == 2 and len(left) == 6


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_star_rounds_change_no_component(spark, rounds):
    rng = random.Random(13)
    texts = near_copies(rng, 60, 80, 5) + near_copies(rng, 30, 80, 8) + ["x " * 60_000]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, texts), block_docs=5, star_rounds=rounds).collect()}
    assert got == brute_components(texts)
