"""Subword lattices, whitening and the audit of sources against brute force, with nulls, ties, hot groups and empty tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewright.llm import divergence, lattice, whiten
from gaugewright.llm.lattice import START, Model

DOCS = "doc_id long, text string, lang string, source string, word string, score string"


def frame(spark, rows):
    """Documents with two more columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS)


# ---- subword lattice


def small_model():
    names = tuple(sorted({bytes([b]) for b in range(256)} | {b"ab", b"abc", b"bc", bytes([START]) + b"a", bytes([START]) + b"ab", "é".encode()}))
    rng = np.random.default_rng(3)
    p = rng.random(len(names)) + 0.1
    p /= p.sum() * 1.05
    return Model(names, np.log(p), math.log(0.05 / 1.05))


def segmentations(word, pieces):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            for rest in segmentations(word[k:], pieces):
                yield [word[:k], *rest]


def brute_word(model, word):
    p = dict(zip(model.pieces, np.exp(model.logs), strict=True))
    paths = [(s, math.prod(p[x] for x in s)) for s in segmentations(bytes([START]) + word, p)]
    total = sum(w for _, w in paths)
    times = Counter()
    for s, w in paths:
        for x in s:
            times[x] += w / total
    return math.log(total), times


@pytest.mark.parametrize("cells", [lattice.CELLS, 40])
def test_words_against_all_segmentations(monkeypatch, cells):
    monkeypatch.setattr(lattice, "CELLS", cells)
    model = small_model()
    words = [b"", b"a", b"ab", b"abc", b"abcab", "éa".encode(), b"zzabc", b"abcabcabcab", "日".encode(), b"ab"]
    counts = np.array([1.0, 2, 3, 1, 1, 1, 4, 1, 1, 5])
    logs, expected = lattice.word_logs(model, words, counts)
    want = Counter()
    for w, log, n in zip(words, logs, counts, strict=True):
        brute, times = brute_word(model, w)
        assert log == pytest.approx(brute, rel=1e-12)
        for x, k in times.items():
            want[x] += n * k
    assert expected == pytest.approx(np.array([want[x] for x in model.pieces]), rel=1e-9, abs=1e-12)


def test_a_word_of_any_length_has_a_probability():
    model = small_model()
    long = b"abc" * 20_000
    logs, _ = lattice.word_logs(model, [long, b"a"])
    assert logs[0] < -20_000 and logs[1] == pytest.approx(brute_word(model, b"a")[0])


def test_learning_raises_the_likelihood(spark):
    counts = spark.createDataFrame([("abc", 50), ("ab", 20), ("bcabc", 5)], "word string, c long")
    words, n = [r["word"].encode() for r in counts.collect()], np.array([r["c"] for r in counts.collect()])
    model, before = small_model(), -np.inf
    for _ in range(3):
        model = lattice.learn(counts, model, texts=10, rounds=1, prior=0.0001)
        assert np.exp(model.logs).sum() + math.exp(model.end) == pytest.approx(1)
        now = (lattice.word_logs(model, words)[0] * n).sum() + 10 * model.end
        assert now > before
        before = now


def learned(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 != 0


def brute_scores(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t, *_ in rows]
    counts = Counter(w for r, ws in zip(rows, words, strict=True) if learned(r[0]) for w in ws)
    texts = sum(learned(r[0]) for r in rows)
    total, kinds = sum(counts.values()) + texts, len(counts) + (texts > 0)
    term = lambda c: math.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
    return [(r[0], learned(r[0]), len(ws) + 1, sum(counts[w] > 0 for w in ws) + (texts > 0), total, sum(term(counts[w]) for w in ws) + term(texts), ws) for r, ws in zip(rows, words, strict=True)]


TEXTS = ["ab abc AB É\tabc\x0bx", "", None, "abc " * 500, "zz", "a b c", "ab abc AB É\tabc\x0bx", "▁a b▁", " \n "]


@pytest.mark.parametrize("block_bytes", [lattice.BLOCK_BYTES, 1])
def test_scores_against_brute_force(spark, block_bytes):
    rows = [(i if i % 7 else None, t, "en", "s") for i, t in enumerate(TEXTS * 3)] + [(1, "ab", None, None)] * 3
    found = lattice.score_documents(frame(spark, rows).repartition(3), small_model(), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, rounds=0, block_bytes=block_bytes).collect()
    model = small_model()
    want = sorted(
        ((str(w[0]), *w[1:5], round(w[5], 6), round((sum(lattice.word_logs(model, [x.encode()])[0][0] for x in w[6]) + model.end) / math.log(10), 6)) for w in brute_scores(rows)), key=str
    )
    assert sorted(((str(r["doc_id"]), r["learned"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in found), key=str) == want
    assert lattice.score_documents(frame(spark, []), model, F.lit(True)).count() == 0
    assert [r["n_known"] for r in lattice.score_documents(frame(spark, rows[:2]), model, F.lit(False)).collect()] == [0, 0]


# ---- whitening


def brute_whitening(vectors, components=16):
    usable = [v for v in vectors if v and all(e is not None and math.isfinite(e) for e in v)]
    x = np.array([[math.floor(64 * e) + 1_000_000 for e in v] for v in usable], dtype=object)
    points = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, sums = len(points), points.sum(axis=0)
    centred = (points * n - sums).astype(float) / n
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1]
    return x, n, sums, cov, values


def test_eigen_against_the_library():
    rng = np.random.default_rng(7)
    for d in (1, 2, 3, 5, 40):
        a = rng.normal(size=(d, d))
        for m in (a @ a.T, np.diag(np.arange(d, dtype=float)), np.ones((d, d)), np.zeros((d, d)), np.kron(np.eye(d), np.ones((2, 2)))):
            e, v = whiten.eigen(m)
            assert e == pytest.approx(np.linalg.eigvalsh(m)[::-1], abs=1e-10)
            assert np.abs(v.T @ v - np.eye(len(m))).max() < 1e-12 and np.abs(m @ v - v * e).max() < 1e-10


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(11)
    base = (rng.normal(size=(300, 5)) * [3, 2, 1, 0.5, 0.2] + 40).astype(np.float32)
    vectors = [v.tolist() for v in base] + [base[0].tolist()] * 200 + [None, [], [1.0] * 4, [1.0, None, 1.0, 1.0, 1.0], [1.0, float("nan"), 1.0, 1.0, 1.0], [float("inf")] * 5]
    table = spark.createDataFrame([(i % 400 if i % 50 else None, v, "clash") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, n string").repartition(5)
    rows = whiten.whiten(table).collect()
    x, n, sums, cov, values = brute_whitening([v for v in vectors if v is None or len(v) != 4])
    assert len(rows) == 500 * 5 and {r["n"] for r in rows} == {n}
    assert Counter(r["deviation"] for r in rows if r["component"] == 1) == Counter(((n * x - sums) ** 2).sum(axis=1).tolist())
    assert [r["explained"] for r in rows[:5]] == pytest.approx(values / values.sum(), rel=1e-10)
    assert max(r["identity_error"] for r in rows) < 1e-10
    # components are eigenvectors: whitened values of the fit list have unit covariance, and the grid vectors can be had back
    w = np.array([r["whitened"] for r in rows]).reshape(-1, 5)
    assert np.sort((w**2).sum(axis=1)) == pytest.approx(np.sort([c @ np.linalg.solve(cov, c) for c in (x - sums / n).astype(float)]), rel=1e-8)


def test_whitening_of_little(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [2.0, 3.0])] * 3):
        assert whiten.whiten(spark.createDataFrame(rows, kind)).count() == 0
    found = whiten.whiten(spark.createDataFrame([(1, [2.0, 3.0]), (2, [4.0, 6.0]), (2, [4.0, 6.0])], kind)).collect()
    assert {r["component"] for r in found} == {1} and len(found) == 3 and found[0]["explained"] == pytest.approx(1)
    huge = whiten.whiten(spark.createDataFrame([(1, [3e38]), (2, [-3e38])], kind)).collect()
    assert [r["deviation"] for r in huge] == [None, None]


def test_welford_merges_in_any_order():
    rng = np.random.default_rng(2)
    data = (rng.integers(0, 50, (90, 3)) + 1_000_000).astype(np.int64)
    for cuts in ([30, 60], [1, 2], [0, 89]):
        whole = whiten.Fit()
        for part in np.split(data, cuts):
            own = whiten.Fit()
            own.add(part)
            whole.merge(own)
        assert whole.n == 90 and whole.sums == data.sum(axis=0).tolist()
        assert whole.spread / 90 == pytest.approx(np.cov(data.T, bias=True), rel=1e-12)


# ---- sources against their language


def brute_audit(rows, min_docs):
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) for r in rows]
    df, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for r, ts in zip(rows, terms, strict=True):
        lang, source = r[2] or "", r[3] or ""
        groups[lang].add(source)
        df[lang].update(set(ts))
        n[lang, source].update(ts)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in df[lang].items() if k >= min_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[t] for t in kept) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        p = {s: share(n[lang, s]) for s in sources}
        q = share(sum((n[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            term = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if n[lang, s][t] > 0 and p[s][t] > q[t])[:10]
            out += [(lang, s, kind, item.decode(), -v, i) for kind, ranked in (("pair", pair), ("term", term)) for i, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


def audit_rows():
    rng = random.Random(9)
    words = ["alpha", "Beta", "gamma", "été", "日本", "x", "delta's", "e-mail"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(8))) + rng.choice(["", "!", "\n", " 12ab3"]), rng.choice(["en", "fr", None, ""]), "hot" if i % 3 == 0 else rng.choice(["a", "b", "é", None, "c", "d"])) for i in range(240)]
    return [*rows, (None, None, "de", "only"), (5, "", "it", "a"), (5, "rare", "it", None), (6, "beta " * 5000, "en", "hot"), (6, "beta " * 5000, "en", "hot")]


@pytest.mark.parametrize("sizes", [{}, {"group_bytes": 50, "block_counts": 3, "stripe_sources": 2}])
def test_audit_against_brute_force(spark, sizes):
    rows = audit_rows()
    found = divergence.audit(frame(spark, rows).repartition(4), **sizes).collect()
    assert sorted(tuple(r) for r in found) == brute_audit(rows, 10)
    assert divergence.audit(frame(spark, [])).count() == 0


def test_audit_without_kept_terms(spark):
    rows = [(1, "a b", "en", "x"), (2, "c", "en", "y"), (3, None, "en", None)]
    assert sorted(tuple(r) for r in divergence.audit(frame(spark, rows)).collect()) == brute_audit(rows, 10)


def test_slices_of_one_digest_stay_apart():
    words = [b"aa", b"ab", b"aa", b"b", b"ab", b"", b"aa"]
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    for digest in (lambda b: 1, len):
        group, first = divergence.grouped_slices(np.frombuffer(b"".join(words), np.uint8), starts[[0, 1, 2, 3, 4, 6]], ends[[0, 1, 2, 3, 4, 6]], digest)
        assert len(set(group.tolist())) == 3 == len(first) and group[0] == group[2] == group[5] and group[1] == group[4]


def test_shares_beyond_64_bits():
    n = np.array([0, 5, 1 << 40, (1 << 61)])
    got = divergence.shares(n, np.full(4, 1 << 62), np.full(4, 10))
    assert got.tolist() == [1 + 10**9 * (int(c) + 2) // ((1 << 62) + 20) for c in n]


def test_queries_and_sql_agree_on_a_small_table(spark, tmp_path):
    from gaugewright.llm.queries import QUERIES
    from gaugewright.llm.sql import ORACLES

    rows = audit_rows()
    frame(spark, rows).drop("word", "score").withColumn("n_chars", F.length("text").cast("long")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["op13_source_divergence"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.sql(ORACLES["op13_source_divergence"]).select(", ".join(got.columns)).fetchall())
    scored = {(r["doc_id"], r["n_tokens"]): r for r in QUERIES["op11_subword_lattice"](spark, str(tmp_path)).collect()}
    for doc_id, held, n, known, total, base, _ in ((w[0], not w[1], *w[2:]) for w in brute_scores(rows)):
        r = scored[doc_id, n]
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (held, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and -math.inf < r["score"] < 0

