"""Audit of sources against their language: which sources of a language differ, and by which terms.

A byte-level tokenizer cuts the terms out of whole batches of texts; equal terms are grouped within a
task and then by Spark. The kept terms of a language are dealt into blocks, each a sparse matrix of
sources by terms, whose divergences add up over the blocks. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.llm.words import LOWER, map_batches, spans, text_buffer
from gaugewright.session import checkpointed

#: Documents of a language that a term must occur in.
MIN_DOCS = 10

#: Terms reported for each source.
TOP_TERMS = 10

#: Bytes of text whose terms are grouped before they leave a task, about.
GROUP_BYTES = 4 << 20

#: Counts of one block of a language's terms, about (a term's own counts stay together).
BLOCK_COUNTS = 200_000

#: Sources of a language that one task holds against all others.
STRIPE_SOURCES = 256

#: Shares are numbers out of this many.
SCALE = 1_000_000_000

#: Bytes that no term has: everything in ASCII but letters.
NOT_TERM = np.array([c < 128 and not (65 <= c <= 90 or 97 <= c <= 122) for c in range(256)])


def grouped_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """The group of each slice of the bytes, and the first slice of each group; groups hold equal slices only.

    Slices are grouped by their digest, then every slice is compared byte by byte with the first of
    its group. Those that differ, which takes a collision, are grouped by their bytes.
    """
    whole = data.tobytes()
    digests = np.fromiter((digest(whole[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), dtype=np.uint64, count=len(starts))
    _, first, group = np.unique(digests, return_index=True, return_inverse=True)
    lengths = ends - starts
    same = lengths == lengths[first[group]]
    alike = np.flatnonzero(same)
    if len(alike):
        size = lengths[alike]
        begin = np.cumsum(size) - size
        within = np.arange(size.sum()) - np.repeat(begin, size)
        equal = data[np.repeat(starts[alike], size) + within] == data[np.repeat(starts[first[group[alike]]], size) + within]
        same[alike] = np.logical_and.reduceat(equal, begin)
    known: dict[tuple[int, bytes], int] = {}
    more = []
    for i in np.flatnonzero(~same).tolist():
        key = (int(group[i]), whole[starts[i] : ends[i]])
        if key not in known:
            known[key] = len(first) + len(more)
            more.append(i)
        group[i] = known[key]
    return group, np.concatenate((first, np.array(more, dtype=first.dtype)))


def _term_counts(batch: pa.Table) -> pa.RecordBatch:
    """Occurrences and documents of each term in each (lang, source) of some rows."""
    data, offsets = text_buffer(batch.column("text"))
    data = LOWER[data]
    starts, ends, first = spans(data, offsets, NOT_TERM)
    group, sample = grouped_slices(data, starts, ends)
    names = pa.StructArray.from_arrays([batch.column(c).combine_chunks().cast(pa.string()).dictionary_encode().indices for c in ("lang", "source")], ["lang", "source"])
    pairs, owner = np.unique(names.field(0).to_numpy().astype(np.int64) << 32 | names.field(1).to_numpy(), return_inverse=True)
    at = np.zeros(len(pairs), dtype=np.int64)
    at[owner] = np.arange(len(owner))  # some row of each pair
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    # each document's own terms first: one entry a document and term
    per_doc, times = np.unique(doc * len(sample) + group, return_counts=True)
    key = owner[per_doc // max(len(sample), 1)] * len(sample) + per_doc % max(len(sample), 1)
    keys, entry = np.unique(key, return_inverse=True)
    n, docs = np.zeros(len(keys), dtype=np.int64), np.bincount(entry, minlength=len(keys))
    np.add.at(n, entry, times)
    term = sample[keys % max(len(sample), 1)]
    rows = pa.array(at[keys // max(len(sample), 1)])
    size = ends[term] - starts[term]
    place = np.concatenate(([0], np.cumsum(size)))
    text = data[np.repeat(starts[term] - place[:-1], size) + np.arange(place[-1])]
    terms = pa.LargeStringArray.from_buffers(len(term), pa.py_buffer(place.astype(np.int64)), pa.py_buffer(text)).cast(pa.string())
    return pa.RecordBatch.from_arrays([batch.column("lang").combine_chunks().take(rows), batch.column("source").combine_chunks().take(rows), terms, pa.array(n), pa.array(docs.astype(np.int64))], ["lang", "source", "term", "n", "docs"])


def _count_terms(group_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows if batch.nbytes > 2 * group_bytes else 1):
                part = batch.slice(k, 1) if batch.nbytes > 2 * group_bytes else batch
                if held and size + part.nbytes > group_bytes:
                    yield _term_counts(pa.Table.from_batches(held))
                    held, size = [], 0
                held.append(part)
                size += part.nbytes
        if held:
            yield _term_counts(pa.Table.from_batches(held))

    return run


def term_counts(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Occurrences ``n`` and documents ``docs`` of each term of each (lang, source); null text, lang or source count as ''.

    Terms are the maximal runs of ASCII letters and characters beyond ASCII, A-Z as a-z.
    """
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    found = map_batches(plain, _count_terms(group_bytes), "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: np.ndarray, terms: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """1 + floor(scale * (count + 2) / (total + 2 * terms)), exact for counts of any size that has 64 bits."""
    above, below = np.asarray(counts) + 2, np.asarray(total) + 2 * np.asarray(terms)
    if len(above) and int(above.max()) > (1 << 62) // scale:
        above, below = above.astype(object), below.astype(object)
    return (1 + above * scale // below).astype(np.int64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)) of shares of at most 1 + scale."""
    return (p - q) ** 2 // (p + q)


def _row_sums(values: np.ndarray, indptr: np.ndarray) -> np.ndarray:
    """Sums of the rows of a CSR matrix's values; 0 for rows without any."""
    out = np.zeros(len(indptr) - 1, dtype=np.int64)
    full = np.flatnonzero(np.diff(indptr))
    if len(full):
        out[full] = np.add.reduceat(values, indptr[full])
    return out


def _block(top: int):
    """One block of a language's terms: its part of every pair's divergence, and each source's leading terms."""

    def run(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
        lang, first = key[0].as_py(), key[2].as_py() == 0

        def rows(part: str, source: np.ndarray, item: pa.Array, value: np.ndarray) -> pa.Table:
            same = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(source), np.int64))) for x in (lang, part)]
            return pa.table({"lang": same[0], "source": sources.take(pa.array(source)), "part": same[1], "item": item, "value": pa.array(value, pa.int64())})

        sources = groups.column("source").combine_chunks()
        parts = [rows("pair", np.zeros(0, np.int64), sources.slice(0, 0), np.zeros(0, np.int64))]
        if not counts.num_rows:
            return parts[0]
        total, v = groups.column("total").to_numpy(), groups.column("terms").to_numpy()
        encoded = counts.column("term").combine_chunks().dictionary_encode()
        terms, col = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
        row = pa.compute.index_in(counts.column("source").combine_chunks(), value_set=sources).to_numpy().astype(np.int64)
        order = np.lexsort((col, row))
        row, col, n = row[order], col[order], counts.column("n").to_numpy()[order]
        indptr = np.searchsorted(row, np.arange(len(sources) + 1))
        p = shares(n, total[row], v[row])
        none = shares(np.zeros(len(sources), dtype=np.int64), total, v)  # the share of a term that a source lacks
        # pairs: with D the divergence less that of two absent terms, a sum over the union of two rows is
        # that over the one, and that over the other, less that over both; Spark adds the parts up
        dense, there = np.empty(len(terms), dtype=np.int64), np.zeros(len(terms), dtype=bool)
        for t in np.flatnonzero(groups.column("mine").to_numpy()):
            mine = slice(indptr[t], indptr[t + 1])
            dense.fill(none[t])
            dense[col[mine]] = p[mine]
            there[col[mine]] = True
            d = divergence(p, dense[col]) - divergence(none[row], none[t])
            own = _row_sums(d, indptr)
            one = own - _row_sums(np.where(there[col], d, 0), indptr)
            there[col[mine]] = False
            own[t] = one[t] = 0
            at, to = np.flatnonzero(one), np.flatnonzero(own)
            source, item = np.concatenate((at, np.full(len(to), t))), np.concatenate((np.full(len(at), t), to))
            parts.append(rows("pair", source, sources.take(pa.array(item)), np.concatenate((one[at], own[to]))))
        if not first:
            return pa.concat_tables(parts)
        # terms: against the language as a whole
        lang_n = np.zeros(len(terms), dtype=np.int64)
        np.add.at(lang_n, col, n)
        q = shares(lang_n, np.full(len(terms), total.sum()), np.full(len(terms), v[0]))[col]
        f = divergence(p, q)
        more = np.flatnonzero((n > 0) & (p > q))
        by_name = np.empty(len(terms), dtype=np.int64)
        by_name[pa.compute.sort_indices(terms.cast(pa.binary())).to_numpy()] = np.arange(len(terms))
        more = more[np.lexsort((by_name[col[more]], -f[more], row[more]))]
        rank = np.arange(len(more)) - np.searchsorted(row[more], row[more])
        more = more[rank < top]
        parts.append(rows("term", row[more], terms.take(pa.array(col[more])), f[more]))
        return pa.concat_tables(parts)

    return run


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, group_bytes: int = GROUP_BYTES, block_counts: int = BLOCK_COUNTS, stripe_sources: int = STRIPE_SOURCES) -> DataFrame:
    """lang, source, part, item, value and rank of the divergences of every (lang, source) of ``docs`` (text, lang, source, ...).

    A language keeps the terms that occur in at least ``min_docs`` of its rows. Part ``pair`` holds
    each other source of the language; value is the divergence summed over all kept terms. Part
    ``term`` holds the kept terms that the source has and uses more than its language does; only
    ``top`` of them. Ranks count from 1 in each group and part by falling value, then by the item's bytes.

    Nulls count as ''; a language of one source has no pair; without kept terms every pair's value is
    0 and there is no term. Rows that repeat count each time. Other columns are ignored.

    Counting combines in each task, so a hot source or term is a few rows a task. What grows with the
    square is the sources of a language, as the result does: a task holds a block of about
    ``block_counts`` counts and compares a stripe of about ``stripe_sources`` sources with all.
    """
    pair = ("lang", "source")
    counts = term_counts(docs, group_bytes)
    counts = counts.withColumn("df", F.sum("docs").over(Window.partitionBy("lang", "term"))).where(F.col("df") >= min_docs)
    counts = checkpointed(counts.select(*pair, "term", "n"))
    present = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in pair)).distinct()
    totals = counts.groupBy(*pair).agg(F.sum("n").alias("total"), F.count("*").alias("nnz"))
    kept = counts.groupBy("lang", "term").agg(F.lit(1)).groupBy("lang").agg(F.count("*").alias("terms"))
    groups = present.join(totals, [*pair], "left").join(kept, "lang", "left").select(*pair, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "nnz", "terms")))
    groups = checkpointed(groups)
    sized = groups.groupBy("lang").agg(F.sum("nnz").alias("nnz"), F.count("*").alias("sources"))
    parts = lambda n, size: F.greatest(F.ceil(F.col(n) / size), F.lit(1)).cast("int")
    sized = sized.select("lang", parts("nnz", block_counts).alias("blocks"), parts("sources", stripe_sources).alias("stripes"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spot = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    dealt = counts.join(sized, "lang").withColumn("block", spot("term", "blocks")).withColumn("stripe", every("stripes"))
    members = groups.join(sized, "lang").withColumn("home", spot("source", "stripes")).withColumn("block", every("blocks")).withColumn("stripe", every("stripes"))
    members = members.withColumn("mine", F.col("home") == F.col("stripe"))
    key = ("lang", "block", "stripe")
    found = dealt.select(*key, "source", "term", "n").groupBy(*key).cogroup(members.select(*key, "source", "total", "terms", "mine").groupBy(*key)).applyInArrow(_block(top), "lang string, source string, part string, item string, value long")
    found = checkpointed(found)
    # two absent terms have a divergence as well, the same for every term
    share = F.expr(f"1 + {2 * SCALE} div (total + 2 * terms)")
    ends = groups.where("terms > 0").withColumn("none", share)
    others = groups.join(sized, "lang").withColumn("stripe", every("stripes")).select("lang", "stripe", F.col("source").alias("item"))
    each = groups.join(sized, "lang").select("lang", spot("source", "stripes").alias("stripe"), "source").join(others, ["lang", "stripe"]).where("source <> item")
    of = lambda who: ends.select("lang", F.col("source").alias(who), F.col("none").alias(f"none_{who}"), F.col("terms").alias(f"terms_{who}"))
    base = each.drop("stripe").join(of("source"), ["lang", "source"], "left").join(of("item"), ["lang", "item"], "left")
    base = base.withColumn("value", F.coalesce(F.expr("terms_source * ((none_source - none_item) * (none_source - none_item) div (none_source + none_item))"), F.lit(0)))
    pairs = base.select("lang", "source", F.lit("pair").alias("part"), "item", "value").unionByName(found.where("part = 'pair'"))
    pairs = pairs.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(found.where("part = 'term'")).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
