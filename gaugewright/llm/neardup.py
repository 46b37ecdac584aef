"""MinHash near-dedup with min-max hashing.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Under each of ``permutations``
hash functions both the least and the greatest value are kept, so a signature has twice as many
values as hash evaluations. Consecutive values are banded; documents that share a band's bucket are
candidates, and every candidate link is confirmed on full sets.

Documents of equal sets are one class from the start, so copies never meet as pairs. Buckets with
the same members are one. A bucket of more than one block's size is first held against single
members, so that most of a large group of near copies is known to be one component after work in
proportion to its size. Two members of one component need no further link. Those outside it meet all
others in blocks of bounded size, and a pair of blocks is a task's unit of work: it counts all
intersections by a product of incidence matrices and gives a spanning forest of the confirmed links,
never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.llm.words import ASCII_SPACE, binary_column, fresh, list_column, map_batches, map_chunks, mix, seeds, shingles, span_hashes, spans, unique_runs
from gaugewright.operators.components import connected_components
from gaugewright.session import checkpointed

PERMUTATIONS = 40
BAND_VALUES = 4
#: Documents and shingles of one block of a bucket, about.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 400_000
#: Ids (some 20 bytes each) up to which a filter of the documents is broadcast.
BROADCAST_IDS = 1_000_000
#: Rounds in which a large bucket is held against single members before pairs of blocks.
STAR_ROUNDS = 2
#: Rows from which a class of equal sets counts as hot; its rows get their result by broadcast.
HOT_ROWS = 500


def _sets(part: np.ndarray, begin: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = spans(part, begin, ASCII_SPACE)
    return shingles(span_hashes(part, starts, ends, fold_case=True), first, k)


def _keys(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits that stand for each row's sorted set, as two columns."""
    out = np.zeros((len(first) - 1, 2), dtype=np.uint64)
    sums = [np.concatenate(([np.uint64(0)], np.cumsum(mix(sets ^ s), dtype=np.uint64))) for s in seeds(2, salt=23)]
    for j, s in enumerate(sums):
        out[:, j] = mix(s[first[1:]] - s[first[:-1]] + np.diff(first).astype(np.uint64))
    return out


def _signatures(k: int, permutations: int, band_values: int):
    multipliers, shifts = seeds(permutations, salt=31) | np.uint64(1), seeds(permutations, salt=37)
    bands = 2 * permutations // band_values

    def work(batch: pa.RecordBatch, part: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
        runs, first = _sets(part, begin, k)
        full = np.flatnonzero(np.diff(first))
        values = np.zeros((2 * permutations, len(full)), dtype=np.uint64)
        if len(full):
            for p in range(permutations):
                hashed = (runs ^ shifts[p]) * multipliers[p]
                hashed ^= hashed >> np.uint64(32)
                values[2 * p] = np.minimum.reduceat(hashed, first[full])
                values[2 * p + 1] = np.maximum.reduceat(hashed, first[full])
        banded = np.zeros((len(full), bands), dtype=np.uint64)
        for b in range(bands):
            one = np.full(len(full), b, dtype=np.uint64)
            for v in values[b * band_values : (b + 1) * band_values]:
                one = mix(one ^ v) + np.uint64(b)
            banded[:, b] = one
        sets, of = unique_runs(runs, first)
        counts = np.zeros(batch.num_rows + 1, dtype=np.int64)
        counts[1:][full] = bands
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("th"), pa.array(np.diff(of)), binary_column(_keys(sets, of).ravel(), 2 * np.arange(batch.num_rows + 1)), list_column(banded.ravel().view(np.int64), np.cumsum(counts), pa.int64())],
            names=["doc_id", "th", "n_shingles", "key", "bands"],
        )

    return map_chunks(work)


def _full_sets(k: int):
    def work(batch: pa.RecordBatch, part: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
        sets, of = unique_runs(*_sets(part, begin, k))
        keys = binary_column(_keys(sets, of).ravel(), 2 * np.arange(batch.num_rows + 1))
        return pa.RecordBatch.from_arrays([keys, binary_column(sets, of)], names=["key", "shingles"])

    return map_chunks(work)


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left sets with the right ones (positions in sets)."""
    n = len(sets)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    if len(left) == 1:
        own = sets[left[0]]
        at = np.minimum(np.searchsorted(own, values), len(own) - 1)
        return np.bincount(owner[own[at] == values], minlength=n)[right][None, :]
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate(([True], values[1:] != values[:-1]))
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    kept = often[column]
    column, owner = (np.cumsum(often) - 1)[column[kept]], owner[kept]
    step = min(max(64, (8 << 20) // n), max(1, int(often.sum())))  # 32 MB of incidence at a time; counts stay far below 2**24 per step
    exact = np.zeros((len(left), len(right)), dtype=np.int64)
    for a in range(0, int(often.sum()), step):
        low, high = np.searchsorted(column, [a, a + step])
        incidence = np.zeros((n, step), dtype=np.float32)
        incidence[owner[low:high], column[low:high] - a] = 1
        exact += np.matmul(incidence[left], incidence[right].T).astype(np.int64)
    return exact


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (node, root) of the components of a symmetric boolean matrix."""
    left, out = np.ones(len(linked), dtype=bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        front = np.array([root])
        while len(front):
            reached = linked[front].any(axis=0) & left
            left &= ~reached
            front = np.flatnonzero(reached)
            out += [(int(i), root) for i in front]
    return out


def _confirm(numerator: int, denominator: int):
    """Rows sorted by bucket and pair of blocks -> confirmed links; one unit is held at a time."""

    def links(unit: list[tuple]) -> list[tuple[bytes, bytes]]:
        members = {key: (block, np.frombuffer(data, dtype=np.uint64)) for key, block, data in unit}
        if len(members) < 2:
            return []
        keys, sets, blocks = list(members), [v[1] for v in members.values()], np.array([v[0] for v in members.values()])
        sizes = np.array([len(s) for s in sets])
        left = np.flatnonzero(blocks == blocks.min())
        right = np.flatnonzero(blocks != blocks.min())
        if not len(right):
            right = left  # one block with itself; a pair of blocks leaves the pairs inside to others
        common = _intersections(sets, left, right)
        linked = np.zeros((len(keys), len(keys)), dtype=bool)
        linked[np.ix_(left, right)] = denominator * common >= numerator * (sizes[left][:, None] + sizes[right][None, :] - common)
        linked |= linked.T
        return [(keys[i], keys[j]) for i, j in _forest(linked)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, unit = None, []
        for batch in batches:
            out = []
            columns = [batch.column(n).to_pylist() for n in ("x1", "x2", "lo", "hi", "key", "block", "shingles")]
            for x1, x2, lo, hi, key, block, data in zip(*columns, strict=True):
                if (x1, x2, lo, hi) != current:
                    out += links(unit)
                    current, unit = (x1, x2, lo, hi), []
                unit.append((key, block, data))
            yield _pairs(out)
        yield _pairs(links(unit))

    return run


def _pairs(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=pa.binary()) for i in (0, 1)], names=["src", "dst"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th"))


def _among(df: DataFrame, rows: DataFrame, how: str, limit: int) -> DataFrame:
    """Rows of df (with doc_id and text) that are, or aren't, among rows (doc_id and th); a null id is a value like others."""
    own_id, own_th = fresh("id", "th")
    named = rows.select(F.col("doc_id").alias(own_id), F.col("th").alias(own_th)).distinct()
    return df.join(_broadcast(named, limit), df["doc_id"].eqNullSafe(F.col(own_id)) & (F.xxhash64(df["text"]) == F.col(own_th)), how)


def _broadcast(df: DataFrame, limit: int) -> DataFrame:
    """df, sent to every task if its rows are few enough."""
    return F.broadcast(df) if df.count() <= limit else df


def _sets_of(docs: DataFrame, keys: DataFrame, k: int, limit: int) -> DataFrame:
    """key and shingles of the classes in keys (key and rep), each made from one document again."""
    texts = _among(docs.select("doc_id", "text"), keys.select("rep.doc_id", "rep.th"), "left_semi", limit).select("text")
    return map_batches(texts, _full_sets(k), "key binary, shingles binary").dropDuplicates(["key"])


def _links(units: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Confirmed links (src, dst) of units: x1, x2, lo, hi, key and block."""
    dealt = units.select("x1", "x2", "lo", "hi", "key", "block").join(sets, "key").repartition("x1", "x2", "lo", "hi").sortWithinPartitions("x1", "x2", "lo", "hi", "key")
    return map_batches(dealt.select("x1", "x2", "lo", "hi", "key", "block", "shingles"), _confirm(numerator, denominator), "src binary, dst binary")


def _star(numerator: int, denominator: int):
    """Rows sorted by bucket and part, each part's centre first -> the members linked with it; two sets are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = key_of = None
        for batch in batches:
            out = []
            columns = [batch.column(n).to_pylist() for n in ("x1", "x2", "key", "block", "shingles")]
            for x1, x2, key, block, data in zip(*columns, strict=True):
                own = np.frombuffer(data, dtype=np.uint64)
                if block < 0:
                    centre, key_of = own, key
                else:
                    at = np.minimum(np.searchsorted(centre, own), len(centre) - 1)
                    both = np.count_nonzero(centre[at] == own)
                    if denominator * both >= numerator * (len(own) + len(centre) - both):
                        out.append((x1, x2, key_of, key))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=pa.int64() if i < 2 else pa.binary()) for i in range(4)], names=["x1", "x2", "src", "dst"])

    return run


def _stars(large: DataFrame, sets: DataFrame, rounds: int, numerator: int, denominator: int) -> tuple[DataFrame, DataFrame | None]:
    """Large buckets' members with ``inside``, and the links found.

    In every round all of a bucket meets one member that is not inside yet. Those linked with the first
    such member are inside, and later those of a member that is linked with any of them, so that all
    that is inside belongs to one component.
    """
    own, found = large.select("key", "x1", "x2", "blocks", F.lit(False).alias("inside")), None
    for turn in range(rounds):
        centre = own.where("not inside").groupBy("x1", "x2").agg(F.min_by("key", F.xxhash64("key", F.lit(turn))).alias("centre"))
        met = own.join(centre, ["x1", "x2"])
        part = F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")).cast("int")
        dealt = met.where("key <> centre").select("x1", "x2", part.alias("lo"), "key", F.lit(0).alias("block"))
        single = met.where("key = centre").select("x1", "x2", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("lo"), "key", F.lit(-1).alias("block"))
        units = dealt.unionByName(single).join(sets, "key").repartition("x1", "x2", "lo").sortWithinPartitions("x1", "x2", "lo", "block")
        links = checkpointed(map_batches(units.select("x1", "x2", "key", "block", "shingles"), _star(numerator, denominator), "x1 long, x2 long, src binary, dst binary"))
        found = links if found is None else found.unionByName(links)
        joined = met.join(links.select("x1", "x2", F.col("dst").alias("key"), F.lit(True).alias("_linked")), ["x1", "x2", "key"], "left").withColumn("_linked", F.coalesce("_linked", F.col("key") == F.col("centre")))
        if turn == 0:
            own = checkpointed(joined.select("key", "x1", "x2", "blocks", F.col("_linked").alias("inside")))
        else:
            touches = joined.groupBy("x1", "x2").agg(F.bool_or(F.col("_linked") & F.col("inside")).alias("_touches"))
            now = own.join(joined.where("_linked").select("x1", "x2", "key", "_linked"), ["x1", "x2", "key"], "left").join(touches, ["x1", "x2"], "left")
            own = checkpointed(now.select("key", "x1", "x2", "blocks", (F.col("inside") | F.coalesce(F.col("_linked") & F.col("_touches"), F.lit(False))).alias("inside")))
    return own, found


def _classes(docs: DataFrame, numerator: int, denominator: int, shingle_words: int, permutations: int, band_values: int, block_docs: int, block_shingles: int, broadcast_ids: int, star_rounds: int) -> DataFrame:
    """Every row's doc_id, th, n_shingles and ``least``: the first row (none, doc_id, th) of its component."""
    signed = checkpointed(map_batches(_rows(docs), _signatures(shingle_words, permutations, band_values), "doc_id long, th long, n_shingles long, key binary, bands array<long>"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    classes = checkpointed(signed.where("n_shingles > 0").groupBy("key").agg(F.min(row).alias("rep"), F.count("*").alias("rows"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    banded = classes.select("key", "rep", "n", F.posexplode("bands").alias("band", "bucket"))
    # a bucket's members, as a count and two sums of hashes without order; buckets of the same members are one
    mark = lambda salt: F.bit_xor(F.xxhash64("key", F.lit(salt)))
    buckets = banded.groupBy("band", "bucket").agg(F.count("*").alias("docs"), F.sum("n").alias("total"), mark(1).alias("x1"), mark(2).alias("x2")).where("docs > 1")
    buckets = buckets.groupBy("x1", "x2", "docs", "total").agg(F.min(F.struct("band", "bucket")).alias("at"))
    blocks = F.greatest(F.ceil(F.col("docs") / block_docs), F.ceil(F.col("total") / block_shingles)).cast("int")
    buckets = checkpointed(buckets.select("x1", "x2", F.col("at.band").alias("band"), F.col("at.bucket").alias("bucket"), "docs", blocks.alias("blocks")))
    members = checkpointed(banded.join(buckets, ["band", "bucket"]).select("key", "rep", "x1", "x2", "docs", "blocks"))
    large, links = members.where("blocks > 1"), None
    sets = _sets_of(docs, members, shingle_words, broadcast_ids)
    judged = members.where("blocks = 1").select("key", "x1", "x2", F.lit(False).alias("inside"), F.lit(1).alias("n_out"), F.lit(0).alias("n_in"))
    if not large.isEmpty():
        sets = checkpointed(sets)
        own, links = _stars(large, sets, star_rounds, numerator, denominator)
        # those outside meet all; those inside, one component, meet only those outside
        sizes = own.groupBy("x1", "x2").agg(F.count("*").alias("n"), F.count_if("inside").alias("_in")).where("_in < n")
        share = lambda part: F.ceil(F.col("blocks") * part / F.col("n")).cast("int")
        judged = judged.unionByName(own.join(sizes, ["x1", "x2"]).select("key", "x1", "x2", "inside", share(F.col("n") - F.col("_in")).alias("n_out"), share(F.col("_in")).alias("n_in")))
    salt = F.xxhash64("key", F.lit(3))
    block = F.when(F.col("inside"), F.col("n_out") + F.pmod(salt, F.col("n_in"))).otherwise(F.pmod(salt, F.col("n_out"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("inside"), F.col("n_out") - 1).otherwise(F.col("n_out") + F.col("n_in") - 1)))
    units = judged.select("key", "x1", "x2", block.alias("block"), other.alias("other")).select("key", "x1", "x2", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    found = _links(units, sets, numerator, denominator)
    found = connected_components(found if links is None else found.unionByName(links.select("src", "dst")))
    joined = classes.select("key", "rep").join(found.withColumnRenamed("node", "key"), "key")
    least = joined.groupBy("component").agg(F.min("rep").alias("least"))
    moved = joined.join(least, "component").select("key", "least")
    final = checkpointed(classes.select("key", "rep", "rows").join(moved, "key", "left").select("key", F.coalesce("least", "rep").alias("least"), "rows"))
    # the rows of classes of many rows stay where they are read; the others meet their class by its key
    hot = _broadcast(final.where(F.col("rows") >= HOT_ROWS).select("key", "least"), broadcast_ids)
    cold = signed.join(hot, "key", "left_anti").join(final.select("key", "least"), "key", "left")
    out = signed.join(hot, "key").unionByName(cold, allowMissingColumns=True)
    return out.select("doc_id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(row).alias("least"))


def near_duplicates(
    docs: DataFrame, numerator: int = 85, denominator: int = 100, shingle_words: int = 5, permutations: int = PERMUTATIONS, band_values: int = BAND_VALUES, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES, broadcast_ids: int = BROADCAST_IDS, star_rounds: int = STAR_ROUNDS
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if denominator * intersection >= numerator * union of their sets.
    component_id is the smallest doc_id of those reachable by links, and kept says that it is the
    document's own. ``docs`` has doc_id and text; other columns are ignored. A null, empty or blank
    text has an empty set and is linked with nothing. A document of fewer words than a shingle has
    them as its one shingle. Repeated rows each get a row; those of one doc_id with one text are
    kept or not together. A null doc_id comes after all others: such a row is kept if it is linked
    with none, or if no row that it is linked with has an id and its text's hash is the least; the
    component_id of a component without ids is null. An empty table gives no rows.

    Every pair that shares a bucket and isn't in one component already is decided on full sets; with
    the default 20 bands of 4 values a pair at the threshold of 0.85 shares none with a chance of about 4e-7.
    """
    found = _classes(docs, numerator, denominator, shingle_words, permutations, band_values, block_docs, block_shingles, broadcast_ids, star_rounds)
    component = F.col("least.doc_id")
    same = F.col("doc_id").isNull() & component.isNull() & (F.col("th") == F.col("least.th"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, same).alias("kept"))


def drop_near_duplicates(docs: DataFrame, numerator: int = 85, denominator: int = 100, shingle_words: int = 5, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The rows that stay, one of each group of near duplicates, with all their columns.

    Of a group the row of the smallest doc_id stays (null ids come last), then that of the least hash
    of its text. Rows of one doc_id are judged each by its own text; rows equal in doc_id and text
    stay once.
    """
    found = checkpointed(_classes(docs, numerator, denominator, shingle_words, PERMUTATIONS, BAND_VALUES, BLOCK_DOCS, BLOCK_SHINGLES, broadcast_ids, STAR_ROUNDS))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    left = _among(docs, found.where(own != F.col("least")), "left_anti", broadcast_ids)
    repeated = found.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1")
    return left if repeated.isEmpty() else left.dropDuplicates(["doc_id", "text"])
