"""Cross-site boilerplate: lines whose distinct-site spread reaches a threshold.

A line's identity is two hashes (96 bits) of its trimmed text. One aggregation gives every line its
count, its first occurrence and a HyperLogLog sketch of its sites; each task merges its own rows
before the exchange, so that a very common line leaves it as one row. Only lines whose estimate is
near the threshold get an exact distinct count. A line that reaches it stays at its first occurrence
(smallest doc_id, then position, then hash of the text) and goes everywhere else, so that of a group
of copies one document stays whole.

The lines found are few against the corpus. Up to a checked number they go to every task, which
takes them out of the rows that it reads; beyond it they are joined.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gaugewright.llm.words import fresh, map_batches
from gaugewright.session import checkpointed

#: Distinct sites from which a line counts as boilerplate.
MIN_SITES = 8

#: log2 of the sketch's registers: a relative standard error of about 1.6 %.
LG_K = 12

#: Estimates within this share of the threshold (and one site) are checked exactly: six standard errors.
NEAR = 0.1

#: Lines up to which they are sent to every task, as sorted arrays of 37 bytes a line (18 MB in all).
BROADCAST_LINES = 500_000

_BLANK = " \t\r\x0b\x0c"


def _text_hash() -> Column:
    return F.xxhash64("text")


def _lines(docs: DataFrame, site: str, min_words: int) -> DataFrame:
    """doc_id, text hash, site (as a hash), pos and the identity (h, g) of every line of at least ``min_words`` words."""
    sites = F.when(F.col(site).isNotNull(), F.xxhash64(F.col(site)))
    split = docs.select("doc_id", _text_hash().alias("th"), sites.alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = split.withColumn("line", F.btrim("line", F.lit(_BLANK))).where(F.col("line").rlike(r"^\S+" + r"\s+\S+" * (min_words - 1)) if min_words > 1 else F.col("line") != "")
    return lines.select("doc_id", "th", "site", "pos", F.xxhash64("line").alias("h"), F.crc32(F.col("line").cast("binary")).alias("g"))


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", min_words: int = 1, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """h, g, n (occurrences), first (doc_id, pos and th) and n_sites (exact near the threshold, else estimated) of the lines that reach it."""
    lines = _lines(docs, site, min_words)
    spread = lines.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos", "th")).alias("first"), F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("estimate"))
    margin = max(1.0, NEAR * min_sites)
    spread = checkpointed(spread.where((F.col("n") >= min_sites) & (F.col("estimate") >= min_sites - margin)))
    near = spread.where(F.abs(F.col("estimate") - min_sites) <= margin).select("h", "g")
    if near.count() <= broadcast_lines:
        near = F.broadcast(near)
    exact = lines.where("site is not null").join(near, ["h", "g"], "left_semi").select("h", "g", "site").distinct().groupBy("h", "g").agg(F.count("*").alias("exact"))
    settled = spread.join(exact, ["h", "g"], "left").withColumn("n_sites", F.coalesce("exact", "estimate"))
    return settled.where(F.col("n_sites") >= min_sites).select("h", "g", "n", "first", "n_sites")


def _in_place(docs: DataFrame, found: DataFrame, keep_first: bool) -> DataFrame:
    """Lines taken out by the task that reads the row."""
    rows = found.select("h", "g", "first.doc_id", "first.pos", "first.th").toArrow()  # their number was checked
    plain = lambda name, kind: rows.column(name).fill_null(0).to_numpy().astype(kind)
    lines = [plain("h", np.int64), plain("g", np.uint32), plain("doc_id", np.int64), plain("pos", np.int32), plain("th", np.int64), rows.column("doc_id").is_null().to_numpy()]
    order = np.lexsort((lines[1], lines[0]))
    known = docs.sparkSession.sparkContext.broadcast([c[order] for c in lines])
    at = docs.columns.index("text")
    blank = _BLANK.encode()

    def signed(data: bytes) -> int:
        h = xxhash.xxh64_intdigest(data, seed=42)
        return h - (1 << 64) if h >> 63 else h

    def clean(doc_id: int | None, text: str | None) -> tuple[str | None, int, int]:
        if text is None:
            return None, 0, 0
        heads, marks, ids, places, texts, none = known.value
        data, gone, own = text.encode(), set(), None
        lines = data.split(b"\n")
        stripped = [line.strip(blank) for line in lines]
        hashes = np.array([signed(line) if line else 0 for line in stripped], dtype=np.int64)
        left, right = np.searchsorted(heads, hashes, "left"), np.searchsorted(heads, hashes, "right")
        for pos in np.flatnonzero(right > left).tolist():
            if not (line := stripped[pos]):
                continue
            for k in range(left[pos], right[pos]):
                if marks[k] != zlib.crc32(line):
                    continue
                if keep_first and places[k] == pos and (doc_id is None if none[k] else doc_id == ids[k]):
                    own = signed(data) if own is None else own
                    if own == texts[k]:
                        continue
                gone.add(pos)
        return (b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode() if gone else text), len(lines), len(gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [clean(*row) for row in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array([x[0] for x in out], type=pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x[i] for x in out], type=pa.int64()) for i in (1, 2))], names=[*batch.schema.names, "n_lines", "n_removed"])

    return map_batches(docs, run, StructType([*docs.schema.fields, StructField("n_lines", LongType()), StructField("n_removed", LongType())]))


def _by_join(docs: DataFrame, found: DataFrame, site: str, min_words: int, keep_first: bool) -> DataFrame:
    """Lines taken out by joins on the line, then on the row's doc_id and text."""
    own_id, own_th, out = fresh("id", "th", "gone")
    at = _lines(docs, site, min_words).join(found.select("h", "g", "first"), ["h", "g"])
    if keep_first:
        at = at.where(~F.struct("doc_id", "pos", "th").eqNullSafe(F.col("first")))
    gone = at.groupBy("doc_id", "th").agg(F.collect_set("pos").alias(out)).select(F.col("doc_id").alias(own_id), F.col("th").alias(own_th), out)
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(own_id)) & (_text_hash() == F.col(own_th)), "left")
    lines, removed = F.split("text", "\n"), F.coalesce(F.size(out), F.lit(0))
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(F.col(out), i)), "\n")
    counts = {"n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"), "n_removed": F.when(F.col(out).isNull(), 0).otherwise(removed).cast("long")}
    return joined.withColumns(counts).withColumn("text", F.when(F.col(out).isNotNull(), kept).otherwise(F.col("text"))).drop(own_id, own_th, out)


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", min_words: int = 1, keep_first: bool = True, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """All rows and columns of docs; text without boilerplate lines, and n_lines and n_removed.

    Lines are what ``\\n`` separates; they are compared without the white space around them. Blank lines
    stay, as do those of fewer than ``min_words`` words. A null text stays null with 0 lines; a null
    site counts as no site. Every row loses the lines of its own text: rows of one doc_id with other
    texts are told apart, and a null doc_id counts as the smallest. Rows equal in doc_id and text are
    treated alike. Texts that lose nothing are unchanged to the byte. Columns named n_lines or
    n_removed are replaced; an empty table gives no rows. Up to ``broadcast_lines`` lines are sent to
    the tasks, more are joined, with the same result.
    """
    docs = docs.drop("n_lines", "n_removed")
    found = checkpointed(boilerplate_lines(docs, min_sites, site, min_words, broadcast_lines))
    return _in_place(docs, found, keep_first) if found.count() <= broadcast_lines else _by_join(docs, found, site, min_words, keep_first)
