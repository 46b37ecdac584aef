"""Token-ID files: ids of all documents in ascending doc_id order, compressed by Re-Pair per shard.

A dataset is a folder of Parquet files, one or more per shard. A row is one block of whole
documents: shard, block, first_token (ids of the shard before it), n_tokens, n_docs, n_symbols and
n_rules of its grammar, and the block's bytes as ``repair`` lays them out. A grammar belongs to one
block, for it must fit a task's memory however large a shard is. Spark writes and commits the files, so any store that Spark
reaches will do and a lost executor's shard is written again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugewright.llm.packing import text_slices
from gaugewright.llm.repair import Block, encode_block
from gaugewright.llm.tokens import encoder, with_end
from gaugewright.llm.words import binary_column, map_batches
from gaugewright.session import checkpointed

BLOCKS = "shard int, block long, first_token long, n_tokens long, n_docs long, n_symbols long, n_rules long, data binary"

#: Shards up to which their first ids (16 bytes each) are broadcast when files are read.
BROADCAST_SHARDS = 1_000_000


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_ids: int = 1 << 20, shards: int | None = None) -> None:
    """Encodes every document (doc_id, text; other columns are ignored) and writes the files.

    Documents are dealt into shards by ranges of doc_id (rows of one doc_id also by their text, so
    that even those can be split) and sorted; a shard is one task, which holds one block of about
    ``block_ids`` ids at a time. A null or empty text has the end id alone. Null doc_ids come first.
    An empty table makes files without rows.
    """
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select("doc_id", "text")
    rows = rows.repartitionByRange(shards, *keys) if shards else rows.repartitionByRange(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, shard = encoder(tokenizer), TaskContext.get().partitionId()
        doc_ids, counts, parts, gathered, block, first = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, counts, parts, gathered, block, first
            data, symbols, rules = encode_block(doc_ids, np.concatenate(counts), np.concatenate(parts))
            row = [[shard], [block], [first], [gathered], [len(doc_ids)], [symbols], [rules], [data]]
            types = [pa.int32(), *[pa.int64()] * 6, pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(row, types, strict=True)], names=["shard", "block", "first_token", "n_tokens", "n_docs", "n_symbols", "n_rules", "data"])
            doc_ids, counts, parts, block, first, gathered = [], [], [], block + 1, first + gathered, 0
            return out

        for batch in batches:
            for part in text_slices(batch, limit=1 << 20):
                ids, begin = with_end(*tool.encode([t or "" for t in part.column("text").to_pylist()]), end_id)
                doc_ids += part.column("doc_id").to_pylist()
                counts.append(np.diff(begin))
                parts.append(ids)
                gathered += len(ids)
                if gathered >= block_ids:
                    yield flush()
        if doc_ids:
            yield flush()

    map_batches(rows.sortWithinPartitions(*keys), run, BLOCKS).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The documents of token files: doc_id, start (ids of all documents before it), n_tokens and ids.

    ids are little-endian unsigned 32-bit integers. Where a shard starts comes from the shards'
    sums, one row for each task that wrote; the blocks stay where they are read while those rows are
    few enough to broadcast.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sums = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = checkpointed(sums.select("shard", before.alias("shard_start")))
    if sums.count() <= BROADCAST_SHARDS:
        sums = F.broadcast(sums)
    placed = blocks.join(sums, "shard").select((F.col("shard_start") + F.col("first_token")).alias("start"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("data"), strict=True):
                block = Block(data.as_buffer().to_pybytes())
                begin = np.concatenate(([0], np.cumsum(block.doc_tokens)))
                columns = [pa.array(block.doc_ids, type=pa.int64()), pa.array(start + begin[:-1]), pa.array(block.doc_tokens), binary_column(block.ids().astype("<u4"), begin)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    return map_batches(placed, run, "doc_id long, start long, n_tokens long, ids binary")


def compression(spark: SparkSession, path: str) -> DataFrame:
    """Each shard's size: shard, n_tokens, n_symbols, n_rules, bytes, and ``ratio``, 4 bytes an id over the bytes stored (before Parquet's own compression)."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sums = blocks.groupBy("shard").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_symbols", "n_rules")], F.sum(F.octet_length("data")).alias("bytes"))
    return sums.withColumn("ratio", 4 * F.col("n_tokens") / F.col("bytes"))
