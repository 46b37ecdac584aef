"""The queries of this subpackage and their SQL: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.llm import decontam, divergence, langid, lattice, licenses, linededup, neardup, packing, quality, sharding, tokenfiles, urlfilter, whiten
from gaugewright.session import shared_path

#: The rules that pages are judged by: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_of_documents(_read(spark, sf_dir, "documents"))
    return found.withColumn("dice", F.round("dice", 6))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    fold = langid.fold_of(F.col("doc_id"))
    dictionaries = langid.learn_dictionaries(docs.where(fold != 1).select("text", "lang"))
    found = langid.identify(docs, dictionaries)
    return found.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    tokenfiles.write_token_files(_read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    read = tokenfiles.read_token_files(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=1024)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    dealt = sharding.shard(sized, F.col("size"), F.col("text_hash"), F.col("doc_id"), shards=24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), numerator=85, denominator=100)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_read(spark, sf_dir, "pages"), URL_RULES)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents")).drop("rejected_by")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.remove_boilerplate(_read(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "text")


def op11_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    scored = lattice.score_documents(_read(spark, sf_dir, "documents"), lattice.from_vocabulary(public_tokenizers.path("piece_bpe_32k.model")), learned)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(_read(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_language_id, op3_token_files, op4_pack_sequences, op5_shard_by_bytes, op6_near_duplicates, op7_url_filter, op8_decontaminate, op9_quality_cascade, op10_line_dedup, op11_subword_lattice, op12_whitening, op13_source_divergence)}
