"""Streaming forms: windowed sums, retransmissions and silence over a stream of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.session import checkpointed
from gaugewright.sources.telemetry import ingest, store


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of readings as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def read_telemetry_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New telemetry files as a stream of path, name, size, digest and text."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.[Mm][Ii][Ss]").load(path)
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def ingest_stream(files: DataFrame, facts_path: str, journal_path: str, checkpoint: str, rejects_path: str | None = None, simulated: DataFrame | None = None, ignore_sizes: bool = False):
    """Stores each batch as a campaign does: content once, a key's first value for good, rejects aside. (STR-once, STR-quarantine, STR-partial)

    A batch that comes again after a lost commit finds its digests in the journal, or, if even that
    was lost, its keys in the facts, and adds nothing. A file whose size on disk is no longer that of
    its batch is still being written: it gets no journal row, and ``retry_unstable`` takes it later,
    for a file source reads no file twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = checkpointed(batch)
        if batch.isEmpty():
            return
        if not ignore_sizes:
            paths = [r["path"] for r in batch.select("path").collect()]  # maxFilesPerTrigger at most
            now = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size_now"))
            batch = batch.join(now, "path", "left")
        store(batch, facts_path, journal_path, simulated, rejects_path=rejects_path)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry_unstable(spark: SparkSession, path: str, facts_path: str, journal_path: str, rejects_path: str | None = None) -> DataFrame:
    """A campaign over the folder's files that the journal doesn't know: those that were still growing when the stream met them. (STR-partial)"""
    return ingest(spark, path, facts_path, journal_path, rejects_path=rejects_path)


def distinct_readings(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Without retransmissions that come within the lateness."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["station", "sensor", "ts", "value"])


def window_sums(stream: DataFrame, width: str = "1 hour", late: str | None = "1 day") -> DataFrame:
    """Sum and count of tumbling windows, each given once when its time has passed; late is None where the stream has its watermark."""
    w = (stream.withWatermark("ts", late) if late else stream).groupBy("station", "sensor", F.window("ts", width).alias("w")).agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    return w.select("station", "sensor", F.col("w.start").alias("start_ts"), "total", "n")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Continuous stretches of each series: a stretch that has ended is a silence of at least the gap."""
    w = stream.withWatermark("ts", late).groupBy("station", "sensor", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select("station", "sensor", F.col("w.start").alias("start_ts"), F.col("w.end").alias("silent_from"), "n")


def sessions_by_step(stream: DataFrame, usual: DataFrame, factor: float = 1.5, late: str | None = "1 day") -> DataFrame:
    """Continuous stretches of each series, a stretch ending at a gap larger than factor times the series' own usual step. (STR-session, WIN-06)

    ``usual``: station, sensor and usual_s, the series' most frequent step so far, such as
    ``lowest_mode_of`` gives over the facts; a series without one has sessions of single times. Rows:
    station, sensor, first_ts, last_ts, n; each once its end has passed. On a whole history they are
    the blocks of ``continuous_blocks``. late is None on a table or where the stream has its watermark.
    """
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = (timed.withWatermark("ts", late) if late else timed).join(usual.select("station", "sensor", "usual_s"), ["station", "sensor"], "left")
    # a session ends before ts + gap: a microsecond more keeps a gap of exactly the factor inside
    gap = F.concat((F.floor(F.coalesce("usual_s", F.lit(0.0)) * (factor * 1e6)) + 1).cast("long").cast("string"), F.lit(" microseconds"))
    w = rows.groupBy("station", "sensor", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    plain = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return w.select("station", "sensor", plain("first_ts"), plain("last_ts"), "n")
