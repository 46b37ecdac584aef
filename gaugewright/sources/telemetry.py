"""Telemetry text files: parsing, writing, names, journal and the idempotent fact table.

A file is blocks of ``YYYYMMDD;HH:MM:SS;value`` rows, each under a header that names its station and
sensor. Files are read whole, so that lines keep their order, and split again by Spark's functions:
no file's lines meet another's, and a file is one row until its lines are exploded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugewright.functions.scalar import file_date, file_station, general_number, number_or_null, state_code
from gaugewright.operators.series import insert_if_absent
from gaugewright.session import checkpointed
from gaugewright.sources.schemas import FACTS, JOURNAL, read_or_empty

_HEADER = "<STATION>"


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files named ``*.MIS`` in any case, below one folder or several: path, name, size, digest and text. (SRC-12, SRC-14, SRC-16)

    Spark's readers pass over files of no bytes, so these get no row.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[Mm][Ii][Ss]").load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def parse_telemetry(files: DataFrame) -> DataFrame:
    """Readings of files (path, text): path, block, line, station, sensor, ts, value, code. (SRC-01, SRC-02)

    Rows before the first header belong to it (Q-07); a repeated header begins a new block; rows of
    other than three fields or with an unreadable time are left out; a value that is no number is
    null with its code. A file with a header that lacks a tag gives no rows, like one without any
    header: see ``file_status``.
    """
    lines = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw")).withColumn("raw", F.trim("raw")).where("raw <> ''")
    head = F.startswith(F.col("raw"), F.lit(_HEADER))
    station, sensor = F.regexp_extract("raw", "<STATION>(.*?)</STATION>", 1), F.regexp_extract("raw", "<SENSOR>(.*?)</SENSOR>", 1)
    broken = head & ~(F.col("raw").rlike("<STATION>.*?</STATION>") & F.col("raw").rlike("<SENSOR>.*?</SENSOR>"))
    per_file = Window.partitionBy("path")
    so_far = per_file.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumns({"_h": head, "_st": F.when(head, station), "_se": F.when(head, sensor), "_bad": F.max(broken).over(per_file)}).where("not _bad")
    marked = marked.withColumn("block", F.greatest(F.sum(F.col("_h").cast("int")).over(so_far), F.lit(1)))
    filled = marked.withColumns({"station": F.max("_st").over(Window.partitionBy("path", "block")), "sensor": F.max("_se").over(Window.partitionBy("path", "block"))})
    fields = F.split("raw", ";")
    rows = filled.where(~F.col("_h") & F.col("station").isNotNull() & (F.size(fields) == 3) & F.col("raw").rlike(r"^\d{8};\d{2}:\d{2}:\d{2};"))
    ts = F.try_to_timestamp(F.concat(fields[0], F.replace(fields[1], F.lit(":"))), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    out = rows.select("path", "block", "line", "station", "sensor", ts.alias("ts"), number_or_null(fields[2]).alias("value"), state_code(fields[2]).alias("code"))
    return out.where("ts is not null")


def file_status(files: DataFrame, readings: DataFrame, journal: DataFrame, simulated: DataFrame | None = None) -> DataFrame:
    """Each file's outcome in a campaign: instable, vide, doublon, illisible, refuse_provenance or ingere. (ST-09, SRC-04)

    ``journal`` has the digests of earlier campaigns. Of files with one content in a campaign the
    first by path is ingested. ``simulated`` (station) names stations that real files may not feed.
    ``files`` may have ``size_now``, the size at a second look: a file that still grows is unstable,
    gets no journal row and comes again.
    """
    first = Window.partitionBy("digest").orderBy("path")
    growing = F.col("size") != F.col("size_now") if "size_now" in files.columns else F.lit(False)
    seen = journal.select("digest").distinct().withColumn("_seen", F.lit(True))
    parsed = readings.groupBy("path").agg(F.count("*").alias("n_rows"))
    s = files.withColumn("_grows", growing).withColumn("_rn", F.row_number().over(first)).join(seen, "digest", "left").join(parsed, "path", "left")
    refused = F.lit(False)
    if simulated is not None:
        bad = readings.join(simulated.select("station").distinct(), "station", "left_semi").select("path").distinct().withColumn("_sim", F.lit(True))
        s, refused = s.join(bad, "path", "left"), F.coalesce("_sim", F.lit(False))
    status = F.when(F.col("_grows"), "instable").when(F.col("size") == 0, "vide").when(F.col("_seen") | (F.col("_rn") > 1), "doublon").when(F.col("n_rows").isNull(), "illisible").when(refused, "refuse_provenance").otherwise("ingere")
    return s.select("path", "name", "size", "digest", status.alias("status"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def latest_journal(journal: DataFrame) -> DataFrame:
    """The last row of each digest in the append-only journal. (SNK-02)"""
    order = Window.partitionBy("digest").orderBy(F.desc_nulls_last("seen_at"), F.desc("path"))
    return journal.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def quarantined(files: DataFrame, status: DataFrame) -> DataFrame:
    """Files that could not be read or may not be taken, with the reason and their text: the table of rejects. (ST-09, STR-quarantine)"""
    header = F.col("text").rlike("(?m)^[ \\t]*<STATION>")
    reason = F.when(F.col("status") == "refuse_provenance", "a station of simulated data").when(F.col("text").isNull(), "no text").when(header, "a header without station or sensor, or no usable row").otherwise("no header")
    bad = status.where("status in ('illisible', 'refuse_provenance')").select("path", "status")
    return files.join(bad, "path").select("path", "name", "digest", reason.alias("reason"), "text")


def prune_names(files: DataFrame, since=None, stations: list[str] | None = None, journal: DataFrame | None = None) -> DataFrame:
    """Files whose names and sizes don't rule them out before they are read; other names pass. (FLT-07)"""
    at, own = file_date(F.col("name")), file_station(F.col("name"))
    keep = F.lit(True)
    if since is not None:
        keep = keep & F.coalesce(at >= F.lit(since).cast("timestamp_ntz"), F.lit(True))
    if stations is not None:
        keep = keep & F.coalesce(own.isin(stations), F.lit(True))
    out = files.where(keep)
    return out.join(journal.select("name", "size").distinct(), ["name", "size"], "left_anti") if journal is not None else out


def ingest(spark: SparkSession, path: str | list[str], facts_path: str, journal_path: str, since=None, stations: list[str] | None = None, simulated: DataFrame | None = None, dry_run: bool = False, rejects_path: str | None = None) -> DataFrame:
    """A campaign over a folder or several uploads: lists, prunes, parses, and appends new readings, rejects and journal rows. Returns the files' outcomes.

    Running it again adds nothing: digests in the journal are duplicates, and keys in the fact table
    never enter twice, the earliest file and line winning. Files are listed twice, so that one whose
    size changes meanwhile is left for the next campaign. ``dry_run`` writes nothing.
    """
    journal = read_or_empty(spark, journal_path, JOURNAL)
    now = read_files(spark, path).select("path", F.col("size").alias("size_now"))
    files = prune_names(read_files(spark, path), since, stations, journal).join(now, "path", "left")
    return store(files, facts_path, journal_path, simulated, dry_run, rejects_path)


def store(files: DataFrame, facts_path: str, journal_path: str, simulated: DataFrame | None = None, dry_run: bool = False, rejects_path: str | None = None) -> DataFrame:
    """Judges files (path, name, size, digest, text) against the journal and stores what is new; returns their outcomes.

    The order is facts, rejects, journal: if the last step is lost, the files come again and their
    readings are found to be there. Facts lie in a folder for each sensor and day, and a batch is held
    against its own sensors' and days' alone.
    """
    spark = files.sparkSession
    journal = read_or_empty(spark, journal_path, JOURNAL)
    readings = parse_telemetry(files)
    status = checkpointed(file_status(files, readings, journal, simulated))
    if dry_run:
        return status
    good = readings.join(status.where("status = 'ingere'").select("path"), "path", "left_semi").where("value is not null").withColumns({"_o": F.struct("path", "line"), "day": F.to_date("ts")})
    touched = good.agg(F.collect_set("sensor").alias("sensors"), F.min("day").alias("a"), F.max("day").alias("b")).first()
    if touched["sensors"]:
        facts = read_or_empty(spark, facts_path, FACTS).where(F.col("sensor").isin(touched["sensors"]) & F.col("day").between(touched["a"], touched["b"]))
        fresh = checkpointed(insert_if_absent(facts, good, "_o").select("station", "sensor", "ts", "value", "code", "path", "day"))
        fresh.repartition("sensor", "day").write.mode("append").partitionBy("sensor", "day").parquet(facts_path)
    if rejects_path:
        quarantined(files, status).write.mode("append").parquet(rejects_path)
    status.where("status <> 'instable'").withColumn("seen_at", F.current_timestamp().cast("timestamp_ntz")).write.mode("append").parquet(journal_path)
    return status


def telemetry_lines(m: DataFrame) -> DataFrame:
    """Readings (station, sensor, ts, value, code) as file text, one row per station and day: station, day and text. (SNK-03)

    A day's text has a block for each sensor, sorted by time, at one time by value as numbers. Numbers have six significant digits; a
    row without a value shows its code. A text never grows beyond a day, however long the history.
    """
    shown = F.when(F.col("value").isNotNull(), general_number(F.col("value"))).otherwise(F.concat(F.lit("---/["), F.coalesce("code", F.lit("0")), F.lit("]")))
    line = F.concat_ws(";", F.date_format("ts", "yyyyMMdd"), F.date_format("ts", "HH:mm:ss"), shown)
    body = m.groupBy("station", "sensor", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "value", line.alias("l")))).alias("rows"))
    block = F.concat(F.lit("<STATION>"), F.col("station"), F.lit("</STATION><SENSOR>"), F.col("sensor"), F.lit("</SENSOR>\n"), F.array_join(F.transform("rows", lambda r: r["l"]), "\n"))
    return body.groupBy("station", "day").agg(F.array_join(F.array_sort(F.collect_list(block)), "\n").alias("text"))


def write_telemetry(m: DataFrame, path: str) -> None:
    """Telemetry text files, in a folder for each station and day. (SNK-03, SNK-04)"""
    texts = telemetry_lines(m).withColumn("day", F.date_format("day", "yyyyMMdd"))
    texts.repartition("station", "day").write.mode("overwrite").partitionBy("station", "day").text(path)
