"""What surrounds a campaign: the lock, snapshots, and results that are kept until the facts change."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from gaugewright.operators.listing import change_signature
from gaugewright.sources.schemas import FACTS

#: Hours after which a lock is taken for that of a run that was cut off.
EXPIRY_H = 6.0


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path, so that any store that Spark reaches will do."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _token(files, place) -> str | None:
    """What a lock's file says, if it is there."""
    try:
        stream = files.open(place)
    except Exception as e:  # py4j's error of a file that another run removed
        if "FileNotFoundException" in str(e):
            return None
        raise
    try:
        return bytes(stream.readNBytes(64)).decode("ascii", "replace")
    finally:
        stream.close()


def _claim(files, place, token: str) -> bool:
    """Writes the token to a file that isn't there yet; False if another run was first."""
    try:
        stream = files.create(place, False)
    except Exception as e:
        if "FileAlreadyExistsException" in str(e) or "already exists" in str(e):
            return False
        raise
    stream.write(bytearray(token.encode()))
    stream.close()
    return True


@contextmanager
def campaign_lock(spark: SparkSession, path: str, expiry_h: float = EXPIRY_H):
    """True inside the block for the one run that holds the lock, False for others, which should leave. (ST-08)

    The lock is a file, created only where there is none, that holds its run's token. One older than
    ``expiry_h`` hours is a cut-off run's: it is moved aside, which only one of several runs can do,
    and only if what was moved is the lock that had expired. A run removes only a lock of its own
    token, so that one that ends late leaves its successor's alone.
    """
    files, place = _file_system(spark, path)
    token = uuid.uuid4().hex
    old = _token(files, place)
    if old is not None and files.exists(place) and time.time() - files.getFileStatus(place).getModificationTime() / 1000 >= expiry_h * 3600:
        _set_aside(spark, files, place, path, old)
    mine = _claim(files, place, token)
    try:
        yield mine
    finally:
        if mine and _token(files, place) == token:
            _set_aside(spark, files, place, path, token)


def _set_aside(spark: SparkSession, files, place, path: str, token: str) -> bool:
    """Moves the lock away and removes it if it holds the token; a lock of another run, taken meanwhile, goes back where it was."""
    aside = _file_system(spark, f"{path}.{uuid.uuid4().hex}")[1]
    try:
        moved = files.rename(place, aside)
    except Exception as e:
        if "FileNotFoundException" in str(e):
            return False
        raise
    if not moved:
        return False
    if _token(files, aside) == token:
        files.delete(aside, False)
        return True
    files.rename(aside, place)
    return False


def snapshot(spark: SparkSession, table_path: str, backups: str, label: str, schema: str = FACTS) -> str:
    """A copy of a table's rows as its files are listed now, in a folder of its own, whose path is returned. (SNK-07)

    The schema is given, for folder names alone would turn identifiers into numbers.

    It is written beside and renamed, so that a folder of that name is always whole; one that exists is an error.
    """
    files, place = _file_system(spark, f"{backups}/{label}")
    if files.exists(place):
        raise FileExistsError(f"{backups}/{label}")
    part = f"{backups}/_{label}-{uuid.uuid4().hex}"
    df = spark.read.schema(schema).parquet(table_path)
    folders = [c for c in ("sensor", "day") if c in df.columns]
    df.write.partitionBy(*folders).parquet(part)
    files.rename(_file_system(spark, part)[1], place)
    return f"{backups}/{label}"


class KeptResults:
    """Results that are worked out again only when the facts' signature changes, or after a time. (ST-10)

    A result is written to the shared folder, not held in memory; at most ``size`` are remembered. One
    that is outdated or forgotten is removed, ``keep_s`` seconds after it was replaced, so that those
    who still read it can end.
    """

    def __init__(self, folder: str, ttl_s: float = 300.0, size: int = 32, keep_s: float = 3600.0):
        self.folder, self.ttl_s, self.size, self.keep_s = folder, ttl_s, size, keep_s
        self._known: dict[str, tuple[str, float, str]] = {}
        self._gone: list[tuple[float, str]] = []

    def _clear(self, spark: SparkSession) -> None:
        due = [p for at, p in self._gone if time.monotonic() - at >= self.keep_s]
        self._gone = [x for x in self._gone if x[1] not in due]
        for path in due:
            files, place = _file_system(spark, path)
            files.delete(place, True)

    def get(self, name: str, facts: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        signature = change_signature(facts).first()["signature"]
        kept = self._known.get(name)
        if not kept or kept[0] != signature or time.monotonic() - kept[1] >= self.ttl_s:
            path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
            make(facts).write.parquet(path)
            if kept:
                self._gone.append((time.monotonic(), self._known.pop(name)[2]))
            self._known[name] = kept = signature, time.monotonic(), path
            while len(self._known) > self.size:
                self._gone.append((time.monotonic(), self._known.pop(next(iter(self._known)))[2]))
            self._clear(facts.sparkSession)
        return facts.sparkSession.read.parquet(kept[2])
