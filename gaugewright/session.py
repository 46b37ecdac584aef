"""Session factory and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "gaugewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators rely on: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and the master is local, as
    in tests on one machine, a temporary folder is made and set; a cluster without the setting is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gaugewright-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows read from reliable storage, with the lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """The same rows, written once as Parquet in the shared folder and read from there; for the state of a loop.

    A checkpoint keeps the size that was estimated for its plan, and the estimate of a join is the
    product of its sides, so that in a loop of joins it grows to a number of astronomical length. Of a
    written table the size is known. ``instead_of``, the state of the round before, is deleted then.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, "rounds")
    df.write.parquet(path)
    if (old := getattr(instead_of, "stored_at", None)) is not None:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder for a written table."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
