"""The tables that the engine keeps, and their creation where they are missing. (ST-01)"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# Columns of the stored tables.
FACTS = "station string, sensor string, ts timestamp_ntz, value double, code string, path string, day date"
JOURNAL = "path string, name string, size long, digest string, status string, n_rows long, seen_at timestamp_ntz"
REJECTS = "path string, name string, digest string, reason string, text string"
PROPOSALS = "id string, station string, declared string, proposed string, reason string, sensors map<string,string>, rules string, provenance string, created_at timestamp_ntz, updated_at timestamp_ntz, status string, answered_at timestamp_ntz, answered_by string, comment string"
HISTORY = "id string, station string, before string, after string, origin string, proposal_id string, reason string, by string, at timestamp_ntz"


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or one without rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def create_if_absent(spark: SparkSession, path: str, schema: str, partitions: tuple[str, ...] = ()) -> None:
    """An empty table in a folder that has none yet."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*partitions).parquet(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """The stored readings. Sensors are names of folders, which without the schema would be read as numbers."""
    return read_or_empty(spark, path, FACTS)
