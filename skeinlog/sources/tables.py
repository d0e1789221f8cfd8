"""Engine storage: canonical tables in Parquet, split by kind, and their readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = (
    "artifact_id string, kind string, seq bigint, event_id string, type string, ts timestamp, ts_nanos bigint, device_id string, source_agent string, agent_version string, adapter_version string, caused_by string, payload string, "
    "parent_hash string, hash string, snapshot_state string, branch string, fork_source_branch string, fork_origin_agent string, merge_from_branch string, merge_from_hash string, merge_strategy string, event_tags array<string>, "
    "aligned_head string, aligned_event_id string, compacted boolean"
)


def read_events(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The event table; a kind reads its partition only."""
    table = spark.read.schema(EVENTS).parquet(path)
    return table.where(F.col("kind") == kind) if kind else table


def append_events(events: DataFrame, path: str) -> None:
    """Append events, a folder a kind."""
    events.write.mode("append").partitionBy("kind").parquet(path)


def read_event_lines(spark: SparkSession, path: str) -> DataFrame:
    """Events from JSON lines, plain or gzip; their writer gives ``seq``."""
    return spark.read.schema(EVENTS).json(path)


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """New files of the event table as a stream."""
    return spark.readStream.schema(EVENTS).parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, modificationTime, sha256`` of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))
