"""The driver tables as parts of the event model (surrogates, chosen here)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.session import load_table


def conv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as inner events: one turn a row, ordered by ``pos``."""
    t = load_table(spark, sf_dir, "conversations")
    return t.select(F.col("conv_id").alias("artifact_id"), F.col("turn").alias("pos"), F.lit("turn").alias("type"), "role", "text")


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as logs: a user is an artifact, order is by time then id."""
    t = load_table(spark, sf_dir, "events")
    return t.select(F.col("user_id").alias("artifact_id"), "event_id", "ts", F.col("event_type").alias("type"), "value", F.col("props").alias("payload"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memory artifacts: source is the agent, the language and labels are tags."""
    docs, labels = load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels")
    tags = F.array_compact(F.array("lang", F.when(F.col("quality") == 1, "pinned"), F.when(F.col("toxic") == 1, "private")))
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("artifact_id"), F.lit("memory").alias("kind"), F.col("source").alias("agent"), tags.alias("tags"), "n_chars", "text")
