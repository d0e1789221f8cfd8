"""Counters, gauges, histograms and the suppression ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlog.functions import constants as C
from skeinlog.functions.text import escaped_label


def label_string(labels: str = "labels") -> Column:
    """Labels in order of name, as ``name="value"`` pairs."""
    pairs = F.array_sort(F.map_entries(labels))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit('="'), escaped_label(e["value"]), F.lit('"'))), ",")


def counters(samples: DataFrame) -> DataFrame:
    return samples.groupBy("name", label_string().alias("labels")).agg(F.sum("value").alias("value"))


def gauges(samples: DataFrame) -> DataFrame:
    """The newest value of each series."""
    return samples.groupBy("name", label_string().alias("labels")).agg(F.max_by("value", "ts").alias("value"))


def bucket(value: Column) -> Column:
    """Number of the first bound that is not under the value; one past the last for larger ones."""
    place = F.lit(len(C.HISTOGRAM_BOUNDS))
    for i in range(len(C.HISTOGRAM_BOUNDS) - 1, -1, -1):
        place = F.when(value <= C.HISTOGRAM_BOUNDS[i], F.lit(i)).otherwise(place)
    return place


def histogram(samples: DataFrame, *by: str) -> DataFrame:
    """``by``, ``le``, ``cumulative``: every bound and +Inf, with the samples at or under it.

    Samples are counted by bucket first, so what is expanded to all bounds has
    one row a series.
    """
    bounds = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(b).alias("le")) for i, b in enumerate([str(x) for x in C.HISTOGRAM_BOUNDS] + ["+Inf"])])
    counted = samples.groupBy(*by, bucket(F.col("value")).alias("place")).agg(F.count("*").alias("n"))
    series = counted.select(*by).distinct() if by else counted.limit(1).select(F.lit(1).alias("__one"))
    full = series.select(*by, F.inline(bounds)) if by else series.select(F.inline(bounds))
    w = Window.partitionBy(*by).orderBy("place") if by else Window.partitionBy(F.lit(1)).orderBy("place")
    return full.join(counted, [*by, "place"], "left").select(*by, "le", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("cumulative"))


def exposition(values: DataFrame, kind: str) -> DataFrame:
    """Text lines of counters or gauges, a ``# TYPE`` line before each name."""
    body = F.concat("name", F.when(F.col("labels") == "", "").otherwise(F.concat(F.lit("{"), "labels", F.lit("}"))), F.lit(" "), F.col("value").cast("string"))
    rows = values.select("name", F.lit(1).alias("part"), body.alias("line"))
    heads = values.select("name").distinct().select("name", F.lit(0).alias("part"), F.concat(F.lit("# TYPE "), "name", F.lit(f" {kind}")).alias("line"))
    return heads.unionByName(rows).orderBy("name", "part", "line")


def suppression_ledger(events: DataFrame, as_of: str, exemplars: int = 5) -> DataFrame:
    """Per agent and reason: how often, first and last time, some exemplars, and whether it went quiet.

    A series is stale after four mean intervals without an event, half an hour
    at least.
    """
    made = events.groupBy("agent", "reason").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.slice(F.array_sort(F.collect_set("exemplar")), 1, exemplars).alias("exemplars"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    mean = F.when(F.col("n") > 1, (micros("last_at") - micros("first_at")) / (F.col("n") - 1)).otherwise(0)
    quiet = F.unix_micros(F.lit(as_of).cast("timestamp")) - micros("last_at")
    return made.withColumn("stale", quiet > F.greatest(F.lit(1_800_000_000), 4 * mean))
