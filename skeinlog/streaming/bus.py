"""The broadcast bus and its durable stores: numbers, slow subscribers, gaps and upserts, in their batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: events that a subscriber's buffer holds.
SLOTS = 64


def numbered(events: DataFrame, time: str = "ts", order: str = "event_id", bucket: str = "hour") -> DataFrame:
    """Events with ``seq``, counted from 1 by time and ``order``.

    Events are counted by bucket of time first, so that a window holds the buckets'
    counts or one bucket's events, never all events.
    """
    cut = events.withColumn("__b", F.date_trunc(bucket, F.col(time)))
    counts = cut.groupBy("__b").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("__b").alias("__bucket"), before.alias("__before"))
    own = F.row_number().over(Window.partitionBy("__b").orderBy(time, order))
    return cut.withColumn("__n", own).join(offsets, F.col("__b").eqNullSafe(F.col("__bucket"))).withColumn("seq", F.col("__before") + F.col("__n")).drop("__b", "__bucket", "__before", "__n")


def delivered(published: DataFrame, drained: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Published events (``subscriber, seq``) with ``dropped``: whether the subscriber's buffer was full.

    ``drained``: ``subscriber, seq`` of the events after which it emptied its
    buffer.  Between two of these it takes ``slots`` events and drops the others.
    """
    marks = drained.select("subscriber", "seq", F.lit(1).alias("__mark")).distinct()
    joined = published.join(marks, ["subscriber", "seq"], "left")
    w = Window.partitionBy("subscriber").orderBy("seq")
    part = joined.withColumn("__part", F.coalesce(F.sum(F.coalesce("__mark", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("subscriber", "__part").orderBy("seq"))
    return part.withColumn("dropped", place > slots).drop("__mark", "__part")


def drop_counts(flagged: DataFrame) -> DataFrame:
    """``subscriber, delivered, dropped``."""
    return flagged.groupBy("subscriber").agg(F.count_if(~F.col("dropped")).alias("delivered"), F.count_if("dropped").alias("dropped"))


def server_sent(seq: Column, kind: Column, data: Column) -> Column:
    """An event in the text form of a server-sent stream; each line of ``data`` gets its field name."""
    return F.concat(F.lit("id: "), seq.cast("string"), F.lit("\nevent: "), kind, F.lit("\ndata: "), F.replace(data, F.lit("\n"), F.lit("\ndata: ")), F.lit("\n\n"))


def gaps(entries: DataFrame, lane: str = "lane", seq: str = "seq") -> DataFrame:
    """``lane, from_seq, to_seq`` of the numbers that a lane lacks between those it has."""
    after = F.lead(seq).over(Window.partitionBy(lane).orderBy(seq))
    return entries.select(lane, F.col(seq).alias("__s"), after.alias("__next")).where("__next > __s + 1").select(lane, (F.col("__s") + 1).alias("from_seq"), (F.col("__next") - 1).alias("to_seq"))


def inbox(stored: DataFrame, arrived: DataFrame, key: list[str], order: str) -> DataFrame:
    """Entries of an inbox after new ones arrived: one a key, the first that was stored; again with the same entries it stays as it is."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(arrived.withColumn("__new", F.lit(1)))
    rest = [c for c in stored.columns if c not in key]
    first = both.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("__new", order)).alias("e"))
    return first.select(*key, "e.*")


def upserted(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a table after an upsert: incoming rows replace those of their key.  Incoming keys must be distinct."""
    return current.join(incoming.select(*key), key, "left_anti").unionByName(incoming)


def new_messages(stored: DataFrame, incoming: DataFrame, identity: list[str]) -> DataFrame:
    """Incoming messages that a session lacks, each once."""
    return incoming.dropDuplicates(identity).join(stored.select(*identity).distinct(), identity, "left_anti")
