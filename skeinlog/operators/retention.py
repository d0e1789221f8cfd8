"""Retention planners: pure queries that say what an apply step would do.  Time is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlog.functions import constants as C
from skeinlog.functions.text import has_payload
from skeinlog.operators.logs import ancestors


def is_checkpoint() -> Column:
    return F.col("type").isin(C.CHECKPOINT_TYPES)


def exempt(tags: str = "tags") -> Column:
    return F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(t) for t in C.PIN_TAGS])), F.lit(False))


def nth_checkpoint(log: DataFrame, n: int = 1) -> DataFrame:
    """``artifact_id, anchor``: order of the n-th newest checkpoint of each log that has so many."""
    w = Window.partitionBy("artifact_id").orderBy(F.desc("seq"))
    return log.where(is_checkpoint()).withColumn("__n", F.row_number().over(w)).where(F.col("__n") == n).select("artifact_id", F.col("seq").alias("anchor"))


def snapshot_count(log: DataFrame) -> DataFrame:
    return log.groupBy("artifact_id").agg(F.count_if(is_checkpoint()).alias("snapshots"))


def prune_plan(log: DataFrame, artifacts: DataFrame, tips: DataFrame | None = None, keep: int = 1) -> DataFrame:
    """Events that compaction would move: before the anchor, not pinned, not in the ancestry of a branch tip."""
    pinned = artifacts.where(exempt()).select("artifact_id")
    before = log.join(nth_checkpoint(log, keep), "artifact_id").where(F.col("seq") < F.col("anchor")).join(pinned, "artifact_id", "left_anti")
    if tips is not None:
        before = before.join(ancestors(log, tips), ["artifact_id", "hash"], "left_anti")
    return before.drop("anchor")


def prune_summary(plan: DataFrame) -> DataFrame:
    """``artifact_id, moved, moved_bytes``: a line's bytes and its newline."""
    return plan.groupBy("artifact_id").agg(F.count("*").alias("moved"), F.sum(F.col("bytes") + 1).alias("moved_bytes"))


def prune_gate(plan: DataFrame, acks: DataFrame, keep_all: bool = False, forced: bool = False) -> DataFrame:
    """Plan rows with ``state``: skipped (all snapshots are kept), blocked (a peer hasn't acked) or permitted."""
    waiting = acks.groupBy("artifact_id").agg(F.bool_and("acked").alias("all_acked"))
    state = F.when(F.lit(keep_all), "skipped").when(F.lit(forced) | F.coalesce("all_acked", F.lit(True)), "permitted").otherwise("blocked")
    return plan.join(waiting, "artifact_id", "left").withColumn("state", state).drop("all_acked")


def snapshot_due(log: DataFrame, artifacts: DataFrame, max_age_seconds: dict[str, int], as_of: str, byte_limit: int = 64 << 20) -> DataFrame:
    """Artifacts whose head is no checkpoint and older than their kind allows; large conversations are left out."""
    head = log.groupBy("artifact_id").agg(F.max_by(F.struct("type", "ts"), "seq").alias("h"), F.sum("bytes").alias("log_bytes"))
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("h.ts").cast("timestamp"))
    limit = F.lit(None).cast("long")
    for kind, seconds in max_age_seconds.items():
        if seconds > 0:
            limit = F.when(F.col("kind") == kind, F.lit(seconds)).otherwise(limit)
    small = (F.col("kind") != "conversation") | ((F.col("log_bytes") <= byte_limit) & (F.coalesce("source_bytes", F.lit(0)) <= byte_limit))
    return artifacts.join(head, "artifact_id").where(~F.col("h.type").isin(C.CHECKPOINT_TYPES) & (age >= limit) & small).select("artifact_id", "kind", age.alias("age_seconds"))


def snapshot_cadence(log: DataFrame, artifacts: DataFrame, every: dict[str, int]) -> DataFrame:
    """Artifacts whose total number of events is a multiple of their kind's threshold (0: never)."""
    counts = log.groupBy("artifact_id").agg(F.count("*").alias("event_count"))
    threshold = F.lit(0)
    for kind, n in every.items():
        threshold = F.when(F.col("kind") == kind, F.lit(n)).otherwise(threshold)
    joined = artifacts.join(counts, "artifact_id").withColumn("__t", threshold)
    return joined.where("__t > 0").where(F.col("event_count") % F.col("__t") == 0).select("artifact_id", "event_count")


def stale_branches(rollup: DataFrame, as_of: str, max_age_seconds: int) -> DataFrame:
    """Side branches without events for too long that were not merged."""
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("last_at").cast("timestamp"))
    return rollup.where((F.col("branch") != C.MAIN) & F.col("merged_into").isNull() & (age >= max_age_seconds)).select("artifact_id", "branch", age.alias("age_seconds"))


def asserted_slots(log: DataFrame) -> DataFrame:
    """Attachment slots that payload-bearing events assert: one row a slot, ``attachments`` exploded with their place."""
    bearing = F.col("type").isin(C.PAYLOAD_TYPES) | (is_checkpoint() & has_payload(F.col("payload")))
    out = log.where(bearing).select("artifact_id", "seq", "ts", F.posexplode("attachments").alias("slot", "a"))
    return out.select("artifact_id", "seq", "ts", "slot", F.col("a.content_hash").alias("content_hash"), F.col("a.bytes").alias("bytes"), F.col("a.evicted").alias("evicted")).where("coalesce(content_hash, '') <> ''")


def live_blobs(slots: DataFrame) -> DataFrame:
    """Hashes that some artifact's last assertion still holds."""
    last = slots.groupBy("artifact_id", "content_hash").agg(F.max_by(F.coalesce("evicted", F.lit(False)), F.struct("seq", "slot")).alias("gone"))
    return last.groupBy("content_hash").agg(F.bool_or(~F.col("gone")).alias("live")).where("live").select("content_hash")


def collectible_blobs(blobs: DataFrame, live: DataFrame, as_of: str, grace_seconds: int = 3600) -> DataFrame:
    """Blobs that nothing holds and that are older than the grace time."""
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("mtime").cast("timestamp"))
    return blobs.join(live, F.col("hash") == F.col("content_hash"), "left_anti").where(age > grace_seconds)


def evict_plan(slots: DataFrame, artifacts: DataFrame, as_of: str, min_age_seconds: int) -> DataFrame:
    """Slots to evict: old, held by their newest assertion, which is old too; each hash at its first eligible event."""
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {min_age_seconds})")
    pinned = artifacts.where(exempt()).select("artifact_id")
    newest = slots.groupBy("artifact_id", "content_hash").agg(F.max_by(F.struct("ts", F.coalesce("evicted", F.lit(False)).alias("evicted")), F.struct("seq", "slot")).alias("n"))
    due = newest.where(~F.col("n.evicted") & (F.col("n.ts").cast("timestamp") < cutoff)).select("artifact_id", "content_hash")
    old = slots.where(~F.coalesce("evicted", F.lit(False)) & (F.col("ts").cast("timestamp") < cutoff)).join(due, ["artifact_id", "content_hash"]).join(pinned, "artifact_id", "left_anti")
    return old.groupBy("artifact_id", "content_hash").agg(F.min_by(F.struct("seq", "slot", "bytes"), F.struct("seq", "slot")).alias("f")).select("artifact_id", "content_hash", "f.seq", "f.bytes")


def backfill(conversations: DataFrame, targets: list[str], cap: int, include_source: bool = False) -> DataFrame:
    """``conv_id, target`` for a uniform cap: each target's newest conversations, its own left out; negative is no cap."""
    pairs = conversations.withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
    kept = pairs if include_source else pairs.where(~F.col("source").eqNullSafe(F.col("target")))
    if cap < 0:
        return kept.select("conv_id", "target")
    w = Window.partitionBy("target").orderBy(F.desc("updated_at"), F.desc("conv_id"))
    return kept.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= cap).select("conv_id", "target")


def backfill_varying(conversations: DataFrame, targets: list[str]) -> DataFrame:
    """As ``backfill`` with a cap per conversation in column ``cap``.

    A conversation is taken while fewer than its own cap were taken before it;
    uncapped ones (negative) are always taken and use up nothing.  The walk depends
    on order, so it is done in one pass a target; but of the conversations with one cap
    no more than the first ``cap`` can be taken, so only those go there.
    """
    import pyarrow as pa

    pairs = conversations.withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets]))).where(~F.col("source").eqNullSafe(F.col("target"))).select("conv_id", "target", "updated_at", "cap")
    top = conversations.agg(F.max("cap")).first()[0] or 0
    order = Window.partitionBy("target", "cap").orderBy(F.desc("updated_at"), F.desc("conv_id"))
    some = pairs.where("cap > 0").withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= top).where("__n <= cap").drop("__n")

    def walk(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("updated_at", "descending"), ("conv_id", "descending")])
        taken, kept = 0, []
        for cap in rows.column("cap").to_pylist():
            kept.append(taken < cap)
            taken += kept[-1]
        return rows.filter(pa.array(kept)).select(["conv_id", "target"])

    free = pairs.where("cap < 0").select("conv_id", "target")
    return free.unionByName(some.groupBy("target").applyInArrow(walk, free.schema))


def store_areas(files: DataFrame) -> DataFrame:
    """``area, files, bytes`` of a store: events, compacted, blobs and other, by path."""
    path = F.col("path")
    area = F.when(F.contains(path, F.lit("/.compacted/")), "compacted").when(F.contains(path, F.lit("/events/")), "events").when(F.contains(path, F.lit("/blobs/")), "blobs").otherwise("other")
    return files.groupBy(area.alias("area")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def pressure(areas: DataFrame, quota: int, watermark: float = 0.8, emergency: float = 0.95) -> DataFrame:
    """Total bytes against a quota: over the watermark, in emergency, and whether reclaiming can't reach it."""
    total = areas.agg(F.sum("bytes").alias("total"), F.sum(F.when(F.col("area").isin("compacted", "blobs"), F.col("bytes")).otherwise(0)).alias("reclaimable"))
    return total.select("total", (F.col("total") > quota * watermark).alias("over_watermark"), (F.col("total") > quota * emergency).alias("emergency"), ((F.col("total") - F.col("reclaimable")) > quota * watermark).alias("unreachable"))


def gc_report(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Markdown lines of a report, the total last, and the total alone."""
    total = actions.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))
    line = F.format_string("| %s | %s | %d |", "action", "artifact_id", "bytes")
    rows = actions.select(F.lit(0).alias("part"), line.alias("line"))
    return rows.unionByName(total.select(F.lit(1).alias("part"), F.format_string("| total |  | %d |", "total_bytes").alias("line"))), total
