"""Streams of file changes and failures: debounce, dedupe, guards, quarantine, lanes, cursors.

Each operator has a batch form over a table of events.  Those that need state on
a live stream have a streaming form beside it; sinks are idempotent by key, as
micro-batches may be delivered again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Quiet time in ms, size up to which contents are hashed, and quarantine limits.
QUIET_MS = 500
HASH_BYTES = 8 << 20
FAILURES, FAILURE_WINDOW_S = 3, 600


def content_hash() -> Column:
    """Hash of a small file's content; of size and time for a large one."""
    meta = F.sha2(F.concat_ws(":", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")), 256)
    return F.when(F.col("length") <= HASH_BYTES, F.sha2(F.col("content"), 256)).otherwise(F.concat(F.lit("meta:"), meta))


def settled(changes: DataFrame, quiet_ms: int = QUIET_MS, key: str = "path", time: str = "ts", order: str = "event_id") -> DataFrame:
    """The changes after which a path stays quiet for ``quiet_ms`` or longer; a gap of exactly that length is quiet."""
    w = Window.partitionBy(key).orderBy(time, order)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = micros(F.lead(time).over(w)) - micros(F.col(time))
    return changes.withColumn("__gap", gap).where(F.col("__gap").isNull() | (F.col("__gap") >= quiet_ms * 1000)).drop("__gap")


def changed_only(settles: DataFrame, key: str = "path", time: str = "ts", order: str = "event_id") -> DataFrame:
    """Settles whose hash differs from the last *committed* one of their path.

    ``committed`` tells whether a settle's sink succeeded.  A settle that failed
    leaves the last hash as it was, so the same content comes through again.
    """
    w = Window.partitionBy(key).orderBy(time, order)
    before = F.last(F.when(F.col("committed"), F.col("content_hash")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return settles.withColumn("__last", before).where(~F.col("content_hash").eqNullSafe(F.col("__last"))).drop("__last")


def debounce_stream(changes: DataFrame, quiet_ms: int = QUIET_MS, late_ms: int = 2000) -> DataFrame:
    """Live debounce by session windows: one row per path and burst, with the last change's hash."""
    timed = changes.withWatermark("ts", f"{late_ms} milliseconds")
    burst = timed.groupBy("path", F.session_window("ts", f"{quiet_ms} milliseconds"))
    return burst.agg(F.max_by("content_hash", "ts").alias("content_hash"), F.max("ts").alias("last_change"), F.count("*").alias("n_changes")).select("path", "last_change", "n_changes", "content_hash")


def deduped(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events with each id once: within the watermark on a live stream, over all of a table."""
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def commit_stream(settles: DataFrame, checkpoint: str, commit: Callable[[DataFrame, int], None]):
    """Start ``commit`` on each micro-batch; ``commit`` must be idempotent by (path, hash)."""
    return settles.writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(commit).start()


def quarantines(results: DataFrame, threshold: int = FAILURES, window_s: int = FAILURE_WINDOW_S) -> DataFrame:
    """Failures at which a name has ``threshold`` of them since its last success and within the window."""
    w = Window.partitionBy("name").orderBy("ts", "seq")
    cut = results.withColumn("__s", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(w)).where("not ok")
    recent = Window.partitionBy("name", "__s").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-window_s * 1_000_000, 0)
    return cut.withColumn("failures", F.count("*").over(recent)).where(F.col("failures") >= threshold).drop("__s")


def quarantine_stream(results: DataFrame, threshold: int = FAILURES, window_s: int = FAILURE_WINDOW_S) -> DataFrame:
    """Live quarantine: a row when a name's failures reach the threshold; state is the failure times of a name, at most ``threshold``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        out = []
        rows = pd.concat(list(batches)).sort_values("ts")
        for ts, ok in zip(rows["ts"], rows["ok"], strict=True):
            now = int(pd.Timestamp(ts).value // 1000)
            if ok:
                times = []
                continue
            times = [t for t in times if t >= now - window_s * 1_000_000] + [now]
            if len(times) >= threshold:
                out.append((key[0], ts, len(times)))
            times = times[-threshold:]
        state.update((times,))
        yield pd.DataFrame(out, columns=["name", "ts", "failures"])

    return results.groupBy("name").applyInPandasWithState(step, "name string, ts timestamp, failures long", "times array<long>", "append", "NoTimeout")


def guarded(writes: DataFrame, marks: DataFrame, ttl_ms: int) -> DataFrame:
    """Changes that no mark of their path explains: none within ``ttl_ms`` before them."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    m = marks.select(F.col("path").alias("__path"), micros("ts").alias("__mark"))
    near = (F.col("path") == F.col("__path")) & (micros("ts") >= F.col("__mark")) & (micros("ts") < F.col("__mark") + ttl_ms * 1000)
    return writes.join(m, near, "left_anti")


def above_mark(rows: DataFrame, mark: float, time: str = "started_at") -> tuple[DataFrame, DataFrame]:
    """Rows above a high-water mark (strictly), and the new mark; late rows at or under it are missed by design."""
    fresh = rows.where(F.col(time) > mark)
    return fresh, fresh.agg(F.greatest(F.lit(mark), F.coalesce(F.max(time), F.lit(mark))).alias("mark"))


def changed_heads(heads: DataFrame, seen: DataFrame) -> DataFrame:
    """Artifacts whose head isn't the one seen (or failed) last."""
    return heads.join(seen.select("artifact_id", "head"), ["artifact_id", "head"], "left_anti")


def unchanged_skipped(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose size or time differs from the scan cache."""
    return files.join(cache.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")


def fingerprint_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, op`` between two directory listings: CHANGE for new or other files, REMOVE for lost ones."""
    b = before.select("path", F.struct("size", "mtime").alias("__b"))
    a = after.select("path", F.struct("size", "mtime").alias("__a"))
    both = b.join(a, "path", "full").where(~F.col("__a").eqNullSafe(F.col("__b")))
    return both.select("path", F.when(F.col("__a").isNull(), "REMOVE").otherwise("CHANGE").alias("op"))


def newest_per_slot(entries: DataFrame, slot: list[str], order: str = "seq") -> DataFrame:
    """Retained lanes: the newest entry of every slot."""
    return entries.groupBy(*slot).agg(F.max_by(F.struct(*[c for c in entries.columns if c not in slot]), order).alias("e")).select(*slot, "e.*")


def byte_batch(entries: DataFrame, budget: int, lane: str = "lane", order: str = "seq", size: str = "bytes") -> DataFrame:
    """The oldest entries of each lane up to a byte budget; the first always."""
    w = Window.partitionBy(lane).orderBy(order)
    kept = entries.withColumn("__n", F.row_number().over(w)).withColumn("__sum", F.sum(size).over(w))
    return kept.where((F.col("__n") == 1) | (F.col("__sum") <= budget)).drop("__n", "__sum")


def dead_letters(entries: DataFrame, cap: int, lane: str = "lane", order: str = "seq") -> DataFrame:
    """The oldest entries of each lane beyond its capacity."""
    w = Window.partitionBy(lane).orderBy(F.desc(order))
    return entries.withColumn("__n", F.row_number().over(w)).where(F.col("__n") > cap).drop("__n")


def cursor_moves(moves: DataFrame, max_span: int = 16) -> DataFrame:
    """Cursor moves with ``ok``: the same position again, or one that follows the one before by its span (1 to ``max_span``)."""
    w = Window.partitionBy("cursor").orderBy("seq")
    before = F.lag("position").over(w)
    follows = F.col("span").between(1, max_span) & F.when(before.isNull(), F.col("position") == F.col("span")).otherwise(F.col("position") == before + F.col("span"))
    return moves.withColumn("ok", F.coalesce((F.col("position") == before) | follows, F.lit(False)))


def store_fingerprint(artifacts: DataFrame) -> DataFrame:
    """Number of artifacts and newest update: equal fingerprints need no sweep."""
    return artifacts.agg(F.count("*").alias("n"), F.max("updated_at").alias("newest"))


def sweep_interval(base_s: int, cap_s: int, unchanged: int) -> int:
    """Seconds to the next sweep after ``unchanged`` sweeps without drift: doubled each time, capped; drift resets it."""
    return min(cap_s, base_s * 2 ** min(unchanged, 30))


def sweeps(history: DataFrame, base_s: int, cap_s: int) -> DataFrame:
    """Observations of store fingerprints (``at, n, newest``) with ``drift``, how many before it were ``unchanged`` in a row, and the ``wait`` in seconds to the next one.

    The first observation drifts.  One without drift needs no sweep and doubles the wait, up to the cap.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("at")
    before = F.lag(F.struct("n", "newest")).over(w)
    marked = history.withColumn("drift", ~F.coalesce(before.eqNullSafe(F.struct("n", "newest")), F.lit(False)))
    run = marked.withColumn("__run", F.sum(F.col("drift").cast("int")).over(w))
    unchanged = F.row_number().over(Window.partitionBy("__run").orderBy("at")) - 1
    out = run.withColumn("unchanged", unchanged).drop("__run")
    return out.withColumn("wait", F.least(F.lit(cap_s), F.lit(base_s) * F.pow(F.lit(2.0), F.least("unchanged", F.lit(30)))).cast("long"))
