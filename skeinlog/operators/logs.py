"""Event logs: heads, tails, pages, chain checks, branches and state folds.

Logs are DataFrames with ``artifact_id`` and an explicit order column ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skeinlog.functions import constants as C
from skeinlog.functions.text import display_path, has_payload
from skeinlog.operators.paths import above
from skeinlog.session import checkpointed


def _branch() -> Column:
    return F.when(F.coalesce("branch", F.lit("")) == "", F.lit(C.MAIN)).otherwise(F.col("branch"))


def row(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def first_event(log: DataFrame, order: Column) -> DataFrame:
    """The first event of each log."""
    return log.groupBy("artifact_id").agg(F.min_by(row(log), order).alias("e")).select("e.*")


def last_event(log: DataFrame, order: Column, *by: str) -> DataFrame:
    """The last event of each log, or of each group of ``by`` in it."""
    return log.groupBy("artifact_id", *by).agg(F.max_by(row(log), order).alias("e")).select("e.*")


def recent_events(log: DataFrame, order: list[Column], n: int, types: list[str] | None = None) -> DataFrame:
    """The last ``n`` events of each log, of the given types; the window keeps ``n`` a log before the shuffle."""
    kept = log.where(F.col("type").isin(types)) if types else log
    w = Window.partitionBy("artifact_id").orderBy(*[o.desc() for o in order])
    return kept.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def recent_headers(log: DataFrame, before: int, n: int) -> DataFrame:
    """Headers (no payload) of each log's last events before a time in ms, with all that tie with the last of ``n``."""
    kept = log.drop("payload").withColumn("seq_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    kept = kept.where(F.col("seq_ms") < before) if before > 0 else kept
    w = Window.partitionBy("artifact_id").orderBy(F.desc("seq_ms"))
    return kept.withColumn("__n", F.rank().over(w)).where(F.col("__n") <= n).drop("__n")


def event_count(log: DataFrame) -> DataFrame:
    return log.groupBy("artifact_id").agg(F.count("*").alias("event_count"))


def merged_layers(active: DataFrame, compacted: DataFrame) -> DataFrame:
    """Active and compacted events in one log, ordered by time, then layer, then place."""
    both = compacted.withColumn("layer", F.lit(0)).unionByName(active.withColumn("layer", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("artifact_id").orderBy("ts", "layer", "seq")
    return both.withColumn("merged_seq", F.row_number().over(w) - 1)


def feed_records(log: DataFrame, local_device: str = "") -> DataFrame:
    """Events as feed rows: sequence in ms, derived type, action, origin and display path."""
    foreign = (F.lit(local_device) != "") & (F.coalesce("device_id", F.lit("")) != "") & (F.col("device_id") != local_device)
    kind = F.when(F.col("type") == "snapshot", "artifact.checkpoint").when(foreign, "artifact.synced").otherwise("artifact.imported")
    made = log.withColumn("feed_type", kind)
    targets = F.coalesce(F.size("synced_agents"), F.lit(0)) > 0
    action = F.when(F.col("feed_type") == "artifact.checkpoint", "checkpointed").when((F.col("feed_type") == "artifact.synced") | targets, "synced").otherwise("imported")
    origin = F.when(F.col("feed_type") == "artifact.checkpoint", "system").when(F.col("feed_type") == "artifact.synced", "remote").otherwise("local")
    return made.withColumns({"seq_ms": F.coalesce(F.unix_millis(F.col("ts").cast("timestamp")), F.lit(0)), "action": action, "origin": origin, "path_shown": display_path(F.col("source_path"))})


def feed_page(records: DataFrame, before: int = 0, limit: int = C.PAGE_DEFAULT) -> DataFrame:
    """The newest ``limit`` rows before a sequence, with all that tie with the last, and the next cursor.

    The border is found by a bounded top-k; only rows at or above it are
    sorted, so no window runs over the whole feed.
    """
    limit = min(max(limit, 1), C.PAGE_MAX)
    kept = records.where(F.col("seq_ms") < before) if before > 0 else records
    border = kept.select("seq_ms").orderBy(F.desc("seq_ms")).limit(limit).agg(F.min("seq_ms").alias("next_before"))
    return kept.join(F.broadcast(border), F.col("seq_ms") >= F.col("next_before"))


# chains


def canonical(columns: list[str]) -> Column:
    """Engine-defined canonical string of an event: its fields in order, null as empty, joined by U+001F."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def event_hash(columns: list[str]) -> Column:
    return F.sha2(canonical(columns), 256)


def verify_chain(log: DataFrame, expected: Column | None = None) -> DataFrame:
    """Faults of each log: ``artifact_id, seq, fault``; an intact log has no row.

    An event's parent is the effective head of its branch: the hash of the event
    before it, or the head that a baseline before it names.  A fork opens a new
    branch from an earlier event; another branch may only open with a
    payload-bearing baseline without parent.
    """
    own = Window.partitionBy("artifact_id", "__b").orderBy("seq")
    head = F.when(F.col("type") == "baseline", F.coalesce("aligned_head", F.lit(""))).otherwise(F.col("hash"))
    placed = log.withColumn("__b", _branch()).withColumn("__head", head)
    placed = placed.withColumns({"__before": F.lag("__head").over(own), "__k": F.row_number().over(own)})
    parent = F.coalesce("parent_hash", F.lit(""))
    known = log.groupBy("artifact_id", F.col("hash").alias("__h")).agg(F.min("seq").alias("__seen"))
    joined = placed.withColumn("__p", parent).join(known.withColumnRenamed("artifact_id", "__a"), (F.col("artifact_id") == F.col("__a")) & (F.col("__p") == F.col("__h")), "left")
    fork, first = F.col("type") == "fork", F.col("__k") == 1
    full = has_payload(F.col("payload"))
    root = first & (F.col("__b") != C.MAIN) & (F.col("type") == "baseline") & (F.col("__p") == "") & full
    fault = F.when(F.col("hash") != expected, "hash") if expected is not None else F.when(F.lit(False), "hash")
    fault = fault.when(fork & ~first, "fork onto a branch that exists")
    fault = fault.when(fork & (F.col("__seen").isNull() | (F.col("__seen") >= F.col("seq"))), "fork parent is no earlier event")
    fault = fault.when(~fork & first & (F.col("__b") != C.MAIN) & ~root, "branch opens without fork")
    fault = fault.when(~fork & (F.col("__p") != F.coalesce("__before", F.lit(""))), "parent is not the head")
    base = F.col("type") == "baseline"
    fault = fault.when(base & (F.coalesce("aligned_head", F.lit("")) == ""), "baseline without head")
    fault = fault.when(base & (F.coalesce("aligned_event_id", F.lit("")) == ""), "baseline without event id")
    fault = fault.when(base & ~full, "baseline without payload")
    return joined.select("artifact_id", "seq", fault.alias("fault")).where("fault is not null")


def intact(log: DataFrame, expected: Column | None = None) -> DataFrame:
    """``artifact_id, intact`` and the first fault of each log."""
    bad = verify_chain(log, expected).groupBy("artifact_id").agg(F.min(F.struct("seq", "fault")).alias("f"))
    return log.select("artifact_id").distinct().join(bad, "artifact_id", "left").select("artifact_id", F.col("f").isNull().alias("intact"), F.col("f.seq").alias("fault_seq"), F.col("f.fault").alias("fault"))


# branches


def branch_rollup(log: DataFrame) -> DataFrame:
    """Per branch: first and last time, head, number of events, fork point and whether it was merged."""
    own = log.withColumn("__b", _branch())
    made = own.groupBy("artifact_id", F.col("__b").alias("branch")).agg(
        F.min("ts").alias("created_at"),
        F.max("ts").alias("last_at"),
        F.max_by("hash", "seq").alias("head"),
        F.count("*").alias("event_count"),
        F.min_by("fork_source_branch", F.when(F.col("type") == "fork", F.col("seq"))).alias("forked_from"),
        F.min_by("parent_hash", F.when(F.col("type") == "fork", F.col("seq"))).alias("forked_from_hash"),
    )
    merged = own.where("type = 'merge' and coalesce(merge_from_branch, '') <> ''").groupBy("artifact_id", F.col("merge_from_branch").alias("branch")).agg(F.max_by("__b", "seq").alias("merged_into"))
    return made.join(merged, ["artifact_id", "branch"], "left")


def listed_branches(rollup: DataFrame) -> DataFrame:
    """Rollup rows with their place: main first, then by age and name."""
    w = Window.partitionBy("artifact_id").orderBy(F.col("branch") != C.MAIN, "created_at", "branch")
    return rollup.withColumn("place", F.row_number().over(w))


_SEGMENT = "array<struct<owner:string,upto:bigint,before:bigint>>"


def _resolved(rows: list[dict]) -> list[tuple]:
    """(branch, error, segments) of one log's branches.

    A segment is the first ``upto`` own events of a branch (null: all of them), after
    ``before`` events of the segments above.  A fork takes its source's segments up to
    its fork point and adds its own.  Sources come first, however deep branches nest;
    what no source leads to is malformed.
    """
    made: dict[str, list[tuple]] = {}
    out, forks = [], {}
    ready = []
    for r in rows:
        if r["k"] == "alone":
            made[r["b"]] = [(r["b"], None, 0)]
            ready.append(r["b"])
        elif r["k"] == "fork":
            forks.setdefault(r["src"], []).append(r)
        else:
            out.append((r["b"], "malformed", None))
    size = {r["b"]: r["n"] for r in rows}
    barred = {r["b"]: r["redactions"] or [] for r in rows}
    while ready:
        source = ready.pop()
        for r in forks.pop(source, []):
            spots: dict[str, int] = {}
            for c in r["points"] or []:
                spots[c["owner"]] = min(c["rank"], spots.get(c["owner"], c["rank"]))
            above = made[source]
            for i, (owner, upto, before) in enumerate(above):
                rank = spots.get(owner)
                if rank is not None and (upto is None or rank <= upto):
                    break
            else:
                out.append((r["b"], "fork point missing", None))
                continue
            later = [(rank, above[i]), *((0, x) for x in above[i + 1 :])]
            if any(start < x <= (size[o] if to is None else to) for start, (o, to, _) in later for x in barred.get(o, [])):
                out.append((r["b"], "redaction barrier", None))
                continue
            made[r["b"]] = [*above[:i], (owner, rank, before), (r["b"], None, before + rank)]
            ready.append(r["b"])
    out += [(r["b"], "malformed", None) for rest in forks.values() for r in rest]
    return out + [(b, None, segments) for b, segments in made.items()]


def project_branches(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(projections, errors) of all branches of all logs.

    A projection has ``projected`` (branch), ``place`` and the event's columns.
    Main is its own events; another branch is its source's projection up to the
    fork's parent, then its own events; a recovery baseline stands alone.
    Errors: ``malformed`` (no fork first, cycle or missing source), ``fork point
    missing``, ``redaction barrier``.

    What a branch is made of is settled over one narrow row a branch, in a task that
    holds the branches of a log (not its events).  Events are placed by their rank in
    their own branch, so they are shuffled once, whatever the branches' depth.
    """
    import pyarrow as pa

    rank = Window.partitionBy("artifact_id", "__b").orderBy("seq")
    own = log.withColumn("__b", _branch()).withColumn("__rank", F.row_number().over(rank).cast("long"))
    opening = own.groupBy("artifact_id", "__b").agg(
        F.min_by(F.struct("type", "parent_hash", "fork_source_branch", "aligned_head", "aligned_event_id", has_payload(F.col("payload")).alias("full")), "seq").alias("o"),
        F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.when(F.col("type") == "redaction", F.col("__rank")))).alias("redactions"),
    )
    root = (F.col("o.type") == "baseline") & (F.coalesce("o.parent_hash", F.lit("")) == "") & (F.coalesce("o.aligned_head", F.lit("")) != "") & (F.coalesce("o.aligned_event_id", F.lit("")) != "") & F.col("o.full")
    source = F.when(F.coalesce("o.fork_source_branch", F.lit("")) == "", F.lit(C.MAIN)).otherwise(F.col("o.fork_source_branch"))
    kinds = opening.select("artifact_id", F.col("__b").alias("b"), F.when((F.col("__b") == C.MAIN) | root, "alone").when(F.col("o.type") == "fork", "fork").otherwise("malformed").alias("k"), source.alias("src"), F.col("o.parent_hash").alias("cut"), "n", "redactions")
    spots = own.select(F.col("artifact_id").alias("__a"), F.col("hash").alias("__h"), F.struct(F.col("__b").alias("owner"), F.col("__rank").alias("rank")).alias("spot"))
    found = kinds.join(spots, (F.col("k") == "fork") & (F.col("artifact_id") == F.col("__a")) & (F.col("cut") == F.col("__h")), "left")
    rows = found.groupBy("artifact_id", "b").agg(F.first("k").alias("k"), F.first("src").alias("src"), F.first("n").alias("n"), F.first("redactions").alias("redactions"), F.collect_list("spot").alias("points"))
    segment = pa.list_(pa.struct([("owner", pa.string()), ("upto", pa.int64()), ("before", pa.int64())]))

    def resolve(table: pa.Table) -> pa.Table:
        made = _resolved(table.to_pylist())
        key = table.column("artifact_id").combine_chunks()
        shown = lambda segments: None if segments is None else [dict(zip(("owner", "upto", "before"), s, strict=True)) for s in segments]
        return pa.table({"artifact_id": key.take(pa.array([0] * len(made))), "branch": pa.array([b for b, _, _ in made], pa.string()), "error": pa.array([e for _, e, _ in made], pa.string()), "segments": pa.array([shown(s) for _, _, s in made], segment)})

    schema = rows.select("artifact_id").schema.add("branch", "string").add("error", "string").add("segments", T._parse_datatype_string(_SEGMENT))
    settled = checkpointed(rows.groupBy("artifact_id").applyInArrow(resolve, schema))
    parts = settled.where("error is null").select(F.col("artifact_id").alias("__a"), F.col("branch").alias("projected"), F.inline("segments"))
    fits = (F.col("artifact_id") == F.col("__a")) & (F.col("__b") == F.col("owner")) & (F.col("upto").isNull() | (F.col("__rank") <= F.col("upto")))
    done = own.join(parts, fits).select("projected", (F.col("before") + F.col("__rank")).cast("int").alias("place"), *log.columns)
    return done, settled.where("error is not null").select("artifact_id", "branch", "error")


def ancestors(log: DataFrame, tips: DataFrame) -> DataFrame:
    """``artifact_id, hash`` of every event in the ancestry of ``tips`` (``artifact_id, hash``).

    Parents that the log no longer holds end the way.  Ways are followed by
    doubling, so the number of rounds is the logarithm of the longest one.
    """
    wanted = tips.select("artifact_id").distinct()
    edges = log.join(wanted, "artifact_id", "left_semi").select("artifact_id", F.col("hash").alias("node"), F.nullif("parent_hash", F.lit("")).alias("parent"))
    starts = tips.select("artifact_id", F.col("hash").alias("node"))
    return above(edges, starts, "artifact_id").select("artifact_id", F.col("node").alias("hash")).distinct()


# state


def _bearing() -> Column:
    return F.col("type").isin(C.PAYLOAD_TYPES) | (F.col("type").isin(C.CHECKPOINT_TYPES) & has_payload(F.col("payload")))


def fold_conversations(log: DataFrame) -> DataFrame:
    """Current state of each conversation: ``artifact_id, format, items`` (arrays joined in order).

    ``format`` and ``items`` are the payload's.  Full and legacy payloads
    replace the state; a delta extends a full one and otherwise starts anew; a
    redaction empties it, and a log that ends so has no row.  Merges, forks and
    amendments take no part.
    """
    part = log.where(_bearing() | (F.col("type") == "redaction"))
    kind = F.when(F.col("type") == "redaction", "none").when(F.col("format") == C.FULL_FORMAT, "full").when(F.col("format") == C.DELTA_FORMAT, "delta").otherwise("legacy")
    w = Window.partitionBy("artifact_id").orderBy("seq")
    marked = part.withColumn("__k", kind)
    extends = (F.col("__k") == "delta") & F.coalesce(F.lag("__k").over(w).isin("full", "delta"), F.lit(False))
    cut = marked.withColumn("__s", F.sum(F.when(extends, 0).otherwise(1)).over(w))
    last = Window.partitionBy("artifact_id")
    kept = cut.withColumn("__last", F.max("__s").over(last)).where("__s = __last")
    made = kept.groupBy("artifact_id").agg(F.max_by("__k", "seq").alias("__k"), F.max_by("format", "seq").alias("__f"), F.sort_array(F.collect_list(F.struct("seq", "items"))).alias("__i"))
    return made.where("__k <> 'none'").select("artifact_id", F.when(F.col("__k") == "legacy", F.col("__f")).otherwise(F.lit(C.FULL_FORMAT)).alias("format"), F.flatten(F.transform("__i", lambda x: F.coalesce(x["items"], F.array().cast("array<string>")))).alias("items"))


def latest_payload(log: DataFrame) -> DataFrame:
    """Newest payload-bearing event of each log; looks past redactions by design."""
    return last_event(log.where(_bearing()), F.col("seq"))


def latest_format(log: DataFrame) -> DataFrame:
    """``artifact_id, format`` of the newest payload-bearing event, if it names one."""
    return latest_payload(log).select("artifact_id", F.get_json_object("payload", "$.format").alias("format")).where("coalesce(format, '') <> ''")


def replay_content(log: DataFrame) -> DataFrame:
    """Current content of opaque artifacts with an intact chain: last create, update, resolution or payload snapshot; a redaction gives empty content; baselines take no part."""
    good = intact(log).where("intact").select("artifact_id")
    part = log.where(F.col("type").isin(C.PAYLOAD_TYPES) | ((F.col("type") == "snapshot") & has_payload(F.col("payload"))) | (F.col("type") == "redaction")).join(good, "artifact_id", "left_semi")
    newest = part.groupBy("artifact_id").agg(F.max_by(F.struct("type", "payload"), "seq").alias("e"))
    return newest.select("artifact_id", F.when(F.col("e.type") == "redaction", "").otherwise(F.get_json_object("e.payload", "$.content")).alias("content"))


def replay_layers(active: DataFrame, compacted: DataFrame) -> DataFrame:
    """``replay_content`` over the active layer; a log whose chain isn't whole there is tried once more with its compacted events before it.

    ``seq`` counts through both layers.  A log that is whole in neither has no row.
    """
    whole = intact(active).where("intact").select("artifact_id")
    again = active.join(whole, "artifact_id", "left_anti")
    older = compacted.join(again.select("artifact_id").distinct(), "artifact_id", "left_semi")
    # an event that was moved but not yet removed stands in both layers
    both = older.unionByName(again.join(older.select("artifact_id", "hash"), ["artifact_id", "hash"], "left_anti"), allowMissingColumns=True)
    return replay_content(active.join(whole, "artifact_id", "left_semi")).unionByName(replay_content(both))


def branch_replay(events: DataFrame) -> DataFrame:
    """Branches of a conversation by its inner events: parent, fork point and whether a merge took the branch in.

    ``events``: ``artifact_id, pos, branch_id, source_branch_id, source_event_id, merged_branch_ids``.
    The order of the rows has no meaning.
    """
    branch = F.coalesce("branch_id", F.lit(C.MAIN))
    own = events.groupBy("artifact_id", branch.alias("branch")).agg(
        F.min_by("source_branch_id", "pos").alias("parent"), F.min_by("source_event_id", "pos").alias("fork_point"), F.count("*").alias("n_events")
    )
    merged = events.select("artifact_id", F.explode("merged_branch_ids").alias("branch")).distinct().withColumn("merged", F.lit(True))
    return own.join(merged, ["artifact_id", "branch"], "left").withColumn("merged", F.coalesce("merged", F.lit(False)))
