"""Merging, comparing and diffing of event sequences, attachments, lines and tags."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from skeinlog.functions.text import event_key, trim_space


def _keyed(events: DataFrame) -> DataFrame:
    """Events with ``key``; ``content`` is their canonical string."""
    return events.withColumn("key", event_key(F.col("ts_nanos"), F.col("role"), F.col("type"), F.col("content")))


def union_merge(local: DataFrame, inbound: DataFrame) -> DataFrame:
    """All local events and the inbound ones whose key is new, by time then key, with their new ``place``.

    Of events with one key the local one, then the earliest, survives.
    """
    both = _keyed(local).withColumn("__side", F.lit(0)).unionByName(_keyed(inbound).withColumn("__side", F.lit(1)))
    first = both.groupBy("artifact_id", "key").agg(F.min_by(F.struct(*[F.col(c) for c in both.columns if c not in ("artifact_id", "key")]), F.struct("__side", "pos")).alias("e"))
    kept = first.select("artifact_id", "key", "e.*").drop("__side")
    w = Window.partitionBy("artifact_id").orderBy("ts_nanos", "key")
    return kept.withColumn("place", F.row_number().over(w) - 1)


def bag_union(local: DataFrame, inbound: DataFrame, key: str = "attachment") -> DataFrame:
    """Multiset union: every attachment as often as the side that holds it more often."""
    count = lambda df, name: df.groupBy("artifact_id", key).agg(F.count("*").alias(name))
    both = count(local, "__l").join(count(inbound, "__r"), ["artifact_id", key], "full")
    times = F.greatest(F.coalesce("__l", F.lit(0)), F.coalesce("__r", F.lit(0)))
    return both.select("artifact_id", key, F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("copy"))


def _ordered(events: DataFrame, value: str, name: str) -> DataFrame:
    return events.groupBy("artifact_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", value))), lambda x: x[value]).alias(name))


def is_prefix(short: Column, long: Column) -> Column:
    """Whether ``short`` is a strict prefix of ``long``."""
    return (F.size(short) < F.size(long)) & (F.slice(long, F.lit(1), F.size(short)) == short)


def relation(local: Column, inbound: Column) -> Column:
    """equal, stale (inbound is behind), extends (inbound is ahead) or diverged."""
    return F.when(local == inbound, "equal").when(is_prefix(inbound, local), "stale").when(is_prefix(local, inbound), "extends").otherwise("diverged")


def classified(local: DataFrame, inbound: DataFrame) -> DataFrame:
    """``artifact_id, relation`` of every conversation on either side, by key sequences."""
    empty = F.array().cast("array<string>")
    both = _ordered(_keyed(local), "key", "l").join(_ordered(_keyed(inbound), "key", "r"), "artifact_id", "full")
    return both.select("artifact_id", relation(F.coalesce("l", empty), F.coalesce("r", empty)).alias("relation"))


def replayed_only(local: DataFrame, inbound: DataFrame, identity: str = "identity") -> DataFrame:
    """``artifact_id, replay_only``: whether what inbound has beyond local's length repeats local turns verbatim."""
    sizes = local.groupBy("artifact_id").agg(F.count("*").alias("__n"))
    w = Window.partitionBy("artifact_id").orderBy("pos")
    tail = inbound.withColumn("__k", F.row_number().over(w)).join(sizes, "artifact_id", "left").where(F.col("__k") > F.coalesce("__n", F.lit(0)))
    known = local.select("artifact_id", identity).distinct().withColumn("__known", F.lit(True))
    old = (F.col("type") == "turn") & F.coalesce("__known", F.lit(False))
    found = tail.join(known, ["artifact_id", identity], "left").groupBy("artifact_id").agg(F.bool_and(old).alias("r"))
    return inbound.select("artifact_id").distinct().join(found, "artifact_id", "left").select("artifact_id", F.coalesce("r", F.lit(False)).alias("replay_only"))


def reconcile(relations: DataFrame, replay: DataFrame, attachments_equal: DataFrame) -> DataFrame:
    """What to do with an inbound conversation.

    noop (equal, attachments too), keep (stale), adopt (extends), or union:
    diverged, an extension that only replays, or other attachments.
    """
    held = relations.join(replay, "artifact_id", "left").join(attachments_equal, "artifact_id", "left")
    same = F.coalesce("attachments_equal", F.lit(True))
    made = F.when((F.col("relation") == "equal") & same, "noop").when((F.col("relation") == "stale") & same, "keep")
    made = made.when((F.col("relation") == "extends") & ~F.coalesce("replay_only", F.lit(False)) & same, "adopt").otherwise("union")
    return held.select("artifact_id", "relation", made.alias("decision"))


def branch_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Position by position: common, only_a or only_b, by the first mismatch of ``hash``."""
    left, right = a.select("artifact_id", "place", F.col("hash").alias("ha")), b.select("artifact_id", "place", F.col("hash").alias("hb"))
    both = left.join(right, ["artifact_id", "place"], "full")
    w = Window.partitionBy("artifact_id")
    mismatch = F.min(F.when(~F.col("ha").eqNullSafe(F.col("hb")), F.col("place"))).over(w)
    cut = both.withColumn("__m", F.coalesce(mismatch, F.lit(2**31 - 1)))
    common = cut.where("place < __m").select("artifact_id", F.lit("common").alias("side"), "place", F.col("ha").alias("hash"))
    only = lambda h, name: cut.where(f"place >= __m and {h} is not null").select("artifact_id", F.lit(name).alias("side"), "place", F.col(h).alias("hash"))
    return common.unionByName(only("ha", "only_a")).unionByName(only("hb", "only_b"))


def positional_diff(a: DataFrame, b: DataFrame, limit: int = 5) -> DataFrame:
    """First ``limit`` differences by position: changed, only_a or only_b."""
    left, right = a.select("artifact_id", "pos", F.col("text").alias("ta")), b.select("artifact_id", "pos", F.col("text").alias("tb"))
    both = left.join(right, ["artifact_id", "pos"], "full").where(~F.col("ta").eqNullSafe(F.col("tb")))
    kind = F.when(F.col("ta").isNull(), "only_b").when(F.col("tb").isNull(), "only_a").otherwise("changed")
    w = Window.partitionBy("artifact_id").orderBy("pos")
    return both.withColumn("diff", kind).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")


def line_diff(a: DataFrame, b: DataFrame, limit: int = 5) -> DataFrame:
    """First ``limit`` lines that differ between two texts (``artifact_id, text``) at one place, trimmed: changed, only_a or only_b.

    Both texts meet in one row, so their lines are not shuffled.  A line that one side
    lacks counts as empty: an empty line against none is no difference.
    """
    both = a.select("artifact_id", F.col("text").alias("__a")).join(b.select("artifact_id", F.col("text").alias("__b")), "artifact_id", "full")
    cut = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, "\n"))
    both = both.withColumns({"__x": F.transform(cut("__a"), trim_space), "__y": F.transform(cut("__b"), trim_space)})
    zipped = F.transform(F.arrays_zip("__x", "__y"), lambda p, i: F.struct((i + 1).alias("line"), p["__x"].alias("line_a"), p["__y"].alias("line_b")))
    found = F.slice(F.filter(zipped, lambda p: F.coalesce(p["line_a"], F.lit("")) != F.coalesce(p["line_b"], F.lit(""))), 1, limit)
    kind = F.when(F.col("line_a").isNull(), "only_b").when(F.col("line_b").isNull(), "only_a").otherwise("changed")
    return both.select("artifact_id", F.inline(found)).withColumn("diff", kind)


def event_diff(log: DataFrame, a: str, b: str) -> DataFrame:
    """Two events, by id or hash, side by side; one row with the fields that differ.

    Where several events go by one name the first in order of their fields is meant.
    """
    fields = [c for c in log.columns if c not in ("event_id", "hash")]
    pick = lambda name: log.where((F.col("event_id").cast("string") == name) | (F.col("hash") == name)).agg(F.min(F.struct("event_id", "hash", *fields)).alias("e")).where("e is not null")
    left, right = pick(a).select(F.col("e").alias("a")), pick(b).select(F.col("e").alias("b"))
    differ = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in fields]))
    return left.join(right, F.lit(True)).select(F.col("a").dropFields("event_id", "hash").alias("a"), F.col("b").dropFields("event_id", "hash").alias("b"), differ.alias("differs_in"))


def common_prefix_len(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    wrong = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | ~F.get(a, i).eqNullSafe(F.get(b, i)))
    return F.array_min(wrong)


def is_subsequence(short: Column, long: Column) -> Column:
    """Whether ``short`` is found in ``long`` in order, with gaps allowed."""
    return F.aggregate(long, F.lit(0), lambda k, x: k + F.when(F.get(short, k).eqNullSafe(x) & (k < F.size(short)), 1).otherwise(0)) == F.size(short)


def _run_at(needle: Column, hay: Column, i: Column) -> Column:
    """Whether ``needle`` stands at place ``i`` of ``hay``; its ends are looked at before all of it is compared."""
    n = F.size(needle)
    ends = F.get(hay, i).eqNullSafe(F.get(needle, F.lit(0))) & F.get(hay, i + n - 1).eqNullSafe(F.get(needle, n - 1))
    return (n == 0) | (ends & (F.slice(hay, i + 1, n) == needle))


def suffix_prefix_overlap(a: Column, b: Column, least: int = 2) -> Column:
    """Longest tail of ``a`` that opens ``b``, of ``least`` items or more; else 0."""
    top = F.least(F.size(a), F.size(b))
    ends = lambda n: F.get(a, F.size(a) - n).eqNullSafe(F.get(b, F.lit(0))) & F.get(a, F.size(a) - 1).eqNullSafe(F.get(b, n - 1))
    fits = F.filter(F.sequence(F.lit(0), top), lambda n: (n >= least) & ends(n) & (F.slice(a, F.size(a) - n + 1, n) == F.slice(b, F.lit(1), n)))
    return F.coalesce(F.array_max(fits), F.lit(0))


def _places(needle: Column, hay: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(hay) - F.size(needle), F.lit(0))), lambda i: _run_at(needle, hay, i))


def sublist_at(needle: Column, hay: Column) -> Column:
    """Place of the first occurrence of ``needle`` in ``hay``; -1 if there is none."""
    return F.when(F.size(needle) > F.size(hay), F.lit(-1)).otherwise(F.coalesce(F.array_min(_places(needle, hay)), F.lit(-1)))


def sublist_replaced(items: Column, needle: Column, other: Column) -> Column:
    """``items`` with the first occurrence of ``needle`` replaced by ``other``; as they are if there is none."""
    at = sublist_at(needle, items)
    return F.when(at < 0, items).otherwise(F.concat(F.slice(items, F.lit(1), at), other, F.slice(items, at + F.size(needle) + 1, F.size(items))))


def tail_after(anchor: Column, items: Column) -> Column:
    """Items after the last occurrence of ``anchor``; null if there is none."""
    last = F.array_max(_places(anchor, items))
    return F.when(last.isNotNull() & (F.size(anchor) <= F.size(items)), F.slice(items, last + F.size(anchor) + 1, F.size(items)))


def append_decision(current: Column, native: Column) -> Column:
    """How a native sequence continues the current one: struct of ``action`` and ``tail``."""
    empty = F.array().cast("array<string>")
    overlap = suffix_prefix_overlap(current, native)
    tail = F.when(is_prefix(current, native), F.slice(native, F.size(current) + 1, F.size(native))).when((overlap > 0) & (overlap < F.size(native)), F.slice(native, overlap + 1, F.size(native))).otherwise(empty)
    action = F.when(current == native, "noop").when(is_prefix(current, native), "prefix").when(is_prefix(native, current) | is_subsequence(native, current), "stale").when(overlap > 0, "overlap").otherwise("diverged")
    return F.struct(action.alias("action"), F.when(action.isin("prefix", "overlap"), tail).otherwise(empty).alias("tail"))


def would_regress(current: Column, native: Column) -> Column:
    """Whether importing ``native`` would lose turns of ``current``."""
    return (F.size(native) < F.size(current)) & is_subsequence(native, current)


def multiset_equal(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def appended_lines(base: DataFrame, extras: DataFrame) -> DataFrame:
    """``artifact_id, text``: base and, after it, lines of the extras that it lacks.

    Lines are compared trimmed; blank ones are left out; of equal ones the first
    stays.  If nothing is new the base is returned as it is.  Texts meet in one
    join; their lines are sorted within the row, so nothing else is shuffled.
    """
    added = extras.groupBy("artifact_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n").alias("__more"))
    joined = base.join(added, "artifact_id", "left")
    lines = lambda c, side: F.transform(F.split(c, "\n"), lambda x, i: F.struct(trim_space(x).alias("t"), F.lit(side).alias("side"), i.alias("at"), x.alias("line")))
    every = F.sort_array(F.filter(F.concat(lines(F.col("text"), 0), lines(F.coalesce("__more", F.lit("")), 1)), lambda x: x["t"] != ""))
    made = joined.where("__more is not null").withColumn("__all", every)
    # the first of equal lines; those of the base come before those of the extras
    new = F.filter("__all", lambda x, i: (x["side"] == 1) & ((i == 0) | (F.get("__all", i - 1)["t"] != x["t"])))
    made = made.withColumn("__new", F.sort_array(F.transform(new, lambda x: F.struct(x["at"].alias("at"), F.regexp_replace(x["line"], r"[ \t\r]+$", "").alias("line")))))
    block = F.array_join(F.transform("__new", lambda x: x["line"]), "\n")
    head = F.when(trim_space(F.col("text")) == "", F.lit("")).when(F.endswith("text", F.lit("\n")), F.col("text")).otherwise(F.concat("text", F.lit("\n")))
    out = made.select("artifact_id", F.when(F.size("__new") == 0, F.col("text")).otherwise(F.concat(head, block, F.lit("\n"))).alias("text"))
    return out.unionByName(joined.where("__more is null").select("artifact_id", "text"))


def stripped_lines(content: Column, extras: Column) -> Column:
    """``content`` without the lines (compared trimmed) of the ``extras`` texts; closing blank space becomes one newline."""
    drop = F.filter(F.transform(F.flatten(F.transform(extras, lambda e: F.split(e, "\n"))), trim_space), lambda t: t != "")
    kept = F.filter(F.split(content, "\n"), lambda line: ~F.array_contains(drop, trim_space(line)))
    made = F.regexp_replace(F.array_join(kept, "\n"), r"[\n \t]+$", "")
    return F.when(F.size(drop) == 0, content).otherwise(F.when(made == "", made).otherwise(F.concat(made, F.lit("\n"))))


def renamed_tag(tags: Column, old: str, new: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(tags, lambda t: F.when(t == old, F.lit(new)).otherwise(t))))


def conflicts(log: DataFrame, window_seconds: int = 30) -> DataFrame:
    """Last two content events of each log that compete: other agents, within the window, other payload and meaning."""
    content = log.where(F.col("type").isin("create", "update", "resolution"))
    w = Window.partitionBy("artifact_id").orderBy(F.desc("seq"))
    two = content.withColumn("__n", F.row_number().over(w)).where("__n <= 2")
    heads = two.groupBy("artifact_id").agg(*[F.max(F.when(F.col("__n") == n, F.struct("seq", "source_agent", "ts", "payload", "meaning"))).alias(a) for n, a in ((1, "latest"), (2, "prev"))])
    gap = F.abs(F.unix_micros(F.col("latest.ts").cast("timestamp")) - F.unix_micros(F.col("prev.ts").cast("timestamp")))
    apart = (F.coalesce("prev.source_agent", F.lit("")) != "") & (F.coalesce("latest.source_agent", F.lit("")) != "") & (F.col("prev.source_agent") != F.col("latest.source_agent"))
    differ = (F.col("prev.payload") != F.col("latest.payload")) & ~F.col("prev.meaning").eqNullSafe(F.col("latest.meaning"))
    return heads.where(F.col("prev").isNotNull() & apart & (gap <= window_seconds * 1_000_000) & differ).select("artifact_id", F.col("prev.seq").alias("prev_seq"), F.col("latest.seq").alias("latest_seq"))


def fast_forward(projections: DataFrame, source: str, target: str) -> DataFrame:
    """``artifact_id, fast_forward, new_head``: whether target's projection is a prefix of source's (a declared deviation: projections, not own rows)."""
    items = projections.groupBy("artifact_id", "projected").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"]).alias("h"))
    s, t = items.where(F.col("projected") == source).select("artifact_id", F.col("h").alias("s")), items.where(F.col("projected") == target).select("artifact_id", F.col("h").alias("t"))
    ok = (F.col("s") == F.col("t")) | is_prefix(F.col("t"), F.col("s"))
    return s.join(t, "artifact_id").select("artifact_id", ok.alias("fast_forward"), F.when(ok, F.element_at("s", -1)).alias("new_head"))


def merged_branch(heads: DataFrame, source: str, target: str, strategy: str, manual: Column | None = None) -> DataFrame:
    """The merge row of two branch heads (``artifact_id, branch, hash, payload``) under ours, theirs or manual."""
    pick = lambda name: heads.where(F.col("branch") == name)
    s = pick(source).select("artifact_id", F.col("hash").alias("merge_from_hash"), F.col("payload").alias("sp"))
    t = pick(target).select("artifact_id", F.col("hash").alias("parent_hash"), F.col("payload").alias("tp"))
    chosen = {"ours": F.col("tp"), "theirs": F.col("sp"), "manual": manual if manual is not None else F.lit(None).cast("string")}[strategy]
    return t.join(s, "artifact_id").select("artifact_id", F.lit("merge").alias("type"), F.lit(target).alias("branch"), "parent_hash", F.lit(source).alias("merge_from_branch"), "merge_from_hash", F.lit(strategy).alias("merge_strategy"), chosen.alias("payload"))


def merged_branches(heads: DataFrame, rollup: DataFrame, target: str, strategy: str, manual: Column | None = None) -> DataFrame:
    """Merge rows of all open branches of a log into ``target``, one after the other by age and name, with their ``place``.

    ``heads``: ``artifact_id, branch, hash, payload``; ``rollup``: ``artifact_id,
    branch, created_at, merged_into``.  The first row's parent is the target's head, a
    later one's the merge before it, named by its place.  Under ``ours`` every row keeps the target's
    payload, under ``theirs`` each takes its branch's.  Logs with fewer than two open
    branches, or without the target, have no row.
    """
    open_ = rollup.where("merged_into is null").select("artifact_id", "branch", "created_at")
    enough = open_.groupBy("artifact_id").agg(F.count("*").alias("__n"), F.bool_or(F.col("branch") == target).alias("__t")).where("__n >= 2 and __t").select("artifact_id")
    sources = open_.where(F.col("branch") != target).join(enough, "artifact_id", "left_semi").join(heads, ["artifact_id", "branch"])
    into = heads.where(F.col("branch") == target).select("artifact_id", F.col("hash").alias("__head"), F.col("payload").alias("__ours"))
    w = Window.partitionBy("artifact_id").orderBy("created_at", "branch")
    chosen = {"ours": F.col("__ours"), "theirs": F.col("payload"), "manual": manual if manual is not None else F.lit(None).cast("string")}[strategy]
    placed = sources.join(into, "artifact_id").withColumn("place", F.row_number().over(w))
    parent = F.when(F.col("place") == 1, F.col("__head")).otherwise(F.concat(F.lit("merge:"), (F.col("place") - 1).cast("string")))
    return placed.select("artifact_id", "place", F.lit("merge").alias("type"), F.lit(target).alias("branch"), parent.alias("parent_hash"), F.col("branch").alias("merge_from_branch"), F.col("hash").alias("merge_from_hash"), F.lit(strategy).alias("merge_strategy"), chosen.alias("payload"))


# sequence algorithms, one pair of conversations a group


def merged_places(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Places in ``a`` and ``b`` (both for an item that they share) of the items of a shortest sequence that holds both.

    Where either order is as short, the smaller item comes first.  Common ends are
    set aside.  The table of the rest is filled a row at a time in numpy; of each cell
    only two bits stay: whether going on in ``a`` leaves a longer common subsequence
    than going on in ``b``, and whether it is as long.
    """
    least = min(len(a), len(b))
    head = next((i for i in range(least) if a[i] != b[i]), least)
    end = next((i for i in range(least - head) if a[-1 - i] != b[-1 - i]), least - head)
    n, m = len(a) - head - end, len(b) - head - end
    x, y = a[head : head + n], b[head : head + m]
    if n and m:
        number = {item: i for i, item in enumerate(sorted({*x, *y}))}
        left, right = np.array([number[item] for item in x], np.int32), np.array([number[item] for item in y], np.int32)
        longer, even = np.zeros((n, (m + 7) // 8), np.uint8), np.zeros((n, (m + 7) // 8), np.uint8)
        below = np.zeros(m + 1, np.int32)
        for i in range(n - 1, -1, -1):
            row = np.maximum(below, np.append(below[1:] + (right == left[i]), 0))
            row = np.maximum.accumulate(row[::-1])[::-1]
            longer[i], even[i] = np.packbits(below[:m] > row[1:]), np.packbits(below[:m] == row[1:])
            below = row
    out: list[tuple[int | None, int | None]] = [(i, i) for i in range(head)]
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and x[i] == y[j]:
            out.append((head + i, head + j))
            i, j = i + 1, j + 1
        elif j == m or (i < n and (longer[i, j >> 3] >> (7 - j & 7) & 1 or (even[i, j >> 3] >> (7 - j & 7) & 1 and x[i] <= y[j]))):
            out.append((head + i, None))
            i += 1
        else:
            out.append((None, head + j))
            j += 1
    return out + [(head + n + i, head + m + i) for i in range(end)]


def _supersequence(a: list[str], b: list[str]) -> list[str]:
    return [a[i] if i is not None else b[j] for i, j in merged_places(a, b)]


def supersequences(pairs: DataFrame) -> DataFrame:
    """``artifact_id, merged`` for rows with arrays ``a`` and ``b``: their shortest common supersequence.

    Time is quadratic in what a pair doesn't share at its ends; a pair is the unit of
    work and two bits a cell of its table all that a task holds.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_supersequence(r["a"] or [], r["b"] or []) for r in rows], pa.list_(pa.string()))], names=["artifact_id", "merged"])

    pairs = pairs.select("artifact_id", "a", "b")
    return pairs.mapInArrow(run, pairs.select("artifact_id").schema.add("merged", ArrayType(StringType())))


def thread_merge(pairs: DataFrame) -> DataFrame:
    """``artifact_id, action, merged`` for two copies ``a`` and ``b`` of a thread without provenance: keep, adopt, overlap, overlap_back or supersequence.

    With provenance, ``threads.thread_decisions`` decides.
    """
    a, b = F.col("a"), F.col("b")
    kind = F.when((a == b) | is_prefix(b, a) | is_subsequence(b, a), "keep").when(is_prefix(a, b) | is_subsequence(a, b), "adopt")
    made = pairs.withColumn("action", kind).withColumn("n", F.when(F.col("action").isNull(), F.struct(suffix_prefix_overlap(a, b).alias("on"), suffix_prefix_overlap(b, a).alias("back"))))
    made = made.withColumn("action", F.coalesce("action", F.when(F.col("n.on") > 0, "overlap").when(F.col("n.back") > 0, "overlap_back").otherwise("supersequence")))
    over = lambda x, y, n: F.concat(x, F.slice(y, n + 1, F.size(y)))
    simple = F.when(F.col("action") == "keep", a).when(F.col("action") == "adopt", b).when(F.col("action") == "overlap", over(a, b, F.col("n.on"))).otherwise(over(b, a, F.col("n.back")))
    hard = made.where("action = 'supersequence'")
    return made.where("action <> 'supersequence'").select("artifact_id", "action", simple.alias("merged")).unionByName(supersequences(hard).select("artifact_id", F.lit("supersequence").alias("action"), "merged"))


def retimed_cohorts(events: DataFrame) -> DataFrame:
    """Per conversation: the largest number of turns that share a time, and contents that stand at more than one time."""
    per_time = events.groupBy("artifact_id", "ts_nanos").agg(F.count("*").alias("n")).groupBy("artifact_id").agg(F.max("n").alias("largest_cohort"))
    per_content = events.groupBy("artifact_id", "role", "content").agg(F.count_distinct("ts_nanos").alias("k")).groupBy("artifact_id").agg(F.count_if(F.expr("k > 1")).alias("retimed_contents"))
    return per_time.join(per_content, "artifact_id")


def best_candidate(scored: DataFrame) -> DataFrame:
    """The best copy of each conversation: fewest violations, reversals, cohort turns, then the smallest text."""
    order = F.struct("role_violations", "time_reversals", "cohort_turns", "json")
    return scored.groupBy("artifact_id").agg(F.min_by(F.struct(*[c for c in scored.columns if c != "artifact_id"]), order).alias("c")).select("artifact_id", "c.*")
