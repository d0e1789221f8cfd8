"""Catalog operators: lists, scopes, projects, bundles, harvests, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlog.functions import constants as C


def listed(artifacts: DataFrame, first_events: DataFrame, kind: str = "", scope: str = "", agent: str = "") -> DataFrame:
    """Artifacts by kind, scope and the agent of their first event; empty means any."""
    out = artifacts
    if kind:
        out = out.where(F.col("kind") == kind)
    if scope:
        out = out.where(F.col("scope") == scope)
    origin = first_events.select("artifact_id", F.col("source_agent").alias("origin_agent"), F.col("device_id").alias("origin_device"))
    out = out.join(origin, "artifact_id", "left")
    return out.where(F.col("origin_agent") == agent) if agent else out


def in_creation_order(artifacts: DataFrame, kind: str) -> DataFrame:
    """Artifacts of a kind with their ``place`` by creation, then id; a page of them is a filter on it.

    Places are counted within days first, so no window holds more than a day's artifacts or one row a day.
    """
    kept = artifacts.where(F.col("kind") == kind).withColumn("__day", F.to_date("created_at"))
    days = kept.groupBy("__day").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = days.select(F.col("__day").alias("__d"), before.alias("__before"))
    own = F.row_number().over(Window.partitionBy("__day").orderBy("created_at", "artifact_id"))
    return kept.withColumn("__n", own).join(offsets, F.col("__day").eqNullSafe(F.col("__d"))).withColumn("place", F.col("__before") + F.col("__n")).drop("__day", "__d", "__before", "__n")


def bundle_bodies(files: DataFrame, transforms: dict[str, Column]) -> DataFrame:
    """Files of a bundle with ``body`` put through the transform of their kind; other kinds stay as they are."""
    body = F.col("body")
    for kind, made in transforms.items():
        body = F.when(F.col("kind") == kind, made).otherwise(body)
    return files.withColumn("body", body)


def logged(projected: DataFrame, sidecar: DataFrame, tag: str = "") -> DataFrame:
    """Events of a projection with their tags, written and from the sidecar (``hash, tags``); only those with ``tag`` if given."""
    empty = F.array().cast("array<string>")
    side = sidecar.select("hash", F.col("tags").alias("__side"))
    out = projected.join(side, "hash", "left").withColumn("all_tags", F.array_union(F.coalesce("event_tags", empty), F.coalesce("__side", empty))).drop("__side")
    return out.where(F.array_contains("all_tags", tag)) if tag else out


def newest_by_source_path(artifacts: DataFrame) -> DataFrame:
    """The newest artifact of each source path: by update, creation, then id."""
    w = Window.partitionBy("source_path").orderBy(F.desc("updated_at"), F.desc("created_at"), F.desc("artifact_id"))
    return artifacts.where("coalesce(source_path, '') <> ''").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def by_native_id(artifacts: DataFrame, native: str) -> DataFrame:
    """Artifacts whose id, name or file name, with or without extension, is ``native``; the first kind in fixed order wins."""
    base = F.element_at(F.split(F.coalesce("source_path", F.lit("")), "/"), -1)
    bare = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    hit = (F.col("artifact_id").cast("string") == native) | (F.col("name") == native) | (bare(F.col("name")) == native) | (base == native) | (bare(base) == native)
    order = F.array_position(F.array(*[F.lit(k) for k in ("memory", "skill", "tool", "conversation")]), F.col("kind"))
    return artifacts.where(hit).orderBy(order, "artifact_id").limit(1)


def attributed(artifacts: DataFrame, roots: dict[str, str]) -> DataFrame:
    """``artifact_id, agent``: agents that an artifact is synced with or whose root holds its path."""
    held = F.array_compact(F.array(*[F.when(F.array_contains(F.coalesce("synced_agents", F.array().cast("array<string>")), a) | F.startswith(F.coalesce("source_path", F.lit("")), F.lit(r.rstrip("/") + "/")), F.lit(a)) for a, r in sorted(roots.items())]))
    return artifacts.select("artifact_id", F.explode(held).alias("agent"))


def agent_counts(attribution: DataFrame) -> DataFrame:
    return attribution.groupBy("agent").agg(F.count("*").alias("artifacts"))


def branch_count(heads: str = "branch_heads") -> Column:
    """Number of an artifact's branches, main among them."""
    names = F.transform(F.map_keys(F.coalesce(heads, F.create_map().cast("map<string,string>"))), lambda k: F.when(k == "", F.lit(C.MAIN)).otherwise(k))
    return F.size(F.array_distinct(F.array_append(names, F.lit(C.MAIN))))


def tag_list(artifacts: DataFrame) -> DataFrame:
    return artifacts.select(F.explode("tags").alias("tag")).distinct()


def resolved_scopes(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """``path, project_id, scope`` by the longest registered root that is a path or one of its parents.

    Every path is expanded to its own parents and joined by equality, so no
    inequality join is needed however many roots there are.
    """
    parts = F.split(F.regexp_replace("path", "/+$", ""), "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("root")))
    tried = paths.select("path", F.inline(parents))
    roots = projects.select(F.regexp_replace("root", "/+$", "").alias("root"), "project_id", F.col("scope").alias("__scope"))
    best = tried.join(roots, "root").groupBy("path").agg(F.max_by(F.struct("project_id", "__scope"), "n").alias("p"))
    joined = paths.join(best, "path", "left")
    scope = F.when(F.col("p").isNull(), "unregistered").when(F.col("p.__scope") == "local", "project").otherwise("global")
    return joined.select("path", F.col("p.project_id").alias("project_id"), scope.alias("scope"))


def path_owners(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """``path, agents``: all agents with a root that is the path or one of its parents."""
    parts = F.split(F.regexp_replace("path", "/+$", ""), "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    tried = paths.select("path", F.explode(parents).alias("root"))
    held = tried.join(roots.select(F.regexp_replace("root", "/+$", "").alias("root"), "agent"), "root").groupBy("path").agg(F.array_sort(F.collect_set("agent")).alias("agents"))
    return paths.join(held, "path", "left").withColumn("agents", F.coalesce("agents", F.array().cast("array<string>")))


def unregistered(folders: DataFrame, registered: DataFrame) -> DataFrame:
    """Folders whose path, letter case aside, isn't registered."""
    known = registered.select(F.lower("path").alias("__p")).distinct()
    return folders.join(known, F.lower("path") == F.col("__p"), "left_anti")


def suggestions(folders: DataFrame, registry: DataFrame) -> DataFrame:
    """Folders with the registry's name by project id, else by path, letter case aside; of several names the first in order."""
    by_id = registry.where("project_id is not null").groupBy(F.col("project_id").alias("__id")).agg(F.min("name").alias("__n1"))
    by_path = registry.where("path is not null").groupBy(F.lower("path").alias("__path")).agg(F.min("name").alias("__n2"))
    return folders.join(by_id, F.col("project_id") == F.col("__id"), "left").join(by_path, F.lower("path") == F.col("__path"), "left").withColumn("name", F.coalesce("__n1", "__n2")).drop("__id", "__n1", "__path", "__n2")


def apply_denied(pending: DataFrame, denied: DataFrame) -> DataFrame:
    """Pending and denied projects in one list; ``denied`` tells the second kind."""
    d = denied.select("project_id", F.col("path").alias("__path"), F.lit(True).alias("__d"))
    both = pending.join(d, "project_id", "full")
    return both.select("project_id", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("sample_path", "__path").alias("sample_path"), F.coalesce("__d", F.lit(False)).alias("denied"))


def pending_projects(artifacts: DataFrame, registered: DataFrame) -> DataFrame:
    """Projects of artifacts that aren't registered: how many artifacts, and the first path."""
    open_ = artifacts.where("project_id is not null").join(registered.select("project_id").distinct(), "project_id", "left_anti")
    return open_.groupBy("project_id").agg(F.count("*").alias("count"), F.min("path").alias("sample_path"))


def harvest(sightings: DataFrame, limit: int = 50) -> DataFrame:
    """The ``limit`` most recently active folders with their agents; ``has_more`` tells whether there are others."""
    grouped = sightings.groupBy("path").agg(F.array_sort(F.collect_set("agent")).alias("agents"), F.max("last_active").alias("last_active"))
    some = grouped.orderBy(F.desc("last_active"), "path").limit(limit + 1)
    more = some.agg((F.count("*") > limit).alias("has_more"))
    return some.orderBy(F.desc("last_active"), "path").limit(limit).crossJoin(F.broadcast(more))


def excluded_path(path: Column, roots: list[str], segments: list[str]) -> Column:
    """Whether a path lies under an excluded root or holds an excluded segment."""
    under = F.lit(False)
    for r in roots:
        r = r.rstrip("/")
        under = under | (path == r) | F.startswith(path, F.lit(r + "/"))
    return under | F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(s) for s in segments]).cast("array<string>"))


def bundled(artifacts: DataFrame, pending: DataFrame, scope: str = "", project_ids: list[str] | None = None) -> DataFrame:
    """Artifacts that an export holds: by scope and project, none of a pending project."""
    out = artifacts.where(F.col("scope") == scope) if scope else artifacts
    if project_ids:
        out = out.where((F.col("scope") != "project") | F.col("project_id").isin(project_ids))
    return out.join(pending.select(F.col("project_id").alias("__p")).distinct(), F.col("project_id") == F.col("__p"), "left_anti")


def dry_run(bundle: DataFrame, store: DataFrame) -> DataFrame:
    """``kind, adds, collisions`` of a restore."""
    have = store.select("kind", "artifact_id").distinct().withColumn("__have", F.lit(True))
    held = F.coalesce("__have", F.lit(False))
    return bundle.join(have, ["kind", "artifact_id"], "left").groupBy("kind").agg(F.count_if(~held).alias("adds"), F.count_if(held).alias("collisions"))


def orphans(artifacts: DataFrame) -> DataFrame:
    """Artifact and agent of every orphan record."""
    return artifacts.select("artifact_id", F.explode("orphaned_by_agent").alias("agent", "since"))


def appended(events: DataFrame, heads: DataFrame) -> DataFrame:
    """New events that may be appended: their parent is still the head of their artifact (empty for a new one)."""
    h = heads.select("artifact_id", F.col("hash").alias("__head"))
    return events.join(h, "artifact_id", "left").where(F.coalesce("parent_hash", F.lit("")) == F.coalesce("__head", F.lit(""))).drop("__head")


def paired_calls(events: DataFrame) -> DataFrame:
    """Tool calls with their results by call id (an extension)."""
    calls = events.where("type = 'tool_call'").select("artifact_id", "call_id", F.col("pos").alias("call_pos"), "tool_name", "input")
    results = events.where("type = 'tool_result'").select("artifact_id", "call_id", F.col("pos").alias("result_pos"), "is_error", F.col("text").alias("result"))
    return calls.join(results, ["artifact_id", "call_id"], "left")
