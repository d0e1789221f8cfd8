"""Queries over the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlog.functions import text as X
from skeinlog.operators import catalog as K
from skeinlog.plans.registry import query
from skeinlog.session import load_table


def _docs(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "memory").when(F.col("doc_id") % 3 == 1, "skill").otherwise("tool")
    return d.select(
        F.col("doc_id").alias("artifact_id"), kind.alias("kind"), F.when(F.col("lang") == "en", "project").otherwise("global").alias("scope"), F.concat(F.lit("p"), (F.col("doc_id") % 40).cast("string")).alias("project_id"),
        F.concat(F.lit("/home/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("source").alias("agent"), "n_chars",
    )


_DOCS = "d AS (SELECT doc_id AS artifact_id, CASE doc_id % 3 WHEN 0 THEN 'memory' WHEN 1 THEN 'skill' ELSE 'tool' END AS kind, CASE lang WHEN 'en' THEN 'project' ELSE 'global' END AS scope, 'p' || (doc_id % 40) AS project_id, '/home/' || source || '/' || doc_id AS path, source AS agent, n_chars FROM documents)"


@query("pending_projects", f"WITH {_DOCS} SELECT project_id, count(*) AS count, min(path) AS sample_path FROM d WHERE project_id NOT IN ('p1', 'p2', 'p3') GROUP BY 1")
def pending_projects(spark, sf_dir):
    registered = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "project_id string")
    return K.pending_projects(_docs(spark, sf_dir), registered)


@query("bundle_filter", f"WITH {_DOCS} SELECT artifact_id, kind, project_id FROM d WHERE scope = 'project' AND project_id IN ('p5', 'p6', 'p7') AND project_id <> 'p6'")
def bundle_filter(spark, sf_dir):
    return K.bundled(_docs(spark, sf_dir), spark.createDataFrame([("p6",)], "project_id string"), "project", ["p5", "p6", "p7"]).select("artifact_id", "kind", "project_id")


@query("dry_run", f"WITH {_DOCS} SELECT kind, count(*) FILTER (WHERE artifact_id % 4 <> 0) AS adds, count(*) FILTER (WHERE artifact_id % 4 = 0) AS collisions FROM d GROUP BY 1")
def dry_run(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return K.dry_run(d, d.where("artifact_id % 4 = 0"))


@query("newest_by_path", f"WITH {_DOCS} SELECT agent AS source_path, max(artifact_id) AS artifact_id FROM d GROUP BY 1")
def newest_by_path(spark, sf_dir):
    d = _docs(spark, sf_dir).select("artifact_id", F.col("agent").alias("source_path"), F.lit(0).alias("updated_at"), F.lit(0).alias("created_at"))
    return K.newest_by_source_path(d).select("source_path", "artifact_id")


@query("harvest", f"WITH {_DOCS} SELECT project_id AS path, array_to_string(list_sort(list_distinct(list(agent))), ',') AS agents, max(artifact_id) AS last_active, true AS has_more FROM d GROUP BY 1 ORDER BY max(artifact_id) DESC, path LIMIT 25")
def harvest(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.col("project_id").alias("path"), "agent", F.col("artifact_id").alias("last_active"))
    return K.harvest(d, 25).withColumn("agents", F.array_join("agents", ","))


@query("scope_resolution", f"WITH {_DOCS} SELECT path, CASE agent WHEN 'src1' THEN 'one' WHEN 'src2' THEN 'two' ELSE 'home' END AS project_id, CASE agent WHEN 'src1' THEN 'project' ELSE 'global' END AS scope FROM d")
def scope_resolution(spark, sf_dir):
    projects = spark.createDataFrame([("/home", "home", "shared"), ("/home/src1/", "one", "local"), ("/home/src2", "two", "shared"), ("/home/src", "no", "local")], "root string, project_id string, scope string")
    return K.resolved_scopes(_docs(spark, sf_dir).select("path"), projects)


@query("agent_artifacts", f"WITH {_DOCS} SELECT agent, count(*) AS artifacts FROM d WHERE agent IN ('src1', 'src2', 'src3') GROUP BY 1")
def agent_artifacts(spark, sf_dir):
    d = _docs(spark, sf_dir).select("artifact_id", F.col("path").alias("source_path"), F.array().cast("array<string>").alias("synced_agents"))
    return K.agent_counts(K.attributed(d, {a: f"/home/{a}" for a in ("src1", "src2", "src3")}))


@query("remote_urls", r"SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://', ''), '/+$', ''), '\.git$', '')) AS remote FROM pages")
def remote_urls(spark, sf_dir):
    return load_table(spark, sf_dir, "pages").select("page_id", X.remote_url(F.col("url")).alias("remote"))


@query("project_ids", r"SELECT doc_id, source || '-' || substr(sha256('/w/' || source), 1, 16) AS project_id FROM documents")
def project_ids(spark, sf_dir):
    return load_table(spark, sf_dir, "documents").select("doc_id", X.path_id(F.concat(F.lit("/w/"), "source")).alias("project_id"))


@query("human_times", "SELECT event_id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS shown FROM (SELECT event_id, epoch_us(TIMESTAMP '2024-02-01') // 1000000 - epoch_us(ts) // 1000000 AS s FROM events)")
def human_times(spark, sf_dir):
    seconds = F.unix_seconds(F.lit("2024-02-01").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    return load_table(spark, sf_dir, "events").select("event_id", X.human_delta(seconds).alias("shown"))


@query("retry_backoff", "SELECT event_id, least(0.25 * pow(2, least(event_id % 40, 32)), 900.0) AS delay FROM events")
def retry_backoff(spark, sf_dir):
    return load_table(spark, sf_dir, "events").select("event_id", X.backoff_seconds(F.col("event_id") % 40).alias("delay"))


@query("branch_names", r"SELECT doc_id, rtrim(substr(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\-_ /.]', '', 'g'), '[\-_ /.]+', '-', 'g'), '-'), 1, 64), '-') AS branch FROM documents WHERE rtrim(substr(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\-_ /.]', '', 'g'), '[\-_ /.]+', '-', 'g'), '-'), 1, 64), '-') <> ''")
def branch_names(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents")
    return docs.select("doc_id", X.normalized_branch(F.col("text")).alias("branch")).where("branch is not null")
