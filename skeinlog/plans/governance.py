"""Queries over rules, redaction, metrics and retention."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlog.functions import constants as C
from skeinlog.functions import text as X
from skeinlog.operators import metrics as S
from skeinlog.operators import retention as R
from skeinlog.operators.rules import PRESETS, Rule, decide, retroactive_tags, route_rows, with_presets
from skeinlog.plans.model import artifacts, log_events
from skeinlog.plans.registry import query
from skeinlog.session import load_table

AGENTS = ["src1", "src2", "src3", "src4"]
RULES = [
    Rule("all", agents=("*",), mode="manual", include_secrets=True, depth={"src1": 10, "src4": 4}),
    Rule("private", {"tag": ["private"]}, ("!src2", "!src3"), remote="exclude", assign_tags=("local-only",), include_secrets=False, depth={"src1": 2}),
    Rule("pinned", {"tag": ["pin*"]}, mode="scheduled", interval=60, skill_mode="strict"),
    Rule("origin", {"agentSource": ["src1", "src2"], "kind": "any"}, ("__originatingAgent__",), assign_tags=("from-origin", "device:x")),
    Rule("off", {"tag": ["en"]}, ("!*",), enabled=False),
]
_TAGS = "list_filter([lang, CASE WHEN quality = 1 THEN 'pinned' END, CASE WHEN toxic = 1 THEN 'private' END], lambda x: x IS NOT NULL)"
_DECIDED = f"""a AS (SELECT d.doc_id AS artifact_id, source, {_TAGS} AS tags FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
m AS (SELECT *, list_contains(tags, 'private') AS p, list_contains(tags, 'pinned') AS q, source IN ('src1', 'src2') AS o FROM a),
d AS (SELECT artifact_id, tags, CASE WHEN p THEN ['src1', 'src4'] ELSE ['src1', 'src2', 'src3', 'src4'] END AS allowed, CASE WHEN p THEN ['src2', 'src3'] ELSE [] END AS denied,
list_sort(list_distinct(tags || CASE WHEN p THEN ['local-only'] ELSE [] END || CASE WHEN o THEN ['from-origin', 'device:x'] ELSE [] END)) AS assigned, NOT p AS remote_allowed,
CASE WHEN q THEN 'strict' ELSE 'lossy' END AS skill_mode, CASE WHEN q THEN 'scheduled' ELSE 'manual' END AS mode, CASE WHEN q THEN 60 ELSE 0 END AS interval_seconds, NOT p AS include_secrets, CASE WHEN p THEN 'src1=2,src4=4' ELSE 'src1=10,src4=4' END AS historical_depth,
['all'] || CASE WHEN p THEN ['private'] ELSE [] END || CASE WHEN q THEN ['pinned'] ELSE [] END || CASE WHEN o THEN ['origin'] ELSE [] END AS matched FROM m)"""


def _decided(spark, sf_dir):
    return decide(artifacts(spark, sf_dir).select("artifact_id", "tags", F.col("agent").alias("origin_agent"), F.lit("memory").alias("type")), RULES, AGENTS)


@query(
    "rules_decision",
    f"WITH {_DECIDED} SELECT artifact_id, array_to_string(allowed, ',') AS allowed_agents, array_to_string(denied, ',') AS denied_agents, array_to_string(assigned, ',') AS assigned_tags, remote_allowed, skill_mode, mode, interval_seconds, include_secrets, historical_depth, array_to_string(matched, ',') AS matched_rules FROM d",
)
def rules_decision(spark, sf_dir):
    d = _decided(spark, sf_dir)
    joined = [F.array_join(c, ",").alias(c) for c in ("allowed_agents", "denied_agents", "assigned_tags", "matched_rules")]
    depth = F.array_join(F.array_sort(F.transform(F.map_entries("historical_depth"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return d.select("artifact_id", *joined, "remote_allowed", "skill_mode", "mode", "interval_seconds", "include_secrets", depth.alias("historical_depth"))


@query(
    "rules_presets",
    f"""WITH a AS (SELECT d.doc_id AS artifact_id, source, CASE doc_id % 3 WHEN 0 THEN 'memory' WHEN 1 THEN 'tool' ELSE 'conversation' END AS type, doc_id % 5 = 0 AS forked, doc_id % 7 = 0 AS private, doc_id % 11 = 0 AS ephemeral FROM documents d)
SELECT artifact_id, 'src1,src2,src3,src4' AS allowed_agents, NOT (private OR ephemeral) AS remote_allowed, CASE WHEN type = 'tool' THEN false END AS include_secrets,
array_to_string(list_filter(['default-all-to-all', CASE WHEN forked THEN 'fork-respects-origin' END, CASE WHEN private THEN 'private-stays-local' END, CASE WHEN type = 'tool' THEN 'tool-secrets-default-local' END, CASE WHEN ephemeral THEN 'ephemeral-projects-stay-local' END], lambda x: x IS NOT NULL), ',') AS matched_rules FROM a""",
)
def rules_presets(spark, sf_dir):
    """The five presets over artifacts of three types, some forked, private or of passing projects."""
    doc = F.col("doc_id")
    tags = F.array_compact(F.array(F.when(doc % 5 == 0, "fork-of:x"), F.when(doc % 7 == 0, "private")))
    a = load_table(spark, sf_dir, "documents").select(
        doc.alias("artifact_id"), tags.alias("tags"), F.when(doc % 3 == 0, "memory").when(doc % 3 == 1, "tool").otherwise("conversation").alias("type"), F.col("source").alias("origin_agent"), F.lit("project").alias("scope_kind"), (doc % 11 == 0).alias("project_ephemeral")
    )
    d = decide(a, with_presets([], list(PRESETS)), AGENTS)
    return d.select("artifact_id", F.array_join("allowed_agents", ",").alias("allowed_agents"), "remote_allowed", "include_secrets", F.array_join("matched_rules", ",").alias("matched_rules"))


PREDICATES = [
    Rule("types", {"type": ["memory", "tool"]}, assign_tags=("t1",)),
    Rule("tools", {"toolKind": ["mcp"], "toolCapability": ["net"]}, assign_tags=("t2",)),
    Rule("project", {"scope": {"kind": ["project"], "project": {"id": ["p1*", "q"], "ephemeral": False}}}, assign_tags=("t3",)),
    Rule("space", {"scope": {"namespace": ["n1"]}, "deviceSource": ["d2"], "kind": "any"}, assign_tags=("t4",)),
    Rule("branch", {"branchName": "^feature-[0-4]$", "path": "/w/src?/*"}, assign_tags=("t5",)),
    Rule("tagged", {"tag": ["la*-en", "zz"]}, assign_tags=("t6",)),
]


@query(
    "rules_predicates",
    """WITH a AS (SELECT doc_id AS artifact_id, doc_id % 3 AS k, doc_id % 10 AS t, source, lang FROM documents)
SELECT artifact_id, array_to_string(list_filter([CASE WHEN k <> 2 THEN 'types' END, CASE WHEN k = 1 AND t < 5 AND t % 2 = 0 THEN 'tools' END, CASE WHEN t < 7 AND artifact_id % 20 IN (1, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19) AND artifact_id % 4 <> 0 THEN 'project' END,
CASE WHEN t = 1 OR artifact_id % 6 = 2 THEN 'space' END, CASE WHEN t < 5 AND length(source) = 4 THEN 'branch' END, CASE WHEN lang = 'en' THEN 'tagged' END], lambda x: x IS NOT NULL), ',') AS matched_rules FROM a""",
)
def rules_predicates(spark, sf_dir):
    """Every predicate of a rule over artifacts with surrogate attributes."""
    doc = F.col("doc_id")
    t = doc % 10
    text = lambda c: c.cast("string")
    a = load_table(spark, sf_dir, "documents").select(
        doc.alias("artifact_id"), F.array_compact(F.array(F.concat(F.lit("lang-"), "lang"))).alias("tags"), F.when(doc % 3 == 0, "memory").when(doc % 3 == 1, "tool").otherwise("skill").alias("type"),
        F.when(t < 5, "mcp").otherwise("cli").alias("tool_kind"), F.when(t % 2 == 0, F.array(F.lit("net"), F.lit("fs"))).otherwise(F.array(F.lit("fs"))).alias("tool_capabilities"), F.when(t < 7, "project").otherwise("global").alias("scope_kind"),
        F.concat(F.lit("p"), text(doc % 20)).alias("project_id"), (doc % 4 == 0).alias("project_ephemeral"), F.concat(F.lit("n"), text(t)).alias("namespace"), F.col("source").alias("origin_agent"), F.concat(F.lit("d"), text(doc % 6)).alias("origin_device"),
        F.concat(F.lit("feature-"), text(t)).alias("branch_name"), F.concat(F.lit("/w/"), "source", F.lit("/f"), text(doc)).alias("native_path"),
    )
    return decide(a, PREDICATES, AGENTS).select("artifact_id", F.array_join("matched_rules", ",").alias("matched_rules"))


@query("rules_routes", f"WITH {_DECIDED} SELECT artifact_id, unnest(allowed) AS agent FROM d")
def rules_routes(spark, sf_dir):
    return route_rows(_decided(spark, sf_dir))


@query("rules_retroactive_tags", f"WITH {_DECIDED}, x AS (SELECT artifact_id, list_sort([t FOR t IN assigned IF NOT list_contains(tags, t) AND NOT starts_with(t, 'device:')]) AS n FROM d) SELECT artifact_id, array_to_string(n, ',') AS added FROM x WHERE len(n) > 0")
def rules_retroactive_tags(spark, sf_dir):
    return retroactive_tags(_decided(spark, sf_dir)).select("artifact_id", F.array_join("added", ",").alias("added"))


def _scrub_sql(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The scrubbed text, and (text before, pattern) of each stage."""
    stages = []
    for pattern, mark in [(C.EMAIL_PATTERN, C.EMAIL_MARK), *[(p, C.SECRET_MARK) for p in C.SECRET_PATTERNS]]:
        stages.append((text, pattern))
        text = f"regexp_replace({text}, '{pattern}', '{mark}', 'g')"
    return text, stages


_SCRUBBED, _STAGES = _scrub_sql("coalesce(text, '')")


@query("scrub_documents", f"SELECT doc_id, md5({_SCRUBBED}) AS text_md5 FROM documents")
def scrub_documents(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(X.scrubbed(F.coalesce("text", F.lit("")))).alias("text_md5"))


@query(
    "scrub_counts",
    f"SELECT sum(len(regexp_extract_all({_STAGES[0][0]}, '{_STAGES[0][1]}')))::BIGINT AS emails, sum({' + '.join(f"len(regexp_extract_all({t}, '{p}'))" for t, p in _STAGES[1:])})::BIGINT AS secrets FROM documents",
)
def scrub_counts(spark, sf_dir):
    counts = X.scrub_counts(F.coalesce("text", F.lit("")))
    return load_table(spark, sf_dir, "documents").agg(F.sum(counts["email"]).alias("emails"), F.sum(counts["secret"]).alias("secrets"))


@query("tag_inventory", f"WITH {_DECIDED} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM a) GROUP BY tag")
def tag_inventory(spark, sf_dir):
    return artifacts(spark, sf_dir).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


_BOUNDS = ", ".join(f"({i}, {b}, '{b}')" for i, b in enumerate(C.HISTOGRAM_BOUNDS)) + ", (11, 1e300, '+Inf')"


@query(
    "value_histogram",
    f"WITH b(place, bound, le) AS (VALUES {_BOUNDS}), t AS (SELECT DISTINCT event_type FROM events) SELECT event_type, le, (SELECT count(*) FROM events e WHERE e.event_type = t.event_type AND e.value / 10 <= b.bound) AS cumulative FROM t, b",
)
def value_histogram(spark, sf_dir):
    e = load_table(spark, sf_dir, "events").select("event_type", (F.col("value") / 10).alias("value"))
    return S.histogram(e, "event_type")


@query("metric_counters", "SELECT 'events_total' AS name, 'kind=\"' || event_type || '\",user=\"' || user_id || '\"' AS labels, count(*)::DOUBLE AS value FROM events GROUP BY event_type, user_id")
def metric_counters(spark, sf_dir):
    e = load_table(spark, sf_dir, "events")
    samples = e.select(F.lit("events_total").alias("name"), F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type")).alias("labels"), F.lit(1.0).alias("value"))
    return S.counters(samples)


@query("metric_gauges", "SELECT 'last_value' AS name, 'user=\"' || user_id || '\"' AS labels, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def metric_gauges(spark, sf_dir):
    e = load_table(spark, sf_dir, "events")
    return S.gauges(e.select(F.lit("last_value").alias("name"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"), "value", F.struct("ts", "event_id").alias("ts")))


@query(
    "suppression_ledger",
    """WITH g AS (SELECT event_type AS agent, user_id % 7 AS reason, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at, list_slice(list_sort(list_distinct(list(props))), 1, 5) AS ex FROM events GROUP BY 1, 2)
SELECT agent, reason, n, first_at, last_at, array_to_string(ex, '|') AS exemplars, epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last_at) > greatest(1800000000, 4 * CASE WHEN n > 1 THEN (epoch_us(last_at) - epoch_us(first_at)) / (n - 1) ELSE 0 END) AS stale FROM g""",
)
def suppression_ledger(spark, sf_dir):
    e = load_table(spark, sf_dir, "events").select(F.col("event_type").alias("agent"), (F.col("user_id") % 7).alias("reason"), "ts", F.col("props").alias("exemplar"))
    return S.suppression_ledger(e, "2024-01-31 00:00:00").withColumn("exemplars", F.array_join("exemplars", "|"))


def _retained(spark, sf_dir):
    """Purchases are checkpoints; a log's users divisible by 11 are pinned."""
    w = Window.partitionBy("artifact_id").orderBy("ts", "event_id")
    e = log_events(spark, sf_dir).withColumn("seq", F.row_number().over(w).cast("long"))
    log = e.select("artifact_id", "seq", "event_id", "ts", F.when(F.col("type") == "purchase", "snapshot").otherwise("update").alias("type"), "payload", F.length("payload").cast("long").alias("bytes"))
    arts = log.select("artifact_id").distinct().select("artifact_id", F.when(F.col("artifact_id") % 2 == 0, "memory").otherwise("conversation").alias("kind"), F.when(F.col("artifact_id") % 11 == 0, F.array(F.lit("pinned"))).otherwise(F.array().cast("array<string>")).alias("tags"), F.lit(0).alias("source_bytes"))
    return log, arts


_LOG = """g AS (SELECT user_id AS artifact_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_type WHEN 'purchase' THEN 'snapshot' ELSE 'update' END AS type, length(props) AS bytes FROM events),
n AS (SELECT artifact_id, seq AS anchor, row_number() OVER (PARTITION BY artifact_id ORDER BY seq DESC) AS k FROM g WHERE type = 'snapshot')"""


@query("checkpoint_nth", f"WITH {_LOG} SELECT artifact_id, anchor FROM n WHERE k = 3")
def checkpoint_nth(spark, sf_dir):
    return R.nth_checkpoint(_retained(spark, sf_dir)[0], 3)


@query("prune_plan", f"WITH {_LOG} SELECT g.artifact_id, count(*) AS moved, sum(bytes + 1)::BIGINT AS moved_bytes FROM g JOIN n ON g.artifact_id = n.artifact_id AND k = 1 AND seq < anchor WHERE g.artifact_id % 11 <> 0 GROUP BY 1")
def prune_plan(spark, sf_dir):
    return R.prune_summary(R.prune_plan(*_retained(spark, sf_dir)))


@query(
    "snapshot_due",
    f"""WITH {_LOG}, h AS (SELECT artifact_id, arg_max(type, seq) AS type, arg_max(ts, seq) AS ts FROM g GROUP BY 1), k AS (SELECT *, CASE WHEN artifact_id % 2 = 0 THEN 'memory' ELSE 'conversation' END AS kind, epoch_us(TIMESTAMP '2024-01-31 12:00:00') // 1000000 - epoch_us(ts) // 1000000 AS age_seconds FROM h)
SELECT artifact_id, kind, age_seconds FROM k WHERE type <> 'snapshot' AND age_seconds >= CASE kind WHEN 'memory' THEN 86400 ELSE 43200 END""",
)
def snapshot_due(spark, sf_dir):
    return R.snapshot_due(*_retained(spark, sf_dir), {"memory": 86400, "conversation": 43200}, "2024-01-31 12:00:00")


@query("snapshot_cadence", f"WITH {_LOG} SELECT artifact_id, count(*) AS event_count FROM g GROUP BY 1 HAVING count(*) % (CASE WHEN artifact_id % 2 = 0 THEN 10 ELSE 5 END) = 0")
def snapshot_cadence(spark, sf_dir):
    return R.snapshot_cadence(*_retained(spark, sf_dir), {"memory": 10, "conversation": 5})


def _slots(spark, sf_dir):
    """Events as attachment assertions: the hash from the value, errors evict."""
    e = load_table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("artifact_id"), F.col("event_id").alias("seq"), "ts", F.lit(0).alias("slot"), F.concat(F.lit("h"), F.floor("value").cast("string")).alias("content_hash"), F.floor("value").alias("bytes"), (F.col("event_type") == "error").alias("evicted"))


_SLOTS = "s AS (SELECT user_id AS artifact_id, event_id AS seq, ts, 'h' || floor(value)::BIGINT AS content_hash, floor(value)::BIGINT AS bytes, event_type = 'error' AS evicted FROM events)"


@query("live_blobs", f"WITH {_SLOTS}, l AS (SELECT artifact_id, content_hash, arg_max(evicted, seq) AS gone FROM s GROUP BY 1, 2) SELECT content_hash FROM l GROUP BY 1 HAVING bool_or(NOT gone)")
def live_blobs(spark, sf_dir):
    return R.live_blobs(_slots(spark, sf_dir))


@query(
    "evict_plan",
    f"""WITH {_SLOTS}, n AS (SELECT artifact_id, content_hash, arg_max(evicted, seq) AS gone, arg_max(ts, seq) AS last FROM s GROUP BY 1, 2)
SELECT s.artifact_id, s.content_hash, min(seq) AS seq, arg_min(bytes, seq) AS bytes FROM s JOIN n ON s.artifact_id = n.artifact_id AND s.content_hash = n.content_hash
WHERE NOT gone AND last < TIMESTAMP '2024-01-21' AND NOT evicted AND ts < TIMESTAMP '2024-01-21' AND s.artifact_id % 11 <> 0 GROUP BY 1, 2""",
)
def evict_plan(spark, sf_dir):
    slots = _slots(spark, sf_dir)
    pinned = slots.select("artifact_id").distinct().withColumn("tags", F.when(F.col("artifact_id") % 11 == 0, F.array(F.lit("pinned"))))
    return R.evict_plan(slots, pinned, "2024-01-31 00:00:00", 10 * 86400)


@query(
    "backfill_cap",
    """WITH c AS (SELECT DISTINCT conv_id, 'src' || (conv_id % 4 + 1) AS source FROM conversations), p AS (SELECT conv_id, source, unnest(['src1', 'src2', 'src3', 'src4']) AS target FROM c)
SELECT conv_id, target FROM p WHERE source <> target QUALIFY row_number() OVER (PARTITION BY target ORDER BY conv_id DESC) <= 10""",
)
def backfill_cap(spark, sf_dir):
    c = load_table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return R.backfill(c.select("conv_id", F.concat(F.lit("src"), (F.col("conv_id") % 4 + 1).cast("string")).alias("source"), F.col("conv_id").alias("updated_at")), AGENTS, 10)


@query("backfill_varying")
def backfill_varying(spark, sf_dir):
    c = load_table(spark, sf_dir, "conversations").select("conv_id").distinct()
    made = c.select("conv_id", F.concat(F.lit("src"), (F.col("conv_id") % 4 + 1).cast("string")).alias("source"), F.col("conv_id").alias("updated_at"), (F.col("conv_id") % 13 - 1).cast("int").alias("cap"))
    return R.backfill_varying(made, AGENTS)


@query("store_areas", "SELECT CASE WHEN event_type = 'error' THEN 'compacted' WHEN event_type = 'view' THEN 'events' WHEN event_type = 'click' THEN 'blobs' ELSE 'other' END AS area, count(*) AS files, sum(floor(value)::BIGINT)::BIGINT AS bytes FROM events GROUP BY 1")
def store_areas(spark, sf_dir):
    place = F.when(F.col("event_type") == "error", "/s/events/.compacted/a").when(F.col("event_type") == "view", "/s/events/a").when(F.col("event_type") == "click", "/s/blobs/a").otherwise("/s/x")
    return R.store_areas(load_table(spark, sf_dir, "events").select(place.alias("path"), F.floor("value").alias("bytes")))
