"""Queries over retention, metrics, streams and the parts of logs that upkeep reads."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlog.operators import logs as L
from skeinlog.operators import metrics as S
from skeinlog.operators import retention as R
from skeinlog.operators import turns as T
from skeinlog.plans.conversations import TURNS
from skeinlog.plans.governance import _LOG, _SLOTS, _retained, _slots
from skeinlog.plans.model import conv_events, log_events
from skeinlog.plans.registry import query
from skeinlog.session import load_table
from skeinlog.streaming import settle

# branches by event type: views are main; sign-ups were merged into it

_ROLLUP = """e AS (SELECT user_id AS artifact_id, event_id, ts, CASE event_type WHEN 'view' THEN 'main' ELSE event_type END AS branch FROM events),
r AS (SELECT artifact_id, branch, min(ts) AS created_at, max(ts) AS last_at, arg_max(event_id, event_id)::VARCHAR AS head, count(*) AS event_count FROM e GROUP BY 1, 2),
m AS (SELECT DISTINCT artifact_id, 'signup' AS branch, 'main' AS merged_into FROM e WHERE branch = 'main' AND event_id % 9 = 0),
b AS (SELECT r.*, merged_into FROM r LEFT JOIN m ON r.artifact_id = m.artifact_id AND r.branch = m.branch)"""


def _rollup(spark, sf_dir):
    e = log_events(spark, sf_dir)
    name = F.when(F.col("type") == "view", F.lit("")).otherwise(F.col("type"))
    merge = (F.col("type") == "view") & (F.col("event_id") % 9 == 0)
    none = F.lit(None).cast("string")
    log = e.select("artifact_id", F.col("event_id").alias("seq"), "ts", name.alias("branch"), F.col("event_id").cast("string").alias("hash"), F.when(merge, "merge").otherwise("update").alias("type"), F.when(merge, "signup").alias("merge_from_branch"), none.alias("parent_hash"), none.alias("fork_source_branch"))
    return L.branch_rollup(log)


@query("branch_rollup_sides", f"WITH {_ROLLUP} SELECT artifact_id, branch, head, event_count, created_at, last_at, merged_into FROM b")
def branch_rollup_sides(spark, sf_dir):
    return _rollup(spark, sf_dir).select("artifact_id", "branch", "head", "event_count", "created_at", "last_at", "merged_into").join(_users(spark, sf_dir), "artifact_id", "left_semi")


def _users(spark, sf_dir):
    return load_table(spark, sf_dir, "events").select(F.col("user_id").alias("artifact_id")).distinct()


@query("branch_places", f"WITH {_ROLLUP} SELECT artifact_id, branch, row_number() OVER (PARTITION BY artifact_id ORDER BY branch <> 'main', created_at, branch)::INTEGER AS place FROM b")
def branch_places(spark, sf_dir):
    return L.listed_branches(_rollup(spark, sf_dir)).select("artifact_id", "branch", "place")


@query("stale_branches", f"WITH {_ROLLUP} SELECT artifact_id, branch, epoch_us(TIMESTAMP '2024-02-01') // 1000000 - epoch_us(last_at) // 1000000 AS age_seconds FROM b WHERE branch <> 'main' AND merged_into IS NULL AND epoch_us(TIMESTAMP '2024-02-01') // 1000000 - epoch_us(last_at) // 1000000 >= 200000")
def stale_branches(spark, sf_dir):
    return R.stale_branches(_rollup(spark, sf_dir), "2024-02-01 00:00:00", 200_000)


@query("snapshot_counts", f"WITH {_LOG} SELECT artifact_id, count(*) FILTER (WHERE type = 'snapshot') AS snapshots FROM g GROUP BY 1")
def snapshot_counts(spark, sf_dir):
    return R.snapshot_count(_retained(spark, sf_dir)[0])


@query(
    "prune_gate",
    f"""WITH {_LOG}, p AS (SELECT g.artifact_id, g.seq FROM g JOIN n ON g.artifact_id = n.artifact_id AND k = 1 AND seq < anchor WHERE g.artifact_id % 11 <> 0)
SELECT artifact_id, seq, CASE WHEN artifact_id % 5 = 0 THEN 'blocked' ELSE 'permitted' END AS state FROM p""",
)
def prune_gate(spark, sf_dir):
    """Every log has three peers; one of them hasn't acked those divisible by five, and some logs have none."""
    log, arts = _retained(spark, sf_dir)
    acks = arts.where("artifact_id % 7 <> 1 or artifact_id % 5 = 0").select("artifact_id", F.explode(F.array(F.lit(True), F.col("artifact_id") % 5 != 0, F.lit(True))).alias("acked"))
    return R.prune_gate(R.prune_plan(log, arts), acks).select("artifact_id", "seq", "state")


@query("prune_gate_forced", f"WITH {_LOG} SELECT count(*) AS n, 'permitted' AS state FROM g JOIN n ON g.artifact_id = n.artifact_id AND k = 2 AND seq < anchor WHERE g.artifact_id % 11 <> 0 HAVING count(*) > 0")
def prune_gate_forced(spark, sf_dir):
    log, arts = _retained(spark, sf_dir)
    acks = arts.select("artifact_id", F.lit(False).alias("acked"))
    return R.prune_gate(R.prune_plan(log, arts, keep=2), acks, forced=True).groupBy("state").agg(F.count("*").alias("n"))


@query(
    "prune_plan_tips",
    f"""WITH RECURSIVE {_LOG}, p AS (SELECT g.artifact_id, g.seq FROM g JOIN n ON g.artifact_id = n.artifact_id AND k = 1 AND seq < anchor WHERE g.artifact_id % 11 <> 0)
SELECT artifact_id, count(*) AS moved FROM p WHERE seq > 6 GROUP BY 1""",
)
def prune_plan_tips(spark, sf_dir):
    """A branch tip at the sixth event protects it and all events before it."""
    log, arts = _retained(spark, sf_dir)
    name = lambda c: F.concat_ws(":", F.col("artifact_id").cast("string"), c.cast("string"))
    chained = log.withColumns({"hash": name(F.col("seq")), "parent_hash": F.when(F.col("seq") > 1, name(F.col("seq") - 1)).otherwise("")})
    plan = R.prune_plan(chained, arts, chained.where("seq = 6").select("artifact_id", "hash"))
    return plan.groupBy("artifact_id").agg(F.count("*").alias("moved"))


@query(
    "collectible_blobs",
    f"""WITH {_SLOTS}, l AS (SELECT content_hash FROM (SELECT artifact_id, content_hash, arg_max(evicted, seq) AS gone FROM s GROUP BY 1, 2) GROUP BY 1 HAVING bool_or(NOT gone)),
b AS (SELECT content_hash AS hash, max(ts) AS mtime FROM s GROUP BY 1 UNION ALL SELECT 'o' || user_id, max(ts) FROM events GROUP BY 1)
SELECT hash FROM b WHERE hash NOT IN (SELECT content_hash FROM l) AND epoch_us(TIMESTAMP '2024-01-30 12:00:00') // 1000000 - epoch_us(mtime) // 1000000 > 3600""",
)
def collectible_blobs(spark, sf_dir):
    """Evicted contents, and one blob a user that no log ever named, an hour old or more."""
    slots = _slots(spark, sf_dir)
    blobs = slots.groupBy(F.col("content_hash").alias("hash")).agg(F.max("ts").alias("mtime"))
    lost = slots.groupBy(F.concat(F.lit("o"), F.col("artifact_id").cast("string")).alias("hash")).agg(F.max("ts").alias("mtime"))
    return R.collectible_blobs(blobs.unionByName(lost), R.live_blobs(slots), "2024-01-30 12:00:00").select("hash")


_AREAS = "a AS (SELECT CASE WHEN event_type = 'error' THEN 'compacted' WHEN event_type = 'view' THEN 'events' WHEN event_type = 'click' THEN 'blobs' ELSE 'other' END AS area, sum(floor(value)::BIGINT)::BIGINT AS bytes FROM events GROUP BY 1)"


@query(
    "store_pressure",
    f"WITH {_AREAS}, t AS (SELECT sum(bytes)::BIGINT AS total, (sum(bytes) FILTER (WHERE area IN ('compacted', 'blobs')))::BIGINT AS rec FROM a) SELECT total, total > 200000 * 0.8 AS over_watermark, total > 200000 * 0.95 AS emergency, total - rec > 200000 * 0.8 AS unreachable FROM t",
)
def store_pressure(spark, sf_dir):
    place = F.when(F.col("event_type") == "error", "/s/events/.compacted/a").when(F.col("event_type") == "view", "/s/events/a").when(F.col("event_type") == "click", "/s/blobs/a").otherwise("/s/x")
    return R.pressure(R.store_areas(load_table(spark, sf_dir, "events").select(place.alias("path"), F.floor("value").alias("bytes"))), 200_000)


@query(
    "gc_report",
    "WITH x AS (SELECT event_type AS action, user_id AS artifact_id, sum(floor(value)::BIGINT)::BIGINT AS bytes FROM events GROUP BY 1, 2) SELECT 0::INTEGER AS part, '| ' || action || ' | ' || artifact_id || ' | ' || bytes || ' |' AS line FROM x UNION ALL SELECT 1, '| total |  | ' || coalesce(sum(bytes), 0)::BIGINT || ' |' FROM x",
)
def gc_report(spark, sf_dir):
    x = load_table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("action"), F.col("user_id").alias("artifact_id")).agg(F.sum(F.floor("value")).alias("bytes"))
    return R.gc_report(x)[0]


@query(
    "metric_exposition",
    "WITH g AS (SELECT event_type AS k, count(*) AS n FROM events GROUP BY 1) SELECT 'events_total' AS name, 1::INTEGER AS part, 'events_total{kind=\"' || k || '\"} ' || n || '.0' AS line FROM g UNION ALL SELECT 'events_total', 0, '# TYPE events_total counter' WHERE EXISTS (SELECT 1 FROM g)",
)
def metric_exposition(spark, sf_dir):
    samples = load_table(spark, sf_dir, "events").select(F.lit("events_total").alias("name"), F.create_map(F.lit("kind"), F.col("event_type")).alias("labels"), F.lit(1.0).alias("value"))
    return S.exposition(S.counters(samples), "counter")


@query(
    "layers_merged",
    "WITH l AS (SELECT event_id, user_id AS artifact_id, ts, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS layer FROM events) SELECT event_id, artifact_id, layer::INTEGER AS layer, (row_number() OVER (PARTITION BY artifact_id ORDER BY date_trunc('hour', ts), layer, event_id) - 1)::INTEGER AS merged_seq FROM l",
)
def layers_merged(spark, sf_dir):
    """A third of the events is compacted; times are cut to hours, so that layers meet."""
    e = log_events(spark, sf_dir).select("artifact_id", "event_id", F.col("event_id").alias("seq"), F.date_trunc("hour", "ts").alias("ts"))
    return L.merged_layers(e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0")).select("event_id", "artifact_id", "layer", "merged_seq")


def _payloads(spark, sf_dir):
    """Sign-ups redact, errors are checkpoints of which some carry a payload; payloads name a format or none."""
    body = F.when(F.col("event_id") % 5 == 0, F.lit('{"content": "plain"}')).otherwise(F.concat(F.lit('{"format": "f'), (F.col("event_id") % 4).cast("string"), F.lit('", "content": "c'), F.col("event_id").cast("string"), F.lit('"}')))
    kind = F.when(F.col("type") == "signup", "redaction").when(F.col("type") == "error", "snapshot").when(F.col("type") == "view", "merge").otherwise("update")
    payload = F.when((F.col("type") == "error") & (F.col("event_id") % 2 == 0), F.lit("null")).otherwise(body)
    return log_events(spark, sf_dir).select("artifact_id", F.col("event_id").alias("seq"), kind.alias("type"), payload.alias("payload"))


_PAYLOADS = """p AS (SELECT user_id AS artifact_id, event_id AS seq, event_type, event_id % 5 = 0 AS plain FROM events), q AS (SELECT * FROM p WHERE event_type IN ('click', 'purchase') OR (event_type = 'error' AND seq % 2 = 1)),
n AS (SELECT artifact_id, max(seq) AS seq FROM q GROUP BY 1)"""


@query("latest_payloads", f"WITH {_PAYLOADS} SELECT artifact_id, seq FROM n")
def latest_payloads(spark, sf_dir):
    return L.latest_payload(_payloads(spark, sf_dir)).select("artifact_id", "seq")


@query("latest_formats", f"WITH {_PAYLOADS} SELECT artifact_id, 'f' || (seq % 4) AS format FROM n WHERE seq % 5 <> 0")
def latest_formats(spark, sf_dir):
    return L.latest_format(_payloads(spark, sf_dir))


@query(
    "content_replay",
    """WITH e AS (SELECT user_id AS artifact_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events),
x AS (SELECT * FROM e WHERE artifact_id NOT IN (SELECT artifact_id FROM e WHERE event_id % 997 = 5)),
c AS (SELECT artifact_id, arg_max(event_id, seq) AS last, arg_max(event_type, seq) AS t FROM x WHERE event_type IN ('click', 'purchase', 'signup') OR (event_type = 'error' AND event_id % 2 = 1) GROUP BY 1)
SELECT artifact_id, CASE WHEN t = 'signup' THEN '' WHEN last % 5 = 0 THEN 'plain' ELSE 'c' || last END AS content FROM c""",
)
def content_replay(spark, sf_dir):
    """Contents of logs with whole chains; a parent is broken at every 997th event."""
    w = Window.partitionBy("artifact_id").orderBy("event_id")
    log = _payloads(spark, sf_dir).withColumn("event_id", F.col("seq")).withColumns({"seq": (F.row_number().over(w) - 1).cast("long"), "hash": F.col("event_id").cast("string")})
    parent = F.when(F.col("event_id") % 997 == 5, "broken").otherwise(F.coalesce(F.lag("hash").over(w), F.lit("")))
    none = [F.lit(None).cast("string").alias(c) for c in ("branch", "aligned_head", "aligned_event_id")]
    return L.replay_content(log.select("artifact_id", "seq", "type", "payload", "hash", parent.alias("parent_hash"), *none))


@query(
    "content_replay_layers",
    """WITH e AS (SELECT user_id AS artifact_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM events),
k AS (SELECT DISTINCT artifact_id FROM e WHERE artifact_id % 3 <> 0 OR n <= 3)
SELECT artifact_id, 'c' || max(event_id) AS content FROM e JOIN k USING (artifact_id) GROUP BY 1""",
)
def content_replay_layers(spark, sf_dir):
    """All but the newest three events of a log are compacted; those of every third log are lost."""
    w = Window.partitionBy("artifact_id").orderBy("event_id")
    e = log_events(spark, sf_dir).select("artifact_id", "event_id", "ts").withColumns({"hash": F.col("event_id").cast("string"), "seq": (F.row_number().over(w) - 1).cast("long")})
    body = F.concat(F.lit('{"content": "c'), F.col("event_id").cast("string"), F.lit('"}'))
    none = [F.lit(None).cast("string").alias(c) for c in ("branch", "aligned_head", "aligned_event_id")]
    log = e.select("artifact_id", "seq", "ts", F.lit("update").alias("type"), body.alias("payload"), "hash", F.coalesce(F.lag("hash").over(w), F.lit("")).alias("parent_hash"), *none, (F.count("*").over(Window.partitionBy("artifact_id")) - F.col("seq")).alias("left"))
    compacted = log.where("left > 3 and artifact_id % 3 <> 0").drop("left")
    return L.replay_layers(log.where("left <= 3").drop("left"), compacted)


# turns


@query("turn_times", f"WITH {TURNS} SELECT conv_id AS artifact_id, CASE WHEN count(*) FILTER (WHERE (conv_id + turn) % 11 = 0) = 0 THEN max(conv_id * 100 + turn) END AS newest, CASE WHEN count(*) FILTER (WHERE (conv_id + turn) % 11 = 0) = 0 THEN min(conv_id * 100 + turn) END AS oldest FROM conversations GROUP BY 1")
def turn_times(spark, sf_dir):
    """Every eleventh turn lacks its time."""
    t = conv_events(spark, sf_dir)
    at = F.when((F.col("artifact_id") + F.col("pos")) % 11 != 0, F.col("artifact_id") * 100 + F.col("pos"))
    return T.turn_times(t.withColumn("ts_nanos", at))


def _blocks(spark, sf_dir):
    """Turns as content blocks: some end with an image, some carry tags or extras."""
    t = conv_events(spark, sf_dir)
    kind = "struct<type:string,text:string>"
    text = F.struct(F.lit("text").alias("type"), F.col("text").alias("text")).cast(kind)
    image = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")).cast(kind)
    pos, conv = F.col("pos"), F.col("artifact_id")
    return t.select(
        "artifact_id", "pos", F.when((conv + pos) % 13 == 0, "system_note").otherwise("turn").alias("type"), "role", F.when(conv % 3 == 0, F.array(text, image)).otherwise(F.array(text)).alias("content"),
        F.when(conv % 5 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("tags"), F.when(conv % 7 == 0, F.lit("{}")).alias("native_extras"),
    )


_GOOD = f"WITH {TURNS}, g AS (SELECT c.conv_id AS artifact_id, c.turn, (c.conv_id + c.turn) % 13 <> 0 AND t.pos IS NOT NULL AS good FROM conversations c LEFT JOIN turns t ON c.conv_id = t.artifact_id AND c.turn = t.pos)"


@query("portable", f"{_GOOD} SELECT artifact_id, bool_and(good) AS portable FROM g GROUP BY 1")
def portable(spark, sf_dir):
    return T.portable(_blocks(spark, sf_dir))


@query("portable_strict", f"{_GOOD} SELECT artifact_id, bool_and(good) AND artifact_id % 3 <> 0 AND artifact_id % 5 <> 0 AND artifact_id % 7 <> 0 AS portable FROM g GROUP BY 1")
def portable_strict(spark, sf_dir):
    return T.portable(_blocks(spark, sf_dir), strict=True)


_TIMED = "t AS (SELECT conv_id AS artifact_id, turn AS pos, role, CASE WHEN turn % 5 = 4 THEN turn - 3 ELSE turn END AS ts_nanos FROM conversations)"


@query(
    "legacy_score",
    f"""WITH {_TIMED}, m AS (SELECT artifact_id, lag(role) OVER w = role AS same, lag(ts_nanos) OVER w > ts_nanos AS back, count(*) OVER (PARTITION BY artifact_id, ts_nanos) > 1 AS cohort FROM t WINDOW w AS (PARTITION BY artifact_id ORDER BY pos))
SELECT artifact_id, count(*) FILTER (WHERE same) AS role_violations, count(*) FILTER (WHERE back) AS time_reversals, count(*) FILTER (WHERE cohort) AS cohort_turns FROM m GROUP BY 1""",
)
def legacy_score(spark, sf_dir):
    """Every fifth turn has the time of an earlier one."""
    pos = F.col("pos")
    return T.legacy_score(conv_events(spark, sf_dir).select("artifact_id", "pos", "role", F.when(pos % 5 == 4, pos - 3).otherwise(pos).alias("ts_nanos")))


# streams


@query("changed_heads", "WITH h AS (SELECT user_id AS artifact_id, max(event_id)::VARCHAR AS head FROM events GROUP BY 1) SELECT artifact_id, head FROM h WHERE NOT (artifact_id % 4 = 0 OR artifact_id % 4 = 1 AND artifact_id % 8 = 1)")
def changed_heads(spark, sf_dir):
    """Heads of some logs were seen, of others an older one."""
    heads = log_events(spark, sf_dir).groupBy("artifact_id").agg(F.max("event_id").cast("string").alias("head"))
    seen = heads.where("artifact_id % 4 = 0 or artifact_id % 8 = 1").unionByName(heads.where("artifact_id % 4 = 2").withColumn("head", F.concat("head", F.lit("x"))))
    return settle.changed_heads(heads, seen).select("artifact_id", "head")


@query(
    "guarded_changes",
    "WITH w AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type <> 'signup'), m AS (SELECT user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'signup') SELECT event_id FROM w WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.user_id = w.user_id AND w.us >= m.us AND w.us < m.us + 36000000000)",
)
def guarded_changes(spark, sf_dir):
    """Sign-ups stand for marks that explain a user's changes for ten hours."""
    e = load_table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("path"), "ts", "event_type")
    return settle.guarded(e.where("event_type <> 'signup'"), e.where("event_type = 'signup'"), 36_000_000).select("event_id")


@query("unchanged_skipped", "WITH f AS (SELECT user_id AS path, count(*) AS size, max(event_id) AS mtime FROM events GROUP BY 1) SELECT path FROM f WHERE path % 3 <> 0")
def unchanged_skipped(spark, sf_dir):
    """The cache knows a third of the files as they are, and another third by another size."""
    f = load_table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("path")).agg(F.count("*").alias("size"), F.max("event_id").alias("mtime"))
    cache = f.where("path % 3 = 0").unionByName(f.where("path % 3 = 1").withColumn("size", F.col("size") + 1))
    return settle.unchanged_skipped(f, cache).select("path")


@query("store_fingerprint", "SELECT count(*) AS n, max(ts) AS newest FROM events")
def store_fingerprint(spark, sf_dir):
    return settle.store_fingerprint(load_table(spark, sf_dir, "events").select(F.col("ts").alias("updated_at")))


@query("content_hashes", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'meta:' || sha256('99999999:' || (doc_id * 1000000)) ELSE sha256(coalesce(text, '')) END AS content_hash FROM documents")
def content_hashes(spark, sf_dir):
    """Documents as files; every tenth is too large to be hashed by content."""
    d = load_table(spark, sf_dir, "documents")
    f = d.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"), F.when(F.col("doc_id") % 10 == 0, F.lit(99_999_999)).otherwise(F.lit(5)).cast("long").alias("length"), F.timestamp_seconds("doc_id").alias("modificationTime"))
    return f.select("doc_id", settle.content_hash().alias("content_hash"))
