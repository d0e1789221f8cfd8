"""Queries over event logs: heads, pages, chains, folds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlog.functions import constants as C
from skeinlog.operators import logs as L
from skeinlog.plans.model import conv_events, log_events
from skeinlog.plans.registry import query

def _order():
    return F.struct("ts", "event_id")


_COLUMNS = "user_id AS artifact_id, event_id, ts, event_type AS type, value, props AS payload"


@query("first_event", f"SELECT {_COLUMNS} FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_event(spark, sf_dir):
    return L.first_event(log_events(spark, sf_dir), _order())


@query("latest_event", f"SELECT {_COLUMNS} FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_event(spark, sf_dir):
    return L.last_event(log_events(spark, sf_dir), _order())


@query("latest_event_by_type", f"SELECT {_COLUMNS} FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_event_by_type(spark, sf_dir):
    return L.last_event(log_events(spark, sf_dir), _order(), "type")


@query("recent_events_n", f"SELECT {_COLUMNS} FROM events WHERE event_type IN ('click', 'purchase') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def recent_events_n(spark, sf_dir):
    return L.recent_events(log_events(spark, sf_dir), [F.col("ts"), F.col("event_id")], 5, ["click", "purchase"])


@query("recent_headers", "SELECT user_id AS artifact_id, event_id, ts, event_type AS type, value, epoch_us(ts) // 1000 AS seq_ms FROM events QUALIFY rank() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 DESC) <= 3")
def recent_headers(spark, sf_dir):
    return L.recent_headers(log_events(spark, sf_dir), 0, 3)


@query("event_count", "SELECT user_id AS artifact_id, count(*) AS event_count FROM events GROUP BY user_id")
def event_count(spark, sf_dir):
    return L.event_count(log_events(spark, sf_dir))


@query(
    "event_feed_page",
    """WITH r AS (SELECT event_id, user_id AS artifact_id, epoch_ms(date_trunc('hour', ts)) AS seq_ms, CASE event_type WHEN 'error' THEN 'artifact.checkpoint' WHEN 'signup' THEN 'artifact.synced' ELSE 'artifact.imported' END AS feed_type FROM events),
p AS (SELECT * FROM r QUALIFY rank() OVER (ORDER BY seq_ms DESC) <= 100)
SELECT event_id, artifact_id, seq_ms, feed_type, CASE feed_type WHEN 'artifact.checkpoint' THEN 'checkpointed' WHEN 'artifact.synced' THEN 'synced' ELSE 'imported' END AS action,
CASE feed_type WHEN 'artifact.checkpoint' THEN 'system' WHEN 'artifact.synced' THEN 'remote' ELSE 'local' END AS origin, (SELECT min(seq_ms) FROM p) AS next_before FROM p""",
)
def event_feed_page(spark, sf_dir):
    """Feed by hour, so that the page's border ties; errors stand for checkpoints, sign-ups for another device's events."""
    log = log_events(spark, sf_dir).select(
        "event_id",
        "artifact_id",
        F.date_trunc("hour", "ts").alias("ts"),
        F.when(F.col("type") == "error", "snapshot").otherwise("update").alias("type"),
        F.when(F.col("type") == "signup", "far").otherwise("near").alias("device_id"),
        F.array().cast("array<string>").alias("synced_agents"),
        F.lit("/a/b/c").alias("source_path"),
    )
    return L.feed_page(L.feed_records(log, "near")).select("event_id", "artifact_id", "seq_ms", "feed_type", "action", "origin", "next_before")


_CHAIN = """c AS (SELECT user_id AS artifact_id, row_number() OVER w - 1 AS seq, event_id, sha256(event_id || chr(31) || event_type || chr(31) || props) AS hash FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT *, CASE WHEN event_id % 997 = 5 THEN 'broken' ELSE coalesce(lag(hash) OVER (PARTITION BY artifact_id ORDER BY seq), '') END AS parent_hash FROM c)"""


def _chain(spark, sf_dir):
    """User logs as main-branch chains; a few parents are broken on purpose."""
    w = Window.partitionBy("artifact_id").orderBy("ts", "event_id")
    log = log_events(spark, sf_dir).withColumns({"seq": (F.row_number().over(w) - 1).cast("long"), "hash": L.event_hash(["event_id", "type", "payload"])})
    parent = F.when(F.col("event_id") % 997 == 5, "broken").otherwise(F.coalesce(F.lag("hash").over(w), F.lit("")))
    return log.select("artifact_id", "seq", "event_id", F.lit("update").alias("type"), "payload", "ts", "hash", parent.alias("parent_hash"), *[F.lit(None).cast("string").alias(c) for c in ("branch", "aligned_head", "aligned_event_id", "fork_source_branch", "merge_from_branch")])


@query("chain_verify", f"WITH {_CHAIN} SELECT artifact_id, seq, 'parent is not the head' AS fault FROM e WHERE parent_hash <> coalesce((SELECT p.hash FROM e p WHERE p.artifact_id = e.artifact_id AND p.seq = e.seq - 1), '')")
def chain_verify(spark, sf_dir):
    return L.verify_chain(_chain(spark, sf_dir))


@query("branch_rollup", f"WITH {_CHAIN} SELECT artifact_id, 'main' AS branch, arg_max(hash, seq) AS head, count(*) AS event_count FROM e GROUP BY artifact_id")
def branch_rollup(spark, sf_dir):
    return L.branch_rollup(_chain(spark, sf_dir)).select("artifact_id", "branch", "head", "event_count")


_FORKED = """f AS (SELECT conv_id AS artifact_id, turn AS seq, CASE WHEN turn >= 4 THEN 'side' ELSE 'main' END AS branch, sha256(conv_id || ':' || turn) AS hash FROM conversations)"""


def _forked(spark, sf_dir):
    """Conversations as logs whose turns from the fifth on fork off the second one."""
    t = conv_events(spark, sf_dir)
    name = lambda p: F.sha2(F.concat(F.col("artifact_id").cast("string"), F.lit(":"), p.cast("string")), 256)
    pos = F.col("pos")
    return t.select(
        "artifact_id",
        pos.alias("seq"),
        F.when(pos == 4, "fork").otherwise("update").alias("type"),
        F.when(pos >= 4, "side").otherwise(C.MAIN).alias("branch"),
        name(pos).alias("hash"),
        F.when(pos == 0, "").when(pos == 4, name(F.lit(1))).otherwise(name(pos - 1)).alias("parent_hash"),
        F.when(pos == 4, C.MAIN).alias("fork_source_branch"),
        F.lit(None).cast("string").alias("aligned_head"),
        F.lit(None).cast("string").alias("aligned_event_id"),
        F.lit('{"x":1}').alias("payload"),
    )


@query(
    "branch_projection",
    f"""WITH {_FORKED}, p AS (SELECT artifact_id, 'main' AS projected, seq FROM f WHERE branch = 'main' UNION ALL
SELECT artifact_id, 'side', seq FROM f WHERE (branch = 'side' OR seq <= 1) AND artifact_id IN (SELECT artifact_id FROM f WHERE seq = 4))
SELECT artifact_id, projected, seq, row_number() OVER (PARTITION BY artifact_id, projected ORDER BY seq) AS place FROM p""",
)
def branch_projection(spark, sf_dir):
    return L.project_branches(_forked(spark, sf_dir))[0].select("artifact_id", "projected", "seq", "place")


@query(
    "ancestor_closure",
    f"""WITH RECURSIVE {_FORKED}, e AS (SELECT artifact_id, hash, CASE WHEN seq = 0 THEN '' WHEN seq = 4 THEN sha256(artifact_id || ':1') ELSE sha256(artifact_id || ':' || (seq - 1)) END AS parent_hash, seq FROM f),
a AS (SELECT artifact_id, hash, parent_hash FROM e WHERE seq = 5 UNION SELECT e.artifact_id, e.hash, e.parent_hash FROM a JOIN e ON e.artifact_id = a.artifact_id AND e.hash = a.parent_hash)
SELECT artifact_id, hash FROM a""",
)
def ancestor_closure(spark, sf_dir):
    log = _forked(spark, sf_dir)
    return L.ancestors(log, log.where("seq = 5"))


_FOLD = """p AS (SELECT conv_id AS artifact_id, turn AS seq, text, CASE WHEN role = 'system' AND turn > 0 THEN 'none' WHEN turn % 7 = 3 THEN 'full' WHEN turn % 11 = 6 THEN 'legacy' ELSE 'delta' END AS k FROM conversations),
m AS (SELECT *, sum(CASE WHEN k = 'delta' AND lag_k IN ('full', 'delta') THEN 0 ELSE 1 END) OVER (PARTITION BY artifact_id ORDER BY seq) AS s FROM (SELECT *, lag(k) OVER (PARTITION BY artifact_id ORDER BY seq) AS lag_k FROM p)),
l AS (SELECT * FROM m QUALIFY s = max(s) OVER (PARTITION BY artifact_id))"""


@query(
    "state_fold",
    f"""WITH {_FOLD} SELECT artifact_id, CASE WHEN arg_max(k, seq) = 'legacy' THEN 'old' ELSE 'acf.conversation.v1' END AS format, count(*) AS n_items, sha256(string_agg(text, chr(30) ORDER BY seq)) AS state
FROM l GROUP BY artifact_id HAVING arg_max(k, seq) <> 'none'""",
)
def state_fold(spark, sf_dir):
    """Turns as events: later system turns redact, some turns carry full or legacy payloads, the others deltas."""
    t = conv_events(spark, sf_dir)
    pos = F.col("pos")
    kind = F.when((F.col("role") == "system") & (pos > 0), "none").when(pos % 7 == 3, "full").when(pos % 11 == 6, "legacy").otherwise("delta")
    log = t.withColumn("k", kind).select(
        "artifact_id",
        pos.alias("seq"),
        F.when(F.col("k") == "none", "redaction").otherwise("update").alias("type"),
        F.lit("{}").alias("payload"),
        F.when(F.col("k") == "full", C.FULL_FORMAT).when(F.col("k") == "delta", C.DELTA_FORMAT).otherwise("old").alias("format"),
        F.array("text").alias("items"),
    )
    return L.fold_conversations(log).select("artifact_id", "format", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", "\x1e"), 256).alias("state"))


@query(
    "graph_lines",
    f"""WITH {_FORKED} SELECT artifact_id, seq, CASE WHEN seq >= 4 THEN '| ' ELSE '' END || '* ' || left(hash, 8) || ' ' || CASE WHEN seq = 4 THEN '(fork) fork' ELSE 'update' END || ' [' || branch || ']' AS line FROM f""",
)
def graph_lines(spark, sf_dir):
    from skeinlog.operators.resume import graph_log

    return graph_log(_forked(spark, sf_dir))


@query("branch_heads_replay", "SELECT conv_id AS artifact_id, CASE WHEN turn >= 4 THEN 'side' ELSE 'main' END AS branch, count(*) AS n_events, max(CASE WHEN turn = 4 THEN 'main' END) AS parent, max(CASE WHEN turn = 4 THEN 'e1' END) AS fork_point, coalesce(bool_or(turn >= 4), false) AND conv_id % 2 = 0 AS merged FROM conversations GROUP BY 1, 2")
def branch_heads_replay(spark, sf_dir):
    """Turns from the fifth on are a branch that forks off the second; main takes it in for even conversations."""
    pos = F.col("pos")
    e = conv_events(spark, sf_dir).select(
        "artifact_id", "pos", F.when(pos >= 4, "side").alias("branch_id"), F.when(pos == 4, "main").alias("source_branch_id"), F.when(pos == 4, "e1").alias("source_event_id"),
        F.when((pos == 0) & (F.col("artifact_id") % 2 == 0), F.array(F.lit("side"))).otherwise(F.array().cast("array<string>")).alias("merged_branch_ids"),
    )
    return L.branch_replay(e).select("artifact_id", "branch", "n_events", "parent", "fork_point", "merged")


_FAULTS = """c AS (SELECT conv_id AS artifact_id, turn AS seq, conv_id % 8 AS kind FROM conversations),
b AS (SELECT artifact_id, seq, kind, 'h' || seq AS hash FROM c)
SELECT artifact_id, seq, fault FROM (SELECT artifact_id, seq, CASE
WHEN kind = 1 AND seq = 2 THEN 'hash'
WHEN kind = 2 AND seq = 3 THEN 'fork onto a branch that exists'
WHEN kind = 3 AND seq = 3 THEN 'fork parent is no earlier event'
WHEN kind = 4 AND seq = 3 THEN 'branch opens without fork'
WHEN kind = 5 AND seq = 2 THEN 'parent is not the head'
WHEN kind = 6 AND seq = 0 THEN 'baseline without event id'
WHEN kind = 7 AND seq = 0 THEN 'baseline without payload' END AS fault FROM b) WHERE fault IS NOT NULL"""


@query("chain_faults", f"WITH {_FAULTS}")
def chain_faults(spark, sf_dir):
    """Conversations as chains, each with one of seven faults or none."""
    t = conv_events(spark, sf_dir).select("artifact_id", F.col("pos").alias("seq"), (F.col("artifact_id") % 8).alias("kind"))
    seq, kind = F.col("seq"), F.col("kind")
    at = lambda k, s: (kind == k) & (seq == s)
    name = lambda c: F.concat(F.lit("h"), c.cast("string"))
    side = ((kind == 2) & (seq >= 2)) | ((kind == 3) & (seq >= 3)) | ((kind == 4) & (seq >= 3))
    fork = at(2, 2) | at(2, 3) | at(3, 3)
    base = kind.isin(6, 7) & (seq == 0)
    parent = F.when(seq == 0, "").when(at(3, 3), "h99").when(at(5, 2), "h0").when(base, "").when(kind.isin(6, 7) & (seq == 1), "far").otherwise(name(seq - 1))
    log = t.select(
        "artifact_id", "seq", F.when(fork, "fork").when(base, "baseline").otherwise("update").alias("type"), F.when(side, "side").otherwise("main").alias("branch"), name(seq).alias("hash"), parent.alias("parent_hash"),
        F.when(at(1, 2), "other").otherwise(name(seq)).alias("made"), F.when(base, "far").alias("aligned_head"), F.when(base & (kind == 7), "e").alias("aligned_event_id"), F.when(base & (kind == 7), "").otherwise('{"x":1}').alias("payload"), F.when(fork, "main").alias("fork_source_branch"),
    )
    return L.verify_chain(log, F.col("made")).select("artifact_id", "seq", "fault")
