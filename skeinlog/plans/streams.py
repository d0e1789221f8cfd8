"""Queries over change streams, in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlog.plans.registry import query
from skeinlog.session import load_table
from skeinlog.streaming import bus as B
from skeinlog.streaming import settle as S


def _events(spark, sf_dir):
    return load_table(spark, sf_dir, "events")


_QUIET = 3600 * 1000


@query("debounce_settled", "SELECT event_id, user_id, ts FROM events QUALIFY lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) >= 3600000000")
def debounce_settled(spark, sf_dir):
    """Users as paths, an hour as the quiet time."""
    return S.settled(_events(spark, sf_dir).select("event_id", "user_id", "ts"), _QUIET, "user_id")


@query(
    "debounce_committed",
    """WITH s AS (SELECT event_id, user_id, ts, event_type AS content_hash, event_id % 5 <> 0 AS committed FROM events),
l AS (SELECT *, last_value(CASE WHEN committed THEN content_hash END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s)
SELECT event_id, user_id, content_hash FROM l WHERE content_hash IS DISTINCT FROM prev""",
)
def debounce_committed(spark, sf_dir):
    """Event types as hashes; every fifth settle fails and doesn't count as committed."""
    e = _events(spark, sf_dir).select("event_id", "user_id", "ts", F.col("event_type").alias("content_hash"), (F.col("event_id") % 5 != 0).alias("committed"))
    return S.changed_only(e, "user_id").select("event_id", "user_id", "content_hash")


@query(
    "quarantine",
    """WITH r AS (SELECT event_id, user_id AS name, ts, event_type IN ('purchase', 'view') AS ok, sum(CASE WHEN event_type IN ('purchase', 'view') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events),
f AS (SELECT event_id, name, count(*) OVER (PARTITION BY name, s ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS failures FROM r WHERE NOT ok)
SELECT event_id, name, failures FROM f WHERE failures >= 3""",
)
def quarantine(spark, sf_dir):
    """Purchases and views are successes, the others failures; the window is a day, as the surrogate is sparse."""
    rows = _events(spark, sf_dir).select("event_id", F.col("user_id").alias("name"), "ts", F.col("event_id").alias("seq"), F.col("event_type").isin("purchase", "view").alias("ok"))
    return S.quarantines(rows, 3, 86400).select("event_id", "name", "failures")


@query("slot_compaction", "SELECT user_id, event_type, event_id AS seq, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def slot_compaction(spark, sf_dir):
    return S.newest_per_slot(_events(spark, sf_dir).select("user_id", "event_type", F.col("event_id").alias("seq"), "value"), ["user_id", "event_type"])


@query("byte_batch", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER w AS n, sum(length(props)) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n = 1 OR s <= 100")
def byte_batch(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "event_id", F.length("props").alias("bytes"))
    return S.byte_batch(e, 100, "user_id", "event_id").select("user_id", "event_id")


@query("dead_letters", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) > 50")
def dead_letters(spark, sf_dir):
    return S.dead_letters(_events(spark, sf_dir).select("user_id", "event_id"), 50, "user_id", "event_id")


@query("high_water", "SELECT event_id, user_id FROM events WHERE event_id > 9000")
def high_water(spark, sf_dir):
    return S.above_mark(_events(spark, sf_dir), 9000, "event_id")[0].select("event_id", "user_id")


@query("event_id_dedupe", "SELECT DISTINCT event_id, user_id FROM events")
def event_id_dedupe(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id")
    return S.deduped(e.unionByName(e.where("event_id % 3 = 0")))


@query(
    "fingerprint_diff",
    """WITH b AS (SELECT user_id AS path, count(*) AS size, max(event_id) AS mtime FROM events WHERE user_id % 10 <> 3 GROUP BY 1), a AS (SELECT user_id AS path, count(*) AS size, max(event_id) AS mtime FROM events WHERE event_id % 50 <> 0 AND user_id % 10 <> 4 GROUP BY 1)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'REMOVE' ELSE 'CHANGE' END AS op FROM b FULL JOIN a ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.size <> b.size OR a.mtime <> b.mtime""",
)
def fingerprint_diff(spark, sf_dir):
    e = _events(spark, sf_dir)
    listing = lambda df: df.groupBy(F.col("user_id").alias("path")).agg(F.count("*").alias("size"), F.max("event_id").alias("mtime"))
    return S.fingerprint_diff(listing(e.where("user_id % 10 <> 3")), listing(e.where("event_id % 50 <> 0 and user_id % 10 <> 4")))


@query("cursor_moves", "SELECT user_id AS cursor, event_id AS seq, coalesce(n = 1 AND p = 1 OR p = lag(p) OVER w OR p = lag(p) OVER w + 1, false) AS ok FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN event_id % 17 = 0 THEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) + 5 ELSE row_number() OVER (PARTITION BY user_id ORDER BY event_id) END AS p FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def cursor_moves(spark, sf_dir):
    """Positions count up by one; every seventeenth event jumps."""
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    moves = _events(spark, sf_dir).select(F.col("user_id").alias("cursor"), F.col("event_id").alias("seq"), (n + F.when(F.col("event_id") % 17 == 0, 5).otherwise(0)).alias("position"), F.lit(1).alias("span"))
    return S.cursor_moves(moves).select("cursor", "seq", "ok")


@query("bus_numbers", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events")
def bus_numbers(spark, sf_dir):
    return B.numbered(_events(spark, sf_dir).select("event_id", "ts")).select("event_id", "seq")


@query(
    "bus_drops",
    """WITH p AS (SELECT user_id % 4 AS subscriber, event_id AS seq, event_type = 'purchase' AND event_id % 20 = 0 AS mark FROM events),
q AS (SELECT *, coalesce(sum(mark::INTEGER) OVER (PARTITION BY subscriber ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM p),
r AS (SELECT subscriber, row_number() OVER (PARTITION BY subscriber, part ORDER BY seq) > 64 AS dropped FROM q)
SELECT subscriber, count(*) FILTER (WHERE NOT dropped) AS delivered, count(*) FILTER (WHERE dropped) AS dropped FROM r GROUP BY 1""",
)
def bus_drops(spark, sf_dir):
    """Four subscribers; some purchases stand for the moments at which they empty their buffers."""
    e = _events(spark, sf_dir).select((F.col("user_id") % 4).alias("subscriber"), F.col("event_id").alias("seq"), "event_type")
    drained = e.where("event_type = 'purchase' and seq % 20 = 0").select("subscriber", "seq")
    return B.drop_counts(B.delivered(e.select("subscriber", "seq"), drained))


@query("server_sent", "SELECT event_id, 'id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) AS frame FROM events")
def server_sent(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", B.server_sent(F.col("event_id"), F.col("event_type"), F.col("props")).alias("frame"))


@query("lane_gaps", "SELECT user_id AS lane, event_id + 1 AS from_seq, n - 1 AS to_seq FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n > event_id + 1")
def lane_gaps(spark, sf_dir):
    return B.gaps(_events(spark, sf_dir).select(F.col("user_id").alias("lane"), F.col("event_id").alias("seq")))


@query(
    "inbox_arrivals",
    "WITH s AS (SELECT user_id, event_type, event_id, value FROM events WHERE event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1), a AS (SELECT user_id, event_type, event_id, value FROM events WHERE event_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1) SELECT * FROM s UNION ALL SELECT a.* FROM a LEFT JOIN s ON a.user_id = s.user_id AND a.event_type = s.event_type WHERE s.user_id IS NULL",
)
def inbox_arrivals(spark, sf_dir):
    """A third of the events is stored; of those that arrive a key's first is taken, if the key is new."""
    e = _events(spark, sf_dir).select("user_id", "event_type", "event_id", "value")
    return B.inbox(e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0"), ["user_id", "event_type"], "event_id")


@query("session_upsert", "WITH s AS (SELECT DISTINCT conv_id FROM conversations) SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'new' ELSE 'old' END AS title FROM s WHERE conv_id % 2 = 0 OR conv_id % 3 = 0")
def session_upsert(spark, sf_dir):
    """Even sessions are stored; every third one is written again."""
    s = load_table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return B.upserted(s.where("conv_id % 2 = 0").withColumn("title", F.lit("old")), s.where("conv_id % 3 = 0").withColumn("title", F.lit("new")), ["conv_id"])


@query("session_new_messages", "SELECT DISTINCT conv_id, role, md5(coalesce(text, '')) AS body FROM conversations EXCEPT SELECT conv_id, role, md5(coalesce(text, '')) FROM conversations WHERE turn % 2 = 0")
def session_new_messages(spark, sf_dir):
    """Every second message is stored; all arrive, twice."""
    m = load_table(spark, sf_dir, "conversations").select("conv_id", "role", F.md5(F.coalesce("text", F.lit(""))).alias("body"), "turn")
    rows = m.drop("turn")
    return B.new_messages(m.where("turn % 2 = 0").drop("turn"), rows.unionByName(rows), ["conv_id", "role", "body"])


@query(
    "sweep_waits",
    """WITH h AS (SELECT date_trunc('hour', ts) AS h, count(*) FILTER (WHERE event_type = 'error') // 4 AS n, 0 AS newest FROM events GROUP BY 1),
d AS (SELECT h, lag(n) OVER (ORDER BY h) IS DISTINCT FROM n AS drift FROM h), r AS (SELECT *, sum(drift::INTEGER) OVER (ORDER BY h) AS run FROM d)
SELECT h AS seen_at, drift, (row_number() OVER (PARTITION BY run ORDER BY h) - 1)::INTEGER AS unchanged, least(600, 60 * pow(2, least(row_number() OVER (PARTITION BY run ORDER BY h) - 1, 30)))::BIGINT AS wait FROM r""",
)
def sweep_waits(spark, sf_dir):
    """Hours as observations; the number of errors in fours is the fingerprint."""
    h = _events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("at")).agg(F.floor(F.count_if(F.col("event_type") == "error") / 4).alias("n"), F.lit(0).alias("newest"))
    return S.sweeps(h, 60, 600).select(F.col("at").alias("seen_at"), "drift", "unchanged", "wait")
