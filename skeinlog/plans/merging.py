"""Queries over two copies of conversations, documents and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlog.operators import merge as M
from skeinlog.operators.turns import visible_turns
from skeinlog.plans.conversations import TURNS
from skeinlog.plans.model import artifacts, conv_events, log_events
from skeinlog.plans.registry import query
from skeinlog.session import load_table


def _copies(spark, sf_dir):
    """Two copies of every conversation: the first lacks some middle turns, the second's odd conversations end early."""
    t = conv_events(spark, sf_dir).select("artifact_id", "pos", "type", "role", F.col("text").alias("content"), F.col("pos").cast("long").alias("ts_nanos"))
    t = t.where("content is not null")
    return t.where("not (artifact_id % 3 = 0 and pos % 4 = 2)"), t.where("not (artifact_id % 2 = 1 and pos >= 3)")


_COPIES = """t AS (SELECT conv_id AS artifact_id, turn AS pos, role, text AS content, turn || chr(31) || sha256(role || chr(31) || 'turn' || chr(31) || text) AS key FROM conversations WHERE text IS NOT NULL),
l AS (SELECT * FROM t WHERE NOT (artifact_id % 3 = 0 AND pos % 4 = 2)), r AS (SELECT * FROM t WHERE NOT (artifact_id % 2 = 1 AND pos >= 3))"""


@query("union_merge", f"WITH {_COPIES}, u AS (SELECT artifact_id, pos, role, key FROM l UNION SELECT artifact_id, pos, role, key FROM r) SELECT artifact_id, pos, role, key, row_number() OVER (PARTITION BY artifact_id ORDER BY pos, key) - 1 AS place FROM u")
def union_merge(spark, sf_dir):
    return M.union_merge(*_copies(spark, sf_dir)).select("artifact_id", "pos", "role", "key", "place")


@query(
    "relation_classify",
    f"""WITH {_COPIES}, a AS (SELECT artifact_id, list(key ORDER BY pos) AS k FROM l GROUP BY 1), b AS (SELECT artifact_id, list(key ORDER BY pos) AS k FROM r GROUP BY 1)
SELECT artifact_id, CASE WHEN x = y THEN 'equal' WHEN len(y) < len(x) AND x[1:len(y)] = y THEN 'stale' WHEN len(x) < len(y) AND y[1:len(x)] = x THEN 'extends' ELSE 'diverged' END AS relation
FROM (SELECT coalesce(a.artifact_id, b.artifact_id) AS artifact_id, coalesce(a.k, []) AS x, coalesce(b.k, []) AS y FROM a FULL JOIN b ON a.artifact_id = b.artifact_id)""",
)
def relation_classify(spark, sf_dir):
    return M.classified(*_copies(spark, sf_dir))


def _bags(spark, sf_dir):
    t = load_table(spark, sf_dir, "events").select(F.col("user_id").alias("artifact_id"), F.col("event_type").alias("attachment"), F.col("event_id"))
    return t.where("event_id % 3 <> 0").drop("event_id"), t.where("event_id % 2 = 0").drop("event_id")


@query(
    "bag_union",
    """WITH l AS (SELECT user_id AS artifact_id, event_type AS attachment, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2), r AS (SELECT user_id AS artifact_id, event_type AS attachment, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2)
SELECT coalesce(l.artifact_id, r.artifact_id) AS artifact_id, coalesce(l.attachment, r.attachment) AS attachment, unnest(range(1, greatest(coalesce(l.n, 0), coalesce(r.n, 0)) + 1)) AS copy
FROM l FULL JOIN r ON l.artifact_id = r.artifact_id AND l.attachment = r.attachment""",
)
def bag_union(spark, sf_dir):
    return M.bag_union(*_bags(spark, sf_dir))


@query(
    "turn_diff",
    f"""WITH {TURNS}, a AS (SELECT artifact_id, pos, t FROM turns WHERE artifact_id % 2 = 0), b AS (SELECT artifact_id - 1 AS artifact_id, pos, t FROM turns WHERE artifact_id % 2 = 1)
SELECT coalesce(a.artifact_id, b.artifact_id) AS artifact_id, coalesce(a.pos, b.pos) AS pos, a.t AS ta, b.t AS tb, CASE WHEN a.t IS NULL THEN 'only_b' WHEN b.t IS NULL THEN 'only_a' ELSE 'changed' END AS diff
FROM a FULL JOIN b ON a.artifact_id = b.artifact_id AND a.pos = b.pos WHERE a.t IS DISTINCT FROM b.t
QUALIFY row_number() OVER (PARTITION BY coalesce(a.artifact_id, b.artifact_id) ORDER BY coalesce(a.pos, b.pos)) <= 5""",
)
def turn_diff(spark, sf_dir):
    """Each even conversation against the odd one after it."""
    t = visible_turns(conv_events(spark, sf_dir))
    odd = t.where("artifact_id % 2 = 1").withColumn("artifact_id", F.col("artifact_id") - 1)
    return M.positional_diff(t.where("artifact_id % 2 = 0"), odd)


@query(
    "line_append",
    r"""WITH b AS (SELECT doc_id AS artifact_id, coalesce(text, '') AS text FROM documents), x AS (SELECT doc_id - 1 AS artifact_id, coalesce(text, '') AS text FROM documents WHERE doc_id >= 1),
bl AS (SELECT DISTINCT artifact_id, trim(l, ' ' || chr(9) || chr(13)) AS t FROM (SELECT artifact_id, unnest(string_split(text, chr(10))) AS l FROM b)),
xl AS (SELECT artifact_id, unnest(range(len(string_split(text, chr(10))))) AS pl, unnest(string_split(text, chr(10))) AS l FROM x),
n AS (SELECT artifact_id, trim(l, ' ' || chr(9) || chr(13)) AS t, min(pl) AS pl, arg_min(rtrim(l, ' ' || chr(9) || chr(13)), pl) AS l FROM xl WHERE trim(l, ' ' || chr(9) || chr(13)) <> '' GROUP BY 1, 2),
k AS (SELECT artifact_id, string_agg(l, chr(10) ORDER BY pl) || chr(10) AS block FROM n WHERE NOT EXISTS (SELECT 1 FROM bl WHERE bl.artifact_id = n.artifact_id AND bl.t = n.t) GROUP BY 1)
SELECT b.artifact_id, md5(CASE WHEN block IS NULL THEN text WHEN trim(text, ' ' || chr(9) || chr(13) || chr(10)) = '' THEN block WHEN suffix(text, chr(10)) THEN text || block ELSE text || chr(10) || block END) AS text_md5 FROM b LEFT JOIN k ON b.artifact_id = k.artifact_id""",
)
def line_append(spark, sf_dir):
    """Each document with the new lines of the document after it."""
    docs = artifacts(spark, sf_dir).select("artifact_id", F.coalesce("text", F.lit("")).alias("text"))
    extra = docs.where("artifact_id >= 1").select((F.col("artifact_id") - 1).alias("artifact_id"), F.lit(0).alias("n"), "text")
    return M.appended_lines(docs, extra).select("artifact_id", F.md5("text").alias("text_md5"))


@query(
    "conflict_pairs",
    """WITH e AS (SELECT user_id AS artifact_id, event_id AS seq, event_type AS agent, epoch_us(ts) AS us, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type <> 'error')
SELECT a.artifact_id, b.seq AS prev_seq, a.seq AS latest_seq FROM e a JOIN e b ON a.artifact_id = b.artifact_id AND a.n = 1 AND b.n = 2 WHERE a.agent <> b.agent AND abs(a.us - b.us) <= 7200000000 AND a.props <> b.props""",
)
def conflict_pairs(spark, sf_dir):
    """Event types stand for agents, errors for checkpoints; the window is two hours, as the surrogate log is sparse."""
    kind = F.when(F.col("type") == "error", "snapshot").otherwise("update")
    log = log_events(spark, sf_dir).select("artifact_id", F.col("event_id").alias("seq"), kind.alias("type"), F.col("type").alias("source_agent"), "ts", "payload", F.col("payload").alias("meaning"))
    return M.conflicts(log, 7200)


@query("tag_rename", "SELECT doc_id AS artifact_id, array_to_string(list_sort(list_distinct([CASE lang WHEN 'en' THEN 'private' ELSE lang END, 'private'])), ',') AS tags FROM documents")
def tag_rename(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("artifact_id"), F.array_join(M.renamed_tag(F.array("lang", F.lit("private")), "en", "private"), ",").alias("tags"))


_PAIRED = f"""{_COPIES}, a AS (SELECT artifact_id, list(key ORDER BY pos) AS x FROM l GROUP BY 1), b AS (SELECT artifact_id, list(key ORDER BY pos) AS y FROM r GROUP BY 1)"""
#: Keys are distinct and in one order in both copies, so a subsequence is a subset here.
_APPEND = f"""{_PAIRED}, o AS (SELECT artifact_id, x, y, coalesce(list_max([n FOR n IN range(2, least(len(x), len(y)) + 1) IF x[len(x) - n + 1:len(x)] = y[1:n]]), 0) AS ov FROM a JOIN b USING (artifact_id)),
d AS (SELECT *, CASE WHEN x = y THEN 'noop' WHEN len(x) < len(y) AND y[1:len(x)] = x THEN 'prefix' WHEN list_has_all(x, y) THEN 'stale' WHEN ov > 0 THEN 'overlap' ELSE 'diverged' END AS action FROM o)"""


def _sides(spark, sf_dir, *names):
    left, right = _copies(spark, sf_dir)
    return M._ordered(M._keyed(left), "key", names[0]).join(M._ordered(M._keyed(right), "key", names[1]), "artifact_id")


@query("append_decision", f"WITH {_APPEND} SELECT artifact_id, action, (CASE action WHEN 'prefix' THEN len(y) - len(x) WHEN 'overlap' THEN len(y) - ov ELSE 0 END)::INTEGER AS appended FROM d")
def append_decision(spark, sf_dir):
    """How the second copy continues the first, and how many turns that adds."""
    made = _sides(spark, sf_dir, "x", "y").withColumn("d", M.append_decision(F.col("x"), F.col("y")))
    return made.select("artifact_id", "d.action", F.size("d.tail").alias("appended"))


@query(
    "append_overlap",
    """WITH t AS (SELECT conv_id AS artifact_id, list(turn ORDER BY turn) AS k FROM conversations GROUP BY 1), p AS (SELECT artifact_id, k[1:len(k) - artifact_id % 3] AS x, k[1 + artifact_id % 4:len(k)] AS y FROM t),
o AS (SELECT *, coalesce(list_max([n FOR n IN range(2, least(len(x), len(y)) + 1) IF x[len(x) - n + 1:len(x)] = y[1:n]]), 0) AS ov FROM p)
SELECT artifact_id, CASE WHEN x = y THEN 'noop' WHEN len(x) < len(y) AND y[1:len(x)] = x THEN 'prefix' WHEN list_has_all(x, y) THEN 'stale' WHEN ov > 0 THEN 'overlap' ELSE 'diverged' END AS action, ov::INTEGER AS overlap, NOT (x = y) AND len(y) < len(x) AND list_has_all(x, y) AS regresses,
(CASE WHEN len(y) > len(x) THEN -1 ELSE coalesce(list_min([i FOR i IN range(0, len(x) - len(y) + 1) IF x[i + 1:i + len(y)] = y]), -1) END)::INTEGER AS at, list_sort(x) = list_sort(y) AS same_bag FROM o""",
)
def append_overlap(spark, sf_dir):
    """The first copy lacks up to two turns at the end, the second up to three at the start."""
    t = conv_events(spark, sf_dir).select("artifact_id", "pos", F.col("pos").cast("string").alias("k"))
    kept = M._ordered(t, "k", "k")
    conv = F.col("artifact_id")
    x = F.slice("k", F.lit(1), F.greatest(F.lit(0), F.size("k") - (conv % 3).cast("int")))
    y = F.slice("k", (conv % 4).cast("int") + 1, F.size("k"))
    p = kept.select("artifact_id", x.alias("x"), y.alias("y"))
    a, b = F.col("x"), F.col("y")
    return p.select("artifact_id", M.append_decision(a, b)["action"].alias("action"), M.suffix_prefix_overlap(a, b).alias("overlap"), M.would_regress(a, b).alias("regresses"), M.sublist_at(b, a).alias("at"), M.multiset_equal(a, b).alias("same_bag"))


@query("thread_merge")
def thread_merge(spark, sf_dir):
    """Both copies of each conversation merged; pairs that share no simple order take the supersequence."""
    return M.thread_merge(_sides(spark, sf_dir, "a", "b"))


@query(
    "replayed_only",
    f"""WITH {_COPIES}, n AS (SELECT artifact_id, count(*) AS n FROM l GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY pos) AS k FROM r),
u AS (SELECT k.artifact_id, EXISTS (SELECT 1 FROM l WHERE l.artifact_id = k.artifact_id AND l.role = k.role) AS old FROM k LEFT JOIN n ON k.artifact_id = n.artifact_id WHERE k > coalesce(n, 0))
SELECT x.artifact_id, coalesce(y.r, false) AS replay_only FROM (SELECT DISTINCT artifact_id FROM r) x LEFT JOIN (SELECT artifact_id, bool_and(old) AS r FROM u GROUP BY 1) y ON x.artifact_id = y.artifact_id""",
)
def replayed_only(spark, sf_dir):
    """A turn's role stands for what it says, so that turns repeat."""
    left, right = _copies(spark, sf_dir)
    return M.replayed_only(left.withColumn("identity", F.col("role")), right.withColumn("identity", F.col("role")))


@query(
    "reconcile",
    f"""WITH {_PAIRED}, c AS (SELECT artifact_id, CASE WHEN x = y THEN 'equal' WHEN len(y) < len(x) AND x[1:len(y)] = y THEN 'stale' WHEN len(x) < len(y) AND y[1:len(x)] = x THEN 'extends' ELSE 'diverged' END AS relation FROM a JOIN b USING (artifact_id))
SELECT artifact_id, relation, CASE WHEN artifact_id % 5 = 0 THEN 'union' WHEN relation = 'equal' THEN 'noop' WHEN relation = 'stale' THEN 'keep' WHEN relation = 'extends' AND artifact_id % 7 <> 1 THEN 'adopt' ELSE 'union' END AS decision FROM c""",
)
def reconcile(spark, sf_dir):
    """Some extensions only replay, and a fifth of the conversations has other attachments."""
    relations = M.classified(*_copies(spark, sf_dir))
    replay = relations.select("artifact_id", (F.col("artifact_id") % 7 == 1).alias("replay_only"))
    bags = relations.select("artifact_id", (F.col("artifact_id") % 5 != 0).alias("attachments_equal")).where("artifact_id % 3 <> 2 or artifact_id % 5 = 0")
    return M.reconcile(relations, replay, bags)


_PLACED = """a AS (SELECT conv_id AS artifact_id, turn AS place, md5(role) AS hash FROM conversations WHERE conv_id % 2 = 0), b AS (SELECT conv_id - 1 AS artifact_id, turn AS place, md5(role) AS hash FROM conversations WHERE conv_id % 2 = 1)"""


@query(
    "branch_diff",
    f"""WITH {_PLACED}, j AS (SELECT coalesce(a.artifact_id, b.artifact_id) AS artifact_id, coalesce(a.place, b.place) AS place, a.hash AS ha, b.hash AS hb FROM a FULL JOIN b ON a.artifact_id = b.artifact_id AND a.place = b.place),
m AS (SELECT *, coalesce(min(CASE WHEN ha IS DISTINCT FROM hb THEN place END) OVER (PARTITION BY artifact_id), 1000000) AS m FROM j)
SELECT artifact_id, 'common' AS side, place, ha AS hash FROM m WHERE place < m UNION ALL SELECT artifact_id, 'only_a', place, ha FROM m WHERE place >= m AND ha IS NOT NULL UNION ALL SELECT artifact_id, 'only_b', place, hb FROM m WHERE place >= m AND hb IS NOT NULL""",
)
def branch_diff(spark, sf_dir):
    """Roles of each even conversation against the odd one after it."""
    t = conv_events(spark, sf_dir).select("artifact_id", F.col("pos").alias("place"), F.md5("role").alias("hash"))
    return M.branch_diff(t.where("artifact_id % 2 = 0"), t.where("artifact_id % 2 = 1").withColumn("artifact_id", F.col("artifact_id") - 1))


@query(
    "event_diff",
    "SELECT a.user_id AS user_a, b.user_id AS user_b, array_to_string(list_filter([CASE WHEN a.user_id <> b.user_id THEN 'artifact_id' END, CASE WHEN a.ts <> b.ts THEN 'ts' END, CASE WHEN a.event_type <> b.event_type THEN 'type' END, CASE WHEN a.value <> b.value THEN 'value' END, CASE WHEN a.props <> b.props THEN 'payload' END], lambda x: x IS NOT NULL), ',') AS differs_in FROM events a, events b WHERE a.event_id = 12 AND b.event_id = 140",
)
def event_diff(spark, sf_dir):
    log = log_events(spark, sf_dir).withColumn("hash", F.sha2(F.col("event_id").cast("string"), 256))
    import hashlib

    found = M.event_diff(log, "12", hashlib.sha256(b"140").hexdigest())
    return found.select(F.col("a.artifact_id").alias("user_a"), F.col("b.artifact_id").alias("user_b"), F.array_join("differs_in", ",").alias("differs_in"))


@query(
    "common_prefix",
    """WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS k FROM conversations GROUP BY 1), p AS (SELECT a.conv_id AS artifact_id, a.k AS x, b.k AS y FROM c a JOIN c b ON a.conv_id % 2 = 0 AND b.conv_id = a.conv_id + 1)
SELECT artifact_id, list_min([i FOR i IN range(0, least(len(x), len(y)) + 1) IF i = least(len(x), len(y)) OR x[i + 1] <> y[i + 1]])::INTEGER AS shared, CASE WHEN x = y THEN 'equal' WHEN len(y) < len(x) AND x[1:len(y)] = y THEN 'stale' WHEN len(x) < len(y) AND y[1:len(x)] = x THEN 'extends' ELSE 'diverged' END AS relation FROM p""",
)
def common_prefix(spark, sf_dir):
    """How many roles the even and the odd conversation after it share from the start."""
    kept = M._ordered(conv_events(spark, sf_dir).select("artifact_id", "pos", "role"), "role", "k")
    odd = kept.where("artifact_id % 2 = 1").select((F.col("artifact_id") - 1).alias("artifact_id"), F.col("k").alias("y"))
    p = kept.where("artifact_id % 2 = 0").withColumnRenamed("k", "x").join(odd, "artifact_id")
    return p.select("artifact_id", M.common_prefix_len(F.col("x"), F.col("y")).alias("shared"), M.relation(F.col("x"), F.col("y")).alias("relation"))


@query(
    "sublist_replace",
    """WITH c AS (SELECT conv_id AS artifact_id, list(role ORDER BY turn) AS k FROM conversations GROUP BY 1), p AS (SELECT *, list_min([i FOR i IN range(0, len(k) - 1) IF k[i + 1] = 'assistant' AND k[i + 2] = 'user']) AS spot FROM c)
SELECT artifact_id, coalesce(spot, -1)::INTEGER AS "at", array_to_string(CASE WHEN spot IS NULL THEN k ELSE k[1:spot] || ['x', 'y', 'z'] || k[spot + 3:len(k)] END, ',') AS made, array_to_string(CASE WHEN spot IS NULL THEN NULL ELSE k[1 + list_max([i FOR i IN range(0, len(k) - 1) IF k[i + 1] = 'assistant' AND k[i + 2] = 'user']) + 2:len(k)] END, ',') AS tail FROM p""",
)
def sublist_replace(spark, sf_dir):
    """An answer and the question after it, replaced; and what follows the last such place."""
    kept = M._ordered(conv_events(spark, sf_dir).select("artifact_id", "pos", "role"), "role", "k")
    pair, k = F.array(F.lit("assistant"), F.lit("user")), F.col("k")
    return kept.select("artifact_id", M.sublist_at(pair, k).alias("at"), F.array_join(M.sublist_replaced(k, pair, F.array(*map(F.lit, "xyz"))), ",").alias("made"), F.array_join(M.tail_after(pair, k), ",").alias("tail"))


_SIDED = """p AS (SELECT conv_id AS artifact_id, turn, 'h' || turn AS hash FROM conversations), n AS (SELECT artifact_id, count(*) AS n FROM p GROUP BY 1), s AS (SELECT artifact_id, list(hash ORDER BY turn) AS s FROM p WHERE artifact_id % 2 = 0 OR turn <> 1 GROUP BY 1), t AS (SELECT artifact_id, list(hash ORDER BY turn) AS t FROM p WHERE turn < 3 GROUP BY 1)"""


@query("fast_forward", f"WITH {_SIDED} SELECT artifact_id, s = t OR (len(t) < len(s) AND s[1:len(t)] = t) AS fast_forward, CASE WHEN s = t OR (len(t) < len(s) AND s[1:len(t)] = t) THEN s[len(s)] END AS new_head FROM s JOIN t USING (artifact_id)")
def fast_forward(spark, sf_dir):
    """Main ends after three turns; the side goes on, and in odd conversations lacks the second."""
    t = conv_events(spark, sf_dir).select("artifact_id", F.col("pos").alias("place"), F.concat(F.lit("h"), F.col("pos").cast("string")).alias("hash"))
    main, side = t.where("place < 3").withColumn("projected", F.lit("main")), t.where("artifact_id % 2 = 0 or place <> 1").withColumn("projected", F.lit("side"))
    return M.fast_forward(main.unionByName(side), "side", "main")


@query(
    "branch_merges",
    "WITH h AS (SELECT user_id AS artifact_id, event_type AS branch, arg_max(event_id, event_id)::VARCHAR AS hash, arg_max(props, event_id) AS payload FROM events GROUP BY 1, 2), p AS (SELECT t.artifact_id, t.hash AS parent_hash, s.hash AS merge_from_hash, t.payload AS tp, s.payload AS sp FROM h t JOIN h s ON t.artifact_id = s.artifact_id AND t.branch = 'view' AND s.branch = 'click') SELECT artifact_id, 'view' AS branch, 'click' AS merge_from_branch, parent_hash, merge_from_hash, unnest(['ours', 'theirs', 'manual']) AS merge_strategy, unnest([tp, sp, 'by hand']) AS payload FROM p",
)
def branch_merges(spark, sf_dir):
    """Clicks merged into views under each strategy."""
    e = log_events(spark, sf_dir)
    heads = e.groupBy("artifact_id", F.col("type").alias("branch")).agg(F.max("event_id").cast("string").alias("hash"), F.max_by("payload", "event_id").alias("payload"))
    made = [M.merged_branch(heads, "click", "view", s, F.lit("by hand")) for s in ("ours", "theirs", "manual")]
    return made[0].unionByName(made[1]).unionByName(made[2]).drop("type")


@query(
    "retimed_cohorts",
    "WITH t AS (SELECT conv_id AS artifact_id, turn // 2 AS ts, role, left(text, 0) AS content FROM conversations), a AS (SELECT artifact_id, max(n) AS largest_cohort FROM (SELECT artifact_id, ts, count(*) AS n FROM t GROUP BY 1, 2) GROUP BY 1), b AS (SELECT artifact_id, count(*) FILTER (WHERE k > 1) AS retimed_contents FROM (SELECT artifact_id, role, count(DISTINCT ts) AS k FROM t GROUP BY 1, 2) GROUP BY 1) SELECT * FROM a JOIN b USING (artifact_id)",
)
def retimed_cohorts(spark, sf_dir):
    """Two turns share a time; all turns of a role say the same, so that contents stand at several times."""
    t = conv_events(spark, sf_dir).select("artifact_id", F.floor(F.col("pos") / 2).alias("ts_nanos"), "role", F.lit("").alias("content"))
    return M.retimed_cohorts(t)


@query(
    "best_copies",
    "WITH c AS (SELECT user_id AS artifact_id, event_id, length(props) % 3 AS role_violations, event_id % 2 AS time_reversals, event_id % 5 AS cohort_turns, props || event_id AS json FROM events) SELECT artifact_id, event_id FROM c QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY role_violations, time_reversals, cohort_turns, json) = 1",
)
def best_copies(spark, sf_dir):
    """Events as copies of a log, scored by surrogates."""
    e = log_events(spark, sf_dir)
    scored = e.select("artifact_id", "event_id", (F.length("payload") % 3).alias("role_violations"), (F.col("event_id") % 2).alias("time_reversals"), (F.col("event_id") % 5).alias("cohort_turns"), F.concat("payload", F.col("event_id").cast("string")).alias("json"))
    return M.best_candidate(scored).select("artifact_id", "event_id")


@query(
    "line_diff",
    r"""WITH a AS (SELECT doc_id AS artifact_id, coalesce(text, '') AS t FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id - 1 AS artifact_id, coalesce(text, '') AS t FROM documents WHERE doc_id % 2 = 1),
p AS (SELECT coalesce(a.artifact_id, b.artifact_id) AS artifact_id, CASE WHEN coalesce(a.t, '') = '' THEN [] ELSE string_split(a.t, chr(10)) END AS x, CASE WHEN coalesce(b.t, '') = '' THEN [] ELSE string_split(b.t, chr(10)) END AS y FROM a FULL JOIN b ON a.artifact_id = b.artifact_id),
l AS (SELECT artifact_id, unnest(range(1, greatest(len(x), len(y)) + 1)) AS line, x, y FROM p),
z AS (SELECT artifact_id, line::INTEGER AS line, regexp_replace(x[line], '^\s+|\s+$', '', 'g') AS la, regexp_replace(y[line], '^\s+|\s+$', '', 'g') AS lb FROM l)
SELECT artifact_id, line, md5(la) AS line_a, md5(lb) AS line_b, CASE WHEN la IS NULL THEN 'only_b' WHEN lb IS NULL THEN 'only_a' ELSE 'changed' END AS diff FROM z WHERE coalesce(la, '') <> coalesce(lb, '') QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY line) <= 5""",
)
def line_diff(spark, sf_dir):
    """Lines of each even document against those of the odd one after it."""
    docs = artifacts(spark, sf_dir).select("artifact_id", "text")
    odd = docs.where("artifact_id % 2 = 1").withColumn("artifact_id", F.col("artifact_id") - 1)
    return M.line_diff(docs.where("artifact_id % 2 = 0"), odd).select("artifact_id", "line", F.md5("line_a").alias("line_a"), F.md5("line_b").alias("line_b"), "diff")


@query(
    "branch_merges_all",
    "WITH h AS (SELECT user_id AS artifact_id, event_type AS branch, max(event_id)::VARCHAR AS hash, arg_max(props, event_id) AS payload, min(ts) AS created_at FROM events WHERE event_type <> 'signup' GROUP BY 1, 2), n AS (SELECT artifact_id FROM h GROUP BY 1 HAVING count(*) >= 2 AND bool_or(branch = 'view')), p AS (SELECT h.*, t.hash AS head, row_number() OVER (PARTITION BY h.artifact_id ORDER BY h.created_at, h.branch) AS place FROM h JOIN n USING (artifact_id) JOIN h t ON t.artifact_id = h.artifact_id AND t.branch = 'view' WHERE h.branch <> 'view') SELECT artifact_id, place::INTEGER AS place, CASE WHEN place = 1 THEN head ELSE 'merge:' || (place - 1) END AS parent_hash, branch AS merge_from_branch, hash AS merge_from_hash, payload FROM p",
)
def branch_merges_all(spark, sf_dir):
    """All open branches merged into views, one after the other; sign-ups were merged before."""
    e = log_events(spark, sf_dir)
    grouped = e.groupBy("artifact_id", F.col("type").alias("branch")).agg(F.max("event_id").cast("string").alias("hash"), F.max_by("payload", "event_id").alias("payload"), F.min("ts").alias("created_at"))
    rollup = grouped.select("artifact_id", "branch", "created_at", F.when(F.col("branch") == "signup", "view").alias("merged_into"))
    made = M.merged_branches(grouped.select("artifact_id", "branch", "hash", "payload"), rollup, "view", "theirs")
    return made.select("artifact_id", "place", "parent_hash", "merge_from_branch", "merge_from_hash", "payload")
