"""Queries over conversations: turns, summaries, search, transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlog.functions import constants as C
from skeinlog.operators import turns as T
from skeinlog.plans.model import conv_events
from skeinlog.plans.registry import query

_HIDDEN = " OR ".join(f"starts_with(t, '{p}')" for p in C.INJECTED_PREFIXES + C.LOCAL_COMMAND_PREFIXES)
TURNS = rf"""
turns AS (SELECT * FROM (SELECT conv_id AS artifact_id, turn AS pos, role, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t
  FROM conversations WHERE role IN ('user', 'assistant')) WHERE t <> '' AND NOT (role = 'user' AND ({_HIDDEN})))"""
SUMMARY = rf"""
said AS (SELECT artifact_id, pos, role, trim(regexp_replace(t, '\s+', ' ', 'g')) AS s FROM turns),
g AS (SELECT artifact_id, count(*) AS turn_count, arg_min(s, pos) FILTER (WHERE role = 'user' AND s <> '') AS fu,
  arg_min(s, pos) FILTER (WHERE role = 'assistant' AND s <> '') AS fa, arg_max(s, pos) FILTER (WHERE role = 'user' AND s <> '') AS lu,
  array_to_string(list_slice(list(s ORDER BY pos) FILTER (WHERE s <> ''), 1, 6), ' ') AS search_text FROM said GROUP BY artifact_id),
h AS (SELECT *, coalesce(fu, fa, 'Conversation') AS title, coalesce(lu, '') AS d1 FROM g),
k AS (SELECT *, CASE WHEN d1 = title THEN coalesce(fa, '') ELSE d1 END AS d2 FROM h),
summary AS (SELECT artifact_id, title, CASE WHEN d2 = title THEN '' ELSE d2 END AS description, turn_count, search_text FROM k)"""


def _summary(spark, sf_dir):
    return T.conversation_summary(T.visible_turns(conv_events(spark, sf_dir)))


@query("visible_turns", f"WITH {TURNS} SELECT artifact_id, pos, role, t AS text FROM turns")
def visible_turns(spark, sf_dir):
    return T.visible_turns(conv_events(spark, sf_dir))


@query("conversation_summary", f"WITH {TURNS}, {SUMMARY} SELECT * FROM summary")
def conversation_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


def _searched(spark, sf_dir, needle):
    made = _summary(spark, sf_dir).withColumns({"updated_at": F.col("artifact_id"), "source_path": F.concat(F.lit("/conv/"), (F.col("artifact_id") % 90).cast("string"))})
    return T.search(made, needle).select("artifact_id", "title", "description", "turn_count", "source_path")


def _search_sql(needle: str) -> str:
    scan = 25 if not needle else 500
    return f"""WITH {TURNS}, {SUMMARY},
u AS (SELECT *, '/conv/' || (artifact_id % 90) AS source_path FROM summary QUALIFY row_number() OVER (PARTITION BY artifact_id % 90 ORDER BY artifact_id DESC) = 1),
s AS (SELECT * FROM u ORDER BY artifact_id DESC LIMIT {scan})
SELECT artifact_id, title, description, turn_count, source_path FROM s
WHERE contains(lower(artifact_id || ' ' || title || ' ' || description || ' ' || search_text || '  ' || source_path || ' '), '{needle}')
ORDER BY artifact_id DESC LIMIT 25"""


@query("conversation_search", _search_sql(""))
def conversation_search(spark, sf_dir):
    return _searched(spark, sf_dir, "")


@query("conversation_search_needle", _search_sql("tion the"))
def conversation_search_needle(spark, sf_dir):
    return _searched(spark, sf_dir, "Tion The ")


@query("transcript_markdown", f"WITH {TURNS} SELECT artifact_id, string_agg('## ' || role || chr(10) || chr(10) || t, chr(10) || chr(10) ORDER BY pos) AS markdown FROM turns GROUP BY artifact_id")
def transcript_markdown(spark, sf_dir):
    return T.transcript(T.visible_turns(conv_events(spark, sf_dir)))


@query(
    "alternating",
    f"""WITH {TURNS}, p AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY pos) - 1 AS k FROM turns)
SELECT artifact_id, bool_and(role = CASE WHEN k % 2 = 0 THEN 'user' ELSE 'assistant' END) AND count(*) % 2 = 0 AS alternating, count(*) AS n_turns FROM p GROUP BY artifact_id""",
)
def alternating(spark, sf_dir):
    return T.alternating(T.visible_turns(conv_events(spark, sf_dir)))


@query(
    "role_violations",
    f"""WITH {TURNS}, p AS (SELECT artifact_id, CASE WHEN lag(role) OVER w IS NULL THEN role <> 'user' ELSE lag(role) OVER w = role END AS bad FROM turns WINDOW w AS (PARTITION BY artifact_id ORDER BY pos))
SELECT artifact_id, count(*) FILTER (WHERE bad) AS role_violations, count(*) AS n_turns FROM p GROUP BY artifact_id""",
)
def role_violations(spark, sf_dir):
    return T.role_violations(T.visible_turns(conv_events(spark, sf_dir)))


@query(
    "turn_keys",
    f"""WITH {TURNS} SELECT artifact_id, pos, pos || chr(31) || sha256(role || chr(31) || 'turn' || chr(31) || t) AS event_key FROM turns""",
)
def turn_keys(spark, sf_dir):
    from skeinlog.functions.text import event_key

    t = T.visible_turns(conv_events(spark, sf_dir))
    return t.select("artifact_id", "pos", event_key(F.col("pos"), F.col("role"), F.lit("turn"), F.col("text")).alias("event_key"))


@query(
    "turns_hash",
    f"""WITH {TURNS} SELECT artifact_id, sha256(string_agg(role || chr(31) || t, chr(30) ORDER BY pos)) AS turns_hash FROM turns GROUP BY artifact_id""",
)
def turns_hash(spark, sf_dir):
    return T.turns_hash(T.visible_turns(conv_events(spark, sf_dir)))
