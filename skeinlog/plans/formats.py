"""Queries that write conversations in each session format and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlog.plans.conversations import TURNS
from skeinlog.plans.model import conv_events
from skeinlog.plans.registry import query
from skeinlog.session import load_table
from skeinlog.sources import sessions as S

#: All formats carry the visible turns, and every reader finds the same ones.
_TURNS = f"WITH {TURNS} SELECT artifact_id::VARCHAR AS session_id, (row_number() OVER (PARTITION BY artifact_id ORDER BY pos) - 1)::INTEGER AS k, role, t AS text FROM turns"


def _rows(spark, sf_dir):
    return conv_events(spark, sf_dir).select(F.col("artifact_id").cast("string").alias("session_id"), F.col("pos").cast("int").alias("line_no"), "role", F.coalesce("text", F.lit("")).alias("text"))


def _lines(spark, sf_dir, *fields):
    return _rows(spark, sf_dir).select("session_id", "line_no", F.to_json(F.struct(*fields)).alias("line"))


def _typed(spark, sf_dir):
    return S.typed_sessions(_lines(spark, sf_dir, F.col("role").alias("type"), F.col("text").alias("content")))


@query("read_typed", _TURNS)
def read_typed(spark, sf_dir):
    return S.text_turns(_typed(spark, sf_dir))


@query("read_messages", _TURNS)
def read_messages(spark, sf_dir):
    return S.text_turns(S.message_sessions(_lines(spark, sf_dir, F.lit("message").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message"))))


@query("read_rollout", _TURNS)
def read_rollout(spark, sf_dir):
    block = F.array(F.struct(F.when(F.col("role") == "user", "input_text").otherwise("output_text").alias("type"), "text"))
    return S.text_turns(S.rollout_sessions(_lines(spark, sf_dir, F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), "role", block.alias("content")).alias("payload"))))


@query("read_table", _TURNS)
def read_table(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("session_id", F.col("line_no").alias("id"), "role", F.col("text").alias("content"), (F.col("line_no") + 1).cast("double").alias("timestamp"))
    return S.text_turns(S.table_sessions(rows))


def _stored(spark, sf_dir):
    """Conversations as tables of sessions, messages and parts; odd ones were never updated after their creation."""
    rows = _rows(spark, sf_dir)
    conv, n = F.col("session_id").cast("long"), F.col("line_no").cast("long")
    sessions = rows.select("session_id").distinct().select(F.col("session_id").alias("id"), (conv * 10).alias("time_created"), F.when(conv % 2 == 0, conv * 10 + 500).alias("time_updated"))
    messages = rows.select(F.format_string("m%04d", "line_no").alias("id"), "session_id", (n + 1).alias("time_created"), F.to_json(F.struct("role")).alias("data"))
    parts = rows.select(F.lit("p").alias("id"), "session_id", F.format_string("m%04d", "line_no").alias("message_id"), (n + 1).alias("time_created"), F.to_json(F.struct(F.lit("text").alias("type"), "text")).alias("data"))
    return sessions, messages, parts


@query("read_updated_parts", _TURNS + " WHERE artifact_id * 10 + CASE WHEN artifact_id % 2 = 0 THEN 500 ELSE 0 END > 600")
def read_updated_parts(spark, sf_dir):
    return S.text_turns(S.part_sessions(S.updated_parts(*_stored(spark, sf_dir), 600)))


@query("changed_sessions", "WITH s AS (SELECT conv_id, conv_id * 10.0 AS started, max(conv_id * 10 + turn * 7) AS last FROM conversations GROUP BY 1) SELECT conv_id::VARCHAR AS id, (SELECT greatest(650.0, max(greatest(started, last))) FROM s) AS mark FROM s WHERE greatest(started, last) > 650")
def changed_sessions(spark, sf_dir):
    """Sessions that began or were written to after a mark, and the next mark."""
    c = load_table(spark, sf_dir, "conversations")
    key = F.col("conv_id").cast("string")
    sessions = c.select(key.alias("id"), (F.col("conv_id") * 10).cast("double").alias("started_at")).distinct()
    messages = c.select(key.alias("session_id"), (F.col("conv_id") * 10 + F.col("turn") * 7).cast("double").alias("timestamp"))
    changed, mark = S.changed_sessions(sessions, messages, 650.0)
    return changed.select("id").join(F.broadcast(mark), F.lit(True))


@query("session_bundles", "SELECT conv_id::VARCHAR AS id, string_agg(CASE WHEN turn % 2 = 0 THEN role END, ',' ORDER BY -turn) AS roles FROM conversations GROUP BY 1")
def session_bundles(spark, sf_dir):
    """Sessions with every second message, newest first by their time."""
    c = load_table(spark, sf_dir, "conversations")
    messages = c.where("turn % 2 = 0").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("id"), (-F.col("turn")).alias("timestamp"), "role")
    found = S.session_bundles(c.select(F.col("conv_id").cast("string").alias("id")).distinct(), messages)
    return found.select("id", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))


def _round(name, encode, read):
    @query(f"write_{name}", _TURNS)
    def run(spark, sf_dir):
        return S.text_turns(read(encode(_typed(spark, sf_dir))))

    run.__name__ = f"write_{name}"


for _name, _encode, _read in (
    ("typed", S.encode_typed, S.typed_sessions), ("typed_portable", S.encode_typed_portable, S.typed_sessions), ("messages", S.encode_messages, S.message_sessions), ("rollout", S.encode_rollout, S.rollout_sessions),
    ("rollout_portable", S.encode_rollout_portable, S.rollout_sessions), ("table", S.encode_table, S.table_sessions), ("parts", S.encode_parts, S.part_sessions),
):
    _round(_name, _encode, _read)


@query("table_headers", f"WITH {TURNS}, u AS (SELECT artifact_id, arg_min(t, pos) AS t FROM turns WHERE role = 'user' GROUP BY 1) SELECT c.conv_id::VARCHAR AS id, 'From x: ' || trim(split_part(u.t, chr(10), 1)) AS title FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN u ON u.artifact_id = c.conv_id")
def table_headers(spark, sf_dir):
    made = S.table_headers(S.encode_table(_typed(spark, sf_dir)), "x")
    return made.select("id", F.replace("title", F.lit("↪ x: "), F.lit("From x: ")).alias("title"))
