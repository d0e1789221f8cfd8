"""Session readers: native logs and tables to canonical conversation events.

Line formats come in as ``session_id, line_no, line``.  All parsing is done by
JVM functions over VARIANT values; the result of every reader has the columns
of ``EVENT_COLUMNS``, ordered by ``pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlog.functions.text import is_hidden_context, join_text_blocks, normalized_turn

#: The engine's own key for the tags of an event in line formats that know none.
TAGS_KEY = "skein_tags"
EVENT_COLUMNS = ["session_id", "pos", "type", "ts", "role", "content", "call_id", "tool_name", "input", "is_error", "tags"]
_EVENT = "struct<type:string,role:string,content:array<struct<type:string,text:string,data:string>>,call_id:string,tool_name:string,input:string,is_error:boolean,tags:array<string>>"
_BLOCKS = "array<struct<type:string,text:string,data:string>>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file and place.

    Spark keeps no line numbers, so each file is read whole and numbered; use
    it for session files, which are small, not for bulk logs.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("session_id"), "value")
    return whole.select("session_id", F.posexplode(F.split("value", "\n")).alias("line_no", "line")).where("line <> ''")


def _text_block(text: Column, kind: str = "text") -> Column:
    return F.array(F.struct(F.lit(kind).alias("type"), text.alias("text"), F.lit(None).cast("string").alias("data")))


def _event(kind: str, role: Column | None = None, content: Column | None = None, call_id: Column | None = None, tool: Column | None = None, given: Column | None = None, error: Column | None = None, tags: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(kind).alias("type"), (none if role is None else role).cast("string").alias("role"), (F.array() if content is None else content).cast(_BLOCKS).alias("content"),
        (none if call_id is None else call_id).cast("string").alias("call_id"), (none if tool is None else tool).cast("string").alias("tool_name"), (none if given is None else given).cast("string").alias("input"),
        F.coalesce(none.cast("boolean") if error is None else error, F.lit(False)).alias("is_error"), (F.array() if tags is None else tags).cast("array<string>").alias("tags"),
    ).cast(_EVENT)


def _one(cond: Column, event: Column) -> Column:
    return F.when(cond, F.array(event)).otherwise(F.array().cast(f"array<{_EVENT}>"))


def _ordered(rows: DataFrame, events: Column) -> DataFrame:
    """Explode ``events`` of rows with ``session_id, line_no, ts`` and number them through a session.

    A row's ``ts_end`` is the time of its results, its ``tags`` those of its events without any.
    """
    end = F.col("ts_end") if "ts_end" in rows.columns else F.lit(None).cast("timestamp")
    own = F.col("tags") if "tags" in rows.columns else F.lit(None).cast("array<string>")
    out = rows.select("session_id", "line_no", "ts", end.alias("__end"), own.alias("__tags"), F.posexplode(events).alias("__i", "__e")).select("session_id", "line_no", "ts", "__end", "__tags", "__i", "__e.*")
    out = out.withColumns({"ts": F.when(F.col("type") == "tool_result", F.coalesce("__end", "ts")).otherwise(F.col("ts")), "tags": F.when(F.size("tags") == 0, F.coalesce("__tags", "tags")).otherwise(F.col("tags"))})
    w = Window.partitionBy("session_id").orderBy("line_no", "__i")
    return out.withColumn("pos", F.row_number().over(w) - 1).select(*EVENT_COLUMNS)


def _parsed(lines: DataFrame) -> DataFrame:
    """Lines as VARIANT up to a session's first malformed one."""
    v = lines.where(F.trim("line") != "").withColumn("v", F.try_parse_json("line"))
    bad = F.min(F.when(F.col("v").isNull(), F.col("line_no"))).over(Window.partitionBy("session_id"))
    return v.withColumn("__bad", bad).where(F.col("__bad").isNull() | (F.col("line_no") < F.col("__bad"))).drop("__bad")


def _get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def _raw(v: Column) -> Column:
    return F.to_json(v)


def _time(column: Column) -> Column:
    return F.try_to_timestamp(column)


def _image(block: Column) -> Column:
    source = block["source"]
    return F.coalesce(F.nullif(_get(source, "$.url"), F.lit("")), F.nullif(_get(source, "$.data"), F.lit("")), _raw(source))


def _result_text(block: Column) -> Column:
    """Text of a tool result: its text, a string content, or the joined texts of a block list."""
    listed = F.transform(F.filter(_get(block["content"], "$", "array<struct<type:string,text:string>>"), lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    inner = F.when(_is_string(block["content"]), _get(block["content"], "$")).otherwise(F.array_join(listed, ""))
    return F.coalesce(F.nullif(block["text"], F.lit("")), inner, F.lit(""))


def typed_sessions(lines: DataFrame) -> DataFrame:
    """Rows typed user, assistant or system, with string or block content, plain or under ``message``.

    Results come before the turn of their row, calls after it.  Rows of the
    reserved ``<synthetic>`` model and empty thinking blocks are left out.
    """
    return _typed(_parsed(lines))


def _typed(parsed: DataFrame) -> DataFrame:
    block = "array<struct<type:string,text:string,thinking:string,id:string,name:string,tool_use_id:string,is_error:boolean,input:variant,content:variant,source:variant>>"
    content = F.coalesce(_get("v", "$.content", "variant"), _get("v", "$.message.content", "variant"))
    rows = parsed.select("session_id", "line_no", "v", _get("v", "$.type").alias("kind"), _time(_get("v", "$.timestamp")).alias("ts"), _get("v", "$.message.model").alias("model"), content.alias("c"))
    rows = rows.withColumns({"s": F.when(_is_string(F.col("c")), _get("c", "$")), "b": F.coalesce(_get("c", "$", block), F.array().cast(block))})
    b = F.col("b")
    none = F.array().cast(f"array<{_EVENT}>")

    def shown(x):
        image = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), _image(x).alias("data"))
        text = F.struct(F.lit("text").alias("type"), F.coalesce(x["text"], F.lit("")).alias("text"), F.lit(None).cast("string").alias("data"))
        thought = F.struct(F.lit("thinking").alias("type"), x["thinking"].alias("text"), F.lit(None).cast("string").alias("data"))
        return F.when(x["type"] == "image", image).when(x["type"] == "thinking", thought).otherwise(text)

    user_blocks = F.transform(F.filter(b, lambda x: x["type"].isin("text", "image")), shown)
    reply_blocks = F.transform(F.filter(b, lambda x: (x["type"] == "text") | ((x["type"] == "thinking") & (F.coalesce(x["thinking"], F.lit("")) != ""))), shown)
    results = F.transform(F.filter(b, lambda x: x["type"] == "tool_result"), lambda x: _event("tool_result", content=_text_block(_result_text(x)), call_id=x["tool_use_id"], error=x["is_error"]))
    calls = F.transform(F.filter(b, lambda x: x["type"] == "tool_use"), lambda x: _event("tool_call", call_id=x["id"], tool=x["name"], given=_raw(x["input"])))
    rows = rows.withColumns({"ub": user_blocks, "ab": reply_blocks})
    plain = F.forall("ub", lambda x: x["type"] == "text")
    joined = F.array_join(F.transform("ub", lambda x: x["text"]), "\n\n")
    said = normalized_turn(F.lit("user"), F.coalesce("s", joined))
    user_text = _one(said.isNotNull(), _event("turn", F.lit("user"), _text_block(said)))
    user_turn = F.when(F.col("s").isNotNull(), user_text).when(F.size("ub") == 0, none).when(plain, user_text).otherwise(F.array(_event("turn", F.lit("user"), F.col("ub"))))
    reply_turn = F.when(F.col("s").isNotNull(), F.array(_event("turn", F.lit("assistant"), _text_block(F.col("s"))))).otherwise(_one(F.size("ab") > 0, _event("turn", F.lit("assistant"), F.col("ab"))))
    note = _one(F.col("s").isNotNull() & ~is_hidden_context(F.coalesce("s", F.lit(""))), _event("system_note", content=_text_block(F.col("s"))))
    events = F.when(F.col("kind") == "user", F.concat(results, user_turn)).when((F.col("kind") == "assistant") & ~F.coalesce(F.col("model") == "<synthetic>", F.lit(False)), F.concat(reply_turn, calls)).when(F.col("kind") == "system", note).otherwise(none)
    return _ordered(rows.withColumn("tags", _get("v", f"$.{TAGS_KEY}", "array<string>")), events)


def message_sessions(lines: DataFrame) -> DataFrame:
    """Rows of type ``message``: the role of the message takes the type's place, then as ``typed_sessions``."""
    parsed = _parsed(lines)
    role = _get("v", "$.message.role")
    swapped = F.when((_get("v", "$.type") == "message") & (F.coalesce(role, F.lit("")) != ""), role).otherwise(_get("v", "$.type"))
    content = _get("v", "$.message.content", "variant")
    remade = F.to_json(F.struct(_get("v", f"$.{TAGS_KEY}", "array<string>").alias(TAGS_KEY), swapped.alias("type"), _get("v", "$.timestamp").alias("timestamp"), F.struct(_get("v", "$.message.model").alias("model"), content.alias("content")).alias("message"), _get("v", "$.content", "variant").alias("content")))
    return _typed(parsed.withColumn("v", F.try_parse_json(remade)))


def rollout_sessions(lines: DataFrame) -> DataFrame:
    """``response_item`` rows: messages, function calls and outputs, custom tool calls, web searches.

    Developer and system messages, and assistant messages of a phase other
    than the final answer, are left out; adjacent texts are joined.
    """
    parsed = _parsed(lines).where(_get("v", "$.type") == "response_item")
    p = "array<struct<type:string,text:string,image_url:string>>"
    rows = parsed.select(
        "session_id", "line_no", _time(_get("v", "$.timestamp")).alias("ts"), _get("v", "$.payload.type").alias("kind"), _get("v", "$.payload.role").alias("role"), _get("v", "$.payload.phase").alias("phase"),
        _get("v", "$.payload.content", p).alias("c"), _get("v", "$.payload.call_id").alias("call_id"), _get("v", "$.payload.name").alias("name"), _get("v", "$.payload.arguments", "variant").alias("arguments"),
        _get("v", f"$.payload.{TAGS_KEY}", "array<string>").alias("tags"), _get("v", "$.payload.input", "variant").alias("input"), _get("v", "$.payload.action", "variant").alias("action"), _get("v", "$.payload.output", "variant").alias("output"),
    )
    none = F.array().cast(f"array<{_EVENT}>")
    empty = F.array().cast(_BLOCKS)

    def step(done, x):
        last = F.try_element_at(done, F.lit(-1))
        text = x["type"].isin("input_text", "output_text", "text")
        grown = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), _text_block(F.concat(last["text"], F.coalesce(x["text"], F.lit("")))).cast(_BLOCKS))
        image = F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), x["image_url"].alias("data"))).cast(_BLOCKS)
        fresh = F.concat(done, _text_block(F.coalesce(x["text"], F.lit(""))).cast(_BLOCKS))
        return F.when(text & F.coalesce(last["type"] == "text", F.lit(False)), grown).when(text & (F.coalesce(x["text"], F.lit("")) != ""), fresh).when(x["type"] == "input_image", F.concat(done, image)).otherwise(done)

    rows = rows.withColumn("b", F.aggregate(F.coalesce("c", F.array().cast(p)), empty, step))
    plain = F.forall("b", lambda x: x["type"] == "text")
    said = normalized_turn(F.col("role"), join_text_blocks(F.col("b")))
    turn = F.when(F.size("b") == 0, none).when((F.col("role") == "user") & plain, _one(said.isNotNull(), _event("turn", F.lit("user"), _text_block(said)))).otherwise(F.array(_event("turn", F.col("role"), F.col("b"))))
    final = F.coalesce("phase", F.lit("")).isin("", "final", "final_answer")
    message = F.when((F.col("role") == "user") | ((F.col("role") == "assistant") & final), turn).otherwise(none)
    arguments = F.when(_is_string(F.col("arguments")), _get("arguments", "$")).otherwise(_raw(F.col("arguments")))
    output = F.when(_is_string(F.col("output")), _get("output", "$")).otherwise(F.coalesce(_get("output", "$.output"), _get("output", "$.content"), _raw(F.col("output"))))
    call = lambda tool, given: F.array(_event("tool_call", call_id=F.col("call_id"), tool=tool, given=given))
    events = F.when(F.col("kind") == "message", message).when(F.col("kind") == "function_call", call(F.col("name"), arguments))
    events = events.when(F.col("kind") == "custom_tool_call", call(F.col("name"), F.coalesce(_raw(F.col("input")), arguments))).when(F.col("kind") == "web_search_call", call(F.lit("web_search"), _raw(F.col("action"))))
    events = events.when(F.col("kind").isin("function_call_output", "custom_tool_call_output"), F.array(_event("tool_result", content=_text_block(F.coalesce(output, F.lit(""))), call_id=F.col("call_id")))).otherwise(none)
    return _ordered(rows, events)


# session tables

#: Columns that a message table must have; others are optional and read as null.
CORE_MESSAGE = ["id", "session_id", "role", "content", "timestamp"]
# Fixed value: what a message of several parts opens with.
MULTI_MARK = "\x00json:"
OPTIONAL_MESSAGE = {"tool_call_id": "string", "tool_calls": "string", "tool_name": "string", "reasoning": "string"}


def checked_columns(table: DataFrame, core: list[str], optional: dict[str, str]) -> DataFrame:
    """The known columns of a table: a missing core column is an error, a missing optional one is null."""
    if lost := [c for c in core if c not in table.columns]:
        raise ValueError(f"missing columns: {lost}")
    return table.select(*core, *[F.col(c).cast(t).alias(c) if c in table.columns else F.lit(None).cast(t).alias(c) for c, t in optional.items()])


def from_epoch(seconds: Column) -> Column:
    """Float epoch seconds as a time; zero means missing."""
    return F.when(seconds != 0, F.timestamp_micros(F.round(seconds * 1_000_000).cast("long")))


def changed_sessions(sessions: DataFrame, messages: DataFrame, mark: float) -> tuple[DataFrame, DataFrame]:
    """Sessions started after the mark or with a message after it, and the new mark."""
    newest = messages.groupBy(F.col("session_id").alias("id")).agg(F.max("timestamp").alias("last_message"))
    held = sessions.join(newest, "id", "left").withColumn("last", F.greatest("started_at", F.coalesce("last_message", F.col("started_at"))))
    changed = held.where(F.col("last") > mark)
    return changed.drop("last_message", "last"), changed.agg(F.greatest(F.lit(mark), F.coalesce(F.max("last"), F.lit(mark))).alias("mark"))


def session_bundles(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Each session with its messages in order of time and id; an empty list if it has none."""
    rest = [c for c in messages.columns if c != "session_id"]
    listed = messages.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("timestamp", "id", *[c for c in rest if c not in ("timestamp", "id")]))).alias("messages"))
    return sessions.join(listed, F.col("id") == F.col("session_id"), "left").drop("session_id")


def table_sessions(messages: DataFrame) -> DataFrame:
    """Message rows by role to events; calls of an assistant's JSON list follow its turn."""
    m = checked_columns(messages, CORE_MESSAGE, OPTIONAL_MESSAGE)
    w = Window.partitionBy("session_id").orderBy("timestamp", "id")
    m = m.withColumns({"line_no": F.row_number().over(w), "ts": from_epoch(F.col("timestamp")), "t": F.coalesce("content", F.lit(""))})
    none = F.array().cast(f"array<{_EVENT}>")
    mark = MULTI_MARK
    part = "array<struct<type:string,text:string,image_url:variant,source:variant>>"
    multi = F.startswith("t", F.lit(mark))
    payload = F.substr(F.col("t"), F.lit(len(mark) + 1))
    url = lambda x: F.when(_is_string(x["image_url"]), _get(x["image_url"], "$")).otherwise(_get(x["image_url"], "$.url"))
    listed = F.transform(
        F.filter(_get(F.try_parse_json(payload), "$", part), lambda x: x["type"].isin("text", "image_url", "image")),
        lambda x: F.struct(F.when(x["type"] == "text", "text").otherwise("image").alias("type"), x["text"].alias("text"), F.when(x["type"] == "image_url", url(x)).when(x["type"] == "image", _image(x)).alias("data")),
    )
    m = m.withColumn("blocks", F.when(multi & (F.coalesce(F.size(listed), F.lit(0)) > 0), listed).otherwise(_text_block(F.when(multi, payload).otherwise(F.col("t")))).cast(_BLOCKS))
    said = normalized_turn(F.lit("user"), F.col("t"))
    called = F.coalesce("tool_call_id", F.lit("")) != ""
    result = F.array(_event("tool_result", content=F.col("blocks"), call_id=F.coalesce("tool_call_id", F.lit(""))))
    calls = F.transform(F.coalesce(F.from_json("tool_calls", "array<struct<id:string,function:struct<name:string,arguments:string>>>"), F.array().cast("array<struct<id:string,function:struct<name:string,arguments:string>>>")), lambda c: _event("tool_call", call_id=c["id"], tool=c["function"]["name"], given=c["function"]["arguments"]))
    carries = (F.col("t") != "") | F.col("reasoning").isNotNull()
    reply = F.concat(_one(carries, _event("turn", F.lit("assistant"), F.when(F.col("t") != "", F.col("blocks")).otherwise(F.array().cast(_BLOCKS)))), calls)
    user = F.when(called, result).otherwise(_one((F.col("t") != "") & said.isNotNull(), _event("turn", F.lit("user"), F.when(multi, F.col("blocks")).otherwise(_text_block(said)))))
    events = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", reply).when(F.col("role") == "tool", result).when((F.col("role") == "system") & (F.col("t") != ""), F.array(_event("system_note", content=F.col("blocks")))).otherwise(none)
    return _ordered(m, events)


# Notes and tags of message parts that are no text or tool, as peers know them.
CHECKPOINT_TAG = "internal-checkpoint"
PART_TAG = "kilo:"
STEP_STARTED, STEP_FINISHED, COMPACTED = "Kilo step started", "Kilo step finished", "Kilo compaction checkpoint"
OTHER_PART = ("Kilo ", " part preserved as an internal checkpoint")
MESSAGE_FAILED = "Kilo assistant message ended with an error"


def updated_parts(sessions: DataFrame, messages: DataFrame, parts: DataFrame, since_ms: int) -> DataFrame:
    """Rows for ``part_sessions`` of the sessions updated (or, without that, created) after a time in ms.

    ``sessions``: ``id, time_created, time_updated``; ``messages``: ``id, session_id,
    time_created, data``; ``parts``: ``id, session_id, message_id, time_created, data``.
    A message without parts gives one row with null ``data`` and its own JSON in
    ``message_data``.
    """
    fresh = sessions.where(F.coalesce("time_updated", "time_created", F.lit(0)) > since_ms).select(F.col("id").alias("session_id"))
    said = messages.join(fresh, "session_id", "left_semi").select("session_id", F.col("id").alias("message_id"), F.get_json_object("data", "$.role").alias("role"), F.col("time_created").alias("message_time"), F.col("data").alias("message_data"))
    held = parts.select("session_id", "message_id", "id", "time_created", "data")
    return said.join(held, ["session_id", "message_id"], "left")


def part_sessions(parts: DataFrame) -> DataFrame:
    """Parts of messages (``session_id, message_id, id, role, message_time, time_created, data`` JSON) to events.

    Texts become turns; tools a call and, once they ended, a result at the time of
    their end; reasoning, steps, compactions and unknown parts become tagged notes.  A row
    without a part gives a note if ``message_data`` says that an assistant's message failed.
    """
    w = Window.partitionBy("session_id").orderBy("message_time", "message_id", "id")
    p = parts.withColumns({"line_no": F.row_number().over(w), "v": F.try_parse_json("data")})
    p = p.withColumns({"kind": F.coalesce(_get("v", "$.type"), F.lit("")), "text": F.coalesce(_get("v", "$.text"), F.lit("")), "status": _get("v", "$.state.status")})
    failed = F.lit(False)
    if "message_data" in parts.columns:
        error = F.get_json_object("message_data", "$.error")
        failed = F.col("data").isNull() & (F.col("role") == "assistant") & error.isNotNull() & ~error.isin("", "null")
    ms = lambda *paths: F.coalesce(*[F.nullif(_get("v", x, "bigint"), F.lit(0).cast("long")) for x in paths], F.nullif(F.col("time_created").cast("long"), F.lit(0).cast("long")), F.col("message_time").cast("long"))
    start = F.when(F.col("kind") == "tool", ms("$.state.time.start", "$.time.start", "$.time.created")).when(F.col("kind") == "step-finish", ms("$.time.end", "$.time.created")).otherwise(ms("$.time.start", "$.time.created", "$.time.end"))
    at = lambda m: F.when(m != 0, F.timestamp_millis(m))
    p = p.withColumns({"ts": at(start), "ts_end": at(ms("$.state.time.end", "$.time.end", "$.time.created"))})
    call_id = F.coalesce(F.nullif(_get("v", "$.callID"), F.lit("")), F.col("id"))
    ended = F.coalesce(F.col("status").isin("completed", "error"), F.lit(False))
    note = lambda text, tag: F.array(_event("system_note", content=_text_block(text), tags=F.array(F.concat(F.lit(PART_TAG), tag), F.lit(CHECKPOINT_TAG))))
    none = F.array().cast(f"array<{_EVENT}>")
    call = _event("tool_call", call_id=call_id, tool=F.coalesce(F.nullif(_get("v", "$.tool"), F.lit("")), F.lit("unknown")), given=F.coalesce(_raw(_get("v", "$.state.input", "variant")), F.lit("{}")), tags=F.when(~ended, F.array(F.lit(PART_TAG + "tool-incomplete"), F.lit(CHECKPOINT_TAG))).otherwise(F.array().cast("array<string>")))
    result = _event("tool_result", content=_text_block(F.coalesce(F.when(F.col("status") == "error", _get("v", "$.state.error")).otherwise(_get("v", "$.state.output")), F.lit(""))), call_id=call_id, error=F.col("status") == "error")
    reason = F.coalesce(_get("v", "$.reason"), F.lit(""))
    shown, kind = F.col("text") != "", F.col("kind")
    events = F.when(failed, note(F.lit(MESSAGE_FAILED), F.lit("error"))).when(F.col("data").isNull(), none)
    events = events.when(kind == "text", _one(shown, _event("turn", F.coalesce(F.nullif("role", F.lit("")), F.lit("assistant")), _text_block(F.col("text")))))
    events = events.when(kind == "reasoning", F.when(shown, note(F.col("text"), kind)).otherwise(none)).when(kind == "tool", F.when(ended, F.array(call, result)).otherwise(F.array(call)))
    events = events.when(kind == "step-start", note(F.lit(STEP_STARTED), kind)).when(kind == "step-finish", note(F.concat(F.lit(STEP_FINISHED), F.when(reason == "", "").otherwise(F.concat(F.lit(": "), reason))), kind))
    events = events.when(kind == "compaction", note(F.lit(COMPACTED), kind)).otherwise(note(F.concat(F.lit(OTHER_PART[0]), kind, F.lit(OTHER_PART[1])), F.when(kind == "", "unknown-part").otherwise(kind)))
    return _ordered(p, events)


def bundle_turns(bundles: DataFrame) -> DataFrame:
    """Text turns of legacy bundle documents (``artifact_id, json``): ``artifact_id, pos, role, text``."""
    rows = bundles.select("artifact_id", F.posexplode(F.from_json("json", "struct<messages:array<struct<role:string,content:string>>>")["messages"]).alias("pos", "m"))
    turns = rows.where(F.col("m.role").isin("user", "assistant")).select("artifact_id", "pos", F.col("m.role").alias("role"), normalized_turn(F.col("m.role"), F.col("m.content")).alias("text"))
    return turns.where("text is not null")


# encoders: canonical events back to lines and rows


_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _at() -> Column:
    return F.date_format("ts", _ISO)


def _tags() -> Column:
    """An event's tags; null if it has none, so that JSON leaves them out."""
    return F.when(F.size("tags") > 0, F.col("tags"))


def _source(data: Column) -> Column:
    """What an image block holds as a source: its own JSON, an address, or bytes in base64."""
    held = F.when(F.startswith(F.trim(data), F.lit("{")), F.try_parse_json(data))
    url = F.to_variant_object(F.struct(F.lit("url").alias("type"), data.alias("url")))
    raw = F.to_variant_object(F.struct(F.lit("base64").alias("type"), data.alias("data")))
    return F.coalesce(held, F.when(F.rlike(data, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), url).otherwise(raw))


def _lines(events: DataFrame, line: Column) -> DataFrame:
    return events.select("session_id", F.col("pos").alias("line_no"), line.alias("line")).where("line is not null")


def encode_typed(events: DataFrame) -> DataFrame:
    """Canonical events as lines that ``typed_sessions`` reads back, with images, thoughts and tags."""
    text = join_text_blocks(F.col("content"))
    plain = F.forall("content", lambda b: b["type"] == "text")

    def block(b):
        none = F.lit(None)
        return F.struct(
            F.coalesce(b["type"], F.lit("text")).alias("type"), F.when(b["type"] == "text", b["text"]).otherwise(none.cast("string")).alias("text"), F.when(b["type"] == "thinking", b["text"]).otherwise(none.cast("string")).alias("thinking"),
            F.when(b["type"] == "image", _source(b["data"])).alias("source"),
        )

    wrap = lambda kind, content: F.to_json(F.struct(kind.alias("type"), _at().alias("timestamp"), F.struct(content.alias("content")).alias("message"), _tags().alias(TAGS_KEY)))
    turn = F.when(plain, wrap(F.col("role"), text)).otherwise(wrap(F.col("role"), F.transform("content", block)))
    call = wrap(F.lit("assistant"), F.array(F.struct(F.lit("tool_use").alias("type"), F.col("call_id").alias("id"), F.col("tool_name").alias("name"), F.try_parse_json("input").alias("input"))))
    result = wrap(F.lit("user"), F.array(F.struct(F.lit("tool_result").alias("type"), F.col("call_id").alias("tool_use_id"), text.alias("content"), F.col("is_error").alias("is_error"))))
    note = F.to_json(F.struct(F.lit("system").alias("type"), _at().alias("timestamp"), text.alias("content"), _tags().alias(TAGS_KEY)))
    return _lines(events, F.when(F.col("type") == "turn", turn).when(F.col("type") == "tool_call", call).when(F.col("type") == "tool_result", result).when(F.col("type") == "system_note", note))


def encode_rollout(events: DataFrame) -> DataFrame:
    """Canonical events as lines that ``rollout_sessions`` reads back, with images and tags; notes become developer messages, which it leaves out."""
    text = join_text_blocks(F.col("content"))
    said = F.when(F.col("role") == "assistant", "output_text").otherwise("input_text")
    wrap = lambda payload: F.to_json(F.struct(_at().alias("timestamp"), F.lit("response_item").alias("type"), payload.alias("payload")))
    tags = _tags().alias(TAGS_KEY)
    none = F.lit(None).cast("string")
    block = lambda b: F.struct(F.when(b["type"] == "image", "input_image").otherwise(said).alias("type"), F.when(b["type"] == "image", none).otherwise(b["text"]).alias("text"), F.when(b["type"] == "image", b["data"]).alias("image_url"))
    blocks = F.transform(F.filter("content", lambda b: b["type"].isin("text", "image")), block)
    one = F.array(F.struct(said.alias("type"), text.alias("text"), none.alias("image_url")))
    plain = F.forall("content", lambda b: b["type"] != "image")
    message = lambda role, content: wrap(F.struct(F.lit("message").alias("type"), role.alias("role"), content.alias("content"), tags))
    role = F.when(F.col("role").isin("user", "assistant", "system"), F.col("role")).otherwise("user")
    turn = F.when(plain, message(role, one)).otherwise(message(role, blocks))
    call = wrap(F.struct(F.lit("function_call").alias("type"), F.col("call_id").alias("call_id"), F.col("tool_name").alias("name"), F.col("input").alias("arguments"), tags))
    result = wrap(F.struct(F.lit("function_call_output").alias("type"), F.col("call_id").alias("call_id"), text.alias("output"), tags))
    note = message(F.lit("developer"), F.array(F.struct(F.lit("input_text").alias("type"), text.alias("text"), none.alias("image_url"))))
    return _lines(events, F.when(F.col("type") == "turn", turn).when(F.col("type") == "tool_call", call).when(F.col("type") == "tool_result", result).when(F.col("type") == "system_note", note))


def encode_table(events: DataFrame) -> DataFrame:
    """Canonical events as message rows that ``table_sessions`` reads back.

    Calls are assistant rows without a text and with a JSON list; images go as a marked JSON list of parts.
    User turns that no person wrote are left out.
    """
    text = join_text_blocks(F.col("content"))
    part = lambda b: F.struct(F.when(b["type"] == "image", "image_url").otherwise("text").alias("type"), F.when(b["type"] != "image", b["text"]).alias("text"), F.when(b["type"] == "image", F.struct(b["data"].alias("url"))).alias("image_url"))
    multi = F.concat(F.lit(MULTI_MARK), F.to_json(F.transform("content", part)))
    body = F.when(F.exists("content", lambda b: b["type"] == "image"), multi).when((F.col("type") == "turn") & (F.col("role") == "user"), normalized_turn(F.lit("user"), text)).otherwise(text)
    role = F.when(F.col("type") == "tool_call", "assistant").when(F.col("type") == "tool_result", "tool").when(F.col("type") == "system_note", "system").when(F.col("role").isin("user", "assistant", "system"), F.col("role")).otherwise("user")
    calls = F.to_json(F.array(F.struct(F.col("call_id").alias("id"), F.lit("function").alias("type"), F.struct(F.col("tool_name").alias("name"), F.coalesce("input", F.lit("")).alias("arguments")).alias("function"))))
    rows = events.where(F.col("type").isin("turn", "tool_call", "tool_result", "system_note")).select(
        "session_id", F.col("pos").alias("id"), role.alias("role"), F.when(F.col("type") == "tool_call", "").otherwise(body).alias("content"), F.coalesce(F.unix_micros("ts") / 1_000_000, F.lit(0.0)).alias("timestamp"),
        F.when(F.col("type") == "tool_result", F.col("call_id")).alias("tool_call_id"), F.when(F.col("type") == "tool_call", calls).alias("tool_calls"), F.when(F.col("type") == "tool_call", F.col("tool_name")).alias("tool_name"),
    )
    return rows.where("content is not null")


def table_headers(rows: DataFrame, origin: str = "") -> DataFrame:
    """Session rows of ``encode_table``'s rows: start, end, number of messages, and a title from the first user message."""
    first = F.min_by("content", F.when((F.col("role") == "user") & ~F.startswith("content", F.lit(MULTI_MARK)), F.col("id")))
    made = rows.groupBy(F.col("session_id").alias("id")).agg(F.min_by("timestamp", "id").alias("started_at"), F.nullif(F.max_by("timestamp", "id"), F.lit(0.0)).alias("ended_at"), F.count("*").alias("message_count"), first.alias("__first"))
    line = F.trim(F.element_at(F.split("__first", "\n"), 1))
    return made.withColumn("title", F.concat(F.lit(f"↪ {origin}: " if origin else ""), line)).drop("__first")


def _portable(events: DataFrame) -> DataFrame:
    """Visible turns with their place ``k``, time and session, for formats that carry nothing else."""
    t = events.where("type = 'turn' and role in ('user', 'assistant')").select("session_id", "pos", "ts", "role", normalized_turn(F.col("role"), join_text_blocks(F.col("content"))).alias("text")).where("text is not null")
    return t.withColumn("k", (F.row_number().over(Window.partitionBy("session_id").orderBy("pos")) - 1).cast("int"))


def _named(prefix: str, k: Column) -> Column:
    """Id of a session's ``k``-th message: the same each time the session is written."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.col("session_id"), 256), 1, 12), F.lit("-"), F.lpad(k.cast("string"), 6, "0"))


def encode_messages(events: DataFrame, agent: str = "") -> DataFrame:
    """Visible turns as lines that ``message_sessions`` reads back: a header, then messages, each naming the one before it."""
    t = _portable(events)
    head = t.groupBy("session_id").agg(F.min("ts").alias("ts")).select("session_id", F.lit(-1).alias("line_no"), F.to_json(F.struct(F.lit("session").alias("type"), _named("s", F.lit(0)).alias("id"), _at().alias("timestamp"), F.col("session_id").alias("skein_thread"))).alias("line"))
    k = F.col("k")
    names = [_named("m", k).alias("id"), F.when(k > 0, _named("m", k - 1)).alias("parentId"), _at().alias("timestamp")]
    user = F.to_json(F.struct(F.lit("message").alias("type"), *names, F.struct(F.col("role"), F.col("text").alias("content")).alias("message")))
    reply = F.to_json(F.struct(F.lit("message").alias("type"), *names, F.struct(F.col("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"), F.lit(agent).alias("model"), F.lit("stop").alias("stopReason")).alias("message")))
    return head.unionByName(t.select("session_id", k.alias("line_no"), F.when(F.col("role") == "user", user).otherwise(reply).alias("line")))


def encode_parts(events: DataFrame) -> DataFrame:
    """Visible turns as part rows that ``part_sessions`` reads back; ``parent_id`` is the question that an answer follows.

    A session that opens with an answer gets an empty question to hang it on.
    """
    t = _portable(events)
    ms = F.coalesce(F.unix_millis("ts"), F.lit(0))
    last = F.max(F.when(F.col("role") == "user", F.col("k"))).over(Window.partitionBy("session_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    rows = t.withColumn("__up", F.when(F.col("role") == "assistant", F.coalesce(last, F.lit(-1))))
    made = rows.select(
        "session_id", _named("m", F.col("k")).alias("message_id"), _named("p", F.col("k")).alias("id"), F.col("role"), (ms + F.col("k")).alias("message_time"), (ms + F.col("k")).alias("time_created"),
        F.to_json(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("data"), F.when(F.col("__up") >= 0, _named("m", F.col("__up"))).when(F.col("__up") < 0, _named("r", F.lit(0))).alias("parent_id"),
    )
    root = rows.where("k = 0 and role = 'assistant'").select(
        "session_id", _named("r", F.lit(0)).alias("message_id"), _named("q", F.lit(0)).alias("id"), F.lit("user").alias("role"), (ms - 1).alias("message_time"), (ms - 1).alias("time_created"), F.to_json(F.struct(F.lit("text").alias("type"), F.lit("").alias("text"))).alias("data"), F.lit(None).cast("string").alias("parent_id")
    )
    return made.unionByName(root)


def encode_typed_portable(events: DataFrame) -> DataFrame:
    """Visible turns as typed lines with ids, each naming the one before it: what another program may resume."""
    t, k = _portable(events), F.col("k")
    row = F.struct(F.col("role").alias("type"), _named("u", k).alias("uuid"), F.when(k > 0, _named("u", k - 1)).alias("parentUuid"), F.col("session_id").alias("sessionId"), _at().alias("timestamp"), F.struct(F.col("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content")).alias("message"))
    return t.select("session_id", k.alias("line_no"), F.to_json(row).alias("line"))


def encode_rollout_portable(events: DataFrame) -> DataFrame:
    """Visible turns as rollout lines after a line that describes the session."""
    t = _portable(events)
    meta = t.groupBy("session_id").agg(F.min("ts").alias("ts")).select("session_id", F.lit(-1).alias("line_no"), F.to_json(F.struct(_at().alias("timestamp"), F.lit("session_meta").alias("type"), F.struct(F.col("session_id").alias("id"), _at().alias("timestamp")).alias("payload"))).alias("line"))
    as_events = t.select("session_id", F.col("k").alias("pos"), F.lit("turn").alias("type"), "ts", "role", _text_block(F.col("text")).cast(_BLOCKS).alias("content"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("input"), F.lit(False).alias("is_error"), F.array().cast("array<string>").alias("tags"))
    return meta.unionByName(encode_rollout(as_events))


def text_turns(events: DataFrame) -> DataFrame:
    """``session_id, k, role, text`` of visible turns: the unit that copies in other formats are compared by."""
    t = events.where("type = 'turn' and role in ('user', 'assistant')").select("session_id", "pos", "role", normalized_turn(F.col("role"), join_text_blocks(F.col("content"))).alias("text")).where("text is not null")
    w = Window.partitionBy("session_id").orderBy("pos")
    return t.withColumn("k", F.row_number().over(w) - 1).select("session_id", "k", "role", "text")
