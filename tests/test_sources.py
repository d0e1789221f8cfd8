"""Session readers and encoders on hand-written logs."""

import json

import pytest

from skeinlog.sources import sessions as S


def lines(spark, rows, session="s"):
    return spark.createDataFrame([(session, i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], "session_id string, line_no int, line string")


def shape(df):
    out = []
    for r in df.orderBy("session_id", "pos").collect():
        out.append((r.type, r.role, [(c.type, c.text or c.data) for c in r.content], r.call_id, r.tool_name, r.input, r.is_error))
    return out


TYPED = [
    {"type": "user", "timestamp": "2024-01-02T03:04:05.123456Z", "content": "  hello "},
    {"type": "user", "message": {"content": "<command-name>/x</command-name>"}},
    {"type": "assistant", "message": {"model": "m", "content": [{"type": "thinking", "thinking": ""}, {"type": "text", "text": "let me look"}, {"type": "tool_use", "id": "c1", "name": "ls", "input": {"a": 1}}]}},
    {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "c1", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}], "is_error": True}, {"type": "image", "source": {"url": "u://1"}}]}},
    {"type": "assistant", "message": {"model": "<synthetic>", "content": "no"}},
    {"type": "system", "content": "note"},
    {"type": "last-prompt", "content": "x"},
    {"type": "assistant", "content": "done"},
    '{"type": "user", "content": "cut',
    {"type": "user", "content": "never read"},
]


def test_typed_sessions(spark):
    assert shape(S.typed_sessions(lines(spark, TYPED))) == [
        ("turn", "user", [("text", "hello")], None, None, None, False),
        ("turn", "assistant", [("text", "let me look")], None, None, None, False),
        ("tool_call", None, [], "c1", "ls", '{"a":1}', False),
        ("tool_result", None, [("text", "ab")], "c1", None, None, True),
        ("turn", "user", [("image", "u://1")], None, None, None, False),
        ("system_note", None, [("text", "note")], None, None, None, False),
        ("turn", "assistant", [("text", "done")], None, None, None, False),
    ]
    assert str(S.typed_sessions(lines(spark, TYPED)).orderBy("pos").first().ts) == "2024-01-02 03:04:05.123456"


def test_message_sessions(spark):
    rows = [{"type": "message", "message": {"role": "user", "content": "hi"}}, {"type": "message", "message": {"role": "assistant", "content": [{"type": "text", "text": "yo"}]}}, {"type": "other"}]
    assert [(x[0], x[1], x[2]) for x in shape(S.message_sessions(lines(spark, rows)))] == [("turn", "user", [("text", "hi")]), ("turn", "assistant", [("text", "yo")])]


def test_rollout_sessions(spark):
    item = lambda **p: {"type": "response_item", "timestamp": "2024-01-02T03:04:05Z", "payload": p}
    rows = [
        {"type": "session_meta", "payload": {}},
        item(type="message", role="developer", content=[{"type": "input_text", "text": "policy"}]),
        item(type="message", role="user", content=[{"type": "input_text", "text": "a"}, {"type": "input_text", "text": "b"}]),
        item(type="message", role="user", content=[{"type": "input_text", "text": "see"}, {"type": "input_image", "image_url": "u://2"}]),
        item(type="message", role="assistant", phase="commentary", content=[{"type": "output_text", "text": "hm"}]),
        item(type="reasoning"),
        item(type="function_call", call_id="c", name="f", arguments='{"x": 2}'),
        item(type="function_call_output", call_id="c", output="ok"),
        item(type="custom_tool_call", call_id="d", name="patch", input="p"),
        item(type="web_search_call", action={"query": "q"}),
        item(type="message", role="assistant", content=[{"type": "output_text", "text": "fin"}]),
    ]
    assert shape(S.rollout_sessions(lines(spark, rows))) == [
        ("turn", "user", [("text", "ab")], None, None, None, False),
        ("turn", "user", [("text", "see"), ("image", "u://2")], None, None, None, False),
        ("tool_call", None, [], "c", "f", '{"x": 2}', False),
        ("tool_result", None, [("text", "ok")], "c", None, None, False),
        ("tool_call", None, [], "d", "patch", '"p"', False),
        ("tool_call", None, [], None, "web_search", '{"query":"q"}', False),
        ("turn", "assistant", [("text", "fin")], None, None, None, False),
    ]


def test_table_sessions(spark):
    rows = [
        (1, "s", "user", "hi", 1.5, None, None),
        (2, "s", "assistant", "sure", 2.5, None, json.dumps([{"id": "c", "function": {"name": "f", "arguments": "{}"}}])),
        (3, "s", "tool", "out", 2.5, "c", None),
        (4, "s", "user", '\x00json:[{"type":"text","text":"t"},{"type":"image_url","image_url":{"url":"u"}}]', 3.0, None, None),
        (5, "s", "system", "sys", 4.0, None, None),
        (6, "s", "assistant", "", 5.0, None, None),
    ]
    m = spark.createDataFrame(rows, "id long, session_id string, role string, content string, timestamp double, tool_call_id string, tool_calls string")
    assert [(x[0], x[1], x[2], x[3], x[4]) for x in shape(S.table_sessions(m))] == [
        ("turn", "user", [("text", "hi")], None, None),
        ("turn", "assistant", [("text", "sure")], None, None),
        ("tool_call", None, [], "c", "f"),
        ("tool_result", None, [("text", "out")], "c", None),
        ("turn", "user", [("text", "t"), ("image", "u")], None, None),
        ("system_note", None, [("text", "sys")], None, None),
    ]
    assert S.table_sessions(m.drop("tool_calls")).where("type = 'tool_call'").count() == 0
    with pytest.raises(ValueError, match="role"):
        S.table_sessions(m.drop("role"))


def test_changed_sessions_and_bundles(spark):
    s = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", 2.0)], "id string, started_at double")
    m = spark.createDataFrame([(1, "a", 7.0), (2, "a", 6.0), (3, "c", 2.5)], "id long, session_id string, timestamp double")
    changed, mark = S.changed_sessions(s, m, 4.0)
    assert {r.id for r in changed.collect()} == {"a", "b"} and mark.first().mark == 7.0
    assert S.changed_sessions(s, m, 7.0)[0].count() == 0 and S.changed_sessions(s, m, 7.0)[1].first().mark == 7.0
    bundles = {r.id: [x.id for x in (r.messages or [])] for r in S.session_bundles(s, m).collect()}
    assert bundles == {"a": [2, 1], "b": [], "c": [3]}


def test_part_sessions(spark):
    data = [
        {"type": "text", "text": "hi"},
        {"type": "reasoning", "text": "why"},
        {"type": "tool", "callID": "k", "tool": "t", "state": {"status": "completed", "input": {"q": 1}, "output": "o", "time": {"start": 5, "end": 6}}},
        {"type": "tool", "tool": "t", "state": {"status": "running"}},
        {"type": "step-finish", "reason": "stop"},
        {"type": "odd"},
        {"type": "text", "text": ""},
    ]
    rows = [("s", "m", f"p{i}", "user" if i == 0 else "assistant", 1, i + 1, json.dumps(d)) for i, d in enumerate(data)]
    p = spark.createDataFrame(rows, "session_id string, message_id string, id string, role string, message_time long, time_created long, data string")
    assert [(x[0], x[1], x[2], x[3]) for x in shape(S.part_sessions(p))] == [
        ("turn", "user", [("text", "hi")], None),
        ("system_note", None, [("text", "why")], None),
        ("tool_call", None, [], "k"),
        ("tool_result", None, [("text", "o")], "k"),
        ("tool_call", None, [], "p3"),
        ("system_note", None, [("text", "Kilo step finished: stop")], None),
        ("system_note", None, [("text", "Kilo odd part preserved as an internal checkpoint")], None),
    ]


def test_formats_convert_both_ways(spark):
    events = S.typed_sessions(lines(spark, TYPED))
    want = [tuple(r) for r in S.text_turns(events).orderBy("k").collect() if r.text]
    for encode, read in ((S.encode_typed, S.typed_sessions), (S.encode_rollout, S.rollout_sessions)):
        back = read(encode(events))
        got = [tuple(r) for r in S.text_turns(back).orderBy("k").collect()]
        assert got == want
        assert [x[4] for x in shape(back) if x[0] == "tool_call"] == ["ls"]


def test_bundle_turns(spark):
    b = spark.createDataFrame([(1, json.dumps({"messages": [{"role": "user", "content": " a "}, {"role": "tool", "content": "x"}, {"role": "assistant", "content": "b"}]}))], "artifact_id long, json string")
    assert [(r.role, r.text) for r in S.bundle_turns(b).orderBy("pos").collect()] == [("user", "a"), ("assistant", "b")]
