"""Operators on small hand-written tables that the driver data has no cases for."""

import json
import random

import pytest
from pyspark.sql import functions as F

from skeinlog.functions import documents as D
from skeinlog.operators import catalog, logs, merge, resume, retention, rules
from skeinlog.sources import configs
from skeinlog.streaming import settle

LOG = "artifact_id long, seq long, type string, branch string, hash string, parent_hash string, payload string, aligned_head string, aligned_event_id string, fork_source_branch string"


def log(spark, rows):
    """Rows of (artifact, seq, type, branch, hash, parent, source branch, aligned head)."""
    made = [(a, s, t, b, h, p, '{"x":1}', al, "e" if al else None, src) for a, s, t, b, h, p, src, al in rows]
    return spark.createDataFrame(made, LOG)


def test_chains(spark):
    rows = [
        (1, 0, "create", "main", "a", "", None, None), (1, 1, "update", "", "b", "a", None, None), (1, 2, "fork", "side", "c", "a", "main", None), (1, 3, "update", "side", "d", "c", None, None),
        (2, 0, "create", "main", "a", "", None, None), (2, 1, "update", "main", "b", "x", None, None),
        (3, 0, "create", "main", "a", "", None, None), (3, 1, "update", "side", "b", "a", None, None),
        (4, 0, "baseline", "main", "a", "", None, "far"), (4, 1, "update", "main", "b", "far", None, None),
        (5, 0, "baseline", "side", "a", "", None, "far"), (5, 1, "update", "side", "b", "far", None, None),
        (6, 0, "create", "main", "a", "", None, None), (6, 1, "fork", "side", "b", "nowhere", "main", None),
    ]
    got = {r.artifact_id: (r.intact, r.fault_seq) for r in logs.intact(log(spark, rows)).collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (False, 1), 4: (True, None), 5: (True, None), 6: (False, 1)}


def test_projections(spark):
    rows = [
        (1, 0, "create", "main", "a", "", None, None), (1, 1, "update", "main", "b", "a", None, None), (1, 2, "update", "main", "c", "b", None, None),
        (1, 3, "fork", "x", "d", "b", "main", None), (1, 4, "update", "x", "e", "d", None, None), (1, 5, "fork", "y", "f", "a", "x", None), (1, 6, "fork", "z", "g", "e", "x", None),
        (2, 0, "create", "main", "a", "", None, None), (2, 1, "redaction", "main", "b", "a", None, None), (2, 2, "fork", "x", "c", "a", "main", None), (2, 3, "fork", "w", "d", "zz", "main", None), (2, 4, "update", "v", "e", "a", None, None), (2, 5, "fork", "u", "f", "a", "gone", None),
    ]
    done, errors = logs.project_branches(log(spark, rows))
    got = {}
    for r in done.orderBy("place").collect():
        got.setdefault((r.artifact_id, r.projected), []).append(r.hash)
    assert got == {(1, "main"): ["a", "b", "c"], (1, "x"): ["a", "b", "d", "e"], (1, "y"): ["a", "f"], (1, "z"): ["a", "b", "d", "e", "g"], (2, "main"): ["a", "b"]}
    assert {(r.branch, r.error) for r in errors.collect()} == {("x", "redaction barrier"), ("w", "fork point missing"), ("v", "malformed"), ("u", "malformed")}


def test_merges_commute(spark):
    rnd = random.Random(1)
    schema = "artifact_id long, pos long, type string, role string, content string, ts_nanos long"
    pick = lambda: [(1, i, "turn", rnd.choice(["user", "assistant"]), rnd.choice("abc"), rnd.randint(1, 6)) for i in range(12)]
    a, b = spark.createDataFrame(pick(), schema), spark.createDataFrame(pick(), schema)
    keys = lambda df: [r.key for r in df.orderBy("place").collect()]
    assert keys(merge.union_merge(a, b)) == keys(merge.union_merge(b, a)) and keys(merge.union_merge(a, a)) == keys(merge.union_merge(a, a.limit(0)))


def test_sequence_functions(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d"]), (["a"], ["a", "b"]), (["a", "b"], ["a", "b"]), (["a", "b", "c"], ["a", "c"]), ([], ["x"])], "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    got = df.select(merge.relation(a, b), merge.common_prefix_len(a, b), merge.is_subsequence(b, a), merge.suffix_prefix_overlap(a, b), merge.append_decision(a, b)["action"], merge.sublist_at(b, a)).collect()
    assert [tuple(r) for r in got] == [
        ("diverged", 0, False, 2, "overlap", -1), ("extends", 1, False, 0, "prefix", -1), ("equal", 2, True, 2, "noop", 0), ("diverged", 1, True, 0, "stale", -1), ("extends", 0, False, 0, "prefix", -1),
    ]
    assert merge._supersequence(list("abcbdab"), list("bdcaba")) == merge._supersequence(list("abcbdab"), list("bdcaba")) and len(merge._supersequence(list("abcbdab"), list("bdcaba"))) == 9


def test_lines_append_and_strip(spark):
    base = spark.createDataFrame([(1, "one\ntwo"), (2, "same\n"), (3, "")], "artifact_id long, text string")
    extra = spark.createDataFrame([(1, 0, " two \nthree  \n\nthree"), (2, 0, "same"), (3, 0, "x\ny")], "artifact_id long, n int, text string")
    made = {r.artifact_id: r.text for r in merge.appended_lines(base, extra).collect()}
    assert made == {1: "one\ntwo\nthree\n", 2: "same\n", 3: "x\ny\n"}


def test_rules_document():
    text = '[[rule]]\nname = "a"\n[rule.match]\ntag = ["x"]\n[rule.route]\nagents = ["*", "!b"]\n'
    assert rules.parse_rules(text)[0].agents == ("*", "!b")
    for bad in ('[[rule]]\nname = "a"\nbogus = 1', '[[rule]]\nname = "a"\n[[rule]]\nname = "a"', '[[rule]]\nname = "a"\n[rule.route]\nagents = ["b", "!b"]', '[[rule]]\nname = "a"\n[rule.match]\nsize = 3', "x = 1"):
        with pytest.raises(ValueError):
            rules.parse_rules(bad)


def test_rule_decisions(spark):
    columns = "artifact_id long, tags array<string>, type string, tool_kind string, tool_capabilities array<string>, scope_kind string, project_id string, project_ephemeral boolean, namespace string, origin_agent string, origin_device string, branch_name string, native_path string"
    rows = [(1, ["private"], "tool", "mcp", ["net"], "project", "p/1", False, None, "a1", None, "main", "/x/y.md"), (2, [], "memory", None, None, "global", "", None, None, None, None, "feature-1", None)]
    df = spark.createDataFrame(rows, columns)
    made = rules.decide(
        df,
        [
            rules.Rule("net", {"toolCapability": ["net"], "scope": {"kind": ["project"], "project": {"id": ["p/*"]}}}, ("a*",), mode="scheduled", include_secrets=True, depth={"a1": 3}),
            rules.Rule("deny", {"tag": ["priv*", "none"]}, ("!a2",), mode="manual", include_secrets=False, depth={"a1": 5}),
            rules.Rule("branch", {"branchName": "^feature", "path": "/x/*", "kind": "any"}, (rules.ORIGIN,)),
            rules.Rule("off", enabled=False),
        ],
        ["a1", "a2", "b"],
    )
    one, two = made.orderBy("artifact_id").collect()
    assert (one.allowed_agents, one.denied_agents, one.mode, one.interval_seconds, one.include_secrets, one.historical_depth, one.matched_rules) == (["a1", "b"], ["a2"], "scheduled", 900, False, {"a1": 5}, ["net", "deny", "branch"])
    assert (two.allowed_agents, two.mode, two.matched_rules) == ([], "live", ["branch"])


def test_configs_round_trip(spark):
    files = [("j", "json", '{"mcpServers": {"s": {"command": "c", "env": {"A": "1", "N": 2}}}}'), ("c", "jsonc", '{// note\n"mcp": {"s": {"type": "x", "environment": {"A": "//no"},},}}'), ("t", "toml", '[mcp_servers.s]\ncommand = "c"\n[mcp_servers.s.env]\nA = "1"\n'), ("bad", "json", "{"), ("none", "json", "{}")]
    rows = configs.config_servers(spark.createDataFrame(files, "path string, kind string, content string")).cache()
    got = {r.path: (r.server, r.env, r.env_other, r.other) for r in rows.collect()}
    assert got == {"j": ("s", {"A": "1"}, '{"N": 2}', '{"command": "c"}'), "c": ("s", {"A": "//no"}, "{}", '{"type": "x"}'), "t": ("s", {"A": "1"}, "{}", '{"command": "c"}'), "bad": (None,) * 4}
    for kind in ("json", "toml", "nested", "jsonc"):
        again = configs.config_servers(configs.config_files(rows, kind).select("path", F.lit(kind).alias("kind"), "content"))
        assert {r.path: (r.env, json.loads(r.env_other), json.loads(r.other)) for r in again.collect()} == {p: (e, json.loads(x), json.loads(o)) for p, (s, e, x, o) in got.items() if s}


def test_json_redaction(spark):
    value = {"api_key": "x", "a": [{"Client-Secret": {"y": 1}}], "env": {"K": "v", "N": 1}, "headers": {"h": 1}, "keep": "ok"}
    row = spark.createDataFrame([(json.dumps(value),), ("no json",)], "j string").select(configs.redact_json(F.col("j")).alias("o")).collect()
    assert json.loads(row[0].o) == {"api_key": "", "a": [{"Client-Secret": ""}], "env": {"K": "", "N": 1}, "headers": {}, "keep": "ok"} and row[1].o is None


def test_documents(spark):
    skill = "---\nname: x\nallowed-tools: bash, read custom\n---\nbody\n"
    df = spark.createDataFrame([(skill,), ("no front",)], "c string")
    once = df.select(D.normalized_tools(F.col("c"), "kilo").alias("c"))
    assert once.first().c.split("\n")[2] == "allowed-tools: acf.exec, acf.read custom"
    assert [r.c for r in once.select(D.denormalized_tools(F.col("c"), "kilo").alias("c")).collect()] == [skill, "no front"]
    m = df.select(D.marked(F.col("c"), F.lit("id-1")).alias("c"))
    assert [tuple(r) for r in m.select(D.mark_of(F.col("c")), D.unmarked(F.col("c"))).collect()] == [("id-1", skill), ("id-1", "no front\n")]
    two = df.select(D.upserted_section(D.upserted_section(F.col("c"), "k", F.lit("T"), F.lit("old")), "k", F.lit("T"), F.lit("new")).alias("c"))
    assert all(r.c.count("## Project: T") == 1 and "new" in r.c and "old" not in r.c for r in two.collect())
    assert [r.c for r in two.select(D.without_sections(F.col("c")).alias("c")).collect()] == [skill, "no front\n"]


def test_resume_graph(spark):
    nodes = spark.createDataFrame(
        [
            ("s", 0, "a", None, True, "user", "1"), ("s", 1, "b", "a", False, None, None), ("s", 2, "c", "b", True, "assistant", "2"), ("s", 3, "d", "c", True, "user", "3"),
            ("f", 0, "a", None, True, "user", "1"), ("f", 1, "b", "a", True, "assistant", "2"), ("f", 2, "c", "a", True, "assistant", "3"),
            ("x", 0, "a", "b", True, "user", "1"), ("x", 1, "b", "a", True, "user", "2"), ("m", 0, "a", "gone", True, "user", "1"), ("d", 0, "a", None, True, "user", "1"), ("d", 1, "a", None, True, "user", "1"),
        ],
        "session_id string, line_no int, uuid string, parent string, conversational boolean, role string, text string",
    )
    prompts = spark.createDataFrame([("s", 9, "a"), ("f", 9, "b")], "session_id string, line_no int, leaf string")
    turns, flags = resume.visible_leaf(nodes, prompts)
    got = {}
    for r in turns.orderBy("pos").collect():
        got.setdefault(r.session_id, []).append(r.text)
    assert got == {"s": ["1", "2", "3"], "f": ["1", "2"]}
    f = {r.session_id: r for r in flags.collect()}
    assert f["s"].leaf_advanced and not f["s"].forked and f["f"].forked and f["x"].cycle and f["m"].missing_parent and f["d"].duplicate_uuid


def test_retention_and_catalog(spark):
    events = spark.createDataFrame([(1, 0, "h0", "", "create", 10), (1, 1, "h1", "h0", "update", 10), (1, 2, "h2", "h1", "snapshot", 10), (1, 3, "h3", "h2", "update", 10)], "artifact_id long, seq long, hash string, parent_hash string, type string, bytes long")
    arts = spark.createDataFrame([(1, [])], "artifact_id long, tags array<string>")
    tips = spark.createDataFrame([(1, "h0")], "artifact_id long, hash string")
    assert [r.hash for r in retention.prune_plan(events, arts, tips).collect()] == ["h1"]
    assert retention.prune_plan(events, spark.createDataFrame([(1, ["pinned"])], "artifact_id long, tags array<string>")).count() == 0
    acks = spark.createDataFrame([(1, False)], "artifact_id long, acked boolean")
    assert {r.state for r in retention.prune_gate(retention.prune_plan(events, arts), acks).collect()} == {"blocked"}
    paths = spark.createDataFrame([("/a/b/c",), ("/x",)], "path string")
    roots = spark.createDataFrame([("/a", "one"), ("/a/b/", "two"), ("/ab", "no")], "root string, agent string")
    assert {r.path: r.agents for r in catalog.path_owners(paths, roots).collect()} == {"/a/b/c": ["one", "two"], "/x": []}


def test_streams(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", "h1"), ("a", "2024-01-01 00:00:00.2", "h2"), ("b", "2024-01-01 00:00:00", "h3")]
    late = [("z", "2024-01-01 01:00:00", "h9"), ("z", "2024-01-01 01:00:10", "h9")]
    schema = "path string, ts timestamp, content_hash string"
    made = lambda rs: spark.createDataFrame(rs, "path string, t string, content_hash string").selectExpr("path", "cast(t as timestamp) ts", "content_hash")
    src = str(tmp_path / "in")
    made(rows).coalesce(1).write.mode("append").parquet(src)
    made(late).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = []
    q = settle.commit_stream(settle.debounce_stream(stream), str(tmp_path / "ck"), lambda df, _: got.extend(df.collect()))
    q.processAllAvailable()
    q.stop()
    assert {(r.path, r.n_changes, r.content_hash) for r in got} >= {("a", 2, "h2"), ("b", 1, "h3")}
    ok = [("n", f"2024-01-01 00:0{i}:00", i == 2) for i in range(7)]
    src = str(tmp_path / "in2")
    spark.createDataFrame(ok, "name string, t string, ok boolean").selectExpr("name", "cast(t as timestamp) ts", "ok").coalesce(1).write.parquet(src)
    out = []
    stream = spark.readStream.schema("name string, ts timestamp, ok boolean").parquet(src)
    q = settle.quarantine_stream(stream).writeStream.option("checkpointLocation", str(tmp_path / "ck2")).foreachBatch(lambda df, _: out.extend(df.collect())).start()
    q.processAllAvailable()
    q.stop()
    assert [r.ts.minute for r in sorted(out, key=lambda r: r.ts)] == [5, 6]
