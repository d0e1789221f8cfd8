"""Queries over catalog lists, filters and joins of artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlog.functions import documents as D
from skeinlog.functions import text as X
from skeinlog.operators import catalog as K
from skeinlog.plans.catalogs import _DOCS, _docs
from skeinlog.plans.model import artifacts, conv_events, log_events
from skeinlog.plans.registry import query
from skeinlog.session import load_table


@query(
    "catalog_listed",
    f"WITH {_DOCS}, f AS (SELECT artifact_id, agent AS origin_agent, 'd' || (artifact_id % 3) AS origin_device FROM d WHERE artifact_id % 5 <> 0) SELECT d.artifact_id, kind, scope, origin_agent, origin_device FROM d LEFT JOIN f ON d.artifact_id = f.artifact_id WHERE kind = 'memory' AND scope = 'project' AND origin_agent = 'src1'",
)
def catalog_listed(spark, sf_dir):
    """Memories of projects that src1 began; a fifth of the artifacts has no first event."""
    d = _docs(spark, sf_dir)
    first = d.where("artifact_id % 5 <> 0").select("artifact_id", F.col("agent").alias("source_agent"), F.concat(F.lit("d"), (F.col("artifact_id") % 3).cast("string")).alias("device_id"))
    return K.listed(d, first, "memory", "project", "src1").select("artifact_id", "kind", "scope", "origin_agent", "origin_device")


_TAGGED = """e AS (SELECT event_id, user_id AS artifact_id, CASE WHEN event_id % 4 = 0 THEN [event_type, 'own'] END AS et, CASE WHEN event_id % 3 = 0 THEN [event_type, 'u' || (user_id % 5)] END AS st FROM events),
g AS (SELECT event_id, artifact_id, list_sort(list_distinct(coalesce(et, []) || coalesce(st, []))) AS tags FROM e)"""


def _logged(spark, sf_dir, tag):
    e = log_events(spark, sf_dir)
    hashed = F.col("event_id").cast("string").alias("hash")
    own = F.when(F.col("event_id") % 4 == 0, F.array("type", F.lit("own")))
    side = e.where("event_id % 3 = 0").select(hashed, F.array("type", F.concat(F.lit("u"), (F.col("artifact_id") % 5).cast("string"))).alias("tags"))
    found = K.logged(e.select("event_id", "artifact_id", hashed, own.alias("event_tags")), side, tag)
    return found.select("event_id", "artifact_id", F.array_join(F.array_sort("all_tags"), ",").alias("tags"))


@query("log_with_tags", f"WITH {_TAGGED} SELECT event_id, artifact_id, array_to_string(tags, ',') AS tags FROM g")
def log_with_tags(spark, sf_dir):
    return _logged(spark, sf_dir, "")


@query("log_by_tag", f"WITH {_TAGGED} SELECT event_id, artifact_id, array_to_string(tags, ',') AS tags FROM g WHERE list_contains(tags, 'u3')")
def log_by_tag(spark, sf_dir):
    return _logged(spark, sf_dir, "u3")


@query(
    "native_id_lookup",
    """WITH d AS (SELECT doc_id AS artifact_id, CASE doc_id % 3 WHEN 0 THEN 'tool' WHEN 1 THEN 'skill' ELSE 'memory' END AS kind, 'note-' || (doc_id % 7) || '.md' AS name, '/n/' || source || '/item' || doc_id || '.json' AS source_path FROM documents)
SELECT artifact_id, kind, name FROM d WHERE name = 'note-4.md' ORDER BY CASE kind WHEN 'memory' THEN 1 WHEN 'skill' THEN 2 ELSE 3 END, artifact_id LIMIT 1""",
)
def native_id_lookup(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 3 == 0, "tool").when(F.col("doc_id") % 3 == 1, "skill").otherwise("memory")
    d = load_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("artifact_id"), kind.alias("kind"), F.concat(F.lit("note-"), (F.col("doc_id") % 7).cast("string"), F.lit(".md")).alias("name"), F.concat(F.lit("/n/"), "source", F.lit("/item"), F.col("doc_id").cast("string"), F.lit(".json")).alias("source_path")
    )
    return K.by_native_id(d, "note-4").select("artifact_id", "kind", "name")


@query("native_path_lookup", "SELECT doc_id AS artifact_id, source FROM documents WHERE doc_id = 17")
def native_path_lookup(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("artifact_id"), "source", F.lit("memory").alias("kind"), F.lit("x").alias("name"), F.concat(F.lit("/n/item"), F.col("doc_id").cast("string"), F.lit(".json")).alias("source_path"))
    return K.by_native_id(d, "item17").select("artifact_id", "source")


@query("excluded_paths", f"WITH {_DOCS} SELECT artifact_id, starts_with(path, '/home/src1/') OR agent = 'src3' AS excluded FROM d")
def excluded_paths(spark, sf_dir):
    return _docs(spark, sf_dir).select("artifact_id", K.excluded_path(F.col("path"), ["/home/src1/", "/elsewhere"], ["src3"]).alias("excluded"))


@query("orphan_records", "SELECT doc_id AS artifact_id, source AS agent, 'day' || (doc_id % 28) AS since FROM documents WHERE doc_id % 6 = 0 UNION ALL SELECT doc_id, 'other', 'long ago' FROM documents WHERE doc_id % 12 = 0")
def orphan_records(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents")
    one = F.create_map(F.col("source"), F.concat(F.lit("day"), (F.col("doc_id") % 28).cast("string")))
    both = F.map_concat(one, F.create_map(F.lit("other"), F.lit("long ago")))
    held = F.when(F.col("doc_id") % 12 == 0, both).when(F.col("doc_id") % 6 == 0, one).otherwise(F.create_map().cast("map<string,string>"))
    return K.orphans(d.select(F.col("doc_id").alias("artifact_id"), held.alias("orphaned_by_agent")))


@query("branch_counts", "SELECT doc_id AS artifact_id, (CASE WHEN doc_id % 4 = 0 THEN 1 WHEN doc_id % 4 = 1 THEN 2 WHEN doc_id % 4 = 2 THEN 1 ELSE 3 END)::INTEGER AS branches FROM documents")
def branch_counts(spark, sf_dir):
    """No heads, one side branch, an unnamed head (main), and two side branches beside main."""
    d = load_table(spark, sf_dir, "documents")
    r = F.col("doc_id") % 4
    heads = F.when(r == 1, F.create_map(F.lit("x"), F.lit("h"))).when(r == 2, F.create_map(F.lit(""), F.lit("h"))).when(r == 3, F.create_map(F.lit("x"), F.lit("h"), F.lit("main"), F.lit("h"), F.lit("y"), F.lit("h")))
    return d.select(F.col("doc_id").alias("artifact_id"), heads.alias("branch_heads")).select("artifact_id", K.branch_count().alias("branches"))


@query("tag_list", "SELECT DISTINCT unnest(list_filter([lang, CASE WHEN quality = 1 THEN 'pinned' END, CASE WHEN toxic = 1 THEN 'private' END], lambda x: x IS NOT NULL)) AS tag FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def tag_list(spark, sf_dir):
    return K.tag_list(artifacts(spark, sf_dir))


@query("path_owner_sets", f"WITH {_DOCS} SELECT path, CASE agent WHEN 'src1' THEN 'all,first,one' WHEN 'src2' THEN 'all,two' ELSE 'all' END AS agents FROM d")
def path_owner_sets(spark, sf_dir):
    roots = spark.createDataFrame([("/home", "all"), ("/home/src1/", "one"), ("/home/src1", "first"), ("/home/src2//", "two"), ("/home/src", "none")], "root string, agent string")
    return K.path_owners(_docs(spark, sf_dir).select("path"), roots).select("path", F.array_join("agents", ",").alias("agents"))


@query("unregistered_folders", f"WITH {_DOCS} SELECT path FROM d WHERE artifact_id % 3 <> 0")
def unregistered_folders(spark, sf_dir):
    """A third of the folders is registered in capitals, twice."""
    folders = _docs(spark, sf_dir).select("artifact_id", "path")
    known = folders.where("artifact_id % 3 = 0").select(F.upper("path").alias("path"))
    return K.unregistered(folders.select("path"), known.unionByName(known))


@query(
    "folder_suggestions",
    f"WITH {_DOCS} SELECT path, project_id, CASE WHEN artifact_id % 40 < 10 THEN 'name of ' || project_id WHEN artifact_id % 7 = 0 THEN 'path ' || artifact_id END AS name FROM d",
)
def folder_suggestions(spark, sf_dir):
    """A quarter of the projects is named; a seventh of the folders is named by path, some of them twice."""
    d = _docs(spark, sf_dir)
    projects = d.where("artifact_id % 40 < 10").select("project_id", F.lit("/none").alias("path"), F.concat(F.lit("name of "), "project_id").alias("name"))
    paths = d.where("artifact_id % 7 = 0").select(F.lit(None).cast("string").alias("project_id"), F.upper("path").alias("path"), F.concat(F.lit("path "), F.col("artifact_id").cast("string")).alias("name"))
    registry = projects.unionByName(paths).unionByName(paths.withColumn("name", F.concat("name", F.lit(" again"))))
    return K.suggestions(d.select("path", "project_id"), registry)


@query(
    "denied_projects",
    f"""WITH {_DOCS}, p AS (SELECT project_id, count(*) AS count, min(path) AS sample_path FROM d WHERE project_id NOT IN ('p1', 'p2') GROUP BY 1), x(project_id, path) AS (VALUES ('p1', '/one'), ('p5', '/five'), ('p77', '/far'))
SELECT coalesce(p.project_id, x.project_id) AS project_id, coalesce(count, 0) AS count, coalesce(sample_path, path) AS sample_path, x.project_id IS NOT NULL AS denied FROM p FULL JOIN x ON p.project_id = x.project_id""",
)
def denied_projects(spark, sf_dir):
    registered = spark.createDataFrame([("p1",), ("p2",)], "project_id string")
    denied = spark.createDataFrame([("p1", "/one"), ("p5", "/five"), ("p77", "/far")], "project_id string, path string")
    return K.apply_denied(K.pending_projects(_docs(spark, sf_dir), registered), denied)


@query(
    "paired_calls",
    """SELECT c.conv_id AS artifact_id, (c.conv_id || ':' || c.turn // 3) AS call_id, c.turn AS call_pos, c.role AS tool_name, r.turn AS result_pos, r.role = 'system' AS is_error, md5(r.text) AS result
FROM conversations c LEFT JOIN conversations r ON c.conv_id = r.conv_id AND r.turn % 3 = 2 AND c.turn // 3 = r.turn // 3 WHERE c.turn % 3 = 1""",
)
def paired_calls(spark, sf_dir):
    """Every second turn of three stands for a call, the third for its result."""
    t = conv_events(spark, sf_dir)
    kind = F.when(F.col("pos") % 3 == 1, "tool_call").when(F.col("pos") % 3 == 2, "tool_result").otherwise("turn")
    e = t.select("artifact_id", "pos", kind.alias("type"), F.concat_ws(":", F.col("artifact_id").cast("string"), F.floor(F.col("pos") / 3).cast("string")).alias("call_id"), F.col("role").alias("tool_name"), F.lit("{}").alias("input"), (F.col("role") == "system").alias("is_error"), "text")
    return K.paired_calls(e).select("artifact_id", "call_id", "call_pos", "tool_name", "result_pos", "is_error", F.md5("result").alias("result"))


@query(
    "append_admitted",
    "WITH e AS (SELECT user_id AS artifact_id, event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'h' || (event_id % 10) END AS parent FROM events), h AS (SELECT DISTINCT user_id AS artifact_id, 'h' || (user_id % 10) AS head FROM events WHERE user_id % 4 <> 0) SELECT e.artifact_id, event_id FROM e LEFT JOIN h ON e.artifact_id = h.artifact_id WHERE parent = coalesce(head, '')",
)
def append_admitted(spark, sf_dir):
    """Events whose parent is their log's head; a quarter of the logs has none yet."""
    e = log_events(spark, sf_dir)
    parent = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("h"), (F.col("event_id") % 10).cast("string")))
    heads = e.where("artifact_id % 4 <> 0").select("artifact_id", F.concat(F.lit("h"), (F.col("artifact_id") % 10).cast("string")).alias("hash")).distinct()
    return K.appended(e.select("artifact_id", "event_id", parent.alias("parent_hash")), heads).select("artifact_id", "event_id")


@query(
    "tag_names",
    r"""WITH t AS (SELECT doc_id, ' ' || split_part(coalesce(text, ''), ' ', 1) || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ':X' ELSE ' y' END AS raw FROM documents), n AS (SELECT doc_id, raw, lower(regexp_replace(raw, '^\s+|\s+$', '', 'g')) AS tag FROM t)
SELECT doc_id, CASE WHEN length(tag) <= 64 AND regexp_full_match(tag, '[a-z0-9:\-_./]*') THEN tag END AS tag FROM n""",
)
def tag_names(spark, sf_dir):
    """First words of texts as tags, some with a character that tags can't have."""
    d = load_table(spark, sf_dir, "documents")
    word = F.element_at(F.split(F.coalesce("text", F.lit("")), " "), 1)
    raw = F.concat(F.lit(" "), word, F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, ":X").otherwise(" y"))
    return d.select("doc_id", X.normalized_tag(raw).alias("tag"))


@query("reserved_tags", "SELECT doc_id, doc_id % 5 <> 4 AS reserved FROM documents")
def reserved_tags(spark, sf_dir):
    r = F.col("doc_id") % 5
    tag = F.concat(F.when(r == 0, "fork-of:").when(r == 1, "device:").when(r == 2, "conflict:").when(r == 3, "system:").otherwise("devices:"), F.col("source"))
    return load_table(spark, sf_dir, "documents").select("doc_id", X.is_reserved_tag(tag).alias("reserved"))


@query("env_split", "SELECT doc_id, 'HOME=' || source || CASE WHEN doc_id % 2 = 0 THEN ',X=1' ELSE '' END AS env, 'command=' || lang AS other, (CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END)::INTEGER AS n_keys FROM documents WHERE lang IS NOT NULL")
def env_split(spark, sf_dir):
    """A server's map split into environment and the rest, and put together again."""
    d = load_table(spark, sf_dir, "documents").where("lang is not null")
    base = F.create_map(F.lit("command"), F.col("lang"), F.lit("env.HOME"), F.col("source"))
    server = F.when(F.col("doc_id") % 2 == 0, F.map_concat(base, F.create_map(F.lit("env.X"), F.lit("1")))).otherwise(base)
    made = d.select("doc_id", D.split_env(server).alias("s"))
    shown = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return made.select("doc_id", shown(F.col("s.env")).alias("env"), shown(F.col("s.other")).alias("other"), F.size(D.merge_env(F.col("s.env"), F.col("s.other"))).alias("n_keys"))


@query("glob_matches", r"""WITH p AS (SELECT doc_id, source || '/' || coalesce(lang, 'xx') || '/n' || doc_id || '.md' AS p FROM documents) SELECT doc_id, regexp_full_match(p, 'src[^/]*/en/n[^/]*\.md') AS star, regexp_full_match(p, 'src[^/]/f[^/]/n[0-4][^/]*') AS one, regexp_full_match(p, '[^/]*\.md') AS flat FROM p""")
def glob_matches(spark, sf_dir):
    path = F.concat("source", F.lit("/"), F.coalesce("lang", F.lit("xx")), F.lit("/n"), F.col("doc_id").cast("string"), F.lit(".md"))
    return load_table(spark, sf_dir, "documents").select("doc_id", X.glob_match("src*/en/n*.md", path).alias("star"), X.glob_match("src?/f?/n[0-4]*", path).alias("one"), X.glob_match("*.md", path).alias("flat"))


@query("stable_ids", "WITH h AS (SELECT doc_id, sha256(source || ':' || doc_id) AS h FROM documents), v AS (SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h) SELECT doc_id, uuid, false AS ordered FROM v")
def stable_ids(spark, sf_dir):
    made = load_table(spark, sf_dir, "documents").select("doc_id", X.deterministic_uuid(F.concat_ws(":", "source", F.col("doc_id").cast("string"))).alias("uuid"))
    return made.withColumn("ordered", X.is_uuid7(F.col("uuid")))


@query("skill_marks", r"SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '\n+$', '') || chr(10) || chr(10) || '<!-- skein:skill:a' || doc_id || ' -->' || chr(10)) AS marked, 'a' || doc_id AS id, md5(regexp_replace(coalesce(text, ''), '\n+$', '') || chr(10)) AS bare FROM documents")
def skill_marks(spark, sf_dir):
    """Documents with their id in a closing comment, read back and taken off."""
    m = load_table(spark, sf_dir, "documents").select("doc_id", D.marked(F.coalesce("text", F.lit("")), F.concat(F.lit("a"), F.col("doc_id").cast("string"))).alias("m"))
    return m.select("doc_id", F.md5("m").alias("marked"), D.mark_of(F.col("m")).alias("id"), F.md5(D.unmarked(F.col("m"))).alias("bare"))


@query("skill_folders", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN 'note' || doc_id WHEN 2 THEN 'skill' ELSE 'x' || doc_id END AS folder FROM documents")
def skill_folders(spark, sf_dir):
    d, r, n = load_table(spark, sf_dir, "documents"), F.col("doc_id") % 4, F.col("doc_id").cast("string")
    path = F.when(r == 0, F.concat(F.lit("/s/"), "source", F.lit("/SKILL.md"))).when(r == 1, "/s/skills/a.md").when(r == 2, "/s/.hidden/a.md")
    name = F.when(r == 1, F.concat(F.lit("note"), n, F.lit(".md"))).when(r == 3, F.concat(F.lit("x"), n)).otherwise("SKILL.md")
    return d.select("doc_id", D.skill_dir(path, name).alias("folder"))


@query("catalog_by_creation", "SELECT event_id AS artifact_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM events WHERE event_type = 'click'")
def catalog_by_creation(spark, sf_dir):
    e = load_table(spark, sf_dir, "events").select(F.col("event_id").alias("artifact_id"), F.col("event_type").alias("kind"), F.col("ts").alias("created_at"))
    return K.in_creation_order(e, "click").select("artifact_id", "place")


@query("bundle_bodies", "SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN upper(coalesce(lang, '')) WHEN 1 THEN 'skill:' || coalesce(text, '') ELSE coalesce(text, '') END) AS body FROM documents")
def bundle_bodies(spark, sf_dir):
    r = F.col("doc_id") % 3
    files = load_table(spark, sf_dir, "documents").select("doc_id", F.when(r == 0, "memory").when(r == 1, "skill").otherwise("tool").alias("kind"), F.coalesce("text", F.lit("")).alias("body"), "lang")
    return K.bundle_bodies(files, {"memory": F.upper(F.coalesce("lang", F.lit(""))), "skill": F.concat(F.lit("skill:"), "body")}).select("doc_id", F.md5("body").alias("body"))


@query(
    "project_sections",
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, '<!-- skein:project-memory:k -->' || chr(10) || '## Project: ' || source || chr(10) || chr(10) || 'about ' || doc_id || chr(10) || '<!-- /skein:project-memory:k -->' || chr(10) AS block FROM documents)
SELECT doc_id, md5(CASE WHEN regexp_replace(t, '\s+', '', 'g') = '' THEN block ELSE t || CASE WHEN suffix(t, chr(10)) THEN '' ELSE chr(10) END || chr(10) || block END) AS body FROM d""",
)
def project_sections(spark, sf_dir):
    """A section written twice: the second writing takes the first one's place."""
    d = load_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), "source")
    once = d.withColumn("t", D.upserted_section(F.col("t"), "k", F.lit("other"), F.lit("old text")))
    return once.select("doc_id", F.md5(D.upserted_section(F.col("t"), "k", F.col("source"), F.concat(F.lit("about "), F.col("doc_id").cast("string"), F.lit("\n\n")))).alias("body"))
