"""Column functions over instruction and skill documents: sections, markers, tool tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinlog.functions.text import trim_space

# Tokens of allowed tools by agent, canonical to native.
TOOL_PREFIX = "acf."
DIALECTS = {
    "claude-code": {
        "acf.exec": "Bash", "acf.read": "Read", "acf.write": "Write", "acf.edit": "Edit", "acf.grep": "Grep", "acf.glob": "Glob",
        "acf.web-search": "WebSearch", "acf.web-fetch": "WebFetch", "acf.todo": "TodoWrite", "acf.task": "Task",
    },
    "codex": {"acf.exec": "exec_command", "acf.edit": "apply_patch", "acf.web-search": "web_search"},
    "kilo": {"acf.exec": "bash", "acf.read": "read", "acf.write": "write", "acf.edit": "apply_patch", "acf.grep": "grep", "acf.todo": "todowrite", "acf.task": "task"},
    "hermes": {"acf.exec": "exec_command", "acf.read": "read", "acf.write": "write", "acf.edit": "apply_patch", "acf.web-search": "web_search"},
    "openclaw": {},
}


def _mapped_tools(content: Column, mapping: dict[str, str]) -> Column:
    """``allowed-tools`` of the front matter with mapped tokens; other documents stay as they are."""
    front = F.regexp_extract(content, r"(?s)^---\n(.*?\n)?---(?:\n|$)", 1)
    keys = F.filter(F.split(front, "\n"), lambda line: F.startswith(line, F.lit("allowed-tools:")))
    line = F.get(keys, F.lit(0))
    raw = F.substr(line, F.lit(len("allowed-tools:") + 1))
    plain = ~F.rlike(F.trim(raw), F.lit(r"^$|#|^[\[\"']"))
    made = reduce(lambda t, kv: F.regexp_replace(t, r"(?<![\w.\-])\Q" + kv[0] + r"\E(?![\w.\-])", kv[1]), mapping.items(), raw)
    swapped = F.replace(content, F.concat(F.lit("\n"), line, F.lit("\n")), F.concat(F.lit("\nallowed-tools:"), made, F.lit("\n")))
    return F.when((F.size(keys) == 1) & plain, swapped).otherwise(content)


def normalized_tools(content: Column, dialect: str) -> Column:
    """Native tool tokens to canonical ones; unknown tokens stay."""
    return _mapped_tools(content, {n: c for c, n in DIALECTS[dialect].items()})


def denormalized_tools(content: Column, dialect: str) -> Column:
    return _mapped_tools(content, DIALECTS[dialect])


def marked(content: Column, artifact_id: Column, own: str = "skein") -> Column:
    """A skill document with its id in a closing comment."""
    return F.concat(F.regexp_replace(content, r"\n+$", ""), F.lit(f"\n\n<!-- {own}:skill:"), artifact_id, F.lit(" -->\n"))


def mark_of(content: Column, own: str = "skein") -> Column:
    """The id in a document's closing comment; null if there is none."""
    return F.nullif(F.regexp_extract(content, rf"(?s)^.*<!-- {own}:skill:\s*([^\n]*?)\s* -->\s*$", 1), F.lit(""))


def unmarked(content: Column, own: str = "skein") -> Column:
    return F.when(mark_of(content, own).isNull(), content).otherwise(F.concat(F.regexp_replace(F.regexp_replace(content, rf"<!-- {own}:skill:[^\n]*? -->\s*$", ""), r"\n+$", ""), F.lit("\n")))


def skill_dir(source_path: Column, name: Column) -> Column:
    """Folder of a skill: its parent folder if that says something, else its name, else ``skill``."""
    parts = F.split(F.coalesce(source_path, F.lit("")), "/")
    parent = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), r"\.md$", "")
    return F.when((parent != "") & (parent != "skills") & ~F.startswith(parent, F.lit(".")), parent).when((bare != "") & (bare != "SKILL"), bare).otherwise(F.lit("skill"))


def _section(key: str, own: str) -> str:
    return rf"(?s)<!-- {own}:project-memory:{key} -->\n.*?<!-- /{own}:project-memory:[^ ]+ -->\n?"


def upserted_section(existing: Column, key: str, title: Column, content: Column, own: str = "skein") -> Column:
    """A document with the project's section put in place of the old one, or at the end."""
    body = F.regexp_replace(content, r"\n+$", "")
    block = F.concat(F.lit(f"<!-- {own}:project-memory:{key} -->\n## Project: "), title, F.lit("\n\n"), body, F.lit(f"\n<!-- /{own}:project-memory:{key} -->\n"))
    old = F.regexp_extract(existing, r"\Q\E(" + _section(r"\Q" + key + r"\E", own) + ")", 1)
    base = F.when(F.endswith(existing, F.lit("\n")), existing).otherwise(F.concat(existing, F.lit("\n")))
    return F.when(old != "", F.replace(existing, old, block)).when(trim_space(existing) == "", block).otherwise(F.concat(base, F.lit("\n"), block))


def without_sections(content: Column, own: str = "skein") -> Column:
    """A document without project sections; blank runs shrink to one line."""
    out = F.regexp_replace(F.regexp_replace(content, _section("[^ ]+", own), ""), r"\n{3,}", "\n\n")
    bare = F.regexp_replace(out, r"\n+$", "")
    return F.when(trim_space(out) == "", bare).otherwise(F.concat(bare, F.lit("\n")))


def split_env(server: Column) -> Column:
    """A server's string map in two: ``env`` (keys under ``env.``) and ``other``."""
    env = F.transform_keys(F.map_filter(server, lambda k, _: F.startswith(k, F.lit("env."))), lambda k, _: F.substr(k, F.lit(5)))
    return F.struct(env.alias("env"), F.map_filter(server, lambda k, _: ~F.startswith(k, F.lit("env."))).alias("other"))


def merge_env(env: Column, other: Column) -> Column:
    return F.map_concat(other, F.transform_keys(env, lambda k, _: F.concat(F.lit("env."), k)))
