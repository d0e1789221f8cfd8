"""Tool-server configurations: JSON, commented JSON, TOML and YAML files to rows and back.

Formats that Spark has no functions for are parsed by Arrow-batched Python, a
file a row.  YAML needs an optional library; without it YAML rows give null.
"""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

try:
    import yaml
except ImportError:  # an optional format
    yaml = None

#: Where each format keeps its servers, and the keys of a server's environment.
LAYOUT = {"json": ("mcpServers", "env"), "jsonc": ("mcp", "environment"), "nested": ("mcp.servers", "env"), "toml": ("mcp_servers", "env"), "yaml": ("mcp_servers", "env")}


def without_comments(text: str) -> str:
    """JSON text without // and /* */ comments and trailing commas, strings left alone."""
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if c == '"':
            j = i + 1
            while j < n and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            out.append(text[i : j + 1])
            i = j + 1
        elif text.startswith("//", i):
            end = text.find("\n", i)
            i = n if end < 0 else end
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = n if end < 0 else end + 2
        elif c == "," and text[i + 1 :].lstrip()[:1] in ("}", "]"):
            i += 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def load_config(kind: str, text: str) -> dict:
    if kind == "toml":
        return tomllib.loads(text)
    if kind == "yaml":
        if yaml is None:
            raise ValueError("no YAML library")
        return yaml.safe_load(text) or {}
    return json.loads(without_comments(text) if kind == "jsonc" else text)


def servers_of(kind: str, text: str) -> list[tuple[str, dict, dict, dict]]:
    """(name, string environment, other environment, other settings) of a file's servers."""
    where, env_key = LAYOUT[kind]
    found = load_config(kind, text)
    for part in where.split("."):
        found = found.get(part, {})
    out = []
    for name, server in sorted(found.items()):
        if isinstance(server, dict):
            env = server.get(env_key) if isinstance(server.get(env_key), dict) else {}
            plain = {k: v for k, v in env.items() if isinstance(v, str)}
            out.append((name, plain, {k: v for k, v in env.items() if k not in plain}, {k: v for k, v in server.items() if k != env_key}))
    return out


def config_servers(files: DataFrame) -> DataFrame:
    """``path, kind, content`` rows to ``path, kind, server, env, env_other, other`` (the last two JSON); broken files give one row with null server."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("server", pa.string()), ("env", pa.map_(pa.string(), pa.string())), ("env_other", pa.string()), ("other", pa.string())])
        for batch in batches:
            rows = []
            for path, kind, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                try:
                    made = servers_of(kind, content or "")
                    rows += [(path, kind, n, list(e.items()), json.dumps(x, sort_keys=True), json.dumps(o, sort_keys=True)) for n, e, x, o in made]
                except (ValueError, AttributeError, KeyError):
                    rows.append((path, kind, None, None, None, None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return files.select("path", "kind", "content").mapInArrow(run, "path string, kind string, server string, env map<string,string>, env_other string, other string")


def _toml(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return "[" + ", ".join(_toml(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{json.dumps(k)} = {_toml(v)}" for k, v in sorted(value.items())) + "}"
    return json.dumps(value)


def write_config(kind: str, servers: dict[str, dict]) -> str:
    """A file of ``kind`` with these servers (environment merged)."""
    where, _ = LAYOUT[kind]
    if kind == "toml":
        lines = []
        for name, server in sorted(servers.items()):
            lines.append(f"[{where}.{json.dumps(name)}]")
            lines += [f"{json.dumps(k)} = {_toml(v)}" for k, v in sorted(server.items())]
        return "\n".join(lines) + "\n"
    nested: dict = servers
    for part in reversed(where.split(".")):
        nested = {part: nested}
    if kind == "yaml":
        if yaml is None:
            raise ValueError("no YAML library")
        return yaml.safe_dump(nested, sort_keys=True)
    return json.dumps(nested, sort_keys=True)


def config_files(servers: DataFrame, kind: str) -> DataFrame:
    """Rows of ``config_servers`` to one file of ``kind`` per path."""
    env_key = LAYOUT[kind][1]
    grouped = servers.where("server is not null").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("server", F.map_entries("env").alias("env"), "env_other", "other"))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows in batch.column(1).to_pylist():
                made = {}
                for r in rows:
                    env = {e["key"]: e["value"] for e in r["env"] or []} | json.loads(r["env_other"] or "{}")
                    made[r["server"]] = json.loads(r["other"] or "{}") | ({env_key: env} if env else {})
                out.append(write_config(kind, made))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["path", "content"])

    return grouped.mapInArrow(run, "path string, content string")


# redaction of JSON documents

#: Names of secret fields and of containers that are emptied, without separators.
SECRET_KEYS = frozenset(
    "token authtoken bottoken accesstoken refreshtoken sessiontoken idtoken bearer bearertoken apikey secret secretkey clientsecret password passphrase privatekey signingkey webhooksecret accesskey accesskeyid secretaccesskey authorization proxyauthorization cookie setcookie".split()
)
SECRET_CONTAINERS = frozenset(["headers", "credentials", "credential"])


def redacted(value: object) -> object:
    """A JSON value with secret fields emptied, at any depth; environments lose their strings."""
    if isinstance(value, list):
        return [redacted(v) for v in value]
    if not isinstance(value, dict):
        return value
    out = {}
    for key, child in value.items():
        name = key.lower().translate({ord(c): None for c in "-_. "})
        if name in SECRET_KEYS:
            out[key] = ""
        elif name in SECRET_CONTAINERS:
            out[key] = {}
        elif name == "env":
            out[key] = {k: v if v is None or isinstance(v, bool | int | float) else "" for k, v in child.items()} if isinstance(child, dict) else {}
        else:
            out[key] = redacted(child)
    return out


def _text_udf(f: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.pandas_udf(StringType())
    def apply(column):
        return column.map(lambda v: None if v is None else f(v))

    return apply


def redact_json(column: Column) -> Column:
    """JSON text with secrets emptied; text that is no JSON gives null."""

    def one(text: str):
        try:
            return json.dumps(redacted(json.loads(text)), ensure_ascii=False, sort_keys=True)
        except ValueError:
            return None

    return _text_udf(one)(column)


def canonical_json(column: Column) -> Column:
    """JSON text with sorted keys, no spaces and numbers as written, so that equal structures are equal strings."""

    class Number(str):
        pass

    def emit(v) -> str:
        if isinstance(v, Number):
            return str(v)
        if isinstance(v, dict):
            return "{" + ",".join(json.dumps(k) + ":" + emit(v[k]) for k in sorted(v)) + "}"
        if isinstance(v, list):
            return "[" + ",".join(map(emit, v)) + "]"
        return json.dumps(v)

    def one(text: str):
        try:
            return emit(json.loads(text, parse_float=Number, parse_int=Number))
        except ValueError:
            return None

    return _text_udf(one)(column)
