"""Routing rules: parse, validate, match, decide."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.functions.text import glob_match, is_reserved_tag

ORIGIN = "__originatingAgent__"
#: Default cadence of a scheduled rule in seconds, and mode ranks.
DEFAULT_INTERVAL = 900
MODE_RANK = {"manual": 1, "scheduled": 2, "live": 3}

_MATCH = {"kind", "tag", "type", "toolKind", "toolCapability", "scope", "agentSource", "deviceSource", "branchName", "path"}
_ROUTE = {"agents", "remote", "skillMode", "includeSecrets", "historicalSyncDepth"}
_TOP = {"name", "enabled", "match", "route", "assign", "mode", "intervalSeconds"}


@dataclass(frozen=True)
class Rule:
    """One rule; ``match`` holds the predicates, ``agents`` the patterns (``!x`` denies)."""

    name: str
    match: dict = field(default_factory=dict)
    agents: tuple[str, ...] = ()
    remote: str = ""
    skill_mode: str = ""
    include_secrets: bool | None = None
    depth: dict = field(default_factory=dict)
    assign_tags: tuple[str, ...] = ()
    mode: str = ""
    interval: int = 0
    enabled: bool = True


def parse_rules(text: str) -> list[Rule]:
    """Rules of a TOML document (``[[rule]]`` tables); ValueError names what is wrong."""
    data = tomllib.loads(text)
    if extra := set(data) - {"rule"}:
        raise ValueError(f"unknown keys: {sorted(extra)}")
    rules, names = [], set()
    for raw in data.get("rule", []):
        for part, known in ((raw, _TOP), (raw.get("match", {}), _MATCH), (raw.get("route", {}), _ROUTE), (raw.get("assign", {}), {"tags"})):
            if extra := set(part) - known:
                raise ValueError(f"unknown keys: {sorted(extra)}")
        name = raw.get("name", "")
        if not name or name in names:
            raise ValueError(f"missing or repeated name: {name!r}")
        names.add(name)
        match, route = raw.get("match", {}), raw.get("route", {})
        if match.get("kind", "all") not in ("all", "any"):
            raise ValueError(f"{name}: match kind {match['kind']!r}")
        if raw.get("mode", "") not in ("", *MODE_RANK):
            raise ValueError(f"{name}: mode {raw['mode']!r}")
        agents = tuple(route.get("agents", ()))
        if clash := {a for a in agents if f"!{a}" in agents}:
            raise ValueError(f"{name}: allowed and denied: {sorted(clash)}")
        if match.get("branchName"):
            re.compile(match["branchName"])
        rules.append(
            Rule(
                name, match, agents, route.get("remote", ""), route.get("skillMode", ""), route.get("includeSecrets"), dict(route.get("historicalSyncDepth", {})),
                tuple(raw.get("assign", {}).get("tags", ())), raw.get("mode", ""), raw.get("intervalSeconds", 0), raw.get("enabled", True),
            )
        )
    return rules


def matches(match: dict) -> Column:
    """Whether a row of artifacts meets a rule's predicates; a rule without any matches every row.

    Columns: tags, type, tool_kind, tool_capabilities, scope_kind, project_id,
    project_ephemeral, namespace, origin_agent, origin_device, branch_name,
    native_path.  Several listed values need one hit, under ``any`` and ``all``.
    """
    found: list[Column] = []
    true_ = lambda c: F.coalesce(c, F.lit(False))
    one_of = lambda name, values: true_(F.col(name).isin(list(values)))
    if match.get("tag"):
        tagged = lambda p: F.exists("tags", lambda t: glob_match(p, t))
        found.append(true_(reduce(lambda a, b: a | b, [tagged(p) for p in match["tag"]])))
    if match.get("type"):
        found.append(one_of("type", match["type"]))
    if match.get("toolKind"):
        found.append(true_(F.col("type") == "tool") & one_of("tool_kind", match["toolKind"]))
    if match.get("toolCapability"):
        found.append(true_(F.col("type") == "tool") & true_(F.arrays_overlap("tool_capabilities", F.array(*[F.lit(c) for c in match["toolCapability"]]))))
    scope = match.get("scope", {})
    if scope.get("kind"):
        found.append(one_of("scope_kind", scope["kind"]))
    project = scope.get("project", {})
    if project.get("id"):
        found.append(reduce(lambda a, b: a | b, [glob_match(p, F.col("project_id")) for p in project["id"]]))
    if project.get("ephemeral") is not None:
        found.append(F.coalesce("project_ephemeral", F.lit(False)) == project["ephemeral"])
    if scope.get("namespace"):
        found.append(one_of("namespace", scope["namespace"]))
    if match.get("agentSource"):
        found.append(one_of("origin_agent", match["agentSource"]))
    if match.get("deviceSource"):
        found.append(one_of("origin_device", match["deviceSource"]))
    if match.get("branchName"):
        found.append(F.rlike(F.coalesce("branch_name", F.lit("")), F.lit(match["branchName"])))
    if match.get("path"):
        found.append(glob_match(match["path"], F.col("native_path")))
    if not found:
        return F.lit(True)
    return reduce((lambda a, b: a | b) if match.get("kind") == "any" else (lambda a, b: a & b), found)


def _names(pattern: str, universe: list[str]) -> Column:
    """Agents of the universe that a pattern names for a row, as an array."""
    if pattern == ORIGIN:
        return F.filter(F.array(*[F.lit(a) for a in universe]), lambda a: a == F.col("origin_agent"))
    regex = re.compile(_glob(pattern))
    return F.array(*[F.lit(a) for a in universe if pattern == "*" or a == pattern or regex.fullmatch(a)]).cast("array<string>")


def _glob(pattern: str) -> str:
    from skeinlog.functions.text import glob_regex

    return glob_regex(pattern) if set(pattern) & set("*?[]") else re.escape(pattern)


def _without_key(map_: Column, key: str) -> Column:
    return F.map_filter(map_, lambda k, _: k != key)


def decide(artifacts: DataFrame, rules: list[Rule], universe: list[str]) -> DataFrame:
    """One decision a row: allowed and denied agents, tags, remote, modes, secrets, depths, matched rules.

    The rules are literals of the expression, so a row is decided where it lies:
    no join, no shuffle, and each predicate is evaluated once per row and rule.
    """
    active = [r for r in rules if r.enabled]
    none = F.array().cast("array<string>")
    if not active:
        flags = artifacts.withColumn("__hits", F.array().cast("array<int>"))
    else:
        flags = artifacts.withColumn("__hits", F.array_compact(F.array(*[F.when(matches(r.match), F.lit(i)) for i, r in enumerate(active)])))
    hit = lambda i: F.array_contains("__hits", i)
    allowed, denied, tags = none, none, F.coalesce("tags", none)
    names, remote, strict = none, F.lit(True), F.lit(False)
    rank, interval = F.lit(0), F.lit(0)
    secrets, depth = F.lit(None).cast("boolean"), F.create_map().cast("map<string,int>")
    everyone = F.array(*[F.lit(a) for a in universe])
    for i, r in enumerate(active):
        on = hit(i)
        positive, negative = [a for a in r.agents if not a.startswith("!")], [a[1:] for a in r.agents if a.startswith("!")]
        gained = reduce(F.array_union, [_names(p, universe) for p in positive]) if positive else everyone
        allowed = F.when(on, F.array_union(allowed, gained)).otherwise(allowed)
        if negative:
            denied = F.when(on, F.array_union(denied, reduce(F.array_union, [_names(p, universe) for p in negative]))).otherwise(denied)
        if r.assign_tags:
            tags = F.when(on, F.array_union(tags, F.array(*[F.lit(t) for t in r.assign_tags]))).otherwise(tags)
        names = F.when(on, F.array_append(names, F.lit(r.name))).otherwise(names)
        if r.remote == "exclude":
            remote = remote & ~on
        if r.skill_mode == "strict":
            strict = strict | on
        if r.mode:
            rank = F.greatest(rank, F.when(on, MODE_RANK[r.mode]).otherwise(0))
        if r.mode == "scheduled":
            interval = F.when(on, F.lit(r.interval or DEFAULT_INTERVAL)).otherwise(interval)
        if r.include_secrets is not None:
            secrets = F.when(on, F.lit(r.include_secrets)).otherwise(secrets)
        for agent, cap in r.depth.items():
            other = _without_key(depth, agent)
            depth = F.when(on, F.map_concat(other, F.create_map(F.lit(agent), F.lit(cap)))).otherwise(depth)
    some = F.size("__hits") > 0
    mode = F.when(rank == 2, "scheduled").when(rank == 1, "manual").otherwise("live")
    return flags.withColumns(
        {
            "allowed_agents": F.when(some, F.array_sort(F.array_except(allowed, denied))).otherwise(none),
            "denied_agents": F.array_sort(denied),
            "assigned_tags": F.array_sort(F.array_distinct(tags)),
            "remote_allowed": remote,
            "skill_mode": F.when(strict, "strict").otherwise("lossy"),
            "mode": mode,
            "interval_seconds": F.when(rank == 2, interval).otherwise(0),
            "include_secrets": secrets,
            "historical_depth": depth,
            "matched_rules": names,
        }
    ).drop("__hits")


def retroactive_tags(decided: DataFrame, own: str = "system:") -> DataFrame:
    """``artifact_id, added``: assigned tags that the artifact lacks, reserved ones left out; rows without any are absent."""
    added = F.filter(F.array_except("assigned_tags", F.coalesce("tags", F.array().cast("array<string>"))), lambda t: ~is_reserved_tag(t, own))
    return decided.select("artifact_id", F.array_sort(added).alias("added")).where(F.size("added") > 0)


def route_rows(decided: DataFrame) -> DataFrame:
    """One row per artifact and agent that it goes to."""
    return decided.select("artifact_id", F.explode("allowed_agents").alias("agent"))


# The five presets that a user may add; none is in force by itself.
PRESETS = {
    "default-all-to-all": Rule("default-all-to-all", {"kind": "any", "type": ["memory", "skill", "tool", "conversation"]}),
    "fork-respects-origin": Rule("fork-respects-origin", {"tag": ["fork-of:*"]}, (ORIGIN,)),
    "private-stays-local": Rule("private-stays-local", {"tag": ["private", "secret"]}, remote="exclude"),
    "tool-secrets-default-local": Rule("tool-secrets-default-local", {"type": ["tool"]}, include_secrets=False),
    "ephemeral-projects-stay-local": Rule("ephemeral-projects-stay-local", {"scope": {"kind": ["project"], "project": {"ephemeral": True}}}, remote="exclude"),
}


def with_presets(rules: list[Rule], names: list[str]) -> list[Rule]:
    """``rules`` and the named presets that they lack, in the order of the names; ValueError for an unknown name."""
    if unknown := set(names) - set(PRESETS):
        raise ValueError(f"unknown presets: {sorted(unknown)}")
    held = {r.name for r in rules}
    return [*rules, *[PRESETS[n] for n in dict.fromkeys(names) if n not in held]]
