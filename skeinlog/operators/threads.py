"""Threads that come back from an agent: what an incoming copy of a conversation does to the thread it belongs to.

Every decision is about one pair of event lists, so it is an Arrow map over rows;
nothing is shuffled and a task holds one pair at a time.  Events are structs of
``ts`` (nanoseconds, 0: none), ``type``, ``role``, ``text`` (the visible text of a turn,
null for everything else) and ``body`` (the canonical string of the event without its
time).  A *turn* is an event with a text; two turns are equal by role and text.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.types import _parse_datatype_string

from skeinlog.operators.merge import merged_places

EVENTS = "array<struct<ts:bigint,type:string,role:string,text:string,body:string>>"
# What an agent says when it has nothing to say; agents whose portable form loses rows, and those that mark each row.
NO_RESPONSE = "No response requested."
LOSSY_AGENTS, MARKING_AGENTS = ["codex"], ["claude-code"]

Event = dict
Turn = tuple[str, str]


def turns_of(events: list[Event]) -> list[Turn]:
    return [(e["role"], e["text"]) for e in events if e["text"] is not None]


def digest(turns: list[Turn]) -> str:
    """The digest of visible turns, as ``turns.turns_hash`` makes it."""
    return hashlib.sha256("\x1e".join(f"{role}\x1f{text}" for role, text in turns).encode()).hexdigest()


def opens(short: list, long: list) -> bool:
    """Whether ``long`` begins with ``short``."""
    return long[: len(short)] == short


def holds(short: list, long: list) -> bool:
    """Whether ``short`` stands in ``long`` in order, with gaps."""
    rest = iter(long)
    return all(x in rest for x in short)


def replays(current: list[Turn], new: list[Turn]) -> bool:
    """Whether all that ``new`` has beyond the length of ``current`` is said there already."""
    more = new[len(current) :]
    return bool(more) and set(more) <= set(current)


def tail_after(events: list[Event], turns: int) -> list[Event]:
    """The events after the first so many turns."""
    if turns <= 0:
        return events
    seen = 0
    for i, e in enumerate(events):
        seen += e["text"] is not None
        if seen == turns:
            return events[i + 1 :]
    return []


def _bodies(events: list[Event]) -> list[str]:
    return [e["body"] for e in events]


def _exchanges(events: list[Event]) -> bool:
    """Whether the events are turns of user and assistant by turns, ending with an answer."""
    return len(events) % 2 == 0 and all(e["type"] == "turn" and e["role"] == ("user", "assistant")[i % 2] for i, e in enumerate(events))


# copies that an older materialiser wrote with times of its own


def retimed(events: list[Event]) -> bool:
    """Whether a list shows the signature of rewritten times: one time for all of it, or a shared time beside contents that stand at several."""
    if len(events) < 2:
        return False
    times = Counter(e["ts"] for e in events)
    if len(times) == 1:
        return events[0]["ts"] != 0
    contents: dict[str, set] = {}
    for e in events:
        contents.setdefault(e["body"], set()).add(e["ts"])
    return any(t and n > 1 for t, n in times.items()) and any(len(ts) > 1 for ts in contents.values())


def edge_echo(clean: list[Event], dirty: list[Event]) -> bool:
    """Whether ``dirty`` is ``clean`` with its first answer once more in front and its last one once more behind."""
    c = _bodies(clean)
    return len(c) >= 4 and _exchanges(clean) and _bodies(dirty) == [c[1], *c, c[-1]]


def adjacent_echo(clean: list[Event], dirty: list[Event]) -> bool:
    """Whether ``dirty`` is two exchanges with the first answer twice, or that and then the last answer and question again."""
    c = _bodies(clean)
    if len(c) != 4 or not _exchanges(clean):
        return False
    twice = [c[0], c[1], c[1], c[2], c[3]]
    return _bodies(dirty) in (twice, [*twice, c[3], c[2]])


def cleaned(events: list[Event]) -> list[Event]:
    """A list with rewritten times without the twins of events that also stand at a time of their own, and without empty answers."""
    if not retimed(events):
        return list(events)
    times = Counter(e["ts"] for e in events)
    originals = {e["body"] for e in events if times[e["ts"]] == 1}
    silent = lambda e: e["type"] == "turn" and e["role"] == "assistant" and (e["text"] or "").strip() == NO_RESPONSE
    return [e for e in events if not (times[e["ts"]] > 1 and e["body"] in originals) and not silent(e)]


def score(events: list[Event]) -> tuple:
    """Smaller is healthier: turns that follow one of their role, times that go back, events at shared times, then the text itself."""
    turns, times = turns_of(events), Counter(e["ts"] for e in events)
    return (
        sum(a[0] == b[0] for a, b in zip(turns, turns[1:], strict=False)),
        sum(b["ts"] < a["ts"] for a, b in zip(events, events[1:], strict=False)),
        sum(times[e["ts"]] > 1 for e in events),
        [_order(e) for e in events],
    )


def _order(e: Event) -> tuple:
    return e["body"], e["ts"]


def repaired(a: list[Event], b: list[Event]) -> list[Event] | None:
    """One list for two copies of which one shows rewritten times; null if neither does.  It doesn't matter which copy comes first.

    An echo at both ends gives the clean copy; equal contents the healthier order;
    a copy that holds the other one that copy; else a shortest list that holds both.
    """
    if not retimed(a) and not retimed(b):
        return None
    for clean, dirty in ((a, b), (b, a)):
        if edge_echo(clean, dirty):
            return list(clean)
    a, b = cleaned(a), cleaned(b)
    x, y = _bodies(a), _bodies(b)
    if Counter(x) == Counter(y):
        return min(a, b, key=score)
    if holds(x, y):
        return b
    if holds(y, x):
        return a
    out = []
    for i, j in merged_places(x, y):
        both = [e for e in (a[i] if i is not None else None, b[j] if j is not None else None) if e is not None]
        # of two copies of an event the one that has a time, then the earlier
        out.append(min(both, key=lambda e: (e["ts"] == 0, e["ts"])))
    return out


# continuations


def stale_continuation(current: list[Event], incoming: list[Event], base_count: int, base_hash: str) -> list[Event] | None:
    """The thread with what an agent wrote after a base that the thread has outgrown; null without proof of that base.

    The base is proven by its stamp: so many turns, with that digest, at the start
    of both lists.  Turns that the thread has at the same places, and events that it
    holds as they are, are no news and left out; if nothing is left, there is no
    continuation.
    """
    cur, new = turns_of(current), turns_of(incoming)
    if not 0 < base_count < min(len(cur), len(new)):
        return None
    base = new[:base_count]
    if not base_hash or digest(base) != base_hash or cur[:base_count] != base:
        return None
    shared = next((i for i, (x, y) in enumerate(zip(cur, new, strict=False)) if x != y), min(len(cur), len(new)))
    tail = tail_after(incoming, shared)
    known = {(e["ts"], e["body"]) for e in current}
    while tail and (tail[0]["ts"], tail[0]["body"]) in known:
        tail = tail[1:]
    return [*current, *tail] if turns_of(tail) else None


def divergent_tail(current: list[Event], incoming: list[Event]) -> list[Event] | None:
    """What an agent wrote on its own after the turns that both copies share; null unless appending it is sound.

    Sound: both start alike, neither leads to the other, the thread holds none of the
    new turns, and all of them are later than any turn that it has.
    """
    cur, new = turns_of(current), turns_of(incoming)
    if not cur or not new or opens(cur, new) or opens(new, cur) or holds(new, cur) or replays(cur, new):
        return None
    shared = next(i for i, (x, y) in enumerate(zip(cur, new, strict=False)) if x != y)
    if not shared or set(new[shared:]) & set(cur):
        return None
    tail = tail_after(incoming, shared)
    had, got = [e["ts"] for e in current if e["text"] is not None], [e["ts"] for e in tail if e["text"] is not None]
    if not got or 0 in had or 0 in got or min(got) <= max(had):
        return None
    return tail


def would_regress(current: list[Event], incoming: list[Event]) -> bool:
    """Whether an import would take away or only repeat what the thread has."""
    cur, new = turns_of(current), turns_of(incoming)
    if not cur:
        return False
    return not opens(cur, new) or (cur == new and len(incoming) < len(current)) or replays(cur, new)


def append_payload(current: list[Event], incoming: list[Event]) -> tuple[str, list[Event]]:
    """How a copy is written after the thread: ``noop``, ``prefix`` (by events), ``text`` (by turns), ``overlap`` or ``full``, and the tail."""
    same = lambda x, y: [(e["ts"], e["body"]) for e in x] == [(e["ts"], e["body"]) for e in y]
    if same(current, incoming):
        return "noop", []
    if len(current) < len(incoming) and same(current, incoming[: len(current)]):
        return "prefix", incoming[len(current) :]
    cur, new = turns_of(current), turns_of(incoming)
    if cur and len(cur) < len(new) and opens(cur, new):
        return "text", tail_after(incoming, len(cur))
    if cur and opens(new, cur):
        return "noop", []
    overlap = next((n for n in range(min(len(cur), len(new)), 1, -1) if cur[-n:] == new[:n]), 0)
    if overlap:
        tail = tail_after(incoming, overlap)
        return ("overlap", tail) if turns_of(tail) else ("noop", [])
    return "full", incoming


# the decision


def _portable(events: list[Event]) -> bool:
    return bool(events) and all(e["type"] == "turn" and e["text"] is not None for e in events)


def _echoes_only(thread: dict, cur: list[Turn], new: list[Turn]) -> bool:
    """Whether the thread is the copy with nothing but copies of its own turns in between, as the agent's own older form shows."""
    stamped = 0 < thread["base_count"] <= len(new) and bool(thread["base_hash"]) and digest(new[: thread["base_count"]]) == thread["base_hash"]
    legacy = thread["legacy"]
    return (
        thread["agent"] in LOSSY_AGENTS and thread["authenticated"] and thread["sanitized"] and stamped and len(legacy) > len(new) and len(cur) > len(new)
        and _exchanges(thread["incoming"]) and _portable(thread["current"]) and holds(new, cur) and holds(legacy, cur) and set(cur) <= set(new)
    )


def decide(thread: dict) -> tuple[str, list[Event]]:
    """(action, events) for one thread.

    ``import``: not a thread that is known here; ``unchanged``: the copy says nothing
    new (which ends the loop of copies between agents); ``suppressed``: it would undo
    or repeat something and there is no proof that it may; ``append``: the events go
    behind the thread; ``replace``: they take its place.
    """
    current, incoming = thread["current"], thread["incoming"]
    cur, new, legacy = turns_of(current), turns_of(incoming), thread["legacy"]
    stamp, count, main, full = thread["base_hash"], thread["base_count"], thread["main"], thread["full"]
    echoed = bool(stamp) and stamp == digest(new)
    whole = thread["generated"] and count == len(new) and echoed
    trusted = thread["agent"] not in LOSSY_AGENTS or thread["authenticated"]
    if not thread["known"]:
        return "import", incoming
    if (echoed and not thread["sanitized"] and not whole) or (thread["generated"] and not thread["has_head"]):
        return "unchanged", []
    if not thread["has_head"]:
        return "import", incoming

    # proofs that the copy is the clean one
    backed = thread["agent"] in MARKING_AGENTS or (thread["agent"] in LOSSY_AGENTS and thread["authenticated"] and thread["sanitized"] and legacy == new and bool(legacy))
    dated = retimed(current) or retimed(incoming)
    edges = main and whole and backed and dated and _portable(current) and _portable(incoming) and edge_echo(incoming, current)
    stamped = 0 < count <= len(new) and bool(stamp) and digest(new[:count]) == stamp
    twice = adjacent_echo(incoming, current)
    adjacent = main and twice and thread["agent"] in LOSSY_AGENTS and backed and stamped and _portable(current) and _portable(incoming)
    projected = thread["sanitized"] and trusted and full and _portable(incoming) and (cur == new or (bool(legacy) and opens(cur, legacy))) and (not _portable(current) or cur != new)
    repair = projected or edges or adjacent or (main and _echoes_only(thread, cur, new))

    if cur == new and not repair:
        return "unchanged", []
    mended = repaired(current, incoming) if full and not repair else None
    if mended is not None:
        shrinks = len(turns_of(mended)) < len(cur) and edge_echo(incoming, current)
        if shrinks or turns_of(mended) == cur:
            return "unchanged", []
        incoming, new = mended, turns_of(mended)
    spare = thread["synthetic"] and trusted and len(cur) == len(new) + 1 and opens(new, cur)
    if full and twice and not adjacent:
        return "suppressed", []
    if not (repair or spare or mended is not None):
        if not opens(cur, new):
            incoming = stale_continuation(current, incoming, count, stamp)
            if incoming is None:
                return "suppressed", []
        elif replays(cur, new):
            return "suppressed", []
    kind, tail = append_payload(current, incoming) if full else ("full", incoming)
    return ("append", tail) if kind in ("prefix", "text", "overlap") else ("replace", incoming)


#: Columns that ``thread_decisions`` reads besides ``artifact_id``, with what a missing or null one counts as.
FACTS: dict[str, object] = {
    "current": [], "incoming": [], "legacy": [], "agent": "", "base_count": 0, "base_hash": "", "known": True, "has_head": True, "main": True, "full": True,
    "generated": False, "sanitized": False, "authenticated": False, "synthetic": False,
}


def _mapped(pairs: DataFrame, columns: list[str], schema: str, work: Callable[[dict], tuple]) -> DataFrame:
    """``artifact_id`` and what ``work`` makes of each row's ``columns``."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = pairs.select("artifact_id", *[c for c in columns if c in pairs.columns])
    out = kept.select("artifact_id").schema
    for f in _parse_datatype_string(schema).fields:
        out = out.add(f)
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                rows = some.to_pylist()
                made = [work({c: FACTS[c] if r.get(c) is None else r[c] for c in columns}) for r in rows]
                yield pa.RecordBatch.from_arrays([some.column(0), *[pa.array([m[i] for m in made], arrow.field(i + 1).type) for i in range(len(arrow) - 1)]], schema=arrow)

    return kept.mapInArrow(run, out)


def thread_decisions(threads: DataFrame) -> DataFrame:
    """``artifact_id``, ``action`` and ``events`` of every row (see ``decide``); ``legacy`` holds structs of role and text."""

    def work(r: dict) -> tuple:
        return decide({**r, "legacy": [(t["role"], t["text"]) for t in r["legacy"]]})

    return _mapped(threads, list(FACTS), f"action string, events {EVENTS}", work)


def repairs(pairs: DataFrame) -> DataFrame:
    """``artifact_id``, ``repaired`` and ``events`` for two copies ``current`` and ``incoming``; no events where neither shows rewritten times."""

    def work(r: dict) -> tuple:
        made = repaired(r["current"], r["incoming"])
        return made is not None, made or []

    return _mapped(pairs, ["current", "incoming"], f"repaired boolean, events {EVENTS}", work)


def continuations(pairs: DataFrame) -> DataFrame:
    """``artifact_id``, ``kind`` and ``tail``: how ``incoming`` goes on from ``current`` (see ``append_payload``, ``stale_continuation``, ``divergent_tail``)."""

    def work(r: dict) -> tuple:
        kind, tail = append_payload(r["current"], r["incoming"])
        if kind == "full":
            stale = stale_continuation(r["current"], r["incoming"], r["base_count"], r["base_hash"])
            if stale is not None:
                return "stale", stale[len(r["current"]) :]
            apart = divergent_tail(r["current"], r["incoming"])
            if apart is not None:
                return "divergent", apart
        return kind, tail

    return _mapped(pairs, ["current", "incoming", "base_count", "base_hash"], f"kind string, tail {EVENTS}", work)
