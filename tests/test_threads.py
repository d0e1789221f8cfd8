"""Threads that come back: decisions, repairs and continuations on hand-written pairs, and walks against plain versions."""

import random

from pyspark.sql import functions as F

from skeinlog.operators import merge, retention, rules
from skeinlog.operators import threads as T
from skeinlog.plans import load_all


def turn(role, text, ts):
    return {"ts": ts, "type": "turn", "role": {"u": "user", "a": "assistant"}[role], "text": text, "body": f"{role}:{text}"}


def thread(*said, at=1):
    """Turns by turns of user and assistant, or as (role, text, time)."""
    return [turn("ua"[i % 2], s, at + i) if isinstance(s, str) else turn(*s) for i, s in enumerate(said)]


def fact(current, incoming, **more):
    return {c: more.get(c, d) for c, d in T.FACTS.items()} | {"current": current, "incoming": incoming} | more


def texts(events):
    return [e["text"] for e in events]


def test_copies_that_say_nothing_new():
    base = thread("q", "a", "r", "b")
    assert T.decide(fact(base, base)) == ("unchanged", [])
    assert T.decide(fact(base, base, known=False))[0] == "import"
    assert T.decide(fact([], base, has_head=False))[0] == "import"
    assert T.decide(fact([], base, has_head=False, generated=True))[0] == "unchanged"
    stamped = {"base_count": 2, "base_hash": T.digest(T.turns_of(base[:2]))}
    assert T.decide(fact(base, base[:2], **stamped)) == ("unchanged", [])
    # behind the thread, without a stamp
    assert T.decide(fact(base, base[:2]))[0] == "suppressed"


def test_continuations():
    base = thread("q", "a", "r", "b")
    more = [*base, turn("u", "new", 9)]
    assert T.decide(fact(base, more)) == ("append", more[4:])
    # the same turns with other times: the tail alone is written
    again = [{**e, "ts": e["ts"] + 100} for e in base] + [turn("u", "new", 200)]
    action, tail = T.decide(fact(base, again))
    assert action == "append" and texts(tail) == ["new"]
    # what it adds is said already
    assert T.decide(fact(base, [*base, turn("u", "q", 50)]))[0] == "suppressed"
    # the thread went on elsewhere; the copy on from its stamped base
    stamped = {"base_count": 2, "base_hash": T.digest(T.turns_of(base[:2]))}
    stale = [*base[:2], turn("u", "x", 7), turn("a", "y", 8)]
    action, tail = T.decide(fact(base, stale, **stamped))
    assert action == "append" and texts(tail) == ["x", "y"]
    assert T.decide(fact(base, stale))[0] == "suppressed"
    assert T.stale_continuation(base, [*base, turn("u", "x", 7)], **stamped)[4:] == [turn("u", "x", 7)]
    assert T.stale_continuation([*base, turn("u", "x", 7)], [*base[:2], turn("u", "x", 7)], **stamped) is None
    # a legacy payload is written anew
    assert T.decide(fact(base, more, full=False)) == ("replace", more)


def test_append_payloads():
    base = thread("q", "a", "r")
    note = {"ts": 5, "type": "system_note", "role": None, "text": None, "body": "note"}
    assert T.append_payload(base, base) == ("noop", []) and T.append_payload(base, [*base, note]) == ("prefix", [note])
    other = [{**e, "ts": e["ts"] + 10} for e in base]
    assert T.append_payload(base, [*other, turn("a", "b", 30)]) == ("text", [turn("a", "b", 30)])
    assert T.append_payload(base, other[:2]) == ("noop", [])
    assert T.append_payload(base, [*other[1:], turn("a", "b", 30)]) == ("overlap", [turn("a", "b", 30)])
    assert T.append_payload(base, thread("z", "y"))[0] == "full"


def test_divergent_tails():
    base = thread("q", "a", "r", "b")
    own = [*base[:2], turn("u", "mine", 50), turn("a", "yes", 51)]
    assert T.divergent_tail(base, own) == own[2:]
    assert T.divergent_tail([*base, *own[2:]], own) is None  # taken already
    assert T.divergent_tail(base, [*base[:2], turn("u", "mine", 1)]) is None  # older
    assert T.divergent_tail(base, [*base[:2], turn("u", "mine", 0)]) is None  # without a time
    assert T.divergent_tail(base, [*base[:1], turn("a", "b", 50), turn("u", "mine", 51)]) is None  # holds a known turn
    assert T.divergent_tail(base, thread("z", "y", at=50)) is None and T.divergent_tail(base, base[:2]) is None
    assert T.would_regress(base, base[:3]) and T.would_regress(base, [*base, turn("u", "q", 9)]) and not T.would_regress(base, [*base, turn("u", "z", 9)]) and not T.would_regress([], base)


def test_retimed_copies():
    clean = thread("q", "a", "r", "b")
    mirror = [{**e, "ts": 77} for e in clean]
    assert T.retimed(mirror) and not T.retimed(clean) and not T.retimed([{**e, "ts": 0} for e in clean])
    assert T.repaired(clean, clean[:3]) is None
    for a, b in ((clean, mirror), (mirror, clean)):
        assert T.repaired(a, b) == clean
    # one time for the answer in front and behind
    dirty = [turn("a", "a", 90), *clean, turn("a", "b", 90)]
    assert T.edge_echo(clean, dirty) and T.repaired(clean, dirty) == T.repaired(dirty, clean) == clean
    # originals beside their twins
    union = [*clean[:2], *mirror, *clean[2:]]
    assert T.cleaned(union) == clean
    assert T.cleaned([*clean, turn("a", T.NO_RESPONSE, 77), turn("a", "a", 77)]) == clean
    # each copy has something of its own: both keep it, in either order
    left, right = [*mirror, turn("u", "left", 77)], [*mirror, turn("u", "right", 77)]
    assert T.repaired(left, right) == T.repaired(right, left) and set(texts(T.repaired(left, right))) == {"q", "a", "r", "b", "left", "right"}
    action, _ = T.decide(fact(mirror, [*clean, turn("u", "new", 99)]))
    assert action in ("append", "replace")


def test_echoes_go_only_with_proof():
    clean = thread("q", "a", "r", "b")
    dirty = [turn("a", "a", 90), *clean, turn("a", "b", 90)]
    proof = {"generated": True, "agent": "claude-code", "base_count": 4, "base_hash": T.digest(T.turns_of(clean))}
    assert T.decide(fact(dirty, clean, **proof)) == ("replace", clean)
    assert T.decide(fact(dirty, clean, **{**proof, "agent": "other"}))[0] == "unchanged"
    twice = [clean[0], clean[1], {**clean[1], "ts": 60}, *clean[2:]]
    lossy = {**proof, "agent": "codex", "authenticated": True, "sanitized": True, "legacy": T.turns_of(clean)}
    assert T.adjacent_echo(clean, twice) and T.adjacent_echo(clean, [*twice, clean[3], clean[2]]) and not T.adjacent_echo(clean, clean)
    assert T.decide(fact(twice, clean, **lossy)) == ("replace", clean)
    assert T.decide(fact(twice, clean))[0] == "suppressed"
    # one bookkeeping turn at the end that an adapter takes out
    assert T.decide(fact([*clean, turn("u", "made up", 9)], clean, synthetic=True)) == ("replace", clean)


def test_decisions_over_a_table(spark):
    base = thread("q", "a")
    rows = [(1, base, base, 0, ""), (2, base, [*base, turn("u", "n", 9)], 0, ""), (3, base, thread("z"), 0, ""), (4, None, base, 0, "")]
    schema = f"artifact_id long, current {T.EVENTS}, incoming {T.EVENTS}, base_count long, base_hash string"
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = {r.artifact_id: (r.action, [e.text for e in r.events]) for r in T.thread_decisions(df).collect()}
    assert got == {1: ("unchanged", []), 2: ("append", ["n"]), 3: ("suppressed", []), 4: ("append", ["q", "a"])}
    kinds = {r.artifact_id: r.kind for r in T.continuations(df).collect()}
    assert kinds == {1: "noop", 2: "prefix", 3: "full", 4: "prefix"}
    assert [r.repaired for r in T.repairs(df).collect()] == [False] * 4 and T.repairs(df.limit(0)).collect() == []


def shortest(a, b):
    """Length of a shortest supersequence, by the plain table."""
    best = [[i + j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best[i][j] = 1 + (best[i - 1][j - 1] if a[i - 1] == b[j - 1] else min(best[i - 1][j], best[i][j - 1]))
    return best[-1][-1]


def test_supersequences_are_shortest_and_commute():
    rnd = random.Random(2)
    for _ in range(300):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 14))] for _ in range(2))
        made = merge._supersequence(a, b)
        assert len(made) == shortest(a, b) and T.holds(a, made) and T.holds(b, made)
        assert made == merge._supersequence(b, a)


def test_thread_merge_query_equals_the_plain_version(spark):
    from skeinlog.plans.merging import _sides

    sf = "/root/testdata/sf0.01"
    pairs = {r.artifact_id: (r.a, r.b) for r in _sides(spark, sf, "a", "b").collect()}
    made = load_all()[0]["thread_merge"](spark, sf).collect()
    assert {r.artifact_id for r in made} == set(pairs) and len({r.action for r in made}) >= 3
    for r in made:
        a, b = pairs[r.artifact_id]
        overlap = lambda x, y: next((n for n in range(min(len(x), len(y)), 1, -1) if x[-n:] == y[:n]), 0)
        if T.holds(b, a):
            want = ("keep", a)
        elif T.holds(a, b):
            want = ("adopt", b)
        elif overlap(a, b):
            want = ("overlap", a + b[overlap(a, b) :])
        elif overlap(b, a):
            want = ("overlap_back", b + a[overlap(b, a) :])
        else:
            want = ("supersequence", merge._supersequence(a, b))
            assert len(r.merged) == shortest(a, b)
        assert (r.action, r.merged) == want


def test_varying_caps_equal_the_plain_walk(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["s1", "s2"]), rnd.randint(0, 30), rnd.choice([-1, 0, 1, 2, 3, 5, 9])) for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, source string, updated_at long, cap int").repartition(3)
    want = set()
    for target in ("s1", "s2", "s3"):
        taken = 0
        for conv, source, _, cap in sorted(rows, key=lambda r: (-r[2], -r[0])):
            if source != target and (cap < 0 or taken < cap):
                want.add((conv, target))
                taken += cap >= 0
    assert {(r.conv_id, r.target) for r in retention.backfill_varying(df, ["s1", "s2", "s3"]).collect()} == want


def test_presets():
    made = rules.with_presets([rules.Rule("private-stays-local", {"tag": ["mine"]})], ["private-stays-local", "default-all-to-all", "default-all-to-all"])
    assert [r.name for r in made] == ["private-stays-local", "default-all-to-all"] and made[0].match == {"tag": ["mine"]}
    try:
        rules.with_presets([], ["none"])
    except ValueError as e:
        assert "none" in str(e)
    else:
        raise AssertionError


def test_long_ways(spark):
    """Chains longer than any round: 300 links up, deep scopes, and a cycle."""
    from skeinlog.operators import catalog, logs
    from skeinlog.operators.paths import above

    log = spark.createDataFrame([(1, f"h{i}", f"h{i - 1}" if i else "") for i in range(300)], "artifact_id long, hash string, parent_hash string")
    tips = spark.createDataFrame([(1, "h280"), (1, "h5"), (1, "none")], "artifact_id long, hash string")
    assert {r.hash for r in logs.ancestors(log, tips).collect()} == {f"h{i}" for i in range(281)}
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "a")], "g long, node string, parent string")
    assert {r.node for r in above(edges, edges.select("g", F.lit("a").alias("node")), "g").collect()} == {"a", "b"}
    root = "/" + "/".join(f"d{i}" for i in range(90))
    paths, projects = spark.createDataFrame([(root + "/f",)], "path string"), spark.createDataFrame([(root, "p", "local")], "root string, project_id string, scope string")
    assert catalog.resolved_scopes(paths, projects).first().project_id == "p"
