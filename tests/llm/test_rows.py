"""Operators 3, 4, 5, 6, 8 and 10 and the pipeline against brute force, with every odd row."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from skeinlog.llm import context_trees, hamming_tree, mixing, quality_ledger, site_spread, template_slots

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# operator 6


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {p for i, w in enumerate(windows) if count[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_ledger_equals_brute_force(docs, rows, empty):
    policy = quality_ledger.POLICIES[2]
    made = quality_ledger.judged(docs, policy).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in made)
    assert got == Counter((r[0], *brute_measures(r[1])) for r in rows)
    for r in made:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept) and r.kept == (r.failures & policy.mask == 0)
    assert quality_ledger.judged(empty, policy).collect() == []


def test_policies_and_ablations_read_bits_only(docs):
    policy = quality_ledger.POLICIES[2]
    kept = quality_ledger.ledger(docs).cache()
    bits = [r.failures & policy.mask for r in kept.collect()]
    for r in quality_ledger.ablation(kept, policy).collect():
        bit = quality_ledger.bits(r.rule)
        assert (r.n_failed, r.n_alone, r.n_kept_without) == (sum(b & bit != 0 for b in bits), sum(b == bit for b in bits), sum(b & ~bit == 0 for b in bits))


def test_keep_good_returns_whole_rows(docs, rows):
    policy = quality_ledger.POLICIES[2]
    good = quality_ledger.keep_good(docs, policy)
    assert good.columns == docs.columns
    verdicts = {r.doc_id: r.kept for r in quality_ledger.judged(docs, policy).collect()}
    assert Counter(r.doc_id for r in good.collect()) == Counter(r[0] for r in rows if verdicts[r[0]])


# operator 3


def brute_spread(rows, threshold):
    sites, places = defaultdict(set), defaultdict(list)
    for r in rows:
        for pos, line in enumerate((r[1] or "").split("\n")):
            if len(WORD.findall(line)) >= 3:
                sites[line].add(r[3])
                places[line].append(((r[0] is not None, r[0] or 0), pos))
    out = {}
    for r in rows:
        kept = []
        for pos, line in enumerate((r[1] or "").split("\n")):
            spread = len(sites[line]) >= threshold if len(WORD.findall(line)) >= 3 else False
            if not spread or ((r[0] is not None, r[0] or 0), pos) == min(places[line]):
                kept.append(line)
        out[r[0]] = "\n".join(kept)
    return out


@pytest.mark.parametrize("threshold", [2, 3, 5])
def test_line_dedup_equals_brute_force(docs, rows, empty, threshold):
    want = brute_spread(rows, threshold)
    got = {r.doc_id: r for r in site_spread.report(docs, threshold).collect()}
    assert {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()} == {k: r.kept_sha256 for k, r in got.items()}
    assert any(r.n_removed for r in got.values())
    assert site_spread.report(empty, threshold).collect() == []


def test_dropping_keeps_columns_nulls_and_clean_rows(docs, rows):
    made = site_spread.drop_boilerplate(docs, 3)
    assert made.columns == docs.columns
    ids = Counter(r.doc_id for r in made.collect())
    assert {60, 61, 62, 63, 64, None} <= set(ids)


# operator 4


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items):
    """{row number: smallest id} of (id, fingerprint) rows."""
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(items):
        if doc is not None:
            low[find(i)] = min(doc, low.get(find(i), doc))
    return [low.get(find(i)) for i in range(len(items))]


def test_near_duplicates_equal_brute_force(docs, rows, empty):
    items = [(r[0], brute_fingerprint(r[1])) for r in rows]
    want = Counter((d, f"{f:016x}", c) for (d, f), c in zip(items, brute_components(items), strict=True))
    assert Counter(tuple(r) for r in hamming_tree.components(docs).collect()) == want
    assert hamming_tree.components(empty).collect() == []
    kept = hamming_tree.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {c for (d, _), c in zip(items, brute_components(items), strict=True) if c is not None} | {None}


@pytest.mark.parametrize("dense", [False, True])
def test_shards_and_trees_find_every_link(spark, dense):
    rnd = random.Random(4)
    if dense:  # one heavy cluster, many points within the radius of each other, and chains
        base = rnd.getrandbits(64)
        values = {base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for _ in range(1200)}
    else:
        values = {rnd.getrandbits(64) for _ in range(900)}
    for _ in range(60):
        v = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 6)):
            v ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4)))
            values.add(v)
    values = sorted(values)
    items = list(enumerate(values))
    want = brute_components(items)
    low = {}
    for (i, v), c in zip(items, want, strict=True):
        low[v] = c
    size = Counter(want)
    points = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    got = {r.fp % (1 << 64): r.label for r in hamming_tree.point_labels(points, shard_points=120).collect()}
    assert set(got) == {v for v in values if size[low[v]] > 1}
    groups = defaultdict(set)
    for v, label in got.items():
        groups[label].add(low[v])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == sum(n > 1 for n in size.values())


# operator 5


def brute_code_length(train, order, text):
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for t in train:
        d = context_trees.START + t
        for i in range(3, len(d)):
            for m in range(order + 1):
                counts[m][d[i - m : i]][d[i]] += 1
    total, d = 0.0, context_trees.START + text
    for i in range(3, len(d)):
        for m in range(order, -1, -1):
            seen = counts[m].get(d[i - m : i])
            if seen:
                t, k = sum(seen.values()), len(seen)
                if d[i] in seen:
                    total -= math.log2(seen[d[i]] / (t + k))
                    break
                total -= math.log2(k / (t + k))
        else:
            total += 8
    return total


@pytest.mark.parametrize("order", [1, 2, 3])
def test_code_lengths_equal_brute_force(rows, order):
    texts = [(r[1] or "").encode() for r in rows if r[1]]
    samples = {"en": texts[:8], "fr": texts[8:20], "x": [b"zzz"]}
    model = context_trees.fit(samples, order)
    tried = [*texts[20:40], b"", "日本 x".encode(), b"\xff\x00"]
    bits = model.code_lengths(tried)
    for k, lang in enumerate(model.langs):
        for i, t in enumerate(tried):
            assert bits[i, k] == pytest.approx(brute_code_length(samples[lang], order, t), rel=1e-5, abs=1e-3)


def test_identification_rules(spark, docs, rows, empty):
    made = {r.doc_id: r for r in context_trees.identified(docs, per_lang=20).collect()}
    import zlib

    for i, r in made.items():
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "und")
    assert all(made[i].lang_pred == "und" and made[i].score == 0 for i in (60, 61, 62, 63))
    assert context_trees.identified(empty).collect() == []
    unlabelled = docs.withColumn("lang", docs["lang"].substr(100, 1)).replace("", None, subset=["lang"])
    assert {r.lang_pred for r in context_trees.identified(unlabelled).collect()} == {"und"}


def test_held_out_accuracy(spark):
    rnd = random.Random(3)
    parts = {"en": ["the", "and", "ing", "tion", "th"], "de": ["ung", "sch", "der", "ein", "ß"], "fr": ["eau", "ou", "é", "que", "le"]}
    rows = [(i, " ".join("".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(20)), lang) for i, lang in enumerate(rnd.choice(list(parts)) for _ in range(300))]
    made = context_trees.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=50)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in made.collect() if r.held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


# operator 8


def page(body, lang="en", title="t"):
    return f'<!DOCTYPE html><html lang="{lang}"><head><title>{title}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{body}</body></html>'


def test_main_text_by_roles():
    p = page('<header>Top</header><nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div><article><h1>Title &amp; more</h1><p><b>Bold. <br><p>Next&nbsp;line</p><form>Sign up</form><script>x</script><div class="comments">First!</div><ul><li>one<li>two</ul></article><aside>Side</aside><footer>&copy; me</footer>')
    assert template_slots.main_text(p) == "Title & more Bold. Next line one two"
    assert template_slots.main_text("<div>a</div><p>b <i>c</i>d") == "a b cd"
    assert template_slots.main_text("") == "" and template_slots.main_text("plain") == "plain" and template_slots.main_text("<p") == ""
    assert template_slots.main_text("<article><p>cut off in the <b>mid") == "cut off in the mid"


def test_template_takes_furniture_out(spark, empty):
    rows = [(i, f"http://h.example/{i}", page(f"<div>Site name</div><div><p>Text {i} here</p></div><div>Fixed line</div>")) for i in range(8)]
    rows += [(20 + i, f"http://two.example/{i}", page("<div>Site name</div><p>Only</p>")) for i in range(2)]
    rows += [(30, None, None), (31, "no url", ""), (32, "http://h.example/7", rows[7][2]), (32, "http://h.example/7", rows[7][2])]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = defaultdict(list)
    for r in template_slots.extracted(pages).collect():
        got[r.page_id].append((r.text, r.n_chars))
    assert all(got[i] == [(f"Text {i} here", len(f"Text {i} here"))] for i in range(8))
    assert got[20] == [("Site name Only", 14)] and got[30] == [("", 0)] and got[31] == [("", 0)] and len(got[32]) == 2
    assert template_slots.extracted(pages.limit(0)).collect() == []


def test_classes_nest():
    member = lambda t, pos, parent: {"token": t, "pos": pos, "parent": parent}
    root = {"support": 9, "members": [member(1, 0, 0), member(2, 5, 1), member(3, 9, 1)]}
    inner = {"support": 6, "members": [member(4, 6, 2), member(5, 7, 4)]}
    stray = {"support": 6, "members": [member(6, 6, 99), member(7, 7, 6)]}
    assert template_slots.nested([stray, inner, root]) == [1, 2, 4, 5, 3] and template_slots.nested([]) == []


# operator 10


def test_exponent_meets_its_target():
    tokens = [1_000_000, 30_000, 20_000, 5_000, 0]
    for mix in (mixing.Mix(entropy=0.7, max_epochs=1e9), mixing.Mix(entropy=1.0, max_epochs=2.0), mixing.Mix(max_epochs=1.5, cover=True)):
        exponent, w, budgets = mixing.solve(tokens, mix)
        assert math.isclose(sum(w), 1) and 0 <= exponent <= 1 and budgets[-1] == 0
        times = [b / t for b, t in zip(budgets, tokens, strict=True) if t]
        assert max(times) <= mix.max_epochs + 0.01
        assert mixing.entropy(w) <= mix.entropy * math.log(4) + 1e-9
        if mix.cover:
            assert min(times) >= 1
        tight = math.isclose(max(times), mix.max_epochs, rel_tol=1e-3) or math.isclose(mixing.entropy(w), mix.entropy * math.log(4), rel_tol=1e-6)
        assert tight
    assert mixing.solve([0, 0], mixing.Mix()) == (1.0, [0.0, 0.0], [0, 0]) and mixing.solve([7], mixing.Mix(entropy=0.5))[2] == [7]


def test_draws_fill_budgets_in_block_order(spark, docs, rows, empty):
    mix = mixing.Mix(entropy=1.0, max_epochs=2.5, budget=1.3, block_tokens=100)
    made = mixing.schedule(docs, mix).collect()
    tokens, size = defaultdict(int), {}
    for r in rows:
        n = max(1, len(WORD.findall(r[1] or "")))
        tokens[r[3]] += n
        size[r[0]] = n
    names = sorted(tokens, key=lambda s: "\x00none" if s is None else s)
    budgets = dict(zip(names, mixing.solve([tokens[s] for s in names], mix)[2], strict=True))
    drawn = defaultdict(int)
    for r in made:
        drawn[r.source] += r.n_tokens
    for s, budget in budgets.items():
        last = max(size[r.doc_id] for r in made if r.source == s)
        assert budget <= drawn[s] < budget + last, s
    for s in names:
        epochs = defaultdict(Counter)
        for r in made:
            if r.source == s:
                epochs[r.epoch][r.doc_id] += 1
        own = Counter(r[0] for r in rows if r[3] == s)
        for e in sorted(epochs)[:-1]:
            assert epochs[e] == own
        assert all(n <= own[d] for d, n in epochs[max(epochs)].items())
    cover = mixing.mixed(docs, mixing.Mix(max_epochs=1.5, cover=True))
    assert cover.columns == docs.columns and {r.doc_id for r in cover.collect()} == {r[0] for r in rows}
    assert mixing.schedule(empty, mix).collect() == [] and mixing.mixed(empty, mix).collect() == []
