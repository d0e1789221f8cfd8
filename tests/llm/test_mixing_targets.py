"""Operator 10: targets above and below the shares' own entropy, and every draw against a plain version."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skeinlog.llm import mixing
from skeinlog.llm.queries import op10_temperature_mix


def even(tokens, mix):
    exponent, met = mixing.solved(mixing.sums_of(tokens), mix)
    w = mixing.weights([t / sum(tokens) for t in tokens], exponent)
    return exponent, met, mixing.entropy(w) / math.log(sum(t > 0 for t in tokens))


def test_target_is_met_from_both_sides():
    for tokens in ([900, 1000, 1100], [1, 5, 400, 100_000], [10, 20, 30, 40, 0], [7_000_000, 6_999_000, 1]):
        for target in (0.97, 0.9, 0.6):
            exponent, met, reached = even(tokens, mixing.Mix(entropy=target, max_epochs=1e12))
            if met == "entropy":
                assert reached == pytest.approx(target, abs=1e-9)
            else:
                assert met == "neither" and exponent == mixing.MAX_EXPONENT and reached > target
    # shares that are nearly even are sharpened, uneven ones flattened
    assert even([900, 1000, 1100], mixing.Mix(entropy=0.95, max_epochs=1e9))[0] > 1
    assert even([1, 5, 400], mixing.Mix(entropy=0.95, max_epochs=1e9))[0] < 1
    # the repetition limit binds on either side of 1
    for tokens, limit in (([900, 1000, 1100], 1.1), ([1, 5, 400], 1.5)):
        exponent, met, _ = even(tokens, mixing.Mix(entropy=0.95, max_epochs=limit))
        times = mixing.epochs(tokens, mixing.weights([t / sum(tokens) for t in tokens], exponent), mixing.Mix())
        assert met == "epochs" and max(times) == pytest.approx(limit, rel=1e-9)
    assert even([5, 7], mixing.Mix(budget=9.0))[1] == "neither"
    assert even([5, 5], mixing.Mix(entropy=0.5))[1] == "neither" and mixing.solved(mixing.sums_of([5]), mixing.Mix(entropy=0.5))[1] == "entropy"


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_reaches_its_target(spark, sf):
    made = op10_temperature_mix(spark, f"/root/testdata/{sf}")
    by_source = made.groupBy("source").agg(F.first("weight").alias("w"), F.sum("n_tokens").alias("drawn"), F.max("n_tokens").alias("most"), F.first("entropy").alias("e"), F.first("met").alias("met")).collect()
    reached = mixing.entropy([r.w for r in by_source]) / math.log(len(by_source))
    assert {r.met for r in by_source} == {"entropy"} and reached == pytest.approx(0.95, abs=1e-6) and all(r.e == 0.95 for r in by_source)
    total = sum(r.drawn for r in by_source)
    assert all(abs(r.drawn - r.w * total) <= 2 * r.most + 0.001 * total for r in by_source)


MIXES = [mixing.Mix(entropy=0.9, max_epochs=4.0, budget=1.7, block_tokens=60), mixing.Mix(entropy=0.5, budget=0.4, block_tokens=1 << 20), mixing.Mix(max_epochs=2.0, cover=True, block_tokens=90)]


@pytest.mark.parametrize("mix, small", [(MIXES[0], True), (MIXES[0], False), (MIXES[1], False), (MIXES[2], True)])
def test_every_draw_equals_the_plain_version(spark, docs, monkeypatch, mix, small):
    if not small:
        monkeypatch.setattr(mixing, "DRIVER_SOURCES", 0)
    rows = mixing.sized_rows(docs, ["doc_id"], "text", "doc_id", "source", mix.seed).select(F.col("__row.doc_id").alias("d"), "__source", "__tokens", "__h")
    by_source = defaultdict(list)
    for r in rows.collect():
        by_source[r["__source"]].append((r.d, r["__tokens"], r["__h"]))
    names = sorted(by_source)
    tokens = [sum(t for _, t, _ in by_source[s]) for s in names]
    budgets = dict(zip(names, mixing.solve(tokens, mix)[2], strict=True))
    asked = [(s, h, e, b) for s in names for _, _, h in by_source[s] for n in [max(1, math.ceil(sum(t for _, t, _ in by_source[s]) / mix.block_tokens))] for e in range(4) for b in range(n)]
    hashes = {}
    for r in spark.createDataFrame(sorted({(h, e, b) for _, h, e, b in asked}), "`__h` long, e long, b long").select("*", F.xxhash64("__h", F.lit(1)).alias("x"), mixing.block_order(F.col("e"), F.col("b"), mix.seed).alias("bo"), mixing.row_order("e").alias("ro")).collect():
        hashes[r["__h"], r.e, r.b] = (r.x, r.bo, r.ro)
    want = Counter()
    for s, total in zip(names, tokens, strict=True):
        left, epoch = budgets[s], 0
        n = max(1, math.ceil(total / mix.block_tokens))
        while left > 0:
            placed = []
            for d, t, h in by_source[s]:
                block = hashes[h, epoch, 0][0] % n
                placed.append((hashes[h, epoch, block][1], block, hashes[h, epoch, 0][2], h, d, t))
            for bo, block, ro, _, d, t in sorted(placed, key=lambda p: p[:4]):
                if left <= 0:
                    break
                want[s, d, epoch, block, bo, ro] += 1
                left -= t
            epoch += 1
    got = Counter((mixing.NONE if r.source is None else r.source, r.doc_id, r.epoch, r.block, r.block_order, r.order_key) for r in mixing.schedule(docs, mix).collect())
    assert got == want
