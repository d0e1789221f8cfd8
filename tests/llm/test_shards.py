"""Operator 4: no task grows beyond its bound, every pair meets, and rows are told apart by id and text."""

import numpy as np
import pytest

from skeinlog.llm import hamming_tree as H


def sizes(points, sample, wanted):
    tree = H.Tree(sample, max(0, (wanted - 1).bit_length()))
    homes, guests = np.zeros((2, tree.shards), np.int64)
    routed = list(tree.route(points))
    for shard, at, home in routed:
        (homes if home else guests)[shard] += len(at)
    deal = H.Deal(homes, guests, H.SHARD_POINTS)
    tasks = {}
    for shard, at, home in routed:
        for task, places, _ in deal.tasks(shard, points[at], home):
            tasks[task] = tasks.get(task, 0) + len(places)
    return tree, int(homes.sum()), tasks


@pytest.mark.parametrize("kind", ["random", "one cluster"])
def test_tasks_stay_bounded_at_a_million_points(kind):
    rnd = np.random.default_rng(3)
    points = rnd.integers(0, 1 << 64, 1_000_000, np.uint64)
    if kind == "one cluster":  # all points differ from one in some of 24 bits: no border tells them apart
        points = np.unique(np.uint64(0x123456789ABCDEF) ^ (points & np.uint64(0xFFFFFF)))
    wanted = -(-len(points) // H.SHARD_POINTS)
    tree, home, tasks = sizes(points, points[: max(H.SAMPLE_POINTS, H.SAMPLE_SHARD * wanted)], wanted)
    assert home == len(points)
    assert max(tasks.values()) < 2 * H.SHARD_POINTS


def test_every_pair_within_the_radius_meets():
    rnd = np.random.default_rng(4)
    points = rnd.integers(0, 1 << 64, 400, np.uint64)
    flips = [np.uint64(0)] + [np.uint64(1) << np.uint64(b) for b in range(64)]
    points = np.unique(np.concatenate([points, points ^ flips[3] ^ flips[40], points[:100] ^ flips[7] ^ flips[9] ^ flips[60]]))
    tree = H.Tree(points, 4)
    homes, guests = np.zeros((2, tree.shards), np.int64)
    for shard, at, home in tree.route(points):
        (homes if home else guests)[shard] += len(at)
    for bound in (15, 40, 10_000):
        deal = H.Deal(homes, guests, bound)
        tasks = {}
        for shard, at, home in tree.route(points):
            for task, places, part in deal.tasks(shard, points[at], home):
                tasks.setdefault(task, []).extend((int(p), part) for p in points[at][places])
        met = set()
        for held in tasks.values():
            own = [p for p, part in held if part < 2]
            others = [p for p, part in held if part == 2] + (own if all(part != 1 for _, part in held) else [])
            met |= {(min(a, b), max(a, b)) for a in own for b in others if a != b and (a ^ b).bit_count() <= 3}
        values = points.tolist()
        assert met == {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 3}


def test_rows_of_one_id_with_other_texts_are_not_lost(spark):
    first, second = "alpha beta gamma delta " * 5, "quite another text with words of its own here"
    rows = [(1, first), (1, second), (1, first), (2, first), (3, second + " end"), (0, "zero on its own"), (None, first)]
    kept = H.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in kept)) == sorted([(False, 0, rows[5][1]), (False, 1, first), (False, 1, second), (False, 3, second + " end"), (True, 0, first)])
