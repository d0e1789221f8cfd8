"""Operator 4: SimHash fingerprints and near duplicates by vantage-point trees.

Fingerprints of whole texts are 64 bits over XXH64 of 3-word shingles.  Equal
fingerprints are one point.  The points are cut into shards by a
vantage-point tree over Hamming distance that is fitted on a sample which grows
with the number of shards; a point goes to the shard it lies in and, as a guest, to
every other shard on the far side of a border that the triangle bound can't rule
out.  Random fingerprints lie almost equally far from any vantage point, so borders
catch many guests.  Points and guests of every shard are therefore counted first, and
a shard that holds more than a task should is dealt in blocks: each block of its
points meets its guests and its other blocks in tasks of their own.  Each task
searches its points by trees of its own and joins what lies within the radius.
Components that share a point across tasks are then joined by a distributed
contraction.  Every link within the radius is found; nothing is approximate.

A large group of near copies is never expanded into pairs: a shard keeps labels,
skips branches whose points already share one, and hands on one row per point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.llm.common import map_text, whole
from skeinlog.session import checkpointed

RADIUS = 3
#: Points of a shard, about; no task gets more than twice as many.
SHARD_POINTS = 65_536
#: Points of the sample that the shards' tree is fitted on: so many, or so many a shard if that is more (1 in 4,096 of all points).
SAMPLE_POINTS, SAMPLE_SHARD = 8_192, 16
#: Points that are sent to their shards at a time.
ROUTE_POINTS = 1 << 18
#: Points that are compared directly.
LEAF = 256


def fingerprints_of(texts: list[str | None], width: int = 3) -> np.ndarray:
    """SimHash of each text as uint64.

    A-Z become lower case, words are runs other than U+0020 and U+0009 to
    U+000D, shingles are ``width`` words with repeats; a text of fewer words is
    one shingle and a text without words has fingerprint zero.
    """
    return np.array([majority(hashes_of(text, width)) for text in texts], np.uint64)


def hashes_of(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of a text's shingles in order, repeats included."""
    words = (text or "").encode().lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= width:
        return np.array([digest(join(words), 42)] if words else [], np.uint64)
    return np.fromiter((digest(join(t), 42) for t in zip(*[words[i:] for i in range(width)], strict=False)), np.uint64, len(words) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """``keys`` and ``fp`` (the fingerprint's 64 bits as a signed long) of every row."""

    def make():
        return lambda texts: [fingerprints_of(texts).view(np.int64)]

    return map_text(df, keys or ["doc_id"], text, "fp long", make)


# the shards' tree


class Tree:
    """A vantage-point tree in arrays: a node's vantage point, border and children; a child under zero is shard ~child."""

    def __init__(self, sample: np.ndarray, depth: int, radius: int = RADIUS, candidates: int = 8):
        """Of some vantage points and of the borders that put a quarter to three quarters inside, the one with the fewest
        sample points within the radius of the border is taken, so that groups are not cut through their middle."""
        vantage, border, inner, outer = [], [], [], []
        self.shards = 0

        def leaf() -> int:
            self.shards += 1
            return -self.shards

        def best_cut(points: np.ndarray):
            best = None
            for v in points[:: max(1, len(points) // candidates)][:candidates]:
                d = np.bitwise_count(points ^ v).astype(np.int64)
                below = np.concatenate(([0], np.cumsum(np.bincount(d, minlength=65))))
                for e in range(1, 65):
                    if len(points) <= 4 * below[e] <= 3 * len(points):
                        near = below[min(65, e + radius)] - below[max(0, e - radius)]
                        if best is None or near < best[0]:
                            best = (near, v, e, d < e)
            return best

        def grow(points: np.ndarray, left: int) -> int:
            best = best_cut(points) if left and len(points) >= 8 else None
            if best is None or best[0] > 0.9 * len(points):
                return leaf()
            at = len(vantage)
            vantage.append(best[1]), border.append(best[2]), inner.append(0), outer.append(0)
            inner[at] = grow(points[best[3]], left - 1)
            outer[at] = grow(points[~best[3]], left - 1)
            return at

        self.root = grow(np.unique(sample), depth)
        self.vantage, self.border = np.array(vantage, np.uint64), np.array(border, np.int8)
        self.inner, self.outer = np.array(inner, np.int32), np.array(outer, np.int32)
        self.radius = radius

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(shard, places in ``points``, whether they live there); a pair within the radius meets in the home of one of them."""
        todo = [(self.root, np.arange(len(points)), True)]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if node < 0:
                yield ~node, at, home
                continue
            d = np.bitwise_count(points[at] ^ self.vantage[node]).astype(np.int16)
            border, inner, outer = int(self.border[node]), int(self.inner[node]), int(self.outer[node])
            if home:
                inside = d < border
                todo += [(inner, at[inside], True), (outer, at[~inside], True), (outer, at[inside & (d >= border - self.radius)], False)]
            else:
                todo += [(inner, at[d < border + self.radius], False), (outer, at[d >= border - self.radius], False)]


class Deal:
    """How the points and guests of counted shards are dealt to tasks.

    A shard's homes are cut into ``home_blocks`` and its guests into ``guest_blocks`` by
    hash.  Home block a meets its partners (home blocks before it, then the guest blocks)
    one task each; the first of these tasks also searches the block itself.
    """

    def __init__(self, homes: np.ndarray, guests: np.ndarray, shard_points: int):
        # blocks are filled by hash, so they are planned somewhat smaller than they may be
        room = max(1, int(0.9 * shard_points))
        self.home_blocks = np.maximum(1, -(-homes // room))
        self.guest_blocks = -(-guests // room)
        h, g = self.home_blocks, self.guest_blocks
        tasks = h * (h - 1) // 2 + h * g + (g == 0)
        self.start = np.concatenate(([0], np.cumsum(tasks)[:-1])) if len(tasks) else tasks

    def task(self, shard: int, block: int, partner: int) -> int:
        """Number of the task in which a home block meets its ``partner``-th partner."""
        g = int(self.guest_blocks[shard])
        before = block * (block - 1) // 2 + block * g
        # without guests block 0 has no partner, but a task of its own
        return int(self.start[shard]) + before + partner + (g == 0 and block > 0)

    def tasks(self, shard: int, points: np.ndarray, home: bool) -> Iterator[tuple[int, np.ndarray, int]]:
        """(task, places in ``points``, part) for points of a shard; part 0: homes that are searched, 1: homes that are only met by guests, 2: guests."""
        h, g = int(self.home_blocks[shard]), int(self.guest_blocks[shard])
        blocks = h if home else g
        own = (_spread(points) % np.uint64(blocks)).astype(np.int64) if blocks > 1 else np.zeros(len(points), np.int64)
        for b in range(blocks):
            at = np.flatnonzero(own == b) if blocks > 1 else np.arange(len(points))
            if not len(at):
                continue
            if not home:
                for a in range(h):
                    yield self.task(shard, a, a + b), at, 2
                continue
            for k in range(max(1, b + g)):
                yield self.task(shard, b, k), at, 0 if k == 0 else 1
            for a in range(b + 1, h):
                yield self.task(shard, a, b), at, 2


def _spread(points: np.ndarray) -> np.ndarray:
    x = points * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x >> np.uint64(32)


# the search within a shard


class Links:
    """Labels of points; those that are linked, directly or not, end with one label."""

    def __init__(self, points: np.ndarray, radius: int = RADIUS):
        self.points, self.radius = points, radius
        self.label = np.arange(len(points))

    def _root(self, at: np.ndarray) -> np.ndarray:
        r = self.label[at]
        while True:
            up = self.label[r]
            if (up == r).all():
                self.label[at] = r
                return r
            r = up

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self._root(a), self._root(b)
            apart = a != b
            a, b = a[apart], b[apart]
            if len(a):
                np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))

    def one(self, *groups: np.ndarray) -> bool:
        roots = [self._root(g) for g in groups]
        return all((r == roots[0][0]).all() for r in roots)

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        rows = max(1, (1 << 20) // max(1, len(b)))
        for i in range(0, len(a), rows):
            some = a[i : i + rows]
            x, y = np.nonzero(np.bitwise_count(self.points[some][:, None] ^ self.points[b][None, :]) <= self.radius)
            self.unite(some[x], b[y])

    def _cut(self, at: np.ndarray) -> tuple[np.ndarray, int]:
        """Distances to a vantage point of ``at`` and the border that cuts it best."""
        d = np.bitwise_count(self.points[at] ^ self.points[at[len(at) // 2]]).astype(np.int64)
        return d, int(np.median(d))

    def search(self, homes: np.ndarray, guests: np.ndarray, own: bool = True) -> None:
        """Link all pairs between ``homes`` and ``guests``, and within ``homes`` unless that is done elsewhere."""
        todo = [(homes, None), (guests, homes)] if own else [(guests, homes)]
        while todo:
            a, b = todo.pop()
            if not len(a) or (b is not None and not len(b)):
                continue
            if b is None:
                if len(a) <= LEAF:
                    self.compare(a, a)
                    continue
                if self.one(a):
                    continue
                d, border = self._cut(a)
                ball = d <= self.radius
                self.unite(np.full(int(ball.sum()), a[len(a) // 2]), a[ball])
                if border == 0 or not (d < border).any():
                    border += 1
                inside = d < border
                if inside.all():
                    self.compare(a, a)
                    continue
                todo += [(a[inside], None), (a[~inside], None), (a[inside & (d >= border - self.radius)], a[~inside & (d < border + self.radius)])]
            else:
                if len(a) * len(b) <= LEAF * LEAF:
                    self.compare(a, b)
                    continue
                if self.one(a, b):
                    continue
                both = np.concatenate((a, b))
                d, border = self._cut(both)
                da, db = d[: len(a)], d[len(a) :]
                if not (d < border).any():
                    border += 1
                if (d < border).all():
                    self.compare(a, b)
                    continue
                r, ia, ib = self.radius, da < border, db < border
                parts = [(a[ia], b[ib]), (a[~ia], b[~ib]), (a[ia & (da >= border - r)], b[~ib & (db < border + r)]), (a[~ia & (da < border + r)], b[ib & (db >= border - r)])]
                if max(len(x) * len(y) for x, y in parts) > 0.95 * len(a) * len(b):
                    self.compare(a, b)
                else:
                    todo += parts


def shard_labels(homes: np.ndarray, guests: np.ndarray, radius: int = RADIUS, own: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Points of groups of two or more, and the smallest point of each one's group, as seen from one task."""
    points = np.concatenate((np.sort(homes), np.sort(guests)))
    links = Links(points, radius)
    links.search(np.arange(len(homes)), np.arange(len(homes), len(points)), own)
    root = links._root(np.arange(len(points)))
    many = np.bincount(root, minlength=len(points))[root] > 1
    smallest = np.full(len(points), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(smallest, root, points)
    return points[many], smallest[root][many]


#: Links up to this many are contracted in one task (16 bytes each); more in rounds of joins.
TASK_LINKS = 1_000_000


def _contracted_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of the links that isn't its component's smallest, and that one."""
    held = [(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)) for b in batches]
    a, b = (np.concatenate([np.zeros(0, np.int64), *[h[i] for h in held]]) for i in (0, 1))
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    links = Links(nodes.view(np.uint64))
    links.unite(place[: len(a)], place[len(a) :])
    root = links._root(np.arange(len(nodes)))
    more = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[more]), pa.array(nodes[root[more]])], names=["a", "label"])


def contracted(links: DataFrame) -> DataFrame:
    """``a``, ``label``: connected components of distinct links (a > b), every node but a component's smallest with that one.

    Up to ``TASK_LINKS`` links are joined in one task.  More are contracted by stars:
    each round points the larger neighbours of a node, then the smaller ones, at
    the smallest.  Rounds grow with the logarithm of the longest chain.  Each
    round is checkpointed, so a lost executor costs one round.
    """
    links = checkpointed(links)
    size = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    if size[0] <= TASK_LINKS:
        return checkpointed(links.select("a", "b").coalesce(1).mapInArrow(_contracted_here, "a long, label long"))
    while size[0]:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(down, "a")
        small = joined.where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(down.select("a", F.col("low").alias("b")))
        links = checkpointed(small.distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == size:
            break
        size = now
    return links.select("a", F.col("b").alias("label"))


def point_labels(points: DataFrame, radius: int = RADIUS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """``fp``, ``label`` of the points (distinct ``fp``) that have a neighbour; a group's points share its smallest point as label."""
    n = points.count()
    wanted = -(-n // shard_points)
    sample = np.zeros(0, np.uint64)
    if wanted > 1:
        size = max(SAMPLE_POINTS, SAMPLE_SHARD * wanted)
        edge = int((2 * min(1.0, size / n) - 1) * 2**63)
        some = points.select("fp").where(F.xxhash64("fp") <= F.lit(min(edge, 2**63 - 1)))
        sample = some.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)
    tree = Tree(sample, max(0, (wanted - 1).bit_length()), radius)
    sent = points.sparkSession.sparkContext.broadcast(tree)

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            size += len(held[-1])
            if size >= ROUTE_POINTS:
                yield np.concatenate(held)
                held, size = [], 0
        if size:
            yield np.concatenate(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, sent.value.shards), np.int64)
        for some in batched(batches):
            for shard, at, home in sent.value.route(some):
                total[1 - home, shard] += len(at)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], names=["shard", "homes", "guests"])

    homes, guests = np.array([n]), np.array([0])
    if wanted > 1:
        counted = points.select("fp").mapInArrow(count, "shard long, homes long, guests long").groupBy("shard").agg(F.sum("homes").alias("homes"), F.sum("guests").alias("guests")).toArrow()
        homes, guests = np.zeros((2, tree.shards), np.int64)
        at = counted.column("shard").to_numpy()
        homes[at], guests[at] = counted.column("homes").to_numpy(), counted.column("guests").to_numpy()
    dealt = points.sparkSession.sparkContext.broadcast(Deal(homes, guests, shard_points))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batched(batches):
            for shard, at, home in sent.value.route(some):
                held = some[at]
                for task, places, part in dealt.value.tasks(shard, held, home):
                    m = len(places)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, task)), pa.array(held[places].view(np.int64)), pa.array(np.full(m, part, np.int8))], names=["task", "fp", "part"])

    def search(table: pa.Table) -> pa.Table:
        held, part = table.column("fp").to_numpy().view(np.uint64), table.column("part").to_numpy()
        fp, label = shard_labels(held[part < 2], held[part == 2], radius, not (part == 1).any())
        return pa.table({"fp": fp.view(np.int64), "label": label.view(np.int64)})

    routed = points.select("fp").mapInArrow(route, "task long, fp long, part byte")
    seen = checkpointed(routed.groupBy("task").applyInArrow(search, "fp long, label long"))
    first = seen.groupBy("fp").agg(F.min("label").alias("first"))
    between = seen.join(first, "fp").where("label <> first").select(F.greatest("label", "first").alias("a"), F.least("label", "first").alias("b")).distinct()
    joined = contracted(between)
    return first.join(joined, F.col("first") == F.col("a"), "left").select("fp", F.coalesce(joined["label"], F.col("first")).alias("label"))


def keyed(df: DataFrame, text: str, doc: str) -> DataFrame:
    """``__doc``, ``__th`` and ``__text`` of every row: rows are one document if they share the id and the text."""
    return df.select(F.col(f"`{doc}`").alias("__doc"), F.xxhash64(whole(text)).alias("__th"), F.col(f"`{text}`").cast("string").alias("__text"))


def _found(df: DataFrame, text: str, keys: list[str], low: Column, radius: int, shard_points: int) -> DataFrame:
    """``keys``, ``fp`` and ``low`` (the aggregate over its component) of every row."""
    made = checkpointed(fingerprints(df, text, keys))
    points = made.groupBy("fp").agg(low.alias("low"))
    labels = checkpointed(point_labels(points, radius, shard_points))
    groups = labels.join(points, "fp").groupBy("label").agg(F.min("low").alias("component"))
    linked = labels.join(groups, "label").select("fp", "component")
    # exact copies alone need no link: their component is the smallest row of the point
    known = points.join(linked, "fp", "left").select("fp", F.coalesce("component", "low").alias("low"))
    # a group of copies may hold a third of the rows: adaptive execution splits that partition of this plain join
    return made.join(known, "fp")


def smallest() -> Column:
    """The first row of a group by id and text; rows without an id come last."""
    return F.min(F.struct(F.col("__doc").isNull().alias("none"), F.col("__doc").alias("doc"), F.col("__th").alias("th")))


def components(df: DataFrame, text: str = "text", doc: str = "doc_id", radius: int = RADIUS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """``doc``, ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest id reachable) of every row.

    Null and empty texts, and texts of white space, have fingerprint zero and
    are linked like any other.  Rows with a null id take part; their component
    is null only if no linked row has an id.  Repeated rows give repeated
    results; an empty table gives an empty one; other columns are not read.
    """
    named = df.select(F.col(f"`{doc}`").alias("__doc"), F.col(f"`{text}`").alias("__text"))
    found = _found(named, "__text", ["__doc"], F.min("__doc"), radius, shard_points)
    return found.select(F.col("__doc").alias(doc), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("low").alias("component_id"))


#: Rows up to this many are broadcast to be taken out (24 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def one_of_each(df: DataFrame, text: str = "text", doc: str = "doc_id", radius: int = RADIUS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """One row of each component, the first by id and text, with the columns of ``df``.

    Rows without an id stay.  Repeated rows (of one id and text) stay as one;
    rows that share an id but not the text are documents of their own.
    """
    return first_of_each(df, _found(keyed(df, text, doc), "__text", ["__doc", "__th"], smallest(), radius, shard_points), text, doc)


def first_of_each(df: DataFrame, found: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that are first in their component in ``found`` (``__doc``, ``__th``, ``low``)."""
    first = F.expr("low.doc <=> __doc and low.th = __th")
    per_row = checkpointed(found.where("__doc is not null").groupBy("__doc", "__th").agg(F.count("*").alias("n"), F.bool_or(~first).alias("gone")).where("gone or n > 1"))
    sizes = per_row.agg(F.count_if(F.expr("gone")).alias("gone"), F.count_if(F.expr("not gone")).alias("twice")).first()
    same = F.expr("__d = __doc and __t = __th")
    marked = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.col(f"`{doc}`").alias("__d"), F.xxhash64(whole(text)).alias("__t"))
    pick = lambda rows, n: (F.broadcast(rows) if n <= BROADCAST_IDS else rows).select("__doc", "__th")
    kept = marked.join(pick(per_row.where("gone"), sizes.gone), same, "left_anti")
    if sizes.twice:
        twice = pick(per_row.where("not gone"), sizes.twice)
        kept = kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["__d", "__t"]))
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in df.columns])
