"""Near duplicates for the pipeline: SimHash groups first, then every other link of Jaccard similarity 0.8 or more.

Texts are sets of 5-word shingles; two are linked from a similarity of 0.8 on.
Operator 4 finds the groups: fingerprints over the shingles, linked at 3 bits or fewer
by its vantage-point trees, and each text is held against the first of its
group.  That finds most links of copies.  It can't find all: two texts as similar
as 0.8 differ in ten bits of 64 on average, and no tree prunes at such a radius.

The others come from the shingles themselves.  Under any common order of shingles two
such sets share one of the first n // 5 + 1 of each, so these prefixes are dealt, by
shingle, as 16 bytes each; only shingles whose texts aren't one component yet go on.  Shingles that are
frequent in a sample come last in the order, which keeps prefixes apart that have no
more than a common passage; the sample changes the work, never the links.

Candidates pass bounds that no linked pair fails (sizes, places in the order,
parity bits of the sets) and are then held against the whole sets.  A first round
holds each prefix shingle's texts against one of them; a second round
compares only those that are not in one component yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlog.llm.common import map_text
from skeinlog.llm.hamming_tree import contracted, first_of_each, hashes_of, keyed, majority, point_labels
from skeinlog.session import checkpointed, removed, shared_folder, written

WIDTH = 5
#: Rows that the order of shingles is sampled from, about, and frequent shingles that it knows, at most.
SAMPLE_ROWS = 4_096
FREQUENT = 200_000
#: Rows of shingles, points and pairs up to this many are broadcast (60 bytes each at most); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Dealt shingles that a task sorts, about (some 40 MB).
TASK_ROWS = 1 << 19


def shingles_of(text: str | None) -> np.ndarray:
    """Distinct shingles as sorted uint64; words as for fingerprints, a text of fewer words is one shingle, one without words has none."""
    return np.unique(hashes_of(text, WIDTH))


def name_of(shingles: np.ndarray) -> int:
    """The set's 64-bit name."""
    value = xxhash.xxh64_intdigest(shingles.tobytes())
    return value - (1 << 64) if value >> 63 else value


def prefix_of(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The first n // 5 + 1 shingles, rare ones first, and how many of them are not frequent."""
    k = len(shingles) // 5 + 1
    if not len(frequent):
        return shingles[:k], min(k, len(shingles))
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    often = np.where(frequent[at] == shingles, counts[at], 0)
    order = np.argsort(often, kind="stable")[:k]
    return shingles[order], int((often[order] == 0).sum())


def parity_of(shingles: np.ndarray) -> np.ndarray:
    """256 parity bits as four int64; they differ in no more bits than the sets do in shingles."""
    odd = np.bincount((shingles & np.uint64(255)).astype(np.int64), minlength=256).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def sketch_of(shingles: np.ndarray) -> bytes:
    """Parity bits, a power of two of them and n or more (64 at least); halves fold by XOR into the sketch of half the width."""
    width = max(64, 1 << max(0, len(shingles) - 1).bit_length())
    odd = np.bincount((shingles >> np.uint64(20) & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.packbits(odd).tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    bits = np.frombuffer(sketch, np.uint8)
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def may_link(x: bytes, y: bytes, n: int) -> bool:
    """False only if sets of ``n`` shingles together can't be as similar as 0.8: they would differ in no more than n / 9."""
    size = min(len(x), len(y))
    return 9 * int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= n


def _small(df: DataFrame, n: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if its rows are few."""
    return F.broadcast(df) if (df.count() if n is None else n) <= BROADCAST_ROWS else df


def plausible(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that pass the bound of the sketches."""
    held = points.select("point", "n", "sketch")
    both = pairs.join(held.toDF("a", "na", "x"), "a").join(held.toDF("b", "nb", "y"), "b").select("a", "b", "x", "y", (F.col("na") + F.col("nb")).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = pa.array([may_link(*r) for r in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)], strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(stays)

    return both.mapInArrow(run, "a long, b long")


def sets(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys``, ``name`` and ``shingles`` of every row."""

    def make():
        def work(texts):
            found = [shingles_of(t) for t in texts]
            return [[name_of(s) for s in found], [s.view(np.int64) for s in found]]

        return work

    return map_text(rows, keys, text, "name long, shingles array<bigint>", make)


def frequent_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of four distinct texts of the sample or more, sorted, and in how many they are."""
    share = SAMPLE_ROWS / max(1, rows.count())
    some = rows if share >= 1 else rows.where(F.xxhash64("__doc") <= int((2 * share - 1) * 2**63))
    held = sets(some, "__text", ["__doc"]).groupBy("name").agg(F.first("shingles").alias("shingles"))
    counted = held.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n >= 4")
    top = counted.orderBy(F.desc("n"), "s").limit(FREQUENT).toArrow()
    s, n = top.column("s").to_numpy().astype(np.int64).view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def verified(rows: DataFrame, points: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (``a`` > ``b``) whose sets have a Jaccard similarity of 0.8 or more.

    Sets are made from the texts again, for texts of candidates only.  While
    pairs are few they go to the texts, so that a set is shuffled once, to its partner.
    """
    pairs = checkpointed(plausible(points, pairs))
    n = pairs.count()
    first = points.select("point", F.col("low.doc").alias("__d"), F.col("low.th").alias("__t"))

    def side(name: str, column: str) -> DataFrame:
        wanted = first.join(pairs.select(F.col(name).alias("point")).distinct(), "point")
        chosen = rows.join(_small(wanted, n), F.expr("__doc = __d and __th = __t"))
        return sets(chosen, "__text", ["point"]).select(F.col("point").alias(name), F.col("shingles").alias(column))

    both = side("a", "x").join(_small(pairs, n), "a").join(side("b", "y"), "b")
    return checkpointed(both.where("9 * size(array_intersect(x, y)) >= 4 * (size(x) + size(y))").select("a", "b").distinct())


#: Bits of a shingle that are dealt; texts that meet by these alone are told apart when whole sets are compared.
S_BITS = 48
#: What linked sets satisfy, by their sizes and the places of a first shingle that their prefixes share, and by their parity bits.
PLACES = "5 * least({x}n, {y}n) >= 4 * greatest({x}n, {y}n) and 9 * least({x}n - {i}, {y}n - {j}) >= 4 * ({x}n + {y}n)"
PARITY = "9 * (bit_count(x_p0 ^ y_p0) + bit_count(x_p1 ^ y_p1) + bit_count(x_p2 ^ y_p2) + bit_count(x_p3 ^ y_p3)) <= x_n + y_n"


def _packed(names: DataFrame, *rest: str | Column) -> DataFrame:
    """``si`` (shingle and place), ``point``, ``other`` (the label, if it is another point) and ``rest``: what repeats or is zero costs a shuffle little.

    A place beyond the bits that are left only weakens its bound.
    """
    most = (1 << 64 - S_BITS) - 1
    return names.select(F.expr(f"s | shiftleft(least(cast(i as long), {most}L), {S_BITS})").alias("si"), "point", F.expr("nullif(label, point)").alias("other"), *rest)


def _shingle(side: str = "") -> str:
    return f"({side}si & {(1 << S_BITS) - 1}L)"


def _place(side: str = "") -> str:
    return f"shiftrightunsigned({side}si, {S_BITS})"


def _apart(names: DataFrame, n: int, **more: Column) -> DataFrame:
    """The rows (``n`` at most) of shingles (``s``) whose rows differ in ``label``, with the aggregates ``more`` over the shingle.

    Rows of rare shingles meet once; those of frequent ones (``hot``), which are bounded in number, are summed up before they meet.
    """
    ends = {"l": F.min("label"), "h": F.max("label")}
    rest = [c for c in names.columns if c not in ("s", "i", "point", "label", "hot")]
    dealt = _packed(names.where("not hot"), *rest).repartition(n // TASK_ROWS + 1, F.expr(_shingle()))
    dealt = dealt.select(F.expr(_shingle()).alias("s"), F.expr(f"cast({_place()} as int)").alias("i"), "point", F.coalesce("other", "point").alias("label"), *rest)
    once = Window.partitionBy("s")
    cold = dealt.withColumns({c: e.over(once) for c, e in {**ends, **more}.items()}).where("l < h").withColumn("hot", F.lit(False))
    often = names.where("hot").groupBy("s").agg(*[e.alias(c) for c, e in {**ends, **more}.items()]).where("l < h")
    hot = names.where("hot").join(F.broadcast(often), "s")
    return cold.unionByName(hot).drop("l", "h")


def _found(df: DataFrame, text: str, doc: str) -> DataFrame:
    """``__doc``, ``__th`` and ``low`` (the first row of its component by id and text) of every row with an id."""
    rows = keyed(df, text, doc).where("__doc is not null")
    frequent, counts = frequent_shingles(rows)

    def make():
        def work(texts):
            hashes = [hashes_of(t, WIDTH) for t in texts]
            found = [np.unique(h) for h in hashes]
            parity = [parity_of(s) for s in found]
            fps = np.array([majority(h) for h in hashes], np.uint64).view(np.int64)
            prefixes = [prefix_of(s, frequent, counts) for s in found]
            return [[name_of(s) for s in found], [len(s) for s in found], fps, *[[p[i] for p in parity] for i in range(4)], [sketch_of(s) for s in found], [p.view(np.int64) for p, _ in prefixes], [r for _, r in prefixes]]

        return work

    folder = shared_folder(df.sparkSession)
    schema = "name long, n int, fp long, p0 long, p1 long, p2 long, p3 long, sketch binary, prefix array<bigint>, rare int"
    try:
        # rows are numbered, and a set goes by the number of its first row: such numbers are small, and lie close together where they are shuffled
        made = written(map_text(rows, ["__doc", "__th"], "__text", schema, make).withColumn("row", F.monotonically_increasing_id()), f"{folder}/made")
        named = checkpointed(made.select("__doc", "__th", "name"))
        columns = ["n", "p0", "p1", "p2", "p3"]
        low = F.min(F.struct(F.col("__doc").alias("doc"), F.col("__th").alias("th"), "row"))
        points = made.groupBy("name").agg(low.alias("low"), *[F.first(c).alias(c) for c in [*columns, "fp", "sketch"]])
        points = checkpointed(points.withColumn("point", F.col("low.row")))
        size, n = points.agg(F.count("*"), F.coalesce(F.sum(F.expr("n div 5 + 1")), F.lit(0))).first()

        # groups of fingerprints
        groups = point_labels(points.select("fp").distinct())
        grouped = points.select("point", "fp").join(groups, "fp", "left").select("point", F.coalesce("label", "fp").alias("label"))
        centre = grouped.groupBy("label").agg(F.min("point").alias("b"), F.max("point").alias("top")).where("b < top").select("label", "b")
        copies = grouped.join(centre, "label").where("point > b").select(F.col("point").alias("a"), "b")
        links = verified(rows, points, copies)

        # shingles whose texts aren't one component yet, with the lowest text that has them
        labels = contracted(links)
        labelled = checkpointed(points.select("point", *columns).join(labels, F.col("point") == F.col("a"), "left").select("point", F.coalesce("label", "point").alias("label"), *columns))
        # one row a set: repeated ones aren't dealt
        names = made.select("row", "prefix", "rare").join(_small(labelled.select("point", "label"), size), F.col("row") == F.col("point"))
        names = names.select("point", "label", "rare", F.posexplode("prefix").alias("i", "s")).select(F.expr(f"s & {(1 << S_BITS) - 1}L").alias("s"), "i", "point", "label", F.expr("i >= rare").alias("hot"))
        first = F.min(F.struct("point", "label", "i"))
        told = ["s", "point", "label", "i", "hot", F.col("first.point").alias("low"), F.col("first.label").alias("llow"), F.col("first.i").alias("ilow")]
        dealt = written(_apart(names, n, first=first).select(*told), f"{folder}/dealt")
        held = labelled.select("point", *columns)

        def bounded(pairs: DataFrame, bounds: str) -> DataFrame:
            x, y = (_small(held, size).select(F.col("point").alias(k), *[F.col(c).alias(f"{side}_{c}") for c in columns]) for k, side in ("ax", "by"))
            return pairs.join(x, "a").join(y, "b").where(bounds).select("a", "b")

        stars = dealt.where("point > low and label <> llow").groupBy(F.col("point").alias("a"), F.col("low").alias("b")).agg(F.min("i").alias("i"), F.min("ilow").alias("j"))
        stars = bounded(stars, PLACES.format(x="x_", y="y_", i="i", j="j") + " and " + PARITY)
        links = checkpointed(links.unionByName(verified(rows, points, stars)))
        now = contracted(links).select(F.col("a").alias("was"), F.col("label").alias("now"))
        later = dealt.select("s", "point", "i", "hot", "low").join(_small(now), F.col("point") == F.col("was"), "left")
        later = _apart(later.select("s", "point", "i", "hot", "low", F.coalesce("now", "point").alias("label")), dealt.count())
        later = written(_packed(later.join(_small(held.select("point", "n"), size), "point"), "n", F.expr("point > low").alias("y")), f"{folder}/later")
        # pairs with the shingle's lowest text are settled by the first round
        x, y = later.alias("x"), later.where("y").alias("y")
        places = PLACES.format(x="x.", y="y.", i=_place("x."), j=_place("y."))
        rest = x.join(y, F.expr(f"{_shingle('x.')} = {_shingle('y.')} and x.point > y.point and coalesce(x.other, x.point) <> coalesce(y.other, y.point) and {places}"))
        rest = bounded(rest.select(F.col("x.point").alias("a"), F.col("y.point").alias("b")).distinct(), PARITY)
        joined = contracted(links.unionByName(verified(rows, points, rest)))
    finally:
        # all that is left is checkpointed
        removed(df.sparkSession, folder)
    known = points.select("name", "point", "low").join(joined, F.col("point") == F.col("a"), "left").select("name", "low", F.coalesce("label", "point").alias("label"))
    low = known.groupBy("label").agg(F.min("low").alias("low"))
    return named.join(known.select("name", "label").join(low, "label"), "name").select("__doc", "__th", "low")


def components(df: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """``doc`` and ``component_id`` (the smallest id reachable over links of similarity 0.8 or more) of every row with an id.

    Rows without an id take no part.  Texts without words have equal (empty)
    sets and are one component.  Repeated rows give repeated results.
    """
    return _found(df, text, doc).select(F.col("__doc").alias(doc), F.col("low.doc").alias("component_id"))


def one_of_each(df: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """One row of each component, the first by id and text, with the columns of ``df``.

    Rows without an id stay.  Repeated rows (of one id and text) stay as one; rows
    that share an id but not the text are documents of their own.
    """
    return first_of_each(df, _found(df, text, doc), text, doc)
