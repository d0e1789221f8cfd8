"""Operator 10: temperature mixing of sources to target weights.

Source shares are raised to an exponent and normalised.  An exponent of 0 makes
the sources even, 1 leaves the shares as they are, and a larger one sharpens them;
entropy falls with the exponent, so the exponent is bisected between 0 and
``MAX_EXPONENT`` until the mix has the target entropy.  If a source would then be
repeated more often than ``max_epochs``, the exponent is bisected between that one and 1
(where no source is repeated more often than another) for the limit instead; ``met`` says
which of the two holds.  The weights become token budgets; a budget is filled by
permutations of the source's blocks, epoch after epoch.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlog.llm.common import whole
from skeinlog.session import checkpointed, removed, shared_folder, written

NONE = "\x00none"
#: Beyond this exponent a mix is its largest sources alone for any practical purpose.
MAX_EXPONENT = 64.0


@dataclass(frozen=True)
class Mix:
    """Target of a mix.

    ``entropy`` is the wanted share (0 to 1) of the greatest entropy;
    ``max_epochs`` bounds how often a source is repeated.  ``cover`` takes the
    smallest budget that holds every document once; without it the budget is
    ``budget`` times the tokens that there are.
    """

    entropy: float = 1.0
    max_epochs: float = 2.0
    budget: float = 1.0
    cover: bool = False
    seed: int = 7
    block_tokens: int = 1 << 20


@dataclass(frozen=True)
class Sums:
    """What a mix is solved from: all tokens, sources that have any, the least and greatest tokens of one, and
    for an exponent the logarithm of the sum of raised shares and the mean logarithm of a share under the weights."""

    total: int
    live: int
    least: int
    most: int
    raised: Callable[[list[float]], list[tuple[float, float]]]


def weights(shares: list[float], exponent: float) -> list[float]:
    top = max((s for s in shares if s > 0), default=1.0)
    raised = [(s / top) ** exponent if s > 0 else 0.0 for s in shares]
    total = math.fsum(raised)
    return [r / total for r in raised] if total else raised


def entropy(w: list[float]) -> float:
    return -math.fsum(x * math.log(x) for x in w if x > 0)


def epochs(tokens: list[int], w: list[float], mix: Mix) -> list[float]:
    """How often each source is repeated under weights ``w``."""
    total = sum(tokens)
    budget = max((t / x for t, x in zip(tokens, w, strict=True) if x > 0), default=0.0) if mix.cover else mix.budget * total
    return [budget * x / t if t else 0.0 for t, x in zip(tokens, w, strict=True)]


def sums_of(tokens: list[int]) -> Sums:
    """Sums over a list of the sources' tokens."""
    some = [t for t in tokens if t > 0]
    total, most = sum(some), max(some, default=0)

    def raised(exponents: list[float]) -> list[tuple[float, float]]:
        out = []
        for e in exponents:
            r = [(t / most) ** e for t in some]
            z = math.fsum(r)
            out.append((math.log(z) + e * math.log(most / total), math.fsum(x * math.log(t / total) for x, t in zip(r, some, strict=True)) / z))
        return out

    return Sums(total, len(some), min(some, default=0), most, raised)


def sums_over(totals: DataFrame) -> Sums:
    """As ``sums_of`` over a table with the sources' tokens in ``t``: one aggregation for any number of exponents."""
    some = totals.where("t > 0")
    r = some.agg(F.sum("t").alias("total"), F.count("*").alias("live"), F.min("t").alias("least"), F.max("t").alias("most")).first()
    total, most = r.total or 0, r.most or 0

    def raised(exponents: list[float]) -> list[tuple[float, float]]:
        power = lambda e: F.pow(F.col("t") / F.lit(float(most)), F.lit(e))
        made = some.agg(*[x for i, e in enumerate(exponents) for x in (F.sum(power(e)).alias(f"z{i}"), F.sum(power(e) * F.log(F.col("t") / F.lit(float(total)))).alias(f"l{i}"))]).first()
        return [(math.log(made[f"z{i}"]) + e * math.log(most / total), made[f"l{i}"] / made[f"z{i}"]) for i, e in enumerate(exponents)]

    return Sums(total, r.live, r.least or 0, most, raised)


def _entropy_at(exponent: float, found: tuple[float, float]) -> float:
    return found[0] - exponent * found[1]


def _epochs_at(sums: Sums, mix: Mix, exponent: float, found: tuple[float, float]) -> float:
    """How often the most repeated source is repeated: the least one under an exponent below 1, the greatest one above."""
    low, high = math.log(sums.least / sums.total), math.log(sums.most / sums.total)
    most = (exponent - 1) * (low if exponent < 1 else high)
    if mix.cover:
        return math.exp(most + (1 - exponent) * (high if exponent < 1 else low))
    return mix.budget * math.exp(most - found[0])


def _section(sums: Sums, good: Callable[[float, tuple], bool], bad: float, fine: float, width: int) -> float:
    """The exponent nearest to ``bad`` that is good; ``fine`` is good, and what lies between it and a good one too."""
    for _ in range(math.ceil(60 / math.log2(width + 1))):
        tried = [bad + (fine - bad) * k / (width + 1) for k in range(1, width + 1)]
        for e, found in zip(tried, sums.raised(tried), strict=True):
            if good(e, found):
                fine = e
                break
            bad = e
    return fine


def solved(sums: Sums, mix: Mix, width: int = 1) -> tuple[float, str]:
    """Exponent, and what it meets: ``entropy``, ``epochs`` (the repetition limit binds) or ``neither``."""
    if not sums.total:
        return 1.0, "neither"
    top = mix.entropy * math.log(sums.live)
    flat = lambda e, found: _entropy_at(e, found) <= top + 1e-12
    few = lambda e, found: _epochs_at(sums, mix, e, found) <= mix.max_epochs + 1e-12
    at = lambda e: sums.raised([e])[0]
    if sums.live < 2 or sums.least == sums.most:
        # every exponent gives the same weights
        return 1.0, "entropy" if few(1.0, at(1.0)) and (sums.live < 2 or mix.entropy >= 1) else "neither"
    exponent, met = (0.0, "entropy") if flat(0.0, at(0.0)) else (MAX_EXPONENT, "entropy")
    if exponent:
        if flat(MAX_EXPONENT, at(MAX_EXPONENT)):
            exponent = _section(sums, flat, 0.0, MAX_EXPONENT, width)
        else:
            met = "neither"
    if few(exponent, at(exponent)):
        return exponent, met
    if not few(1.0, at(1.0)):
        return 1.0, "neither"
    return _section(sums, few, exponent, 1.0, width), "epochs"


def solve(tokens: list[int], mix: Mix) -> tuple[float, list[float], list[int]]:
    """Exponent, weights and token budgets of the sources."""
    total = sum(tokens)
    exponent, _ = solved(sums_of(tokens), mix)
    if not total:
        return exponent, [0.0] * len(tokens), [0] * len(tokens)
    w = weights([t / total for t in tokens], exponent)
    return exponent, w, [math.floor(e * t + 0.5) for e, t in zip(epochs(tokens, w, mix), tokens, strict=True)]


def word_tokens(text: str = "text") -> Column:
    """White-space words of a text; an empty or null text counts one, so that every row has a place."""
    trimmed = F.btrim(whole(text), F.lit(" \t\n\x0b\f\r"))
    return F.greatest(F.lit(1), F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


#: Sources up to this many are solved on the driver and broadcast (under 200 bytes each); more are solved by aggregation and joined by shuffle.
DRIVER_SOURCES = 50_000


@dataclass(frozen=True)
class Plan:
    """``table``: one row a source with ``tokens``, ``weight`` and ``budget``; the exponent and entropy of the mix and what it meets."""

    table: DataFrame
    small: bool
    exponent: float
    entropy: float
    met: str


def plan(narrow: DataFrame, mix: Mix) -> Plan:
    """Solve the mix over (``__source``, ``__tokens``) rows; totals reach the driver only if sources are few."""
    totals = checkpointed(narrow.groupBy("__source").agg(F.sum("__tokens").alias("t")))
    small = totals.count() <= DRIVER_SOURCES
    sums = sums_of([r.t for r in totals.select("t").collect()]) if small else sums_over(totals)
    exponent, met = solved(sums, mix, 1 if small else 31)
    if not sums.total:
        table = totals.select("__source", F.col("t").alias("tokens"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"))
        return Plan(table, small, exponent, 0.0, met)
    found = sums.raised([exponent])[0]
    reached = _entropy_at(exponent, found) / math.log(sums.live) if sums.live > 1 else 1.0
    log_share = F.log(F.col("t") / F.lit(float(sums.total)))
    weight = F.exp(F.lit(exponent) * log_share - F.lit(found[0]))
    low, high = math.log(sums.least / sums.total), math.log(sums.most / sums.total)
    # without cover a multiple of all tokens; with it so much that the least repeated source is drawn once
    budget = F.exp(log_share * F.lit(exponent) + F.lit((1 - exponent) * (high if exponent < 1 else low))) if mix.cover else F.lit(mix.budget) * weight
    table = totals.select("__source", F.col("t").alias("tokens"), weight.alias("weight"), F.floor(budget * F.lit(float(sums.total)) + 0.5).cast("long").alias("budget"))
    return Plan(table, small, exponent, reached, met)


def sized_rows(df: DataFrame, carried: list[str], text: str, doc: str, source: str, seed: int) -> DataFrame:
    """``carried`` columns as one struct, with the source, tokens and hash of each row."""
    return df.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("__row"),
        F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(NONE)).alias("__source"),
        word_tokens(text).alias("__tokens"),
        F.xxhash64(F.lit(seed), F.col(f"`{doc}`"), whole(text)).alias("__h"),
    )


def _block() -> Column:
    return F.pmod(F.xxhash64(F.col("__h"), F.lit(1)), F.col("__n"))


def block_order(epoch: Column | str, block: Column | str, seed: int) -> Column:
    """What an epoch's blocks are ordered by, then by number."""
    return F.xxhash64(block, epoch, F.lit(seed))


def row_order(epoch: Column | str) -> Column:
    """What the rows of a block are ordered by in an epoch, then by hash."""
    return F.xxhash64("__h", epoch)


def cuts(narrow: DataFrame, planned: Plan, mix: Mix) -> DataFrame:
    """One row a source: where the last epoch of its budget ends.

    ``__last`` is the last epoch (-1: nothing is drawn).  Of its blocks those
    before (``__o``, ``__b``) are taken whole; of block ``__b`` the rows before
    (``__k``, ``__hh``), and ``__take`` of the ``__m`` rows that are equal there.

    Blocks are summed by ranges of their order first, so that no window holds
    more than 4,096 ranges, the blocks of one range, or the rows of one block,
    however large a source is.
    """
    last = F.when(F.col("budget") > 0, F.floor((F.col("budget") - 1) / F.col("tokens"))).otherwise(-1).cast("long")
    blocks_of = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("tokens") / F.lit(mix.block_tokens))).cast("long")
    sources = planned.table.select("__source", "budget", last.alias("__last"), blocks_of.alias("__n"), (F.col("budget") - F.greatest(last, F.lit(0)) * F.col("tokens")).alias("__left"))
    hint = F.broadcast if planned.small else (lambda df: df)
    dealt = narrow.join(hint(sources), "__source").where("__last >= 0").withColumn("__b", _block())
    blocks = checkpointed(dealt.groupBy("__source", "__b").agg(F.sum("__tokens").alias("__t"), F.first("__last").alias("__last"), F.first("__left").alias("__left")).withColumn("__o", block_order("__last", "__b", mix.seed)))

    def crossing(rows: DataFrame, order: list[str], before: str | None) -> DataFrame:
        """The row of each source in which the running total reaches what is left, with the total before it."""
        w = Window.partitionBy("__source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        at = F.coalesce(F.sum("__t").over(w), F.lit(0)) + (F.lit(0) if before is None else F.col(before))
        return rows.withColumn("__at", at).where("__at < __left and __at + __t >= __left")

    ranged = blocks.withColumn("__g", F.shiftright("__o", 52))
    ranges = crossing(ranged.groupBy("__source", "__g").agg(F.sum("__t").alias("__t"), F.first("__left").alias("__left")), ["__g"], None)
    inner = ranged.join(hint(ranges.select("__source", "__g", F.col("__at").alias("__from"))), ["__source", "__g"])
    block = checkpointed(crossing(inner, ["__o", "__b"], "__from").select("__source", "__b", "__o", F.col("__at").alias("__from"), "__last", "__left"))
    rows = dealt.select("__source", "__b", "__h", "__tokens").join(hint(block), ["__source", "__b"]).groupBy("__source", "__h").agg(
        F.sum("__tokens").alias("__t"), F.count("*").alias("__m"), F.first("__b").alias("__b"), F.first("__o").alias("__o"), F.first("__from").alias("__from"), F.first("__last").alias("__last"), F.first("__left").alias("__left")
    )
    row = crossing(rows.withColumn("__k", row_order("__last")), ["__k", "__h"], "__from")
    take = F.ceil((F.col("__left") - F.col("__at")) / (F.col("__t") / F.col("__m"))).cast("long")
    found = row.select("__source", "__b", "__o", "__k", F.col("__h").alias("__hh"), take.alias("__take"), "__m")
    return checkpointed(sources.select("__source", "__n", "__last").join(found, "__source"))


def draws(rows: DataFrame, narrow: DataFrame, planned: Plan, mix: Mix) -> DataFrame:
    """Each drawn row of ``sized_rows`` once an epoch, with ``__epoch``, ``__block``, ``__block_order`` and ``__order``.

    A row's block comes from its hash, so a source of any size is spread over
    blocks of about ``block_tokens``.  Whether a row is drawn depends on its own
    hash and its source's row of ``cuts``: rows are read once and, as long as
    sources are few, never shuffled.  The row that reaches the budget is the last.
    """
    ends = cuts(narrow, planned, mix)
    many = ends.agg(F.count_if(F.expr("__take < __m"))).first()[0]
    ends = ends.withColumnsRenamed({c: f"__c{c}" for c in ("__b", "__o", "__k", "__hh", "__take", "__m")})
    joined = rows.join(F.broadcast(ends) if planned.small else ends, "__source").withColumn("__block", _block())
    joined = joined.withColumns({"__bo": block_order("__last", "__block", mix.seed), "__ro": row_order("__last")})
    own = F.expr("__block = __c__b and __bo = __c__o")
    at_cut = own & F.expr("__ro = __c__k and __h = __c__hh")
    before = F.expr("__bo < __c__o or (__bo = __c__o and __block < __c__b)") | (own & F.expr("__ro < __c__k or (__ro = __c__k and __h < __c__hh)"))
    drawn = before | (at_cut & F.expr("__c__take = __c__m"))
    earlier = F.when(F.col("__last") > 0, F.sequence(F.lit(0).cast("long"), F.col("__last") - 1)).otherwise(F.array().cast("array<bigint>"))
    every = F.when(drawn, F.array_append(earlier, F.col("__last"))).otherwise(earlier)
    out = ["__row", "__source", "__block", "__tokens", "__epoch", block_order("__epoch", "__block", mix.seed).alias("__block_order"), row_order("__epoch").alias("__order")]
    made = joined.withColumn("__epoch", F.explode(every)).select(*out)
    if not many:
        return made
    # some of several equal rows end a budget
    some = joined.where(at_cut & F.expr("__c__take < __c__m")).withColumn("__i", F.row_number().over(Window.partitionBy("__source").orderBy("__h"))).where("__i <= __c__take")
    return made.unionByName(some.withColumn("__epoch", F.col("__last")).select(*out))


def _drawn(df: DataFrame, carried: list[str], mix: Mix, text: str, doc: str, source: str) -> tuple[DataFrame, Plan]:
    rows = sized_rows(df, carried, text, doc, source, mix.seed)
    folder = shared_folder(df.sparkSession)
    try:
        narrow = written(rows.select("__source", "__tokens", "__h"), folder)
        planned = plan(narrow, mix)
        return draws(rows, narrow, planned, mix), planned
    finally:
        # what follows reads the cuts, which are checkpointed
        removed(df.sparkSession, folder)


def mixed(df: DataFrame, mix: Mix, text: str = "text", doc: str = "doc_id", source: str = "source") -> DataFrame:
    """Rows of ``df`` drawn to the target weights, repeated once an epoch, with the columns of ``df``.

    Rows with a null source form a source of their own.  Null and empty texts
    weigh one token.  Repeated rows are drawn as often as they stand there.  An
    empty table gives an empty one.
    """
    drawn, _ = _drawn(df, df.columns, mix, text, doc, source)
    return drawn.select(*[F.col("__row").getField(c).alias(c) for c in df.columns])


def schedule(df: DataFrame, mix: Mix, text: str = "text", doc: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per drawn document and epoch; sorting by ``epoch``, ``block_order``, ``block``, ``order_key`` replays a source.

    ``entropy`` is the share of the greatest entropy that the mix reaches and
    ``met`` what it meets (see ``solved``).
    """
    drawn, planned = _drawn(df, [doc], mix, text, doc, source)
    table = planned.table.select("__source", "weight")
    return drawn.join(F.broadcast(table) if planned.small else table, "__source").select(
        F.col("__row").getField(doc).alias(doc),
        F.when(F.col("__source") != NONE, F.col("__source")).alias("source"),
        F.col("__epoch").alias("epoch"),
        F.col("__block").alias("block"),
        F.col("__block_order").alias("block_order"),
        F.col("__order").alias("order_key"),
        F.col("__tokens").alias("n_tokens"),
        F.round("weight", 9).alias("weight"),
        F.lit(round(planned.exponent, 9)).alias("exponent"),
        F.lit(round(planned.entropy, 9)).alias("entropy"),
        F.lit(planned.met).alias("met"),
    )
