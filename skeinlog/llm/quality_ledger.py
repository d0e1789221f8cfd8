"""Operator 6 [native]: a ledger of quality rules as failure bits.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one BIGINT whose bit *i* is set if rule *i* failed.  A policy is a version
and a mask of the rules that reject; applying a policy, or asking what a rule
rejects on its own, only reads the bits.  All of it is column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.llm.common import whole

#: White space of the word rule: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rules by bit: the name and the failing condition over the measurements.  New rules go to the end.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "5 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("shouting", "2 * n_capitals > word_chars"),
]
BASE = ("few_words", "repeated_windows")
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


@dataclass(frozen=True)
class Policy:
    """A version of what rejects; ``base`` rules reject in every version."""

    version: int
    rejects: tuple[str, ...]

    @property
    def mask(self) -> int:
        return bits(*BASE, *self.rejects)


def bits(*names: str) -> int:
    at = {name: i for i, (name, _) in enumerate(RULES)}
    return sum(1 << i for i in {at[n] for n in names})


POLICIES = {p.version: p for p in (Policy(1, ()), Policy(2, ("symbols", "repeated_lines", "short_words", "long_words", "shouting")))}


def _removed(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars``."""
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def measured(df: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """``keys`` and the measurements of every row; a null text has no words.

    Windows are compared by XXH64 over their three words.  ``n_repeat_words``
    counts each word once, however many repeated windows hold it.
    """
    keys = keys or ["doc_id"]
    held = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]
    names = [f"__k{i}" for i in range(len(keys))]
    whitespace = F.lit(SPACES)
    base = df.select(*held, whole(text).alias("__t"))
    trimmed = F.btrim(F.col("__t"), whitespace)
    cut = base.select(
        *names,
        "__t",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("__words"),
        F.filter(F.split(F.col("__t"), "\n"), lambda line: F.btrim(line, whitespace) != "").alias("__lines"),
    )
    words = F.col("__words")
    counted = cut.select(
        *names,
        F.size(words).cast("long").alias("n_words"),
        (F.char_length("__t") - _removed(F.col("__t"), SPACES)).cast("long").alias("word_chars"),
        _removed(F.col("__t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        _removed(F.col("__t"), CAPITALS).cast("long").alias("n_capitals"),
        F.transform(
            F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
        ).alias("__h"),
    )
    # few documents hold every window once; only the others are put in order with places
    placed = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = counted.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), placed))
    ordered = F.col("__s")

    def meets(x, i):
        before = F.coalesce(x.h == F.get(ordered, i - 1).h, F.lit(False))
        return before | F.coalesce(x.h == F.get(ordered, i + 1).h, F.lit(False))

    starts = some.withColumn("__at", F.sort_array(F.transform(F.filter("__s", meets), lambda x: x.i)))
    at = F.col("__at")
    covered = F.aggregate(
        F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda total, step: total + step,
    )
    result = starts.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    return result.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], *MEASURES)


def ledger(df: DataFrame, text: str = "text", keys: list[str] | None = None, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """``keys``, the measurements and ``failures``: one row per row of ``df``.

    An empty text fails ``few_words`` alone.  Repeated rows give repeated rows;
    an empty table gives an empty one; other columns are not read.
    """
    failures = F.lit(0).cast("long")
    for i, (_, failing) in enumerate(rules or RULES):
        failures = failures.bitwiseOR(F.when(F.expr(failing), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured(df, text, keys).withColumn("failures", failures)


def verdict(policy: Policy, failures: str = "failures") -> Column:
    """True where ``policy`` keeps the row."""
    return F.col(failures).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablation(kept: DataFrame, policy: Policy, failures: str = "failures") -> DataFrame:
    """For each rule of ``policy``: rows it fails, rows that it alone rejects, and rows kept without it.

    Rows are first counted by bit pattern, so what follows has at most one row
    per pattern however large the corpus is.
    """
    patterns = kept.groupBy(F.col(failures).bitwiseAND(F.lit(policy.mask).cast("long")).alias("__b")).count()
    active = [(name, 1 << i) for i, (name, _) in enumerate(RULES) if policy.mask >> i & 1]
    total = [
        F.struct(
            F.lit(name).alias("rule"),
            F.coalesce(F.sum(F.when(F.col("__b").bitwiseAND(F.lit(bit).cast("long")) != 0, F.col("count"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("__b") == bit, F.col("count"))), F.lit(0)).alias("n_alone"),
            F.coalesce(F.sum(F.when(F.col("__b").bitwiseAND(F.lit(policy.mask & ~bit).cast("long")) == 0, F.col("count"))), F.lit(0)).alias("n_kept_without"),
        )
        for name, bit in active
    ]
    return patterns.agg(F.array(*total).alias("__r")).select(F.inline("__r"))


def judged(df: DataFrame, policy: Policy, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """The ledger with ``base_failed``, ``kept`` and the policy's version."""
    base = F.col("failures").bitwiseAND(F.lit(bits(*BASE)).cast("long")) != 0
    return ledger(df, text, keys).withColumns({"base_failed": base, "kept": verdict(policy), "policy": F.lit(policy.version)})


def keep_good(df: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """The rows of ``df`` that ``policy`` keeps, with the columns of ``df``.

    The row travels through the ledger as one struct, so that no join is needed
    and no column name can clash.  It is unpacked by ``inline`` rather than kept
    by a filter: a filter would be pushed below the measurements and repeat them.
    """
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.col(f"`{text}`").alias("__text"))
    return judged(row, policy, "__text", ["__row"]).select(F.inline(F.when(F.col("kept"), F.array("__row"))))
