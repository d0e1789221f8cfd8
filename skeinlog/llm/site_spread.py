"""Operator 3 [native]: boilerplate lines by how many distinct sites they spread over.

Lines are keyed by two XXH64 values.  A HyperLogLog sketch of the sites is
built for every key by aggregation (partial sketches merge before and after the
shuffle, so a line that a third of all rows hold costs one sketch a task).
Lines whose estimate lies near the threshold get exact distinct counts; the
others are decided by their estimate.  Of a line on ``threshold`` sites or more
one place stays, the first by document and position, and all others go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.llm.common import whole
from skeinlog.session import checkpointed, removed, shared_folder, written

SPACES = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    """128 bits of a line: XXH64 of it and of it with a mark before it."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("|"), line).alias("b"))


def row_key(df: DataFrame, text: str, doc: str) -> list[Column]:
    """What tells rows apart: the id and the text; equal rows share one key and are treated alike."""
    return [F.col(f"`{doc}`").alias("__doc"), F.xxhash64(whole(text)).alias("__th")]


def lines(df: DataFrame, text: str = "text", doc: str = "doc_id", site: str = "source", min_words: int = 3) -> DataFrame:
    """Every line of at least ``min_words`` words with its place; shorter lines are never boilerplate."""
    got = df.select(*row_key(df, text, doc), F.col(f"`{site}`").cast("string").alias("__site"), F.posexplode(F.split(whole(text), "\n")).alias("__pos", "__line"))
    words = F.split(F.btrim("__line", F.lit(SPACES)), r"[\x20\x09-\x0D]+")
    return got.where(F.size(words) >= min_words).select("__doc", "__th", "__site", "__pos", line_key(F.col("__line")).alias("__key"))


#: Keys, or documents with their positions, up to this many are broadcast (about 100 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """``df`` cut from its lineage, and marked for broadcast if its rows (or their summed weights) are few."""
    held = checkpointed(df)
    size = held.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0
    return F.broadcast(held) if size <= BROADCAST_ROWS else held


def spread(found: DataFrame, threshold: int, lg_k: int = 12) -> DataFrame:
    """Keys on ``threshold`` sites or more with ``n_sites`` and the first place of the line.

    A null site counts as one site of its own.  The sketch errs by about
    1.04 / sqrt(2 ** lg_k); lines within four such errors of the threshold, or
    within 1.5 sites, are counted exactly.
    """
    site = F.coalesce(F.concat(F.lit("s"), F.col("__site")), F.lit("-"))
    place = F.struct("__doc", "__th", "__pos")
    summed = found.groupBy("__key").agg(F.hll_sketch_agg(site, F.lit(lg_k)).alias("__sketch"), F.min(place).alias("__first"))
    estimated = summed.select("__key", "__first", F.hll_sketch_estimate("__sketch").alias("__est"))
    width = max(1.5, 4 * 1.04 / 2 ** (lg_k / 2) * threshold)
    # few lines reach the threshold: what follows meets the lines again only through them
    high = _small(estimated.where(F.col("__est") >= threshold - width))
    near = high.where(F.col("__est") <= threshold + width)
    exact = (
        found.join(near.select("__key"), "__key", "left_semi")
        .select("__key", site.alias("__site"))
        .groupBy("__key", "__site")
        .agg(F.lit(1).alias("__one"))
        .groupBy("__key")
        .agg(F.count("*").alias("__exact"))
    )
    counted = high.join(exact, "__key", "left").withColumn("n_sites", F.coalesce("__exact", F.col("__est").cast("long")))
    return counted.where(F.col("n_sites") >= threshold).select("__key", "n_sites", "__first")


def removals(found: DataFrame, threshold: int) -> DataFrame:
    """For each row key of ``lines`` the positions that go, in order; rows that keep all their lines are absent."""
    spread_lines = _small(spread(found, threshold))
    place = F.struct("__doc", "__th", "__pos")
    gone = found.join(spread_lines.select("__key", "__first"), "__key").where(~place.eqNullSafe(F.col("__first")))
    return gone.groupBy("__doc", "__th").agg(F.array_sort(F.collect_set("__pos")).alias("__gone"))


def without_boilerplate(df: DataFrame, threshold: int = 10, text: str = "text", doc: str = "doc_id", site: str = "source", min_words: int = 3) -> DataFrame:
    """The rows of ``df`` with ``__kept_text`` (boilerplate gone), ``__n_gone`` and ``__n_lines``.

    Texts are cut into lines and hashed once, into a narrow table of keys, sites and
    places in the shared folder; counts, exact counts and removals read that, and
    the texts are read once more to take lines out.  Null and empty texts stay as
    they are.  Line order, empty lines and short lines stay.  Equal rows (same id and
    text) are one document here: all keep or lose the same places.  An empty table
    gives an empty one.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    try:
        found = written(lines(df, text, doc, site, min_words), folder)
        gone = _small(removals(found, threshold), 1 + F.size("__gone") / 8).withColumnsRenamed({"__doc": "__gdoc", "__th": "__gth"})
    finally:
        removed(spark, folder)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *row_key(df, text, doc), F.col(f"`{text}`").cast("string").alias("__text"))
    joined = rows.join(gone, rows["__doc"].eqNullSafe(gone["__gdoc"]) & (rows["__th"] == gone["__gth"]), "left")
    split = F.split(F.col("__text"), "\n")
    # the lines are named in a lambda, so that they are cut once and not at every place
    stay = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("__gone")), lambda i: F.get(ls, i))
    kept = F.array_join(F.get(F.transform(F.array(split), stay), F.lit(0)), "\n")
    return joined.select(
        *[F.col("__row").getField(c).alias(c) for c in df.columns],
        F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(kept).alias("__kept_text"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("__n_gone"),
        F.coalesce(F.size(split), F.lit(0)).cast("long").alias("__n_lines"),
    )


def report(df: DataFrame, threshold: int = 10, text: str = "text", doc: str = "doc_id", site: str = "source", min_words: int = 3) -> DataFrame:
    """``doc``, ``n_lines``, ``n_removed``, ``n_chars_kept`` and the SHA-256 of the text that stays."""
    made = without_boilerplate(df.select(*dict.fromkeys([doc, text, site])), threshold, text, doc, site, min_words)
    stays = F.coalesce("__kept_text", F.lit(""))
    return made.select(
        F.col(f"`{doc}`"),
        F.when(F.col("__kept_text").isNull(), F.lit(0).cast("long")).otherwise(F.col("__n_lines")).alias("n_lines"),
        F.col("__n_gone").alias("n_removed"),
        F.char_length(stays).cast("long").alias("n_chars_kept"),
        F.sha2(stays, 256).alias("kept_sha256"),
    )


def drop_boilerplate(df: DataFrame, threshold: int = 10, text: str = "text", doc: str = "doc_id", site: str = "source", min_words: int = 3) -> DataFrame:
    """``df`` with boilerplate lines taken out of ``text``; rows that held nothing else go."""
    made = without_boilerplate(df, threshold, text, doc, site, min_words)
    emptied = (F.col("__n_gone") > 0) & (F.btrim("__kept_text", F.lit(SPACES)) == "")
    return made.where(~emptied).select(*[F.col("__kept_text").alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])
