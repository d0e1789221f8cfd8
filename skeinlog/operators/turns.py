"""Turns of conversations: visibility, summaries, transcripts, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlog.functions import constants as C
from skeinlog.functions.text import normalized_turn, summary_text


def visible_turns(events: DataFrame) -> DataFrame:
    """``artifact_id, pos, role, text`` of the turns that a person sees."""
    turns = events.where((F.col("type") == "turn") & F.col("role").isin("user", "assistant"))
    return turns.select("artifact_id", "pos", "role", normalized_turn(F.col("role"), F.col("text")).alias("text")).where("text is not null")


def conversation_summary(turns: DataFrame) -> DataFrame:
    """Title, description, number of turns and search text of each conversation."""
    said = turns.select("artifact_id", "pos", "role", summary_text(F.col("text")).alias("t"))
    user, reply = (F.col("role") == "user") & (F.col("t") != ""), (F.col("role") == "assistant") & (F.col("t") != "")
    ordered = F.sort_array(F.collect_list(F.when(F.col("t") != "", F.struct("pos", "t"))))
    grouped = said.groupBy("artifact_id").agg(
        F.count("*").alias("turn_count"),
        F.min_by(F.when(user, F.col("t")), F.when(user, F.col("pos"))).alias("first_user"),
        F.min_by(F.when(reply, F.col("t")), F.when(reply, F.col("pos"))).alias("first_reply"),
        F.max_by(F.when(user, F.col("t")), F.when(user, F.col("pos"))).alias("latest_user"),
        F.array_join(F.transform(F.slice(ordered, 1, C.PREVIEW_TURNS), lambda x: x["t"]), " ").alias("search_text"),
    )
    blank = F.lit("")
    title = F.coalesce("first_user", "first_reply", F.lit("Conversation"))
    first = F.coalesce("latest_user", blank)
    second = F.when(first == F.col("title"), F.coalesce("first_reply", blank)).otherwise(first)
    return (
        grouped.withColumn("title", title)
        .withColumn("description", F.when(second == F.col("title"), blank).otherwise(second))
        .select("artifact_id", "title", "description", "turn_count", "search_text")
    )


def haystack(summary: DataFrame) -> DataFrame:
    """``summary`` with the lower-case text that a search looks in."""
    parts = ["artifact_id", "title", "description", "search_text", "source_agent", "source_path", "materialized_in"]
    held = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in summary.columns else F.lit("") for c in parts]
    return summary.withColumn("haystack", F.lower(F.concat_ws(" ", *held)))


def search(summary: DataFrame, query: str = "", limit: int = C.SEARCH_DEFAULT, scan: int = C.SEARCH_SCAN) -> DataFrame:
    """Newest conversations whose text holds ``query``.

    Order: ``updated_at`` then id, newest first; one conversation a source path;
    at most ``scan`` of those are looked at (``limit`` if there is no query);
    then the filter, then the limit.
    """
    limit = min(limit if limit > 0 else C.SEARCH_DEFAULT, C.SEARCH_MAX)
    needle = query.strip().lower()
    newest = [F.desc("updated_at"), F.desc("artifact_id")]
    key = F.trim(F.coalesce("source_path", F.lit("")))
    per_path = Window.partitionBy(F.when(key != "", key).otherwise(F.concat(F.lit("\x00"), F.col("artifact_id").cast("string")))).orderBy(*newest)
    unique = summary.withColumn("__n", F.row_number().over(per_path)).where("__n = 1").drop("__n")
    scanned = unique.orderBy(*newest).limit(limit if not needle else scan)
    found = haystack(scanned)
    if needle:
        found = found.where(F.contains(F.col("haystack"), F.lit(needle)))
    return found.orderBy(*newest).limit(limit).drop("haystack")


def transcript(turns: DataFrame) -> DataFrame:
    """Markdown of each conversation: a heading and the text of every turn, in order."""
    part = F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), F.col("text"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", part.alias("p"))))
    return turns.groupBy("artifact_id").agg(F.array_join(F.transform(ordered, lambda x: x["p"]), "\n\n").alias("markdown"))


def turns_hash(turns: DataFrame) -> DataFrame:
    """One digest of a conversation's visible turns, the key for equality across copies."""
    part = F.concat("role", F.lit("\x1f"), "text")
    ordered = F.sort_array(F.collect_list(F.struct("pos", part.alias("p"))))
    return turns.groupBy("artifact_id").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["p"]), "\x1e"), 256).alias("turns_hash"))


def alternating(turns: DataFrame) -> DataFrame:
    """Whether each conversation alternates user and assistant and ends with an answer."""
    w = Window.partitionBy("artifact_id").orderBy("pos")
    placed = turns.withColumn("__k", F.row_number().over(w) - 1)
    fits = F.col("role") == F.when(F.col("__k") % 2 == 0, "user").otherwise("assistant")
    return placed.groupBy("artifact_id").agg((F.bool_and(fits) & (F.count("*") % 2 == 0)).alias("alternating"), F.count("*").alias("n_turns"))


def role_violations(turns: DataFrame) -> DataFrame:
    """Turns that follow a turn of the same role, and a first turn that isn't the user's, by conversation."""
    w = Window.partitionBy("artifact_id").orderBy("pos")
    before = F.lag("role").over(w)
    wrong = F.when(before.isNull(), F.col("role") != "user").otherwise(before == F.col("role"))
    return turns.select("artifact_id", wrong.alias("w")).groupBy("artifact_id").agg(F.count_if("w").alias("role_violations"), F.count("*").alias("n_turns"))


def turn_times(events: DataFrame) -> DataFrame:
    """Newest and oldest time of a conversation's turns; null if any turn lacks one."""
    missing = F.bool_or(F.col("ts_nanos").isNull())
    return events.where("type = 'turn'").groupBy("artifact_id").agg(F.when(~missing, F.max("ts_nanos")).alias("newest"), F.when(~missing, F.min("ts_nanos")).alias("oldest"))


def portable(events: DataFrame, strict: bool = False) -> DataFrame:
    """Whether every event of a conversation is a visible user or assistant turn; strict: one plain text block, no tags or extras."""
    text = F.array_join(F.transform(F.filter("content", lambda b: (b["type"] == "text") & (b["text"] != "")), lambda b: b["text"]), "\n\n")
    good = (F.col("type") == "turn") & F.col("role").isin("user", "assistant") & normalized_turn(F.col("role"), text).isNotNull()
    if strict:
        plain = (F.size("content") == 1) & (F.get("content", F.lit(0))["type"] == "text") & (F.coalesce(F.size("tags"), F.lit(0)) <= 0) & F.col("native_extras").isNull()
        good = good & plain
    return events.groupBy("artifact_id").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("portable"))


def legacy_score(events: DataFrame) -> DataFrame:
    """Quality of a conversation copy, smaller is better: role violations, time reversals, turns in retimed cohorts."""
    w = Window.partitionBy("artifact_id").orderBy("pos")
    cohort = Window.partitionBy("artifact_id", "ts_nanos")
    marked = events.withColumns(
        {
            "__same": (F.lag("role").over(w) == F.col("role")).cast("int"),
            "__back": (F.lag("ts_nanos").over(w) > F.col("ts_nanos")).cast("int"),
            "__cohort": (F.count("*").over(cohort) > 1).cast("int"),
        }
    )
    return marked.groupBy("artifact_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("__same", "role_violations"), ("__back", "time_reversals"), ("__cohort", "cohort_turns"))])
