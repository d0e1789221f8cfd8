"""Resume graphs: the visible turns on the path from the root to the chosen leaf."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlog.operators.paths import above, ends
from skeinlog.session import checkpointed


def visible_leaf(nodes: DataFrame, prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, flags) of session graphs.

    ``nodes``: ``session_id, line_no, uuid, parent, conversational, text, role``
    (text null: no visible turn).  ``prompts``: ``session_id, line_no, leaf``.
    The leaf is the last prompt's, else the last conversational row; it moves
    down while exactly one child still leads to a turn.  Turns come in order from
    the root.  Flags: ``forked``, ``cycle``, ``missing_parent``, ``duplicate_uuid``, ``leaf_advanced``.
    All sessions are walked together, by doubling.
    """
    sizes = nodes.groupBy("session_id", "uuid").agg(F.count("*").alias("n"))
    duplicate = sizes.where("n > 1").select("session_id").distinct()
    graph = checkpointed(nodes.join(duplicate, "session_id", "left_anti").select("session_id", "line_no", F.col("uuid").alias("node"), F.nullif("parent", F.lit("")).alias("parent"), "conversational", "role", "text"))
    edges = graph.select("session_id", "node", "parent")
    # nodes at or above a turn
    bearing = above(edges, graph.where("text is not null").select("session_id", "node"), "session_id").select("session_id", "node").distinct()
    ways = bearing.join(edges.where("parent is not null"), ["session_id", "node"]).groupBy("session_id", "parent").agg(F.count("*").alias("n"), F.min("node").alias("child"))
    ways = checkpointed(ways)
    forked = ways.where("n > 1").select("session_id").distinct().withColumn("forked", F.lit(True))
    asked = prompts.groupBy("session_id").agg(F.max_by("leaf", "line_no").alias("asked"))
    last = graph.where("conversational").groupBy("session_id").agg(F.max_by("node", "line_no").alias("last"))
    first = last.join(asked, "session_id", "full").select("session_id", F.coalesce("asked", "last").alias("node"))
    leaf = ends(ways.where("n = 1").select("session_id", F.col("parent").alias("node"), F.col("child").alias("parent")), first, "session_id")
    advanced = leaf.select("session_id", (F.col("node") != F.col("end")).alias("leaf_advanced"))
    tips = leaf.select("session_id", F.col("end").alias("node"))
    path = above(edges, tips, "session_id")
    looped = path.groupBy("session_id", "node").agg(F.count("*").alias("n")).where("n > 1").select("session_id").distinct()
    known = edges.select("session_id", "node")
    lost = tips.join(known, ["session_id", "node"], "left_anti").select("session_id")
    ups = path.join(edges, ["session_id", "node"]).where("parent is not null").select("session_id", F.col("parent").alias("node"))
    missing = checkpointed(lost.unionByName(ups.join(known, ["session_id", "node"], "left_anti").select("session_id")).distinct())
    bad = looped.unionByName(missing).distinct()
    turns = path.join(bad, "session_id", "left_anti").join(graph.where("text is not null").select("session_id", "node", "role", "text"), ["session_id", "node"])
    ordered = turns.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("k"), "role", "text"))).alias("t")).select("session_id", F.posexplode("t").alias("pos", "x")).select("session_id", "pos", "x.role", "x.text")
    flag = lambda df, name: df.select("session_id").distinct().withColumn(name, F.lit(True))
    flags = nodes.select("session_id").distinct()
    for df, name in ((forked, "forked"), (flag(looped, "cycle"), "cycle"), (flag(missing, "missing_parent"), "missing_parent"), (flag(duplicate, "duplicate_uuid"), "duplicate_uuid"), (advanced, "leaf_advanced")):
        flags = flags.join(df, "session_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return ordered, flags


def graph_log(log: DataFrame) -> DataFrame:
    """A line of text per event, in order of ``seq``: ``*`` in its branch's lane, ``|`` for the lanes before it, then hash, mark, type and branch.

    Main has the first lane; other branches follow in the order in which they open.
    """
    branch = F.when(F.coalesce("branch", F.lit("")) == "", "main").otherwise(F.col("branch"))
    rows = log.withColumn("__b", branch)
    opened = rows.groupBy("artifact_id", "__b").agg(F.min("seq").alias("__open"))
    lanes = opened.withColumn("__lane", (F.row_number().over(Window.partitionBy("artifact_id").orderBy(F.col("__b") != "main", "__open", "__b")) - 1).cast("int")).drop("__open")
    mark = F.when(F.col("type") == "fork", "(fork) ").when(F.col("type") == "merge", "(merge) ").otherwise("")
    line = F.concat(F.repeat(F.lit("| "), F.col("__lane")), F.lit("* "), F.substring("hash", 1, 8), F.lit(" "), mark, F.col("type"), F.lit(" ["), F.col("__b"), F.lit("]"))
    return rows.join(lanes, ["artifact_id", "__b"]).select("artifact_id", "seq", line.alias("line"))
