"""Storage, formats and the query registry."""

import pytest

import __spark_entry__
from skeinlog.operators.logs import branch_replay
from skeinlog.plans import load_all
from skeinlog.sources import registry, tables


def test_events_round_trip_by_kind(spark, tmp_path):
    rows = spark.createDataFrame([("a", "memory", 1), ("b", "tool", 2)], "artifact_id string, kind string, seq long")
    from pyspark.sql import functions as F

    schema = spark.createDataFrame([], tables.EVENTS).schema
    full = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    tables.append_events(full, str(tmp_path / "e"))
    tables.append_events(full.where("kind = 'tool'"), str(tmp_path / "e"))
    assert tables.read_events(spark, str(tmp_path / "e")).count() == 3
    one = tables.read_events(spark, str(tmp_path / "e"), "tool")
    assert one.count() == 2 and "PartitionFilters: [isnotnull(kind" in one._jdf.queryExecution().toString()
    assert tables.manifest(spark, str(tmp_path / "e")).where("length > 0").count() >= 2
    full.drop("kind").write.json(str(tmp_path / "j"), compression="gzip")
    assert tables.read_event_lines(spark, str(tmp_path / "j")).count() == 2


def test_formats(spark):
    lines = spark.createDataFrame([("s", 0, '{"type": "user", "content": "hi"}')], "session_id string, line_no int, line string")
    assert registry.convert("typed", "rollout", lines).first().line.count("input_text") == 1
    with pytest.raises(ValueError):
        registry.read("table", lines)
    with pytest.raises(ValueError):
        registry.convert("typed", "parts", lines)
    with pytest.raises(ValueError):
        registry.register("typed", registry.FORMATS["typed"])


def test_branch_replay(spark):
    rows = [(1, 0, None, None, None, []), (1, 1, "x", "main", "e0", []), (1, 2, None, None, None, ["x"])]
    df = spark.createDataFrame(rows, "artifact_id long, pos long, branch_id string, source_branch_id string, source_event_id string, merged_branch_ids array<string>")
    assert {(r.branch, r.parent, r.fork_point, r.merged) for r in branch_replay(df).collect()} == {("main", None, None, False), ("x", "main", "e0", True)}


def test_registry_and_entry(spark):
    found, sql = load_all()
    assert len(found) > 60 and set(sql) <= set(found)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
