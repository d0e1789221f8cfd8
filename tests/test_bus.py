"""The broadcast bus and its stores on small tables."""

from skeinlog.streaming import bus, settle


def test_slow_subscribers_lose_what_their_buffer_has_no_room_for(spark):
    published = spark.createDataFrame([("s", i) for i in range(1, 11)] + [("t", 1)], "subscriber string, seq long")
    drained = spark.createDataFrame([("s", 4)], "subscriber string, seq long")
    got = {(r.subscriber, r.seq) for r in bus.delivered(published, drained, 3).where("dropped").collect()}
    assert got == {("s", 4), ("s", 8), ("s", 9), ("s", 10)}
    assert {(r.subscriber, r.delivered, r.dropped) for r in bus.drop_counts(bus.delivered(published, drained, 3)).collect()} == {("s", 6, 4), ("t", 1, 0)}


def test_numbers_gaps_and_upserts(spark):
    e = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 20 * id, 0) ts, id event_id from range(10)")
    assert [r.seq for r in bus.numbered(e).orderBy("event_id").collect()] == list(range(1, 11))
    lanes = spark.createDataFrame([("a", 1), ("a", 2), ("a", 5), ("b", 7)], "lane string, seq long")
    assert [tuple(r) for r in bus.gaps(lanes).collect()] == [("a", 3, 4)]
    stored, new = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k long, v string")
    assert {tuple(r) for r in bus.upserted(stored, new, ["k"]).collect()} == {(1, "x"), (2, "z"), (3, "w")}
    once = bus.inbox(stored, new, ["k"], "v")
    assert {tuple(r) for r in once.collect()} == {(1, "x"), (2, "y"), (3, "w")} == {tuple(r) for r in bus.inbox(once, new, ["k"], "v").collect()}


def test_live_dedupe_keeps_each_id_once(spark, tmp_path):
    rows = spark.sql("select cast(id % 3 as string) event_id, timestamp'2024-01-01' ts from range(9)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    q = settle.deduped(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda df, _: got.extend(df.collect())).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.event_id for r in got) == ["0", "1", "2"]
