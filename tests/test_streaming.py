from tesserine.plans import context
from tesserine.streaming import events


def drain(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    return spark.table(name).collect()


def stream(spark, small, tmp_path):
    spark.read.parquet(f"{small}/events.parquet").write.parquet(str(tmp_path / "in"))
    return events.read(spark, str(tmp_path / "in"))


def test_per_minute_matches_batch(spark, small, tmp_path):
    rows = drain(spark, events.per_minute(stream(spark, small, tmp_path)), "per_minute", "complete")
    batch = {r.minute: r.n for r in context.per_minute_volume(spark, small).collect()}
    got = {}
    for r in rows:
        got[r.minute] = got.get(r.minute, 0) + r.n
    assert got == batch


def test_rate_limit_matches_window(spark, small, tmp_path):
    rows = drain(spark, events.rate_limited(stream(spark, small, tmp_path), 2, 3600), "rates")
    expected = spark.sql(
        "select event_id, count(*) over (partition by user_id order by ts range between interval 3600 seconds preceding and current row) as n from {e}",
        e=spark.read.parquet(f"{small}/events.parquet"),
    )
    assert {r.event_id: r.n for r in rows} == {r.event_id: r.n for r in expected.collect()}


def test_rate_limit_counts_late_events(spark, tmp_path):
    schema = events.SCHEMA
    rows = [[(1, "2024-01-01 10:00:00"), (2, "2024-01-01 10:00:30")], [(3, "2024-01-01 09:59:40"), (4, "2024-01-01 10:00:35")], [(5, "2024-01-01 10:00:31")]]
    for k, part in enumerate(rows):
        frame = spark.createDataFrame([(i, 7, ts) for i, ts in part], "event_id long, user_id long, ts string").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "'x' as event_type", "1.0d as value", "'' as props")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {r.event_id: r.n for r in drain(spark, events.rate_limited(events.read(spark, str(tmp_path / "in"), 1), 2, 60), "late_rates")}
    assert got.keys() == {1, 2, 3, 4, 5} and got[3] == 1 and got[1] == 1 and got[2] in (2, 3) and got[4] in (3, 4) and got[5] >= 3
    assert schema.startswith("event_id")


def test_upserts_keep_the_last_row_by_time(spark, tmp_path):
    write = events.upsert_each_batch(str(tmp_path / "table"), "k", buckets=4)
    frame = lambda *rows: spark.createDataFrame(list(rows), "k int, ts string, v string").selectExpr("k", "cast(ts as timestamp) as ts", "v")
    write(frame((1, "2024-01-01 10:00:00", "new"), (2, "2024-01-01 08:00:00", "two")), 0)
    write(frame((1, "2024-01-01 05:00:00", "late"), (3, "2024-01-01 05:00:00", "three")), 2)  # an epoch number may be left out
    write(frame((2, "2024-01-01 09:00:00", "more"), (2, "2024-01-01 08:30:00", "less")), 3)
    write(frame((2, "2024-01-01 09:00:00", "more"), (2, "2024-01-01 08:30:00", "less")), 3)
    write(frame().limit(0), 4)
    assert {(r.k, r.v) for r in events.stored(spark, str(tmp_path / "table")).collect()} == {(1, "new"), (2, "more"), (3, "three")}
