"""Streams give their batch twins' results."""

import pytest
from pyspark.sql import functions as F

from shelfstream.streaming import feeds


@pytest.fixture(scope="module")
def events_dir(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("feed") / "events")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    for i in range(3):  # files in order of time, one a batch
        rows.where(F.floor((F.col("event_id") - 1) / 334) == i).coalesce(1).write.mode("append").parquet(path)
    return path


def drain(spark, stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def shop_rows(rows):
    return rows.select(F.concat(F.lit("shop_"), (F.col("user_id") % 3).cast("string")).alias("shop"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"))


def test_first_deliveries(spark, events_dir, tmp_path):
    pairs = feeds.feed(spark, events_dir).withColumn("webhook", F.floor(F.col("event_id") / 2))
    got = drain(spark, feeds.first_deliveries(pairs, "webhook", "ts", "1 day"), tmp_path, "first_deliveries")
    n = spark.read.parquet(events_dir).select(F.floor(F.col("event_id") / 2)).distinct().count()
    assert got.count() == n


def test_quota_gate(spark, events_dir, tmp_path):
    got = drain(spark, feeds.quota_gate(shop_rows(feeds.feed(spark, events_dir)), 50, "1 hour"), tmp_path, "gate")
    assert {(r["shop"], r["n"]) for r in got.where("accepted").groupBy("shop").agg(F.count("*").alias("n")).collect()} == {(f"shop_{i}", 50) for i in range(3)}
    assert got.count() == spark.read.parquet(events_dir).count()


def test_throttle_matches_fold(spark, events_dir, tmp_path):
    rows = shop_rows(feeds.feed(spark, events_dir)).where("type = 'error'")
    got = {(r["event_id"], r["n"]) for r in drain(spark, feeds.throttle(rows, 5, 6 * 3600, "40 days"), tmp_path, "throttle").collect()}
    want, state = set(), {}
    batch = shop_rows(spark.read.parquet(events_dir)).where("type = 'error'").orderBy("ts", "event_id").collect()
    for r in batch:
        start, n = state.get(r["shop"], (None, 0))
        if start is None or (r["ts"] - start).total_seconds() > 6 * 3600:
            start, n = r["ts"], 0
        state[r["shop"]] = (start, n + 1)
        want.add((r["event_id"], n + 1))
    assert got == want


def test_late_events(spark, tmp_path):
    rows = spark.sql("SELECT 'a' AS shop, explode(sequence(1L, 4L)) AS event_id").withColumn("ts", F.timestamp_seconds(F.when(F.col("event_id") == 3, 5).otherwise(F.col("event_id") * 10)))
    path = str(tmp_path / "late_in")
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    got = {r["event_id"]: r["late"] for r in drain(spark, feeds.late_events(stream, "1 day"), tmp_path, "late").collect()}
    assert got == {1: False, 2: False, 3: True, 4: False}


def test_reservations(spark, tmp_path):
    """One reservation takes effect, one rolls back after its time, one takes effect too late."""
    path, day = str(tmp_path / "res_in"), 86_400
    batches = [
        f"SELECT * FROM VALUES (1L, {day}, 'HOLD'), (2L, {day}, 'HOLD'), (3L, {day + 5}, 'HOLD'), (1L, {day + 60}, 'EFFECT') AS t(reservation_id, s, event)",
        f"SELECT * FROM VALUES (9L, {2 * day}, 'HOLD') AS t(reservation_id, s, event)",
        f"SELECT * FROM VALUES (9L, {2 * day + 1}, 'EFFECT') AS t(reservation_id, s, event)",
        f"SELECT * FROM VALUES (8L, {2 * day + 2}, 'HOLD') AS t(reservation_id, s, event)",
    ]
    for text in batches:
        spark.sql(text).select("reservation_id", F.timestamp_seconds("s").alias("ts"), "event").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("reservation_id long, ts timestamp, event string").option("maxFilesPerTrigger", 1).parquet(path)
    got = [(r["reservation_id"], r["outcome"]) for r in drain(spark, feeds.reservations(stream, "30 minutes", "1 minute"), tmp_path, "res").collect()]
    assert sorted(got) == [(1, "COMMITTED"), (2, "ROLLED_BACK"), (3, "ROLLED_BACK"), (9, "COMMITTED")]


def test_daily_usage(spark, events_dir, tmp_path):
    got = drain(spark, feeds.daily_usage(shop_rows(feeds.feed(spark, events_dir)), "1 hour"), tmp_path, "daily")
    want = shop_rows(spark.read.parquet(events_dir)).groupBy(F.to_date("ts").alias("day"), "shop", "type").agg(F.count("*").alias("n"))
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() > 0


def test_click_attribution(spark, events_dir, tmp_path):
    rows = feeds.feed(spark, events_dir)
    searches = rows.where("event_type = 'view'").select("user_id", F.col("event_id").alias("log_id"), F.col("ts").alias("created_at"))
    clicks = feeds.feed(spark, events_dir).where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), "ts")
    got = {tuple(r) for r in drain(spark, feeds.attributed_clicks(searches, clicks, "1 day"), tmp_path, "clicks").collect()}
    b = spark.read.parquet(events_dir)
    s = b.where("event_type = 'view'").select(F.col("user_id").alias("u"), F.col("event_id").alias("log_id"), F.col("ts").alias("t0"))
    c = b.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), "ts")
    want = {tuple(r) for r in c.join(s, (F.col("u") == F.col("user_id")) & (F.col("t0") <= F.col("ts")) & (F.col("t0") > F.col("ts") - F.expr("INTERVAL 2 HOURS"))).select("click_id", "log_id").collect()}
    assert got == want
