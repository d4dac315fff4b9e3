"""Job streams, versioned tables and catalog scans: batch twins' results, over restarts, shuffled files and torn batches."""

import random

import pytest
from pyspark.sql import functions as F

from shelfstream import plans
from shelfstream.operators import sync as S
from shelfstream.sources.views import Tables
from shelfstream.streaming import jobs, ordered, tables

DAY = 86_400


@pytest.fixture(autouse=True)
def timers(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, ordered.STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # one state store is enough here
    yield
    spark.conf.unset(key)
    spark.conf.set("spark.sql.shuffle.partitions", "3")


def put(rows, path, i):
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/f{i}")


def drained(spark, make, schema, src, out, cp):
    """Runs the stream over what is there and stops it."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    q = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


def test_timers_need_their_store(spark):
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = spark.readStream.format("rate").load().selectExpr("timestamp AS ts", "value AS log_id", "'ASK' AS event", "value AS ask_id")
    with pytest.raises(ValueError, match="providerClass"):
        jobs.receipts(rows, "ts", "1 second")


def test_bursts_equal_the_twin_on_shuffled_files(spark, sf_dir, tmp_path):
    feed = Tables(spark, sf_dir)("job_feed").withColumn("ts", F.col("ts").cast("timestamp"))
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    end = feed.limit(1).withColumns({"shop": F.lit("end"), "ts": F.expr("TIMESTAMP '2030-01-01'")})
    for i in range(2):  # each file has every other event
        put(feed.where(F.col("feed_id") % 3 == 2 - i), src, i)
    drained(spark, lambda s: jobs.bursts(s, "ts", "400 days"), feed.schema, src, out, cp)
    put(feed.where("feed_id % 3 = 0"), src, 2)
    put(end, src, 3)
    drained(spark, lambda s: jobs.bursts(s, "ts", "400 days"), feed.schema, src, out, cp)
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("shop", "product_id", "job_id", "absorbed_by").collect())
    want = sorted(tuple(r) for r in plans.QUERIES["str3_burst_feed"](spark, sf_dir).select("shop", "product_id", "job_id", "absorbed_by").collect())
    assert got == want and any(a != b for *_, a, b in want)


def test_bursts_by_version_and_topic(spark, tmp_path):
    """A started job absorbs no update; a request without version goes into any open job; other topics stay apart."""
    say = [
        (1, "PRODUCTS_CREATE", None, "REQUEST"), (2, "PRODUCTS_UPDATE", None, "REQUEST"), (1, "PRODUCTS_CREATE", None, "START"), (3, "PRODUCTS_UPDATE", None, "REQUEST"), (1, "PRODUCTS_CREATE", None, "END"), (4, "PRODUCTS_UPDATE", None, "REQUEST"),
        (5, "REINDEX_PRODUCT", 1, "REQUEST"), (5, "REINDEX_PRODUCT", 1, "START"), (6, "REINDEX_PRODUCT_CAPACITY", 1, "REQUEST"), (7, "REINDEX_PRODUCT", 2, "REQUEST"), (8, "REINDEX_PRODUCT", None, "REQUEST"),
        (9, "REINDEX_PRODUCT_ENRICHMENT", 3, "REQUEST"), (5, "REINDEX_PRODUCT", 1, "END"), (10, "REINDEX_PRODUCT", None, "REQUEST"), (11, "REINDEX_PRODUCT", 1, "REQUEST"), (12, "REINDEX_PRODUCT_ENRICHMENT", 4, "REQUEST"),
    ]
    rows = [(i, j, "s", 1, t, v, e, i) for i, (j, t, v, e) in enumerate(say, 10)] + [(99, 99, "end", 1, "PRODUCTS_CREATE", None, "REQUEST", DAY)]
    schema = "feed_id long, job_id long, shop string, product_id long, topic string, policy_version long, event string, s long"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s"))
    put(df, str(tmp_path / "in"), 0)
    drained(spark, lambda s: jobs.bursts(s, "ts", "1 second"), df.schema, *(str(tmp_path / x) for x in ("in", "out", "cp")))
    got = {r["job_id"]: r["absorbed_by"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 5, 9: 9, 10: 7, 11: 11, 12: 9}


def changes(spark, sf_dir):
    """Each job waits, is taken a minute later, and is three minutes later where the table has it."""
    j = Tables(spark, sf_dir)("sync_jobs").select("job_id", "shop", "product_id", "status", F.col("attempts").cast("long").alias("attempts"), F.col("created_at").cast("timestamp").alias("created_at"), F.col("updated_at").cast("timestamp").alias("updated_at"))
    waits = j.select("job_id", "shop", "product_id", F.lit("PENDING").alias("status"), F.lit(0).cast("long").alias("attempts"), "created_at", F.col("created_at").alias("updated_at"))
    taken = j.where("status <> 'PENDING'").select("job_id", "shop", "product_id", F.lit("PROCESSING").alias("status"), "attempts", "created_at", (F.col("created_at") + F.expr("INTERVAL 1 MINUTE")).alias("updated_at"))
    now = j.where("status <> 'PENDING'")
    return waits.unionByName(taken).unionByName(now)


def last_states(df, when):
    known = df.where(F.col("updated_at") < F.lit(when))
    return known.groupBy("job_id").agg(F.max_by(F.struct("shop", "status", "attempts", "created_at", "updated_at"), F.struct("updated_at", "attempts")).alias("r")).select("job_id", "r.*")


def in_two_runs(spark, df, make, tmp_path, when):
    """The stream over files in order of time, stopped half way, then closed by one row behind ``when``."""
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    known = df.where(F.col("updated_at") < F.lit(when)).persist()
    cut = known.selectExpr("percentile_approx(updated_at, array(0.3, 0.6))").first()[0]
    parts = [known.where(F.col("updated_at") <= F.lit(cut[0])), known.where((F.col("updated_at") > F.lit(cut[0])) & (F.col("updated_at") <= F.lit(cut[1]))), known.where(F.col("updated_at") > F.lit(cut[1]))]
    end = known.limit(1).withColumns({"job_id": F.lit(-1).cast("long"), "shop": F.lit("end"), "updated_at": F.lit(when)})
    put(parts[0], src, 0)
    put(parts[1], src, 1)
    drained(spark, make, df.schema, src, out, cp)
    put(parts[2], src, 2)
    drained(spark, make, df.schema, src, out, cp)
    put(end, src, 3)
    drained(spark, make, df.schema, src, out, cp)
    return spark.read.parquet(out)


def test_retries_equal_the_twin_after_restarts(spark, sf_dir, tmp_path):
    import datetime

    when = datetime.datetime(2024, 1, 5, 12, 0)
    df = changes(spark, sf_dir).select("job_id", "shop", "status", "attempts", "created_at", "updated_at")
    out = in_two_runs(spark, df, lambda s: jobs.job_retries(s, "0 seconds"), tmp_path, when)
    last = out.where("job_id >= 0").groupBy("job_id").agg(F.max_by(F.struct("status", "exhausted", "eligible_at"), F.struct("at", F.expr("cause = 'CHANGED'"))).alias("r")).select("job_id", "r.*")
    want = S.settled_jobs(last_states(df, when), F.lit(when))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.select(last.columns).collect())) and last.count() > 100
    causes = {r["cause"]: r["n"] for r in out.groupBy("cause").agg(F.count("*").alias("n")).collect()}
    assert causes["DUE"] > 10 and causes["EXHAUSTED"] > 2
    due = out.where("cause = 'DUE'")
    assert due.where("at <> eligible_at").count() == 0 and due.count() == due.distinct().count()


def test_scans_equal_the_twin_after_restarts(spark, sf_dir, tmp_path):
    import datetime

    when = datetime.datetime(2024, 1, 5, 12, 0)
    reasons = F.array(*[F.lit(r) for r in (*S.REASON_PRIORITY, "OTHER")])
    df = changes(spark, sf_dir).withColumns({"reason": reasons[(F.col("job_id") * 5 % 8).cast("int")], "shop": F.concat_ws("_", "shop", F.col("product_id").cast("string")), "change_id": F.col("job_id")}).drop("product_id")
    out = in_two_runs(spark, df, lambda s: jobs.catalog_scans(s, "0 seconds"), tmp_path, when)
    last = out.where("shop <> 'end'").groupBy("shop").agg(F.max_by(F.struct("job_id", "reason", "waiting"), "n").alias("r")).select("shop", "r.*").where("job_id IS NOT NULL")
    want = S.next_scans(last_states(df.withColumn("shop", F.struct("shop", "reason")), when).select("job_id", "shop.*", "status", "attempts", "created_at", "updated_at"), F.lit(when))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.select(last.columns).collect())) and last.count() > 20
    assert out.where("busy AND job_id IS NOT NULL").count() == 0 and out.where("busy").count() > 20


def test_receipts_expire(spark, tmp_path):
    rows = [(1, "RECEIPT", None, 100), (1, "ASK", 1, 7299), (1, "ASK", 2, 7300), (2, "ASK", 3, 105), (2, "RECEIPT", None, 110), (2, "RECEIPT", None, 7100), (2, "ASK", 4, 14_000), (9, "ASK", 9, DAY)]
    df = spark.createDataFrame(rows, "log_id long, event string, ask_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    for i in range(2):
        put(df.where(F.col("s") % 2 == i), str(tmp_path / "in"), i)
    put(df.where("log_id = 9").withColumn("ts", F.timestamp_seconds("s") + F.expr("INTERVAL 1 DAY")), str(tmp_path / "in"), 2)
    drained(spark, lambda s: jobs.receipts(s, "ts", "1 day"), df.schema, *(str(tmp_path / x) for x in ("in", "out", "cp")))
    got = sorted(((r["log_id"], int(r["at"].timestamp()), r["ask_id"], r["outcome"]) for r in spark.read.parquet(str(tmp_path / "out")).where("log_id < 9").collect()), key=str)
    assert got == sorted([(1, 7299, 1, "HIT"), (1, 7300, None, "EXPIRED"), (1, 7300, 2, "MISS"), (2, 105, 3, "MISS"), (2, 14_000, 4, "HIT"), (2, 14_300, None, "EXPIRED")], key=str)


KV = "key long, version long, text string"


def kv(spark, rows):
    return spark.createDataFrame(rows, KV)


def test_versions_appear_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sink = tables.upsert_sink(path, KV, ["key"], "version", buckets=8)
    table = tables.VersionedTable(spark, path, KV, ["key"], 8)
    assert table.version() == -1 and table.read().count() == 0
    sink(kv(spark, [(i, 1, "a") for i in range(40)]), 0)
    before = sorted(map(tuple, table.read().collect()))
    old = table._folders(0)
    # A batch that is torn before its manifest leaves the version before.
    real = tables.VersionedTable.merge

    def torn(self, rows, number, change):
        monkeypatch.setattr(self.spark, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")), raising=False)
        return real(self, rows, number, change)

    monkeypatch.setattr(tables.VersionedTable, "merge", torn)
    batch = kv(spark, [(3, 2, "b"), (4, 0, "old"), (100, 1, "new")])
    with pytest.raises(RuntimeError):
        sink(batch, 1)
    monkeypatch.undo()
    assert table.version() == 0 and sorted(map(tuple, table.read().collect())) == before
    sink(batch, 1)
    want = {i: (1, "a") for i in range(40)} | {3: (2, "b"), 100: (1, "new")}
    assert {r["key"]: (r["version"], r["text"]) for r in table.read().collect()} == want
    sink(kv(spark, [(3, 9, "repeated with other rows")]), 1)  # the number is there: nothing changes
    assert {r["key"]: (r["version"], r["text"]) for r in table.read().collect()} == want
    same = [b for b, f in table._folders(1).items() if old.get(b) == f]
    assert len(same) >= 5  # buckets without new rows are not written again
    sink(kv(spark, []), 2)
    sink(kv(spark, [(7, 5, "c")]), 5)  # numbers may be skipped
    assert {r["key"]: (r["version"], r["text"]) for r in table.read().collect()} == want | {7: (5, "c")}
    assert sorted(map(tuple, table.read(0).collect())) == before
    table.vacuum(1)
    assert {r["key"]: (r["version"], r["text"]) for r in table.read().collect()} == want | {7: (5, "c")}


def test_upsert_stream(spark, sf_dir, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "table")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") % 40).alias("key"), F.col("event_id").alias("version"), F.col("event_type").alias("text"))
    for i in range(3):
        put(rows.where(F.col("version") % 3 == i), src, i)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    q = stream.writeStream.foreachBatch(tables.upsert_sink(out, KV, ["key"], "version", 4)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = {r["key"]: r["version"] for r in tables.VersionedTable(spark, out, KV, ["key"], 4).read().collect()}
    assert got == {r["key"]: r["v"] for r in rows.groupBy("key").agg(F.max("version").alias("v")).collect()}


def test_late_rows_go_aside(spark, tmp_path):
    out, sink = str(tmp_path / "out"), tables.split_late(str(tmp_path / "out"), "ts", 60)
    r = random.Random(3)
    batches = [[(b * 100 + i, 1000 * b - r.choice([0, 30, 500, 2000])) for i in range(50)] for b in range(4)]
    newest, want = None, set()
    for n, b in enumerate(batches):
        df = spark.createDataFrame([*b, (9000 + n, None)], "id long, s long").withColumn("ts", F.timestamp_seconds("s"))
        sink(df, n)
        if n == 2:
            sink(df, n)  # repeated
        want |= {i for i, s in b if newest is not None and s < newest - 60}
        newest = max([*([] if newest is None else [newest]), *(s for _, s in b)])
    late = [x["id"] for x in spark.read.parquet(f"{out}/late").collect()]
    kept = [x["id"] for x in spark.read.parquet(f"{out}/rows").collect()]
    assert sorted(late) == sorted(want) and sorted(late + kept) == sorted([i for b in batches for i, _ in b] + [9000, 9001, 9002, 9003]) and len(want) > 10


PAGE = "shop string, scan_id long, page int, pages int, product_id long, published boolean, seen_at timestamp"


def page(spark, shop, scan, n, products, pages=None, hidden=()):
    rows = [(shop, scan, n, pages, p, p not in hidden) for p in products] or [(shop, scan, n, pages, None, None)]
    return spark.createDataFrame(rows, "shop string, scan_id long, page int, pages int, product_id long, published boolean").withColumn("seen_at", F.timestamp_seconds(F.lit(scan)))


def registry(spark, path):
    rows = tables.VersionedTable(spark, f"{path}/registry", tables.REGISTRY, ["shop", "product_id"], 4).read().collect()
    return {(r["shop"], r["product_id"]): (r["scan_id"], r["action"]) for r in rows}


def test_scans_go_on_and_remove_only_at_their_end(spark, tmp_path):
    """A stream of pages that is stopped in mid-scan, torn, and restarted."""
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    dead = [0]

    def run(sink):
        stream = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination(240)

    sink = tables.scan_sink(out, buckets=4)
    put(page(spark, "a", 1, 1, [1, 2, 3]), src, 0)
    put(page(spark, "a", 1, 2, [4, 5], pages=2, hidden={5}).unionByName(page(spark, "b", 7, 1, [1, 2], pages=1)), src, 1)
    run(sink)
    first = {("a", i): (1, "UNPUBLISHED" if i == 5 else "SEEN") for i in range(1, 6)} | {("b", i): (7, "SEEN") for i in (1, 2)}
    assert registry(spark, out) == first
    put(page(spark, "a", 2, 1, [1, 2]), src, 2)  # a scan that stops: 3, 4 and 5 stay
    run(sink)
    half = first | {("a", i): (2, "SEEN") for i in (1, 2)}
    assert registry(spark, out) == half
    put(page(spark, "a", 3, 2, [9]), src, 3)  # a new scan, its pages out of order and one repeated
    run(sink)
    put(page(spark, "a", 3, 2, [9]), src, 4)

    def dies(batch, number):
        real = tables.VersionedTable.merge

        def torn(self, rows, n, change):
            if self.path.endswith("pages"):
                dead[0] += 1
                raise RuntimeError("lost")
            return real(self, rows, n, change)

        tables.VersionedTable.merge = torn
        try:
            sink(batch, number)
        finally:
            tables.VersionedTable.merge = real

    with pytest.raises(Exception):
        run(dies)
    assert dead[0] == 1
    run(sink)
    assert registry(spark, out) == half | {("a", 9): (3, "SEEN")}
    put(page(spark, "a", 3, 1, [2]), src, 5)
    put(page(spark, "a", 2, 2, [3], pages=2), src, 6)  # the rest of the scan before: left aside
    run(sink)
    assert registry(spark, out) == half | {("a", 9): (3, "SEEN"), ("a", 2): (3, "SEEN")}
    put(page(spark, "a", 3, 3, [], pages=3), src, 7)  # the last page, empty: the scan is whole
    run(sink)
    assert registry(spark, out) == first | {("a", 9): (3, "SEEN"), ("a", 2): (3, "SEEN")} | {("a", i): (3, "REMOVED") for i in (1, 3, 4, 5)}


def test_scans_hold_the_rest_against_the_live_catalog(spark, tmp_path):
    live = lambda s: s.createDataFrame([("a", 1, True), ("a", 2, False)], "shop string, product_id long, published boolean")
    sink = tables.scan_sink(str(tmp_path), live, buckets=4)
    sink(page(spark, "a", 1, 1, [1, 2, 3, 4], pages=1), 0)
    sink(page(spark, "a", 2, 1, [4], pages=1), 1)
    assert registry(spark, str(tmp_path)) == {("a", 1): (2, "SEEN"), ("a", 2): (2, "UNPUBLISHED"), ("a", 3): (2, "REMOVED"), ("a", 4): (2, "SEEN")}
