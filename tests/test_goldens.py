"""Small cases with known results."""

import hashlib
import hmac

from pyspark.sql import functions as F

from shelfstream.functions import prices as P
from shelfstream.functions import text as T
from shelfstream.operators import commerce as C
from shelfstream.operators import metering as M
from shelfstream.operators import retrieval as R
from shelfstream.operators import sync as S


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr.alias("x")).first()["x"]


def test_folds(spark):
    assert one(spark, T.query_fold(F.col("t")), t="Điện thoại  ÁO-khoác!") == "dien thoai ao khoac"
    assert one(spark, T.semantic_fold(F.col("t")), t="Đồ Crème") == "đo creme"
    assert one(spark, T.equivalence_key(F.col("t")), t="Berries glasses shoes bus") == "berry glasse shoe bus"


def test_prices(spark):
    def parse(q):
        r = one(spark, P.price_constraint(F.col("t")), t=q)
        return r and (r["min"], r["max"], r["min_inclusive"], r["max_inclusive"], r["currency"])

    assert parse("shoes under $50") == (None, 50, True, False, "USD")
    assert parse("from 1,5 trieu to 2 trieu") == (1_500_000, 2_000_000, True, True, "VND")
    assert parse("khong duoi 400.000 vnd") == (400_000, None, True, True, "VND")
    assert parse("20 or more") == (20, None, True, True, None)
    assert parse("red shoes") is None and parse("") is None and one(spark, P.price_constraint(F.lit(None).cast("string")), t="x") is None
    assert parse("khong tren 2tr") == (None, 2_000_000, True, True, "VND") and parse("tren gia 2tr") == (2_000_000, None, False, True, "VND")
    assert parse("size 7 at most $1,250") == (None, 1250, True, True, "USD") and parse("gia 300k - 200k") == (200_000, 300_000, True, True, "VND")
    assert parse("between 10 and 5 usd, under 3") == (5, 10, True, True, "USD") and parse("2 million max") == (None, 2_000_000, True, True, None)
    assert parse("5 kg min") is None and parse("over 5 or more") == (5, None, False, True, None) and parse(">= 100.000d") == (100_000, None, True, True, "VND")


def test_hmac(spark):
    assert one(spark, T.hmac_sha256("k" * 70, F.col("t")), t="abc") == hmac.new(b"k" * 70, b"abc", hashlib.sha256).hexdigest()


def products(spark, n, stale=0):
    rows = [("s", i, False, True, "STALE" if i >= n - stale else "READY", None, None, i) for i in range(n)]
    return spark.createDataFrame(rows, "shop string, product_id long, searchable boolean, has_vector boolean, vector_status string, blocked_reason string, status string, created_at long")


def limits(spark, limit, active=True):
    return spark.createDataFrame([("s", active, limit)], "shop string, active boolean, product_limit int")


def test_eligibility(spark):
    out = M.eligibility(products(spark, 1283), limits(spark, 100))
    assert (out.where("now_searchable").count(), out.where("now_blocked = 'PRODUCT_LIMIT'").count()) == (100, 1183)
    out = M.eligibility(products(spark, 500, 30), limits(spark, 500))
    assert (out.where("now_searchable").count(), out.where("requires_reindex").count()) == (500, 30)
    assert M.eligibility(products(spark, 500), limits(spark, 500, False)).where("now_searchable").count() == 0


def test_eligibility_again_changes_nothing(spark):
    first = M.eligibility(products(spark, 50), limits(spark, 20))
    again = products(spark, 50).drop("searchable", "blocked_reason").join(first.select("shop", "product_id", F.col("now_searchable").alias("searchable"), F.col("now_blocked").alias("blocked_reason")), ["shop", "product_id"])
    second = M.eligibility(again, limits(spark, 20))
    cols = ["product_id", "now_searchable", "now_blocked", "requires_reindex"]
    assert sorted(first.select(cols).collect()) == sorted(second.select(cols).collect())


def test_revenue(spark):
    rows = [("ACTIVE", 9.9, "USD", "EVERY_30_DAYS", "p"), ("ACTIVE", 1200.0, "EUR", "ANNUAL", "p"), ("FROZEN", 5.0, "USD", "EVERY_30_DAYS", "p"), ("ACTIVE", None, "USD", "ANNUAL", "p")]
    df = spark.createDataFrame(rows, "status string, price_snapshot double, currency string, interval_code string, plan_handle string")
    out = {r["currency"]: r["mrr"] for r in C.recurring_revenue(df).where("plan_handle IS NULL").collect()}
    assert out == {"USD": 9.9, "EUR": 100.0}


def lanes(spark, dense=(), sparse=(), lexical=(), structured=()):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return (
        make(dense, "query_id long, product_id long, score double, rank int"), make(sparse, "query_id long, product_id long, rank int"),
        make(lexical, "query_id long, product_id long, score double"), make(structured, "query_id long, product_id long, score double, kinds array<string>"),
    )


def test_fusion_confirms_shared_candidates(spark):
    out = R.fuse_lanes(*lanes(spark, [(1, 10, 0.8, 1), (1, 11, 0.7, 2)], [(1, 11, 1), (1, 12, 2)]), floor=0.35, most=10).orderBy("rank").collect()
    assert out[0]["product_id"] == 11 and out[0]["sources"] == ["SEMANTIC", "SPARSE"] and len(out) == 3


def test_fusion_exact_title_first(spark):
    out = R.fuse_lanes(*lanes(spark, [(1, 10, 0.72, 1)], [], [(1, 20, 0.995)]), floor=0.35, most=10).orderBy("rank").collect()
    assert [r["product_id"] for r in out] == [20, 10]


def test_fusion_facts_alone(spark):
    rows = [(1, 1, 0.8, ["ATTRIBUTE"]), (1, 2, 0.8, ["COMPATIBILITY"])]
    out = R.fuse_lanes(*lanes(spark, structured=rows), floor=0.35, most=10).collect()
    assert [r["product_id"] for r in out] == [2]


def test_thresholds(spark):
    df = spark.createDataFrame([(1, 1, 0.6), (1, 2, 0.5), (2, 1, 0.39)], "query_id long, product_id long, score double")
    got = {r["query_id"]: round(r["threshold"], 3) for r in R.adaptive_threshold(df, 0.35, 0.78).collect()}
    assert got == {1: 0.468, 2: 0.35}
    none = spark.createDataFrame([], "query_id long")
    assert {r["query_id"] for r in R.reject_without_evidence(df, none, 0.6).collect()} == {1}
    assert {r["query_id"] for r in R.reject_without_evidence(df, df.where("query_id = 2"), 0.6).collect()} == {1, 2}


def test_branches(spark):
    df = spark.createDataFrame([(1, 1, 0, 0.3), (1, 1, 1, 0.5), (1, 2, 1, 0.6)], "query_id long, product_id long, branch int, score double")
    got = {r["product_id"]: (r["raw"], r["primary"]) for r in R.fuse_branches(df).collect()}
    assert got == {1: (0.5, 0.3), 2: (0.6, None)}


def test_backoff(spark):
    df = spark.sql("SELECT explode(sequence(1, 5)) AS n, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS t")
    waits = [r["d"] and r["d"].total_seconds() for r in df.select("n", (S.retry_at(F.col("n"), F.col("t"), 5, 5) - F.col("t")).alias("d")).orderBy("n").collect()]
    assert waits == [5, 10, 20, 40, None]


def test_dense_plan_has_no_cartesian(spark, sf_dir):
    from shelfstream import plans

    plan = plans.QUERIES["ret10_hybrid_fusion"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
