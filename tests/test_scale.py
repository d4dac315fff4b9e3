"""Pruned and split forms give what the plain ones give, and do less."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfstream.operators import analytics as A
from shelfstream.operators import ranking
from shelfstream.operators import retrieval as R


def texts(r, n, common=12, rare=900, length=40):
    """Zipf-like texts: a few words that most texts have, many that few have."""
    out = []
    for i in range(n):
        w = [f"c{r.randrange(common)}" for _ in range(r.randrange(1, length))] + [f"r{int(rare * r.random() ** 2)}" for _ in range(r.randrange(0, 12))]
        r.shuffle(w)
        out.append((i, f"s{i % 7 // 6}", r.choice([" ".join(w), " ".join(w), None if i % 50 == 0 else " ".join(w)])))
    return out


def brute_bm25(queries, docs, k):
    per = defaultdict(dict)
    for i, s, t in docs:
        if t:
            per[s][i] = Counter(t.split())
    out = []
    for q, s, text in queries:
        n, own = len(per[s]), per[s]
        mean = sum(sum(c.values()) for c in own.values()) / max(n, 1)
        scores = {}
        for w in set((text or "").split()):
            df = sum(w in c for c in own.values())
            for i, c in own.items():
                if w in c:
                    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                    scores[i] = scores.get(i, 0) + idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
        best = sorted(((-round(x, 6), i) for i, x in scores.items()))[:k]
        out += [(q, i, rank) for rank, (_, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 16])
def test_bm25_with_bounds(spark, monkeypatch, block):
    """All queries' first k, from far fewer postings than their terms have; no block is larger than it should be."""
    monkeypatch.setattr(R, "POSTINGS_BLOCK", block)
    monkeypatch.setattr(R, "RARE", 3)
    r = random.Random(2)
    docs = texts(r, 900)
    queries = [(i, f"s{i % 2}", " ".join([f"c{r.randrange(12)}" for _ in range(r.randrange(0, 8))] + [f"r{int(900 * r.random() ** 2)}" for _ in range(r.randrange(0, 5))])) for i in range(60)] + [(100, "s0", None), (101, "none", "c1"), (102, "s0", "c0 c1 c2 c3 c4 c5")]
    q, d = spark.createDataFrame(queries, "query_id long, shop string, query string"), spark.createDataFrame(docs, "doc_id long, shop string, text string")
    b = R.Bm25(q, d, 5)
    got = sorted((x["query_id"], x["doc_id"], x["rank"]) for x in b.top().collect())
    assert got == brute_bm25(queries, docs, 5)
    whole = b.asked.join(b.postings, ["shop", "term"]).count()
    sums = b.first_sums()
    floors = b.floors(sums)
    others = b.others(floors)
    joined = b.met(b.asked.where("rare")).count() + b.met(others.where("need IS NOT NULL").select("query_id", "shop", "term", "need")).count() + b.scored(b.candidates(sums, floors, others)).count()
    assert joined < 0.8 * whole, (joined, whole)
    largest = b.postings.groupBy("shop", "term", "block").count().agg(F.max("count")).first()[0]
    assert largest <= 2.5 * block


def test_bm25_of_few_words(spark, monkeypatch):
    """Where bounds save nothing, each posting asked for is met once: no candidate meets all terms of its query."""
    r = random.Random(3)
    docs = [(i, f"s{i % 2}", " ".join(f"c{r.randrange(30)}" for _ in range(r.randrange(1, 60)))) for i in range(400)]
    queries = [(i, f"s{i % 2}", " ".join(f"c{r.randrange(30)}" for _ in range(9))) for i in range(20)]
    q, d = spark.createDataFrame(queries, "query_id long, shop string, query string"), spark.createDataFrame(docs, "doc_id long, shop string, text string")
    monkeypatch.setattr(R, "RARE", 3)
    monkeypatch.setattr(R.Bm25, "scored", lambda *_: pytest.fail("candidates were made"))
    assert sorted((x["query_id"], x["doc_id"], x["rank"]) for x in R.bm25_top(q, d, 5).collect()) == brute_bm25(queries, docs, 5)


@pytest.mark.parametrize("few", [50_000, 2])
def test_bm25_of_repeated_ids(spark, monkeypatch, few):
    """Rows of one id are one document, and rows without an id count, but are not found."""
    monkeypatch.setattr(R, "FEW_TERMS", few)
    docs = [(1, "s", "a b a"), (1, "s", "c Ж a"), (2, "s", "a \u0416x b"), (3, "s", "c"), (None, "s", "c d d"), (4, None, "c")]
    q = spark.createDataFrame([(7, "s", "c ж d")], "query_id long, shop string, query string")
    got = {x["doc_id"]: x["score"] for x in R.bm25_top(q, spark.createDataFrame(docs, "doc_id long, shop string, text string"), 5).collect()}
    n, mean, df = 4, 13 / 4, {"c": 3, "ж": 1}
    w = lambda t, length: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / mean))
    assert got == {1: pytest.approx(w("c", 6) + w("ж", 6), abs=1e-6), 3: pytest.approx(w("c", 1), abs=1e-6)}


def test_counted_words_are_folded_as_by_spark(spark):
    """Every Latin letter alone, between letters and in capitals, and words that are left to Spark."""
    from shelfstream.functions.text import query_fold, token_counts, tokens

    texts = [f"{a}{chr(c)}{b}" for c in range(1, 0x3C8) for a, b in (("", ""), ("x", "Y"), ("1 ", " z"), ("É", "'Σ"))]
    texts += ["", None, "  ", "ΑΣ ΣΑ'Σ. the\u2003the\u00a0the", "İstanbul ĐÀ e\u0301e \u2019s ½² 東京 東京 the", "Å\u1ea4 a_b \x1ca\x85b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    want = {x["i"]: x["ts"] for x in df.select("i", tokens(query_fold(F.col("text"))).alias("ts")).collect()}
    for only in (None, ["the", "x", "東京"]):
        for x in token_counts(df, only).collect():
            counts, ts = Counter(), want[x["i"]] or []
            for c in x["counts"]:
                counts[c["term"]] += c["n"]
            assert x["len"] == len(ts), repr(texts[x["i"]])
            whole = Counter(ts)
            assert counts == whole if only is None else all(counts[t] == whole[t] for t in only) and not counts - whole, repr(texts[x["i"]])


def brute_similar(lists, least):
    out = {}
    for i, (s, a, x) in enumerate(lists):
        for t, b, y in lists[:i]:
            if s == t and set(x) & set(y):
                keys = set(x) | set(y)
                w = lambda l, p: 1 / l[p] if p in l else 0.0
                j = round(sum(min(w(x, p), w(y, p)) for p in keys) / sum(max(w(x, p), w(y, p)) for p in keys), 6)
                if j >= least:
                    out[s, min(a, b), max(a, b)] = j
    return out


@pytest.mark.parametrize("least,hot", [(0.7, 2000), (0.3, 2000), (0.0, 2000), (0.5, 7)])
def test_similar_lists(spark, monkeypatch, least, hot):
    """Popular products, lists of popular products only, and products dealt to many tasks."""
    monkeypatch.setattr(A, "HOT_LISTS", hot)
    r = random.Random(4)
    lists = []
    for i in range(160):
        base = r.sample(range(6), r.randrange(1, 6)) + r.sample(range(6, 80), r.randrange(0, 8))
        if lists and r.random() < 0.4:
            base = list(r.choice(lists)[2])
            r.shuffle(base) if r.random() < 0.3 else None
        lists.append((f"s{i % 2}", i, {p: n for n, p in enumerate(base, 1)}))
    df = spark.createDataFrame([(s, i, sorted(x.items())) for s, i, x in lists], "shop string, log_id long, items array<struct<product_id:long,rnk:long>>")
    got = {(x["shop"], x["a"], x["b"]): x["similarity"] for x in A.similar_lists(df, "log_id", least).collect()}
    want = brute_similar(lists, least)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want) and len(want) > 20


def test_long_chains_settle_in_few_rounds(spark):
    """A chain of 600 waits takes about log2 rounds, not 600."""
    n = 600
    got = A.leaders(spark.range(n).selectExpr("id", "id AS place"), spark.range(n - 1).selectExpr("id", "id + 1 AS other"), most_rounds=12)
    assert {r["id"]: r["leader"] for r in got.collect()} == {i: i if i % 2 == 0 else i - 1 for i in range(n)}


def test_running_sums_without_a_task_a_key(spark):
    """One key with nearly all rows, null keys, ties broken by the last column."""
    r = random.Random(5)
    rows = [(r.choice(["hot"] * 9 + ["cold", None]), r.randrange(50), i, r.randrange(3)) for i in range(4000)]
    df = spark.createDataFrame(rows, "shop string, at long, id long, v long")
    got = {x["id"]: (x["n"], x["total"]) for x in ranking.running(df, "shop", ["at", F.desc("id")], {"n": F.lit(1), "total": F.col("v")}).collect()}
    want, seen = {}, defaultdict(lambda: [0, 0])
    for s, at, i, v in sorted(rows, key=lambda x: (x[1], -x[2])):
        seen[s][0] += 1
        seen[s][1] += v
        want[i] = tuple(seen[s])
    assert got == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = df.repartitionByRange("shop", "at", F.desc("id")).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts < 0.6 * len(rows)
    assert ranking.places(df.limit(0), "shop", ["at"]).count() == 0


def test_gate_over_a_large_key(spark):
    df = spark.range(3000).selectExpr("'s' AS shop", "id", "id % 7 AS at")
    got = ranking.gate(df, "shop", ["at", "id"], F.lit(1000)).where("accepted").collect()
    assert {x["id"] for x in got} == {i for i in sorted(range(3000), key=lambda i: (i % 7, i))[:1000]}


def test_sketches_of_slices_add_up(spark):
    from shelfstream.operators import catalog as C

    facts = spark.range(60_000).selectExpr("'s' AS shop", "'TAG' AS kind", "IF(id % 3 = 0, 'a', 'b') AS norm_value", "id % 40000 AS product_id", "id % 11 AS day")
    got = {r["norm_value"]: r["products"] for r in C.merged_postings(C.posting_sketches(facts, "day")).collect()}
    want = {r["norm_value"]: r["products"] for r in C.postings(facts).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 0.02 * want[k] for k in want)
