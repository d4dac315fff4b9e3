"""Re-rank features, source ownership, URL routes, feeds and facet samples by cases and plain folds."""

import json
import random

import pytest
from pyspark.sql import functions as F

from shelfstream.functions import urls
from shelfstream.operators import catalog as C
from shelfstream.operators import ownership as N
from shelfstream.operators import rerank as K
from shelfstream.operators import retrieval as R
from shelfstream.streaming import intake


def brute_rerank(candidates, signals, facts, most):
    """Rows of each query: (product, dropped, final), and its order."""
    own = {}
    for p, k, v in facts:
        own.setdefault(p, []).append((k, v))
    out, order = {}, {}
    for q in {c[0] for c in candidates}:
        sig = [s for s in signals if s[0] == q]
        rows = []
        for _, p, score, cosine, mode, evidence in [c for c in candidates if c[0] == q]:
            def cover(kind, value):
                fit, best = K.SIGNAL_FACTS[kind], 0.0
                for k, v in own.get(p, []):
                    if not fit or k in fit:
                        best = max(best, len(set(value.split()) & set(v.split())) / len(set(value.split())))
                return best

            by = {}
            for _, k, v, _, _ in sig:
                by.setdefault(k, {})[v] = cover(k, v)
            most_of = lambda k, by=by: max(by.get(k, {}).values(), default=0.0)
            share = lambda k: sum(x >= 0.75 for x in by[k].values()) / len(by[k]) if by.get(k) else 0.0
            kinds = {k for k, _ in own.get(p, [])}
            who = {w for k, v in own.get(p, []) if k == "AUDIENCE" for w in v.split()}
            rows.append(dict(p=p, score=score, cosine=cosine, mode=mode, evidence=evidence, by=by, m=most_of, need=share("NEED"), source=share("SOURCE"), facets=sum(x >= 0.75 for x in by.get("FACET", {}).values()),
                             known=bool(kinds & set(K._TYPES)), cat="CATEGORY" in kinds, col="COLOUR" in kinds, male=bool(who & set(K.MALE)), female=bool(who & set(K.FEMALE))))
        has = lambda k, ok=lambda s: True: any(s[1] == k and ok(s) for s in sig)
        for r in rows:
            target = has("IDENTITY", lambda s: s[3]) and r["mode"] in ("DIRECT", "COMPLEMENT")
            ground = (r["mode"] == "DIRECT" or r["mode"] == "COMPLEMENT" and target) and max(x["m"]("IDENTITY") for x in rows) >= 0.5 and has("IDENTITY", lambda s: not s[4])
            for_m, for_f = has("AUDIENCE", lambda s: s[2] in K.MALE), has("AUDIENCE", lambda s: s[2] in K.FEMALE)
            another = not r["evidence"] and r["m"]("IDENTITY") < 0.34
            dropped = None
            if for_m != for_f and r["male"] != r["female"] and (r["female"] if for_m else r["male"]):
                dropped = "AUDIENCE"
            elif has("COLOUR") and sum(x["col"] for x in rows) / len(rows) >= 0.9 and r["col"] and r["m"]("COLOUR") < 1:
                dropped = "COLOUR"
            elif r["mode"] == "COMPLEMENT" and r["m"]("REFERENCE") >= 0.75:
                dropped = "REFERENCE"
            elif target and another or ground and r["known"] and another:
                dropped = "IDENTITY"
            elif any(x >= 1 for x in r["by"].get("NEGATIVE", {}).values()):
                dropped = "NEGATIVE"
            elif has("CATEGORY") and max(x["m"]("CATEGORY") for x in rows) >= 0.75 and r["cat"] and r["m"]("CATEGORY") < 0.5:
                dropped = "CATEGORY"
            else:
                dropped = next((k for k in K.HARD_KINDS if has(k, lambda s: s[3]) and r["m"](k) < 0.5), None)
            n = len({s for s in sig if s[1] == "SOURCE"})
            bonus = min(0.24, r["m"]("IDENTITY") * 0.22) if ground else min(0.14, r["m"]("IDENTITY") * 0.12)
            bonus += r["m"]("ATTRIBUTE") * 0.03 + (r["source"] * 0.08 if n >= 2 else 0) + min(0.08, r["facets"] * 0.08) + (0 if r["mode"] == "DISCOVERY" else r["need"] * 0.1) + r["m"]("EXPANSION") * 0.08
            bonus += min(0.08, sum(r["m"](k) for k in (*K.HARD_KINDS, "AUDIENCE")) * 0.02)
            base = min(max(r["score"], 0), 0.995)
            final = round(base + (0.995 - base) * min(bonus, 0.7), 6)
            out[q, r["p"]] = (dropped, final)
            wide = r["mode"] == "DISCOVERY"
            key = (
                -(2 if ground and r["m"]("IDENTITY") >= 0.75 else 1 if target and r["evidence"] else 0), -(r["cosine"] if r["cosine"] is not None else -1.0), -(r["mode"] == "DIRECT" and r["facets"] > 0 and r["m"]("IDENTITY") >= 0.75),
                -(wide and n >= 2 and r["source"] >= 1), -(r["facets"] if ground or target else 0), -(wide and r["source"] >= 0.75), -(round(r["m"]("EXPANSION"), 6) if wide else 0), -(wide and r["m"]("EXPANSION") >= 0.75), -final, -r["score"], r["p"],
            )
            if dropped is None:
                order.setdefault(q, []).append((key, r["p"]))
    return out, {q: [p for _, p in sorted(v)[:most]] for q, v in order.items()}


def test_rerank(spark):
    r = random.Random(6)
    words = "bag bags laptop case red blue travel".split()
    text = lambda n=3: " ".join(r.choice(words) for _ in range(r.randrange(1, n)))
    facts = [(p, r.choice(["CANONICAL_PRODUCT_TYPE", "PRODUCT_TYPE", "ATTRIBUTE", "VENDOR", "MEASUREMENT", "USE_CASE", "MODEL", "COMPATIBILITY", "SKU", "CATEGORY"]), text()) for p in range(60) for _ in range(r.randrange(6))]
    facts += [(p, "COLOUR", r.choice(["red", "blue"])) for p in range(60) if p % 20] + [(p, "AUDIENCE", r.choice(["men", "women", "men women", "kids"])) for p in range(60) if p % 3]
    candidates, signals = [], []
    for q in range(90):
        mode = ["DIRECT", "DISCOVERY", "COMPLEMENT"][q % 3]
        for p in r.sample(range(60), 14):
            candidates.append((q, p, round(r.uniform(-0.1, 1.1), 3), r.choice([None, 0.2, round(r.random(), 3)]), mode, r.random() < 0.2))
        for kind in K.SIGNAL_FACTS:
            for _ in range(r.choice([0, 0, 0, 1, 2])):
                value = r.choice(["men", "women"]) if kind == "AUDIENCE" else r.choice(["red", "blue"]) if kind == "COLOUR" else text()
                signals.append((q, kind, value, r.random() < 0.5, r.random() < 0.3))
    signals = list({(q, k, v): (q, k, v, h, f) for q, k, v, h, f in signals}.values())
    c = spark.createDataFrame(candidates, "query_id long, product_id long, score double, cosine double, mode string, target_evidence boolean")
    s = spark.createDataFrame(signals, "query_id long, kind string, value string, hard boolean, fallback boolean")
    f = spark.createDataFrame(facts, "product_id long, kind string, norm_value string")
    want, order = brute_rerank(candidates, signals, facts, 5)
    rows = {(x["query_id"], x["product_id"]): (x["dropped"], x["final"]) for x in K.rerank_rows(c, s, f).collect()}
    assert rows.keys() == want.keys()
    assert not [(k, rows[k], want[k]) for k in want if rows[k][0] != want[k][0] or abs(rows[k][1] - want[k][1]) >= 2e-6]
    assert {d for d, _ in want.values()} == {None, "AUDIENCE", "COLOUR", "REFERENCE", "IDENTITY", "NEGATIVE", "CATEGORY", *K.HARD_KINDS}
    got = {}
    for x in sorted(K.featured_rerank(c, s, f, 5).collect(), key=lambda x: x["final_rank"]):
        got.setdefault(x["query_id"], []).append(x["product_id"])
    assert got == order
    feats = K.signal_features(c, s, f)
    assert feats.groupBy("query_id", "product_id", "kind", "value").count().where("count > 1").count() == 0 and feats.where("exact AND coverage < 1").count() == 0
    assert K.featured_rerank(c, s.limit(0), f, 99).count() == len(candidates) and K.featured_rerank(c.limit(0), s, f, 5).count() == 0


@pytest.mark.parametrize("text,start,owns", [
    ("black cardigan", 1, True), ("working from home", 2, False), ("something very warm", 2, False), ("i need a portable computer that is light enough to carry", 4, True), ("jacket for rain when i walk home every day", 0, True),
    ("we print labels every morning before school starts in my home office", 9, True), ("boil water every morning at the camp and drink tea", 9, False), ("", 0, False),
])
def test_what_a_query_asks_for(spark, text, start, owns):
    assert spark.range(1).select(N.owns_target(F.lit(text), F.lit(start))).first()[0] is owns


def test_owned_identities(spark):
    q = spark.createDataFrame([(1, "White shirt, please"), (2, "waterproof jacket"), (3, "a gift for winter boots"), (4, "new smart watch")], "query_id long, query string")
    identities = spark.createDataFrame([(1, "white shirt"), (1, "shirt"), (1, "trousers"), (2, "waterproof jacket"), (3, "boots"), (4, "new smart watch"), (4, None), (9, "x")], "query_id long, identity string")
    concepts = spark.createDataFrame([(1, "shirt", "shirt"), (1, "trousers", "trousers"), (2, "jacket", "jacket"), (3, "boots", "winter boots"), (4, "new smart watch", "smart watch")], "query_id long, target string, source string")
    exact, modifiers = spark.createDataFrame([(1, "White"), (1, None)], "query_id long, value string"), spark.createDataFrame([(4, "new"), (4, "smart"), (4, "")], "query_id long, value string")
    got = sorted(map(tuple, N.owned_identities(q, identities, concepts, exact, modifiers).collect()))
    assert got == [(1, "shirt"), (4, "smart watch")]
    kept = N.owned_constraints(q, spark.createDataFrame([(1, "Shirt"), (1, "white"), (3, "boots"), (4, "watch")], "query_id long, value string"), concepts)
    assert sorted(map(tuple, kept.collect())) == [(1, "Shirt"), (3, "boots")]


def test_modes(spark):
    rows = spark.createDataFrame([("COMPLEMENT", True), ("DISCOVERY", True), ("DISCOVERY", False), (None, False), ("OTHER", True)], "raw string, has boolean")
    assert [x[0] for x in rows.select(N.resolved_mode(F.col("raw"), F.col("has"))).collect()] == ["COMPLEMENT", "DIRECT", "DISCOVERY", "DIRECT", "DIRECT"]


@pytest.mark.parametrize("query,target,reason", [
    ("red shoes", "/search?q=red+shoes&type=product&sort_by=relevance&options%5Bprefix%5D=last", "SEMANTIC_PRODUCT_SEARCH"), ("red shoes", "/search?type=product&q=a%3Db=c&page=3", "SEMANTIC_PRODUCT_SEARCH"),
    ("red shoes", "/search?type=product&Sort_By=relevance", "UNSUPPORTED_SEARCH_PARAM:Sort_By"), ("red shoes", "/search?type=product&t.category=1", "UNSUPPORTED_SEARCH_PARAM:t.category"), ("red shoes", "/search?type=product&sort_by=price", "NON_RELEVANCE_SORT"),
    ("red shoes", "/search?type=product&page=-1", "INVALID_PAGE"), ("red shoes", "/search?type=product&page=2x", "SEMANTIC_PRODUCT_SEARCH"), ("red shoes", "/search?type=product&options[prefix]=first", "UNSUPPORTED_PREFIX_MODE"),
    ("red shoes", "/search?type=product,page", "SEARCH_TYPES_NOT_PRODUCT_ONLY"), ("red shoes", "/search", "SEARCH_TYPES_UNSCOPED"), ("red shoes", None, "NATIVE_SEARCH_CONTEXT_MISSING"), ("red shoes", "https://x/search?type=product", "NATIVE_SEARCH_CONTEXT_MISSING"),
    ("  ", "/search?type=product", "EMPTY_QUERY"), (None, None, "EMPTY_QUERY"), ("ab", None, "QUERY_TOO_SHORT_FOR_SEMANTIC"), ("x" * 501, None, "QUERY_TOO_LONG"), ("cat OR dog", None, "QUERY_SYNTAX"), ("title:x", None, "QUERY_SYNTAX"), ("'a b'", None, "QUERY_SYNTAX"), ("wor*", None, "QUERY_SYNTAX"),
    ("red shoes", "/search?type=product&bad=%zz", "UNSUPPORTED_SEARCH_PARAM:bad"),
])
def test_search_routes(spark, query, target, reason):
    row = spark.createDataFrame([(query, target)], "q string, t string").select(urls.search_route(F.col("q"), F.col("t")).alias("r")).first()["r"]
    assert (row["reason"], row["engine"]) == (reason, "AI" if reason == "SEMANTIC_PRODUCT_SEARCH" else "NATIVE")


def test_feeds_as_a_stream(spark, tmp_path):
    """Every event goes to its feed or to the rejects, once, also when a batch comes again."""
    good = {
        "CLICK": {"searchLogId": " 5 ", "productId": "7", "x": {"y": 1}}, "APP_SUBSCRIPTIONS_UPDATE": {"app_subscription": {"admin_graphql_api_id": "sub/1", "status": "ACTIVE", "plan_handle": "pro"}},
        "APP_UNINSTALLED": {"domain": "d"}, "PRODUCTS_DELETE": {"id": 8}, "PRODUCTS_UPDATE": {"id": 8, "admin_graphql_api_id": "gid/8", "title": "t"},
    }
    rows = [(i, "s", t, json.dumps(p)) for i, (t, p) in enumerate(good.items())]
    bad = [("CLICK", '{"searchLogId":"5"}', "MISSING:detail"), ("CLICK", "[1]", "MALFORMED"), ("CLICK", None, "MALFORMED"), ("APP_SUBSCRIPTIONS_UPDATE", '{"app_subscription":{"admin_graphql_api_id":"s","status":"LOST"}}', "UNKNOWN_STATUS"),
           ("APP_SUBSCRIPTIONS_UPDATE", '{"app_subscription":null}', "MISSING:key"), ("PRODUCTS_UPDATE", '{"id":', "MALFORMED"), ("OTHER", "{}", "UNKNOWN_TOPIC"), (None, "{}", "UNKNOWN_TOPIC")]
    rows += [(100 + i, "s", t, p) for i, (t, p, _) in enumerate(bad)]
    df = spark.createDataFrame(rows, "event_id long, shop string, topic string, payload string")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(2):
        df.where(F.col("event_id") % 2 == i).coalesce(1).write.parquet(f"{src}/f{i}")
    sink = intake.feed_sink(out)

    def twice(batch, number):
        sink(batch, number)
        sink(batch, number)

    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    q = stream.writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    read = lambda name: [r.asDict() for r in spark.read.parquet(f"{out}/{name}").collect()]
    assert sorted((r["event_id"], r["reject"]) for r in read("rejects")) == [(100 + i, why) for i, (_, _, why) in enumerate(bad)]
    kept = {r["event_id"]: (r["key"], r["status"], r["detail"]) for name in ("product", "subscription", "uninstall", "click") for r in read(name)}
    assert kept == {0: ("5", None, "7"), 1: ("sub/1", "ACTIVE", "pro"), 2: ("s", None, "d"), 3: ("8", None, None), 4: ("gid/8", None, "t")}


def test_facet_samples_and_complete_shops(spark):
    products = spark.createDataFrame([("s", i, f"Red {'Bolt' if i % 2 else 'ring'} {i}", i != 3) for i in range(30)], "shop string, product_id long, title string, has_vector boolean")
    facts = spark.createDataFrame([("s", i, k, f"{v}{j}") for i in range(12) for j in range(3) for k, v in (("ATTRIBUTE", "a"), ("IDENTIFIER", "x"), ("VARIANT_OPTION", "size="), ("VARIANT_OPTION", "plain"))], "shop string, product_id long, kind string, norm_value string")
    got = {(r["pattern"], r["product_id"]): (r["facets"], r["options"]) for r in C.facet_samples(products, facts, ["bolt", "RING", "none"], most=3, facets=2, options=2).collect()}
    assert sorted(got) == [("RING", 0), ("RING", 2), ("RING", 4), ("bolt", 1), ("bolt", 5), ("bolt", 7)] and set(map(str, got.values())) == {str((["ATTRIBUTE:a0", "ATTRIBUTE:a1"], ["size=0", "size=1"]))}
    a, b = spark.createDataFrame([("x", 0), ("y", 1), ("z", 0)], "shop string, missing long"), spark.createDataFrame([("x", True), ("y", True), ("w", True)], "shop string, covered boolean")
    assert {r["shop"]: r["complete"] for r in R.complete_shops(a, b).collect()} == {"x": True, "y": False, "z": False, "w": False}
