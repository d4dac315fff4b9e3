"""Queries of the retrieval lanes and their fusion."""

from pyspark.sql import functions as F

from ..functions.text import query_fold, tokens
from ..operators import retrieval as R
from ..operators.lineage import settled
from ..operators.ranking import ranked
from .registry import query

_FOLD = "trim(regexp_replace(replace(strip_accents(lower({0})), 'đ', 'd'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def fold(c: str) -> str:
    return _FOLD.format(c)


def toks(c: str) -> str:
    return f"list_filter(string_split({fold(c)}, ' '), lambda t: t <> '')"


_SHOP = "concat('shop_', CAST(label % 3 AS VARCHAR))"
_DENSE = f"""pr AS (SELECT vec_id AS product_id, {_SHOP} AS shop, embedding FROM embeddings WHERE vec_id % 100 <> 0),
qv AS (SELECT vec_id AS query_id, {_SHOP} AS shop, embedding FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, product_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6) AS score FROM qv q JOIN pr p USING (shop)),
dense AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS INTEGER) AS rank FROM s WHERE score >= 0.1)"""


def _vectors(t):
    rows = t("embeddings").select("vec_id", F.concat(F.lit("shop_"), (F.col("label") % 3).cast("string")).alias("shop"), "embedding")
    queries = rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return queries, rows.where("vec_id % 100 <> 0").withColumnRenamed("vec_id", "product_id")


@query("ret1_dense_top", (), f"WITH {_DENSE} SELECT * FROM dense WHERE rank <= 20")
def _(t):
    return R.dense_top(*_vectors(t), 20, 0.1)


@query("ret1_dense_cells")
def _(t):
    return R.cell_top(*_vectors(t), k=20, cells=16, probes=12)


@query("ret6_branch_fusion", (), f"""WITH {_DENSE}, b AS (SELECT query_id % 300 AS query_id, product_id, query_id // 300 AS branch, max(score) AS score FROM s WHERE score > 0.05 GROUP BY ALL),
r AS (SELECT *, score / max(score) OVER (PARTITION BY query_id, branch) AS relative FROM b)
SELECT query_id, product_id, max(score) AS raw, max(score) FILTER (WHERE branch = 0) AS primary_score, round(max(relative), 6) AS relative, round(max(score * CASE WHEN branch = 0 THEN 1 ELSE CAST(0.9 AS DOUBLE) END) + least((count(*) - 1) * CAST(0.01 AS DOUBLE), 0.03), 4) AS fused FROM r GROUP BY 1, 2""")
def _(t):
    rows = R.dense_top(*_vectors(t), None, -1.0).where("score > 0.05")
    rows = rows.select((F.col("query_id") % 300).alias("query_id"), "product_id", F.floor(F.col("query_id") / 300).alias("branch"), "score")
    out = R.fuse_branches(rows.groupBy("query_id", "product_id", "branch").agg(F.max("score").alias("score")))
    return out.select("query_id", "product_id", "raw", F.col("primary").alias("primary_score"), F.round("relative", 6).alias("relative"), F.round("fused", 4).alias("fused"))


@query("ret7_adaptive_threshold", (), f"""WITH {_DENSE} SELECT query_id, round(greatest(0.1, max(score) * 0.78), 6) AS threshold, round(CASE WHEN count(*) >= 8 THEN greatest(0.1, least(greatest(0.1, max(score) * 0.88), max(score) FILTER (WHERE rank = 8))) ELSE greatest(0.1, max(score) * 0.88) END, 6) AS discovery FROM dense GROUP BY query_id""")
def _(t):
    rows = R.dense_top(*_vectors(t), 1000, 0.1)
    direct, wide = R.adaptive_threshold(rows, 0.1, 0.78), R.adaptive_threshold(rows, 0.1, 0.88, 8)
    return direct.join(wide.withColumnRenamed("threshold", "discovery"), "query_id").select("query_id", F.round("threshold", 6).alias("threshold"), F.round("discovery", 6).alias("discovery"))


@query("ret8_no_evidence_guard", (), f"""WITH {_DENSE}, w AS (SELECT query_id FROM dense GROUP BY query_id HAVING max(score) < 0.4 AND query_id % 300 <> 0) SELECT query_id, product_id, score FROM dense WHERE query_id NOT IN (SELECT query_id FROM w) AND rank <= 10""")
def _(t):
    rows = R.dense_top(*_vectors(t), 1000, 0.1)
    evidence = _vectors(t)[0].where("query_id % 300 = 0")
    return R.reject_without_evidence(rows, evidence, 0.4).where("rank <= 10").select("query_id", "product_id", "score")


@query("ret9_recall_admission", (), f"""WITH {_DENSE}, r AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS relative FROM dense) SELECT query_id, product_id FROM r WHERE score >= 0.35 OR query_id % 200 = 0 AND relative >= 0.92 AND score >= 0.2""")
def _(t):
    rows = R.dense_top(*_vectors(t), None, 0.1)
    rows = rows.join(rows.groupBy("query_id").agg(F.max("score").alias("best")), "query_id")
    return rows.where((F.col("score") >= 0.35) | ((F.col("query_id") % 200 == 0) & (F.col("score") / F.col("best") >= 0.92) & (F.col("score") >= 0.2))).select("query_id", "product_id")


_BM25 = f"""w0 AS (SELECT lang AS shop, doc_id, unnest({toks("text")}) AS term FROM documents),
ln AS (SELECT shop, doc_id, count(*) AS len FROM w0 GROUP BY 1, 2), st AS (SELECT shop, avg(len) AS avg_len, count(*) AS n_docs FROM ln GROUP BY 1),
q0 AS (SELECT item_id AS query_id, ['en', 'fr', 'de', 'es'][item_id % 4 + 1] AS shop, {toks("text")} AS ws FROM benchmark),
qt AS (SELECT DISTINCT query_id, shop, unnest(ws) AS term FROM q0), po AS (SELECT shop, term, doc_id, count(*) AS tf FROM w0 GROUP BY 1, 2, 3), dfs AS (SELECT shop, term, count(*) AS df FROM po GROUP BY 1, 2),
sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len)))), 6) AS score FROM qt JOIN po USING (shop, term) JOIN dfs USING (shop, term) JOIN ln USING (shop, doc_id) JOIN st USING (shop) GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 10"""


def _bm25(t, k):
    lang = F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (F.col("item_id") % 4 + 1).cast("int"))
    queries = t("benchmark").select(F.col("item_id").alias("query_id"), lang.alias("shop"), F.col("text").alias("query"))
    return R.bm25_top(queries, t("documents").select("doc_id", F.col("lang").alias("shop"), "text"), k)


@query("ret2_bm25_top", (), "WITH " + _BM25)
def _(t):
    return _bm25(t, 10)


_TITLE = f"""tq AS (SELECT log_id AS query_id, shop, query FROM query_log),
tf AS (SELECT query_id, shop, {fold("query")} AS f, list_distinct(list_filter({toks("query")}, lambda x: length(x) >= 2 AND x NOT IN ('most', 'more', 'less', 'can', 'with', 'best', 'good'))) AS ws FROM tq),
tp AS (SELECT shop, product_id, {fold("title")} AS tt, list_distinct(list_concat({toks("title")}, {toks("replace(handle, '-', ' ')")})) AS own, {toks("title")} AS ts FROM products),
th AS (SELECT query_id, q.shop, product_id, CASE WHEN tt = f THEN 'EXACT_TITLE' WHEN contains(tt, f) THEN 'TITLE_PHRASE' WHEN list_has_all(ts, ws) THEN 'TITLE_TOKENS' ELSE 'HANDLE' END AS kind FROM tf q JOIN tp p ON p.shop = q.shop AND list_has_all(own, ws) WHERE len(ws) > 0),
title AS (SELECT *, CASE kind WHEN 'EXACT_TITLE' THEN CAST(0.995 AS DOUBLE) WHEN 'TITLE_PHRASE' THEN 0.985 WHEN 'TITLE_TOKENS' THEN 0.96 ELSE 0.94 END AS score FROM th)"""


@query("ret3_exact_title", ("query_log", "products"), f"WITH {_TITLE} SELECT * FROM title QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) <= 100")
def _(t):
    q = t("query_log").select(F.col("log_id").alias("query_id"), "shop", "query")
    return R.title_lane(q, t("products"))


_MATCH = """fm AS (SELECT DISTINCT w.query_id, w.shop, f.product_id, w.kind, w.norm_value, w.mode, w.confidence FROM wanted w JOIN facts f ON f.shop = w.shop AND f.norm_value = w.norm_value
  AND (w.kind = 'PRODUCT_TYPE' AND f.kind IN ('CANONICAL_PRODUCT_TYPE', 'PRODUCT_TYPE', 'ALIAS', 'CATEGORY') OR w.kind = 'BRAND' AND f.kind IN ('BRAND', 'VENDOR') OR w.kind = 'MEASUREMENT' AND f.kind IN ('MEASUREMENT', 'VARIANT_OPTION') OR w.kind = 'ATTRIBUTE' AND f.kind IN ('ATTRIBUTE', 'VARIANT_OPTION')))"""
_KIND = "(SELECT unnest(['PRODUCT_TYPE', 'BRAND', 'MEASUREMENT', 'ATTRIBUTE']) AS kind, unnest([40, 20, 8, 6]) AS weight, unnest([CAST(0.92 AS DOUBLE), 0.88, 0.8, 0.62]) AS ceiling)"
_FACTS = f"""{_MATCH}, kw AS {_KIND},
asked AS (SELECT query_id, sum(weight * confidence) FILTER (WHERE mode <> 'MUST_NOT') AS all_weight, count(*) FILTER (WHERE mode = 'MUST') AS musts FROM wanted JOIN kw USING (kind) GROUP BY 1),
pf AS (SELECT query_id, shop, product_id, sum(CASE WHEN mode <> 'MUST_NOT' THEN weight * confidence ELSE 0 END) AS weight, count(*) FILTER (WHERE mode = 'MUST') AS got, bool_or(mode = 'MUST_NOT') AS excluded,
  bool_or(mode <> 'MUST_NOT' AND kind <> 'ATTRIBUTE' AND confidence >= 0.75 AND (kind <> 'MEASUREMENT' OR mode = 'MUST')) AS anchored, list_sort(list(DISTINCT kind) FILTER (WHERE mode <> 'MUST_NOT')) AS kinds, max(ceiling) FILTER (WHERE mode <> 'MUST_NOT') AS ceiling FROM fm JOIN kw USING (kind) GROUP BY 1, 2, 3),
fact_lane AS (SELECT query_id, shop, product_id, round(ceiling * weight / all_weight, 6) AS score, weight, kinds FROM pf JOIN asked USING (query_id) WHERE anchored AND NOT excluded AND got = musts)"""


@query("ret4_exact_facts", ("wanted", "facts"), f"WITH {_FACTS} SELECT query_id, shop, product_id, score, round(weight, 6) AS weight, array_to_string(kinds, ',') AS kinds FROM fact_lane QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, weight DESC, product_id) <= 500")
def _(t):
    return R.fact_lane(t("wanted"), t("facts")).select("query_id", "shop", "product_id", "score", F.round("weight", 6).alias("weight"), F.array_join("kinds", ",").alias("kinds"))


@query("jn12_fact_matches", ("wanted", "facts"), f"WITH {_MATCH} SELECT query_id, product_id, kind, norm_value, mode FROM fm")
def _(t):
    return R.fact_matches(t("wanted"), t("facts")).select("query_id", "product_id", "kind", "norm_value", "mode")


@query("ret5_grounded_facets", ("wanted", "facts"), f"WITH {_MATCH}, n AS (SELECT query_id, count(DISTINCT (kind, norm_value)) AS need FROM wanted WHERE kind IN ('ATTRIBUTE', 'PRODUCT_TYPE') GROUP BY 1), g AS (SELECT query_id, product_id, count(DISTINCT (kind, norm_value)) AS got FROM fm WHERE kind IN ('ATTRIBUTE', 'PRODUCT_TYPE') GROUP BY 1, 2) SELECT query_id, product_id, CAST(0.72 AS DOUBLE) AS score FROM g JOIN n USING (query_id) WHERE got = need")
def _(t):
    return R.all_values(t("wanted").where("kind IN ('ATTRIBUTE', 'PRODUCT_TYPE')"), t("facts"), 0.72)


@query("jn16_all_facets", ("facts",), "SELECT shop, product_id FROM facts WHERE kind = 'CANONICAL_PRODUCT_TYPE' AND norm_value IN ('bolt', 'ring') OR kind = 'ATTRIBUTE' AND norm_value IN ('hot', 'red', 'blue') GROUP BY 1, 2 HAVING count(DISTINCT kind) = 2")
def _(t):
    hit = ((F.col("kind") == "CANONICAL_PRODUCT_TYPE") & F.col("norm_value").isin("bolt", "ring")) | ((F.col("kind") == "ATTRIBUTE") & F.col("norm_value").isin("hot", "red", "blue"))
    return t("facts").where(hit).groupBy("shop", "product_id").agg(F.countDistinct("kind").alias("n")).where("n = 2").select("shop", "product_id")


@query("ret18_absence_proof", ("wanted", "facts", "products"), f"""WITH {_MATCH}, n AS (SELECT query_id, shop, count(*) AS need, min(confidence) AS sure FROM wanted WHERE mode = 'MUST' GROUP BY 1, 2), g AS (SELECT query_id, max(got) AS got FROM (SELECT query_id, product_id, count(*) AS got FROM fm WHERE mode = 'MUST' GROUP BY 1, 2) GROUP BY 1),
kf AS (SELECT DISTINCT f.shop, f.product_id FROM facts f JOIN products p ON p.shop = f.shop AND p.product_id = f.product_id WHERE NOT (p.shop = 'shop_1' AND p.size_no = 50)), c AS (SELECT p.shop, count(*) = count(kf.product_id) AS complete FROM products p LEFT JOIN kf ON kf.shop = p.shop AND kf.product_id = p.product_id GROUP BY 1)
SELECT n.query_id, n.shop, CASE WHEN coalesce(got = need, false) THEN 'PRESENT' WHEN coalesce(complete, false) AND sure >= 0.99 THEN 'CERTAIN' ELSE 'UNKNOWN' END AS status FROM n LEFT JOIN g USING (query_id) LEFT JOIN c ON c.shop = n.shop""")
def _(t):
    """Completeness from the facts themselves; products of size 50 stand for those of shop_1 whose facts are not there yet."""
    from ..operators import catalog as C

    facts, products = t("facts"), t("products")
    late = products.where("size_no = 50 AND shop = 'shop_1'").select("shop", "product_id")
    known = facts.join(late, ["shop", "product_id"], "left_anti")
    done = C.product_tokens(known).where("complete").groupBy("shop").agg(F.count("*").alias("complete"))
    payload = products.groupBy("shop").agg(F.count("*").alias("registered")).join(done, "shop", "left").select("shop", (F.col("registered") == F.col("complete")).alias("covered"))
    return R.absence_status(t("wanted"), facts, R.complete_shops(C.coverage(products, known), payload))


@query("ret18_absence_status", ("wanted", "facts", "products"), f"""WITH {_MATCH}, n AS (SELECT query_id, shop, count(*) AS need, min(confidence) AS sure FROM wanted WHERE mode = 'MUST' GROUP BY 1, 2), g AS (SELECT query_id, max(got) AS got FROM (SELECT query_id, product_id, count(*) AS got FROM fm WHERE mode = 'MUST' GROUP BY 1, 2) GROUP BY 1)
SELECT n.query_id, n.shop, CASE WHEN coalesce(got = need, false) THEN 'PRESENT' WHEN n.shop <> 'shop_1' AND sure >= 0.99 THEN 'CERTAIN' ELSE 'UNKNOWN' END AS status FROM n LEFT JOIN g USING (query_id)""")
def _(t):
    complete = t("products").select("shop").distinct().withColumn("complete", F.col("shop") != "shop_1")
    return R.absence_status(t("wanted"), t("facts"), complete)


_LANES = f"""{_FACTS},
wq AS (SELECT DISTINCT query_id, shop, p.p_name AS query FROM wanted JOIN part p ON p.p_partkey = query_id),
hd AS (SELECT query_id, product_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM (SELECT DISTINCT query_id, shop FROM wanted) w JOIN embeddings a ON a.vec_id = query_id // 100 JOIN products p ON p.shop = w.shop AND p.has_vector AND p.searchable JOIN embeddings v ON v.vec_id = p.product_id),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM hd WHERE score >= 0.1 QUALIFY rank <= 100),
tw AS (SELECT shop, product_id, unnest({toks("title")}) AS term FROM products), tl AS (SELECT shop, product_id, count(*) AS len FROM tw GROUP BY 1, 2), ts AS (SELECT shop, avg(len) AS avg_len, count(*) AS n_docs FROM tl GROUP BY 1),
tp AS (SELECT shop, term, product_id, count(*) AS tf FROM tw GROUP BY 1, 2, 3), td AS (SELECT shop, term, count(*) AS df FROM tp GROUP BY 1, 2),
hs AS (SELECT query_id, product_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len)))), 6) AS score FROM (SELECT DISTINCT query_id, shop, unnest({toks("query")}) AS term FROM wq) a JOIN tp USING (shop, term) JOIN td USING (shop, term) JOIN tl USING (shop, product_id) JOIN ts USING (shop) GROUP BY 1, 2),
sp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM hs QUALIFY rank <= 100),
lx AS (SELECT query_id, product_id, CAST(0.995 AS DOUBLE) AS score FROM wq w JOIN products p ON p.shop = w.shop AND {fold("p.title")} = {fold("w.query")}),
fl AS (SELECT query_id, product_id, score, kinds FROM fact_lane QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, weight DESC, product_id) <= 500),
ln AS (SELECT query_id, product_id, 1 / (60 + rank) AS c, score AS cosine, NULL AS lexical, NULL AS structured, NULL AS kinds FROM d UNION ALL SELECT query_id, product_id, 1 / (60 + rank), NULL, NULL, NULL, NULL FROM sp
  UNION ALL SELECT query_id, product_id, NULL, NULL, score, NULL, NULL FROM lx UNION ALL SELECT query_id, product_id, NULL, NULL, NULL, score, kinds FROM fl),
mg AS (SELECT query_id, product_id, sum(c) AS raw, max(cosine) AS cosine, max(lexical) AS lexical, max(structured) AS structured, coalesce(max(kinds), []) AS kinds FROM ln GROUP BY 1, 2),
m2 AS (SELECT *, CASE WHEN raw IS NOT NULL THEN least(1, raw / (CAST(2 AS DOUBLE) / 61)) END AS rrf, list_contains(kinds, 'MEASUREMENT') AS closed, list_contains(kinds, 'BRAND') AND list_contains(kinds, 'PRODUCT_TYPE') AS branded, len(kinds) >= 2 AS several FROM mg),
m3 AS (SELECT *, CASE WHEN rrf IS NULL THEN lexical WHEN lexical IS NULL THEN rrf ELSE greatest(rrf, lexical) END AS found, CASE WHEN closed THEN 0.08 ELSE 0 END + CASE WHEN several THEN CAST(0.045 AS DOUBLE) ELSE 0 END AS boost,
  CASE WHEN closed THEN CAST(0.96 AS DOUBLE) WHEN branded THEN 0.86 WHEN several AND list_contains(kinds, 'PRODUCT_TYPE') THEN 0.72 END AS ceiling FROM m2),
m4 AS (SELECT *, round(CASE WHEN found IS NULL THEN CASE WHEN closed OR branded THEN least(structured, ceiling) ELSE least(structured, ceiling, CAST(0.379 AS DOUBLE)) END
  WHEN structured IS NOT NULL THEN least(0.995, least(greatest(found, 0), 0.995) + (0.995 - least(greatest(found, 0), 0.995)) * boost) ELSE found END, 6) AS score FROM m3),
fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(rrf, 0) DESC, coalesce(lexical, 0) DESC, coalesce(structured, 0) DESC, cosine DESC NULLS LAST, product_id) AS INTEGER) AS rank FROM m4 WHERE score IS NOT NULL AND NOT (found IS NULL AND ceiling IS NULL))"""


def lanes(t):
    """The four lanes of the ``wanted`` queries: cosines of their vectors, BM25 of titles, exact titles, exact facts."""
    wanted, products = t("wanted"), t("products")
    names = t("part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"))
    queries = wanted.select("query_id", "shop").distinct().join(names, "query_id")
    vectors = t("embeddings").select("vec_id", "embedding")
    asked = queries.join(vectors, F.floor(F.col("query_id") / 100) == F.col("vec_id")).select("query_id", "shop", "embedding")
    goods = products.where("has_vector AND searchable").join(vectors, F.col("product_id") == F.col("vec_id")).select("shop", "product_id", "embedding")
    dense = R.dense_top(asked, goods, 100, 0.1)
    titles = products.select("shop", F.col("product_id").alias("doc_id"), F.col("title").alias("text"))
    sparse = settled(R.bm25_top_of_copies(queries, titles, 100).withColumnRenamed("doc_id", "product_id"))
    dense, structured = settled(dense), R.fact_lists(wanted, t("facts"), 500)
    key = ["query_id", "product_id"]
    others = dense.select(*key).union(sparse.select(*key)).union(structured.select("query_id", F.explode("product_ids").alias("product_id")))
    return dense, sparse, R.exact_title_lists(queries, products, others, 100 + 100 + 500 + SHOWN), structured


#: Rows of a query that the fusion shows.
SHOWN = 20


def hybrid(t):
    return R.fuse_lanes(*lanes(t), floor=0.35, most=SHOWN)


VIEWS = ("wanted", "facts", "products")


@query("ret10_hybrid_fusion", VIEWS, f"WITH {_LANES} SELECT query_id, product_id, score, rank FROM fused WHERE rank <= 20")
def _(t):
    return hybrid(t).select("query_id", "product_id", "score", "rank")


@query("ret11_lane_sources", VIEWS, f"WITH {_LANES} SELECT query_id, product_id, concat_ws(',', CASE WHEN lexical IS NOT NULL THEN 'LEXICAL' END, CASE WHEN cosine IS NOT NULL THEN 'SEMANTIC' END, CASE WHEN product_id IN (SELECT product_id FROM sp WHERE sp.query_id = fused.query_id) THEN 'SPARSE' END, CASE WHEN structured IS NOT NULL THEN 'STRUCTURED' END) AS sources FROM fused WHERE rank <= 20")
def _(t):
    return hybrid(t).select("query_id", "product_id", F.array_join("sources", ",").alias("sources"))


@query("ret12_fusion_counts", VIEWS, f"WITH {_LANES} SELECT query_id, count(*) AS results, count(*) FILTER (WHERE cosine IS NOT NULL) AS dense, count(*) FILTER (WHERE lexical IS NOT NULL) AS lexical, count(*) FILTER (WHERE structured IS NOT NULL) AS structured FROM fused WHERE rank <= 20 GROUP BY 1")
def _(t):
    has = lambda s: F.count_if(F.array_contains("sources", s))
    return hybrid(t).groupBy("query_id").agg(F.count("*").alias("results"), has("SEMANTIC").alias("dense"), has("LEXICAL").alias("lexical"), has("STRUCTURED").alias("structured"))


@query("ret13_final_cut", VIEWS, f"WITH {_LANES} SELECT query_id, product_id, rank FROM fused WHERE rank <= 20 AND (query_id % 300 = 0 AND (lexical IS NOT NULL OR closed) OR cosine >= 0.5)")
def _(t):
    rows = hybrid(t).select("*", F.when(F.col("query_id") % 300 == 0, "DIRECT").otherwise("DISCOVERY").alias("mode"), F.col("cosine").alias("primary_cosine"), F.when(F.col("lexical").isNotNull(), "EXACT_TITLE").alias("lexical_kind"), F.coalesce("kinds", F.array().cast("array<string>")).alias("anchor_kinds"), F.lit(False).alias("rescued"))
    return R.final_cut(rows, 0.5).select("query_id", "product_id", "rank")


@query("win9_price_bands", VIEWS, f"""WITH {_LANES}, b AS (SELECT f.query_id, f.product_id, f.score, p.price, CAST(floor((max(f.score) OVER (PARTITION BY f.query_id) - f.score) / 0.03 + 0.000000001) AS BIGINT) AS band FROM fused f JOIN products p ON p.product_id = f.product_id WHERE rank <= 20)
SELECT query_id, product_id, band, CAST(row_number() OVER (PARTITION BY query_id ORDER BY band, price, score DESC, product_id) AS INTEGER) AS rank FROM b""")
def _(t):
    rows = hybrid(t).drop("rank").join(t("products").select("product_id", "price"), "product_id")
    return R.price_order(rows).select("query_id", "product_id", "band", "rank")


@query("win13_branch_champions", VIEWS, f"""WITH {_LANES}, b0 AS (SELECT query_id, product_id, score, cosine, rank, product_id % 4 AS branch FROM fused WHERE rank <= 20),
b AS (SELECT *, score / max(score) OVER (PARTITION BY query_id, branch) AS relative, count(*) OVER (PARTITION BY query_id) AS n, first_value(score) OVER (PARTITION BY query_id ORDER BY rank) AS top_score FROM b0),
g AS (SELECT *, coalesce(branch > 0 AND relative >= 0.9 AND cosine >= 0.2 AND score >= 0.72 * top_score, false) AS good FROM b),
c AS (SELECT *, good AND row_number() OVER (PARTITION BY query_id, branch, good ORDER BY rank) = 1 AS champion FROM g),
o AS (SELECT *, n >= 4 AND count(*) FILTER (WHERE champion) OVER (PARTITION BY query_id) >= 2 AS open FROM c),
k AS (SELECT *, CASE WHEN rank = 1 THEN 0 WHEN open AND champion AND count(*) FILTER (WHERE champion AND rank > 1) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) < 4 THEN 1 ELSE 2 END AS key FROM o)
SELECT query_id, product_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY key, rank) AS INTEGER) AS final_rank FROM k""")
def _(t):
    from pyspark.sql import Window as W

    rows = hybrid(t).withColumn("branch", F.col("product_id") % 4)
    rows = rows.withColumns({"relative": F.col("score") / F.max("score").over(W.partitionBy("query_id", "branch")), "primary_cosine": F.col("cosine")})
    return R.diversify(rows, 0.2).select("query_id", "product_id", "final_rank")


@query("jn11_fuzzy_names", ("products",), """WITH n AS (SELECT DISTINCT shop, split_part(title, ' ', 1) AS name FROM products), w AS (SELECT shop, concat(name, 'x') AS word FROM n UNION SELECT shop, substr(name, 2) FROM n),
m AS (SELECT DISTINCT w.shop, word, name FROM w JOIN n ON n.shop = w.shop AND abs(length(word) - length(name)) = 1 AND levenshtein(word, name) = 1)
SELECT shop, word, min(name) AS name, CAST(0.9 AS DOUBLE) AS confidence FROM m GROUP BY 1, 2 HAVING count(*) = 1""")
def _(t):
    names = t("products").select("shop", F.split_part("title", F.lit(" "), F.lit(1)).alias("name")).distinct()
    words = names.select("shop", F.concat("name", F.lit("x")).alias("word")).union(names.select("shop", F.substring("name", F.lit(2), F.length("name")).alias("word"))).distinct()
    return R.fuzzy_matches(words, names)


@query("jn10_phrase_matches", ("query_log", "facts"), f"""WITH q AS (SELECT DISTINCT log_id AS query_id, shop, {toks("query")} AS ws FROM query_log),
d AS (SELECT DISTINCT shop, norm_value AS phrase, kind AS field FROM facts WHERE kind = 'ATTRIBUTE' UNION SELECT DISTINCT shop, title, 'TITLE' FROM products),
l AS (SELECT query_id, array_to_string(ws, ' ') AS phrase, field, 0 AS start, 2 AS n FROM q JOIN d ON d.shop = q.shop AND d.phrase = array_to_string(ws, ' ') WHERE len(ws) = 2),
o AS (SELECT query_id, ws[i] AS phrase, field, i - 1 AS start, 1 AS n FROM (SELECT query_id, shop, ws, unnest(range(1, len(ws) + 1)) AS i FROM q) q JOIN d ON d.shop = q.shop AND d.phrase = ws[i] WHERE query_id NOT IN (SELECT query_id FROM l))
SELECT query_id, phrase, field, CAST(start AS INTEGER) AS start, CAST(n AS INTEGER) AS n FROM l UNION ALL SELECT query_id, phrase, field, CAST(start AS INTEGER), CAST(n AS INTEGER) FROM o""")
def _(t):
    q = t("query_log").select(F.col("log_id").alias("query_id"), "shop", "query")
    d = t("facts").where("kind = 'ATTRIBUTE'").select("shop", F.col("norm_value").alias("phrase"), F.col("kind").alias("field")).distinct()
    titles = t("products").select("shop", F.col("title").alias("phrase"), F.lit("TITLE").alias("field")).distinct()
    return R.phrase_matches(q, d.unionByName(titles), 2)


@query("ret21_query_reuse", ("query_log", "sync_jobs"), """WITH r AS (SELECT shop, count(*) AS catalog_revision, count_if(topic = 'REINDEX_PRODUCT') AS semantic_revision FROM sync_jobs GROUP BY 1)
SELECT sha256(concat_ws('|', shop, lower(trim(query)), CASE WHEN user_id % 2 = 0 THEN 'en' ELSE 'vi' END, CAST(coalesce(catalog_revision, 0) AS VARCHAR), CAST(coalesce(semantic_revision, 0) AS VARCHAR), 'v1')) AS key, count(*) AS uses, min(log_id) AS first_log, max(result_count) > 0 OR min(shop) <> 'shop_1' AS reusable FROM query_log LEFT JOIN r USING (shop) GROUP BY 1""")
def _(t):
    """Searches that may share one result: same tenant, text, language, revisions and pipeline; an empty result only where absence is proven (complete catalogs)."""
    jobs = t("sync_jobs").groupBy("shop").agg(F.count("*").alias("catalog_revision"), F.count_if(F.col("topic") == "REINDEX_PRODUCT").alias("semantic_revision"))
    rows = t("query_log").join(jobs, "shop", "left").withColumn("language", F.when(F.col("user_id") % 2 == 0, "en").otherwise("vi"))
    keyed = R.with_reuse_key(rows, "v1").withColumn("proven", F.col("shop") != "shop_1")
    return keyed.groupBy("key").agg(F.count("*").alias("uses"), F.min("log_id").alias("first_log"), ((F.max("result_count") > 0) | F.bool_or("proven")).alias("reusable"))


@query("ret23_term_merge", ("wanted", "facts"), """WITH s AS (SELECT query_id, kind, norm_value, mode FROM wanted WHERE kind <> 'PRODUCT_TYPE' OR mode = 'MUST'), x AS (SELECT q.query_id, CASE f.kind WHEN 'CANONICAL_PRODUCT_TYPE' THEN 'PRODUCT_TYPE' WHEN 'VENDOR' THEN 'BRAND' ELSE f.kind END AS kind, f.norm_value, 'SHOULD' AS mode FROM (SELECT DISTINCT query_id, shop FROM wanted) q JOIN facts f ON f.shop = q.shop AND f.product_id = q.query_id + 3),
o AS (SELECT * FROM x WHERE kind = 'PRODUCT_TYPE' AND query_id NOT IN (SELECT query_id FROM s WHERE kind = 'PRODUCT_TYPE') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY norm_value) = 1),
a AS (SELECT *, 0 AS source FROM s UNION ALL SELECT *, 1 FROM x WHERE kind = 'ATTRIBUTE' UNION ALL SELECT *, 1 FROM o), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id, kind, norm_value ORDER BY source, mode) = 1)
SELECT query_id, kind, norm_value, CASE WHEN (query_id, norm_value) IN (SELECT (query_id, norm_value) FROM wanted WHERE mode = 'MUST_NOT') THEN 'MUST_NOT' ELSE mode END AS mode FROM b""")
def _(t):
    """The query's own terms merged with an expansion, here the facts of the next product of its shop."""
    from ..operators.grounding import merge_terms

    w = t("wanted")
    kind = F.when(F.col("kind") == "CANONICAL_PRODUCT_TYPE", "PRODUCT_TYPE").when(F.col("kind") == "VENDOR", "BRAND").otherwise(F.col("kind"))
    f = t("facts").select("shop", (F.col("product_id") - 3).alias("query_id"), kind.alias("kind"), "norm_value", F.lit("SHOULD").alias("mode"))
    more = w.select("query_id", "shop").distinct().join(f, ["query_id", "shop"]).drop("shop")
    own = w.where("kind <> 'PRODUCT_TYPE' OR mode = 'MUST'").select("query_id", "kind", "norm_value", "mode")
    return merge_terms(own, more, w.where("mode = 'MUST_NOT'")).select("query_id", "kind", "norm_value", "mode")


@query("txt22_signal_coverage", ("wanted", "products"), f"""WITH c AS (SELECT w.query_id, p.product_id, w.kind, w.norm_value, round(CASE WHEN contains(concat(' ', {fold("p.title")}, ' '), concat(' ', {fold("w.norm_value")}, ' ')) THEN 1 WHEN len({toks("w.norm_value")}) > 1 THEN len(list_filter(list_distinct({toks("w.norm_value")}), lambda x: list_contains({toks("p.title")}, x))) / len(list_distinct({toks("w.norm_value")})) ELSE 0 END, 6) AS coverage
FROM wanted w JOIN products p ON p.shop = w.shop) SELECT * FROM c WHERE coverage > 0""")
def _(t):
    """Signals and titles meet on their tokens; pairs without a common token have no coverage and are not listed."""
    w = t("wanted").select("query_id", "shop", "kind", "norm_value").distinct()
    return R.signal_coverage(w, t("products").select("shop", "product_id", "title")).select("query_id", "product_id", "kind", "norm_value", "coverage")
