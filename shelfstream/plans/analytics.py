"""Queries of search analytics."""

from pyspark.sql import functions as F

from ..functions.text import analytics_fold
from ..operators import analytics as A
from ..operators.ranking import latest, page, ranked, top
from .registry import query

LOGS = ("query_log", "query_click")

_PER = """k AS (SELECT log_id, count(*) AS n_clicks FROM query_click GROUP BY log_id),
per AS (SELECT l.*, coalesce(k.n_clicks, 0) AS n_clicks, lower(trim(regexp_replace(query, '\\s+', ' ', 'g'))) AS norm_query FROM query_log l LEFT JOIN k USING (log_id))"""
_CLASSES = f"""{_PER},
c0 AS (SELECT shop, norm_query, count(*) AS searches, count(*) FILTER (WHERE n_clicks > 0) AS clicked_searches, CAST(sum(n_clicks) AS BIGINT) AS clicks,
  count(DISTINCT query) AS variants, round(avg(result_count), 6) AS mean_results, count(*) FILTER (WHERE result_count = 0 AND has_facets) AS faceted_empty
  FROM per GROUP BY shop, norm_query),
classes AS (SELECT *, CASE WHEN faceted_empty > 0 THEN 'SEMANTIC_NO_RESULTS' WHEN searches > 20 AND clicked_searches / searches < 0.05 THEN 'LOW_CTR' ELSE 'HEALTHY' END AS class FROM c0)"""
_ABNORMAL = f"""{_CLASSES},
abnormal AS (SELECT p.log_id, p.shop, p.norm_query, c.class FROM per p JOIN classes c USING (shop, norm_query)
  WHERE c.class = 'LOW_CTR' OR c.class = 'SEMANTIC_NO_RESULTS' AND p.result_count = 0 AND p.has_facets)"""
_CHANGE = """w AS (SELECT shop, count(*) FILTER (WHERE d >= DATE '2024-01-25') AS n1, count(*) FILTER (WHERE d >= DATE '2024-01-25' AND n_clicks > 0) AS k1,
  count(*) FILTER (WHERE d >= DATE '2024-01-18' AND d < DATE '2024-01-25') AS n0, count(*) FILTER (WHERE d >= DATE '2024-01-18' AND d < DATE '2024-01-25' AND n_clicks > 0) AS k0
  FROM (SELECT *, CAST(created_at AS DATE) AS d FROM per) GROUP BY shop),
v AS (SELECT shop, n1, n0, CASE WHEN n1 > 0 THEN k1 / n1 * 100 END AS c1, CASE WHEN n0 > 0 THEN k0 / n0 * 100 END AS c0 FROM w),
change AS (SELECT shop, n1, n0, floor(c1 * 10 + 0.5) / 10 AS current_ctr, floor(c0 * 10 + 0.5) / 10 AS previous_ctr, floor((c1 - c0) * 10 + 0.5) / 10 AS delta_points,
  round(CASE WHEN c0 > 0 THEN (c1 - c0) / c0 * 100 END, 6) AS delta_percent FROM v)"""
_HITS = """kept AS (SELECT log_id, product_id, min(rnk) AS rnk, arg_min(score, rnk) AS score FROM ranked WHERE rnk <= 20 GROUP BY 1, 2),
newest AS (SELECT log_id, arg_max(receipt_id, (created_at, receipt_id)) AS receipt_id FROM receipts GROUP BY 1),
late AS (SELECT log_id, product_id, min(position) AS position, arg_min(score, position) AS late_score FROM receipts SEMI JOIN newest USING (log_id, receipt_id) GROUP BY 1, 2),
h0 AS (SELECT c.click_id, c.log_id, c.clicked_at, coalesce(k.rnk, r.position) AS rnk, c.product_id, CASE WHEN k.rnk IS NOT NULL THEN k.score ELSE coalesce(late_score, 0) END AS score, s.shop
  FROM product_click c LEFT JOIN kept k ON k.log_id = c.log_id AND k.product_id = c.product_id LEFT JOIN late r ON r.log_id = c.log_id AND r.product_id = c.product_id JOIN (SELECT DISTINCT log_id, shop FROM ranked) s ON s.log_id = c.log_id),
hits AS (SELECT * FROM h0 WHERE rnk IS NOT NULL QUALIFY row_number() OVER (PARTITION BY log_id, product_id ORDER BY clicked_at, click_id) = 1)"""
CLICKS = (*LOGS, "ranked", "product_click", "receipts")
_LISTS = """r20 AS (SELECT shop, log_id, product_id, min(rnk) AS rnk, 1 / min(rnk) AS w FROM ranked WHERE rnk <= 20 GROUP BY ALL)"""
_SIMILAR = """mass AS (SELECT log_id, sum(w) AS mass FROM own GROUP BY 1), low AS (SELECT a.shop, a.log_id AS log_a, b.log_id AS log_b, sum(least(a.w, b.w)) AS low FROM own a JOIN own b ON a.shop = b.shop AND a.product_id = b.product_id AND a.log_id < b.log_id GROUP BY 1, 2, 3),
similar_lists AS (SELECT l.shop, log_a, log_b, round(low / (x.mass + y.mass - low), 6) AS similarity FROM low l JOIN mass x ON x.log_id = log_a JOIN mass y ON y.log_id = log_b)"""
_CLUSTERS = f"""{_LISTS}, cl AS (SELECT shop, lower(trim(regexp_replace(query, '\\s+', ' ', 'g'))) AS norm_query, result_count = 0 AS empty, max(log_id) AS id FROM query_log GROUP BY 1, 2, 3),
own AS (SELECT r20.* FROM r20 JOIN cl ON cl.id = r20.log_id AND NOT empty), {_SIMILAR},
fp AS (SELECT cl.shop, cl.id, CAST(embedding AS DOUBLE[]) AS v FROM cl JOIN query_log l ON l.log_id = cl.id JOIN embeddings e ON e.vec_id = l.qkey WHERE empty),
lk AS (SELECT log_a AS a, log_b AS b FROM similar_lists WHERE similarity >= 0.7 UNION SELECT x.id, y.id FROM fp x JOIN fp y ON x.shop = y.shop AND x.id < y.id WHERE round(list_cosine_similarity(x.v, y.v), 6) >= 0.82),
od AS (SELECT shop, id, norm_query, empty, row_number() OVER (PARTITION BY shop ORDER BY id DESC) AS i FROM cl),
nb AS (SELECT o.shop, o.i, list(p.i) AS newer FROM od o LEFT JOIN lk ON lk.a = o.id LEFT JOIN od p ON p.id = lk.b GROUP BY 1, 2),
fold AS (SELECT shop, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS led, [CAST(1 AS BIGINT)] AS heads FROM (SELECT DISTINCT shop FROM cl)
  UNION ALL SELECT f.shop, n.i, coalesce(list_filter(f.heads, lambda h: list_contains(n.newer, h))[1], n.i), CASE WHEN list_filter(f.heads, lambda h: list_contains(n.newer, h))[1] IS NULL THEN list_append(f.heads, n.i) ELSE f.heads END FROM fold f JOIN nb n ON n.shop = f.shop AND n.i = f.i + 1),
clusters AS (SELECT o.shop, o.norm_query, o.empty, h.norm_query AS leader, f.led = f.i AS is_leader FROM fold f JOIN od o ON o.shop = f.shop AND o.i = f.i JOIN od h ON h.shop = f.shop AND h.i = f.led),
cluster_logs AS (SELECT l.*, lower(trim(regexp_replace(l.query, '\\s+', ' ', 'g'))) AS norm_query, c.leader, c.empty FROM query_log l JOIN clusters c ON c.shop = l.shop AND c.norm_query = lower(trim(regexp_replace(l.query, '\\s+', ' ', 'g'))) AND c.empty = (l.result_count = 0))"""


def now():
    return F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")


def _classes(t):
    return A.query_classes(t("query_log"), t("query_click"))


def _hits(t):
    return A.click_ranks(t("product_click"), t("ranked"), t("receipts"))


def _clusters(t):
    fingerprints = t("query_log").join(t("embeddings"), F.col("qkey") == F.col("vec_id")).select("log_id", "embedding")
    return A.lead_clusters(t("query_log"), t("ranked"), fingerprints)


def _cluster_logs(t):
    """Each log with the leader of its class; clusters with and without results stay apart."""
    rows = t("query_log").withColumns({"norm_query": analytics_fold(F.col("query")), "empty": F.col("result_count") == 0})
    rows = rows.join(_clusters(t).select("shop", "norm_query", "empty", "leader"), ["shop", "norm_query", "empty"])
    return rows.withColumn("leader", F.concat(F.when(F.col("empty"), "0:").otherwise("1:"), F.col("leader")))


@query("agg8_query_classes", LOGS, f"WITH {_CLASSES} SELECT * EXCLUDE (class) FROM classes")
def _(t):
    return _classes(t).drop("class")


@query("agg9_abnormal_classes", LOGS, f"WITH {_CLASSES} SELECT shop, norm_query, class FROM classes")
def _(t):
    return _classes(t).select("shop", "norm_query", "class")


@query("agg10_abnormal_logs", LOGS, f"WITH {_ABNORMAL} SELECT log_id, shop, norm_query, class FROM abnormal")
def _(t):
    return A.abnormal_logs(t("query_log"), _classes(t)).select("log_id", "shop", "norm_query", "class")


@query("agg11_impact_totals", CLICKS, f"""WITH {_HITS},
k AS (SELECT log_id, count(*) AS clicks, sum(rnk) AS rank_sum FROM hits GROUP BY log_id),
s AS (SELECT shop, count(*) AS searches, count(clicks) AS clicked, CAST(coalesce(sum(clicks), 0) AS BIGINT) AS clicks, sum(rank_sum) AS rank_sum FROM query_log LEFT JOIN k USING (log_id) GROUP BY shop)
SELECT shop, searches, clicked, clicks, floor(clicked / searches * 1000 + 0.5) / 10 AS ctr, CASE WHEN clicks > 0 THEN floor(rank_sum / clicks * 10 + 0.5) / 10 END AS mean_rank FROM s""")
def _(t):
    return A.totals(t("query_log"), _hits(t))


@query("agg12_daily_series", LOGS, f"""WITH {_ABNORMAL},
days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day),
daily AS (SELECT p.shop, CAST(p.created_at AS DATE) AS day, count(*) AS searches, count(*) FILTER (WHERE n_clicks > 0) AS clicked, count(a.log_id) AS abnormal
  FROM per p LEFT JOIN abnormal a ON a.log_id = p.log_id GROUP BY 1, 2)
SELECT s.shop, day, coalesce(searches, 0) AS searches, coalesce(clicked, 0) AS clicked, coalesce(abnormal, 0) AS abnormal,
  CASE WHEN searches > 0 THEN floor(clicked / searches * 1000 + 0.5) / 10 END AS ctr
FROM (SELECT DISTINCT shop FROM query_log) s CROSS JOIN days LEFT JOIN daily USING (shop, day)""")
def _(t):
    return A.daily_series(t("query_log"), t("query_click"), A.abnormal_logs(t("query_log"), _classes(t)), now(), 30)


@query("agg13_weekly_change", LOGS, f"WITH {_PER}, {_CHANGE} SELECT * FROM change")
def _(t):
    return A.weekly_change(t("query_log"), t("query_click"), now())


@query("agg14_alerts", LOGS, f"""WITH {_CLASSES}, {_CHANGE},
a AS (SELECT shop, 1 AS tier, class AS type, norm_query AS query, CASE WHEN class = 'LOW_CTR' THEN searches ELSE faceted_empty END AS count, searches
  FROM classes WHERE class <> 'HEALTHY' QUALIFY row_number() OVER (PARTITION BY shop ORDER BY searches DESC, norm_query) <= 6
  UNION ALL SELECT shop, 0, 'CTR_DROP', NULL, n1, n1 FROM change WHERE n1 >= 30 AND n0 >= 30 AND delta_percent <= -20),
b AS (SELECT *, CAST(row_number() OVER (PARTITION BY shop ORDER BY tier, searches DESC, query) AS INTEGER) AS position FROM a)
SELECT shop, type, query, count, CASE WHEN tier = 0 OR count >= 10 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, position FROM b WHERE position <= 6""")
def _(t):
    return A.alerts(_classes(t), A.weekly_change(t("query_log"), t("query_click"), now()))


_LEADER = "concat(CASE WHEN empty THEN '0:' ELSE '1:' END, leader)"


@query("agg15_class_variants", ("query_log", "ranked"), f"""WITH RECURSIVE {_CLUSTERS}, v AS (SELECT shop, {_LEADER} AS leader, query, count(*) AS n, max(created_at) AS last FROM cluster_logs GROUP BY 1, 2, 3)
SELECT shop, leader, query, n, CAST(row_number() OVER (PARTITION BY shop, leader ORDER BY n DESC, last DESC, query) AS INTEGER) AS position FROM v""")
def _(t):
    return A.class_variants(_cluster_logs(t))


@query("agg16_common_products", CLICKS, f"""WITH RECURSIVE {_HITS}, {_CLUSTERS},
k AS (SELECT log_id, product_id, count(*) AS k FROM hits GROUP BY 1, 2),
p AS (SELECT r.shop, {_LEADER} AS leader, r.product_id, count(*) AS appearances, round(avg(r.rnk), 6) AS mean_rank, CAST(coalesce(sum(k), 0) AS BIGINT) AS clicks
  FROM ranked r JOIN cluster_logs l USING (log_id) LEFT JOIN k ON k.log_id = r.log_id AND k.product_id = r.product_id GROUP BY 1, 2, 3)
SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY shop, leader ORDER BY appearances DESC, mean_rank, clicks DESC, product_id) <= 10""")
def _(t):
    return A.common_products(_cluster_logs(t), t("ranked"), _hits(t))


@query("jn8_click_attribution", CLICKS, f"WITH {_HITS} SELECT log_id, product_id, click_id, rnk, score FROM hits")
def _(t):
    return _hits(t).select("log_id", "product_id", "click_id", "rnk", "score")


@query("jn9_clicked_titles", (*CLICKS, "products"), f"""WITH {_HITS}
SELECT h.shop, h.product_id, coalesce(p.title, concat('Product ', CAST(h.product_id AS VARCHAR))) AS title, p.handle, count(*) AS clicks
FROM hits h LEFT JOIN products p ON p.shop = h.shop AND p.product_id = h.product_id GROUP BY 1, 2, 3, 4""")
def _(t):
    clicks = _hits(t).groupBy("shop", "product_id").agg(F.count("*").alias("clicks"))
    named = clicks.join(t("products").select("shop", "product_id", "title", "handle"), ["shop", "product_id"], "left")
    return named.withColumn("title", F.coalesce("title", F.concat(F.lit("Product "), F.col("product_id").cast("string"))))


@query("clu2_weighted_jaccard", ("ranked",), f"""WITH {_LISTS}, lists AS (SELECT shop, log_id, string_agg(concat(product_id, ':', rnk), ',' ORDER BY product_id) AS items FROM r20 GROUP BY 1, 2),
reps AS (SELECT shop, items, min(log_id) AS log_id, count(*) AS members FROM lists GROUP BY 1, 2), own AS (SELECT r20.* FROM r20 JOIN reps ON reps.log_id = r20.log_id), {_SIMILAR}
SELECT s.*, x.members AS members_a, y.members AS members_b FROM similar_lists s JOIN reps x ON x.log_id = log_a JOIN reps y ON y.log_id = log_b""")
def _(t):
    return A.weighted_jaccard(t("ranked"))


@query("clu2_list_members", ("ranked",), f"""WITH {_LISTS}, lists AS (SELECT shop, log_id, string_agg(concat(product_id, ':', rnk), ',' ORDER BY product_id) AS items FROM r20 GROUP BY 1, 2)
SELECT shop, log_id, min(log_id) OVER (PARTITION BY shop, items) AS list_id FROM lists""")
def _(t):
    return A.list_members(t("ranked"))


@query("clu1_leader_clusters", ("query_log", "ranked"), f"WITH RECURSIVE {_CLUSTERS} SELECT * FROM clusters")
def _(t):
    return _clusters(t)


@query("clu3_cluster_metrics", (*LOGS, "ranked"), f"""WITH RECURSIVE {_CLUSTERS}, k AS (SELECT log_id, count(*) AS n_clicks FROM query_click GROUP BY log_id), per AS (SELECT l.*, coalesce(n_clicks, 0) AS n_clicks FROM cluster_logs l LEFT JOIN k USING (log_id))
SELECT shop, {_LEADER} AS leader, count(*) AS searches, round(count(*) FILTER (WHERE result_count > 0) / count(*), 6) AS result_rate, round(count(*) FILTER (WHERE n_clicks > 0) / count(*), 6) AS ctr,
  floor(CAST(sum(CAST(round(top_score * 1000000) AS BIGINT)) AS BIGINT) / count(*)) / 1000000 AS mean_score, round(avg(vector_threshold), 6) AS mean_threshold FROM per GROUP BY 1, 2""")
def _(t):
    per = A.clicked_logs(_cluster_logs(t), t("query_click"))
    n = F.count("*")
    return per.groupBy("shop", "leader").agg(
        n.alias("searches"), F.round(F.count_if(F.col("result_count") > 0) / n, 6).alias("result_rate"), F.round(F.count_if(F.col("n_clicks") > 0) / n, 6).alias("ctr"),
        (F.floor(F.sum(F.round(F.col("top_score") * 1_000_000).cast("long")) / n) / 1_000_000).alias("mean_score"), F.round(F.avg("vector_threshold"), 6).alias("mean_threshold"),
    )


@query("win10_dense_ranks", ("ranked",), """WITH f AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY log_id, product_id ORDER BY rnk) = 1)
SELECT log_id, product_id, CAST(row_number() OVER (PARTITION BY log_id ORDER BY rnk) AS INTEGER) AS rank FROM f WHERE product_id % 7 <> 0""")
def _(t):
    once = top(t("ranked"), ["log_id", "product_id"], ["rnk"])
    return ranked(once.where("product_id % 7 <> 0"), "log_id", ["rnk"]).select("log_id", "product_id", "rank")


@query("win11_result_pages", ("ranked",), """WITH r AS (SELECT *, CAST(row_number() OVER (PARTITION BY log_id ORDER BY rnk) AS INTEGER) AS rank, greatest(ceil(count(*) OVER (PARTITION BY log_id) / 6), 1) AS pages FROM ranked)
SELECT log_id, product_id, rank FROM r WHERE rank > (least(2, pages) - 1) * 6 AND rank <= least(2, pages) * 6""")
def _(t):
    return page(t("ranked"), "log_id", ["rnk"], 2, 6).select("log_id", "product_id", "rank")


@query("win12_newest_events", ("usage_event",), "SELECT event_id, shop, type, created_at FROM usage_event ORDER BY created_at DESC, event_id DESC LIMIT 200")
def _(t):
    return t("usage_event").select("event_id", "shop", "type", "created_at").orderBy(F.desc("created_at"), F.desc("event_id")).limit(200)


@query("mnt4_history_search", ("query_log",), """WITH f AS (SELECT *, CAST(row_number() OVER (PARTITION BY shop ORDER BY created_at DESC, log_id DESC) AS INTEGER) AS rank FROM query_log WHERE contains(lower(query), 'blue') OR result_count = 0)
SELECT log_id, shop, query, result_count, rank FROM f WHERE rank <= 50""")
def _(t):
    hit = t("query_log").where(F.contains(F.lower("query"), F.lit("blue")) | (F.col("result_count") == 0))
    return ranked(hit, "shop", [F.desc("created_at"), F.desc("log_id")]).where("rank <= 50").select("log_id", "shop", "query", "result_count", "rank")


@query("agg27_distinct_filters", ("sync_jobs",), "SELECT DISTINCT shop, status FROM sync_jobs")
def _(t):
    return t("sync_jobs").select("shop", "status").distinct()


@query("src11_search_log_rows", ("query_log", "ranked"), """SELECT l.log_id, l.shop, substr(l.query, 1, 500) AS query, coalesce(max(r.score) FILTER (WHERE r.rnk <= 20), NULL) AS top_score, count(r.log_id) FILTER (WHERE r.rnk <= 20) AS kept
FROM query_log l LEFT JOIN ranked r USING (log_id) GROUP BY 1, 2, 3""")
def _(t):
    first = t("ranked").where("rnk <= 20").groupBy("log_id").agg(F.max("score").alias("top_score"), F.count("*").alias("kept"))
    rows = t("query_log").select("log_id", "shop", F.substring("query", 1, 500).alias("query"))
    return rows.join(first, "log_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
