"""Domain tables, derived from the plain input tables by SQL that Spark and DuckDB both run.

``Tables`` hands them out as DataFrames; ``ctes`` gives the same SQL as WITH
clauses. A name in braces stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "products": """
SELECT concat('shop_', CAST(p_partkey % 3 AS STRING)) AS shop, p_partkey AS product_id,
       concat(replace(p_name, ' ', '-'), '-', CAST(p_partkey AS STRING)) AS handle, p_name AS title, p_brand AS vendor, p_type AS product_type,
       p_size AS size_no, p_retailprice AS price, (p_partkey % 11 <> 0) AS has_vector, (p_partkey % 5 <> 0) AS searchable,
       CASE WHEN p_partkey % 11 = 0 THEN 'MISSING' WHEN p_partkey % 13 = 0 THEN 'STALE' ELSE 'READY' END AS vector_status,
       CASE WHEN p_partkey % 17 = 0 THEN 'UNPUBLISHED' WHEN p_partkey % 5 = 0 THEN 'PRODUCT_LIMIT' ELSE NULL END AS blocked_reason
FROM {part}""",
    "facts": """
SELECT shop, product_id, 'CANONICAL_PRODUCT_TYPE' AS kind, split_part(title, ' ', 2) AS norm_value FROM {products}
UNION ALL SELECT shop, product_id, 'ATTRIBUTE', split_part(title, ' ', 1) FROM {products}
UNION ALL SELECT shop, product_id, 'PRODUCT_TYPE', lower(product_type) FROM {products}
UNION ALL SELECT shop, product_id, 'VENDOR', lower(replace(vendor, '#', ' ')) FROM {products}
UNION ALL SELECT shop, product_id, 'MEASUREMENT', concat('size ', CAST(size_no AS STRING)) FROM {products}""",
    "typed_facts": """
SELECT shop, product_id, kind, norm_value FROM {facts}
UNION ALL SELECT shop, product_id, 'MEASUREMENT', concat(CAST(size_no AS STRING), 'x', CAST(size_no % 7 AS STRING)) FROM {products} WHERE product_id % 4 = 0
UNION ALL SELECT shop, product_id, 'VARIANT_OPTION', concat('colour=', split_part(title, ' ', 1)) FROM {products} WHERE product_id % 3 <> 1
UNION ALL SELECT shop, product_id, 'USE_CASE', concat(split_part(title, ' ', 2), ' ', split_part(title, ' ', 1)) FROM {products} WHERE product_id % 7 = 0""",
    "rerank_facts": """
SELECT product_id, kind, norm_value FROM {typed_facts}
UNION ALL SELECT product_id, 'AUDIENCE', CASE product_id % 5 WHEN 0 THEN 'men' WHEN 1 THEN 'women' WHEN 2 THEN 'men women' ELSE 'kids' END FROM {products} WHERE product_id % 5 < 4
UNION ALL SELECT product_id, 'COLOUR', split_part(title, ' ', 1) FROM {products} WHERE product_id % 32 <> 0
UNION ALL SELECT product_id, 'CATEGORY', split_part(title, ' ', 2) FROM {products} WHERE product_id % 4 <> 0
UNION ALL SELECT product_id, 'COMPATIBILITY', concat('fits ', split_part(title, ' ', 2)) FROM {products} WHERE product_id % 3 = 0""",
    "rerank_asks": """
SELECT p_partkey AS query_id, CAST(floor(p_partkey / 100) AS INT) AS n, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, lower(replace(p_brand, '#', ' ')) AS brand, concat('size ', CAST(p_size AS STRING)) AS size
FROM {part} WHERE p_partkey % 100 = 0""",
    "rerank_signals": """
SELECT query_id, 'IDENTITY' AS kind, b AS value, n % 6 = 1 AS hard, n % 5 = 0 AS fallback FROM {rerank_asks} WHERE n % 4 <> 3
UNION ALL SELECT query_id, 'FACET', a, false, false FROM {rerank_asks}
UNION ALL SELECT query_id, 'ATTRIBUTE', a, false, false FROM {rerank_asks}
UNION ALL SELECT query_id, 'SOURCE', a, false, false FROM {rerank_asks} WHERE n % 2 = 0
UNION ALL SELECT query_id, 'SOURCE', b, false, false FROM {rerank_asks} WHERE n % 2 = 0
UNION ALL SELECT query_id, 'NEED', concat(a, ' ', b), false, false FROM {rerank_asks} WHERE n % 3 = 0
UNION ALL SELECT query_id, 'EXPANSION', concat('new ', b), false, false FROM {rerank_asks} WHERE n % 3 = 1
UNION ALL SELECT query_id, 'COLOUR', a, false, false FROM {rerank_asks} WHERE n % 5 = 2
UNION ALL SELECT query_id, 'AUDIENCE', CASE WHEN n % 2 = 0 THEN 'women' ELSE 'men' END, false, false FROM {rerank_asks} WHERE n % 3 = 2
UNION ALL SELECT query_id, 'NEGATIVE', b, false, false FROM {rerank_asks} WHERE n % 7 = 3
UNION ALL SELECT query_id, 'CATEGORY', b, false, false FROM {rerank_asks} WHERE n % 4 = 3
UNION ALL SELECT query_id, 'REFERENCE', b, false, false FROM {rerank_asks} WHERE n % 3 = 2
UNION ALL SELECT query_id, 'COMPATIBILITY', concat('fits ', b), true, false FROM {rerank_asks} WHERE n % 8 = 4
UNION ALL SELECT query_id, 'BRAND', brand, true, false FROM {rerank_asks} WHERE n % 9 = 4
UNION ALL SELECT query_id, 'NUMERIC', size, true, false FROM {rerank_asks} WHERE n % 10 = 7""",
    "asks": """
SELECT product_id AS ask_id, shop, title,
       CASE product_id % 12
            WHEN 0 THEN concat('cheapest ', title, ' size ', CAST(size_no AS STRING))
            WHEN 1 THEN concat(title, ' without ', split_part(title, ' ', 1), ' and under $', CAST(size_no AS STRING))
            WHEN 2 THEN concat('must be ', CAST(size_no AS STRING), 'gb ', title, ' or ', split_part(title, ' ', 2))
            WHEN 3 THEN concat('Luxury, budget ', title, ' ', CAST(size_no AS STRING), ' cm')
            WHEN 4 THEN concat('works with ', lower(replace(vendor, '#', ' ')), ' pro ', title)
            WHEN 5 THEN concat(title, ' for iPhone ', CAST(size_no AS STRING), ' mini')
            WHEN 6 THEN concat('prefer ', CAST(size_no AS STRING), 'x', CAST(size_no AS STRING), ' ', title, ' not ', split_part(title, ' ', 1), ' or not ', split_part(title, ' ', 2))
            WHEN 7 THEN concat('newest ', title, ' gear pack of ', CAST(size_no AS STRING))
            WHEN 8 THEN concat('most expensive ', title, ' either for men and kids ', CAST(size_no AS STRING))
            WHEN 9 THEN concat('premium women ', title, ' except men')
            WHEN 10 THEN concat('áo xl ', title, ' không phải ', split_part(title, ' ', 1))
            ELSE title END AS query
FROM {products}""",
    "search_urls": """
SELECT ask_id, CASE ask_id % 11 WHEN 0 THEN '  ' WHEN 1 THEN 'ab' WHEN 2 THEN concat('tag:', query) WHEN 3 THEN concat(query, ' AND more') WHEN 4 THEN concat('"', query, '"') WHEN 5 THEN concat(query, '*') ELSE query END AS query,
       CASE ask_id % 17 WHEN 0 THEN '/search?q=x&type=product' WHEN 1 THEN '/search?type=product&sort_by=Relevance&page=2' WHEN 2 THEN '/search?type=product&sort_by=price-ascending' WHEN 3 THEN '/search?type=product&options[prefix]=last'
            WHEN 4 THEN '/search?options%5Bprefix%5D=none&type=Product' WHEN 5 THEN '/search?type=product&options[prefix]=all' WHEN 6 THEN '/search?type=product&filter.v.price.gte=10' WHEN 7 THEN '/search?type=product&page=0'
            WHEN 8 THEN '/search?type=article' WHEN 9 THEN '/search?q=x' WHEN 10 THEN '//shop/search?type=product' WHEN 11 THEN '/a/../search?type=product' WHEN 12 THEN '/search?view=grid&type=product&vendor=a' WHEN 13 THEN '/pages/x?type=product'
            WHEN 14 THEN '/en/search/?type=product,product&q=a#top' WHEN 15 THEN '/search?type=product&page=x' ELSE NULL END AS target
FROM {asks}""",
    "query_log": """
SELECT e.event_id AS log_id, concat('shop_', CAST(e.user_id % 3 AS STRING)) AS shop, e.user_id, (e.user_id + e.event_id % 5) % 150 AS qkey,
       p.p_name AS query, e.ts AS created_at,
       CASE WHEN e.event_type = 'error' THEN 0 ELSE CAST(floor(e.value) AS INT) % 20 + 1 END AS result_count,
       (e.event_id % 2 = 0) AS has_facets, round(e.value / CAST(500 AS DOUBLE), 6) AS top_score, CAST(0.35 AS DOUBLE) AS vector_threshold
FROM {events} e JOIN {part} p ON p.p_partkey = (e.user_id + e.event_id % 5) % 150
WHERE e.event_type IN ('view', 'error')""",
    "ranked": """
SELECT l.log_id, l.shop, n.n_nationkey + 1 AS rnk, 3 * ((l.qkey * 7 + n.n_nationkey * 5) % 61) + l.user_id % 3 AS product_id,
       round(CAST(1 AS DOUBLE) / (n.n_nationkey + 2), 6) AS score
FROM {query_log} l JOIN {nation} n ON n.n_nationkey < l.result_count""",
    "query_click": """
SELECT c.event_id AS click_id, max(l.log_id) AS log_id, c.user_id, c.ts AS clicked_at
FROM {events} c JOIN {query_log} l ON l.user_id = c.user_id AND l.created_at <= c.ts AND l.created_at > c.ts - INTERVAL '2' HOUR
WHERE c.event_type = 'click' GROUP BY c.event_id, c.user_id, c.ts""",
    "product_click": """
SELECT c.click_id, c.log_id, c.user_id, c.clicked_at, 3 * ((l.qkey * 7 + (c.click_id % 30) * 5) % 61) + l.user_id % 3 AS product_id
FROM {query_click} c JOIN {query_log} l ON l.log_id = c.log_id""",
    "receipts": """
SELECT 2 * l.log_id + v.r_regionkey AS receipt_id, l.log_id, l.created_at + v.r_regionkey * INTERVAL '1' MINUTE AS created_at, n.n_nationkey + 1 AS position,
       3 * ((l.qkey * 7 + (n.n_nationkey + v.r_regionkey) * 5) % 61) + l.user_id % 3 AS product_id, round(CAST(1 AS DOUBLE) / (n.n_nationkey + 2 + v.r_regionkey), 6) AS score
FROM {query_log} l JOIN {region} v ON v.r_regionkey < 2 JOIN {nation} n ON l.log_id % 4 <> 0""",
    "api_usage_event": """
SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('shop_', CAST(l_suppkey % 3 AS STRING)) END AS shop,
       CASE WHEN l_returnflag = 'R' THEN 'GEMINI' ELSE 'OPENAI' END AS provider,
       CASE l_linenumber WHEN 1 THEN 'QUERY_REWRITE' WHEN 2 THEN 'QUERY_EMBEDDING' WHEN 3 THEN 'PRODUCT_ENRICHMENT'
            WHEN 4 THEN 'PRODUCT_EMBEDDING' ELSE 'EMBEDDING' END AS operation,
       concat('model_', l_linestatus) AS model, CAST(round(l_quantity * 100) AS BIGINT) AS input_tokens,
       CAST(round(l_discount * 1000) AS BIGINT) AS cached_input_tokens, CAST(round(l_quantity * 20) AS BIGINT) AS output_tokens, l_shipdate AS created_at
FROM {lineitem}""",
    "subscriptions": """
SELECT o_orderkey AS sub_id, concat('shop_c', CAST(o_custkey AS STRING)) AS shop,
       CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'P' THEN 'FROZEN' ELSE 'CANCELLED' END AS status,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 10) AS DOUBLE) / 100 END AS price_snapshot,
       CASE o_custkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'VND' END AS currency,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'ANNUAL' ELSE 'EVERY_30_DAYS' END AS interval_code,
       CASE o_orderkey % 3 WHEN 0 THEN 'basic' WHEN 1 THEN 'pro' ELSE 'custom' END AS plan_handle,
       o_orderdate AS updated_at, o_orderdate + INTERVAL '7' DAY AS trial_ends_at, o_orderdate + INTERVAL '30' DAY AS period_ends_at
FROM {orders}""",
    "billing_rows": """
SELECT s.sub_id, s.shop, CASE WHEN o.o_orderkey % 23 = 0 THEN 'PENDING' ELSE s.status END AS status, s.price_snapshot, s.plan_handle, s.updated_at,
       CASE WHEN o.o_orderkey % 6 = 1 THEN NULL ELSE s.updated_at END AS trial_starts_at, CASE WHEN o.o_orderkey % 6 = 1 THEN NULL ELSE s.trial_ends_at END AS trial_ends_at,
       CASE WHEN o.o_orderkey % 9 = 2 THEN NULL ELSE s.updated_at END AS period_starts_at,
       CASE WHEN o.o_orderkey % 9 = 2 THEN NULL WHEN o.o_orderkey % 10 = 3 THEN s.updated_at + INTERVAL '5' DAY ELSE s.updated_at + INTERVAL '900' DAY END AS period_ends_at,
       CASE o.o_orderkey % 7 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'CANCELLED' WHEN 2 THEN 'NONE' ELSE 'CONVERTED' END AS trial_status,
       CASE o.o_orderkey % 5 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'RECOVERED' WHEN 2 THEN 'NONE' ELSE 'PAID' END AS payment_status,
       CASE WHEN o.o_orderkey % 19 = 0 THEN 'FULL' ELSE 'NONE' END AS refund_status
FROM {subscriptions} s JOIN {orders} o ON o.o_orderkey = s.sub_id""",
    "billing_pointers": """
SELECT concat('shop_c', CAST(o_custkey AS STRING)) AS shop, CASE WHEN o_custkey % 4 = 0 THEN min(o_orderkey) WHEN o_custkey % 4 = 1 THEN max(o_orderkey) WHEN o_custkey % 20 = 2 THEN -1 ELSE NULL END AS sub_id
FROM {orders} GROUP BY o_custkey""",
    "quota_grants": """
SELECT event_id AS grant_id, concat('shop_', CAST(user_id % 3 AS STRING)) AS shop,
       CASE event_id % 3 WHEN 0 THEN 'SEARCH' WHEN 1 THEN 'PRODUCT' ELSE 'VECTOR_UPDATE' END AS kind, event_id % 50 + 1 AS amount, ts AS starts_at,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts + INTERVAL '10' DAY END AS expires_at,
       CASE WHEN event_id % 9 = 0 THEN ts + INTERVAL '1' DAY ELSE NULL END AS revoked_at
FROM {events} WHERE event_type = 'signup'""",
    "sync_jobs": """
SELECT event_id AS job_id, concat('wh_', CAST(event_id - event_id % 2 AS STRING)) AS webhook_id,
       concat('shop_', CAST(user_id % 3 AS STRING)) AS shop, event_id % 40 AS product_id,
       CASE event_type WHEN 'signup' THEN 'PRODUCTS_CREATE' WHEN 'error' THEN 'REINDEX_PRODUCT' ELSE 'PRODUCTS_UPDATE' END AS topic,
       CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'PROCESSING' ELSE 'DONE' END AS status,
       event_id % 6 AS attempts, ts AS created_at, ts + INTERVAL '3' MINUTE AS updated_at
FROM {events}""",
    "job_feed": """
SELECT event_id AS feed_id, event_id AS job_id, concat('shop_', CAST(user_id % 3 AS STRING)) AS shop, CAST(floor(event_id / 5) AS BIGINT) % 10 AS product_id,
       CASE event_id % 5 WHEN 0 THEN 'PRODUCTS_CREATE' WHEN 1 THEN 'PRODUCTS_UPDATE' WHEN 2 THEN 'REINDEX_PRODUCT' WHEN 3 THEN 'REINDEX_PRODUCT_CAPACITY' ELSE 'REINDEX_PRODUCT_ENRICHMENT' END AS topic,
       user_id % 2 + 1 AS policy_version, CASE event_type WHEN 'signup' THEN 'START' WHEN 'error' THEN 'END' ELSE 'REQUEST' END AS event, ts
FROM {events}""",
    "reservations": """
SELECT event_id AS reservation_id, concat('shop_', CAST(user_id % 3 AS STRING)) AS shop,
       CASE WHEN event_type = 'purchase' THEN 'VECTOR_UPDATE' ELSE 'SEARCH' END AS kind, (event_id % 3 <> 0) AS effect_applied, ts AS updated_at
FROM {events} WHERE event_type IN ('purchase', 'view')""",
    "usage_event": """
SELECT event_id, concat('shop_', CAST(user_id % 3 AS STRING)) AS shop, date_trunc('month', ts) AS period_start, ts AS created_at,
       CASE event_type WHEN 'view' THEN 'SEARCH' WHEN 'purchase' THEN 'VECTOR_UPDATE' WHEN 'error' THEN 'FALLBACK' WHEN 'click' THEN 'BLOCKED' ELSE 'SYNC' END AS type
FROM {events}""",
    "wanted": """
SELECT q.p_partkey AS query_id, concat('shop_', CAST(q.p_partkey % 3 AS STRING)) AS shop, 'PRODUCT_TYPE' AS kind, split_part(q.p_name, ' ', 2) AS norm_value,
       CASE WHEN floor(q.p_partkey / 100) % 4 = 0 THEN 'MUST' ELSE 'SHOULD' END AS mode, CAST(0.9 AS DOUBLE) AS confidence
FROM {part} q WHERE q.p_partkey % 100 = 0
UNION ALL SELECT q.p_partkey, concat('shop_', CAST(q.p_partkey % 3 AS STRING)), 'ATTRIBUTE', split_part(q.p_name, ' ', 1),
       CASE WHEN floor(q.p_partkey / 100) % 6 = 0 THEN 'MUST_NOT' ELSE 'SHOULD' END, CAST(0.8 AS DOUBLE) FROM {part} q WHERE q.p_partkey % 100 = 0
UNION ALL SELECT q.p_partkey, concat('shop_', CAST(q.p_partkey % 3 AS STRING)), 'BRAND', lower(replace(q.p_brand, '#', ' ')), 'SHOULD', CAST(1 AS DOUBLE)
FROM {part} q WHERE q.p_partkey % 100 = 0
UNION ALL SELECT q.p_partkey, concat('shop_', CAST(q.p_partkey % 3 AS STRING)), 'MEASUREMENT', concat('size ', CAST(q.p_size AS STRING)),
       CASE WHEN floor(q.p_partkey / 100) % 5 = 0 THEN 'MUST' ELSE 'SHOULD' END, CAST(1 AS DOUBLE) FROM {part} q WHERE q.p_partkey % 100 = 0""",
}

_NAME = re.compile(r"\{(\w+)\}")


class Tables:
    """Input tables and views of one data folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.sql(VIEWS[name])

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: self(n) for n in set(_NAME.findall(text))})


def ctes(names: tuple[str, ...]) -> list[str]:
    """``name AS (...)`` of the views and of those they read, in order."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in VIEWS and name not in done:
            for n in _NAME.findall(VIEWS[name]):
                add(n)
            done[name] = f"{name} AS ({_NAME.sub(r'\1', VIEWS[name])})"

    for name in names:
        add(name)
    return list(done.values())
