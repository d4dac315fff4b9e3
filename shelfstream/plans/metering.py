"""Queries of usage metering and quotas."""

from pyspark.sql import functions as F

from ..operators import metering as M
from ..operators.lineage import small
from ..operators.ranking import gate, latest, ranked, top
from .registry import query

# USD per million tokens; parameters of the estimate.
RATES = {"embedding": 0.02, "input": 0.10, "cached": 0.025, "output": 0.40}
_USAGE = """u AS (SELECT *, CAST(floor(CASE WHEN operation IN ('EMBEDDING', 'QUERY_EMBEDDING', 'PRODUCT_EMBEDDING') THEN input_tokens * CAST(0.02 AS DOUBLE)
  ELSE greatest(input_tokens - cached_input_tokens, 0) * CAST(0.1 AS DOUBLE) + cached_input_tokens * CAST(0.025 AS DOUBLE) + output_tokens * CAST(0.4 AS DOUBLE) END + 0.5) AS BIGINT) AS cost_micros FROM api_usage_event),
daily AS (SELECT CAST(created_at AS DATE) AS day, coalesce(shop, '__UNSCOPED__') AS shop, provider, operation, model, count(*) AS events,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cost_micros) AS BIGINT) AS cost_micros FROM u GROUP BY ALL)"""
API = ("api_usage_event",)


def usage(t):
    return t("api_usage_event").withColumn("cost_micros", M.cost_micros(F.col("operation"), F.col("input_tokens"), F.col("cached_input_tokens"), F.col("output_tokens"), RATES))


@query("agg1_daily_usage", API, f"WITH {_USAGE} SELECT * FROM daily")
def _(t):
    return M.daily_usage(usage(t))


@query("agg1_merge_daily", API, f"WITH {_USAGE} SELECT * FROM daily")
def _(t):
    old, new = usage(t).where("input_tokens % 2 = 0"), usage(t).where("input_tokens % 2 <> 0")
    return M.merge_daily(M.daily_usage(old), M.daily_usage(new))


@query("agg1_month_rollup", API, f"""WITH {_USAGE} SELECT CAST(CAST(date_trunc('month', day) AS DATE) AS VARCHAR) AS month, CAST(day AS VARCHAR) AS day, shop, CAST(sum(events) AS BIGINT) AS events, CAST(sum(cost_micros) AS BIGINT) AS cost_micros
FROM daily GROUP BY ROLLUP (date_trunc('month', day), day, shop)""")
def _(t):
    d = M.daily_usage(usage(t)).withColumn("month", F.trunc("day", "month"))
    out = d.rollup("month", "day", "shop").agg(F.sum("events").alias("events"), F.sum("cost_micros").alias("cost_micros"))
    return out.withColumns({"month": F.col("month").cast("string"), "day": F.col("day").cast("string")})


@query("agg2_month_to_date", API, f"""WITH {_USAGE} SELECT shop, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cost_micros) AS BIGINT) AS cost_micros
FROM daily WHERE day >= DATE '2001-10-01' GROUP BY shop""")
def _(t):
    both = M.raw_and_daily(usage(t), F.lit("2001-10-20").cast("date"))
    return both.where("day >= DATE '2001-10-01'").groupBy("shop").agg(*(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cost_micros")))


@query("set1_raw_and_daily", API, f"""WITH {_USAGE} SELECT CAST(created_at AS DATE) AS day, coalesce(shop, '__UNSCOPED__') AS shop, provider, operation, model, CAST(1 AS BIGINT) AS events, input_tokens, output_tokens, cost_micros
FROM u WHERE created_at >= TIMESTAMP '2001-10-20' UNION ALL SELECT * FROM daily WHERE day < DATE '2001-10-20'""")
def _(t):
    return M.raw_and_daily(usage(t), F.lit("2001-10-20").cast("date"))


@query("agg3_provider_summary", API, f"""WITH {_USAGE} SELECT provider, count(*) AS events, CAST(coalesce(sum(input_tokens) FILTER (WHERE operation LIKE '%EMBEDDING'), 0) AS BIGINT) AS embedding_tokens,
  CAST(coalesce(sum(input_tokens + output_tokens) FILTER (WHERE operation NOT LIKE '%EMBEDDING'), 0) AS BIGINT) AS llm_tokens,
  CAST(coalesce(sum(cost_micros) FILTER (WHERE operation LIKE 'QUERY%'), 0) AS BIGINT) AS search_cost, CAST(coalesce(sum(cost_micros) FILTER (WHERE operation LIKE 'PRODUCT%'), 0) AS BIGINT) AS indexing_cost FROM u GROUP BY provider""")
def _(t):
    def total(value, when):
        return F.coalesce(F.sum(F.when(when, value)), F.lit(0))

    op = F.col("operation")
    return usage(t).groupBy("provider").agg(
        F.count("*").alias("events"), total(F.col("input_tokens"), op.endswith("EMBEDDING")).alias("embedding_tokens"),
        total(F.col("input_tokens") + F.col("output_tokens"), ~op.endswith("EMBEDDING")).alias("llm_tokens"),
        total(F.col("cost_micros"), op.startswith("QUERY")).alias("search_cost"), total(F.col("cost_micros"), op.startswith("PRODUCT")).alias("indexing_cost"),
    )


@query("agg28_event_costs", API, f"WITH {_USAGE} SELECT operation, cost_micros, count(*) AS n FROM u GROUP BY 1, 2")
def _(t):
    return usage(t).groupBy("operation", "cost_micros").agg(F.count("*").alias("n"))


@query("agg4_registry_stats", ("products",), """SELECT shop, count(*) AS total, count_if(has_vector) AS vectorised, count_if(searchable) AS slots, count_if(blocked_reason = 'UNPUBLISHED') AS unpublished,
  count_if(blocked_reason = 'PRODUCT_LIMIT') AS limited, count_if(vector_status = 'STALE') AS stale FROM products GROUP BY shop""")
def _(t):
    c = F.col
    return t("products").groupBy("shop").agg(
        F.count("*").alias("total"), F.count_if("has_vector").alias("vectorised"), F.count_if("searchable").alias("slots"), F.count_if(c("blocked_reason") == "UNPUBLISHED").alias("unpublished"),
        F.count_if(c("blocked_reason") == "PRODUCT_LIMIT").alias("limited"), F.count_if(c("vector_status") == "STALE").alias("stale"),
    )


@query("agg5_enrichment_coverage", ("products",), "SELECT shop, count(*) AS products, count_if(vector_status = 'STALE') AS fallback, count_if(vector_status = 'MISSING' AND blocked_reason IS NULL) AS awaiting FROM products GROUP BY shop")
def _(t):
    c = F.col
    return t("products").groupBy("shop").agg(
        F.count("*").alias("products"), F.count_if(c("vector_status") == "STALE").alias("fallback"), F.count_if((c("vector_status") == "MISSING") & c("blocked_reason").isNull()).alias("awaiting")
    )


@query("agg6_queue_status", ("sync_jobs",), """SELECT shop, count_if(status = 'PENDING') AS pending, count_if(status = 'PROCESSING') AS processing, count_if(status = 'FAILED') AS failed, count_if(status = 'DONE') AS done FROM sync_jobs GROUP BY GROUPING SETS ((shop), ())""")
def _(t):
    return t("sync_jobs").rollup("shop").agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PENDING", "PROCESSING", "FAILED", "DONE")))


@query("agg7_usage_counts", ("usage_event",), "SELECT shop, period_start, type, count(*) AS n FROM usage_event GROUP BY ALL")
def _(t):
    return t("usage_event").groupBy("shop", "period_start", "type").agg(F.count("*").alias("n"))


@query("met2_period_counters", ("usage_event",), """SELECT shop, period_start, count_if(type = 'SEARCH') AS searches, count_if(type = 'VECTOR_UPDATE') AS vector_updates, count_if(type = 'FALLBACK') AS fallbacks,
  count_if(type = 'BLOCKED') AS blocked, CAST(count_if(type = 'SYNC') AS BIGINT) AS syncs FROM usage_event GROUP BY ALL""")
def _(t):
    names = {"SEARCH": "searches", "VECTOR_UPDATE": "vector_updates", "FALLBACK": "fallbacks", "BLOCKED": "blocked", "SYNC": "syncs"}
    return t("usage_event").groupBy("shop", "period_start").agg(*(F.count_if(F.col("type") == k).alias(v) for k, v in names.items()))


@query("win6_quota_gate", ("usage_event",), """SELECT event_id, shop, row_number() OVER (PARTITION BY shop, period_start ORDER BY created_at, event_id) <= 300 AS accepted FROM usage_event WHERE type = 'SEARCH'""")
def _(t):
    rows = t("usage_event").where("type = 'SEARCH'")
    return gate(rows, ["shop", "period_start"], ["created_at", "event_id"], F.lit(300)).select("event_id", "shop", "accepted")


@query("win7_slot_gate", ("products",), """WITH s AS (SELECT shop, count_if(searchable) AS used FROM products GROUP BY shop)
SELECT p.shop, product_id, row_number() OVER (PARTITION BY p.shop ORDER BY product_id) + used <= 600 AS accepted FROM products p JOIN s ON s.shop = p.shop WHERE NOT searchable""")
def _(t):
    p = t("products")
    used = p.groupBy("shop").agg(F.count_if("searchable").alias("used"))
    rows = p.where("NOT searchable").join(small(used), "shop")
    return gate(rows, "shop", ["product_id"], 600 - F.col("used")).select("shop", "product_id", "accepted")


@query("win8_reindex_selection", ("products",), """WITH c AS (SELECT *, blocked_reason = 'PRODUCT_LIMIT' AND blocked_reason IS NOT NULL AS free FROM products WHERE vector_status <> 'READY' AND coalesce(blocked_reason, '') <> 'UNPUBLISHED')
SELECT shop, product_id, free FROM c QUALIFY free OR row_number() OVER (PARTITION BY shop, free ORDER BY product_id) <= 50""")
def _(t):
    free = F.coalesce(F.col("blocked_reason") == "PRODUCT_LIMIT", F.lit(False))
    rows = t("products").where("vector_status <> 'READY' AND coalesce(blocked_reason, '') <> 'UNPUBLISHED'").withColumn("free", free)
    return rows.where("free").unionByName(top(rows.where("NOT free"), "shop", ["product_id"], 50)).select("shop", "product_id", "free")


@query("win5_beyond_newest", ("products",), "SELECT shop, product_id FROM products WHERE has_vector QUALIFY row_number() OVER (PARTITION BY shop ORDER BY product_id DESC) > 100")
def _(t):
    return ranked(t("products").where("has_vector"), "shop", [F.desc("product_id")]).where("rank > 100").select("shop", "product_id")


def _eligible(t):
    rows = t("products").withColumns({"status": F.lit(None).cast("string"), "created_at": F.col("product_id")})
    limits = t("products").select("shop").distinct().withColumns({"active": F.col("shop") != "shop_2", "product_limit": F.lit(400)})
    return M.eligibility(rows, limits)


_ELIGIBLE = """e0 AS (SELECT *, coalesce(blocked_reason, '') = 'UNPUBLISHED' AS unpub, shop <> 'shop_2' AS active FROM products),
e1 AS (SELECT *, row_number() OVER (PARTITION BY shop ORDER BY unpub, searchable DESC, (vector_status = 'READY') DESC, product_id) AS n FROM e0),
e2 AS (SELECT *, NOT unpub AND n <= CASE WHEN active THEN 400 ELSE 0 END AS chosen, CASE WHEN active THEN 'PRODUCT_LIMIT' ELSE 'SUBSCRIPTION' END AS cause FROM e1),
e AS (SELECT shop, product_id, chosen, chosen AND has_vector AS now_searchable, CASE WHEN unpub THEN 'UNPUBLISHED' WHEN NOT chosen THEN cause END AS now_blocked,
  CASE WHEN unpub THEN 'UNPUBLISHED' WHEN chosen AND has_vector THEN 'INDEXED' WHEN chosen AND coalesce(blocked_reason, '') = 'PRODUCT_LIMIT' THEN 'PRODUCT_LIMIT_RECOVERY_PENDING'
    WHEN chosen THEN 'VECTOR_QUOTA_BLOCKED' ELSE concat(cause, '_BLOCKED') END AS now_status,
  chosen AND (NOT has_vector OR vector_status <> 'READY') AS requires_reindex, searchable AS was_searchable FROM e2)"""


@query("win3_eligibility_plan", ("products",), f"WITH {_ELIGIBLE} SELECT * FROM e")
def _(t):
    return _eligible(t)


@query("win4_eligibility_diff", ("products",), f"""WITH {_ELIGIBLE} SELECT shop, count_if(now_searchable AND NOT was_searchable) AS reactivated, count_if(NOT now_searchable AND was_searchable) AS deactivated,
  count_if(requires_reindex) AS reindex, count_if(was_searchable) AS before, count_if(now_searchable) AS after FROM e GROUP BY shop""")
def _(t):
    now, was = F.col("now_searchable"), F.col("was_searchable")
    return _eligible(t).groupBy("shop").agg(
        F.count_if(now & ~was).alias("reactivated"), F.count_if(~now & was).alias("deactivated"), F.count_if("requires_reindex").alias("reindex"), F.count_if(was).alias("before"), F.count_if(now).alias("after")
    )


def now():
    return F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")


_GRANTS = """g AS (SELECT shop, CAST(coalesce(sum(amount) FILTER (WHERE kind = 'SEARCH'), 0) AS BIGINT) AS granted_search, CAST(coalesce(sum(amount) FILTER (WHERE kind = 'PRODUCT'), 0) AS BIGINT) AS granted_product,
  CAST(coalesce(sum(amount) FILTER (WHERE kind = 'VECTOR_UPDATE'), 0) AS BIGINT) AS granted_vector_update FROM quota_grants
  WHERE starts_at <= TIMESTAMP '2024-01-31' AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-31') AND (revoked_at IS NULL OR revoked_at > TIMESTAMP '2024-01-31') GROUP BY shop)"""


@query("jn5_active_grants", ("quota_grants",), f"WITH {_GRANTS} SELECT * FROM g")
def _(t):
    return M.active_grants(t("quota_grants"), now())


@query("jn17_valid_grants", ("quota_grants",), "SELECT grant_id, shop, kind FROM quota_grants WHERE starts_at <= TIMESTAMP '2024-01-20' AND coalesce(expires_at, TIMESTAMP '9999-01-01') > TIMESTAMP '2024-01-20' AND coalesce(revoked_at, TIMESTAMP '9999-01-01') > TIMESTAMP '2024-01-20'")
def _(t):
    at = F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    later = [F.col(c).isNull() | (F.col(c) > at) for c in ("expires_at", "revoked_at")]
    return t("quota_grants").where((F.col("starts_at") <= at) & later[0] & later[1]).select("grant_id", "shop", "kind")


_LIMITS = f"""{_GRANTS},
used AS (SELECT shop, count_if(type = 'SEARCH') AS used FROM usage_event GROUP BY shop),
q AS (SELECT s.shop, used, CASE WHEN s.shop = 'shop_2' THEN 0 ELSE least(CASE WHEN s.shop = 'shop_1' THEN 500 ELSE 3000 END + coalesce(granted_search, 0), 1000000000) END AS search_limit FROM used s LEFT JOIN g USING (shop))"""


def _limits(t):
    used = t("usage_event").groupBy("shop").agg(F.count_if(F.col("type") == "SEARCH").alias("used"))
    rows = used.join(M.active_grants(t("quota_grants"), now()), "shop", "left")
    own = F.when(F.col("shop") == "shop_1", 500)
    limit = M.effective_limit(F.lit(3000).cast("long"), own, F.col("granted_search"), F.col("shop") != "shop_2")
    return rows.select("shop", "used", limit.alias("search_limit"))


@query("met4_effective_limits", ("quota_grants", "usage_event"), f"WITH {_LIMITS} SELECT shop, used, CAST(search_limit AS BIGINT) AS search_limit FROM q")
def _(t):
    return _limits(t)


@query("met6_quota_view", ("quota_grants", "usage_event"), f"WITH {_LIMITS} SELECT shop, CAST(greatest(search_limit - used, 0) AS BIGINT) AS remaining, CAST(CASE WHEN search_limit > 0 THEN least(floor(used / search_limit * 100 + 0.5), 100) END AS BIGINT) AS percent FROM q")
def _(t):
    return _limits(t).select("shop", *M.quota_view(F.col("used"), F.col("search_limit")))


@query("met3_reservation_outcomes", ("reservations",), """SELECT reservation_id, shop, kind, CASE WHEN updated_at > TIMESTAMP '2024-01-31' - INTERVAL 30 MINUTE THEN 'PENDING' WHEN effect_applied THEN 'COMMITTED' ELSE 'ROLLED_BACK' END AS outcome FROM reservations""")
def _(t):
    return M.reservation_outcomes(t("reservations"), now()).select("reservation_id", "shop", "kind", "outcome")


@query("jn4_latest_period", ("usage_event",), """WITH c AS (SELECT shop, CAST(date_trunc('week', created_at) AS DATE) AS period, count(*) AS used FROM usage_event GROUP BY ALL)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY shop ORDER BY period DESC) = 1""")
def _(t):
    per = t("usage_event").groupBy("shop", F.to_date(F.date_trunc("week", "created_at")).alias("period")).agg(F.count("*").alias("used"))
    return latest(per, "shop", ["period"])


@query("agg20_budget", (*API, "query_log"), f"""WITH {_USAGE}, c AS (SELECT coalesce(sum(cost_micros) FILTER (WHERE operation LIKE 'QUERY%'), 0) AS spent, (SELECT count(*) FROM query_log) AS searches FROM u)
SELECT CAST(spent AS BIGINT) AS spent, searches, CASE WHEN searches > 0 THEN round(spent / searches, 6) END AS per_search, CAST(greatest(100000000 - spent, 0) AS BIGINT) AS remaining,
  CAST(CASE WHEN searches > 0 AND spent > 0 THEN floor(greatest(100000000 - spent, 0) / (spent / searches)) END AS BIGINT) AS searches_left FROM c""")
def _(t):
    spent = usage(t).agg(F.coalesce(F.sum(F.when(F.col("operation").startswith("QUERY"), F.col("cost_micros"))), F.lit(0)).alias("spent"))
    c = spent.crossJoin(t("query_log").agg(F.count("*").alias("searches")))
    left = F.greatest(F.lit(100_000_000) - F.col("spent"), F.lit(0))
    each = F.when(F.col("searches") > 0, F.col("spent") / F.col("searches"))
    return c.select("spent", "searches", F.round(each, 6).alias("per_search"), left.alias("remaining"), F.when(each > 0, F.floor(left / each)).alias("searches_left"))


@query("str9_throttle_twin", ("usage_event",), """WITH RECURSIVE f AS (SELECT shop, event_id, created_at, row_number() OVER (PARTITION BY shop ORDER BY created_at, event_id) AS i FROM usage_event WHERE type = 'FALLBACK'),
r AS (SELECT shop, event_id, created_at, i, created_at AS started, 1 AS n FROM f WHERE i = 1
  UNION ALL SELECT f.shop, f.event_id, f.created_at, f.i, CASE WHEN f.created_at - r.started > INTERVAL 6 HOUR THEN f.created_at ELSE r.started END, CASE WHEN f.created_at - r.started > INTERVAL 6 HOUR THEN 1 ELSE r.n + 1 END
  FROM r JOIN f ON f.shop = r.shop AND f.i = r.i + 1)
SELECT shop, event_id, n, n >= 5 AS blocked FROM r""")
def _(t):
    return M.throttled(t("usage_event").where("type = 'FALLBACK'"), 6 * 3600, 5)
