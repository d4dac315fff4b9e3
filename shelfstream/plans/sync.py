"""Queries of catalog synchronisation and maintenance."""

from pyspark.sql import functions as F

from ..operators import sync as S
from ..operators.ranking import latest, ranked, top
from .registry import query

JOBS = ("sync_jobs",)
_AT = "TIMESTAMP '2024-01-31'"


def now():
    return F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")


_IN = """i AS (SELECT shop, product_id, sha256(concat(title, '|', product_type)) AS dh, sha256(concat(title, '|', CAST(size_no AS VARCHAR))) AS sh, CASE WHEN blocked_reason = 'UNPUBLISHED' THEN 'POLICY' END AS blocked FROM products WHERE product_id % 19 <> 0),
r AS (SELECT shop, product_id, sha256(concat(CASE WHEN product_id % 7 = 0 THEN 'old' ELSE title END, '|', product_type)) AS odh, sha256(concat(title, '|', CAST(size_no + CAST(product_id % 3 = 0 AS INT) AS VARCHAR))) AS osh, has_vector FROM products WHERE product_id % 23 <> 0),
a AS (SELECT shop, product_id, CASE WHEN i.dh IS NULL THEN 'REMOVE' WHEN blocked IS NOT NULL THEN 'BLOCKED' WHEN r.odh IS NULL OR NOT has_vector THEN 'INDEX' WHEN dh <> odh THEN 'INDEX' WHEN sh <> osh THEN 'METADATA' ELSE 'SKIP' END AS action FROM i FULL JOIN r USING (shop, product_id))"""


def _actions(t):
    p = t("products")
    size, c = F.col("size_no").cast("string"), F.col
    new = p.where("product_id % 19 <> 0").select("shop", "product_id", F.sha2(F.concat_ws("|", "title", "product_type"), 256).alias("document_hash"), F.sha2(F.concat_ws("|", "title", size), 256).alias("source_hash"), F.when(c("blocked_reason") == "UNPUBLISHED", "POLICY").alias("blocked"))
    old_title = F.when(c("product_id") % 7 == 0, "old").otherwise(c("title"))
    old_size = (c("size_no") + F.when(c("product_id") % 3 == 0, 1).otherwise(0)).cast("string")
    old = p.where("product_id % 23 <> 0").select("shop", "product_id", F.sha2(F.concat_ws("|", old_title, "product_type"), 256).alias("old_document_hash"), F.sha2(F.concat_ws("|", "title", old_size), 256).alias("old_source_hash"), "has_vector")
    return S.index_actions(new, old)


@query("syn1_index_actions", ("products",), f"WITH {_IN} SELECT shop, product_id, action, action = 'INDEX' AS costs_vector FROM a")
def _(t):
    return _actions(t)


@query("syn2_scan_totals", ("products",), f"WITH {_IN} SELECT shop, action, count(*) AS n FROM a GROUP BY ALL")
def _(t):
    return _actions(t).groupBy("shop", "action").agg(F.count("*").alias("n"))


@query("jn13_change_costs", ("products",), f"WITH {_IN} SELECT shop, count_if(action = 'INDEX') AS vector_updates, count_if(action = 'REMOVE') AS removals FROM a GROUP BY shop")
def _(t):
    return _actions(t).groupBy("shop").agg(F.count_if("costs_vector").alias("vector_updates"), F.count_if(F.col("action") == "REMOVE").alias("removals"))


@query("syn3_blocked_states", ("products",), """SELECT shop, product_id, coalesce(blocked_reason, 'NONE') AS reason, CASE WHEN blocked_reason IS NULL THEN vector_status WHEN has_vector THEN 'STALE' ELSE 'MISSING' END AS vector_status, blocked_reason IS NULL AND searchable AND has_vector AS searchable FROM products""")
def _(t):
    c = F.col
    state = F.when(c("blocked_reason").isNull(), c("vector_status")).when(c("has_vector"), "STALE").otherwise("MISSING")
    return t("products").select("shop", "product_id", F.coalesce("blocked_reason", F.lit("NONE")).alias("reason"), state.alias("vector_status"), (c("blocked_reason").isNull() & c("searchable") & c("has_vector")).alias("searchable"))


@query("syn4_revisions", JOBS, "SELECT shop, count_if(topic <> 'REINDEX_PRODUCT') + count_if(topic = 'REINDEX_PRODUCT') AS catalog_revision, count_if(topic = 'REINDEX_PRODUCT') AS semantic_revision FROM sync_jobs GROUP BY shop")
def _(t):
    return t("sync_jobs").groupBy("shop").agg(F.count("*").alias("catalog_revision"), F.count_if(F.col("topic") == "REINDEX_PRODUCT").alias("semantic_revision"))


@query("syn5_refresh_decision", (*JOBS, "products", "query_log"), """WITH l AS (SELECT shop, status, job_id FROM sync_jobs QUALIFY row_number() OVER (PARTITION BY shop ORDER BY created_at DESC, job_id DESC) = 1),
p AS (SELECT shop, count_if(has_vector) AS indexed FROM products GROUP BY shop),
s AS (SELECT shop, u, CASE WHEN u = 0 THEN indexed ELSE 0 END AS indexed, CASE WHEN u IN (0, 4) THEN NULL ELSE job_id END AS job, u = 2 AS forced, CASE WHEN u = 3 THEN 'basic' ELSE 'pro' END AS old_plan, 'pro' AS plan, CASE WHEN u = 1 THEN 100 ELSE 505 END AS old_limit, CASE WHEN u = 5 THEN 100 WHEN u = 3 THEN NULL ELSE 505 END AS new_limit
  FROM p JOIN l USING (shop) CROSS JOIN (SELECT unnest(range(6)) AS u))
SELECT shop, CAST(u AS INTEGER) AS scenario, CASE WHEN job IS NULL AND indexed = 0 THEN 'INITIAL' WHEN forced OR new_limit IS NULL AND job IS NOT NULL AND old_plan <> plan OR new_limit IS NULL OR new_limit > old_limit THEN 'PLAN_RECONCILE' ELSE 'NONE' END AS decision FROM s""")
def _(t):
    """Each shop in six situations: without a job, with more room, forced, of another plan, without a job but indexed, with less room."""
    jobs = latest(t("sync_jobs").select("shop", "status", "created_at", "job_id"), "shop", ["created_at", "job_id"]).select("shop", "job_id")
    stats = t("products").groupBy("shop").agg(F.count_if("has_vector").alias("indexed"))
    u = F.col("scenario")
    rows = stats.join(jobs, "shop").withColumn("scenario", F.explode(F.sequence(F.lit(0), F.lit(5))))
    rows = rows.withColumns({"indexed": F.when(u == 0, F.col("indexed")).otherwise(0), "job_id": F.when(~u.isin(0, 4), F.col("job_id"))})
    limit = lambda low: F.when(u == low, 100).otherwise(505)
    decision = S.refresh_decision(F.col("job_id").isNotNull(), F.col("indexed"), u == 2, F.when(u == 3, "basic").otherwise("pro"), F.lit("pro"), limit(1), F.when(u != 3, limit(5)))
    return rows.select("shop", "scenario", decision.alias("decision"))


_ROOM = "CASE {0} WHEN 'basic' THEN 505 WHEN 'pro' THEN 5005 END"


@query("syn5_refresh_subscriptions", ("subscriptions",), f"""WITH o AS (SELECT *, lag(plan_handle) OVER w AS old_plan, row_number() OVER (PARTITION BY shop ORDER BY updated_at DESC, sub_id DESC) AS n, count(*) FILTER (WHERE status = 'ACTIVE') OVER (PARTITION BY shop) AS indexed, count(*) OVER (PARTITION BY shop) > 1 AS has_job FROM subscriptions WINDOW w AS (PARTITION BY shop ORDER BY updated_at, sub_id)),
l AS (SELECT *, {_ROOM.format("old_plan")} AS old_limit, {_ROOM.format("plan_handle")} AS new_limit FROM o WHERE n = 1)
SELECT shop, CASE WHEN NOT has_job AND indexed = 0 THEN 'INITIAL' WHEN status = 'FROZEN' OR new_limit IS NULL AND has_job AND old_plan <> plan_handle OR old_limit IS NOT NULL AND (new_limit IS NULL OR new_limit > old_limit) THEN 'PLAN_RECONCILE' ELSE 'NONE' END AS decision FROM l""")
def _(t):
    """Each shop by its last subscription and the one before; a frozen one forces the decision, active ones stand for what is indexed."""
    last = t("subscriptions").groupBy("shop").agg(F.slice(F.sort_array(F.collect_list(F.struct("updated_at", "sub_id", "plan_handle", "status")), False), 1, 2).alias("s"), F.count_if(F.col("status") == "ACTIVE").alias("indexed"), F.count("*").alias("n"))
    old, new, room = F.try_element_at("s", F.lit(2))["plan_handle"], F.col("s")[0]["plan_handle"], lambda c: F.expr(_ROOM.format(c))
    rows = last.select("shop", "indexed", (F.col("n") > 1).alias("has_job"), (F.col("s")[0]["status"] == "FROZEN").alias("forced"), old.alias("old_plan"), new.alias("plan"))
    return rows.select("shop", S.refresh_decision(F.col("has_job"), F.col("indexed"), F.col("forced"), F.col("old_plan"), F.col("plan"), room("old_plan"), room("plan")).alias("decision"))


@query("syn6_policy_gate", (*JOBS, "products"), """SELECT j.job_id, j.job_id % 4 <> 0 AND coalesce(p.searchable, false) AS runs FROM sync_jobs j LEFT JOIN products p ON p.shop = j.shop AND p.product_id = j.product_id WHERE j.topic = 'REINDEX_PRODUCT'""")
def _(t):
    jobs = t("sync_jobs").where("topic = 'REINDEX_PRODUCT'").select("job_id", "shop", "product_id")
    rows = jobs.join(t("products").select("shop", "product_id", "searchable"), ["shop", "product_id"], "left")
    return rows.select("job_id", ((F.col("job_id") % 4 != 0) & F.coalesce("searchable", F.lit(False))).alias("runs"))


@query("syn7_requeue_failed", JOBS, "SELECT job_id, shop, 'PENDING' AS status, CAST(0 AS BIGINT) AS attempts FROM sync_jobs WHERE status = 'FAILED' QUALIFY row_number() OVER (PARTITION BY shop ORDER BY updated_at, job_id) <= 20")
def _(t):
    rows = top(t("sync_jobs").where("status = 'FAILED'"), "shop", ["updated_at", "job_id"], 20)
    return rows.select("job_id", "shop", F.lit("PENDING").alias("status"), F.lit(0).cast("long").alias("attempts"))


@query("syn8_catalog_listing", ("products",), """WITH c AS (SELECT shop, product_id, has_vector AND searchable AS indexed, CASE WHEN blocked_reason = 'UNPUBLISHED' THEN 'Not published' WHEN blocked_reason = 'PRODUCT_LIMIT' THEN 'Over the product limit' WHEN NOT has_vector THEN 'Waiting for a vector' END AS issue FROM products)
SELECT *, CAST(row_number() OVER (PARTITION BY shop, indexed ORDER BY product_id) AS INTEGER) AS rank FROM c QUALIFY rank <= 25""")
def _(t):
    c = F.col
    issue = F.when(c("blocked_reason") == "UNPUBLISHED", "Not published").when(c("blocked_reason") == "PRODUCT_LIMIT", "Over the product limit").when(~c("has_vector"), "Waiting for a vector")
    rows = t("products").select("shop", "product_id", (c("has_vector") & c("searchable")).alias("indexed"), issue.alias("issue"))
    return ranked(rows, ["shop", "indexed"], ["product_id"]).where("rank <= 25")


@query("jn1_registry_guard", ("ranked", "products"), """SELECT r.log_id, r.product_id, CAST(row_number() OVER (PARTITION BY r.log_id ORDER BY rnk) AS INTEGER) AS rank FROM ranked r WHERE EXISTS (SELECT 1 FROM products p WHERE p.shop = r.shop AND p.product_id = r.product_id AND p.searchable AND p.has_vector)""")
def _(t):
    valid = t("products").where("searchable AND has_vector").select("shop", "product_id")
    return ranked(t("ranked").join(valid, ["shop", "product_id"], "left_semi"), "log_id", ["rnk"]).select("log_id", "product_id", "rank")


@query("jn2_due_shops", (*JOBS, "products"), """WITH done AS (SELECT shop, max(updated_at) AS last_done FROM sync_jobs WHERE status = 'DONE' GROUP BY shop)
SELECT s.shop, d.last_done FROM (SELECT DISTINCT shop FROM products) s LEFT JOIN done d USING (shop) WHERE EXISTS (SELECT 1 FROM sync_jobs j WHERE j.shop = s.shop AND j.topic = 'PRODUCTS_CREATE')
AND NOT EXISTS (SELECT 1 FROM sync_jobs j WHERE j.shop = s.shop AND j.status = 'PENDING' AND j.created_at > TIMESTAMP '2024-01-30 23:30:00') AND coalesce(d.last_done, TIMESTAMP '1970-01-01') < TIMESTAMP '2024-02-01' ORDER BY last_done LIMIT 25""")
def _(t):
    jobs = t("sync_jobs")
    done = jobs.where("status = 'DONE'").groupBy("shop").agg(F.max("updated_at").alias("last_done"))
    shops = t("products").select("shop").distinct().join(jobs.where("topic = 'PRODUCTS_CREATE'").select("shop"), "shop", "left_semi")
    shops = shops.join(jobs.where("status = 'PENDING' AND created_at > TIMESTAMP_NTZ '2024-01-30 23:30:00'").select("shop"), "shop", "left_anti").join(done, "shop", "left")
    before = F.col("last_done").isNull() | (F.col("last_done") < F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'"))
    return shops.where(before).orderBy(F.col("last_done").asc_nulls_first(), "shop").limit(25)


@query("jn3_enrichment_retry", (*JOBS, "products"), """SELECT DISTINCT p.shop, p.product_id, sha256(concat(p.shop, '|', CAST(p.product_id AS VARCHAR), '|', CAST(CAST(floor(epoch(j.updated_at) / 21600) AS BIGINT) AS VARCHAR))) AS token
FROM products p JOIN sync_jobs j ON j.shop = p.shop AND j.product_id = p.product_id WHERE p.vector_status <> 'READY' AND j.status = 'FAILED' AND j.attempts < 4""")
def _(t):
    jobs = t("sync_jobs").where("status = 'FAILED' AND attempts < 4").select("shop", "product_id", "updated_at")
    due = t("products").where("vector_status <> 'READY'").select("shop", "product_id").join(jobs, ["shop", "product_id"])
    bucket = F.floor(F.unix_seconds(F.col("updated_at").cast("timestamp")) / 21600).cast("string")
    return due.select("shop", "product_id", F.sha2(F.concat_ws("|", "shop", F.col("product_id").cast("string"), bucket), 256).alias("token")).distinct()


@query("jn6_orphan_vectors", ("products",), """WITH v AS (SELECT vec_id, concat('shop_', CAST(label % 3 AS VARCHAR)) AS shop, CASE WHEN vec_id % 17 = 0 THEN NULL ELSE vec_id END AS product_id, TIMESTAMP '2024-01-01' + to_hours(CAST(vec_id % 800 AS INTEGER)) AS indexed_at FROM embeddings)
SELECT vec_id, 'MALFORMED' AS class FROM v WHERE product_id IS NULL UNION ALL SELECT vec_id, 'ORPHAN' FROM v WHERE product_id IS NOT NULL AND indexed_at < TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR AND NOT EXISTS (SELECT 1 FROM products p WHERE p.shop = v.shop AND p.product_id = v.product_id)""")
def _(t):
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_dt_interval(hours=(F.col("vec_id") % 800).cast("int"))
    v = t("embeddings").select("vec_id", F.concat(F.lit("shop_"), (F.col("label") % 3).cast("string")).alias("shop"), F.when(F.col("vec_id") % 17 != 0, F.col("vec_id")).alias("product_id"), at.alias("indexed_at"))
    return S.orphan_vectors(v, t("products"), now(), 24)


@query("jn7_stale_rows", ("products",), "SELECT shop, product_id, CASE WHEN size_no % 10 = 0 THEN 'REMOVE' WHEN blocked_reason IS DISTINCT FROM 'UNPUBLISHED' THEN 'TOUCH' ELSE 'UNPUBLISH' END AS action FROM products WHERE vector_status <> 'READY'")
def _(t):
    """Rows without a ready vector stand for those that the scan did not see; sizes in tens are no longer in the live catalog."""
    p = t("products")
    live = p.where("size_no % 10 <> 0").select("shop", "product_id", (~F.col("blocked_reason").eqNullSafe(F.lit("UNPUBLISHED"))).alias("published"))
    return S.stale_actions(p.where("vector_status <> 'READY'").select("shop", "product_id"), live)


@query("jn15_revalidation", ("ranked", "products"), """WITH r AS (SELECT r.log_id, r.product_id, p.title, p.product_id % 9 = 0 AS repaired, CAST(row_number() OVER (PARTITION BY r.log_id ORDER BY rnk, r.product_id) AS INTEGER) AS rank FROM ranked r JOIN products p ON p.shop = r.shop AND p.product_id = r.product_id WHERE p.blocked_reason IS DISTINCT FROM 'UNPUBLISHED')
SELECT * FROM r WHERE rank <= 10""")
def _(t):
    old = t("products").select("shop", "product_id", F.when(F.col("product_id") % 9 != 0, F.col("title")).otherwise("was").alias("old_title"))
    shown = t("ranked").join(old, ["shop", "product_id"])
    live = t("products").where(~F.col("blocked_reason").eqNullSafe(F.lit("UNPUBLISHED")))
    return S.revalidate(shown, live, 10).select("log_id", "product_id", "title", "repaired", "rank")


@query("src7_upsert", JOBS, """WITH b AS (SELECT shop, product_id, status, updated_at, 0 AS n FROM sync_jobs WHERE job_id % 2 = 0 UNION ALL SELECT shop, product_id, status, updated_at, 1 FROM sync_jobs WHERE job_id % 2 = 1)
SELECT shop, product_id, status, updated_at FROM b QUALIFY row_number() OVER (PARTITION BY shop, product_id ORDER BY updated_at DESC, n DESC) = 1""")
def _(t):
    rows = t("sync_jobs").select("shop", "product_id", "status", "updated_at", "job_id")
    return S.upsert(rows.where("job_id % 2 = 0").drop("job_id"), rows.where("job_id % 2 = 1").drop("job_id"), ["shop", "product_id"], "updated_at")


@query("win15_due_jobs", JOBS, """WITH e AS (SELECT job_id, shop, CASE status WHEN 'PENDING' THEN created_at WHEN 'PROCESSING' THEN updated_at + INTERVAL 2 MINUTE WHEN 'FAILED' THEN CASE WHEN attempts < 5 THEN updated_at + to_milliseconds(CAST(1000 * least(5 * pow(2, greatest(attempts - 1, 0)), 300) AS BIGINT)) END END AS eligible_at FROM sync_jobs)
SELECT * FROM e WHERE eligible_at <= TIMESTAMP '2024-01-31' QUALIFY row_number() OVER (PARTITION BY shop ORDER BY eligible_at, job_id) <= 100""")
def _(t):
    c = F.col
    rows = t("sync_jobs").select("job_id", "shop", S.eligible_at(c("status"), c("created_at"), c("updated_at"), c("attempts")).alias("eligible_at"))
    return top(rows.where(c("eligible_at") <= now()), "shop", ["eligible_at", "job_id"], 100)


@query("str1_first_deliveries", JOBS, "SELECT webhook_id, min(job_id) AS job_id, count(*) - 1 AS duplicates FROM sync_jobs GROUP BY webhook_id")
def _(t):
    return t("sync_jobs").groupBy("webhook_id").agg(F.min_by("job_id", F.struct("created_at", "job_id")).alias("job_id"), (F.count("*") - 1).alias("duplicates"))


@query("str2_out_of_order_twin", JOBS, """WITH w AS (SELECT job_id, shop, updated_at, max(updated_at) OVER (PARTITION BY shop ORDER BY job_id * 7919 % 10007, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM sync_jobs)
SELECT job_id, coalesce(updated_at < newest, false) AS late FROM w""")
def _(t):
    from pyspark.sql import Window as W

    before = W.partitionBy("shop").orderBy(F.col("job_id") * 7919 % 10007, "job_id").rowsBetween(W.unboundedPreceding, -1)
    rows = t("sync_jobs").withColumn("newest", F.max("updated_at").over(before))
    return rows.select("job_id", F.coalesce(F.col("updated_at") < F.col("newest"), F.lit(False)).alias("late"))


@query("str3_burst_twin", JOBS, """WITH a AS (SELECT *, CASE WHEN lag(status) OVER o IS DISTINCT FROM 'PENDING' OR status <> 'PENDING' THEN 1 ELSE 0 END AS s FROM sync_jobs WINDOW o AS (PARTITION BY shop, product_id ORDER BY created_at, job_id)),
b AS (SELECT *, sum(s) OVER (PARTITION BY shop, product_id ORDER BY created_at, job_id) AS g FROM a)
SELECT job_id, min(job_id) OVER (PARTITION BY shop, product_id, g) AS absorbed_by FROM b""")
def _(t):
    return S.coalesce_jobs(t("sync_jobs")).select("job_id", "absorbed_by")


@query("str3_burst_feed", ("job_feed",), """WITH f AS (SELECT *, CASE WHEN topic IN ('PRODUCTS_CREATE', 'PRODUCTS_UPDATE') THEN 'LIVE' WHEN topic IN ('REINDEX_PRODUCT', 'REINDEX_PRODUCT_CAPACITY', 'REINDEX_PRODUCT_SUBSCRIPTION') THEN 'POLICY' ELSE topic END AS class FROM job_feed),
v AS (SELECT *, CASE WHEN class = 'POLICY' THEN policy_version ELSE -1 END AS version FROM f),
b AS (SELECT *, (SELECT count(*) FROM v e WHERE e.shop = v.shop AND e.product_id = v.product_id AND e.class = v.class AND e.version = v.version AND e.event = CASE WHEN v.class = 'LIVE' THEN 'START' ELSE 'END' END AND (e.ts, e.feed_id) < (v.ts, v.feed_id)) AS burst FROM v WHERE event = 'REQUEST')
SELECT shop, product_id, job_id, arg_min(job_id, (ts, feed_id)) OVER (PARTITION BY shop, product_id, class, version, burst) AS absorbed_by FROM b""")
def _(t):
    return S.coalesce_feed(t("job_feed"), "ts")


_WHEN = "TIMESTAMP '2024-01-05 12:00:00'"


def _when():
    return F.expr("TIMESTAMP_NTZ '2024-01-05 12:00:00'")


@query("str6_terminal_jobs", JOBS, f"""WITH j AS (SELECT *, status = 'PROCESSING' AND updated_at + INTERVAL 2 MINUTE <= {_WHEN} AND attempts >= 5 AS dead FROM sync_jobs)
SELECT job_id, CASE WHEN dead THEN 'FAILED' ELSE status END AS status, dead OR status = 'FAILED' AND attempts >= 5 AS exhausted,
  CASE WHEN attempts < 5 THEN CASE status WHEN 'PENDING' THEN created_at WHEN 'PROCESSING' THEN updated_at + INTERVAL 2 MINUTE WHEN 'FAILED' THEN updated_at + to_seconds(CAST(least(5 * pow(2, greatest(attempts - 1, 0)), 300) AS INTEGER)) END END AS eligible_at FROM j""")
def _(t):
    return S.settled_jobs(t("sync_jobs"), _when())


_REASONS = "['INITIAL', 'STOREFRONT_RECONCILE', 'SLOT_REFILL', 'PLAN_RECONCILE', 'RECONCILE', 'MANUAL_REFRESH', 'LANGUAGE_CHANGE', 'OTHER']"


@query("str7_catalog_priority", JOBS, f"""WITH j AS (SELECT job_id, concat(shop, '_', CAST(product_id AS VARCHAR)) AS shop, {_REASONS}[job_id * 5 % 8 + 1] AS reason, status, attempts, created_at, updated_at FROM sync_jobs WHERE created_at <= {_WHEN}),
k AS (SELECT *, [10, 20, 30, 40, 50, 60, 100, 50][list_position({_REASONS}, reason)] AS priority, CASE status WHEN 'PENDING' THEN created_at WHEN 'PROCESSING' THEN updated_at + INTERVAL 5 MINUTE WHEN 'FAILED' THEN updated_at + to_seconds(CAST(least(10 * pow(2, greatest(attempts - 1, 0)), 300) AS INTEGER)) END AS due FROM j),
o AS (SELECT *, coalesce(attempts < 4 AND due <= {_WHEN}, false) AS open, status = 'PROCESSING' AND updated_at + INTERVAL 5 MINUTE > {_WHEN} AS busy FROM k)
SELECT shop, arg_max(job_id, (priority, job_id)) FILTER (WHERE open) AS job_id, arg_max(reason, (priority, job_id)) FILTER (WHERE open) AS reason, count_if(open) AS waiting FROM o GROUP BY shop HAVING NOT bool_or(busy) AND count_if(open) > 0""")
def _(t):
    """Jobs dealt to as many shops as there are products, with reasons in turn."""
    reasons = F.array(*[F.lit(r) for r in (*S.REASON_PRIORITY, "OTHER")])
    shop = F.concat_ws("_", "shop", F.col("product_id").cast("string"))
    rows = t("sync_jobs").where(F.col("created_at") <= _when()).withColumns({"reason": reasons[(F.col("job_id") * 5 % 8).cast("int")], "shop": shop})
    return S.next_scans(rows, _when())


@query("mnt1_retention", JOBS, f"""WITH k AS (SELECT *, updated_at >= {_AT} - to_days(CASE status WHEN 'DONE' THEN 7 WHEN 'FAILED' THEN 14 ELSE 20 END) AS kept FROM sync_jobs) SELECT shop, status, count_if(kept) AS kept, count_if(NOT kept) AS removed FROM k GROUP BY ALL""")
def _(t):
    keep = S.retained(t("sync_jobs"), now(), {"DONE": 7, "FAILED": 14}, 20).select("job_id", F.lit(True).alias("kept"))
    rows = t("sync_jobs").join(keep, "job_id", "left")
    return rows.groupBy("shop", "status").agg(F.count("kept").alias("kept"), F.count_if(F.col("kept").isNull()).alias("removed"))


@query("mnt2_tenant_erasure", (*JOBS, "products", "query_log"), """SELECT 'products' AS name, count(*) AS kept FROM products WHERE shop <> 'shop_1' UNION ALL SELECT 'jobs', count(*) FROM sync_jobs WHERE shop <> 'shop_1' UNION ALL SELECT 'logs', count(*) FROM query_log WHERE shop <> 'shop_1'""")
def _(t):
    erased = t.spark.createDataFrame([("shop_1",)], "shop string")
    out = None
    for name, table in (("products", "products"), ("jobs", "sync_jobs"), ("logs", "query_log")):
        n = t(table).join(F.broadcast(erased), "shop", "left_anti").agg(F.lit(name).alias("name"), F.count("*").alias("kept"))
        out = n if out is None else out.unionByName(n)
    return out


@query("mnt3_readiness", (*JOBS, "products"), """WITH p AS (SELECT shop, count_if(has_vector AND searchable) AS ready FROM products GROUP BY shop), j AS (SELECT shop, count_if(status IN ('PENDING', 'PROCESSING')) AS busy, count_if(status = 'FAILED') AS failed FROM sync_jobs GROUP BY shop)
SELECT p.shop, ready, busy, CASE WHEN ready = 0 THEN 'EMPTY' WHEN busy > 0 THEN 'SYNCING' WHEN failed > 0 THEN 'ATTENTION' ELSE 'READY' END AS state FROM p JOIN j USING (shop)""")
def _(t):
    ready = t("products").groupBy("shop").agg(F.count_if(F.col("has_vector") & F.col("searchable")).alias("ready"))
    jobs = t("sync_jobs").groupBy("shop").agg(F.count_if(F.col("status").isin("PENDING", "PROCESSING")).alias("busy"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    state = F.when(F.col("ready") == 0, "EMPTY").when(F.col("busy") > 0, "SYNCING").when(F.col("failed") > 0, "ATTENTION").otherwise("READY")
    return ready.join(jobs, "shop").select("shop", "ready", "busy", state.alias("state"))


@query("mnt5_audit_feed", JOBS, """SELECT j.job_id, j.topic, c.c_name AS actor, j.created_at FROM sync_jobs j LEFT JOIN customer c ON c.c_custkey = j.job_id % 400 ORDER BY j.created_at DESC, j.job_id DESC LIMIT 100""")
def _(t):
    actors = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("actor"))
    newest = t("sync_jobs").orderBy(F.desc("created_at"), F.desc("job_id")).limit(100)
    return newest.join(actors, F.col("job_id") % 400 == F.col("k"), "left").select("job_id", "topic", "actor", "created_at")


@query("set2_union_distinct", ("products", "ranked"), "SELECT shop, product_id FROM products WHERE searchable UNION SELECT shop, product_id FROM ranked")
def _(t):
    return t("products").where("searchable").select("shop", "product_id").union(t("ranked").select("shop", "product_id")).distinct()


@query("set3_intersect", ("products", "ranked"), "SELECT shop, product_id FROM products WHERE searchable INTERSECT SELECT shop, product_id FROM ranked")
def _(t):
    return t("products").where("searchable").select("shop", "product_id").intersect(t("ranked").select("shop", "product_id"))


@query("set4_except", ("products", "ranked"), "SELECT shop, product_id FROM products WHERE searchable EXCEPT SELECT shop, product_id FROM ranked")
def _(t):
    return t("products").where("searchable").select("shop", "product_id").join(t("ranked").select("shop", "product_id").distinct(), ["shop", "product_id"], "left_anti").distinct()


@query("str10_expired_receipts", ("query_log",), "SELECT log_id, shop FROM query_log WHERE created_at + INTERVAL 2 HOUR > TIMESTAMP '2024-01-29'")
def _(t):
    return t("query_log").where(F.col("created_at") + F.expr("INTERVAL '2' HOUR") > F.expr("TIMESTAMP_NTZ '2024-01-29 00:00:00'")).select("log_id", "shop")


@query("str8_click_attribution_twin", ("query_click",), "SELECT click_id, log_id FROM query_click")
def _(t):
    clicks = t("events").where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", "ts")
    logs = t("query_log").select("log_id", "user_id", "created_at")
    pairs = clicks.join(logs, "user_id").where("created_at <= ts AND created_at > ts - INTERVAL '2' HOUR")
    return pairs.groupBy("click_id").agg(F.max("log_id").alias("log_id"))
