"""Queries of subscriptions and revenue."""

from pyspark.sql import functions as F

from ..operators import commerce as C
from ..operators.ranking import latest
from .registry import query

SUBS = ("subscriptions",)
_LAST = "last AS (SELECT * FROM subscriptions QUALIFY row_number() OVER (PARTITION BY shop ORDER BY updated_at DESC, sub_id DESC) = 1)"
_NOW = "TIMESTAMP '2001-06-15'"


def now():
    return F.expr("TIMESTAMP_NTZ '2001-06-15 00:00:00'")


def last(t):
    return latest(t("subscriptions"), "shop", ["updated_at", "sub_id"])


@query("win1_latest_subscription", SUBS, f"WITH {_LAST} SELECT * FROM last")
def _(t):
    return last(t)


@query("win1_operational", SUBS, "SELECT shop, sub_id, status FROM subscriptions WHERE status IN ('ACTIVE', 'PENDING', 'FROZEN') QUALIFY row_number() OVER (PARTITION BY shop ORDER BY updated_at DESC, sub_id DESC) = 1")
def _(t):
    return latest(t("subscriptions").where(F.col("status").isin(*C.OPERATIONAL)), "shop", ["updated_at", "sub_id"]).select("shop", "sub_id", "status")


@query("win2_newest_children", SUBS, """SELECT shop, arg_max(sub_id, (updated_at, sub_id)) AS last_sub, arg_max(sub_id, (updated_at, sub_id)) FILTER (WHERE status = 'CANCELLED') AS last_cancelled FROM subscriptions GROUP BY shop HAVING count_if(status = 'CANCELLED') > 0""")
def _(t):
    order, gone = F.struct("updated_at", "sub_id"), F.col("status") == "CANCELLED"
    per = t("subscriptions").groupBy("shop").agg(F.max_by("sub_id", order).alias("last_sub"), F.max_by(F.when(gone, F.col("sub_id")), F.when(gone, order)).alias("last_cancelled"), F.count_if(gone).alias("n"))
    return per.where("n > 0").drop("n")


@query("agg17_recurring_revenue", SUBS, f"""WITH {_LAST}, p AS (SELECT currency, plan_handle, CASE WHEN interval_code = 'ANNUAL' THEN price_snapshot / 12 ELSE price_snapshot END AS m FROM last WHERE status = 'ACTIVE' AND price_snapshot IS NOT NULL)
SELECT currency, plan_handle, round(sum(m), 4) AS mrr, round(sum(m) * 12, 4) AS arr, count(*) AS n FROM p GROUP BY GROUPING SETS ((currency), (currency, plan_handle))""")
def _(t):
    return C.recurring_revenue(last(t))


@query("agg18_state_counts", SUBS, f"""WITH {_LAST} SELECT plan_handle, count(*) AS total, count_if(status = 'ACTIVE') AS active, count_if(status = 'ACTIVE' AND trial_ends_at > {_NOW}) AS trial, count_if(status = 'FROZEN') AS frozen, count_if(status = 'CANCELLED') AS cancelled FROM last GROUP BY ROLLUP (plan_handle)""")
def _(t):
    return C.state_counts(last(t), now())


@query("agg19_fleet_overview", (*SUBS, "products", "query_log"), f"""WITH {_LAST} SELECT (SELECT count(*) FROM last) AS shops, (SELECT count_if(status = 'ACTIVE') FROM last) AS active, (SELECT count(*) FROM products) AS products, (SELECT count_if(searchable) FROM products) AS searchable, (SELECT count(*) FROM query_log) AS searches""")
def _(t):
    shops = last(t).agg(F.count("*").alias("shops"), F.count_if(F.col("status") == "ACTIVE").alias("active"))
    goods = t("products").agg(F.count("*").alias("products"), F.count_if("searchable").alias("searchable"))
    return shops.crossJoin(goods).crossJoin(t("query_log").agg(F.count("*").alias("searches")))


BILLING = ("billing_rows", "billing_pointers")
_THEN = "TIMESTAMP '2000-03-15'"
_CURRENT = f"""nm AS (SELECT p.shop, p.sub_id AS pointer FROM billing_pointers p LEFT JOIN billing_rows b ON b.shop = p.shop AND b.sub_id = p.sub_id WHERE p.sub_id IS NOT NULL AND NOT coalesce(b.status = 'CANCELLED' AND b.period_ends_at <= {_THEN}, false)),
tr AS (SELECT b.*, CASE WHEN pointer IS NOT NULL THEN CASE WHEN pointer = sub_id THEN 0 END WHEN refund_status <> 'FULL' AND payment_status IN ('PAID', 'RECOVERED') AND trial_status NOT IN ('ACTIVE', 'CANCELLED') AND period_ends_at > {_THEN} AND status IN ('ACTIVE', 'CANCELLED') THEN 1 WHEN status = 'PENDING' THEN 2 END AS tier FROM billing_rows b LEFT JOIN nm ON nm.shop = b.shop),
cur AS (SELECT * FROM tr WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY shop ORDER BY tier, updated_at DESC, sub_id DESC) = 1)"""


def then():
    return F.expr("TIMESTAMP_NTZ '2000-03-15 00:00:00'")


def current(t):
    return C.current_subscription(t("billing_rows"), t("billing_pointers"), then())


@query("bil8_current_subscription", BILLING, f"WITH {_CURRENT} SELECT shop, sub_id, status, CAST(tier AS INTEGER) AS tier FROM cur")
def _(t):
    return current(t).select("shop", "sub_id", "status", "tier")


@query("bil1_derived_states", SUBS, f"""SELECT sub_id, CASE WHEN status = 'CANCELLED' THEN CASE WHEN trial_ends_at > {_NOW} THEN 'FORFEITED' ELSE 'ENDED' END WHEN trial_ends_at > {_NOW} THEN 'ACTIVE' ELSE 'CONVERTED' END AS trial_state,
  CASE WHEN status = 'ACTIVE' THEN 'FULL' WHEN status = 'FROZEN' THEN 'SUSPENDED' WHEN period_ends_at > {_NOW} THEN 'UNTIL_PERIOD_END' ELSE 'NONE' END AS access_state FROM subscriptions""")
def _(t):
    c = F.col
    return t("subscriptions").select("sub_id", C.trial_state(c("status"), c("trial_ends_at"), now()).alias("trial_state"), C.access_state(c("status"), c("period_ends_at"), now()).alias("access_state"))


@query("bil2_plan_terms", SUBS, f"""WITH {_LAST}, plans AS (SELECT * FROM (VALUES ('basic', 505, 3000, 1000), ('pro', 5000, 30000, 10000)) p(plan_handle, products, searches, vectors)),
own AS (SELECT shop, CAST(split_part(shop, '_c', 2) AS BIGINT) % 100 + 1000 AS searches FROM last WHERE plan_handle = 'custom')
SELECT l.shop, l.plan_handle, p.products, coalesce(o.searches, p.searches) AS searches, p.vectors, o.shop IS NOT NULL AS is_custom FROM last l LEFT JOIN plans p USING (plan_handle) LEFT JOIN own o ON o.shop = l.shop""")
def _(t):
    # Plan limits of the catalog: products, searches and vector updates a period.
    plans = t.spark.createDataFrame([("basic", 505, 3000, 1000), ("pro", 5000, 30000, 10000)], "plan_handle string, products int, searches int, vectors int")
    rows = last(t)
    own = rows.where("plan_handle = 'custom'").select("shop", (F.split_part("shop", F.lit("_c"), F.lit(2)).cast("long") % 100 + 1000).alias("own"))
    out = rows.join(F.broadcast(plans), "plan_handle", "left").join(own, "shop", "left")
    return out.select("shop", "plan_handle", "products", F.coalesce("own", F.col("searches").cast("long")).alias("searches"), "vectors", F.col("own").isNotNull().alias("is_custom"))


@query("bil3_reconciliation", SUBS, f"""WITH {_LAST}, l AS (SELECT shop, status AS a FROM last WHERE sub_id % 11 <> 0), r AS (SELECT shop, CASE WHEN sub_id % 5 = 0 THEN 'CANCELLED' WHEN sub_id % 13 = 0 THEN 'FROZEN' ELSE status END AS b FROM last WHERE sub_id % 7 <> 0)
SELECT shop, a AS local_status, b AS remote_status, CASE WHEN b IS NULL THEN CASE WHEN a = 'CANCELLED' THEN 'SETTLED' ELSE 'MISSING_REMOTE' END WHEN a IS NULL THEN 'MISSING_LOCAL' WHEN a = b THEN 'MATCH' WHEN b = 'CANCELLED' THEN 'REMOTE_TERMINAL' ELSE 'MISMATCH' END AS class
FROM l FULL JOIN r USING (shop)""")
def _(t):
    rows = last(t)
    remote = F.when(F.col("sub_id") % 5 == 0, "CANCELLED").when(F.col("sub_id") % 13 == 0, "FROZEN").otherwise(F.col("status"))
    return C.reconcile(rows.where("sub_id % 11 <> 0"), rows.where("sub_id % 7 <> 0").withColumn("status", remote))


@query("bil4_check_schedule", SUBS, f"""SELECT sub_id, CASE WHEN status <> 'FROZEN' OR {_NOW} - updated_at < INTERVAL 7 DAY THEN {_NOW} + to_minutes(CASE WHEN status = 'FROZEN' THEN 480 ELSE [5, 30, 120, 480][least(sub_id % 6 + 1, 4)] END) END AS next_check FROM subscriptions WHERE status <> 'CANCELLED' AND updated_at <= {_NOW}""")
def _(t):
    rows = t("subscriptions").where(F.col("status") != "CANCELLED").where(F.col("updated_at") <= now())
    return rows.select("sub_id", C.next_check(F.col("sub_id") % 6, F.col("status") == "FROZEN", F.col("updated_at"), now()).alias("next_check"))


@query("bil5_uninstall_cascade", SUBS, f"""WITH gone AS (SELECT DISTINCT shop FROM subscriptions WHERE CAST(split_part(shop, '_c', 2) AS BIGINT) % 9 = 0)
SELECT s.sub_id, s.shop, CASE WHEN g.shop IS NOT NULL AND status IN ('ACTIVE', 'FROZEN', 'PENDING') THEN 'CANCELLED' ELSE status END AS status, g.shop IS NOT NULL AND trial_ends_at > {_NOW} AS trial_forfeited FROM subscriptions s LEFT JOIN gone g ON g.shop = s.shop""")
def _(t):
    subs = t("subscriptions")
    gone = subs.select("shop").distinct().where(F.split_part("shop", F.lit("_c"), F.lit(2)).cast("long") % 9 == 0).withColumn("gone", F.lit(True))
    rows, g = subs.join(gone, "shop", "left"), F.coalesce("gone", F.lit(False))
    status = F.when(g & F.col("status").isin(*C.OPERATIONAL), "CANCELLED").otherwise(F.col("status"))
    return rows.select("sub_id", "shop", status.alias("status"), (g & (F.col("trial_ends_at") > now())).alias("trial_forfeited"))


@query("bil6_pending_price", SUBS, "SELECT sub_id, status = 'ACTIVE' AND plan_handle = 'custom' AND price_snapshot IS NOT NULL AND price_snapshot <> round(price_snapshot) AS pending FROM subscriptions")
def _(t):
    c = F.col
    priced = (c("status") == "ACTIVE") & (c("plan_handle") == "custom") & c("price_snapshot").isNotNull()
    return t("subscriptions").select("sub_id", (priced & F.coalesce(c("price_snapshot") != F.round("price_snapshot"), F.lit(False))).alias("pending"))


@query("bil7_grant_expiry", ("quota_grants",), """SELECT grant_id, CASE grant_id % 3 WHEN 0 THEN NULL WHEN 1 THEN starts_at + INTERVAL 30 DAY ELSE date_trunc('month', starts_at) + INTERVAL 1 MONTH END AS expires FROM quota_grants""")
def _(t):
    cycle = F.date_trunc("month", "starts_at").cast("timestamp_ntz") + F.expr("INTERVAL '1' MONTH")
    at = F.when(F.col("grant_id") % 3 == 1, F.col("starts_at") + F.expr("INTERVAL '30' DAY")).when(F.col("grant_id") % 3 == 2, cycle)
    return t("quota_grants").select("grant_id", at.alias("expires"))


_STEPS = """w AS (SELECT *, lag(status) OVER o AS s0, lag(price_snapshot) OVER o AS p0, lag(plan_handle) OVER o AS h0, lag(payment_status) OVER o AS y0, lag(trial_status) OVER o AS t0, lag(trial_ends_at) OVER o AS e0 FROM billing_rows WINDOW o AS (PARTITION BY shop ORDER BY updated_at, sub_id)),
n AS (SELECT *, s0 IS DISTINCT FROM status AS moved FROM w),
ev AS (SELECT shop, sub_id, updated_at, unnest(list_filter([
  CASE WHEN moved AND status = 'ACTIVE' AND s0 IS DISTINCT FROM 'FROZEN' THEN 'ACTIVATED' END, CASE WHEN moved AND status = 'ACTIVE' AND s0 = 'PENDING' THEN 'APPROVED' END, CASE WHEN moved AND status = 'ACTIVE' AND s0 = 'FROZEN' THEN 'UNFROZEN' END,
  CASE WHEN moved AND status = 'FROZEN' THEN 'FROZEN' END, CASE WHEN moved AND status = 'CANCELLED' AND s0 IS NOT NULL THEN 'CANCELLED' END,
  CASE WHEN payment_status = 'FAILED' AND y0 IS DISTINCT FROM 'FAILED' THEN 'PAYMENT_FAILED' END, CASE WHEN payment_status = 'RECOVERED' AND y0 IS DISTINCT FROM 'RECOVERED' THEN 'PAYMENT_RECOVERED' END,
  CASE WHEN h0 <> plan_handle AND price_snapshot > p0 THEN 'UPGRADED' END, CASE WHEN h0 <> plan_handle AND price_snapshot < p0 THEN 'DOWNGRADED' END,
  CASE WHEN trial_status = 'ACTIVE' AND t0 IS DISTINCT FROM 'ACTIVE' THEN 'TRIAL_STARTED' END, CASE WHEN trial_status = 'ACTIVE' AND t0 = 'ACTIVE' AND trial_ends_at > e0 THEN 'TRIAL_EXTENDED' END,
  CASE WHEN t0 = 'ACTIVE' AND trial_status IN ('CONVERTED', 'NONE') THEN 'TRIAL_ENDED' END, CASE WHEN t0 = 'ACTIVE' AND trial_status = 'CANCELLED' THEN 'TRIAL_CANCELLED' END], lambda x: x IS NOT NULL)) AS event FROM n)"""


@query("bil9_lifecycle_events", ("billing_rows",), f"WITH {_STEPS} SELECT *, sha256(concat(shop, '|', CAST(sub_id AS VARCHAR), '|', event)) AS event_key FROM ev")
def _(t):
    return C.lifecycle_events(t("billing_rows"))


@query("bil10_charges", SUBS, """SELECT shop, CAST(date_trunc('month', updated_at) AS DATE) AS period_start, arg_max(status, (updated_at, sub_id)) AS status, min(updated_at) AS first_at, max(updated_at) AS last_at FROM subscriptions GROUP BY 1, 2""")
def _(t):
    per = t("subscriptions").groupBy("shop", F.to_date(F.date_trunc("month", "updated_at")).alias("period_start"))
    return per.agg(F.max_by("status", F.struct("updated_at", "sub_id")).alias("status"), F.min("updated_at").alias("first_at"), F.max("updated_at").alias("last_at"))


@query("met1_usage_windows", ("billing_rows",), f"""WITH k AS (SELECT *, CASE WHEN trial_status = 'ACTIVE' AND trial_ends_at > {_THEN} AND trial_ends_at > trial_starts_at THEN 'TRIAL' WHEN trial_ends_at <= {_THEN} AND period_ends_at > trial_ends_at THEN 'AFTER_TRIAL'
  WHEN period_ends_at > period_starts_at AND (trial_ends_at IS NULL OR period_ends_at > trial_ends_at) THEN 'BILLING' WHEN trial_ends_at > trial_starts_at THEN 'EXPIRED_TRIAL' ELSE 'MONTH' END AS kind FROM billing_rows)
SELECT sub_id, kind, CASE kind WHEN 'TRIAL' THEN trial_starts_at WHEN 'AFTER_TRIAL' THEN trial_ends_at WHEN 'BILLING' THEN period_starts_at WHEN 'EXPIRED_TRIAL' THEN trial_starts_at ELSE TIMESTAMP '2000-03-01' END AS window_start,
  CASE kind WHEN 'TRIAL' THEN trial_ends_at WHEN 'AFTER_TRIAL' THEN period_ends_at WHEN 'BILLING' THEN period_ends_at WHEN 'EXPIRED_TRIAL' THEN trial_ends_at ELSE TIMESTAMP '2000-04-01' END AS window_end FROM k""")
def _(t):
    c = F.col
    span = C.usage_window(c("trial_status"), c("trial_starts_at"), c("trial_ends_at"), c("period_starts_at"), c("period_ends_at"), then())
    return t("billing_rows").select("sub_id", span.alias("w")).select("sub_id", "w.kind", c("w.start").alias("window_start"), c("w.end").alias("window_end"))


_SHOP_STATE = """CAST(split_part(shop, '_c', 2) AS BIGINT) AS n"""


@query("met5_entitlement", BILLING, f"""WITH {_CURRENT}, s AS (SELECT *, {_SHOP_STATE} FROM cur),
a AS (SELECT shop, n, status = 'ACTIVE' AND (coalesce(trial_status = 'ACTIVE' AND trial_ends_at > {_THEN}, false) OR coalesce(period_ends_at > {_THEN} AND (trial_ends_at IS NULL OR trial_ends_at <= {_THEN} AND period_ends_at > trial_ends_at), false))
  OR status = 'CANCELLED' AND coalesce(trial_status NOT IN ('ACTIVE', 'CANCELLED') AND period_ends_at > {_THEN}, false) AS entitled FROM s),
r AS (SELECT shop, n, entitled AND n % 13 <> 0 AND n % 17 <> 0 AS active, CASE WHEN NOT entitled THEN 'SUBSCRIPTION_INACTIVE' WHEN n % 13 = 0 THEN 'AI_SEARCH_DISABLED_BY_MERCHANT' WHEN n % 17 = 0 THEN 'PLAN_SEMANTIC_SEARCH_DISABLED' WHEN n % 11 < 1 THEN 'PRODUCT_LIMIT_RECONCILIATION_REQUIRED'
  WHEN n % 7 = 0 AND n % 3 = 0 THEN 'INITIAL_SYNC_IN_PROGRESS' WHEN n % 7 = 0 AND n % 3 = 1 THEN 'INITIAL_SYNC_FAILED' WHEN n % 10 - 2 <= 0 THEN 'SEARCH_QUOTA_EXCEEDED' END AS reason FROM a)
SELECT shop, reason, reason IS NULL AS search_allowed, active AND n % 8 <> 5 AS vector_allowed FROM r""")
def _(t):
    """Entitlements of the shops' current subscriptions; settings, slots and use are derived from the shop's number."""
    c, n = F.col, F.col("n")
    rows = current(t).withColumns({"n": F.split_part("shop", F.lit("_c"), F.lit(2)).cast("long"), "entitled": C.entitled(c("status"), c("trial_status"), c("trial_ends_at"), c("period_ends_at"), then())})
    sync = F.when(n % 3 == 0, "PROCESSING").when(n % 3 == 1, "FAILED").otherwise("READY")
    wanted, semantic = n % 13 != 0, n % 17 != 0
    reason = C.disabled_reason(c("entitled"), wanted, semantic, n % 11 - 1, n % 7, sync, n % 10 - 2)
    return rows.select("shop", reason.alias("reason"), reason.isNull().alias("search_allowed"), (c("entitled") & wanted & semantic & (n % 8 != 5)).alias("vector_allowed"))
