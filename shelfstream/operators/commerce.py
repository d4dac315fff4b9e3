"""Subscriptions, recurring revenue and billing state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import top

# States in which a subscription is under way.
OPERATIONAL = ("ACTIVE", "PENDING", "FROZEN")


def monthly(price: Column, interval: Column) -> Column:
    return F.when(interval == "ANNUAL", price / 12).otherwise(price)


def recurring_revenue(subs: DataFrame) -> DataFrame:
    """MRR and ARR of active priced subscriptions by currency, and by currency and plan (plan null: all)."""
    paid = subs.where("status = 'ACTIVE' AND price_snapshot IS NOT NULL AND currency IS NOT NULL AND interval_code IS NOT NULL")
    paid = paid.withColumn("mrr", monthly(F.col("price_snapshot"), F.col("interval_code")))
    sums = paid.groupingSets([["currency"], ["currency", "plan_handle"]], "currency", "plan_handle").agg(F.sum("mrr").alias("mrr"), F.count("*").alias("n"))
    return sums.select("currency", "plan_handle", F.round("mrr", 4).alias("mrr"), F.round(F.col("mrr") * 12, 4).alias("arr"), "n")


def state_counts(subs: DataFrame, now: Column) -> DataFrame:
    """Subscriptions by state, per plan and over all plans (plan null)."""
    c = F.col
    return subs.rollup("plan_handle").agg(
        F.count("*").alias("total"), F.count_if(c("status") == "ACTIVE").alias("active"), F.count_if((c("status") == "ACTIVE") & (c("trial_ends_at") > now)).alias("trial"),
        F.count_if(c("status") == "FROZEN").alias("frozen"), F.count_if(c("status") == "CANCELLED").alias("cancelled"),
    )


def current_subscription(subs: DataFrame, pointers: DataFrame, now: Column) -> DataFrame:
    """Each shop's subscription that counts, with its tier.

    0: the one that the shop's pointer (shop, sub_id) names, unless it is
    cancelled and its period over. A pointer to a row that is missing gives
    the shop none. Without a pointer, 1: the newest one paid for and not
    refunded, beyond its trial, whose period runs; 2: the newest pending one.
    """
    c = F.col
    named = pointers.where("sub_id IS NOT NULL").select("shop", c("sub_id").alias("pointer"))
    over = subs.where((c("status") == "CANCELLED") & (c("period_ends_at") <= now)).select("shop", c("sub_id").alias("pointer"))
    rows = subs.join(named.join(over, ["shop", "pointer"], "left_anti"), "shop", "left")
    paid = (
        (c("refund_status") != "FULL") & c("payment_status").isin("PAID", "RECOVERED") & ~c("trial_status").isin("ACTIVE", "CANCELLED") & (c("period_ends_at") > now)
        & c("status").isin("ACTIVE", "CANCELLED")
    )
    tier = F.when(c("pointer").isNotNull(), F.when(c("pointer") == c("sub_id"), 0)).when(paid, 1).when(c("status") == "PENDING", 2)
    return top(rows.withColumn("tier", tier).where("tier IS NOT NULL"), "shop", ["tier", F.desc("updated_at"), F.desc("sub_id")])


def usage_window(trial_status: Column, trial_start: Column, trial_end: Column, start: Column, end: Column, now: Column) -> Column:
    """struct(kind, start, end) against which use is metered.

    A running trial; the paid time behind a trial that is over; the billing
    period, unless it ends within the trial; the trial that was; the UTC month.
    """
    month = F.date_trunc("month", now).cast("timestamp_ntz")
    span = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"))
    real_trial = trial_end > trial_start
    return (
        F.when((trial_status == "ACTIVE") & real_trial & (trial_end > now), span("TRIAL", trial_start, trial_end))
        .when((trial_end <= now) & (end > trial_end), span("AFTER_TRIAL", trial_end, end))
        .when((end > start) & (trial_end.isNull() | (end > trial_end)), span("BILLING", start, end))
        .when(real_trial, span("EXPIRED_TRIAL", trial_start, trial_end))
        .otherwise(span("MONTH", month, month + F.expr("INTERVAL '1' MONTH")))
    )


def trial_state(status: Column, trial_end: Column, now: Column) -> Column:
    return F.when(trial_end.isNull(), "NONE").when(status == "CANCELLED", F.when(trial_end > now, "FORFEITED").otherwise("ENDED")).when(trial_end > now, "ACTIVE").otherwise("CONVERTED")


def access_state(status: Column, period_end: Column, now: Column) -> Column:
    return F.when(status == "ACTIVE", "FULL").when(status == "FROZEN", "SUSPENDED").when(period_end > now, "UNTIL_PERIOD_END").otherwise("NONE")


def entitled(status: Column, trial_status: Column, trial_end: Column, period_end: Column, now: Column) -> Column:
    """Whether a subscription gives access now: in its trial, in a paid period beyond it, or in the paid rest after a cancellation."""
    trial = (trial_status == "ACTIVE") & (trial_end > now)
    paid = (period_end > now) & (trial_end.isNull() | ((trial_end <= now) & (period_end > trial_end)))
    rest = ~trial_status.isin("ACTIVE", "CANCELLED") & (period_end > now)
    no = F.lit(False)
    return ((status == "ACTIVE") & (F.coalesce(trial, no) | F.coalesce(paid, no))) | ((status == "CANCELLED") & F.coalesce(rest, no))


def disabled_reason(entitled: Column, wanted: Column, semantic: Column, slots_left: Column, indexed: Column, sync_status: Column, searches_left: Column) -> Column:
    """Why search is off, the first that holds; null where it is on. Amounts left are null where there is no limit."""
    return (
        F.when(~entitled, "SUBSCRIPTION_INACTIVE")
        .when(~wanted, "AI_SEARCH_DISABLED_BY_MERCHANT")
        .when(~semantic, "PLAN_SEMANTIC_SEARCH_DISABLED")
        .when(slots_left < 0, "PRODUCT_LIMIT_RECONCILIATION_REQUIRED")
        .when((indexed == 0) & sync_status.isin("PENDING", "PROCESSING"), "INITIAL_SYNC_IN_PROGRESS")
        .when((indexed == 0) & (sync_status == "FAILED"), "INITIAL_SYNC_FAILED")
        .when(searches_left <= 0, "SEARCH_QUOTA_EXCEEDED")
    )


def lifecycle_events(subs: DataFrame) -> DataFrame:
    """Events between successive states of a shop's subscription, each with a key that names it once.

    subs: shop, sub_id, updated_at, status, plan_handle, price_snapshot,
    payment_status, trial_status, trial_ends_at.
    """
    w = W.partitionBy("shop").orderBy("updated_at", "sub_id")
    names = ("status", "price_snapshot", "plan_handle", "payment_status", "trial_status", "trial_ends_at")
    rows = subs.withColumns({f"old_{s}": F.lag(s).over(w) for s in names})
    rows = rows.withColumn("known", F.col("old_status").isNotNull())
    new, old = (lambda s: F.col(s)), (lambda s: F.col(f"old_{s}"))
    turned = lambda s, value: (new(s) == value) & ~F.coalesce(old(s) == value, F.lit(False))
    became = lambda value: turned("status", value)
    changed = new("plan_handle") != old("plan_handle")
    found = F.array_compact(
        F.array(
            F.when(became("ACTIVE") & F.coalesce(old("status") != "FROZEN", F.lit(True)), "ACTIVATED"),
            F.when(became("ACTIVE") & (old("status") == "PENDING"), "APPROVED"),
            F.when(became("ACTIVE") & (old("status") == "FROZEN"), "UNFROZEN"),
            F.when(became("FROZEN"), "FROZEN"),
            F.when(became("DECLINED"), "DECLINED"),
            F.when(became("EXPIRED"), "EXPIRED"),
            F.when(F.col("known") & became("CANCELLED"), "CANCELLED"),
            F.when(turned("payment_status", "FAILED"), "PAYMENT_FAILED"),
            F.when(turned("payment_status", "RECOVERED"), "PAYMENT_RECOVERED"),
            F.when(changed & (new("price_snapshot") > old("price_snapshot")), "UPGRADED"),
            F.when(changed & (new("price_snapshot") < old("price_snapshot")), "DOWNGRADED"),
            F.when(turned("trial_status", "ACTIVE"), "TRIAL_STARTED"),
            F.when((new("trial_status") == "ACTIVE") & (old("trial_status") == "ACTIVE") & (new("trial_ends_at") > old("trial_ends_at")), "TRIAL_EXTENDED"),
            F.when((old("trial_status") == "ACTIVE") & new("trial_status").isin("CONVERTED", "NONE"), "TRIAL_ENDED"),
            F.when((old("trial_status") == "ACTIVE") & (new("trial_status") == "CANCELLED"), "TRIAL_CANCELLED"),
        )
    )
    events = rows.select("shop", "sub_id", "updated_at", F.explode(found).alias("event"))
    return events.withColumn("event_key", F.sha2(F.concat_ws("|", "shop", F.col("sub_id").cast("string"), "event"), 256))


def reconcile(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Class of each subscription that either side knows: (shop, local_status, remote_status, class)."""
    both = local.select("shop", F.col("status").alias("local_status")).join(remote.select("shop", F.col("status").alias("remote_status")), "shop", "full")
    a, b = F.col("local_status"), F.col("remote_status")
    kind = (
        F.when(b.isNull(), F.when(a == "CANCELLED", "SETTLED").otherwise("MISSING_REMOTE"))
        .when(a.isNull(), "MISSING_LOCAL")
        .when(a == b, "MATCH")
        .when(b == "CANCELLED", "REMOTE_TERMINAL")
        .otherwise("MISMATCH")
    )
    return both.withColumn("class", kind)


def next_check(attempt: Column, frozen: Column, updated: Column, now: Column) -> Column:
    """When to look again: 5 minutes, 30 minutes, 2 hours, then 8 hours; a frozen one every 8 hours for 7 days, then not."""
    wait = F.element_at(F.array(*[F.lit(m) for m in (5, 30, 120, 480)]), F.least(attempt + 1, F.lit(4)).cast("int"))
    step = F.make_dt_interval(mins=F.when(frozen, 480).otherwise(wait))
    return F.when(~frozen | (now - updated < F.expr("INTERVAL '7' DAY")), now + step)
