"""Catalog synchronisation as table differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def index_actions(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """What to do with each product of either side.

    incoming: shop, product_id, document_hash, source_hash, blocked (reason or
    null). registry: shop, product_id, old_document_hash, old_source_hash,
    has_vector. Only INDEX costs a vector update.
    """
    both = incoming.withColumn("here", F.lit(True)).join(registry.withColumn("known", F.lit(True)), ["shop", "product_id"], "full")
    c = F.col
    action = (
        F.when(c("here").isNull(), "REMOVE")
        .when(c("blocked").isNotNull(), "BLOCKED")
        .when(c("known").isNull() | ~c("has_vector"), "INDEX")
        .when(c("document_hash") != c("old_document_hash"), "INDEX")
        .when(c("source_hash") != c("old_source_hash"), "METADATA")
        .otherwise("SKIP")
    )
    return both.select("shop", "product_id", action.alias("action"), (action == "INDEX").alias("costs_vector"))


def stale_actions(registry: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Registry rows that a finished scan did not see: touch, unpublish or remove by what the live snapshot says."""
    live = snapshot.select("shop", "product_id", "published", F.lit(True).alias("live"))
    action = F.when(F.col("live").isNull(), "REMOVE").when(F.col("published"), "TOUCH").otherwise("UNPUBLISH")
    return registry.join(live, ["shop", "product_id"], "left").select("shop", "product_id", action.alias("action"))


def orphan_vectors(vectors: DataFrame, registry: DataFrame, now: Column, grace_hours: int) -> DataFrame:
    """Vectors without a registry row and older than the grace period; those without a product are MALFORMED."""
    bad = vectors.where("product_id IS NULL").select("vec_id", F.lit("MALFORMED").alias("class"))
    old = F.col("indexed_at") < now - F.make_dt_interval(hours=F.lit(grace_hours))
    lost = vectors.where("product_id IS NOT NULL").join(registry.select("shop", "product_id"), ["shop", "product_id"], "left_anti")
    return bad.unionByName(lost.where(old).select("vec_id", F.lit("ORPHAN").alias("class")))


def revalidate(ranked: DataFrame, snapshot: DataFrame, most: int) -> DataFrame:
    """Ranked results held against live products: missing ones go, changed titles are repaired, the first ``most`` stay."""
    live = snapshot.select("shop", "product_id", "title")
    rows = ranked.join(live, ["shop", "product_id"])
    rows = rows.withColumn("repaired", ~F.col("title").eqNullSafe(F.col("old_title")))
    rank = F.row_number().over(W.partitionBy("log_id").orderBy("rnk", "product_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The table with the rows merged in: of a key the largest version stays, the new row where versions tie."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    rest = [c for c in table.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(version, "_new"))
    return both.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def retry_at(attempts: Column, since: Column, first_seconds: int, most: int) -> Column:
    """Next try: doubling waits up to 5 minutes; null once the attempts are used up."""
    wait = F.least(F.lit(float(first_seconds)) * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))), F.lit(300.0))
    return F.when(attempts < most, since + F.make_dt_interval(secs=wait.cast("decimal(18,6)")))


def eligible_at(status: Column, created: Column, updated: Column, attempts: Column, first_seconds: int = 5, most: int = 5, lease_minutes: int = 2) -> Column:
    """When a job may be taken: pending at once, processing after its lease, failed after its wait; else never."""
    return (
        F.when(status == "PENDING", created)
        .when(status == "PROCESSING", updated + F.make_dt_interval(mins=F.lit(lease_minutes)))
        .when(status == "FAILED", retry_at(attempts, updated, first_seconds, most))
    )


def coalesce_jobs(jobs: DataFrame) -> DataFrame:
    """Bursts of updates of a product become one job: a waiting update absorbs later ones until work on it starts.

    Adds ``absorbed_by``: the waiting job (itself where it is new). A job that
    is past waiting begins a new burst.
    """
    w = W.partitionBy("shop", "product_id").orderBy("created_at", "job_id")
    starts = F.when((F.lag("status").over(w).isNull()) | (F.lag("status").over(w) != "PENDING") | (F.col("status") != "PENDING"), 1).otherwise(0)
    rows = jobs.withColumn("_burst", starts)
    rows = rows.withColumn("_no", F.sum("_burst").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.withColumn("absorbed_by", F.min("job_id").over(W.partitionBy("shop", "product_id", "_no"))).drop("_burst", "_no")


# Topics whose waiting job absorbs, and topics whose job absorbs as long as it is open, by policy version.
LIVE_TOPICS = ("PRODUCTS_CREATE", "PRODUCTS_UPDATE")
POLICY_TOPICS = ("REINDEX_PRODUCT", "REINDEX_PRODUCT_CAPACITY", "REINDEX_PRODUCT_SUBSCRIPTION")


def topic_class(topic: Column) -> Column:
    """LIVE, POLICY, or the topic itself: jobs absorb others of their class."""
    return F.when(topic.isin(*LIVE_TOPICS), "LIVE").when(topic.isin(*POLICY_TOPICS), "POLICY").otherwise(topic)


def coalesce_feed(feed: DataFrame, time: str) -> DataFrame:
    """The open job that each request of a feed goes into (shop, product_id, job_id, absorbed_by), itself where it is new.

    feed: feed_id, job_id, shop, product_id, topic, policy_version, event
    (REQUEST, START, END) and the time. Of live topics a waiting job absorbs
    until it starts, of others an open one until it ends, those of policy
    topics by version, which must be known here (the stream takes nulls too).
    """
    c = F.col
    rows = feed.withColumn("class", topic_class(c("topic"))).withColumn("version", F.when(c("class") == "POLICY", c("policy_version")).otherwise(-1))
    w = W.partitionBy("shop", "product_id", "class", "version").orderBy(time, "feed_id")
    closes = F.when(c("event") == F.when(c("class") == "LIVE", "START").otherwise("END"), 1).otherwise(0)
    rows = rows.withColumn("burst", F.sum(closes).over(w.rowsBetween(W.unboundedPreceding, 0))).where("event = 'REQUEST'")
    first = F.first("job_id").over(W.partitionBy("shop", "product_id", "class", "version", "burst").orderBy(time, "feed_id"))
    return rows.select("shop", "product_id", "job_id", first.alias("absorbed_by"))


def retained(rows: DataFrame, now: Column, days: dict[str, int], default: int) -> DataFrame:
    """Rows younger than their status allows."""
    keep = F.lit(default)
    for status, n in days.items():
        keep = F.when(F.col("status") == status, n).otherwise(keep)
    return rows.where(F.col("updated_at") >= now - F.make_dt_interval(days=keep))


def refresh_decision(has_job: Column, indexed: Column, forced: Column, old_plan: Column, plan: Column, old_limit: Column, new_limit: Column) -> Column:
    """INITIAL for a shop without a job and anything indexed; PLAN_RECONCILE where it is forced, an unlimited plan is new, or there is
    more room for products; else NONE. A null limit is no limit."""
    expands = new_limit.isNull() & has_job & (old_plan != plan)
    grown = old_limit.isNotNull() & (new_limit.isNull() | (new_limit > old_limit))
    return F.when(~has_job & (indexed == 0), "INITIAL").when(forced | expands | F.coalesce(grown, F.lit(False)), "PLAN_RECONCILE").otherwise("NONE")


def settled_jobs(jobs: DataFrame, now: Column, most: int = 5, lease_minutes: int = 2) -> DataFrame:
    """Jobs (job_id, status, attempts, created_at, updated_at) with the status they have now and when they may be taken.

    A job in work whose lease is over and whose attempts are used up has
    failed for good; one with attempts left may be taken again at once.
    """
    c = F.col
    over = (c("status") == "PROCESSING") & (c("updated_at") + F.make_dt_interval(mins=F.lit(lease_minutes)) <= now)
    dead = over & (c("attempts") >= most)
    status = F.when(dead, "FAILED").otherwise(c("status"))
    at = F.when(~dead & (c("attempts") < most), eligible_at(c("status"), c("created_at"), c("updated_at"), c("attempts"), 5, most, lease_minutes))
    return jobs.select("job_id", status.alias("status"), (dead | ((c("status") == "FAILED") & (c("attempts") >= most))).alias("exhausted"), at.alias("eligible_at"))


# Priority of the reasons of catalog scans, and that of any other.
REASON_PRIORITY = {"INITIAL": 10, "STOREFRONT_RECONCILE": 20, "SLOT_REFILL": 30, "PLAN_RECONCILE": 40, "RECONCILE": 50, "MANUAL_REFRESH": 60, "LANGUAGE_CHANGE": 100}
OTHER_PRIORITY = 50


def next_scans(jobs: DataFrame, now: Column, most: int = 4, lease_minutes: int = 5) -> DataFrame:
    """Each shop's catalog scan to run now: (shop, job_id, reason, waiting).

    jobs: job_id, shop, reason, status, attempts, created_at, updated_at. A
    shop with a scan in work whose lease runs has none. Waiting scans of a
    shop are one: the reason of highest priority, of equal ones the newest.
    """
    c = F.col
    priority = F.coalesce(F.create_map(*[F.lit(x) for kv in REASON_PRIORITY.items() for x in kv])[c("reason")], F.lit(OTHER_PRIORITY))
    busy = F.bool_or((c("status") == "PROCESSING") & (c("updated_at") + F.make_dt_interval(mins=F.lit(lease_minutes)) > now))
    at = eligible_at(c("status"), c("created_at"), c("updated_at"), c("attempts"), 10, most, lease_minutes)
    open_ = (c("attempts") < most) & (at <= now)
    best = F.max_by(F.when(open_, F.struct("job_id", "reason")), F.when(open_, F.struct(priority, "job_id")))
    per = jobs.groupBy("shop").agg(F.coalesce(busy, F.lit(False)).alias("busy"), best.alias("best"), F.count_if(open_).alias("waiting"))
    return per.where("NOT busy AND best IS NOT NULL").select("shop", "best.job_id", "best.reason", "waiting")
