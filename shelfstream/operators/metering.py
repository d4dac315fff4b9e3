"""Usage metering: costs, rollups, quotas, eligibility."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import small
from .ranking import places

UNSCOPED = "__UNSCOPED__"
# Fixed value: the largest finite limit.
LIMIT_CAP = 1_000_000_000


def cost_micros(operation: Column, input_tokens: Column, cached: Column, output_tokens: Column, rates: dict[str, float]) -> Column:
    """Estimated cost in 1e-6 USD; embeddings pay for input only, cached input at its own rate. Rates are per million tokens."""
    embedding = operation.isin("EMBEDDING", "QUERY_EMBEDDING", "PRODUCT_EMBEDDING")
    fresh = F.greatest(input_tokens - cached, F.lit(0))
    llm = fresh * rates["input"] + cached * rates["cached"] + output_tokens * rates["output"]
    return F.floor(F.when(embedding, input_tokens * rates["embedding"]).otherwise(llm) + 0.5).cast("long")


def daily_usage(events: DataFrame) -> DataFrame:
    """A row per UTC day, shop (null: unscoped), provider, operation, model."""
    return events.groupBy(F.to_date("created_at").alias("day"), F.coalesce("shop", F.lit(UNSCOPED)).alias("shop"), "provider", "operation", "model").agg(
        F.count("*").alias("events"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_micros").alias("cost_micros")
    )


def merge_daily(old: DataFrame, new: DataFrame) -> DataFrame:
    """Adds rollups of the same keys."""
    keys = ["day", "shop", "provider", "operation", "model"]
    return old.unionByName(new).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in old.columns if c not in keys))


def raw_and_daily(events: DataFrame, cutoff: Column) -> DataFrame:
    """Raw rows from the cutoff day on, and days before it compacted: never both for one day."""
    day = F.to_date("created_at")
    cols = ["day", "shop", "provider", "operation", "model", "events", "input_tokens", "output_tokens", "cost_micros"]
    raw = events.where(day >= cutoff).select(day.alias("day"), F.coalesce("shop", F.lit(UNSCOPED)).alias("shop"), "provider", "operation", "model", F.lit(1).cast("long").alias("events"), "input_tokens", "output_tokens", "cost_micros")
    return raw.select(cols).unionByName(daily_usage(events.where(day < cutoff)).select(cols))


def eligibility(products: DataFrame, limits: DataFrame) -> DataFrame:
    """Which products of each shop are searchable under its product limit.

    products: shop, product_id, searchable, has_vector, vector_status,
    blocked_reason, status, created_at. limits: shop, active, product_limit
    (null: none). Published products are ordered by searchable, ready, age and
    id; the first ones up to the limit are chosen.
    """
    rows = products.join(small(limits), "shop", "left").withColumn("active", F.coalesce("active", F.lit(False)))
    unpublished = F.coalesce(F.col("blocked_reason") == "UNPUBLISHED", F.lit(False))
    order = [unpublished, F.desc("searchable"), F.desc(F.col("vector_status") == "READY"), "created_at", "product_id"]
    rows = places(rows, "shop", order, "_n")
    room = F.when(~F.col("active"), F.lit(0)).otherwise(F.greatest(F.coalesce("product_limit", F.lit(LIMIT_CAP)), F.lit(0)))
    chosen = ~unpublished & (F.col("_n") <= room)
    limit_ids, sub_ids = ("PRODUCT_LIMIT_BLOCKED", "PRODUCT_LIMIT_RECOVERY_PENDING"), ("SUBSCRIPTION_BLOCKED", "SUBSCRIPTION_RECOVERY_PENDING")
    reason, status = F.coalesce("blocked_reason", F.lit("")), F.coalesce("status", F.lit(""))
    on = F.when(F.col("active"), "PRODUCT_LIMIT").otherwise("SUBSCRIPTION")
    state = (
        F.when(unpublished, "UNPUBLISHED")
        .when(chosen & F.col("has_vector"), "INDEXED")
        .when(chosen & ((reason == "PRODUCT_LIMIT") | status.isin(*limit_ids)), limit_ids[1])
        .when(chosen & ((reason == "SUBSCRIPTION") | status.isin(*sub_ids)), sub_ids[1])
        .when(chosen, "VECTOR_QUOTA_BLOCKED")
        .otherwise(F.concat(on, F.lit("_BLOCKED")))
    )
    return rows.select(
        "shop", "product_id", chosen.alias("chosen"), (chosen & F.col("has_vector")).alias("now_searchable"),
        F.when(unpublished, "UNPUBLISHED").when(~chosen, on).alias("now_blocked"), state.alias("now_status"),
        (chosen & (~F.col("has_vector") | (F.col("vector_status") != "READY"))).alias("requires_reindex"), F.col("searchable").alias("was_searchable"),
    )


def effective_limit(plan: Column, override: Column, granted: Column, active: Column) -> Column:
    """Plan limit, or the shop's own where it is 0 or more, plus grants; null is unlimited, an inactive shop has 0."""
    base = F.when(override >= 0, override).otherwise(plan)
    return F.when(~active, F.lit(0)).when(base.isNotNull(), F.least(base + F.coalesce(granted, F.lit(0)), F.lit(LIMIT_CAP)))


def active_grants(grants: DataFrame, now: Column) -> DataFrame:
    """Granted amounts per shop and kind that hold at ``now``: one column a kind."""
    valid = (F.col("starts_at") <= now) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)) & (F.col("revoked_at").isNull() | (F.col("revoked_at") > now))
    kinds = {"SEARCH": "search", "PRODUCT": "product", "VECTOR_UPDATE": "vector_update"}
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("amount"))), F.lit(0)).alias(f"granted_{v}") for k, v in kinds.items()]
    return grants.where(valid).groupBy("shop").agg(*sums)


def quota_view(used: Column, limit: Column) -> list[Column]:
    """Remaining amount and percentage used, null where unlimited."""
    return [F.greatest(limit - used, F.lit(0)).alias("remaining"), F.when(limit > 0, F.least(F.floor(used / limit * 100 + 0.5), F.lit(100))).alias("percent")]


def reservation_outcomes(rows: DataFrame, now: Column, ttl_minutes: int = 30) -> DataFrame:
    """Stale pending reservations: committed where their effect is seen, else rolled back; younger ones stay pending."""
    stale = F.col("updated_at") <= now - F.make_dt_interval(mins=F.lit(ttl_minutes))
    return rows.withColumn("outcome", F.when(~stale, "PENDING").when(F.col("effect_applied"), "COMMITTED").otherwise("ROLLED_BACK"))


def throttled(failures: DataFrame, window_seconds: int, limit: int) -> DataFrame:
    """Failures (shop, event_id, created_at) counted in windows that one restarts once the last window is over: (shop, event_id, n, blocked).

    A shop's rows stream past in order of time; only the window's start and
    count are carried, so a task needs no more room for a large shop.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shop, started, n = None, 0, 0
        for batch in batches:
            counts = []
            for name, at in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.int64()).to_pylist()):
                if name != shop or at - started > window_seconds * 1_000_000:
                    shop, started, n = name, at, 0
                n += 1
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int32()), pa.array([k >= limit for k in counts], pa.bool_())], ["shop", "event_id", "n", "blocked"])

    dealt = failures.select("shop", "event_id", "created_at").repartition("shop").sortWithinPartitions("shop", "created_at", "event_id")
    return dealt.mapInArrow(run, "shop string, event_id long, n int, blocked boolean")
