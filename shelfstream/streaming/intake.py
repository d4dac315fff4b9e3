"""Feeds of events as they arrive: payloads read by declared schemas, and a way out for those that are not valid.

The same functions take a table or a stream.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Feed:
    """A kind of event: its topics, the schema of its payload, the fields that must be there (SQL over ``body``, by name) and known statuses."""

    name: str
    topics: tuple[str, ...]
    schema: str
    fields: dict[str, str]
    required: tuple[str, ...]
    statuses: tuple[str, ...] = ()


# Topics, field names of payloads and statuses of subscriptions.
FEEDS = (
    Feed("PRODUCT", ("PRODUCTS_CREATE", "PRODUCTS_UPDATE", "PRODUCTS_DELETE"), "id long, admin_graphql_api_id string, title string", {"key": "coalesce(nullif(trim(body.admin_graphql_api_id), ''), CAST(body.id AS STRING))", "detail": "body.title"}, ("key",)),
    Feed(
        "SUBSCRIPTION", ("APP_SUBSCRIPTIONS_UPDATE",), "app_subscription struct<admin_graphql_api_id:string,status:string,plan_handle:string,name:string>",
        {"key": "nullif(trim(body.app_subscription.admin_graphql_api_id), '')", "status": "body.app_subscription.status", "detail": "body.app_subscription.plan_handle"}, ("key", "status"),
        ("ACTIVE", "CANCELLED", "DECLINED", "EXPIRED", "FROZEN", "PENDING"),
    ),
    Feed("UNINSTALL", ("APP_UNINSTALLED",), "domain string", {"key": "shop", "detail": "body.domain"}, ("key",)),
    Feed("CLICK", ("CLICK",), "searchLogId string, productId string", {"key": "nullif(trim(body.searchLogId), '')", "detail": "nullif(trim(body.productId), '')"}, ("key", "detail")),
)


def _reject(feed: Feed) -> Column:
    missing = F.when(F.col("body").isNull() | F.col("body._corrupt").isNotNull(), "MALFORMED")
    for name in feed.required:
        missing = F.coalesce(missing, F.when(F.col(name).isNull(), f"MISSING:{name}"))
    return F.coalesce(missing, F.when(~F.col("status").isin(*feed.statuses), "UNKNOWN_STATUS")) if feed.statuses else missing


def read_feed(events: DataFrame, feed: Feed) -> DataFrame:
    """The feed's events: event_id, shop, topic, feed, key, status, detail, ``reject`` (why it is not valid, or null) and payload.

    events: event_id, shop, topic, payload (JSON text). A payload that is no
    JSON object, lacks a field, or has an unknown status is a reject; others
    keep what they have, fields that are not declared are left out.
    """
    rows = events.where(F.col("topic").isin(*feed.topics))
    rows = rows.withColumn("body", F.from_json("payload", f"{feed.schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    rows = rows.withColumns({c: F.expr(feed.fields[c]) if c in feed.fields else F.lit(None).cast("string") for c in ("key", "status", "detail")})
    return rows.select("event_id", "shop", "topic", F.lit(feed.name).alias("feed"), "key", "status", "detail", _reject(feed).alias("reject"), "payload")


def read_feeds(events: DataFrame, feeds: tuple[Feed, ...] = FEEDS) -> DataFrame:
    """All feeds' events; a topic that no feed has is a reject of its own."""
    out = None
    for feed in feeds:
        rows = read_feed(events, feed)
        out = rows if out is None else out.unionByName(rows)
    known = [t for f in feeds for t in f.topics]
    none = F.lit(None).cast("string")
    other = events.where(~F.coalesce(F.col("topic").isin(*known), F.lit(False)))
    return out.unionByName(other.select("event_id", "shop", "topic", none.alias("feed"), none.alias("key"), none.alias("status"), none.alias("detail"), F.lit("UNKNOWN_TOPIC").alias("reject"), "payload"))


def feed_sink(path: str, feeds: tuple[Feed, ...] = FEEDS) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: valid events to ``path/<feed>``, rejects with their payload to ``path/rejects``, by batch, each batch once."""

    def write(batch: DataFrame, number: int) -> None:
        rows = read_feeds(batch, feeds).persist()
        try:
            for feed in feeds:
                rows.where((F.col("feed") == feed.name) & F.col("reject").isNull()).drop("feed", "reject", "payload").write.mode("overwrite").parquet(f"{path}/{feed.name.lower()}/batch={number}")
            rows.where("reject IS NOT NULL").select("event_id", "shop", "topic", "reject", "payload").write.mode("overwrite").parquet(f"{path}/rejects/batch={number}")
        finally:
            rows.unpersist()

    return write
