"""Event feeds and stateful streams; each has a batch twin among the queries.

All streams take timestamps in UTC and bound their state by a watermark. Jobs
and receipts are in ``jobs``, tables that streams write in ``tables``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def feed(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, time: str = "ts", files_per_batch: int = 1) -> DataFrame:
    """Files of a folder as a stream in the declared schema, with the time as an instant."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def first_deliveries(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """STR1: the first event of each key within the watermark's delay; later ones are dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def daily_usage(events: DataFrame, late: str) -> DataFrame:
    """STR11: counts per UTC day, shop and type, given out once a day is over."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "shop", "type").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "shop", "type", "n")


def attributed_clicks(searches: DataFrame, clicks: DataFrame, late: str, lifetime: str = "2 HOURS") -> DataFrame:
    """STR8: clicks joined to searches of the same user within a receipt's lifetime: click_id, log_id."""
    s = searches.withWatermark("created_at", late).select(F.col("user_id").alias("s_user"), "log_id", "created_at")
    c = clicks.withWatermark("ts", late)
    on = (F.col("user_id") == F.col("s_user")) & (F.col("created_at") <= F.col("ts")) & (F.col("created_at") > F.col("ts") - F.expr(f"INTERVAL {lifetime}"))
    return c.join(s, on).select("click_id", "log_id")


def quota_gate(events: DataFrame, limit: int, late: str, keep: str = "40 days") -> DataFrame:
    """STR4: events (shop, event_id, ts) with whether their month's quota still had room, in order of time within each batch.

    A shop's rows of one batch are sorted in memory; ``files_per_batch`` of the feed bounds them.
    """

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        pdf = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
        place = used + pd.RangeIndex(1, len(pdf) + 1).to_numpy()
        used += len(pdf)
        yield pd.DataFrame({"shop": pdf["shop"], "event_id": pdf["event_id"], "accepted": place <= limit})
        state.update((used,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + int(pd.Timedelta(keep).total_seconds() * 1000))

    rows = events.withWatermark("ts", late).withColumn("period", F.date_format("ts", "yyyy-MM"))
    return rows.groupBy("shop", "period").applyInPandasWithState(step, "shop string, event_id long, accepted boolean", "used long", "append", GroupStateTimeout.EventTimeTimeout)


def late_events(events: DataFrame, late: str) -> DataFrame:
    """STR2: events (shop, event_id, ts) flagged where a newer one of their shop came before them.

    A shop's newest time is kept until the watermark passes it: what is older by then is late for the stream as a whole.
    """

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest = state.get[0] if state.exists else -(1 << 62)
        pdf = pd.concat(list(pdfs)).sort_values("event_id")
        at = pdf["ts"].astype("datetime64[us, UTC]" if pdf["ts"].dt.tz is not None else "datetime64[us]").astype("int64")
        before = at.cummax().shift(fill_value=newest).clip(lower=newest)
        state.update((int(max(newest, at.max())),))
        state.setTimeoutTimestamp(max(state.get[0] // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"shop": pdf["shop"], "event_id": pdf["event_id"], "late": at < before})

    rows = events.withWatermark("ts", late)
    return rows.groupBy("shop").applyInPandasWithState(step, "shop string, event_id long, late boolean", "newest long", "append", GroupStateTimeout.EventTimeTimeout)


def throttle(failures: DataFrame, limit: int, window_seconds: int, late: str) -> DataFrame:
    """STR9: failures (shop, event_id, ts) counted in windows that restart once over; blocked from the limit on.

    A shop's window is kept until the watermark has passed its end.
    """

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        started, n = state.get if state.exists else (None, 0)
        out = []
        pdf = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
        at = pdf["ts"].astype("datetime64[us, UTC]" if pdf["ts"].dt.tz is not None else "datetime64[us]").astype("int64")
        for t in at.tolist():
            if started is None or t - started > window_seconds * 1_000_000:
                started, n = t, 0
            n += 1
            out.append(n)
        state.update((started, n))
        state.setTimeoutTimestamp(max(started // 1000 + window_seconds * 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"shop": pdf["shop"], "event_id": pdf["event_id"], "n": out, "blocked": [k >= limit for k in out]})

    rows = failures.withWatermark("ts", late)
    return rows.groupBy("shop").applyInPandasWithState(step, "shop string, event_id long, n int, blocked boolean", "started long, n int", "append", GroupStateTimeout.EventTimeTimeout)


def reservations(changes: DataFrame, ttl: str, late: str) -> DataFrame:
    """STR5: (reservation_id, ts, event) with event HOLD or EFFECT; one outcome each: COMMITTED at its effect, else ROLLED_BACK after the ttl."""

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            if state.get[0] == "PENDING":
                yield pd.DataFrame({"reservation_id": [key[0]], "outcome": ["ROLLED_BACK"]})
            state.remove()
            return
        pdf = pd.concat(list(pdfs))
        status = state.get[0] if state.exists else "PENDING"
        if status == "PENDING" and (pdf["event"] == "EFFECT").any():
            status = "COMMITTED"
            yield pd.DataFrame({"reservation_id": [key[0]], "outcome": [status]})
        state.update((status,))
        end = int(pdf["ts"].max().timestamp() * 1000) + int(pd.Timedelta(ttl).total_seconds() * 1000)
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    rows = changes.withWatermark("ts", late)
    return rows.groupBy("reservation_id").applyInPandasWithState(step, "reservation_id long, outcome string", "status string", "append", GroupStateTimeout.EventTimeTimeout)
