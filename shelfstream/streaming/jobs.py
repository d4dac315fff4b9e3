"""Job streams: bursts that coalesce, retries with leases, one catalog scan a shop, receipts that expire.

Each folds in order of event time, so a stream that is stopped and started
again gives the rows of one that was not; the batch twins are among the
queries of ``plans.sync``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators.sync import OTHER_PRIORITY, REASON_PRIORITY, topic_class
from .ordered import InOrder, fold_in_order

SECOND = 1_000_000
def wait_us(attempts: int, first_seconds: int, most_seconds: int = 300) -> int:
    """Doubling waits of retries."""
    return int(min(first_seconds * 2 ** max(attempts - 1, 0), most_seconds) * SECOND)


class Bursts(InOrder):
    """Of one shop, product and class of topics: the open job that a request goes into.

    LIVE: a waiting job absorbs; once started it does not. POLICY: an open
    job of the same policy version absorbs until it ends; a request without a
    version goes into any open one, the smallest id first. Other topics: an
    open job absorbs until it ends.
    """

    columns = {"job_id": "long", "event": "string", "policy_version": "long"}

    def start(self, handle) -> None:
        self.open = handle.getMapState("open", "version long", "job_id long")

    def on_row(self, key: tuple, at: int, row: Row) -> Iterator[Row]:
        version = -1 if key[2] != "POLICY" or row.policy_version is None else row.policy_version
        if row.event != "REQUEST":
            if (key[2] == "LIVE") == (row.event == "START"):  # what ends a job's absorbing
                if self.open.containsKey((version,)):
                    self.open.removeKey((version,))
            return
        if key[2] == "POLICY" and row.policy_version is None:
            held = min((v[0] for v in self.open.values()), default=None)
        else:
            found = self.open.getValue((version,))
            held = found[0] if found else None
        if held is None:
            self.open.updateValue((version,), (row.job_id,))
        yield Row(shop=key[0], product_id=key[1], job_id=row.job_id, absorbed_by=row.job_id if held is None else held)


def bursts(feed: DataFrame, time: str, late: str) -> DataFrame:
    """STR3: the job that each request of the feed goes into, itself where it is new: shop, product_id, job_id, absorbed_by.

    feed: feed_id, job_id, shop, product_id, topic, policy_version, event
    (REQUEST, START, END) and the time.
    """
    rows = feed.withColumn("class", topic_class(F.col("topic")))
    return fold_in_order(rows, ["shop", "product_id", "class"], time, "feed_id", late, Bursts(), "shop string, product_id long, job_id long, absorbed_by long")


class Retries(InOrder):
    """Of one job: its state, with timers for the end of its lease and of its wait."""

    columns = {"status": "string", "attempts": "long", "created_us": "long"}

    def __init__(self, first_seconds: int, most: int, lease_seconds: int, keep_seconds: int):
        self.first, self.most, self.lease, self.keep = first_seconds, most, lease_seconds * SECOND, keep_seconds * SECOND

    def start(self, handle) -> None:
        self.job = handle.getValueState("job", "status string, attempts long, created long, updated long, told boolean")

    def _eligible(self, status: str, attempts: int, created: int, updated: int) -> int | None:
        if attempts >= self.most:
            return None
        ends = {"PENDING": created, "PROCESSING": updated + self.lease, "FAILED": updated + wait_us(attempts, self.first)}
        return ends.get(status)

    def _row(self, key: tuple, at: int, cause: str, status: str, attempts: int, created: int, updated: int) -> Row:
        dead = status == "FAILED" and attempts >= self.most
        return Row(job_id=key[0], at_us=at, cause=cause, status=status, exhausted=dead, eligible_us=self._eligible(status, attempts, created, updated))

    def on_row(self, key: tuple, at: int, row: Row) -> Iterator[Row]:
        self.job.update((row.status, row.attempts, row.created_us, at, False))
        yield self._row(key, at, "CHANGED", row.status, row.attempts, row.created_us, at)

    def next_deadline(self) -> int | None:
        if not self.job.exists():
            return None
        status, attempts, _, updated, told = self.job.get()
        if not told and status == "PROCESSING":
            return updated + self.lease
        if not told and status == "FAILED" and attempts < self.most:
            return updated + wait_us(attempts, self.first)
        return updated + self.keep if status != "PENDING" else None

    def on_deadline(self, key: tuple, at: int) -> Iterator[Row]:
        status, attempts, created, updated, told = self.job.get()
        if at == updated + self.keep and (told or status == "DONE" or status == "FAILED" and attempts >= self.most):
            self.job.clear()  # nothing can happen to it any more
        elif status == "PROCESSING" and attempts >= self.most:
            self.job.update(("FAILED", attempts, created, updated, True))
            yield self._row(key, at, "EXHAUSTED", "FAILED", attempts, created, updated)
        else:
            self.job.update((status, attempts, created, updated, True))
            yield self._row(key, at, "DUE", status, attempts, created, updated)


def job_retries(changes: DataFrame, late: str, first_seconds: int = 5, most: int = 5, lease_seconds: int = 120, keep_seconds: int = 86_400) -> DataFrame:
    """STR6: what becomes of each job: job_id, at, cause, status, exhausted, eligible_at, in order of time for each job.

    changes: job_id, status, attempts, created_at, updated_at, each row a new
    state from its updated_at on. CHANGED rows follow these; a timer gives
    DUE when a failed job's wait or a lease is over and another attempt is
    left, and EXHAUSTED, with status FAILED, when the lease of the last
    attempt is over. State is kept ``keep_seconds`` after the last change.
    """
    rows = changes.withColumns({"created_us": F.unix_micros(F.col("created_at").cast("timestamp")), "change_seq": F.col("attempts").cast("long")})
    schema = "job_id long, at_us long, cause string, status string, exhausted boolean, eligible_us long"
    out = fold_in_order(rows, ["job_id"], "updated_at", "change_seq", late, Retries(first_seconds, most, lease_seconds, keep_seconds), schema)
    return out.select("job_id", F.timestamp_micros("at_us").alias("at"), "cause", "status", "exhausted", F.timestamp_micros("eligible_us").alias("eligible_at"))


class Scans(InOrder):
    """Of one shop: its open scans, and which one is to run."""

    columns = {"job_id": "long", "reason": "string", "status": "string", "attempts": "long", "created_us": "long"}

    def __init__(self, first_seconds: int, most: int, lease_seconds: int):
        self.first, self.most, self.lease = first_seconds, most, lease_seconds * SECOND

    def start(self, handle) -> None:
        self.jobs = handle.getMapState("jobs", "job_id long", "reason string, status string, attempts long, created long, updated long")
        self.last = handle.getValueState("last", "clock long, n long, job_id long, waiting long, busy boolean")

    def _turn(self, job: tuple) -> int:
        """When the job's standing changes by time alone."""
        _, status, attempts, created, updated = job
        return {"PROCESSING": updated + self.lease, "FAILED": updated + wait_us(attempts, self.first)}.get(status, created)

    def _decided(self, key: tuple, at: int) -> Iterator[Row]:
        busy, best, waiting = False, None, 0
        for (job_id,), job in self.jobs.iterator():
            reason, status, attempts, _, _ = job
            over = self._turn(job) <= at
            busy |= status == "PROCESSING" and not over
            if attempts < self.most and over:
                waiting += 1
                best = max(best, (REASON_PRIORITY.get(reason, OTHER_PRIORITY), job_id, reason)) if best else (REASON_PRIORITY.get(reason, OTHER_PRIORITY), job_id, reason)
        chosen = best[1] if best and not busy else None
        _, n, *before = self.last.get() if self.last.exists() else (0, 0, None, 0, False)
        changed = before != [chosen, waiting, busy]
        self.last.update((at, n + changed, chosen, waiting, busy))
        if changed:
            yield Row(shop=key[0], n=n + 1, at_us=at, job_id=chosen, reason=best[2] if chosen is not None else None, waiting=waiting, busy=busy)

    def on_row(self, key: tuple, at: int, row: Row) -> Iterator[Row]:
        if row.status == "DONE":
            if self.jobs.containsKey((row.job_id,)):
                self.jobs.removeKey((row.job_id,))
        else:
            self.jobs.updateValue((row.job_id,), (row.reason, row.status, row.attempts, row.created_us, at))
        yield from self._decided(key, at)

    def next_deadline(self) -> int | None:
        clock = self.last.get()[0] if self.last.exists() else 0
        return min((t for v in self.jobs.values() if (t := self._turn(v)) > clock), default=None)

    def on_deadline(self, key: tuple, at: int) -> Iterator[Row]:
        yield from self._decided(key, at)
        done = [k for k, v in self.jobs.iterator() if v[2] >= self.most and self._turn(v) <= at]
        for k in done:
            self.jobs.removeKey(k)  # no attempt left, no lease


def catalog_scans(changes: DataFrame, late: str, first_seconds: int = 10, most: int = 4, lease_seconds: int = 300) -> DataFrame:
    """STR7: each change of a shop's scan to run: shop, n (its place), at, job_id, reason, waiting, busy.

    changes: change_id, job_id, shop, reason, status, attempts, created_at,
    updated_at. While a scan's lease runs the shop is busy and none is to
    run; else waiting scans, those whose wait is over and those whose lease
    is over are one: the reason of highest priority, of equal ones the newest.
    """
    rows = changes.withColumn("created_us", F.unix_micros(F.col("created_at").cast("timestamp")))
    schema = "shop string, n long, at_us long, job_id long, reason string, waiting long, busy boolean"
    out = fold_in_order(rows, ["shop"], "updated_at", "change_id", late, Scans(first_seconds, most, lease_seconds), schema)
    return out.select("shop", "n", F.timestamp_micros("at_us").alias("at"), "job_id", "reason", "waiting", "busy")


class Receipts(InOrder):
    """Of one log: whether its receipt still holds when it is asked for."""

    columns = {"event": "string", "ask_id": "long"}

    def __init__(self, lifetime_seconds: int):
        self.lifetime = lifetime_seconds * SECOND

    def start(self, handle) -> None:
        self.until = handle.getValueState("until", "until long")

    def on_row(self, key: tuple, at: int, row: Row) -> Iterator[Row]:
        if row.event == "RECEIPT":
            self.until.update((at + self.lifetime,))
        else:
            yield Row(log_id=key[0], ask_id=row.ask_id, at_us=at, outcome="HIT" if self.until.exists() else "MISS")

    def next_deadline(self) -> int | None:
        return self.until.get()[0] if self.until.exists() else None

    def on_deadline(self, key: tuple, at: int) -> Iterator[Row]:
        self.until.clear()
        yield Row(log_id=key[0], ask_id=None, at_us=at, outcome="EXPIRED")


def receipts(events: DataFrame, time: str, late: str, lifetime_seconds: int = 7200) -> DataFrame:
    """STR10: asks for receipts (HIT or MISS) and their expiry: log_id, ask_id, at, outcome.

    events: log_id, event (RECEIPT or ASK), ask_id and the time. A receipt's
    state ends with its lifetime; a new one of the same log starts it anew.
    """
    rows = events.withColumn("ask_seq", F.coalesce("ask_id", F.lit(-1)))
    out = fold_in_order(rows, ["log_id"], time, "ask_seq", late, Receipts(lifetime_seconds), "log_id long, ask_id long, at_us long, outcome string")
    return out.select("log_id", "ask_id", F.timestamp_micros("at_us").alias("at"), "outcome")
