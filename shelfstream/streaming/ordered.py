"""Stateful streams that fold the rows of a key in order of event time, whatever batches they come in."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Rows wait in state until the watermark has passed them; then they are folded, oldest first, ``seq`` breaking ties.

    A subclass names the ``columns`` it needs with their types and gives
    ``start(handle)``, ``on_row(key, at, row)``, ``next_deadline()`` and
    ``on_deadline(key, at)``. Times are microseconds. A deadline comes before
    a row of the same time, so that what is given out depends on event times
    alone, not on how rows are dealt to batches or when a stream restarts.
    """

    columns: dict[str, str] = {}

    def start(self, handle) -> None: ...

    def on_row(self, key: tuple, at: int, row: Row) -> Iterator[Row]: ...

    def next_deadline(self) -> int | None:
        return None

    def on_deadline(self, key: tuple, at: int) -> Iterator[Row]: ...

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, seq long", ", ".join(f"{k} {v}" for k, v in self.columns.items()))
        self.start(handle)

    def handleInputRows(self, key, rows, timerValues):
        times = set()
        for r in rows:
            self.waiting.updateValue((r["at_us"], r["seq"]), tuple(r[c] for c in self.columns))
            times.add(r["at_us"] // 1000 + 1)
        for t in times:
            self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        end = timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted(tuple(k) for k in self.waiting.keys() if k[0] < end)
        rows = [(k, self.waiting.getValue(k)) for k in due]
        for at, seq in due:
            self.waiting.removeKey((at, seq))
        i = 0
        while True:
            limit = self.next_deadline()
            if limit is not None and limit < end and (i == len(rows) or limit <= rows[i][0][0]):
                yield from self.on_deadline(key, limit)
            elif i < len(rows):
                (at, _), values = rows[i]
                yield from self.on_row(key, at, Row(*self.columns)(*values))
                i += 1
            else:
                break
        if limit is not None:
            self.handle.registerTimer(limit // 1000 + 1)

    def close(self) -> None: ...


def fold_in_order(rows: DataFrame, keys: list[str], time: str, seq: str, late: str, processor: InOrder, out: str) -> DataFrame:
    """The rows that ``processor`` gives for each key; rows later than the watermark's delay are dropped (see ``split_late``)."""
    spark = rows.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE:
        raise ValueError(f"timers need spark.sql.streaming.stateStore.providerClass = {STORE}")
    given = rows.withWatermark(time, late).withColumns({"at_us": F.unix_micros(time), "seq": F.col(seq).cast("long")})
    given = given.select(*keys, time, "at_us", "seq", *[F.col(c).cast(t).alias(c) for c, t in processor.columns.items() if c not in keys])
    return given.groupBy(*keys).transformWithState(processor, out, "Append", "EventTime")
