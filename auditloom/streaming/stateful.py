"""Stateful processors with timers. They need the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`)."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from auditloom.streaming.limits import WINDOW_MS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RateLimiter(StatefulProcessor):
    """A key's state is its open window: how many requests it has had and when it ends. When the watermark passes the end, a timer
    removes it; a request after that opens a new window in any case, so nothing depends on when the timer fires."""

    def __init__(self, most: int, window_ms: int = WINDOW_MS):
        self.most, self.window_ms = most, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "count bigint, ends bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        count, ends = self.window.get() if self.window.exists() else (0, None)
        before = ends
        arrived = sorted((int(ms), ident) for pdf in rows for ms, ident in zip(pdf["ms"].tolist(), pdf["ident"].tolist(), strict=True))
        out = []
        for ms, ident in arrived:
            if ends is None or ms > ends:
                count, ends = 0, ms + self.window_ms
            count += 1
            out.append((key[0], ident, count, count <= self.most))
        if ends != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(ends)
        self.window.update((count, ends))
        yield pd.DataFrame(out, columns=["key", "ident", "count", "allowed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.window.exists() and self.window.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limit_stream(events: DataFrame, most: int, key: str, when: str, ident: str, window_ms: int = WINDOW_MS, late: str = "1 minute") -> DataFrame:
    """limits.rate_limit over a stream: (key, ident, count, allowed). Requests of a micro-batch count in the order of time, then ident;
    batches count as they come, so the result is that of the batch form where they come in that order. Requests without a time, and those
    that come later than `late`, are left out. A restarted stream goes on with the windows of its checkpoint."""
    rows = events.where(F.col(when).isNotNull()).withWatermark(when, late)
    rows = rows.select(F.col(key).alias("key"), F.col(ident).alias("ident"), F.unix_millis(when).alias("ms"), F.col(when).alias("at"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy("key").transformWithStateInPandas(RateLimiter(most, window_ms), f"key {kinds['key']}, ident {kinds['ident']}, count bigint, allowed boolean", "Append", "EventTime")


class Reminder(StatefulProcessor):
    """An order's state: what it waits for, since when, and whether it was reminded. Its timer is set while it waits and deleted when
    its address comes; a second one forgets the order."""

    def __init__(self, minutes: int, days: int):
        self.wait_ms, self.keep_ms = minutes * 60_000, days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.order = handle.getValueState("order", "waits boolean, since bigint, reminded boolean")

    def _due(self, since: int) -> int:
        return since + self.wait_ms + 1  # over so many minutes, as the batch form has it

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.order.exists()
        waits, since, reminded = self.order.get() if known else (False, None, False)
        changes = sorted((int(ms), str(status), bool(done)) for pdf in rows for ms, status, done in zip(pdf["ms"].tolist(), pdf["status"].tolist(), pdf["reminded"].tolist(), strict=True))
        waited = waits and not reminded
        for ms, status, done in changes:
            since = ms if since is None else since
            waits, reminded = status == "needs_url", reminded or done
        if waited:
            self.handle.deleteTimer(self._due(since))
        if not known:
            self.handle.registerTimer(since + self.keep_ms)
        if waits and not reminded:
            self.handle.registerTimer(self._due(since))
        self.order.update((waits, since, reminded))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.order.exists():
            return
        waits, since, reminded = self.order.get()
        if expiredTimerInfo.getExpiryTimeInMs() == since + self.keep_ms:
            self.order.clear()
        elif waits and not reminded:
            self.order.update((waits, since, True))
            yield pd.DataFrame([(key[0], since, expiredTimerInfo.getExpiryTimeInMs())], columns=["id", "since_ms", "due_ms"])

    def close(self) -> None:
        pass


def reminders_stream(orders: DataFrame, minutes: int = 10, days: int = 30, late: str = "1 minute") -> DataFrame:
    """(id, since_ms, due_ms): one reminder for each order that still waits for its site's address over `minutes` after it came, when the
    watermark says so. orders: (id, status, reminded, at), a row for the order and for each later change. An order is forgotten, and its
    state with it, after `days`."""
    rows = orders.where(F.col("id").isNotNull() & F.col("at").isNotNull()).withWatermark("at", late)
    rows = rows.select("id", F.coalesce("status", F.lit("")).alias("status"), F.coalesce("reminded", F.lit(False)).alias("reminded"), F.unix_millis("at").alias("ms"), "at")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.groupBy("id").transformWithStateInPandas(Reminder(minutes, days), f"id {kind}, since_ms bigint, due_ms bigint", "Append", "EventTime")


class FirstOnly(StatefulProcessor):
    """Lets an identity's first row through and forgets the identity after a while of the machine's time."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = not self.seen.exists()
        for pdf in rows:
            if fresh and len(pdf):
                fresh = False
                self.seen.update((True,))
                yield pdf.iloc[:1]

    def close(self) -> None:
        pass


def first_only(events: DataFrame, ident: str, ttl_ms: int = 86_400_000) -> DataFrame:
    """The events of a stream without those whose identity has come within ttl_ms, in any batch."""
    return events.groupBy(ident).transformWithStateInPandas(FirstOnly(ttl_ms), events.schema, "Append", "ProcessingTime")
