"""Stateful streams with timers: rate limits and sign-in sessions whose state ends with its time (ST4, ST5).

Rows of a key wait until the watermark has passed them and are then taken in order of time, so that results don't depend on how
rows fall into batches, and equal those of the batch operators. A timer stands at the next moment at which a key has something
to do: a row that becomes due, or the end of its state. A key without open rows and without live state holds nothing.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

MICROS = 1_000_000


def with_rocksdb(spark: SparkSession) -> None:
    """Stateful processors keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Holds rows (at in microseconds, sequence, payload) back until they are due, and hands them to take() in order.

    Subclasses have begin(), which reads the key's own state, take(rows), which yields output rows, and finish(now), which writes the
    state and returns the microsecond at which it is to be looked at again (None: there is none).
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} {t}" for c, t in self.fields))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in r) for b in rows for r in b[[c for c, _ in self.fields]].itertuples(index=False)]
        if new:
            self.waiting.appendList(new)
            self.plan(min(r[0] for r in new), timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame()

    def plan(self, at_us: int, watermark_ms: int) -> None:
        """One timer per key, at the earliest of what is to be done; never at a time that has passed."""
        ms = max(-(-at_us // 1000), watermark_ms + 1)
        # The timer that has just gone off may still be listed.
        there = [t for t in self.handle.listTimers() if t > watermark_ms]
        if not there or ms < min(there):
            for t in there:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: r[:2]) if self.waiting.exists() else []
        due = [r for r in rows if r[0] <= watermark * 1000]
        later = rows[len(due) :]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        self.begin()
        out = [(key[0], *r) for r in self.take(due)]
        end = self.finish(watermark * 1000)
        ends = [x for x in (later[0][0] if later else None, end) if x is not None]
        if ends:
            self.plan(min(ends), watermark)
        yield pd.DataFrame(out, columns=list(self.out)) if out else pd.DataFrame()

    def close(self) -> None:
        pass


class Limiter(InOrder):
    """State: the times of the allowed calls that still count."""

    fields = (("at_us", "long"), ("seq", "long"))
    out = ("key", "at_us", "seq", "allowed")

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window = limit, window_us

    def init(self, handle) -> None:
        super().init(handle)
        self.calls = handle.getListState("calls", "at_us long")

    def begin(self) -> None:
        self.kept = deque(sorted(t for (t,) in self.calls.get()) if self.calls.exists() else ())

    def take(self, rows: list[tuple]) -> Iterator[tuple]:
        for at, seq in rows:
            while self.kept and at - self.kept[0] > self.window:
                self.kept.popleft()
            allowed = len(self.kept) < self.limit
            if allowed:
                self.kept.append(at)
            yield at, seq, allowed

    def finish(self, now: int) -> int | None:
        """A row that comes now is later than the watermark: calls that are over by then count for nothing."""
        live = [(t,) for t in self.kept if now - t <= self.window]
        if live:
            self.calls.put(live)
            return live[-1][0] + self.window + 1000
        self.calls.clear()
        return None


def rate_limited(calls: DataFrame, limit: int, window_s: float, late: str = "10 minutes") -> DataFrame:
    """ST4: calls (key, at timestamp, seq long) with allowed, as rate_allowed tells it, for append mode.

    A call is told once the watermark has passed it. Calls that come later than ``late`` are dropped by the watermark, null times
    too. A key's state is at most ``limit`` times and its open calls; it is gone when the window after its last call is over.
    """
    with_rocksdb(calls.sparkSession)
    rows = calls.where("at is not null").withWatermark("at", late).select("key", "at", F.unix_micros("at").alias("at_us"), F.col("seq").cast("long").alias("seq"))
    out = rows.groupBy("key").transformWithStateInPandas(Limiter(limit, round(window_s * MICROS)), "key string, at_us long, seq long, allowed boolean", "Append", "EventTime")
    return out.select("key", F.timestamp_micros("at_us").alias("at"), "seq", "allowed")


class Sessions(InOrder):
    """State: email and start of a token's session."""

    fields = (("at_us", "long"), ("seq", "long"), ("kind", "string"), ("email", "string"))
    out = ("token", "at_us", "seq", "kind", "email")

    def __init__(self, max_age_us: int):
        self.max_age = max_age_us

    def init(self, handle) -> None:
        super().init(handle)
        self.session = handle.getValueState("session", "email string, start long")

    def begin(self) -> None:
        self.now = tuple(self.session.get()) if self.session.exists() else None

    def take(self, rows: list[tuple]) -> Iterator[tuple]:
        for at, seq, kind, email in rows:
            if self.now and at - self.now[1] > self.max_age:
                self.now = None
            if kind == "create":
                self.now = ((email or "").strip().lower(), at)
            elif kind == "delete":
                self.now = None
            yield at, seq, kind, self.now[0] if self.now else None

    def finish(self, now: int) -> int | None:
        if self.now and now - self.now[1] <= self.max_age:
            self.session.update(self.now)
            return self.now[1] + self.max_age + 1000
        self.session.clear()
        return None


def session_users(events: DataFrame, max_age_s: float = 30 * 86400, late: str = "10 minutes") -> DataFrame:
    """ST5: events (token, at timestamp, seq long, kind create, use or delete, email) with the email that the token stands for
    after the event: null for unknown, deleted and expired tokens. A session ends ``max_age_s`` after it began; a timer then takes
    it out of the state. Equals session_lookup() on the same rows.
    """
    with_rocksdb(events.sparkSession)
    rows = events.where("at is not null").withWatermark("at", late).select("token", "at", F.unix_micros("at").alias("at_us"), F.col("seq").cast("long").alias("seq"), "kind", "email")
    out = rows.groupBy("token").transformWithStateInPandas(Sessions(round(max_age_s * MICROS)), "token string, at_us long, seq long, kind string, email string", "Append", "EventTime")
    return out.select("token", F.timestamp_micros("at_us").alias("at"), "seq", "kind", "email")


def session_lookup(events: DataFrame, max_age_s: float = 30 * 86400) -> DataFrame:
    """ST5 in batch: the last create or delete at or before an event decides, for ``max_age_s`` seconds."""
    from pyspark.sql.window import Window as W

    w = W.partitionBy("token").orderBy("at", "seq").rowsBetween(W.unboundedPreceding, 0)
    made = F.struct(F.col("kind"), F.unix_micros("at").alias("start"), F.lower(F.trim(F.coalesce("email", F.lit("")))).alias("who"))
    last = F.last(F.when(F.col("kind").isin("create", "delete"), made), ignorenulls=True).over(w)
    live = (F.col("last.kind") == "create") & (F.unix_micros("at") - F.col("last.start") <= round(max_age_s * MICROS))
    return events.where("at is not null").withColumn("last", last).select("token", "at", "seq", "kind", F.when(live, F.col("last.who")).alias("email"))
