"""State of each viewer and user over a stream, forgotten by timers once it can't matter any more."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kithgraph.plans.telemetry import ACTIVE
from kithgraph.schemas import FATIGUE_WINDOW, IMPRESSION_COUNT, IMPRESSION_ENTRIES

#: Where the engine keeps state of this kind.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IMPRESSION_OUT = "viewer_id long, post_id long, last_served long, count long, expired boolean"
SEEN_OUT = "user_id long, last_seen long, active boolean"


def keyed_state(spark: SparkSession) -> None:
    """Lets a session run the queries below; to be called before they start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def runs(held: list[tuple[int, int, int]]) -> dict[int, tuple[int, int]]:
    """(last_served, count) by post of entries (seq, post, served) in order of seq."""
    out: dict[int, tuple[int, int]] = {}
    for _, post, served in held:
        last, count = out.get(post, (served, 0))
        out[post] = served, 1 if abs(served - last) >= FATIGUE_WINDOW else min(IMPRESSION_COUNT, count + 1)
    return out


class Timed(StatefulProcessor):
    """A processor with one timer for each key."""

    handle: StatefulProcessorHandle

    def wake(self, at_ms: int) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at_ms)

    def close(self) -> None:
        """Nothing is open."""


class Impressions(Timed):
    """The newest IMPRESSION_ENTRIES entries of a viewer, in whatever order they come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", "seq long, post long, served long")
        self.told = handle.getValueState("told", "watermark long")

    def _told(self) -> int:
        return self.told.get()[0] if self.told.exists() else 0

    def _rows(self, key: tuple, found: list[tuple]) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame([(key[0], *f) for f in found], columns=["viewer_id", "post_id", "last_served", "count", "expired"])

    def _wake_for(self, held: dict[int, tuple[int, int]], after: int) -> bool:
        """Sets the timer to the next post's end after a time, if there is one."""
        ends = [e for last, _ in held.values() if (e := (last + FATIGUE_WINDOW) * 1000) > after]
        if ends:
            self.wake(min(ends))
        return bool(ends)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(e) for e in self.entries.get()] if self.entries.exists() else []
        before, told = runs(held), self._told()
        for b in rows:
            held = sorted([*held, *zip(b["seq"].tolist(), b["post_id"].tolist(), b["served_at"].tolist(), strict=True)])[-IMPRESSION_ENTRIES:]
        self.entries.put(held)
        after = runs(held)
        changed = [(post, *run, False) for post, run in after.items() if before.get(post) != run]
        gone = [(post, last, 0, False) for post, (last, _) in before.items() if post not in after]
        if not self._wake_for(after, told):
            self.wake(max(told, timerValues.getCurrentWatermarkInMs()) + 1)
        yield from self._rows(key, [*changed, *gone])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Posts last served FATIGUE_WINDOW before the watermark are told as gone, once.

        Their entries still take up places among the newest ones; when no post is left, all are forgotten.
        """
        now, told = timerValues.getCurrentWatermarkInMs(), self._told()
        held = runs([tuple(e) for e in self.entries.get()] if self.entries.exists() else [])
        gone = [(post, last, 0, True) for post, (last, _) in held.items() if told < (last + FATIGUE_WINDOW) * 1000 <= now]
        if self._wake_for(held, now):
            self.told.update((now,))
        else:
            self.entries.clear()
            self.told.clear()
        yield from self._rows(key, gone)


def impression_state(log: DataFrame, delay: str = "1 day") -> DataFrame:
    """State of operators.impressions.state over a stream of impressions; each change is emitted.

    Entries come in any order up to `delay`; those further behind are dropped.  A post whose last
    entry is no longer among the newest ones is emitted with count 0, and so, with `expired`, is
    one last served FATIGUE_WINDOW before the watermark: what is left is impressions.live().  A viewer
    without such posts is forgotten, as every later run is a new one.  Entries with a null in
    any column don't count.  The last word on a post is that of the last batch, expiry after the rest.
    """
    keyed_state(log.sparkSession)
    log = log.dropna(subset=["viewer_id", "post_id", "served_at", "seq"])
    log = log.withColumn("event_time", F.timestamp_seconds("served_at")).withWatermark("event_time", delay)
    return log.groupBy("viewer_id").transformWithStateInPandas(Impressions(), IMPRESSION_OUT, "Update", "eventTime")


def last_words(emitted: DataFrame, batch: str) -> DataFrame:
    """The impressions that are left after all that impression_state() emitted, with its batch number in a column."""
    last = emitted.groupBy("viewer_id", "post_id").agg(F.max_by(F.struct("last_served", "count"), F.struct(batch, "expired")).alias("x"))
    return last.where("x.count > 0").select("viewer_id", "post_id", "x.last_served", "x.count")


class LastSeen(Timed):
    """The newest activity of a user, until the longest window of activity has passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ts long")

    def _row(self, key: tuple, ts: int, active: bool) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [key[0]], "last_seen": [ts], "active": [active]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.seen.get()[0] if self.seen.exists() else None
        newest = max([int(b["ts"].max()) for b in rows] + ([held] if held is not None else []))
        if newest != held:
            self.seen.update((newest,))
            self.wake((newest + max(ACTIVE)) * 1000)
            yield self._row(key, newest, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest = self.seen.get()[0] if self.seen.exists() else None
        self.seen.clear()
        if newest is not None:
            yield self._row(key, newest, False)


def last_seen(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """(user_id, last_seen, active) of a stream (user_id, ts), for each change.

    A user without activity in the longest window of telemetry.ACTIVE before the watermark is
    emitted once more as not active, and forgotten.  Rows further behind than `delay`, and rows with a null, don't count.
    """
    keyed_state(events.sparkSession)
    at = events.dropna(subset=["user_id", "ts"]).withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", delay)
    return at.groupBy("user_id").transformWithStateInPandas(LastSeen(), SEEN_OUT, "Update", "eventTime")


def active(emitted: DataFrame, batch: str) -> DataFrame:
    """(user_id, last_seen) of the users that are active after all that last_seen() emitted."""
    last = emitted.groupBy("user_id").agg(F.max_by(F.struct("last_seen", "active"), F.struct(batch, "last_seen", ~F.col("active"))).alias("x"))
    return last.where("x.active").select("user_id", "x.last_seen")
