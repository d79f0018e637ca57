"""Feeds that beat while nothing changes, and leases that end when nobody renews them: state by key with event-time timers.

Both tell what is due as soon as the watermark has passed it, also without a new
row of the key, and what was due before a row when the row comes; so what they
tell doesn't depend on how rows fall into micro-batches. Rows that come after a
later one of their key was told are late and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HEARTBEAT_TICKS, LIFETIME_TICKS = 10, 60
FEED = "user_id long, at long, kind string, event_type string"
LEASE = "job long, worker string, at long, result string"


class _Timed(StatefulProcessor):
    """One value of state and one timer, for what is due next. Subclasses: STATE, OUT, ORDER, due(state), pass_(key, state, upto), take(key, state, row)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.STATE)

    def _put(self, state) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if (due := self.due(state)) is not None:
            self.handle.registerTimer(due)
        self.state.update(tuple(state))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in self.OUT.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, out = list(self.state.get()) if self.state.exists() else None, []
        for row in pd.concat(list(rows)).sort_values(self.ORDER, kind="stable").itertuples():
            if state is not None:
                out += self.pass_(key, state, row.t)
            state, said = self.take(key, state, row)
            out += said
        self._put(state)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = list(self.state.get())
        out = self.pass_(key, state, max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))
        self._put(state)
        yield self._frame(out)


class _Feed(_Timed):
    STATE = "ends long, beat long, seen long, last string, over boolean"
    OUT, ORDER = FEED, ["t", "event_id"]

    def __init__(self, tick: int, heartbeat: int, lifetime: int):
        self.idle, self.life = 1000 * tick * heartbeat, 1000 * tick * lifetime

    def due(self, state):
        return None if state[4] else min(state[0], state[1])

    def pass_(self, key, state, upto):
        out = []
        while not state[4] and min(state[0], state[1]) <= upto:
            if state[0] <= state[1]:
                out.append((key[0], state[0], "end", None))
                state[4] = True
            else:
                out.append((key[0], state[1], "heartbeat", None))
                state[1] += self.idle
        return out

    def take(self, key, state, row):
        now, kind = row.t, row.event_type
        if state is None:
            return [now + self.life, now + self.idle, now, kind, False], [(key[0], now, "payload", kind)]
        if state[4] or now < state[2]:
            return state, []
        state[2] = now
        if kind == state[3]:
            return state, []
        state[1], state[3] = now + self.idle, kind
        return state, [(key[0], now, "payload", kind)]


def feed(events: DataFrame, tick: int = 1, heartbeat: int = HEARTBEAT_TICKS, lifetime: int = LIFETIME_TICKS, delay: str = "0 seconds") -> DataFrame:
    """events: user_id, event_id, ts, event_type. Rows user_id, at, kind, event_type: a payload where a user's type changes, a heartbeat after each so many ticks (seconds each) without one, and the end of the feed after its lifetime, from its first event on. What is due at the time of an event comes before it."""
    timed = events.withWatermark("ts", delay).select("user_id", "event_id", "event_type", "ts", F.unix_millis(F.col("ts")).alias("t"))
    made = timed.groupBy("user_id").transformWithStateInPandas(_Feed(tick, heartbeat, lifetime), FEED, "append", "eventTime")
    return made.withColumn("at", F.timestamp_millis("at"))


class _Lease(_Timed):
    STATE = "worker string, ends long, seen long"
    OUT, ORDER = LEASE, ["t", "worker"]

    def due(self, state):
        return state[1] if state[0] is not None else None

    def pass_(self, key, state, upto):
        if state[0] is None or state[1] > upto:
            return []
        out = [(key[0], state[0], state[1], "expired")]
        state[0] = None
        return out

    def take(self, key, state, row):
        now = row.t
        if state is not None and now < state[2]:
            return state, []
        held = state is not None and state[0] is not None
        if held and state[0] != row.worker:
            state[2] = now
            return state, [(key[0], row.worker, now, "refused")]
        return [row.worker, now + 1000 * int(row.ttl), now], [(key[0], row.worker, now, "renewed" if held else "claimed")]


def leases(beats: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """beats: job, worker, at, ttl (seconds). Rows job, worker, at, result: one worker holds a job until its lease ends unrenewed, which is told as expired; then any may claim it."""
    timed = beats.withWatermark("at", delay).withColumn("t", F.unix_millis(F.col("at")))
    return timed.groupBy("job").transformWithStateInPandas(_Lease(), LEASE, "append", "eventTime").withColumn("at", F.timestamp_millis("at"))


def feed_of(events: DataFrame, tick: int = 1, heartbeat: int = HEARTBEAT_TICKS, lifetime: int = LIFETIME_TICKS) -> DataFrame:
    """feed() of a finished table, as a batch of joins and windows: what is due up to the table's last time."""
    from pyspark.sql import Window

    ms = F.unix_millis(F.col("ts"))
    rows = events.select("user_id", "event_id", "event_type", ms.alias("t"))
    own = Window.partitionBy("user_id").orderBy("t", "event_id")
    last = rows.agg(F.max("t").alias("last"))
    rows = rows.withColumn("ends", F.min("t").over(Window.partitionBy("user_id")) + 1000 * tick * lifetime)
    before = F.lag("event_type").over(own)
    told = rows.withColumn("new", (F.row_number().over(own) == 1) | ~F.col("event_type").eqNullSafe(before)).where("new and t < ends")
    told = told.withColumn("until", F.coalesce(F.lead("t").over(own), F.col("ends")))
    met = told.join(F.broadcast(last))  # one row
    step = 1000 * tick * heartbeat
    beats = F.when(F.col("until") == F.col("ends"), F.least(F.col("until") - 1, F.col("last"))).otherwise(F.least("until", "last"))
    due = F.when(beats >= F.col("t") + step, F.sequence(F.col("t") + step, beats, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    none = F.lit(None).cast("string")
    at = F.timestamp_millis(F.col("at"))
    return (
        told.select("user_id", F.timestamp_millis("t").alias("at"), F.lit("payload").alias("kind"), "event_type")
        .unionByName(met.select("user_id", F.explode(due).alias("at")).select("user_id", at.alias("at"), F.lit("heartbeat").alias("kind"), none.alias("event_type")))
        .unionByName(rows.select("user_id", "ends").distinct().join(F.broadcast(last)).where("ends <= last").select("user_id", F.timestamp_millis("ends").alias("at"), F.lit("end").alias("kind"), none.alias("event_type")))
    )
