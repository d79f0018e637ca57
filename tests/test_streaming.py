"""Streams against their batch forms, over several micro-batches and late rows."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from siteatlas.streaming import progress, timers

EVENTS = "user_id long, event_id long, ts timestamp, event_type string"
DAY = dt.datetime(2024, 1, 1)


def at(s):
    return DAY + dt.timedelta(seconds=s)


def write(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)  # files are read in order of time


def test_changes_over_batches(spark, tmp_path):
    some = random.Random(2)
    rows = [(i % 3, i, at(i // 2), some.choice(["a", "b", None])) for i in range(60)]
    write(spark, f"{tmp_path}/events", [rows[:20], rows[20:40], rows[40:], [(0, 1000, at(0), "late")]], EVENTS)
    out = progress.drained(spark, f"{tmp_path}/events", progress.stage_changes, f"{tmp_path}/out", files=1)
    want = []
    for user in range(3):
        last = object()
        for _, i, _, kind in sorted((r for r in rows if r[0] == user), key=lambda r: (r[2], r[1])):
            if kind != last:
                want.append((user, i, kind))
            last = kind
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    again = progress.drained(spark, f"{tmp_path}/events", progress.stage_changes, f"{tmp_path}/out", files=1)
    assert again.count() == len(want)


def test_deliveries_count_once(spark, tmp_path):
    rows = [(1, i % 10, at(i % 10), "a") for i in range(30)]
    write(spark, f"{tmp_path}/events", [rows[:15], rows[15:]], EVENTS)
    out = progress.drained(spark, f"{tmp_path}/events", progress.once, f"{tmp_path}/out", files=1)
    assert sorted(r.event_id for r in out.collect()) == list(range(10))


@pytest.mark.parametrize("batches", [1, 2, 6])
def test_leases(spark, tmp_path, batches):
    """What is told is the same however beats fall into micro-batches; job 2 ends without a new beat, job 3 isn't over at the last time."""
    beats = [(1, "a", at(0), 180), (2, "b", at(5), 180), (1, "b", at(100), 180), (1, "a", at(150), 180), (1, "b", at(329), 180), (1, "b", at(330), 180), (3, "c", at(400), 600), (1, "a", at(900), 60)]
    size = -(-len(beats) // batches)
    write(spark, f"{tmp_path}/beats", [beats[i : i + size] for i in range(0, len(beats), size)], "job long, worker string, at timestamp, ttl long")
    out = progress.drained(spark, f"{tmp_path}/beats", timers.leases, f"{tmp_path}/out", files=1)
    assert sorted(map(tuple, out.collect())) == sorted(
        [(1, "a", at(0), "claimed"), (1, "b", at(100), "refused"), (1, "a", at(150), "renewed"), (1, "b", at(329), "refused"), (1, "a", at(330), "expired"), (1, "b", at(330), "claimed"), (1, "b", at(510), "expired"), (1, "a", at(900), "claimed"), (2, "b", at(5), "claimed"), (2, "b", at(185), "expired"), (3, "c", at(400), "claimed")]
    )


@pytest.mark.parametrize("batches", [1, 4])
def test_feed_is_batch(spark, tmp_path, batches):
    some = random.Random(4)
    rows = sorted([(some.randint(0, 3), i, at(some.randint(0, 300)), some.choice(["a", "b", None])) for i in range(60)] + [(9, 100, at(3), "only")], key=lambda r: r[2])
    size = -(-len(rows) // batches)
    write(spark, f"{tmp_path}/events", [rows[i : i + size] for i in range(0, len(rows), size)], EVENTS)
    feed = lambda events: timers.feed(events, 2, 5, 100)
    out = progress.drained(spark, f"{tmp_path}/events", feed, f"{tmp_path}/out", files=1)
    want = timers.feed_of(spark.createDataFrame(rows, EVENTS), 2, 5, 100)
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted(map(tuple, want.collect()), key=str)
    plain = []
    for user in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == user), key=lambda r: (r[2], r[1]))
        begin, last, beat, over = own[0][2], object(), None, False
        for t, kind in [*((r[2], r[3]) for r in own), (rows[-1][2], object())]:
            while beat and not over and min(beat, begin + dt.timedelta(seconds=200)) <= t:
                over = begin + dt.timedelta(seconds=200) <= beat
                plain.append((user, min(beat, begin + dt.timedelta(seconds=200)), "end" if over else "heartbeat", None))
                beat += dt.timedelta(seconds=10)
            if kind != last and not over and isinstance(kind, (str, type(None))):
                plain.append((user, t, "payload", kind))
                last, beat = kind, t + dt.timedelta(seconds=10)
    assert got == sorted(plain, key=str) and sum(r[2] == "end" for r in got) > 2 and sum(r[2] == "heartbeat" for r in got) > 10


def test_slow_reader(spark):
    rows = spark.createDataFrame([(1, 1, at(0), "a"), (1, 2, at(1), "b"), (2, 3, at(0), "c")], EVENTS)
    assert sorted(map(tuple, progress.latest(rows).collect())) == [(1, 2, "b"), (2, 3, "c")]


def test_audit_reads_each_epoch(spark, tmp_path):
    write(spark, f"{tmp_path}/events", [[(1, 1, at(0), "a")], [(1, 2, at(1), "b")]], EVENTS)
    seen = []

    def epoch():
        seen.append(1)
        return spark.createDataFrame([(1, len(seen))], "user_id long, epoch long")

    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    progress.audited(spark, events, f"{tmp_path}/audit", epoch)
    assert [(r.event_id, r.epoch) for r in spark.read.parquet(f"{tmp_path}/audit").orderBy("event_id").collect()] == [(1, 1), (2, 2)]
    assert spark.read.parquet(f"{tmp_path}/audit").where(F.col("batch").isNull()).count() == 0
