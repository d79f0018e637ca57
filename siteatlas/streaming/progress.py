"""The progress feed as streams, equal to their batch forms.

Events are (user_id, event_id, ts, event_type). State by user keeps the last
event's time and identifier; an event that comes after a later one of its user
was told is late: it is counted in its state and gives no row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteatlas.sources.stores import shared_folder
from siteatlas.streaming.timers import feed

CHANGES = "user_id long, event_id long, event_type string"
_LAST = "ts timestamp, event_id long, event_type string, late long"


def _changes(key, frames, state) -> Iterator[pd.DataFrame]:
    last = state.get if state.exists else (None, None, None, 0)
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
    fresh = rows if last[0] is None else rows[(rows.ts > last[0]) | ((rows.ts == last[0]) & (rows.event_id > last[1]))]
    late = last[3] + len(rows) - len(fresh)
    if len(fresh):
        before = fresh.event_type.shift()
        before.iloc[0] = last[2]
        changed = (fresh.event_type != before) & ~(fresh.event_type.isna() & before.isna())
        if last[0] is None:
            changed.iloc[0] = True
        end = fresh.iloc[-1]
        last = (end.ts.to_pydatetime(), int(end.event_id), end.event_type, late)
        yield fresh[changed][["user_id", "event_id", "event_type"]]
    state.update((*last[:3], late))


def stage_changes(events: DataFrame) -> DataFrame:
    """Rows wherever a user's event type changes. One user's events of a micro-batch are sorted in one task."""
    return events.groupBy("user_id").applyInPandasWithState(_changes, CHANGES, _LAST, "append", "NoTimeout")


def once(events: DataFrame) -> DataFrame:
    """At-least-once deliveries of an event as one, by its key within the watermark."""
    return events.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"])


def latest(batch: DataFrame) -> DataFrame:
    """The last event of each user: all that a slow reader of one slot sees of a micro-batch."""
    return batch.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max(F.struct("ts", "event_id")).alias("at")).select("user_id", "at.event_id", "event_type")


def _source(spark: SparkSession, path: str) -> tuple[str, str]:
    """A folder that a stream can read and the pattern of its files: a table is a folder of files or one file."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return (path, "*") if system.getFileStatus(own).isDirectory() else (path.rsplit("/", 1)[0], own.getName())


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(spark: SparkSession, path: str, stream: Callable[[DataFrame], DataFrame], out: str, files: int = 1000) -> DataFrame:
    """All files of a table once through the stream, so many in a micro-batch; what a run before has read isn't read again."""
    table = spark.read.parquet(path)
    folder_, pattern = _source(spark, path)
    events = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(folder_)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # timers need it
    made = stream(events)
    made.writeStream.format("parquet").outputMode("append").option("checkpointLocation", out + "-log").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


def audited(spark: SparkSession, events: DataFrame, out: str, epoch: Callable[[], DataFrame]) -> None:
    """Appends events to the audit table, each micro-batch joined to the side table as it is then (user_id, epoch): a new epoch is read with the next micro-batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.join(epoch(), "user_id", "left").withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    events.writeStream.foreachBatch(write).option("checkpointLocation", out + "-log").trigger(availableNow=True).start().awaitTermination()


def run_feed(spark: SparkSession, sf_dir: str, tick: int) -> DataFrame:
    """All events once through the feed with its heartbeats."""
    stream = lambda events: feed(events.select("user_id", "event_id", F.col("ts").cast("timestamp"), "event_type"), tick)
    return drained(spark, f"{sf_dir}/events.parquet", stream, f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}")


def run_stage_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events once through the stream; the sink is a table in the shared folder."""
    stream = lambda events: stage_changes(events.select("user_id", "event_id", F.col("ts").cast("timestamp"), "event_type"))
    return drained(spark, f"{sf_dir}/events.parquet", stream, f"{shared_folder(spark)}/progress-{uuid.uuid4().hex}")
