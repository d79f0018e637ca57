"""Tables that keep what the engine makes: append, upsert, insert-ignore, clones, artifacts, JSON corpora.

Parquet folders stand for tables. A changed table is written whole beside the old
one; its reader is given the new path, so a lost job leaves the old table as it was.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def appended(rows: DataFrame, path: str) -> None:
    """Immutable rows: snapshots, versions, audit events."""
    rows.write.mode("append").parquet(path)


def upserted(table: DataFrame, rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """table with rows in place of those of their keys; of several rows of one key the last in order counts, and new columns never come in."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))
    new = rows.withColumn("_n", last).where("_n = 1").select(*table.columns)
    return table.join(new.select(*keys), keys, "left_anti").select(*table.columns).unionByName(new)


def inserted(table: DataFrame, rows: DataFrame, keys: list[str], order: str, where: Column | None = None) -> DataFrame:
    """Rows that are new: their keys stand in no row of table (of those that `where` holds for), the first of each key."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    known = (table if where is None else table.where(where)).select(*keys).distinct()
    return rows.withColumn("_n", first).where("_n = 1").drop("_n").join(known, keys, "left_anti")


def cloned(versions: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """changes: key, new_key and columns to replace. Copies of those versions under new keys, the rest of their columns as it was."""
    own = [c for c in changes.columns if c not in (key, f"new_{key}")]
    met = versions.join(changes.select(key, f"new_{key}", *(F.col(c).alias(f"_new_{c}") for c in own)), key)
    return met.select(*(F.col(f"new_{key}").alias(c) if c == key else F.col(f"_new_{c}").alias(c) if c in own else F.col(c) for c in versions.columns))


def artifacts(rows: DataFrame, report: DataFrame, path: str) -> None:
    """One JSON line for each row, and the report beside them."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    report.write.mode("overwrite").json(f"{path}/report")


def corpus(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON files, one document or one array of them each; a schema saves the pass that finds it."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def backfilled(table: DataFrame, source: DataFrame, keys: list[str], column: str, there: DataFrame, on: list[str]) -> DataFrame:
    """table, in which the null values of `column` come from the source row of the same keys (the least value of several), wherever `there` has a row of the same `on`; a backfill of a changed schema."""
    value = source.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.min(column).alias("_new"))
    open_ = there.select(*on).distinct().withColumn("_there", F.lit(True))
    met = table.join(value, keys, "left").join(open_, on, "left")
    return met.withColumn(column, F.when(F.col(column).isNull() & F.col("_there"), F.col("_new")).otherwise(F.col(column))).select(*table.columns)


def audited(files: DataFrame, texts: DataFrame) -> DataFrame:
    """files: id, sha256; texts: id, text. Whether each file's text is there and has its hash."""
    met = files.join(texts, "id", "left")
    state = F.when(F.col("text").isNull(), "missing").when(F.sha2("text", 256) != F.col("sha256"), "changed").otherwise("same")
    return met.select("id", state.alias("state"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one, kept for the session, only in local mode."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = "file://" + tempfile.mkdtemp(prefix="siteatlas-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once and read again: a round's state, which later rounds read instead of computing it anew."""
    path = f"{shared_folder(df.sparkSession)}/siteatlas/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
