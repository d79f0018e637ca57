"""Snapshots of pages: what an observation changes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(stored: DataFrame, observed: DataFrame) -> DataFrame:
    """stored: url, hash, not_found_count; observed: url, outcome, hash. Rows url, change (added, modified, removed, unavailable or none), and the page kept: hash, not_found_count (NULL where it isn't).

    A first not-found lists a page as unavailable, the second removes it; ok resets the count, unavailable keeps it.
    """
    old, new = stored.select("url", F.col("hash").alias("old"), F.col("not_found_count").alias("n")), observed.select("url", "outcome", F.col("hash").alias("new"))
    met = old.join(new, "url", "full").withColumn("had", F.col("old").isNotNull())
    gone = (F.col("outcome") == "not-found") & F.col("had")
    change = (
        F.when((F.col("outcome") == "ok") & ~F.col("had"), "added")
        .when((F.col("outcome") == "ok") & (F.col("old") != F.col("new")), "modified")
        .when(gone & (F.col("n") + 1 >= 2), "removed")
        .when(gone | (F.col("outcome") == "unavailable"), "unavailable")
        .otherwise("none")
    )
    kept_hash = F.when(F.col("outcome") == "ok", F.col("new")).when(change == "removed", F.lit(None)).otherwise(F.col("old"))
    count = F.when(F.col("outcome") == "ok", F.lit(0)).when(change == "removed", F.lit(None)).when(gone, F.col("n") + 1).otherwise(F.col("n"))
    return met.select("url", change.alias("change"), kept_hash.alias("hash"), count.cast("long").alias("not_found_count"))
