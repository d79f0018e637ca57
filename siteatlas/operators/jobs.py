"""Jobs with leases as transitions of whole tables. `now` is a timestamp column or value, never the clock.

jobs: job, project, kind, status (pending, running, succeeded, failed), attempt,
max_attempts, available_at, lease_until, lease_token, key, error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEASE_S, RETRY_CAP_S, RETRY_BASE_S = 180, 300, 5
ACTIVE = ("pending", "running")


def _later(now: Column, seconds) -> Column:
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_seconds(F.unix_micros(now) / 1_000_000 + seconds)


def expired(now: Column) -> Column:
    return (F.col("status") == "running") & (F.col("lease_until") <= now)


def live(now: Column, token: Column) -> Column:
    """Whether a worker with this token still holds the job."""
    return (F.col("status") == "running") & (F.col("lease_token") == token) & (F.col("lease_until") > now)


def swept(jobs: DataFrame, now: Column) -> DataFrame:
    """Expired jobs without attempts left fail."""
    out = expired(now) & (F.col("attempt") >= F.col("max_attempts"))
    return jobs.withColumn("error", F.when(out, "lease expired").otherwise(F.col("error"))).withColumn("status", F.when(out, "failed").otherwise(F.col("status")))


def claimable(now: Column) -> Column:
    return (F.col("attempt") < F.col("max_attempts")) & (((F.col("status") == "pending") & (F.col("available_at") <= now)) | expired(now))


def claimed(jobs: DataFrame, now: Column, workers: int, queue: str = "kind", ttl: int = LEASE_S) -> DataFrame:
    """All jobs, those that `workers` of each queue take changed: oldest first, attempt + 1, a lease of their own, error cleared. Expired jobs are swept first."""
    jobs = swept(jobs, now).withColumn("_can", claimable(now))
    place = F.row_number().over(Window.partitionBy(queue, "_can").orderBy("available_at", "job"))
    jobs = jobs.withColumn("taken", F.col("_can") & (place <= workers))
    take = lambda new, old: F.when(F.col("taken"), new).otherwise(F.col(old)).alias(old)
    changed = {
        "status": F.lit("running"), "attempt": F.col("attempt") + 1, "lease_until": _later(now, ttl),
        "lease_token": F.sha2(F.concat_ws("|", F.col("job").cast("string"), (F.col("attempt") + 1).cast("string")), 256), "error": F.lit(None).cast("string"),
    }
    return jobs.select(*(take(changed[c], c) if c in changed else F.col(c) for c in jobs.columns if c != "_can"))


def renewed(jobs: DataFrame, beats: DataFrame, now: Column, ttl: int = LEASE_S) -> DataFrame:
    """beats: job, token. Live leases get a new end; a stale token changes nothing."""
    met = jobs.join(beats.withColumnRenamed("token", "_token"), "job", "left")
    ok = F.coalesce(live(now, F.col("_token")), F.lit(False))
    return met.withColumn("lease_until", F.when(ok, _later(now, ttl)).otherwise(F.col("lease_until"))).withColumn("renewed", ok).drop("_token")


def backoff(attempt: Column) -> Column:
    """Seconds until the next try."""
    return F.least(F.lit(RETRY_CAP_S), RETRY_BASE_S * F.pow(F.lit(2), attempt)).cast("long")


def failed(jobs: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """failures: job, token, retryable, message. Of live jobs: pending again after a wait while attempts are left, else failed."""
    met = jobs.join(failures.withColumnRenamed("token", "_token"), "job", "left")
    hit = F.coalesce(live(now, F.col("_token")), F.lit(False))
    again = hit & F.col("retryable") & (F.col("attempt") < F.col("max_attempts"))
    met = met.withColumn("available_at", F.when(again, _later(now, backoff(F.col("attempt")))).otherwise(F.col("available_at"))).withColumn("error", F.when(hit, F.col("message")).otherwise(F.col("error")))
    return met.withColumn("status", F.when(again, "pending").when(hit, "failed").otherwise(F.col("status"))).withColumn("lease_token", F.when(hit, F.lit(None)).otherwise(F.col("lease_token"))).drop("_token", "retryable", "message")


def enqueued(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """requests: request, project, kind, key. What each gives: the project's active job whatever its key, else the job that has the key, else a new one; of requests that would be new for one project or key the first is inserted and the others reuse it."""
    active = jobs.where(F.col("status").isin(*ACTIVE)).groupBy("project").agg(F.min_by("job", F.struct("available_at", "job")).alias("active"))
    same = jobs.where("key is not null").groupBy("key").agg(F.min("job").alias("same"))
    met = requests.join(active, "project", "left").join(same, "key", "left")
    fresh = F.col("active").isNull() & F.col("same").isNull()
    first = lambda by: F.min(F.when(fresh, F.col("request"))).over(Window.partitionBy(by))
    lead = F.least(first("project"), F.when(F.col("key").isNotNull(), first("key")))
    how = F.when(F.col("active").isNotNull(), "active").when(F.col("same").isNotNull(), "same key").when(lead < F.col("request"), "reused").otherwise("inserted")
    return met.select("request", "project", how.alias("result"), F.coalesce("active", "same").alias("job"), F.when(how == "reused", lead).alias("request_of"))


def scheduled(projects: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """projects: project, monitored, next_check_at. The oldest due ones, each with its new next check a day on and the key of its job."""
    due = projects.where(F.col("monitored") & (F.col("next_check_at") <= now)).orderBy("next_check_at", "project").limit(limit)
    return due.select("project", F.concat(F.lit("refresh:"), F.col("project").cast("string"), F.lit(":"), F.date_format("next_check_at", "yyyy-MM-dd")).alias("key"), (F.col("next_check_at") + F.expr("interval 1 day")).alias("next_check_at"))


def dispatched(jobs: DataFrame, known: list[str]) -> DataFrame:
    """Claimed jobs by the handler of their kind; kinds that nobody handles fail."""
    return jobs.where("taken").select("job", F.when(F.col("kind").isin(known), F.col("kind")).otherwise("unknown").alias("handler"), (~F.col("kind").isin(known)).alias("fails"))
