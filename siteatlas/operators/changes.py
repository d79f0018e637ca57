"""What changed between a draft's sources and the latest snapshot, and what hangs on it."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.functions.diff import unified_diff

KINDS = ["added", "modified", "removed"]


def source_changes(draft: DataFrame, latest: DataFrame) -> DataFrame:
    """draft, latest: project, source_id, url, title, content. Rows project, source_id, url, change, diff of the contents."""
    keys = ["project", "source_id"]
    a = draft.select(*keys, F.col("url").alias("_u"), F.struct("title", "content").alias("_a"))
    b = latest.select(*keys, F.col("url").alias("_v"), F.struct("title", "content").alias("_b"))
    met = a.join(b, keys, "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("modified")
    return met.select(*keys, F.coalesce("_v", "_u").alias("url"), change.alias("change"), unified_diff("_a.content", "_b.content").alias("diff"))


def inbox(changes: DataFrame, links: DataFrame, decisions: DataFrame) -> DataFrame:
    """changes with `sections` (those of the guide that link the source; links: project, source_id, section) and `flagged` (decisions that rest on it and need review; decisions: project, decision, needs_review, basis of source ids)."""
    keys = ["project", "source_id"]
    sections = links.groupBy(*keys).agg(F.array_sort(F.collect_set("section")).alias("sections"))
    rest = decisions.where("needs_review").select("project", "decision", F.explode("basis").alias("source_id")).groupBy(*keys).agg(F.array_sort(F.collect_set("decision")).alias("flagged"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    out = changes.join(sections, keys, "left").join(rest, keys, "left")
    return out.select(*changes.columns, none("sections", "string"), none("flagged", dict(decisions.dtypes)["decision"]))


def inbox_counts(items: DataFrame, answers: DataFrame) -> DataFrame:
    """By project: all, added, modified, removed, answers (flagged ones; answers: project, decision)."""
    n = items.groupBy("project").agg(F.count("*").alias("all"), *(F.count_if(F.col("change") == k).alias(k) for k in KINDS))
    a = answers.groupBy("project").agg(F.count("*").alias("answers"))
    return n.join(a, "project", "full").na.fill(0)


def without_repeats(sources: DataFrame, reviews: DataFrame) -> DataFrame:
    """reviews: request, source_id, content; sources: request, source_id, content. Reviewed sources that are the same as the request's own become a reference."""
    met = reviews.join(sources.select("request", "source_id", F.col("content").alias("_own")), ["request", "source_id"], "left")
    same = F.coalesce(F.col("content") == F.col("_own"), F.lit(False))
    return met.select("request", "source_id", F.when(~same, F.col("content")).alias("content"), same.alias("same_as_source"))


def distinct_in_order(rows: DataFrame, by: list[str], key: str, order: str) -> DataFrame:
    """The first row of each key; the order of first places stays in `place`."""
    own = F.row_number().over(Window.partitionBy(*by, key).orderBy(order))
    first = rows.withColumn("_n", own).where("_n = 1").drop("_n")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("long"))


def merged(prior: DataFrame, fresh: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """Sources of prior and fresh, fresh ones first, without the removed keys; `fresh` says which."""
    kept = prior.join(fresh.select(*keys), keys, "left_anti").withColumn("fresh", F.lit(False)).unionByName(fresh.withColumn("fresh", F.lit(True)))
    return kept.join(removed.select(*keys), keys, "left_anti")


def set_difference(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Of two array columns: added (only in b), removed (only in a), common, and whether a is within b."""
    return rows.select(key, F.array_sort(F.array_except(b, a)).alias("added"), F.array_sort(F.array_except(a, b)).alias("removed"), F.array_sort(F.array_intersect(a, b)).alias("common"), (F.size(F.array_except(a, b)) == 0).alias("within"))


def unchanged_payloads(rows: DataFrame, key: str, order: Column, payload: str) -> DataFrame:
    """Rows whose payload is another than that of the row before."""
    before = F.lag(payload).over(Window.partitionBy(key).orderBy(order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
    return rows.withColumn("_emit", first | ~F.col(payload).eqNullSafe(before)).where("_emit").drop("_emit")


def previous_run(runs: DataFrame) -> DataFrame:
    """runs: run, suite, model, prompt, created_at. With `previous`, the run before of the same suite, model and prompt."""
    return runs.withColumn("previous", F.lag("run").over(Window.partitionBy("suite", "model", "prompt").orderBy("created_at", "run")))


def recent_runs(runs: DataFrame, jobs: DataFrame, suites: DataFrame, versions: DataFrame, k: int = 20) -> DataFrame:
    """The k newest runs of each guide with their job's status, suite and version; runs meet jobs by key."""
    met = runs.join(jobs.select("key", F.col("status").alias("job_status")), "key").join(suites.select("suite", "guide"), "suite").join(versions.select("version", F.col("created_at").alias("version_at")), "version")
    place = F.row_number().over(Window.partitionBy("guide").orderBy(F.desc("created_at"), "run"))
    return met.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def section_ranges(headings: DataFrame) -> DataFrame:
    """headings: guide, line, level, text, n_lines. With `until`, the line before which the section ends: the next heading's, or one after the last line."""
    following = F.lead("line").over(Window.partitionBy("guide").orderBy("line"))
    return headings.withColumn("until", F.coalesce(following, F.col("n_lines") + 1))


def sections_of_lines(lines: DataFrame, headings: DataFrame) -> DataFrame:
    """lines: guide, line. With the heading whose range holds each (null before the first): the last heading up to it, by one window over both."""
    h = headings.select("guide", "line", F.struct("line", "level", "text").alias("_h"), F.lit(0).alias("_k"))
    both = lines.select("guide", "line", F.lit(None).cast(h.schema["_h"].dataType).alias("_h"), F.lit(1).alias("_k")).unionByName(h)
    last = F.last("_h", ignorenulls=True).over(Window.partitionBy("guide").orderBy("line", "_k"))
    return both.withColumn("heading", last).where("_k = 1").select("guide", "line", "heading")


def snapshot_status(rows: DataFrame) -> DataFrame:
    """rows: site, usable, missed (unavailable, cut off or warned of). By site: status and fresh, its usable pages."""
    n = rows.groupBy("site").agg(F.count_if("usable").alias("fresh"), F.bool_or("missed").alias("missed"))
    return n.select("site", F.when(F.col("fresh") == 0, "failed").when(F.col("missed"), "partial").otherwise("complete").alias("status"), "fresh")


def recent_sessions(visits: DataFrame, k: int = 10) -> DataFrame:
    """visits: user, project, name, visited_at. The k projects that each user saw last, once each; visits without identifier, name or time don't count."""
    good = visits.where("project is not null and trim(name) <> '' and visited_at is not null")
    last = good.groupBy("user", "project").agg(F.max_by("name", "visited_at").alias("name"), F.max("visited_at").alias("visited_at"))
    place = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("visited_at"), "project"))
    return last.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def read_model(projects: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """projects with one array column for each part (rows with `project`), ordered by its other columns; empty where there is none."""
    out = projects
    for name, rows in parts.items():
        fields = [c for c in rows.columns if c != "project"]
        packed = rows.groupBy("project").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(packed, "project", "left").withColumn(name, F.coalesce(name, F.array().cast(packed.schema[name].dataType)))
    return out
