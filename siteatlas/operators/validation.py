"""Rules that a generated guide and its questions must keep, as one expression over each row.

Rows: mode (generate or questions), max_questions, sources (array of ids),
decisions (array of id, active, needs_review), dismissed_topics; has_guide,
claims (array of text, evidence_ids; the summary first), links (array of source
ids in order), shortcuts (array of source_id, decision_ids), questions (array of
topic, options, recommended, evidence_ids).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The rules, in the order in which they are told.
RULES = "mode question-budget id-overlap question-evidence repeated-topic bad-option claim-evidence disputed-claim unknown-source duplicate-source shortcut-unlinked duplicate-shortcut shortcut-decision".split()


def _repeats(xs: Column) -> Column:
    return F.size(F.array_distinct(xs)) < F.size(xs)


def violations() -> Column:
    """Names of the rules that a row breaks, in order."""
    c = F.col
    none = F.array().cast("array<string>")
    ids = F.transform("decisions", lambda d: d["id"])
    active = F.transform(F.filter("decisions", lambda d: d["active"]), lambda d: d["id"])
    disputed = F.transform(F.filter("decisions", lambda d: d["needs_review"]), lambda d: d["id"])
    evidence = F.concat("sources", active)
    unknown = lambda xs, known: F.size(F.array_except(xs, known)) > 0
    topics = F.transform("questions", lambda q: q["topic"])
    guide = c("has_guide")
    used = F.when(guide, c("links")).otherwise(none)
    marks = F.transform("shortcuts", lambda s: s["source_id"])
    broken = [
        (c("mode") == "generate") != guide,
        F.size("questions") > c("max_questions"),
        F.arrays_overlap(c("sources"), ids),
        F.exists("questions", lambda q: unknown(q["evidence_ids"], evidence)),
        _repeats(topics) | F.arrays_overlap(topics, c("dismissed_topics")),
        F.exists("questions", lambda q: q["recommended"].isNotNull() & (q["recommended"] >= F.size(q["options"]))),
        guide & F.exists("claims", lambda x: unknown(x["evidence_ids"], evidence)),
        guide & F.exists("claims", lambda x: F.arrays_overlap(x["evidence_ids"], disputed)),
        unknown(used, c("sources")),
        _repeats(used),
        guide & unknown(marks, used),
        guide & _repeats(marks),
        guide & F.exists("shortcuts", lambda s: unknown(s["decision_ids"], active)),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(b, F.lit(False)), name) for b, name in zip(broken, RULES, strict=True))))


def validated(results: DataFrame) -> DataFrame:
    """results with `violations`, and `rule`, the first of them (null: valid)."""
    return results.withColumn("violations", violations()).withColumn("rule", F.get("violations", F.lit(0)))


def repeated_ids(rows: DataFrame, key: str, *within: str) -> DataFrame:
    """Identifiers that come more than once: an error wherever they must be unique."""
    return rows.groupBy(*within, key).agg(F.count("*").alias("n")).where("n > 1")


def unique(rows: DataFrame, *keys: str) -> DataFrame:
    """rows as they are; a key that comes more than once fails the query that reads them, and is named in the error."""
    own = Window.partitionBy(*keys)
    message = F.concat(F.lit("repeated identifier: "), F.concat_ws(", ", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys)))
    return rows.withColumn("_n", F.count(F.lit(1)).over(own)).where(F.assert_true(F.col("_n") == 1, message).isNull()).drop("_n")
