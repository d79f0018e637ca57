"""Owner decisions, questions, versions and publication, as guarded transitions of whole tables.

Edits carry the revision that their author saw; an edit whose revision isn't the
project's own is refused, and every accepted one raises the revision by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.functions.text import fingerprint

from siteatlas.operators.jobs import ACTIVE


def review_flags(decisions: DataFrame, sources: DataFrame) -> DataFrame:
    """decisions: project, decision, active, needs_review, basis (array of source_id, hash); sources: project, source_id, hash. With `needs_review` also where a source of the basis is gone or has changed, and `flagged` where that is new."""
    basis = decisions.where("active").select("project", "decision", F.explode("basis").alias("b")).select("project", "decision", "b.source_id", F.col("b.hash").alias("was"))
    met = basis.join(sources.select("project", "source_id", F.col("hash").alias("now")), ["project", "source_id"], "left")
    stale = met.groupBy("project", "decision").agg(F.bool_or(F.col("now").isNull() | (F.col("now") != F.col("was"))).alias("stale"))
    out = decisions.join(stale, ["project", "decision"], "left").withColumn("flagged", F.coalesce("stale", F.lit(False)) & ~F.col("needs_review"))
    return out.withColumn("needs_review", F.col("needs_review") | F.col("flagged")).drop("stale")


def review_events(flagged: DataFrame, now: Column) -> DataFrame:
    """Audit rows of review_flags(), to be appended."""
    return flagged.where("flagged").select("project", "decision", F.lit("needs_review").alias("event"), now.alias("at"))


def evidence_basis(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answers: project, answer, kind, question_evidence, previous_basis (arrays of source ids). The basis of each: the question's evidence that is still there, else the previous basis, else for a fact all sources, else none."""
    all_ = sources.groupBy("project").agg(F.array_sort(F.collect_set("source_id")).alias("ids"))
    none = F.array().cast("array<string>")
    met = answers.join(all_, "project", "left").withColumn("ids", F.coalesce("ids", none))
    asked = F.array_sort(F.array_intersect(F.coalesce("question_evidence", none), F.col("ids")))
    before = F.array_sort(F.array_intersect(F.coalesce("previous_basis", none), F.col("ids")))
    basis = F.when(F.size(asked) > 0, asked).when(F.size(before) > 0, before).when(F.col("kind") == "fact", F.col("ids")).otherwise(none)
    return met.select("project", "answer", basis.alias("basis"))


def suppressed_topics(questions: DataFrame, decisions: DataFrame) -> DataFrame:
    """questions: project, snapshot, current_snapshot, topic, status, decision; decisions: project, decision, active, needs_review. Topics that mustn't be asked again: pending, dismissed for the current snapshot, or answered by an active decision that isn't flagged."""
    met = questions.join(decisions.select("project", "decision", "active", "needs_review"), ["project", "decision"], "left")
    answered = (F.col("status") == "answered") & F.coalesce(F.col("active") & ~F.col("needs_review"), F.lit(False))
    dismissed = (F.col("status") == "dismissed") & (F.col("snapshot") == F.col("current_snapshot"))
    return met.where((F.col("status") == "pending") | dismissed | answered).select("project", "topic").distinct()


def closed_cards(questions: DataFrame, restored: DataFrame) -> DataFrame:
    """questions with the pending cards of a restored answer's project, snapshot and topic answered by it; restored: question, decision."""
    origin = questions.join(restored.withColumnRenamed("decision", "_decision"), "question").select("project", "snapshot", "topic", F.col("_decision"))
    one = origin.groupBy("project", "snapshot", "topic").agg(F.min("_decision").alias("_decision"))
    met = questions.join(one, ["project", "snapshot", "topic"], "left")
    close = (F.col("status") == "pending") & F.col("_decision").isNotNull()
    return met.withColumn("decision", F.when(close, F.col("_decision")).otherwise(F.col("decision"))).withColumn("status", F.when(close, "answered").otherwise(F.col("status"))).drop("_decision")


def refresh_baseline(projects: DataFrame, versions: DataFrame, sources: DataFrame) -> DataFrame:
    """projects: project, snapshot, decisions_revision, draft; versions: version, snapshot, decisions_revision; sources: snapshot, source_id. Added and removed sources of projects whose draft is of another snapshot but of the same decisions."""
    old = versions.select(F.col("version").alias("draft"), F.col("snapshot").alias("old"), F.col("decisions_revision").alias("_r"))
    met = projects.join(old, "draft").where((F.col("snapshot") != F.col("old")) & (F.col("decisions_revision") == F.col("_r")))
    ids = sources.groupBy("snapshot").agg(F.collect_set("source_id").alias("ids"))
    none = F.array().cast("array<string>")
    met = met.join(ids, "snapshot", "left").join(ids.select(F.col("snapshot").alias("old"), F.col("ids").alias("before")), "old", "left")
    now, before = F.coalesce("ids", none), F.coalesce("before", none)
    return met.select("project", F.array_sort(F.array_except(now, before)).alias("added"), F.array_sort(F.array_except(before, now)).alias("removed"), F.array_sort(F.array_intersect(now, before)).alias("kept"))


def placed_results(results: DataFrame, projects: DataFrame) -> DataFrame:
    """results: project, version, decisions_revision, edited. Where a finished generation goes: superseded where decisions have moved on, a proposal beside a draft edited by hand, else the draft."""
    met = results.join(projects.select("project", F.col("decisions_revision").alias("_r"), "draft_edited"), "project")
    return met.select("project", "version", F.when(F.col("decisions_revision") != F.col("_r"), "superseded").when(F.col("draft_edited"), "proposal").otherwise("draft").alias("status"))


def generation_needed(projects: DataFrame) -> DataFrame:
    """projects: project, changed, draft. Those whose snapshot changed or that have no draft."""
    return projects.where(F.col("changed") | F.col("draft").isNull()).select("project")


def newer_events(versions: DataFrame, events: DataFrame) -> DataFrame:
    """versions with `stale`: a decision of their project was made after them."""
    last = events.groupBy("project").agg(F.max("at").alias("_last"))
    return versions.join(last, "project", "left").withColumn("stale", F.coalesce(F.col("_last") > F.col("created_at"), F.lit(False))).drop("_last")


def reusable_plans(plans: DataFrame, directions: DataFrame, events: DataFrame) -> DataFrame:
    """plans: project, direction (null where it wasn't saved), created_at. A saved plan is used again where its direction is the current one, or, without one, where no decision came since."""
    met = newer_events(plans, events).join(directions.withColumnRenamed("direction", "_now"), "project", "left")
    return met.withColumn("reuse", F.when(F.col("direction").isNotNull(), F.col("direction").eqNullSafe(F.col("_now"))).otherwise(~F.col("stale"))).drop("stale", "_now")


def direction_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new: project, key, pos, value. Added, removed and updated directions, in the old order, then the new one's."""
    a, b = old.select("project", "key", F.col("pos").alias("_a"), F.col("value").alias("before")), new.select("project", "key", F.col("pos").alias("_b"), F.col("value").alias("after"))
    met = a.join(b, ["project", "key"], "full").where(~F.col("before").eqNullSafe(F.col("after")) | F.col("_a").isNull() | F.col("_b").isNull())
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("updated")
    place = F.row_number().over(Window.partitionBy("project").orderBy(F.col("_a").isNull(), "_a", "_b", "key"))
    return met.select("project", "key", change.alias("change"), "before", "after", place.cast("long").alias("place"))


def publish_gate(requests: DataFrame, projects: DataFrame, versions: DataFrame, jobs: DataFrame, decisions: DataFrame) -> DataFrame:
    """requests: project, revision, version (null: withdraw). Why each publication is refused (null: it isn't). First the revision, then a job that isn't an evaluation, then the draft, then its decisions."""
    busy = jobs.where(F.col("status").isin(*ACTIVE) & (F.col("kind") != "evaluate")).select("project").distinct().withColumn("_busy", F.lit(True))
    flagged = decisions.where("active and needs_review").select("project").distinct().withColumn("_flagged", F.lit(True))
    met = requests.join(projects.select("project", F.col("revision").alias("_revision"), "draft", "decisions_revision"), "project", "left")
    met = met.join(busy, "project", "left").join(flagged, "project", "left").join(versions.select("project", "version", F.col("decisions_revision").alias("_r")), ["project", "version"], "left")
    why = (
        F.when(F.col("_revision").isNull(), "unknown project")
        .when(F.col("revision") != F.col("_revision"), "stale revision")
        .when(F.col("_busy"), "update running")
        .when(F.col("version").isNull(), F.lit(None))
        .when(~F.col("version").eqNullSafe(F.col("draft")), "not the current draft")
        .when(~F.col("_r").eqNullSafe(F.col("decisions_revision")) | F.col("_flagged").isNotNull(), "answers to resolve")
    )
    return met.select("project", "version", why.alias("refused"))


def published(projects: DataFrame, allowed: DataFrame, now: Column) -> DataFrame:
    """projects after the publications of publish_gate() that nothing refuses."""
    ok = allowed.where("refused is null").select("project", F.col("version").alias("_version"), F.lit(True).alias("_ok"))
    met = projects.join(ok, "project", "left")
    new = lambda value, old: F.when(F.col("_ok"), value).otherwise(F.col(old)).alias(old)
    changed = {"published_version": F.col("_version"), "published_at": F.when(F.col("_version").isNotNull(), now), "revision": F.col("revision") + 1}
    return met.select(*(new(changed[c], c) if c in changed else F.col(c) for c in projects.columns))


def verified(published: DataFrame, found: DataFrame) -> DataFrame:
    """Whether the text at a site's address is the published one, but for white space around it."""
    trim = lambda c: F.regexp_replace(F.col(c), r"^\s+|\s+$", "")
    return published.join(found, "project", "left").select("project", F.coalesce(trim("markdown") == trim("body"), F.lit(False)).alias("verified"))


def accept_gate(requests: DataFrame, projects: DataFrame, proposals: DataFrame) -> DataFrame:
    """requests: project, revision, version. A proposal is accepted at the current revision, while it is pending, of the current snapshot and decisions."""
    met = requests.join(projects.select("project", F.col("revision").alias("_revision"), F.col("snapshot").alias("_snapshot"), F.col("decisions_revision").alias("_r")), "project").join(proposals, ["project", "version"], "left")
    why = F.when(F.col("revision") != F.col("_revision"), "stale revision").when(~F.coalesce(F.col("status") == "proposal", F.lit(False)), "no such proposal").when((F.col("snapshot") != F.col("_snapshot")) | (F.col("decisions_revision") != F.col("_r")), "superseded")
    return met.select("project", "version", why.alias("refused"))


def edited(projects: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edits: project, edit, revision, kind (save, dismiss, use, document, more). One edit a project and revision is accepted, the first; save, dismiss and use also raise the decisions' revision. Projects after them, and every edit with `accepted`."""
    met = edits.join(projects.select("project", F.col("revision").alias("_r")), "project", "left")
    first = F.row_number().over(Window.partitionBy("project", "revision").orderBy("edit")) == 1
    told = met.withColumn("accepted", F.coalesce(F.col("revision") == F.col("_r"), F.lit(False)) & first).drop("_r")
    done = told.where("accepted").groupBy("project").agg(F.lit(1).alias("_one"), F.count_if(F.col("kind").isin("save", "dismiss", "use")).alias("_d"), F.bool_or(F.col("kind") == "document").alias("_hand"))
    after = projects.join(done, "project", "left")
    changed = {"revision": F.col("revision") + F.coalesce("_one", F.lit(0)), "decisions_revision": F.col("decisions_revision") + F.coalesce("_d", F.lit(0)), "draft_edited": F.col("draft_edited") | F.coalesce("_hand", F.lit(False))}
    return after.select(*((changed[c] if c in changed else F.col(c)).alias(c) for c in projects.columns)), told


def guide_transition(guides: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: guide, action (cancel, resume, create). guides with `auto_cancelled` after them; resuming what isn't cancelled and creating what exists change nothing and are told."""
    met = guides.join(requests, "guide", "full")
    there = F.col("auto_cancelled").isNotNull()
    result = F.when(F.col("action").isNull(), "unchanged").when((F.col("action") == "create") & there, "exists").when(F.col("action") == "create", "created").when(~there, "unknown guide").when((F.col("action") == "resume") & ~F.col("auto_cancelled"), "not cancelled").otherwise(F.concat("action", F.when(F.col("action") == "cancel", "led").otherwise("d")))
    after = F.when((F.col("action") == "cancel") & there, True).when((F.col("action") == "resume") & there, False).when(F.col("action") == "create", F.coalesce("auto_cancelled", F.lit(False))).otherwise(F.col("auto_cancelled"))
    return met.select("guide", after.alias("auto_cancelled"), result.alias("result"))


def model_cache(requests: DataFrame, cache: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """requests: request, payload (struct); cache: key, result, valid, created_at. Hits are exact by the hash of the request, at most `days` old and valid still."""
    met = requests.withColumn("key", fingerprint(F.col("payload"))).join(cache, "key", "left")
    hit = F.col("created_at").isNotNull() & (F.col("created_at") > now - F.make_dt_interval(days=F.lit(days))) & F.col("valid")
    return met.select("request", "key", F.coalesce(hit, F.lit(False)).alias("hit"), F.when(hit, F.col("result")).alias("result"))
