"""Grades of saved runs: routing, answers, generations, dialogues, reader trials; and their summaries.

Every grade is an expression over a row, so a run of any size is one pass;
patterns are regular expressions that ignore case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteatlas.functions.text import folded, has_pattern, has_phrase, quote_matches, word_count

_STRINGS = "array<string>"


def _listed(xs: Column, empty: str = _STRINGS) -> Column:
    return F.coalesce(xs, F.array().cast(empty))


def routing() -> Column:
    """Of a row (urls returned, gold, candidates, visible: gold within the budget): top1, top3, reciprocal_rank, invalid, abstained, gold_visible, passed."""
    urls, gold = _listed(F.col("urls")), _listed(F.col("gold"))
    first = F.slice(urls, 1, 3)
    at = F.array_min(F.array_compact(F.transform(first, lambda u, i: F.when(F.array_contains(gold, u), i + 1))))
    invalid = F.size(F.array_except(urls, F.col("candidates"))) > 0
    none = (F.size(gold) == 0) & (F.size(urls) == 0)
    return F.struct(
        (F.coalesce(at, F.lit(0)) == 1).alias("top1"),
        at.isNotNull().alias("top3"),
        F.coalesce(1 / at, F.lit(0.0)).alias("reciprocal_rank"),
        invalid.alias("invalid"),
        (F.size(urls) == 0).alias("abstained"),
        F.when(F.size(gold) > 0, F.arrays_overlap(gold, F.col("visible"))).alias("gold_visible"),
        ((at.isNotNull() | none) & ~invalid).alias("passed"),
    )


def routing_summary(graded: DataFrame, *by: str) -> DataFrame:
    g = "grade."
    n = lambda test: F.count_if(test)
    return graded.groupBy(*by).agg(
        F.count("*").alias("tasks"), n(F.col(g + "passed")).alias("passed"), n(F.col(g + "top1")).alias("top1"), n(F.col(g + "top3")).alias("top3"),
        n(~F.coalesce(g + "gold_visible", F.lit(True))).alias("gold_outside_budget"), F.round(F.avg(g + "reciprocal_rank"), 6).alias("mrr"),
    )


def citations(answers: DataFrame, pages: DataFrame) -> DataFrame:
    """answers: answer_id, citations (array of url, quote); pages: answer_id, url, content, what the reader opened. Rows answer_id, cited (array of url, quote, valid): a quote is valid where its page was opened and holds it."""
    each = answers.select("answer_id", F.posexplode_outer("citations").alias("pos", "c")).select("answer_id", "pos", "c.url", "c.quote")
    met = each.join(pages, ["answer_id", "url"], "left")
    ok = F.coalesce((folded(F.col("quote")) != "") & quote_matches(F.col("quote"), F.col("content")), F.lit(False))
    one = F.when(F.col("pos").isNotNull(), F.struct("pos", "url", "quote", ok.alias("valid")))
    return met.groupBy("answer_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["url"].alias("url"), x["quote"].alias("quote"), x["valid"].alias("valid"))).alias("cited"))


def answer() -> Column:
    """Of a row (answer, action, expect_abstain, facts: array of id, answer_patterns, quote_patterns, evidence_urls; forbidden: patterns; cited): correct, grounded, abstained, errors, facts."""
    text, facts, cited = F.coalesce("answer", F.lit("")), F.col("facts"), F.col("cited")
    abstained = F.coalesce(F.col("action") == "abstain", F.lit(False))
    said = lambda f: F.forall(f["answer_patterns"], lambda p: has_pattern(text, p))
    proven = lambda f: F.exists(cited, lambda c: c["valid"] & F.array_contains(f["evidence_urls"], c["url"]) & F.forall(f["quote_patterns"], lambda p: has_pattern(c["quote"], p)))
    told = F.transform(facts, lambda f: F.struct(f["id"].alias("id"), said(f).alias("answer_present"), proven(f).alias("citation_supported")))
    bad = F.exists(_listed(F.col("forbidden")), lambda p: has_pattern(text, p))
    errors = F.size(F.filter(cited, lambda c: ~c["valid"]))
    correct = F.when(F.col("expect_abstain"), abstained & (text != "") & ~bad).otherwise(~abstained & (F.size(facts) > 0) & F.forall(facts, said) & ~bad)
    grounded = correct & (errors == 0) & (F.col("expect_abstain") | F.forall(facts, proven))
    return F.struct(correct.alias("correct"), grounded.alias("grounded"), abstained.alias("abstained"), errors.alias("errors"), told.alias("facts"))


def answer_summary(graded: DataFrame) -> DataFrame:
    """By arm: attempts, correct, grounded, abstained, and sums of the model calls' tokens (usage: array of input_tokens, output_tokens)."""
    add = lambda f: F.aggregate("usage", F.lit(0).cast("long"), lambda a, x: a + x[f])
    n = lambda c: F.count_if(F.col(f"grade.{c}"))
    return graded.groupBy("arm").agg(F.count("*").alias("attempts"), n("correct").alias("correct"), n("grounded").alias("grounded"), n("abstained").alias("abstained"), F.sum(add("input_tokens")).alias("input_tokens"), F.sum(add("output_tokens")).alias("output_tokens"))


def generation() -> Column:
    """Failures of a row (violations: of the rules; document, links: array of section, source_id, label, description; questions: array of question; claims: array of text, evidence_ids; expected: struct)."""
    e, links, doc = F.col("expected"), F.col("links"), F.coalesce("document", F.lit(""))
    ids = F.transform(links, lambda x: x["source_id"])
    made = F.col("document").isNotNull()
    wrong = lambda test, what: F.when(F.coalesce(test, F.lit(False)), F.lit(what))
    each = lambda xs, test, what: F.transform(F.filter(_listed(xs), test), lambda x: F.concat(F.lit(what + ": "), x))
    qualified = lambda q: F.exists(links, lambda x: (x["source_id"] == q["source_id"]) & ~has_pattern(F.concat_ws(" ", x["section"], x["label"], F.coalesce(x["description"], F.lit(""))), q["pattern"]))
    n = F.size("questions")
    single = F.array(
        wrong(e["first_source"].isNotNull() & ~F.get(ids, F.lit(0)).eqNullSafe(e["first_source"]), "audience order"),
        wrong(n < F.coalesce(e["min_questions"], F.lit(0)), "question missing"),
        wrong(n > F.coalesce(e["max_questions"], F.col("max_questions")), "too many questions"),
        wrong(made & (F.size(links) > F.coalesce(e["max_links"], F.lit(10_000))), "link budget"),
        wrong(made & (word_count(doc) > F.coalesce(e["max_words"], F.lit(100_000))), "word budget"),
        wrong(made & ~has_pattern(doc, e["document_pattern"]), "document requirement"),
        wrong(made & F.exists(F.coalesce(e["qualified"], F.array().cast("array<struct<source_id:string,pattern:string>>")), qualified), "qualifier missing"),
        wrong(made & e["claim"].isNotNull() & ~F.exists("claims", lambda c: F.contains(c["text"], e["claim"]["text"]) & F.array_contains(c["evidence_ids"], e["claim"]["evidence_id"])), "claim without provenance"),
        wrong(e["question_pattern"].isNotNull() & ~F.exists("questions", lambda q: has_pattern(q["question"], e["question_pattern"])), "ambiguity not asked"),
    )
    several = F.concat(
        F.transform(F.col("violations"), lambda v: F.concat(F.lit("rule: "), v)),
        each(e["include"], lambda x: ~F.array_contains(ids, x), "missing resource"),
        each(e["exclude"], lambda x: F.array_contains(ids, x), "unwanted resource"),
        each(e["forbidden"], lambda x: has_phrase(doc, x), "forbidden text"),
    )
    return F.concat(several, F.array_compact(single))


def dialogue() -> Column:
    """Failures of a stage (stage, ambiguity_pattern, expect_question, questions: array of question, options, rationale, recommended; document, links, claims; expected: include, exclude, document_pattern, kind, removed_forbidden)."""
    e, doc = F.col("expected"), F.coalesce("document", F.lit(""))
    match = F.filter("questions", lambda q: has_pattern(q["question"], F.col("ambiguity_pattern")))
    asked, q = F.coalesce(F.size(match), F.lit(0)) > 0, F.get(match, F.lit(0))
    wrong = lambda test, what: F.when(F.coalesce(test, F.lit(False)), F.lit(what))
    first = F.col("stage") == "first"
    options = F.transform(q["options"], folded)
    ids = F.col("links")
    each = lambda xs, test, what: F.transform(F.filter(_listed(xs), test), lambda x: F.concat(F.lit(what + ": "), x))
    single = F.array(
        wrong(first & F.col("expect_question") & ~asked, "question missing"),
        wrong(first & ~F.col("expect_question") & (F.size("questions") > 0), "needless question"),
        wrong(first & asked & q["recommended"].isNull(), "no recommendation"),
        wrong(first & asked & (F.size(F.array_distinct(options)) != F.size(options)), "repeated options"),
        wrong(first & asked & (word_count(q["rationale"]) < 6), "terse rationale"),
        wrong(F.col("stage").isin("recommended", "alternative", "custom", "dismissed", "more") & asked, "asked again"),
        wrong(~has_pattern(doc, e["document_pattern"]), "answer not in document"),
        wrong((e["kind"] == "fact") & ~F.exists("claims", lambda c: has_pattern(c["text"], e["document_pattern"]) & F.array_contains(c["evidence_ids"], "answer")), "fact without provenance"),
        wrong((F.col("stage") == "removed") & has_pattern(doc, e["removed_forbidden"]), "removed fact persists"),
    )
    return F.concat(each(e["include"], lambda x: ~F.array_contains(ids, x), "missing resource"), each(e["exclude"], lambda x: F.array_contains(ids, x), "resource retained"), F.array_compact(single))


def branches(cases: DataFrame) -> DataFrame:
    """cases: case_id, expect_question, has_custom. One row for each stage that a case is run through, in order."""
    more = F.when(F.col("expect_question"), F.array(*map(F.lit, ("recommended", "alternative", "dismissed", "more")))).otherwise(F.array().cast(_STRINGS))
    own = F.when(F.col("has_custom"), F.array(F.lit("custom"), F.lit("removed"))).otherwise(F.array().cast(_STRINGS))
    return cases.select("case_id", F.posexplode(F.concat(F.array(F.lit("first")), more, own)).alias("pos", "stage"))


def trials(runs: DataFrame, opened: DataFrame) -> DataFrame:
    """runs: trial, action (null: no final answer), answer, expected_url, citations (array of url, passage_id); opened: trial, url, passage_id. Rows trial, outcome, expected_reached, expected_cited, verified (citations)."""
    each = runs.select("trial", "expected_url", F.explode("citations").alias("c")).select("trial", "expected_url", "c.url", "c.passage_id")
    there = opened.select("trial", "url", "passage_id").distinct().withColumn("_there", F.lit(True))
    met = each.join(there, ["trial", "url", "passage_id"], "left").groupBy("trial").agg(F.count("*").alias("cited"), F.count("_there").alias("verified"), F.bool_or(F.col("_there").isNotNull() & (F.col("url") == F.col("expected_url"))).alias("_hit"))
    reached = opened.select("trial", F.col("url").alias("expected_url")).distinct().withColumn("_reached", F.lit(True))
    out = runs.join(met, "trial", "left").join(reached, ["trial", "expected_url"], "left")
    expected = F.col("expected_url").isNotNull()
    hit = F.coalesce("_hit", F.lit(False))
    proven = F.coalesce((F.col("cited") > 0) & (F.col("cited") == F.col("verified")), F.lit(False)) & (F.trim(F.coalesce("answer", F.lit(""))) != "") & (~expected | hit)
    outcome = F.when(F.col("action").isNull() | (F.col("action") == "abstain"), "abstained").when(proven & expected, "evidence_matched").when(proven, "citations_verified").otherwise("needs_review")
    return out.select("trial", outcome.alias("outcome"), F.when(expected, F.col("_reached").isNotNull()).alias("expected_reached"), F.when(expected, hit).alias("expected_cited"), F.coalesce("verified", F.lit(0)).alias("verified"))


def strings_of(rows: DataFrame, key: str, json: str) -> DataFrame:
    """rows: key, json (any JSON as text). Rows key, path, text: every string in it, names of fields left out. Objects and arrays are taken apart a level at a time."""
    level = rows.select(key, F.lit("$").alias("path"), F.try_parse_json(F.col(json)).alias("v")).where("v is not null")
    kind = F.schema_of_variant(F.col("v"))
    found = None
    while True:
        here = level.where(kind == "STRING").select(key, "path", F.col("v").cast("string").alias("text"))
        found = here if found is None else found.unionByName(here)
        nested = level.where(kind.rlike("^(ARRAY|OBJECT)<."))
        if nested.isEmpty():
            return found
        inner = nested.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()))
        level = inner.select(key, F.concat("path", F.coalesce(F.concat(F.lit("."), inner["key"]), F.concat(F.lit("["), inner["pos"].cast("string"), F.lit("]")))).alias("path"), F.col("value").alias("v"))


def anchored(reviews: DataFrame) -> DataFrame:
    """reviews: review, payload (any JSON as text), quotes. With invalid: quotes that no string of the payload holds."""
    asked = reviews.select("review", F.explode("quotes").alias("quote")).distinct()
    held = strings_of(reviews, "review", "payload").select("review", "text")
    there = asked.join(held, "review").where(F.contains("text", F.col("quote"))).groupBy("review").agg(F.collect_set("quote").alias("_there"))
    none = F.array().cast(_STRINGS)
    return reviews.join(there, "review", "left").withColumn("invalid", F.filter(F.coalesce("quotes", none), lambda q: ~F.array_contains(F.coalesce("_there", none), q))).drop("_there")


def replayed_reads(steps: DataFrame, entries: DataFrame, pages: DataFrame, links: DataFrame, max_opens: int = 3) -> tuple[DataFrame, DataFrame]:
    """A reader's recorded steps run again: steps: trial, step (from 0), action, url; entries: trial, url (links of what was shown first); pages: url, kind (guide or source); links: url, link (of guides).

    Rows trial, step, url, result of each page that was asked for before the first other action: a
    reader may only open what was linked so far, a guide that is opened shows its links, and after max_opens pages asking for another
    ends the trial. And rows trial, outcome, opens: the action that ended it, exhausted, or none.
    """
    end = steps.where("action <> 'open'").groupBy("trial").agg(F.min("step").alias("end"))
    told = steps.join(end, "trial", "left").where((F.col("end").isNull() | (F.col("step") <= F.col("end"))) & (F.col("step") <= max_opens))
    allowed = entries.select("trial", "url").distinct()
    asked = told.where("action = 'open'").select("trial", "step", "url")
    reads = None
    for k in range(max_opens):
        here = asked.where(F.col("step") == k).join(allowed.distinct().withColumn("_linked", F.lit(True)), ["trial", "url"], "left").join(pages.select("url", "kind"), "url", "left")
        result = F.when(F.col("_linked").isNull(), "refused: not linked").when(F.col("kind").isNull(), "refused: not captured").when(F.col("kind") == "guide", "guide").otherwise("source")
        here = here.select("trial", "step", "url", result.alias("result"))
        reads = here if reads is None else reads.unionByName(here)
        shown = here.where("result = 'guide'").join(links, "url").select("trial", F.col("link").alias("url"))
        allowed = allowed.unionByName(shown)
    last = told.where(F.col("step") == F.col("end")).select("trial", F.col("action").alias("_last"))
    spent = asked.where(F.col("step") == max_opens).select("trial").distinct().withColumn("_spent", F.lit(True))
    opens = asked.where(F.col("step") < max_opens).groupBy("trial").agg(F.count("*").alias("opens"))
    trials_ = steps.select("trial").distinct().join(last, "trial", "left").join(spent, "trial", "left").join(opens, "trial", "left")
    outcome = F.when(F.col("_spent"), "exhausted").otherwise(F.coalesce("_last", F.lit("none")))
    return reads, trials_.select("trial", outcome.alias("outcome"), F.coalesce("opens", F.lit(0)).alias("opens"))


def review_status(reviews: DataFrame, labels: DataFrame) -> DataFrame:
    """reviews: id, issues, invalid_anchors; labels: id, has_known_defect. One row: reviewed, with_issues, invalid_anchors, and of the labelled ones how many verdicts are right."""
    met = reviews.join(labels, "id", "left")
    right = (F.col("issues") > 0) == F.col("has_known_defect")
    return met.agg(F.count("*").alias("reviewed"), F.count_if(F.col("issues") > 0).alias("with_issues"), F.coalesce(F.sum("invalid_anchors"), F.lit(0)).alias("invalid_anchors"), F.count("has_known_defect").alias("judged"), F.count_if(right).alias("judge_right"))


def set_coverage(rows: DataFrame, key: str) -> DataFrame:
    """rows: key, wanted, have (arrays). matched, total, ratio (null where nothing is wanted), missing in order."""
    wanted = F.array_distinct("wanted")
    matched = F.size(F.array_intersect(wanted, F.col("have")))
    return rows.select(key, matched.alias("matched"), F.size(wanted).alias("total"), F.round(F.try_divide(matched, F.size(wanted)), 6).alias("ratio"), F.array_sort(F.array_except(wanted, F.col("have"))).alias("missing"))


def micro_average(covered: DataFrame) -> DataFrame:
    """One ratio of all cases: sums, not a mean of ratios."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return covered.agg(s("matched").alias("matched"), s("total").alias("total"), F.round(F.try_divide(s("matched"), s("total")), 6).alias("ratio"))


def regraded(saved: DataFrame, grade: Column, inputs: DataFrame) -> DataFrame:
    """Saved rows (case_id, input_hash, grade as `was`) graded again beside the old grade; a row whose input has another hash by now is told, not graded."""
    met = saved.join(inputs.select("case_id", F.col("input_hash").alias("_hash")), "case_id", "left")
    same = F.coalesce(F.col("input_hash") == F.col("_hash"), F.lit(False))
    return met.withColumn("mismatch", ~same).withColumn("grade", F.when(same, grade)).drop("_hash")


def gold_links(tasks: DataFrame, links: DataFrame) -> DataFrame:
    """tasks: task, file, pattern; links: file, url. Rows task, acceptable: the file's links that the pattern finds."""
    met = tasks.join(links, "file", "left").where(F.coalesce(F.regexp_like("url", F.col("pattern")), F.lit(False)))
    found = met.groupBy("task").agg(F.array_sort(F.collect_set("url")).alias("acceptable"))
    return tasks.select("task").join(found, "task", "left").withColumn("acceptable", F.coalesce("acceptable", F.array().cast(_STRINGS)))


METRICS = {"crawl_important_coverage": ("important", "usable"), "generated_important_coverage": ("important", "linked"), "generated_usable_source_coverage": ("usable", "linked"), "generated_link_precision": ("linked", "usable")}


def end_to_end(important: DataFrame, usable: DataFrame, linked: DataFrame) -> DataFrame:
    """All three: site, url. Rows site, metric, matched, total, ratio of the four shares of one set that another one holds; a site without any of them has no row."""
    sets = {"important": important, "usable": usable, "linked": linked}
    rows = None
    for name, df in sets.items():
        own = df.select("site", "url").distinct().withColumn("what", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    held = rows.groupBy("site", "url").agg(F.collect_set("what").alias("sets"))
    of = lambda a, b: F.count_if(F.array_contains("sets", a) & F.array_contains("sets", b))
    counts = held.groupBy("site").agg(*(of(a, x).alias(f"{m}_{k}") for m, (a, b) in METRICS.items() for k, x in (("matched", b), ("total", a))))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}_matched").alias("matched"), F.col(f"{m}_total").alias("total")) for m in METRICS)))
    return counts.select("site", each.alias("m")).select("site", "m.*", F.round(F.try_divide("m.matched", "m.total"), 6).alias("ratio"))
