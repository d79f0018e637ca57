"""Queries of rankings, grades, validation and run summaries, and DuckDB SQL written apart from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.functions import text
from siteatlas.operators import grading, validation
from siteatlas.operators.quotes import matched_quotes
from siteatlas.operators.ranking import bm25, nth_row, placed
from siteatlas.plans.catalogue import _BM25
from siteatlas.plans.site import flat, query

_TRIALS = "select l_returnflag as category, l_linestatus as split, l_shipmode as kind, l_orderkey as case_id, l_quantity as took, l_discount < 0.09 as passed, l_linenumber * 10 as input_tokens from lineitem".replace("l_shipmode", "cast(l_linenumber % 3 as string)")


def _summary(trials: DataFrame, *by: str) -> DataFrame:
    """Attempts, passed, cases, cases that pass every repeat, token sums and the median, by one or more columns."""
    each = trials.groupBy(*by, "case_id").agg(F.count("*").alias("n"), F.count_if("passed").alias("ok"), F.sum("input_tokens").alias("tokens"))
    counts = each.groupBy(*by).agg(F.sum("n").alias("attempts"), F.sum("ok").alias("passed"), F.count("*").alias("cases"), F.count_if(F.col("n") == F.col("ok")).alias("consistent"), F.sum("tokens").alias("input_tokens"))
    took = trials.groupBy(*by, "took").agg(F.count("*").alias("f")).groupBy(*by).agg(F.round(F.percentile("took", 0.5, F.col("f")), 6).alias("median_took"))
    return counts.join(took, list(by)) if by else counts.crossJoin(took)  # one row each


@query("run_summary", f""", t as ({_TRIALS}), c as (select case_id, bool_and(passed) as ok from t group by 1), o as (select took, row_number() over (order by took) as k, count(*) over () as n from t)
select count(*) as attempts, count(*) filter (where passed) as passed, count(distinct case_id) as cases, (select count(*) from c where ok) as consistent, sum(input_tokens)::bigint as input_tokens, round(median(took), 6) as median_took, (select min(took) from o where k = least(n - 1, cast(floor(n * 0.95) as bigint)) + 1) as p95_took from t""")
def run_summary(q):
    t = q(_TRIALS)
    return _summary(t).crossJoin(nth_row(t, "took", 0.95).withColumnRenamed("took", "p95_took"))  # one row each


@query("run_summary_groups", f""", t as ({_TRIALS}), g as (select 'category' as dim, category as value, * from t union all select 'split', split, * from t union all select 'kind', kind, * from t), c as (select dim, value, case_id, bool_and(passed) as ok from g group by 1, 2, 3)
select dim, value, count(*) as attempts, count(*) filter (where passed) as passed, count(distinct case_id) as cases, (select count(*) from c where c.dim = g.dim and c.value = g.value and ok) as consistent, sum(input_tokens)::bigint as input_tokens, round(median(took), 6) as median_took from g group by dim, value""")
def run_summary_groups(q):
    t = q(_TRIALS)
    out = [_summary(t, c).withColumn("dim", F.lit(c)).withColumnRenamed(c, "value") for c in ("category", "split", "kind")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("round_robin_limit", "select doc_id, source from (select doc_id, source, row_number() over (partition by source order by doc_id) as k from documents) order by k, source limit 50")
def round_robin_limit(q):
    """No source gives more than the limit, so that much is all that is sorted of each."""
    k = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return q("select doc_id, source from documents").withColumn("k", k).where("k <= 50").orderBy("k", "source").limit(50).select("doc_id", "source")


@query("even_sample", "with r as (select doc_id, source, row_number() over (partition by source order by doc_id) - 1 as k, count(*) over (partition by source) as n from documents) select distinct r.doc_id, r.source from r join (select range as i from range(12)) t on i < least(12, n) and r.k = i * n // least(12, n)".replace("with r as", ", r as", 1))
def even_sample(q):
    r = placed(q("select doc_id, source from documents"), "source", "doc_id")
    c = F.least(F.lit(12), "n")
    wanted = F.transform(F.sequence(F.lit(0).cast("long"), c - 1), lambda i: F.floor(i * F.col("n") / c))
    return r.where(F.array_contains(wanted, F.col("place"))).select("doc_id", "source")


@query("quote_match", "select b.item_id, count(d.doc_id) as n_docs, coalesce(min(d.doc_id), -1) as first_doc from (select item_id, text from benchmark union all select item_id + 1000, substr(text, 2, 18) from benchmark) b left join documents d on contains(d.text, b.text) group by 1")
def quote_match(q):
    quotes = q("select item_id, text as quote from benchmark union all select item_id + 1000, substr(text, 2, 18) from benchmark")
    met = matched_quotes(quotes, q("select doc_id, text from documents"), "item_id", "doc_id")
    n = met.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return quotes.join(n, "item_id", "left").select("item_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("first_doc", F.lit(-1)).alias("first_doc"))


@query("bm25_urls", ", " + _BM25.removeprefix("with ") + ", u as (select query_id, doc_id, score, row_number() over (partition by query_id, doc_id % 97 order by score desc, doc_id) as k from sc where score > 0) select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from u where k = 1) where rank <= 3")
def bm25_urls(q):
    """The best document of each URL, then the best three URLs."""
    docs = q("select doc_id, text, concat('https://x/', cast(doc_id % 97 as string)) as url from documents")
    return bm25(q("select item_id as query_id, text from benchmark"), docs, url="url").select("query_id", "doc_id", "score", "rank")


_FIRST = "list_filter([1, 2, 3], lambda i: i <= len(urls) and list_contains(gold, urls[i]))"
_GRADES = f""", g as (select task, category, list_min({_FIRST}) as spot, len(list_filter(urls, lambda u: not list_contains(candidates, u))) > 0 as invalid, len(urls) = 0 as abstained, len(gold) = 0 as free, case when len(gold) > 0 then list_has_any(gold, visible) end as gold_visible from tasks),
k as (select task, category, coalesce(spot, 0) = 1 as top1, spot is not null as top3, round(coalesce(1.0 / spot, 0), 6) as rr, invalid, abstained, gold_visible, (spot is not null or free and abstained) and not invalid as passed from g)"""


@query("routing_grades", _GRADES + " select task, top1, top3, rr, invalid, abstained, coalesce(gold_visible::varchar, '') as gold_visible, passed from k")
def routing_grades(q):
    g = q("tasks").select("task", grading.routing().alias("g"))
    return g.select("task", "g.top1", "g.top3", F.round("g.reciprocal_rank", 6).alias("rr"), "g.invalid", "g.abstained", F.coalesce(F.col("g.gold_visible").cast("string"), F.lit("")).alias("gold_visible"), "g.passed")


@query("routing_summary", _GRADES + " select category, count(*) as tasks, count(*) filter (where passed) as passed, count(*) filter (where top1) as top1, count(*) filter (where top3) as top3, count(*) filter (where not gold_visible) as gold_outside_budget, round(avg(rr), 4) as mrr from k group by 1")
def routing_summary(q):
    out = grading.routing_summary(q("tasks").withColumn("grade", grading.routing()), "category")
    return out.withColumn("mrr", F.round("mrr", 4))


@query("set_coverage", "select task, len(list_filter(list_distinct(gold), lambda x: list_contains(urls, x))) as matched, len(list_distinct(gold)) as total, coalesce(round(case when len(gold) > 0 then len(list_filter(list_distinct(gold), lambda x: list_contains(urls, x))) / len(list_distinct(gold)) end, 6), -1) as ratio, array_to_string(list_sort(list_filter(list_distinct(gold), lambda x: not list_contains(urls, x))), '|') as missing from tasks")
def set_coverage(q):
    c = grading.set_coverage(q("select task, gold as wanted, urls as have from tasks"), "task")
    return c.select("task", F.col("matched").cast("long").alias("matched"), F.col("total").cast("long").alias("total"), F.coalesce("ratio", F.lit(-1.0)).alias("ratio"), flat(F.col("missing")).alias("missing"))


@query("coverage_micro", "select sum(m)::bigint as matched, sum(n)::bigint as total, round(sum(m) / sum(n), 6) as ratio from (select len(list_filter(list_distinct(gold), lambda x: list_contains(urls, x))) as m, len(list_distinct(gold)) as n from tasks)")
def coverage_micro(q):
    return grading.micro_average(grading.set_coverage(q("select task, gold as wanted, urls as have from tasks"), "task"))


@query("trial_outcomes", """, v as (select c.trial, count(*) as n, count(*) filter (where exists (select 1 from opened o where o.trial = c.trial and o.url = c.url and o.passage_id = c.passage_id)) as ok, bool_or(c.url = t.expected_url and exists (select 1 from opened o where o.trial = c.trial and o.url = c.url and o.passage_id = c.passage_id)) as hit from cited c join trial_runs t on t.trial = c.trial group by 1)
select t.trial, case when action is null or action = 'abstain' then 'abstained' when n > 0 and n = ok and trim(answer) <> '' and (expected_url is null or hit) then case when expected_url is null then 'citations_verified' else 'evidence_matched' end else 'needs_review' end as outcome, coalesce(ok, 0) as verified, case when expected_url is null then '' else exists (select 1 from opened o where o.trial = t.trial and o.url = t.expected_url)::varchar end as reached from trial_runs t left join v on v.trial = t.trial""")
def trial_outcomes(q):
    cites = q("cited").groupBy("trial").agg(F.collect_list(F.struct("url", "passage_id")).alias("citations"))
    runs = q("trial_runs").join(cites, "trial", "left").withColumn("citations", F.coalesce("citations", F.array().cast("array<struct<url:string,passage_id:string>>")))
    return grading.trials(runs, q("opened")).select("trial", "outcome", "verified", F.coalesce(F.col("expected_reached").cast("string"), F.lit("")).alias("reached"))


#: Facts differ by row: one or two of them, with their own patterns and pages.
_FACTS = "transform(sequence(1, 1 + cast(answer_id % 2 as int)), k -> named_struct('id', concat('f', cast(k as string)), 'answer_patterns', array(case when k = 1 then concat('COSTS [', cast(answer_id % 3 as string), '-4]') else 'month$' end, 'euros?'), 'quote_patterns', array(case when k = 1 then '[a-z]' else '[a-m]' end), 'evidence_urls', array('u0', case when answer_id % 5 = 0 then 'u2' else 'u1' end)))"


def _answers(q):
    r = q("replies")
    cited = grading.citations(r.select("answer_id", F.array(F.struct("url", "quote")).alias("citations")), r.select("answer_id", "url", F.col("text").alias("content")))
    asked = r.withColumn("facts", F.expr(_FACTS)).withColumn("forbidden", F.array(F.lit("FREE"), F.lit("2 euros"))).withColumn("usage", F.array(F.struct(F.col("tokens").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"))))
    return asked.join(cited, "answer_id").withColumn("grade", grading.answer())


_REPLIES = """, v as (select answer_id, arm, tokens, action = 'abstain' as abstained, regexp_matches(answer, '2 euros') as bad, answer <> '' as said, expect_abstain, answer_id % 4 <> 1 and len(list_filter(list_transform(string_split_regex(quote, '\\.\\.\\.|…'), lambda x: replace(replace(replace(lower(trim(regexp_replace(x, '[ \\n\\t]+', ' ', 'g'))), 'ß', 'ss'), 'ſ', 's'), 'ς', 'σ')), lambda x: x <> '')) > 0 and len(list_filter(list_filter(list_transform(string_split_regex(quote, '\\.\\.\\.|…'), lambda x: replace(replace(replace(lower(trim(regexp_replace(x, '[ \\n\\t]+', ' ', 'g'))), 'ß', 'ss'), 'ſ', 's'), 'ς', 'σ')), lambda x: x <> ''), lambda x: length(x) < 8)) = 0 as valid, regexp_matches(answer, 'costs [' || (answer_id % 3) || '-4] euro') as fact, url in ('u0', case when answer_id % 5 = 0 then 'u2' else 'u1' end) as own, regexp_matches(lower(quote), case when answer_id % 2 = 1 then '[a-m]' else '[a-z]' end) as letters from replies),
g as (select *, case when expect_abstain then abstained and said and not bad else not abstained and fact and not bad end as correct from v), k as (select *, correct and valid and (expect_abstain or own and letters) as grounded from g)"""


@query("answer_grades", _REPLIES + " select answer_id, correct, grounded, abstained from k")
def answer_grades(q):
    return _answers(q).select("answer_id", "grade.correct", "grade.grounded", "grade.abstained")


@query("answer_summary", _REPLIES + " select arm, count(*) as attempts, count(*) filter (where correct) as correct, count(*) filter (where grounded) as grounded, count(*) filter (where abstained) as abstained, sum(tokens)::bigint as input_tokens, count(*) as output_tokens from k group by 1")
def answer_summary(q):
    return grading.answer_summary(_answers(q))


_RULES = """, e as (select *, list_transform(decisions, lambda d: d.id) as ids, list_transform(list_filter(decisions, lambda d: d.active), lambda d: d.id) as on_, list_transform(list_filter(decisions, lambda d: d.needs_review), lambda d: d.id) as bad, list_transform(questions, lambda x: x.topic) as topics, list_transform(shortcuts, lambda x: x.source_id) as marks from results),
b as (select id, (mode = 'generate') <> has_guide as v0, len(questions) > max_questions as v1, list_has_any(sources, ids) as v2, len(list_filter(list_transform(questions, lambda x: x.evidence_ids[1]), lambda x: not list_contains(sources || on_, x))) > 0 as v3, len(list_distinct(topics)) < len(topics) or list_has_any(topics, dismissed_topics) as v4, len(list_filter(questions, lambda x: x.recommended is not null and x.recommended >= len(x.options))) > 0 as v5,
has_guide and len(list_filter(flatten(list_transform(claims, lambda x: x.evidence_ids)), lambda x: not list_contains(sources || on_, x))) > 0 as v6, has_guide and list_has_any(flatten(list_transform(claims, lambda x: x.evidence_ids)), bad) as v7, has_guide and len(list_filter(links, lambda x: not list_contains(sources, x))) > 0 as v8, has_guide and len(list_distinct(links)) < len(links) as v9, has_guide and len(list_filter(marks, lambda x: not list_contains(links, x))) > 0 as v10, has_guide and len(list_distinct(marks)) < len(marks) as v11, has_guide and len(list_filter(flatten(list_transform(shortcuts, lambda x: x.decision_ids)), lambda x: not list_contains(on_, x))) > 0 as v12 from e)"""
_NAMES = "concat_ws('|', " + ", ".join(f"case when v{i} then '{n}' end" for i, n in enumerate(validation.RULES)) + ")"


@query("validation_violations", _RULES + f" select id, {_NAMES} as violations from b")
def validation_violations(q):
    return validation.validated(q("results")).select("id", flat(F.col("violations")).alias("violations"))


@query("repeated_ids", "select user_id, event_type, count(*) as n from events where event_id % 3 = 0 group by 1, 2 having count(*) > 1")
def repeated_ids(q):
    return validation.repeated_ids(q("select user_id, event_type from events where event_id % 3 = 0"), "event_type", "user_id")


_EXPECTED = "named_struct('include', array('s1'), 'exclude', array('s8'), 'forbidden', array('Never Mention'), 'first_source', 's0', 'min_questions', 1, 'max_questions', 2, 'max_links', 3, 'max_words', 5, 'document_pattern', 'region [0-2]', 'qualified', array(named_struct('source_id', 's0', 'pattern', 'archived')), 'claim', named_struct('text', 'day 1', 'evidence_id', 'd0'), 'question_pattern', 'region [13]', 'kind', 'fact', 'removed_forbidden', 'region 3')"


def _generated(q):
    r = validation.validated(q("results")).withColumn("ids", F.col("links")).withColumn("expected", F.expr(_EXPECTED))
    return r.withColumn("links", F.transform("links", lambda x: F.struct(F.lit("Pages").alias("section"), x.alias("source_id"), F.lit("label").alias("label"), F.when(F.col("id") % 2 == 0, "Archived copy").alias("description"))))


@query("generation_grades", _RULES + """, f as (select r.id, v0 or v1 or v2 or v3 or v4 or v5 or v6 or v7 or v8 or v9 or v10 or v11 or v12 as broken, not list_contains(links, 's1') as f1, list_contains(links, 's8') as f2, coalesce(contains(document, 'never mention'), false) as f3, document is not null and len(links) > 3 as f4, document is not null and len(list_filter(string_split_regex(document, '\\s+'), lambda x: x <> '')) > 5 as f5, document is not null and not regexp_matches(document, 'region [0-2]') as f6, document is not null and r.id % 2 = 1 as f7, document is not null and not (r.id % 10 = 1 and r.id % 11 not in (2, 3, 4)) as f8, r.id % 4 not in (1, 3) as f9 from results r join b on b.id = r.id)
select id, broken, f1::int + f2::int + f3::int + f4::int + f5::int + f6::int + f7::int + f8::int + f9::int as failures from f""")
def generation_grades(q):
    g = _generated(q).withColumn("f", grading.generation())
    return g.select("id", (F.size("violations") > 0).alias("broken"), (F.size("f") - F.size("violations")).alias("failures"))


@query("dialogue_grades")
def dialogue_grades(q):
    r = q("results").withColumn("expected", F.expr(_EXPECTED)).withColumn("ambiguity_pattern", F.lit("region [0-2]")).withColumn("expect_question", F.col("id") % 3 > 0)
    r = r.withColumn("stage", F.get(F.array(*map(F.lit, ("first", "recommended", "removed", "custom"))), (F.col("id") % 4).cast("int")))
    return r.select("id", "stage", flat(grading.dialogue()).alias("failures"))


@query("dialogue_branches", "select case_id, pos, stage from (select doc_id as case_id, unnest(s) as stage, unnest(range(len(s))) as pos from (select doc_id, ['first'] || case when doc_id % 2 = 0 then ['recommended', 'alternative', 'dismissed', 'more'] else [] end || case when doc_id % 3 = 0 then ['custom', 'removed'] else [] end as s from documents))")
def dialogue_branches(q):
    b = grading.branches(q("select doc_id as case_id, doc_id % 2 = 0 as expect_question, doc_id % 3 = 0 as has_custom from documents"))
    return b.select("case_id", F.col("pos").cast("long").alias("pos"), "stage")


@query("unique_projects", "select c_custkey as project, c_nationkey as nation from customer")
def unique_projects(q):
    """Identifiers that must be unique; a repeated one fails the query."""
    return validation.unique(q("select c_custkey as project, c_nationkey as nation from customer"), "project")


@query("study_report", _GRADES + """, r as (select * from reviews left join defects using (id))
select 'routing' as part, 'tasks' as name, count(*) as n from k union all select 'routing', 'passed', count(*) filter (where passed) from k union all select 'routing', 'top1', count(*) filter (where top1) from k union all select 'routing', 'top3', count(*) filter (where top3) from k
union all select 'reviews', 'reviewed', count(*) from r union all select 'reviews', 'with_issues', count(*) filter (where issues > 0) from r union all select 'reviews', 'invalid_anchors', sum(invalid_anchors)::bigint from r union all select 'reviews', 'judge_right', count(*) filter (where (issues > 0) = has_known_defect) from r
union all select 'runs', 'attempts', count(*) from runs union all select 'runs', 'suites', count(distinct suite) from runs""")
def study_report(q):
    """Totals of saved runs of every kind, as one table."""
    routed = grading.routing_summary(q("tasks").withColumn("all", F.lit(1)).withColumn("grade", grading.routing()), "all")
    reviewed = grading.review_status(q("reviews"), q("defects"))
    runs = q("runs").agg(F.count("*").alias("attempts"), F.countDistinct("suite").alias("suites"))
    out = None
    for part, df, names in (("routing", routed, ["tasks", "passed", "top1", "top3"]), ("reviews", reviewed, ["reviewed", "with_issues", "invalid_anchors", "judge_right"]), ("runs", runs, ["attempts", "suites"])):
        rows = df.select(F.explode(F.array(*(F.struct(F.lit(part).alias("part"), F.lit(n).alias("name"), F.col(n).cast("long").alias("n")) for n in names))).alias("x")).select("x.*")
        out = rows if out is None else out.unionByName(rows)
    return out


_ANCHORS = "select doc_id as review, lang, source, text, substr(text, 3, 12) as q1, case doc_id % 3 when 0 then lower(substr(text, 1, 9)) when 1 then substr(text, 1, 5) else concat(source, '.') end as q2 from documents where text is not null and length(text) > 20"


@query("anchored_quotes", f"select review, case when contains(text, q2) or contains(lang, q2) or contains(source, q2) then '' else q2 end as invalid from ({_ANCHORS})")
def anchored_quotes(q):
    r = q(f"select review, to_json(named_struct('b', named_struct('c', array(named_struct('t', text), named_struct('t', ''))), 'a', array(array(lang), array(source)))) as payload, array(q1, q2) as quotes from ({_ANCHORS})")
    return grading.anchored(r).select("review", flat(F.col("invalid")).alias("invalid"))


_WEB = """, s as (select conv_id as trial, turn as step, case when turn > 0 and turn % 4 = conv_id % 4 then case when conv_id % 2 = 0 then 'answer' else 'abstain' end else 'open' end as action, 'u' || (length(text) * 7 + turn) % 9 as url from (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as turn, text from conversations)),
p as (select 'u' || i as url, case when i < 3 then 'guide' else 'source' end as kind from range(8) r(i)), l as (select 'u' || i as url, 'u' || (i * 2 + 3 + k) as link from range(3) r(i), range(3) t(k)),
e as (select trial, min(step) filter (where action <> 'open') as fin from s group by 1),
t as (select s.* from s join e using (trial) where step <= coalesce(fin, step) and step <= 3),
a as (select distinct trial, unnest(['u0', 'u1', 'u2', 'u3']) as url from s),
r0 as (select t.trial, t.step, t.url, case when a.url is null then 'refused: not linked' when p.url is null then 'refused: not captured' else kind end as result from t left join a on a.trial = t.trial and a.url = t.url left join p on p.url = t.url where step = 0 and action = 'open'),
a1 as (select * from a union select trial, link from r0 join l on l.url = r0.url where result = 'guide'),
r1 as (select t.trial, t.step, t.url, case when a.url is null then 'refused: not linked' when p.url is null then 'refused: not captured' else kind end as result from t left join a1 a on a.trial = t.trial and a.url = t.url left join p on p.url = t.url where step = 1 and action = 'open'),
a2 as (select * from a1 union select trial, link from r1 join l on l.url = r1.url where result = 'guide'),
r2 as (select t.trial, t.step, t.url, case when a.url is null then 'refused: not linked' when p.url is null then 'refused: not captured' else kind end as result from t left join a2 a on a.trial = t.trial and a.url = t.url left join p on p.url = t.url where step = 2 and action = 'open')"""


def _replay(q):
    steps = q("select conv_id as trial, turn as step, case when turn > 0 and turn % 4 = conv_id % 4 then case when conv_id % 2 = 0 then 'answer' else 'abstain' end else 'open' end as action, concat('u', cast((length(text) * 7 + turn) % 9 as string)) as url from (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as turn, text from conversations)")
    entries = steps.select("trial", F.explode(F.array(*map(F.lit, ("u0", "u1", "u2", "u3")))).alias("url")).distinct()
    spark = steps.sparkSession
    name = lambda c: F.concat(F.lit("u"), c.cast("string"))
    pages = spark.range(8).select(name(F.col("id")).alias("url"), F.when(F.col("id") < 3, "guide").otherwise("source").alias("kind"))
    links = spark.range(9).select(F.floor(F.col("id") / 3).alias("i"), (F.col("id") % 3).alias("k")).select(name(F.col("i")).alias("url"), name(F.col("i") * 2 + 3 + F.col("k")).alias("link"))
    return grading.replayed_reads(steps, entries, pages, links)


@query("reader_replay", _WEB + " select * from r0 union all select * from r1 union all select * from r2")
def reader_replay(q):
    """Recorded steps run again: who may open what, after which guide."""
    return _replay(q)[0].select("trial", F.col("step").cast("long").alias("step"), "url", "result")


@query("reader_outcomes", _WEB + " select e.trial, case when exists (select 1 from t where t.trial = e.trial and step = 3 and action = 'open') then 'exhausted' else coalesce((select action from t where t.trial = e.trial and t.step = e.fin), 'none') end as outcome, (select count(*) from t where t.trial = e.trial and action = 'open' and step < 3) as opens from e")
def reader_outcomes(q):
    return _replay(q)[1]


@query("review_status", "select count(*) as reviewed, count(*) filter (where issues > 0) as with_issues, sum(invalid_anchors)::bigint as invalid_anchors, count(has_known_defect) as judged, count(*) filter (where (issues > 0) = has_known_defect) as judge_right from reviews left join defects using (id)")
def review_status(q):
    return grading.review_status(q("reviews"), q("defects"))


@query("gold_links", "select p.site * 10 + k as task, coalesce(string_agg(distinct url, '|' order by url) filter (where regexp_matches(url, case k when 0 then '/docs/' when 1 then 'p[0-9]$' else 'zzz' end)), '') as acceptable from site_pages p cross join (select unnest([0, 1, 2]) as k) group by 1")
def gold_links(q):
    tasks = q("select site * 10 + k as task, site as file, case k when 0 then '/docs/' when 1 then 'p[0-9]$' else 'zzz' end as pattern from site_roots cross join (select explode(array(0, 1, 2)) as k)")
    return grading.gold_links(tasks, q("select site as file, url from site_pages")).select("task", flat(F.col("acceptable")).alias("acceptable"))


@query("regraded_runs", _GRADES + " select task, task % 7 = 0 as mismatch, case when task % 7 = 0 then '' else passed::varchar end as passed from k")
def regraded_runs(q):
    """Saved runs graded again; the input of every seventh has changed since."""
    saved = q("tasks").withColumn("case_id", F.col("task")).withColumn("input_hash", F.sha2(F.concat_ws("|", "gold"), 256))
    inputs = saved.select("case_id", F.when(F.col("case_id") % 7 == 0, "changed").otherwise(F.col("input_hash")).alias("input_hash"))
    out = grading.regraded(saved, grading.routing(), inputs)
    return out.select("task", "mismatch", F.coalesce(F.col("grade.passed").cast("string"), F.lit("")).alias("passed"))
