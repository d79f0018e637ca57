"""Every registered query of the engine and the SQL that gives the same rows.

A plan is a function of a dialect that gives SQL; Spark runs it over views of
the tables and DuckDB runs its own dialect of it. Plans built on the package's
DataFrame operators give both forms by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteatlas.functions import urls
from siteatlas.operators.ranking import STOP, bm25
from siteatlas.operators.reconcile import reconcile
from siteatlas.streaming.progress import run_feed, run_stage_changes

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


class Spark:
    sha = staticmethod(lambda x: f"sha2({x}, 256)")
    join = staticmethod(lambda x, sep, by: f"array_join(transform(array_sort(collect_list(struct({by}, {x} as _v))), x -> x._v), '{sep}')")
    idiv = staticmethod(lambda a, b: f"({a} div {b})")
    words = staticmethod(lambda x: f"size(filter(split({x}, '[ \\n\\t]+'), x -> x <> ''))")
    lines = staticmethod(lambda x: f"split({x}, '\\n')")
    size = staticmethod(lambda x: f"size({x})")
    at = staticmethod(lambda x, i: f"get({x}, {i} - 1)")
    all = staticmethod(lambda x, re: f"regexp_extract_all({x}, '({re})', 1)")
    rows = staticmethod(lambda x, pos, val: f"lateral view posexplode({x}) _e as {pos}0, {val}")
    pos = staticmethod(lambda pos: f"{pos}0 + 1")
    seq = staticmethod(lambda n, name: f"(select id as {name} from range({n}))")
    like = staticmethod(lambda x, re: f"{x} rlike '{re}'")
    bytes = staticmethod(lambda x: f"octet_length({x})")
    arr = staticmethod(lambda *xs: f"array({', '.join(xs)})")
    rec = staticmethod(lambda **kv: f"named_struct({', '.join(f'{k!r}, {v}' for k, v in kv.items())})")
    compact = staticmethod(lambda x: f"array_compact({x})")
    each = staticmethod(lambda x, name: f"lateral view explode({x}) _e as {name}")
    nl = "'\\n'"


class Duck:
    sha = staticmethod(lambda x: f"sha256({x})")
    join = staticmethod(lambda x, sep, by: f"string_agg({x}, '{sep}' order by {by})")
    idiv = staticmethod(lambda a, b: f"({a} // {b})")
    words = staticmethod(lambda x: f"len(list_filter(string_split_regex({x}, '[ \\n\\t]+'), lambda x: x <> ''))")
    lines = staticmethod(lambda x: f"string_split({x}, chr(10))")
    size = staticmethod(lambda x: f"len({x})")
    at = staticmethod(lambda x, i: f"{x}[{i}]")
    all = staticmethod(lambda x, re: f"regexp_extract_all({x}, '({re})', 1)")
    rows = staticmethod(lambda x, pos, val: f", lateral (select unnest({x}) as {val}, generate_subscripts({x}, 1) as {pos}0)")
    pos = staticmethod(lambda pos: f"{pos}0")
    seq = staticmethod(lambda n, name: f"(select range as {name} from range({n}))")
    like = staticmethod(lambda x, re: f"regexp_matches({x}, '{re}')")
    bytes = staticmethod(lambda x: f"octet_length(encode({x}))")
    arr = staticmethod(lambda *xs: f"[{', '.join(xs)}]")
    rec = staticmethod(lambda **kv: "{" + ", ".join(f"{k!r}: {v}" for k, v in kv.items()) + "}")
    compact = staticmethod(lambda x: f"list_filter({x}, lambda x: x is not null)")
    each = staticmethod(lambda x, name: f", lateral (select unnest({x}) as {name})")
    nl = "chr(10)"


QUERIES: dict = {}
SQL: dict[str, str] = {}


def plan(name: str, sql) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = sql(Spark)
        for t in TABLES:
            if t in text:
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(text)

    QUERIES[name], SQL[name] = query, sql(Duck)


def built(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return wrap


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RE = "'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)([?][^#]*)?(#.*)?$'"
_PATH = f"regexp_extract(url, {_RE}, 3)"
_SECTION = f"coalesce(nullif(regexp_extract({_PATH}, '^/+([^/]+)', 1), ''), '(entry)')"
_SEGMENTS = f"list_filter(string_split({_PATH}, '/'), lambda x: x <> '')"
_RANK = f"case when list_has_any(list_transform({_SEGMENTS}, lambda x: lower(x)), {urls.LOW_VALUE}) then 3 when list_contains({urls.USEFUL}, lower({_SEGMENTS}[-1])) then 0 else 1 end"


@built("url_canonical", f"select page_id, lower(regexp_extract(url, {_RE}, 1)) || '://' || lower(regexp_extract(url, {_RE}, 2)) || case when {_PATH} = '' then '/' else {_PATH} end || regexp_extract(url, {_RE}, 4) || regexp_extract(url, {_RE}, 5) as canonical from pages")
def url_canonical(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@built(
    "url_normalize",
    f"""with p as (select page_id, url, list_sort(list_filter(string_split(substr(regexp_extract(url, {_RE}, 4), 2), '&'), lambda x: contains(x, '=') and not ends_with(x, '=') and not regexp_full_match(lower(split_part(x, '=', 1)), '{urls.IGNORED}'))) as q, {_SEGMENTS} as s from pages)
select page_id, lower(regexp_extract(url, {_RE}, 1)) || '://' || regexp_replace(lower(regexp_extract(url, {_RE}, 2)), ':(80|443)$', '') || '/' || array_to_string(s, '/') || case when ends_with({_PATH}, '/') and len(s) > 0 then '/' else '' end || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end as normalized from p""",
)
def url_normalize(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", urls.normalized(F.col("url")).alias("normalized"))


@built("source_id", "select page_id, 'src_' || substr(sha256(url), 1, 20) as source_id from pages")
def source_id(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", urls.source_id(F.col("url")).alias("source_id"))


@built("page_priority", f"select page_id, {_RANK} as rank, greatest(len({_SEGMENTS}), 1) as depth from pages")
def page_priority(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", urls.rank(F.col("url")).alias("rank"), urls.depth(F.col("url")).alias("depth"))


@built("section_balanced_rank", f"with p as (select url, {_SECTION} as section, {_RANK} as rank, greatest(len({_SEGMENTS}), 1) as depth from pages) select url, section, row_number() over (partition by section order by rank, depth, url) as reads, row_number() over (partition by section order by rank, depth, url) = 1 as head from p")
def section_balanced_rank(spark, sf_dir):
    p = _table(spark, sf_dir, "pages").select("url", urls.section(F.col("url")).alias("section"), urls.rank(F.col("url")).alias("rank"), urls.depth(F.col("url")).alias("depth"))
    reads = F.row_number().over(Window.partitionBy("section").orderBy("rank", "depth", "url"))
    return p.select("url", "section", reads.cast("long").alias("reads"), (reads == 1).alias("head"))


plan("section_counts", lambda d: f"select {_SECTION} as section, count(*) as n from pages group by 1")

_OBS = """stored as (select url, md5(url) as hash, cast(page_id % 2 as bigint) as n from pages where page_id % 4 <> 0),
observed as (select url, case when page_id % 5 = 1 then 'not-found' when page_id % 5 = 2 then 'unavailable' else 'ok' end as outcome, case when page_id % 6 = 3 then md5(url || 'x') else md5(url) end as hash from pages where page_id % 9 <> 8)"""
_RECONCILED = f"""with {_OBS},
met as (select coalesce(s.url, o.url) as url, s.hash as old, s.n, o.outcome, o.hash as new from stored s full join observed o on s.url = o.url),
r as (select *, case when outcome = 'ok' and old is null then 'added' when outcome = 'ok' and old <> new then 'modified' when outcome = 'not-found' and old is not null and n + 1 >= 2 then 'removed' when (outcome = 'not-found' and old is not null) or outcome = 'unavailable' then 'unavailable' else 'none' end as change from met),
k as (select url, change, case when outcome = 'ok' then new when change = 'removed' then null else old end as hash, case when outcome = 'ok' then 0 when change = 'removed' then null when outcome = 'not-found' and old is not null then n + 1 else n end as not_found_count from r)"""


def _reconciled(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    i, url = F.col("page_id"), F.col("url")
    stored = pages.where(i % 4 != 0).select("url", F.md5(url).alias("hash"), (i % 2).alias("not_found_count"))
    outcome = F.when(i % 5 == 1, "not-found").when(i % 5 == 2, "unavailable").otherwise("ok")
    observed = pages.where(i % 9 != 8).select("url", outcome.alias("outcome"), F.when(i % 6 == 3, F.md5(F.concat(url, F.lit("x")))).otherwise(F.md5(url)).alias("hash"))
    return reconcile(stored, observed)


@built("reconcile_pages", _RECONCILED + " select url, change, coalesce(hash, '') as hash, coalesce(not_found_count, -1)::bigint as not_found_count from k")
def reconcile_pages(spark, sf_dir):
    return _reconciled(spark, sf_dir).select("url", "change", F.coalesce("hash", F.lit("")).alias("hash"), F.coalesce("not_found_count", F.lit(-1)).alias("not_found_count"))


@built("reconcile_summary", _RECONCILED + " select change, count(*) as n, count(hash) as kept from k group by 1")
def reconcile_summary(spark, sf_dir):
    return _reconciled(spark, sf_dir).groupBy("change").agg(F.count("*").alias("n"), F.count("hash").alias("kept"))


plan("snapshot_status", lambda d: _RECONCILED + " select case when count(*) filter (where change <> 'none') = 0 then 'complete' when count(hash) = 0 then 'failed' else 'partial' end as status, count(hash) as kept from k")
plan("not_found_streak", lambda d: f"""with o as (select page_id, r, case when (page_id + r) % 3 = 0 then 'not-found' when (page_id * r) % 4 = 1 then 'unavailable' else 'ok' end as outcome from pages cross join {d.seq(3, 'r')} t),
g as (select *, sum(case when outcome = 'ok' then 1 else 0 end) over (partition by page_id order by r rows between unbounded preceding and current row) as island from o)
select page_id, cast(r as bigint) as r, outcome, cast(sum(case when outcome = 'not-found' then 1 else 0 end) over (partition by page_id, island order by r rows between unbounded preceding and current row) as bigint) as streak from g""")
plan("coverage_micro", lambda d: f"with {_OBS} select count(*) filter (where o.outcome = 'ok') as matched, count(*) as total, round(count(*) filter (where o.outcome = 'ok') * 1.0e0 / count(*), 6) as ratio from stored s left join observed o on s.url = o.url")


def _refresh(d):
    bit = lambda i: f"{d.idiv('b', 2**i)} % 2 = 1"
    published, crawl, unchanged, valid, conflict, same, auto, draft, edited = map(bit, range(9))
    return f"""select cast(b as bigint) as b, case when not ({published}) or not ({crawl}) then 'preserve' when {unchanged} then 'unchanged' when not ({valid}) then 'preserve' when {conflict} then 'review' when {same} then 'unchanged' when not ({auto}) or {draft} or {edited} then 'review' else 'publish' end as action from (select o_orderkey % 512 as b from orders) t"""


plan("refresh_action", _refresh)

_JOBS = "jobs as (select o_orderkey as id, o_custkey as project, case o_orderstatus when 'P' then 'pending' when 'O' then 'running' else 'failed' end as status, o_orderdate as available_at, o_orderpriority as kind, o_orderkey % 4 as attempt from orders)"
plan("job_due", lambda d: f"with {_JOBS} select id, project from jobs where status = 'pending' and available_at <= timestamp '1998-01-01 00:00:00' order by available_at, id limit 100")
plan("job_claim_topk", lambda d: f"with {_JOBS}, c as (select *, row_number() over (partition by kind order by available_at, id) as k from jobs where attempt < 3 and ((status = 'pending' and available_at <= timestamp '1998-01-01 00:00:00') or (status = 'running' and available_at <= timestamp '1997-01-01 00:00:00'))) select id, project, kind, attempt + 1 as attempt, 'running' as status from c where k <= 5")
plan("job_lease_sweep", lambda d: f"with {_JOBS} select status, swept, count(*) as n from (select case when status = 'running' and attempt >= 3 then 'failed' else status end as status, status = 'running' and attempt >= 3 as swept from jobs) group by 1, 2")
plan("job_backoff", lambda d: f"with {_JOBS} select id, status = 'failed' and attempt < 3 as retry, least(300, 5 * cast(power(2, attempt) as bigint)) as delay_s from jobs")
plan("latest_job_status", lambda d: f"with {_JOBS}, r as (select *, row_number() over (partition by project order by available_at desc, id desc) as k from jobs) select c_custkey as project, coalesce(r.status, 'none') as status from customer left join r on c_custkey = r.project and r.k = 1")
plan("cache_retention", lambda d: "select event_id, user_id from (select event_id, user_id, ts, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k <= 100 and ts >= timestamp '2024-01-24 00:00:00'")
plan("cache_upsert", lambda d: "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events) where k = 1")

_TRIALS = "trials as (select l_returnflag as category, l_linestatus as split, l_orderkey as case_id, l_quantity as took, l_discount < 0.09 as passed from lineitem)"
_SUMMARY = "count(*) as attempts, count(*) filter (where passed) as passed, count(distinct case_id) as cases, round(median(took), 6) as median_took"
plan("consistent_cases", lambda d: f"with {_TRIALS} select category, count(*) as cases, count(*) filter (where ok) as consistent from (select category, case_id, bool_and(passed) as ok from trials group by 1, 2) group by 1")

_STOP = ", ".join(map(repr, STOP))
_BM25 = f"""with q0 as (select item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) as term from benchmark),
q as (select item_id, term, count(*) as times from q0 where term not in ({_STOP}) group by all),
t as (select doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda x: x not in ({_STOP})) as ts from documents),
s as (select count(*) as n, avg(len(ts)) as mean from t),
e as (select doc_id, len(ts) as len, unnest(ts) as term from t),
tf as (select doc_id, len, term, count(*) as tf from e where term in (select term from q) group by all),
df as (select term, count(*) as df from tf group by 1),
sc as (select item_id as query_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) as score from tf join df using (term) join q using (term), s group by 1, 2),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc where score > 0)"""


def _ranked(spark, sf_dir):
    return bm25(_table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"), _table(spark, sf_dir, "documents"))


@built("bm25_rank", _BM25 + " select query_id, doc_id, score, rank from r where rank <= 3")
def bm25_rank(spark, sf_dir):
    return _ranked(spark, sf_dir).select("query_id", "doc_id", "score", "rank")


_HELD = " g as (select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text)), h as (select b.item_id, min(r.rank) as best from benchmark b left join g using (item_id) left join (select * from r where rank <= 3) r on r.query_id = b.item_id and r.doc_id = g.doc_id group by 1)"


@built("bm25_metrics", _BM25 + "," + _HELD + " select count(*) as tasks, count(*) filter (where best = 1) as top1, count(best) as top3, round(avg(coalesce(1.0 / best, 0)), 6) as mrr from h")
def bm25_metrics(spark, sf_dir):
    asked = _table(spark, sf_dir, "benchmark").withColumnRenamed("text", "quote")
    docs = _table(spark, sf_dir, "documents")
    top = _ranked(spark, sf_dir).select(F.col("query_id").alias("item_id"), "doc_id", "rank")
    hit = top.join(asked, "item_id").join(docs.select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("quote"))).groupBy("item_id").agg(F.min("rank").alias("best"))
    met = asked.select("item_id").join(hit, "item_id", "left")
    return met.agg(F.count("*").alias("tasks"), F.count_if(F.col("best") == 1).alias("top1"), F.count("best").alias("top3"), F.round(F.avg(F.coalesce(1 / F.col("best"), F.lit(0))), 6).alias("mrr"))



_GUIDE = lambda d: f"guides as (select page_id, concat_ws({d.nl}, concat('# ', regexp_extract(html, '<title>([^<]*)</title>', 1)), '', concat('- [one](', url, '): about'), case when page_id % 3 = 0 then concat('- [one](', url, ')') else 'See https://example.com/plain for more.' end, case when page_id % 4 = 0 then concat_ws({d.nl}, '```', 'curl https://example.com/fenced', '```') else 'todo: write' end) as text from pages)"
_LINES = lambda d: f"{_GUIDE(d)}, lines as (select page_id, {d.pos('k')} as k, line from guides {d.rows(d.lines('text'), 'k', 'line')})"
plan("markdown_metrics", lambda d: f"with {_GUIDE(d)} select page_id, {d.bytes('text')} as bytes, {d.words('text')} as words, {d.size(d.lines('text'))} as lines, cast(ceil(length(text) / 4.0) as bigint) as approx_tokens from guides")
plan("bare_urls", lambda d: f"with {_LINES(d)}, f as (select *, sum(case when line like '```%' then 1 else 0 end) over (partition by page_id order by k rows between unbounded preceding and current row) % 2 as fenced from lines) select page_id, k, regexp_extract(line, '(https?://[^ )]+)', 1) as url from f where fenced = 0 and not contains(line, '](') and contains(line, 'http')")
plan("truncate_complete_line", lambda d: "select doc_id, case when length(text) <= 1000 then text else regexp_replace(substr(text, 1, 1000), '" + "\\\\n[^\\\\n]*\\\\z".replace("\\\\", "\\" if d is Duck else "\\\\") + "', '') end as cut from documents")
plan("passages", lambda d: f"select doc_id, count(*) as n, min(length(line)) as shortest from (select doc_id, line from documents {d.rows(d.lines('substr(text, 1, 12000)'), 'k', 'line')}) where trim(line) <> '' group by 1")
plan("progress_changes", lambda d: "select user_id, event_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) where before is null or before <> event_type")
plan("progress_latest", lambda d: "select user_id, max_by(event_type, event_id) as event_type, max(event_id) as event_id from events group by 1")
plan("progress_recent", lambda d: "select event_id, count(*) over w as n, round(sum(value) over w, 4) as total from events window w as (partition by user_id order by ts, event_id rows between 5 preceding and current row)")


@built("progress_stream")
def progress_stream(spark, sf_dir):
    return run_stage_changes(spark, sf_dir)


@built(
    "progress_feed",
    """with e as (select user_id, event_id, event_type, epoch_us(ts) // 1000 as t from events), l as (select max(t) as last from e),
k as (select *, lag(event_type) over w as before, row_number() over w as n, min(t) over (partition by user_id) + 216000000 as ends from e window w as (partition by user_id order by t, event_id)),
p as (select *, lead(t, 1, ends) over (partition by user_id order by t, event_id) as until from k where (n = 1 or event_type is distinct from before) and t < ends),
b as (select user_id, unnest(range(t + 36000000, least(until, case when until = ends then until - 1 else until end, last) + 1, 36000000)) as at_ms from p, l)
select user_id, t as at_ms, 'payload' as kind, event_type from p union all select user_id, at_ms, 'heartbeat', '' from b union all select distinct user_id, ends, 'end', '' from k, l where ends <= last""",
)
def progress_feed(spark, sf_dir):
    """Feeds of an hour's ticks: a heartbeat after ten of them without a change, an end after sixty."""
    f = run_feed(spark, sf_dir, 3600)
    return f.select("user_id", F.unix_millis("at").alias("at_ms"), "kind", F.coalesce("event_type", F.lit("")).alias("event_type"))
