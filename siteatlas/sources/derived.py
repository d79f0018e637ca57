"""Inputs of the engine's queries, derived from the given tables by one SQL text for both engines.

Sites, pages, guides, jobs, decisions and runs are made from columns of the
tables, so that every rule of the operators meets rows on both of its sides.
"""


import re


def needed(d, text: str) -> str:
    """The common table expressions that a text of SQL names, with those that they name."""
    parts = re.split(r"(?m)^(\w+) as (?=\()", inputs(d))
    known = {n: t.strip().rstrip(",") for n, t in zip(parts[1::2], parts[2::2], strict=True)}
    used, todo = set(), [text]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        new = (words & known.keys()) - used
        used |= new
        todo += [known[n] for n in new]
    return ",\n".join(f"{n} as {t}" for n, t in known.items() if n in used)


def inputs(d) -> str:
    """Common table expressions in dialect d."""
    a, r = d.arr, d.rec
    s = lambda x: f"cast({x} as string)"
    keep = lambda *pairs: d.compact(a(*(f"case when {test} then {x} end" for test, x in pairs)))
    return f"""
sp as (select page_id, cast(page_id % 5 as bigint) as site, concat('https://s', {s("page_id % 5")}, '.example.com') as origin,
  case page_id * 7 % 9 when 0 then 'docs' when 1 then 'help' when 2 then 'blog' when 3 then 'products' when 4 then 'support' when 5 then 'pricing' when 6 then 'login' when 7 then 'docs/api' else 'learn' end as seg from pages),
site_pages as (select page_id, site, origin, concat(origin, '/') as root, seg, concat(origin, '/', seg, '/p', {s("page_id")}, case when page_id % 11 = 0 then '/' when page_id % 13 = 0 then '.pdf' else '' end) as url, page_id % 6 = 1 as known from sp),
site_roots as (select distinct site, origin, root from site_pages),
reading as (select site, root, url, known, page_id from site_pages union all select site, root, root, false, -1 from site_roots),
scopes as (select site, root from (select site, concat(origin, '/docs/') as root, 0 as k from site_roots union all select site, replace(concat(origin, '/docs/index.html'), '//s', '//www.s'), 1 from site_roots union all select site, root, 2 from site_roots) where k = site % 3),
odd_pages as (select site, page_id, url from site_pages union all select site, page_id + 100000, concat(origin, '/docs/%2e%2e/private/p', {s("page_id")}) from site_pages union all select site, page_id + 200000, concat(origin, '/docs-other/p', {s("page_id")}) from site_pages union all select site, page_id + 300000, replace(url, '//s', '//WWW.s') from site_pages union all select site, page_id + 400000, concat(origin, '/%64ocs/a//b/./p', {s("page_id")}) from site_pages union all select (site + 1) % 5, page_id + 500000, url from site_pages),
paths as (select '/' as path union all select '/docs/' union all select '/docs/api/' union all select '/help/'),
site_guides as (select site, origin, concat('g', {s("site")}, path) as guide, path, concat(case path when '/' then 'Home' when '/docs/' then 'Docs [new]' when '/docs/api/' then 'API' else 'Help' end) as name, concat('v', {s("site")}, path) as draft, case when path <> '/help/' then concat('v', {s("site")}, path) end as published_version, path = '/help/' and site % 2 = 1 as auto_cancelled, site = 3 as manually_edited from site_roots cross join paths where not (path = '/docs/api/' and site = 4)),
responses as (select page_id, site, url, case page_id % 7 when 0 then 'No-Store, max-age=0' when 1 then 'public, PRIVATE' when 2 then '' when 3 then null else 'max-age=60' end as cache_control, case page_id % 5 when 0 then 'Accept-Encoding, User-Agent' when 1 then ' accept , ACCEPT-ENCODING,' when 2 then null else 'Accept' end as vary, case page_id % 3 when 0 then concat('e', {s("page_id")}) when 1 then '' end as etag, case when page_id % 4 = 1 then 'Mon, 01 Jan 2024 00:00:00 GMT' else '' end as last_modified,
  cast(case page_id % 10 when 0 then 404 when 1 then 410 when 2 then 304 when 3 then 500 else 200 end as int) as status, case page_id % 6 when 0 then 'application/xhtml+xml' when 1 then 'application/pdf' when 2 then 'text/plain' else 'Text/HTML; charset=utf-8' end as content_type, page_id % 4 = 2 as cached, h.html as body from site_pages join (select page_id as id, html from pages) h on h.id = page_id),
captures as (select concat(origin, p.path, 'llms.txt') as url, cast(case when (site + n) % 5 = 0 then 404 else 200 end as int) as status, case when (site + n) % 4 = 1 then 'text/html' else 'text/plain' end as content_type, case (site * 3 + n) % 6 when 0 then '## no title' when 1 then concat('# T', {d.nl}, '<!DOCTYPE html>') when 2 then concat('#  ', {d.nl}, 'x') else concat('# Guide', {d.nl}, 'text') end as body from site_roots cross join (select path, case path when '/' then 0 when '/docs/' then 1 when '/docs/api/' then 2 else 3 end as n from paths) p),
deep_sites as (select site, concat(origin, case site % 4 when 0 then '/docs/api/start.html' when 1 then '/docs/' when 2 then '/' else '/help/a/b' end) as root from site_roots),
sitemaps as (select site, concat(origin, '/sitemap', {s("k")}, '.xml') as sitemap, cast(case when k = 3 then 404 else 200 end as int) as status, concat(case when k = 1 then '<?xml version="1.0"?><!DOCTYPE x>' else '<?xml version="1.0"?>' end, case when k = 2 then '<sitemapindex xmlns="s">' else '<x:urlset xmlns:x="s">' end, replace(body, 'ENTRY', case when k = 2 then 'sitemap' else 'x:url' end), case when k = 0 and site = 4 then '' when k = 2 then '</sitemapindex>' else '</x:urlset>' end) as body from (select site, origin, k, {d.join("case when page_id % 3 = 0 then concat('<ENTRY><!-- a --><x:loc xmlns:x=\"s\"> ', url, '?a=1&amp;b=&#50; </x:loc></ENTRY>') else concat('<ENTRY><loc>', url, '</loc></ENTRY>') end", "", "page_id")} as body from site_pages cross join (select 0 as k union all select 1 union all select 2 union all select 3) ks group by site, origin, k)),
crawl_pages as (select page_id, site, idx, origin, case when idx = 0 then concat(origin, '/') else concat(origin, '/', seg, '/p', {s("idx")}) end as url, case when site % 7 = 6 then 500 when page_id % 11 = 3 then 404 else 200 end as status, cast(100 + page_id % 7 * 50 as bigint) as chars, cast(1000 + page_id % 5 * 500 as bigint) as bytes, cast(1 + page_id % 3 as double) as seconds from (select page_id, cast(page_id % 25 as bigint) as site, {d.idiv("page_id", "25")} as idx, concat('https://c', {s("page_id % 25")}, '.example.com') as origin, case page_id * 7 % 9 when 0 then 'docs' when 1 then 'help' when 2 then 'tag' when 3 then 'products' when 4 then 'docs/api' when 5 then 'pricing' else 'blog' end as seg from pages) c),
crawl_sites as (select site, url as root, cast(case when site % 7 = 1 then 5 end as bigint) as max_pages, cast(case when site % 7 = 2 then 9 end as double) as max_seconds, cast(case when site % 7 = 3 then 9000 end as bigint) as max_bytes, cast(case when site % 7 = 4 then 1100 end as bigint) as max_chars from crawl_pages where idx = 0),
crawl_plan as (select site, url, cast(100 - idx as bigint) as step from crawl_pages where site % 7 = 5 and idx between 1 and 3),
map_tree as (select distinct site, concat(origin, '/map', {s("n")}, '.xml') as sitemap, n, origin from site_roots cross join (select page_id as n from pages where page_id < 13) p),
tree_maps as (select t.site, t.sitemap, cast(200 as int) as status, case when t.n < 4 then concat('<sitemapindex>', max(concat('<sitemap><loc>', t.origin, '/map', {s("t.n * 3 + 1")}, '.xml</loc></sitemap><sitemap><loc>', t.origin, '/map', {s("t.n * 3 + 2")}, '.xml</loc></sitemap><sitemap><loc>', t.origin, '/map', {s("t.n * 3 + 3")}, '.xml</loc></sitemap><sitemap><loc>', t.origin, '/map0.xml</loc></sitemap>')), '</sitemapindex>') else concat('<urlset>', {d.join("concat('<url><loc>', url, '</loc></url>')", "", "page_id")}, '</urlset>') end as body from map_tree t join site_pages p on p.site = t.site and (t.n < 4 or p.page_id % 9 = t.n - 4) group by t.site, t.sitemap, t.n),
offsets as (select sitemap, cast(3 as bigint) as resume_at from sitemaps where site % 2 = 0),
store as (select concat({d.sha("url")}, '.json') as key, case when page_id % 9 = 4 then 'timeout' end as error, page_id from site_pages where page_id % 3 <> 0),
sources as (select site as project, concat('src', {s("page_id % 12")}) as source_id, min(url) as url, case when min(page_id) % 2 = 0 then concat(min(url), '.md') end as markdown_url, concat('Title *', {s("min(page_id)")}, '*') as title, case when min(page_id) % 3 = 0 then '' else concat('About `', {s("min(page_id)")}, '`') end as description, concat('line one', {d.nl}, 'page ', {s("min(page_id)")}, {d.nl}, 'end') as content, {d.sha(s("min(page_id)"))} as hash from site_pages group by 1, 2),
latest as (select project, source_id, url, title, case when substr(hash, 1, 1) < '8' then content else concat(content, {d.nl}, 'more') end as content from sources where substr(hash, 2, 1) < 'd' union all select project, concat(source_id, 'n'), url, title, content from sources where substr(hash, 3, 1) < '3'),
decisions as (select cast(n_nationkey % 5 as bigint) as project, concat('d', {s("n_nationkey")}) as decision, n_nationkey % 4 <> 0 as active, n_nationkey % 3 = 1 as needs_review, {a(r(source_id="concat('src', " + s("n_nationkey % 14") + ")", hash=d.sha(s("n_nationkey"))), r(source_id="concat('src', " + s("n_nationkey % 5") + ")", hash="coalesce(h.hash, 'none')"))} as basis, {a("concat('src', " + s("n_nationkey % 5") + ")", "concat('src', " + s("n_nationkey % 12") + ")")} as basis_ids from nation left join sources h on h.project = n_nationkey % 5 and h.source_id = concat('src', {s("n_nationkey % 5")})),
answers as (select project, decision as answer, case when project % 2 = 0 then 'fact' else 'direction' end as kind, {keep(("length(decision) = 2", "'src1'"), ("active", "'src99'"))} as question_evidence, {keep(("needs_review", "'src2'"), ("needs_review", "'src3'"))} as previous_basis from decisions),
questions as (select concat('q', {s("c_custkey")}) as question, cast(c_custkey % 5 as bigint) as project, cast(c_custkey % 3 as bigint) as snapshot, cast(1 as bigint) as current_snapshot, concat('topic', {s("c_custkey % 7")}) as topic, case c_custkey % 4 when 0 then 'pending' when 1 then 'dismissed' else 'answered' end as status, case when c_custkey % 4 > 1 then concat('d', {s("c_custkey % 25")}) end as decision from customer),
jobs as (select o_orderkey as job, o_custkey as project, o_orderpriority as kind, case o_orderstatus when 'P' then 'pending' when 'O' then 'running' else 'failed' end as status, o_orderkey % 4 as attempt, cast(3 as bigint) as max_attempts, cast(o_orderdate as timestamp) as available_at, cast(case when o_orderstatus = 'O' then o_orderdate end as timestamp) as lease_until, case when o_orderstatus = 'O' then concat('t', {s("o_orderkey % 3")}) end as lease_token, case when o_orderkey % 2 = 0 then concat('k', {s("o_orderkey % 500")}) end as key, case when o_orderstatus = 'F' then 'failed' end as error from orders),
requests as (select c_custkey as request, c_custkey * 7 % 180 as project, 'refresh' as kind, case when c_custkey % 3 > 0 then concat('k', {s("c_custkey * 3 % 900")}) end as key from customer),
monitored as (select c_custkey as project, c_nationkey % 3 > 0 as monitored, cast(o.at as timestamp) as next_check_at from customer join (select o_custkey, min(o_orderdate) as at from orders group by 1) o on o_custkey = c_custkey),
projects as (select c_custkey as project, c_custkey % 5 as revision, cast(c_custkey % 7 as bigint) as snapshot, cast(c_custkey % 3 as bigint) as decisions_revision, case when c_custkey % 9 > 0 then c_custkey * 10 end as draft, c_nationkey % 4 = 0 as changed, c_nationkey % 3 = 0 as draft_edited, cast(null as bigint) as published_version, cast(null as timestamp) as published_at from customer),
versions as (select c_custkey as project, c_custkey * 10 as version, cast((c_custkey + c_nationkey) % 7 as bigint) as snapshot, cast(c_nationkey % 3 as bigint) as decisions_revision, case when c_nationkey % 2 = 0 then 'proposal' else 'draft' end as status, cast(case when c_nationkey % 2 = 0 then timestamp '1996-01-01 00:00:00' else timestamp '1999-01-01 00:00:00' end as timestamp) as created_at from customer),
answered as (select c_custkey as project, concat('a', {s("c_custkey")}) as decision, c_custkey % 2 = 0 as active, c_custkey % 3 = 0 as needs_review from customer),
publications as (select c_custkey as project, cast(case when c_custkey % 6 = 0 then c_custkey % 5 + 1 else c_custkey % 5 end as bigint) as revision, case when c_custkey % 7 = 0 then null when c_custkey % 8 = 0 then c_custkey * 10 + 1 else c_custkey * 10 end as version from customer),
edits as (select o_custkey as project, o_orderkey as edit, o_orderkey % 5 as revision, case o_orderkey % 3 when 0 then 'save' when 1 then 'document' else 'more' end as kind from orders),
old_directions as (select cast(n_regionkey as bigint) as project, substr(n_name, 1, 2) as key, cast(min(n_nationkey) as bigint) as pos, case when n_regionkey % 2 = 0 then max(n_name) else 'same' end as value from nation group by n_regionkey, substr(n_name, 1, 2)),
new_directions as (select project, key, pos + 1 as pos, case when project = 4 then value else 'same' end as value from old_directions where pos % 4 > 0 union all select project, concat('n', key), pos + 50, value from old_directions where pos % 5 = 1),
tasks as (select doc_id as task, source as category, {keep(("doc_id % 3 > 0", "concat('u', " + s("doc_id % 7") + ")"), ("doc_id % 4 = 1", "concat('u', " + s("doc_id % 11") + ")"), ("doc_id % 5 = 2", "concat('x', " + s("doc_id % 3") + ")"), ("doc_id % 6 = 3", "concat('u', " + s("doc_id % 4") + ")"))} as urls, {keep(("doc_id % 8 > 0", "concat('u', " + s("doc_id % 4") + ")"), ("doc_id % 2 = 0", "concat('u', " + s("doc_id % 5") + ")"))} as gold, {a(*(f"'u{i}'" for i in range(11)))} as candidates, {a("'u0'", "'u1'", "'u2'")} as visible from documents),
runs as (select l_orderkey * 10 + l_linenumber as run, l_partkey % 3 as suite, l_suppkey % 2 as model, l_returnflag as prompt, max(l_shipdate) as created_at, concat('k', cast((l_orderkey * 10 + l_linenumber) % 500 as string)) as key from lineitem where l_linenumber < 3 group by 1, 2, 3, 4),
trial_runs as (select conv_id as trial, case when conv_id % 5 = 0 then null when conv_id % 7 = 0 then 'abstain' else 'answer' end as action, max(text) as answer, case when conv_id % 3 > 0 then concat('u', {s("conv_id % 4")}) end as expected_url, cast(max(turn) as bigint) as turns from conversations group by conv_id),
cited as (select trial, u.url, u.passage_id from (select trial, {a(r(url="concat('u', " + s("trial % 4") + ")", passage_id="concat('p', " + s("trial % 3 + 1") + ")"), r(url="concat('u', " + s("trial % 6") + ")", passage_id="'p1'"))} as us from trial_runs where turns % 4 > 0) {d.each("us", "u")}),
opened as (select conv_id as trial, concat('u', {s("turn % 4")}) as url, concat('p', {s("turn % 3 + 1")}) as passage_id from conversations union all select conv_id, concat('u', {s("turn % 3")}), 'p1' from conversations),
results as (select doc_id as id, case when doc_id % 13 = 5 then 'questions' else 'generate' end as mode, cast(case when doc_id % 7 = 3 then 1 else 3 end as int) as max_questions, {a("'s0'", "'s1'", "'s2'", "case when doc_id % 29 = 6 then 'd0' else 's3' end")} as sources,
  {a(r(id="'d0'", active="true", needs_review="false"), r(id="'d1'", active="false", needs_review="false"), r(id="'d2'", active="true", needs_review="true"))} as decisions, {a("'t9'", "'t8'")} as dismissed_topics, not (doc_id % 13 = 5 and doc_id % 2 = 0) as has_guide,
  {a(r(text="concat('Launch on day ', " + s("doc_id % 10") + ")", evidence_ids=a("'s0'", "case doc_id % 11 when 2 then 'd1' when 3 then 'd2' when 4 then 's7' else 'd0' end")))} as claims,
  {keep(("true", "'s0'"), ("doc_id % 3 > 0", "'s1'"), ("doc_id % 17 = 4", "'s0'"), ("doc_id % 19 = 7", "'s8'"))} as links,
  {a(r(source_id="case when doc_id % 5 = 1 then 's1' else 's0' end", decision_ids=a("case when doc_id % 23 = 9 then 'd1' else 'd0' end")), r(source_id="case when doc_id % 31 = 8 then 's0' else 's1' end", decision_ids=a("'d0'")))} as shortcuts,
  {a(r(topic="case doc_id % 9 when 4 then 't9' else 't1' end", question="concat('Which Region ', " + s("doc_id % 4") + ", '?')", options=a("'One'", "case when doc_id % 10 = 6 then ' oNe ' else 'Two' end"), rationale="case when doc_id % 8 = 2 then 'Too short' else 'It changes which pages readers see first' end", recommended="cast(case doc_id % 12 when 5 then 2 when 7 then null else 1 end as int)", evidence_ids=a("case when doc_id % 15 = 3 then 'd1' else 's2' end")), r(topic="case doc_id % 10 when 4 then 't1' else 't2' end", question="'Anything else?'", options=a("'a'", "'b'"), rationale="'one two three four five six'", recommended="cast(0 as int)", evidence_ids=a("'d2'")))} as questions,
  case when doc_id % 13 = 5 and doc_id % 2 = 0 then null else concat('# Guide', {d.nl}, 'Archived docs, region ', {s("doc_id % 4")}, case when doc_id % 6 = 1 then ' never mention' else '' end) end as document from documents),
reviews as (select doc_id as id, cast(doc_id % 4 as bigint) as issues, cast(case when doc_id % 5 = 0 then 2 else 0 end as bigint) as invalid_anchors from documents),
defects as (select doc_id as id, toxic = 1 as has_known_defect from labels),
replies as (select doc_id as answer_id, case doc_id % 3 when 0 then 'guide' when 1 then 'home' else 'none' end as arm, case when doc_id % 6 = 5 then 'abstain' else 'answer' end as action, case when doc_id % 10 = 9 then '' else concat('It costs ', {s("doc_id % 5")}, ' euros a month') end as answer, doc_id % 6 = 5 or doc_id % 14 = 3 as expect_abstain, concat('u', {s("doc_id % 3")}) as url, case when doc_id % 4 = 1 then 'no such words here at all' else substr(text, 5, 40) end as quote, text, cast(doc_id % 50 as bigint) as tokens from documents where length(text) > 100)"""
