"""Reading a site, over captures instead of live requests: scope, robots, sitemaps, cache decisions, order and budgets.

Every function takes and returns DataFrames (or columns) and works on all sites
at once; a site is one key. Times come in as values, never from the clock.
"""

from __future__ import annotations

from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.functions import urls
from siteatlas.functions.arrow import arrow
from siteatlas.functions.text import collapsed
from siteatlas.sources.stores import stored

# Endings of files that aren't pages, headers of a response that a cache may vary by, MIME types of guides that are refused.
FILES = ".pdf .png .jpg .jpeg .svg .gif .zip .css .js .xml .mp4".split()
VARY = ["accept-encoding", "accept"]
REFUSED = "html|json|image/|application/pdf"
MAX_GUIDE = 100_000


# scope


def bare_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(urls.part(url, 2), r"^[^@]*@|:[0-9]*$", "")), r"^www\.", "")


def plain_path(url: Column) -> Column:
    """The decoded path without empty and dot segments, / for none; as it stands where its percent codes are broken."""
    path = urls.part(url, 3)
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.regexp_replace(urls.dotless(decoded), "(?<=.)/$", "")


def scope_path(url: Column) -> Column:
    """A site's own path; a file stands for its folder."""
    path, folder = plain_path(url), ~urls.part(url, 3).endswith("/")
    last = F.element_at(F.split(path, "/"), -1)
    up = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(folder & F.contains(last, F.lit(".")), F.when(up == "", F.lit("/")).otherwise(up)).otherwise(path)


def in_scope(url: Column, host: Column, path: Column) -> Column:
    own = plain_path(url)
    return (bare_host(url) == host) & ((path == "/") | (own == path) | F.startswith(own, F.concat(path, F.lit("/"))))


def is_page(url: Column) -> Column:
    """Not a file of another kind, by its ending."""
    return ~F.lower(urls.part(url, 3)).rlike("(" + "|".join(x.replace(".", r"\.") for x in FILES) + ")$")


def section_under(url: Column, root: Column) -> Column:
    """First path segment below the root's path, (entry) for none."""
    base = F.regexp_replace(urls.part(root, 3), "/+$", "")
    path = urls.part(url, 3)
    rest = F.when((path == base) | F.startswith(path, F.concat(base, F.lit("/"))), F.substr(path, F.length(base) + 1)).otherwise(path)
    return F.coalesce(F.nullif(F.regexp_extract(rest, "^/*([^/]+)", 1), F.lit("")), F.lit("(entry)"))


# robots


@arrow("struct<groups:array<struct<agents:array<string>,everybody:boolean,rules:array<struct<allow:boolean,path:string>>>>,delay:double,sitemaps:array<string>>")
def robots_groups(body: pd.Series) -> pd.DataFrame:
    """Groups of rules in file order; an empty line ends a group. The delay is that of the group for everybody."""

    def read(text):
        groups, agents, rules, delay, maps = [], [], [], None, []

        def close():
            nonlocal agents, rules
            if agents and rules:
                groups.append({"agents": agents, "everybody": "*" in agents, "rules": [r for r in rules if r]})
            agents, rules = [], []

        for raw in (text or "").splitlines():
            if not raw:
                close()
            name, _, value = raw.split("#", 1)[0].strip().partition(":")
            name, value = name.strip().lower(), value.strip()
            if name == "user-agent":
                if rules:
                    close()
                agents = [*agents, value.lower()]
            elif name == "sitemap" and value:
                maps.append(value)
            elif agents and name in ("allow", "disallow"):
                rules.append({"allow": name == "allow" or not value, "path": quote(unquote(value))})
            elif agents and name == "crawl-delay":
                rules.append(None)
                if "*" in agents and delay is None and value.isdigit():
                    delay = float(value)
        close()
        return groups, delay, maps

    return pd.DataFrame([read(x) for x in body], columns=["groups", "delay", "sitemaps"])


def robots_policies(captures: DataFrame) -> DataFrame:
    """captures: origin, status, body. Rows origin, policy (parsed, allow-all or deferred), groups, delay, sitemaps."""
    read = robots_groups(F.when(F.col("status") == 200, F.col("body")).otherwise(""))
    policy = F.when(F.col("status") == 200, "parsed").when(F.col("status").isin(404, 410), "allow-all").otherwise("deferred")
    return captures.select("origin", policy.alias("policy"), read.alias("r")).select("origin", "policy", "r.*")


def permitted(path: Column, groups: Column, agent: str) -> Column:
    """The first matching rule of the first group that names the agent decides, without one of the first group for everybody; else the path is open."""
    named = F.filter(groups, lambda g: ~g["everybody"] & F.exists(g["agents"], lambda a: F.contains(F.lit(agent.lower()), a)))
    rules = F.coalesce(F.get(named, F.lit(0)), F.get(F.filter(groups, lambda g: g["everybody"]), F.lit(0)))["rules"]
    first = F.get(F.filter(rules, lambda r: (r["path"] == "*") | F.startswith(path, r["path"])), F.lit(0))
    return F.coalesce(first["allow"], F.lit(True))


def readable(pages: DataFrame, scopes: DataFrame, policies: DataFrame, agent: str) -> DataFrame:
    """pages: site, url; scopes: site, root. Rows with origin, in_scope, allowed (null while a policy is deferred), read."""
    own = scopes.select("site", bare_host(F.col("root")).alias("_host"), scope_path(F.col("root")).alias("_path"))
    met = pages.join(own, "site").withColumn("origin", F.concat(urls.part(F.col("url"), 1), F.lit("://"), urls.part(F.col("url"), 2)))
    met = met.join(policies.select("origin", "policy", "groups"), "origin", "left")
    path = F.concat(F.when(urls.part(F.col("url"), 3) == "", "/").otherwise(urls.part(F.col("url"), 3)), urls.part(F.col("url"), 4))
    allowed = F.when(F.col("policy") == "allow-all", True).when(F.col("policy") == "parsed", permitted(path, F.col("groups"), agent))
    met = met.withColumn("in_scope", in_scope(F.col("url"), F.col("_host"), F.col("_path"))).withColumn("allowed", allowed)
    return met.withColumn("read", F.coalesce(F.col("in_scope") & F.col("allowed"), F.lit(False))).drop("_host", "_path", "groups", "policy")


# sitemaps


SITEMAP = "sitemap array<struct<loc:string>>, url array<struct<loc:string>>, _corrupt_record string"


def sitemap_locations(captures: DataFrame, offsets: DataFrame) -> DataFrame:
    """captures: sitemap, status, body; offsets: sitemap, resume_at. Rows sitemap, is_index, pos, location from the saved offset on; files with a DTD, other statuses and broken XML give none."""
    fit = (F.col("status") == 200) & F.col("body").isNotNull() & ~F.col("body").rlike(r"(?i)<!(doctype|entity)")
    read = captures.where(fit).select("sitemap", F.from_xml("body", SITEMAP, {"ignoreNamespace": "true"}).alias("x")).where("x._corrupt_record is null")
    index = F.col("x.sitemap").isNotNull()
    own = F.filter(F.transform(F.coalesce("x.sitemap", "x.url"), lambda e: F.trim(F.coalesce(e["loc"], F.lit("")))), lambda u: u != "")
    found = read.select("sitemap", index.alias("is_index"), F.posexplode(own).alias("pos", "location"))
    return found.join(offsets, "sitemap", "left").where(F.col("pos") >= F.coalesce("resume_at", F.lit(0))).drop("resume_at")


def discovered(roots: DataFrame, captures: DataFrame, offsets: DataFrame, url_bytes: int = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """Pages that sitemaps name, indexes followed to their maps at any depth: roots: site, sitemap; captures and offsets as above.

    Rows site, sitemap, depth, pos, location, up to the page whose URL brings its site over url_bytes, in
    order of depth, map and place; and rows sitemap, resume_at for the next run: where a map was cut, and 0 for maps behind. Each
    round follows the maps that the last one found and none before; a round's maps are stored.
    """
    every = captures.select("sitemap", "status", "body")
    maps = frontier_ = stored(roots.select("site", "sitemap", F.lit(0).alias("depth")).distinct(), "maps")
    depth, pages = 0, None
    while not frontier_.isEmpty():
        got = frontier_.join(sitemap_locations(every.join(frontier_.select("sitemap").distinct(), "sitemap", "left_semi"), offsets), "sitemap")
        named = got.where(~F.col("is_index")).select("site", "sitemap", "depth", F.col("pos").cast("long").alias("pos"), "location")
        pages = named if pages is None else pages.unionByName(named)
        depth += 1
        new = got.where("is_index").select("site", F.col("location").alias("sitemap")).distinct().join(maps, ["site", "sitemap"], "left_anti")
        frontier_ = stored(new.withColumn("depth", F.lit(depth)), "maps")
        maps = maps.unionByName(frontier_)
    pages = pages if pages is not None else maps.select("site", "sitemap", "depth", F.lit(0).cast("long").alias("pos"), F.col("sitemap").alias("location")).limit(0)
    order = Window.partitionBy("site").orderBy("depth", "sitemap", "pos")
    summed = pages.withColumn("_total", F.sum(F.octet_length("location")).over(order))
    cut = summed.where(F.col("_total") > url_bytes).groupBy("sitemap").agg(F.min("pos").alias("resume_at"))
    return summed.where(F.col("_total") <= url_bytes).drop("_total"), cut


def sitemap_order(sitemaps: DataFrame) -> DataFrame:
    """sitemaps: site, root, url, resumed. With `place`: resumed ones first, then those in scope, those that share a word of the scope, shorter and smaller paths."""
    url, scope = F.col("url"), scope_path(F.col("root"))
    path = F.lower(urls.part(url, 3))
    words = F.filter(F.split(F.lower(F.trim(scope)), "/"), lambda t: t != "")
    near = F.when((scope != "/") & in_scope(url, bare_host(F.col("root")), scope), 0).when(F.exists(words, lambda t: F.contains(path, t)), 1).otherwise(2)
    order = Window.partitionBy("site").orderBy(F.desc("resumed"), near, F.size(F.split(path, "/")), path, "url")
    return sitemaps.withColumn("place", F.row_number().over(order).cast("long"))


# answers and the page cache


def outcome(status: Column, content_type: Column, cached: Column) -> Column:
    html = F.coalesce(content_type, F.lit("")).rlike("(?i)^(text/html|application/xhtml)")
    return F.when(status.isin(404, 410), "not-found").when((status == 304) & cached, "reuse").when((status == 200) & html, "extract").otherwise("unavailable")


def conditional(etag: Column, last_modified: Column) -> Column:
    """Header of a conditional request: the entity tag is preferred."""
    name = F.when(etag != "", "If-None-Match").when(last_modified != "", "If-Modified-Since")
    return F.when(name.isNotNull(), F.struct(name.alias("name"), F.when(etag != "", etag).otherwise(last_modified).alias("value")))


def storage_decision(cache_control: Column, vary: Column, etag: Column, last_modified: Column) -> Column:
    control = F.lower(F.coalesce(cache_control, F.lit("")))
    parts = F.filter(F.transform(F.split(F.coalesce(vary, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return (
        F.when(F.contains(control, F.lit("no-store")) | F.contains(control, F.lit("private")), "not stored: Cache-Control private/no-store")
        .when(F.size(F.array_except(parts, F.array(*map(F.lit, VARY)))) > 0, "not stored: unsupported Vary")
        .when((F.coalesce(etag, F.lit("")) != "") | (F.coalesce(last_modified, F.lit("")) != ""), "stored with validator")
        .otherwise("stored without validator")
    )


def cache_put(cache: DataFrame, fetched: DataFrame, keys: list[str]) -> DataFrame:
    """cache after fetched: rows whose `decision` begins with "stored" replace those of their key, the others delete it. Both have the columns of cache."""
    names = cache.columns
    kept = cache.join(fetched.select(*keys), keys, "left_anti")
    return kept.unionByName(fetched.where(F.startswith(F.col("decision"), F.lit("stored"))).select(*names))


def cache_lookup(pages: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """pages (site, url) with `hit` and the cached row's fields; rows of other extraction versions don't count."""
    found = cache.where(F.col("extraction_version") == version).drop("extraction_version").withColumn("hit", F.lit(True))
    return pages.join(found, ["site", "url"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def frozen(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """Captures by the hash of their URL; a miss is an error row of its own."""
    key = F.concat(F.sha2("url", 256), F.lit(".json"))
    met = wanted.withColumn("key", key).join(store.withColumn("_there", F.lit(True)).withColumnRenamed("error", "_error"), "key", "left")
    miss = F.col("_there").isNull()
    return met.withColumn("cache_miss", miss).withColumn("error", F.when(miss, "Page missing from frozen capture").otherwise(F.col("_error"))).drop("_there", "_error")


def replayed(wanted: DataFrame, captures: DataFrame, unknown: str, key: str = "url") -> DataFrame:
    """wanted (url) answered from captures (url, status), or both by another key: what isn't there is 404 in a replay of whole sites (`not-found`), unavailable in one of changes (`unavailable`)."""
    default = {"not-found": 404, "unavailable": 503}[unknown]
    return wanted.join(captures, key, "left").withColumn("known", F.col("status").isNotNull()).withColumn("status", F.coalesce("status", F.lit(default)))


# existing guides


def guide_candidates(sites: DataFrame) -> DataFrame:
    """sites: site, root. Rows site, pos, candidate: the guide of the root's path and of every ancestor, deepest first."""
    root = F.col("root")
    origin = F.concat(F.lower(urls.part(root, 1)), F.lit("://"), F.lower(urls.part(root, 2)))
    parts = F.filter(F.split(scope_path(root), "/"), lambda x: x != "")
    prefix = F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.concat(origin, F.array_join(F.transform(F.slice(parts, F.lit(1), n), lambda x: F.concat(F.lit("/"), x)), ""), F.lit("/llms.txt")))
    return sites.select("site", F.posexplode(prefix).alias("pos", "candidate"))


def guide_refusal(status: Column, content_type: Column, body: Column) -> Column:
    """Why a response isn't a guide; null where it is. body is null where it isn't UTF-8."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "^﻿", ""), r"^\s+", ""), r"\s+$", "")
    title = F.regexp_extract(text, r"^# ([^\r\n]*)", 1)
    return (
        F.when(status.isNull() | (status != 200), F.concat(F.lit("HTTP "), F.coalesce(status.cast("string"), F.lit("none"))))
        .when(F.coalesce(content_type, F.lit("")).rlike(f"(?i){REFUSED}"), "Response is not a Markdown text file")
        .when(body.isNull(), "Response is not UTF-8 text")
        .when(F.contains(text, F.lit("\0")) | ~F.startswith(text, F.lit("# ")) | (F.trim(title) == ""), "No Markdown title found")
        .when(F.lower(text).rlike("<html|<!doctype"), "Response contains an HTML page")
    )


def discover_guides(sites: DataFrame, captures: DataFrame) -> DataFrame:
    """Every candidate with its check: site, pos, candidate, reason (null: a guide), nearest (the deepest guide of its site)."""
    body = F.when(F.octet_length("body") <= MAX_GUIDE, F.col("body"))
    met = guide_candidates(sites).join(captures.withColumnRenamed("url", "candidate"), "candidate", "left")
    met = met.select("site", "pos", "candidate", guide_refusal(F.col("status"), F.col("content_type"), body).alias("reason"))
    first = F.min(F.when(F.col("reason").isNull(), F.col("pos"))).over(Window.partitionBy("site"))
    return met.withColumn("nearest", F.coalesce(F.col("pos") == first, F.lit(False)))


# order and budgets


def read_order(pages: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """pages: site, root, url, known. With `place`, the order of reading.

    Without a plan sections take turns: always the least of (pages read of the section, priority), the root
    first. Sites with a plan (site, url, step) read the root, the plan in its order and then what was known, by URL.
    """
    url = F.col("url")
    p = pages.withColumn("section", section_under(url, F.col("root"))).withColumn("entry", url == F.col("root"))
    rank = F.when(F.col("entry"), -2).when(F.col("known"), -1).otherwise(urls.rank(url))
    depth = F.when(F.col("entry") | F.col("known"), 0).otherwise(urls.depth(url))
    p = p.withColumn("_p", F.struct(rank.alias("rank"), depth.alias("depth"), url.alias("url")))
    reads = F.row_number().over(Window.partitionBy("site", "section").orderBy("_p")) - 1
    turn = p.withColumn("_turn", F.when(F.col("entry"), -1).otherwise(reads))
    free = turn.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("_turn", "_p")).cast("long")).drop("_p", "_turn")
    if plan is None:
        return free.drop("entry")
    has = plan.select("site").distinct().withColumn("_planned", F.lit(True))
    met = free.join(has, "site", "left").join(plan, ["site", "url"], "left")
    keep = F.col("_planned").isNull() | F.col("entry") | F.col("step").isNotNull() | F.col("known")
    step = F.when(F.col("_planned").isNull(), F.col("place")).when(F.col("entry"), -1).otherwise(F.coalesce("step", F.lit(1 << 40)))
    order = Window.partitionBy("site").orderBy(step, "url")
    return met.where(keep).withColumn("place", F.row_number().over(order).cast("long")).drop("_planned", "step", "entry")


def checked_plan(plan: DataFrame, candidates: DataFrame, ranked: DataFrame) -> DataFrame:
    """plan: site, url, step, as a planner gave it; candidates: site, url, what it was offered; ranked: site, url, place. Rows site, url, step, planned.

    A site's plan holds if it isn't empty, names no page twice and none that wasn't offered; every other
    site that was offered pages keeps the ranked order of these.
    """
    offered = candidates.select("site", "url").distinct()
    met = plan.join(offered.withColumn("_offered", F.lit(True)), ["site", "url"], "left")
    fair = met.groupBy("site").agg(F.count("*").alias("n"), F.countDistinct("url").alias("kinds"), F.count("_offered").alias("offered"))
    fair = fair.where("n = kinds and n = offered").select("site")
    taken = plan.join(fair, "site", "left_semi").select("site", "url", "step", F.lit(True).alias("planned"))
    rest = ranked.join(offered, ["site", "url"], "left_semi").join(fair, "site", "left_anti")
    return taken.unionByName(rest.select("site", "url", F.col("place").cast(dict(plan.dtypes)["step"]).alias("step"), F.lit(False).alias("planned")))


def shortlist(pages: DataFrame, budget: int = 24_000, slack: int = 2051) -> DataFrame:
    """pages: site, root, url, known. Rows site, url, pos: sections take turns, the one with the best head first; a page goes in if its JSON string fits the bytes left, and a full round ends the list once it is within `slack` of the budget. One site's candidates are one row."""
    url = F.col("url")
    rank = F.when(url == F.col("root"), -2).when(F.col("known"), -1).otherwise(urls.rank(url))
    depth = F.when((url == F.col("root")) | F.col("known"), 0).otherwise(urls.depth(url))
    p = pages.withColumn("section", section_under(url, F.col("root"))).withColumn("_p", F.struct(rank.alias("rank"), depth.alias("depth"), url.alias("url")))
    own = Window.partitionBy("site", "section")
    p = p.withColumn("rn", F.row_number().over(own.orderBy("_p"))).withColumn("head", F.min("_p").over(own))
    cost = F.octet_length(F.to_json(F.struct(url.alias("u")))) - F.octet_length(F.lit('{"u":}')) + 1
    each = p.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("rn", "head", "url", cost.alias("cost")))).alias("all"))
    start = F.struct(F.lit(2).alias("size"), F.lit(False).alias("stop"), F.lit(1).alias("rn"), F.array().cast("array<struct<url:string,pos:int>>").alias("took"), F.lit(0).alias("pos"))

    def step(a, x):
        stop = a["stop"] | ((x["rn"] > a["rn"]) & (a["size"] >= budget - slack))
        fits = ~stop & (a["size"] + x["cost"] <= budget)
        pos = a["pos"] + 1
        return F.struct(F.when(fits, a["size"] + x["cost"]).otherwise(a["size"]).alias("size"), stop.alias("stop"), x["rn"].alias("rn"), F.when(fits, F.concat(a["took"], F.array(F.struct(x["url"].alias("url"), pos.alias("pos"))))).otherwise(a["took"]).alias("took"), pos.alias("pos"))

    return each.select("site", F.explode(F.aggregate("all", start, step)["took"]).alias("t")).select("site", "t.url", "t.pos")


def within_budget(rows: DataFrame, key: str, order: str, cost: str, budget: int) -> DataFrame:
    """Rows up to the first one whose cost goes over the budget, that one left out: nothing after it is taken, however small."""
    total = F.sum(cost).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("total", total).where(F.col("total") <= budget)


def fitting_links(pages: DataFrame, limit: int = 12_000) -> DataFrame:
    """pages: key, head (characters of the page as JSON without links), links. The links, in order, up to the first that brings the JSON over the limit."""
    size = lambda x: F.length(F.to_json(x))
    step = lambda a, x: F.when(a["full"], a).when(a["size"] + size(x) + F.when(a["n"] > 0, 2).otherwise(0) > limit, F.struct(a["size"].alias("size"), a["n"].alias("n"), F.lit(True).alias("full"))).otherwise(F.struct((a["size"] + size(x) + F.when(a["n"] > 0, 2).otherwise(0)).alias("size"), (a["n"] + 1).alias("n"), F.lit(False).alias("full")))
    start = F.struct(F.col("head").cast("int").alias("size"), F.lit(0).alias("n"), F.lit(False).alias("full"))
    return pages.withColumn("links", F.slice("links", F.lit(1), F.aggregate("links", start, step)["n"]))


def frontier(queued: DataFrame, visited: DataFrame, previous: DataFrame, roots: DataFrame) -> DataFrame:
    """URLs of each site that wait for a later crawl; all four: site, url."""
    known = visited.unionByName(previous).unionByName(roots)
    return queued.distinct().join(known, ["site", "url"], "left_anti")


def coverage(queued: DataFrame, visited: DataFrame, fresh: DataFrame, retained: DataFrame, hits: DataFrame) -> DataFrame:
    """Counts by site of URLs: discovered, read, unread, fresh, retained, cache_hits."""
    one = lambda df, name: df.select("site", "url").distinct().withColumn("what", F.lit(name))
    unread = one(queued.join(visited, ["site", "url"], "left_anti"), "unread")
    rows = unread
    for df, name in ((queued, "discovered"), (visited, "read"), (fresh, "fresh"), (retained, "retained"), (hits, "cache_hits")):
        rows = rows.unionByName(one(df, name))
    names = ["discovered", "read", "unread", "fresh", "retained", "cache_hits"]
    return rows.groupBy("site").agg(*(F.count_if(F.col("what") == n).alias(n) for n in names))


def crawled(pages: DataFrame, max_pages: int, text_budget: int, plan: DataFrame | None = None) -> DataFrame:
    """A crawl over captures: pages (site, root, url, known, outcome, chars) in reading order up to the page cap and the text budget, and why each site stopped."""
    own = Window.partitionBy("site")
    order = read_order(pages, plan).withColumn("n", F.count("*").over(own))
    took = within_budget(order.where(F.col("place") <= max_pages), "site", "place", "chars", text_budget)
    last = F.max("place").over(own)
    only = F.count_if(F.col("outcome") != "unavailable").over(own) == 0
    why = F.when(only, "fetch_failure").when(last < F.least("n", F.lit(max_pages)), "text_budget").when(last < F.col("n"), "explicit_page_budget").otherwise("coverage_plan_finished" if plan is not None else "exhausted")
    return took.withColumn("stopped", why).drop("n")


def usable(content: Column) -> Column:
    return F.length(collapsed(F.coalesce(content, F.lit("")))) >= 40
