"""A crawl that finds its own pages, over captures: rounds until no site has a page left to read or a reason to go on.

In each round every site that goes on reads its next pages, those of the section
read least so far first; pages that were read give their links, of which the
ones in scope, permitted by robots rules, of a page's kind and never seen join
the site's queue.

Several rounds are one step of Spark jobs. Joins gather, for each site, the first
AHEAD pages of its queue (no other page of it can be among its next AHEAD reads),
their links, the first 2 * AHEAD pages that these lead to, and so on for LEVELS of
links; one function then goes through a site's rounds on these rows, and leaves off
before a page that was not gathered. So its rows don't grow with the site, and the order is the same as
round by round. What a step leaves behind (queue, reads, why sites stopped) is
stored, and the next one reads that: a lost executor costs a step's work at most,
and plans don't grow with the steps.

A site stops before the first page that breaks a limit, for the first reason
that holds: explicit_page_budget, time_budget (seconds of the pages before it),
download_budget (bytes, this page counted), text_budget (characters, this page
counted). Its queue as it stands then stays unread; pages found in that same round
are still read as far as they fit the limits. With its queue empty the reason is
fetch_failure if no page answered, coverage_plan_finished with a plan, else
exhausted. Limits that are null don't hold.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.functions import urls
from siteatlas.operators import crawl
from siteatlas.sources.stores import stored

#: Pages of a site in a round; pages of a site that a step looks ahead, and how often it follows their links; steps after which the reads of each are written as one table.
BATCH, AHEAD, LEVELS, COMPACT = 4, 64, 3, 8
READS = "site long, url string, section string, place long, outcome string, chars long, bytes long, seconds double"
_QUEUE = ["site", "url", "section", "entry", "planned", "step", "rank", "depth", "live"]
_SIZES = ["chars", "bytes", "seconds"]
_LIMITS = ["max_pages", "max_seconds", "max_bytes", "max_chars"]


def _sections(pages: DataFrame, sites: DataFrame) -> DataFrame:
    return pages.join(sites.select("site", "root"), "site").withColumn("section", crawl.section_under(F.col("url"), F.col("root"))).drop("root")


def _best() -> Column:
    return F.struct("step", "rank", "depth", "url")


def _first(queue: DataFrame, reads: DataFrame, n: int) -> DataFrame:
    """The first n pages of each site's queue: section by section as often as read so far, best page first; a plan's pages by step. `done` are the reads of the page's section."""
    done = reads.groupBy("site", "section").agg(F.count("*").alias("done"))
    own = queue.withColumn("_n", F.row_number().over(Window.partitionBy("site", "section").orderBy(_best()))).where(F.col("_n") <= n)
    own = own.join(done, ["site", "section"], "left").withColumn("done", F.coalesce("done", F.lit(0)))
    turn = F.when(F.col("entry"), -1).when(F.col("planned"), 0).otherwise(F.col("done") + F.col("_n") - 1)
    return own.withColumn("_k", F.row_number().over(Window.partitionBy("site").orderBy(turn, _best()))).where(F.col("_k") <= n).drop("_n", "_k")


def _fetched(pages: DataFrame, captures: DataFrame) -> DataFrame:
    got = pages.join(captures, "url", "left").withColumn("outcome", F.coalesce("outcome", F.lit("unavailable")))
    got = got.withColumn("chars", F.when(F.col("outcome").isin("extract", "reuse"), F.col("chars")).otherwise(0).cast("long"))
    return got.withColumn("bytes", F.coalesce("bytes", F.lit(0)).cast("long")).withColumn("seconds", F.coalesce("seconds", F.lit(0.0)).cast("double"))


def _unseen(pages: DataFrame, edges: DataFrame, queue: DataFrame, reads: DataFrame) -> DataFrame:
    """What the pages (site, url, outcome) that answered link to and their sites have not seen, by the linking page."""
    read = pages.where(F.col("outcome").isin("extract", "reuse")).select("site", F.col("url").alias("parent"))
    seen = queue.select("site", "url").unionByName(reads.select("site", "url"))
    return edges.join(read, ["site", "parent"]).join(seen, ["site", "url"], "left_anti")


def _rounds(batch: int, ahead: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A site's rounds over gathered rows: its pages (with `queued`, or found by a link), and links (with `parent`)."""

    def go(rows: pd.DataFrame) -> pd.DataFrame:
        site, pages, links, queue, known, out = rows["site"].iloc[0], {}, {}, {}, set(), []
        done = dict(zip(rows["section"], rows["done"], strict=True))
        limits = [None if pd.isna(x) else x for x in rows[_LIMITS].iloc[0]]
        n, *total = rows[["all_pages", *(f"all_{c}" for c in _SIZES)]].iloc[0]
        n, total = int(n), [int(total[0]), int(total[1]), float(total[2])]

        def join(r) -> None:
            if r.url not in known:
                known.add(r.url)
                insort(queue.setdefault(r.section, []), ((r.step, r.rank, r.depth, r.url), bool(r.entry), bool(r.planned)))

        for r in rows.itertuples(index=False):
            if isinstance(r.parent, str):
                links.setdefault(r.parent, []).append(r)
                continue
            pages[r.url] = r
            if r.queued:
                join(r)
        for turn in range(ahead // batch):
            next_ = sorted((-1 if entry else 0 if planned else done[s] + i, best, s, (best, entry, planned)) for s, own in queue.items() for i, (best, entry, planned) in enumerate(own[:batch]))[:batch]
            if not next_ or any(best[-1] not in pages for _, best, _, _ in next_):
                break
            why, kept = None, []
            for _, best, s, item in next_:
                r = pages[best[-1]]
                sums = [total[0] + int(r.chars), total[1] + int(r.bytes), total[2] + float(r.seconds)]
                over = ((limits[0], n + 1, "explicit_page_budget"), (limits[1], total[2], "time_budget"), (limits[2], sums[1], "download_budget"), (limits[3], sums[0], "text_budget"))
                why = next((name for limit, x, name in over if limit is not None and (x >= limit if name == "time_budget" else x > limit)), None)
                if why:
                    break
                n, total = n + 1, sums
                kept.append(r)
                queue[s].remove(item)
                done[s] += 1
                out.append((site, r.url, s, n, r.outcome, int(r.chars), int(r.bytes), float(r.seconds), turn, None))
            for r in kept:
                for link in links.get(r.url, ()):
                    join(link)
            if why:
                out.append((site, None, None, None, None, None, None, None, turn, why))
                break
        made = pd.DataFrame(out, columns=["site", "url", "section", "place", "outcome", *_SIZES, "turn", "stopped"])
        return made.astype({c: "Int64" for c in ("place", "chars", "bytes", "turn")})

    return go


def crawl_sites(sites: DataFrame, captures: DataFrame, links: DataFrame, policies: DataFrame, agent: str, known: DataFrame | None = None, plan: DataFrame | None = None, batch: int = BATCH, ahead: int = AHEAD) -> tuple[DataFrame, DataFrame]:
    """sites: site, root, max_pages, max_seconds, max_bytes, max_chars; captures: url, outcome (as crawl.outcome), chars, bytes, seconds; links: url, link (normalised); policies: as crawl.robots_policies; known: site, url read before; plan: site, url, step for sites that read a plan's pages only.

    Rows site, url, section, place, outcome, chars, bytes, seconds in order of reading; and rows site, stopped, pages, unread.
    """
    sites = sites.withColumn("root", F.coalesce(urls.normalized(F.col("root")), F.col("root")))
    kind, url = dict(sites.dtypes)["site"], F.col("url")
    given = sites.select("site", F.col("root").alias("url"), F.lit(True).alias("entry"), F.lit(False).alias("known"), F.lit(-1).cast("long").alias("step"))
    none = F.lit(None).cast("long").alias("step")
    if known is not None:
        given = given.unionByName(known.select("site", "url", F.lit(False).alias("entry"), F.lit(True).alias("known"), none))
    followed, has = sites.select("site"), sites.select("site", F.lit(True).alias("_planned")).limit(0)
    if plan is not None:
        has = plan.select("site").distinct().withColumn("_planned", F.lit(True))
        followed = followed.join(has, "site", "left_anti")
        given = given.unionByName(plan.select("site", "url", F.lit(False).alias("entry"), F.lit(False).alias("known"), F.col("step").cast("long").alias("step")))
    given = given.groupBy("site", "url").agg(F.max("entry").alias("entry"), F.max("known").alias("known"), F.max("step").alias("step"))
    given = given.join(has, "site", "left").withColumn("planned", F.coalesce("_planned", F.lit(False)))
    given = given.withColumn("step", F.when(F.col("planned"), F.coalesce("step", F.lit(1 << 40))).otherwise(F.lit(0)).cast("long"))
    near = F.col("entry") | F.col("known")
    given = given.withColumn("rank", F.when(F.col("entry"), -2).when(F.col("known"), -1).otherwise(urls.rank(url)).cast("int")).withColumn("depth", F.when(near, 0).otherwise(urls.depth(url)).cast("int"))
    # every step reads captures and, by site, the links that its rules let in
    captures = stored(captures.select("url", "outcome", *_SIZES), "crawl-captures")
    links = stored(links.select("url", "link").distinct(), "crawl-links")
    host = crawl.bare_host
    fit = links.select(F.col("link").alias("url")).distinct().where(crawl.is_page(url)).withColumn("_host", host(url))
    fit = fit.join(sites.join(followed, "site", "left_semi").select("site", host(F.col("root")).alias("_host")), "_host").select("site", "url")
    fit = _sections(crawl.readable(fit, sites.select("site", "root"), policies, agent).where("read").select("site", "url"), sites)
    fit = fit.withColumn("rank", urls.rank(url).cast("int")).withColumn("depth", urls.depth(url).cast("int"))
    edges = stored(links.select(F.col("url").alias("parent"), F.col("link").alias("url")).join(fit, "url"), "crawl-edges")
    queue = stored(_sections(given, sites).withColumn("live", F.lit(True)).select(*_QUEUE), "crawl-queue")
    reads = stored(sites.sparkSession.createDataFrame([], READS.replace("site long", f"site {kind}")), "crawl-reads")
    stops = stored(sites.select("site", F.lit(0).alias("at"), F.lit(None).cast("string").alias("stopped")).limit(0), "crawl-stops")
    new = {"entry": F.lit(False), "planned": F.lit(False), "step": F.lit(0).cast("long")}
    ahead, steps = max(ahead, batch), 0
    while not queue.where("live").isEmpty():
        first = stored(_fetched(_first(queue.where("live"), reads, ahead), captures), "crawl-first")
        done = reads.groupBy("site", "section").agg(F.count("*").alias("done"))
        met = lambda found: found.join(done, ["site", "section"], "left").withColumns(new | {"done": F.coalesce("done", F.lit(0))})
        level, found, gathered = first, None, first.drop("live").withColumn("queued", F.lit(True))
        for _ in range(LEVELS):
            found = stored(met(_unseen(level, edges, queue, reads)), "crawl-found")
            level = stored(_fetched(_first(found.drop("parent").distinct().join(gathered.select("site", "url"), ["site", "url"], "left_anti").drop("done"), reads, 2 * ahead), captures), "crawl-level")
            gathered = gathered.unionByName(level.withColumn("queued", F.lit(False)).withColumn("parent", F.lit(None).cast("string")), allowMissingColumns=True).unionByName(found, allowMissingColumns=True)
        gathered = gathered.unionByName(met(_unseen(level, edges, queue, reads)), allowMissingColumns=True)
        sums = reads.groupBy("site").agg(F.count("*").alias("all_pages"), *(F.sum(c).alias(f"all_{c}") for c in _SIZES))
        state = sites.select("site", *_LIMITS).join(sums, "site", "left").na.fill(0, ["all_pages", "all_chars", "all_bytes"]).na.fill(0.0, ["all_seconds"])
        gathered = gathered.join(state, "site")
        went = stored(gathered.groupBy("site").applyInPandas(_rounds(batch, ahead), READS.replace("site long", f"site {kind}") + ", turn long, stopped string"), "crawl-went")
        kept, over = went.where("url is not null"), went.where("stopped is not null").select("site", "turn", "stopped")
        # a stopped site keeps what its last round found
        found = _unseen(kept, edges, queue, reads).join(kept.select("site", F.col("url").alias("parent"), "turn"), ["site", "parent"])
        found = found.groupBy("site", "url", "section", "rank", "depth").agg(F.min("turn").alias("found")).withColumns(new | {"live": F.lit(True)})
        rest = queue.withColumn("found", F.lit(-1).cast("long")).unionByName(found).join(kept.select("site", "url"), ["site", "url"], "left_anti")
        ended = over.select("site", F.col("turn").alias("_end"))
        rest = rest.join(ended, "site", "left").withColumn("live", F.col("live") & (F.col("_end").isNull() | (F.col("found") >= F.col("_end"))))
        queue = stored(rest.select(*_QUEUE), "crawl-queue")
        reads, stops, steps = reads.unionByName(kept.drop("turn", "stopped")), stops.unionByName(over.select("site", F.lit(steps).alias("at"), "stopped")), steps + 1
        if steps % COMPACT == 0:
            reads, stops = stored(reads, "crawl-reads"), stored(stops, "crawl-stops")
    ended = reads.groupBy("site").agg(F.count("*").alias("pages"), F.count_if(F.col("outcome") != "unavailable").alias("answered"))
    unread = queue.groupBy("site").agg(F.count("*").alias("unread"))
    stops = stops.groupBy("site").agg(F.min_by("stopped", "at").alias("stopped"))
    met = sites.select("site").join(stops, "site", "left").join(ended, "site", "left").join(unread, "site", "left").join(has, "site", "left")
    why = F.coalesce("stopped", F.when(F.coalesce("answered", F.lit(0)) == 0, "fetch_failure").when(F.col("_planned"), "coverage_plan_finished").otherwise("exhausted"))
    return reads, met.select("site", why.alias("stopped"), F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("unread", F.lit(0)).alias("unread"))
