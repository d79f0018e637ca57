"""Guides of a site and their hierarchy: suggestions, covering guides, rendering, delegation, bundles.

Guides have a path like /docs/. A prefix relation between paths is never tested
pair by pair: each path is exploded into itself and its ancestors, and these
meet the others by equality.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.functions import markdown, urls
from siteatlas.functions.text import collapsed, escaped

# First segments that make automatic children.
AUTOMATIC = "docs help support developers learn".split()
LEAST_PAGES, SUGGESTED = 3, 3


def folders(path: Column) -> Column:
    """A path's folder and its ancestors, / last: /a/b/c gives /a/b/, /a/, /."""
    parts = F.filter(F.split(F.regexp_replace(path, "[^/]*$", ""), "/"), lambda x: x != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.concat(F.lit("/"), F.array_join(F.transform(F.slice(parts, F.lit(1), n), lambda x: F.concat(x, F.lit("/"))), "")))


def path_of(url: Column) -> Column:
    """The guide path that a URL stands for: a file's folder, else the path with one slash at the end."""
    path = F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract(url, "^https?://[^/]+(.*)$", 1), F.lit("")), F.lit("/")), "[?#].*$", "")
    last = F.regexp_replace(path, "^.*/", "")
    return F.when(F.split_part(last, F.lit("."), F.lit(2)) != "", F.regexp_replace(path, "[^/]*$", "")).otherwise(F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/")))


def suggestions(pages: DataFrame, guides: DataFrame, eligible: list[str] = urls.ELIGIBLE) -> DataFrame:
    """pages: site, page, url; guides: site, path. Sections of three pages or more that have no guide, the three largest of each site; ties go to the one whose page comes first."""
    parts = F.split(F.regexp_replace(urls.part(F.col("url"), 3), "^/+|/+$", ""), "/")
    found = pages.select("site", "page", parts.alias("parts")).where((F.size("parts") > 1) & F.col("parts")[0].isin(eligible))
    n = found.groupBy("site", F.concat(F.lit("/"), F.col("parts")[0], F.lit("/")).alias("path")).agg(F.count("*").alias("n"), F.min("page").alias("first"))
    n = n.where(F.col("n") >= LEAST_PAGES).join(guides.select("site", "path"), ["site", "path"], "left_anti")
    place = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("n"), "first"))
    name = F.initcap(F.replace(F.regexp_replace("path", "^/|/$", ""), F.lit("-"), F.lit(" ")))
    return n.withColumn("place", place.cast("long")).where(F.col("place") <= SUGGESTED).select("site", "path", name.alias("name"), "n", "place")


def automatic_children(pages: DataFrame, guides: DataFrame) -> DataFrame:
    """Suggestions that become guides by themselves: of sites whose only guide is the root's, once."""
    once = guides.groupBy("site").agg((F.count("*") == 1).alias("one"), F.bool_or(F.col("path") == "/").alias("root")).where("one and root")
    return suggestions(pages.join(once.select("site"), "site", "left_semi"), guides, AUTOMATIC)


def covering(pages: DataFrame, guides: DataFrame) -> DataFrame:
    """pages: page, url; guides: guide (its file's URL). The deepest guide whose folder holds the page, of the same scheme and host; the greater URL among equals, null for none."""
    origin = lambda c: F.concat(urls.part(c, 1), F.lit("://"), urls.part(c, 2))
    url, guide = urls.normalized(F.col("url")), urls.normalized(F.col("guide"))
    path = urls.part(F.col("_u"), 3)
    scopes = guides.select("guide", guide.alias("_g")).select("guide", origin(F.col("_g")).alias("_origin"), F.regexp_replace(urls.part(F.col("_g"), 3), "[^/]*$", "").alias("_scope"))
    own = pages.withColumn("_u", url).withColumn("_origin", origin(F.col("_u"))).withColumn("_scope", F.explode_outer(F.array_union(F.array(F.concat(path, F.when(path.endswith("/"), "").otherwise("/"))), folders(path))))
    best = own.join(scopes, ["_origin", "_scope"]).groupBy("page").agg(F.max_by("guide", F.struct(F.length("_scope"), "guide")).alias("guide"))
    return pages.join(best, "page", "left").select("page", "guide")


def relatives(guides: DataFrame) -> DataFrame:
    """guides: site, guide, path. Rows site, parent, child, depth for every guide and each under it, itself left out; the deepest parent has depth 0."""
    up = guides.select("site", F.col("guide").alias("child"), F.col("path").alias("child_path"), F.explode(folders(F.col("path"))).alias("path"))
    met = up.join(guides.select("site", F.col("guide").alias("parent"), "path"), ["site", "path"]).where("parent <> child")
    depth = F.row_number().over(Window.partitionBy("site", "child").orderBy(F.desc(F.length("path")), "parent")) - 1
    return met.select("site", "parent", "child", "child_path", depth.cast("long").alias("depth"))


def ready_children(guides: DataFrame, versions: DataFrame) -> DataFrame:
    """Rows site, parent, child, path, name, markdown: guides under another one that have a draft and aren't cancelled."""
    drafts = guides.where(~F.col("auto_cancelled")).join(versions.select(F.col("version").alias("draft"), "markdown"), "draft")
    met = relatives(guides).join(drafts.select("site", F.col("guide").alias("child"), "path", "name", "markdown"), ["site", "child"])
    return met.select("site", "parent", "child", "path", "name", "markdown")


def retained(shortcuts: DataFrame, sources: DataFrame, decisions: DataFrame) -> DataFrame:
    """shortcuts: guide, source_id, decision_ids. Rows guide, canonical: links that stay with the parent, their source known and every decision that they cite active."""
    active = decisions.where("active").groupBy("guide").agg(F.collect_set("decision_id").alias("active"))
    met = shortcuts.join(sources.select("guide", "source_id", F.coalesce("markdown_url", "url").alias("url")), ["guide", "source_id"]).join(active, "guide", "left")
    met = met.where(F.size(F.array_except("decision_ids", F.coalesce("active", F.array().cast("array<string>")))) == 0)
    return met.select("guide", urls.canonical(urls.destination(F.col("url"))).alias("canonical")).where("canonical is not null").distinct()


def rendered(guides: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """guides: guide, title, summary, context (array); links: guide, section_pos, section, pos, source_id, label, description; sources: guide, source_id, url, markdown_url.

    Rows guide, markdown, missing (links whose source isn't there; the guide is an error then).
    """
    met = links.join(sources.select("guide", "source_id", F.coalesce("markdown_url", "url").alias("url")), ["guide", "source_id"], "left")
    line = F.concat(F.lit("- ["), escaped(F.col("label")), F.lit("](<"), urls.destination(F.col("url")), F.lit(">)"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), escaped(F.col("description")))).otherwise(""))
    met = met.withColumn("line", line).groupBy("guide", "section_pos", "section").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"), F.count_if(F.col("line").isNull()).alias("lost"))
    body = F.concat(F.lit("## "), escaped(F.col("section")), F.lit("\n\n"), F.array_join(F.transform("lines", lambda x: F.concat(x["line"], F.lit("\n"))), ""), F.lit("\n"))
    parts = met.select("guide", "section_pos", body.alias("body"), "lost").groupBy("guide").agg(F.array_sort(F.collect_list(F.struct("section_pos", "body"))).alias("parts"), F.sum("lost").alias("lost"))
    text = F.concat(
        F.lit("# "), escaped(F.col("title")), F.lit("\n\n"),
        F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("> "), escaped(F.col("summary")), F.lit("\n\n"))).otherwise(""),
        F.array_join(F.transform(F.coalesce("context", F.array().cast("array<string>")), lambda x: F.concat(escaped(x), F.lit("\n\n"))), ""),
        F.coalesce(F.array_join(F.transform("parts", lambda x: x["body"]), ""), F.lit("")),
    )
    return guides.join(parts, "guide", "left").select("guide", F.concat(F.rtrim(F.regexp_replace(text, r"\n+\z", "")), F.lit("\n")).alias("markdown"), F.coalesce("lost", F.lit(0)).alias("missing"))


def baseline(sources: DataFrame) -> DataFrame:
    """The guide that needs no model: every source (guide, pos, source_id, title, description) linked in one section; the first one's title."""
    first = F.min_by("title", "pos")
    links = F.transform(F.array_sort(F.collect_list(F.struct("pos", "source_id", "title", "description"))), lambda x: F.struct(x["source_id"].alias("source_id"), x["title"].alias("label"), F.nullif(x["description"], F.lit("")).alias("description")))
    return sources.groupBy("guide").agg(F.coalesce(first, F.lit("Website")).alias("title"), F.array(F.struct(F.lit("Resources").alias("title"), links.alias("links"))).alias("sections"))


def delegated(guides: DataFrame, children: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows guide, canonical: links that some child of the guide lists below its own path (not its root or another guide's file), unless they are kept."""
    home = lambda url: F.concat(urls.part(url, 1), F.lit("://"), urls.part(url, 2))
    below = children.join(guides.select(F.col("guide").alias("parent"), home(F.col("url")).alias("_home")), "parent")
    below = below.withColumn("_p", markdown.parsed(F.col("markdown"), F.concat("_home", "path", F.lit("llms.txt"))))
    listed = below.select(F.col("parent").alias("guide"), "path", F.lower("_home").alias("_home"), F.explode("_p.links").alias("x")).select("guide", "path", "_home", "x.canonical")
    page = F.regexp_replace(urls.part(F.col("canonical"), 3), "/+$", "")
    own = (home(F.col("canonical")) == F.col("_home")) & F.startswith(urls.part(F.col("canonical"), 3), F.col("path")) & (page != F.regexp_replace("path", "/+$", "")) & ~F.endswith(page, F.lit("/llms.txt"))
    return listed.where(own).select("guide", "canonical").distinct().join(kept.select("guide", "canonical").distinct(), ["guide", "canonical"], "left_anti")


def consolidated(guides: DataFrame, children: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows guide, text: the guide without list lines whose link goes to a child, and without the second-level sections that this leaves empty."""
    read = guides.where("markdown is not null").select("guide", "markdown", markdown.parsed(F.col("markdown"), F.coalesce("url", F.lit(""))).alias("p"))
    links = read.select("guide", F.explode("p.links").alias("x")).select("guide", "x.canonical", F.col("x.line").alias("n"))
    gone = links.join(delegated(guides, children, kept), ["guide", "canonical"], "left_semi").select("guide", "n", F.lit(True).alias("goes")).distinct()
    rows = read.select("guide", F.posexplode(markdown.lines(F.col("markdown"))).alias("n", "line")).select("guide", (F.col("n") + 1).alias("n"), "line")
    heads = read.select("guide", F.explode("p.headings").alias("h")).select("guide", F.col("h.line").alias("n"), F.col("h.level").alias("level"))
    met = rows.join(gone, ["guide", "n"], "left").join(heads, ["guide", "n"], "left")
    met = met.withColumn("goes", F.coalesce(F.col("goes") & F.startswith("line", F.lit("- [")), F.lit(False)))
    # A line's section is the last heading at or before it.
    section = F.last(F.when(F.col("level").isNotNull(), F.col("n")), ignorenulls=True).over(Window.partitionBy("guide").orderBy("n"))
    met = met.withColumn("section", F.coalesce(section, F.lit(0)))
    stays = F.col("level").isNull() & ~F.col("goes") & (F.trim(collapsed(F.col("line"))) != "")
    sections = met.groupBy("guide", "section").agg(F.max("level").alias("of"), F.count_if(stays).alias("left"))
    touched = met.where("goes").select("guide").distinct().withColumn("touched", F.lit(True))
    met = met.join(sections, ["guide", "section"]).join(touched, "guide", "left")
    kept_line = F.coalesce(F.col("touched"), F.lit(False)) & (F.col("goes") | ((F.col("of") == 2) & (F.col("left") == 0)))
    said = met.where(~F.coalesce(kept_line, F.lit(False))).groupBy("guide").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("own"))
    text = F.array_join(F.transform("own", lambda x: x["line"]), "")
    return guides.select("guide", "markdown").join(said.select("guide", text.alias("_said")), "guide", "left").select("guide", F.when(F.col("markdown").isNotNull(), F.coalesce("_said", F.lit(""))).alias("text"))


def related(markdown: Column, origin: Column, children: Column) -> Column:
    """The guide with a last section that links those children (path, name) whose file it doesn't name."""
    file = lambda c: F.concat(origin, c["path"], F.lit("llms.txt"))
    new = F.filter(children, lambda c: ~F.contains(markdown, file(c)))
    label = lambda c: F.regexp_replace(F.regexp_replace(c["name"], r"[\[\]]", ""), "\n", " ")
    lines = F.transform(new, lambda c: F.concat(F.lit("- ["), label(c), F.lit("](<"), file(c), F.lit(">): Guide to "), c["path"]))
    return F.when(F.size(new) > 0, F.concat(markdown, F.lit("\n## Related guides\n\n"), F.array_join(lines, "\n"), F.lit("\n"))).otherwise(markdown)


def linked(guides: DataFrame, children: DataFrame, kept: DataFrame) -> DataFrame:
    """guides: guide, url, markdown, manually_edited; children as ready_children(); kept as retained(). Rows guide, markdown: links that children list go to them, and children are named. A guide edited by hand keeps its lines."""
    below = children.groupBy(F.col("parent").alias("guide")).agg(F.array_sort(F.collect_list(F.struct("path", "name"))).alias("children"))
    met = guides.join(below, "guide", "left").join(consolidated(guides, children, kept), "guide", "left")
    none = F.array().cast("array<struct<path:string,name:string>>")
    origin = F.concat(urls.part(F.col("url"), 1), F.lit("://"), urls.part(F.col("url"), 2))
    said = F.when(F.col("manually_edited"), F.col("markdown")).otherwise(F.col("text"))
    return met.select("guide", said.alias("_said"), origin.alias("_origin"), F.coalesce("children", none).alias("children")).select("guide", related(F.col("_said"), F.col("_origin"), F.col("children")).alias("markdown"))


def parent_updates(changed: DataFrame, guides: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Every ancestor of a changed guide whose text differs from before: site, parent, depth of the nearest change, markdown; deepest first."""
    up = relatives(guides).join(changed.select(F.col("guide").alias("child")).distinct(), "child", "left_semi").groupBy("site", "parent").agg(F.min("depth").alias("depth"))
    met = up.join(after.withColumnRenamed("guide", "parent"), "parent").join(before.select(F.col("guide").alias("parent"), F.col("markdown").alias("old")), "parent", "left")
    return met.where(~F.col("markdown").eqNullSafe(F.col("old"))).select("site", "parent", "depth", "markdown").orderBy("site", "depth", "parent")


def relative(folder: Column, file: Column) -> Column:
    """Path from a folder like /a/b/ to a file."""
    steps = lambda p: F.filter(F.split(p, "/"), lambda x: x != "")
    a, b = steps(folder), steps(file)
    most = F.least(F.size(a), F.size(b) - 1)
    same = F.size(F.filter(F.sequence(F.lit(0), most), lambda n: F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n))) - 1
    return F.concat(F.repeat(F.lit("../"), F.size(a) - same), F.array_join(F.slice(b, same + 1, F.size(b) - same), "/"))


def bundle(guides: DataFrame) -> DataFrame:
    """guides: site, path, markdown, origin. Rows site, file, text, with links to the site's other guides relative to each."""
    files = guides.groupBy("site").agg(F.collect_set(F.concat("path", F.lit("llms.txt"))).alias("files"))
    local = F.aggregate("files", F.col("markdown"), lambda text, f: F.replace(text, F.concat(F.lit("(<"), F.col("origin"), f, F.lit(">)")), F.concat(F.lit("(<"), relative(F.col("path"), f), F.lit(">)"))))
    file = F.regexp_replace(F.concat("path", F.lit("llms.txt")), "^/", "")
    return guides.where("markdown is not null").join(files, "site").select("site", file.alias("file"), local.alias("text"))


def zipped(files: DataFrame) -> bytes:
    """One site's bundle as a ZIP, made on the driver; a bundle is as large as its guides."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for r in files.orderBy("file").select("file", "text").toLocalIterator():
            z.writestr(r.file, r.text)
    return out.getvalue()


def published(guides: DataFrame, versions: DataFrame) -> DataFrame:
    """Texts that the published address of each guide gives."""
    return guides.join(versions.select(F.col("version").alias("published_version"), "guide", "markdown"), ["guide", "published_version"]).select("guide", "path", "markdown")


def audit_lines(guides: DataFrame, cut: int = 80) -> DataFrame:
    """guides: id, category, url, accepted, parsed (parsed()). Lines (part, id, line) of a Markdown table, cells escaped; in order of part and id."""
    cell = lambda c: F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    cells = [cell(F.col("id")), cell(F.col("category")), F.left(cell(F.col("url")), F.lit(cut)), cell(F.col("accepted")), cell(F.col("parsed.metrics.link_count")), cell(F.array_join("parsed.flags", ", "))]
    names = ["id", "category", "url", "accepted", "links", "flags"]
    head = guides.sparkSession.range(2).select(F.col("id").cast("int").alias("part"), F.lit(None).cast(dict(guides.dtypes)["id"]).alias("id"), F.when(F.col("id") == 0, row([F.lit(n) for n in names])).otherwise(F.lit("|" + "---|" * len(names))).alias("line"))
    return head.unionByName(guides.select(F.lit(2).alias("part"), "id", row(cells).alias("line")))

