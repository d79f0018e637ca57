"""Operators against plain versions and the standard library, on random rows."""

import collections
import datetime as dt
import json
import random
import time
import urllib.robotparser

import pytest
from pyspark.sql import functions as F

from siteatlas.engine import Engine
from siteatlas.functions import text
from siteatlas.operators import changes, crawl, grading, guides, jobs, validation
from siteatlas.operators.quotes import GRAM, Quotes, Wanted, all_grams, matched_quotes
from siteatlas.operators.ranking import nth_row, placed
from siteatlas.operators.reconcile import reconcile
from siteatlas.sources import stores

rng = random.Random(9)
SEGMENTS = ["docs", "help", "blog", "tag", "pricing", "API", "a", "b"]


def section(url, root):
    base, path = root.split(".test", 1)[1].rstrip("/"), url.split(".test", 1)[1]
    return (path[len(base) :] if base and (path == base or path.startswith(base + "/")) else path).strip("/").split("/")[0] or "(entry)"


def priority(url, root, known):
    if url == root or known:
        return (-2 if url == root else -1, 0, url)
    parts = url.split(".test", 1)[1].lower().strip("/").split("/")
    return (3 if set(parts) & {"tag", "login"} else 0 if parts[-1] in {"docs", "help", "pricing", "api"} else 1, len(parts), url)


def site_rows(sites):
    out = []
    for s in range(sites):
        root = f"https://s{s}.test/{rng.choice(['', 'docs/', 'docs'])}"
        own = {root} | {f"https://s{s}.test/" + "/".join(rng.choice(SEGMENTS) + rng.choice(["", "1", "é"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 25))}
        out += [(s, root, u, u != root and rng.random() < 0.15) for u in sorted(own)]
    return out


def test_reading_order_is_greedy(spark):
    rows = site_rows(40)
    got = crawl.read_order(spark.createDataFrame(rows, "site long, root string, url string, known boolean")).collect()
    for s in range(40):
        own, reads, order = [r for r in rows if r[0] == s], collections.Counter(), []
        while own:
            best = min(own, key=lambda r: (-1 if r[2] == r[1] else reads[section(r[2], r[1])], priority(r[2], r[1], r[3])))
            own.remove(best)
            reads[section(best[2], best[1])] += 1
            order.append(best[2])
        assert [r.url for r in sorted((r for r in got if r.site == s), key=lambda r: r.place)] == order


def test_shortlist_is_the_loop(spark):
    rows = site_rows(60)
    got = crawl.shortlist(spark.createDataFrame(rows, "site long, root string, url string, known boolean"), 300, 120).collect()
    stopped = 0
    for s in range(60):
        own = [r for r in rows if r[0] == s]
        groups = collections.defaultdict(list)
        for r in own:
            groups[section(r[2], r[1])].append(priority(r[2], r[1], r[3]))
        queues = sorted((sorted(g) for g in groups.values()), key=lambda g: g[0])
        out, size = [], 2
        while any(queues):
            for g in queues:
                if g:
                    url = g.pop(0)[2]
                    cost = len(json.dumps(url, ensure_ascii=False).encode()) + 1
                    if size + cost <= 300:
                        out.append(url)
                        size += cost
            if size >= 180:
                stopped += any(queues)
                break
        assert [r.url for r in sorted((r for r in got if r.site == s), key=lambda r: r.pos)] == out
    assert stopped


def test_robots_agree_with_the_standard_library(spark):
    bodies, paths = [], ["/", "/a", "/a/b", "/b?x=1", "/login", "/c%20d", "/docs/api"]
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(0, 3)):
            lines += [f"User-Agent: {rng.choice(['*', 'siteatlas', 'Other', 'site'])}" for _ in range(rng.randint(1, 2))]
            lines += [f"{rng.choice(['Allow', 'disallow'])}: {rng.choice(['', '/', '/a', '/a/b', '/b', '/c d', '/docs', '*'])} # x" for _ in range(rng.randint(0, 4))]
            lines += [""] * rng.randint(0, 1)
        bodies.append("\n".join(lines))
    rows = [(f"https://h{i}.test", 200, b) for i, b in enumerate(bodies)] + [("https://gone.test", 404, "User-agent: *\nDisallow: /"), ("https://down.test", 503, "")]
    pages = [(1, o + p) for o, _, _ in rows for p in paths]
    scopes = spark.createDataFrame([(1, "https://h0.test/")], "site long, root string")
    policies = crawl.robots_policies(spark.createDataFrame(rows, "origin string, status int, body string"))
    got = {r.url: r.allowed for r in crawl.readable(spark.createDataFrame(pages, "site long, url string"), scopes, policies, "siteatlas").collect()}
    for origin, status, body in rows:
        parser = urllib.robotparser.RobotFileParser()
        parser.parse(body.splitlines() if status == 200 else [])
        for p in paths:
            assert got[origin + p] == (None if status == 503 else parser.can_fetch("siteatlas", origin + p)), (body, p)


def test_reconcile_by_the_table(spark):
    urls = [f"u{i}" for i in range(300)]
    stored = {u: (rng.choice("xy"), rng.randint(0, 1)) for u in urls if rng.random() < 0.6}
    seen = {u: rng.choice([("ok", "x"), ("ok", "y"), ("not-found", None), ("unavailable", None)]) for u in urls if rng.random() < 0.7}
    want = {}
    for u in stored.keys() | seen.keys():
        old, (outcome, new) = stored.get(u), seen.get(u, (None, None))
        if outcome == "ok":
            want[u] = ("added" if old is None else "modified" if old[0] != new else "none", new, 0)
        elif outcome == "not-found" and old:
            want[u] = ("removed", None, None) if old[1] >= 1 else ("unavailable", old[0], old[1] + 1)
        elif outcome == "unavailable":
            want[u] = ("unavailable", *(old or (None, None)))
        else:
            want[u] = ("none", *(old or (None, None)))
    a = spark.createDataFrame([(u, *v) for u, v in stored.items()], "url string, hash string, not_found_count long")
    b = spark.createDataFrame([(u, o, h) for u, (o, h) in seen.items()], "url string, outcome string, hash string")
    assert {r.url: (r.change, r.hash, r.not_found_count) for r in reconcile(a, b).collect()} == want


def test_places(spark):
    rows = [(rng.choice("abc") if rng.random() < 0.5 else "hot", i * i) for i in range(400)]
    got = sorted(map(tuple, placed(spark.createDataFrame(rows, "k string, o long"), "k", "o", 8).select("k", "o", "place", "n").collect()))
    by = collections.defaultdict(list)
    for k, o in rows:
        by[k].append(o)
    assert got == sorted((k, o, i, len(os)) for k, os in by.items() for i, o in enumerate(sorted(os)))


@pytest.mark.parametrize(("broadcast", "bits"), [(1 << 20, 20), (0, 20), (0, 16)])
def test_quotes_in_texts(spark, broadcast, bits):
    say = lambda n: " ".join(rng.choice(["a", "b", "ß", "日本", "the", "\x00"]) for _ in range(n))
    texts = [(i, say(rng.randint(0, 60))) for i in range(60)] + [(99, None), (98, ""), (97, "aaaaaaaaaaaaaaaaaaaaaaaa"), (3, "a second row of three"), (96, "ab")]
    quotes = [(i, (t := rng.choice(texts[:60])[1])[(b := rng.randint(0, 80)) : b + rng.randint(0, 30)]) for i in range(80)]
    quotes += [(900, "zz zz zz zz zz"), (901, ""), (902, "a  b c d e"), (903, None), (904, "a" * 9), (904, "a" * 24), (905, "a" * 25), (906, "second"), (906, "second row of three"), (907, "b")]
    got = matched_quotes(spark.createDataFrame(quotes, "q long, quote string"), spark.createDataFrame(texts, "d long, text string").repartition(3), "q", "d", broadcast, bits)
    want = collections.Counter((q, d) for q, s in quotes if s is not None for d in {d for d, t in texts if t is not None and s in t})
    assert collections.Counter(map(tuple, got.collect())) == want


def test_quotes_take_linear_time():
    words = [rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(200_000)]
    text = " ".join(words).encode()
    quotes = [" ".join(words[i : i + 7]).encode() for i in range(0, 20_000, 40)] + [b"abc", b"h h"]
    took = []
    for n in (1, 4):
        texts, began = [text * n], time.process_time()
        counts = collections.Counter()
        for _, number in Wanted(all_grams(quotes), GRAM).found(texts[0] + bytes(GRAM - 1)):
            counts.update(all_grams(quotes)[number].tolist())
        found = Quotes(quotes, counts).matches(texts)
        took.append(time.process_time() - began)
        assert found == [(0, i) for i, q in enumerate(quotes) if q in texts[0]]
    assert took[1] < 8 * took[0] + 0.5


def test_guides_end_to_end(spark):
    e = Engine(spark)
    sources = spark.createDataFrame([("g", i, f"s{i}", f"T*{i}", "about" if i else "", f"https://x.test/p{i}", None) for i in range(3)], "guide string, pos long, source_id string, title string, description string, url string, markdown_url string")
    base = e.generate(sources)
    links = base.select("guide", F.posexplode("sections").alias("section_pos", "s")).select("guide", "section_pos", F.col("s.title").alias("section"), F.posexplode("s.links").alias("pos", "l")).select("guide", "section_pos", "section", "pos", "l.*")
    head = base.select("guide", "title", F.lit(None).cast("string").alias("summary"), F.array().cast("array<string>").alias("context"))
    text = e.render(head, links, sources).first().markdown
    assert text == "# T\\*0\n\n## Resources\n\n- [T\\*0](<https://x.test/p0>)\n- [T\\*1](<https://x.test/p1>): about\n- [T\\*2](<https://x.test/p2>): about\n"
    parsed = e.parse(spark.createDataFrame([(text, "https://x.test/llms.txt")], "text string, base string")).first().parsed
    assert [x.label for x in parsed.links] == ["T*0", "T*1", "T*2"] and parsed.flags == []
    assert guides.zipped(guides.bundle(spark.createDataFrame([(1, "/", text, "https://x.test")], "site long, path string, markdown string, origin string")))[:2] == b"PK"


def test_linked_guides(spark):
    parent = "# Site\n\n## Guides\n\n- [In](/docs/in)\n- [Kept](/docs/kept)\n"
    g = spark.createDataFrame([(1, "root", "/", "Root", "v1", False, parent, "https://x.test/llms.txt", False), (1, "docs", "/docs/", "Do[c]s", "v2", False, "# D\n- [In](/docs/in)\n- [Kept](/docs/kept)\n", "https://x.test/docs/llms.txt", False), (1, "gone", "/gone/", "G", None, False, "", "https://x.test/gone/llms.txt", False), (1, "hand", "/", "H", "v4", False, parent, "https://x.test/llms.txt", True)], "site long, guide string, path string, name string, draft string, auto_cancelled boolean, markdown string, url string, manually_edited boolean")
    ready = guides.ready_children(g.drop("markdown"), g.where("draft is not null").select(F.col("draft").alias("version"), "markdown")).where("child = 'docs'")
    kept = spark.createDataFrame([("root", "https://x.test/docs/kept")], "guide string, canonical string")
    out = {r.guide: r.markdown for r in guides.linked(g, ready, kept).collect()}
    tail = "\n## Related guides\n\n- [Docs](<https://x.test/docs/llms.txt>): Guide to /docs/\n"
    assert out["root"] == "# Site\n\n## Guides\n\n- [Kept](/docs/kept)\n" + tail and out["hand"] == parent + tail and out["gone"] == ""


def test_leases_of_jobs(spark):
    now = dt.datetime(2024, 1, 1, 12)
    at = lambda m: now + dt.timedelta(minutes=m)
    rows = [(1, "k", "pending", 0, at(-9), None, None), (2, "k", "pending", 0, at(9), None, None), (3, "k", "running", 2, at(-99), at(-1), "t"), (4, "k", "running", 3, at(-99), at(-1), "t"), (5, "k", "running", 1, at(-99), at(1), "t"), (6, "k", "pending", 3, at(-99), None, None)]
    j = spark.createDataFrame([(*r, None, "k", 3, 1) for r in rows], "job long, kind string, status string, attempt long, available_at timestamp, lease_until timestamp, lease_token string, error string, key string, max_attempts long, project long")
    out = {r.job: (r.status, r.attempt, r.taken) for r in jobs.claimed(j, F.lit(now), 2).collect()}
    assert out == {1: ("running", 1, True), 2: ("pending", 0, False), 3: ("running", 3, True), 4: ("failed", 3, False), 5: ("running", 1, False), 6: ("pending", 3, False)}
    assert [r.x for r in spark.range(8).select(jobs.backoff(F.col("id")).alias("x")).collect()] == [5, 10, 20, 40, 80, 160, 300, 300]


def test_dialogue_and_trials(spark):
    schema = "stage string, ambiguity_pattern string, expect_question boolean, questions array<struct<question:string,options:array<string>,rationale:string,recommended:int>>, document string, links array<string>, claims array<struct<text:string,evidence_ids:array<string>>>, expected struct<include:array<string>,exclude:array<string>,document_pattern:string,kind:string,removed_forbidden:string>"
    q = [("Which region?", ["EU", " eu "], "too short", None)]
    rows = [("first", "REGION", True, q, "d", ["a"], [], None), ("first", "region", True, [], "d", [], [], None), ("first", "region", False, q, "d", [], [], None), ("custom", "region", True, q, "made in 1999", ["x"], [("since 1999", ["answer"])], (["y"], ["x"], "199[0-9]", "fact", None)), ("removed", "zz", True, [], "secret", [], [], ([], [], None, None, "SECRET"))]
    got = [r.f for r in spark.createDataFrame(rows, schema).select(grading.dialogue().alias("f")).collect()]
    assert got == [["no recommendation", "repeated options", "terse rationale"], ["question missing"], ["needless question", "no recommendation", "repeated options", "terse rationale"], ["missing resource: y", "resource retained: x", "asked again"], ["removed fact persists"]]


def test_stores(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k long, v string, o long")
    assert sorted(map(tuple, stores.upserted(t, new, ["k"], F.col("o")).collect())) == [(1, "a"), (2, "d"), (3, "e")]
    stores.appended(t, f"{tmp_path}/t")
    stores.appended(t, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4
    stores.artifacts(t, t.agg(F.count("*").alias("n")), f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r/report").first().n == 2
    (tmp_path / "case.json").write_text('[{"id": "x",\n "n": 1}, {"id": "y", "n": 2}]')
    assert stores.corpus(spark, f"{tmp_path}/case.json").count() == 2
    runs = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, None), (1, 5, None)], "k long, o long, p string")
    assert [r.o for r in changes.unchanged_payloads(runs, "k", F.col("o"), "p").orderBy("o").collect()] == [1, 3, 4]


def test_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    assert crawl.read_order(none("site long, root string, url string, known boolean")).count() == 0
    assert crawl.shortlist(none("site long, root string, url string, known boolean")).count() == 0
    assert guides.suggestions(none("site long, page long, url string"), none("site long, path string")).count() == 0
    assert changes.source_changes(*[none("project long, source_id string, url string, title string, content string")] * 2).count() == 0
    assert placed(none("k string, o long"), "k", "o").count() == 0


def test_row_at_a_share(spark):
    for n, share, kind in ((0, 0.95, "double"), (1, 0.95, "double"), (37, 0.95, "long"), (5000, 0.95, "double"), (5000, 0.5, "long"), (5000, 0.0, "double")):
        values = [rng.choice([rng.gauss(0, 1e6), 5.0, -3.25]) if kind == "double" else rng.randint(0, 40) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in [*values, None]], f"took {kind}")
        got = nth_row(df, "took", share, buckets=8, few=20).first().took
        assert got == (sorted(values)[min(n - 1, int(n * share))] if n else None)


def test_strings_and_anchors(spark):
    payloads = ['{"b": [1, {"c": "x y", "a": [["deep"], null, ""]}], "name": "z"}', '"alone"', "[]", "{}", "not json", None, '{"k": {"k": {"k": {"k": "four"}}}}']
    df = spark.createDataFrame([(i, p, ["deep", "name", "x", "four", "alone"]) for i, p in enumerate(payloads)], "review int, payload string, quotes array<string>")
    got = collections.Counter((r.review, r.path, r.text) for r in grading.strings_of(df, "review", "payload").collect())
    assert got == collections.Counter([(0, "$.b[1].c", "x y"), (0, "$.b[1].a[0][0]", "deep"), (0, "$.b[1].a[2]", ""), (0, "$.name", "z"), (1, "$", "alone"), (6, "$.k.k.k.k", "four")])
    invalid = {r.review: r.invalid for r in grading.anchored(df).collect()}
    assert invalid[0] == ["name", "four", "alone"] and invalid[1] == ["deep", "name", "x", "four"] and len(invalid[4]) == len(invalid[5]) == 5


def test_fingerprints_without_order(spark):
    one = spark.sql("select named_struct('a', 1, 'b', named_struct('x', 'é', 'y', array(named_struct('p', 1, 'q', 2)))) as v")
    two = spark.sql("select named_struct('b', named_struct('y', array(named_struct('q', 2, 'p', 1)), 'x', 'é'), 'a', 1) as v")
    other = spark.sql("select named_struct('b', named_struct('y', array(named_struct('q', 1, 'p', 2)), 'x', 'é'), 'a', 1) as v")
    a, b, c = (f.select(text.fingerprint(F.col("v")).alias("x")).first().x for f in (one, two, other))
    assert a == b != c


def test_reader_opens_what_was_linked(spark):
    steps = [(1, 0, "open", "g"), (1, 1, "open", "s"), (1, 2, "answer", None), (1, 3, "open", "s"), (2, 0, "open", "s"), (2, 1, "open", "g"), (2, 2, "open", "s"), (2, 3, "open", "g"), (3, 0, "abstain", None), (4, 0, "open", "gone"), (5, 0, "open", "x")]
    entries = [(t, u) for t in range(1, 6) for u in ("g", "gone")]
    reads, ends = grading.replayed_reads(
        spark.createDataFrame(steps, "trial int, step int, action string, url string"),
        spark.createDataFrame(entries, "trial int, url string"),
        spark.createDataFrame([("g", "guide"), ("s", "source")], "url string, kind string"),
        spark.createDataFrame([("g", "s"), ("g", "g")], "url string, link string"),
    )
    assert {(r.trial, r.step): r.result for r in reads.collect()} == {(1, 0): "guide", (1, 1): "source", (2, 0): "refused: not linked", (2, 1): "guide", (2, 2): "source", (4, 0): "refused: not captured", (5, 0): "refused: not linked"}
    assert {r.trial: (r.outcome, r.opens) for r in ends.collect()} == {1: ("answer", 2), 2: ("exhausted", 3), 3: ("abstain", 0), 4: ("none", 1), 5: ("none", 1)}


def test_plans_are_checked(spark):
    pages = spark.createDataFrame([(s, "https://x.test/", f"https://x.test/{p}", False) for s in range(4) for p in ("a", "b/c", "d")], "site long, root string, url string, known boolean")
    offered = pages.where("url <> 'https://x.test/d'").select("site", "url")

    def assess(candidates):
        assert candidates.columns == ["site", "url"]
        rows = [(0, "b/c", 0), (0, "a", 1), (1, "a", 0), (1, "d", 1), (2, "a", 0), (2, "a", 1)]
        return spark.createDataFrame([(s, f"https://x.test/{p}", k) for s, p, k in rows], "site long, url string, step long")

    got = Engine(spark, assessor=assess).plan(pages, offered)
    assert sorted((r.site, r.url[-1], r.planned) for r in got.orderBy("site", "step").collect()) == sorted([(0, "c", True), (0, "a", True), *((s, u, False) for s in (1, 2, 3) for u in "ac")])
    assert [r.url[-1] for r in got.where("site = 0").orderBy("step").collect()] == ["c", "a"]
    assert Engine(spark).plan(pages, offered).where("planned").isEmpty()


def test_repeated_identifiers_fail(spark):
    good = spark.createDataFrame([(1, "a"), (2, "a"), (None, "b")], "id int, v string")
    assert validation.unique(good, "id").count() == 3
    for keys in (["v"], ["id", "v"]):
        with pytest.raises(Exception, match="repeated identifier: .*a"):
            validation.unique(good.unionByName(spark.createDataFrame([(2, "a")], "id int, v string")), *keys).collect()


def test_backfill(spark):
    table = spark.createDataFrame([(1, "x", None), (2, "x", "kept"), (3, "x", None), (4, "x", None)], "id int, kind string, v string")
    source = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "z"), (4, "q")], "id int, v string")
    got = stores.backfilled(table, source, ["id"], "v", spark.createDataFrame([(1,), (1,), (2,), (3,)], "id int"), ["id"])
    assert {r.id: r.v for r in got.collect()} == {1: "a", 2: "kept", 3: None, 4: None} and got.columns == table.columns


def test_crawls_in_rounds(spark):
    """Batches, sections in turn, what is known, scope, robots, files and missing captures, against a plain queue."""
    from siteatlas.operators.site_crawl import crawl_sites

    pages = {0: [f"https://a{s}.test/{p}" for s in (0,) for p in ("", "docs/x", "docs/y", "blog/1", "blog/2", "private/z", "file.pdf", "docs/gone", "deep/a/b")]}
    home, x, y, b1, b2, private, pdf, gone, deep = pages[0]
    graph = {home: [x, b1, private, pdf, "https://other.test/", home], x: [y, gone, b2], b1: [x], y: [deep], b2: [], deep: [home]}
    captures = [(u, "extract", 10 * (i + 1), 100, 1.0) for i, u in enumerate(graph)] + [(gone, "not-found", 5, 1, 0.5)]
    sites = [(1, home, None, None, None, None), (2, home, 3, None, None, None), (3, "https://none.test/", None, None, None, None), (4, home, None, None, None, 35), (5, home, None, 2.0, None, None), (6, home, None, None, 250, None)]
    rows = spark.createDataFrame(sites, "site long, root string, max_pages long, max_seconds double, max_bytes long, max_chars long")
    links = spark.createDataFrame([(u, v) for u, vs in graph.items() for v in vs], "url string, link string")
    rules = spark.createDataFrame([("https://a0.test", 200, "User-agent: *\nDisallow: /private")], "origin string, status int, body string")
    reads, ends = crawl_sites(rows, spark.createDataFrame(captures, "url string, outcome string, chars long, bytes long, seconds double"), links, crawl.robots_policies(rules), "bot", known=spark.createDataFrame([(1, b2)], "site long, url string"), batch=2)
    got = collections.defaultdict(list)
    for r in reads.orderBy("site", "place").collect():
        got[r.site].append(r.url)
    stops = {r.site: (r.stopped, r.pages, r.unread) for r in ends.collect()}
    assert got[1][:2] == [home, b2] and sorted(got[1]) == sorted([home, x, y, b1, b2, gone, deep]) and stops[1] == ("exhausted", 7, 0)
    assert len(got[2]) == 3 and stops[2][0] == "explicit_page_budget"
    assert got[3] == ["https://none.test/"] and stops[3] == ("fetch_failure", 1, 0)
    assert stops[4][0] == "text_budget" and stops[5][:2] == ("time_budget", 2) and stops[6][:2] == ("download_budget", 2)
    none = rows.limit(0)
    reads, ends = crawl_sites(none, spark.createDataFrame(captures, "url string, outcome string, chars long, bytes long, seconds double"), links, crawl.robots_policies(rules), "bot")
    assert reads.isEmpty() and ends.isEmpty()


def test_crawl_looks_ahead(spark, monkeypatch):
    """Many rounds in few steps, the same order however far a step sees, and pages that are found in the round of a stop."""
    from siteatlas.operators import site_crawl

    labels, plain = [], site_crawl.stored
    monkeypatch.setattr(site_crawl, "stored", lambda df, label: labels.append(label) or plain(df, label))
    home, a, b, c = (f"https://b.test/{p}" for p in ("", "x/a", "x/b", "x/c"))
    wide = [f"https://w.test/{'ab'[i % 2]}/{i:02}" for i in range(40)]
    graph = {home: [a, b], a: [c], "https://w.test/": wide[:30], wide[3]: wide[30:]}
    chars = {home: 10, a: 20, b: 80, c: 5}
    captures = spark.createDataFrame([(u, "extract", chars.get(u, 1), 1, 1.0) for u in [home, a, b, c, "https://w.test/", *wide]], "url string, outcome string, chars long, bytes long, seconds double")
    links = spark.createDataFrame([(u, v) for u, vs in graph.items() for v in vs], "url string, link string")
    sites = spark.createDataFrame([(1, home, None, None, None, 35), (2, "https://w.test/", None, None, None, None)], "site long, root string, max_pages long, max_seconds double, max_bytes long, max_chars long")
    rules = spark.createDataFrame([(f"https://{h}.test", 404, "") for h in "bw"], "origin string, status int, body string")
    orders = []
    for far in ({}, {"ahead": 8}):
        reads, ends = site_crawl.crawl_sites(sites, captures, links, crawl.robots_policies(rules), "bot", batch=2, **far)
        if not far:
            assert labels.count("crawl-queue") <= 4
        orders.append(sorted((r.site, r.place, r.url) for r in reads.collect()))
        assert sorted((r.site, r.stopped, r.pages, r.unread) for r in ends.collect()) == [(1, "text_budget", 3, 1), (2, "exhausted", 41, 0)]
    assert orders[0] == orders[1] and [u for s, _, u in orders[0] if s == 1] == [home, a, c]


def test_sitemaps_of_any_depth(spark):
    index = lambda *maps: "<sitemapindex>" + "".join(f"<sitemap><loc>{m}</loc></sitemap>" for m in maps) + "</sitemapindex>"
    urlset = lambda *urls: "<u:urlset xmlns:u='s'>" + "".join(f"<u:url><u:loc> {u} </u:loc></u:url>" for u in urls) + "</u:urlset>"
    files = {"r": index("i", "m1", "broken", "dtd", "r"), "i": index("m2", "i"), "m1": urlset("a", "b&amp;c", "", "d"), "m2": urlset("e", "<![CDATA[f]]>"), "broken": "<urlset><url><loc>x</loc></url>", "dtd": "<!DOCTYPE a><urlset><url><loc>x</loc></url></urlset>", "empty": "<urlset/>", "null": None}
    captures = spark.createDataFrame([(k, 200, v) for k, v in files.items()] + [("gone", 404, urlset("x"))], "sitemap string, status int, body string")
    offsets = spark.createDataFrame([("m1", 1)], "sitemap string, resume_at long")
    roots = spark.createDataFrame([(1, "r"), (2, "empty"), (3, "null"), (4, "gone"), (5, "nowhere"), (6, "m2")], "site long, sitemap string")
    found, rest = crawl.discovered(roots, captures, offsets)
    assert sorted((r.site, r.sitemap, r.depth, r.pos, r.location) for r in found.collect()) == [(1, "m1", 1, 1, "b&c"), (1, "m1", 1, 2, "d"), (1, "m2", 2, 0, "e"), (1, "m2", 2, 1, "f"), (6, "m2", 0, 0, "e"), (6, "m2", 0, 1, "f")]
    assert rest.isEmpty()
    found, rest = crawl.discovered(roots.where("site = 1"), captures, offsets, url_bytes=4)
    assert [r.location for r in found.orderBy("depth", "pos").collect()] == ["b&c", "d"] and [tuple(r) for r in rest.collect()] == [("m2", 0)]
    assert crawl.discovered(roots.limit(0), captures, offsets)[0].isEmpty()
