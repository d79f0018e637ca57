import collections
import math
import re

import duckdb
import pytest

import __spark_entry__ as entry
from siteatlas.functions import urls
from siteatlas.operators.ranking import STOP, bm25
from siteatlas.operators.reconcile import reconcile
from siteatlas.plans import catalogue, evals, site  # noqa: F401

SF = "/root/testdata/sf0.001"


def rows(frame):
    text = lambda v: "" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in r) for r in frame)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    asked = duck.sql(catalogue.SQL[name])
    assert sorted(asked.columns) == names
    order = ", ".join(f'"{n}"' for n in names)
    assert rows(df.select(*names).collect()) == rows(duck.sql(f"select {order} from ({catalogue.SQL[name]})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries())


def test_stream_is_batch(spark):
    got = catalogue.QUERIES["progress_stream"](spark, SF)
    want = catalogue.QUERIES["progress_changes"](spark, SF)
    assert rows(got.select("user_id", "event_id", "event_type").collect()) == rows(want.select("user_id", "event_id", "event_type").collect())


def test_urls(spark):
    cases = {
        "HTTP://Shop.Test.ORG:80/Basket/?z=9&utm_campaign=q&a=&b=1#pay": "http://shop.test.org/Basket/?b=1&z=9",
        "https://wiki.test.org/a/./b/../c/": "https://wiki.test.org/a/c/",
        "http://test.org:80": "http://test.org/",
        "gopher://test.org/": None,
        "https://me:pw@test.org/": None,
        "https://printer.local/": None,
        "https://192.168.1.7/": None,
        "https://te st.org/": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string").select("url", urls.normalized(urls.F.col("url")).alias("n"))
    assert {r.url: r.n for r in df.collect()} == cases


def test_reconcile(spark):
    stored = spark.createDataFrame([("a", "1", 0), ("b", "1", 0), ("c", "1", 1), ("d", "1", 1), ("e", "1", 1), ("f", "1", 0)], "url string, hash string, not_found_count long")
    seen = spark.createDataFrame([("a", "ok", "2"), ("b", "not-found", None), ("c", "not-found", None), ("d", "ok", "1"), ("e", "unavailable", None), ("g", "ok", "1"), ("h", "not-found", None), ("i", "unavailable", None)], "url string, outcome string, hash string")
    got = {r.url: (r.change, r.hash, r.not_found_count) for r in reconcile(stored, seen).collect()}
    assert got == {"a": ("modified", "2", 0), "b": ("unavailable", "1", 1), "c": ("removed", None, None), "d": ("none", "1", 0), "e": ("unavailable", "1", 1), "f": ("none", "1", 0), "g": ("added", "1", 0), "h": ("none", None, None), "i": ("unavailable", None, None)}


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "Kettles boil water in copper and steel", "a"), (2, "Water pumps", "b"), (3, "Garden chairs", "c"), (4, "Copper kettles, copper pans", "a")], "doc_id long, text string, url string")
    asked = spark.createDataFrame([(1, "Which kettles are of copper?"), (2, "quartz"), (3, "copper water")], "query_id long, text string")

    def plain(distinct):
        terms = {r.doc_id: re.findall(r"[^\W_]+", r.text.lower()) for r in docs.collect()}
        terms = {d: [t for t in ts if t not in STOP] for d, ts in terms.items()}
        mean, page = sum(map(len, terms.values())) / len(terms), {r.doc_id: r.url for r in docs.collect()}
        out = []
        for r in asked.collect():
            scores = collections.Counter()
            for t in (t for t in re.findall(r"[^\W_]+", r.text.lower()) if t not in STOP):
                df = sum(t in ts for ts in terms.values())
                for d, ts in terms.items():
                    tf = ts.count(t)
                    scores[d] += math.log(1 + (len(terms) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / mean))
            best, seen = sorted((-round(x, 6), d) for d, x in scores.items() if x > 0), set()
            best = [d for _, d in best if not distinct or not (page[d] in seen or seen.add(page[d]))]
            out += [(r.query_id, d, k + 1) for k, d in enumerate(best[:3])]
        return sorted(out)

    for url in (None, "url"):
        assert sorted((r.query_id, r.doc_id, r["rank"]) for r in bm25(asked, docs, url=url).collect()) == plain(url)


def same_over(spark, folder, name, pages):
    """Whether a query gives the rows of its SQL over pages (page_id, url, html) of its own."""
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, str(folder))
    names = sorted(df.columns)
    return rows(df.select(*names).collect()) == rows(con.sql(f"select {', '.join(names)} from ({catalogue.SQL[name]})").fetchall())


def test_replays_of_shared_urls(spark, tmp_path):
    """Two pages of one URL, one captured and one not."""
    assert same_over(spark, tmp_path, "replayed_pages", [(1, "https://a.test/x", "abc"), (2, "https://a.test/x", "ab"), (3, "https://a.test/y", "abcdef"), (4, "https://a.test/x", "abcd")])


def test_guide_paths_of_any_end(spark, tmp_path):
    """Every kind of alteration over paths with and without a slash at their end, the root alone, and none."""
    ends = ["https://a.test/en/1", "https://a.test/en/1/", "https://a.test/", "https://a.test", "https://a.test/en/1/?q"]
    assert same_over(spark, tmp_path, "guide_paths", [(9 * i + n, url, "x" * n) for i, url in enumerate(ends) for n in range(9)])
