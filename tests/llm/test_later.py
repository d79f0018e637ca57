"""The source audit, the vector search and the alignment of tokenizers against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from siteatlas.llm import alignment, divergence, extraction, nearest, queries

rng = random.Random(5)
SF = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def by_duckdb(sql, **frames):
    with duckdb.connect() as con:
        for name, pdf in frames.items():
            con.register(name, pdf)
        found = con.sql(sql)
        return found.columns, found.fetchall()


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_exact_top_k"])
def test_sql(spark, name):
    with duckdb.connect() as con:
        for t in ("documents", "embeddings"):
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        found = con.sql(queries.SQL[name])
        names, want = found.columns, found.fetchall()
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df, *names) == collections.Counter(want)


# Source audit.

WORDS = ["Ab", "b", "ß", "c", "DD", "é", "f", "g", "ı", "x1y"]


def audited(rows, top):
    """Term by term over every pair, in Python's whole numbers."""
    docs = [(lang or "", source or "", [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for _, _, ts in own for t in set(ts))
        kept = [t for t, n in df.items() if n >= 3]
        counts = {s: collections.Counter(t for _, s2, ts in own if s2 == s for t in ts if df[t] >= 3) for s in {d[1] for d in own}}
        total = sum(counts.values(), collections.Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))  # noqa: B023, E731
        f = lambda x, y: (x - y) ** 2 // y
        for s, c in counts.items():
            pairs = [(-sum(f(p(c, t), p(c2, t)) for t in kept), s2.encode()) for s2, c2 in counts.items() if s2 != s]
            terms = [(-f(p(c, t), p(total, t)), t.encode()) for t in kept if c[t] and p(c, t) > p(total, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


def made_sources(n):
    pick = lambda: " ".join(rng.choices(WORDS, [9, 7, 5, 3, 2, 2, 1, 1, 1, 1], k=rng.randint(0, 30)))
    rows = [(rng.choice(["de", "en"]), f"s{min(rng.randint(0, 9), 4)}", pick()) for _ in range(n)]
    return [*rows, rows[0], rows[0], (None, None, "Ab b"), ("xx", "only", None), ("xx", "other", "rare words here"), ("de", None, ""), ("de", "long", " ".join(["Ab", "q\x00r"] * 400) + "z" * 300)]


@pytest.mark.parametrize(("block", "pairs", "top"), [(1 << 20, 1 << 19, 200), (90, 4, 2)])
def test_divergence(spark, block, pairs, top):
    rows = made_sources(150)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, n int").repartition(4)
    found = divergence.divergence_audit(df, top=top, block=block, pairs=pairs)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert rows_of(found, *found.columns) == collections.Counter(audited(rows, top))


def test_divisions_are_exact(spark):
    pairs = [(c, m) for m in (1, 3, 999, 10**9 + 7, 9 * 10**15) for c in (0, m // 3, m - 1)]
    df = spark.createDataFrame(pairs, "c long, m long")
    got = df.select("c", "m", divergence._p(df.c, df.m)).collect()
    assert all(r[2] == 1 + 10**9 * (r[0] + 1) // r[1] for r in got)


# Search.


def searched(rows, k=20, every=20):
    own = [(i, tuple(math.floor(64 * float(np.float32(x))) for x in v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) and abs(x) <= nearest.LIMIT for x in v)]
    out = collections.Counter()
    for at, (i, v) in enumerate(own):
        if i is not None and i % every == 0:
            rest = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), j is None, j or 0) for x, (j, w) in enumerate(own) if x != at))[:k]
            out.update((i, n + 1, None if none else j, -s) for n, (s, none, j) in enumerate(rest))
    return out


def made_vectors(n, width, spread):
    point = lambda: [round(rng.gauss(0, spread), 2) for _ in range(width)]
    centres = [point() for _ in range(5)]
    rows = [(i, [a + rng.gauss(0, spread / 8) for a in rng.choice(centres)]) for i in range(n)]
    rows += [(1000 + i, list(centres[0])) for i in range(60)]  # one vector many times
    rows += [(40, list(centres[1])), (40, list(centres[1])), (None, list(centres[1])), (2000, None), (2020, [1.0, None] + [0.0] * (width - 2)), (2040, [float("nan")] * width), (2060, [float("inf")] * width), (2080, [1e30] * width), (2100, [0.5]), (-20, [0.0] * width)]
    return rows


@pytest.mark.parametrize(("shard", "leaf", "least", "part", "spread", "width"), [(40, 4, 8, 5, 0.3, 6), (1 << 16, 128, 2048, 1 << 17, 0.02, 3), (25, 3, 8, 1 << 17, 5000.0, 4), (60, 7, 8, 9, 200000.0, 5)])
def test_top_k(spark, shard, leaf, least, part, spread, width):
    rows = made_vectors(300, width, spread)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, q int").repartition(5)
    found = nearest.top_k(df, shard=shard, leaf=leaf, least_shard=least, part=part)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert rows_of(found, *found.columns) == searched(rows)


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (21, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert rows_of(nearest.top_k(df), "query_id", "rank", "vec_id", "score") == {(20, 1, 21, 64 * 32): 1}


def test_boxes_spare_leaves():
    """Leaves whose box can't hold a better vector aren't visited."""
    r = np.random.default_rng(3)
    v = np.unique(np.concatenate([r.integers(-5, 5, (400, 8)) + 60 * np.eye(8, dtype=np.int64)[c] for c in range(8)]), axis=0)
    tree, met = nearest.Tree(v, np.arange(len(v)), 16), []
    whole = tree._met
    tree._met = lambda visits, *rest: met.extend(visits) or whole(visits, *rest)
    q, s, _ = tree.search(v[:40], 5, np.full(40, -(1 << 62)), np.zeros(40, np.int64))
    want = -np.sort(-(v[:40] @ v.T), axis=1)[:, :5]
    assert (s.reshape(40, 5) == want).all() and len(met) < 0.4 * 40 * sum(c is None for c in tree.child)


# Alignment.


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.tokenizer_paths()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=path_b)


def plain_groups(tokenizers, text):
    """Whole text at once; token ends by each token's own bytes."""
    if not text:
        return None
    a, b = tokenizers
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    stands = alignment._byte_characters()
    raw_a = [bytes(stands[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return None
    spans = lambda raw: [(sum(map(len, raw[:i])), sum(map(len, raw[: i + 1]))) for i in range(len(raw))]
    spans_a, spans_b = spans(raw_a), spans(raw_b)
    cuts, groups, last = sorted({e for _, e in spans_a} & {e for _, e in spans_b}), [], 0
    for cut in cuts:
        groups.append("|".join(",".join(str(i) for i, (s, _) in zip(ids, at, strict=True) if last <= s < cut) for ids, at in ((ids_a, spans_a), (ids_b, spans_b))))
        last = cut
    links = [(x, y) for x, (i, j) in zip(ids_a, spans_a, strict=True) for y, (k, m) in zip(ids_b, spans_b, strict=True) if max(i, k) < min(j, m)]
    return len(ids_a), len(ids_b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def aligned(tokenizers, rows):
    found = [(i, plain_groups(tokenizers, t)) for i, t in rows]
    counts = collections.Counter(x for _, f in found if f for x in f[3])
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return collections.Counter((i, *((f[0], f[1], f[2], len(f[3]), sum(counts[x] == best[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), f[4]) if f else (0, 0, 0, 0, 0, 0, ""))) for i, f in found)


ODD_TEXTS = [
    None, "", " ", "  ", "a", " a b", "a  b", "a \n b\t\tc ", "\x00x \x1c y", "▁ a b", "a ▁b c", "it's they'll don 't", "ß é 😀 x😀y 日本語 と 中文", "a　b c   d", "<|endoftext|> <s> </s> <unk> <0x41>",
    "1234567890 3.14159 0xdeadbeef", "a" * 700, "ab " * 300, "é" * 200 + " " + "日" * 100, "tabs\tand\nlines\r\nend\n", "é ﬁ ½", "﻿x ​ y",
]


@pytest.mark.parametrize(("chunks", "members"), [(150_000, 8_000_000), (5, 20)])
def test_alignment(spark, tokenizers, chunks, members):
    alphabet = ["a", "the", "ß", " ", "\n", "1", "é", "▁", "😀", "'s", "-", "\t", " ", "word", "ing", "Q"]
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(3, "a  b"), (None, "the word"), (None, None)]
    rows += [(100 + i, "".join(rng.choices(alphabet, [3, 3, 1, 12, 1, 1, 1, 0.05, 1, 1, 1, 1, 0.5, 3, 2, 1], k=rng.randint(1, 60)))) for i in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, block string").repartition(3)
    found = alignment.align_tokenizers(df, *alignment.tokenizer_paths(), block_chunks=chunks, block_occurrences=members)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(found, *found.columns) == aligned(tokenizers, rows)


def test_alignment_of_documents(spark, tokenizers):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 1500")
    rows = [tuple(r) for r in docs.collect()]
    found = alignment.align_tokenizers(docs, *alignment.tokenizer_paths())
    assert len(rows) > 50 and rows_of(found, *found.columns) == aligned(tokenizers, rows)
    assert queries.QUERIES["op13_tokenizer_alignment"](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.divergence_audit(docs).count() == 0
    assert alignment.align_tokenizers(docs, *alignment.tokenizer_paths()).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.top_k(vectors).count() == 0


# Extraction.


def slow_text(page):
    """Lines by the standard library's parser, windows by their definition."""
    from html.parser import HTMLParser

    blocks: list[list] = [["", False, False, 0, 0]]  # text, furniture, main, characters, of links

    class Reader(HTMLParser):
        stack: list = []

        def state(self):
            return (any(f for _, f, _ in self.stack), any(m for _, _, m in self.stack), any(t == "a" for t, _, _ in self.stack))

        def cut(self, tag):
            if tag in extraction._INLINE or tag == "br":
                return
            blocks.append(["", *self.state()[:2], 0, 0])
            if tag in extraction._CONTAINERS and not self.state()[1]:
                blocks.append([None])
                blocks.append(["", *self.state()[:2], 0, 0])

        def handle_starttag(self, tag, attrs):
            self.cut(tag)
            if tag == "br":
                blocks[-1][0] += " "
            if tag in extraction._VOID:
                return
            while self.stack and tag in ("p", "li") and any(t == tag for t, _, _ in self.stack[-2:]):
                self.stack.pop()
            known = dict(attrs).get("class", "")
            inside = self.state()[1]
            bad = tag in ("nav", "footer", "aside", "form", "head", "script", "style", "title") or (tag == "header" and not inside) or known in ("ad", "comments")
            self.stack.append((tag, bad, tag in ("article", "main") and not bad))
            if tag not in extraction._INLINE:
                blocks[-1][1:3] = self.state()[:2]

        def handle_endtag(self, tag):
            self.cut(tag)
            if any(t == tag for t, _, _ in self.stack):
                while self.stack.pop()[0] != tag:
                    pass
            if tag not in extraction._INLINE:
                blocks[-1][1:3] = self.state()[:2]

        def handle_data(self, data):
            blocks[-1][0] += data
            blocks[-1][3] += len(data.strip())
            blocks[-1][4] += len(data.strip()) if self.state()[2] else 0

    reader = Reader()
    reader.stack = []
    reader.feed(page)
    reader.close()
    lines = [("", False, False, 0.0) if b == [None] else (" ".join(b[0].split()), b[1], b[2], b[4] / b[3] if b[3] else 0.0) for b in blocks if b == [None] or b[0].split()]
    size = [0 if bad or (linked > 0.6 and not m) else len(t) for t, bad, m, linked in lines]

    def read(weights, share):
        n, spans = len(lines), []
        while sum(len(s) for s in spans) < n:
            at = sum(len(s) for s in spans)
            end = next((j for j in range(at, n) if lines[j][2] != lines[at][2]), n)
            spans.append(range(at, end))
        window = {i: sum(weights[j] for j in s if i <= j < i + extraction.WINDOW) for s in spans for i in s}
        least = max(extraction.SURGE, min(extraction.SURGE_MOST, share * max(window.values(), default=0)))
        kept = set()
        for s in spans:
            for i in s:
                if weights[i] and window[i] >= least and i not in kept:
                    dive = next((j for j in s if j > i and not window[j]), s[-1] + 1)
                    rise = next((j for j in reversed(s) if j < i and (not weights[j] or j in kept)), s[0] - 1)
                    kept |= {j for j in range(rise + 1, dive) if weights[j]}
        return sorted(kept)

    own = read([n * extraction.INSIDE if x[2] else 0 for n, x in zip(size, lines, strict=True)], 0)
    if not own:
        own = read([0 if x[2] else n for n, x in zip(size, lines, strict=True)], extraction.SURGE_SHARE)
    return " ".join(lines[i][0] for i in own)


def test_extraction_against_plain_version(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    pages += [re.sub(r"<(/?)article\b", r"<\1div", p) for p in pages]
    pages += [re.sub(r"<(/?)(article|nav)\b", r"<\1section", p).replace('class="ad"', "").replace("<p>", "<div><p>", 2) for p in pages[:20]]
    assert [extraction.main_text(p) for p in pages] == [slow_text(p) for p in pages]


def test_windows_decide_without_names(spark):
    pages = [re.sub(r"<(/?)article\b", r"<\1div", r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    plain = [extraction.main_text(p, names=False) for p in pages]
    for window, surge in ((1, 40), (8, 40), (3, 1), (3, 200)):
        assert sum(extraction.main_text(p, window, surge, names=False) != x for p, x in zip(pages, plain, strict=True)) >= len(pages) // 10


def test_comments_and_notices_beside_an_article():
    comments = "".join(f'<div class="entry"><p>Entry number {i}, which says a good many things about the text above.</p></div>' for i in range(6))
    page = f'<article><h1>Head.</h1><p>{"A short article, some words of it. " * 4}</p></article><div class="thread">{comments}</div><div><p>Legal. {"All rights are reserved, and so on. " * 12}</p></div>'
    assert extraction.main_text(page) == " ".join(("Head. " + "A short article, some words of it. " * 4).split())


@pytest.mark.parametrize("part", ["<p ", '<a "', "<!", "<a '\">", '<a href="x>', "<script", "</", "<div class=a>", "<", "<p>x", "<b a='>", "<!--", "&amp"])
def test_malformed_pages_take_linear_time(part):
    import time

    took = []
    for n in (300_000, 1_200_000):
        began = time.process_time()
        extraction.main_text(part * (n // len(part)))
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.3


# Toxicity.


def test_held_out_recall(spark):
    """Rows labelled toxic whose identifiers training never sees; nine of them hold no mark that any other toxic row holds."""
    from pyspark.sql import functions as F

    from siteatlas.llm import toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    net = toxicity.train(docs, labels)
    held = docs.join(labels.select("doc_id", "toxic"), "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    rows = [(r.src.toxic, r.predicted) for r in toxicity.toxicity(held, net).collect()]
    caught, toxic = sum(p for y, p in rows if y), sum(y for y, _ in rows)
    assert toxic == 144 and caught >= 0.88 * toxic and sum(p for y, p in rows if not y) <= 0.015 * (len(rows) - toxic)
    assert toxicity.toxicity(docs.limit(0), net).count() == 0


def test_training_leaves_the_driver_alone(spark, monkeypatch):
    """The network is what fit() gives for the same rows in order, and no training runs in this process."""
    from siteatlas.llm import toxicity

    rows = [(i, f"{'vequoti ' * (i % 4 == 0)}word{i % 7} other{i % 11} more{i % 5}") for i in range(60)]
    fair = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    want = toxicity.fit([t for _, t in fair], [int(i % 4 == 0) for i, _ in fair])

    def refuse(*_):
        raise AssertionError("training on the driver")

    monkeypatch.setattr(toxicity.Network, "backward", refuse)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    net = toxicity.train(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    assert net.p.keys() == want.p.keys()
    assert all(net.p[k].shape == x.shape and np.allclose(net.p[k], x, atol=1e-3) for k, x in want.p.items())
    assert toxicity.train(docs, spark.createDataFrame([(i, 0) for i, _ in rows], "doc_id long, toxic int")) is None


# Language model.


def test_keys_of_pairs_are_one_to_one(tmp_path):
    from siteatlas.llm import kneser_ney as kn

    every = np.array([a << 32 | b for a in range(32) for b in range(32)], np.uint64)
    assert len(np.unique(kn._scrambled(every, 5))) == 1024
    r = np.random.default_rng(1)
    for width, n in ((5, 700), (17, 5000), (24, 5000), (32, 5000)):
        pairs = np.unique(r.integers(0, 1 << width, n, dtype=np.uint64) << np.uint64(32) | r.integers(0, 1 << width, n, dtype=np.uint64))
        known, rest = pairs[::2], pairs[1::2]
        kn._save_rows(str(tmp_path / str(width)), 2, 0, known, np.arange(len(known))[None, :], width)
        files = kn.Arrays(str(tmp_path / str(width)))
        for keys, there in ((known, True), (rest, False)):
            (_, own, place, found), *more = files.find("2", 1, keys, keys, width)
            assert not more and (found == there).all() and len(own) == len(keys)
            if there:
                rows, codes = files.get("rows2-0", np.int64), files.get("codes2-0", kn._code_kind(len(known)))
                assert (rows[codes[place]] == own).all()
        assert (tmp_path / str(width) / "keys2-0").exists() == (width >= 24)  # too few keys for so many buckets
