"""Source divergence audit by joint count histograms.

Words are counted by source in blocks of texts, where each task makes one row of
a language, source and term; rows of a term meet once and a language keeps the
terms of at least `min_docs` documents. For each pair of a language's sources
the joint histogram says how many kept terms have the counts (a, b) in them.
Only cells of two positive counts are tallied from terms; cells with a zero are
implied: a source's own histogram less what the joint cells hold of it, and
both zeros are what is left of all kept terms. The divergence is evaluated once
for each cell, both ways, times the cell's number of terms. So work follows the
sources that terms share and the distinct counts, not terms times pairs.

Probabilities are whole numbers, p = 1 + floor(SCALE (count + 1) / (N + V)), and
a term's share of the divergence of p from q is floor((p - q)^2 / q); divisions
are done in three steps of long numbers, exact up to N + V of 9 * 10^15.

Defined results: null text, language and source count as ''; every (language,
source) that occurs is a group, also without any kept term, where all of its
pairs are 0; repeated rows are documents of their own; an empty table gives no
rows; only the three columns are read, others are not looked at. A long text is
read in pieces and still counts as one document of each of its terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.llm.storage import durable, table, tune

MIN_DOCS, SCALE_STEP, TOP_TERMS = 3, 1000, 200
#: Bytes of text that are counted together; pairs that are tallied together.
BLOCK, PAIRS = 14 << 20, 1 << 19
#: A-Z to a-z, other letters and all bytes of other characters as they are, the rest to spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _terms(folded: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of folded text, and where each one starts."""
    raw = np.frombuffer(folded, dtype=np.uint8)
    letter = np.zeros(len(raw) + 2, dtype=np.int8)
    letter[1:-1] = raw != 32
    step = np.diff(letter)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[raw != 32])), starts


def _block_counts(groups: list[tuple[str, str]], texts: list[bytes]) -> pa.RecordBatch:
    """Rows of one block of whole texts; groups: language and source of each text."""
    words, starts = _terms(b" ".join(texts).translate(_FOLD))
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    coded = words.dictionary_encode()
    code, width = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
    names = list(dict.fromkeys(groups))
    place = {g: i for i, g in enumerate(names)}
    group_of = np.array([place[g] for g in groups], dtype=np.int64)
    cells, n = np.unique(group_of[doc] * width + code, return_counts=True)
    once = np.unique(doc * width + code)
    docs = np.unique(group_of[once // width] * width + once % width, return_counts=True)[1]
    group = cells // width
    column = lambda i: pa.DictionaryArray.from_arrays(pa.array(group, pa.int32()), pa.array([g[i] for g in names], pa.string())).cast(pa.string())
    return pa.RecordBatch.from_arrays([column(0), column(1), coded.dictionary.take(pa.array(cells % width)), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=_COUNTED)


def _long_counts(group: tuple[str, str], text: bytes, block: int) -> Iterator[pa.RecordBatch]:
    """Rows of one long text, read in pieces; a term's first piece tells that it is in the document."""
    folded, at, seen = text.translate(_FOLD), 0, set()
    while at < len(folded):
        end = len(folded) if len(folded) - at <= block else folded.rfind(b" ", at, at + block)
        if end <= at:
            end = found if (found := folded.find(b" ", at + block)) >= 0 else len(folded)
        rows = _block_counts([group], [folded[at:end]])
        terms = rows.column(2).to_pylist()
        fresh = pa.array([int(t not in seen) for t in terms], pa.int64())
        seen.update(terms)
        yield rows.set_column(4, _COUNTED.field(4), fresh)
        at = end


def _count(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    groups, texts, size = [], [], 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(text) > block:
                yield from _long_counts((lang, source), text, block)
                continue
            groups.append((lang, source))
            texts.append(text)
            size += len(text) + 1
            if size >= block:
                yield _block_counts(groups, texts)
                groups, texts, size = [], [], 0
    if texts:
        yield _block_counts(groups, texts)


def kept_terms(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, block: int = BLOCK) -> DataFrame:
    """A row for each kept term of a language: lang, term, total, held (its sources with their counts, sorted by source)."""
    tune(df.sparkSession)
    read = df.select(*(F.coalesce(df[c].cast("string"), F.lit("")).alias(c2) for c, c2 in ((lang_col, "lang"), (source_col, "source"))), F.coalesce(df[text_col], F.lit("")).cast("binary").alias("text"))
    counted = read.mapInArrow(lambda it: _count(it, block), "lang string, source string, term string, n long, docs long")
    met = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    held = met.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("held"))
    return held.where(F.col("docs") >= min_docs).select("lang", "term", "total", "held")


_CELLS = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("ca", pa.int64()), ("cb", pa.int64()), ("n", pa.int64())])


def _tally(batches: Iterator[pa.RecordBatch], pairs: int) -> Iterator[pa.RecordBatch]:
    """Joint cells of two positive counts, and what they take from the cells of one source with a zero, of (lang, held)."""
    keys = ["lang", "a", "b", "ca", "cb"]
    held: list[pd.DataFrame] = []
    size = 0

    def met(frames: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(frames).groupby(keys, sort=False, observed=True, as_index=False)["n"].sum()

    def told(frames: list[pd.DataFrame], names: list[str], langs: list[str]) -> pa.RecordBatch:
        joint = met(frames)
        left, right = joint.assign(cb=0, n=-joint["n"]), joint.assign(ca=0, n=-joint["n"])
        out = pd.concat([joint, met([left]), met([right])])
        text = lambda c, of: pa.DictionaryArray.from_arrays(pa.array(out[c].to_numpy(), pa.int32()), pa.array(of, pa.string())).cast(pa.string())
        return pa.RecordBatch.from_arrays([text("lang", langs), text("a", names), text("b", names), *(pa.array(out[c].to_numpy(), pa.int64()) for c in ("ca", "cb", "n"))], schema=_CELLS)

    sources: dict[str, int] = {}
    langs: dict[str, int] = {}
    for batch in batches:
        lang_of = np.array([langs.setdefault(x, len(langs)) for x in batch.column(0).to_pylist()], dtype=np.int64)
        lists = batch.column(1)
        at, flat = lists.offsets.to_numpy(), lists.values
        coded = flat.field(0).dictionary_encode()
        code = np.array([sources.setdefault(x, len(sources)) for x in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy()]
        n, many = flat.field(1).to_numpy(), np.diff(at)
        for k in np.unique(many[many > 1]):
            first, second = np.triu_indices(k, 1)
            rows = np.flatnonzero(many == k)
            for own in np.array_split(rows, -(-len(rows) * len(first) // pairs)):
                place = at[own][:, None] + np.arange(k)
                s, c = code[place], n[place]
                lang = np.repeat(lang_of[own], len(first))
                frame = pd.DataFrame({"lang": lang, "a": s[:, first].ravel(), "b": s[:, second].ravel(), "ca": c[:, first].ravel(), "cb": c[:, second].ravel(), "n": 1})
                held.append(frame)
                size += len(frame)
                if size > 2 * pairs:
                    held = [met(held)]
                    size = len(held[0])
                    if size > pairs:
                        yield told(held, list(sources), list(langs))
                        held, size = [], 0
    if held:
        yield told(held, list(sources), list(langs))


def _p(count: Column, mass: Column) -> Column:
    """1 + floor(SCALE_STEP^3 (count + 1) / mass) in long numbers."""
    out, rest = F.lit(1).cast("long"), count + 1
    for i in (2, 1, 0):
        out = out + F.call_function("div", rest * SCALE_STEP, mass) * SCALE_STEP**i
        rest = (rest * SCALE_STEP) % mass
    return out


def _share(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence_audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block: int = BLOCK, pairs: int = PAIRS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part pair has each other source of the language, part term the terms that a source uses more than its language does."""
    kept = durable(kept_terms(df, text_col, lang_col, source_col, min_docs, block), "kept-terms")
    groups = durable(df.select(F.coalesce(df[lang_col].cast("string"), F.lit("")).alias("lang"), F.coalesce(df[source_col].cast("string"), F.lit("")).alias("source")).distinct(), "groups")
    each = kept.select("lang", "term", "total", F.explode("held").alias("h")).select("lang", "term", "total", "h.source", "h.n")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n"))
    masses = groups.join(each.groupBy("lang", "source").agg(F.sum("n").alias("own_n")), ["lang", "source"], "left").join(of_lang, "lang", "left")
    masses = durable(masses.select("lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"), *((F.coalesce(c, F.lit(0)) + F.coalesce("terms", F.lit(0))).alias(m) for c, m in (("own_n", "mass"), ("lang_n", "lang_mass")))), "masses")

    joint = kept.select("lang", "held").where(F.size("held") > 1).mapInArrow(lambda it: _tally(it, pairs), "lang string, a string, b string, ca long, cb long, n long")
    single = each.groupBy("lang", "source", "n").agg(F.count("*").alias("times"))
    others = groups.select("lang", F.col("source").alias("other"))
    alone = single.join(others, "lang").where("source <> other")
    first, zero = F.col("source") < F.col("other"), F.lit(0).cast("long")
    alone = alone.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), F.when(first, F.col("n")).otherwise(zero).alias("ca"), F.when(first, zero).otherwise(F.col("n")).alias("cb"), F.col("times").alias("n"))
    cells = joint.unionByName(alone).groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("n").alias("n")).where("n > 0")

    mass = lambda name: masses.select("lang", F.col("source").alias(name), F.col("mass").alias(f"m{name}"))
    valued = cells.join(mass("a"), ["lang", "a"]).join(mass("b"), ["lang", "b"])
    valued = valued.select("lang", "a", "b", "n", _p(F.col("ca"), F.col("ma")).alias("pa"), _p(F.col("cb"), F.col("mb")).alias("pb"))
    summed = valued.groupBy("lang", "a", "b").agg(F.sum("n").alias("n"), F.sum(F.col("n") * _share(F.col("pa"), F.col("pb"))).alias("ab"), F.sum(F.col("n") * _share(F.col("pb"), F.col("pa"))).alias("ba"))
    ways = summed.select("lang", "n", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("ab").alias("value")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("ba").alias("value")))).alias("w")).select("lang", "w.*", "n")
    both = masses.join(masses.select("lang", F.col("source").alias("item"), F.col("mass").alias("q_mass")), "lang").where("source <> item").join(ways, ["lang", "source", "item"], "left")
    left = F.col("terms") - F.coalesce("n", F.lit(0))  # kept terms that neither source holds
    none = F.when(left > 0, left * _share(_p(zero, F.greatest("mass", F.lit(1))), _p(zero, F.greatest("q_mass", F.lit(1))))).otherwise(0)
    pair = both.select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("value", F.lit(0)) + none).alias("value"))
    pair = pair.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    p, q = _p(F.col("n"), F.col("mass")), _p(F.col("total"), F.col("lang_mass"))
    more = each.join(masses, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    term = more.select("lang", "source", F.lit("term").alias("part"), "item", _share(F.col("p"), F.col("q")).alias("value"))
    term = term.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
    return pair.unionByName(term)


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP11_SQL = r"""
with docs as (select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
words as (select d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term from words group by lang, term having count(distinct d) >= 3),
counted as (select w.lang, w.source, w.term, count(*) as n from words w join kept k on w.lang = k.lang and w.term = k.term group by all),
grp as (select distinct lang, source from docs),
v as (select lang, count(*) as v from kept group by lang),
mass as (select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint + any_value(v.v) as m from grp g join v using (lang) left join counted c on c.lang = g.lang and c.source = g.source group by g.lang, g.source),
lang_mass as (select lang, sum(n)::hugeint + any_value(v.v) as m from counted join v using (lang) group by lang),
probs as (select m.lang, m.source, k.term, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // m.m as p from mass m join kept k on k.lang = m.lang left join counted c on c.lang = m.lang and c.source = m.source and c.term = k.term),
pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::bigint as value from probs a join probs b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0)::bigint as value from grp a join grp b on a.lang = b.lang and a.source <> b.source left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source),
both_p as (select c.lang, c.source, c.term, 1 + (1000000000::hugeint * (c.n + 1)) // m.m as p, 1 + (1000000000::hugeint * (sum(c.n) over (partition by c.lang, c.term) + 1)) // l.m as q from counted c join mass m on m.lang = c.lang and m.source = c.source join lang_mass l on l.lang = c.lang),
term as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // q)::bigint as value from both_p where p > q),
ranked as (select lang, source, part, item, value, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pair union all select * from term))
select * from ranked where part = 'pair' or rank <= 200
"""
