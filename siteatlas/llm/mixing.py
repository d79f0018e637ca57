"""Mixing sources to target weights by hierarchical budgeting, in Spark's own functions.

Tokens (words) are counted for the leaves of a tree domain - language - source.
Budgets go from the root down. At each node the children share its budget by
weight; a child that can't use its share (its tokens times max_epochs) is
filled and what it leaves goes to its siblings first, and only what a whole
node can't use goes to the siblings of its ancestor. All of it is integer
arithmetic: shares round down.

A leaf reads its documents in epochs. Epochs that fit wholly take each document
once each; the last one takes the prefix, in the order of a seeded hash, that
reaches the leaf's budget. The prefix of a leaf that holds a third of all rows
is found by hash bucket: sums of 4096 buckets name the one where the budget
ends, and only that bucket's rows are put in order. Rows meet their leaf's
budget in SALTS parts, so that no task gets all rows of a leaf.

Defined results: null language or source is the child "(none)", null text has
no tokens, a document without tokens is taken in whole epochs and where it lies
before the cut; repeated rows count as rows; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.llm.storage import durable, table

LEVELS = ["domain", "lang", "source"]
WORDS = r"[^\x20\x09-\x0D]+"
#: Weights of the production mix; nodes that aren't named weigh 10.
WEIGHTS = {"domain": {"d0": 40, "d1": 30, "d2": 20}, "lang": {"en": 50, "de": 20, "fr": 20}, "source": {"src1": 30, "src2": 5}}
OTHER = 10
SHARE_PERCENT, MAX_EPOCHS, SEED, SALTS = 60, 2, 17, 64


def source_domain(source: Column) -> Column:
    """The domain of a source: its trailing number modulo 4, or other."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (number.cast("long") % 4).cast("string")))


def _weight(level: str, weights: dict, other: int) -> Column:
    out = F.lit(other).cast("long")
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(w).cast("long")).otherwise(out)
    return out


def fill(children: DataFrame, parent: list[str], child: str, weights: dict, other: int, max_epochs: int) -> DataFrame:
    """children (tokens, budget of the parent in `given`) with `share`: the child's budget after redistribution."""
    cap = F.col("tokens") * max_epochs
    df = children.withColumn("w", _weight(child, weights, other)).withColumn("cap", cap)
    order = Window.partitionBy(*parent).orderBy(F.expr("cap div w"), F.expr("cap % w * 1000000 div w"), child)
    df = df.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    df = df.withColumn("rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    df = df.withColumn("full", F.expr("cap * rest <= w * (given - before)"))
    group = Window.partitionBy(*parent)
    df = df.withColumn("filled", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(group)).withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(group))
    return df.withColumn("share", F.expr("case when full then cap else w * (given - filled) div open end")).drop("w", "cap", "before", "rest", "full", "filled", "open")


def leaf_budgets(leaves: DataFrame, share_percent: int, max_epochs: int, weights: dict, other: int) -> DataFrame:
    """leaves (domain, lang, source, tokens) with `budget`."""
    domains = leaves.groupBy("domain").agg(F.sum("tokens").alias("tokens")).withColumn("root", F.lit(0))
    total = F.sum("tokens").over(Window.partitionBy("root"))
    domains = domains.withColumn("given", F.least(F.expr(f"sum(tokens) over (partition by root) * {share_percent} div 100"), total * max_epochs))
    domains = fill(domains, ["root"], "domain", weights, other, max_epochs).select("domain", F.col("share").alias("given"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("tokens").alias("tokens")).join(domains, "domain")
    langs = fill(langs, ["domain"], "lang", weights, other, max_epochs).select("domain", "lang", F.col("share").alias("given"))
    return fill(leaves.join(langs, ["domain", "lang"]), ["domain", "lang"], "source", weights, other, max_epochs).drop("given").withColumnRenamed("share", "budget")


def _with_plan(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Each row with its leaf's line of plan; a line goes to all of its leaf's parts."""
    lines = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")).join(lines, [*LEVELS, "salt"]).drop("salt")


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain=source_domain, weights: dict = WEIGHTS, other: int = OTHER, share_percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row for each row of df: identifier, domain, lang, source, n_tokens, copies (times taken), tokens (taken in all)."""
    name = lambda c: F.coalesce(df[c], F.lit("(none)"))
    docs = df.select(df[id_col].alias("_id"), domain(name(source_col)).alias("domain"), name(lang_col).alias("lang"), name(source_col).alias("source"), F.regexp_count(F.coalesce(df[text_col], F.lit("")), F.lit(WORDS)).cast("long").alias("n_tokens"))
    docs = durable(docs, "mix")
    leaves = docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    plan = leaf_budgets(leaves, share_percent, max_epochs, weights, other)
    plan = durable(plan.select(*LEVELS, F.expr("case when tokens > 0 then budget div tokens else 0 end").alias("whole"), F.expr("case when tokens > 0 then budget % tokens else 0 end").alias("part")), "budgets")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"), F.col("_id").cast("string")))
    keyed = _with_plan(docs, plan).withColumn("key", key).withColumn("bucket", F.substring("key", 1, 3))
    sums = keyed.groupBy(*LEVELS, "part", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    order = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = sums.withColumn("before", F.coalesce(F.sum("tokens").over(order), F.lit(0))).where("before <= part and part < before + tokens").select(*LEVELS, F.col("bucket").alias("cut"), "before")
    keyed = _with_plan(docs, plan.join(cut, LEVELS, "left")).withColumn("key", key).withColumn("bucket", F.substring("key", 1, 3))
    out = ["_id", *LEVELS, "n_tokens", "whole", "took"]
    sure = keyed.where("cut is null or bucket <> cut").withColumn("took", F.expr("case when bucket < cut then n_tokens else -1 end")).select(*out)
    place = F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("key", "_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens") + F.col("before")
    edge = keyed.where("bucket = cut").withColumn("place", place).withColumn("took", F.expr("case when place < part then least(n_tokens, part - place) else -1 end")).select(*out)
    return sure.unionByName(edge).select(F.col("_id").alias(id_col), *LEVELS, "n_tokens", F.expr("whole + case when took >= 0 then 1 else 0 end").alias("copies"), F.expr("whole * n_tokens + greatest(took, 0)").alias("tokens"))


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def _sql_weight(level: str) -> str:
    return "case " + " ".join(f"when {level} = '{k}' then {v}" for k, v in WEIGHTS[level].items()) + f" else {OTHER} end"


def _sql_fill(name: str, source: str, parent: str, child: str) -> str:
    over = f"partition by {parent} order by cap // w, (cap % w) * 1000000 // w, {child}"
    return f"""
{name}1 as (select *, tokens * {MAX_EPOCHS} as cap, {_sql_weight(child)} as w from {source}),
{name}2 as (select *, coalesce(sum(cap) over ({over} rows between unbounded preceding and 1 preceding), 0) as before, sum(w) over ({over} rows between current row and unbounded following) as rest from {name}1),
{name}3 as (select *, cap * rest <= w * (given - before) as full_ from {name}2),
{name}4 as (select *, sum(case when full_ then cap else 0 end) over (partition by {parent}) as filled, sum(case when full_ then 0 else w end) over (partition by {parent}) as open_ from {name}3),
{name} as (select *, case when full_ then cap else w * (given - filled) // open_ end as share from {name}4),"""


OP8_SQL = f"""
with d as (select doc_id, coalesce(lang, '(none)') as lang, coalesce(source, '(none)') as source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::hugeint as n_tokens from documents),
d2 as (select *, case when regexp_extract(source, '([0-9]{{1,9}})$', 1) = '' then 'other' else 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::bigint % 4)::varchar end as domain from d),
leaves as (select domain, lang, source, sum(n_tokens)::hugeint as tokens from d2 group by all),
dom as (select domain, 0 as root, sum(tokens)::hugeint as tokens, least((sum(sum(tokens)) over ())::hugeint * {SHARE_PERCENT} // 100, (sum(sum(tokens)) over ())::hugeint * {MAX_EPOCHS}) as given from leaves group by domain),
{_sql_fill("fd", "dom", "root", "domain")}
lan as (select l.domain, l.lang, sum(l.tokens)::hugeint as tokens, any_value(share) as given from leaves l join fd on l.domain = fd.domain group by 1, 2),
{_sql_fill("fl", "lan", "domain", "lang")}
sou as (select l.domain, l.lang, l.source, l.tokens, share as given from leaves l join fl on l.domain = fl.domain and l.lang = fl.lang),
{_sql_fill("fs", "sou", "domain, lang", "source")}
k as (select d2.*, case when tokens > 0 then share // tokens else 0 end as whole, case when tokens > 0 then share % tokens else 0 end as part from d2 join fs using (domain, lang, source)),
p as (select *, md5('{SEED}|' || whole::bigint || '|' || doc_id) as key from k),
q as (select *, sum(n_tokens) over (partition by domain, lang, source order by key, doc_id, n_tokens rows between unbounded preceding and current row) - n_tokens as place from p)
select doc_id, domain, lang, source, n_tokens::bigint as n_tokens, (whole + case when place < part then 1 else 0 end)::bigint as copies, (whole * n_tokens + case when place < part then least(n_tokens, part - place) else 0 end)::bigint as tokens from q
"""
