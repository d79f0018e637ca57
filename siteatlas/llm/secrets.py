"""Secret scan with multipart credential linking, in Spark's own functions.

Three strong kinds are always reported. Weak candidates (a login name, a mixed
token, an endpoint) are reported only where the parts that complete them lie
within `scope` code points: a token needs an identifier, a name needs a secret,
an endpoint needs both. Parts that overlap don't complete each other. The
interval join is a sweep over the starts and ends of a text's parts in order:
each part looks at the last end up to its start and the first start from its
end on, so it takes time in proportion to the parts (but for sorting them) and
never forms pairs.

Spans are code points, end exclusive. Positions come from the lengths of the
matches and of the pieces between them. A weak candidate that overlaps a strong
span is dropped. Null and empty texts give no spans; every row of the table
gives one row, repeated rows too; only the identifier and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.llm.storage import table

VALUE = r"[A-Za-z0-9+/_.=-]+"
JOINED = r"""["']?\x20*[:=]\x20*["']?"""
STRONG = {
    "assign": rf"(?i:password|passwd|secret|token|api_?key){JOINED}({VALUE})",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
}
WEAK = {
    "login": rf"(?i:user(?:name)?|login|account|client_?id|access_?key_?id){JOINED}[A-Za-z0-9@._-]{{3,}}",
    "token": r"[A-Za-z0-9+/_-]{20,}={0,2}",
    "endpoint": r"""(?:https?://[^\s"'<>]+|\b[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.(?:com|net|org|io|dev|internal)\b(?::[0-9]{2,5})?|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{2,5})?\b)""",
}
KINDS = [*STRONG, *WEAK]
SCOPE = 200
_CHUNK = 512


def running(lengths: Column) -> Column:
    """Sums of all lengths up to each one; in chunks, so that the work isn't the square of their number."""
    add = lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _CHUNK).cast("int")), lambda c: F.slice(lengths, c * _CHUNK + 1, _CHUNK))
    none = F.array().cast("array<int>")
    before = F.aggregate(F.transform(chunks, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)), F.array(F.lit(0)), add)
    return F.flatten(F.transform(chunks, lambda x, i: F.transform(F.aggregate(x, none, add), lambda y: y + F.get(before, i))))


def found(df: DataFrame, kind: str, pattern: str, text: str = "_text", when: Column | None = None) -> DataFrame:
    """df with the column kind: (start, end, kind's place) of every match, in order; none where `when` is false."""
    has = F.col(text).rlike(pattern)
    has = has if when is None else when & has
    df = df.withColumn("_m", F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    df = df.withColumn("_g", F.when(F.col("_m").isNotNull(), F.transform(F.split(text, pattern, -1), lambda x: F.length(x))))
    good = {
        "assign": lambda m: F.length(F.regexp_extract(m, pattern, 1)) >= 8,
        "access": lambda m: F.length(m) >= 16,
        "token": lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]"),
    }.get(kind, lambda m: F.lit(True))
    df = df.withColumn("_s", running(F.transform("_g", lambda g, i: g + F.coalesce(F.length(F.get("_m", i - 1)), F.lit(0)))))
    spans = F.transform("_m", lambda m, i: F.struct(F.get("_s", i).alias("start"), (F.get("_s", i) + F.length(m)).alias("end"), F.lit(KINDS.index(kind)).alias("kind"), good(m).alias("good")))
    return df.withColumn(kind, F.filter(spans, lambda x: x["good"])).drop("_m", "_g", "_s")


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for each row of df: its identifier, counts of the strong kinds, n_linked, base_sha256, spans."""
    docs = df.select(df[id_col].alias("_id"), F.coalesce(df[text_col], F.lit("")).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    for kind, pattern in STRONG.items():
        docs = found(docs, kind, pattern)
    docs = found(docs, "login", WEAK["login"])
    for kind in ("token", "endpoint"):
        docs = found(docs, kind, WEAK[kind], when=F.col("access").isNotNull() | F.col("login").isNotNull())
    none = F.array().cast("array<struct<start:int,end:int,kind:int,good:boolean>>")
    parts = docs.select("_id", "_row", F.explode_outer(F.concat(*(F.coalesce(F.col(k), none) for k in KINDS))).alias("p")).select("_id", "_row", "p.start", "p.end", "p.kind")
    opens = F.struct(F.col("start").alias("at"), F.lit(1).alias("opens"))
    closes = F.struct(F.col("end").alias("at"), F.lit(0).alias("opens"))
    events = parts.select("*", F.explode(F.when(F.col("start").isNull(), F.array(opens)).otherwise(F.array(opens, closes))).alias("e")).select("_id", "_row", "start", "end", "kind", "e.*")
    of = lambda *kinds: F.col("kind").isin(*(KINDS.index(k) for k in kinds))
    event = lambda opens, test: F.when((F.col("opens") == opens) & test, F.col("at"))
    own = Window.partitionBy("_row")
    before = own.orderBy("at", "opens").rowsBetween(Window.unboundedPreceding, -1)
    behind = own.orderBy(F.desc("at"), F.desc("opens")).rowsBetween(Window.unboundedPreceding, -1)
    sides = {"by_id": of("access", "login"), "by_secret": of("assign", "hex", "token")}
    strong = of(*STRONG)
    swept = events.select(
        "*",
        *(F.max(event(0, test)).over(before).alias(f"{name}_end") for name, test in sides.items()),
        *(F.min(event(1, test)).over(behind).alias(f"{name}_start") for name, test in sides.items()),
        *(F.count(event(i, strong)).over(before).alias(f"strong_{i}") for i in (0, 1)),
    )
    seen = lambda name: F.max(F.coalesce(F.when(F.col("opens") == 1, F.col(f"{name}_end") >= F.col("start") - scope).otherwise(F.col(f"{name}_start") <= F.col("end") + scope), F.lit(False)))
    # a strong part overlaps where more of them start before the end than end up to the start
    over = F.max(F.when(F.col("opens") == 0, F.col("strong_1"))) > F.max(F.when(F.col("opens") == 1, F.col("strong_0")))
    met = swept.groupBy("_row", "_id", "start", "end", "kind").agg(*(seen(name).alias(name) for name in sides), F.coalesce(over, F.lit(False)).alias("over"))
    linked = ~F.col("over") & (of("token") & F.col("by_id") | of("login") & F.col("by_secret") | of("endpoint") & F.col("by_id") & F.col("by_secret"))
    told = F.struct("start", "kind", "end")
    name = F.array(*map(F.lit, KINDS))
    line = lambda xs: F.array_join(F.transform(F.sort_array(xs), lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda test: F.count(F.when(test, 1))
    return met.groupBy("_row", "_id").agg(
        *(count(of(k)).alias(f"n_{k}") for k in STRONG),
        count(linked).alias("n_linked"),
        F.sha2(line(F.collect_list(F.when(strong, told))), 256).alias("base_sha256"),
        line(F.collect_list(F.when(strong | linked, told))).alias("spans"),
    ).withColumnRenamed("_id", id_col).drop("_row")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    """Spans by lengths of matches and gaps; links by comparing all parts of a text."""
    kinds = []
    for i, (kind, pattern) in enumerate((STRONG | WEAK).items()):
        q = pattern.replace("'", "''")
        good = {"assign": f"length(regexp_extract(m, '{q}', 1)) >= 8", "access": "length(m) >= 16", "token": "regexp_matches(m, '[0-9]') and regexp_matches(m, '[a-z]') and regexp_matches(m, '[A-Z]')"}.get(kind, "true")
        kinds.append(f"""select r, {i} as kind, s::bigint as s, (s + length(m))::bigint as e from (select r, ms[k] as m, list_sum(list_transform(gs[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:k - 1], lambda x: length(x))), 0) as s
from (select r, ms, gs, unnest(range(1, len(ms) + 1)) as k from (select r, regexp_extract_all(text, '{q}', 0) as ms, string_split_regex(text, '{q}') as gs from t where regexp_matches(text, '{q}')))) where {good}""")
    name, strong = f"(['{"', '".join(KINDS)}'])[kind + 1]", f"kind < {len(STRONG)}"
    side = lambda *kinds: ", ".join(str(KINDS.index(k)) for k in kinds)
    near = lambda kinds: f"exists (select 1 from p q where q.r = p.r and q.kind in ({kinds}) and (q.e between p.s - {SCOPE} and p.s or q.s between p.e and p.e + {SCOPE}))"
    of = {k: KINDS.index(k) for k in WEAK}
    return f"""with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
p as ({" union all ".join(kinds)}),
w as (select r, kind, s, e, {near(side("access", "login"))} as by_id, {near(side("assign", "hex", "token"))} as by_secret, exists (select 1 from p q where q.r = p.r and q.kind < {len(STRONG)} and q.s < p.e and q.e > p.s) as over_ from p),
l as (select *, not over_ and (kind = {of["token"]} and by_id or kind = {of["login"]} and by_secret or kind = {of["endpoint"]} and by_id and by_secret) as linked, {name} || ':' || s || ':' || e as line from w),
g as (select r, {", ".join(f"count(*) filter (where kind = {i}) as n_{k}" for i, k in enumerate(STRONG))}, count(*) filter (where linked) as n_linked, string_agg(line, ',' order by s, kind) filter (where {strong}) as base, string_agg(line, ',' order by s, kind) filter (where {strong} or linked) as spans from l group by r)
select doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in STRONG)}, coalesce(n_linked, 0) as n_linked, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from t left join g using (r)"""


OP2_SQL = _sql()
