"""Lexical ranking."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Words that no query or document term may be.
STOP = "a an and are as at be can do does for from how i in is it me of on or the this to what where which with you my".split()


def terms(text):
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda x: ~x.isin(STOP))


def placed(rows: DataFrame, key: str, order: str, buckets: int = 256) -> DataFrame:
    """rows with `place` (from 0) in its key's order of whole numbers, and `n`, the key's rows. A key's rows are numbered in ranges of the order, so that no task sorts all of them; ties are numbered as they come."""
    ends = rows.groupBy(key).agg(F.min(order).alias("_low"), F.max(order).alias("_high"))
    rows = rows.join(ends, key).withColumn("_b", F.floor((F.col(order) - F.col("_low")) * buckets / (F.col("_high") - F.col("_low") + 1)).cast("int"))
    n = rows.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    own = Window.partitionBy(key)
    n = n.withColumn("_before", F.sum("_n").over(own.orderBy("_b")) - F.col("_n")).withColumn("n", F.sum("_n").over(own))
    within = F.row_number().over(Window.partitionBy(key, "_b").orderBy(order)) - 1
    return rows.withColumn("_k", within).join(n.drop("_n"), [key, "_b"]).withColumn("place", F.col("_before") + F.col("_k")).drop("_low", "_high", "_b", "_before", "_k")


def bm25(queries: DataFrame, documents: DataFrame, k: int = 3, url: str | None = None) -> DataFrame:
    """queries: query_id, text; documents: doc_id, text. The k best documents of each query (score over 0, ties to the smaller identifier); with `url`, the best document of each URL only.

    Postings are cut to the queries' terms before they are counted; repeated query terms count each time.
    """
    asked = queries.select("query_id", F.explode(terms("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    counted = documents.select("doc_id", terms("text").alias("ts")).withColumn("len", F.size("ts"))
    total = counted.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    tf = counted.select("doc_id", "len", F.explode("ts").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    met = tf.join(df, "term").join(asked, "term").join(F.broadcast(total))  # one row
    mean = F.when(F.col("mean") == 0, 1.0).otherwise(F.col("mean"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = F.col("times") * idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / mean))
    ranked = met.groupBy("query_id", "doc_id").agg(F.round(F.sum(score), 6).alias("score")).where("score > 0")
    if url:
        own = F.row_number().over(Window.partitionBy("query_id", url).orderBy(F.desc("score"), "doc_id"))
        ranked = ranked.join(documents.select("doc_id", url), "doc_id").withColumn("_own", own).where("_own = 1").drop("_own")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return ranked.withColumn("rank", place.cast("long")).where(F.col("rank") <= k)


def nth_row(rows: DataFrame, value: str, share: float, buckets: int = 1024, few: int = 10_000) -> DataFrame:
    """One row: the number at place min(n - 1, floor(share n)) of the sorted values, as `value`; null without any.

    Histograms of the values' range narrow it down, `buckets` counts at a time, until few rows are left
    or all are equal; only these are sorted. Null values don't count.
    """
    left = rows.where(F.col(value).isNotNull()).select(value)
    n, low, high = left.agg(F.count("*"), F.min(value), F.max(value)).first()
    place = min(n - 1, int(n * share)) if n else 0
    while n > few and low < high:
        own = left.where(F.col(value).between(F.lit(low), F.lit(high)))
        at = F.least(F.floor((F.col(value) - F.lit(low)).cast("double") / F.lit(float(high - low)) * buckets), F.lit(buckets - 1))
        for r in own.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).orderBy("b").collect():  # `buckets` at most
            if place < r.n:
                n, low, high = r.n, r.low, r.high
                break
            place -= r.n
    return left.where(F.col(value).between(F.lit(low), F.lit(high))).orderBy(value).limit(1 if low == high else place + 1).agg(F.max(value).alias(value))
