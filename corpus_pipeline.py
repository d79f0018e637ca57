"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, which are
what the stage before kept, stored as Parquet. All but the last return the
columns of documents. Null, empty and repeated rows are treated as the stages'
operators say. The first three stages decide row by row; in the mix, rows of one
identifier stay or go together. One run over one folder at a time: a stage that
starts deletes the tables of the stage before over the same folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteatlas.llm.exact_dedup import deduplicated
from siteatlas.llm.jaccard_join import jaccard_components
from siteatlas.llm.mixing import mix_sources
from siteatlas.llm.packing import pack_documents, vocabulary_path
from siteatlas.llm.storage import durable, release, scope, shared_dir, table
from siteatlas.llm.toxicity import toxicity, train

MIX_PERCENT, MIX_EPOCHS = 90, 1
ROW = "_pipeline_row"
_tables: dict[tuple[str, str], list[str]] = {}


def _stage(after: str | None):
    """Stages' own tables go when the next one starts: its docs are stored by then."""

    def wrap(f):
        def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            release(spark, _tables.pop((after, sf_dir), []))
            with scope() as written:
                out = f(spark, docs, sf_dir)
                _tables[f.__name__, sf_dir] = list(written)
            return out

        stage.__name__, stage.__doc__ = f.__name__, f.__doc__
        return stage

    return wrap


def _only(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows of docs whose identifier is in keep."""
    keep = keep.select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["_kept"]), "left_semi")


@_stage(None)
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as toxic go."""
    scored = toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.where("predicted = 0").select(*(F.col("src").getField(c).alias(c) for c in docs.columns))


@_stage("drop_toxic")
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest identifier stays."""
    return deduplicated(docs)


@_stage("drop_copies")
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts alike the row with the smallest identifier stays; a null one counts as greatest."""
    rows = durable(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    found = jaccard_components(rows, id_col=ROW).join(rows.select(ROW, "doc_id"), ROW)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW))
    kept = found.groupBy("component_id").agg(first.alias("first")).select(F.col("first")[ROW].alias(ROW))
    return rows.join(kept, ROW, "left_semi").select(*docs.columns)


@_stage("drop_near_copies")
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their leaf's budget stay."""
    return _only(docs, mix_sources(docs, share_percent=MIX_PERCENT, max_epochs=MIX_EPOCHS).where("copies > 0"))


@_stage("mix")
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, packed."""
    return pack_documents(docs, vocabulary_path())


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("mixing sources", mix), ("best-fit packing", pack)]

#: Training, hashing and packing have no SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/siteatlas/run-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
