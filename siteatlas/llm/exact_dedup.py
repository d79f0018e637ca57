"""Exact deduplication by Patricia tries.

Every task first folds its own rows into a compressed radix trie over full
byte strings, so a text that fills a third of the table leaves each task as
one representative. Representatives meet by (byte length, content hash), where
a second trie compares full bytes, so equal hashes of different texts never
merge. Terminal nodes store the owner: the row with the smallest identifier,
or the largest where `keep="max"`.

A trie over its memory budget spills its heaviest subtree: the terminals leave
as partial results, which the second trie merges again; nothing is written to
a machine's own disk.

Defined results: a null text counts as empty; null identifiers lose to any
other; repeated rows (same identifier, same text) leave exactly one owner, and
an empty table gives an empty result. Other columns travel in a struct, so
their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteatlas.llm.storage import durable, table, tune

TRIE_BYTES = 64 << 20


class _Node:
    __slots__ = ("kids", "label", "mark")

    def __init__(self, label: bytes, mark: list | None = None):
        self.label, self.mark, self.kids = label, mark, {}


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b[at:], by bisection over slices."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class RadixTrie:
    """Compressed radix trie over byte strings; `mark` of a node is its caller's record for the string that ends there."""

    OVERHEAD = 200

    def __init__(self):
        self.root = _Node(b"")
        self.weight: dict[int, int] = {}
        self.bytes = 0

    def mark(self, key: bytes, new) -> list:
        """The record for key; new() makes it where key wasn't there."""
        node, at, grown = self.root, 0, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = _Node(key[at:])
                grown += len(kid.label) + self.OVERHEAD
                node, at = kid, len(key)
            elif key.startswith(kid.label, at):
                node, at = kid, at + len(kid.label)
            else:
                n = _common(kid.label, key, at)
                fork = node.kids[key[at]] = _Node(kid.label[:n])
                kid.label = kid.label[n:]
                fork.kids[kid.label[0]] = kid
                grown += self.OVERHEAD
                node, at = fork, at + n
        if node.mark is None:
            node.mark = new()
        if grown:
            self.bytes += grown
            self.weight[key[0]] = self.weight.get(key[0], 0) + grown
        return node.mark

    def _marks(self, node: _Node) -> Iterator[list]:
        todo = [node]
        while todo:
            node = todo.pop()
            if node.mark is not None:
                yield node.mark
            todo.extend(node.kids.values())

    def spill(self) -> Iterator[list]:
        """Cut the heaviest subtree below the root and give its records."""
        first = max(self.weight, key=self.weight.get)
        self.bytes -= self.weight.pop(first)
        return self._marks(self.root.kids.pop(first))

    def drain(self) -> Iterator[list]:
        return self._marks(self.root)


_DECISION = "n_bytes int, hash long, row long, rep long, sha string, owner long, owner_row long, members long"


def _better(a: tuple, b: tuple, keep: str) -> tuple:
    """Of two (identifier, row) pairs, the owner; no identifier loses."""
    if a[0] is None or b[0] is None:
        return b if a[0] is None and b[0] is not None else a if b[0] is None and a[0] is not None else max(a, b)
    if keep == "max":
        return max(a, b)
    return min(a, b)


def _fold(batches: Iterator[pa.RecordBatch], schema: pa.Schema, id_col: str, text_col: str, keep: str, budget: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40
    trie = RadixTrie()

    def summaries(marks):
        done = [(m[1], m[2], m[0], m[3][0], m[3][1], m[4]) for m in marks]
        for i in range(0, len(done), 10_000):
            n, h, rep, owner, owner_row, members = zip(*done[i : i + 10_000], strict=True)
            nulls = [None] * len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip([nulls, n, h, nulls, rep, nulls, owner, owner_row, members], schema, strict=True)], schema=schema
            )

    for batch in batches:
        src = batch.column(0)
        ids, texts = src.field(id_col).to_pylist(), src.field(text_col).to_pylist()
        out: list[list] = [[], [], [], [], []]
        for doc, text in zip(ids, texts, strict=True):
            key = (text or "").encode()
            digest = hashlib.sha256(key)
            h = int.from_bytes(digest.digest()[:8], "big", signed=True)
            mark = trie.mark(key, lambda: [row, len(key), h, (doc, row), 0])  # noqa: B023
            mark[3] = _better(mark[3], (doc, row), keep)
            mark[4] += 1
            for x, v in zip(out, (len(key), h, row, mark[0], digest.hexdigest()), strict=True):
                x.append(v)
            row += 1
            while trie.bytes > budget and len(trie.weight) > 0:
                yield from summaries(trie.spill())
        nulls = [None] * len(ids)
        yield pa.RecordBatch.from_arrays([src.cast(schema.field(0).type), *(pa.array(x, f.type) for x, f in zip([*out, nulls, nulls, nulls], list(schema)[1:], strict=True))], schema=schema)
    yield from summaries(trie.drain())


def _merge(batches: Iterator[pa.RecordBatch], keep: str) -> Iterator[pa.RecordBatch]:
    """Rows by (n_bytes, hash), texts before summaries: one trie for each run of equal length and hash."""
    schema = pa.schema([("rep", pa.int64()), ("owner", pa.int64()), ("owner_row", pa.int64()), ("group_size", pa.int64())])
    run, trie, marks, out = None, RadixTrie(), {}, []

    def close():
        out.extend((rep, *mark[0], mark[1]) for rep, mark in marks.items())

    for batch in batches:
        for n, h, text, rep, owner, owner_row, members in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if (n, h) != run:
                close()
                run, trie, marks = (n, h), RadixTrie(), {}
            if members is None:
                marks[rep] = trie.mark((text or "").encode(), lambda: [None, 0])
            else:
                mark = marks[rep]
                mark[0] = (owner, owner_row) if mark[0] is None else _better(mark[0], (owner, owner_row), keep)
                mark[1] += members
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)
            out = []
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row for each row of df: src (a struct of its columns), keep_id, group_size, kept, text_sha256."""
    from pyspark.sql.pandas.types import to_arrow_schema

    tune(df.sparkSession)
    packed = df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("src"))
    packed = packed.withColumn("src", F.col("src").withField(f"`{id_col}`", F.col("src").getField(id_col).cast("long")))
    schema = T.StructType([T.StructField("src", packed.schema["src"].dataType, True), *T._parse_datatype_string(_DECISION).fields])
    arrow = to_arrow_schema(schema)
    rows = durable(packed.mapInArrow(lambda it: _fold(it, arrow, id_col, text_col, keep, trie_bytes), schema), "trie")
    met = (
        rows.where(F.col("members").isNotNull() | (F.col("row") == F.col("rep")))
        .select("n_bytes", "hash", F.when(F.col("members").isNull(), F.col("src").getField(text_col)).alias("text"), "rep", "owner", "owner_row", "members")
        .repartition("n_bytes", "hash")
        .sortWithinPartitions("n_bytes", "hash", F.col("members").isNotNull())
    )
    owners = met.mapInArrow(lambda it: _merge(it, keep), "rep long, owner long, owner_row long, group_size long")
    return (
        rows.where(F.col("members").isNull())
        .select("src", "row", "rep", "sha")
        .join(owners, "rep")
        .select("src", F.col("owner").alias("keep_id"), "group_size", (F.col("row") == F.col("owner_row")).alias("kept"), F.col("sha").alias("text_sha256"))
    )


def deduplicated(df: DataFrame, **options) -> DataFrame:
    """The rows of df that stay."""
    return exact_dedup(df, **options).where("kept").select(*(F.col("src").getField(c).alias(c) for c in df.columns))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, keep="max").select(F.col("src.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
