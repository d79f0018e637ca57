"""Exact top-k search by inner product with a KD-tree in each shard.

Vectors are made whole numbers, floor(64 x). Equal ones meet first: each distinct
vector keeps its k + 1 least identifiers, since no result can hold more of them,
and is searched for once, however many rows ask. Median splits learned from a
bounded sample deal the distinct vectors to shards (every vector is dealt, the
sample only places the cuts); a shard builds a KD-tree of median splits of the
widest side with tight boxes.

A query first searches the shard of its own cell; the k-th result that it finds
there goes with it to those other shards alone whose box can hold a better one.
In a shard nodes are taken best first, by the greatest inner product that their
box allows, until none reaches the query's k-th result so far. Queries of a batch
take their next leaves (one, then two, four, ...) together, so that the leaf's
scores are one matrix product for all queries that want it.

Ties go to the smaller identifier at every step, so results don't depend on
shards, cuts or the sample. Rows stream through a shard's task: what is held is
one shard and one batch of queries. A shard with many queries is copied to tasks
with PART queries each.

Defined results: vectors that are null, hold null or non-finite components, or a
component beyond +-LIMIT (a score must fit a long) take no part, neither as
queries nor as candidates; shorter vectors count as continued by zeros; null
identifiers are no queries, and come last among ties (2^63 - 1 is read as null);
repeated rows are candidates for each other, and each a query of its own; with
fewer candidates than k all come; columns besides the two aren't read; an empty
table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.llm.storage import durable, table, tune

TOP, EVERY, SCALE, LIMIT = 20, 20, 64, 1 << 20
#: Vectors of a shard and a leaf, most shards, the sample that places the cuts, queries that share one copy of a shard.
SHARD, LEAF, MOST_SHARDS, SAMPLE, PART = 1 << 16, 128, 1 << 14, 1 << 13, 1 << 17
LEAST_SHARD = 2048
_NULL = (1 << 63) - 1
_SALTS = 64


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of `width` numbers, continued by zeros."""
    many = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (many == width).all():
        return flat.reshape(len(many), width)
    out = np.zeros((len(many), width), dtype=np.int32)
    row = np.repeat(np.arange(len(many)), many)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many)] = flat
    return out


def _kind(most_a: int, most_b: int, width: int):
    """The fastest numbers in which all inner products are exact."""
    greatest = int(most_a) * int(most_b) * max(width, 1)
    return np.float32 if greatest < 1 << 24 else np.float64 if greatest < 1 << 53 else np.int64


class Tree:
    """A KD-tree over distinct vectors in order of their least identifier."""

    def __init__(self, vectors: np.ndarray, least: np.ndarray, leaf: int = LEAF):
        self.least, self.width = least, vectors.shape[1]
        order = np.arange(len(vectors))
        low, high, self.span, self.child = [], [], [], []
        todo = [(0, len(vectors), -1)]
        while todo:
            begin, end, slot = todo.pop()
            own = vectors[order[begin:end]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            node = len(self.span)
            self.span.append((begin, end))
            self.child.append(None)
            if slot >= 0:
                self.child[slot] = (*(self.child[slot] or ()), node)
            wide = high[-1].astype(np.int64) - low[-1]
            if end - begin > leaf and wide.any():
                half = (end - begin) // 2
                order[begin:end] = order[begin:end][np.argpartition(own[:, int(wide.argmax())], half)]
                todo += [(begin, begin + half, node), (begin + half, end, node)]
        self.low, self.high = np.array(low), np.array(high)
        self.vectors, self.rank = vectors[order], order
        self.first = [int(order[b:e].min()) for b, e in self.span]
        self.most = int(np.abs(vectors.astype(np.int64)).max(initial=0))
        self.typed: dict = {}

    def _as(self, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if kind not in self.typed:
            self.typed = {kind: (self.vectors.astype(kind), self.low.T.astype(kind), self.high.T.astype(kind))}
        return self.typed[kind]

    def search(self, queries: np.ndarray, k: int, score: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best vectors of each query among those better than its (score, rank): arrays of query, score and rank, best first."""
        kind = _kind(np.abs(queries.astype(np.int64)).max(initial=0), self.most, self.width)
        vectors, low, high = self._as(kind)
        asked = queries.astype(kind)
        bounds = (np.maximum(asked, 0) @ high + np.minimum(asked, 0) @ low).astype(np.int64)
        least, rank = score.astype(np.int64).copy(), before.astype(np.int64).copy()
        heaps = [[(-b, 0)] for b in bounds[:, 0].tolist()]
        active, step = list(range(len(queries))), 1
        none = np.zeros(0, np.int64)
        found = (none, none, none)
        while active:
            visits: list[tuple[int, int]] = []
            going = []
            for q in active:
                heap, bound, most, last, left = heaps[q], bounds[q], int(least[q]), int(rank[q]), step
                while heap and left:
                    b, node = heapq.heappop(heap)
                    if -b < most:
                        heap.clear()
                        break
                    if -b == most and self.first[node] >= last:
                        continue
                    if self.child[node] is None:
                        visits.append((node, q))
                        left -= 1
                        continue
                    for c in self.child[node]:
                        if (x := int(bound[c])) >= most:
                            heapq.heappush(heap, (-x, c))
                if heap:
                    going.append(q)
            if visits:
                found = self._met(visits, vectors, asked, least, rank, found, k)
            active, step = going, 2 * step
        return found

    def _met(self, visits, vectors, asked, least, rank, found, k):
        """Scores of the leaves that queries visit, joined with what they found before; least and rank follow."""
        visits.sort()
        leaf, query = (np.array(x) for x in zip(*visits, strict=True))
        cuts = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)]
        qs, scores, ranks = [found[0]], [found[1]], [found[2]]
        for i, j in zip(cuts, cuts[1:], strict=False):
            begin, end = self.span[leaf[i]]
            q, own = query[i:j], self.rank[begin:end]
            s = (asked[q] @ vectors[begin:end].T).astype(np.int64)
            better = (s > least[q][:, None]) | ((s == least[q][:, None]) & (own[None, :] < rank[q][:, None]))
            a, b = np.nonzero(better)
            qs.append(q[a])
            scores.append(s[a, b])
            ranks.append(own[b])
        q, s, r = np.concatenate(qs), np.concatenate(scores), np.concatenate(ranks)
        order = np.lexsort((r, -s, q))
        q, s, r = q[order], s[order], r[order]
        begin = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(begin, np.diff(begin, append=len(q)))
        full = place == k - 1
        least[q[full]], rank[q[full]] = s[full], r[full]
        return q[place < k], s[place < k], r[place < k]


_FOUND = pa.schema([("q", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64()), ("shard", pa.int32()), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32()))])
_FOUND_KIND = "q long, score long, vec_id long, shard int, low array<int>, high array<int>"


def _told(q, score, vec_id, shard=None, low=None, high=None) -> pa.RecordBatch:
    n = len(q)
    columns = [q, score, vec_id, shard or [None] * n, low or [None] * n, high or [None] * n]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)


def _search(batches: Iterator[pa.RecordBatch], width: int, k: int, leaf: int, boxes: bool) -> Iterator[pa.RecordBatch]:
    """Rows by (shard, part, queries last): q, v, ids, least score, least identifier. Results, and a shard's box and least identifier where boxes."""
    key, held, tree, ids = None, [], None, []

    def build() -> None:
        nonlocal tree, ids, held
        if held:
            first = np.concatenate([x for _, x, _ in held])
            order = np.argsort(first, kind="stable")
            lists = [own for _, _, many in held for own in many]
            ids = [lists[i] for i in order]
            tree = Tree(np.concatenate([v for v, _, _ in held])[order], first[order], leaf)
            held = []

    def box() -> Iterator[pa.RecordBatch]:
        if boxes and tree is not None and key[1] == 0:
            yield _told([None], [None], [int(tree.least[0])], [key[0]], [tree.low[0]], [tree.high[0]])

    for batch in batches:
        shards, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        change = np.flatnonzero((np.diff(shards) != 0) | (np.diff(parts) != 0)) + 1
        for i, j in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
            if i == j:
                continue
            if key != (shards[i], parts[i]):
                build()
                yield from box()
                key, tree, ids = (int(shards[i]), int(parts[i])), None, []
            own = batch.slice(i, j - i)
            ask = own.column(2).is_valid()
            vectors = own.filter(pa.compute.invert(ask))
            if vectors.num_rows:
                lists = vectors.column(4).to_pylist()
                held.append((_matrix(vectors.column(3), width), np.array([x[0] for x in lists], dtype=np.int64), lists))
            asked = own.filter(ask)
            if not asked.num_rows:
                continue
            build()
            if tree is None:
                continue
            number = asked.column(2).to_numpy()
            score = asked.column(5).fill_null(-(1 << 62)).to_numpy()
            before = np.searchsorted(tree.least, asked.column(6).fill_null(_NULL).to_numpy(), side="left")
            q, s, r = tree.search(_matrix(asked.column(3), width), k, score, before)
            n = np.array([len(ids[x]) for x in r.tolist()], dtype=np.int64)
            every = np.fromiter((y for x in r.tolist() for y in ids[x]), np.int64, int(n.sum()))
            q, s = np.repeat(q, n), np.repeat(s, n)
            order = np.lexsort((every, -s, q))
            q, s, every = q[order], s[order], every[order]
            begin = np.flatnonzero(np.diff(q, prepend=-1))
            keep = np.arange(len(q)) - np.repeat(begin, np.diff(begin, append=len(q))) < k
            yield _told(number[q[keep]], s[keep], every[keep])
    build()
    yield from box()


def _cuts(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sides and thresholds of `depth` levels of median splits, in heap order."""
    side, at = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1, np.int64)
    cells = {0: sample}
    for node in range(len(side)):
        own = cells.pop(node)
        if len(own) and own.shape[1]:
            side[node] = int((own.max(axis=0).astype(np.int64) - own.min(axis=0)).argmax())
            values = own[:, side[node]]
            at[node] = int(np.sort(values)[(len(values) - 1) // 2])
            right = values > at[node]
            cells[2 * node + 1], cells[2 * node + 2] = own[~right], own[right]
        else:
            cells[2 * node + 1] = cells[2 * node + 2] = own
    return side, at


def _cell(vectors: np.ndarray, side: np.ndarray, at: np.ndarray) -> np.ndarray:
    node = np.zeros(len(vectors), np.int64)
    if vectors.shape[1]:
        while len(node) and node[0] < len(side):  # all at one level
            node = 2 * node + 1 + (vectors[np.arange(len(node)), side[node]] > at[node])
        node -= len(side)
    return node


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale x) of the vectors that take part."""
    fits = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= LIMIT))
    rows = df.select(F.coalesce(df[id_col].cast("long"), F.lit(_NULL)).alias("vec_id"), df[vector_col].alias(vector_col)).where(F.col(vector_col).isNotNull() & fits)
    return rows.select("vec_id", F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def top_k(df: DataFrame, k: int = TOP, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, leaf: int = LEAF, least_shard: int = LEAST_SHARD, part: int = PART) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row whose identifier is divisible by `every` the k others of the greatest inner product."""
    spark = df.sparkSession
    tune(spark)
    rows, most = whole_vectors(df, id_col, vector_col), k + 1
    # Equal vectors meet in _SALTS parts first, each with its least identifiers only.
    by = Window.partitionBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(_SALTS))).orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most)
    distinct = durable(few.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, most).alias("ids")), "vectors")
    size = distinct.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = size.n, size.width or 0
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(MOST_SHARDS, max(-(-n // shard), min(slots, n // least_shard), 1))
    depth = (wanted - 1).bit_length()
    near = distinct.where(F.pmod(F.xxhash64("v"), F.lit(max(1, n // SAMPLE))) == 0).select("v").limit(2 * SAMPLE).collect() if depth else []
    sample = np.zeros((len(near), width), np.int64)
    for i, r in enumerate(near):
        sample[i, : len(r.v)] = r.v
    side, at = _cuts(sample, depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_cell(_matrix(batch.column(0), width), side, at), pa.int32())], names=["v", "ids", "shard"])

    vectors = durable(distinct.mapInArrow(deal, "v array<int>, ids array<bigint>, shard int"), "shards") if depth else distinct.withColumn("shard", F.lit(0))
    asking = rows.where((F.pmod("vec_id", F.lit(every)) == 0) & (F.col("vec_id") != _NULL))
    queries = durable(vectors.join(asking.select("v").distinct(), "v", "left_semi").select(F.monotonically_increasing_id().alias("q"), "v", "shard"), "queries")
    parts = -(-queries.count() // part) or 1

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    stored = vectors.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), none("long", "q"), "v", "ids", none("long", "score"), none("long", "least"))

    def searched(asked: DataFrame, boxes: bool) -> DataFrame:
        asked = asked.select("shard", F.pmod("q", F.lit(parts)).cast("int").alias("part"), "q", "v", none("array<bigint>", "ids"), "score", "least")
        met = stored.unionByName(asked).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("q").isNotNull())
        return met.mapInArrow(lambda it: _search(it, width, most, leaf, boxes), _FOUND_KIND)

    home = durable(searched(queries.select("*", none("long", "score"), none("long", "least")), True), "found")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = home.where("q is not null").select("q", "score", "vec_id")
    if depth:
        boxes = home.where("q is null").select("shard", "vec_id", "low", "high").collect()  # one for each shard
        shards, first = np.array([r.shard for r in boxes], np.int64), np.array([r.vec_id for r in boxes], np.int64)
        low, high = (np.array([getattr(r, c) for r in boxes], np.int64).reshape(len(boxes), width) for c in ("low", "high"))
        kth = found.withColumn("place", F.row_number().over(best)).where(F.col("place") == most).select("q", "score", F.col("vec_id").alias("least"))

        def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = _matrix(batch.column(1), width)
                kind = _kind(np.abs(vectors.astype(np.int64)).max(initial=0), max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)), width)
                own = vectors.astype(kind)
                bound = (np.maximum(own, 0) @ high.T.astype(kind) + np.minimum(own, 0) @ low.T.astype(kind)).astype(np.int64)
                score = batch.column(3).fill_null(-(1 << 62)).to_numpy()[:, None]
                least = batch.column(4).fill_null(_NULL).to_numpy()[:, None]
                may = ((bound > score) | ((bound == score) & (first[None, :] < least))) & (shards[None, :] != batch.column(2).to_numpy()[:, None])
                row, box = np.nonzero(may)
                for i in range(0, len(row), 1000):
                    took = batch.take(pa.array(row[i : i + 1000]))
                    yield pa.RecordBatch.from_arrays([took.column(0), took.column(1), pa.array(shards[box[i : i + 1000]], pa.int32()), took.column(3), took.column(4)], names=["q", "v", "shard", "score", "least"])

        more = queries.join(kth, "q", "left").select("q", "v", "shard", "score", "least").mapInArrow(elsewhere, "q long, v array<int>, shard int, score long, least long")
        found = found.unionByName(searched(more, False).select("q", "score", "vec_id"))
    won = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
    answers = won.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("worst"), "vec_id"))).alias("best")).join(queries.select("q", "v"), "q").select("v", "best")
    own = F.struct((-F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)).alias("worst"), F.col("vec_id"))
    mine = F.array_position("best", own)  # the query's row is one of the best, or beyond them
    others = F.slice(F.filter("best", lambda _, i: (i + 1) != mine), 1, k)
    out = asking.join(answers, "v").select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("place", "b"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), F.when(F.col("b.vec_id") != _NULL, F.col("b.vec_id")).alias("vec_id"), (-F.col("b.worst")).alias("score"))


def op12_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP12_SQL = """
with rows as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
met as (select q.r, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score from rows q join rows c on q.r <> c.r where q.vec_id % 20 = 0),
ranked as (select query_id, row_number() over (partition by r order by score desc, vec_id)::int as rank, vec_id, score from met)
select * from ranked where rank <= 20
"""
