"""Jaccard join of word shingles by prefixes of token combinations.

A document is the set of its distinct shingles; equal sets are one node. All
tokens of all documents are counted and have three classes: those of one
document, rare ones, and frequent ones, which more than FREQUENT documents
hold. In this order, then by hash, two sets that are alike share
min(EXTEND, ceil(threshold * n)) tokens within their prefixes of
n - ceil(threshold * n) + EXTEND tokens, n the greater set's size where it
counts. Rare tokens, and frequent ones that few sets outside of their greatest
component hold, are indexed singly; of the other frequent tokens, combinations
of two are indexed. Sets that are alike share two tokens of their prefixes, so
they meet at a single token or at a combination.

Only links decide components, so pairs of one component needn't all be tried:
first each token's holders are verified against two of them, the least and the
one with the greatest share of repeated tokens (what copies were made from has
no edits of its own). Then the holders of a token that are still in different
components are compared by a bitmap of each set, which bounds the intersection
from above: a bit that one set has and the other lacks stands for a token that
they don't share. A task gives a forest over the pairs within the bound, so
never more pairs than it has rows; trees of all tokens join to clusters, and
every link that is left lies in one of them. Each cluster's whole sets meet
once and are verified there, components joining as links are found.

A token or cluster of many sets is dealt to parts in blocks, those of its
greatest component apart; blocks of that component meet the others, never each
other. What is sent is in proportion to the sets while the others are one block,
beyond that to the sets times the number of blocks; memory is two blocks.

Tokens are 64-bit hashes of shingles, nodes 64-bit hashes of sets. Broadcasts
are bitmaps of 2^26 and 2^27 bits at any size.

Defined results: a text with fewer words than a shingle is one shingle of all
of them; without words (or null) it is the empty set, of component itself;
repeated rows are linked; a null identifier's component is the least of the
others' (null if there are none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.llm.components import components
from siteatlas.llm.kneser_ney import _by_group, _Counter, _numbers, _summed
from siteatlas.llm.storage import durable, table, tune
from siteatlas.llm.textops import mix, shingles, word_hashes

WORDS, PERCENT = 5, 80
FREQUENT, FEW, EXTEND, SHARDS = 8, 4096, 6, 64
SKETCH, PART, TOKENS = 1024, 4096, 2_000_000
BITS, REPEAT_BITS = 26, 27
_KEPT = ~np.uint64((1 << 24) - 1)


def _slots(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def _set(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def _sets(batch: pa.RecordBatch, column: int, i: int, words: int) -> list[np.ndarray]:
    return shingles(*word_hashes([(t or "").encode() for t in batch.column(column).slice(i, 100).to_pylist()]), words)


def _node(tokens: np.ndarray) -> int:
    """A set's hash; 0 for the empty set alone."""
    if not len(tokens):
        return 0
    h = mix(mix(tokens).sum(keepdims=True, dtype=np.uint64) ^ np.uint64(len(tokens)))
    return int((h | np.uint64(1)).view(np.int64)[0])


def _sketch(tokens: np.ndarray, bits: int = SKETCH) -> bytes:
    flags = np.zeros(bits, np.uint8)
    flags[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags).tobytes()


def _bitmap(parts: list[tuple[int, bytes]], bits: int = BITS) -> np.ndarray:
    """From packed slots of each shard's range."""
    out = np.zeros(1 << bits - 3, np.uint8)
    width = len(out) // SHARDS
    for shard, packed in parts:
        out[shard * width : (shard + 1) * width] = np.frombuffer(packed, np.uint8)
    return out


def _pack(s: int, tokens: np.ndarray, bits: int = BITS) -> bytes:
    flags = np.zeros((1 << bits) // SHARDS, np.uint8)
    flags[_slots(tokens, bits) - s * len(flags)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def token_classes(docs: DataFrame, words: int, more_than: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the slots that hold a token of two documents, and of more than so many."""

    def count(batches):
        counter = _Counter(SHARDS, lambda key: key)
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                yield from counter.add(np.concatenate(_sets(batch, 0, i, words)) & _KEPT)
        yield from counter.close()

    def mark(batches):
        for s, rows in _by_group(batches):
            key, n = _summed([_numbers(k, np.uint64) for k, _ in rows], [_numbers(c, np.uint32).astype(np.int64) for _, c in rows])
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([_pack(s, key[n > 1], REPEAT_BITS)], pa.binary()), pa.array([_pack(s, key[n > more_than])], pa.binary())], names=["shard", "repeated", "frequent"])

    met = docs.select("text").mapInArrow(count, "shard int, keys binary, counts binary").repartition("shard").sortWithinPartitions("shard")
    told = met.mapInArrow(mark, "shard int, repeated binary, frequent binary").collect()
    return _bitmap([(r.shard, r.repeated) for r in told], REPEAT_BITS), _bitmap([(r.shard, r.frequent) for r in told])


def node_bitmap(nodes: DataFrame) -> np.ndarray:
    """nodes: node. Bitmap of their slots."""

    def mark(batches):
        for s, rows in _by_group(batches):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([_pack(s, np.array([r[0] for r in rows], np.int64).view(np.uint64))], pa.binary())], names=["shard", "bits"])

    shard = F.shiftrightunsigned("node", 64 - 6).cast("int")
    told = (nodes.select(shard.alias("shard"), F.shiftrightunsigned("node", 64 - BITS).alias("slot")).distinct().select("shard", F.shiftleft("slot", 64 - BITS).alias("node")).repartition("shard").sortWithinPartitions("shard").mapInArrow(mark, "shard int, bits binary")).collect()
    return _bitmap([(r.shard, r.bits) for r in told])


def whole_sets(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Rows node, tokens of each of these nodes; of some others too, where slots are shared."""
    wanted = docs.sparkSession.sparkContext.broadcast(node_bitmap(nodes))

    def give(batches):
        bitmap, seen = wanted.value, set()
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                out = []
                for s in _sets(batch, 0, i, words):
                    node = _node(s)
                    if node and node not in seen and _set(bitmap, _slots(np.array([node], np.int64).view(np.uint64)))[0]:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(node)
                        out.append((node, s.tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["node", "tokens"])

    return docs.select("text").mapInArrow(give, "node long, tokens binary").dropDuplicates(["node"])


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    place = np.searchsorted(x, y)
    n = int((x[np.minimum(place, len(x) - 1)] == y).sum())
    return 100 * n >= percent * (len(x) + len(y) - n)


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of distinct pairs (u, v) of nodes, those that are alike."""
    pairs = durable(pairs, "pairs")
    sets = whole_sets(pairs.select(F.explode(F.array("u", "v")).alias("node")), docs, words)
    both = pairs.join(sets.select(F.col("node").alias("v"), F.col("tokens").alias("b")), "v").join(sets.select(F.col("node").alias("u"), F.col("tokens").alias("a")), "u")

    def test(batches):
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in (2, 3))
            keep = [_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return durable(both.select("u", "v", "a", "b").mapInArrow(test, "u long, v long"), "links")


def dealt(rows: DataFrame, key: str, weight: Column) -> DataFrame:
    """Rows (key, node, comp, ...) of keys that several components hold, with the columns minor (not of the key's greatest component) and others, most (weight of the minor rows and of the rest)."""
    own = rows.groupBy(key, "comp").agg(F.sum(weight).alias("w"))
    told = own.groupBy(key).agg(F.sum("w").alias("w"), F.max(F.struct("w", "comp")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
    told = told.select(key, "top.comp", (F.col("w") - F.col("top.w")).alias("others"), F.col("top.w").alias("most")).withColumnRenamed("comp", "top")
    return rows.join(told, key).withColumn("minor", F.col("comp") != F.col("top")).drop("top")


def parted(rows: DataFrame, size: int) -> DataFrame:
    """Rows of dealt() in blocks of about `size` in weight, the minor ones apart; each two blocks of which one is minor meet in one part (salt), a minor block with itself where it meets the first of the others."""
    few, many = (F.ceil(F.col(c) / size).cast("int") for c in ("others", "most"))
    block = F.pmod(F.xxhash64("node"), F.when(F.col("minor"), few).otherwise(many)).cast("int")
    part = lambda a, x: F.struct((a * (few + many) + x).alias("salt"), (x == 0).alias("first"))
    met = F.concat(F.transform(F.sequence(F.lit(0), many - 1), lambda x: part(block, x)), F.transform(F.filter(F.sequence(F.lit(0), few - 1), lambda x: x != block), lambda x: part(F.least(block, x), many + F.greatest(block, x))))
    rows = rows.withColumn("part", F.explode(F.when(F.col("minor"), met).otherwise(F.transform(F.sequence(F.lit(0), few - 1), lambda a: part(a, block)))))
    return rows.select("*", "part.*", F.when(F.col("minor"), block).otherwise(-1).alias("block")).drop("part", "minor", "others", "most")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Of consecutive rows (key, salt, node, n, comp, block, first, data): the data, nodes, sizes, components, blocks, whether blocks meet themselves."""

    def told(rows):
        node, n, comp, block, first, data = zip(*rows, strict=True)
        return data, *(np.array(x, np.int64) for x in (node, n, comp, block)), first[0]

    now, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if row[:2] != now:
                if rows:
                    yield told(rows)
                now, rows = row[:2], []
            rows.append(row[2:])
    if rows:
        yield told(rows)


def _pairs_out(found: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["u", "v"])
    for pair in found:
        out.append(pair)
        if len(out) == 10_000:
            yield batch()
            out = []
    if out:
        yield batch()


def _partners(i: int, differ: np.ndarray, n: np.ndarray, block: np.ndarray, first: bool, percent: int) -> np.ndarray:
    """Places that the minor set i is tried with in this part, as far as sizes allow."""
    ok = differ & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
    minor = block >= 0
    if not first:
        ok &= block != block[i]
    ok[i:] &= ~minor[i:]
    return np.flatnonzero(ok)


def _most(i: int, j: np.ndarray, n: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Bounds of the intersections of i and j from above."""
    mine, theirs = bits[i], bits[j]
    return np.minimum(n[i] - np.bitwise_count(mine & ~theirs).sum(1, dtype=np.int64), n[j] - np.bitwise_count(theirs & ~mine).sum(1, dtype=np.int64))


def _candidates(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple[int, int]]:
    """Of parts of tokens, with sketches: a forest over the pairs that can be alike, so fewer pairs than rows."""
    for data, node, n, comp, block, first in _by_part(batches):
        bits, tree = np.frombuffer(b"".join(data), np.uint64).reshape(len(node), -1), np.arange(len(node))
        for i in np.flatnonzero(block >= 0):
            j = _partners(i, (comp != comp[i]) & (tree != tree[i]), n, block, first, percent)
            j = j[(100 + percent) * _most(i, j, n, bits) >= percent * (n[i] + n[j])]
            trees, least = np.unique(tree[j], return_index=True)
            for k in j[least]:
                yield int(node[i]), int(node[k])
            tree[np.isin(tree, trees)] = tree[i]


def _links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple[int, int]]:
    """Of parts of clusters, with whole sets: verified pairs, one at most for two components as they then are."""
    for data, node, n, comp, block, first in _by_part(batches):
        sets = [np.frombuffer(x, np.uint64) for x in data]
        wide = 1 << int(np.clip(8 * int(np.median(n)) - 1, SKETCH - 1, (1 << 15) - 1)).bit_length()
        bits = np.frombuffer(b"".join(_sketch(s, wide) for s in sets), np.uint64).reshape(len(node), -1)
        for i in np.flatnonzero(block >= 0):
            j = _partners(i, comp != comp[i], n, block, first, percent)
            most = _most(i, j, n, bits)
            can = (100 + percent) * most >= percent * (n[i] + n[j])
            for k in j[can][np.argsort(-most[can], kind="stable")]:
                if comp[k] != comp[i] and _alike(sets[i], sets[k], percent):
                    yield int(node[i]), int(node[k])
                    comp[comp == comp[k]] = comp[i]


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of df: identifier, n_shingles, component_id. percent is over 50."""
    if percent <= 50:
        raise ValueError(f"percent {percent}; unlike sets that are alike share two tokens only above 50")
    spark = df.sparkSession
    tune(spark)
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    classes = spark.sparkContext.broadcast(token_classes(docs, words, FREQUENT))
    shape = pa.schema([("id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64())), ("shared", pa.float64()), ("sketch", pa.binary())])

    def prefixes(batches):
        (repeated, frequent), seen = classes.value, set()
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                out = []
                for doc, s in zip(batch.column(0).slice(i, 100).to_pylist(), _sets(batch, 1, i, words), strict=True):
                    node, n, prefix, shared, sketch = _node(s), len(s), None, None, None
                    if node and node not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(node)
                        common, twice = _set(frequent, _slots(s)), _set(repeated, _slots(s, REPEAT_BITS))
                        shared, sketch = float(twice.mean() + common.mean()), _sketch(s)
                        least = -(-percent * n // 100)
                        prefix = np.concatenate([s[~twice], s[twice & ~common], s[twice & common]])[: n - least + EXTEND]
                        prefix = prefix[_set(repeated, _slots(prefix, REPEAT_BITS))].view(np.int64).tolist()
                    out.append((doc, node, n, prefix, shared, sketch))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)

    rows = durable(docs.select(F.col("id").cast("long"), "text").mapInArrow(prefixes, "id long, node long, n long, tokens array<long>, shared double, sketch binary"), "prefixes")
    sets = rows.where("tokens is not null").dropDuplicates(["node"])
    index = sets.select("node", "n", "shared", F.explode("tokens").alias("token"))
    own = Window.partitionBy("token")
    told = index.select("token", "node", "n", F.min("node").over(own).alias("least"), F.max("node").over(own).alias("most"), F.max(F.struct("shared", "node")).over(own)["node"].alias("source"))
    held = durable(told.where("least <> most").drop("most"), "index")
    ends = held.select("node", "n", F.explode(F.array_distinct(F.array("least", "source"))).alias("end")).where("node <> end")
    ends = ends.groupBy(F.greatest("node", "end").alias("u"), F.least("node", "end").alias("v")).agg(F.count("*").alias("met"), F.max("n").alias("n"))
    first = verified(ends.where(f"met >= least({EXTEND}, ceil(n * {percent} / 100))").select("u", "v"), docs, words, percent)
    found = components(first)

    comp = held.select("token", "node", "n").join(found, "node", "left").select("token", "node", "n", F.coalesce("comp", "node").alias("comp"))
    holders = durable(dealt(comp, "token", F.lit(1)), "holders")
    sketches = sets.select("node", "sketch")
    columns = ["salt", "node", "n", "comp", "block", "first"]

    def candidates(holders):
        near = parted(holders, PART).join(sketches, "node").select("token", *columns, "sketch")
        return near.repartition("token", "salt").sortWithinPartitions("token", "salt").mapInArrow(lambda it: _pairs_out(_candidates(it, percent)), "u long, v long")

    several = holders.where(F.col("others") > FEW).groupBy("node", "n", "comp").agg(F.collect_set("token").alias("tokens"))
    many = F.flatten(F.transform("tokens", lambda x: F.transform(F.filter("tokens", lambda y: y > x), lambda y: F.xxhash64(x, y))))
    combined = durable(dealt(several.select(F.explode(many).alias("token"), "node", "n", "comp"), "token", F.lit(1)), "combinations")
    near = durable(candidates(holders.where(F.col("others") <= FEW)).unionByName(candidates(combined)), "candidates")

    nodes = components(near).select("node", F.col("comp").alias("cluster")).join(sets.select("node", "n"), "node").join(found, "node", "left")
    nodes = durable(nodes.select("node", "n", "cluster", F.coalesce("comp", "node").alias("comp")), "clusters")
    parts = parted(dealt(nodes, "cluster", F.col("n")), TOKENS).join(whole_sets(nodes.select("node"), docs, words), "node").select("cluster", *columns, "tokens")
    parts = parts.repartition("cluster", "salt").sortWithinPartitions("cluster", "salt")
    second = durable(parts.mapInArrow(lambda it: _pairs_out(_links(it, percent)), "u long, v long"), "links")
    hung = found.where("node <> comp").select(F.col("node").alias("u"), F.col("comp").alias("v"))
    final = components(hung.unionByName(second))

    least = rows.where("node <> 0").groupBy("node").agg(F.min("id").alias("id")).join(final, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "id")
    of = least.join(least.groupBy("comp").agg(F.min("id").alias("component_id")), "comp").select("node", "component_id")
    out = rows.select("id", "node", "n").join(of, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=85)
