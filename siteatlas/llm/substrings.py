"""Repeated byte strings by a hash-compared suffix sort.

A string of `length` bytes that starts at two places at least is removed where
it lies. Each such string holds one anchor: the run of ANCHOR bytes in it with
the smallest hash, leftmost among equals, so equal strings have equal anchors
at equal offsets. Anchors of all texts are counted; strings whose anchor comes
once can't repeat. The others make contexts: the bytes that the strings of one
anchor cover. A 128-bit BLAKE2 digest of each context, without its bytes, meets
first: a context that comes again is repeated as a whole, and one of each kind
is elected. (Polynomial hashes wouldn't do here: texts can be made that collide
modulo 2^64 whatever the base, and these contexts aren't compared again.) Elected contexts whose anchor has another go, with their bytes,
to the task of their anchor. There, suffixes at equal offsets from equal
anchors are sorted: prefix polynomial hashes and a binary search give the
common extension of two suffixes, so one comparison takes a logarithmic number
of steps, and a bottom-up merge sort puts them in order for all groups at once.
Neighbours that share `length` bytes are compared byte by byte before they
count.

An anchor with HOT unlike contexts or more (a line in a third of all texts),
which would be over 2 MB for one sort, is split by salt. A string found twice
within a salt needs no more; of the rest, and one of each, 128-bit BLAKE2 digests
meet evenly spread.

What is broadcast is 2^26 bits each for repeated anchors, anchors with several
contexts and elected contexts and 2^22 for frequent anchors, at any size; a
slot that two share costs work, never results.

Defined results: null counts as empty; texts shorter than `length` lose
nothing by themselves; repeated rows are each other's copies; matches never
cross texts. Rows that agree in identifier and text have the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.llm.kneser_ney import _by_group, _Counter, _numbers, _summed
from siteatlas.llm.storage import durable, table, tune
from siteatlas.llm.textops import mix

LENGTH, ANCHOR = 200, 64
SLOT_BITS, HOT_BITS, HOT, SALTS = 26, 22, 8192, 64
BLOCK, CHUNK, HELD = 1 << 20, 3 << 20, 400_000
_B1 = np.uint64(0x9E3779B97F4A7C15)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse, n at least, kept for the next call."""
    if int(base) not in _powers or len(_powers[int(base)][0]) < n:
        size = max(n, 2 * BLOCK)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        _powers[int(base)] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (base, inverse))
    return _powers[int(base)]


class PrefixHash:
    """Polynomial hashes of any stretch of buf, modulo 2^64."""

    def __init__(self, buf: np.ndarray, base: np.uint64 = _B1):
        power, self.unpower = _power(base, len(buf) + 1)
        self.sum = np.empty(len(buf) + 1, np.uint64)
        self.sum[0] = 0
        terms = buf.astype(np.uint64)
        terms += np.uint64(1)
        terms *= power[: len(buf)]
        np.cumsum(terms, out=self.sum[1:])

    def of(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (self.sum[at + n] - self.sum[at]) * self.unpower[at]

    def all(self, n: int) -> np.ndarray:
        """Of every n bytes, in order."""
        return (self.sum[n:] - self.sum[:-n]) * self.unpower[: len(self.sum) - n]


def _slide(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values."""
    n = len(values) - width + 1
    pad = -len(values) % width
    grid = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def digests(parts: Iterator[bytes]) -> np.ndarray:
    """Rows of two numbers: the 128-bit digest of each."""
    return np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in parts), np.int64).reshape(-1, 2)


def contexts(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For blocks of texts: anchor's hash, text's number, first string's start, strings, anchor's offset from that start.

    Texts over BLOCK bytes are read in blocks that overlap by length - 1.
    """
    block: list[tuple[int, int, bytes]] = []
    size = 0

    def close():
        owner = np.array([b[0] for b in block])
        shift = np.array([b[1] for b in block])
        sizes = np.array([len(b[2]) for b in block])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        buf = np.frombuffer(b"".join(b[2] for b in block), np.uint8)
        prefix = PrefixHash(buf)
        hashes = mix(prefix.all(ANCHOR))
        ranked = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
        at = (_slide(ranked, length - ANCHOR + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        starts = np.concatenate([np.arange(f, f + n - length + 1) for f, n in zip(first, sizes, strict=True)])
        text = np.repeat(np.arange(len(block)), sizes - length + 1)
        anchor = at[starts]
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
        count = np.diff(np.append(new, len(starts)))
        t = text[new]
        # least hashes of windows are small numbers: mixed once more, they spread over shards and slots
        return mix(hashes[anchor[new]]), owner[t], starts[new] - first[t] + shift[t], count, anchor[new] - starts[new]

    for i, text in enumerate(texts):
        for at in range(0, len(text), BLOCK):
            part = text[at : at + BLOCK + length - 1]
            if len(part) >= length:
                block.append((i, at, part))
                size += len(part)
            if size > BLOCK:
                yield close()
                block, size = [], 0
    if block:
        yield close()


class SuffixSort:
    """Sorts suffixes of buf, cut at `limit` bytes, by merging runs."""

    def __init__(self, buf: np.ndarray, limit: int):
        self.buf, self.limit, self.hash = buf, limit, PrefixHash(buf)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common bytes of the suffixes at x and y, `limit` at most, by binary search over hashes."""
        out = np.full(len(x), self.limit, np.int64)
        differ = np.flatnonzero(self.hash.of(x, self.limit) != self.hash.of(y, self.limit))
        x, y = x[differ], y[differ]
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.limit - 1, np.int64)
        for _ in range(int(self.limit - 1).bit_length()):
            mid = (low + high + 1) // 2
            same = self.hash.of(x, mid) == self.hash.of(y, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        out[differ] = low
        return out

    def less(self, x: np.ndarray, y: np.ndarray, ties: bool) -> np.ndarray:
        """Whether the suffix at x comes before the one at y; ties: what equal ones give."""
        n = self.extension(x, y)
        return np.where(n >= self.limit, ties, self.buf[np.minimum(x + n, len(self.buf) - 1)] < self.buf[np.minimum(y + n, len(self.buf) - 1)])

    def order(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Places in `at` sorted within groups; group is ascending."""
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(first, len(group)))
        within, begin, n = np.arange(len(at)) - np.repeat(first, size), np.repeat(first, size), np.repeat(size, size)
        order, run = np.arange(len(at)), 1
        while run < size.max(initial=0):
            live = np.flatnonzero(n > run)
            w, b, m = within[live], begin[live], n[live]
            pair = w // (2 * run) * (2 * run)
            left = w - pair < run
            low = np.where(left, pair + run, pair)
            high = np.minimum(np.where(left, pair + 2 * run, pair + run), m)
            low = np.minimum(low, high)
            base, own = low.copy(), at[order[live]]
            for _ in range(run.bit_length()):
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                other, mine = at[order[b[open_] + mid]], own[open_]
                l = left[open_]
                before = np.empty(len(open_), bool)
                before[l] = self.less(other[l], mine[l], False)
                before[~l] = self.less(other[~l], mine[~l], True)
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            place = b + pair + np.where(left, w - pair, w - pair - run) + (low - base)
            merged = order.copy()
            merged[place] = order[live]
            order, run = merged, 2 * run
        return order

    def same(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether `limit` bytes are equal, byte by byte."""
        view = np.lib.stride_tricks.sliding_window_view(self.buf, self.limit)
        out = np.empty(len(x), bool)
        for i in range(0, len(x), 4096):
            out[i : i + 4096] = (view[x[i : i + 4096]] == view[y[i : i + 4096]]).all(axis=1)
        return out


def repeated(group: np.ndarray, offset: np.ndarray, data: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, PrefixHash | None]:
    """Of contexts with ascending groups: place of each string in the joined bytes, its context, whether it repeats, whether it is its like's first."""
    seen: dict[tuple, int] = {}
    twin = np.array([seen.setdefault((g, o, d), i) for i, (g, o, d) in enumerate(zip(group.tolist(), offset.tolist(), data, strict=True))])
    many = np.bincount(twin, minlength=len(twin)) > 1
    own = np.flatnonzero(twin == np.arange(len(twin)))
    sizes = np.array([len(d) for d in data])
    begin = np.concatenate([[0], np.cumsum(sizes[own])[:-1]])
    buf = np.frombuffer(b"".join(data[i] for i in own), np.uint8)
    count = sizes[own] - length + 1
    context = np.repeat(np.arange(len(own)), count)
    step = np.arange(len(context)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    at = begin[context] + step
    alone = np.bincount(np.unique(group[own], return_inverse=True)[1])[np.unique(group[own], return_inverse=True)[1]] == 1
    key = group[own][context] * 65536 + (offset[own][context] - step)
    dup = many[own][context]
    first = np.ones(len(at), bool)
    work = np.flatnonzero(~alone[context])
    if len(work):
        work = work[np.argsort(key[work], kind="stable")]
        sort = SuffixSort(buf, length)
        order = work[sort.order(at[work], key[work])]
        x, y = order[:-1], order[1:]
        near = np.flatnonzero(key[x] == key[y])
        near = near[sort.hash.of(at[x[near]], length) == sort.hash.of(at[y[near]], length)]
        near = near[sort.same(at[x[near]], at[y[near]])]
        dup[x[near]] = dup[y[near]] = True
        first[y[near]] = False
    # one entry for each context: those of twins are their own first one's
    back = np.empty(len(twin), np.int64)
    back[own] = np.arange(len(own))
    return at, back[twin], dup, first, buf


def _runs(flags: np.ndarray, start: int, length: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(start + int(a), start + int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _slots(anchors: np.ndarray, bits: int) -> np.ndarray:
    return (anchors >> np.uint64(64 - bits)).astype(np.int64)


def _place(key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One number for a text's key and a place in it."""
    return mix(key.view(np.uint64) ^ mix(start.astype(np.uint64)))


def _set(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def repeated_spans(df: DataFrame, length: int = LENGTH, shards: int = 64) -> DataFrame:
    """df: id, key, text. Rows id, key, start, end: stretches of bytes that repeated strings cover; they may overlap."""
    raw = lambda batch, i, column: [(t or "").encode() for t in batch.column(column).slice(i, 100).to_pylist()]

    def blocks(batches):
        """Identifiers, keys, texts and contexts of 100 rows at a time; batches: id, key, text."""
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                ids, keys = (batch.column(c).slice(i, 100).to_numpy(zero_copy_only=False) for c in (0, 1))
                texts = raw(batch, i, 2)
                for found in contexts(texts, length):
                    yield ids, keys, texts, found

    def count(batches):
        counter = _Counter(shards, lambda key: key)
        for *_, found in blocks(batches):
            yield from counter.add(found[0])
        yield from counter.close()

    def mark(batches):
        """Bits of the slots whose keys come often enough; shards beyond the first `shards` hold elected contexts."""
        for s, rows in _by_group(batches):
            key, n = _summed([_numbers(k, np.uint64) for k, _ in rows], [_numbers(c, np.uint32).astype(np.int64) for _, c in rows])
            out = []
            for bits, least in ((SLOT_BITS, 2 if s < shards else 1), (HOT_BITS, HOT)):
                width = (1 << bits) // shards
                flags = np.zeros(width, np.uint8)
                flags[_slots(key[n >= least], bits) - s % shards * width] = 1
                out.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([out[0]], pa.binary()), pa.array([out[1]], pa.binary())], names=["shard", "often", "hot"])

    def marked(counted: DataFrame) -> list[np.ndarray]:
        maps = [np.zeros(1 << bits - 3, np.uint8) for bits in (SLOT_BITS, SLOT_BITS, HOT_BITS)]
        for r in counted.repartition("shard").sortWithinPartitions("shard").mapInArrow(mark, "shard int, often binary, hot binary").toLocalIterator():
            for bitmap, part in ((maps[r.shard // shards], r.often), (maps[2] if r.shard < shards else None, r.hot)):
                if bitmap is not None:
                    at = r.shard % shards * len(part)
                    bitmap[at : at + len(part)] = np.frombuffer(part, np.uint8)
        return maps

    spark = df.sparkSession
    df = df.select("id", "key", "text")
    counts = "shard int, keys binary, counts binary"
    often = spark.sparkContext.broadcast(marked(df.mapInArrow(count, counts))[0])

    slim = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("anchor", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("again", pa.bool_())])

    def flushed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Contexts once each; the places of those that came again as merged stretches, whose anchor is null."""
        h1, h2, anchor, id_, key, start, end = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((h2, h1))
        new = np.concatenate([[True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])])
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(order))) > 1
        one = order[first]
        more = order[many[np.cumsum(new) - 1]]
        more = more[np.lexsort((start[more], id_[more], key[more]))]
        k, i, s, e = (x[more] for x in (key, id_, start, end))
        runs = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (s[1:] > e[:-1])])) if len(more) else more
        last = np.append(runs[1:], len(more)) - 1 if len(more) else more
        none = pa.nulls(len(runs), pa.int64())
        for columns in (
            [*(x[one] for x in (h1, h2, anchor, id_, key, start, end)), many],
            [k[runs], s[runs], none, i[runs], k[runs], s[runs], e[last], np.ones(len(runs), bool)],
        ):
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, slim, strict=True)], schema=slim)

    def gather(batches):
        held, size = [], 0
        for ids, keys, texts, (anchor, owner, start, n, _) in blocks(batches):
            pick = np.flatnonzero(_set(often.value, _slots(anchor, SLOT_BITS)))
            o, s = owner[pick], start[pick]
            e = s + n[pick] + length - 1
            h = digests(texts[i][a:b] for i, a, b in zip(o.tolist(), s.tolist(), e.tolist(), strict=True))
            held.append((h[:, 0], h[:, 1], anchor[pick].view(np.int64), ids[o], keys[o], s, e))
            size += len(pick)
            if size > HELD:
                yield from flushed(held)
                held, size = [], 0
        if size:
            yield from flushed(held)

    like = Window.partitionBy("h1", "h2").orderBy("key", "start")
    every = like.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = (
        df.mapInArrow(gather, "h1 long, h2 long, anchor long, id long, key long, start long, end long, again boolean")
        .withColumn("first", (F.row_number().over(like) == 1) & F.col("anchor").isNotNull())
        .withColumn("whole", F.max("again").over(every) | (F.count(F.lit(1)).over(every) > 1))
        .where("first or whole")
        .select("anchor", "id", "key", "start", "end", "first", "whole")
    )
    met = durable(met, "contexts")

    def elect(batches):
        """Anchors of elected contexts, counted, and the places of these contexts."""
        counters = [_Counter(shards, lambda key: key) for _ in range(2)]
        out = lambda i, found: (pa.RecordBatch.from_arrays([pa.compute.add(b.column(0), pa.scalar(i * shards, pa.int32())), *b.columns[1:]], names=b.schema.names) for b in found)
        for batch in batches:
            anchor, key, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            yield from out(0, counters[0].add(anchor.view(np.uint64)))
            yield from out(1, counters[1].add(_place(key, start)))
        for i, c in enumerate(counters):
            yield from out(i, c.close())

    kept = spark.sparkContext.broadcast(marked(met.where("first").select("anchor", "key", "start").mapInArrow(elect, counts)))
    cut = pa.schema([("anchor", pa.int64()), ("salt", pa.int32()), ("id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("offset", pa.int64()), ("data", pa.binary())])

    def give(batches):
        several, elected, hot = kept.value
        for ids, keys, texts, (anchor, owner, start, n, offset) in blocks(batches):
            pick = np.flatnonzero(_set(several, _slots(anchor, SLOT_BITS)))
            pick = pick[_set(elected, _slots(_place(keys[owner[pick]], start[pick]), SLOT_BITS))]
            if not len(pick):
                continue
            anchor, o, s, n, offset = (x[pick] for x in (anchor, owner, start, n, offset))
            salt = np.where(_set(hot, _slots(anchor, HOT_BITS)), keys[o] % SALTS, -1)
            data = [texts[i][a:b] for i, a, b in zip(o.tolist(), s.tolist(), (s + n + length - 1).tolist(), strict=True)]
            for i in range(0, len(pick), 5000):
                part = slice(i, i + 5000)
                columns = (anchor[part].view(np.int64), salt[part], ids[o[part]], keys[o[part]], s[part], offset[part], data[part])
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, cut, strict=True)], schema=cut)

    told = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """rows: (group, salt, id, key, start, offset, data), whole groups."""
        group, offset = np.array([r[0] for r in rows]), np.array([r[5] for r in rows])
        at, context, dup, first, buf = repeated(group, offset, [r[6] for r in rows], length)
        n = np.array([len(r[6]) for r in rows]) - length + 1
        sizes = np.zeros(context.max() + 1, np.int64)
        sizes[context] = n
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        out: list[tuple] = []
        given: set[int] = set()
        for r, c, m in zip(rows, context.tolist(), n.tolist(), strict=True):
            own = slice(begin[c], begin[c] + m)
            out += [(r[2], r[3], a, b, None, None) for a, b in _runs(dup[own], r[4], length)]
            if r[1] >= 0 and c not in given:
                given.add(c)
                pick = np.flatnonzero(first[own])
                h1, h2 = digests(buf[i : i + length] for i in at[own][pick].tolist()).T.tolist()
                out += [(r[2], r[3], r[4] + j, r[4] + j + length, x, y) for j, x, y in zip(pick.tolist(), h1, h2, strict=True)]
        for i in range(0, len(out), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out[i : i + 20_000], strict=True), told, strict=True)], schema=told)

    def sort(batches):
        rows, size, group, now = [], 0, 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if row[:2] != now:
                    if size > CHUNK:
                        yield from settle(rows)
                        rows, size = [], 0
                    now, group = row[:2], group + 1
                rows.append((group, *row[1:]))
                size += len(row[6])
        if rows:
            yield from settle(rows)

    sorted_ = (
        df.mapInArrow(give, "anchor long, salt int, id long, key long, start long, offset long, data binary")
        .repartition("anchor", "salt")
        .sortWithinPartitions("anchor", "salt")
        .mapInArrow(sort, "id long, key long, start long, end long, h1 long, h2 long")
    )
    found = durable(sorted_, "suffixes")
    single = found.where("h1 is not null").groupBy("h1", "h2").agg(F.collect_list(F.struct("id", "key", "start", "end")).alias("at")).where(F.size("at") > 1).select(F.inline("at"))
    place = ["id", "key", "start", "end"]
    return met.where("whole").select(place).unionByName(found.where("h1 is null").select(place)).unionByName(single)


def remove_repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each row of df: identifier, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes."""
    spark = df.sparkSession
    tune(spark)
    text = F.coalesce(df[text_col], F.lit(""))
    none = F.lit(-(1 << 63))
    docs = df.select(F.coalesce(df[id_col].cast("long"), none).alias("id"), F.xxhash64(text, df[id_col]).alias("key"), text.alias("text"))
    spans = repeated_spans(docs, length).groupBy("id", "key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, raw, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = raw.encode()
                kept, at, n, runs = [], 0, 0, 0
                end = -1
                for s in sorted((x["start"], x["end"]) for x in spans or ()):
                    if s[0] > end:
                        if runs:
                            n += end - begin
                            at = end
                        kept.append(raw[at : s[0]])
                        runs, begin, end = runs + 1, *s
                    else:
                        end = max(end, s[1])
                if runs:
                    n += end - begin
                    at = end
                kept = b"".join([*kept, raw[at:]])
                out.append((doc, len(raw), n, runs, hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"]) if out else None

    cut_ = docs.join(spans, ["id", "key"], "left").select("id", "text", "spans").mapInArrow(lambda it: (b for b in cut(it) if b is not None), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
    return cut_.select(F.nullif("id", none).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept_bytes")
