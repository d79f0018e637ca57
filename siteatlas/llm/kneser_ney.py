"""Interpolated modified Kneser-Ney model of any order from 2, counted in Spark and read by memory map.

Words are counted by task and meet in shards of equal ranges of their 64-bit
hash; each shard is written as a sorted array of hashes with counts. Words are
numbered by classes of frequency (powers of two), the most frequent first, so
that n-grams, which are rows of such numbers, pack well: a number is the first
one of the word's class and shard and its rank in them. N-grams of the full order are also counted by task; they meet in shards by a hash of the n-gram,
so a frequent word or context fills no shard. Each shard is written as a sorted
array of keys, with a code for each into the shard's distinct rows of numbers,
and gives to the order below one continuation for the end of each n-gram and
the sums of its contexts. So lower orders come from the higher one's shards, and
only the highest from the texts; the sums of single words meet by block of word
numbers. The arrays lie in the folder that all executors share; workers map them
and look up a batch's distinct words and n-grams.

The driver sees sums of each shard only: tokens, words and counts of counts.

Texts begin with order - 1 begin symbols. Each order is interpolated with the
one below, the lowest with the uniform distribution over the known words and one
unknown word, so every text has a probability. Keys of pairs are exact; longer
n-grams are hashes, of which an array tells the shard, the bucket in it and 32
bits more: one in 500 million n-grams that don't occur is taken for one that does.

Defined results: a null or empty text is the end token alone; with no training
rows every token has probability 1; a null identifier counts as empty text in
the fold. Up to 2^32 - 2 words; more raise an error.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteatlas.llm.storage import cleaned, new_path, table, tune
from siteatlas.llm.textops import mix, word_hashes

END = mix(np.array([0xE0D], dtype=np.uint64))[0]
ORDER = 3
GRAMS_A_SHARD, WORDS_A_BLOCK, HELD = 2_000_000, 1 << 20, 1_500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def in_fold(doc_id, modulus: int, remainder: int) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == remainder


def _local(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise RuntimeError(f"the shared folder must be one that workers can map, and {path} isn't")
    return path


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Whole or not at all, also where a task runs twice."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    array.tofile(part)
    os.replace(part, f"{folder}/{name}")


def _planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight together: of sorted numbers most compress to nothing."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _numbers(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(key) else count


def _shard(high: np.ndarray, shards: int) -> np.ndarray:
    return (high >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)


class _Counter:
    """Counts of one task, given out by shard whenever many are held."""

    def __init__(self, shards: int, spread):
        self.shards, self.spread, self.keys, self.counts, self.size = shards, spread, [], [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        key, count = np.unique(keys, return_counts=True)
        self.keys.append(key)
        self.counts.append(count)
        self.size += len(key)
        if self.size > HELD:
            yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            key, count = _summed(self.keys, self.counts)
            shard = _shard(self.spread(key), self.shards)
            order = np.argsort(shard, kind="stable")
            key, count, shard = key[order], count[order].astype(np.uint32), shard[order]
            first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            ends = [*first[1:], len(key)]
            yield pa.RecordBatch.from_arrays([pa.array(shard[first].astype(np.int32)), pa.array([_planes(key[i:j]) for i, j in zip(first, ends, strict=True)], pa.binary()), pa.array([_planes(count[i:j]) for i, j in zip(first, ends, strict=True)], pa.binary())], names=["shard", "keys", "counts"])
            self.keys, self.counts, self.size = [], [], 0


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """Consecutive rows with the same first column."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if row[0] != now and rows:
                yield now, rows
                rows = []
            now = row[0]
            rows.append(row[1:])
    if rows:
        yield now, rows


def _blocks(batch: pa.RecordBatch, column: int, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text, one row at least."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else []
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, side="right")))
        yield batch.slice(i, j - i)
        i = j


def _tokens(ids: list, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, and where each text begins."""
    words, at = word_hashes([(t or "").encode() for t in texts])
    return np.insert(words, at[1:], END), at + np.arange(len(at))


class Arrays:
    """The model's files, mapped on first use."""

    def __init__(self, folder: str):
        self.folder, self.maps = folder, {}

    def get(self, name: str, kind: type) -> np.ndarray:
        if name not in self.maps:
            path = f"{self.folder}/{name}"
            self.maps[name] = np.memmap(path, dtype=kind, mode="r") if os.path.exists(path) and os.path.getsize(path) else np.empty(0, kind)
        return self.maps[name]

    def _place(self, name: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where hashed keys stand in an array that is kept in buckets, and whether they do."""
        ends, known = self.get(f"tops{name}", np.uint32), self.get(f"lows{name}", np.uint32)
        if not len(known):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        bits = (len(ends) - 1).bit_length() - 1  # 2^bits buckets and one more end
        bucket, low = _cut_key(keys, bits)
        at, to = ends[bucket].astype(np.int64), ends[bucket + 1].astype(np.int64)
        last = to - 1
        while len(open_ := np.flatnonzero(at < to)):
            mid = (at[open_] + to[open_]) // 2
            less = known[mid] < low[open_]
            at[open_[less]], to[open_[~less]] = mid[less] + 1, mid[~less]
        return at, (at <= last) & (known[np.minimum(at, len(known) - 1)] == low)

    def find(self, stem: str, shards: int, keys: np.ndarray, high: np.ndarray, width: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each shard that keys reach: its number, which keys, their places, whether they are there. Kept in buckets where width is given: that of the words of pairs, 0 for hashes."""
        shard = _shard(high, shards)
        order = np.argsort(shard, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if len(own):
                s = int(shard[own[0]])
                if width is not None and len(self.get(f"tops{stem}-{s}", np.uint32)):
                    yield s, own, *self._place(f"{stem}-{s}", _scrambled(keys[own], width) if width else keys[own])
                    continue
                known = self.get(f"{stem if width is None else f'keys{stem}'}-{s}", np.uint64)
                place = np.searchsorted(known, keys[own])
                there = np.zeros(len(own), bool)
                inside = place < len(known)
                there[inside] = known[place[inside]] == keys[own][inside]
                yield s, own, place, there


def _scrambled(pairs: np.ndarray, width: int) -> np.ndarray:
    """Keys of pairs of words of `width` bits, one to one as numbers whose first bits are evenly spread."""
    line = pairs >> np.uint64(32) << np.uint64(width) | pairs & np.uint64(0xFFFFFFFF)
    for _ in range(2):  # a product with an odd number and a shift are one to one on 2 width bits
        line = line * _STEP & np.uint64((1 << 2 * width) - 1)
        line = line ^ line >> np.uint64(width)
    return line << np.uint64(64 - 2 * width)


def _cut_key(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash's first bits, and the 32 after them."""
    first = (keys >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)
    return first, (keys >> np.uint64(32 - bits)).astype(np.uint32)


def _frequency(count: np.ndarray) -> np.ndarray:
    """Class of each count, 0 for the greatest."""
    return 63 - np.frexp(count.astype(np.float64))[1]


class Words(Arrays):
    """offsets: the first number of each class and shard."""

    def __init__(self, folder: str, offsets: np.ndarray, known: int):
        super().__init__(folder)
        self.offsets, self.unknown = offsets, known + 1

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and training count of each word."""
        keys, back = np.unique(hashes, return_inverse=True)
        number, count = np.full(len(keys), self.unknown, np.int64), np.zeros(len(keys), np.int64)
        for s, own, place, there in self.find("words", self.offsets.shape[1], keys, keys):
            found = self.get(f"counts-{s}", np.int64)[place[there]]
            count[own[there]] = found
            number[own[there]] = self.offsets[_frequency(found), s] + self.get(f"ranks-{s}", np.uint32)[place[there]]
        return number[back], count[back]


def _grams(number: np.ndarray, at: np.ndarray, begin: int, order: int) -> np.ndarray:
    """The last `order` words up to each token, the token itself in the last row."""
    place = np.arange(len(number)) - np.repeat(at[:-1], np.diff(at))
    out = np.full((order, len(number)), begin, np.uint32)
    for back in range(order):
        there = np.flatnonzero(place >= back)
        out[order - 1 - back, there] = number[there - back]
    return out


def _key(grams: np.ndarray) -> np.ndarray:
    key = grams[0].astype(np.uint64)
    if len(grams) > 1:
        key = key << np.uint64(32) | grams[1].astype(np.uint64)
    for row in grams[2:]:
        key = mix(mix(key) * _STEP + row.astype(np.uint64))
    return key


def _met(grams: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, their n-grams and the sums of their columns of values."""
    key = _key(grams)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[first], grams[:, order[first]], np.add.reduceat(values[:, order], first, axis=1) if len(key) else values


_PACKED = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("values", pa.binary())])
_PACKED_DDL = "shard int, kind int, keys binary, values binary"


def _packed(rows) -> bytes:
    """Planes of rows of numbers, compressed."""
    return zstandard.ZstdCompressor(level=6).compress(b"".join(_planes(row) for row in rows))


def _dealt(grams: np.ndarray, values: np.ndarray, kind: int, shards: int) -> Iterator[tuple]:
    """Rows of _PACKED, one for each shard that is reached, each sorted by its first words (by as many bits as one number holds), of which the first is packed as steps."""
    shard = _shard(mix(_key(grams)), shards)
    width = int(grams[:2].max(initial=0)).bit_length()
    spare = 64 - max(1, (shards - 1).bit_length())
    first, second = (row.astype(np.uint64) for row in grams[:2])
    line = first << np.uint64(width) | second if 2 * width <= spare else first
    order = np.argsort(shard << np.uint64(2 * width if 2 * width <= spare else width) | line)
    shard = shard[order]
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if j > i:
            own = order[i:j]
            yield int(shard[i]), kind, _packed([np.diff(grams[0][own], prepend=np.uint32(0)), *(row[own] for row in grams[1:])]), _packed(row[own] for row in values)


def _undealt(rows: list, width: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams and values of rows (keys, values)."""
    rows = [tuple(zstandard.ZstdDecompressor().decompress(x) for x in r) for r in rows]
    grams = [np.stack([_numbers(k[i * len(k) // order : (i + 1) * len(k) // order], np.uint32) for i in range(order)]) for k, _ in rows]
    for g in grams:
        g[0] = np.cumsum(g[0], dtype=np.uint32)
    values = [np.stack([_numbers(v[i * len(v) // width : (i + 1) * len(v) // width], np.int64) for i in range(width)]) for _, v in rows]
    return np.concatenate([np.empty((order, 0), np.uint32), *grams], axis=1), np.concatenate([np.empty((width, 0), np.int64), *values], axis=1)


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)


def _code_kind(rows: int) -> type:
    return np.uint8 if rows <= 1 << 8 else np.uint16 if rows <= 1 << 16 else np.uint32


def _save_rows(folder: str, level: int, shard: int, key: np.ndarray, values: np.ndarray, width: int) -> None:
    """Keys, the distinct columns of values and a code for each key.

    Keys are kept in buckets of eight or so: the ends of the buckets by the keys' first bits, and the 32 bits after these. Of
    pairs that is the whole key, with more buckets if need be; where these would take more room than they spare, whole keys are kept.
    """
    stem, bits = f"{level}-{shard}", max(len(key).bit_length() - 3, 0)
    if level == 2:
        spread = _scrambled(key, width) if 2 * width <= 64 else key
        bits = max(bits, 2 * width - 32)
        if bits < max(len(key).bit_length(), 4) and 2 * width <= 64:
            order = np.argsort(spread)
            key, values = spread[order], values[:, order]
        else:
            bits = -1
    like = np.zeros(len(key), np.uint64)
    for row in values:
        like = mix(like * _STEP + row.astype(np.uint64) + np.uint64(1))
    kinds, code = np.unique(like, return_inverse=True)
    first = np.empty(len(kinds), np.int64)
    first[code] = np.arange(len(code))
    if bits >= 0:
        bucket, low = _cut_key(key, bits)
        _save(folder, f"tops{stem}", np.searchsorted(bucket, np.arange((1 << bits) + 1)).astype(np.uint32))
        _save(folder, f"lows{stem}", low)
    else:
        _save(folder, f"keys{stem}", key)
    _save(folder, f"rows{stem}", np.ascontiguousarray(values[:, first]))
    _save(folder, f"codes{stem}", code.astype(_code_kind(len(first))))


def discounts(n: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ of counts of counts n1..n4, kept inside what a count can give."""
    n = n.astype(float)
    if not n[0] or not n[1]:
        return np.array([0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else i / 2 for i in (1, 2, 3)]
    return np.clip(d, 0.1, [0.95, 1.95, 2.95])


def train(df: DataFrame, id_col: str, text_col: str, modulus: int, held: int, order: int = ORDER) -> dict:
    """Counts all rows outside the held fold; gives what a scorer needs besides the arrays in `folder`."""
    if order < 2:
        raise ValueError(f"order {order}; the model has contexts from order 2")
    spark = df.sparkSession
    folder = _local(new_path(spark, "lm"))
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    shards = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def batches_of(batches):
        for batch in batches:
            for part in _blocks(batch, 1):
                ids, texts = (part.column(c).to_pylist() for c in (0, 1))
                keep = [k for k, x in enumerate(ids) if not in_fold(x, modulus, held)]
                if keep:
                    yield _tokens(ids, [texts[k] for k in keep])

    def count_words(batches):
        counter = _Counter(shards, lambda key: key)
        for tokens, _ in batches_of(batches):
            yield from counter.add(tokens)
        yield from counter.close()

    def write_words(batches):
        for s, rows in _by_group(batches):
            key, count = _summed([_numbers(k, np.uint64) for k, _ in rows], [_numbers(c, np.uint32).astype(np.int64) for _, c in rows])
            _save(folder, f"words-{s}", key)
            _save(folder, f"counts-{s}", count)
            kind = _frequency(count)
            order, sizes = np.argsort(kind, kind="stable"), np.bincount(kind, minlength=64)
            rank = np.empty(len(key), np.uint32)
            rank[order] = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            _save(folder, f"ranks-{s}", rank)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([sizes.astype(np.int64).tobytes()], pa.binary()), pa.array([int(count.sum())], pa.int64())], names=["shard", "sizes", "tokens"])

    packed = "shard int, keys binary, counts binary"
    met = docs.mapInArrow(count_words, packed).repartition("shard").sortWithinPartitions("shard")
    with cleaned(spark):
        told = met.mapInArrow(write_words, "shard int, sizes binary, tokens long").collect()
    sizes = np.zeros((64, shards), np.int64)
    for r in told:
        sizes[:, r.shard] = np.frombuffer(r.sizes, np.int64)
    known, tokens = int(sizes.sum()), sum(r.tokens for r in told)
    offsets = (np.cumsum(sizes) - sizes.ravel()).reshape(sizes.shape)
    if known >= 2**32 - 2:
        raise ValueError(f"{known} words; n-grams of numbers hold 2^32 - 2")
    width = max(int(known + 1).bit_length(), 1)
    gram_shards, blocks = max(1, -(-tokens // GRAMS_A_SHARD)), known // WORDS_A_BLOCK + 1

    def count_grams(batches):
        words, held_, size = Words(folder, offsets, known), [], 0

        def close():
            _, grams, count = _met(*(np.concatenate(x, axis=1) for x in zip(*held_, strict=True)))
            return _sent(list(_dealt(grams, count, 0, gram_shards)))

        for token, at in batches_of(batches):
            grams = _grams(words.numbers(token)[0], at, known, order)
            _, grams, count = _met(grams, np.ones((1, grams.shape[1]), np.int64))
            held_.append((grams, count))
            size += grams.shape[1]
            if size > HELD:
                yield close()
                held_, size = [], 0
        if held_:
            yield close()

    def contexts(grams, value):
        """N-grams without their last word, with totals and numbers of continuations seen once, twice and more often."""
        return grams[:-1], np.stack([value, *(x.astype(np.int64) for x in (value == 1, value == 2, value >= 3))])

    def write_grams(level, batches):
        """Arrays of n-grams of `level` words; what they give to the level below, or to the sums of words."""
        for s, rows in _by_group(batches):
            if s < 0:
                yield _sent([(s, *r) for r in rows])
                continue
            ends, times = _undealt([r[1:] for r in rows if r[0] == 0], 1, level)
            if level == order:
                key, grams, values = _met(ends, times)
            else:
                before, sums_ = _undealt([r[1:] for r in rows if r[0] == 1], 4, level)
                values = np.zeros((5, ends.shape[1] + before.shape[1]), np.int64)
                values[0, : ends.shape[1]], values[1:, ends.shape[1] :] = times[0], sums_
                key, grams, values = _met(np.concatenate([ends, before], axis=1), values)
            _save_rows(folder, level, s, key, values, width)
            seen = np.flatnonzero(values[0])
            grams, count = grams[:, seen], values[0, seen]
            yield _sent([(-1, level, b"", np.array([(count == i).sum() for i in (1, 2, 3, 4)], np.int64).tobytes())])
            if level > 2:
                for part, value, kind in ((grams[1:], np.ones((1, len(count)), np.int64), 0), (*contexts(grams, count), 1)):
                    _, part, value = _met(part, value)
                    if len(value[0]):
                        yield _sent(list(_dealt(part, value, kind, gram_shards)))
                continue
            out = []
            kinds = [(0, grams[0], count)]
            kinds += [(i, grams[0][pick], np.ones(int(pick.sum()), np.int64)) for i, pick in ((1, count == 1), (2, count == 2), (3, count >= 3))]
            kinds.append((4, grams[1], np.ones(len(count), np.int64)))
            for kind, word, value in kinds:
                word, value = _summed([word], [value])
                turn = np.argsort(word % np.uint32(blocks), kind="stable")
                word, value = word[turn], value[turn]
                block = word % np.uint32(blocks)
                cut = [0, *(np.flatnonzero(np.diff(block)) + 1), len(word)]
                for i, j in zip(cut[:-1], cut[1:], strict=True):
                    if j > i:
                        out.append((int(block[i]), kind, _planes((word[i:j] // np.uint32(blocks)).astype(np.uint32)), _planes(value[i:j])))
            if out:
                yield _sent(out)

    def write_blocks(batches):
        for block, rows in _by_group(batches):
            if block < 0:
                for level in sorted({level for level, _, _ in rows}):
                    n = sum(np.frombuffer(v, np.int64) for x, _, v in rows if x == level)
                    yield pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([n.tobytes()], pa.binary()), pa.array([0], pa.int64())], names=["kind", "n", "total"])
                continue
            total = np.zeros((5, (known - block) // blocks + 1), np.int64)
            for kind, keys, values in rows:
                total[kind, _numbers(keys, np.uint32)] += _numbers(values, np.int64)
            _save(folder, f"sums-{block}", total)
            n = np.array([(total[4] == i).sum() for i in (1, 2, 3, 4)] + [(total[4] == 1).sum(), (total[4] == 2).sum(), (total[4] >= 3).sum()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([n.tobytes()], pa.binary()), pa.array([int(total[4].sum())], pa.int64())], names=["kind", "n", "total"])

    parts = docs.mapInArrow(count_grams, _PACKED_DDL)
    for level in range(order, 1, -1):
        parts = parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(lambda it, level=level: write_grams(level, it), _PACKED_DDL)
    with cleaned(spark):
        told = parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(write_blocks, "kind int, n binary, total long").collect()
    of = lambda kind, size: sum((np.frombuffer(r.n, np.int64) for r in told if r.kind == kind), np.zeros(size, np.int64))
    lower = of(1, 7)
    d_low = discounts(lower[:4])
    kinds = sum(r.total for r in told if r.kind == 1)
    return {"folder": folder, "offsets": offsets, "order": order, "gram_shards": gram_shards, "blocks": blocks, "width": width, "words": known, "tokens": tokens, "d": {k: discounts(of(k, 4)) for k in range(2, order + 1)}, "d_low": d_low, "pair_kinds": kinds, "spare": float((d_low * lower[4:]).sum() / kinds) if kinds else 1.0}


class Scorer:
    def __init__(self, model: dict):
        self.m, self.words, self.files = model, Words(model["folder"], model["offsets"], model["words"]), Arrays(model["folder"])

    def _sums(self, number: np.ndarray) -> np.ndarray:
        """Rows total, n1, n2, n3+, continuations of each word number; zeros for unknown ones."""
        out = np.zeros((5, len(number)), np.int64)
        block = number % self.m["blocks"]
        known = np.flatnonzero(number <= self.m["words"])
        for b in np.unique(block[known]):
            own = known[block[known] == b]
            raw = self.files.get(f"sums-{b}", np.int64)
            if len(raw):
                out[:, own] = raw.reshape(5, -1)[:, number[own] // self.m["blocks"]]
        return out

    def _rows(self, level: int, keys: np.ndarray) -> np.ndarray:
        """Rows times, and below the highest order total, n1, n2, n3+ as a context, of each n-gram; zeros for unknown ones."""
        keys, back = np.unique(keys, return_inverse=True)
        out = np.zeros((1 if level == self.m["order"] else 5, len(keys)), np.int64)
        for s, own, place, there in self.files.find(str(level), self.m["gram_shards"], keys, mix(keys), 0 if level > 2 else self.m["width"]):
            rows = self.files.get(f"rows{level}-{s}", np.int64).reshape(len(out), -1)
            code = self.files.get(f"codes{level}-{s}", _code_kind(rows.shape[1]))
            out[:, own[there]] = rows[:, code[place[there]]]
        return out[:, back]

    def scores(self, texts: list) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base score and score of each text."""
        m = self.m
        token, at = _tokens([], texts)
        number, count = self.words.numbers(token)
        base = np.log10((count + 1) / (m["tokens"] + m["words"] + 1))
        grams = _grams(number, at, m["words"], m["order"])
        of_word, w = np.unique(number, return_inverse=True)
        of_context, c = np.unique(grams[-2].astype(np.int64), return_inverse=True)
        follows = self._sums(of_word)[4]
        d_low = np.concatenate([[0], m["d_low"]])
        p = ((follows - d_low[np.minimum(follows, 3)]) / max(m["pair_kinds"], 1) + m["spare"] / (m["words"] + 1))[w]
        before = self._sums(of_context)[:4, c]
        for level in range(2, m["order"] + 1):
            own = _key(grams[-level:])
            if level < m["order"]:
                own = np.concatenate([own, _key(grams[-level - 1 : -1])])
            found = self._rows(level, own)
            times, (total, n1, n2, n3), d = found[0, : len(p)], before, np.concatenate([[0], m["d"][level]])
            safe = np.maximum(total, 1)
            back_off = np.where(total > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / safe, 1.0)
            p = (times - d[np.minimum(times, 3)]) / safe + back_off * p
            before = found[1:, len(p) :]
        score = np.log10(p)
        add = lambda x: np.add.reduceat(x, at[:-1]) if len(at) > 1 else np.empty(0)
        return np.diff(at), add((count > 0).astype(np.int64)), add(base), add(score)


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2, order: int = ORDER) -> DataFrame:
    """One row for each row of df: identifier, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    tune(df.sparkSession)
    model = train(df, id_col, text_col, modulus, held, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in _blocks(batch, 1):
                ids = part.column(0).to_pylist()
                n, known, base, score = scorer.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([in_fold(x, modulus, held) for x in ids]), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([model["tokens"]] * len(ids), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("doc_id", id_col)


def op6_kneser_ney(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
