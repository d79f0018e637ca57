"""I-Match fingerprints over several randomised lexicons.

Document frequencies are counted over distinct texts: texts whose hash comes
once, told from a bitmap of fixed size, are counted where they are read, the
others meet first, one of each text and task. Frequencies are those of single
terms (64-bit hashes), which meet in shards; the lexicon is a bitmap of 2^26
slots, 8 MB whatever the corpus: a term is in it if a term of its slot lies in
the band, so a shared slot lets a term in and never keeps one out. A document
keeps its distinct terms inside the band, sorted; of every randomised lexicon
subset it hashes the terms that the subset holds. Subsets come in LEVELS sizes
(each half of the one before) of DRAWS random draws; the first entry is the
whole lexicon, the classic fingerprint. Likeness is the share of equal subset
hashes at the level that shows most of it, among subsets that hold a term of
either document, with four of them at least; else over all levels.

Defined results: equal texts have equal fingerprints (also of likeness 1); a
text of whose terms the band holds less than one in FLOOR (one of many near
copies, whose words are all frequent, or none at all) uses all of its terms;
likeness is taken under the rule of the document itself, for its edited text and
for the next document too; null and empty texts have the empty fingerprint,
alike to itself only.

`edited_fingerprints` pairs each document with the next in descending order of
identifier without a global window: splits of the identifier range deal rows to
buckets, and the greatest row of each bucket is also dealt to the one before.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteatlas.llm.kneser_ney import _by_group, _Counter, _numbers, _summed
from siteatlas.llm.storage import table, tune
from siteatlas.llm.textops import mix, word_hashes

SLOT_BITS, SHARDS = 26, 64
LEVELS, DRAWS, FIRST_LEVEL = 12, 16, 2
MIN_DF, MAX_DF_SHARE, FLOOR = 2, 0.05, 4
COPY_BITS, COPY_BLOCK_BITS = 26, 16
_DIGITS = 4


def _copies(df: DataFrame, text_col: str) -> tuple[bytes, int]:
    """The compressed bitmap of hashes that come more than once, 2^COPY_BITS bits at any size of corpus, and the number of distinct hashes."""
    met = df.select(F.xxhash64(text_col).alias("h")).groupBy("h").count()
    slot = F.shiftrightunsigned("h", 64 - COPY_BITS)
    at = F.when(F.col("count") > 1, slot.bitwiseAND((1 << COPY_BLOCK_BITS) - 1).cast("int"))
    blocks = met.groupBy(F.shiftright(slot, COPY_BLOCK_BITS).cast("int").alias("block")).agg(F.collect_set(at).alias("again"), F.count("*").alias("n"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for again in batch.column(1):
                full = np.zeros(1 << COPY_BLOCK_BITS, dtype=bool)
                full[again.values.to_numpy()] = True
                bits.append(zlib.compress(np.packbits(full, bitorder="little").tobytes(), 1) if len(again) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary()), batch.column(2)], names=["block", "bits", "n"])

    out, width, n = bytearray(1 << (COPY_BITS - 3)), 1 << (COPY_BLOCK_BITS - 3), 0
    for r in blocks.mapInArrow(pack, "block int, bits binary, n long").collect():
        n += r.n
        if r.bits:
            out[r.block * width : (r.block + 1) * width] = zlib.decompress(r.bits)
    return zlib.compress(bytes(out), 1), n


_COUNTED = "shard int, key long, data binary, counts binary"


def _rows(shards, keys, data, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(keys, pa.int64()), pa.array(data, pa.binary()), pa.array(counts, pa.binary())], names=["shard", "key", "data", "counts"])


def _terms(raw: list[bytes]) -> np.ndarray:
    """Hashes of each text's distinct words, text by text."""
    words, at = word_hashes(raw)
    doc = np.repeat(np.arange(len(raw)), np.diff(at))
    order = np.lexsort((words, doc))
    words, doc = words[order], doc[order]
    return words[np.concatenate([[True], (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])])] if len(words) else words


def _told(counted: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A counter's shards as rows; the key only spreads them."""
    for batch in counted:
        shards, data, counts = (batch.column(i).to_pylist() for i in range(3))
        yield _rows(shards, [zlib.crc32(x) for x in data], data, counts)


def _count_single(batches: Iterator[pa.RecordBatch], copies: bytes) -> Iterator[pa.RecordBatch]:
    """Of one task's (text, hash): term counts of texts that come once, and one of each other text as shard -1."""
    bits, found, seen = np.frombuffer(zlib.decompress(copies), dtype=np.uint8), _Counter(SHARDS, lambda key: key), set()
    for batch in batches:
        slots = (batch.column(1).to_numpy().view(np.uint64) >> np.uint64(64 - COPY_BITS)).astype(np.int64)
        again = (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
        for i in range(0, batch.num_rows, 200):
            raw = [(x or "").encode() for x in batch.column(0).slice(i, 200).to_pylist()]
            yield from _told(found.add(_terms([x for x, a in zip(raw, again[i : i + 200], strict=True) if not a])))
            new = {}
            for x, a in zip(raw, again[i : i + 200], strict=True):
                if a and (digest := hashlib.blake2b(x, digest_size=16).digest()) not in seen:
                    seen.add(digest)
                    new[digest] = x
            if new:
                yield _rows([-1] * len(new), [int.from_bytes(k[:8], "little", signed=True) for k in new], [zlib.compress(x, 1) for x in new.values()], [None] * len(new))
    yield from _told(found.close())


def _count_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By (shard, key, data): term counts of the distinct texts of shard -1 besides the counts that are there."""
    found, last = _Counter(SHARDS, lambda key: key), None
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            rows, texts = list(zip(*(batch.column(c).slice(i, 200).to_pylist() for c in range(4)), strict=True)), []
            for shard, _, data, _ in rows:
                if shard < 0 and data != last:
                    texts.append(zlib.decompress(data))
                    last = data
            yield from _told(found.add(_terms(texts)))
            if counts := [r for r in rows if r[0] >= 0]:
                yield _rows(*zip(*counts, strict=True))
    yield from _told(found.close())


def lexicon(df: DataFrame, text_col: str = "text", min_df: int = MIN_DF, max_share: float = MAX_DF_SHARE) -> bytes:
    """The bitmap of slots that hold a term inside the band: 2^SLOT_BITS / 8 bytes at any size of corpus."""
    texts = df.select(F.coalesce(df[text_col], F.lit("")).alias("text"))
    copies, n = _copies(texts, "text")
    single = texts.select("text", F.xxhash64("text").alias("h")).mapInArrow(lambda it: _count_single(it, copies), _COUNTED)
    counted = single.repartition("shard", "key").sortWithinPartitions("shard", "key", "data").mapInArrow(_count_copies, _COUNTED).select("shard", "data", "counts")
    most = max(min_df, int(n * max_share))
    width = (1 << SLOT_BITS) // SHARDS

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, rows in _by_group(batches):
            term, n = _summed([_numbers(k, np.uint64) for k, _ in rows], [_numbers(c, np.uint32).astype(np.int64) for _, c in rows])
            flags = np.zeros(width, dtype=np.uint8)
            flags[(term[(n >= min_df) & (n <= most)] >> np.uint64(64 - SLOT_BITS)).astype(np.int64) - s * width] = 1
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["shard", "bits"])

    bits = bytearray(1 << (SLOT_BITS - 3))
    for r in counted.repartition("shard").sortWithinPartitions("shard").mapInArrow(band, "shard int, bits binary").toLocalIterator():
        bits[r.shard * width // 8 : (r.shard + 1) * width // 8] = r.bits
    return bytes(bits)


def fingerprints(texts: list[str], bits: np.ndarray, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the whole lexicon and of each subset for each text, 0 where a subset holds none of its terms; which texts use all of their terms, if whole doesn't say it."""
    out = np.zeros((len(texts), 1 + LEVELS * DRAWS), dtype=np.uint64)
    words, at = word_hashes([t.encode() for t in texts])
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(at))
    order = np.lexsort((words, doc))
    words, doc = words[order], doc[order]
    first = np.ones(len(words), dtype=bool)
    first[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    words, doc = words[first], doc[first]
    slot = (words >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    inside = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
    held = np.bincount(doc[inside], minlength=len(texts))
    if whole is None:
        whole = FLOOR * held < np.bincount(doc, minlength=len(texts))
    use = inside | (whole | (held == 0))[doc]
    words, doc = words[use], doc[use]

    def put(column: int, w: np.ndarray, d: np.ndarray) -> None:
        if len(w):
            begin = np.flatnonzero(np.diff(d, prepend=-1))
            out[d[begin], column] = np.add.reduceat(mix(w), begin) | np.uint64(1)

    put(0, words, doc)
    for draw in range(DRAWS):
        luck, w, d = mix(words ^ mix(np.array([draw + 1], dtype=np.uint64))), words, doc
        for level in range(LEVELS):
            keep = luck < np.uint64(1 << (64 - FIRST_LEVEL - level))
            luck, w, d = luck[keep], w[keep], d[keep]
            put(1 + level * DRAWS + draw, w, d)
    return out, whole


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, 0 to 1."""
    same, held = (a == b) & (a != 0), (a != 0) | (b != 0)
    by = lambda x: x[:, 1:].reshape(len(x), LEVELS, DRAWS).sum(axis=2)
    level = np.where(by(held) >= 4, by(same) / np.maximum(by(held), 1), 0).max(axis=1)
    whole = same.sum(axis=1) / np.maximum(held.sum(axis=1), 1)
    return np.where((a == b).all(axis=1), 1.0, np.maximum(level, whole))


def written(prints: np.ndarray) -> list[str]:
    """The classic fingerprint in 16 hexadecimal digits and 4 for each subset, - where it is empty."""
    low = (mix(prints[:, 1:]) >> np.uint64(48)).astype(">u2")
    empty = prints[:, 1:] == 0
    text = [low[i].tobytes().hex() for i in range(len(prints))]
    return [f"{int(p):016x}" + "".join("-" * _DIGITS if e else t[_DIGITS * j : _DIGITS * j + _DIGITS] for j, e in enumerate(es)) for p, t, es in zip(prints[:, 0], text, empty, strict=True)]


def _edits(batches: Iterator[pa.RecordBatch], bitmap) -> Iterator[pa.RecordBatch]:
    """Rows by (bucket, tail, identifier and text descending)."""
    bits = np.frombuffer(bitmap.value, dtype=np.uint8)
    held: list[tuple] = []

    def told(rows: list[tuple]):
        """Results for rows whose successor is the next of rows."""
        texts, pairs, edited = [r[2] for r in rows], [], []
        for i, (bucket, tail, text, _) in enumerate(rows):
            if not tail and i + 1 < len(rows) and rows[i + 1][0] == bucket:
                k = len(text) // 3
                pairs.append(i)
                edited.append(text[: len(text) - k] + texts[i + 1][:k])
        if not pairs:
            return None
        at = np.array(pairs)
        own, whole = fingerprints(texts, bits)
        new, _ = fingerprints(edited, bits, whole[at])
        mine, after = own[at], own[at + 1]
        if len(other := np.flatnonzero(whole[at] != whole[at + 1])):
            after[other], _ = fingerprints([texts[i + 1] for i in at[other]], bits, whole[at][other])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][3] for i in pairs], pa.int64()),
                pa.array([len(texts[i]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                pa.array(written(mine)),
                pa.array(written(new)),
                pa.array(likeness(mine, new)),
                pa.array(likeness(mine, after)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for batch in batches:
        for start in range(0, batch.num_rows, 100):
            held += zip(*(batch.column(i).slice(start, 100).to_pylist() for i in range(4)), strict=True)
            if (out := told(held)) is not None:
                yield out
            held = held[-1:]


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df, with its fingerprint, its edited text's and their likeness. Null identifiers come last, equal ones by text."""
    spark = df.sparkSession
    tune(spark)
    bitmap = spark.sparkContext.broadcast(lexicon(df, text_col))
    docs = df.select(df[id_col].cast("long").alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    key = F.coalesce("id", F.lit(-(1 << 63)))
    parts = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(x) for x in docs.select(key.cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts)})
    bucket = lambda: F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda c: c > key)), F.lit(0)) if cuts else F.lit(0)
    ends = sorted((r.bucket, r.greatest) for r in docs.select(bucket().alias("bucket"), key.alias("k")).groupBy("bucket").agg(F.max("k").alias("greatest")).collect())
    names, tails = [b for b, _ in ends], {}
    for i, (_, greatest) in enumerate(ends):
        tails[greatest] = names[i - 1]  # the first one's greatest row follows the last bucket
    before = F.create_map(*(F.lit(x).cast("long" if i % 2 == 0 else "int") for pair in tails.items() for i, x in enumerate(pair))) if tails else F.create_map()
    tail = F.try_element_at(before, key) if tails else F.lit(None).cast("int")
    none = F.lit(None).cast("struct<bucket:int,tail:boolean>")
    where = F.array_compact(F.array(F.struct(bucket().cast("int").alias("bucket"), F.lit(False).alias("tail")), F.when(tail.isNotNull(), F.struct(tail.alias("bucket"), F.lit(True).alias("tail"))).otherwise(none)))
    dealt = docs.select("id", "text", F.explode(where).alias("at")).select("at.bucket", "at.tail", "text", "id")
    order = dealt.repartition("bucket").sortWithinPartitions("bucket", "tail", F.desc_nulls_last("id"), F.desc("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return order.mapInArrow(lambda it: _edits(it, bitmap), schema).withColumnRenamed("doc_id", id_col)


def op4_imatch(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
