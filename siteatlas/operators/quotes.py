"""Which texts hold which quotes, by the rarest gram of each quote.

A gram is the number that eight neighbouring bytes make. How often each gram of
the quotes comes in the texts is counted; a quote is then looked for only where
its rarest gram stands, and compared byte by byte there. Both passes read a text
once, in time proportional to its length, and don't depend on how many quotes
there are. Quotes whose rarest gram comes nowhere are in no text. A quote
of fewer than eight bytes is a gram of its own length.

Up to BROADCAST bytes, different quotes go to every task and texts don't move.
Beyond it a filter of fixed size tells which places of the texts may be a gram
of a quote, and grams, candidates and texts meet in joins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM, BROADCAST, PLACES = 8, 32 << 20, 1 << 20
#: Slots of the filter of grams in tasks, and (as powers of two) of the one for joins and of its parts.
_NEAR_BITS, FILTER_BITS, _PART_BITS = 22, 26, 16
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def grams(raw: bytes, begin: int, end: int, size: int) -> np.ndarray:
    """The grams of `size` bytes that begin at begin..end-1; raw has GRAM - 1 more bytes at its end."""
    out = np.ndarray((max(end - begin, 0),), "<u8", raw, begin, (1,)) if end > begin else np.zeros(0, "<u8")
    return out & np.uint64((1 << 8 * size) - 1) if size < GRAM else out.copy()


def _slots(x: np.ndarray, size: int, bits: int) -> np.ndarray:
    return ((x + np.uint64(size)) * _SPREAD >> np.uint64(64 - bits)).astype(np.int64)


class Wanted:
    """Grams of one size that are looked for."""

    def __init__(self, values: np.ndarray, size: int):
        self.values, self.size = np.unique(values), size
        self.near = np.zeros(1 << _NEAR_BITS, dtype=bool)
        self.near[_slots(self.values, size, _NEAR_BITS)] = True

    def found(self, raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in raw (with its added bytes) and the number of the gram there."""
        last = len(raw) - (GRAM - 1) - self.size + 1
        for begin in range(0, last, PLACES):
            here = grams(raw, begin, min(begin + PLACES, last), self.size)
            at = np.flatnonzero(self.near[_slots(here, self.size, _NEAR_BITS)])
            number = np.searchsorted(self.values, here[at])
            same = self.values[np.minimum(number, len(self.values) - 1)] == here[at]
            yield at[same] + begin, number[same]


def _blocks(batch: pa.RecordBatch, text: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Rows whose text is there, about PLACES bytes at a time."""
    rows, texts, size = [], [], 0
    for i, x in enumerate(batch.column(text).to_pylist()):
        if x is not None:
            rows.append(i)
            texts.append(x)
            size += len(x)
            if size > PLACES:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Texts one behind the other, and where each ends."""
    return b"".join(texts) + bytes(GRAM - 1), np.cumsum([len(t) for t in texts])


class Quotes:
    """Different quotes with the gram by which each one is found."""

    def __init__(self, quotes: list[bytes], counts: dict[int, int]):
        self.quotes, self.whole = quotes, [i for i, q in enumerate(quotes) if not q]
        keys: dict[int, list[tuple[int, int, int]]] = {}
        for i, q in enumerate(quotes):
            if 0 < len(q) < GRAM:
                keys.setdefault(len(q), []).append((int(grams(q + bytes(GRAM - 1), 0, 1, len(q))[0]), i, 0))
            elif q:
                own = grams(q + bytes(GRAM - 1), 0, len(q) - GRAM + 1, GRAM).tolist()
                at = min(range(len(own)), key=lambda j: (counts.get(own[j], 0), j))  # noqa: B023
                if counts.get(own[at], 0):
                    keys.setdefault(GRAM, []).append((own[at], i, at))
        self.wanted = [Wanted(np.array([k for k, _, _ in rows], "<u8"), size) for size, rows in sorted(keys.items())]
        self.by = []
        for w in self.wanted:
            held: list[list[tuple[int, int]]] = [[] for _ in w.values]
            for k, i, at in keys[w.size]:
                held[int(np.searchsorted(w.values, np.uint64(k)))].append((i, at))
            self.by.append(held)

    def matches(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(text, quote) in order of the texts."""
        raw, ends = _joined(texts)
        out = {(t, i) for t in range(len(texts)) for i in self.whole}
        for w, held in zip(self.wanted, self.by, strict=True):
            for places, numbers in w.found(raw):
                in_text = np.searchsorted(ends, places, side="right")
                for p, k, t in zip(places.tolist(), numbers.tolist(), in_text.tolist(), strict=True):
                    begin = int(ends[t - 1]) if t else 0
                    for i, at in held[k]:
                        q = self.quotes[i]
                        if p - at >= begin and p - at + len(q) <= ends[t] and (t, i) not in out and raw[p - at : p - at + len(q)] == q:
                            out.add((t, i))
        return sorted(out)


def all_grams(quotes: list[bytes]) -> np.ndarray:
    """The different grams of the quotes that have any."""
    own = [grams(q + bytes(GRAM - 1), 0, len(q) - GRAM + 1, GRAM) for q in quotes if len(q) >= GRAM]
    return np.unique(np.concatenate(own)) if own else np.zeros(0, "<u8")


def _told(values: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values.astype("<u8").view("<i8"), pa.int64()), pa.array(n, pa.int64())], names=["gram", "n"])


def _near_texts(quotes: list[bytes], documents: DataFrame, doc_id: str) -> DataFrame:
    """Quotes go to the tasks: (number of the quote, doc_id)."""
    sc, kind = documents.sparkSession.sparkContext, documents.select(doc_id).schema[0].dataType
    sent = sc.broadcast(quotes)
    texts = documents.select(doc_id, F.col("text").cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = all_grams(sent.value)
        if not len(values):
            return
        wanted, n = Wanted(values, GRAM), np.zeros(len(values), np.int64)
        for batch in batches:
            for _, block in _blocks(batch, 0):
                for _, number in wanted.found(_joined(block)[0]):
                    n += np.bincount(number, minlength=len(n))
        yield _told(values[n > 0], n[n > 0])

    counted = texts.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    known = sc.broadcast({r.gram & ((1 << 64) - 1): r.n for r in counted.collect()})  # as many as the quotes have bytes at most

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Quotes(sent.value, known.value)
        for batch in batches:
            for rows, block in _blocks(batch, 1):
                if pairs := index.matches(block):
                    yield pa.RecordBatch.from_arrays([pa.array([i for _, i in pairs], pa.int64()), batch.column(0).take(pa.array([rows[t] for t, _ in pairs]))], names=["_quote", doc_id])

    return texts.mapInArrow(find, T.StructType([T.StructField("_quote", T.LongType()), T.StructField(doc_id, kind)]))


def _filter(values: DataFrame, bits: int) -> bytes:
    """A compressed bitmap of the grams' slots: 2^bits bits whatever their number. values: gram, size."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, size = batch.column(0).to_numpy().view("<u8"), batch.column(1).to_numpy()
            slot = np.unique(np.concatenate([np.zeros(0, np.int64), *(_slots(gram[size == s], int(s), bits) for s in np.unique(size))]))
            yield pa.RecordBatch.from_arrays([pa.array(slot >> _PART_BITS, pa.int64()), pa.array(slot & ((1 << _PART_BITS) - 1), pa.int64())], names=["part", "slot"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for slots in batch.column(1):
                full = np.zeros(1 << _PART_BITS, dtype=bool)
                full[slots.values.to_numpy()] = True
                rows.append(zlib.compress(np.packbits(full, bitorder="little").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["part", "bits"])

    parts = values.mapInArrow(place, "part long, slot long").groupBy("part").agg(F.collect_set("slot").alias("slots"))
    out, width = bytearray(1 << (bits - 3)), 1 << (_PART_BITS - 3)
    for r in parts.mapInArrow(pack, "part long, bits binary").toLocalIterator():
        out[r.part * width : (r.part + 1) * width] = zlib.decompress(r.bits)
    return zlib.compress(bytes(out), 1)


def _far_texts(quotes: DataFrame, documents: DataFrame, doc_id: str, bits: int) -> DataFrame:
    """Grams and candidates meet in joins: (quote, doc_id). quotes: different quotes that are not empty."""
    sc, kind = documents.sparkSession.sparkContext, documents.select(doc_id).schema[0].dataType
    texts = documents.select(doc_id, F.col("text").cast("binary").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q in batch.column(0).to_pylist():
                raw, size = q.encode(), min(len(q.encode()), GRAM)
                own = grams(raw + bytes(GRAM - 1), 0, len(raw) - size + 1, size)
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(own)), pa.array(own.view("<i8"), pa.int64()), pa.array([size] * len(own), pa.int32())], names=["quote", "gram", "size"])

    own = quotes.mapInArrow(cut, "quote string, gram long, size int")

    def placed(bitmap: bytes, sizes: list[int], each: bool):
        """Grams of the texts that pass the filter: counts of a task, or one of each text."""
        sent = sc.broadcast(bitmap)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            full = np.unpackbits(np.frombuffer(zlib.decompress(sent.value), np.uint8), bitorder="little").view(bool)
            for batch in batches:
                for rows, block in _blocks(batch, 1):
                    raw, ends = _joined(block)
                    for size in sizes:
                        for begin in range(0, max(len(raw) - GRAM + 2 - size, 0), PLACES):
                            here = grams(raw, begin, min(begin + PLACES, len(raw) - GRAM + 2 - size), size)
                            at = np.flatnonzero(full[_slots(here, size, bits)])
                            gram, text = here[at].view("<i8"), np.searchsorted(ends, at + begin, side="right")
                            order = np.lexsort((gram, text)) if each else np.argsort(gram, kind="stable")
                            gram, text = gram[order], text[order]
                            first = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (each & (text[1:] != text[:-1])))[: len(gram)])
                            known = batch.column(0).take(pa.array([rows[t] for t in text[first].tolist()], pa.int64())) if each else pa.nulls(len(first), batch.column(0).type)
                            yield pa.RecordBatch.from_arrays([pa.array(gram[first]), pa.array([size] * len(first), pa.int32()), pa.array(np.diff(first, append=len(gram)), pa.int64()), known], names=["gram", "size", "n", doc_id])

        return texts.mapInArrow(run, T.StructType([T.StructField("gram", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField(doc_id, kind)]))

    sizes = sorted(r.size for r in own.select("size").distinct().collect())  # GRAM at most
    counted = placed(_filter(own.select("gram", "size"), bits), sizes, False).groupBy("gram", "size").agg(F.sum("n").alias("n"))
    rarest = F.row_number().over(Window.partitionBy("quote").orderBy("n", "gram"))
    keys = own.distinct().join(counted, ["gram", "size"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("_k", rarest).where("_k = 1 and n > 0").select("quote", "gram", "size")
    met = placed(_filter(keys.select("gram", "size"), bits), sizes, True).select("gram", "size", doc_id).distinct().join(keys, ["gram", "size"])
    return met.select("quote", doc_id).distinct().join(documents.select(doc_id, "text"), doc_id).where(F.contains("text", F.col("quote"))).select("quote", doc_id).distinct()


def matched_quotes(quotes: DataFrame, documents: DataFrame, quote_id: str, doc_id: str, broadcast: int = BROADCAST, filter_bits: int = FILTER_BITS) -> DataFrame:
    """quotes: quote_id, quote; documents: doc_id, text. One row for each pair whose text holds the quote as it stands. An empty quote is in every text, a null one in none."""
    asked = quotes.select(quote_id, "quote").where("quote is not null")
    different = asked.select("quote").distinct()
    size = different.agg(F.sum(F.octet_length("quote") + 64)).first()[0] or 0
    if size <= broadcast:
        texts = sorted(r.quote for r in different.collect())  # `broadcast` bytes at most
        spark = documents.sparkSession
        numbers = spark.createDataFrame(list(enumerate(texts)), "_quote long, quote string")
        found = _near_texts([q.encode() for q in texts], documents, doc_id).join(numbers, "_quote").select("quote", doc_id).distinct()
    else:
        found = _far_texts(different.where("quote <> ''"), documents, doc_id, filter_bits)
        found = found.unionByName(documents.where("text is not null").select(F.lit("").alias("quote"), doc_id).distinct().join(different, "quote", "left_semi"))
    return asked.join(found, "quote").select(quote_id, doc_id)
