"""Best-fit packing of tokenised documents by linear grouping.

Documents become pieces of at most `capacity` tokens. Only the histogram of
piece lengths (at most `capacity` numbers) comes to the driver, where the plan
is made: lengths over the small limit are sorted and cut into groups of equal
cardinality, each length rounded up to its group's greatest; configurations of
these few sizes are chosen by a knapsack that always holds the greatest size
left and repeated until one of their sizes runs out; documents' own lengths are
put in the places of their groups, and the room that rounding leaves, like all
other room, takes the small lengths by best fit, longest first.

The plan says for each length which ranks go to which sequences, as runs of
equal sequences; its size depends on capacity and groups, not on the corpus.
Pieces get their rank among equal lengths from counts of each task and
length, so no sort or window holds all rows of a length.

Defined results: a null or empty text is the one token `end_id`; repeated rows
are packed as often as they come; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.llm.storage import durable, table, tune

CAPACITY, END_ID, GROUPS, SMALL = 2048, 0, (8, 64, 256), 1 / 3
CACHED_WORDS = 1_000_000
#: A special token of the vocabulary: texts around it are encoded apart.
MARK = "<|endoftext|>"


#: Python splits at these four, the vocabulary's white space doesn't hold them.
_CONTROL = re.compile("[\x1c-\x1f]")
_WIDE = re.compile("[^\x00-\xff]")
_WORD = re.compile(r"(?:[\x1c-\x1f]|\S)+")
# The vocabulary's splitter, and what its classes hold of the lower-case characters up to 255.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CLASSES = {r"\p{L}": r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"\p{N}": r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": r"\t-\r \x85\xa0"}
LAST = "</w>"


def _narrow(splitter: str) -> re.Pattern:
    for name, held in _CLASSES.items():
        splitter = splitter.replace(name, held)
    return re.compile(splitter)


class Encoder:
    """ids of texts with a cache: of the splitter's own parts where a text's characters are below 256, else of words, which the splitter never joins."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.mark = self.tokenizer.token_to_id(MARK)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(LAST)]] = True
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)["pre_tokenizer"].get("pretokenizers", [])
        known = steps and steps[0].get("pattern") == {"Regex": SPLITTER} and self.tokenizer.model.end_of_word_suffix == LAST
        self.part = _narrow(SPLITTER) if known else None

    def _learn_parts(self, parts: list[str]) -> None:
        """Parts in one call; a part ends where a token does that ends words."""
        raw = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (4 * np.flatnonzero(self.last[raw]) + 4).tolist()
        if len(ends) != len(parts):
            raise ValueError("the vocabulary splits a part in two")
        raw = raw.tobytes()
        for part, i, j in zip(parts, [0, *ends], ends, strict=False):
            self.known[part] = raw[i:j]

    def _learn(self, words: list[str]) -> None:
        """Words in one call, kept apart by a special token; one by one where a word holds that token itself."""
        ids = np.array(self.tokenizer.encode(MARK.join(words), add_special_tokens=False).ids, dtype="<u4")
        cuts = np.flatnonzero(ids == self.mark)
        if len(cuts) != len(words) - 1:
            for w in words:
                self.known[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()
            return
        raw = ids.tobytes()
        for w, i, j in zip(words, [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(raw)], strict=True):
            self.known[w] = raw[i:j]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        narrow = [bool(self.part) and "<|" not in t and (t.isascii() or not _WIDE.search(t)) for t in texts]
        words = [self.part.findall(t.lower()) if short else _WORD.findall(t) if _CONTROL.search(t) else t.split() for t, short in zip(texts, narrow, strict=True)]
        new = list(set().union(*(ws for ws, short in zip(words, narrow, strict=True) if short)).difference(self.known))
        for i in range(0, len(new), 5000):
            self._learn_parts(new[i : i + 5000])
        new = list(set().union(*(ws for ws, short in zip(words, narrow, strict=True) if not short)).difference(self.known))
        for i in range(0, len(new), 500):
            self._learn(new[i : i + 500])
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in words]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """A worker's encoder: later tasks find the cache of earlier ones."""
    return Encoder(path)


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("place", pa.int64())])


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, encoder = TaskContext.get().partitionId(), _encoder(path)
    seen = [0] * (capacity + 1)
    end = np.array([end_id], dtype="<u4").tobytes()
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            ids, texts = batch.column(0).slice(at, 100).to_pylist(), batch.column(1).slice(at, 100).to_pylist()
            rows = []
            for doc, raw in zip(ids, encoder.ids([t or "" for t in texts]), strict=True):
                raw = memoryview(raw + end)
                for piece, start in enumerate(range(0, len(raw) // 4, capacity)):
                    part = raw[4 * start : 4 * (start + capacity)]
                    n = len(part) // 4
                    rows.append((doc, piece, start, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)


def _grouped(lengths: list[tuple[int, int]], groups: int) -> list[deque]:
    """Runs (length, count), longest first, cut into groups of equal cardinality."""
    total = sum(n for _, n in lengths)
    out, run, left = [], deque(), -(-total // groups)
    for length, n in lengths:
        while n:
            take = min(n, left)
            run.append([length, take])
            n, left = n - take, left - take
            if not left:
                out.append(run)
                run, left = deque(), -(-total // groups)
    return [*out, run] if run else out


def _configuration(sizes: list[int], counts: list[int], capacity: int) -> list[int]:
    """How often each size is used: the greatest size left once at least, and with it as full as can be."""
    first = next(i for i, n in enumerate(counts) if n)
    room = capacity - sizes[first]
    best: list[tuple | None] = [None] * (room + 1)
    best[0] = ()
    for i in range(first, len(sizes)):
        size = sizes[i]
        most = min(counts[i] - (i == first), room // size)
        if most <= 0:
            continue
        for at in range(room, -1, -1):
            if best[at] is None:
                continue
            for k in range(1, most + 1):
                if at + k * size > room:
                    break
                if best[at + k * size] is None:
                    best[at + k * size] = (*best[at], (i, k))
    use = [0] * len(sizes)
    use[first] = 1
    for i, k in next(x for x in reversed(best) if x is not None):
        use[i] += k
    return use


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> list[tuple[int, list[tuple[int, int]]]]:
    """Of the plans with so many groups, the one with the fewest sequences."""
    return min((plan_packing(histogram, capacity, g) for g in groups), key=lambda plan: sum(times for times, _ in plan))


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS[0], small: float = SMALL) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs (sequences, [(length, times)]) that hold all pieces of the histogram."""
    large = sorted(((x, n) for x, n in histogram.items() if n and x > small * capacity), reverse=True)
    grouped = _grouped(large, groups)
    sizes, counts = [g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped]
    room: list[list] = [[] for _ in range(capacity + 1)]
    while any(counts):
        use = _configuration(sizes, counts, capacity)
        times = min(c // u for c, u in zip(counts, use, strict=True) if u)
        counts = [c - times * u for c, u in zip(counts, use, strict=True)]
        parts = [(g, u) for g, u in zip(grouped, use, strict=True) if u]
        while times:
            same = min(times, *(max(1, g[0][1] // u) for g, u in parts))
            if any(g[0][1] < u for g, u in parts):
                same = 1
            held: dict[int, int] = {}
            for g, u in parts:
                need = u * same
                while need:
                    take = min(need, g[0][1])
                    held[g[0][0]] = held.get(g[0][0], 0) + (take if same == 1 else take // same)
                    g[0][1] -= take
                    need -= take
                    if not g[0][1]:
                        g.popleft()
            room[capacity - sum(x * n for x, n in held.items())].append((same, list(held.items())))
            times -= same
    for length, n in sorted(((x, n) for x, n in histogram.items() if n and x <= small * capacity), reverse=True):
        at = length
        while n:
            while at <= capacity and not room[at]:
                at += 1
            if at > capacity:
                fit = min(n, capacity // length)
                room[capacity - fit * length].append((n // fit, [(length, fit)]))
                if n % fit:
                    room[capacity - n % fit * length].append((1, [(length, n % fit)]))
                break
            times, held = room[at].pop()
            fit = at // length
            whole = min(times, n // fit)
            if whole:
                room[at - fit * length].append((whole, [*held, (length, fit)]))
                n -= whole * fit
            times -= whole
            if times and n and n < fit:
                room[at - n * length].append((1, [*held, (length, n)]))
                times, n = times - 1, 0
            if times:
                room[at].append((times, held))
    return [run for at in room for run in at]


def _places(plan: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> dict[int, np.ndarray]:
    """For each length rows (first rank, times in a sequence, first sequence, offset), by rank."""
    rows: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for times, held in plan:
        offset = 0
        for length, n in held:
            rank = ranks.get(length, 0)
            rows.setdefault(length, []).append((rank, n, sequence, offset))
            ranks[length] = rank + times * n
            offset += n * length
        sequence += times
    return {length: np.array(x, dtype=np.int64) for length, x in rows.items()}


def pack_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """One row for each piece: identifier, piece, start, length, ids_crc32, sequence_id, offset."""
    tune(df.sparkSession)
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"
    cut = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(lambda it: _cut(it, vocabulary, capacity, end_id), kinds)
    pieces = durable(cut, "pieces")
    counted = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(best_plan(histogram, capacity, groups), capacity)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(counted.select("length", "task", before.alias("before")), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(own):
                    n = int(length[own[0]])
                    runs = places[n]
                    run = runs[np.searchsorted(runs[:, 0], rank[own], side="right") - 1]
                    within = rank[own] - run[:, 0]
                    sequence[own] = run[:, 2] + within // run[:, 1]
                    offset[own] = run[:, 3] + within % run[:, 1] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = ranked.mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", id_col)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())
