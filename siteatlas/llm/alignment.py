"""Cross-tokenizer alignment with a dictionary of groups.

Tokenizers A and B cut the same bytes; where both end a token, a group ends. A
group is the ids of its tokens, and so its links (pairs of an A and a B token
whose bytes overlap) are the same wherever it occurs. Each task encodes texts in
blocks and interns the groups of a block: a row for each distinct group with its
number of occurrences, and a row for each document with its groups as numbers
of the block. Over the corpus distinct groups meet once; each expands its links
once, times its occurrences, to count id pairs; what the counts say of a group
goes back to the blocks that hold it by the group's key, and each document sums
over its groups. No row of a document's links is ever made.

Texts are cut before single spaces between other characters, where neither
tokenizer joins anything (A's splitter begins a part there, no piece of B holds
a space behind another character), and each different chunk of a block is encoded
once. A text with another byte sequence than its tokens' is encoded as a whole,
and without tokens if that differs too.

Defined results: texts null, empty or that a tokenizer changes have no tokens,
zeros and the empty string; repeated rows count as often as they come, and give
a row each; null identifiers stay null; only the identifier and the text are
read, the columns that come out are fixed; an empty table gives no rows. The
text is the unit of memory: a block holds whole texts.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteatlas.llm.storage import cleaned, durable, table, tune

#: Chunks and occurrences of groups that a block holds before it is told; bytes that are encoded in one call.
BLOCK_CHUNKS, BLOCK_OCCURRENCES, CALL = 400_000, 8_000_000, 1 << 18
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACE = "▁"
_RAW = re.compile(r"<0x([0-9A-F]{2})>")


def _byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Groups of texts, as numbers of what it has interned."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        stands = _byte_characters()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(stands[c] for c in token) if all(c in stands for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _RAW.fullmatch(p)) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = np.array([len(x) for x in self.bytes_a]), np.array([len(x) for x in self.bytes_b])
        self.in_chunks = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        self.forget()

    def forget(self) -> None:
        """A new block: groups and chunks are numbered from 0 again."""
        self.groups: dict[str, int] = {}
        self.chunks: dict[str, int] = {}
        self.ok: list[bool] = []
        self.written: list[bytes] = []
        self.tokens: list[tuple[int, int]] = []
        self.members: list[list[int]] = []

    def _whole(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of texts that begin with a space, by A and B; None where a tokenizer changes the bytes."""
        out = []
        for text, a, b in zip(texts, self.a.encode_batch_fast(texts, add_special_tokens=False), self.b.encode([t[1:] for t in texts], num_threads=1), strict=True):
            raw = text.encode()
            same = b"".join(map(self.bytes_a.__getitem__, a.ids)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw
            out.append((a.ids, b) if same else None)
        return out

    def _intern(self, a: list[int], b: list[int]) -> tuple[list[int], bytes]:
        """Numbers of the groups of equal bytes' tokens, and how they are written."""
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        _, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=False, return_indices=True)
        return self._named(list(map(str, a)), list(map(str, b)), at_a.tolist(), at_b.tolist())

    def _named(self, a: list[str], b: list[str], at_a: list[int], at_b: list[int]) -> tuple[list[int], bytes]:
        names, i, j = [], 0, 0
        for x, y in zip(at_a, at_b, strict=True):
            names.append(",".join(a[i : x + 1]) + "|" + ",".join(b[j : y + 1]))
            i, j = x + 1, y + 1
        groups = self.groups
        return [groups.setdefault(k, len(groups)) for k in names], ";".join(names).encode()

    def _put(self, chunk: str, members: list[int], written: bytes, tokens: tuple[int, int], ok: bool) -> None:
        self.chunks[chunk] = len(self.ok)
        self.ok.append(ok)
        self.members.append(members)
        self.written.append(written)
        self.tokens.append(tokens)

    def _learn(self, new: list[str]) -> None:
        """Chunks that don't begin or end with white space, without their space, in few calls: in a row they are cut as alone."""
        held: list[str] = []
        size = 0
        for i, chunk in enumerate(new):
            held.append(chunk)
            size += len(chunk) + 1
            if size >= CALL or i == len(new) - 1:
                self._learn_row(held)
                held, size = [], 0

    def _learn_row(self, new: list[str]) -> None:
        ids = self._whole([" " + " ".join(new)])[0]
        if ids is None:  # some chunk is changed: each one for itself
            for chunk, found in zip(new, self._whole([" " + c for c in new]), strict=True):
                self._put(chunk, *((*self._intern(*found), (len(found[0]), len(found[1])), True) if found else ([], b"", (0, 0), False)))
            return
        a, b = ids
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        both, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        ends = np.cumsum([len(c.encode()) + 1 for c in new])
        last = np.searchsorted(both, ends)
        if not np.array_equal(both[last], ends):
            raise ValueError("a chunk doesn't end with a token")
        to = last + 1
        many_a, many_b = np.diff(at_a[last], prepend=-1).tolist(), np.diff(at_b[last], prepend=-1).tolist()
        str_a, str_b = list(map(str, a)), list(map(str, b))
        from_a, from_b = [0, *(at_a[:-1] + 1).tolist()], [0, *(at_b[:-1] + 1).tolist()]
        to_a, to_b = (at_a + 1).tolist(), (at_b + 1).tolist()
        names = [(str_a[i] if j - i == 1 else ",".join(str_a[i:j])) + "|" + (str_b[k] if m - k == 1 else ",".join(str_b[k:m])) for i, j, k, m in zip(from_a, to_a, from_b, to_b, strict=True)]
        groups = self.groups
        numbers = [groups.setdefault(k, len(groups)) for k in names]
        begin = 0
        for chunk, end, n_a, n_b in zip(new, to.tolist(), many_a, many_b, strict=True):
            self._put(chunk, numbers[begin:end], ";".join(names[begin:end]).encode(), (n_a, n_b), True)
            begin = end

    def align(self, texts: list[str | None]) -> list[tuple[int, int, list[int], str]]:
        """For each text the numbers of A's and B's tokens, its groups and their SHA-256."""
        parts = [self._chunks(t) for t in texts]
        known = self.chunks
        new = dict.fromkeys(c for p in parts if p for c in p if c not in known)
        plain = [c for c in new if not (c[:1].isspace() or c[-1:].isspace() or not c)]
        self._learn(plain)
        odd = [c for c in new if c not in known]
        for chunk, found in zip(odd, self._whole([" " + c for c in odd]) if odd else [], strict=True):
            self._put(chunk, *((*self._intern(*found), (len(found[0]), len(found[1])), True) if found else ([], b"", (0, 0), False)))
        out = []
        for text, chunks in zip(texts, parts, strict=True):
            if not text:
                out.append((0, 0, [], ""))
                continue
            if chunks:
                at = [known[c] for c in chunks]
                if all(map(self.ok.__getitem__, at)):
                    tokens = [self.tokens[i] for i in at]
                    members = [g for i in at for g in self.members[i]]
                    out.append((sum(n for n, _ in tokens), sum(n for _, n in tokens), members, hashlib.sha256(b";".join([self.written[i] for i in at])).hexdigest()))
                    continue
            found = self._whole([" " + text])[0]
            if found is None:
                out.append((0, 0, [], ""))
            else:
                members, written = self._intern(*found)
                out.append((len(found[0]), len(found[1]), members, hashlib.sha256(written).hexdigest()))
        return out

    def _chunks(self, text: str | None) -> list[str] | None:
        return _CUT.split(text) if text and self.in_chunks else None


@lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def links_of(key: str, size_a: np.ndarray, size_b: np.ndarray) -> list[tuple[int, int]]:
    """The id pairs of a group's links, in order; as often as they come."""
    a, b = (list(map(int, ids.split(","))) for ids in key.split("|"))
    out, i, j, left_a, left_b = [], 0, 0, int(size_a[a[0]]), int(size_b[b[0]])
    while True:
        out.append((a[i], b[j]))
        step = min(left_a, left_b)
        left_a, left_b = left_a - step, left_b - step
        if not left_a:
            i += 1
            if i == len(a):
                return out
            left_a = int(size_a[a[i]])
        if not left_b:
            j += 1
            left_b = int(size_b[b[j]])


def _counted(members: list[int]) -> bytes:
    """Distinct groups and how often each comes, compressed."""
    group, n = np.unique(np.array(members, dtype=np.uint32), return_counts=True)
    return zlib.compress(np.concatenate([np.diff(group, prepend=np.uint32(0)), n.astype(np.uint32)]).astype("<u4").reshape(-1, 1).view(np.uint8).T.tobytes(), 1)


def _uncounted(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()
    half = len(flat) // 2
    return np.cumsum(flat[:half], dtype=np.int64), flat[half:].astype(np.int64)


_BLOCKS = pa.schema([("block", pa.string()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("members", pa.binary()), ("keys", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))])


def _encode(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, salt: str, most_chunks: int, most_members: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents, and one of each block's groups (keys and how often they come, by number) behind them."""
    from pyspark import TaskContext

    task, aligner, number, seen, held = TaskContext.get().partitionId(), _aligner(path_a, path_b), 0, np.zeros(0, np.int64), 0
    aligner.forget()
    name = f"{salt}-{task}-0"

    def close() -> pa.RecordBatch:
        nonlocal number, name, seen, held
        keys = list(aligner.groups)
        times = np.zeros(len(keys), np.int64)
        times[: len(seen)] = seen
        columns = [[name], [None], [None], [None], [None], [None], [None], [keys], [times]]
        aligner.forget()
        number, seen, held = number + 1, np.zeros(0, np.int64), 0
        name = f"{salt}-{task}-{number}"
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _BLOCKS, strict=True)], schema=_BLOCKS)

    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            ids, texts = batch.column(0).slice(at, 200).to_pylist(), batch.column(1).slice(at, 200).to_pylist()
            found = aligner.align(texts)
            every = np.array([g for _, _, members, _ in found for g in members], dtype=np.int64)
            n = np.bincount(every, minlength=len(aligner.groups))
            n[: len(seen)] += seen
            seen, held = n, held + len(every)
            columns = [[name] * len(ids), ids, [f[0] for f in found], [f[1] for f in found], [len(f[2]) for f in found], [f[3] for f in found], [_counted(f[2]) for f in found], [None] * len(ids), [None] * len(ids)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _BLOCKS, strict=True)], schema=_BLOCKS)
            if len(aligner.chunks) > most_chunks or held > most_members:
                yield close()
    if held or aligner.groups:
        yield close()
    aligner.forget()


_KINDS = "block string, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, members binary, keys array<string>, times array<bigint>"
_LINKS = pa.schema([("key", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("times", pa.int64()), ("weight", pa.int64())])


def _expand(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    """(key, n) to its distinct id pairs: times in the group, and times n in the corpus."""
    aligner = _aligner(path_a, path_b)
    for batch in batches:
        rows = []
        for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            pairs: dict[tuple[int, int], int] = {}
            for pair in links_of(key, aligner.size_a, aligner.size_b):
                pairs[pair] = pairs.get(pair, 0) + 1
            rows += [(key, a, b, times, times * n) for (a, b), times in pairs.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _LINKS, strict=True)], schema=_LINKS)


_OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (block, documents last): what a block's groups have (place, n_links, n_best, count_sum), then its documents."""
    block, held, values = None, [], None
    for batch in batches:
        blocks = batch.column(0).to_pylist()
        cuts = [0, *(i for i in range(1, len(blocks)) if blocks[i] != blocks[i - 1]), len(blocks)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if blocks[i] != block:
                block, held, values = blocks[i], [], None
            own = batch.slice(i, j - i)
            known = own.column(1).is_valid()
            facts = own.filter(known)
            if facts.num_rows:
                held.append([facts.column(k).to_numpy() for k in range(1, 5)])
            documents = own.filter(pa.compute.invert(known))
            if not documents.num_rows:
                continue
            if values is None:
                place, *sums = (np.concatenate(x) for x in zip(*held, strict=True)) if held else [np.zeros(0, np.int64)] * 4
                values = np.zeros((3, int(place.max()) + 1 if len(place) else 0), np.int64)
                for k in range(3):
                    values[k, place] = sums[k]
                held = []
            totals = np.zeros((3, documents.num_rows), np.int64)
            for r, raw in enumerate(documents.column(10).to_pylist()):
                group, n = _uncounted(raw)
                totals[:, r] = (values[:, group] * n).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*(documents.column(k) for k in (5, 6, 7, 8)), *(pa.array(x) for x in totals), documents.column(9)], schema=_OUT)


def align_tokenizers(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_chunks: int = BLOCK_CHUNKS, block_occurrences: int = BLOCK_OCCURRENCES) -> DataFrame:
    """One row for each row of df: identifier, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = df.sparkSession
    tune(spark)
    salt = uuid.uuid4().hex[:8]
    encoded = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(lambda it: _encode(it, path_a, path_b, salt, block_chunks, block_occurrences), _KINDS)
    blocks = durable(encoded, "aligned")
    interned = blocks.where("keys is not null").select("block", F.posexplode(F.arrays_zip("keys", "times")).alias("place", "g")).select("block", "place", F.col("g.keys").alias("key"), F.col("g.times").alias("times"))
    with cleaned(spark):
        links = durable(interned.groupBy("key").agg(F.sum("times").alias("n")).mapInArrow(lambda it: _expand(it, path_a, path_b), "key string, a int, b int, times long, weight long"), "links")
        pairs = links.groupBy("a", "b").agg(F.sum("weight").alias("count"))
        pairs = durable(pairs.withColumn("best", F.max("count").over(Window.partitionBy("b"))).select("a", "b", "count", (F.col("count") == F.col("best")).alias("best")), "pairs")
        facts = durable(
            links.join(pairs, ["a", "b"]).groupBy("key").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")),
            "facts",
        )
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    back = interned.select("block", "place", "key").join(facts, "key").select("block", F.col("place").cast("long").alias("place"), "n_links", "n_best", "count_sum", *none("long", "doc_id", "n_a", "n_b", "n_groups"), *none("string", "groups_sha256"), *none("binary", "members"))
    rows = blocks.where("keys is null").select("block", *none("long", "place", "n_links", "n_best", "count_sum"), "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "members")
    met = back.unionByName(rows).repartition("block").sortWithinPartitions("block", F.col("place").isNull())
    out = met.mapInArrow(_sum, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("doc_id", id_col)


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents").select("doc_id", "text"), *tokenizer_paths())
