"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is the mean of learnt vectors of the word and of its character
2- to 5-grams with its borders (hashed to 2^15 rows), so unseen words are read
by their characters. A run without white space of more than LONG code points is
no word: its runs of letters and digits are read as words, and those that are
still longer as overlapping pieces, so no part of a text is left out. Windows of
WINDOW words begin every STRIDE words, and one more ends with the text, so every
word is in a window and every passage of up to WINDOW - STRIDE + 1 words is whole
in one; windows that begin at other words aren't scored. They are as long as they
are since marks of a toxic text may stand some dozen words apart. Each window is
read in both directions, pooled by attention and scored; a text's score is its
highest window's.

Training takes a bounded sample of labelled rows, whole texts of any length: for
each label, in order of a hash of their identifier, SAMPLE rows outside the held
fold at most, and of these as many as have SAMPLE_TOTAL code points together, or
the shortest one if none has so few. One task reads the sample and learns; the
driver gets identifiers and the network, never texts. Labels are of texts, so
windows are learnt as multiple instances: of a toxic text the window that
scores highest counts as toxic, of another one every window as clean.

Defined results: null, empty and blank texts score 0; without rows of both
labels all texts score 0; repeated labels of a row count once, toxic if any is.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteatlas.llm.storage import table, tune

ROWS, SIZE, HIDDEN, ATTEND = 1 << 15, 16, 8, 8
#: FRESH: random clean windows in training for each toxic one, besides the hardest ones.
WINDOW, STRIDE, FRESH = 192, 144, 1
SAMPLE, SAMPLE_TOTAL, PASSES, SEED, THRESHOLD = 1500, 4_000_000, 7, 7, 0.7
CACHED_WORDS, BLOCK = 300_000, 10_000
LONG, PIECE, STEP = 64, 24, 12
_EDGE = re.compile(r"^\W+|\W+$")
_RUN = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    words = text.lower().split()
    if max(map(len, words), default=0) <= LONG:
        return words
    out = []
    for word in words:
        for run in (_RUN.findall(word) or _cut(word)) if len(word) > LONG else (word,):
            out += _cut(run) if len(run) > LONG else (run,)
    return out


def _cut(run: str) -> list[str]:
    """Pieces of PIECE code points; whatever has no more than PIECE - STEP is whole in one of them."""
    return [run[i : i + PIECE] for i in range(0, max(1, len(run) - PIECE + STEP), STEP)]


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table that each word uses, one after another, and where each word's begin."""
    raw = [b"\x02" + _EDGE.sub("", w).encode() + b"\x03" for w in words]
    size = np.array([len(x) for x in raw])
    first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    body = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), size)
    with np.errstate(over="ignore"):
        whole = np.add.reduceat(body * (np.arange(len(body), dtype=np.uint64) - first[owner].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), first)
        grams, owners, h = [whole ^ (whole >> np.uint64(29))], [np.arange(len(raw))], body
        for n in range(2, 6):
            if len(body) < n:
                break
            h = h[:-1] * np.uint64(0x100000001B3) + body[n - 1 :]
            same = owner[: len(h)] == owner[n - 1 :]
            grams.append(h[same] * np.uint64(2 * n + 1))
            owners.append(owner[: len(h)][same])
        key = np.concatenate(grams) * np.uint64(0xBF58476D1CE4E5B9)
    who = np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    row = (key[order] >> np.uint64(49)).astype(np.int32)
    return row, np.concatenate([np.searchsorted(who[order], np.arange(len(raw))), [len(row)]])


def _vectors(emb: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(emb[row], at[:-1]) / np.diff(at)[:, None].astype(emb.dtype)


def _features_by_block(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [_features(words[i : i + BLOCK]) for i in range(0, len(words), BLOCK)]
    sizes = np.concatenate([np.diff(at) for _, at in parts])
    return np.concatenate([row for row, _ in parts]), np.concatenate([[0], np.cumsum(sizes)])


def _vectors_by_block(emb: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    ends = [at[i : i + BLOCK + 1] for i in range(0, len(at) - 1, BLOCK)]
    return np.concatenate([_vectors(emb, row[e[0] : e[-1]], e - e[0]) for e in ends])


def windows_of(n: int) -> list[int]:
    """Where windows over n words begin; the last one reaches the end."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.negative(x)
    np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _added(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values by index, for 0 to n - 1, each of which is there."""
    order = np.argsort(index, kind="stable")
    return np.add.reduceat(values[order], np.searchsorted(index[order], np.arange(n)))


class Network:
    NAMES = [f"{d}{k}" for d in "fb" for k in ("W", "U", "b")] + ["A", "a", "v", "w", "c"]

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        p = {"emb": r.normal(0, 0.3, (ROWS, SIZE))}
        for d in "fb":
            p |= {d + "W": r.normal(0, 0.5, (SIZE, 3 * HIDDEN)), d + "U": r.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), d + "b": np.zeros(3 * HIDDEN)}
        p |= {"A": r.normal(0, 0.4, (2 * HIDDEN, ATTEND)), "a": np.zeros(ATTEND), "v": r.normal(0, 0.4, ATTEND), "w": r.normal(0, 0.4, 2 * HIDDEN), "c": np.zeros(1)}
        self.p = {k: x.astype(np.float32) for k, x in p.items()}

    @classmethod
    def of(cls, p: dict[str, np.ndarray]) -> Network:
        net = cls.__new__(cls)
        net.p = p
        return net

    def project(self, vectors: np.ndarray) -> np.ndarray:
        """What words give to the gates of both directions."""
        return np.concatenate([vectors @ self.p[d + "W"] + self.p[d + "b"] for d in "fb"], axis=1)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: (time, window, both directions' gates); mask: (time, window). Scores, and the states where keep is set."""
        T, B, _ = x.shape
        H, p = HIDDEN, self.p
        states = np.empty((T, B, 2 * H), np.float32)
        saved = {}
        for d, times in (("f", range(T)), ("b", range(T - 1, -1, -1))):
            o = 0 if d == "f" else 3 * H
            h, U, log = np.zeros((B, H), np.float32), p[d + "U"], []
            whole = mask.all(axis=1)
            for t in times:
                u = h @ U
                zr = _sigmoid(x[t, :, o : o + 2 * H] + u[:, : 2 * H])
                z, r = zr[:, :H], zr[:, H:]
                n = np.tanh(x[t, :, o + 2 * H : o + 3 * H] + r * u[:, 2 * H :])
                new = n + z * (h - n)
                m = mask[t][:, None]
                new = new if whole[t] else np.where(m, new, h)
                if keep:
                    log.append((t, h, z, r, n, u[:, 2 * H :], m))
                h = new
                states[t, :, o // 3 : o // 3 + H] = h
            saved[d] = log
        e = np.tanh(states @ p["A"] + p["a"])
        s = np.where(mask, e @ p["v"], -1e9)
        s = np.exp(s - s.max(axis=0))
        s /= s.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", s, states)
        y = _sigmoid(pooled @ p["w"] + p["c"][0])
        return (y, states, e, s, pooled, saved) if keep else y

    def backward(self, x, mask, target, weight):
        """Gradients of the weighted log loss, by parameter, and by x."""
        H, p = HIDDEN, self.p
        y, states, e, s, pooled, saved = self.forward(x, mask, keep=True)
        dy = ((y - target) * weight / weight.sum()).astype(np.float32)
        g = {"w": pooled.T @ dy, "c": np.array([dy.sum()], np.float32)}
        dpool = dy[:, None] * p["w"]
        dstates = s[:, :, None] * dpool
        ds = np.einsum("bh,tbh->tb", dpool, states)
        ds = s * (ds - (s * ds).sum(axis=0))
        g["v"] = np.einsum("tb,tba->a", ds, e)
        de = ds[:, :, None] * p["v"] * (1 - e * e)
        g["A"], g["a"] = np.einsum("tbh,tba->ha", states, de), de.sum(axis=(0, 1))
        dstates += de @ p["A"].T
        dx = np.zeros_like(x)
        for d in "fb":
            o = 0 if d == "f" else 3 * H
            U, gU, dh = p[d + "U"], np.zeros_like(p[d + "U"]), np.zeros((x.shape[1], H), np.float32)
            for t, h, z, r, n, un, m in reversed(saved[d]):
                dh = dh + dstates[t, :, o // 3 : o // 3 + H]
                dn = np.where(m, dh * (1 - z), 0) * (1 - n * n)
                dz = np.where(m, dh * (h - n), 0) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                dx[t, :, o : o + 3 * H] = np.concatenate([dz, dr, dn], axis=1)
                du = np.concatenate([dz, dr, dn * r], axis=1)
                gU += h.T @ du
                dh = np.where(m, dh * z, dh) + du @ U.T
            g[d + "U"], g[d + "b"] = gU, dx[:, :, o : o + 3 * H].sum(axis=(0, 1))
        return y, g, dx


def _windows(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, time) of word numbers, and which are words."""
    begin = windows_of(len(words))
    place = np.array(begin, np.int32)[:, None] + np.arange(WINDOW, dtype=np.int32)
    there = place < len(words)
    return words[np.minimum(place, len(words) - 1)], there


def _alike(there: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, int]]:
    """Numbers of windows of like length, `size` at a time, and the words of the longest."""
    many = there.sum(axis=1)
    order = np.argsort(many, kind="stable")
    for i in range(0, len(order), size):
        own = order[i : i + size]
        yield own, int(many[own[-1]])


def fit(texts: list[str], labels: list[int], seed: int = SEED, passes: int = PASSES) -> Network | None:
    """A network from whole texts and their labels; none without both labels."""
    return _fit(zip(texts, labels, strict=True), seed, passes)


def _fit(pairs: Iterable[tuple[str, int]], seed: int = SEED, passes: int = PASSES) -> Network | None:
    number: dict[str, int] = {}
    docs = []
    for t, y in pairs:  # one text's words at a time: as lists of strings they take many times its size
        if w := words_of(t):
            docs.append((_windows(np.array([number.setdefault(x, len(number)) for x in w], np.int32)), y))
    if len({y for _, y in docs}) < 2:
        return None
    row, at = _features_by_block(list(number))
    del number
    count = np.diff(at)
    words, there = np.concatenate([d[0][0] for d in docs]), np.concatenate([d[0][1] for d in docs])
    doc = np.repeat(np.arange(len(docs)), [len(d[0][0]) for d in docs])
    toxic = np.array([y for _, y in docs]) == 1
    del docs[:]
    first = np.searchsorted(doc, np.arange(len(toxic)))
    few = np.diff(np.append(first, len(doc))) <= 3
    net, r = Network(seed), np.random.default_rng(seed)
    mean = {k: np.zeros_like(x) for k, x in net.p.items()}
    square = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0

    def scores() -> np.ndarray:
        x = net.project(_vectors_by_block(net.p["emb"], row, at))
        out = np.empty(len(words), np.float32)
        for own, n in _alike(there, 250):
            out[own] = net.forward(x[words[own, :n].T], there[own, :n].T)
        return out

    for k in range(passes):
        score = scores() if k else r.random(len(words))
        if k < 2 and (few & toxic).sum() >= 20:
            good = np.flatnonzero((few & toxic)[doc])
        else:
            best = np.lexsort((score, doc))
            best = best[np.append(first[1:], len(doc)) - 1]
            good = best[toxic]
        clean = np.flatnonzero(~toxic[doc])
        hard = clean[np.argsort(-score[clean])[: len(good)]] if k else clean[:0]
        chosen = np.concatenate([good, hard, r.choice(clean, min(len(clean), FRESH * len(good) + 200), replace=False)])
        chosen = np.concatenate([r.permutation(chosen) for _ in range(max(1, min(20, 4000 // len(chosen))))])
        for i in range(0, len(chosen), 128):
            own = chosen[i : i + 128]
            used, back = np.unique(words[own], return_inverse=True)
            back = back.reshape(len(own), WINDOW)
            rows_ = np.concatenate([row[at[u] : at[u + 1]] for u in used])
            begin = np.concatenate([[0], np.cumsum(count[used])])
            vectors = _vectors(net.p["emb"], rows_, begin)
            x = net.project(vectors)[back.T]
            y = toxic[doc[own]].astype(np.float32)
            _, g, dx = net.backward(x, there[own].T, y, np.where(y, 1.0, 0.7).astype(np.float32))
            dx *= there[own].T[:, :, None]
            dvec = _added(back.T.ravel(), dx.reshape(-1, 6 * HIDDEN), len(used))
            for d, o in (("f", 0), ("b", 3 * HIDDEN)):
                g[d + "W"] = vectors.T @ dvec[:, o : o + 3 * HIDDEN]
            de = sum(dvec[:, o : o + 3 * HIDDEN] @ net.p[d + "W"].T for d, o in (("f", 0), ("b", 3 * HIDDEN))) / count[used][:, None]
            touched, inverse = np.unique(rows_, return_inverse=True)
            demb = _added(inverse, np.repeat(de, count[used], axis=0), len(touched))
            step += 1
            rate = 0.01 * min(1, step / 30) * (0.3 if k >= passes - 2 else 1)
            for name, grad in [*g.items(), ("emb", demb)]:
                where = touched if name == "emb" else slice(None)
                mean[name][where] = 0.9 * mean[name][where] + 0.1 * grad
                square[name][where] = 0.999 * square[name][where] + 0.001 * grad * grad
                net.p[name][where] -= rate * (mean[name][where] / (1 - 0.9**step)) / (np.sqrt(square[name][where] / (1 - 0.999**step)) + 1e-7)
    return net


class Scorer:
    def __init__(self, net: Network):
        self.net, self.known, self.rows = net, {}, np.empty((0, 6 * HIDDEN), np.float32)

    def _numbers(self, texts: list[list[str]]) -> None:
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        new = list({w for ws in texts for w in ws if w not in self.known})
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            at, end = len(self.known), len(self.known) + len(part)
            if end > len(self.rows):
                grown = np.empty((max(end, 2 * len(self.rows)), 6 * HIDDEN), np.float32)
                grown[:at] = self.rows[:at]
                self.rows = grown
            self.rows[at:end] = self.net.project(_vectors(self.net.p["emb"], *_features(part)))
            self.known.update(zip(part, range(at, end), strict=True))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        split = [words_of(t or "") for t in texts]
        self._numbers(split)
        out, blocks, held, size = np.zeros(len(texts), np.float32), [], [], 0

        def close():
            nonlocal blocks, held, size
            if blocks:
                words, there = np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])
                of = np.array(held)
                for own, n in _alike(there, 512):
                    y = self.net.forward(self.rows[words[own, :n].T], there[own, :n].T)
                    np.maximum.at(out, of[own], y)
            blocks, held, size = [], [], 0

        for i, ws in enumerate(split):
            if ws:
                block = _windows(np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws)))
                blocks.append(block)
                held += [i] * len(block[0])
                if len(held) >= 2048:
                    close()
        close()
        return out.astype(float)


def _within(rows: list, total: int) -> list:
    """Rows in order whose n are total together at most; the least one where none fits."""
    out, left = [], total
    for r in rows:
        if r.n <= left:
            out.append(r)
            left -= r.n
    return out or sorted(rows, key=lambda r: r.n)[:1]


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows id, text, y in order: a network's parameters; no row without a network."""
    net = _fit((batch.column(1)[i].as_py(), batch.column(2)[i].as_py()) for batch in batches for i in range(batch.num_rows))
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # what training freed would stay with the worker
        trim(0)
    if net:
        name, value = zip(*net.p.items(), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(name), pa.array([x.shape for x in value], pa.list_(pa.int32())), pa.array([x.tobytes() for x in value], pa.binary())], names=["name", "shape", "data"])


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_total: int = SAMPLE_TOTAL) -> Network | None:
    """From a sample of at most `sample` rows of each label outside the held fold."""
    fit_for = docs.where(F.length(F.trim(text_col)) > 0).groupBy(F.col(id_col).alias("id")).agg(F.max(F.length(text_col)).alias("n"))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % modulus != held)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    fair = known.join(fit_for, "id")
    order = [F.xxhash64("id"), F.col("id")]
    chosen = [r for y in (0, 1) for r in _within(fair.where(F.col("y") == y).orderBy(*order).limit(sample).collect(), sample_total)]
    if not chosen:
        return None
    picked = docs.sparkSession.createDataFrame([(r.id, r.y) for r in chosen], "id long, y int")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length(F.trim("text")) > 0).join(F.broadcast(picked), "id").dropDuplicates(["id"])
    tune(docs.sparkSession)
    learnt = rows.select("id", "text", "y").repartition(1).sortWithinPartitions("id").mapInArrow(_learn, "name string, shape array<int>, data binary").collect()
    return Network.of({r.name: np.frombuffer(r.data, np.float32).reshape(r.shape) for r in learnt}) if learnt else None


def toxicity(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted after a struct src of its columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    tune(docs.sparkSession)
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("src"))
    schema = packed.select("src").schema.add("score", "double").add("predicted", "integer")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net) if net else None
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                src = batch.column(0).slice(i, 200)
                texts = src.field(text_col).to_pylist()
                score = scorer.scores(texts) if scorer else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([src.cast(arrow.field(0).type), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], schema=arrow)

    return packed.mapInArrow(run, schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("src.doc_id").alias("doc_id"), (F.crc32(F.coalesce(F.col("src.doc_id").cast("string"), F.lit(""))) % 3 == 1).alias("held_out"), "score", "predicted")
