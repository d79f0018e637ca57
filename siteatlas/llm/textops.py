"""Words and their 64-bit hashes for many texts at once, in numpy.

A word is a run of bytes other than space and tab to carriage return; A-Z count
as a-z. Texts are read in pieces cut at white space, so memory depends on the
longest word and never on the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
PIECE = 1 << 20
_pow = np.cumprod(np.full(4096, _BASE, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _pow
    if n > len(_pow):
        _pow = np.cumprod(np.full(2 * n, _BASE, dtype=np.uint64))
    return _pow


def _hash_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word."""
    raw = np.frombuffer(block, dtype=np.uint8)
    gap = _SPACE[raw]
    edge = np.empty(len(raw), dtype=bool)
    edge[0] = not gap[0]
    np.logical_and(~gap[1:], gap[:-1], out=edge[1:])
    starts = np.flatnonzero(edge)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    body = raw[starts[0] :]
    at = starts - starts[0]
    spans = np.diff(at, append=len(body))
    place = np.arange(len(body)) - np.repeat(at, spans)
    value = (_LOWER[body].astype(np.uint64) + np.uint64(1)) * _powers(int(spans.max()) + 1)[place]
    value[gap[starts[0] :]] = 0
    return mix(np.add.reduceat(value, at)), starts


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(b, at, at + PIECE) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:
            found = [x for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := text.find(b, at + PIECE)) >= 0]
            cut = min(found, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes in order, and for each text where its words begin (one more entry than texts)."""
    out, counts, block, sizes = [], [], [], 0
    ends: list[int] = []

    def close():
        nonlocal block, sizes, ends
        if block:
            hashes, starts = _hash_block(b" ".join(block) + b" ")
            out.append(hashes)
            counts.extend(np.diff(np.searchsorted(starts, ends), prepend=0))
            block, sizes, ends = [], 0, []

    for text in texts:
        if len(text) > PIECE:
            close()
            n = 0
            for piece in _pieces(text):
                if piece:
                    hashes, _ = _hash_block(piece)
                    out.append(hashes)
                    n += len(hashes)
            counts.append(n)
            continue
        block.append(text)
        sizes += len(text) + 1
        ends.append(sizes)
        if sizes > PIECE:
            close()
    close()
    return np.concatenate([np.empty(0, np.uint64), *out]), np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64))]).astype(np.int64)


def shingles(words: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word runs; of all its words where there are fewer; none without words."""
    out = []
    for i, j in zip(at[:-1], at[1:], strict=True):
        w = words[i:j]
        n = min(k, len(w))
        if not n:
            out.append(w[:0])
            continue
        h = np.full(len(w) - n + 1, np.uint64(n), dtype=np.uint64)
        for x in range(n):
            h = mix(h * _BASE + w[x : x + len(h)])
        out.append(np.unique(h))
    return out
