"""Vectorised character and word kernels: texts as arrays of code points, words as 64-bit hashes."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Texts are joined up to this many characters before numpy works on them.
BLOCK = 1 << 20


@cache
def is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


@cache
def is_word() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 256)
        full = np.full(size, 0x9E3779B97F4A7C15, dtype=np.uint64)
        full[0] = 1
        _powers = np.multiply.accumulate(full)
    return _powers[:n]


def blocks(texts: list[str | None], size: int = BLOCK):
    """(first, last) of consecutive texts with about size characters together."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= size:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased letter-and-digit runs of all texts, and where each text's words begin (one more entry)."""
    low = [t.lower() if t else "" for t in texts]
    lengths = np.fromiter(map(len, low), dtype=np.int64, count=len(low))
    edges = np.concatenate([[0], np.cumsum(lengths + 1)])
    c = codes("\n".join(low) + "\n")
    w = is_word()[c]
    step = np.flatnonzero(np.diff(w.view(np.int8), prepend=np.int8(0)))
    starts, ends = step[0::2], step[1::2]
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    sizes = ends - starts
    inside = c[w].astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(len(inside)) - np.repeat(first, sizes)
    inside *= np.uint64(0xD6E8FEB86659FD93)
    inside ^= inside >> np.uint64(32)
    inside *= powers(int(sizes.max()))[place]
    return mixed(np.add.reduceat(inside, first)), np.searchsorted(starts, edges)


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of every k successive words, in Karp and Rabin's polynomial form; empty when there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += words[i : i + n]
    return mixed(total)
