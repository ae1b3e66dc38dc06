"""Vectorised word and n-gram hashing of whole Arrow/pandas batches.

A *word* is a run of a-z and 0-9 in the lower-cased text. All texts of a batch are joined into one
byte buffer, words are found with array operations, and each word gets a 64-bit polynomial hash taken
from prefix sums, so that no Python code runs per word.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = np.zeros(256, dtype=bool)
_WORD[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", dtype=np.uint8)] = True
#: Texts are cut into buffers of at most about this many bytes, which bounds the working memory.
BUFFER_BYTES = 1 << 21


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of a 64-bit value (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    if n:
        p[0] = np.uint64(1)
    return np.multiply.accumulate(p)


_POW = {"up": _powers(_BASE, 1), "down": _powers(_INV, 1)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse."""
    if len(_POW["up"]) < n:
        size = max(n, 1 << 16)
        _POW["up"], _POW["down"] = _powers(_BASE, size), _powers(_INV, size)
    return _POW["up"][:n], _POW["down"][:n]


def batches(texts) -> list[slice]:
    """Slices of `texts` whose joined size stays near BUFFER_BYTES; one very long text is a slice of its own."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if size and size + n > BUFFER_BYTES:
            out.append(slice(start, i))
            start, size = i, 0
        size += n
    if start < len(texts):
        out.append(slice(start, len(texts)))
    return out


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, offsets): the words of text i are hashes[offsets[i]:offsets[i + 1]]. None is an empty text."""
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8) if parts else np.zeros(0, dtype=np.uint8)
    if not len(buf):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(parts) + 1, dtype=np.int64)
    inside = np.concatenate(([False], _WORD[buf], [False]))
    step = np.diff(inside.astype(np.int8))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = powers(len(buf) + 1)
    pre = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=pre[1:])
    hashes = mix64((pre[ends] - pre[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
    return hashes, np.searchsorted(starts, bounds).astype(np.int64)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words over the whole buffer (runs that cross texts included)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        acc = acc * _BASE + hashes[k : k + m]
    return mix64(acc)


def grams_by_text(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, text index, word position) of every n-gram inside one text."""
    grams = gram_hashes(hashes, n)
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    pos = np.arange(len(hashes)) - offsets[owner]
    ok = pos[: len(grams)] + n <= lengths[owner[: len(grams)]]
    return grams[ok], owner[: len(grams)][ok], pos[: len(grams)][ok]
