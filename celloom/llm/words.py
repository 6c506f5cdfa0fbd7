"""Words, word hashes and five-word shingles, computed for a batch of texts at once in numpy.

A word is a run of ASCII letters, ASCII digits and non-ASCII characters in the lower-cased text. SEPARATOR is the same rule as a
regular expression for Spark and DuckDB.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
SEPARATOR = r"[^0-9a-z\x{80}-\x{10FFFF}]+"

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = True
_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACE = mix(np.arange(1001, 1001 + SHINGLE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_RADIX = 0x9E3779B97F4A7C15
_RADIX_INVERSE = pow(_RADIX, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _RADIX), ("down", _RADIX_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def hashed_slices(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of bytes."""
    return sliced(_BYTE[buffer], starts, ends)


def sliced(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of 64-bit values, by differences of one running polynomial sum."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, in order, and the offsets of each text's words (one more than there are texts)."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    buffer = np.frombuffer(b" ".join([*parts, b""]) if parts else b"", np.uint8)
    if not len(buffer):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    word = np.zeros(len(buffer) + 2, bool)
    word[1:-1] = _WORD[buffer]
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    bounds = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    return hashed_slices(buffer, starts, ends), np.searchsorted(starts, bounds)


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes (with repeats), text by text, and the offsets of each text's.

    A text of one to four words has one shingle, of all its words; a text without words has none.
    """
    words, at = word_hashes(texts)
    counts = np.diff(at)
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(offsets[-1], np.uint64)
    whole = len(words) - SHINGLE + 1
    if whole > 0:
        rolled = np.zeros(whole, np.uint64)
        for j in range(SHINGLE):
            rolled += words[j : j + whole] * _PLACE[j]
        rolled = mix(rolled)
        long = counts >= SHINGLE
        source = np.repeat((at[:-1] - offsets[:-1])[long], n[long])
        target = np.arange(offsets[-1])[np.repeat(long, n)]
        out[target] = rolled[target + source]
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        own = words[at[i] : at[i + 1]]
        out[offsets[i]] = mix(np.sum(own * _PLACE[: len(own)], dtype=np.uint64, keepdims=True))[0]
    return out, offsets


def in_chunks(texts: list[str], most: int = 400_000):
    """Index ranges over texts of at most so many characters, or of one text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
