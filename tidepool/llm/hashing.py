"""Hashes of words and of word shingles, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a worker keeps; beyond that it starts anew.
CACHE = 250_000
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    return text.encode().translate(_LOWER).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: a one-to-one scramble."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of a text that :func:`word_hashes` takes at a time.
PIECE = 1 << 20
_BLANK = np.array([c == 0x20 or 0x09 <= c <= 0x0D for c in range(256)])
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def _power(sign: int, n: int) -> np.ndarray:
    """The powers of ``_ODD`` (of its inverse if ``sign`` is -1) from 0 on."""
    if len(_powers[sign]) < n:
        base = np.full(max(n, 2 * len(_powers[sign])), _ODD if sign > 0 else np.uint64(pow(int(_ODD), -1, 1 << 64)))
        base[0] = 1
        _powers[sign] = np.multiply.accumulate(base)
    return _powers[sign]


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each of :func:`words_of`, by polynomials over the whole
    text at once (other values than those of :class:`WordHashes`)."""
    out, data, at = [], text.encode().translate(_LOWER) if text else b"", 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and not _BLANK[data[end]]:  # pieces end with a word
            end += 1
        x = np.frombuffer(data, np.uint8, min(end, len(data)) - at, at)
        gap = np.ones(len(x) + 2, np.int8)
        gap[1:-1] = _BLANK[x]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_BYTE[x] * _power(1, len(x))[:len(x)], out=total[1:])
        out.append(mix((total[edge[1::2]] - total[edge[::2]]) * _power(-1, len(x) + 1)[edge[::2]]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k of the hashes ``h`` in their order; the whole
    sequence as one run if there are fewer, nothing if there are none."""
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    s = np.full(n, np.uint64(k))
    for j in range(k):
        s = s * _ODD + h[j:j + n]
    return mix(s)


class WordHashes(dict):
    """64-bit hashes of words, kept by word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    def shingles(self, words: list[bytes], k: int) -> np.ndarray:
        """:func:`shingle_hashes` of words."""
        return shingle_hashes(self.of(words), k)

    def shingle_set(self, words: list[bytes], k: int) -> np.ndarray:
        return np.unique(self.shingles(words, k))
