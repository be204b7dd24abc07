"""Vectorised Rabin-Karp hashes: of words in UTF-8 text, and of windows of word hashes.

Polynomial hashes modulo 2**64 from prefix sums: with odd base p, the hash of positions
[a, b) is ``(sum[b] - sum[a]) * p**-a``.  Byte values go through a table of fixed random
numbers first, and every result through a bit mixer.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 20
_U = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15
_rng = np.random.Generator(np.random.PCG64(20))
_BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed up to ``keep``."""

    def __init__(self, base: int, keep: int):
        self.base, self.keep = base, keep
        self._held = self._make(0)

    def _make(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for b in (self.base, pow(self.base, -1, 1 << 64)):
            p = np.full(n + 1, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        return out[0], out[1]

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.keep:
            return self._make(n)
        if len(self._held[0]) <= n:
            self._held = self._make(min(self.keep, max(n, 1 << 16, 2 * len(self._held[0]))))
        return self._held


_bytes_powers = Powers(_BYTE_BASE, CHUNK + 1)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends (exclusive) of the words of a UTF-8 byte array."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    space = is_space(data)
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        change = np.concatenate(([0], change))
    if not space[-1]:
        change = np.concatenate((change, [len(data)]))
    return change[0::2], change[1::2]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``data``; works through the data in bounded chunks."""
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        origin = int(starts[done])
        last = max(int(np.searchsorted(ends, origin + CHUNK, "right")), done + 1)
        stop = int(ends[last - 1])
        power, inverse = _bytes_powers.get(stop - origin)
        sums = np.empty(stop - origin + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE_VALUES[data[origin:stop]] * power[: stop - origin], dtype=np.uint64, out=sums[1:])
        a, b = starts[done:last] - origin, ends[done:last] - origin
        out[done:last] = (sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64)
        done = last
    return mix(out)


def hash_words(data: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a UTF-8 text."""
    array = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    starts, ends = word_spans(array)
    return starts, ends, hash_spans(array, starts, ends)


def hash_windows(words: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """The hash of every ``width`` consecutive entries of ``words``."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, inverse = powers.get(len(words))
    sums = np.empty(len(words) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(words * power[: len(words)], dtype=np.uint64, out=sums[1:])
    return mix((sums[width:] - sums[:n]) * inverse[:n])


class Run:
    """Several UTF-8 texts as one byte array, with the spans and hashes of their words.

    ``edges[i]`` to ``edges[i + 1]`` are the bytes of text i and a closing line feed;
    ``first_word[i]`` to ``first_word[i + 1]`` are its words.
    """

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.edges = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
        self.starts, self.ends, self.words = hash_words(self.data)
        self.first_word = np.searchsorted(self.starts, self.edges)
        self.n_words = np.diff(self.first_word)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_words)), self.n_words)

    def count(self, mask: np.ndarray) -> np.ndarray:
        """True bytes of ``mask`` per text."""
        if len(self.edges) < 2:
            return np.empty(0, np.int64)
        return np.add.reduceat(mask, self.edges[:-1], dtype=np.int64)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends (before the line feed) and text numbers of all lines."""
        ends = np.flatnonzero(self.data == 10)
        starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        return starts, ends, np.searchsorted(self.edges, starts, "right") - 1


def equal_within(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries in order: whether an equal hash of the same owner stands earlier, and later."""
    order = np.lexsort((hashes, owner)) if len(hashes) else np.empty(0, np.int64)
    h, o = hashes[order], owner[order]
    same = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    earlier, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    earlier[order[1:][same]] = True
    later[order[:-1][same]] = True
    return earlier, later
