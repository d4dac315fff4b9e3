"""Numpy kernels that run inside tasks, on one batch of texts at a time."""

from __future__ import annotations

import numpy as np

MASK = (1 << 64) - 1
#: Bytes of text that a kernel handles at once; its arrays take about 40 times as much.
CHUNK = 1 << 19
#: Rows that are turned into Python objects at once.
SLICE_ROWS = 256


def splitmix(seed: int, n: int) -> np.ndarray:
    """n well mixed 64-bit numbers that depend on the seed alone."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any byte range of a buffer from prefix sums modulo 2**64.

    Byte values go through a random table and are weighed with powers of an
    odd base; a range's sum is brought to a common power with the base's
    inverse, so that equal strings at different places hash alike.
    """

    def __init__(self, seed: int):
        self.table = splitmix(seed, 256)
        self.base = int(splitmix(seed + 1, 1)[0]) & MASK | 5
        self.back = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, CHUNK + CHUNK // 4)
            up, down = np.full(n, self.base, dtype=np.uint64), np.full(n, self.back, dtype=np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def sums(self, buf: np.ndarray) -> np.ndarray:
        self._grow(len(buf) + 1)
        out = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(self.table[buf] * self.up[: len(buf)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix((sums[end] - sums[start]) * self.down[start] + size)


def chunks(sizes: list[int], limit: int = CHUNK):
    """Index ranges of consecutive texts of about ``limit`` bytes together, one text at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def slices(batches, rows: int = SLICE_ROWS):
    """The same record batches in pieces of few rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


class WordHash:
    """64-bit hashes of whole words: each byte times a random multiplier of its place in the word, summed.

    Multipliers of different places have nothing in common, so that no family
    of words cancels out as it does under powers of one base.
    """

    def __init__(self, seed: int, breaks: np.ndarray = _IS_SPACE):
        self.seed, self.breaks = seed, breaks
        self.places = splitmix(seed, 1 << 10) | np.uint64(1)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of the texts, and where each text's words begin (one more entry at the end)."""
        buf = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
        inside = ~self.breaks[buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, size = edge[::2], edge[1::2] - edge[::2]
        begins = 1 + np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        at = np.searchsorted(start, begins)
        if not len(start):
            return np.zeros(0, dtype=np.uint64), at
        longest = int(size.max())
        if longest > len(self.places):
            self.places = splitmix(self.seed, 2 * longest) | np.uint64(1)
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
        sums = np.add.reduceat((buf[inside].astype(np.uint64) + np.uint64(1)) * self.places[place], first)
        return mix(sums + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), at


def shingle_sets(texts: list[bytes], k: int, hashes: WordHash) -> list[np.ndarray]:
    """For each text its sorted distinct k-word shingles as 64-bit hashes; one of all words where there are fewer."""
    words, at = hashes.words(texts)
    coef = splitmix(77, k) | np.uint64(1)
    n = len(words) - k + 1
    grams = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(k if n > 0 else 0):
        grams += words[j : j + n] * coef[j]
    grams = mix(grams)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            short = (words[a:b] * coef[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
