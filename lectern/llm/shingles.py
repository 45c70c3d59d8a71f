"""Word shingles of whole texts as 64-bit hashes, and min-hashes of their sets, in numpy.

Words are runs of bytes other than ASCII white space in the lower-cased text. A word's hash is a
polynomial over its bytes modulo 2**64, taken for all words at once from prefix sums.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """The first n powers of the base (or of its inverse) modulo 2**64."""
    if len(_powers[which]) < n:
        size = max(n, 2 * len(_powers[which]), 1 << 16)
        steps = np.full(size, _BASE if which == "up" else _INVERSE, dtype=np.uint64)
        steps[0] = 1
        _powers[which] = np.cumprod(steps)
    return _powers[which][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(data: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last) of each word of ``data`` (bytes). ``cuts``: true at
    bytes before which a word is cut too."""
    solid = ~_SPACE[data]
    before = np.concatenate([[False], solid[:-1]]) if len(data) else solid
    begin, end = solid & ~before, before & ~solid
    if cuts is not None:
        inner = cuts & solid & before
        begin, end = begin | inner, end | inner
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
    if len(data) and solid[-1]:
        ends = np.append(ends, len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", len(data) + 1)[starts]), starts, ends


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hashed_words`` of the lower-cased text."""
    return hashed_words(np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """The hash of every run of ``size`` words, in order; of all words if there are fewer."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out += words[j : j + n] * np.uint64(pow(_BASE, 2 * j + 1, 1 << 64))
    return mix(out + np.uint64(size))


def shingle_set(text: str, size: int = 5) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(shingle_hashes(word_hashes(text)[0], size))


def set_signature(shingles: np.ndarray) -> bytes:
    """16 bytes that tell sets apart: two independent sums over the members and the size."""
    a = int(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    b = int(mix(shingles + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)) ^ len(shingles)
    return a.to_bytes(8, "big") + b.to_bytes(8, "big")


class MinHasher:
    """``count`` min-hashes of 32 bits each, from multiply-shift functions."""

    def __init__(self, count: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.count = count
        self.a = rng.integers(0, 1 << 63, count, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, count, dtype=np.uint64)[:, None]

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(self.count, np.iinfo(np.uint32).max, dtype=np.uint32)
        for at in range(0, len(shingles), 1024):
            some = shingles[None, at : at + 1024] * self.a
            some += self.b
            some >>= np.uint64(32)
            np.minimum(low, some.min(axis=1).astype(np.uint32), out=low)
        return low


def set_overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 1 << 15) -> np.ndarray:
    """The number of common members of every left with every right set (arrays of distinct hashes)."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    owners = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)]
    values = [np.concatenate(s) if s else np.zeros(0, np.uint64) for s in (left, right)]
    common = np.intersect1d(np.unique(values[0]), np.unique(values[1]), assume_unique=True)
    for at in range(0, len(common), columns):
        some = common[at : at + columns]
        cells = []
        for owner, value, size in zip(owners, values, (len(left), len(right)), strict=True):
            place = np.minimum(np.searchsorted(some, value), len(some) - 1)
            hit = some[place] == value
            m = np.zeros((size, len(some)), dtype=np.float32)
            m[owner[hit], place[hit]] = 1
            cells.append(m)
        out += cells[0] @ cells[1].T
    return out
