"""SetSketch registers, joint estimation and exact comparison of shingle sets, for use inside tasks.

A register holds the exponentially spaced, truncated minimum of exponential hash values of a set:
``K = clip(floor(1 - log_b x), 0, q + 1)``, x the minimum over the elements (Ertl, "SetSketch:
Filling the Gap between MinHash and HyperLogLog", VLDB 2021). Registers of a union are the larger
of the two, register by register.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

BASE, RATE, LARGEST = 1.001, 20.0, 65_535
ROWS_PER_BAND, BANDS = 5, 32
REGISTERS = ROWS_PER_BAND * BANDS
WORDS = 5
_MANY_WORDS = 400_000

_rng = np.random.default_rng(20210712)
_MUL = (_rng.integers(0, 2**32, REGISTERS, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[None, :]
_ADD = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint64).astype(np.uint32)[None, :]
_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 2**64) | 1) for k in range(WORDS)]


class WordHashes(dict):
    """64-bit hashes of words; forgets all once it holds many, so that memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MANY_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles: 5 words, or all words where fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    mixed = np.zeros(n - WORDS + 1, np.uint64)
    for k, f in enumerate(_FACTORS):
        mixed = (mixed ^ h[k : k + len(mixed)]) * f
        mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed)


def registers(elements: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set of 64-bit hashes."""
    high = (elements >> np.uint64(32)).astype(np.uint32)[:, None]
    least = None
    for at in range(0, len(high), 256):
        part = (high[at : at + 256] * _MUL + _ADD).min(0)
        least = part if least is None else np.minimum(least, part)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LARGEST).astype(np.uint16)


_GRID = np.concatenate([np.linspace(0.0, 0.8, 17), np.linspace(0.81, 1.0, 20)])


def likely(equal: np.ndarray, more: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, least: float, doubt: float = 14.0) -> np.ndarray:
    """Whether a Jaccard similarity of ``least`` or more is plausible, from joint register counts.

    equal and more count the registers in which a equals b, and in which a is larger. The joint
    likelihood is taken over a grid of similarities; a pair is ruled out only if ``least`` is
    smaller in log-likelihood than the best value below it by more than ``doubt`` (a chance of
    about 1e-7), or if the set sizes alone exclude it.
    """
    less = REGISTERS - equal - more
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    most = np.minimum(u / v, v / u)
    log_b = np.log(BASE)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / log_b

    def loglik(j: np.ndarray) -> np.ndarray:
        j = np.minimum(j, most)
        up, down = np.clip(p(u - v * j), 1e-9, 1), np.clip(p(v - u * j), 1e-9, 1)
        same = np.clip(1 - up - down, 1e-9, 1)
        return more * np.log(up) + less * np.log(down) + equal * np.log(same)

    best, best_at = np.full(len(u), -np.inf), np.zeros(len(u))
    for j in _GRID:
        ll = loglik(np.full(len(u), j))
        better = ll > best
        best, best_at = np.where(better, ll, best), np.where(better, j, best_at)
    here = loglik(np.full(len(u), least))
    return (most >= least - 1e-12) & ((best_at >= least) | (best - here <= doubt))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def counts_of_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Register counts (equal, a larger) of row pairs."""
    return (a == b).sum(1), (a > b).sum(1)


@lru_cache(maxsize=8)
def fewest_equal(least: float) -> int:
    """The smallest number of equal registers with which a similarity of ``least`` is plausible, whatever the
    other registers and the sizes are. Two registers are left as a margin."""
    ratios = np.linspace(least, 1.0, 33)
    for equal in range(REGISTERS + 1):
        more = np.arange(REGISTERS - equal + 1)
        m, r = (x.ravel() for x in np.meshgrid(more, ratios))
        if likely(np.full(len(m), equal), m, np.ones(len(r)), r, least).any():
            return max(0, equal - 2)
    return REGISTERS


_COLUMNS = 8_192


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """|a & b| of each pair of sets, given as sorted distinct arrays, by products of their incidence matrices."""
    all_left, all_right = np.concatenate(left), np.concatenate(right)
    row_left, row_right = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    shared = np.intersect1d(all_left, all_right)
    out = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, len(shared), _COLUMNS):
        part = shared[at : at + _COLUMNS]
        sides = []
        for elements, rows, n in ((all_left, row_left, len(left)), (all_right, row_right, len(right))):
            place = np.searchsorted(part, elements)
            there = part[np.minimum(place, len(part) - 1)] == elements
            matrix = np.zeros((n, len(part)), np.float32)
            matrix[rows[there], place[there]] = 1
            sides.append(matrix)
        out += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    return out
