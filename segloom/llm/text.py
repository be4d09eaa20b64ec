"""Vectorised tokenising: 64-bit hashes of white-space separated words and of their n-grams, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at once; larger arrays would leave the caches.
PIECE = 1 << 18
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = BASE) -> np.ndarray:
    key = str(base)
    if len(_POWERS.get(key, ())) < n:
        p = np.full(max(n, PIECE), np.uint64(base))
        p[0] = 1
        _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS[key][:n]


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def pieces(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut at white space or between texts, so that no word is cut."""
    at, n = 0, len(data)
    while at < n:
        to = min(at + PIECE, n)
        if to < n:
            inner = bounds[(bounds > at) & (bounds <= to)]
            spaces = np.flatnonzero(SPACE[data[to - 4096 if to - 4096 > at else at : to]])
            if len(spaces):
                to = (to - 4096 if to - 4096 > at else at) + int(spaces[-1]) + 1
            elif len(inner):
                to = int(inner[-1])
            else:
                later = np.flatnonzero(SPACE[data[to:]])
                after = bounds[bounds > to]
                to = min([int(after[0])] + ([to + int(later[0]) + 1] if len(later) else []))
        yield at, to
        at = to


def spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte, and the byte after the last, of every word; bounds: where texts begin and end."""
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Hashes of the words from start to end, and which have bytes that count (None: all)."""
    total = np.zeros(len(data) + 1, np.uint64)
    own = codes[data]
    if codes.all():
        np.cumsum(own * powers(len(data)), out=total[1:])
        return mix((total[end] - total[start]) * powers(len(data), INVERSE)[start]), None
    # the power of a byte is how many before it count
    nth = np.zeros(len(data) + 1, np.int64)
    np.cumsum(own != 0, out=nth[1:])
    np.cumsum(own * powers(len(data)).take(nth[:-1]), out=total[1:])
    return mix((total[end] - total[start]) * powers(len(data) + 1, INVERSE)[nth[start]]), nth[end] > nth[start]


def words(data: np.ndarray, bounds: np.ndarray, codes: np.ndarray = BYTE_CODES) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and where each text's words begin (one more offset than texts).

    codes: a 64-bit code for each byte; bytes of code 0 don't count, nor do words that have no others.
    """
    hashes, begins = [], []
    for at, to in pieces(data, bounds):
        part = data[at:to]
        start, end = spans(part, np.clip(bounds, at, to) - at)
        found, some = hashes_of(part, start, end, codes)
        hashes.append(found if some is None else found[some])
        begins.append((start if some is None else start[some]) + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), bounds)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, across texts too; mask with inside()."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes)), out=total[1:])
    return mix((total[n:] - total[:-n]) * powers(len(hashes), INVERSE)[: len(hashes) - n + 1])


def inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """Which runs of n words lie in one text."""
    total = int(offsets[-1])
    if total < n:
        return np.zeros(0, bool)
    ok = np.ones(total + 1, bool)
    lengths = np.diff(offsets)
    # the last n - 1 starts of every text run over its end
    for k in range(1, n):
        ok[(offsets[1:] - k)[lengths >= k]] = False
    return ok[: total - n + 1]


def texts_of(offsets: np.ndarray) -> np.ndarray:
    """The text of every word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
