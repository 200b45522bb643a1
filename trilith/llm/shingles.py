"""Word and shingle hashes of many texts at once (numpy, per Arrow batch).

Words are maximal runs without space, tab, line feed, vertical tab, form feed
and carriage return, found on UTF-8 bytes.  A word's hash is a polynomial in
its bytes modulo 2^64, mixed; a shingle's hash is a polynomial in the hashes
of its words, mixed.  All values are 64 bits wide.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20  # bytes hashed at once; longer only for a longer word
BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = []

BREAKS = np.zeros(256, dtype=bool)
BREAKS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        _powers[:] = [np.full(size, x, dtype=np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64))]
        for p in _powers:
            p[0] = 1
            np.cumprod(p, out=p)
    return _powers[0], _powers[1]


def hashed_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    gap = BREAKS[data]
    edge = np.diff(gap.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    counts = np.diff(np.searchsorted(starts, ends_of_text), prepend=0)
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, side="right")))
        lo, hi = starts[i], ends[j - 1]
        power, inverse = _power_tables(hi - lo + 1)
        piece = data[lo:hi]
        piece = (LOWER[piece] if lower else piece).astype(np.uint64) + np.uint64(1)
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(piece * power[:hi - lo], out=total[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[b] - total[a]) * inverse[a]
        i = j
    return mix(out), counts


def shingles(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes in order, number per text): all runs of ``width``
    words; a shorter text is one shingle, a text without words has none."""
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    first = np.cumsum(counts) - counts
    offset = np.cumsum(n) - n
    at = np.repeat(first - offset, n) + np.arange(int(n.sum()))
    factor = [pow(STEP, j + 1, 1 << 64) for j in range(width)]
    padded = np.concatenate([words, np.zeros(width, dtype=np.uint64)])
    rolled = np.zeros(len(words), dtype=np.uint64)
    for j in range(width):
        rolled += padded[j:j + len(words)] * np.uint64(factor[j])
    out = rolled[at]
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        w, total = words[first[d]:first[d] + counts[d]], 0
        for j, x in enumerate(w):
            total += int(x) * factor[j]
        out[offset[d]] = total & (2 ** 64 - 1)
    return mix(out), n


def shingle_sets(texts: list[bytes], width: int, lower: bool = False) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    s, n = shingles(*hashed_words(texts, lower), width)
    return [np.unique(x) for x in np.split(s, np.cumsum(n)[:-1])] if texts else []
