"""Pre-split pieces of many texts at once and their ids from one table.

For texts of ASCII and of U+00C0 to U+00FF (two bytes in UTF-8), the pieces
of the public byte-level pattern follow from runs of letters, digits, white
space and other characters; array operations find them for a block of texts.
A piece is known by a 64-bit hash, checked by a second one, in a table of
open addressing that points to its ids in a pool.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

#: Texts of other characters are not taken here.
BEYOND = re.compile("[^\x00-\x7f\xc0-\xff]")
SPACE, LETTER, DIGIT, OTHER = range(4)
LEAD = 0xC3
MULTIPLIER = 0x5851F42D4C957F2D


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _kinds() -> np.ndarray:
    out = np.full(256, OTHER, dtype=np.int8)
    for b in range(128):
        kind = unicodedata.category(chr(b))[0]
        out[b] = SPACE if b in (9, 10, 11, 12, 13, 32) else LETTER if kind == "L" else DIGIT if kind == "N" else OTHER
    return out


KINDS = _kinds()


def pieces(b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Start of every piece of texts in ``b``, one after another, ``ends``
    being the end of each (no empty ones)."""
    n = len(b)
    kind = KINDS[b]
    lead = np.flatnonzero(b == LEAD)
    letters = lead[(b[lead + 1] != 0x97) & (b[lead + 1] != 0xB7)]
    kind[letters] = kind[letters + 1] = LETTER
    start = np.zeros(n + 1, dtype=bool)
    start[0] = start[n] = True
    start[1:n] = kind[1:] != kind[:-1]
    start[ends] = True
    last = np.zeros(n + 1, dtype=bool)  # ends of texts
    last[ends] = True
    # white space before something else leaves its last character: a space
    # goes to what follows, any other is a piece
    gap = np.flatnonzero(start[1:] & (kind == SPACE) & ~last[1:])
    start[gap] = True
    to_next = gap[b[gap] == 32] + 1
    start[to_next] = False
    # 's, 't, 're, 've, 'm, 'll and 'd stand alone at the start of a piece
    mark = np.flatnonzero((b[:-1] == 39) & start[:n - 1] & start[1:n] & (kind[1:] == LETTER) & ~last[1:n])
    one = b[mark + 1]
    two = np.where(last[np.minimum(mark + 2, n)], 0, b[np.minimum(mark + 2, n - 1)])
    single = np.isin(one, [115, 116, 109, 100])
    double = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
    start[mark[single | double] + 1] = False
    start[mark[single] + 2] = True
    start[mark[double] + 3] = True
    return np.flatnonzero(start[:n])


class PieceTable:
    """Pieces to ids; ``encode`` gives the ids of one piece as bytes."""

    def __init__(self, encode, width: np.dtype, longest: int, most: int, block: int):
        self.encode, self.width, self.longest, self.most = encode, width, longest, most
        rng = np.random.default_rng(11)
        self.values = rng.integers(1, 2 ** 63, (2, 256), dtype=np.uint64)
        self.power = _powers(MULTIPLIER, block)
        self.inverse = _powers(pow(MULTIPLIER, -1, 2 ** 64), block)
        self.bits = (2 * most - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        size = 1 << self.bits
        self.keys, self.checks = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.uint64)
        self.at, self.n = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32)
        self.pool, self.used, self.filled = np.zeros(1 << 16, dtype=self.width), 0, 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 for unknown ones."""
        slot = self._slot(keys)
        there = self.keys[slot]
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[left]]
            left = left[(there != keys[left]) & (there != 0)]
        slot[self.keys[slot] != keys] = -1
        return slot

    def _insert(self, keys, checks, at, n) -> None:
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot[todo]] == keys[todo]
            done = todo[won]
            self.checks[slot[done]], self.at[slot[done]], self.n[slot[done]] = checks[done], at[done], n[done]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
        self.filled += len(keys)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the ids of ``words``, put into the pool."""
        ids = [self.encode(w) for w in words]
        n = np.array([len(x) for x in ids], dtype=np.int64) // self.width.itemsize
        new = np.frombuffer(b"".join(ids), dtype=self.width)
        while self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(new)] = new
        at = self.used + np.cumsum(n) - n
        self.used += len(new)
        return at, n

    def encode_many(self, raw: list[bytes]) -> list[bytes]:
        """Raw ids of texts (none empty), together at most a block."""
        if self.filled > self.most:
            self.clear()
        buffer = b"".join(raw)
        b = np.frombuffer(buffer, dtype=np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        start = pieces(b, ends)
        stop = np.append(start[1:], len(b))
        hashes = []
        for values in self.values:
            total = np.zeros(len(b) + 1, dtype=np.uint64)
            np.cumsum(values[b] * self.power[:len(b)], out=total[1:])
            hashes.append((total[stop] - total[start]) * self.inverse[start])
        keys, checks = np.maximum(hashes[0], np.uint64(1)), hashes[1] ^ (stop - start).astype(np.uint64)
        slot = self._find(keys)
        at, n = self.at[slot].astype(np.int64), self.n[slot].astype(np.int64)
        long = stop - start > self.longest
        miss = np.flatnonzero((slot < 0) & ~long)
        if len(miss):
            new, first = np.unique(keys[miss], return_index=True)
            own = miss[first]
            spots, sizes = self._learn([buffer[i:j].decode("utf-8") for i, j in zip(start[own].tolist(), stop[own].tolist())])
            if self.filled + len(new) < len(self.keys) * 3 // 4:
                self._insert(new, checks[own], spots, sizes)
            place = np.searchsorted(new, keys[miss])
            at[miss], n[miss] = spots[place], sizes[place]
            known = np.where(slot < 0, 0, self.checks[slot])
            known[miss] = checks[own][place]
        else:
            known = self.checks[slot]
        alone = np.flatnonzero(long | (known != checks))  # long pieces; two pieces of one hash
        if len(alone):
            at[alone], n[alone] = self._learn([buffer[i:j].decode("utf-8") for i, j in
                                               zip(start[alone].tolist(), stop[alone].tolist())])
        before = np.append(0, np.cumsum(n))
        ids = self.pool[np.repeat(at - before[:-1], n) + np.arange(before[-1])]
        cuts = before[np.searchsorted(start, ends)].tolist()
        return [ids[i:j].tobytes() for i, j in zip([0, *cuts], cuts)]
