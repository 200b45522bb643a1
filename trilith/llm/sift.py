"""Which tokens of many texts, and which neighbours, need a closer look.

Most tokens are plain words (letters between marks) or numbers whose
features have no weight.  They are told apart for a whole block of texts with
array operations on its bytes: token bounds, marks at the ends, runs of a
letter, and the CRC-32 of each feature, moved on one byte at a time for all
words together.  Letters are a to z and those of U+00C0 to U+00FF (two bytes
in UTF-8, the first of which is ``LEAD``).  Whatever is not plain is left open.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

USUAL = 24  # bytes of a word that is checked here
#: White space of ``str.split`` beyond ASCII; texts with it are not taken here.
WIDE_SPACE = re.compile("[\x85\xa0  -     　]")
CRC_TABLE = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)
LETTER, DIGIT, EDGES = 1, 2, 3
LEAD = 0xC3


def _table(chars, dtype=bool) -> np.ndarray:
    out = np.zeros(256, dtype=dtype)
    out[[ord(c) for c in chars]] = 1
    return out


class Sieve:
    """``mask``: whether a feature cell (CRC modulo its length) has weight;
    ``edge``: marks to strip off a token; ``marks``: those that also may stand
    inside neighbours; ``prefixes``: lengths of prefix features, in a row;
    ``short``: characters of a token that may be part of a split word."""

    def __init__(self, mask: np.ndarray, edge: str, marks, prefixes, short: int):
        self.mask, self.prefixes, self.short = mask, prefixes, short
        self.space = _table([*map(chr, range(9, 14)), *map(chr, range(28, 33))])
        self.lower = np.array([ord(chr(b).lower()) if b < 128 else b for b in range(256)], dtype=np.uint8)
        self.mark = _table(marks)
        self.kind = np.zeros(256, dtype=np.uint8)
        for b in range(128):
            c = chr(b)
            self.kind[b] = LETTER if c.isalpha() else DIGIT if c.isdigit() else EDGES if c in edge else 0

    def _cell(self, crc: np.ndarray) -> np.ndarray:
        return self.mask[~crc % np.uint32(len(self.mask))]

    def _weighted(self, columns) -> np.ndarray:
        """Whether words have a weighted feature.  ``columns`` yields, letter
        by byte, the words (a slice or places) that go on and their bytes."""
        word = prefix = size = hit = None
        for n, at, chars in columns:
            if word is None:
                word = np.full(n, zlib.crc32(b"=") ^ 0xFFFFFFFF, dtype=np.uint32)
                prefix = np.full(n, zlib.crc32(b"^") ^ 0xFFFFFFFF, dtype=np.uint32)
                size, hit = np.zeros(n, dtype=np.int8), np.zeros(n, dtype=bool)
            for crc in (word, prefix):
                old = crc[at]
                crc[at] = CRC_TABLE[(old ^ chars) & 255] ^ (old >> np.uint32(8))
            size[at] += (chars & 0xC0) != 0x80
            now = size[at]
            ends = (now >= self.prefixes[0]) & (now <= self.prefixes[-1]) & (chars != LEAD)
            hit[at] |= ends & self._cell(prefix[at])
        return hit | self._cell(word)

    def open(self, texts: list[str]):
        """(tokens, neighbours, spaced): what of the texts is open, as
        (text number, token) and (text number, tokens in a row) pairs, and the
        numbers of texts with three or more single characters in a row."""
        raw = [t.encode("utf-8") for t in texts]
        ends = np.cumsum([len(r) + 1 for r in raw])
        buffer = b"\n".join(raw)
        b = np.frombuffer(buffer + b"\n\n\n", dtype=np.uint8)
        n = len(b)
        d = np.diff(self.space[b].astype(np.int8), prepend=1)
        starts, stops = np.flatnonzero(d == -1), np.flatnonzero(d == 1)
        if not len(starts):
            return [], [], set()
        doc = np.searchsorted(ends, starts, side="right")
        low, kind = self.lower[b], self.kind[b]
        lead = np.flatnonzero(b[:-1] == LEAD)
        second = b[lead + 1]
        wide = (second != 0x97) & (second != 0xB7)  # the two signs among these letters
        lead, second = lead[wide], second[wide]
        kind[lead] = kind[lead + 1] = LETTER
        low[lead + 1] = np.where(second <= 0x9E, second + 0x20, second)
        total = lambda x: np.append(0, np.cumsum(x, dtype=np.int32))
        letters, digits = total(kind == LETTER), total(kind == DIGIT)
        triple = np.zeros(n, dtype=bool)
        triple[:-2] = (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:])
        lead = lead[lead + 5 < n]
        triple[lead] |= np.logical_and.reduce([low[lead + i] == low[lead + i + 2] for i in range(4)])
        triples = total(triple)
        solid, at = kind != EDGES, np.arange(n, dtype=np.int32)
        first = np.minimum.accumulate(np.where(solid, at, n)[::-1])[::-1][starts]
        last = np.maximum.accumulate(np.where(solid, at, -1))[stops - 1]
        empty = first >= stops
        first, last = np.where(empty, starts, first), np.where(empty, starts, last)
        size = last + 1 - first
        word = (letters[last + 1] - letters[first] == size) & (
            (size < 3) | (triples[np.maximum(last - 1, first)] == triples[first]))
        plain = ~empty & (word | (digits[last + 1] - digits[first] == size)) & (size <= USUAL)
        some = np.flatnonzero(plain)
        some = some[np.argsort(-size[some], kind="stable")]
        sizes, begin = size[some], first[some]

        def letters_of_words():
            for i in range(int(sizes[0]) if len(sizes) else 0):
                m = int(np.searchsorted(-sizes, -i, side="left"))  # words of more than i bytes
                yield len(some), slice(0, m), low[begin[:m] + i]

        dropped = empty.copy()
        if len(some):
            dropped[some] = ~self._weighted(letters_of_words())
        tokens = [(int(doc[k]), buffer[starts[k]:stops[k]].decode("utf-8")) for k in np.flatnonzero(~dropped).tolist()]

        chars = total((b & 0xC0) != 0x80)
        chars = chars[stops] - chars[starts]
        short = chars <= self.short
        width = stops - starts
        marks = total(self.mark[b])
        fit = short & (letters[stops] - letters[starts] + marks[stops] - marks[starts] == width) & (
            (width < 3) | (triples[np.maximum(stops - 2, starts)] == triples[starts]))
        next_to = np.append(short[:-1] & short[1:] & (doc[:-1] == doc[1:]), False)
        pair = np.flatnonzero(next_to[:-1] & (chars[:-1] + chars[1:] > 2)) if len(starts) > 1 else starts[:0]
        three = pair[(pair > 0) & next_to[pair - 1]]
        split = self._open_rows(pair, 2, starts, stops, low, kind, fit) + self._open_rows(
            three - 1, 3, starts, stops, low, kind, fit)
        neighbours = [(int(doc[k]), " ".join(buffer[starts[j]:stops[j]].decode("utf-8") for j in range(k, k + m)))
                      for k, m in split]
        one = chars == 1
        spaced = np.flatnonzero(one[:-2] & one[1:-1] & one[2:] & (doc[:-2] == doc[2:]))
        return tokens, neighbours, set(doc[spaced].tolist())

    def _open_rows(self, rows, m, starts, stops, low, kind, fit) -> list[tuple[int, int]]:
        """Those of ``rows`` (first of m tokens in a row) that are open."""
        plain = np.logical_and.reduce([fit[rows + j] for j in range(m)]) if len(rows) else fit[:0]
        own = rows[plain]
        filled = np.zeros(len(own), dtype=bool)

        def letters_of_rows():
            for j in range(m):
                for i in range(int((stops[own + j] - starts[own + j]).max())):
                    p = starts[own + j] + i
                    at = np.flatnonzero((p < stops[own + j]) & (kind[np.minimum(p, len(kind) - 1)] == LETTER))
                    filled[at] = True
                    yield len(own), at, low[p[at]]

        is_open = np.ones(len(rows), dtype=bool)
        if len(own):
            is_open[plain] = self._weighted(letters_of_rows()) | ~filled
        return [(k, m) for k in rows[is_open].tolist()]
