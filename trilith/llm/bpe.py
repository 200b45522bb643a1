r"""Byte-level BPE by a tokenization automaton.

The merges are compiled by successive merge gadgets.  The automaton starts
with one state that loops on every byte.  Merge k of (u, v) copies the state
that u leads to, takes v from the copy, leads u there, and adds an arc uv,
parallel to u and v in sequence, to where v led.  Every label has one target
state, so a state is known by the last label, and a copy differs from its
origin by the labels taken away.  It is therefore stored as the gadgets
``(u, v) -> k`` alone: label y may follow label x unless a gadget that was
made while both ends still looked like (x', y') took the arc away, where x'
runs through x and its right parts and y' through y and its left parts.  A
merge whose v cannot follow u any more gets no gadget and no label.  The arcs
met while encoding are kept in a table.

Encoding reads a pre-split word byte by byte.  A second table (an
Aho-Corasick automaton over the labels) gives the labels that end at each
byte, longest first; exactly one of them can follow the label that the prefix
before it ends with.  Decoding emits the labels of the arcs.

Defined results: a null text is the empty text (no tokens); rows are
independent, so ties, repeated rows, null ids and extra columns do not
matter; whole texts of any length are encoded.  Strings of special tokens in
a text become their ids, as the tokenizer file says.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import bounded_batches, task_state

#: Fixed value: the public byte-level pre-split pattern.
SPLIT_PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_WORDS = 100_000
CHARS = 2_000_000  # bytes of text whose words are encoded together
LONG_WORD = 64  # bytes; longer words are read alone
CACHED_ARCS = 2_000_000
NEVER = 1 << 60


def byte_chars() -> dict[str, int]:
    """The printable stand-ins of bytes in a tokenizer file: printable Latin-1
    bytes stand for themselves, the others are moved past U+00FF in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """Transitions met so far: integer keys to values >= 0, many looked up at
    once (open addressing); missing ones are computed and kept."""

    def __init__(self, compute, bits: int = 18):
        self.compute = compute
        self._empty(bits)

    def _empty(self, bits: int) -> None:
        self.shift, self.mask, self.filled = np.uint64(64 - bits), (1 << bits) - 1, 0
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << bits, dtype=np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _probe(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        for k, slot, v in zip(keys.tolist(), self._slots(keys).tolist(), values.tolist()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.values[slot] = k, v
        self.filled += len(keys)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = self._probe(keys)
        miss = out < 0
        if miss.any():
            new = np.unique(keys[miss])
            values = np.array([self.compute(k) for k in new.tolist()], dtype=np.int32)
            out[miss] = values[np.searchsorted(new, keys[miss])]
            bits = (self.mask + 1).bit_length() - 1
            if (self.filled + len(new)) * 3 > self.mask:
                old, kept = self.keys[self.keys >= 0], self.values[self.keys >= 0]
                grow = self.filled < CACHED_ARCS
                while (self.filled * grow + len(new)) * 3 >= 1 << bits:
                    bits += 1
                self._empty(bits)
                if grow:
                    self._insert(old, kept)
            self._insert(new, values)
        return out


class Automaton:
    def __init__(self, labels: dict[int, bytes], merges: list[tuple[bytes, bytes]], specials: dict[str, int]):
        self.labels, self.specials = labels, specials
        self.stride = max(labels, default=0) + 1
        ids = {v: k for k, v in labels.items()}
        self.born = {ids[bytes([b])]: 0 for b in range(256)}
        self.parts: dict[int, tuple[int, int]] = {}
        self.gadgets: dict[int, int] = {}
        self.arcs: dict[int, bool] = {}
        for k, (a, b) in enumerate(merges, 1):
            u, v, w = ids[a], ids[b], ids[a + b]
            if u in self.born and v in self.born and w not in self.born and self.follows(u, v):
                self.gadgets[u * self.stride + v] = k
                self.born[w], self.parts[w] = k, (u, v)
        self._suffix_tables()

    def follows(self, x: int, y: int) -> bool:
        """Whether the state that x leads to has an arc y."""
        born, tx, ty = self.born, NEVER, NEVER
        while True:
            k = self.gadgets.get(x * self.stride + y)
            if k is not None and k < tx and k <= ty:
                return False
            bx, by = born[x], born[y]
            if bx > by:
                tx, x = bx, self.parts[x][1]
            elif by:
                ty, y = by, self.parts[y][0]
            else:
                return True

    def _suffix_tables(self) -> None:
        goto, depth, ends = [{}], [0], [-1]
        for t in self.born:
            node = 0
            for c in self.labels[t]:
                nxt = goto[node].get(c)
                if nxt is None:
                    nxt = goto[node][c] = len(goto)
                    goto.append({})
                    depth.append(depth[node] + 1)
                    ends.append(-1)
                node = nxt
            ends[node] = t
        fail, link = [0] * len(goto), [0] * len(goto)
        queue = deque(goto[0].values())
        while queue:
            node = queue.popleft()
            for c, nxt in goto[node].items():
                f = fail[node]
                while f and c not in goto[f]:
                    f = fail[f]
                fail[nxt] = goto[f][c] if depth[nxt] > 1 else 0
                queue.append(nxt)
            link[node] = fail[node] if ends[fail[node]] >= 0 else link[fail[node]]
        self.goto = {node << 8 | c: nxt for node, row in enumerate(goto) for c, nxt in row.items()}
        self.fail, self.link, self.ends, self.depth = fail, link, ends, depth

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        goto, fail, link, ends, depth = self.goto, self.fail, self.link, self.ends, self.depth
        arcs, stride = self.arcs, self.stride
        if len(arcs) > CACHED_ARCS:
            arcs.clear()
        last, node = [], 0
        for i, c in enumerate(word, 1):
            while (nxt := goto.get(node << 8 | c)) is None:
                node = fail[node]
            node = nxt
            at = node if ends[node] >= 0 else link[node]
            while True:
                t, j = ends[at], i - depth[at]
                if j == 0:
                    break
                arc = last[j - 1] * stride + t
                ok = arcs.get(arc)
                if ok is None:
                    ok = arcs[arc] = self.follows(last[j - 1], t)
                if ok:
                    break
                at = link[at]
            last.append(t)
        out, i = [], len(word)
        while i:
            t = last[i - 1]
            out.append(t)
            i -= len(self.labels[t])
        return tuple(out[::-1])


def load_automaton(path: str) -> Automaton:
    """Compile a byte-level BPE tokenizer file (JSON)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
        raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
    chars = byte_chars()
    raw = lambda s: bytes(chars[c] for c in s)
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    labels = {i: raw(s) for s, i in model["vocab"].items() if s not in specials}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return Automaton(labels, [(raw(a), raw(b)) for a, b in pairs], specials)


class Codec:
    """Encoder of many texts at once with a bounded table of words, and decoder."""

    def __init__(self, automaton: Automaton):
        self.automaton = a = automaton
        self.words: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(SPLIT_PATTERN).findall
        self.cut = None
        if a.specials:
            some = sorted(a.specials, key=len, reverse=True)
            self.cut = regex.compile("(" + "|".join(map(regex.escape, some)) + ")").split
        self.labels = dict(a.labels)
        self.labels.update({i: s.encode("utf-8") for s, i in a.specials.items()})
        self.names = {i: str(i) for i in self.labels}
        self.ends, self.link, self.depth = (np.array(x, dtype=np.int64) for x in (a.ends, a.link, a.depth))
        self.longest = np.where(self.ends >= 0, np.arange(len(self.ends)), self.link)
        self.size = np.zeros(a.stride, dtype=np.int64)
        for i, s in a.labels.items():
            self.size[i] = len(s)
        self.moves = Table(self._move)
        self.arcs = Table(lambda k: int(a.follows(*divmod(k, a.stride))))

    def _move(self, key: int) -> int:
        a, (node, c) = self.automaton, divmod(key, 256)
        while (nxt := a.goto.get(node << 8 | c)) is None:
            node = a.fail[node]
        return nxt

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The labels of each word (at most LONG_WORD bytes): one step of all
        words at a time, longest words first."""
        size = np.array([len(w) for w in words])
        order = np.argsort(-size, kind="stable")
        width, n = int(size.max()), len(words)
        chars = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in order), dtype=np.uint8)
        chars = chars.reshape(n, width).T.astype(np.int64)
        active = np.searchsorted(-size[order], -np.arange(1, width + 1), side="right")
        last = np.zeros((width + 1, n), dtype=np.int32)
        node = np.zeros(n, dtype=np.int64)
        for i in range(1, width + 1):
            m = active[i - 1]
            node = self.moves.get(node[:m] << 8 | chars[i - 1, :m]).astype(np.int64)
            at, todo = self.longest[node], np.arange(m)
            while len(todo):
                label, start = self.ends[at], i - self.depth[at]
                ok = start == 0
                inner = np.flatnonzero(~ok)
                arc = last[start[inner], todo[inner]].astype(np.int64) * self.automaton.stride + label[inner]
                ok[inner] = self.arcs.get(arc) == 1
                last[i, todo[ok]] = label[ok]
                at, todo = self.link[at[~ok]], todo[~ok]
        left, rows = size[order], np.arange(n)
        steps = []
        while len(rows):
            label = last[left, rows]
            steps.append((rows, label))
            left = left - self.size[label]
            rows, left = rows[left > 0], left[left > 0]
        rows, labels = (np.concatenate(x[::-1]) for x in zip(*steps))
        rows = order[rows]
        flat = labels[np.argsort(rows, kind="stable")].tolist()
        stops = np.cumsum(np.bincount(rows, minlength=n)).tolist()
        return [tuple(flat[i:j]) for i, j in zip([0, *stops], stops)]

    def _learn(self, words: set[str]) -> None:
        new = words.difference(self.words)
        if len(self.words) + len(new) > CACHED_WORDS:
            self.words.clear()
            new = words
        raw = [(w, w.encode("utf-8")) for w in new]
        short = [x for x in raw if len(x[1]) <= LONG_WORD]
        if short:
            self.words.update(zip([w for w, _ in short], self.encode_words([b for _, b in short])))
        self.words.update((w, self.automaton.encode_word(b)) for w, b in raw if len(b) > LONG_WORD)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        specials = self.automaton.specials
        pieces = [self.cut(t) if any(s in t for s in specials) else [t] for t in texts]
        split = [[[p] if p in specials else self.split(p) for p in ps] for ps in pieces]
        self._learn(set(chain.from_iterable(chain.from_iterable(split))).difference(specials))
        known = {**self.words, **{s: (i,) for s, i in specials.items()}} if any(len(p) > 1 for p in pieces) else self.words
        return [list(chain.from_iterable(map(known.__getitem__, chain.from_iterable(ps)))) for ps in split]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", errors="replace")

    def joined(self, ids) -> str:
        return ",".join(map(self.names.__getitem__, ids))


def _digests(codec: Codec, ids: list[int]) -> tuple[int, str, str]:
    return (len(ids), hashlib.sha256(codec.joined(ids).encode()).hexdigest(),
            hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest())


def _slices(batch):
    """(ids, texts) of consecutive rows that hold CHARS characters or one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + CHARS, side="right")))
        yield (batch.column("doc_id").slice(start, stop - start),
               [t or "" for t in batch.column("text").slice(start, stop - start).to_pylist()])
        start = stop


def encode_documents(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """Encode and decode ``text``: doc_id, n_tokens with ids (array<int>) and
    decoded text, or with ``digests`` their SHA-256 instead.

    The compiled tables go to the tasks by broadcast; their size is that of
    the vocabulary.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_automaton(path))
    schema = ("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests
              else "doc_id long, n_tokens long, ids array<int>, decoded string")

    def run(batches):
        codec = task_state(shared.value, lambda: Codec(shared.value))
        for batch in batches:
            for doc_ids, part in _slices(batch):
                ids = codec.encode_batch(part)
                if digests:
                    cols = list(zip(*[_digests(codec, x) for x in ids]))
                    types = [pa.int64(), pa.string(), pa.string()]
                else:
                    cols = [[len(x) for x in ids], ids, [codec.decode(x) for x in ids]]
                    types = [pa.int64(), pa.list_(pa.int32()), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types))],
                    names=[c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
