"""Toxicity scores after noisy-channel deobfuscation.

1. A character language model (4-grams over a to z, word boundary and one
   symbol for all other letters, accents folded) is counted over all
   documents: each task sums into one array of 28^4 cells and passes on the
   cells it filled, Spark adds them, and the driver gets at most 28^4 counts.
2. Tokens of other than plain letters become a character lattice: digits and
   signs may stand for letters, an asterisk for any vowel, a letter three or
   more times for one or two, separators for nothing or a word boundary.
   Viterbi decoding under the language model picks the restored spelling.
   Words and bare numbers have one path and stay; the parts of a token between separators are
   decoded besides, as are neighbours of at most ``SHORT`` characters, each
   two and three in a row read as one split word.
3. A logistic model over the words of the restored text and their prefixes
   gives the score.

The classifier is fitted on a bounded sample: at most ``SAMPLE`` labelled
rows of each class, the smallest md5 of their id (the intercept is corrected
for the share taken).  Rows whose crc32(doc_id) mod 3 is 1 are held out.

Defined results: null text is the empty text and gets the score of a text
without words; repeated rows get equal scores; conflicting labels of an id
all count; null labels and ids are never trained on, a null id is not held
out; without rows of both classes every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections import Counter
from itertools import chain, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop_task_state, task_state
from .sift import WIDE_SPACE, Sieve

SYMBOLS = 28  # 0 boundary, 1 to 26 letters, 27 any other letter
ORDER = 4
CELLS = SYMBOLS ** ORDER
SAMPLE = 3000
BUCKETS = 1 << 20
LEVELS = 4
PREFIXES = (3, 4, 5, 6, 7)
WORD_CRC, PREFIX_CRC = zlib.crc32(b"="), zlib.crc32(b"^")
CHARS = 1_000_000
CACHED_TOKENS = 150_000
SHORT = 4
THRESHOLD = 0.7

#: What digits and signs stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
VOWELS = "aeiou"
SEPARATORS = ".-_*~/"
EDGE = " .,;:?\"'()[]{}<>%&#`^=\\"
MARKS = dict.fromkeys(map(ord, set(EDGE + SEPARATORS) - {"*", *LEET}))  # read as nothing or as a boundary
TAIL_RE = re.compile(r"(?:!+|\*+|([$|+])\1\1+)$")
RUN_RE = re.compile(r"(.)\1\1")
SPACED_RE = re.compile(r"^\w(?:[.\-_*~/]+[\w@$!|+]){2,}$")
PART_RE = re.compile(r"[^\W_]+")
SEPARATED_RE = re.compile(r"[.\-_*~/\s]+")


def _symbol_table() -> np.ndarray:
    """Symbol of each code point below U+0250; letters beyond are 'other'."""
    out = np.zeros(0x250, dtype=np.int32)
    for code in range(0x250):
        c = chr(code).lower()
        if c.isalpha():
            base = unicodedata.normalize("NFD", c)[0]
            out[code] = ord(base) - 96 if "a" <= base <= "z" else 27
    return out


SYMBOL = _symbol_table()


def symbol(c: str) -> int:
    """As in ``_symbols``: beyond the table, 'other' below U+2000, else a boundary."""
    return int(SYMBOL[ord(c)]) if ord(c) < len(SYMBOL) else 27 * (ord(c) < 0x2000)


def _symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return np.where(codes < len(SYMBOL), SYMBOL[np.minimum(codes, len(SYMBOL) - 1)], np.where(codes < 0x2000, 27, 0))


def count_into(cells: np.ndarray, text: str, piece: int = 1 << 20) -> None:
    """Add the 4-grams of ``text``; nothing before a word's start is seen."""
    for start in range(0, len(text), piece):
        before, end = text[max(0, start - 3):start], " " if start + piece >= len(text) else ""
        s = _symbols(before + text[start:start + piece] + end)
        s = np.concatenate([np.zeros(3 - len(before), dtype=np.int64), s])
        a = s[2:-1]
        b = np.where(a > 0, s[1:-2], 0)
        c = np.where(b > 0, s[:-3], 0)
        code = ((c * SYMBOLS + b) * SYMBOLS + a) * SYMBOLS + s[3:]
        code = code[(s[3:] > 0) | (a > 0)]
        cells += np.bincount(code[code > 0], minlength=CELLS)


def _count_batches(batches):
    drop_task_state()
    cells = np.zeros(CELLS, dtype=np.int64)
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            texts = [t for t in batch.column("text").slice(start, 256).to_pylist() if t]
            if texts:
                count_into(cells, "\n".join(texts))
    full = np.flatnonzero(cells)
    yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(cells[full])], names=["code", "n"])


class CharModel:
    """Log probability of a symbol after three: interpolated counts of at
    most 28^4 cells, whatever the corpus."""

    def __init__(self, counts: np.ndarray, weight: float = 5.0):
        n = counts.astype(np.float64).reshape((SYMBOLS,) * ORDER)
        p = np.full(SYMBOLS, 1 / SYMBOLS)
        for order in range(1, ORDER + 1):
            part = n.sum(axis=tuple(range(ORDER - order)))
            p = (part + weight * p) / (part.sum(axis=-1, keepdims=True) + weight)
        self.log = np.log(p).astype(np.float32)

    def score(self, word: str) -> float:
        """Log probability of a word and the boundary after it."""
        s, total = (0, 0, 0), 0.0
        for ch in word + " ":
            x = symbol(ch)
            if x or s[2]:
                total += float(self.log[s[0], s[1], s[2], x])
            s = (s[1], s[2], x) if x else (0, 0, 0)
        return total


def language_model(docs: DataFrame) -> CharModel:
    cells = docs.select("text").mapInArrow(_count_batches, "code long, n long").groupBy("code").agg(
        F.sum("n").alias("n"))
    counts = np.zeros(CELLS, dtype=np.int64)
    table = cells.toArrow()  # at most 28^4 rows
    counts[table.column("code").to_numpy()] = table.column("n").to_numpy()
    return CharModel(counts)


def lattice(chars: str, spaced: bool) -> list[list[tuple[str, float]]]:
    """The spellings of each position with their channel costs."""
    out, i = [], 0
    while i < len(chars):
        c, j = chars[i], i
        while j < len(chars) and chars[j] == c:
            j += 1
        run = j - i
        if spaced and (c in SEPARATORS or c == " "):
            out.append([("", -0.1), (" ", -2.3)])
        elif c in LEET:
            subs = LEET[c]
            many = [(x * k, -0.7 * len(subs) - 2 * (k < run)) for x in subs for k in range(1, min(run, 2) + 1)]
            out.append(many + ([] if c.isdigit() else [("", -2.0 * run)]))
        elif c == "*":
            out.append([(v, -1.6) for v in VOWELS])
        elif not c.isalnum():
            out.append([("", -0.7), (" ", -0.7)])
        elif run >= 3:
            out.append([(c, -0.5), (c + c, -0.9)])
        else:
            out += [[(c, 0.0)]] * run
        i = j
    return out


def viterbi(paths: list[list[tuple[str, float]]], model: CharModel) -> str:
    """The best spelling; states are the last three symbols."""
    log = model.log
    best = {(0, 0, 0): (0.0, None)}
    for options in paths + [[(" ", 0.0)]]:
        grown: dict = {}
        for state, (score, trail) in best.items():
            for text, cost in options:
                s, total = state, score + cost
                for ch in text:
                    x = symbol(ch)
                    if x or s[2]:
                        total += float(log[s[0], s[1], s[2], x])
                    s = (s[1], s[2], x) if x else (0, 0, 0)
                if s not in grown or total > grown[s][0]:
                    grown[s] = (total, (trail, text) if text else trail)
        best = grown
    trail, out = max(best.values(), key=lambda v: v[0])[1], []
    while trail:
        trail, text = trail
        out.append(text)
    return "".join(reversed(out)).strip()


def restore(token: str, model: CharModel) -> str:
    """The restored, lower-cased spelling of one token."""
    core = token.lower()
    if core[:-1].isalpha() and not RUN_RE.search(core):  # the common case: a word, perhaps with a full stop
        if core.isalpha():
            return core
        if core[-1] in EDGE:
            return core[:-1]
    core = TAIL_RE.sub("", core.strip(EDGE)).strip(EDGE)
    if not core or core.isalpha() and not RUN_RE.search(core):
        return core
    if SPACED_RE.match(core):
        return viterbi(lattice(core, spaced=True), model)
    if any(c.isalpha() for c in core) or sum(c in LEET and not c.isdigit() for c in core) >= 2:
        return viterbi(lattice(core, spaced=False), model)
    return core


def readings(token: str, model: CharModel) -> list[str]:
    """The words of the restored token, then those of its parts."""
    words = PART_RE.findall(restore(token, model))
    parts = [x for x in SEPARATED_RE.split(token) if x]
    if len(parts) > 1:
        words += [w for x in parts for w in PART_RE.findall(restore(x, model))]
    return list(dict.fromkeys(words))


def neighbours(tokens: list[str]) -> set[str]:
    """Short neighbours, two and three in a row, as one spaced key each."""
    split, a, b = set(), "", ""
    for c in tokens:
        if len(c) > SHORT:
            a = b = ""
            continue
        if b and len(b) + len(c) > 2:
            split.add(f"{b} {c}")
            if a:
                split.add(f"{a} {b} {c}")
        a, b = b, c
    return split


def spaced_words(tokens: list[str], known: Tokens) -> set[str]:
    """Words of three or more single characters in a row, decoded as one
    spaced-out stretch."""
    out: set[str] = set()
    single = [i for i, t in enumerate(tokens) if len(t) == 1]
    i = 0
    while i < len(single):
        j = i
        while j + 1 < len(single) and single[j + 1] == single[j] + 1:
            j += 1
        if j - i >= 2:
            joined = " ".join(tokens[single[i]:single[j] + 1]).lower()
            out.update(known.chosen(PART_RE.findall(viterbi(lattice(joined, spaced=True), known.model))))
        i = j + 1
    return out


def restored_words(text: str, known: Tokens) -> set[str]:
    """Distinct restored words that ``known`` returns for the tokens.  Short
    neighbours are decoded as one split word besides, and single characters
    in a row as one stretch."""
    tokens = text.split()
    out = set().union(*map(known.__getitem__, set(tokens))) if tokens else set()
    out.update(*map(known.split.__getitem__, neighbours(tokens)))
    return out | spaced_words(tokens, known)


def one_word(segments: list[str], model: CharModel) -> bool:
    """Whether the language model reads segments of letters rather as one
    word than as any sequence of several."""
    best = [0.0]  # of the first j segments, the whole in one word left out
    for j in range(1, len(segments) + 1):
        starts = range(0 if j < len(segments) else 1, j)
        best.append(max((best[i] + model.score("".join(segments[i:j])) for i in starts), default=-np.inf))
    return model.score("".join(segments)) >= best[-1]


class Splits(dict):
    """Neighbours -> the word that they are, if they read as one; emptied
    when full.

    The word can only be one of the readings without a boundary, so these are
    looked up first; without evidence in them there is nothing to decode.
    Letters have one such reading, and the language model compares the
    spellings of neighbours of letters without a lattice.
    """

    def __init__(self, tokens: Tokens):
        super().__init__()
        self.tokens = tokens

    def __missing__(self, key):
        if len(self) >= CACHED_TOKENS:
            self.clear()
        words = self[key] = self.word(key.lower())
        return words

    def word(self, key: str) -> tuple:
        tokens = self.tokens
        letters = key.replace(" ", "")
        if letters.isalpha() and not RUN_RE.search(key) and not tokens.possible((letters,)):
            return ()  # nearly all neighbours
        if not all(any(c.isalpha() or c in LEET for c in x) for x in key.split(" ")):
            return ()
        core = TAIL_RE.sub("", key.strip(EDGE)).strip(EDGE)
        segments = PART_RE.findall(core)
        if "*" not in core and not RUN_RE.search(core) and all(map(str.isalpha, segments)) and LEET.keys().isdisjoint(core):
            found = tokens.chosen(("".join(segments),))
            return found if found and one_word(segments, tokens.model) else ()
        if not tokens.possible(joined_readings(core)):
            return ()
        words = PART_RE.findall(restore(core, tokens.model))
        return tokens.chosen(words) if len(words) == 1 else ()


def joined_readings(core: str, most: int = 64) -> list[str] | None:
    """The readings of a token without a boundary; None: more than ``most``."""
    options = [[text for text, _ in o if text != " "] for o in lattice(core, spaced=False)]
    if np.prod([float(len(o)) for o in options]) > most:
        return None
    return ["".join(x) for x in product(*options)]


class Tokens(dict):
    """token -> its restored words; emptied when full."""

    def __init__(self, model: CharModel):
        super().__init__()
        self.model, self.split = model, Splits(self)

    def chosen(self, words):
        return tuple(words)

    def possible(self, readings) -> bool:
        return True

    def __missing__(self, token):
        if len(self) >= CACHED_TOKENS:
            self.clear()
        words = self[token] = self.chosen(readings(token, self.model))
        return words


class Features(dict):
    """word -> hashed features: the word and its prefixes, one for each
    level of repetition."""

    def __missing__(self, word):
        if len(self) >= CACHED_TOKENS:
            self.clear()
        names = ["=" + word] + ["^" + word[:k] for k in PREFIXES if len(word) >= k]
        ids = self[word] = tuple(zlib.crc32(x.encode("utf-8")) % (BUCKETS // LEVELS) * LEVELS for x in names)
        return ids


class Evidence(Tokens):
    """token -> those of its restored words that have a weighted feature."""

    def __init__(self, model: CharModel, weights: dict[int, float], bias: float):
        super().__init__(model)
        self.weights, self.bias = weights, bias
        self.based = {k - k % LEVELS for k in weights}
        self.cells = {k // LEVELS for k in weights}
        mask = np.zeros(BUCKETS // LEVELS, dtype=bool)
        mask[list(self.cells)] = True
        self.sieve = Sieve(mask, EDGE, map(chr, MARKS), PREFIXES, SHORT)
        self.table, self.hits = Features(), {}

    def weighted(self, word: str) -> bool:
        """Whether a feature of ``word`` has weight: as ``Features`` names
        them, with the CRC of a prefix carried on to the next one."""
        cells, crc = self.cells, zlib.crc32
        if crc(word.encode(), WORD_CRC) % (BUCKETS // LEVELS) in cells:
            return True
        shortest = PREFIXES[0]
        if len(word) < shortest:
            return False
        c = crc(word[:shortest].encode(), PREFIX_CRC)
        if c % (BUCKETS // LEVELS) in cells:
            return True
        for ch in word[shortest:PREFIXES[-1]]:
            c = crc(ch.encode(), c)
            if c % (BUCKETS // LEVELS) in cells:
                return True
        return False

    def chosen(self, words):
        out = []
        for w in words:
            if self.weighted(w):
                self.hits[w] = tuple(k for k in self.table[w] if k in self.based)  # few words have weight
                out.append(w)
        return tuple(out)

    def possible(self, readings) -> bool:
        """Whether one of ``readings`` may have a weighted feature."""
        return readings is None or any(map(self.weighted, readings))

    def _odds(self, words: set[str]) -> float:
        found = Counter(chain.from_iterable(map(self.hits.__getitem__, words)))
        return self.bias + sum(self.weights.get(k + i, 0.0) for k, n in sorted(found.items())
                               for i in range(min(n, LEVELS)))

    def log_odds(self, text: str) -> float:
        return self._odds(restored_words(text, self))

    def log_odds_many(self, texts: list[str]) -> list[float]:
        """``log_odds`` of texts of together ``CHARS`` characters at a time:
        only tokens and neighbours that the sieve leaves open are looked up."""
        out, block, size = [], [], 0
        for i, t in enumerate(texts):
            block.append(t)
            size += len(t)
            if size >= CHARS or i + 1 == len(texts):
                words: list[set] = [set() for _ in block]
                wide = {k for k, x in enumerate(block) if not x.isascii() and WIDE_SPACE.search(x)}
                tokens, split, spaced = self.sieve.open(["" if k in wide else x for k, x in enumerate(block)])
                for k, token in tokens:
                    words[k].update(self[token])
                for k, key in split:
                    words[k].update(self.split[key])
                for k in spaced:
                    words[k].update(spaced_words(block[k].split(), self))
                for k in wide:
                    words[k] = restored_words(block[k], self)
                out += map(self._odds, words)
                block, size = [], 0
        return out


def features(text: str, tokens: Tokens, table: Features) -> list[int]:
    """Hashed features of a text: level i of a feature is present when more
    than i of the text's distinct words have it."""
    found = Counter(chain.from_iterable(map(table.__getitem__, restored_words(text, tokens))))
    return sorted(k + i for k, n in found.items() for i in range(min(n, LEVELS)))


def fit(flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, taken: np.ndarray,
        rounds: int = 400) -> tuple[dict[int, float], float]:
    """Logistic weights of the features whose frequency differs clearly
    between the classes, and the intercept.  ``flat`` holds the features of
    all rows in turn, ``sizes`` how many each has; ``taken``: the share of the
    labelled rows of class 0 and 1 in the sample."""
    pos, neg = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    p = np.bincount(flat[y[row] == 1], minlength=BUCKETS).astype(np.float64)
    n = np.bincount(flat, minlength=BUCKETS) - p
    a, b = p / pos, n / neg
    spread = np.sqrt((p + 1) / pos ** 2 + (n + 1) / neg ** 2)
    chosen = np.flatnonzero((np.abs(a - b) > 4 * spread) & (p + n >= 4))
    column = np.full(BUCKETS, -1)
    column[chosen] = np.arange(len(chosen))
    keep = column[flat] >= 0
    r, c = row[keep], column[flat[keep]]
    w, bias = np.zeros(len(chosen)), float(np.log(pos / neg))
    rate = np.where(y == 1, 0.5 / pos, 0.5 / neg) * len(y)  # balanced while fitting
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, rounds + 1):  # Adam, full batch
        z = bias + np.bincount(r, weights=w[c], minlength=len(y))
        error = rate * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.append(np.bincount(c, weights=error[r], minlength=len(chosen)) / len(y) + 1e-4 * w, error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    prior = np.log((pos / taken[1]) / (neg / taken[0]))
    return dict(zip(chosen.tolist(), w.tolist())), float(bias + 0.5 * prior)


def _shares(labels: DataFrame) -> dict[int, int]:
    return {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, model: CharModel, sample: int = SAMPLE):
    """(weights, intercept), or None without rows of both classes."""
    spark = docs.sparkSession
    usable = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .where("doc_id IS NOT NULL AND toxic IN (0, 1)").distinct().where(~_held_out(F.col("doc_id"))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    usable = texts.select("doc_id").distinct().join(usable, "doc_id")
    total = _shares(usable)
    if len(total) < 2:
        return None
    order = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]
    picked = usable.where("toxic = 0").orderBy(*order).limit(sample).unionByName(
        usable.where("toxic = 1").orderBy(*order).limit(sample))  # at most 2 * sample ids
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        tokens, table = Tokens(shared.value), Features()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = [features(t or "", tokens, table) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.list_(pa.int32())), part.column("toxic"), part.column("doc_id")],
                    names=["ids", "toxic", "doc_id"])

    rows = (texts.join(F.broadcast(picked), "doc_id").select("text", "toxic", "doc_id").dropDuplicates()
            .mapInArrow(run, "ids array<int>, toxic int, doc_id long").toArrow())
    rows = rows.sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    if not rows.num_rows:
        return None
    ids = rows.column("ids").combine_chunks()
    sizes = np.diff(ids.offsets.to_numpy())
    y = rows.column("toxic").to_numpy().astype(np.float64)
    return fit(ids.flatten().to_numpy(), sizes, y, np.array([min(1.0, sample / total[k]) for k in (0, 1)]))


def _evidence(docs: DataFrame, labels: DataFrame, sample: int):
    """Broadcast model and weights, trained on ``docs`` and ``labels``."""
    bounded_batches(docs.sparkSession)
    model = language_model(docs)
    weights, bias = train(docs, labels, model, sample) or ({}, -np.inf)
    return docs.sparkSession.sparkContext.broadcast(Evidence(model, weights, bias))


def _scores(shared, texts: list) -> np.ndarray:
    evidence = task_state(shared.value, lambda: shared.value)
    return np.exp(-np.logaddexp(0.0, -np.array(evidence.log_odds_many([t or "" for t in texts]))))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE,
                    threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, text_md5: one row per input row."""
    shared = _evidence(docs, labels, sample)
    schema = "doc_id long, score double, text_md5 string"

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(_scores(shared, texts)),
                     pa.array([hashlib.md5((t or "").encode("utf-8")).hexdigest() for t in texts])],
                    names=["doc_id", "score", "text_md5"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "text_md5")


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic; all columns
    are kept, whatever their names.  The task that scores a row drops it, so
    rows are not moved and rows without id are judged too."""
    shared = _evidence(docs, labels, sample)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                scores = _scores(shared, part.column(0).field(at).to_pylist())
                yield part.filter(pa.array(scores < threshold))

    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(run, rows.schema).select("row.*")
