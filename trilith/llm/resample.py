"""Importance resampling towards a target corpus, on hashed n-gram features.

Features are the runs of one and two words of a text; a feature's bucket is
the CRC-32 of its bytes modulo ``BUCKETS``.  Exact bucket totals of the raw
and of the target table give every bucket a gain; a document's weight is its
mean gain, and Gumbel noise from its id turns the highest weights into a
sample without replacement.

Buckets come from a head-tail vocabulary.  The head holds the words that make
up at least one in ``HEAD`` of all words (so at most ``HEAD`` of them, each of
at most ``LONGEST`` bytes) with their exact CRC states: the CRC of the word
and that of the word and a space, from which a pair's CRC follows by two
table steps.  Frequent pairs have their bucket ready in a table of one probe.
Words that the head lacks, and pairs with one, take the direct CRC.  Which
pairs are in the table changes nothing but time: a task proposes those above
the same share of its own words, so none that is frequent everywhere is
missed.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored, task_state
from .ranks import in_order, positions

#: Fixed values of the sampler.
BUCKETS, SEED, PERCENT, MIN_WORDS = 10_000, 7, 25, 20
HEAD = 50_000
LONGEST = 64  # bytes of a head word
PAIR_BITS = 18  # the pair table has 2 ** PAIR_BITS cells
CHARS = 2_000_000  # bytes of text taken together
COUNTED = 500_000  # words or pairs counted before partial counts are sent on
DENSE = 5_000  # a document with more features keeps (bucket, count)

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8, A-Z in lower case."""
    return text.translate(_WORDS).split()


def _blocks(batch, *names):
    """(texts, other columns) of consecutive rows that hold CHARS bytes or one row."""
    text = batch.column("text")
    size = 0
    start = 0
    raw = [(t or "").encode("utf-8") for t in text.to_pylist()]
    for i, t in enumerate(raw):
        size += len(t)
        if size >= CHARS or i + 1 == len(raw):
            yield raw[start:i + 1], [batch.column(n).slice(start, i + 1 - start) for n in names]
            start, size = i + 1, 0


class Shift:
    """CRC-32 register moved over up to ``LONGEST`` following bytes."""

    def __init__(self):
        step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)
        now = np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], dtype=np.uint32)[:, None]
        tables = [now]
        for _ in range(LONGEST):
            now = (now >> np.uint32(8)) ^ step[now & np.uint32(255)]
            tables.append(now)
        self.tables = np.stack(tables)

    def joined(self, first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
        """CRC of two parts from the CRC of each and the bytes of the second."""
        out = second.copy()
        for k in range(4):
            out ^= self.tables[size, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
        return out


class Vocabulary:
    """Bucket look-up of features with a head of ``words`` and frequent
    ``pairs`` (first * len(words) + second)."""

    def __init__(self, words: list[bytes], pairs: np.ndarray):
        self.ids = {w: i for i, w in enumerate(words)}
        self.crc = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
        self.state = np.array([zlib.crc32(b" ", zlib.crc32(w)) for w in words], dtype=np.uint32)
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        self.bucket = (self.crc % np.uint32(BUCKETS)).astype(np.uint16)
        self.shift = Shift()
        self.n = max(1, len(words))
        self.keys = np.full(1 << PAIR_BITS, -1, dtype=np.int64)
        self.keys[self._cell(pairs)] = pairs
        held = np.flatnonzero(self.keys >= 0)
        self.values = np.zeros(1 << PAIR_BITS, dtype=np.uint16)
        self.values[held] = self._by_state(*np.divmod(self.keys[held], self.n))

    def _cell(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def _by_state(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(a):
            return np.zeros(0, dtype=np.uint16)
        return (self.shift.joined(self.state[a], self.crc[b], self.size[b]) % np.uint32(BUCKETS)).astype(np.uint16)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Head numbers of words, -1 for the tail."""
        return np.fromiter(map(self.ids.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def features(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of every word, and of every word with its successor."""
        if not words:
            return np.zeros(0, dtype=np.uint16), np.zeros(0, dtype=np.uint16)
        at = self.places(words)
        ones = np.zeros(len(words), dtype=np.uint16)
        known = at >= 0
        if len(self.bucket):
            ones[known] = self.bucket[at[known]]
        tail = np.flatnonzero(~known)
        crc = zlib.crc32
        ones[tail] = [crc(words[i]) % BUCKETS for i in tail.tolist()]
        twos = np.zeros(len(words) - 1, dtype=np.uint16)
        both = np.flatnonzero(known[:-1] & known[1:])
        a, b = at[both], at[both + 1]
        key = a * self.n + b
        cell = self._cell(key)
        ready = self.keys[cell] == key
        twos[both[ready]] = self.values[cell[ready]]
        twos[both[~ready]] = self._by_state(a[~ready], b[~ready])
        rest = np.flatnonzero(~(known[:-1] & known[1:]))
        twos[rest] = [crc(words[i] + b" " + words[i + 1]) % BUCKETS for i in rest.tolist()]
        return ones, twos


def _word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): exact counts of all words, summed in the tasks first."""
    def run(batches):
        count: Counter = Counter()

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.binary()),
                                               pa.array(count.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for texts, _ in _blocks(batch):
                for t in texts:
                    count.update(words_of(t))
                if len(count) > COUNTED:
                    yield sent()
                    count.clear()
        if count:
            yield sent()
    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pair_counts(docs: DataFrame, shared) -> DataFrame:
    """(pair, n) of head words: those above one in ``HEAD`` of the words that a
    task has seen together."""
    def run(batches):
        vocabulary = task_state(shared.value, lambda: Vocabulary(*shared.value))
        held, size = [], 0

        def sent():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(2, size / HEAD)
            return pa.RecordBatch.from_arrays([pa.array(keys[often]), pa.array(n[often].astype(np.int64))],
                                              names=["pair", "n"])
        for batch in batches:
            for texts, _ in _blocks(batch):
                for words in map(words_of, texts):
                    at = vocabulary.places(words)
                    both = (at[:-1] >= 0) & (at[1:] >= 0)
                    held.append(at[:-1][both] * vocabulary.n + at[1:][both])
                    size += len(words)
                if size > 8 * COUNTED:
                    yield sent()
                    held, size = [], 0
        if size:
            yield sent()
    return docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame):
    """Broadcast (head words, frequent pairs): at most ``HEAD`` words, as each
    holds one in ``HEAD`` of all, and as many pairs."""
    spark = docs.sparkSession
    counts = stored(_word_counts(docs), "resample-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    head = counts.where((F.col("n") * HEAD >= total) & (F.octet_length("word") <= LONGEST)).select("word")
    words = sorted(bytes(r[0]) for r in head.collect())
    shared = spark.sparkContext.broadcast((words, np.zeros(0, dtype=np.int64)))
    pairs = [r[0] for r in _pair_counts(docs, shared).where(F.col("n") * HEAD >= total).select("pair").collect()]
    return spark.sparkContext.broadcast((words, np.array(sorted(pairs), dtype=np.int64)))


FEATURES = "doc_id long, n_words long, n_features long, buckets binary, counts binary"


def features(docs: DataFrame, shared) -> DataFrame:
    """One row per document: its buckets (16 bit each), either one for every
    feature or, for long texts, distinct ones with 64-bit ``counts``."""
    def run(batches):
        vocabulary = task_state(shared.value, lambda: Vocabulary(*shared.value))
        for batch in batches:
            for texts, (ids,) in _blocks(batch, "doc_id"):
                words = [words_of(t) for t in texts]
                ones, twos = vocabulary.features([w for ws in words for w in ws])
                sizes, buckets, counts, at = [len(ws) for ws in words], [], [], 0
                for n in sizes:
                    own = np.concatenate([ones[at:at + n], twos[at:at + max(0, n - 1)]])
                    at += n
                    often = b""
                    if len(own) > DENSE:
                        own, n_own = np.unique(own, return_counts=True)
                        often = n_own.astype("<i8").tobytes()
                    buckets.append(own.astype("<u2").tobytes())
                    counts.append(often)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sizes, pa.int64()), pa.array([max(0, 2 * n - 1) for n in sizes], pa.int64()),
                     pa.array(buckets, pa.binary()), pa.array(counts, pa.binary())],
                    names=[c.split()[0] for c in FEATURES.split(", ")])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FEATURES)


def _row_features(batch):
    for b, c in zip(batch.column("buckets"), batch.column("counts")):
        own, often = np.frombuffer(b.as_buffer(), dtype="<u2"), np.frombuffer(c.as_buffer(), dtype="<i8")
        yield own, often if len(often) else None


def totals(table: DataFrame) -> np.ndarray:
    """Features in each bucket, exactly: each task sends at most ``BUCKETS``
    sums, the driver gets ``BUCKETS``."""
    def run(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            plain = []
            for own, often in _row_features(batch):
                if often is None:
                    plain.append(own)
                else:
                    total[own] += often
            if plain:
                total += np.bincount(np.concatenate(plain), minlength=BUCKETS)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])
    out = np.zeros(BUCKETS, dtype=np.int64)
    rows = table.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket")
    for r in rows.agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of a bucket's smoothed share in the target over
    that in the raw table, rounded down."""
    s, t = float(raw.sum()), float(target.sum())
    return np.floor(1000 * np.log((target + 1.0) * (s + BUCKETS) / ((raw + 1.0) * (t + BUCKETS)))).astype(np.int64)


def weights(table: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the mean gain, rounded down."""
    shared = table.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        for batch in batches:
            sums = [int((shared.value[own] if often is None else shared.value[own] * often).sum())
                    for own, often in _row_features(batch)]
            n = batch.column("n_features").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"),
                 pa.array([s // k if k else 0 for s, k in zip(sums, n)], pa.int64())],
                names=["doc_id", "n_words", "n_features", "weight"])
    return table.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED,
             min_words: int = MIN_WORDS) -> DataFrame:
    """Every document with its weight, score and rank in the draw.

    doc_id, n_features, weight, score, rank (from 1; null when not drawn), all
    long; n_words follows.  Of the documents with at least ``min_words`` words
    the ``percent`` per cent with the highest scores are drawn, ties to the
    smaller doc_id, null ids last (their noise is that of an empty id).  One
    row per input row; repeated rows have equal scores and follow each other.
    Null text is the empty text: no features, weight 0.  Without documents the
    result is empty; without target features all gains come from the smoothing
    alone.  Extra columns are ignored.  Texts stay where they are: the tasks
    exchange counts, and the ranks are found on (score, doc_id) alone.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = vocabulary(docs)
    table = stored(features(docs, shared), "resample-features")
    goal = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), shared)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
                                  256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weights(table, gains(totals(table), totals(goal)))
    scored = scored.withColumn("score", F.col("weight") + noise).withColumn("_in", F.col("n_words") >= min_words)
    placed = in_order(stored(scored.withColumn("_row", F.monotonically_increasing_id()), "resample-scores"),
                      [F.col("_in").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(),
                       F.col("n_features"), F.col("weight"), F.col("_row")], "resample-order")
    drawn = placed.where("_in").count() * percent // 100
    ranked = positions(placed, [], "resample-cells")
    rank = F.col("rank") + 1
    return ranked.select("doc_id", "n_features", "weight", "score",
                         F.when(rank <= F.lit(drawn), rank).alias("rank"), "n_words")
