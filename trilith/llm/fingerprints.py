"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A fingerprint holds the ``k`` smallest distinct 48-bit hashes of a text's
five-word shingles (a shorter text is one shingle).  It is mergeable: the
union of the parts' hashes, cut to the k smallest, is the sketch of all
their shingles.  Sketches that hold fewer than k hashes are the whole set, so
estimates from them are exact; otherwise the standard error of a resemblance
is at most 1 / (2 sqrt(k)).

Written form: the hashes in increasing order, six big-endian bytes each, as
base64; the empty string for an empty set.

Defined results: null text is the empty text; two empty sets resemble each
other fully (1.0), an empty and a non-empty one not at all (0.0).
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions
from .shingles import hashed_words, shingles

WIDTH, K, BITS = 5, 128, 48
ROWS = 256  # rows hashed at once


def sketch(values: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, cut to 48 bits, of ``values``."""
    values = values >> np.uint64(64 - BITS)
    if len(values) > 8 * k:  # the bulk cannot be among the k smallest
        low = np.uint64(min(2 ** BITS - 1, 2 ** BITS // len(values) * 4 * k))
        part = np.unique(values[values <= low])
        if len(part) >= k:
            return part[:k]
    return np.unique(values)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of both sets."""
    return np.union1d(a, b)[:k]


def distinct_count(s: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(s)) if len(s) < k else (k - 1) * float(2 ** BITS) / (float(s[k - 1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity: the share of the union's sketch that is
    in both."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(both <= union[-1])) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    union = distinct_count(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct_count(a, k)) if len(b) else 0.0


def written(s: np.ndarray) -> str:
    raw = s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
    return base64.b64encode(raw).decode()


def read_sketch(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).copy().view(">u8").ravel().astype(np.uint64)


def sketches(texts: list[bytes], width: int = WIDTH, k: int = K) -> list[np.ndarray]:
    s, n = shingles(*hashed_words(texts), width)
    return [sketch(x, k) for x in np.split(s, np.cumsum(n)[:-1])] if texts else []


def _search(value: Column, cuts: list, lo: int, hi: int) -> Column:
    """Number of ``cuts`` not above ``value``: a binary search as one expression."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(value < F.lit(cuts[mid]), _search(value, cuts, lo, mid)).otherwise(
        _search(value, cuts, mid + 1, hi))


def in_order(docs: DataFrame, n: int) -> DataFrame:
    """Rows of (doc_id, text) dealt into ``n`` ranges of doc_id, column
    ``_range``; each range also gets, marked ``_guest``, the row that follows
    its last one in descending order, and the last range the very first.

    Only ids are read to find the ranges; the driver gets at most n cut
    points and n greatest ids.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = sorted(set(rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    cuts = [int(c) for c in cuts]
    spot = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_search(F.col("doc_id"), cuts, 0, len(cuts)))
    heads = (rows.select("doc_id", spot.alias("_range")).groupBy("_range").agg(F.max("doc_id").alias("_head"))
             .orderBy("_range").collect())
    after = {}
    for i, r in enumerate(heads):
        target = heads[i + 1] if i + 1 < len(heads) else heads[0]
        after[r["_head"]] = target["_range"]
    table = spark.createDataFrame([(k, v) for k, v in after.items()], "_head long, _to int")
    own = F.struct(spot.cast("int").alias("_range"), F.lit(False).alias("_guest"))
    guest = F.struct(F.col("_to").alias("_range"), F.lit(True).alias("_guest"))
    places = F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, guest))
    return (rows.join(F.broadcast(table), rows["doc_id"].eqNullSafe(table["_head"]), "left")
            .select("doc_id", "text", F.inline(places)))


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, edited_in_text double, n_shingles_est double")


def _rows(block: list[tuple]) -> list[tuple]:
    """Result rows of consecutive (range, guest, doc_id, text) rows, all but
    the last one, which is only the follower of the one before."""
    texts = [t for *_, t in block]
    raw = [t.encode("utf-8") for t in texts]
    own = sketches(raw)
    at = [i for i in range(len(block) - 1) if not block[i][1] and block[i][0] == block[i + 1][0]]
    edited = []
    for i in at:
        m = len(texts[i]) // 3
        edited.append((texts[i][:len(texts[i]) - m] + texts[i + 1][:m]).encode("utf-8"))
    out = []
    for i, e, s in zip(at, edited, sketches(edited)):
        out.append((block[i][2], len(texts[i]), hashlib.sha256(e).hexdigest(), written(own[i]), written(s),
                    resemblance(own[i], s), resemblance(own[i], own[i + 1]), containment(s, own[i]),
                    distinct_count(own[i])))
    return out


def _fingerprint_batches(batches):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]]
             for c in SCHEMA.split(", ")]
    carried: list[tuple] = []

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            block = carried + list(zip(*(part.column(c).to_pylist() for c in ("_range", "_guest", "doc_id", "text"))))
            rows = _rows(block)
            if rows:
                yield batch_of(rows)
            carried = block[-1:]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited text: the last third of the code
    points replaced by the first as many of the next document in descending
    doc_id (after the last: the first).

    One row per input row.  Order: doc_id descending, null last, then text;
    repeated rows follow each other; a single document follows itself.  Extra
    columns are ignored; an empty table gives an empty result.  Texts are
    shuffled once, into ranges of ids; a task holds a few hundred texts.
    """
    bounded_batches(docs.sparkSession)
    n = max(2, partitions(docs.sparkSession))
    dealt = in_order(docs, n)
    ordered = (dealt.repartition(n, "_range")
               .sortWithinPartitions("_range", "_guest", F.desc_nulls_last("doc_id"), "text"))
    return ordered.mapInArrow(_fingerprint_batches, SCHEMA)
