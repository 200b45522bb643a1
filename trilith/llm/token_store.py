"""Token ids in raw binary shards with a minimal perfect hash index.

A shard is one file.  It begins with nothing but ids, little-endian, 16 bits
wide when the vocabulary allows and else 32, document after document in
ascending key order, each closed by the end id.  Behind them stands the
shard's index::

    g            2 bits for each of 3 m vertices
    fingerprint  uint32 per key
    first        uint32 per key: number of the key's first document
    copies       uint32 per key: documents with that key
    start        uint64 per document: its first id
    key          int64 per document
    trailer      see ``TRAILER``

and once more the end id, as the text sink that writes the files closes every
record with it.  The index is a minimal perfect hash over the shard's keys: a
key hashes to three vertices, their ``g`` pick one of these, and its rank
among the used vertices is the key's slot.  ``g`` comes from peeling the
3-partite hypergraph of all keys, round by round; an unlucky seed is replaced.
Keys of the shard always meet their own slot; a foreign key passes the
fingerprint with probability 2 ** -32.  A key costs the same few steps however
large the shard is.

``write_store`` writes shards; ``catalog`` has one row per shard, from the
trailers; ``read_store`` reads every document back through the index,
``read_keys`` some, and ``Shard`` opens one seekable file.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, partitions, stored, task_state
from .piece_table import BEYOND, PieceTable
from .ranks import small

END_ID = 2
SHARD_BYTES = 64 << 20  # of text
SHARD_ROWS = 1_000_000
CACHED_WORDS, LONG_WORD = 100_000, 64  # of texts with unusual characters
TABLE_PIECES, BLOCK = 1_000_000, 1 << 20  # pieces kept; bytes of text encoded together
REQUESTS = 100_000  # keys looked up in a shard at a time

#: Fixed value: the public byte-level pre-split pattern, over letter, digit
#: and white-space classes.
_PIECES = r"'(?:s|t|re|ve|m|ll|d)| ?[{l}]+| ?[{n}]+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+"
_ANY = _PIECES.format(l=r"\p{L}", n=r"\p{N}", s=r"\s")


def _latin_pieces() -> str:
    """The pattern for texts of Latin-1 characters, classes written out."""
    kinds = {chr(i): unicodedata.category(chr(i))[0] for i in range(256)}
    space = "\t\n\x0b\x0c\r \x85\xa0"
    return _PIECES.format(l="".join(c for c in kinds if kinds[c] == "L"),
                          n="".join(c for c in kinds if kinds[c] == "N"), s=space)


class Encoder:
    """Texts to raw ids by the ``tokenizers`` library; the ids of frequent
    pieces are kept, as encoding is by piece."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_str(spec)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.width = np.dtype("<u2" if self.whole.get_vocab_size() < 1 << 16 else "<u4")
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.latin, self.any = re.compile(_latin_pieces()).findall, regex.compile(_ANY).findall
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(own)]
        self.chars = {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}
        self.space, self.tokenize = chr(self.chars[32]), self.whole.model.tokenize
        self.code = next(c for c in "HI" if array(c).itemsize == self.width.itemsize)
        encoder = self

        class Words(dict):
            def __missing__(self, piece):
                ids = encoder.piece(piece)
                if len(piece) <= LONG_WORD:
                    self[piece] = ids
                return ids
        self.words = Words()
        self.table = PieceTable(self.piece, self.width, LONG_WORD, TABLE_PIECES, BLOCK)

    def piece(self, piece: str) -> bytes:
        if piece[1:].isalpha() and piece.isascii() and piece[0] == " ":  # most pieces
            raw = self.space + piece[1:]
        else:
            raw = piece.encode("utf-8").decode("latin-1").translate(self.chars)
        return array(self.code, [t.id for t in self.tokenize(raw)]).tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """``encode`` of each text, those of usual characters in blocks."""
        out: list = [b""] * len(texts)
        block, size = [], 0
        for i, t in enumerate(texts):
            raw = t.encode("utf-8")
            if len(raw) > BLOCK or any(s in t for s in self.specials) or not t.isascii() and BEYOND.search(t):
                out[i] = self.encode(t)
            elif raw:
                if size + len(raw) > BLOCK:
                    self._encode_block(block, out)
                    block, size = [], 0
                block.append((i, raw))
                size += len(raw)
        self._encode_block(block, out)
        return out

    def _encode_block(self, block: list, out: list) -> None:
        if block:
            for (i, _), ids in zip(block, self.table.encode_many([raw for _, raw in block])):
                out[i] = ids

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.specials):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=self.width).tobytes()
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        try:
            text.isascii() or text.encode("latin-1")
            pieces = self.latin(text)
        except UnicodeEncodeError:
            pieces = self.any(text)
        return b"".join(map(self.words.__getitem__, pieces))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys.astype(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def _vertices(keys: np.ndarray, seed: int, m: int) -> np.ndarray:
    """The three vertices of each key, one in each third."""
    k = keys.astype(np.uint64)
    salts = np.array([(3 * seed + j + 1) * 0x9E3779B97F4A7C15 % 2 ** 64 for j in range(3)], dtype=np.uint64)
    h = _mix(k[:, None] + salts[None, :]) >> np.uint64(32)
    return ((h * np.uint64(m)) >> np.uint64(32)).astype(np.int64) + np.arange(3) * m


def build_hash(keys: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(seed, m, g) of a minimal perfect hash over distinct int64 keys."""
    n = len(keys)
    m = int(1.25 * n / 3) + 3
    seed = 0
    while True:
        at = _vertices(keys, seed, m)
        degree = np.bincount(at.ravel(), minlength=3 * m)
        edges = np.zeros(3 * m, dtype=np.int64)  # xor of the edges at a vertex
        for j in range(3):
            np.bitwise_xor.at(edges, at[:, j], np.arange(n))
        rounds, left = [], n
        free = np.flatnonzero(degree == 1)
        while len(free):
            taken, first = np.unique(edges[free], return_index=True)
            rounds.append((taken, free[first]))
            left -= len(taken)
            ends = at[taken].ravel()
            np.subtract.at(degree, ends, 1)
            np.bitwise_xor.at(edges, ends, np.repeat(taken, 3))
            free = np.unique(ends[degree[ends] == 1])
        if not left:
            break
        seed += 1
    g = np.full(3 * m, 3, dtype=np.uint8)
    for taken, vertex in reversed(rounds):
        own = at[taken]
        others = g[own].astype(np.int64).sum(axis=1) - 3
        g[vertex] = (vertex // m - others) % 3
    return seed, m, g


#: magic, id bytes, documents with a null key, documents, keys, ids, m, seed
TRAILER = struct.Struct("<8sIIQQQQQ")
MAGIC = b"TOKSHRD1"


def shard_index(keys: list, counts: list[int], width: int) -> bytes:
    """Index and trailer of documents in key order (null first) with
    ``counts`` ids each."""
    n_null = sum(k is None for k in keys)
    ids = np.array([k or 0 for k in keys], dtype="<i8")
    distinct, first, copies = np.unique(ids[n_null:], return_index=True, return_counts=True)
    seed, m, g = build_hash(distinct)
    slot = _slots(distinct, seed, m, g, np.cumsum(g != 3) - 1)
    table = np.zeros((3, len(distinct)), dtype="<u4")
    table[:, slot] = _fingerprint(distinct), first + n_null, copies
    ends = np.cumsum(np.array(counts, dtype="<u8"))
    start = (ends - np.array(counts, dtype="<u8")).astype("<u8")
    packed = np.pad(g, (0, -len(g) % 4)).reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)
    return (np.bitwise_or.reduce(packed, axis=1).astype(np.uint8).tobytes() + table.tobytes() + start.tobytes()
            + ids.tobytes() + TRAILER.pack(MAGIC, width, n_null, len(ids), len(distinct), int(ends[-1]), m, seed))


def _slots(keys, seed, m, g, rank) -> np.ndarray:
    """Slots of keys, -1 for a vertex that no key uses."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64)
    at = _vertices(keys, seed, m)
    chosen = at[np.arange(len(keys)), g[at].astype(np.int64).sum(axis=1) % 3]
    return np.where(g[chosen] == 3, -1, rank[chosen])


class Shard:
    """One shard, read through ``read(offset, size)`` of a file of ``size``
    bytes.  Opening reads the index, a document then one range."""

    def __init__(self, read, size: int):
        self.read = read
        for width in (2, 4):  # the sink's closing end id has an id's width
            try:
                raw = read(size - width - TRAILER.size, TRAILER.size)
                magic, self.width, self.n_null, n, keys, self.n_ids, self.m, self.seed = TRAILER.unpack(raw)
            except (struct.error, ValueError):
                continue
            if magic == MAGIC and self.width == width:
                break
        else:
            raise ValueError("not a token shard")
        base = self.n_ids * width
        raw = read(base, size - width - TRAILER.size - base)
        packed = np.frombuffer(raw, dtype=np.uint8, count=-(-3 * self.m // 4))
        self.g = ((packed[:, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3).ravel()[:3 * self.m]
        self.rank = np.cumsum(self.g != 3) - 1
        at = len(packed)
        self.fingerprints, self.first, self.copies = np.frombuffer(raw, "<u4", 3 * keys, at).reshape(3, keys)
        at += 12 * keys
        self.start = np.frombuffer(raw, "<u8", n, at).astype(np.int64)
        self.keys = np.frombuffer(raw, "<i8", n, at + 8 * n)
        self.stop = np.append(self.start[1:], self.n_ids)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first document, documents) of int64 keys; 0 documents: not here."""
        slot = _slots(keys, self.seed, self.m, self.g, self.rank)
        first, copies = np.zeros((2, len(keys)), dtype=np.int64)
        there = np.flatnonzero(slot >= 0)
        there = there[self.fingerprints[slot[there]] == _fingerprint(keys[there])]
        first[there], copies[there] = self.first[slot[there]], self.copies[slot[there]]
        return first, copies

    def ids(self, document: int) -> np.ndarray:
        """The ids of a document by its number, end id included."""
        raw = self.read(int(self.start[document]) * self.width,
                        int(self.stop[document] - self.start[document]) * self.width)
        return np.frombuffer(raw, dtype=f"<u{self.width}")

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of all documents with ``key``."""
        (first,), (copies,) = self.find(np.array([key], dtype=np.int64))
        return [self.ids(i) for i in range(first, first + copies)]

    def documents(self) -> np.ndarray:
        """Numbers of all documents: those without a key, and what the index
        finds for each key."""
        own = self.keys[self.n_null:]
        distinct = own[np.append(True, own[1:] != own[:-1])] if len(own) else own
        first, copies = self.find(distinct)
        found = np.repeat(first - np.append(0, np.cumsum(copies)[:-1]), copies) + np.arange(copies.sum())
        return np.concatenate([np.arange(self.n_null), found]).astype(np.int64)


def open_shard(file) -> Shard:
    """A shard from a seekable binary file."""
    def read(offset, size):
        file.seek(offset)
        return file.read(size)
    return Shard(read, file.seek(0, 2))


def _shard_of(content) -> Shard:
    view = memoryview(content)
    return Shard(lambda offset, size: view[offset:offset + size], len(view))


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, key: str = "doc_id") -> DataFrame:
    """Encode ``text``, append ``end_id`` and write shards under ``path``/shards.
    Returns their ``catalog``, which reads them when it is used.

    Order: key, null first; equal keys by bytes of text and a hash of it, so
    repeated rows follow each other.  Null text is the empty text (the end id
    alone).  Extra columns are ignored; an empty table gives an empty store.
    Shards are ranges of (key, text size, hash, row), so no key fills one task;
    there is one for every ``SHARD_BYTES`` of text or ``SHARD_ROWS`` rows, and
    a text is never split.  Texts are shuffled once and encoded where they are
    written; a repeated task writes the same shard.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    encoder = Encoder(spec)
    end = np.array([end_id], dtype=encoder.width).tobytes()
    if max(end) > 127:
        raise ValueError("the bytes of the end id must be ASCII characters, as the sink's line separator is text")
    shared = spark.sparkContext.broadcast(spec)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    size, n_rows = rows.agg(F.sum(F.octet_length("text").cast("long")), F.count("*")).first()
    n = max(partitions(spark), -(-(size or 0) // SHARD_BYTES), -(-n_rows // SHARD_ROWS))
    order = [F.col("key").asc_nulls_first(), F.col("_size"), F.col("_hash"), F.col("_row")]
    dealt = (rows.select("key", "text", F.octet_length("text").alias("_size"), F.xxhash64("text").alias("_hash"),
                         F.monotonically_increasing_id().alias("_row"))
             .repartitionByRange(n, *order).sortWithinPartitions(*order))

    def run(batches):
        encoder = task_state(shared.value, lambda: Encoder(shared.value))
        keys, counts = [], []
        for batch in batches:
            keys += batch.column("key").to_pylist()
            texts = batch.column("text")
            for start in range(0, len(texts), 256):
                payload = encoder.encode_many(texts.slice(start, 256).to_pylist())
                counts += [len(p) // encoder.width.itemsize + 1 for p in payload]
                yield pa.RecordBatch.from_arrays([pa.array(payload, pa.binary())], names=["value"])
        if keys:
            index = shard_index(keys, counts, encoder.width.itemsize)
            yield pa.RecordBatch.from_arrays([pa.array([index], pa.binary())], names=["value"])

    (dealt.select("key", "text").mapInArrow(run, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", end.decode()).text(f"{path}/shards"))
    return catalog(spark, path)


def _files(spark: SparkSession, paths) -> DataFrame:
    return (spark.read.format("binaryFile").load(paths).where("length > 0")
            .select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "path", "content"))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """shard, path, docs, nulls (documents without a key), least and greatest
    key, ids, and ``base``, the ids of all shards before."""
    schema = "shard int, path string, docs long, nulls long, least long, greatest long, ids long"

    def run(batches):
        for batch in batches:
            rows = []
            for number, name, content in zip(*(batch.column(c) for c in ("shard", "path", "content"))):
                s = _shard_of(content.as_buffer())
                own = s.keys[s.n_null:]
                rows.append((number.as_py(), name.as_py(), len(s.keys), s.n_null, int(own[0]) if len(own) else None,
                             int(own[-1]) if len(own) else None, s.n_ids))
            names = [c.split()[0] for c in schema.split(", ")]
            types = [pa.int32(), pa.string(), *[pa.int64()] * 5]
            cols = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return _based(_files(spark, f"{path}/shards").mapInArrow(run, schema))


def _based(shards: DataFrame) -> DataFrame:
    """With the ids of all shards before: a running sum over one row per shard."""
    return shards.withColumn("base", F.sum("ids").over(Window.orderBy("shard")) - F.col("ids"))


READ = "key long, shard int, at long, n_tokens long, ids_crc32 long"


def _documents(shard: Shard, number: int, wanted, with_ids: bool):
    """Batch of documents by their numbers."""
    ids = [shard.ids(i) for i in wanted]
    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
    cols = [pa.array([None if i < shard.n_null else int(shard.keys[i]) for i in wanted], pa.int64()),
            pa.array([number] * len(ids), pa.int32()), pa.array(shard.start[wanted], pa.int64()),
            pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64())]
    names = [c.split()[0] for c in READ.split(", ")]
    if with_ids:
        cols.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int64())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(cols, names=names)


def _with_base(rows: DataFrame, shards: DataFrame) -> DataFrame:
    base = small(shards.select("shard", "base"))
    return rows.join(base, "shard").withColumn("start", F.col("base") + F.col("at")).drop("base", "at")


def read_store(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """Every document of a store: key, shard, start (ids of all documents
    before it), n_tokens, the CRC of its ids as 32-bit numbers, and with
    ``ids`` the ids.  Each shard is read by one task, and its documents are
    fetched through the index by the keys that the shard lists."""
    def run(batches):
        for batch in batches:
            for number, content in zip(batch.column("shard"), batch.column("content")):
                shard = _shard_of(content.as_buffer())
                wanted = shard.documents()
                for start in range(0, len(wanted), 1000):
                    yield _documents(shard, number.as_py(), wanted[start:start + 1000], ids)

    rows = stored(_files(spark, f"{path}/shards").mapInArrow(run, READ + (", ids array<long>" if ids else "")), "token-rows")
    shards = stored(_based(rows.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))), "token-bases")
    return _with_base(rows, shards)


def read_keys(spark: SparkSession, path: str, keys: DataFrame, ids: bool = True) -> DataFrame:
    """The documents of ``keys`` (first column, long): as ``read_store``, one
    row per document; repeated and null keys are asked once and not at all, keys that the store
    lacks give no row.  Only shards whose range holds a key are read."""
    shards = stored(catalog(spark, path), "token-catalog")
    wanted = keys.select(F.col(keys.columns[0]).cast("long").alias("key")).dropna().distinct()
    ranges = [tuple(r) for r in shards.where("least IS NOT NULL").orderBy("shard")
              .select("shard", "least", "greatest").collect()]
    shared = spark.sparkContext.broadcast(np.array(ranges, dtype=np.int64).reshape(-1, 3))

    def route(batches):
        number, least, greatest = shared.value.T
        for batch in batches:
            k = batch.column("key").to_numpy()
            lo, hi = np.searchsorted(greatest, k, side="left"), np.searchsorted(least, k, side="right")
            n = np.maximum(hi - lo, 0)
            at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(number[at], pa.int32()), pa.array(np.repeat(k, n))],
                                             names=["shard", "key"])

    routed = stored(wanted.mapInArrow(route, "shard int, key long"), "token-requests")
    touched = routed.groupBy("shard").agg(F.count("*").alias("n"))
    most = touched.agg(F.max("n")).first()[0] or 0
    blocks = -(-most // REQUESTS) or 1
    lists = routed.groupBy("shard", F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("_block")).agg(
        F.collect_list("key").alias("keys"))
    paths = [r[0] for r in touched.join(shards, "shard").select("path").collect()]
    schema = READ + (", ids array<long>" if ids else "")
    if not paths:
        return _with_base(spark.createDataFrame([], schema), shards)

    def run(batches):
        for batch in batches:
            for number, content, own in zip(*(batch.column(c) for c in ("shard", "content", "keys"))):
                shard = _shard_of(content.as_buffer())
                first, copies = shard.find(own.values.to_numpy().astype(np.int64))
                found = np.repeat(first - np.append(0, np.cumsum(copies)[:-1]), copies) + np.arange(copies.sum())
                for start in range(0, len(found), 1000):
                    yield _documents(shard, number.as_py(), found[start:start + 1000], ids)

    joined = _files(spark, paths).join(small(stored(lists, "token-lists"), 1000), "shard")
    return _with_base(joined.select("shard", "content", "keys").mapInArrow(run, schema), shards)
