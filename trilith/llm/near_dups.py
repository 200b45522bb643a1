"""Near-duplicate documents by MinHash bands, odd sketches and exact sets.

1. Each text becomes the set of its word-shingle hashes; ``HASHES`` MinHash
   samples give ``BANDS`` band keys and an odd sketch: every sample (number,
   minimum) toggles one of ``BITS`` bits.  The XOR of two odd sketches counts
   the samples that differ, twice each unless bits collide, so its population
   count bounds the share of equal samples sharply where it is high.
2. Documents with equal sets form a class, kept by its smallest id.
3. Classes that share a band key are candidates.  First each is compared
   with the smallest of its bucket only.  Links found make components.
4. Then, in the buckets that still hold several components, pairs across
   components are compared in groups of at most two blocks of ``BLOCK``
   hashed members.  A pair inside one component cannot change any component,
   so no link between different components is left out.  A pair is looked at
   in the first band it shares only; members without any near partner leave
   before the sets are fetched, and a group passes on just the links that
   join components.
5. Before the exact check a pair's odd sketches are compared; the limit lets
   a pair at the threshold fail with probability below ``MISS``.  Links are
   confirmed on the full sets.

At the threshold 0.8 a pair shares no band with probability
(1 - 0.8^4)^32 < 5e-8; there is no other way to lose a link, and no cap.

Defined results: null text and texts without words have the empty set, which
is linked with nothing; repeated rows are one class; an id with several texts
is linked through any of them; rows without id are told apart by their text
and rank after all ids (their ``component_id`` is null when no id is
reachable); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop_task_state, partitions, stored
from .components import components
from .shingles import mix, shingle_sets

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BITS = 1024
WORDS = BITS // 64
MISS = 1e-9
BLOCK = 512  # members of a crowded bucket in one block
MAX_BROADCAST_ROWS = 2_000_000  # ids of 8 bytes each
BATCH = 128  # texts hashed at once
NO_ID = 1 << 62  # stand-ins of null ids start here

_rng = np.random.default_rng(20)
FLIPS = _rng.integers(0, 2 ** 64, HASHES, dtype=np.uint64)
FACTORS = _rng.integers(0, 2 ** 64, HASHES, dtype=np.uint64) | np.uint64(1)
SALTS = _rng.integers(0, 2 ** 64, HASHES, dtype=np.uint64)

SKETCH = [f"o{i}" for i in range(WORDS)]
SIGNATURE = ("node long, doc_id long, n_shingles long, text_md5 string, digest string, bands array<long>, "
             + ", ".join(f"{c} long" for c in SKETCH))


@functools.cache
def xor_limit(percent: int) -> int:
    """The largest XOR count to let pass: twice the number of differing
    samples that a pair at the threshold exceeds with probability < MISS."""
    p, tail, d = 1 - percent / 100, 0.0, HASHES
    while d > 0:
        tail += math.comb(HASHES, d) * p ** d * (1 - p) ** (HASHES - d)
        if tail >= MISS:
            break
        d -= 1
    return 2 * d


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples, one row per hash and one column per (non-empty) set."""
    values = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out, work = np.empty((HASHES, len(sets)), dtype=np.uint64), np.empty_like(values)
    for j in range(HASHES):
        np.bitwise_xor(values, FLIPS[j], out=work)
        np.multiply(work, FACTORS[j], out=work)
        out[j] = np.minimum.reduceat(work, at)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """One row per set, one 64-bit key per band."""
    parts = mix(low ^ SALTS[:, None]).reshape(BANDS, ROWS, -1)
    return mix(parts.sum(axis=1, dtype=np.uint64)).T


def odd_sketches(low: np.ndarray) -> np.ndarray:
    """One row of ``WORDS`` 64-bit words per set: the parity bitmap."""
    n = low.shape[1]
    spot = (mix((low + np.uint64(1)) * FACTORS[:, None] ^ SALTS[::-1, None]) % np.uint64(BITS)).astype(np.int64)
    spot += np.arange(n) * BITS
    odd = (np.bincount(spot.ravel(), minlength=n * BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, BITS), axis=1).view(np.uint64)


def _signature_batches(batches, width: int):
    drop_task_state()
    names = [c.split()[0] for c in SIGNATURE.split(", ")]
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            ids = batch.column("doc_id").slice(start, BATCH).to_pylist()
            texts = [(t or "").encode("utf-8") for t in batch.column("text").slice(start, BATCH).to_pylist()]
            sets = shingle_sets(texts, width, lower=True)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands = np.zeros((len(sets), BANDS), dtype=np.uint64)
            odd = np.zeros((len(sets), WORDS), dtype=np.uint64)
            if full:
                low = minima([sets[i] for i in full])
                bands[full], odd[full] = band_keys(low), odd_sketches(low)
            md5 = [hashlib.md5(t).hexdigest() for t in texts]
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets]
            node = [NO_ID + int(m[:15], 16) if i is None else i for i, m in zip(ids, md5)]
            lists = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS,
                                             pa.array(bands.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(md5), pa.array(digest), lists, *(pa.array(x) for x in odd.view(np.int64).T)], names=names)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda batches: _signature_batches(batches, width), SIGNATURE)


def _set_batches(batches, width: int):
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            nodes = batch.column("node").slice(start, BATCH)
            texts = [(t or "").encode("utf-8") for t in batch.column("text").slice(start, BATCH).to_pylist()]
            sets = [s.view(np.int64) for s in shingle_sets(texts, width, lower=True)]
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [nodes, pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))], names=["node", "members"])


def _xor_count(a: str, b: str) -> Column:
    total = F.bit_count(F.col(f"{a}.o0").bitwiseXOR(F.col(f"{b}.o0")))
    for c in SKETCH[1:]:
        total = total + F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")))
    return total


def _sets(nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, members): the shingle sets of the texts of ``nodes``."""
    nodes = stored(nodes.distinct(), "near-nodes")
    if nodes.count() <= MAX_BROADCAST_ROWS:  # else texts are shuffled by id
        nodes = F.broadcast(nodes)
    node = F.coalesce(F.col("doc_id").cast("long"),
                      F.lit(NO_ID) + F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 15), 16, 10)
                      .cast("long"))
    texts = docs.select(node.alias("node"), "text").join(nodes, "node", "left_semi")
    sets = texts.mapInArrow(lambda it: _set_batches(it, width), "node long, members array<long>")
    return stored(sets.dropDuplicates(), "near-sets")


def _confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    pairs = stored(pairs.select("a", "b").distinct(), "near-pairs")
    sets = _sets(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))), docs, width)
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("_sa"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("_sb"))
    both = F.size(F.array_intersect("_sa", "_sb"))
    return stored(pairs.join(left, "a").join(right, "b").withColumn("_both", both)
                  .where(100 * F.col("_both") >= percent * (F.size("_sa") + F.size("_sb") - F.col("_both")))
                  .select("a", "b").distinct(), "near-links")


GROUP = ["band", "i", "j"]
MEMBER = "band long, i int, j int, first boolean, node long, c long, n_shingles long, bands array<long>, " + ", ".join(
    f"{c} long" for c in SKETCH)


def _groups(batches):
    """Whole groups of consecutive rows with equal (band, i, j)."""
    held: list = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in GROUP])
        edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
            own = tuple(keys[:, lo])
            if key is not None and own != key:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            key = own
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _near_pairs(group: pa.Table, percent: int) -> list[tuple[int, np.ndarray]]:
    """(row, later or other-side rows that may be linked to it) of a group."""
    col = lambda c: group.column(c).to_numpy()
    n, c, node, band = col("n_shingles"), col("c"), col("node"), col("band")[0]
    odd = np.stack([col(x) for x in SKETCH], axis=1).view(np.uint64)
    bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    same_block = col("i")[0] == col("j")[0]
    first = np.flatnonzero(col("first"))
    other = first if same_block else np.flatnonzero(~col("first"))
    limit, out = xor_limit(percent), []
    for r in first:
        at = other[(c[other] != c[r]) & (100 * np.minimum(n[other], n[r]) >= percent * np.maximum(n[other], n[r]))]
        if same_block:
            at = at[node[at] > node[r]]
        if len(at):
            at = at[np.bitwise_count(odd[at] ^ odd[r]).sum(axis=1) <= limit]
        if len(at):
            shared = bands[at] == bands[r]
            at = at[bands[r][shared.argmax(axis=1)] == band]
        if len(at):
            out.append((int(r), at))
    return out


def _active_batches(batches, percent: int):
    """The members that have a near partner across components."""
    for group in _groups(batches):
        pairs = _near_pairs(group, percent)
        if pairs:
            rows = np.unique(np.concatenate([x for r, at in pairs for x in ([r], at)]))
            yield from group.take(pa.array(rows)).to_batches()


def _link_batches(batches, percent: int):
    """Links (a, b) that join components, confirmed on the sets."""
    for group in _groups(batches):
        pairs = _near_pairs(group, percent)
        if not pairs:
            continue
        members = group.column("members").combine_chunks()
        ends, flat = members.offsets.to_numpy(), members.flatten().to_numpy()
        sizes, values = np.diff(ends), flat[ends[0]:ends[-1]]
        ends = ends - ends[0]
        local = np.unique(values, return_inverse=True)[1]
        mark = np.zeros(len(values) + 1, dtype=bool)
        c, node = group.column("c").to_pylist(), group.column("node").to_pylist()
        root = {x: x for x in c}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found = []
        for r, at in pairs:
            own = local[ends[r]:ends[r + 1]]
            mark[own] = True
            for b in at:
                if find(c[r]) == find(c[b]):
                    continue
                both = int(np.count_nonzero(mark[local[ends[b]:ends[b + 1]]]))
                if 100 * both >= percent * (sizes[r] + sizes[b] - both):
                    root[find(c[r])] = find(c[b])
                    found.append((node[r], node[b]))
            mark[own] = False
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])


def _across(shared: DataFrame, ones: DataFrame, first: DataFrame, docs: DataFrame, width: int,
            percent: int) -> DataFrame:
    """Links between different components of a bucket."""
    placed = shared.join(first, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    mixed = (placed.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n"))
             .where("lo <> hi").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    members = placed.join(mixed, "band").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    # member of block m meets the blocks from m on as the first, those up to m as the second
    as_first = F.transform(F.sequence("block", F.col("blocks") - 1), lambda j: F.struct(
        F.col("block").alias("i"), j.alias("j"), F.lit(True).alias("first")))
    as_second = F.transform(F.filter(F.sequence(F.lit(0), F.col("block")), lambda i: i < F.col("block")),
                            lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(False).alias("first")))
    dealt = (members.join(ones.select("node", "n_shingles", "bands", *SKETCH), "node")
             .select("band", "node", "c", "n_shingles", "bands", *SKETCH, F.inline(F.concat(as_first, as_second))))
    columns = [x.split()[0] for x in MEMBER.split(", ")]
    n = partitions(docs.sparkSession)
    grouped = lambda df: df.repartition(n, *GROUP).sortWithinPartitions(*GROUP)
    active = stored(grouped(dealt.select(*columns)).mapInArrow(lambda it: _active_batches(it, percent), MEMBER),
                    "near-active")
    sets = _sets(active.select("node"), docs, width)
    links = grouped(active.join(sets, "node").select(*columns, "members")).mapInArrow(
        lambda it: _link_batches(it, percent), "a long, b long")
    return stored(links.distinct(), "near-links")


def _same_id(filled: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of an id that has several texts."""
    held = filled.select("node", "digest").join(classes, "digest").select("node", "class_id")
    several = held.groupBy("node").agg(F.min("class_id").alias("a"), F.max("class_id").alias("z")).where("a <> z")
    return held.join(several, "node").where("a <> class_id").select("a", F.col("class_id").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id, text_md5: one row
    per input row.  ``class_id`` is the smallest id with the same set."""
    bounded_batches(docs.sparkSession)
    sig = stored(signatures(docs, width), "near-signatures")
    limit = xor_limit(percent)
    filled = sig.where("n_shingles > 0")
    classes = stored(filled.groupBy("digest").agg(F.min("node").alias("class_id")), "near-classes")
    key = (F.col("f.digest") == F.col("k.digest")) & (F.col("f.node") == F.col("k.class_id"))
    ones = stored(filled.alias("f").join(classes.alias("k"), key, "left_semi").dropDuplicates(["digest", "node"])
                  .select("node", "n_shingles", "bands", *SKETCH), "near-ones")

    # against the smallest of each bucket
    slots = ones.select("node", F.explode("bands").alias("band"))
    firsts = (slots.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
              .select("band", "a"))
    shared = stored(slots.join(firsts, "band"), "near-shared")
    sketches = ones.select("node", *SKETCH)
    stars = (shared.where("a <> node").select("a", F.col("node").alias("b")).distinct()
             .join(sketches.alias("x"), F.col("a") == F.col("x.node"))
             .join(sketches.alias("y"), F.col("b") == F.col("y.node")).where(_xor_count("x", "y") <= limit))
    links = _confirm(stars, docs, width, percent).union(_same_id(filled, classes))
    first = stored(components(links), "near-first")

    # across the components that still meet in a bucket
    more = _across(shared.select("band", "node"), ones, first, docs, width, percent)
    known = first.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    other = first.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    bridges = more.join(known, "a", "left").join(other, "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    second = components(bridges).select(F.col("node").alias("c"), F.col("component").alias("c2"))

    # one row per document
    final = (classes.join(first.withColumnRenamed("node", "class_id"), "class_id", "left")
             .withColumn("c", F.coalesce("component", "class_id")).join(second, "c", "left")
             .select("digest", "class_id", F.coalesce("c2", "c").alias("_component")))
    rows = sig.select("node", "doc_id", "n_shingles", "text_md5", "digest").join(final, "digest", "left")
    component = F.coalesce("_component", "node")
    own_class = F.coalesce("class_id", "node")
    known_id = lambda c: F.when(c < NO_ID, c)
    return rows.select("doc_id", "n_shingles", known_id(component).alias("component_id"),
                       (F.col("node") == component).alias("kept"), known_id(own_class).alias("class_id"), "text_md5")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the smallest id; of
    rows that repeat an id and its text one stays.  All columns are kept,
    whatever their names."""
    kept = (near_duplicates(docs, width, percent).where("kept")
            .select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5")).distinct())
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_own"),
                       F.md5(F.coalesce("text", F.lit(""))).alias("_key"))
    return (rows.join(kept, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_md5")), "left_semi")
            .dropDuplicates(["_own", "_key"]).select("_row.*"))
