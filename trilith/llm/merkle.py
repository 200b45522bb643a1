"""Merkle manifest of a document table by a nested-struct rollup.

Leaves are SHA-256 digests of a row's fields; within a group they stand in
the order of their key, and runs of three nodes become the digest of their
digests until one is left.  The groups' roots, in the order of the groups,
form one more tree.

Ranks are written as base-3 digits.  Blocks of 3 ** ``LEVELS`` leaves are
gathered by one shuffle; inside, the digit columns are grouped away one by
one, lowest first, and each group nests its child structs.  The roots of the
blocks are the leaves of the next tier, so that no row ever holds more than
a block.  Downwards one transform per tier turns a block into its leaves
with their siblings, and explode emits them; leaves are never joined.  Only
block rows meet the path above their root (one row a block).

A path lists, from the leaf to the root, the siblings to the left and to the
right as struct<l, r> of joined hexadecimal digests; a run of one node has
empty ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .ranks import in_order, positions, small

ARITY, LEVELS = 3, 6
BLOCK = ARITY ** LEVELS
PATH = "array<struct<l:string,r:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*fields: Column) -> Column:
    """Digest of fields: ``-`` for null, else byte count, ``:`` and value."""
    texts = [c.cast("string") for c in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda acc, s: digest(s["l"], acc, s["r"]))


def path_digest(path: Column) -> Column:
    """Digest of all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def _rollup(rows: DataFrame, tree: list[str], below: int) -> DataFrame:
    """One tier: (tree, n, rank, hash, item) to (tree, n, block, hash, kids).
    ``below`` levels were done before; a level is hashed while the tree has
    several nodes on it."""
    digits = [f"_d{i}" for i in range(1, LEVELS)]
    rank = F.col("rank")
    table = rows.select(
        *tree, "n", F.expr(f"rank div {BLOCK}").alias("block"),
        *[F.expr(f"int(rank div {ARITY ** i} % {ARITY})").alias(d) for i, d in enumerate(digits, 1)],
        F.struct((rank % ARITY).cast("int").alias("digit"), "hash", "item").alias("node"))
    table = table.repartition(*tree, "block")
    for level in range(1, LEVELS + 1):
        kept = digits[level - 1:]
        table = table.groupBy(*tree, "n", "block", *kept).agg(F.sort_array(F.collect_list("node")).alias("kids"))
        several = F.col("n") > ARITY ** (below + level - 1)
        node = F.when(several, F.sha2(F.array_join(F.col("kids.hash"), ""), 256)).otherwise(F.col("kids")[0]["hash"])
        if level < LEVELS:
            table = table.select(*tree, "n", "block", *kept, F.struct(
                F.col(kept[0]).alias("digit"), node.alias("hash"), "kids").alias("node"))
    return table.select(*tree, "n", "block", node.alias("hash"), "kids")


def _leaves(kids: Column, path: Column, below: int, level: int) -> Column:
    """Items under ``kids`` with their paths inside the block."""
    def child(c, i):
        hashes = kids.getField("hash")
        step = F.struct(F.array_join(F.slice(hashes, F.lit(1), i), "").alias("l"),
                        F.array_join(F.slice(hashes, i + 2, F.lit(ARITY)), "").alias("r"))
        here = F.when(F.col("n") > ARITY ** (below + level - 1), F.concat(F.array(step), path)).otherwise(path)
        if level == 1:
            return F.array(F.struct(c["item"].alias("item"), c["hash"].alias("hash"), here.alias("path")))
        return _leaves(c["kids"], here, below, level - 1)
    return F.flatten(F.transform(kids, child))


def _tiers(rows: DataFrame, tree: list[str], name: str) -> list[DataFrame]:
    """Stored tiers from the leaves up; the last has one row per tree."""
    greatest = rows.agg(F.max("n")).first()[0] or 0
    tiers = []
    while True:
        tiers.append(stored(_rollup(rows, tree, LEVELS * len(tiers)), f"{name}-tier{len(tiers)}"))
        if greatest <= BLOCK ** len(tiers):
            return tiers
        rows = tiers[-1].select(*tree, "n", F.col("block").alias("rank"), "hash",
                                F.struct("block").alias("item"))


def _proofs(tiers: list[DataFrame], tree: list[str], above: DataFrame | None) -> DataFrame:
    """(tree, item, hash, top, path and what ``above`` has): every leaf with
    its path.  ``above`` holds one row per tree with the path over its top."""
    depth = len(tiers)
    extra = [] if above is None else [c for c in above.columns if c not in (*tree, "path")]
    table = tiers[-1].withColumn("top", F.col("hash"))
    if above is None:
        table = table.withColumn("path", F.array().cast(PATH))
    else:
        table = _with(table, above, tree)
    for tier in range(depth - 1, -1, -1):
        inner = _leaves(F.col("kids"), F.array().cast(PATH), LEVELS * tier, LEVELS)
        table = (table.select(*tree, "top", *extra, F.col("path").alias("_over"), F.explode(inner).alias("_leaf"))
                 .select(*tree, "top", *extra, "_leaf.item", "_leaf.hash",
                         F.concat("_leaf.path", "_over").alias("path")))
        if tier:
            heads = table.select(*tree, F.col("item.block").alias("block"), "top", *extra, "path")
            table = _with(tiers[tier - 1], heads, [*tree, "block"])
    return table


def _with(blocks: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with what ``heads`` says of their roots, one row each."""
    heads = small(stored(heads, "merkle-heads").select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in heads.columns if c not in keys]))
    on = reduce(lambda a, b: a & b, [blocks[k].eqNullSafe(heads[f"_k{i}"]) for i, k in enumerate(keys)])
    return blocks.join(heads, on).drop(*[f"_k{i}" for i in range(len(keys))])


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None, key: str = "doc_id", group: str = "source",
             fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """Merkle manifest: key, group, leaf, subroot (of the group), root and
    path, one row per row of ``docs``, with the columns of ``carry`` (over
    ``docs``), which take no part in the digests.

    Order in a group: key, null first, then leaf; repeated rows are repeated
    leaves.  Groups are ordered with null first, then bytewise; null is a
    group.  Null text and empty text differ.  Texts of any length are hashed
    in place and not moved; extra columns are ignored whatever their names.
    An empty table has an empty manifest (and no root).
    """
    carry = carry or {}
    leaves = stored(docs.select(
        F.col(group).alias("group"),
        F.struct(F.col(key).alias("key"), *[c.alias(f"c{i}") for i, c in enumerate(carry.values())]).alias("item"),
        leaf_digest(*[F.col(f) for f in fields]).alias("hash"),
        F.monotonically_increasing_id().alias("_row")), "merkle-leaves")
    placed = in_order(leaves, [F.col("group"), F.col("item.key"), F.col("hash"), F.col("_row")], "merkle-order")
    tiers = _tiers(positions(placed, ["group"], "merkle-cells").drop("_row"), ["group"], "merkle")
    tops = in_order(tiers[-1].select(F.struct(F.col("group")).alias("item"), "hash"),
                    [F.col("item.group")], "merkle-groups")
    above = _proofs(_tiers(positions(tops, [], "merkle-group-cells"), [], "merkle-top"), [], None)
    above = above.select(F.col("item.group").alias("group"), F.col("top").alias("root"), "path")
    return _proofs(tiers, ["group"], above).select(
        F.col("item.key").alias(key), F.col("group").alias(group), F.col("hash").alias("leaf"),
        F.col("top").alias("subroot"), "root", "path",
        *[F.col(f"item.c{i}").alias(c) for i, c in enumerate(carry)])


def tampered_digest() -> Column:
    """Leaf of a document whose newlines were deleted when 2 divides the CRC
    of its decimal id; the others' leaves, and null texts, as they are."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)


def audit(docs: DataFrame) -> DataFrame:
    """The manifest with each leaf, tampered where ``tampered_digest`` says,
    folded with the original siblings.  Rows and order as in ``manifest``; a
    null id is not tampered."""
    rows = manifest(docs, carry={"tampered": tampered_digest()})
    rows = rows.withColumn("folded_root", fold(F.col("tampered"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
