"""Reproducible splits, folds and id-based alignment (§2.6).

Row order comes from a seeded hash of the stable id: ``md5(id || seed)``,
ties broken by the id.  No operator here relies on row positions.

Scale notes
* ``hash_split`` is shuffle-free (a per-row threshold on the hash).
* ``stratified_split`` is quota-exact per stratum without a window: label, id
  and hash are written once, the two cut points of each stratum are found on
  that narrow table by the exact distributed rank selection, then every row is
  compared with its stratum's cut points in a narrow projection (one md5 a
  cut).  A stratum holding a third of all rows costs the same as any other.
* ``kfold_assign`` needs every row's exact rank.  Rows are split into
  equal-width blocks of the (uniform) hash, each block is ranked by a window
  partitioned by (stratum, block), and a small (strata x blocks) table of
  block offsets turns local ranks into stratum ranks.  A hot stratum is
  thus spread over ``blocks`` tasks.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import select_ranks
from ..session import dropped, scratch_path, written

HASH_DIGITS = 13  # 52 bits: exact in a double


def seeded_md5(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))


def _h52(md5: Column) -> Column:
    return F.conv(F.substring(md5, 1, HASH_DIGITS), 16, 10).cast("long")


def quota_cuts(n: int, fracs: tuple[float, ...]) -> list[int]:
    """Cumulative cut ranks round-half-up(share * n), in integer arithmetic."""
    cuts, acc = [], 0
    for f in fracs[:-1]:
        acc += round(f * 10000)
        cuts.append((acc * n + 5000) // 10000)
    return cuts


def stratified_split(df: DataFrame, id_col: str, label: str,
                     fracs: tuple[float, ...] = (0.70, 0.15, 0.15), seed: int = 42,
                     names: tuple[str, ...] = ("train", "val", "test"),
                     out: str = "split") -> DataFrame:
    """Quota-exact split per label: within each label rows are ordered by
    (md5(id || seed), id); the first round(f1*n) are ``names[0]``, up to
    round((f1+f2)*n) ``names[1]``, the rest ``names[2]``.  Rows without a
    label get ``'unlabelled'``."""
    path = scratch_path(df.sparkSession, f"split-keys-{uuid.uuid4().hex}")
    keys = written(df.where(F.col(label).isNotNull())
                   .select(F.col(label).alias("_g"), F.col(id_col).alias("_i"), _h52(seeded_md5(id_col, seed)).alias("_h")), path)
    h = F.col("_h").cast("double")
    sizes = (keys.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.count(h).alias("n_h"), F.min(h).alias("lo"), F.max(h).alias("hi"))
             .collect())
    if len(sizes) > 10_000:
        raise ValueError("too many strata for literal cut points")
    cuts = {r["_g"]: quota_cuts(r["n"], fracs) for r in sizes}
    wanted = {g: sorted({c for c in cs if c >= 1}) for g, cs in cuts.items()}
    found = select_ranks(keys, F.col("_g"), h, wanted, tie_cols=[seeded_md5("_i", seed), F.col("_i")],
                         stats={r["_g"]: (r["n_h"], r["lo"], r["hi"]) for r in sizes}) if wanted else {}
    dropped(df.sparkSession, path)
    # the digits of _h lead the md5, so (md5, id) has the order of (_h, md5, id)
    key = F.struct(seeded_md5(id_col, seed).alias("m"), F.col(id_col).alias("i"))
    expr = F.when(F.col(label).isNull(), F.lit("unlabelled"))
    for part, name in enumerate(names[:-1]):
        bound = None
        for g, cs in cuts.items():
            c = cs[part]
            if c < 1:
                continue
            _, m, i = found[(g, c)]
            own = F.struct(F.lit(m).alias("m"), F.lit(i).cast(df.schema[id_col].dataType).alias("i"))
            bound = F.when(F.col(label) == F.lit(g), own) if bound is None else bound.when(F.col(label) == F.lit(g), own)
        if bound is not None:
            expr = expr.when(key <= bound, F.lit(name))
    return df.withColumn(out, expr.otherwise(F.lit(names[-1])))


def hash_split(df: DataFrame, id_col: str, fracs: tuple[float, ...] = (0.70, 0.15, 0.15),
               seed: int = 42, names: tuple[str, ...] = ("train", "val", "test"),
               out: str = "split") -> DataFrame:
    """Shuffle-free split: u = first 8 hex digits of md5(id || seed) / 2^32;
    proportions hold within sampling error."""
    u = F.conv(F.substring(seeded_md5(id_col, seed), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    expr, acc = None, 0.0
    for f, name in zip(fracs[:-1], names[:-1]):
        acc += f
        expr = F.when(u < F.lit(acc), F.lit(name)) if expr is None else expr.when(u < F.lit(acc), F.lit(name))
    return df.withColumn(out, expr.otherwise(F.lit(names[-1])))


BLOCK_ROWS = 2_000_000
BROADCAST_OFFSETS = 200_000


def hashed_rank(df: DataFrame, id_col: str, label: str | None, seed: int = 42,
                blocks: int | None = None, out: str = "_rank") -> DataFrame:
    """Exact 1-based rank of every row within its label by (md5(id||seed), id).

    See the module notes: equal-width hash blocks bound each window task to
    about ``BLOCK_ROWS`` rows (the block count follows the largest label);
    block offsets come from a (labels x blocks) count table, broadcast only
    when that table is provably small, else joined on (label, block).
    """
    spark = df.sparkSession
    grp = F.col(label) if label else F.lit(0)
    n_labels = 1
    if blocks is None:
        sizes = df.groupBy(grp.alias("_g")).agg(F.count(F.lit(1)).alias("n")).collect()
        n_labels = max(1, len(sizes))
        biggest = max((r["n"] for r in sizes), default=0)
        blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-biggest // BLOCK_ROWS))
    md5 = seeded_md5(id_col, seed)
    keyed = (df.withColumn("_md5", md5).withColumn("_h", _h52(F.col("_md5")))
             .withColumn("_g", grp)
             # in double: a long product 2^52 x blocks would overflow (ANSI error) on big clusters;
             # the double form is monotone in h, which is all the block order needs
             .withColumn("_blk", F.least(F.floor(F.col("_h").cast("double") * F.lit(float(blocks))
                                                 / F.lit(float(16 ** HASH_DIGITS))), F.lit(blocks - 1)).cast("int")))
    counts = keyed.groupBy("_g", "_blk").agg(F.count(F.lit(1)).alias("_n"))
    wo = Window.partitionBy("_g").orderBy("_blk")
    offsets = counts.select("_g", "_blk", (F.sum("_n").over(wo) - F.col("_n")).alias("_off"))
    w = Window.partitionBy("_g", "_blk").orderBy("_h", "_md5", id_col)
    ranked = keyed.withColumn("_local", F.row_number().over(w))
    small = n_labels * blocks <= BROADCAST_OFFSETS
    return (ranked.join(F.broadcast(offsets) if small else offsets, ["_g", "_blk"], "left")
            .withColumn(out, (F.col("_off") + F.col("_local")).cast("long"))
            .drop("_md5", "_h", "_g", "_blk", "_local", "_off"))


def kfold_assign(df: DataFrame, id_col: str, label: str | None = None, k: int = 5,
                 seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold = (rank - 1) mod k, rank within label (stratified) or global.
    Rows without a label get NULL."""
    src = df.where(F.col(label).isNotNull()) if label else df
    ranked = hashed_rank(src, id_col, label, seed)
    res = ranked.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")
    if label:
        res = res.unionByName(df.where(F.col(label).isNull()).withColumn(out, F.lit(None).cast("int")))
    return res


def split_join(left: DataFrame, splits: DataFrame, left_id: str, split_id: str,
               cols: list[str] | None = None) -> DataFrame:
    """Attach split membership by an inner equi-join on the stable id."""
    right = splits.select(F.col(split_id).alias(left_id), *(cols or ["split"]))
    return left.join(right, left_id, "inner")


def combine_modalities(numeric: DataFrame, text: DataFrame, num_id: str, text_id: str,
                       text_cols: list[str]) -> DataFrame:
    """Numeric features and text of the same item in one row (inner join)."""
    return numeric.join(text.select(F.col(text_id).alias(num_id), *text_cols), num_id, "inner")


def alignment_check(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """Row counts of both sides, ids on both, ids on one side only, and
    duplicated ids; one full outer join over distinct-id counts."""
    ca = a.groupBy(F.col(a_id).alias("_id")).agg(F.count(F.lit(1)).alias("_na"))
    cb = b.groupBy(F.col(b_id).alias("_id")).agg(F.count(F.lit(1)).alias("_nb"))
    j = ca.join(cb, "_id", "full_outer")
    return j.agg(F.coalesce(F.sum("_na"), F.lit(0)).cast("bigint").alias("n_left"),
                 F.coalesce(F.sum("_nb"), F.lit(0)).cast("bigint").alias("n_right"),
                 F.count_if(F.col("_na").isNotNull() & F.col("_nb").isNotNull()).alias("n_both"),
                 F.count_if(F.col("_nb").isNull()).alias("n_left_only"),
                 F.count_if(F.col("_na").isNull()).alias("n_right_only"),
                 F.count_if((F.col("_na") > 1) | (F.col("_nb") > 1)).alias("n_duplicated"))


def concat_splits(*dfs: DataFrame) -> DataFrame:
    """Bag union by column name."""
    return reduce(lambda x, y: x.unionByName(y), dfs)
