"""Exact positions of rows in a global order, without a one-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored

PART_BITS = 33  # of monotonically_increasing_id: rows within a partition
SMALL_ROWS = 100_000  # a table of so many short rows may be broadcast


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df``, marked for broadcast when it was counted to be small; a larger
    one is joined by shuffling."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows of ``df`` in ranges of ``order``, stored with their place ``_at``
    (range number and row of the range).  A range is at most what rows that
    agree in all of ``order`` make it: give a last key that tells rows apart.
    """
    n = partitions(df.sparkSession)
    return stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                  .withColumn("_at", F.monotonically_increasing_id()), name)


def positions(placed: DataFrame, groups: list[str], name: str) -> DataFrame:
    """Adds ``rank`` (from 0, within equal ``groups``, which the order begins
    with) and ``n`` (rows of the group) to the result of ``in_order``.

    Counts per (group, range) give the offsets: a hot group has one such row
    per range.  Null is a group of its own.
    """
    part = F.shiftright("_at", PART_BITS)
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]
    names = [f"_g{i}" for i in range(len(groups))]
    w = Window.partitionBy(*names)
    cells = stored(placed.groupBy(*keys, part.alias("_part"))
                   .agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
                   .withColumn("n", F.sum("_rows").over(w))
                   .withColumn("_before", F.sum("_rows").over(w.orderBy("_part")) - F.col("_rows"))
                   .drop("_rows"), name)
    on = part == F.col("_part")
    for i, g in enumerate(groups):
        on = on & placed[g].eqNullSafe(F.col(f"_g{i}"))
    return (placed.join(small(cells), on)
            .withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before"))
            .drop("_part", "_first", "_before", "_at", *names))
