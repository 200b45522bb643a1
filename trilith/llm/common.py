"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder named by ``spark.checkpoint.dir``."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts
    the lineage, survives lost executors and keeps column pruning."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, for explicit repartitioning."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unit_hash(*cols: Column, seed: str = "") -> Column:
    """A uniform number in [0, 1) from the first 52 bits of an md5 (the same
    in any engine that has md5)."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


ARROW_ROWS = 512


def bounded_batches(spark: SparkSession) -> None:
    """Rows of an Arrow batch between the JVM and Python: at most
    ``ARROW_ROWS`` in this session, as a row may hold a very long text.  A
    smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


_held: dict = {}


def task_state(key, build):
    """What a Python worker keeps between tasks: one state for all operators,
    made by ``build`` when ``key`` is another object than last time.  The old
    one is freed first, so workers that serve many operators stay small."""
    if _held.get("key") is not key:
        _held.clear()
        gc.collect()
        _held.update(key=key, state=build())
    return _held["state"]


def drop_task_state() -> None:
    """Free what an earlier operator left in this worker."""
    if _held:
        _held.clear()
        gc.collect()
