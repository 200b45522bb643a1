"""Sources and sinks (§2.1): typed scans, schema repair, split and table
writers, model persistence and the run-metrics log.

Every writer targets a caller-given path; scratch paths of the registered
queries live under the shared ``spark.checkpoint.dir`` so they are visible
to every executor.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def scan_items(spark: SparkSession, paths: list[str], schema: StructType, fmt: str | None = None) -> DataFrame:
    """Read the first existing path of ``paths`` with an explicit schema
    (no inference); CSV with a header, or parquet."""
    for p in paths:
        if _exists(spark, p):
            kind = fmt or ("parquet" if p.endswith(".parquet") else "csv")
            reader = spark.read.schema(schema)
            if kind == "csv":
                return reader.option("header", True).option("mode", "PERMISSIVE").csv(p)
            return reader.format(kind).load(p)
    raise FileNotFoundError(f"none of {paths} exists")


def ensure_columns(df: DataFrame, schema: StructType) -> DataFrame:
    """Add every column of ``schema`` that ``df`` lacks as a typed NULL."""
    out = df
    for f in schema.fields:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    return out


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> DataFrame:
    """Persist the table partitioned by split (one folder per split, so a
    reader of one split prunes the others) and return the table read back."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Write ``df`` as csv (with header) or parquet; return it read back
    with the writer's schema."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
        return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)
    w.format(fmt).save(path)
    return df.sparkSession.read.format(fmt).load(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def log_runs(runs: DataFrame, path: str, run_col: str, metric_cols: list[str]) -> DataFrame:
    """Append metrics in long form (run, key, value) to a parquet log and
    return the rows of this call (tagged by a unique batch id)."""
    batch = uuid.uuid4().hex
    st = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in metric_cols)
    long = runs.select(F.col(run_col).cast("string").alias("run"),
                       F.expr(f"stack({len(metric_cols)}, {st}) AS (key, value)")).withColumn("batch", F.lit(batch))
    long.write.mode("append").parquet(path)
    return runs.sparkSession.read.parquet(path).where(F.col("batch") == batch).drop("batch")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
