"""A stream without files has a result: no rows of the scored columns."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trilith.sources import io as IO
from trilith.streaming import scoring


def test_no_file_has_arrived(spark, monkeypatch):
    monkeypatch.setattr(scoring, "batch_score", lambda df, *rest: df.select(
        "x", F.lit("a").alias("prediction"), F.create_map(F.lit("a"), F.lit(1.0)).alias("probabilities")))
    monkeypatch.setattr(scoring, "validate_requests", lambda df, bounds: df.withColumn(
        "is_valid", F.col("x") > 0).withColumn("reasons", F.lit("")))
    schema = StructType.fromDDL("x double")
    src, sink, check = (IO.fresh_path(spark, n) for n in ("empty-src", "empty-sink", "empty-check"))
    spark.createDataFrame([], schema).write.parquet(src)
    for name in ("first", "second"):
        got = scoring.stream_score(spark, src, schema, None, [], None, sink, check)
        if name == "first":
            assert got.count() == 0 and got.columns == ["x", "prediction"]
            spark.createDataFrame([(1.0,), (-1.0,)], schema).write.mode("append").parquet(src)
    assert [tuple(r) for r in got.collect()] == [(1.0, "a")]
