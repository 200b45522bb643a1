"""Structured Streaming scoring (§2.11).

The serving path becomes a stream: requests arrive as files, are validated,
scored by the same ``PipelineModel`` as the batch path (stateless, so the
stream result equals the batch result on the same rows) and appended to a
sink.  Running counters are a complete-mode aggregate (two numbers of
state, no watermark needed: the count is cumulative by definition).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.stats import fround
from ..operators.evaluate import validate_requests
from ..operators.score import batch_score


def prediction_log(df: DataFrame, ts: str, prediction: str = "prediction", confidence: str = "confidence",
                   price: str = "price", out: str = "log") -> DataFrame:
    """One JSON record per prediction: timestamp (UTC, second precision,
    whatever the session time zone), prediction, confidence (4 decimals),
    price (2 decimals)."""
    if df.schema[ts].dataType.typeName() == "timestamp_ntz":
        utc = F.col(ts)  # wall-clock value: rendering does not depend on the session zone
    else:
        tz = df.sparkSession.conf.get("spark.sql.session.timeZone", "UTC")
        utc = F.convert_timezone(F.lit(tz), F.lit("UTC"), F.col(ts).cast("timestamp_ntz"))
    rec = F.struct(F.date_format(utc, "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
                   F.col(prediction).alias("prediction"),
                   fround(F.col(confidence), 4).alias("confidence"),
                   fround(F.col(price), 2).alias("price"))
    return df.select(F.to_json(rec, {"ignoreNullFields": "false"}).alias(out))


def prediction_metrics(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    """Prediction count and mean confidence (4 decimals, 0 when none)."""
    return df.agg(F.count(F.lit(1)).alias("n_predictions"),
                  F.coalesce(F.round(F.avg(confidence), 4), F.lit(0.0)).alias("mean_confidence"))


def stream_score(spark: SparkSession, src: str, schema: StructType, clf: PipelineModel, labels: list[str],
                 reg: PipelineModel | None, sink: str, checkpoint: str, keep: list[str] | None = None,
                 fmt: str = "parquet", bounds: dict | None = None) -> DataFrame:
    """Validate and score every file under ``src``; valid rows are scored
    and appended to ``sink``, rejected rows (with reasons) to
    ``sink + '_rejected'``.  Runs with ``availableNow`` and returns the
    scored sink table."""
    stream = spark.readStream.schema(schema).format(fmt).load(src)
    checked = validate_requests(stream, bounds)

    def per_batch(batch: DataFrame, epoch: int) -> None:
        # one folder per micro-batch, overwritten: a batch replayed after a failure
        # replaces its own output instead of appending duplicates (exactly-once effect)
        ok = batch.where("is_valid").drop("is_valid", "reasons")
        batch_score(ok, clf, labels, reg, keep).drop("probabilities") \
            .write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")
        batch.where(~F.col("is_valid")).write.mode("overwrite").parquet(f"{sink}_rejected/epoch={epoch}")

    q = (checked.writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    try:
        return spark.read.parquet(sink).drop("epoch")
    except AnalysisException:  # no file has arrived yet
        none = spark.createDataFrame([], schema)
        return batch_score(none, clf, labels, reg, keep).drop("probabilities").where(F.lit(False))


def stream_prediction_metrics(spark: SparkSession, src: str, schema: StructType, name: str,
                              confidence: str = "confidence", fmt: str = "parquet") -> DataFrame:
    """Running count and mean confidence over a file stream (complete
    mode into a memory table); returns the final snapshot."""
    stream = spark.readStream.schema(schema).format(fmt).load(src)
    agg = stream.agg(F.count(F.lit(1)).alias("n_predictions"), F.avg(confidence).alias("_m"))
    q = agg.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.sql(f"SELECT n_predictions, coalesce(round(_m, 4), 0.0) AS mean_confidence FROM {name}")
