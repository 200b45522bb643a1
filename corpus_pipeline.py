"""Corpus pipeline: five stages from raw documents to token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``; all but the last
return the columns of ``documents``.

1. toxicity       documents predicted toxic go
2. near_dedup     one document of each group of near copies stays (five-word
                  shingles, similarity of 0.8 or more)
3. secret_scans   found secrets are masked in the text, ``n_chars`` follows
4. mixing         documents are sampled by calibrated probabilities
5. bpe            token ids of each text, with the decoded text

Null text is the empty text to every stage; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trilith.llm import bpe, mixing, near_dups, secrets, toxicity
from trilith.llm.common import stored
from trilith.llm.queries import tokenizer_path
from trilith.sources.tables import read_table


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.drop_near_duplicates(docs, width=5, percent=80)


def stage_secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample_documents(docs)


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, tokenizer_path())


STAGES = [("toxicity", stage_toxicity), ("near_dedup", stage_near_dedup), ("secret_scans", stage_secret_scans),
          ("mixing", stage_mixing), ("bpe", stage_bpe)]

#: Viterbi decoding, sketches and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
