"""Quota-exact split: hashes are taken once, and rows are compared cheaply."""

import hashlib
import os
from collections import defaultdict

from pyspark.sql import functions as F

from trilith.operators.split import quota_cuts, stratified_split
from trilith.session import scratch_path


def test_the_input_is_read_once_for_the_cuts(spark):
    n, seen = 3000, spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(n).select("id", F.concat(F.lit("g"), F.col("id") % 3).alias("lab")).mapInArrow(counted, "id long, lab string")
    got = stratified_split(df, "id", "lab")
    assert seen.value == n
    assert got.count() == n


def test_a_filter_on_the_split_takes_one_hash_a_cut(spark):
    df = spark.range(500).select("id", F.concat(F.lit("g"), F.col("id") % 5).alias("lab"))
    test = stratified_split(df, "id", "lab").where(F.col("split") == "test").select("id")
    plan = test._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") <= 2 and "conv(" not in plan


def test_the_narrow_table_does_not_stay(spark):
    folder = scratch_path(spark, "").removeprefix("file:")
    df = spark.range(100).select("id", F.lit("g").alias("lab"))
    assert stratified_split(df, "id", "lab").where("split = 'train'").count() == 70
    assert not [x for x in os.listdir(folder) if x.startswith("split-keys")]


def test_repeated_ids_and_null_labels(spark):
    rows = [(i // 2 if i % 3 else i, None if i % 7 == 0 else f"g{i % 4}") for i in range(2000)] + [(5, "one")]
    parts = defaultdict(list)
    for i, lab in rows:
        parts[lab].append((hashlib.md5(f"{i}42".encode()).hexdigest(), i))
    want = defaultdict(int)
    for lab, keys in parts.items():
        first, second = (sorted(keys)[c - 1] if c else ("", 0) for c in quota_cuts(len(keys), (0.70, 0.15, 0.15)))
        for key in keys:
            name = "unlabelled" if lab is None else "train" if key <= first else "val" if key <= second else "test"
            want[(key[1], lab, name)] += 1
    got = defaultdict(int)
    for r in stratified_split(spark.createDataFrame(rows, "id long, lab string").repartition(5), "id", "lab").collect():
        got[tuple(r)] += 1
    assert got == want
