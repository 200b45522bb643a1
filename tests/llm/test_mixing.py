from pyspark.sql import functions as F

from trilith.llm import mixing as M

from .conftest import ODD


def test_raked_weights_meet_the_targets(docs):
    rows = M.mix_report(docs).select("source", "lang", "topic", "n_tokens", "weight", "probability").collect()
    cells = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in rows}
    total = sum(cells.values())
    assert abs(total - 1) < 1e-6 and max(r["probability"] for r in rows) == 1.0
    for i in range(3):
        tokens, weights = {}, {}
        for r in rows:
            tokens[r[i]] = tokens.get(r[i], 0) + r["n_tokens"]
        for c, w in cells.items():
            weights[c[i]] = weights.get(c[i], 0) + w
        norm = sum(t ** M.ALPHA for t in tokens.values())
        for k, t in tokens.items():
            assert abs(weights[k] - t ** M.ALPHA / norm) < 1e-6


def test_sample_follows_given_targets(spark, docs):
    """Many copies with other ids: the sampled tokens have the wanted shares."""
    many = docs.crossJoin(spark.range(40).withColumnRenamed("id", "_copy")).withColumn(
        "doc_id", F.col("doc_id") * 100 + F.col("_copy"))
    langs = spark.createDataFrame([("en", 0.4), ("de", 0.3), ("fr", 0.2), ("es", 0.1)], "lang string, share double")
    out = M.mix_report(many, targets={"lang": langs}).where("sampled").groupBy("lang").agg(F.sum("n_tokens").alias("t"))
    got = {r["lang"]: r["t"] for r in out.collect()}
    total = sum(got.values())
    for r in langs.collect():
        assert abs(got[r["lang"]] / total - r["share"]) < 0.06


def test_one_stray_row_hardly_changes_what_is_kept(spark):
    source = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 19))
    lang = F.element_at(F.array(*map(F.lit, ["en", "de", "fr", "es"])), (F.col("id") % 7 % 4 + 1).cast("int"))
    many = spark.range(10_000).select(F.col("id").alias("doc_id"), source.alias("source"), lang.alias("lang"),
                                      F.lit("some plain words of a text").alias("text"))
    stray = spark.createDataFrame([(-1, "new", None, "some plain words of a text")],
                                  "doc_id long, source string, lang string, text string")
    runs = [{r["doc_id"]: r for r in M.mix_report(d).collect()} for d in (many, many.unionByName(stray))]
    for rows in runs:
        expected = sum(r["n_tokens"] * r["probability"] for r in rows.values())
        assert abs(expected / sum(r["n_tokens"] for r in rows.values()) - M.RATE) < 1e-4
    assert runs[1][-1]["probability"] == 1.0
    assert max(abs(r["probability"] - runs[1][i]["probability"]) for i, r in runs[0].items()) < 0.01


def test_decisions_do_not_depend_on_partitions(docs):
    a = M.sample_documents(docs.repartition(7)).select("doc_id").collect()
    b = M.sample_documents(docs.coalesce(1)).select("doc_id").collect()
    assert sorted(a) == sorted(b)


def test_odd_rows(odd_docs, no_docs):
    rows = M.mix_report(odd_docs).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault((r["doc_id"], r["n_tokens"]), set()).add(r["sampled"])
    assert all(len(v) == 1 for v in by.values())
    assert {r["source"] for r in rows} == {"a", "b", "c", "(none)"}
    kept = M.sample_documents(odd_docs)
    assert kept.schema.fieldNames() == odd_docs.schema.fieldNames()
    assert kept.count() == sum(r["sampled"] for r in rows)
    assert M.mix_report(no_docs).count() == 0
    empty = odd_docs.where("text IS NULL")
    assert {r["probability"] for r in M.mix_report(empty).collect()} == {0.0}


def test_topics(spark):
    texts = ["Licensed under X", "write to a.b@c.org", "x | y | z", "buy $$$ now", "plain words", None]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)],
                               "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["topic"] for r in M.mix_report(df).collect()}
    assert [got[i] for i in range(6)] == ["legal", "contact", "table", "noise", "prose", "prose"]


def test_cells_beside_a_full_one_make_up_for_it(spark):
    """A rare cell is kept whole; its language and topic still get their share."""
    cells = spark.createDataFrame([("a", "en", "prose", 900.0), ("b", "en", "prose", 800.0), ("b", "de", "prose", 10.0),
                                   ("a", "de", "prose", 700.0)], "source string, lang string, topic string, tokens double")
    shares = {"source": [("a", 0.7), ("b", 0.3)], "lang": [("en", 0.6), ("de", 0.4)], "topic": [("prose", 1.0)]}
    targets = {d: spark.createDataFrame(v, f"{d} string, share double") for d, v in shares.items()}
    raked, budget = M.rake(cells, targets), 0.7 * 2410
    assert any(r["weight"] * budget > r["tokens"] for r in raked.collect())
    out = {(r["source"], r["lang"]): r for r in M.expected_tokens(raked, 0.7).collect()}
    kept = {k: r["expected"] for k, r in out.items()}
    assert abs(kept["b", "de"] - 10) < 1e-3 and all(r["expected"] <= r["tokens"] for r in out.values())
    for at, dim in enumerate(("source", "lang")):
        for name, share in shares[dim]:
            assert abs(sum(v for k, v in kept.items() if k[at] == name) - share * budget) < 1e-4 * budget


def test_new_topics(spark):
    texts = ["see https://x.y", "int a;\nint b;\n", "- one\n- two", "from 120 to 340 units", "12 plain words"]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)],
                               "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["topic"] for r in M.mix_report(df).collect()}
    assert [got[i] for i in range(5)] == ["link", "code", "list", "figures", "prose"]
