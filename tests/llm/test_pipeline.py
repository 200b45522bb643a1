"""Each stage against a brute-force version on its own input."""

import corpus_pipeline as C
from trilith.llm import bpe, mixing, secrets, toxicity
from trilith.llm.common import stored
from trilith.llm.queries import tokenizer_path

from .test_near_dups import brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in C.STAGES]
    assert names == ["toxicity", "near_dedup", "secret_scans", "mixing", "bpe"]
    at = docs
    for name, stage in C.STAGES:
        out = stored(stage(spark, at, SF), "t-stage")
        before = {r["doc_id"]: r for r in at.collect()}
        after = {r["doc_id"]: r for r in out.collect()}
        if name != "bpe":
            assert out.dtypes == docs.dtypes
        assert set(after) <= set(before) and len(after) == out.count()
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.score_documents(at, labels).where("predicted = 1").collect()}
            assert set(after) == set(before) - bad
        elif name == "near_dedup":
            roots = brute_components([(i, r["text"]) for i, r in before.items()], 5)
            assert set(after) == {i for i, r in roots.items() if i == r}
        elif name == "secret_scans":
            assert set(after) == set(before)
            assert {i: r["text"] for i, r in after.items()} == {i: secrets.redact(r["text"]) for i, r in before.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif name == "mixing":
            assert set(after) == {r["doc_id"] for r in mixing.mix_report(at).where("sampled").collect()}
            assert 0 < len(after) < len(before)
        else:
            codec = bpe.Codec(bpe.load_automaton(tokenizer_path()))
            assert {i: r["ids"] for i, r in after.items()} == {i: codec.encode(r["text"]) for i, r in before.items()}
            assert all(r["decoded"] == before[i]["text"] for i, r in after.items())
        at = out
    assert {r["doc_id"] for r in C.run(spark, SF).collect()} == set(after)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    for table in (odd_docs, no_docs):
        at = table
        for name, stage in C.STAGES:
            out = stored(stage(spark, at, SF), "t-stage")
            if name != "bpe":
                assert out.schema.fieldNames() == table.schema.fieldNames()
            at = out
        assert at.count() <= table.count()
