import hashlib

import numpy as np

from trilith.llm import fingerprints as P
from trilith.llm.shingles import shingle_sets

from .conftest import ODD


def test_order_edit_and_estimates_against_brute_force(docs):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in P.fingerprint_documents(docs.repartition(5)).collect()}
    assert len(got) == len(rows)
    sets = dict(zip([r["doc_id"] for r in rows], shingle_sets([r["text"].encode() for r in rows], P.WIDTH)))
    errors = []
    for i, r in enumerate(rows):
        after, m, g = rows[(i + 1) % len(rows)], len(r["text"]) // 3, got[r["doc_id"]]
        edited = r["text"][:len(r["text"]) - m] + after["text"][:m]
        assert g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and g["n_chars"] == len(r["text"])
        a, b = sets[r["doc_id"]], shingle_sets([edited.encode()], P.WIDTH)[0]
        errors.append(abs(g["near_edited"] - len(np.intersect1d(a, b)) / len(np.union1d(a, b))))
        both = sets[after["doc_id"]]
        assert abs(g["near_next"] - len(np.intersect1d(a, both)) / len(np.union1d(a, both))) < 0.25
        assert abs(g["n_shingles_est"] / len(a) - 1) < 0.5
    assert np.mean(errors) < 0.05 and max(errors) < 0.25


def test_merging_parts_gives_the_whole():
    rng = np.random.default_rng(1)
    x, y = (rng.integers(0, 2 ** 64, n, dtype=np.uint64) for n in (5000, 300))
    assert (P.merge(P.sketch(x), P.sketch(y)) == P.sketch(np.concatenate([x, y]))).all()
    assert (P.read_sketch(P.written(P.sketch(x))) == P.sketch(x)).all()
    assert abs(P.distinct_count(P.sketch(x)) / 5000 - 1) < 0.3
    assert P.containment(P.sketch(y), P.sketch(np.concatenate([x, y]))) > 0.6
    assert P.resemblance(P.sketch(x), P.sketch(y)) < 0.05
    assert (P.sketch(x) == np.unique(x >> np.uint64(16))[:P.K]).all()


def test_odd_rows(odd_docs, no_docs):
    rows = P.fingerprint_documents(odd_docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(o[0]) for o in ODD)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["fingerprint"] == by[2][0]["fingerprint"] == by[2][1]["fingerprint"] != ""
    assert by[3][0]["fingerprint"] == by[4][0]["fingerprint"] == "" and by[3][0]["n_chars"] == 0
    # 5 (white space alone) is edited with 4 (empty); null ids come last and are followed by the first
    assert by[5][0]["near_next"] == 1.0
    assert P.fingerprint_documents(no_docs).count() == 0
    one = P.fingerprint_documents(odd_docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
