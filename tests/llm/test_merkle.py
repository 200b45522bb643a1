import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from trilith.llm import merkle as M

from .conftest import ODD


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, i):
    out = []
    for nodes in tree[:-1]:
        b = i // 3 * 3
        out.append(("".join(nodes[b:i]), "".join(nodes[i + 1:b + 3])))
        i //= 3
    return out


def expected(rows):
    """Result rows of (doc_id, source, lang, n_chars, text) rows, in any order."""
    groups = {}
    for doc, source, lang, n, text in rows:
        head = field(doc) + field(source) + field(lang) + field(n)
        hit = doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 2 == 0
        groups.setdefault(source, []).append(
            ((doc is not None, doc or 0), h(head, field(text)),
             h(head, field(text.replace("\n", "") if hit else text)), doc))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort()
        trees[s] = levels([g[1] for g in groups[s]])
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for j, s in enumerate(order):
        for i, (_, leaf, other, doc) in enumerate(groups[s]):
            steps, folded = path(trees[s], i) + path(top, j), other
            for a, b in steps:
                folded = h(a, folded, b)
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], h(*[a + b for a, b in steps]), folded,
                        folded == top[-1][0]))
    return out


def key(r):
    return tuple(str(x) for x in r)


@pytest.mark.parametrize("levels_per_tier", [1, 2, 6])
def test_manifest_against_brute_force_and_over_several_tiers(spark, monkeypatch, levels_per_tier):
    """Sources of 1 to 40 rows, one of them null, blocks of 3, 9 and 729."""
    monkeypatch.setattr(M, "LEVELS", levels_per_tier)
    monkeypatch.setattr(M, "BLOCK", 3 ** levels_per_tier)
    sizes = {None: 2, "": 1, "a": 3, "é": 4, "z": 40, "z2": 28, "Z": 9, "b": 10}
    rows, doc = [], 0
    for s, n in sizes.items():
        for i in range(n):
            rows.append((doc * 7 % 101, s, "en" if i % 3 else None, i, f"text {i}\nof {s}" if i % 4 else "plain"))
            doc += 1
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = M.audit(df.repartition(5)).collect()
    assert sorted(map(key, got)) == sorted(map(key, expected(rows)))
    assert {r["verified"] for r in got} == {True, False}


def test_odd_rows(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = M.audit(odd_docs).collect()
    assert len(got) == len(ODD) and sorted(map(key, got)) == sorted(map(key, expected(rows)))
    assert M.audit(no_docs).count() == 0
    one = M.audit(odd_docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["verified"]
    assert one[0]["proof_sha256"] == h()


def test_a_proof_folds_to_the_root_and_another_text_does_not(docs):
    m = M.manifest(docs, carry={"other": M.leaf_digest(F.lit("x"))})
    row = m.select(F.min((M.fold(F.col("leaf"), F.col("path")) == F.col("root")).cast("int")),
                   F.max((M.fold(F.col("other"), F.col("path")) == F.col("root")).cast("int"))).first()
    assert tuple(row) == (1, 0)


def test_blocks_need_one_exchange(spark):
    rows = spark.createDataFrame([("a", 5, 0, "h", 1)], "`group` string, n long, rank long, hash string, item long")
    plan = M._rollup(rows, ["group"], 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
