import itertools
import random
import re

import numpy as np
import pytest

from trilith.llm import near_dups as N
from trilith.llm.components import components
from trilith.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(rows, width, percent=80):
    """id -> smallest id reachable, all pairs compared."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(brute_set(t, width))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        for x, y in itertools.product(sets[a], sets[b]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
                break
    return {i: find(i) for i in sets}


def check(spark, rows, width=4):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, width)
    got = N.near_duplicates(df, width).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want[r["doc_id"]], r
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    return got


def family(rng, words, n, start, most):
    out = []
    for i in range(n):
        w = list(words)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10 ** 6)}"
        out.append((start + i, " ".join(w)))
    return out


def test_near_copies_around_the_threshold(spark, monkeypatch):
    """Groups whose members are just above or below the threshold, in
    buckets cut into several blocks."""
    monkeypatch.setattr(N, "BLOCK", 7)
    rng = random.Random(11)
    rows = []
    for g in range(6):
        words = [f"g{g}x{rng.randrange(500)}" for _ in range(60)]
        rows += family(rng, words, 40, 100 * g, 4)
    rng.shuffle(rows)
    check(spark, rows)


def test_documents_of_the_table(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    check(spark, rows, width=4)


def test_odd_rows(odd_docs, no_docs):
    got = {}
    for r in N.near_duplicates(odd_docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[1][0]["component_id"] == 1 and got[2][0]["component_id"] == got[2][1]["component_id"] == 1
    assert not got[2][0]["kept"] and got[3][0]["kept"] and got[3][0]["n_shingles"] == 0
    assert got[9][0]["n_shingles"] == 1 and got[6][0]["n_shingles"] == 1 and got[5][0]["n_shingles"] == 0
    assert len(got[None]) == 3 and all(r["component_id"] is None and r["kept"] for r in got[None])
    assert N.near_duplicates(no_docs).count() == 0
    left = N.drop_near_duplicates(odd_docs)
    assert left.schema == odd_docs.schema
    ids = sorted(str(r["doc_id"]) for r in left.collect())
    assert ids == sorted(map(str, [1, 3, 4, 5, 6, 7, 8, 9, 10, None, None]))
    assert N.drop_near_duplicates(no_docs).count() == 0


def test_an_id_with_several_texts(spark):
    a, b = "one two three four five six seven", "red green blue black white grey pink"
    got = check(spark, [(1, a), (5, a), (5, b), (9, b), (9, b)])
    assert {r["component_id"] for r in got if r["doc_id"] == 5} <= {1}


def test_odd_sketches_estimate_high_similarity():
    rng = np.random.default_rng(2)
    for share in (0.95, 0.9, 0.8):
        base = rng.integers(0, 2 ** 64, 20_000, dtype=np.uint64)
        cut = int(len(base) * 2 * share / (1 + share))
        other = np.concatenate([base[:cut], rng.integers(0, 2 ** 64, len(base) - cut, dtype=np.uint64)])
        odd = N.odd_sketches(N.minima([np.unique(base), np.unique(other)]))
        count = int(np.bitwise_count(odd[0] ^ odd[1]).sum())
        differing = -N.BITS / 4 * np.log(1 - 2 * count / N.BITS)  # collisions undone
        assert abs(1 - differing / N.HASHES - share) < 0.12
        assert count <= N.xor_limit(80)


@pytest.mark.parametrize("shape", ["random", "path", "star"])
def test_components(spark, shape):
    rng = random.Random(6)
    links = {"random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)],
             "path": [(i, i + 1) for i in range(120)] + [(5, 5)], "star": [(0, i) for i in range(1, 200)] * 2}[shape]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_shingles_in_pieces(monkeypatch):
    from trilith.llm import shingles
    texts = [b"a b c d e f", b"", b" ", b"a", b"a b c d", b"long " * 50]
    whole = shingle_sets(texts, 4)
    monkeypatch.setattr(shingles, "PIECE", 16)
    for x, y in zip(whole, shingle_sets(texts, 4)):
        assert (x == y).all()
    assert [len(x) for x in whole] == [3, 0, 0, 1, 1, 1]
