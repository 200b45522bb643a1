import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from trilith.llm import resample as R

from .conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def feature_buckets(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in w + [a + " " + b for a, b in zip(w, w[1:])]]


def expected(rows, target, percent=25):
    """{position: (doc_id, n_features, weight, score, rank)} by plain Python."""
    found = [feature_buckets(t) for _, t in rows]
    s = Counter(b for _, f in found for b in f)
    t = Counter(b for x in target for b in feature_buckets(x)[1])
    n, m = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[i] + 1.0) * (n + 10000) / ((s[i] + 1.0) * (m + 10000)))) for i in range(10000)]
    out = []
    for (doc, _), (_, f) in zip(rows, found):
        weight = sum(gain[i] for i in f) // len(f) if f else 0
        u = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296))), None])
    able = [i for i in range(len(rows)) if found[i][0] >= 20]
    able.sort(key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0, out[i][1], out[i][2]))
    for place, i in enumerate(able[:percent * len(able) // 100]):
        out[i][4] = place + 1
    return [tuple(o) for o in out]


def key(r):
    return tuple(str(x) for x in r)


def check(docs, target):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    goal = [r["text"] for r in target.select("text").collect()]
    got = [tuple(r)[:5] for r in R.resample(docs, target).collect()]
    assert sorted(map(key, got)) == sorted(map(key, expected(rows, goal)))
    return got


def test_table_against_brute_force_with_small_heads(spark, docs, monkeypatch):
    """Few head words and a tiny pair table: state path, direct CRC and table
    all meet; long documents keep counts."""
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = check(docs.repartition(3), target)
    assert 0 < sum(r[4] is not None for r in got) < len(got)
    monkeypatch.setattr(R, "HEAD", 300)
    monkeypatch.setattr(R, "PAIR_BITS", 4)
    monkeypatch.setattr(R, "DENSE", 50)
    assert sorted(map(key, check(docs.repartition(3), target))) == sorted(map(key, got))


def test_crc_states_join_to_the_crc_of_pairs():
    words = [w.encode() for w in ("a", "the", "über", "日本", "x" * 64, "zz9")]
    v = R.Vocabulary(words, np.array([1, 8], dtype=np.int64))
    text = [*words, b"tail", *words[::-1], b"t2", b"t3", words[0], words[1], words[1], words[2]]
    ones, twos = v.features(text)
    assert ones.tolist() == [zlib.crc32(w) % 10000 for w in text]
    assert twos.tolist() == [zlib.crc32(a + b" " + b) % 10000 for a, b in zip(text, text[1:])]
    none = R.Vocabulary([], np.zeros(0, dtype=np.int64))
    assert none.features(text)[1].tolist() == twos.tolist()


def test_head_and_pairs_are_bounded(docs, monkeypatch):
    monkeypatch.setattr(R, "HEAD", 40)
    words, pairs = R.vocabulary(docs).value
    count = Counter(w for r in docs.select("text").collect() for w in R.words_of((r["text"] or "").encode()))
    total = sum(count.values())
    assert words == sorted(w for w, n in count.items() if n * 40 >= total and len(w) <= 64)
    assert 0 < len(words) <= 40 and len(pairs) <= 40


def test_odd_rows(spark, odd_docs, no_docs):
    target = spark.createDataFrame([("the quick brown fox",), (None,), ("",)], "text string")
    assert len(check(odd_docs, target)) == len(ODD)
    check(odd_docs, target.limit(0))
    assert R.resample(no_docs, target).count() == 0
    copies = odd_docs.where("doc_id = 7").select("doc_id", "text")
    for _ in range(4):
        copies = copies.unionByName(copies)
    got = check(copies, target)
    assert sorted(r[4] for r in got if r[4]) == [1, 2, 3, 4]


def test_the_draw_is_one_order_over_many_ranges(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(" ".join("abcdefghijklmnopqrstuvw")).alias("text"))
    got = R.resample(docs, docs.limit(0)).where("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 751))
    assert [(-r["score"], r["doc_id"]) for r in got] == sorted((-r["score"], r["doc_id"]) for r in got)
