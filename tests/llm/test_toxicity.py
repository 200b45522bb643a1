import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trilith.llm import toxicity as T

from .conftest import ODD


@pytest.fixture(scope="module")
def medium(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


@pytest.fixture(scope="module")
def model(medium):
    return T.language_model(medium[0])


def test_counts_against_brute_force():
    texts = ["The cat, theé 7 the", "", "a", "日x"]
    cells = np.zeros(T.CELLS, dtype=np.int64)
    T.count_into(cells, "\n".join(texts))
    want = np.zeros(T.CELLS, dtype=np.int64)
    for word in "\n".join(texts).replace(",", " ").replace("7", " ").split():
        s = [0, 0, 0] + [T.symbol(c) for c in word.lower()] + [0]
        for i in range(3, len(s)):
            if not s[i] and not s[i - 1]:
                continue
            want[((s[i - 3] * T.SYMBOLS + s[i - 2]) * T.SYMBOLS + s[i - 1]) * T.SYMBOLS + s[i]] += 1
    assert (cells == want).all()
    pieces = np.zeros(T.CELLS, dtype=np.int64)
    T.count_into(pieces, " ".join(["ab"] * 50), piece=7 * 3)
    whole = np.zeros(T.CELLS, dtype=np.int64)
    T.count_into(whole, " ".join(["ab"] * 50))
    assert (pieces == whole).all()


def test_restored_spellings(model):
    for seen, meant in {"1d10t": "idiot", "m0r0n!!": "moron", "idiooooot": "idiot", "i.d.i.o.t": "idiot", "$cum": "scum",
                        "l0$er": "loser", "tra$h": "trash", "st*pid,": "stupid", "MORON": "moron", "p4th3t1c": "pathetic",
                        "the": "the", "2024": "2024", "": "", "...": ""}.items():
        assert T.restore(seen, model) == meant
    assert "idiot" in T.restored_words("you i d i o t there", T.Tokens(model))


def test_partly_separated_and_short_spellings(model):
    for seen, meant in {"stu-pid": "stupid", "st.u.pid": "stupid", "mo_ron": "moron", "id/iot": "idiot", "lo~ser,": "loser",
                        "st.up1d": "stupid", "2024-01-05": "2024-01-05", "3.14": "3.14"}.items():
        assert T.restore(seen, model) == meant
    for text, word in {"you stu pid one": "stupid", "a mo ron here": "moron", "the st up id thing": "stupid",
                       "you id 10t there": "idiot", "moron/idiot": "idiot", "so stu-pid!": "stupid"}.items():
        assert word in T.restored_words(text, T.Tokens(model))
    counts = np.zeros(T.CELLS, dtype=np.int64)
    T.count_into(counts, "what shit you ass " * 1000)
    abuse = T.CharModel(counts)
    assert T.restore("5h!7", abuse) == "shit" and T.restore("a$$", abuse) == "ass" and T.restore("@$$", abuse) == "ass"


def test_held_out_accuracy(medium, model):
    docs, labels = medium
    rows = (T.score_documents(docs, labels).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL")
            .select("doc_id", "score", "predicted", "toxic").collect())
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    score, y = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    order = np.argsort(np.argsort(score))
    auc = (order[y == 1].mean() - (y.sum() - 1) / 2) / (1 - y).sum()
    hit = np.array([r["predicted"] for r in rows])
    assert auc > 0.93 and (hit & y).sum() / hit.sum() > 0.95 and (hit & y).sum() / y.sum() > 0.75
    assert ((score >= 0) & (score <= 1)).all()


def test_obfuscated_documents_are_found(spark, medium):
    docs, labels = medium
    clean = docs.join(labels.where("toxic = 0"), "doc_id").where("lang = 'en'").orderBy("doc_id").limit(20)
    for i, words in enumerate(["1d10t m0r0n l0$er $cum", "idiooot scuuuum moron!!!", "i d i o t and s-c-u-m and m.o.r.o.n"]):
        more = clean.select((F.col("doc_id") + 10 ** 9 + 100 * i).alias("doc_id"), F.concat(
            "text", F.lit(f" {words} ")).alias("text"), "lang", "source", "n_chars")
        docs = docs.unionByName(more)
    got = T.score_documents(docs, labels).where(f"doc_id >= {10 ** 9}").agg(F.avg("predicted")).first()[0]
    assert got > 0.9


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (7, 0), (9, 0), (10, 0), (None, 1), (2, None), (8, 0), (6, 1), (6, 1)],
                                   "doc_id long, toxic int")
    rows = T.score_documents(odd_docs, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["text_md5"], set()).add(r["score"])
    assert all(len(v) == 1 for v in by.values())
    assert T.score_documents(no_docs, labels).count() == 0
    none = T.score_documents(odd_docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert T.drop_toxic(odd_docs, labels.limit(0)).schema == odd_docs.schema
    assert T.drop_toxic(odd_docs, labels.limit(0)).count() == len(ODD)


def spelled_score(text, cost, model):
    s, total = (0, 0, 0), cost
    for ch in text + " ":
        x = T.symbol(ch)
        if x or s[2]:
            total += float(model.log[s[0], s[1], s[2], x])
        s = (s[1], s[2], x) if x else (0, 0, 0)
    return total


def test_the_decoder_finds_the_best_of_all_paths(model):
    rng = np.random.default_rng(3)
    alphabet = list("iadots0135@$!*.-_ eé")
    for _ in range(300):
        token = "".join(rng.choice(alphabet, rng.integers(1, 7))).strip() or "a"
        for spaced in (False, True):
            paths = T.lattice(token, spaced)
            every = [("".join(t for t, _ in p), sum(c for _, c in p)) for p in itertools.product(*paths)]
            best = max(spelled_score(t, c, model) for t, c in every)
            got = T.viterbi(paths, model)
            assert max(spelled_score(t, c, model) for t, c in every if t.strip() == got) == pytest.approx(best, abs=1e-4)


def test_split_words_are_read_as_the_lattice_reads_them(model):
    rng = np.random.default_rng(4)
    pieces = "stu pid id iot mo ron the of a to, it's in l0 ser ooo re st* é nä! 10t 7 o. x".split()
    tokens = T.Tokens(model)
    weights = {zlib.crc32(w.encode()) % (T.BUCKETS // T.LEVELS) * T.LEVELS: 1.0
               for w in ("=stupid", "^idi", "^moro", "=loser", "=theof")}
    evidence = T.Evidence(model, weights, 0.0)
    for _ in range(1500):
        key = " ".join(rng.choice(pieces, rng.integers(2, 4)))
        words = T.PART_RE.findall(T.restore(key, model))
        letters = all(any(c.isalpha() or c in T.LEET for c in x) for x in key.split(" "))
        want = tuple(words) if letters and len(words) == 1 else ()
        assert tokens.split[key] == want, key
        assert evidence.split[key] == evidence.chosen(want), key


def test_weighted_words_are_those_with_a_feature(model):
    words = ["stupid", "stu", "st", "moronic", "moro", "éclair", "é", "", "idiotically", "日本語の文"]
    table = T.Features()
    ids = sorted({k for w in words[::2] for k in table[w]})[::3]
    e = T.Evidence(model, dict.fromkeys(ids, 1.0), 0.0)
    for w in [*words, "other", "morons", "éclat"]:
        assert e.weighted(w) == any(k in e.based for k in table[w])


def test_the_fit_meets_the_condition_of_the_optimum():
    """At the minimum of the balanced, regularised loss the gradient is zero;
    a Newton solver of the same loss gives the same weights."""
    rng = np.random.default_rng(1)
    n, d = 3000, 6
    x = rng.random((n, d)) < np.linspace(0.2, 0.7, d)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ np.array([3, -3, 2.5, -2.5, 3, -3]) + 0.5)))).astype(float)
    flat, sizes = np.nonzero(x)[1] * T.LEVELS, x.sum(axis=1)
    w, bias = T.fit(flat, sizes, y, np.array([1.0, 1.0]), rounds=4000)
    cols = [k // T.LEVELS for k in sorted(w)]
    a = np.column_stack([x[:, cols].astype(float), np.ones(n)])
    rate = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum())) * n
    penalty = np.append(np.full(len(cols), 1e-4), 0.0)
    v = np.zeros(len(cols) + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ v))
        grad = a.T @ (rate * (p - y)) / n + penalty * v
        v -= np.linalg.solve((a.T * (rate * p * (1 - p))) @ a / n + np.diag(penalty), grad)
    prior = 0.5 * np.log(y.sum() / (n - y.sum()))
    assert len(cols) >= 4
    assert np.allclose([w[k] for k in sorted(w)], v[:-1], atol=0.05) and abs(bias - prior - v[-1]) < 0.05


def test_rows_are_dropped_where_they_are_scored(spark, medium):
    docs, labels = medium
    docs = docs.where("doc_id < 1500")
    scored = T.score_documents(docs, labels).where("predicted = 0").select("doc_id")
    kept = T.drop_toxic(docs, labels)
    assert kept.schema == docs.schema and "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(kept.select("doc_id").collect()) == sorted(scored.collect())
    few = T.drop_toxic(docs.withColumn("doc_id", F.col("doc_id").cast("int")), labels)
    assert few.count() == kept.count()


def test_the_sieve_drops_nothing_that_counts(model, medium):
    rng = np.random.default_rng(8)
    weights = {zlib.crc32(w.encode()) % (T.BUCKETS // T.LEVELS) * T.LEVELS: float(i + 1)
               for i, w in enumerate(["=stupid", "^idi", "^moro", "=été", "^élé", "=2024", "=theof", "^ßaß", "=stu", "=日本"])}
    evidence, plain = T.Evidence(model, weights, -1.0), T.Evidence(model, weights, -1.0)
    pieces = ("stu pid stupid STUPID, id iot idiot idiooot mo-ron \"moron.\" été ÉTÉ (élégant) élé gant ßaß ééé été! 2024 2024, "
              "the of, the.of é×t×é i d i o t a b 日本 日 本 x÷y st*pid l0$er ... -- ( ) !!! 't o' morons' aaa").split()
    gaps = [" "] * 12 + ["\n", "  ", "\t", "\x1f", "\xa0", "\u3000", "\x85"]
    texts = ["", " ", "stupid", "\x00 stupid\x00", "x" * 40 + "idiot", "é" * 30]
    for _ in range(800):
        n = int(rng.integers(1, 25))
        texts.append("".join(x + str(y) for x, y in zip(rng.choice(pieces, n), rng.choice(gaps, n))))
    alphabet = list("stupidmo é-!.,'0($*ß") + [" "] * 5
    texts += ["".join(rng.choice(alphabet, int(rng.integers(1, 60)))) for _ in range(3000)]
    texts += [r["text"] or "" for r in medium[0].where("doc_id < 300").select("text").collect()]
    assert evidence.log_odds_many(texts) == [plain.log_odds(t) for t in texts]
