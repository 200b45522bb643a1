import glob
import zlib

import numpy as np
import pytest

from trilith.llm import token_store as T
from trilith.llm.common import fresh_path
from trilith.llm.queries import tokenizer_path

from .conftest import ODD


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def key(r):
    return tuple(str(x) for x in r)


def test_shards_against_the_library(spark, docs, library, monkeypatch):
    monkeypatch.setattr(T, "SHARD_ROWS", 30)
    path = fresh_path(spark, "tokens")
    catalog = T.write_store(docs.repartition(3), path, tokenizer_path())
    rows = sorted(tuple(r) for r in docs.select("doc_id", "text").collect())
    at, stream, want = 0, [], {}
    for (doc, _), e in zip(rows, library.encode_batch([t for _, t in rows], add_special_tokens=False)):
        ids = [*e.ids, 2]
        want[doc] = (at, len(ids), crc(ids), ids)
        at += len(ids)
        stream += ids
    got = T.read_store(spark, path, ids=True).collect()
    assert len(got) == len(rows) and catalog.count() >= len(rows) / 30
    assert all((r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == want[r["key"]] for r in got)
    # the files are nothing but the ids, in order, and an index
    raw = []
    for r in catalog.orderBy("shard").collect():
        with open(r["path"].removeprefix("file:"), "rb") as f:
            raw += np.frombuffer(f.read(2 * r["ids"]), dtype="<u2").tolist()
    assert raw == stream


def test_keyed_access(spark, docs, library):
    path = fresh_path(spark, "tokens")
    T.write_store(docs, path, tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    some = [*sorted(texts)[::7], 10 ** 12, -5]
    keys = spark.createDataFrame([(k,) for k in [*some, some[0], None]], "k long")
    got = T.read_keys(spark, path, keys).collect()
    assert sorted(r["key"] for r in got) == sorted(texts)[::7]
    for r in got:
        assert list(r["ids"]) == [*library.encode(texts[r["key"]], add_special_tokens=False).ids, 2]
    assert T.read_keys(spark, path, keys.where("k < 0")).count() == 0
    for name in glob.glob(path.removeprefix("file:") + "/shards/part-*"):
        with open(name, "rb") as f:
            s = T.open_shard(f)
            for k in s.keys[:5].tolist():
                (ids,) = s.get(k)
                assert ids.tolist() == [*library.encode(texts[k], add_special_tokens=False).ids, 2]
            assert s.get(-1) == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 100_000])
def test_the_hash_is_perfect_and_minimal(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(-2 ** 63, 2 ** 63 - 1, n)) if n % 2 == 0 else np.arange(n)
    seed, m, g = T.build_hash(keys)
    slots = T._slots(keys, seed, m, g, np.cumsum(g != 3) - 1)
    assert sorted(slots.tolist()) == list(range(len(keys)))


def test_foreign_keys_are_refused():
    keys = [None, None, *range(0, 5000, 3), 4998, 4998]
    index = T.shard_index(keys, [1] * len(keys), 2)
    raw = bytes(2 * len(keys)) + index + b"\x02\x00"
    s = T.Shard(lambda at, n: raw[at:at + n], len(raw))
    first, copies = s.find(np.arange(-5000, 10_000))
    assert copies.tolist() == [3 if k == 4998 else int(0 <= k < 5000 and k % 3 == 0) for k in range(-5000, 10_000)]
    assert s.documents().tolist() == list(range(len(keys)))


TRICKY = ["", " ", "  a", "a  b \n\n c", "don't can't 's 'S 'll'll d'dd", "x y\x85z\x1c\x1fq \x0b\x0c\t e",
          "½ ² ªº µ 1½2", "é ñ日本 😀  x​", "a<|endoftext|>b", "  <|endoftext|>  ", "''' '' 're 've''t",
          "x" * 500, "1234567890" * 20, "\r\n\r\n  \r\n", "!?.,;: !? ...", "ÀÖØöø÷×ÿ", "Ā ā ʰ ˁ ͅ", "٣ ४ Ⅷ ①"]


def test_pieces_are_the_library_s(library):
    with open(tokenizer_path(), encoding="utf-8") as f:
        e = T.Encoder(f.read())
    rng = np.random.default_rng(5)
    alphabet = list("ab'stredvml 0½é\n\t \x85!日<") + [" ", " ", "'"]
    texts = TRICKY + ["".join(rng.choice(alphabet, rng.integers(1, 60))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(e.encode(t), dtype=e.width).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_odd_rows(spark, odd_docs, no_docs, library):
    path = fresh_path(spark, "tokens")
    T.write_store(odd_docs, path, tokenizer_path())
    got = T.read_store(spark, path).orderBy("start").collect()
    want = sorted(((d is not None, d or 0), len([*library.encode(t or "", add_special_tokens=False).ids, 2]))
                  for d, t, *_ in ODD)
    assert [((r["key"] is not None, r["key"] or 0), r["n_tokens"]) for r in got] == want
    assert [r["start"] for r in got] == np.cumsum([0, *[n for _, n in want]])[:-1].tolist()
    assert T.read_keys(spark, path, spark.createDataFrame([(2,), (3,)], "k long")).count() == 4
    path = fresh_path(spark, "tokens")
    assert T.write_store(no_docs, path, tokenizer_path()).count() == 0
    assert T.read_store(spark, path).count() == 0
    with pytest.raises(ValueError):
        T.write_store(no_docs, path + "x", tokenizer_path(), end_id=50256)


def test_one_key_fills_many_shards(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(T, "SHARD_ROWS", 20)
    many = spark.range(300).selectExpr("7L AS doc_id", "concat('text ', id) AS text")
    path = fresh_path(spark, "tokens")
    catalog = T.write_store(many, path, tokenizer_path())
    assert catalog.count() > 8
    assert T.read_store(spark, path).agg({"n_tokens": "sum"}).first()[0] == catalog.agg({"ids": "sum"}).first()[0]
    assert T.read_keys(spark, path, spark.createDataFrame([(7,)], "k long")).count() == 300


def test_blocks_of_texts_are_encoded_as_each_alone(library, docs, monkeypatch):
    """Also with a tiny block and a table that is often cleared."""
    rng = np.random.default_rng(6)
    alphabet = list("ab'stredvmlé×ÀÿÃ 0") + [" ", " ", "'", "\n", "\t", ".", "!", "\x1f", "\x00"]
    texts = TRICKY + ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(4000)]
    texts += ["'s", "'re", "'r", "x'", "'", " 's", "a'll'", "'ll", "''s", "é's", "'dé", "1's 're2", " ", "\n ", " \n"]
    texts += [r["text"] or "" for r in docs.select("text").collect()]
    want = [np.array(e.ids, dtype="<u2").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    with open(tokenizer_path(), encoding="utf-8") as f:
        spec = f.read()
    for pieces, block in ((500_000, 1 << 20), (50, 300)):
        monkeypatch.setattr(T, "TABLE_PIECES", pieces)
        monkeypatch.setattr(T, "BLOCK", block)
        e = T.Encoder(spec)
        for _ in range(2):
            got = e.encode_many(texts)
            assert [t for t, a, b in zip(texts, got, want) if a != b] == []


def test_pieces_of_one_hash_are_told_apart(library):
    with open(tokenizer_path(), encoding="utf-8") as f:
        e = T.Encoder(f.read())
    e.table.values[0] = 1  # every piece of a length has the same first hash
    texts = ["one two six ten", "two one", " six one", "abc abd abc"]
    want = [np.array(x.ids, dtype="<u2").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
    assert e.encode_many(texts) == want == e.encode_many(texts)
