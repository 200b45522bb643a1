import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from trilith.llm import bpe
from trilith.llm.queries import tokenizer_path

from .conftest import ODD


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_automaton(tokenizer_path()))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def test_matches_the_library_on_random_strings(codec, library):
    rng = random.Random(3)
    bits = ["a", "aa", "the", " ", "  ", "\n", "\t", "é", "日", "😀", "'s", "'ll", "12", "!!", "<|endoftext|>", "ing", "ſ",
            "\x00", "́", "٣", "ⅷ", "_", "==", " "]
    texts = ["".join(rng.choice(bits) * rng.randint(1, 5) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    for text, ids in zip(texts, codec.encode_batch(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want, text
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_long_words_and_runs(codec, library):
    for text in ["a" * 5000, "ab" * 3000, " " * 3000, "é" * 2000, "aaaaaaa" + "x" * 64 + "y" * 65]:
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_automaton_follows_exactly_the_tokenizations(codec, library):
    """A pair of labels is a path of the automaton iff the library splits
    their string so (no pre-split border inside)."""
    a, rng = codec.automaton, random.Random(5)
    plain = [i for i, s in a.labels.items() if s.isalpha() and s.isascii()]
    for _ in range(3000):
        x, y = rng.choice(plain), rng.choice(plain)
        word = (a.labels[x] + a.labels[y]).decode()
        assert a.follows(x, y) == (library.encode(word).ids == [x, y])


def test_scalar_and_table_driven_encoders_agree(codec):
    words = [w.encode() for t in (o[1] for o in ODD[:10]) if t for w in t.split()[:3000] if len(w.encode()) <= 64]
    assert codec.encode_words(words) == [codec.automaton.encode_word(w) for w in words]


def test_odd_rows(spark, odd_docs, no_docs, library):
    rows = bpe.encode_documents(odd_docs, tokenizer_path()).collect()
    assert len(rows) == len(ODD)
    for r, (doc_id, text, *_) in zip(rows, ODD):
        assert (r["doc_id"], r["decoded"]) == (doc_id, text or "")
        assert r["ids"] == library.encode(text or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
    assert bpe.encode_documents(no_docs, tokenizer_path(), digests=True).count() == 0


def test_the_table_grows_until_new_keys_fit():
    t = bpe.Table(lambda k: k % 11, bits=4)
    keys = np.arange(600_000, dtype=np.int64) * 5
    assert (t.get(keys) == keys % 11).all() and (t.get(keys[::-7]) == keys[::-7] % 11).all()
    assert t.mask > 3 * 600_000
