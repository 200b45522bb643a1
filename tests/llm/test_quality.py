import re

from trilith.llm import quality as Q

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered))


def base(r):
    return tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))


def test_base_rules_against_brute_force(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in Q.quality(docs).collect():
        assert base(r) == brute(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])


def test_lines_shared_by_many_documents_go(spark):
    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    note = "This  site uses COOKIES " + " ".join(f"c{j}" for j in range(60))
    rows = [(i, f"{note}\n{own(i, 40)}", "h") for i in range(30)]  # 40 of 104 words left: kept
    rows += [(100 + i, f"{note.lower()}\n{own(100 + i, 25)}", "h") for i in range(5)]  # 25 of 89 words: depleted
    rows += [(200 + i, own("same", 50), "h") for i in range(60)]  # one distinct document
    rows += [(300, f"{note}\n{own(300, 25)}", "other")]  # not frequent there
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in Q.quality(df).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r["removed_words"] == (64 if i < 200 else 0)
        assert r["kept"] == (not 100 <= i < 200) and not r["base_failed"]


def test_cleaned_texts_lack_the_removed_lines(spark):
    rows = [(i, f"Same  note HERE\n\nown{i} word\nsame note here", "h") for i in range(30)]
    rows += [(50 + i, f"rare line\nmine{i}", "h") for i in range(11)] + [(70, None, None), (71, "Same note here", "other")]
    rows += [(100 + i, f"filler{i}", "h") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in Q.clean_texts(df).collect()}
    assert len(got) == len(rows) and got[3] == "\nown3 word" and got[50] == "rare line\nmine0"
    assert got[70] is None and got[71] == "Same note here"
    words = {r["doc_id"]: r["n_words"] - r["removed_words"] for r in Q.quality(df).collect()}
    assert words == {i: len(WORD.findall(t or "")) for i, t in got.items()}
    assert {r["doc_id"]: r["text"] for r in Q.clean_texts(df, share=0.0).collect()}[50] == "mine0"


def test_odd_rows(odd_docs, no_docs):
    rows = Q.quality(odd_docs).collect()
    assert len(rows) == len(ODD)
    want = sorted((str(o[0]), *brute(o[1])) for o in ODD)
    assert sorted((str(r["doc_id"]), *base(r)) for r in rows) == want
    assert all(not r["kept"] for r in rows if r["n_words"] < 20)
    assert Q.quality(no_docs).count() == 0


def test_the_limit_is_the_same_on_large_and_small_hosts(spark):
    """A line of 30 documents goes on a host of 40 and on one of 2000."""
    lines = [(i, host, f"common line of words\nown text number {i} on {host} " + " ".join(f"w{i}x{j}" for j in range(30))
              if i % 2000 < 30 else f"other text number {i} " + " ".join(f"v{i}x{j}" for j in range(30)))
             for host, start, n in (("small", 0, 40), ("large", 2000, 2000)) for i in range(start, start + n)]
    df = spark.createDataFrame(lines, "doc_id long, source string, text string")
    got = Q.quality(df, share=0.0).where("removed_words > 0").groupBy().agg({"*": "count"}).first()[0]
    assert got == 60
