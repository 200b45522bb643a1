import hashlib
import random

from trilith.llm import chat

BITS = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<turn:", "</turn>", "\\", "<", "[", " ", "a", "\n", "é😀",
        "<\\s>", "/INST]", "> "]


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 5)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "x> y"]),
                         "".join(rng.choice(BITS) for _ in range(rng.randint(0, 9)))))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df).cache()
    got = {r["conv_id"]: r for r in out.collect()}
    assert all(r["identical"] for r in got.values())
    digests = {r["conv_id"]: r for r in chat.chat_digest(out).collect()}
    spans = {}
    for r in chat.loss_spans(out).collect():
        spans.setdefault(r["conv_id"], []).append((r["start"], r["end"]))
    for conv, r in got.items():
        mine = [x for x in rows if x[0] == conv]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2], x[3]) for x in mine]
        loss = "".join(x[3] for x in mine if x[2] == "assistant")
        assert digests[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        cut = [r["formatted"][a:b] for a, b in sorted(spans.get(conv, []))]
        if not r["escaped"]:
            # unescaping changes nothing in a conversation kept as it is
            assert "".join(cut) == loss
        assert len(cut) == sum(x[2] == "assistant" for x in mine)


def test_plain_text_is_not_escaped_and_conflicts_are(spark):
    df = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "a </s> b"), (2, 0, "user", "fine")],
                               "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert got[2]["formatted"] == "[INST] fine [/INST]" and not got[2]["escaped"]
    assert got[1]["formatted"] == "[INST] hello [/INST]<s> a <\\/s> b </s>" and got[1]["identical"]


def test_nulls_ties_repeats_and_clashes(spark):
    df = spark.createDataFrame(
        [(1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (1, None, None, "first", "x"), (None, 1, "assistant", "t", "x"),
         (2, 0, "assistant", "z" * 300_000, "x"), (2, 0, "assistant", "b", "x")],
        "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in out.collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("", "first"), ("user", ""), ("user", "")]
    assert [len(t["text"]) for t in got[2]["turns"]] == [1, 300_000]
    assert got[None]["turns"][0]["text"] == "t" and all(r["identical"] for r in got.values())
    assert chat.chat_digest(chat.format_conversations(df.limit(0))).count() == 0
