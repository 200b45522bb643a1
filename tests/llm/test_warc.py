import base64
import hashlib

import numpy as np
import pytest

from trilith.llm import warc
from trilith.llm.common import fresh_path

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip_with_magic_in_payloads(spark):
    rows = [(5, "http://a/", "same"), (3, "http://b/\r\nX: y", "same"), (9, None, FAKE * 3), (8, "u", FAKE + "\r\n\r\n" * 4),
            (1, "u", None), (2, "u", ""), (7, "u", "é😀\r\n"), (6, "u", "x" * 500_000), (3, "u", "same"), (None, "u", "same"),
            (None, "u", "alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS payload")
    path = fresh_path(spark, "t-warc")
    warc.write_warc(df.coalesce(1), path, records_per_file=4)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(rows) and all(r["payload_ok"] for r in got)
    want = []
    for page, _, html in rows:
        first = min((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=page)
        kind = "response" if page == first else "revisit"
        want.append((page, len((html or "").encode()), digest(html), kind, None if kind == "response" else first))
    have = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    path = fresh_path(spark, "t-warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


def test_long_urls_lose_no_record(spark):
    rows = [(1, "u" * 100_000, "first"), (2, "u", "second"), (3, "http://x/" + "y" * 300_000, FAKE), (4, "u", "last")]
    path = fresh_path(spark, "t-warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    got = warc.read_warc(spark, path).collect()
    assert sorted((r["page_id"], r["url"], r["payload_ok"]) for r in got) == [(i, u, True) for i, u, _ in rows]


def test_a_chain_that_stops_early_is_an_error():
    record = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for broken in (record + b"junk" + record, b"junk" + record, record[:-1]):
        with pytest.raises(ValueError, match="chain broken"):
            list(warc._records(memoryview(broken)))
    assert list(warc._records(memoryview(b""))) == []


def test_many_candidates_before_one_blank_line():
    data = b"WARC/1.0\r\n" * 200_000 + b"Content-Length: 0\r\n\r\n\r\n\r\n"
    at, _, after = warc.candidates(data)
    assert len(at) == 200_000 and set(after.tolist()) == {len(data)}


def test_only_the_chain_from_the_start_counts():
    record = lambda body: b"WARC/1.0\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    inner = record(b"inside")
    data = record(b"one") + record(inner * 2) + record(b"three")
    at, _, after = warc.candidates(data)
    mark = warc.reachable(at, after, len(data))
    assert len(at) == 5 and at[mark].tolist() == [0, len(record(b"one")), len(record(b"one") + record(inner * 2))]
    broken = record(b"one") + b"junk" + record(b"two")
    at, _, after = warc.candidates(broken)
    assert not warc.reachable(at, after, len(broken)).any()
    at, _, after = warc.candidates(b"junk" + data)
    assert not warc.reachable(at, after, len(data) + 4).any()
    n = 1000
    chain = np.arange(n) * 10
    assert warc.reachable(chain, chain + 10, n * 10).all()
