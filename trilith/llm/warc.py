"""WARC writing, and reading by boundary-chain verification.

Writing: a record is one string (header, blank line, payload) and Spark's
text sink ends each with the two line breaks that close a WARC record, so the
archive is written by Spark's own committed output and survives lost tasks.
``records_per_file`` bounds a file; a file is read by one task.

Reading: every occurrence of the version line in a file, inside payloads too,
is a candidate if a header with a length follows it; it points to the offset
where its record would end.  Pointer jumping from the file's start marks the
reachable candidates in a logarithmic number of rounds, and only these are
records.  Headers may have any length.  A chain that stops before its file's
end is an error: no record is dropped silently.

Defined results: null html is an empty payload; of records with equal
payloads the smallest page_id is the response and the others revisit it (all
rows that share that page_id are responses; a null page_id ranks last, and
is a response if no other id has the payload); null url is written as empty,
line breaks in it are percent-encoded; an empty table gives empty archives.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

END = "\r\n\r\n"
#: RFC 4648 digits in order, against those of a base-32 number.
B32_FROM, B32_TO = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
START_RE = re.compile(rb"WARC/1\.[01]\r\n")
LENGTH_RE = re.compile(rb"\r\nContent-Length: *(\d+)(?=\r\n)", re.I)
BLANK_RE = re.compile(rb"\r\n\r\n")
MAX_BROADCAST_ROWS = 200_000  # of 40 bytes each


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1 without padding: 160 bits are eight groups of
    20 bits, each five hex and four base-32 digits."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), B32_FROM, B32_TO)


def with_record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("payload_digest", base32_sha1(F.encode("payload", "UTF-8")))
    shared = stored(p.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("_n"), F.min("page_id").alias("_first"))
                    .where((F.col("_n") > 1) & F.col("_first").isNotNull()).select("payload_digest", "_first"),
                    "warc-shared")
    if shared.count() <= MAX_BROADCAST_ROWS:  # else payloads are shuffled by digest
        shared = F.broadcast(shared)
    revisit = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id"))
    return p.join(shared, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, records_per_file: int = 2000) -> None:
    """Write one record per row of ``pages`` (page_id, url, html)."""
    r = with_record_types(pages)
    line = "\r\n"
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, "").otherwise(F.col("payload"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    header = F.concat(
        F.lit(f"WARC/1.0{line}WARC-Type: "), "record_type",
        F.lit(f"{line}WARC-Record-ID: <urn:page:"), page, F.lit(f">{line}WARC-Target-URI: "), url,
        F.lit(f"{line}WARC-Payload-Digest: sha1:"), "payload_digest",
        F.lit(f"{line}X-Payload-Length: "), F.octet_length("payload").cast("string"),
        F.when(revisit, F.concat(F.lit(f"{line}WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"),
                                 F.lit(">"))).otherwise(""),
        F.lit(f"{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(END))
    (r.select(F.concat(header, block).alias("value")).write.option("lineSep", END)
     .option("maxRecordsPerFile", records_per_file).text(path))


def candidates(data) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, block starts and successors of all candidate records.  Blank
    lines and lengths are found in one pass each, so many candidates before
    one far blank line cost no more than few."""
    at, block, after = [], [], []
    blanks = np.array([m.start() for m in BLANK_RE.finditer(data)], dtype=np.int64)
    lengths = [(m.start(), m.end(), int(m[1][:18])) for m in LENGTH_RE.finditer(data)]
    starts = np.array([x[0] for x in lengths], dtype=np.int64)
    found = np.array([m.start() for m in START_RE.finditer(data)], dtype=np.int64)
    for i, stop, size in zip(found.tolist(), np.searchsorted(blanks, found).tolist(),
                             np.searchsorted(starts, found).tolist()):
        if stop < len(blanks) and size < len(lengths) and lengths[size][1] <= blanks[stop]:
            at.append(i)
            block.append(int(blanks[stop]) + 4)
            after.append(block[-1] + lengths[size][2] + 4)
    return tuple(np.array(x, dtype=np.int64) for x in (at, block, after))


def reachable(at: np.ndarray, after: np.ndarray, size: int) -> np.ndarray:
    """Marks the candidates on the chain from offset 0, by pointer jumping.
    The chain may end at the file's end only; a successor elsewhere that is
    no candidate stops it there (the broken record itself is dropped)."""
    n = len(at)
    if not n or at[0] != 0:
        return np.zeros(n, dtype=bool)
    nxt = np.searchsorted(at, after)
    hit = (nxt < n) & (at[np.minimum(nxt, n - 1)] == after)
    jump = np.where(hit, nxt, n)  # n: the sink
    jump = np.append(jump, n)
    mark = np.zeros(n + 1, dtype=bool)
    mark[0] = True
    while True:
        grown = mark.copy()
        grown[jump[np.flatnonzero(mark)]] = True
        if (grown == mark).all() and (jump == jump[jump]).all():
            break
        mark, jump = grown, jump[jump]
    return mark[:n] & (hit | (after == size))


SCHEMA = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, payload_ok boolean, record_offset long")


def _records(content: memoryview):
    at, block, after = candidates(content)
    chain = np.flatnonzero(reachable(at, after, len(content)))
    if len(content) and (not len(chain) or after[chain[-1]] != len(content)):
        raise ValueError(f"WARC chain broken after {len(chain)} records, before the end at {len(content)} bytes")
    for i in chain:
        lines = bytes(content[at[i]:block[i] - 4]).decode("utf-8").split("\r\n")[1:]
        h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        payload = bytes(content[block[i]:after[i] - 4])
        digest, size, kind = h["WARC-Payload-Digest"].split(":")[1], int(h["X-Payload-Length"]), h["WARC-Type"]
        ok = True
        if kind == "response":
            own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            ok = (own, len(payload)) == (digest, size)
            digest, size = own, len(payload)
        page = h["WARC-Record-ID"][len("<urn:page:"):-1]
        refers = h.get("WARC-Refers-To")
        yield (None if page == "none" else int(page), h["WARC-Target-URI"], size, digest, kind,
               int(refers[len("<urn:page:"):-1]) if refers else None, ok, int(at[i]))


def _read_batches(batches):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]
    for batch in batches:
        for content in batch.column("content"):
            rows = list(_records(memoryview(content.as_buffer())))
            if rows:
                cols = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per verified record of the archives in ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read_batches, SCHEMA)
