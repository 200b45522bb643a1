r"""Secret scans with structural confirmation.

Base kinds (``assign``, ``access``, ``hex``) are pattern matches.  The
method adds spans that are reported only after decoding: runs of base64 or
hex are decoded and must be a whole private-key encoding, whose nested
lengths fill the bytes exactly; a signed token's first part must decode to a
JSON header that names its algorithm.

* ``pem``  an armoured block whose body is a private key (DER or OpenSSH); its line
  ends may be escaped, as in JSON
* ``key``  a bare base64 or hex run that is such a key, or decodes to an armoured one;
  in a base64 run also every part behind one of ``/ - _ +``, up to the run's end or,
  for DER, to the end that its length tells, and every hex run
* ``token``  header.payload.signature with a decodable header

Defined results: null text is the empty text; an empty text has no spans and
the digest of the empty string; rows are independent, so ties, repeated rows
and extra columns do not matter; texts of any length are scanned whole.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, drop_task_state

KINDS = ("assign", "access", "hex", "pem", "key", "token")
BASE_KINDS = KINDS[:3]
ROWS = 256  # texts masked at once
ORDER = {k: i for i, k in enumerate(KINDS)}

ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_RE = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                       re.I | re.A)
ACCESS_RE = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX_RE = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
BEGIN_RE = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)(?=-----)")
END_RE = re.compile(r"-----END ([A-Z0-9 ]*PRIVATE KEY)(?=-----)")
B64_RE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_KEY_RE = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}")
#: Beginnings of encoded keys behind a separator: DER sequence, OpenSSH, armour.
PART_RE = re.compile(r"(?<=[/+_-])(?:M[A-P]|b3BlbnNzaC1rZXkt|LS0tLS1CRUdJTi)")
ESCAPED_END_RE = re.compile(r"\\+[rn]")
#: A JSON object's first byte makes the first base64 character an e.
TOKEN_RE = re.compile(r"(?<![A-Za-z0-9_-])(e[A-Za-z0-9_-]{11,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")


def tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, content start, content end) of the DER element at ``at``."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        more = size & 0x7F
        if not 1 <= more <= 4 or at + more > end:
            return None
        size, at = int.from_bytes(data[at:at + more], "big"), at + more
    return (tag, at, at + size) if at + size <= end else None


def children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill ``at``..``end`` exactly, else None."""
    out = []
    while at < end:
        x = tlv(data, at, end)
        if x is None:
            return None
        out.append(x)
        at = x[2]
    return out


def is_der_key(data: bytes) -> bool:
    """PKCS #1, #8 (plain or encrypted), SEC 1 or DSA private key."""
    top = tlv(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = children(data, top[1], top[2])
    if not parts:
        return False
    tags = [x[0] for x in parts]
    if tags[0] == 0x30 and tags == [0x30, 0x04]:  # encrypted: algorithm, octets
        inner = children(data, parts[0][1], parts[0][2])
        return bool(inner) and inner[0][0] == 0x06
    if tags[0] != 0x02:
        return False
    version = int.from_bytes(data[parts[0][1]:parts[0][2]], "big")
    if len(tags) >= 3 and tags[1:3] == [0x30, 0x04] and version <= 1:
        inner = children(data, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == 0x06
    if tags[1:2] == [0x04] and version == 1:
        return all(t in (0xA0, 0xA1) for t in tags[2:]) and parts[1][2] - parts[1][1] >= 16
    return version <= 1 and len(tags) >= 6 and all(t == 0x02 for t in tags[:6])


def is_openssh_key(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, strings = len(magic), 0
    while strings < 3:  # cipher, key derivation, its options
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data):
            return False
        at, strings = at + 4 + size, strings + 1
    return at + 4 <= len(data) and int.from_bytes(data[at:at + 4], "big") >= 1


def unbase64(run: str) -> bytes:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def is_pem(body: str) -> bool:
    body = ESCAPED_END_RE.sub("\n", body).replace("\\/", "/")
    lines = [x.strip() for x in body.splitlines()]
    data = unbase64("".join(x for x in lines if ":" not in x))
    return is_der_key(data) or is_openssh_key(data)


def armoured(text: str) -> list[tuple[int, int, str]]:
    """(start, end, body) of each BEGIN with the next END of its kind, from
    left to right; the marks are found once, whatever is left open."""
    ends: dict[str, list[int]] = {}
    for m in END_RE.finditer(text):
        ends.setdefault(m[1], []).append(m.start())
    out, last = [], 0
    for m in BEGIN_RE.finditer(text):
        own, body = ends.get(m[1], ()), m.end() + 5
        at = bisect_left(own, body)
        if m.start() >= last and at < len(own):
            last = own[at] + len("-----END ") + len(m[1]) + 5
            out.append((m.start(), last, text[body:own[at]]))
    return out


def is_key(data: bytes) -> bool:
    if not data:
        return False
    if data[0] == 0x30 and is_der_key(data) or is_openssh_key(data):
        return True
    found = armoured(data.decode("latin-1")) if data.startswith(b"-----BEGIN") else []
    return bool(found) and is_pem(found[0][2])


def is_token(head: str) -> bool:
    try:
        x = json.loads(unbase64(head))
    except (ValueError, RecursionError):
        return False
    return isinstance(x, dict) and isinstance(x.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern matches, unsorted."""
    out = [(m.start(), m.end(), "hex") for m in HEX_RE.finditer(text)]
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN_RE.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS_RE.finditer(text)]
    return out


def part_end(text: str, start: int, end: int) -> int | None:
    """The end of the key that begins at ``start`` inside the base64 run that
    ends at ``end`` (padding included), or None."""
    digits = end - (text[start:end].endswith("=") + text[start:end].endswith("=="))
    if text[start] != "M":  # no length over all: up to the run's end
        whole = digits - (digits - start) % 4 if (digits - start) % 4 == 1 else digits
        return end if is_key(unbase64(text[start:whole])) else None
    head = unbase64(text[start:min(start + 8, digits)])
    if len(head) < 6:
        return None
    more = head[1] & 0x7F if head[1] & 0x80 else 0
    if head[1] == 0x80 or more > 4:
        return None
    size = 2 + more + (int.from_bytes(head[2:2 + more], "big") if more else head[1])
    stop = start + -(-size * 4 // 3)
    if stop > digits or stop < digits and text[stop] not in "/-_+":
        return None
    return (end if stop == digits else stop) if is_key(unbase64(text[start:stop])) else None


def run_spans(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """The keys of one base64 run: the whole, else its hex runs and the
    parts behind separators."""
    if is_key(unbase64(text[start:end])):
        return [(start, end, "key")]
    out = [(h.start(), h.end(), "key") for h in HEX_KEY_RE.finditer(text, start, end)
           if is_key(bytes.fromhex(h[0][:len(h[0]) & ~1]))]
    starts = [start] if text[start] == "M" else []
    last = start
    for at in starts + [m.start() for m in PART_RE.finditer(text, start, end)]:
        if at >= last and (stop := part_end(text, at, end)):
            out.append((at, stop, "key"))
            last = stop
    return out


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if "-----BEGIN " in text:
        out += [(a, b, "pem") for a, b, body in armoured(text) if is_pem(body)]
    for m in B64_RE.finditer(text):
        out += run_spans(text, m.start(), m.end())
    if "." in text:
        out += [(m.start(), m.end(), "token") for m in TOKEN_RE.finditer(text) if is_token(m[1])]
    return out


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans by start, then kind in the order of ``KINDS``."""
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda x: (x[0], ORDER[x[2]], x[1]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, mask: str = "[secret]") -> str:
    """``text`` with every maximal stretch of spans replaced by ``mask``."""
    out, last = [], 0
    for a, b, _ in scan(text):
        if a >= last:
            out += [text[last:a], mask]
        last = max(last, b)
    return "".join(out) + text[last:] if out else text


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string"


def _scan_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            spans = scan(text or "")
            base = [x for x in spans if x[2] in BASE_KINDS]
            n = [sum(x[2] == k for x in base) for k in BASE_KINDS]
            rows.append((doc_id, *n, len(spans) - len(base), hashlib.sha256(joined(base).encode()).hexdigest(),
                         joined(spans)))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        yield out.astype({"doc_id": "Int64"})


def scan_documents(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans per row of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(_scan_batches, SCHEMA)


def redact_documents(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with secrets in ``text`` replaced and ``n_chars``, if there
    is such a column, renewed; a null text stays null.  Other columns pass
    through as they are."""

    def run(batches):
        drop_task_state()
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                texts = [None if t is None else redact(t, mask) for t in batch.column("text").to_pylist()]
                new = {"text": texts, "n_chars": [None if t is None else len(t) for t in texts]}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(new[f.name], f.type) if f.name in new else batch.column(i)
                     for i, f in enumerate(batch.schema)], schema=batch.schema)

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
