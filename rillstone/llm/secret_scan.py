"""Secrets in texts: patterns first, structure as the confirmation.

The base patterns report credentials by their surroundings or shape. What they cannot
tell apart from any other long run of letters is decoded (base64, base64url or hex) and
parsed: a private key must be a DER value whose nested lengths fill it exactly down to the
algorithm's identifier and the key inside, an OpenSSH key must carry its magic and whole
length-prefixed fields, a signed token must have a JSON header that names an algorithm, a
JSON payload and a signature. Base64 may be wrapped over lines. Only what parses is reported.

Defined results: a null text is the empty text, which has no spans; positions are code
points, ends exclusive; an empty table gives no rows; rows with repeated or null ids are
scanned each for itself; other columns, whatever their names, are not read. All work is per
row, so no key can be hot.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.common import bounded_batches

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "ssh", "jwt")
_RANK = {k: n for n, k in enumerate(KINDS)}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
# Both are runs that no failing match can share with a longer one, so the length is part of the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----([^-]*)-----END \1-----")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
#: Lines of base64 of one key without armour.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/]{60,80}+\r?\n)++[A-Za-z0-9+/]{1,80}+={0,2}")
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])(ey[A-Za-z0-9_-]{8,}|ew[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")

Span = tuple[int, int, str]


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the contents of the DER element at a place, if it lies within the end."""
    if end - at < 2:
        return None
    tag, first, at = data[at], data[at + 1], at + 2
    if first < 128:
        size = first
    else:
        n = first & 127
        if not 1 <= n <= 4 or end - at < n or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + n]), at + n
        if size < 128:
            return None
    return (tag, at, at + size) if at + size <= end else None


def _fields(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, contents) of the elements that fill the bytes exactly; none where they do not, or where there are none or over 16."""
    found, at = [], 0
    while at < len(data):
        field = _element(data, at, len(data))
        if not field or len(found) > 16:
            return None
        found.append((field[0], data[field[1] : field[2]]))
        at = field[2]
    return found or None


def _identifier(data: bytes) -> str | None:
    """The dotted form of an object identifier; none where a number in it is cut off or padded."""
    if not data or data[-1] & 128:
        return None
    numbers, now, fresh = [], 0, True
    for byte in data:
        if fresh and byte == 128:
            return None
        now, fresh = now << 7 | byte & 127, not byte & 128
        if fresh:
            numbers.append(now)
            now = 0
    first = min(numbers[0] // 40, 2)
    return ".".join(map(str, (first, numbers[0] - 40 * first, *numbers[1:])))


def _algorithm(data: bytes) -> tuple[str, list[tuple[int, bytes]]] | None:
    """An algorithm's identifier and parameters, which must fill it."""
    fields = _fields(data)
    if not fields or fields[0][0] != 6 or len(fields) > 2:
        return None
    name = _identifier(fields[0][1])
    return (name, fields[1:]) if name and name.count(".") >= 3 else None


def _inner_key(name: str, data: bytes) -> bool:
    """Whether the bytes are a key of the algorithm; of an unknown one, whether they are one whole element."""
    fields = _fields(data)
    if not fields or len(fields) != 1:
        return False
    tag, content = fields[0]
    if name == _RSA:
        return tag == 0x30 and _plain_key(data)
    if name == _CURVE:
        return tag == 0x30 and _curve_key(_fields(content))
    if name.startswith(_EDWARDS):
        return tag == 4 and len(content) in (32, 56, 57)
    return tag == 2 and len(content) >= 16 if name in _NUMBERS else tag in (2, 4, 0x30) and len(content) >= 16


def _curve_key(fields: list[tuple[int, bytes]] | None) -> bool:
    return bool(fields) and [t for t, _ in fields[:2]] == [2, 4] and fields[0][1] == b"\1" and 16 <= len(fields[1][1]) <= 80 and all(t in (0xA0, 0xA1) and _fields(c) for t, c in fields[2:])


def _plain_key(data: bytes) -> bool:
    """RSA or DSA: a version and then five or eight numbers, none padded."""
    outer = _fields(data)
    fields = _fields(outer[0][1]) if outer and len(outer) == 1 and outer[0][0] == 0x30 else None
    if not fields or len(fields) not in (6, 9) or any(t != 2 or not c for t, c in fields):
        return False
    return fields[0][1] == b"\0" and len(fields[1][1]) >= 32


# Fixed identifiers: RSA, elliptic curves, the Edwards and Montgomery curves, DSA and Diffie-Hellman, password-based encryption.
_RSA, _CURVE, _EDWARDS = "1.2.840.113549.1.1.1", "1.2.840.10045.2.1", "1.3.101.11"
_NUMBERS = ("1.2.840.10040.4.1", "1.2.840.113549.1.3.1", "1.2.840.10046.2.1")
_PASSWORD = ("1.2.840.113549.1.5.", "1.2.840.113549.1.12.1.")


def der_key(data: bytes) -> bool:
    """Whether the bytes are one DER private key, every length nested exactly in the one around it."""
    outer = _fields(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    fields = _fields(outer[0][1])
    if not fields:
        return False
    tags = [t for t, _ in fields]
    if tags[:3] == [2, 0x30, 4] and fields[0][1] in (b"\0", b"\1"):  # PKCS #8, perhaps with attributes
        algorithm = _algorithm(fields[1][1])
        return bool(algorithm) and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]) and _inner_key(algorithm[0], fields[2][1])
    if tags == [0x30, 4]:  # the same, encrypted: whole blocks of a cipher
        algorithm = _algorithm(fields[0][1])
        return bool(algorithm) and algorithm[0].startswith(_PASSWORD) and bool(algorithm[1]) and len(fields[1][1]) >= 16 and len(fields[1][1]) % 8 == 0
    return _plain_key(data) or _curve_key(fields)


def ssh_key(data: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key: magic, cipher, key derivation and keys as length-prefixed fields."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for field in range(3):
        if len(data) - at < 4:
            return False
        size = int.from_bytes(data[at : at + 4])
        at += 4 + size
        if at > len(data) or field == 0 and not 1 <= size <= 64:
            return False
    return len(data) - at >= 4 and 1 <= int.from_bytes(data[at : at + 4]) <= 64


def _base64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(text: str) -> dict | None:
    data = _base64(text)
    try:
        found = json.loads(data.decode()) if data else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def signed_token(header: str, payload: str, signature: str) -> bool:
    head = _object(header)
    if not head or not isinstance(head.get("alg"), str) or _object(payload) is None:
        return False
    return head["alg"].lower() == "none" if not signature else len(_base64(signature) or b"") >= 16


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def confirmed_spans(text: str) -> list[Span]:
    """Spans whose decoded contents parse as a key or a signed token."""
    found: list[Span] = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            body = m[2].replace("\\n", "").split("\n\n")[-1]
            data = _base64("".join(body.split()))
            if data and (der_key(data) or ssh_key(data)):
                found.append((m.start(), m.end(), "pem"))
    for m in _RUN.finditer(text):
        run = m[0]
        for data in (_base64(run), bytes.fromhex(run) if re.fullmatch(r"(?:[0-9a-f]{2})+|(?:[0-9A-F]{2})+", run) else None):
            if data and data[:1] == b"0" and der_key(data):
                found.append((m.start(), m.end(), "der"))
            elif data and ssh_key(data):
                found.append((m.start(), m.end(), "ssh"))
    for m in _WRAPPED.finditer(text) if "\n" in text else ():
        data = _base64("".join(m[0].split()))
        if data and data[:1] == b"0" and der_key(data):
            found.append((m.start(), m.end(), "der"))
        elif data and ssh_key(data):
            found.append((m.start(), m.end(), "ssh"))
    if "." in text and ("ey" in text or "ew" in text):
        found += [(m.start(), m.end(), "jwt") for m in _JWT.finditer(text) if signed_token(m[1], m[2], m[3])]
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): every row's spans (kind, start, end) by start, then kind."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                spans = sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[0], _RANK[s[2]]))
                rows.append([{"kind": k, "start": s, "end": e} for s, e, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, span)], names=["id", "spans"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans in one string."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in BASE_KINDS]
    return scanned.select("id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


__all__ = ["base_spans", "confirmed_spans", "der_key", "digest", "scan", "signed_token", "ssh_key"]
