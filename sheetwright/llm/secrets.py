"""Secret scans with structural confirmation.

Base spans come from three patterns.  On top of them, candidates in base64 or
hex are decoded and reported only if what they hold has the structure of a
secret: nested DER lengths of a private key, the length-prefixed fields of an
OpenSSH key, PEM text of either, or the JSON header and claims of a signed
token.  Wrapped lines are one candidate, every candidate is decoded at each
alignment, and a key may start and end anywhere inside it.  An encrypted PEM
block is known by its headers, as its body has no structure to see.

Nulls and empty texts have no spans.  Repeated rows are scanned each for
itself.  Spans that start together are listed in the order of KINDS, then by
end.  Very long texts are scanned whole, in time that grows with their length.
An empty table gives an empty result.  Only the id and the text are read, so
other columns can't clash.
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

from sheetwright.llm.common import release_memory, short_batches

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "openssh", "jwt")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: The end of a line, or its escape inside a string.
_LINE = r"(?:\r?\n|(?:\\r)?\\n)"
_PEM = re.compile(rf"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----(\s*+{_LINE}?(?:[A-Za-z][A-Za-z0-9-]*:[^\n\\]*{_LINE}\s*+)++)?+([A-Za-z0-9+/=\s\\]+?)-----END \1PRIVATE KEY-----")
_ENCRYPTED = re.compile(r"Proc-Type:\s*4,\s*ENCRYPTED[\s\S]*DEK-Info:\s*[A-Za-z0-9-]+")
_WRAP = re.compile(rf"[ \t]*{_LINE}[ \t]*")
_BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{40,}}(?:{_WRAP.pattern}[A-Za-z0-9+/_-]+)*={{0,2}}")
_HEX_ANY = re.compile(rf"[0-9A-Fa-f]{{40,}}(?:{_WRAP.pattern}[0-9A-Fa-f]+)*")
#: A sequence of any length whose first element is a version or a sequence.
_DER_START = re.compile(rb"\x30(?=(?:[\x00-\x7f]|\x81.|\x82..|\x83.{3}|\x84.{4})(?:\x02\x01[\x00\x01]|\x30))", re.DOTALL)
_OPENSSH = b"openssh-key-v1\0"
_DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
#: Characters of the shortest header that names an algorithm, {"alg":""}.
LEAST_HEADER = 14
_SPACES = re.compile(r"\\n|\\r|\s")
SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _b64(text: str) -> bytes | None:
    """Decoded standard or URL-safe base64, or None."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def read_tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, first byte, one past the last) of the DER element at ``at``; None if its length does not fit."""
    if at + 2 > end:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length == 0x80:
        return None
    if length > 0x80:
        n = length & 0x7F
        if n > 4 or at + n > end:
            return None
        length = int.from_bytes(data[at : at + n], "big")
        if length < 0x80 or data[at] == 0:
            return None  # DER has the shortest form only
        at += n
    return (tag, at, at + length) if at + length <= end else None


#: Elements of a sequence at most; no private key has as many.
MOST_ELEMENTS = 32


def children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """Elements that fill [start, end) exactly."""
    found: list[tuple[int, int, int]] = []
    while start < end:
        if len(found) == MOST_ELEMENTS:
            return None
        item = read_tlv(data, start, end)
        if item is None:
            return None
        found.append(item)
        start = item[2]
    return found


def is_private_der(data: bytes) -> bool:
    """Whether all of ``data`` is one private key."""
    top = read_tlv(data, 0, len(data))
    return top is not None and top[2] == len(data) and is_private_element(data, top)


def is_private_element(data: bytes, top: tuple[int, int, int]) -> bool:
    """PKCS#1, DSA, SEC1, PKCS#8 or encrypted PKCS#8, judged by nested lengths and element kinds."""
    if top[0] != 0x30:
        return False
    parts = children(data, top[1], top[2])
    if not parts:
        return False
    tags = [p[0] for p in parts]
    if len(tags) in (6, 9) and set(tags) == {0x02}:
        return data[parts[0][1] : parts[0][2]] in (b"\0", b"\1")
    if tags[:2] == [0x02, 0x04] and data[parts[0][1] : parts[0][2]] == b"\1":
        return parts[1][2] - parts[1][1] >= 16
    if tags[:3] == [0x02, 0x30, 0x04] and data[parts[0][1] : parts[0][2]] in (b"\0", b"\1"):
        inner = children(data, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == 0x06
    if tags == [0x30, 0x04]:
        inner = children(data, parts[0][1], parts[0][2])
        return bool(inner) and inner[0][0] == 0x06 and parts[1][2] - parts[1][1] >= 16
    return False


def openssh_end(data: bytes, at: int) -> int | None:
    """One past the last byte of the OpenSSH key at ``at``: the magic, three length-prefixed strings, a key count and as many public keys and one private block."""
    if not data.startswith(_OPENSSH, at):
        return None
    at += len(_OPENSSH)

    def field() -> int | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else len(data)
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return n

    if any(field() is None for _ in range(3)) or at + 4 > len(data):
        return None
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= count <= 16 or any(field() is None for _ in range(count)):
        return None
    return at if field() else None


def is_openssh_key(data: bytes) -> bool:
    """Whether all of ``data`` is one OpenSSH key."""
    return openssh_end(data, 0) == len(data)


def is_signed_token(text: str) -> bool:
    """header.claims.signature whose header and claims are JSON objects and whose header names an algorithm."""
    head, claims, signature = text.split(".")
    try:
        header, body = (json.loads(_b64(x) or b"") for x in (head, claims))
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(body, dict) or not isinstance(header.get("alg"), str):
        return False
    return header["alg"].lower() == "none" or bool(signature and _b64(signature))


def token_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the signed tokens: in runs of parts between dots, a header that begins with the first eyJ of its
    part, and the next two parts.  Each part is decoded twice at most, so the time grows with the text alone."""
    found = []
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        at, i = m.start(), 0
        while i + 2 < len(parts):
            k = parts[i].find("eyJ")
            if 0 <= k <= len(parts[i]) - LEAST_HEADER and is_signed_token(f"{parts[i][k:]}.{parts[i + 1]}.{parts[i + 2]}"):
                end = at + sum(map(len, parts[i : i + 3])) + 2
                found.append((at + k, end))
                at, i = end + 1, i + 3
            else:
                at, i = at + len(parts[i]) + 1, i + 1
    return found


def pem_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the PEM blocks that hold a key, or say that they hold an encrypted one."""
    found = []
    for m in _PEM.finditer(text):
        data = _b64(_SPACES.sub("", m[3]))
        if data and (is_private_der(data) or is_openssh_key(data) or (m[2] and _ENCRYPTED.search(m[2]) and len(data) >= 16 and len(data) % 8 == 0)):
            found.append((m.start(), m.end()))
    return found


def keys_in(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes of the keys in decoded data; a key's own parts are not listed."""
    found, reach = [], 0
    for m in _DER_START.finditer(data):
        if m.start() >= reach and (top := read_tlv(data, m.start(), len(data))) and is_private_element(data, top):
            found.append(("der", m.start(), reach := top[2]))
    at = data.find(_OPENSSH)
    while at >= 0:
        end = openssh_end(data, at)
        if end is not None:
            found.append(("openssh", at, end))
        at = data.find(_OPENSSH, end or at + 1)
    if b"-----BEGIN" in data:
        found += [("pem", a, len(data) - len(data[b:].lstrip())) for a, b in pem_spans(data.decode("latin-1"))]
    return found


def _decoded(run: str, bits: int) -> Iterator[tuple[int, bytes]]:
    """(characters left out, bytes) of a base64 (6 bits) or hex (4 bits) run at each alignment."""
    if bits == 4:
        for k in range(2):
            yield k, bytes.fromhex(run[k : len(run) - (len(run) - k) % 2])
        return
    for k in range(4):
        body = run[k : len(run) - ((len(run) - k) % 4 == 1)]
        data = _b64(body)
        if data:
            yield k, data


def _encoded_keys(text: str, pattern: re.Pattern, bits: int) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the keys in the candidates of a pattern."""
    for m in pattern.finditer(text):
        whole = m[0].rstrip("=")
        wraps = list(_WRAP.finditer(whole)) if "\n" in whole or "\\" in whole else []
        run = _WRAP.sub("", whole) if wraps else whole
        places = None
        for k, data in _decoded(run, bits):
            for kind, a, b in keys_in(data):
                first, last = k + a * 8 // bits, k - (-b * 8 // bits) - 1  # characters with bits of the key
                if wraps and places is None:
                    places, at = [], 0
                    for w in wraps:
                        places += range(m.start() + at, m.start() + w.start())
                        at = w.end()
                    places += range(m.start() + at, m.start() + len(whole))
                start, end = (places[first], places[last] + 1) if places else (m.start() + first, m.start() + last + 1)
                yield kind, start, m.end() if b == len(data) else end


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind as listed in KINDS."""
    if not text:
        return []
    spans = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    if "-----BEGIN" in text:
        spans += [("pem", a, b) for a, b in pem_spans(text)]
    if "eyJ" in text:
        spans += [("jwt", a, b) for a, b in token_spans(text)]
    spans += _encoded_keys(text, _BASE64, 6)
    spans += _encoded_keys(text, _HEX_ANY, 4)
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str | None, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with each maximal run of spans replaced by ``mark``."""
    if not text or not spans:
        return text
    out, at, reach = [], 0, -1
    for _, start, end in spans:
        if start > reach:
            out += [text[at:start], mark]
        at = reach = max(reach, end)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and ``spans``."""
    id_field = docs.schema[id_col]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW_SPANS)], [id_field.name, "spans"])

    return short_batches(docs).select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {id_field.dataType.simpleString()}, spans {SPAN_TYPE}")


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, all columns and rows kept, with every span of the text replaced."""
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([redact(t, find_spans(t)) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)
        release_memory()

    return short_batches(docs).mapInArrow(clean, docs.schema)


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(scanned: DataFrame) -> DataFrame:
    """The digest columns of the query, from ``scan_secrets``."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    def count_of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count_of(k) for k in BASE_KINDS]
    return scanned.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
