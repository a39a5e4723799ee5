import base64
import hashlib
import json
import re
import time

import pytest

from sheetwright.llm import secrets as S


def tlv(tag: int, body: bytes) -> bytes:
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


INT = lambda n: tlv(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))
RSA = tlv(0x30, INT(0) + b"".join(INT(3**k) for k in range(80, 88)))
EC = tlv(0x30, INT(1) + tlv(4, bytes(range(32))))
PKCS8 = tlv(0x30, INT(0) + tlv(0x30, tlv(6, b"\x2a\x86\x48") + tlv(5, b"")) + tlv(4, EC))
ENCRYPTED = tlv(0x30, tlv(0x30, tlv(6, b"\x2a\x86\x48")) + tlv(4, bytes(48)))
CERTIFICATE = tlv(0x30, tlv(0x30, tlv(6, b"\x2a")) + tlv(0x30, b"") + tlv(3, bytes(40)))
field = lambda b: len(b).to_bytes(4, "big") + b
OPENSSH = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(bytes(40)) + field(bytes(60))
enc = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
JWT = enc(json.dumps({"alg": "HS256"}).encode()) + "." + enc(b'{"sub": 1}') + "." + enc(bytes(32))


@pytest.mark.parametrize("data", [RSA, EC, PKCS8, ENCRYPTED])
def test_private_keys_are_known_by_structure(data):
    assert S.is_private_der(data)
    assert not S.is_private_der(data[:-1]) and not S.is_private_der(data + b"\0")


def test_other_structures_are_not():
    assert not S.is_private_der(CERTIFICATE) and not S.is_private_der(b"") and not S.is_private_der(tlv(0x30, b"\x30\x80"))
    assert S.is_openssh_key(OPENSSH) and not S.is_openssh_key(OPENSSH[:-1]) and not S.is_openssh_key(b"openssh-key-v1\0")
    assert S.is_signed_token(JWT) and not S.is_signed_token(enc(b"[]") + "." + enc(b"{}") + ".x") and not S.is_signed_token("eyJ.eyJ.")


@pytest.mark.parametrize(
    ("text", "kind"),
    [(base64.b64encode(RSA).decode(), "der"), ("x" + " " + PKCS8.hex() + " y", "der"), (base64.b64encode(OPENSSH).decode(), "openssh"), (f"a {JWT} b", "jwt"), ("-----BEGIN EC PRIVATE KEY-----\n" + base64.encodebytes(EC).decode() + "-----END EC PRIVATE KEY-----", "pem")],
)
def test_added_spans(text, kind):
    assert kind in [k for k, _, _ in S.find_spans(text)]
    assert kind not in [k for k, _, _ in S.find_spans(text.replace("A", "!").replace("M", "N").replace("3", "4").replace("b3", "c3").replace("eyJ", "eyK"))]


def base_spans(text):
    spans = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return spans + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def test_base_spans_and_digest(spark, docs, texts, odd, none):
    for frame, known in ((docs, texts), (odd, None)):
        rows = S.secret_digest(S.scan_secrets(frame)).collect()
        known = known or {r["doc_id"]: r["text"] or "" for r in frame.collect()}
        assert len(rows) == frame.count()
        for r in rows:
            want = sorted(base_spans(known[r["doc_id"]]), key=lambda s: (s[1], S.KINDS.index(s[0])))
            assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for k, _, _ in want) for n in S.BASE_KINDS]
            listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
            assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
            assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))
    assert S.secret_digest(S.scan_secrets(none)).count() == 0


def test_code_points_and_letters():
    assert S.find_spans("😂 TOKEN: abcdefgh") == [("assign", 2, 17)]
    assert S.find_spans("to\u212aen=abcdefgh") == []  # the Kelvin sign is no k
    assert S.find_spans(None) == S.find_spans("") == []


def test_redaction(odd):
    text = 'token = "' + "a1" * 20 + '" and AKIA' + "Z" * 16
    assert S.redact(text, S.find_spans(text)) == '[SECRET]" and [SECRET]'
    assert not [s for s in S.find_spans(S.redact(text, S.find_spans(text)))]
    clean = S.redact_secrets(odd)
    rest = lambda df: sorted(map(str, df.where("doc_id is null or doc_id <> 10").collect()))
    assert clean.columns == odd.columns and rest(clean) == rest(odd)
    assert clean.where("doc_id = 10").first()["text"] == "[SECRET]"  # 120,000 letters a are hex


B64 = lambda b: base64.b64encode(b).decode()
WRAPPED = lambda b, n: "\n".join(re.findall(f".{{1,{n}}}", B64(b)))
PEM_TEXT = "-----BEGIN PRIVATE KEY-----\n" + WRAPPED(PKCS8, 64) + "\n-----END PRIVATE KEY-----\n"
LOCKED = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF\n\n" + WRAPPED(bytes(range(200, 248)), 64) + "\n-----END RSA PRIVATE KEY-----"


@pytest.mark.parametrize(
    ("secret", "kind", "before", "after"),
    [
        (B64(PEM_TEXT.encode()), "pem", "tls.key: ", "\nnext"),
        (WRAPPED(PEM_TEXT.encode(), 76), "pem", "x ", " y"),
        (PEM_TEXT.encode().hex(), "pem", "x ", " y"),
        (B64(RSA), "der", "key_", " "),
        (B64(RSA), "der", "/", "\n"),
        (B64(EC).rstrip("="), "der", "a-b_", "/more"),
        (B64(OPENSSH).rstrip("="), "openssh", "id/", " "),
        (WRAPPED(RSA, 64), "der", "see: ", "\n\nThe end"),
        (WRAPPED(PKCS8, 76).replace("\n", "\r\n  "), "der", "", " end"),
        (WRAPPED(RSA, 64).replace("\n", "\\n"), "der", '"', '"'),
        (WRAPPED(OPENSSH, 64), "openssh", "", ""),
        (RSA.hex(), "der", "0", " "),
        ("\n".join(re.findall(".{1,60}", RSA.hex())), "der", "", ""),
        (LOCKED, "pem", "a ", " b"),
        (LOCKED.replace("\n", "\\n"), "pem", "'", "'"),
    ],
)
def test_keys_in_any_wrapping(secret, kind, before, after):
    text = before + secret + after
    assert (kind, len(before), len(before) + len(secret)) in S.find_spans(text)
    assert S.redact(text, [s for s in S.find_spans(text) if s[0] == kind]) == before + "[SECRET]" + after


def test_no_key_in_other_data():
    for data in (CERTIFICATE, RSA[:-1], bytes(range(256)) * 3, b"0" * 5000, LOCKED.replace("ENCRYPTED", "MIC-ONLY").encode()):
        for text in (B64(data), "key_" + B64(data), WRAPPED(data, 64), data.hex()):
            assert not [s for s in S.find_spans(text) if s[0] not in S.BASE_KINDS]


def test_signed_tokens_in_runs_of_parts():
    text = f"x{JWT} a.b.{JWT}.{JWT} eyJ.eyJ.eyJ.{JWT}, v1.eyJhIjoxfQ.eyJiIjoyfQ."
    assert [text[a:b] for a, b in S.token_spans(text)] == [JWT] * 4
    assert [(k, text[a:b]) for k, a, b in S.find_spans(text) if k == "jwt"] == [("jwt", JWT)] * 4


@pytest.mark.parametrize("text", ["eyJ" * 350_000, "eyJ." * 260_000, "eyJ" * 170_000 + "." + "eyJ" * 170_000 + ".x", "-----BEGIN PRIVATE KEY-----" * 40_000, "token" * 200_000, "MII" * 350_000, "30" * 500_000])
def test_long_texts_take_little_time(text):
    began = time.perf_counter()
    S.find_spans(text)
    assert time.perf_counter() - began < 6


def test_a_long_text_hides_nothing():
    text = "eyJ" * 100_000 + " filler" * 100_000 + f" {JWT} " + "eyJ" * 100_000
    assert [text[a:b] for k, a, b in S.find_spans(text) if k == "jwt"] == [JWT]
