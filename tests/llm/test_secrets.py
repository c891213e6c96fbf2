"""Secret scans: base spans, structural confirmation, masks and odd rows."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import re
import struct
import time

import pytest

from plumbline.llm import queries, secrets

DER = bytes.fromhex("3082") + (38).to_bytes(2, "big")  # long form of a short length: not DER


def tlv(tag: int, body: bytes) -> bytes:
    n = len(body)
    head = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + head + body


KEY = tlv(0x30, tlv(0x02, b"\0") + tlv(0x02, b"\x5a" * 200) + tlv(0x30, tlv(0x06, b"\x2a\x86\x48")))
SSH = b"".join(struct.pack(">I", len(p)) + p for p in (b"ssh-ed25519", b"k" * 32))


def b64(data: bytes) -> str:
    return base64.b64encode(data).decode()


def url64(value: object) -> str:
    return base64.urlsafe_b64encode(json.dumps(value).encode()).decode().rstrip("=")


def kinds(text: str) -> list[str]:
    return [secrets.KINDS[k] for _, k, _ in secrets.find_spans(text)]


def test_base_patterns():
    assert kinds("API_KEY = 'abcd1234'") == ["assign"]
    assert kinds("password: short") == []
    assert kinds("x AKIA" + "A" * 12) == ["access"]
    assert kinds("x AKIA" + "A" * 11) == []
    assert kinds("f" * 32) == ["hex"] and kinds("f" * 31) == [] and kinds("F" * 32) == []


def test_a_short_match_hides_nothing_after_it():
    text = "token=abc secret=abcdefgh"
    assert secrets.find_spans(text) == [(10, 0, 25)]


@pytest.mark.parametrize(("data", "kind"), [(KEY, "der"), (SSH, "ssh")])
def test_decoded_keys_are_confirmed(data, kind):
    assert kind in kinds(f"see {b64(data)} end")
    assert kind in kinds(f"see {data.hex()} end")
    broken = bytearray(data)
    broken[3] ^= 0x41
    assert kind not in kinds(f"see {b64(bytes(broken))} end")


def test_der_lengths_must_nest_exactly():
    assert secrets.key_der(KEY)
    assert not secrets.key_der(KEY + b"\0") and not secrets.key_der(KEY[:-1])
    assert not secrets.key_der(DER + KEY[:38])


def test_pem_needs_a_key_inside():
    armour = "-----BEGIN PRIVATE KEY-----\n{}\n-----END PRIVATE KEY-----"
    assert "pem" in kinds(armour.format(b64(KEY)))
    assert "pem" not in kinds(armour.format(b64(b"nothing of the kind" * 4)))


BIG = tlv(0x30, tlv(0x02, b"\0") + tlv(0x02, bytes(range(251, 256)) * 60))


def lines(data: bytes, width: int, end: str = "\n") -> str:
    return end.join(re.findall(f".{{1,{width}}}", b64(data)))


@pytest.mark.parametrize("end", ["\n", "\r\n", r"\n", r"\r\n", r"\\n"])
def test_pem_with_escaped_line_ends(end):
    key = f"-----BEGIN PRIVATE KEY-----{end}{lines(BIG, 64, end)}{end}-----END PRIVATE KEY-----"
    assert secrets.find_spans(f"key: '{key}'") == [(6, 3, 6 + len(key))]
    slashes = key.replace("/", r"\/")
    assert slashes != key and kinds(slashes) == ["pem"]


@pytest.mark.parametrize("end", ["\n", r"\n"])
def test_pem_with_headers(end):
    head = f"Proc-Type: 4,ENCRYPTED{end}DEK-Info: AES-128-CBC,{'0A' * 16}{end}{end}"
    armour = f"-----BEGIN RSA PRIVATE KEY-----{end}{{}}{{}}{end}-----END RSA PRIVATE KEY-----"
    body = lines(bytes(range(160)), 64, end)
    assert kinds(armour.format(head, body)) == ["pem"]
    assert kinds(armour.format("", body)) == [] and kinds(armour.format(head, lines(bytes(range(161)), 64, end))) == []
    assert kinds(armour.format(f"Comment: mine{end}", lines(KEY, 64, end))) == ["pem"]


@pytest.mark.parametrize("end", ["\n", "\r\n", r"\n", r"\r\n", "\n  "])
@pytest.mark.parametrize("width", [64, 76])
def test_wrapped_keys_without_armour(width, end):
    openssh = b"openssh-key-v1\0" + bytes(range(200))
    for data, kind in ((BIG, 4), (KEY, 4), (openssh, 5), (SSH + b"\0\0\0\x40" + b"q" * 64, 5)):
        text = lines(data, width, end)
        for before, after in (("see ", " end"), ("prose of the document" + end, end + "more"), ("", "")):
            assert (len(before), kind, len(before) + len(text)) in secrets.find_spans(before + text + after)
    broken = bytearray(BIG)
    broken[3] ^= 0x41
    assert kinds(lines(bytes(broken), width, end)) == []


def test_url_safe_keys():
    text = base64.urlsafe_b64encode(BIG).decode()
    assert "_" in text and "-" in text
    for own in (text, text.rstrip("=")):
        assert (4, 4, 4 + len(own)) in secrets.find_spans(f"see {own} end")
        assert secrets.masked(f"see {own} end", secrets.find_spans(f"see {own} end"), "#") == "see # end"
    wrapped = "\n".join(re.findall(".{1,76}", text))
    assert secrets.find_spans(wrapped) == [(0, 4, len(wrapped))]


def test_long_texts_without_keys_end_soon():
    for text in ("M" * 300_000, "MIIB\n" * 60_000, "-----BEGIN KEY-----" + " " * 200_000, "-----BEGIN KEY-----" + "a: b\n" * 50_000, ("A" * 16 + "\n") * 20_000):
        assert kinds(text) == []


def test_signed_token_needs_a_header():
    assert kinds(f"{url64({'alg': 'HS256'})}.{url64({'sub': 1})}.abc") == ["jwt"]
    assert kinds(f"{url64({'typ': 'JWT'})}.{url64({'sub': 1})}.abc") == []
    assert kinds("eyJ.eyJ.x eyJhbGci.notjson.sig") == []


def test_masks_cover_overlapping_spans_once():
    text = "a token=" + "0" * 40 + " b"
    spans = secrets.find_spans(text)
    assert len(spans) == 2
    assert secrets.masked(text, spans, "#") == "a # b"
    assert secrets.masked("plain", [], "#") == "plain"


def test_odd_rows(spark, rows):
    long_text = "x " * 200_000 + "password=abcdefgh"
    docs = spark.createDataFrame(
        [(1, None, "a"), (2, "", "b"), (3, "é AKIA" + "A" * 12, "c"), (3, "é AKIA" + "A" * 12, "c"), (None, long_text, None)], "doc_id long, text string, spans string"
    )
    found = {(r["doc_id"], r["text"] and len(r["text"])): r for r in rows(secrets.scan_secrets(docs))}
    empty = hashlib.sha256(b"").hexdigest()
    assert found[1, None]["base_sha256"] == found[2, ""]["base_sha256"] == empty
    assert found[1, None]["spans"] == ""
    assert found[3, 18]["spans"] == "access:2:18"
    assert found[None, len(long_text)]["n_assign"] == 1
    assert secrets.scan_secrets(docs).count() == 5
    assert secrets.scan_secrets(docs.limit(0)).count() == 0
    masked = {r["doc_id"]: r["text"] for r in rows(secrets.scan_secrets(docs.where("doc_id < 4"), mask="#"))}
    assert masked == {1: None, 2: "", 3: "é #"}


def test_query_has_exactly_the_base_matches(spark, duck, rows):
    """The digest and counts of every document from the patterns as the contract writes them."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    folder = "/root/testdata/sf0.01"  # the smallest tables hold none
    texts = duck(folder).execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    found = {r["doc_id"]: r for r in rows(queries.op3_secret_scan(spark, folder))}
    assert len(found) == len(texts)
    total = 0
    for doc, text in texts:
        base = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
        base += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        base += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(base))
        assert found[doc]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [found[doc][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(s[1] == k for s in base) for k in range(3)]
        total += len(base)
    assert total > 0


def test_signed_tokens_in_any_place_and_form():
    head, body = url64({"alg": "HS256"}), url64({"sub": 1})
    spaced = base64.urlsafe_b64encode(b'{ "alg": "none"}').decode().rstrip("=")
    lines = base64.urlsafe_b64encode(b'{\n"alg":"ES256"}').decode().rstrip("=")
    assert kinds(f"{spaced}.{body}. {lines}.{body}.abc") == ["jwt", "jwt"]
    assert kinds(f"v1.x.{head}.{body}.sig.{head}.{body}.sig") == ["jwt", "jwt"]
    text = f"id_{head}.{body}.sig"
    assert secrets.find_spans(text) == [(3, 6, len(text))]


def test_token_letters_without_end_are_read_once():
    for text in ("eyJ" * 500_000, "eyJ." * 300_000, "eyJhbGci." * 100_000, "." * 1_000_000 + "eyJ"):
        assert kinds(text) == []


def test_columns_of_any_name(spark, rows):
    docs = spark.createDataFrame([(1, "token=abcdefgh", "a", "b")], "doc_id long, text string, _s string, spans_of_text string")
    (r,) = rows(secrets.scan_secrets(docs))
    assert (r["_s"], r["spans_of_text"], r["n_assign"]) == ("a", "b", 1)


def _hostile() -> dict[str, str]:
    """Texts of a million characters that would make a careless scan read the same letters again and again."""
    n = 1_000_000
    ssh = base64.b64encode(b"openssh-key-v1\0" + b"x" * 33).decode()
    rsa = base64.b64encode(b"\0\0\0\7ssh-rsa" + b"\0\0\0\1a" + b"\0\0\0\x18" + b"y" * 24 + b"\0\0\0\0").decode()
    lines = n // 65
    der = [base64.b64encode(b"\x30\x83" + ((lines - i) * 48 - 5).to_bytes(3, "big") + b"\x05\x00" * 21 + b"\x05").decode() for i in range(lines)]
    return {
        "labels": "-----BEGIN " + "KEY" * (n // 3), "certificates": "-----BEGIN " + "CERTIFICATE" * (n // 11), "begins": "-----BEGIN KEY-----\n" * (n // 20),
        "begins in headers": "-----BEGIN KEY-----\nX: " * (n // 23), "headers": "-----BEGIN KEY-----\n" + "A: b\n" * (n // 5),
        "encrypted": "-----BEGIN KEY-----\n" + "Proc-Type: 4,ENCRYPTED\n" * (n // 23) + "\nAAAA\n-----END KEY-----",
        "backslashes": "-----BEGIN KEY-----" + "\\" * n, "lines and backslashes": "A" * 20 + "\\" * n, "openssh": (ssh[:63] + "\n") * (n // 64), "openssh, odd": (ssh + "b\n") * (n // 66) + "x",
        "ssh": (rsa + "\n") * (n // 65) + rsa[:-8] + "////////", "der": "\n".join(der), "dots": "eyJ." * (n // 4), "short lines": "A\n" * (n // 2), "lines": ("M" * 64 + "\n") * lines,
        "hex": "30" * (n // 2), "words": "password" * (n // 8),
    }


@pytest.mark.parametrize("name", sorted(_hostile()))
def test_hostile_texts_take_seconds(name):
    text = _hostile()[name]
    began = time.process_time()
    secrets.find_spans(text)
    assert time.process_time() - began < (2 if name not in ("ssh", "der") else 4)


def test_elements_are_settled_once():
    """The shared walk agrees with the plain one wherever a sequence begins and ends."""
    rng = random.Random(3)

    def element(depth: int) -> bytes:
        inner = b"".join(element(depth + 1) for _ in range(rng.randint(0, 3))) if depth < 4 and rng.random() < 0.5 else None
        body = rng.randbytes(rng.randint(0, 9)) if inner is None else inner
        tag = b"\x30" if inner is not None else rng.choice([b"\x02", b"\x05", b"\x06"])
        return tag + (bytes([len(body)]) if len(body) < 128 else bytes([0x81, len(body)]) if len(body) < 256 else b"\x82" + len(body).to_bytes(2, "big")) + body

    for _ in range(60):
        data = bytearray(b"".join(element(0) for _ in range(6)))
        for _ in range(rng.randint(0, 2)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        data, shared = bytes(data), None
        shared = secrets.Nested(data)
        for _ in range(200):
            a, b = sorted((rng.randint(0, len(data)), rng.randint(0, len(data))))
            assert shared.key(a, b) == secrets.key_der(data[a:b])
