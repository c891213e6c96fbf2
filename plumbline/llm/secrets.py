"""Secret scans with structural confirmation.

Pattern spans are found first; then every base64 or hex candidate is decoded and its bytes are
parsed (PEM armour, DER nesting, SSH wire strings, JWT headers) before it is reported as a key or a
signed token.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import unused

# The kinds in their order, and the base patterns of the contract.
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

PEM_BEGIN = re.compile(r"-----BEGIN (?=[A-Z0-9 ]*?(?:KEY|CERTIFICATE))([A-Z0-9 ]*+)-----")
#: Line ends and slashes may be escaped, as in strings of JSON or .env files; headers may come before the body.
PEM_HEADER = re.compile(r"(?:\s|\\++[nrt])*+[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]*+(?=[\r\n\\])")
PEM_BODY = re.compile(r"(?:[A-Za-z0-9+/=\s]|\\++[nrt/])++")
ESCAPED = re.compile(r"\\+[nrt]|\\+(?=/)|\s+")
#: Headers of a body that is encrypted, so that its bytes have no form of their own but whole cipher blocks.
ENCRYPTED = re.compile(r"Proc-Type:\x20?4,ENCRYPTED(?=\s|\\)")
CIPHER = re.compile(r"DEK-Info:\x20?[A-Z0-9-]+,(?:[0-9A-Fa-f]{16}){1,2}(?![0-9A-Fa-f])")
#: First letters of a JSON object in base64: a brace, then a quote, a space, a line end or a tab.
TOKEN_HEADS = ("eyJ", "eyA", "ewo", "ew0", "ewk")
#: Letters of the shortest header that names an algorithm, ``{"alg":""}``.
TOKEN_HEADER = 14
TOKEN_HEAD = re.compile("|".join(TOKEN_HEADS))
#: Runs with two dots or more; a run begins where no other letter of one precedes, so each is read once.
DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]*+\.[A-Za-z0-9_-]*+\.[A-Za-z0-9_.-]*+")
#: A first letter of a key in base64, where a run of letters begins; the letter of an escaped line end before it is not a part of it.
KEY_BEGIN = r"[MAb](?:(?<=\\[nrt].)|(?<=\\.)|(?<![\\{a}].))"
BASE64, URL64 = (re.compile(KEY_BEGIN.replace("{a}", a) + f"[{a}]{{39,}}={{0,2}}") for a in ("A-Za-z0-9+/", "A-Za-z0-9_-"))
LINE_END = r"(?:\r?\n|\\+r\\+n|\\+n)[ \t]*"
#: Lines of base64, the first of 16 characters or more, with real or escaped line ends.
BEGIN = r"(?:(?<=\\[nrt])|(?<=\\)(?![nrt])|(?<![\\{a}]))"
WRAPPED = [re.compile(BEGIN.replace("{a}", a) + rf"[{a}]{{16,}}+(?:{LINE_END}[{a}]++)++={{0,2}}") for a in ("A-Za-z0-9+/", "A-Za-z0-9_-")]
#: What any wrapped text holds: a line end after 16 letters. And the letters of the shortest hexadecimal and base64 keys in one line.
WRAP_HINT = re.compile(r"[\r\n\\](?<=[A-Za-z0-9+/_-]{16}.)", re.S)
HEX_LETTERS, KEY_LETTERS = 32, 40
SSH_HEAD = re.compile(rb"openssh-key-|\0\0\0.(?:ssh-|ecdsa-)", re.S)
HEX_ANY = re.compile(r"(?:[0-9a-f]{2}){24,}|(?:[0-9A-F]{2}){24,}")
_STANDARD = str.maketrans("-_", "+/")
SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")


def der_head(data: bytes, at: int, end: int) -> tuple[int, int] | None:
    """Where the content of the DER element at a place begins and ends; None if it is none or goes past ``end``."""
    if end - at < 2:
        return None
    tag, size = data[at], data[at + 1]
    at += 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        at += n
        if size < 0x80 or (n > 1 and size < 1 << (8 * (n - 1))):  # DER wants the shortest form
            return None
    if at + size > end or tag & 0x1F == 0x1F or tag == 0:
        return None
    return at, at + size


def der_ok(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> bool:
    """Whether ``data[at:end]`` is one DER SEQUENCE whose nested lengths all add up exactly."""
    end = len(data) if end is None else end
    if depth > 16 or end - at < 2 or (depth == 0 and data[at] != 0x30):
        return False
    while at < end:
        head = der_head(data, at, end)
        if head is None or (depth == 0 and head[1] != end) or (data[at] & 0x20 and head[1] > head[0] and not der_ok(data, *head, depth + 1)):
            return False
        at = head[1]
    return True


def key_der(data: bytes) -> bool:
    """A DER SEQUENCE of at least 32 bytes with an INTEGER, OID or SEQUENCE in front."""
    if len(data) < 32 or not der_ok(data):
        return False
    head = 2 + (data[1] & 0x7F if data[1] & 0x80 else 0)
    return data[head] in (0x02, 0x06, 0x30)


def key_ssh(data: bytes, at: int = 0, end: int | None = None, dead: set[int] | None = None) -> bool:
    """OpenSSH private key magic, or SSH wire strings of a known key type that fill ``data[at:end]``.

    ``dead`` keeps the places from which no strings reach the end; calls with the same end share it.
    """
    end = len(data) if end is None else end
    if data[at : min(end, at + 15)] == b"openssh-key-v1\0":
        return True
    dead = set() if dead is None else dead
    parts, seen = 0, []
    while at < end:
        size = int.from_bytes(data[at : at + 4], "big")
        if at in dead or at + 4 + size > end or (parts == 0 and data[at + 4 : at + 4 + min(size, 32)] not in SSH_TYPES):
            dead.update(seen[1:])
            return False
        seen.append(at)
        at += 4 + size
        parts += 1
    return parts >= 2


class Nested:
    """DER elements of some bytes. What follows an element is settled once, however many sequences hold it.

    At each depth the places of elements form trees, each place below the one that follows it. A place
    keeps one far pointer besides, so whether elements end at a given place takes a logarithm of steps.
    """

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.trees: defaultdict[int, dict[int, tuple[int, int, int]]] = defaultdict(dict)  # place: next, far, steps to the root

    def following(self, at: int, depth: int) -> int | None:
        """Where the element at a place ends, if it is one and its own elements fill it."""
        head = der_head(self.data, at, len(self.data))
        if head is None:
            return None
        begin, end = head
        return None if self.data[at] & 0x20 and end > begin and not self.fills(begin, end, depth + 1) else end

    def fills(self, at: int, end: int, depth: int) -> bool:
        """Whether elements lead from one place exactly to another."""
        if depth > 16:
            return False
        tree, path = self.trees[depth], []
        place = at
        while place not in tree:
            after = self.following(place, depth)
            if after is None:
                tree[place] = (place, place, 0)
            else:
                path.append((place, after))
                place = after
        for place, after in reversed(path):
            _, far, level = tree[after]
            _, farther, far_level = tree[far]
            jump = farther if level - far_level == far_level - tree[farther][2] else after
            tree[place] = (after, jump, level + 1)
        while at < end:
            after, far, level = tree[at]
            if not level:
                return False
            at = far if far <= end else after
        return at == end

    def key(self, at: int, end: int) -> bool:
        """A SEQUENCE of at least 32 bytes with an INTEGER, OID or SEQUENCE in front; see :func:`key_der`."""
        head = der_head(self.data, at, end)
        return end - at >= 32 and self.data[at] == 0x30 and head is not None and head[1] == end and self.data[head[0]] in (0x02, 0x06, 0x30) and self.fills(*head, 1)


def decoded64(text: str) -> bytes | None:
    text = text.rstrip("=").translate(_STANDARD)
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_chars(start: str) -> int | None:
    """Base64 characters, without padding, of the DER SEQUENCE that begins with ``start``."""
    head = decoded64(start)
    if head is None or len(head) < 6 or head[0] != 0x30:
        return None
    more = head[1] & 0x7F if head[1] & 0x80 else 0
    if more > 4:
        return None
    size = 2 + more + (int.from_bytes(head[2 : 2 + more], "big") if more else head[1])
    return -(-size * 4 // 3)


def wrapped_keys(text: str) -> Iterator[tuple[int, int, int]]:
    """Spans of keys whose base64 goes over several lines.

    A DER key ends with the line at which its own length is reached. SSH data ends with the first line
    that is not as long as those before it, or before a shorter line that does not belong to it.
    """
    for pattern in WRAPPED:
        for block in pattern.finditer(text):
            if not re.search(r"(?:^|\n|\\n)[ \t]*[MAb]", block[0]):
                continue
            ends = list(re.finditer(LINE_END, block[0]))
            starts = [block.start(), *[block.start() + m.end() for m in ends]]
            stops = [*[block.start() + m.start() for m in ends], block.start() + len(block[0].rstrip("="))]
            letters = "".join(text[a:b] for a, b in zip(starts, stops, strict=True)).translate(_STANDARD)
            widths = [b - a for a, b in zip(starts, stops, strict=True)]
            sums = [0, *accumulate(widths)]
            other = [len(starts)] * len(starts)  # the next line of another width
            for i in range(len(starts) - 2, -1, -1):
                other[i] = other[i + 1] if widths[i] == widths[i + 1] else i + 1
            whole: dict[int, Nested] = {}  # by the letters left out in front, so that all groups of four begin where a line's do
            done, dead = 0, defaultdict(set)
            for i, a in enumerate(starts):
                if i < done or text[a] not in "MAb" or widths[i] < 16:
                    continue
                tries = []
                if text[a] == "M":
                    chars = der_chars(text[a : a + 8])
                    j = bisect_left(sums, sums[i] + chars) if chars else 0
                    tries = [j] if i + 1 < j < len(sums) and sums[j] == sums[i] + chars else []
                elif SSH_HEAD.match(decoded64(text[a : a + 16]) or b""):
                    tries = [x for x in (other[i] + 1, other[i]) if i + 1 < x <= len(starts)]
                for j in tries:
                    if (sums[j] - sums[i]) % 4 == 1:
                        continue
                    align = sums[i] % 4
                    if align not in whole:
                        own = letters[align:]
                        whole[align] = Nested(base64.b64decode(own + "A" * (-len(own) % 4)))
                    data, begin = whole[align], sums[i] // 4 * 3
                    end = begin + (sums[j] - sums[i]) * 3 // 4
                    found = data.key(begin, end) if text[a] == "M" else key_ssh(data.data, begin, end, dead[j, align])
                    if found:
                        yield a, 4 if text[a] == "M" else 5, block.end() if j == len(starts) else stops[j - 1]
                        done = j
                        break


def armoured(text: str) -> Iterator[tuple[int, int]]:
    """Spans of PEM blocks whose body is a key or encrypted. No header and no body is read twice."""
    headers: dict[int, int] = {}  # from where headers begin to where they end
    bodies: dict[int, int] = {}
    past = 0
    for begin in PEM_BEGIN.finditer(text):
        if begin.start() < past:
            continue
        at, seen = begin.end(), []
        while at not in headers and (header := PEM_HEADER.match(text, at)):
            seen.append(at)
            at = header.end()
        at = headers.get(at, at)
        headers.update(dict.fromkeys([*seen, at], at))
        if at not in bodies:
            body = PEM_BODY.match(text, at)
            bodies[at] = body.end() if body else at
        end = f"-----END {begin[1]}-----"
        if bodies[at] == at or not text.startswith(end, bodies[at]):
            continue
        past = bodies[at] + len(end)
        data = decoded64(ESCAPED.sub("", text[at : bodies[at]]))
        if data is not None and (key_der(data) or key_ssh(data) or (len(data) >= 32 and len(data) % 8 == 0 and encrypted(text[begin.end() : at]))):
            yield begin.start(), past


def encrypted(headers: str) -> bool:
    """Whether PEM headers name an encryption and then its cipher."""
    named = ENCRYPTED.search(headers)
    return named is not None and CIPHER.search(headers, named.end()) is not None


def token_ok(head: str, body: str) -> bool:
    """Whether both parts decode to JSON objects and the header names an algorithm."""
    if len(head) < TOKEN_HEADER:
        return False
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(p + "=" * (-len(p) % 4))) for p in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str)


def signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of signed tokens: three parts joined by dots, the header from its first possible letters on."""
    for run in DOTTED.finditer(text):
        parts = run[0].split(".")
        starts = [run.start() + n for n in accumulate((len(p) + 1 for p in parts), initial=0)]
        i = 0
        while i + 2 < len(parts):
            head = TOKEN_HEAD.search(parts[i])
            if head and parts[i + 1] and token_ok(parts[i][head.start() :], parts[i + 1]):
                yield starts[i] + head.start(), starts[i + 2] + len(parts[i + 2])
                i += 2
            i += 1


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """All spans of a text as (start, kind number, end), sorted."""
    spans = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    longest = max(map(len, text.split()), default=0)
    if longest >= HEX_LETTERS:
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "-----BEGIN " in text:
        spans += [(a, 3, b) for a, b in armoured(text)]
    if any(h in text for h in TOKEN_HEADS):
        spans += [(a, 6, b) for a, b in signed_tokens(text)]
    # DER starts with byte 30 and SSH data with 00 00 00 or "openssh", which fixes the first base64 letter.
    if WRAP_HINT.search(text):
        armour = sorted((a, b) for a, k, b in spans if k == 3)  # apart from each other
        inside = lambda a, b: (at := bisect_right(armour, (a, len(text)))) and b <= armour[at - 1][1]
        spans += [s for s in wrapped_keys(text) if not inside(s[0], s[2])]
    if longest >= KEY_LETTERS:
        for m in (m for pattern in (BASE64, URL64) for m in pattern.finditer(text)):
            if (data := decoded64(m[0])) is not None:
                if key_der(data):
                    spans.append((m.start(), 4, m.end()))
                elif key_ssh(data):
                    spans.append((m.start(), 5, m.end()))
        for m in HEX_ANY.finditer(text):
            if m[0][:2] in ("30", "00", "6f", "6F"):
                data = bytes.fromhex(m[0])
                if key_der(data):
                    spans.append((m.start(), 4, m.end()))
                elif key_ssh(data):
                    spans.append((m.start(), 5, m.end()))
    return sorted(set(spans))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """``text`` with every maximal run of overlapping spans replaced by ``mask``."""
    parts, at, end = [], 0, -1
    for a, _, b in spans:
        if a >= end:
            if end >= 0:
                parts += [mask]
                at = end
            parts.append(text[at:a])
            end = b
        else:
            end = max(end, b)
    return "".join([*parts, mask, text[end:]]) if spans else text


def scan_secrets(docs: DataFrame, text_col: str = "text", mask: str | None = None) -> DataFrame:
    """Append ``n_assign, n_access, n_hex, base_sha256, spans, n_confirmed`` to every row.

    ``spans`` lists ``kind:start:end`` in code points, end exclusive, by start and then kind, for the
    base patterns and the structurally confirmed kinds pem, der, ssh and jwt. With ``mask`` the text
    column is also rewritten with each run of spans replaced by it (null stays null).

    A null text counts as empty: no spans and the digest of the empty string. Whole texts are
    scanned whatever their length. Rows are independent, so ties, repeated rows and empty tables
    need no care. Input columns named like an output column are replaced (the text column stays); all
    others are kept whatever their names.
    """
    fields = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_confirmed bigint"

    @F.arrow_udf(f"struct<{fields.replace(' bigint', ':bigint').replace(' string', ':string')}, masked:string>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for value in batch:
                text = value.as_py()
                spans = find_spans(text or "")
                base = [s for s in spans if s[1] < 3]
                kinds = [s[1] for s in spans]
                row = (*(kinds.count(k) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), sum(k > 2 for k in kinds))
                for col, x in zip(cols, row, strict=False):
                    col.append(x)
                cols[6].append(masked(text, spans, mask) if mask is not None and spans else None)
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.string()]
            names = [f.split()[0] for f in fields.split(", ")] + ["masked"]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    names = [f.split()[0] for f in fields.split(", ")]
    own = unused(docs, "spans_of_text")
    found = docs.drop(*[n for n in names if n != text_col]).withColumn(own, scan(F.col(text_col)))
    if mask is not None:
        found = found.withColumn(text_col, F.coalesce(f"{own}.masked", text_col))
    return found.withColumns({n: F.col(f"{own}.{n}") for n in names if n != text_col}).drop(own)
