"""Secret scans with structural confirmation.

Three base patterns report what merely looks like a secret (an assignment, an access key id, a hex run). The method's own
kinds are reported only after their bytes were decoded and read: a private key is one whose DER lengths nest without a
byte left over, or an OpenSSH container whose counted strings end where they should; a signed token is one whose header
and payload decode to JSON objects and whose header names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from studyloom.llm.common import slices, tidily

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: words without which ASSIGN can't match, in lower case
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
#: kind, headers such as Proc-Type and DEK-Info, body
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----((?:(?:\s|\\[nr])*[A-Z][A-Za-z0-9-]{1,40}:[^\r\n\\]{0,200}(?:[\r\n]|\\[nr]))*)([A-Za-z0-9+/=\s\\]{16,}?)-----END \1PRIVATE KEY-----")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]{4,})\.(ey[A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
#: where base64, plain or URL-safe, of a SEQUENCE, of the OpenSSH container's magic or of a PEM text may begin: after anything
#: but a letter or digit, also after an escaped line end or a percent-encoded character
KEY64 = re.compile(r"(?:(?<![A-Za-z0-9])|(?<=\\[nrt])|(?<=%[0-9A-Fa-f]{2}))(?=(?:M[A-P]|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi)[A-Za-z0-9+/_-]{16})")
#: one line of base64, up to the dashes of a PEM mark; what lies between two lines
LINE64 = re.compile(r"(?:[A-Za-z0-9+/_]+|-(?!----))+")
BREAK64 = re.compile(r"[ \t]*(?:\r?\n|\\r\\n|\\n|\\r)[ \t]*")
PAD64 = re.compile("={0,2}")
KEYHEX = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[Ff]70656[Ee]7373682[Dd]6[Bb]65792[Dd]763100)(?:[0-9A-Fa-f]{2}){31,}(?![0-9A-Fa-f])")
#: the order of kinds that begin at one place
KINDS = ("assign", "access", "hex", "jwt", "pem", "key64", "keyhex")
RANK = {k: i for i, k in enumerate(KINDS)}
OPENSSH = b"openssh-key-v1\x00"

Span = tuple[str, int, int]


def der_items(data: bytes) -> list[tuple[int, int, int, int]] | None:
    """(depth, tag, begin, end) of every DER element, contents as begin:end; None unless all nested lengths fit exactly.

    One pass with a stack of the ends that are open, so neither depth nor length costs more than the bytes.
    """
    out: list[tuple[int, int, int, int]] = []
    ends, at = [len(data)], 0
    while True:
        while ends and at == ends[-1]:
            ends.pop()
        if not ends:
            return out
        if at + 2 > ends[-1]:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > ends[-1]:
                return None
            n, at = int.from_bytes(data[at : at + k]), at + k
            if n < 0x80:  # not the shortest form
                return None
        if at + n > ends[-1]:
            return None
        out.append((len(ends) - 1, tag, at, at + n))
        if tag & 0x20 and n:
            ends.append(at + n)
        else:
            at += n


def is_der_key(data: bytes) -> bool:
    """A private key in PKCS#1, DSA, SEC 1 or (encrypted) PKCS#8 form."""
    items = der_items(data)
    if not items or items[0][:2] != (0, 0x30) or sum(i[0] == 0 for i in items) != 1:
        return False
    top = [(tag, data[b:e]) for depth, tag, b, e in items if depth == 1]
    tags = [t for t, _ in top]
    if len(top) >= 3 and tags[0] == 0x02 and top[0][1] in (b"\x00", b"\x01"):
        if tags[1] == 0x30 and tags[2] == 0x04:  # version, algorithm, key octets
            return any(depth == 2 and tag == 0x06 for depth, tag, *_ in items)
        if tags[1] == 0x04:  # version, key octets, curve
            return len(top[1][1]) >= 16
        return len(top) >= 6 and all(t == 0x02 for t in tags[:6])  # version and the key's numbers
    # encrypted: algorithm with an identifier, then one octet string
    return tags == [0x30, 0x04] and len(top[1][1]) >= 32 and any(depth == 2 and tag == 0x06 for depth, tag, *_ in items)


def openssh_length(data: bytes) -> int | None:
    """The bytes of the container that `data` begins with, by its counted strings: cipher, kdf, options, the number of keys,
    public keys, the private block."""
    if not data.startswith(OPENSSH):
        return None
    at, strings, keys = len(OPENSSH), 0, 0
    while strings < 4 + keys or strings < 4:
        if strings == 3 and not keys:
            keys, at = int.from_bytes(data[at : at + 4]), at + 4
            if not 1 <= keys <= 64:
                return None
        n, at = int.from_bytes(data[at : at + 4]), at + 4
        at += n
        strings += 1
        if at > len(data):
            return None
    return at


def is_openssh_key(data: bytes) -> bool:
    return openssh_length(data) == len(data)


def is_key(data: bytes) -> bool:
    return is_der_key(data) or is_openssh_key(data)


def from_base64(text: str, url: bool = False) -> bytes | None:
    """The bytes, or None where the text is no base64 of its alphabet; missing padding is put back."""
    text = text.rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def der_length(head: bytes) -> int | None:
    """The bytes of a SEQUENCE that may be a key, by its first 12: a version or another SEQUENCE comes first in it."""
    n, at = head[1], 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4:
            return None
        n, at = int.from_bytes(head[2 : 2 + k]), 2 + k
    return at + n if head[at : at + 3] in (b"\2\1\0", b"\2\1\1") or head[at] == 0x30 else None


def chars_of(n: int) -> int:
    """The characters of base64 that n bytes take without padding."""
    return (4 * n + 2) // 3


def line_pieces(text: str, at: int, most: float = float("inf")) -> list[tuple[int, str]]:
    """(place, characters) of the lines of base64 that begin at `at`, until there are `most` characters."""
    out: list[tuple[int, str]] = []
    n = 0
    while n < most and (m := LINE64.match(text, at)):
        out.append((at, m[0]))
        n += len(m[0])
        if not (gap := BREAK64.match(text, m.end())):
            break
        at = gap.end()
    return out


def decoded64(pieces: list[tuple[int, str]], chars: int | None = None) -> bytes | None:
    run = "".join(p for _, p in pieces)[:chars]
    if chars is None and len(run) % 4 == 1:
        run = run[:-1]
    return from_base64(run, url="-" in run or "_" in run)


def key64_end(text: str, at: int) -> int | None:
    """Where base64 of a whole key that begins at `at` ends, on one line or several; None if there is none."""
    if text[at] == "M":
        head = decoded64([(at, text[at : at + 16])])
        if not head or (n := der_length(head)) is None:
            return None
        pieces = line_pieces(text, at, chars_of(n))
    else:
        pieces = line_pieces(text, at)
        signs = ""
        for i, (_, p) in enumerate(pieces):  # lines of the other alphabet are no part of it
            signs += "".join({*p} & {*"+/-_"})
            if {*signs} & {*"+/"} and {*signs} & {*"-_"}:
                pieces = pieces[:i]
                break
        data = decoded64(pieces)
        if not data:
            return None
        if data.startswith(OPENSSH):
            n = openssh_length(data)
        else:
            ends = [e for _, e in pem_spans(data.decode("latin-1"))]
            n = ends[-1] if ends else None
        if n is None:
            return None
    left = chars_of(n)
    if left > sum(len(p) for _, p in pieces) or (text[at] != "L" and not is_key(decoded64(pieces, left) or b"")):
        return None
    for begin, p in pieces:
        if left <= len(p):
            return PAD64.match(text, begin + left).end()
        left -= len(p)
    return None


def pem_spans(text: str) -> list[tuple[int, int]]:
    """Marked private keys. What is encrypted by its headers can't be read and is told by its marks."""
    out = []
    for m in PEM.finditer(text) if "PRIVATE KEY-----" in text else ():
        data = from_base64(re.sub(r"\\[nr]|\s", "", m[3]))
        if data and (is_key(data) or "ENCRYPTED" in m[2] or "DEK-Info:" in m[2]):
            out.append(m.span())
    return out


def key64_spans(text: str, marked: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Base64 of keys outside of `marked` stretches, none within another."""
    out: list[tuple[int, int]] = []
    to = 0
    for m in KEY64.finditer(text):
        at = m.start()
        if at >= to and not any(b <= at < e for b, e in marked) and (end := key64_end(text, at)):
            out.append((at, end))
            to = end
    return out


def is_object(part: str, key: str | None = None) -> bool:
    data = from_base64(part, url=True)
    try:
        got = json.loads(data) if data is not None else None
    except (ValueError, RecursionError):
        return False
    return isinstance(got, dict) and (key is None or isinstance(got.get(key), str))


def base_spans(text: str) -> list[Span]:
    """Spans of the three base kinds, each leftmost and non-overlapping within its kind."""
    out: list[Span] = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[Span]:
    """Spans of the kinds that were decoded and read."""
    out: list[Span] = []
    if "ey" in text:
        out += [("jwt", *m.span()) for m in JWT.finditer(text) if is_object(m[1], "alg") and is_object(m[2]) and (m[3] == "" or from_base64(m[3], url=True))]
    pem = pem_spans(text)
    out += [("pem", *x) for x in pem] + [("key64", *x) for x in key64_spans(text, pem)]
    return out + [("keyhex", *m.span()) for m in KEYHEX.finditer(text) if is_key(bytes.fromhex(m[0]))]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in sorted(spans, key=lambda s: (s[1], RANK[s[0]], s[2])))


def redacted(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """`text` with every stretch that spans cover put as one `mark`."""
    out, at, open_to = [], 0, -1
    for b, e in sorted((b, e) for _, b, e in spans):
        if b >= open_to:
            out += [text[at:b], mark]
        open_to = max(open_to, e)
        at = open_to
    return "".join([*out, text[at:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            n, digest, spans = {k: [] for k in KINDS}, [], []
            for text in part.column("text").to_pylist():
                base = base_spans(text or "")
                all_ = base + confirmed_spans(text or "")
                for k in KINDS:
                    n[k].append(sum(s[0] == k for s in all_))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(all_))
            out = {"id": part.column("id")} | {f"n_{k}": pa.array(v, pa.int64()) for k, v in n.items()}
            yield pa.RecordBatch.from_pydict(out | {"base_sha256": pa.array(digest, pa.string()), "spans": pa.array(spans, pa.string())})


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_jwt, n_pem, n_key64, n_keyhex, base_sha256, spans) of every row.

    Spans are `kind:begin:end` in code points, end exclusive, by begin and then kind. A null text counts as empty; an empty
    text has no span and the digest of "". Repeated rows are scanned each for itself; columns other than the two are not
    looked at, so none can clash. Nothing is shuffled, texts are scanned whole.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(docs[key].alias("id"), docs[text].alias("text")).mapInArrow(tidily(_scan), schema).withColumnRenamed("id", key)


def _redact(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index(text)
        for part in slices(batch, text):
            new = [t and redacted(t, base_spans(t) + confirmed_spans(t)) for t in part.column(text).to_pylist()]
            yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))


def redacted_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs`, all rows and columns, with each stretch of `text` that spans cover put as one mark; null stays null."""
    return docs.mapInArrow(tidily(lambda b: _redact(b, text)), docs.schema)
