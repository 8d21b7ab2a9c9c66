"""Secret scans with structural confirmation.

Three patterns find plain candidates. Candidates in base64 or hex, on one line or wrapped over lines of one length, are decoded and
parsed. A key is reported only if its nested lengths fit exactly, down to the last level, and its structure is that of a private one:
PKCS#1 (version and eight numbers), DSA (version and five), SEC1 (version 1 and an octet string), PKCS#8 (version, algorithm, and
an octet string that parses again), encrypted PKCS#8 (an algorithm of passwords), or an OpenSSH key. So public
keys, certificates and signatures aren't reported. Between PEM marks an encrypted body counts if its header names cipher and start value
and its length fits. A signed token needs a header in JSON that names an algorithm. Spans are code point offsets, the end exclusive.

A null text is empty and has no spans; overlapping spans of different kinds are all reported; equal rows
each get theirs. An empty table gives an empty result. A candidate of any length is decoded whole. Columns besides doc_id and text are ignored.
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

from cratewise.llm.common import texts

# The kinds in the order of the report, and the patterns of the plain ones.
KINDS = ("assign", "access", "hex", "token", "key")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

#: In quoted strings line ends, tabs and slashes are escaped, more than once where strings are nested.
PEM = re.compile(
    r"-----BEGIN (?P<kind>[A-Z ]*PRIVATE KEY)-----(?P<head>(?:(?:\\+[nrt]|\s)*[A-Z][A-Za-z]*-[A-Z][A-Za-z]*: [^\n\r\\]*(?:\\+[nrt]|\s))*)"
    r"(?P<body>(?:[A-Za-z0-9+/=\s]|\\+[nrt/])+)-----END (?P=kind)-----"
)
#: What the header of an encrypted body says: the cipher, and its start value in hex.
ENCRYPTED = re.compile(r"Proc-Type: 4,ENCRYPTED(?:.|\s)*DEK-Info: [A-Z0-9-]+,((?:[0-9A-Fa-f]{2}){8,16})(?![0-9A-Fa-f])")
#: The next line of a wrapped candidate.
NEXT = re.compile(r"(?:\\+[nr]|\r?\n)+[ \t]*([A-Za-z0-9+/_-]+={0,2})(?![A-Za-z0-9+/_=-])")
ESCAPED = re.compile(r"\\+[nrt]|\\+(?=/)|\s+")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]+)\.(ey[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
#: A DER sequence starts with the byte 0x30, so its base64 starts with M and its hex with 30; an OpenSSH key with its magic. An escaped line end may stand before.
ENCODED = re.compile(
    r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nrt]))(?:M|b3BlbnNzaC1rZXktdjEA)[A-Za-z0-9+/_-]{31,}={0,2}"
    r"|(?:(?<![0-9A-Fa-f])|(?<=\\[nrt]))(?P<hex>(?:30|6[Ff]70656[Ee]7373682[Dd]6[Bb]65792[Dd]763100)[0-9A-Fa-f]{46,})"
)
OPENSSH = b"openssh-key-v1\0"
#: These ciphers put a tag of so many bytes after the private part.
TAGGED, TAG = (b"aes128-gcm@openssh.com", b"aes256-gcm@openssh.com", b"chacha20-poly1305@openssh.com"), 16
LEAST_PARTS = 2
NUMBER, OCTETS, OBJECT, SEQUENCE = 0x02, 0x04, 0x06, 0x30
#: Object ids of algorithms that take a password start with these.
BY_PASSWORD = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
DEEPEST = 16


def from_base64(text: str) -> bytes | None:
    """Either alphabet, with or without padding."""
    plain = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except binascii.Error:
        return None


def der_parts(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag, start and end of each element between two offsets; None unless their lengths fill it exactly."""
    parts = []
    while start < end:
        if start + 2 > end:
            return None
        tag, size, at = data[start], data[start + 1], start + 2
        if size & 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or at + more > end:
                return None
            size, at = int.from_bytes(data[at : at + more], "big"), at + more
        if at + size > end:
            return None
        parts.append((tag, at, at + size))
        start = at + size
    return parts


def ssh_strings(data: bytes, start: int, most: int | None = None) -> tuple[list[bytes], int] | None:
    """Strings with 32-bit lengths, so many or all up to the end, and the offset after them; None if one doesn't fit."""
    found: list[bytes] = []
    while len(found) < most if most is not None else start < len(data):
        size = int.from_bytes(data[start : start + 4], "big")
        if start + 4 + size > len(data):
            return None
        found.append(data[start + 4 : start + 4 + size])
        start += 4 + size
    return found, start


def is_openssh_key(data: bytes) -> bool:
    """The magic, cipher, derivation and its options, the number of keys, so many public ones and the private part, without a rest."""
    head = ssh_strings(data, len(OPENSSH), 3) if data.startswith(OPENSSH) else None
    if head is None or head[1] + 4 > len(data):
        return False
    (cipher, derivation, _), at = head
    keys = int.from_bytes(data[at : at + 4], "big")
    if not cipher or not derivation or not 1 <= keys <= len(data):
        return False
    body = ssh_strings(data, at + 4, keys + 1)
    if body is None or len(data) - body[1] != (TAG if cipher in TAGGED else 0):
        return False
    *public, private = body[0]
    for key in public:
        parts = ssh_strings(key, 0)
        if parts is None or len(parts[0]) < LEAST_PARTS or not parts[0][0]:
            return False
    return len(private) >= 8 and (cipher != b"none" or private[:4] == private[4:8])


def is_key(data: bytes) -> bool:
    return is_openssh_key(data) or is_der_key(data)


def well_formed(data: bytes, start: int, end: int, depth: int = 0) -> bool:
    """Whether elements fill the range, those within them too, and so on."""
    parts = der_parts(data, start, end)
    return parts is not None and depth < DEEPEST and all(well_formed(data, a, b, depth + 1) for tag, a, b in parts if tag & 0x20)


def is_der_key(data: bytes) -> bool:
    """One DER sequence that fills the data and is built as a private key is."""
    outer = der_parts(data, 0, len(data))
    if outer is None or len(outer) != 1 or outer[0][0] != SEQUENCE or not well_formed(data, *outer[0][1:]):
        return False
    parts = der_parts(data, *outer[0][1:])
    tags, value = [tag for tag, _, _ in parts], lambda k: data[parts[k][1] : parts[k][2]]
    if tags == [SEQUENCE, OCTETS]:
        algorithm = der_parts(data, *parts[0][1:])
        return bool(algorithm) and algorithm[0][0] == OBJECT and data[algorithm[0][1] : algorithm[0][2]].startswith(BY_PASSWORD) and len(value(1)) >= 8
    if not tags or tags[0] != NUMBER or value(0) not in (b"\0", b"\1"):
        return False
    if tags[1:] in ([NUMBER] * 8, [NUMBER] * 8 + [SEQUENCE], [NUMBER] * 5):
        return True
    if tags[1:2] == [OCTETS]:
        return value(0) == b"\1" and len(value(1)) >= 16 and set(tags[2:]) <= {0xA0, 0xA1}
    if tags[1:3] != [SEQUENCE, OCTETS] or not set(tags[3:]) <= {0xA0, 0xA1, 0x81}:
        return False
    algorithm, inner = der_parts(data, *parts[1][1:]), der_parts(data, *parts[2][1:])
    return bool(algorithm) and algorithm[0][0] == OBJECT and inner is not None and len(inner) == 1 and (not inner[0][0] & 0x20 or well_formed(data, *inner[0][1:]))


def is_encrypted(head: str, data: bytes) -> bool:
    """Whether a PEM header names a cipher and its start value, and the body has whole blocks of it."""
    found = ENCRYPTED.search(head)
    return found is not None and len(data) >= 16 and len(data) % (len(found[1]) // 2) == 0


def is_signed_token(header: str, body: str) -> bool:
    for part, name in ((header, "alg"), (body, None)):
        try:
            value = json.loads(from_base64(part) or b"")
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict) or (name and not isinstance(value.get(name), str)):
            return False
    return True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the plain patterns find; matches that are too short are dropped."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """What decoding and parsing confirms: signed tokens and key encodings."""
    found = [("token", m.start(), m.end()) for m in SIGNED.finditer(text) if is_signed_token(m[1], m[2])]
    pem = [m for m in PEM.finditer(text) if (data := from_base64(ESCAPED.sub("", m["body"]))) and (is_key(data) or is_encrypted(m["head"], data))]
    found += [("key", m.start(), m.end()) for m in pem]
    done = 0
    for m in ENCODED.finditer(text):
        if m.start() < done or any(p.start() <= m.start() < p.end() for p in pem):
            continue
        for body, end in wrapped(m, text):
            data = from_base64(body) if m["hex"] is None else bytes.fromhex(body) if re.fullmatch("(?:[0-9A-Fa-f]{2})+", body) else None
            if data and is_key(data):
                found.append(("key", m.start(), end))
                done = end
                break
    return found


def wrapped(m: re.Match, text: str) -> list[tuple[str, int]]:
    """What a candidate may be, with its end: its line alone; with all following lines of its length; with a last one that is shorter."""
    line, end = m[0], m.end()
    tries, lines = [(line, end)], [line]
    while len(lines[-1]) == len(line) and not lines[-1].endswith("="):
        more = NEXT.match(text, end)
        if more is None or len(more[1]) > len(line):
            break
        if len(more[1]) < len(line) and len(lines) > 1:
            tries.append(("".join(lines), end))
        lines.append(more[1])
        end = more.end()
    return [*tries, ("".join(lines), end)] if len(lines) > 1 else tries


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS[:3]}
            digests, spans = [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                for kind, own in counts.items():
                    own.append(sum(k == kind for k, _, _ in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + confirmed_spans(text)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in counts.values()), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of every kind replaced in text; overlapping spans become one mark."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                at, parts = 0, []
                for _, a, b in sorted(base_spans(text or "") + confirmed_spans(text or ""), key=lambda x: x[1]):
                    if b > at:
                        parts += [text[at:a], mark] if a >= at else []
                        at = b
                out.append(None if text is None else "".join([*parts, text[at:]]))
            yield batch.set_column(columns.index("text"), "text", pa.array(out, pa.string()))

    return docs.mapInArrow(run, docs.schema)
