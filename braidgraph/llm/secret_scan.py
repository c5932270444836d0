"""Secret scans with structural confirmation.

Three base patterns find assignments, access keys and hexadecimal runs by regular
expression. Further spans are reported only after their structure is confirmed:

``pem``     an armoured block whose base64 body is a private key, or whose header lines
            name a cipher that the body's size fits
``der``     a bare base64, base64url or hex run that decodes to a private key in DER
``ssh``     a base64 run that is an OpenSSH private key container
``sshpub``  a base64 run of an SSH public key: no secret, but a trace of one
``jwt``     three base64url parts whose header is a JSON object with ``alg``

Private keys in DER are RSA (version and eight INTEGERs of fitting sizes), DSA
(version and five), EC (version 1 and an OCTET STRING), PKCS#8 (version, a known key
algorithm, an OCTET STRING that holds that algorithm's key) and encrypted PKCS#8 (a
password-based scheme and an OCTET STRING). Certificates and public keys in DER are
not reported. A base64 run may follow any character but a letter or digit and may be
wrapped over lines; where it ends follows from the lengths that it encodes, and no
further character of the alphabet may follow. What lies inside a reported block is
not reported again.

Whole texts are scanned, map-only. Offsets count code points, ends are exclusive.
A null text is read as empty; an empty text has no spans.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from braidgraph.llm.common import small_batches

#: Base kinds, in the order that breaks ties of start.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "ssh", "sshpub", "jwt")
_PEM, _DER, _SSH, _PUB, _TOKEN = range(3, 8)
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{%d,}" % (MIN_ACCESS - 4))
_HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,64})(?=-----)")
_CIPHER = re.compile(r"^[ \t]*DEK-Info:[ \t]*([A-Za-z0-9-]+)(?:,[ \t]*([0-9A-Fa-f]+))?[ \t]*$", re.M)
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
_HEXRUN = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{62,}(?![0-9A-Fa-f])")
#: A SEQUENCE starts with M; SSH fields with AAAA; the OpenSSH container with its magic.
_START = re.compile(r"(?<![A-Za-z0-9])(?=M[A-Za-z0-9+/_-]{23}|AAAA[A-Za-z0-9+/]{20}|b3BlbnNzaC1rZXktdjEA)")
_RUN = re.compile(r"[A-Za-z0-9+/_-]+")
_FOLD = re.compile(r"[ \t]*\r?\n[ \t]*(?=[A-Za-z0-9+/_-])")

_INTEGER, _BITS, _OCTETS, _OID, _SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30
#: Object identifiers (fixed values), as DER contents: RSA and RSA-PSS, DSA, EC, Diffie-Hellman; the X and Ed curves.
_RSA = (bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a864886f70d01010a"))
_EC, _DSA, _DH = bytes.fromhex("2a8648ce3d0201"), bytes.fromhex("2a8648ce380401"), bytes.fromhex("2a864886f70d010301")
_CURVES = tuple(bytes.fromhex("2b65") + bytes([k]) for k in (110, 111, 112, 113))
#: Password-based schemes: PKCS#5 and PKCS#12 (prefixes).
_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
#: SSH key types (fixed values) with the number of fields after the name.
_SSH_FIELDS = {b"ssh-rsa": 2, b"ssh-dss": 4, b"ssh-ed25519": 1, b"ecdsa-sha2-nistp256": 2, b"ecdsa-sha2-nistp384": 2, b"ecdsa-sha2-nistp521": 2}
_MAGIC = b"openssh-key-v1\0"


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value at ``at``; None unless it lies within ``end``."""
    if at + 2 > end:
        return None
    tag, size, body = data[at], data[at + 1], at + 2
    if tag & 0x1F == 0x1F:
        return None
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or body + n > end:
            return None
        size = int.from_bytes(data[body : body + n], "big")
        if size < 0x80 or n > 1 and data[body] == 0:  # DER has the shortest form only
            return None
        body += n
    return (tag, body, body + size) if body + size <= end else None


def der_tags(data: bytes) -> list[int] | None:
    """Tags of all values if ``data`` is one DER SEQUENCE whose nested lengths tile it exactly."""
    top = _tlv(data, 0, len(data))
    if not top or top[0] != _SEQUENCE or top[2] != len(data):
        return None
    tags, todo = [], [(top[1], top[2])]
    while todo:
        at, end = todo.pop()
        while at < end:
            v = _tlv(data, at, end)
            if v is None:
                return None
            tags.append(v[0])
            if v[0] & 0x20:
                todo.append((v[1], v[2]))
            at = v[2]
    return tags


def _children(data: bytes) -> list[tuple[int, bytes]]:
    """(tag, content) of the values inside ``data``, which tile it."""
    out, at = [], 0
    while at < len(data) and (v := _tlv(data, at, len(data))):
        out.append((v[0], data[v[1] : v[2]]))
        at = v[2]
    return out if at == len(data) else []


def _numbers(parts: list[tuple[int, bytes]]) -> list[int]:
    return [int.from_bytes(c, "big", signed=True) for tag, c in parts if tag == _INTEGER]


def _rsa(parts: list[tuple[int, bytes]]) -> bool:
    """version, n, e, d, p, q, d mod p - 1, d mod q - 1, inverse of q (more primes in version 1)."""
    if [tag for tag, _ in parts[:9]] != [_INTEGER] * 9:
        return False
    version, n, e, d, p, q, dp, dq, qi = _numbers(parts[:9])
    more = [tag for tag, _ in parts[9:]] == ([_SEQUENCE] if version else [])
    sized = n.bit_length() >= 256 and abs(p.bit_length() + q.bit_length() - n.bit_length()) <= (1 if version == 0 else n.bit_length())
    return version in (0, 1) and more and sized and 1 < e < n and 1 < d < n and 0 < dp < p and 0 < dq < q and 0 < qi < p


def _dsa(parts: list[tuple[int, bytes]]) -> bool:
    """version, p, q, g, public and private number."""
    if [tag for tag, _ in parts] != [_INTEGER] * 6:
        return False
    version, p, q, g, y, x = _numbers(parts)
    return version == 0 and p.bit_length() >= 512 and 160 <= q.bit_length() <= 512 and 1 < g < p and 1 < y < p and 0 < x < q


def _ec(parts: list[tuple[int, bytes]]) -> bool:
    """version 1, the private number, then the curve and the public point if given."""
    tags = [tag for tag, _ in parts]
    return tags[:2] == [_INTEGER, _OCTETS] and tags[2:] in ([], [0xA0], [0xA1], [0xA0, 0xA1]) and parts[0][1] == b"\1" and 20 <= len(parts[1][1]) <= 72


def _inner(oid: bytes, key: bytes) -> bool:
    """Whether the OCTET STRING of PKCS#8 holds a key of its algorithm."""
    top = _children(key)
    if len(top) != 1:
        return False
    tag, content = top[0]
    if oid in _CURVES:
        return tag == _OCTETS and 32 <= len(content) <= 57
    if oid in _RSA or oid == _EC:
        return tag == _SEQUENCE and (_rsa if oid in _RSA else _ec)(_children(content))
    return oid in (_DSA, _DH) and tag == _INTEGER and len(content) >= 16


def is_private_der(data: bytes) -> bool:
    """A private key of one of the shapes above whose nested lengths tile ``data`` exactly."""
    if der_tags(data) is None:
        return False
    parts = _children(_children(data)[0][1])
    tags = [tag for tag, _ in parts]
    if tags[:3] == [_INTEGER, _SEQUENCE, _OCTETS]:
        algorithm = _children(parts[1][1])
        named = bool(algorithm) and algorithm[0][0] == _OID and parts[0][1] in (b"\0", b"\1")
        return named and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]) and _inner(algorithm[0][1], parts[2][1])
    if tags == [_SEQUENCE, _OCTETS]:
        scheme = _children(parts[0][1])
        return len(scheme) == 2 and scheme[0][0] == _OID and scheme[0][1].startswith(_PBE) and len(parts[1][1]) >= 16
    return _rsa(parts) or _dsa(parts) or _ec(parts)


def _fields(data: bytes, at: int, count: int) -> tuple[list[bytes], int] | None:
    """``count`` length-prefixed fields from ``at`` on, and where they end."""
    out = []
    for _ in range(count):
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if at + size > len(data):
            return None
        out.append(data[at : at + size])
        at += size
    return out, at


def ssh_public(data: bytes) -> int | None:
    """Where an SSH public key at the start of ``data`` ends; None if there is none."""
    name = _fields(data, 0, 1)
    if not name or name[0][0] not in _SSH_FIELDS:
        return None
    found = _fields(data, name[1], _SSH_FIELDS[name[0][0]])
    if not found:
        return None
    kind, values = name[0][0], found[0]
    if kind == b"ssh-rsa":
        fits = 1 <= len(values[0]) <= 8 and len(values[1]) >= 32
    elif kind == b"ssh-ed25519":
        fits = len(values[0]) == 32
    elif kind == b"ssh-dss":
        fits = len(values[0]) >= 64 and 20 <= len(values[1]) <= 33
    else:
        fits = values[0] == kind[11:] and values[1][:1] in (b"\2", b"\3", b"\4") and 33 <= len(values[1]) <= 133
    return found[1] if fits else None


def ssh_container(data: bytes) -> int | None:
    """Where an OpenSSH private key container at the start of ``data`` ends; None if there is none.

    Cipher, key derivation and its options, the number of keys, that many public keys,
    and the private part: whole blocks, which start, unless encrypted, with a number
    twice and the first key's type.
    """
    head = _fields(data, len(_MAGIC), 3)
    if not data.startswith(_MAGIC) or not head or head[1] + 4 > len(data):
        return None
    (cipher, derived, _), at = head
    count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if (cipher == b"none") != (derived == b"none") or not 1 <= count <= len(data) // 36:
        return None
    rest = _fields(data, at, count + 1)
    if not rest or any(ssh_public(k) != len(k) for k in rest[0][:-1]):
        return None
    private = rest[0][-1]
    if len(private) < 64 or len(private) % 8:
        return None
    name = _fields(private, 8, 1) if cipher == b"none" else None
    if cipher == b"none" and (private[:4] != private[4:8] or not name or name[0][0] not in _SSH_FIELDS):
        return None
    return rest[1]


def _b64(s: str, url: bool = False) -> bytes | None:
    s = s.rstrip("=")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _pem_parts(body: str) -> tuple[str, str]:
    """Header lines (RFC 1421; up to a blank line) and base64 of an armoured block's body."""
    lines = body.strip().splitlines()
    if not lines or ":" not in lines[0]:
        return "", body
    cut = next((i for i, x in enumerate(lines) if not x.strip()), None)
    if cut is None:  # no blank line: the headers end with the last colon
        cut = max(i for i, x in enumerate(lines) if ":" in x) + 1
    return "\n".join(lines[:cut]), "\n".join(lines[cut:])


def is_encrypted(headers: str, raw: bytes) -> bool:
    """An encrypted body: its header names a cipher with an initial vector, whole blocks of which it fills."""
    m = _CIPHER.search(headers)
    if not m or not raw or "ENCRYPTED" not in headers:
        return False
    block = len(m[2] or "") // 2
    return block in (8, 16) and len(m[2]) % 2 == 0 and (not m[1].upper().endswith("CBC") or len(raw) % block == 0)


def is_jwt_header(part: str) -> bool:
    raw = _b64(part, url=True)
    try:
        head = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, unsorted."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    # a run too short from its first AKIA is too short from any later one, so a bound in the pattern finds the same spans
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


def _read_b64(text: str, start: int, wanted: int) -> tuple[bytes, int] | None:
    """``wanted`` bytes of base64, wrapped or not, from ``start`` on, and where they end; None if the
    run is shorter or goes on."""
    left, parts, at = -(-wanted * 4 // 3), [], start
    while True:
        m = _RUN.match(text, at)
        if not m or len(m[0]) > left:
            return None
        parts.append(m[0])
        left -= len(m[0])
        if not left:
            break
        fold = _FOLD.match(text, m.end())
        if not fold:
            return None
        at = fold.end()
    body, end = "".join(parts), m.end()
    raw = _b64(body, url="-" in body or "_" in body)
    pad = -len(body) % 4
    return (raw, end + (pad if text.startswith("=" * pad, end) else 0)) if raw and len(raw) == wanted else None


def _peek(text: str, start: int, most: int) -> bytes:
    """Up to ``most`` bytes of base64 from ``start`` on, as far as they go."""
    parts, left, at = [], -(-most // 3) * 4, start
    while left and (m := _RUN.match(text, at, at + left)):
        parts.append(m[0])
        left -= len(m[0])
        fold = _FOLD.match(text, m.end())
        if not fold:
            break
        at = fold.end()
    body = "".join(parts)
    return _b64(body[: len(body) - (len(body) % 4 == 1)]) or b""


def _whole(text: str, start: int) -> int | None:
    """A size that certainly holds the SSH structure at ``start``: the bytes of its run."""
    at = start
    count = 0
    while m := _RUN.match(text, at):
        count += len(m[0])
        fold = _FOLD.match(text, m.end())
        if not fold:
            break
        at = fold.end()
    return count * 3 // 4


def _key_at(text: str, start: int) -> tuple[int, int] | None:
    """(kind, end) of the key whose base64 starts at ``start``."""
    if text[start] == "M":
        head = _b64(text[start : start + 8], url=True) if {"-", "_"} & set(text[start : start + 8]) else _b64(text[start : start + 8])
        size = _der_size(head or b"")
        got = _read_b64(text, start, size) if size else None
        return (_DER, got[1]) if got and is_private_der(got[0]) else None
    ends, kind = (ssh_public, _PUB) if text[start] == "A" else (ssh_container, _SSH)
    if kind == _PUB:
        name = _peek(text, start, 32)
        if not any(name[4:].startswith(k) for k in _SSH_FIELDS):
            return None
    size = ends(_peek(text, start, _whole(text, start)))
    got = _read_b64(text, start, size) if size else None
    return (kind, got[1]) if got else None


def _der_size(head: bytes) -> int | None:
    """Bytes of the SEQUENCE that starts with ``head``."""
    if len(head) < 6 or head[0] != _SEQUENCE:
        return None
    if head[1] < 0x80:
        return 2 + head[1]
    n = head[1] & 0x7F
    return 2 + n + int.from_bytes(head[2 : 2 + n], "big") if 1 <= n <= 4 else None


def is_private(raw: bytes) -> bool:
    return is_private_der(raw) or ssh_container(raw) == len(raw)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates whose decoded structure is that of a secret."""
    out: list[tuple[int, int, int]] = []
    if "-----BEGIN " in text:
        for m in _BEGIN.finditer(text):
            start, end = m.end() + 5, f"-----END {m[1]}-----"
            stop = text.find("-----", start)
            if stop < 0 or not text.startswith(end, stop):
                continue
            headers, body = _pem_parts(text[start:stop])
            raw = _b64("".join(body.split()))
            if raw and (is_private(raw) or is_encrypted(headers, raw)):
                out.append((m.start(), _PEM, stop + len(end)))
    if "eyJ" in text:
        out += [(m.start(), _TOKEN, m.end()) for m in _JWT.finditer(text) if is_jwt_header(m[1])]
    taken = sorted((s, e) for s, _, e in out)
    starts = [s for s, _ in taken]

    def inside(at: int) -> bool:
        k = bisect_right(starts, at) - 1
        return k >= 0 and at < taken[k][1]

    done = 0
    for m in _START.finditer(text):
        if m.start() >= done and not inside(m.start()) and (found := _key_at(text, m.start())):
            out.append((m.start(), *found))
            done = found[1]
    for m in _HEXRUN.finditer(text):
        if len(m[0]) % 2 == 0 and is_private_der(bytes.fromhex(m[0])):
            out.append((m.start(), _DER, m.end()))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_assign", T.LongType()),
        T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per document: counts of each base kind, a digest of the base spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for value in b.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                for k in range(3):
                    rows[k].append(sum(s[1] == k for s in base))
                rows[3].append(hashlib.sha256(listed(base).encode()).hexdigest())
                rows[4].append(listed(base + confirmed_spans(text)))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, rows, types)], names=_SCHEMA.fieldNames())

    return small_batches(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, _SCHEMA)
