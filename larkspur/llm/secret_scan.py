"""Secret scanning: patterns propose, decoded structure confirms.

Base kinds are patterns alone: ``assign`` (a keyword, ``=`` or ``:``, a value of 12 or more
characters), ``access`` (AKIA identifiers) and ``hex`` (16 or more hex digits). The structural kinds
are reported only if the decoded candidate parses to its last byte:

- ``jwt``: three dot-separated base64url parts whose header is a JSON object with an ``alg``,
  whose second part is a JSON object;
- ``pem``: a BEGIN/END PRIVATE KEY block whose body decodes to a key; line breaks may be written as
  escapes, and lines of headers may come first (if they say that the body is encrypted, it must be
  whole cipher blocks);
- ``key64``: base64 or base64url that decodes to a key outside such a block, in one run or in lines;
- ``keyhex``: a bare hex run, in lower or upper case, that decodes to a key.

A key is a DER SEQUENCE whose nested lengths all close exactly and whose children are those of
PKCS#1, PKCS#8 (plain, or encrypted by a password scheme), SEC1 or DSA keys, or an OpenSSH private
key whose length prefixes, check numbers and padding fit.

Nulls and odd input: a null text is an empty one and has no spans; a null id is kept as it is;
repeated rows give equal rows; texts are scanned whole in time linear in their length (every pattern
starts at the head of a run and gives nothing back); columns other than the id and the text are not
read; an empty table gives an empty result.
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

from .common import map_in_arrow

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "jwt", "pem", "key64", "keyhex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEYWORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A JSON object in base64url starts with e and one of the letters for "{" and what follows it.
JWT = re.compile(r"(?<![A-Za-z0-9_-])e[w-z0-9_-][A-Za-z0-9_-]*+\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+")
PEM_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,30}PRIVATE KEY)-----")
ESCAPES = re.compile(r"\\[nrt]")
#: DER starts with 0x30 and a length (M), OpenSSH's header with "openss" (b3Blbn).
RUN64 = re.compile(r"(?<![A-Za-z0-9+/=])(?:M|b3Blbn)[A-Za-z0-9+/]{42,}+(?:(?:\r?\n|\\n|\\r\\n)[ \t]*+[A-Za-z0-9+/]++)*+={0,2}")
RUN64_URL = re.compile(r"(?<![A-Za-z0-9_-])(?:M|b3Blbn)[A-Za-z0-9]*+[_-][A-Za-z0-9_-]*+={0,2}")
RUN16 = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{62,}+")
BREAKS = re.compile(r"\\r|\\n|\s")
#: Object identifiers of the password schemes (PKCS#5) begin so.
PASSWORD_SCHEME = bytes.fromhex("2a864886f70d01")
#: Numbers and strings of an OpenSSH key after its type, before its comment.
SSH_FIELDS = {b"ssh-rsa": 6, b"ssh-ed25519": 2, b"ssh-dss": 5}
SCHEMA = "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long>>"


def der_children(data: bytes, depth: int = 12) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the elements that fill data exactly, nested ones checked too; else None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 128:
            size = n & 127
            if not 1 <= size <= 4 or at + size > len(data):
                return None
            n = int.from_bytes(data[at : at + size], "big")
            at += size
        if at + n > len(data):
            return None
        body = data[at : at + n]
        if tag & 32 and (depth == 0 or der_children(body, depth - 1) is None):
            return None
        out.append((tag, body))
        at += n
    return out


def _ssh_string(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The length-prefixed string at a position, and where it ends."""
    if at + 4 > len(data):
        return None
    end = at + 4 + int.from_bytes(data[at : at + 4], "big")
    return (data[at + 4 : end], end) if end <= len(data) else None


def _ssh_private(data: bytes, keys: int) -> bool:
    """Whether an unencrypted OpenSSH block holds so many keys, then its padding, and no more."""
    if len(data) < 8 or data[:4] != data[4:8]:
        return False
    at = 8
    for _ in range(keys):
        if (found := _ssh_string(data, at)) is None:
            return False
        kind, at = found
        fields = 3 if kind.startswith(b"ecdsa-sha2-") else SSH_FIELDS.get(kind)
        if fields is None:
            return False
        for _ in range(fields + 1):  # the comment, too
            if (found := _ssh_string(data, at)) is None:
                return False
            at = found[1]
    return len(data) - at < 64 and data[at:] == bytes(range(1, len(data) - at + 1))


def openssh_end(data: bytes) -> int | None:
    """Where the OpenSSH private key that data begins with ends; None if it is none."""
    if not data.startswith(b"openssh-key-v1\0"):
        return None
    at, heads = 15, []
    for _ in range(3):  # cipher, key derivation and its options
        if (found := _ssh_string(data, at)) is None:
            return None
        heads.append(found[0])
        at = found[1]
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16:
        return None
    for _ in range(keys):
        if (found := _ssh_string(data, at)) is None:
            return None
        at = found[1]
    if (found := _ssh_string(data, at)) is None:
        return None
    block, at = found
    ok = _ssh_private(block, keys) if heads[0] == b"none" else bool(block) and len(block) % 8 == 0
    return at if ok else None


def der_end(data: bytes) -> int | None:
    """Where the DER SEQUENCE that data begins with says that it ends."""
    if len(data) < 2 or data[0] != 0x30:
        return None
    size = data[1] & 127 if data[1] & 128 else 0
    if size > 4 or len(data) < 2 + size or data[1] == 128:
        return None
    return 2 + size + (int.from_bytes(data[2 : 2 + size], "big") if size else data[1])


def is_key(data: bytes) -> bool:
    """Whether the bytes, all of them, encode a private key."""
    if data.startswith(b"openssh-key-v1\0"):
        return openssh_end(data) == len(data)
    if len(data) < 16 or der_end(data) != len(data):
        return False
    outer = der_children(data)
    if outer is None or len(outer) != 1:
        return False
    inner = der_children(outer[0][1])
    if not inner:
        return False
    tags = [tag for tag, _ in inner]
    if tags == [0x30, 0x04]:  # encrypted: how, and the cipher's bytes
        scheme = der_children(inner[0][1])
        return bool(scheme) and scheme[0][0] == 6 and scheme[0][1].startswith(PASSWORD_SCHEME) and len(inner[1][1]) >= 8
    if inner[0][0] != 2 or inner[0][1] not in (b"\0", b"\1"):
        return False
    return tags[1:3] == [0x30, 0x04] or tags[1:2] == [0x04] or len(tags) in (6, 9) and set(tags) == {2}


def decode64(text: str) -> bytes | None:
    text = re.sub(r"\s+", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _is_pem_key(body: str) -> bool:
    """Whether the lines between BEGIN and END are a key, after header lines if there are any."""
    lines = [line.strip() for line in ESCAPES.sub("\n", body).split("\n")]
    heads = [line for line in lines if ":" in line]
    data = decode64("".join(line for line in lines if ":" not in line))
    if not data:
        return False
    return len(data) % 8 == 0 if any("ENCRYPTED" in h for h in heads) else is_key(data)


def _pems(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while (m := PEM_BEGIN.search(text, at)) is not None:
        at = text.find("-----", m.end())
        if at < 0:
            return
        close = f"-----END {m[1]}-----"
        if text.startswith(close, at):
            if _is_pem_key(text[m.end() : at]):
                yield m.start(), at + len(close)
            at += len(close)


def _bare64(text: str, start: int, end: int) -> int | None:
    """Where the key ends whose base64 starts a run of text from start to end; None if there is none."""
    run = text[start:end]
    plain = BREAKS.sub("", run).rstrip("=")
    data = decode64(plain[: len(plain) // 4 * 4]) if len(plain) % 4 == 1 else decode64(plain)
    size = None if data is None else openssh_end(data) if data[:1] == b"o" else der_end(data)
    if size is None or size > len(data) or not is_key(data[:size]):
        return None
    need = -(-size * 4 // 3)  # characters of the key; the run must break off there
    i, left = start, need
    while left:
        m = BREAKS.match(text, i)
        i, left = (m.end(), left) if m else (i + 1, left - 1)
    while i < end and text[i] == "=":
        i += 1
    return i if i == end or BREAKS.match(text, i) else None


def _json(part: str) -> dict | None:
    try:
        value = json.loads(decode64(part) or b"")
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(text: str) -> bool:
    head, body, _ = text.split(".")
    found = _json(head)
    return found is not None and isinstance(found.get("alg"), str) and _json(body) is not None


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, in code points, by start, then kind as listed."""
    spans: list[tuple[int, int, str]] = []
    folded = text.lower() if not text.islower() else text
    if any(w in folded for w in KEYWORDS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    for m in RUN16.finditer(text):
        if not (m.end() - m.start()) % 2 and is_key(bytes.fromhex(m[0])):
            spans.append((m.start(), m.end(), "keyhex"))
    if "." in text:
        spans += [(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if is_signed_token(m[0])]
    pems = list(_pems(text)) if "-----BEGIN " in text else []
    spans += [(a, b, "pem") for a, b in pems]
    k = 0
    for m in sorted([*RUN64.finditer(text), *RUN64_URL.finditer(text)], key=lambda m: m.start()):
        while k < len(pems) and pems[k][1] <= m.start():
            k += 1
        if not (k < len(pems) and pems[k][0] <= m.start()) and (end := _bare64(text, m.start(), m.end())) is not None:
            spans.append((m.start(), end, "key64"))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(spans), key=lambda s: (s[0], order[s[2]], s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, found) for every row of docs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("id", pa.int64()), *((n, pa.int64()) for n in ("n_assign", "n_access", "n_hex")), ("base_sha256", pa.string()), ("spans", pa.string()),
             ("found", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]
        )
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = find_secrets(text or "")
                base = [s for s in spans if s[2] in KINDS[:3]]
                counts = [sum(s[2] == k for s in base) for k in KINDS[:3]]
                found = [{"kind": k, "start": s, "end": e} for s, e, k in spans]
                rows.append((doc, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), found))
            columns = list(zip(*rows)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return map_in_arrow(rows, scan, SCHEMA).withColumnRenamed("id", id_col)
