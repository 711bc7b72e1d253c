"""Secret scan: plain patterns, then encoded candidates that are reported only if their structure parses.

Base kinds (``assign``, ``access``, ``hex``) are patterns. The method adds runs of base64 or hexadecimal
digits that decode to something with the inner structure of a key: a DER sequence whose nested lengths
fill it exactly and whose first members are those of a key, an SSH public or private key whose
length-prefixed fields add up, or a signed token whose first segment is a JSON header naming an algorithm.

Defined results: a null or empty text has no secrets; repeated rows get equal results; texts of any length are
scanned whole; an empty table gives an empty result. The scan reads id and text only; redaction passes all
columns through, with the text (and ``n_chars``, its length) rewritten only where secrets were found.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, strings

#: Base kinds in the order in which ties are listed, then those of the method.
KINDS = ("assign", "access", "hex", "der", "ssh", "jwt")
_RANK = {k: i for i, k in enumerate(KINDS)}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: What every match of ASSIGN has; most texts have none of it and skip the slower pattern.
_ASSIGN_HINT = re.compile(r"""[A-Za-z]["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{16,})(?![A-Za-z0-9_-])")
#: A line's end, itself or written as an escape, with the indentation around it.
_BREAK = r"[\x20\t]*(?:\r?\n|(?:\\+r)?\\+n)[\x20\t]*"
BREAK = re.compile(_BREAK)
#: A base64 run, perhaps over lines of an armoured key; the letter of an escape is not its first digit.
BASE64 = re.compile(rf"(?!(?<=\\)[nrt])[A-Za-z0-9+/]{{32,}}(?:{_BREAK}[A-Za-z0-9+/]+)*={{0,2}}")
HEX_BYTES = re.compile(r"(?:[0-9a-f]{64,}|[0-9A-F]{64,})")

Span = tuple[int, int, str]


def _der(data: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the members that fill ``data[at:end]`` exactly, or None."""
    members = []
    while at < end:
        if end - at < 2 or depth > 8:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or end - at < k or data[at] == 0:
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
            if n < 0x80:
                return None
        if n > end - at:
            return None
        if tag & 0x20 and _der(data, at, at + n, depth + 1) is None:
            return None
        members.append((tag, at, at + n))
        at += n
    return members


# Object identifiers of PKCS#5 (1.2.840.113549.1.5) and of PKCS#12's encryption by password (1.2.840.113549.1.12.1).
_BY_PASSWORD = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def is_der_key(data: bytes) -> bool:
    """A private or public key in DER: PKCS#1, PKCS#8 (also encrypted), SEC1 or SubjectPublicKeyInfo."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    top = _der(data, 0, len(data))
    if not top or len(top) != 1:
        return False
    inner = _der(data, top[0][1], top[0][2])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _, _ in inner]
    if tags[0] == 0x02:
        version = data[inner[0][1] : inner[0][2]]
        if version in (b"\0", b"\1") and tags[1] in (0x30, 0x04):  # PKCS#8 and SEC1
            return True
        return len(tags) in (2, 9) and set(tags) == {0x02}  # PKCS#1
    if tags in ([0x30, 0x03], [0x30, 0x04]):
        algorithm = _der(data, inner[0][1], inner[0][2])
        if not algorithm or algorithm[0][0] != 0x06:
            return False
        # SubjectPublicKeyInfo: an algorithm's identifier, then a bit string. Encrypted PKCS#8: that of an encryption by password, then octets.
        return tags[1] == 0x03 or data[algorithm[0][1] : algorithm[0][2]].startswith(_BY_PASSWORD)
    return False


def _fields(data: bytes, at: int = 0) -> list[bytes] | None:
    """Length-prefixed fields that fill the rest exactly, or None."""
    out = []
    while at < len(data):
        if len(data) - at < 4:
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if n > len(data) - at:
            return None
        out.append(data[at : at + n])
        at += n
    return out


def is_ssh_key(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if data.startswith(magic):
        at, names = len(magic), []
        for _ in range(3):  # cipher, key derivation, its options
            if len(data) - at < 4:
                return False
            n = int.from_bytes(data[at : at + 4], "big")
            at += 4
            if n > len(data) - at:
                return False
            names.append(data[at : at + n])
            at += n
        return bool(names[0]) and len(data) - at >= 4 and _fields(data, at + 4) is not None
    fields = _fields(data)
    return bool(fields) and len(fields) >= 2 and re.match(rb"(ssh-|ecdsa-sha2-|sk-)[a-z0-9@.-]+\Z", fields[0]) is not None


def is_signed_token(header: str, payload: str) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(header + "=" * (-len(header) % 4)))
        base64.urlsafe_b64decode(payload + "=" * (-len(payload) % 4))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def _decoded(run: str) -> bytes:
    body = BREAK.sub("", run).rstrip("=")
    if len(body) % 4 == 1:
        return b""
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return b""


def _key_kind(run: str) -> str:
    data = _decoded(run)
    return "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else ""


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if (":" in text or "=" in text) and _ASSIGN_HINT.search(text):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(*m.span(), "hex") for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[Span]:
    """Candidates whose decoded structure is that of a key or a signed token."""
    out: list[Span] = []
    for m in BASE64.finditer(text):
        breaks = [b.span() for b in BREAK.finditer(m[0])]
        whole = [(0, len(m[0])), *([(0, breaks[-1][0])] if breaks else [])]  # perhaps a word stands on the line after the key
        if found := next(((b, kind) for _, b in whole if (kind := _key_kind(m[0][:b]))), None):
            out.append((m.start(), m.start() + found[0], found[1]))
        elif breaks:  # perhaps a key on one line beside other long words
            for a, b in zip([0, *(e for _, e in breaks)], [*(s for s, _ in breaks), len(m[0])], strict=True):
                if b - a >= 32 and (kind := _key_kind(m[0][a:b])):
                    out.append((m.start() + a, m.start() + b, kind))
    for m in HEX_BYTES.finditer(text):
        data = bytes.fromhex(m[0][: len(m[0]) // 2 * 2])
        if kind := "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else "":
            out.append((*m.span(), kind))
    if "." in text:
        out += [(*m.span(), "jwt") for m in JWT.finditer(text) if is_signed_token(m[1], m[2])]
    return out


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], _RANK[span[2]], span[1]


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans and all spans, each in order of start, then kind."""
    base = sorted(base_spans(text), key=_order)
    return base, sorted({*base, *confirmed_spans(text)}, key=_order)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by one marker."""
    out, at, cover = [], 0, 0
    for start, end, kind in spans:
        if start >= cover:
            out += [text[at:start] if start > at else "", f"[{kind.upper()}]"]
        cover = at = max(cover, end)
    return "".join([*out, text[at:]])


def secrets(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The id of every row with counts of the base kinds and all spans."""
    docs = docs.select(id_column, text)
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [scan(t) for t in strings(batch.column(1))]
        count = lambda kind: pa.array([sum(k == kind for _, _, k in base) for base, _ in both], pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), count("assign"), count("access"), count("hex"),
                pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in both], pa.string()),
                pa.array([listed(every) for _, every in both], pa.string()),
                pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in every] for _, every in both], kind_type),
            ],
            names=[id_column, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"],
        )

    schema = f"`{id_column}` {docs.dtypes[0][1]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:bigint,end:bigint>>"
    return map_batches(docs, find, schema, text)


def redacted_documents(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """All rows and columns, with the secrets in the texts replaced by markers."""

    def redact(batch: pa.RecordBatch) -> pa.RecordBatch:
        before = batch.column(text).to_pylist()
        after = list(before)
        for i, t in enumerate(before):
            if t and (spans := scan(t)[1]):
                after[i] = redacted(t, spans)
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        columns[text] = pa.array(after, batch.schema.field(text).type)
        if length in columns and pa.types.is_integer(columns[length].type):
            changed = [len(a) if a is not b else n for a, b, n in zip(after, before, columns[length].to_pylist(), strict=True)]
            columns[length] = pa.array(changed, columns[length].type)
        return pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return map_batches(docs, redact, docs.schema, text)


def op10_structural_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their secrets."""
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")
