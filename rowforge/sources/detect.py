"""Formats by content: the name only breaks ties."""

from __future__ import annotations

import logging

from pyspark.sql import SparkSession

from . import codecs
from .files import Store

log = logging.getLogger("rowforge")

#: Names of formats and their extensions, fixed values.
FORMATS = ("json", "parquet", "csv", "tsv", "arrow")
EXTENSIONS = {".parquet": "parquet", ".csv": "csv", ".tsv": "tsv", ".arrow": "arrow", ".json": "json", ".ndjson": "json", ".jsonl": "json"}
HEAD = 4096
SAMPLE_LINES = 16


class UnknownFormat(ValueError):
    """Contents that no reader takes."""


def by_extension(name: str) -> str | None:
    name = codecs.strip_extension(name).lower()
    return next((f for e, f in EXTENSIONS.items() if name.endswith(e)), None)


def input_format_by_name(name: str) -> str:
    return by_extension(name) or "json"


def sniff(head: bytes, hint: str | None = None, whole: bool = False) -> str:
    """The format of contents that begin with ``head``; ``whole``: there is no more."""
    if head.startswith(b"PAR1"):
        return "parquet"
    if head.startswith(b"PARE"):
        raise UnknownFormat("encrypted Parquet cannot be read")
    if head.startswith(b"ARROW1"):
        return "arrow"
    if b"\0" in head:
        raise UnknownFormat("the contents are no known format")
    text = head.removeprefix(b"\xef\xbb\xbf").lstrip(b" \t\r\n")
    if not text:
        return hint or "json"
    if text.startswith(b"{"):
        return "json"
    lines = [x.rstrip(b"\r") for x in head.removeprefix(b"\xef\xbb\xbf").split(b"\n")]
    if not whole and len(head) >= HEAD and len(lines) > 1:
        lines.pop()
    lines = [x for x in lines if x.strip()][:SAMPLE_LINES]
    votes = {f: _vote(lines, d) for f, d in (("csv", b","), ("tsv", b"\t"))}
    best = max(votes.values())
    if best > 0:
        if votes["csv"] == votes["tsv"]:
            return hint if hint in ("csv", "tsv") else "csv"
        return max(votes, key=votes.get)
    if hint:
        return hint
    raise UnknownFormat("the contents are no known format")


def _vote(lines: list[bytes], delimiter: bytes) -> int:
    """Lines with as many delimiters outside quotes as the first, if it has any and most lines agree."""
    counts = [b"".join(line.split(b'"')[::2]).count(delimiter) for line in lines]
    agree = sum(n == counts[0] for n in counts) if counts and counts[0] else 0
    return agree if 2 * agree > len(counts) else 0


def detect(spark: SparkSession, path: str, codec: str | None = None) -> tuple[str, str]:
    """(format, codec) of a file."""
    store = Store(spark)
    head = store.head(path, HEAD)
    codec = codec or codecs.detect(head, path)
    plain = head
    if codec != codecs.NONE:
        plain = b""
        for data in codecs.decompress(store.chunks(path, 1 << 16), codec):
            plain += data
            if len(plain) >= HEAD:
                break
        plain = plain[:HEAD]
    hint = by_extension(path)
    found = sniff(plain, hint, len(plain) < HEAD)
    if hint and hint != found:
        log.info("%s is named like %s but holds %s", path, hint, found)
    return found, codec
