"""Compressed bytes, as streams on the driver: what a codec's magic is, and how to read and write it."""

from __future__ import annotations

import bz2
import io
import lzma
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa

NONE = "none"
#: Magic bytes at the start of a file. Fixed values of the formats.
MAGIC = {
    "gzip": b"\x1f\x8b",
    "zstd": b"\x28\xb5\x2f\xfd",
    "xz": b"\xfd7zXZ\x00",
    "lz4": b"\x04\x22\x4d\x18",
    "snappy": b"\xff\x06\x00\x00sNaPpY",
}
_BZIP2_BLOCKS = (b"1AY&SY", b"\x17\x72\x45\x38\x50\x90")
#: Extensions of codecs, fixed values.
EXTENSIONS = {
    ".gz": "gzip", ".gzip": "gzip", ".zst": "zstd", ".zstd": "zstd", ".bz2": "bzip2", ".bzip2": "bzip2",
    ".xz": "xz", ".lz4": "lz4", ".sz": "snappy", ".snappy": "snappy", ".br": "brotli",
}
CODECS = (NONE, "gzip", "zstd", "bzip2", "xz", "lz4", "snappy", "brotli")


class BadCompression(ValueError):
    """Bytes that the codec cannot read."""


class DecompressedTooLarge(ValueError):
    """An input that expands beyond the given size."""


def sniff(head: bytes) -> str:
    for codec, magic in MAGIC.items():
        if head.startswith(magic):
            return codec
    if head[:3] == b"BZh" and head[3:4] in b"123456789" and head[3:4] and head[4:10] in _BZIP2_BLOCKS:
        return "bzip2"
    return NONE


def by_extension(name: str) -> str:
    return next((c for e, c in EXTENSIONS.items() if name.lower().endswith(e)), NONE)


def strip_extension(name: str) -> str:
    return next((name[: -len(e)] for e in sorted(EXTENSIONS, key=len, reverse=True) if name.lower().endswith(e)), name)


def detect(head: bytes, name: str) -> str:
    """By content; by name only for the codec that has no magic."""
    found = sniff(head)
    return "brotli" if found == NONE and by_extension(name) == "brotli" else found


class _Reader(io.RawIOBase):
    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.rest = chunks, b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        if not self.rest:
            self.rest = next(self.chunks, b"")
        n = min(len(buffer), len(self.rest))
        buffer[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def _members(chunks: Iterator[bytes], make) -> Iterator[bytes]:
    """Streams of one or more members, each with its own decompressor."""
    engine, fresh = make(), True
    for data in chunks:
        while data:
            if engine.eof:
                engine, fresh = make(), True
            fresh = False
            if out := engine.decompress(data):
                yield out
            data = engine.unused_data if engine.eof else b""
    if not engine.eof and not fresh:
        raise BadCompression("compressed data ends early")


_CRC32C = []
for _i in range(256):
    for _ in range(8):
        _i = _i >> 1 ^ (0x82F63B78 if _i & 1 else 0)
    _CRC32C.append(_i)


def _masked_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = _CRC32C[(crc ^ b) & 0xFF] ^ crc >> 8
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def _unframe_snappy(chunks: Iterator[bytes]) -> Iterator[bytes]:
    stream, codec = io.BufferedReader(_Reader(chunks)), pa.Codec("snappy")
    while head := stream.read(4):
        if len(head) < 4:
            raise BadCompression("a snappy chunk is cut off")
        kind, size = head[0], int.from_bytes(head[1:], "little")
        body = stream.read(size)
        if len(body) < size:
            raise BadCompression("a snappy chunk is cut off")
        if kind in (0, 1):
            data = body[4:]
            if kind == 0:
                length = shift = 0
                for b in data[:5]:
                    length |= (b & 127) << shift
                    shift += 7
                    if not b & 128:
                        break
                data = codec.decompress(data, decompressed_size=length, asbytes=True)
            if _masked_crc(data) != int.from_bytes(body[:4], "little"):
                raise BadCompression("a snappy chunk's checksum differs")
            yield data
        elif 2 <= kind <= 0x7F:
            raise BadCompression("an unknown snappy chunk")


def _frame_snappy(chunks: Iterable[bytes]) -> Iterator[bytes]:
    codec = pa.Codec("snappy")
    yield MAGIC["snappy"]
    for data in chunks:
        for i in range(0, len(data), 65536):
            part = data[i : i + 65536]
            body = _masked_crc(part).to_bytes(4, "little") + codec.compress(part, asbytes=True)
            yield b"\x00" + len(body).to_bytes(3, "little") + body


def decompress(chunks: Iterator[bytes], codec: str, most: int | None = None) -> Iterator[bytes]:
    total = 0
    try:
        for data in _decompress(chunks, codec):
            total += len(data)
            if most and total > most:
                raise DecompressedTooLarge(f"the input expands beyond {most} bytes")
            yield data
    except (zlib.error, OSError, EOFError, lzma.LZMAError, pa.ArrowException) as e:
        raise BadCompression(f"{codec}: {e}") from None


def _decompress(chunks: Iterator[bytes], codec: str) -> Iterator[bytes]:
    if codec == NONE:
        yield from chunks
    elif codec == "gzip":
        yield from _members(chunks, lambda: zlib.decompressobj(31))
    elif codec == "bzip2":
        yield from _members(chunks, bz2.BZ2Decompressor)
    elif codec == "xz":
        yield from _members(chunks, lzma.LZMADecompressor)
    elif codec == "snappy":
        yield from _unframe_snappy(chunks)
    elif codec in ("zstd", "lz4", "brotli"):
        with pa.CompressedInputStream(pa.PythonFile(io.BufferedReader(_Reader(chunks)), mode="r"), codec) as stream:
            while data := stream.read(1 << 20):
                yield data
    else:
        raise BadCompression(f'unknown compression "{codec}"')


def compress(chunks: Iterable[bytes], codec: str) -> Iterator[bytes]:
    if codec == NONE:
        yield from chunks
    elif codec == "bzip2":
        raise BadCompression("bzip2 output is not supported (bzip2 input is)")
    elif codec == "snappy":
        yield from _frame_snappy(chunks)
    elif codec in ("gzip", "xz"):
        engine = zlib.compressobj(wbits=31) if codec == "gzip" else lzma.LZMACompressor()
        for data in chunks:
            if out := engine.compress(data):
                yield out
        yield engine.flush()
    else:
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, codec) as stream:
            for data in chunks:
                stream.write(data)
        yield sink.getvalue().to_pybytes()
