"""AVI motion-JPEG columns: write, index, decode, and find shots.

A payload is stored as grey frames of 16 x 12 blocks, one sample per 8 x 8 block: a block of one grey value has
only a DC coefficient, and with its quantiser at 8 that coefficient is the sample itself (less 128), so
baseline JPEG keeps it exactly. The frames' Huffman table gives DC size category ``c`` a code of
``9 - c`` bits, so that every block takes ten bits, end-of-block included, and a whole file decodes with
array operations. Files with other tables go through a general baseline decoder.

Reading goes by the file's index: ``idx1``, or the standard index chunks of the extended format, or
the chunks themselves where a file has neither. A shot ends where the histogram difference of neighbouring
frames exceeds what the differences around it make usual.

Defined results: a null or empty text is stored as one frame of spaces; equal texts give equal values;
texts of up to 580 MB are stored whole, in blocks of frames, a longer one is an error that says so (its file would pass the 2 GB of a value in
Spark); an empty table gives an empty result; only id and text (or media) are read, so further columns of any name make no difference.
A file that is damaged in any way has one row that says why.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, strings

UNIT = 192
COLUMNS, ROWS = 16, 12
FPS = 24
#: Bytes of a frame's entropy-coded data before byte stuffing.
CODED = UNIT * 10 // 8
#: Frames that one array operation works on.
BLOCK = 2048
#: Bytes of a payload at most: with all its bytes stuffed, a frame of 192 takes no more than 700, and a file no more than 2 GB.
MOST_PAYLOAD = 580_000_000 // UNIT * UNIT
BINS = 32


# --- JPEG tables of the frames that this module writes -------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


HEADER = b"".join(
    (
        b"\xff\xd8",
        _segment(0xDB, bytes([0, 8]) + bytes([1]) * 63),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, ROWS * 8, COLUMNS * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, bytes([0x00]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))),
        _segment(0xC4, bytes([0x10]) + bytes([1] + [0] * 15) + bytes([0])),
        _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    )
)


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Difference + 255 -> ten bits, and ten bits -> difference (or 999)."""
    encode, decode = np.zeros(511, dtype=np.uint64), np.full(1024, 999, dtype=np.int16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << c) - 1
        bits = ((((1 << (8 - c)) - 1) << 1) << c | extra) << 1
        encode[d + 255] = bits
        decode[bits] = d
    return encode, decode


_ENCODE, _DECODE = _codes()


# --- writing -------------------------------------------------------------------------------------------


def padded(text: str) -> tuple[bytes, int]:
    """The payload of a text and the number of its bytes before padding."""
    raw = text.encode()
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" "), len(raw)


def _frames(samples: np.ndarray, base: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Chunks of a block of frames (F x 192 samples), with offsets (from ``base``) and sizes of their data."""
    n = len(samples)
    level = samples.astype(np.int16) - 128
    difference = np.diff(level, axis=1, prepend=np.int16(0))
    bits = _ENCODE[difference + 255].reshape(n, UNIT // 4, 4)
    word = bits[..., 0] << np.uint64(30) | bits[..., 1] << np.uint64(20) | bits[..., 2] << np.uint64(10) | bits[..., 3]
    coded = word.astype(">u8").view(np.uint8).reshape(n, UNIT // 4, 8)[..., 3:].reshape(n, CODED)
    full = coded == 0xFF
    stuffed = np.cumsum(full, axis=1, dtype=np.int64)
    sizes = len(HEADER) + CODED + stuffed[:, -1] + 2
    chunk = 8 + sizes + (sizes & 1)
    start = np.cumsum(chunk) - chunk
    out = np.zeros(int(chunk.sum()), dtype=np.uint8)
    data = start + 8
    out[start[:, None] + np.arange(4)] = np.frombuffer(b"00dc", dtype=np.uint8)
    out[start[:, None] + np.arange(4, 8)] = sizes.astype("<u4").view(np.uint8).reshape(n, 4)
    out[data[:, None] + np.arange(len(HEADER))] = np.frombuffer(HEADER, dtype=np.uint8)
    out[(data + len(HEADER))[:, None] + np.arange(CODED) + (stuffed - full)] = coded
    out[data + sizes - 2] = 0xFF
    out[data + sizes - 1] = 0xD9
    return out.tobytes(), start + base, sizes


def _list(kind: bytes, body: bytes) -> bytes:
    return b"LIST" + struct.pack("<I", len(body) + 4) + kind + body


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


class MediaTooLarge(ValueError):
    """More samples than one AVI file of 32-bit sizes, or one row of Spark's, can hold."""


def write_avi(payload: bytes, fps: int = FPS) -> bytes:
    """A payload (a multiple of 192 bytes) as an AVI file."""
    if len(payload) > MOST_PAYLOAD:
        raise MediaTooLarge(f"a payload of {len(payload)} bytes; an AVI file of 32-bit sizes takes {MOST_PAYLOAD}")
    samples = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
    n, width, height = len(samples), COLUMNS * 8, ROWS * 8
    chunks, offsets, sizes, at = [], [], [], 4
    for i in range(0, n, BLOCK):
        body, where, size = _frames(samples[i : i + BLOCK], at)
        chunks.append(body)
        offsets.append(where)
        sizes.append(size)
        at += len(body)
    sizes = np.concatenate(sizes)
    index = np.empty((n, 4), dtype="<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1] = 0x10  # every frame is a key frame
    index[:, 2] = np.concatenate(offsets)
    index[:, 3] = sizes
    most = int(sizes.max())
    main = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, n, 0, 1, most, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, n, most, 0xFFFFFFFF, 0, 0, 0, width, height)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", bitmap)))
    body = b"".join((head, _list(b"movi", b"".join(chunks)), _chunk(b"idx1", index.tobytes())))
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"AVI " + body


# --- reading -------------------------------------------------------------------------------------------


class BadMedia(ValueError):
    """The bytes are no motion-JPEG AVI that this module can read."""


@dataclass
class Index:
    fps: float
    offsets: np.ndarray
    sizes: np.ndarray


def _walk(data: bytes, at: int, end: int):
    while at + 8 <= end:
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > end:
            raise BadMedia(f"chunk {kind!r} at {at} is cut off")
        yield kind, at + 8, size
        at += 8 + size + (size & 1)


def read_index(data: bytes) -> Index:
    """Where the frames of the first video stream lie."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise BadMedia("no RIFF AVI header")
    fps, movi, old, super_index, stream, video = 0.0, None, None, [], -1, None
    for kind, at, size in _walk(data, 12, min(len(data), 8 + int.from_bytes(data[4:8], "little"))):
        if kind == b"LIST" and data[at : at + 4] == b"hdrl":
            for k, a, n in _walk(data, at + 4, at + size):
                if k == b"LIST" and data[a : a + 4] == b"strl":
                    stream += 1
                    for kk, aa, nn in _walk(data, a + 4, a + n):
                        if kk == b"strh" and data[aa : aa + 4] == b"vids" and video is None:
                            video = stream
                            scale, rate = struct.unpack_from("<II", data, aa + 20)
                            fps = rate / scale if scale else 0.0
                        elif kk == b"indx" and video == stream:
                            longs, _, kind_of, used = struct.unpack_from("<HBBI", data, aa)
                            if kind_of == 0:  # an index of indexes
                                super_index = [struct.unpack_from("<QII", data, aa + 24 + 16 * i) for i in range(used)]
        elif kind == b"LIST" and data[at : at + 4] == b"movi":
            movi = (at, at + size)
        elif kind == b"idx1":
            old = (at, size)
    if movi is None or video is None:
        raise BadMedia("no video stream or no frames")
    ids = [f"{video:02d}{k}".encode() for k in ("dc", "db")]
    offsets, sizes = [], []
    for where, _, _ in super_index:  # the extended format's index spans all its RIFF parts, idx1 only the first
        at = where + 8
        _, _, _, used = struct.unpack_from("<HBBI", data, at)
        base = struct.unpack_from("<Q", data, at + 12)[0]
        for i in range(used):
            offset, size = struct.unpack_from("<II", data, at + 24 + 8 * i)
            offsets.append(base + offset)
            sizes.append(size & 0x7FFFFFFF)
    if not offsets and old is not None and old[1] >= 16:
        table = np.frombuffer(data, dtype="<u4", count=old[1] // 16 * 4, offset=old[0]).reshape(-1, 4)
        table = table[np.isin(table[:, 0], [int.from_bytes(i, "little") for i in ids])].astype(np.int64)
        # Offsets count from the list's kind or from the file's start, by writer.
        if len(table):
            first = int(table[0, 2])
            base = movi[0] if data[movi[0] + first : movi[0] + first + 4] in ids else 0
            return Index(fps, table[:, 2] + base + 8, table[:, 3])
    if not offsets:
        for begin, end in [movi, *_later_parts(data)]:
            for at, size in _frames_in(data, begin + 4, end, ids):
                offsets.append(at)
                sizes.append(size)
    if max(offsets, default=0) > len(data):
        raise BadMedia("the index points beyond the file")
    return Index(fps, np.array(offsets, dtype=np.int64), np.array(sizes, dtype=np.int64))


def _frames_in(data: bytes, at: int, end: int, ids: list[bytes]):
    """(where, size) of a list's frames and of those in its groups."""
    for kind, a, size in _walk(data, at, end):
        if kind in ids:
            yield a, size
        elif kind == b"LIST" and data[a : a + 4] == b"rec ":
            yield from ((aa, n) for k, aa, n in _walk(data, a + 4, a + size) if k in ids)


def _later_parts(data: bytes):
    """Lists of frames in the RIFF parts that follow the first."""
    at = 8 + int.from_bytes(data[4:8], "little")
    while data[at : at + 4] == b"RIFF":
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        for kind, a, n in _walk(data, at + 12, min(len(data), at + 8 + size)):
            if kind == b"LIST" and data[a : a + 4] == b"movi":
                yield a, a + n
        at += 8 + size + (size & 1)


def read_samples(data: bytes, index: Index) -> np.ndarray:
    """The samples of frames that this module wrote, F x 192."""
    out = np.empty((len(index.offsets), UNIT), dtype=np.uint8)
    head = len(HEADER)
    for i in range(0, len(out), BLOCK):
        parts = []
        for at, size in zip(index.offsets[i : i + BLOCK].tolist(), index.sizes[i : i + BLOCK].tolist(), strict=True):
            if not data.startswith(HEADER, at) or data[at + size - 2 : at + size] != b"\xff\xd9":
                raise BadMedia("a frame with other tables")
            parts.append(data[at + head : at + size - 2])
        raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
        keep = np.ones(len(raw), dtype=bool)
        keep[1:] = (raw[1:] != 0) | (raw[:-1] != 0xFF)
        coded = raw[keep]
        if len(coded) != len(parts) * CODED:
            raise BadMedia("a frame of another length")
        word = np.zeros((len(parts), UNIT // 4, 8), dtype=np.uint8)
        word[..., 3:] = coded.reshape(len(parts), UNIT // 4, 5)
        word = word.view(">u8")[..., 0].astype(np.uint64)
        bits = np.stack([word >> np.uint64(k) & np.uint64(1023) for k in (30, 20, 10, 0)], axis=-1).reshape(len(parts), UNIT)
        difference = _DECODE[bits]
        if (difference == 999).any():
            raise BadMedia("a code that the tables do not have")
        out[i : i + len(parts)] = np.cumsum(difference, axis=1, dtype=np.int16) + 128
    return out


_ZIGZAG = sorted(range(64), key=lambda i: ((s := i // 8 + i % 8), i // 8 if s % 2 else i % 8))


def _huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol, from how many codes each length from 1 on has."""
    table, code, used = {}, 0, 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            table[length, code] = symbols[used]
            used, code = used + 1, code + 1
        code <<= 1
    return table


def _standard_tables() -> dict[int, dict[tuple[int, int], int]]:
    """The tables that motion-JPEG frames mean which carry none: class and number in the high and low half of the key."""
    # Code lengths and the first symbols of the JPEG standard's typical tables; the other symbols follow in ascending order.
    difference = bytes(range(12))
    luma = bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a")
    chroma = bytes.fromhex("0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f1".replace(" ", ""))
    every = bytes(s for s in range(256) if 1 <= s & 15 <= 10)
    rest = lambda first: first + bytes(s for s in every if s not in first)
    return {
        0x00: _huffman(bytes.fromhex("00010501010101010100000000000000"), difference), 0x10: _huffman(bytes.fromhex("0002010303020403050504040000017d"), rest(luma)),
        0x01: _huffman(bytes.fromhex("00030101010101010101010000000000"), difference), 0x11: _huffman(bytes.fromhex("00020102040403040705040400010277"), rest(chroma)),
    }


_STANDARD = _standard_tables()
_COSINE = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def bit(self) -> int:
        if not self.n:
            if self.at >= len(self.data):
                raise BadMedia("entropy-coded data ends early")
            byte = self.data[self.at]
            self.at += 1
            if byte == 0xFF:
                self.at += 1  # the stuffed zero
            self.held, self.n = byte, 8
        self.n -= 1
        return self.held >> self.n & 1

    def take(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | self.bit()
        return value

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bit()
            if (found := table.get((length, code))) is not None:
                return found
        raise BadMedia("a code that the tables do not have")

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


def decode_frame(jpeg: bytes) -> np.ndarray:
    """Luma of any baseline JPEG, height x width; where it carries no Huffman tables, the standard's typical ones hold."""
    if jpeg[:2] != b"\xff\xd8":
        raise BadMedia("no JPEG")
    quantisers: dict[int, np.ndarray] = {}
    tables = dict(_STANDARD)
    parts, interval, height, width, at = [], 0, 0, 0, 2
    while True:
        marker, size = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else np.uint8).astype(np.float64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                tables[body[0]] = _huffman(body[1:17], body[17:])
                body = body[17 + sum(body[1:17]) :]
        elif marker in (0xC0, 0xC1):
            height, width = struct.unpack_from(">HH", body, 1)
            parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(body[5])]
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xDA:
            for i in range(body[0]):
                part = next((p for p in parts if p["id"] == body[1 + 2 * i]), None)
                if part is None:
                    raise BadMedia("a scan of a component that the frame does not have")
                part["dc"], part["ac"] = body[2 + 2 * i] >> 4, 16 | body[2 + 2 * i] & 15
            break
        elif 0xC2 <= marker <= 0xCF:
            raise BadMedia("not baseline")
    if not parts or not all(p.get("dc") in tables and p.get("ac") in tables and len(quantisers.get(p["q"], ())) == 64 and p["h"] and p["v"] for p in parts):
        raise BadMedia("a frame without its tables")
    most_h, most_v = max(p["h"] for p in parts), max(p["v"] for p in parts)
    if len(parts) == 1:
        most_h = most_v = parts[0]["h"] = parts[0]["v"] = 1
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    if across * down > 4 * len(jpeg):  # a block takes two bits at least
        raise BadMedia("more blocks than data")
    luma = parts[0]
    plane = np.zeros((down * luma["v"] * 8, across * luma["h"] * 8))
    bits, before = _Bits(jpeg[at:]), [0] * len(parts)
    for unit in range(across * down):
        if interval and unit and unit % interval == 0:
            bits.at, bits.n, before = bits.at + 2, 0, [0] * len(parts)
        for k, part in enumerate(parts):
            for block in range(part["h"] * part["v"]):
                values = np.zeros(64)
                before[k] += bits.signed(bits.symbol(tables[part["dc"]]))
                values[0] = before[k]
                i = 1
                while i < 64:
                    symbol = bits.symbol(tables[part["ac"]])
                    if symbol == 0:
                        break
                    i += symbol >> 4
                    if symbol & 15:
                        if i > 63:
                            raise BadMedia("a run beyond the block")
                        values[i] = bits.signed(symbol & 15)
                    i += 1
                if k == 0:
                    grid = np.zeros(64)
                    grid[_ZIGZAG] = values * quantisers[part["q"]]
                    y = (unit // across * part["v"] + block // part["h"]) * 8
                    x = (unit % across * part["h"] + block % part["h"]) * 8
                    plane[y : y + 8, x : x + 8] = _COSINE @ grid.reshape(8, 8) @ _COSINE.T
    plane = plane[: -(-height * luma["v"] // most_v), : -(-width * luma["h"] // most_h)]
    return np.clip(np.rint(plane + 128), 0, 255).astype(np.uint8)


def frames(data: bytes) -> tuple[float, np.ndarray]:
    """Frame rate and, for each frame, its grey values in a row (one per block for files of this module)."""
    index = read_index(data)
    try:
        return index.fps, read_samples(data, index)
    except BadMedia:
        planes = [decode_frame(data[a : a + n]).ravel() for a, n in zip(index.offsets.tolist(), index.sizes.tolist(), strict=True)]
        if len({len(p) for p in planes}) > 1:
            raise BadMedia("frames of unlike size") from None
        return index.fps, np.stack(planes) if planes else np.zeros((0, 1), dtype=np.uint8)


# --- shots ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Cuts:
    """A cut lies where the difference exceeds mean + ``spread`` deviations of those around it, and ``least``."""

    around: int = 12
    spread: float = 2.5
    least: float = 0.25


def differences(values: np.ndarray) -> np.ndarray:
    """Half the L1 distance of neighbouring frames' grey histograms, 0 to 1."""
    n, size = values.shape
    histogram = np.empty((n, BINS), dtype=np.int64)
    for i in range(0, n, BLOCK):
        block = values[i : i + BLOCK]
        key = (block >> 3).astype(np.int64) + np.arange(len(block))[:, None] * BINS
        histogram[i : i + len(block)] = np.bincount(key.ravel(), minlength=len(block) * BINS).reshape(-1, BINS)
    return np.abs(np.diff(histogram, axis=0)).sum(axis=1) / (2.0 * size)


def cut_frames(difference: np.ndarray, cuts: Cuts = Cuts()) -> np.ndarray:
    """Frames at which a new shot begins. The values around a frame leave the frame itself out."""
    n = len(difference)
    if not n:
        return np.zeros(0, dtype=np.int64)
    total, square = (np.concatenate(([0.0], np.cumsum(d))) for d in (difference, difference**2))
    low, high = np.maximum(np.arange(n) - cuts.around, 0), np.minimum(np.arange(n) + cuts.around + 1, n)
    count = np.maximum(high - low - 1, 1)
    mean = (total[high] - total[low] - difference) / count
    deviation = np.sqrt(np.maximum((square[high] - square[low] - difference**2) / count - mean**2, 0))
    return np.flatnonzero((difference > mean + cuts.spread * deviation) & (difference >= cuts.least)) + 1


def clips_of(data: bytes, cuts: Cuts = Cuts()) -> list[tuple[int, int, int, float, float]]:
    """(clip, first frame, frame after the last, start second, end second)"""
    fps, values = frames(data)
    return timed(len(values), fps, cut_frames(differences(values), cuts))


def timed(n: int, fps: float, begins: np.ndarray) -> list[tuple[int, int, int, float, float]]:
    edges = [0, *begins.tolist(), n]
    rate = fps or 1.0
    return [(i, a, b, a / rate, b / rate) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]


# --- columns -------------------------------------------------------------------------------------------


def stored(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The id of every row and its text as an AVI file."""
    docs = docs.select(id_column, text)

    def store(batch: pa.RecordBatch) -> pa.RecordBatch:
        media = [write_avi(padded(t)[0]) for t in strings(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=[id_column, "media"])

    return map_batches(docs, store, f"`{id_column}` {docs.dtypes[0][1]}, media binary", text)


def clips(media: DataFrame, id_column: str = "doc_id", column: str = "media", cuts: Cuts = Cuts()) -> DataFrame:
    """Timed clip rows of AVI files; a null or unreadable file has none, and says why in ``error``."""
    media = media.select(id_column, column)

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, data in enumerate(batch.column(1).to_pylist()):
            try:
                if data is None:
                    raise BadMedia("null")
                if not (found := clips_of(data, cuts)):
                    raise BadMedia("no frames")
                rows += [(i, *clip, None) for clip in found]
            except BadMedia as e:
                rows.append((i, *[None] * 5, str(e)))
            except Exception as e:  # whatever is wrong with a file is its own row's matter
                rows.append((i, *[None] * 5, f"{type(e).__name__}: {e}"))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        types = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string())
        ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
        names = [id_column, "clip", "start_frame", "end_frame", "start_s", "end_s", "error"]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns[1:], types, strict=True))], names=names)

    schema = f"`{id_column}` {media.dtypes[0][1]}, clip int, start_frame long, end_frame long, start_s double, end_s double, error string"
    return map_batches(media, find, schema, column)


def described(docs: DataFrame, id_column: str = "doc_id", text: str = "text", cuts: Cuts = Cuts()) -> DataFrame:
    """Each whole text stored as AVI and read back: digests of both forms and the clips found."""
    docs = docs.select(id_column, text)

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in strings(batch.column(1)):
            payload, n_bytes = padded(t)
            media = write_avi(payload)
            del payload
            fps, values = frames(media)
            found = timed(len(values), fps, cut_frames(differences(values), cuts))
            back = values.tobytes()
            feature = f"frames={len(values)};fps={fps:g};clips=" + ",".join(f"{a}-{b}@{s:.3f}-{e:.3f}" for _, a, b, s, e in found)
            rows.append((n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(found)))
        columns = list(zip(*rows, strict=True)) or [()] * 8
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = [id_column, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_clips"]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, types, strict=True))], names=names)

    schema = f"`{id_column}` {docs.dtypes[0][1]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_clips long"
    return map_batches(docs, describe, schema, text)


def op1_mjpeg_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as motion-JPEG files, read back."""
    return described(spark.read.parquet(f"{sf_dir}/documents.parquet"))
