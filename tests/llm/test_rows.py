"""Operators that look at one row at a time, against plain versions."""

import base64
import collections
import hashlib
import json
import random
import re
import struct
import zlib

import numpy as np
import pytest

from rowforge.llm import bpe, media, quality_rules, secrets

from .conftest import ODD

W = re.compile(r"[^\x20\x09-\x0D]+")


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def expect(rows, f):
    return sorted((f(i, t or "") for i, t, _ in rows), key=repr)


# --- 1: media --------------------------------------------------------------------------------------------


def test_media_keeps_the_payload(odd, nothing):
    def plain(i, t):
        raw = t.encode()
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        return i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])

    got = media.described(odd)
    assert by_row(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == expect(ODD, plain)
    assert media.described(nothing).count() == 0
    same = {tuple(r)[1:] for r in got.where("doc_id in (5, 6)").collect()}
    assert len(same) == 1


def test_frames_decode_like_any_jpeg():
    rng = random.Random(1)
    payload = bytes(rng.randrange(256) for _ in range(192 * 3))
    data = media.write_avi(payload)
    index = media.read_index(data)
    for k, (a, n) in enumerate(zip(index.offsets, index.sizes, strict=True)):
        plane = media.decode_frame(data[a : a + n])
        assert plane.shape == (96, 128) and plane[::8, ::8].tobytes() == payload[k * 192 : (k + 1) * 192]
        assert (plane == np.kron(plane[::8, ::8], np.ones((8, 8), np.uint8))).all()
    assert media.frames(data[: data.rindex(b"idx1")] + b"JUNK\0\0\0\0")[1].tobytes() == payload  # without an index
    with pytest.raises(media.BadMedia):
        media.frames(b"RIFF....WAVE")


def test_shots(spark):
    dark, light = bytes([20]) * 192, bytes([200]) * 192
    data = media.write_avi(dark * 30 + light * 40 + dark * 10)
    assert [(a, b) for _, a, b, _, _ in media.clips_of(data)] == [(0, 30), (30, 70), (70, 80)]
    assert len(media.clips_of(media.write_avi(dark * 50))) == 1
    df = spark.createDataFrame([(1, data), (2, None), (3, b"junk")], "doc_id long, media binary")
    rows = media.clips(df).orderBy("doc_id", "clip").collect()
    assert [(r["doc_id"], r["start_frame"], r["end_s"]) for r in rows[:3]] == [(1, 0, 1.25), (1, 30, 70 / 24), (1, 70, 80 / 24)]
    assert [bool(r["error"]) for r in rows] == [False, False, False, True, True]


def test_damaged_files_have_a_row_that_says_why(spark):
    rng = random.Random(11)
    whole = [media.write_avi(media.padded(t)[0]) for t in ("a short text", "a longer text " * 60, "tail" * 200)]
    files = [None, b"", b"RIFF", whole[0][:200]]
    for _ in range(3000):
        data = bytearray(rng.choice(whole))
        for _ in range(rng.randint(1, 12)):
            k = rng.random()
            at = rng.randrange(len(data)) if k < 0.5 else rng.randrange(min(len(data), 900))
            if k < 0.8:
                data[at] = rng.randrange(256)
            elif k < 0.9:
                del data[at : at + rng.randint(1, 40)]
            else:
                data[at:at] = rng.randbytes(rng.randint(1, 8))
        files.append(bytes(data))
    docs = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "doc_id long, media binary")
    rows = media.clips(docs).collect()
    assert {r["doc_id"] for r in rows} == set(range(len(files)))
    assert all((r["error"] is None) == (r["clip"] is not None) for r in rows) and sum(r["error"] is not None for r in rows) > 500


def test_frames_without_tables_and_extended_files():
    text = "frames of a file that has no tables of its own " * 20
    payload = media.padded(text)[0]
    data = media.write_avi(payload)
    index = media.read_index(data)
    # The standard's typical tables: every code length is used up, no symbol comes twice.
    for key, n in ((0x00, 12), (0x01, 12), (0x10, 162), (0x11, 162)):
        table = media._STANDARD[key]
        assert len(table) == n == len(set(table.values())) and sum(2.0 ** -length for length, _ in table) < 1.0
    # A grey block of the standard's: difference category 0 is 00, end of block 1010.
    bits = "001010" * 12 * 16
    body = int(bits, 2).to_bytes(len(bits) // 8, "big")
    head = media.HEADER
    while (at := head.find(b"\xff\xc4")) >= 0:
        head = head[:at] + head[at + 2 + int.from_bytes(head[at + 2 : at + 4], "big") :]
    bare = head + body.replace(b"\xff", b"\xff\0") + b"\xff\xd9"
    assert (media.decode_frame(bare) == 128).all()
    # Later RIFF parts and grouped frames count where there is no index.
    frame = data[index.offsets[0] : index.offsets[0] + index.sizes[0]]
    chunk = b"00dc" + struct.pack("<I", len(frame)) + frame + b"\0" * (len(frame) & 1)
    cut_at = data.index(b"idx1")
    first = data[:4] + struct.pack("<I", cut_at - 8) + data[8:cut_at]
    group = b"LIST" + struct.pack("<I", 4 + len(chunk)) + b"rec " + chunk
    movi = b"LIST" + struct.pack("<I", 4 + len(group) + len(chunk)) + b"movi" + group + chunk
    more = b"RIFF" + struct.pack("<I", 4 + len(movi)) + b"AVIX" + movi
    assert len(media.read_index(first + more).offsets) == len(index.offsets) + 2


def test_payloads_beyond_a_file_are_refused(monkeypatch):
    monkeypatch.setattr(media, "MOST_PAYLOAD", 192)
    with pytest.raises(media.MediaTooLarge, match="384 bytes"):
        media.write_avi(b" " * 384)


def test_stored_files_are_read_back(odd):
    both = media.stored(odd.where("doc_id = 1"))
    assert media.frames(both.first()["media"])[1].tobytes().rstrip(b" ").decode() == ODD[0][1]


# --- 4: quality rules ------------------------------------------------------------------------------------


def base_counts(i, t):
    w = W.findall(t)
    at = collections.defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    covered = {x for v in at.values() if len(v) > 1 for k in v for x in range(k, k + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed


def test_quality_counts(odd, nothing, make):
    rng = random.Random(2)
    rows = ODD + [(100 + k, "".join(rng.choice(["a ", "b ", "cc ", "\n", "\r", "\x1c", " ", "é ", "* "]) for _ in range(rng.randint(0, 200))), "z") for k in range(60)]
    got = quality_rules.quality(make(rows))
    assert by_row(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == expect(rows, base_counts)
    assert not got.where("base_failed and kept").count()
    assert quality_rules.quality(nothing).count() == 0
    kept = quality_rules.kept_documents(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality_rules.quality(odd).where("kept").collect()} == {1, 7}


def test_compression_bands():
    rng = random.Random(3)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) + ("." if k % 12 == 0 else "") for k in range(1500))
    noise = " ".join(base64.b64encode(rng.randbytes(30)).decode() for _ in range(300))
    loop = " ".join(f"{k % 7} the quick brown fox number {k % 10} jumps" for k in range(400))
    verdict = quality_rules.Rules(quality_rules.Bands()).score([prose, noise, loop])
    assert verdict["kept"].tolist() == [True, False, False] and not verdict["base_failed"][1]
    mixed = prose + " ".join(base64.b64encode(rng.randbytes(30)).decode() for _ in range(150))
    assert not quality_rules.Rules(quality_rules.Bands()).score([mixed])["kept"][0]  # the whole passes, its chunks do not


# --- 6: BPE ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe_is_the_librarys(library, odd, nothing):
    def plain(i, t):
        ids = library.encode(t, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        return i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    assert by_row(bpe.digests(odd), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expect(ODD, plain)
    assert bpe.digests(nothing).count() == 0
    back = bpe.decode(bpe.encode(odd))
    assert by_row(back, "doc_id", "text") == expect(ODD, lambda i, t: (i, t))


def test_bpe_on_random_texts(library):
    a, rng = bpe.compiled(bpe.default_path()), random.Random(4)
    alphabet = ["a", "b", "e", "h", "t", " ", "é", "ß", "\n", "'s", "'", "1", "23", "!", "<|endoftext|>", "aaa", "==", "  ", "ñ", "中", "🙂", "\t", "’", "՘", "\U0001ccf0", "\x1c", "\x85"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert a.encode(text) == ",".join(map(str, ids)), text
        assert a.decode(a.encode(text)) == library.decode(ids, skip_special_tokens=False) == text
    for token, label in a.labels.items():
        assert a.encode_word(label) == [token]


def test_presplit_of_every_character(library):
    for cp in [*range(0x3000), *range(0x1C80, 0x1C90), *range(0xA7C0, 0xA7E0), *range(0x10D40, 0x10D90), *range(0x1CCF0, 0x1CCFA), *range(0x323A0, 0x323C0)]:
        text = f"a{chr(cp)}1{chr(cp)} {chr(cp)}b{chr(cp)}"
        assert bpe.presplit(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], hex(cp)


# --- 10: secrets -----------------------------------------------------------------------------------------


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x80 | (k := (len(body).bit_length() + 7) // 8)]) + len(body).to_bytes(k, "big")
    return bytes([tag]) + size + body


def lengthed(*parts):
    return b"".join(len(p).to_bytes(4, "big") + p for p in parts)


def plain_base(text):
    out = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(s for _, _, s in sorted(out))


def test_secrets(make, nothing):
    rng = random.Random(5)
    pieces = ["password", "Secret", "API_KEY", "apikey", "toKen", "ſecret", '"', "'", " ", " = ", ": ", "=", "AKIA", "ABCDEFGH1234567", "deadbeef" * 5, "0123456789abcdef" * 2, "x/y+z_9.", "é", "\n", "short"]
    rows = ODD + [(200 + k, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))), "s") for k in range(300)]
    found = secrets.secrets(make(rows))
    digest = lambda i, t: (i, hashlib.sha256(plain_base(t).encode()).hexdigest())
    assert by_row(found, "doc_id", "base_sha256") == expect(rows, digest)
    assert secrets.secrets(nothing).count() == 0


def test_structures():
    rng = random.Random(6)
    number = der(2, b"\1" + rng.randbytes(64))
    private = der(0x30, der(2, b"\0"), *[number] * 8)
    pkcs8 = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86\x48"), der(5)), der(4, private))
    public = der(0x30, der(0x30, der(6, b"\x2a\x86\x48"), der(5)), der(3, b"\0" + rng.randbytes(80)))
    ssh = lengthed(b"ssh-ed25519", rng.randbytes(32))
    box = b"openssh-key-v1\0" + lengthed(b"none", b"none", b"") + (1).to_bytes(4, "big") + lengthed(ssh, rng.randbytes(136))
    seg = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    token = f"{seg(json.dumps({'alg': 'HS256'}).encode())}.{seg(b'{}')}.{seg(rng.randbytes(32))}"
    sealed = der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")), der(0x30, der(4, rng.randbytes(8)), der(2, b"\x08\x00"))), der(4, rng.randbytes(160)))
    digest = der(0x30, der(0x30, der(6, bytes.fromhex("608648016503040201")), der(5)), der(4, rng.randbytes(32)))  # no key: a hash and its algorithm
    assert secrets.confirmed_spans(base64.b64encode(digest).decode()) == []
    for data, kind in ((private, "der"), (pkcs8, "der"), (public, "der"), (sealed, "der"), (ssh, "ssh"), (box, "ssh")):
        run = base64.b64encode(data).decode()
        assert [k for _, _, k in secrets.confirmed_spans(f"key {run} end")] == [kind]
        lines = "\n".join(run[i : i + 64] for i in range(0, len(run), 64))
        assert [(lines in "x " + lines, k) for _, _, k in secrets.confirmed_spans(f"-----BEGIN-----\n{lines}\n-----END-----")] == [(True, kind)]
        assert kind in [k for _, _, k in secrets.confirmed_spans(f"hex {data.hex()} end")]
        assert secrets.confirmed_spans(base64.b64encode(data[:-1] + b"").decode()[:-4] + " cut") == []
    (span,) = secrets.confirmed_spans(f"bearer {token}, then")
    assert span == (7, 7 + len(token), "jwt")
    for _ in range(200):
        assert secrets.confirmed_spans(base64.b64encode(rng.randbytes(rng.randint(24, 200))).decode()) == []
    assert secrets.confirmed_spans("eyJhbGciOiJub25lIn0x.abcdef.ghijklmnopqrstuvw") == []


def test_tokens_with_spaced_headers():
    seg = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    for header in (b'{"alg":"HS256"}', b'{ "alg": "HS256" }', b'{\n  "typ": "JWT",\n  "alg": "RS256"\n}', b' {"alg":"none"}', b'\t{"alg":"ES256"}'):
        token = f"{seg(header)}.{seg(b'{}')}.{seg(bytes(range(32)))}"
        assert secrets.confirmed_spans(f"token {token} end") == [(6, 6 + len(token), "jwt")], header


def test_redaction(make):
    rows = [(1, "clean words stay", "a"), (2, "token = abcdefgh1 and token=zzzzzzzzz, end é", "a"), (3, None, "a"), (4, "", "a")]
    docs = make(rows)
    out = {r["doc_id"]: r for r in secrets.redacted_documents(docs).collect()}
    assert out[1]["text"] == "clean words stay" and out[3]["text"] is None and out[3]["n_chars"] is None
    assert out[2]["text"] == "[ASSIGN] and [ASSIGN], end é" and out[2]["n_chars"] == len(out[2]["text"]) and out[2]["kept"] == "x"
