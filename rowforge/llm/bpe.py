"""Byte-pair encoding through a tokenization automaton.

The automaton reads tokens: a state is the token read last, and an arc ``s -> t`` is there if and only if the
merges, applied in their order to the text of ``s`` and ``t``, leave the two apart. It starts as the automaton of
all byte strings (one state per byte, arcs between all of them) and takes the merges one after the other. The
gadget for merge ``(u, v) -> w``

* adds a state ``w`` that continues as ``v`` continued before this merge (its row shares ``v``'s, up to this rank),
* takes the arc ``u -> v`` away, and
* lets ``w`` be reached from wherever ``u`` can be reached after that (its column shares ``u``'s).

The result accepts exactly one token string for each byte string: that of the merges. Rows hold only the arcs
taken away, so the automaton is as large as the merge list. Spelling each arc by its token's bytes and making
the result deterministic (state by state, as words ask for them) gives a table of transitions by byte whose
states know the last token of the text so far; a word is encoded by following the table and reading the
last tokens backwards. Decoding emits the byte labels of the tokens' arcs.

Defined results: a null or empty text has no tokens and decodes to the empty text; repeated rows get equal
results; texts of any length are encoded whole; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, strings

#: Words, arcs and states that a worker remembers; words not met since the last time go first, the others together.
WORD_CACHE = 200_000
ARC_CACHE = 400_000
STATE_CACHE = 150_000
_START = -1


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


#: The letters and numbers that Unicode 16.0 added. The tokenizers library classifies by 16.0; the
#: interpreter's tables may be older and the regex module's newer.
ADDED_LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
ADDED_NUMBERS_16 = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)

#: The byte-level pre-split of the vocabulary, a fixed value.
PRESPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def _newer() -> str:
    """Ranges of a character class: letters and numbers of the regex module that Unicode 16.0 does not have."""
    added = [range(a, b + 1) for a, b in (*ADDED_LETTERS_16, *ADDED_NUMBERS_16)]
    ranges: list[list[int]] = []
    for ch in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))):
        cp = ord(ch)
        if unicodedata.category(ch)[0] in "LN" or any(cp in r for r in added):
            continue
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@functools.cache
def _patterns() -> tuple[re.Pattern, regex.Pattern, re.Pattern | None, regex.Pattern]:
    """The pre-split for Latin texts, for others, the test for newer characters, and the pre-split with those."""
    letter, number, space = r"A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"0-9\u00b2\u00b3\u00b9\u00bc-\u00be", r"\t-\r \u0085\u00a0"
    latin = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")
    common = regex.compile(PRESPLIT)
    if not (newer := _newer()):
        return latin, common, None, common
    full = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{newer}]]+| ?[\p{{N}}--[{newer}]]+| ?[[^\s\p{{L}}\p{{N}}]||[{newer}]]+|\s+(?!\S)|\s+", regex.V1)
    return latin, common, re.compile(f"[{newer}]"), full


def presplit(text: str) -> list[str]:
    """The words that merges do not cross."""
    latin, common, newer, full = _patterns()
    raw = text.encode()
    # No byte above 0xC8: no code point above U+023F.
    if not raw or np.frombuffer(raw, dtype=np.uint8).max() <= 0xC8:
        return latin.findall(text)
    return (full if newer and newer.search(text) else common).findall(text)


class Automaton:
    """Compiled from a vocabulary and its merges in order."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[str, int] | None = None):
        self.labels = labels
        self.special = special or {}
        self.span = max(labels, default=0) + 1
        #: state -> {next token: rank at which that arc was taken away}
        self.removed: dict[int, dict[int, int]] = {}
        #: state -> (state whose row it shares, rank up to which)
        self.row_of: dict[int, tuple[int, int]] = {}
        #: token -> (token whose column it shares, rank up to and with which)
        self.column_of: dict[int, tuple[int, int]] = {}
        for rank, (u, v, w) in enumerate(merges):
            self.gadget(rank, u, v, w)
        self.goto: dict[int, int] = {}
        self.accepts: list[int] = [_START]
        for token, label in labels.items():
            self.add_path(label, token)
        self.inner = {key >> 8 for key in self.goto}
        self.clear()
        self.words: dict[str, str] = {}
        self.older_words: dict[str, str] = {}
        self.text_labels = {str(t): label for t, label in labels.items()} | {str(t): s.encode() for s, t in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def gadget(self, rank: int, u: int, v: int, w: int) -> None:
        if w not in self.row_of:
            self.row_of[w] = (v, rank)
            self.column_of[w] = (u, rank)
        self.removed.setdefault(u, {}).setdefault(v, rank)

    def add_path(self, label: bytes, token: int) -> None:
        node = 0
        for b in label:
            key = node << 8 | b
            if key not in self.goto:
                self.goto[key] = len(self.accepts)
                self.accepts.append(_START)
            node = self.goto[key]
        if node:
            self.accepts[node] = token

    def arc(self, state: int, token: int) -> bool:
        """Whether ``token`` may follow ``state``: no arc of a shared row and column was taken away in time."""
        row, row_until = state, None
        while True:
            removed = self.removed.get(row)
            if removed:
                column, column_until = token, None
                while True:
                    rank = removed.get(column)
                    if rank is not None and (row_until is None or rank < row_until) and (column_until is None or rank <= column_until):
                        return False
                    if column not in self.column_of:
                        break
                    column, column_until = self.column_of[column]
            if row not in self.row_of:
                return True
            row, row_until = self.row_of[row]

    def clear(self) -> None:
        self.arcs: dict[int, bool] = {}
        #: State of the byte automaton and byte -> next state, made when first met.
        self.moves: dict[int, int] = {}
        self.number: dict[tuple[int, ...], int] = {}
        self.items: list[tuple[int, ...]] = []
        self.last: list[int] = []
        self._state((0,), _START)

    def _state(self, items: tuple[int, ...], token: int) -> int:
        state = self.number[items] = len(self.items)
        self.items.append(items)
        self.last.append(token)
        return state

    def _move(self, state: int, byte: int) -> int:
        """Subset construction: a state is what can still come of each place where a token may have begun.

        An item is the token before that place and the trie's node since. Exactly one item ends in a token
        that may follow its predecessor; that token is the last one of the text so far.
        """
        goto, accepts, nodes = self.goto, self.accepts, len(self.accepts)
        items, found = [], _START
        for item in self.items[state]:
            before, node = divmod(item, nodes)
            node = goto.get(node << 8 | byte)
            if node is None:
                continue
            if node in self.inner:
                items.append(before * nodes + node)
            token = accepts[node]
            if found < 0 <= token and (not before or self._may(before - 1, token)):
                found = token
        items.append((found + 1) * nodes)
        key = tuple(items)
        after = self.number.get(key)
        if after is None:
            after = self._state(key, found)
        self.moves[state << 8 | byte] = after
        return after

    def _may(self, state: int, token: int) -> bool:
        key = state * self.span + token
        there = self.arcs.get(key)
        if there is None:
            there = self.arcs[key] = self.arc(state, token)
        return there

    def encode_word(self, word: bytes) -> list[int]:
        if len(self.items) > STATE_CACHE or len(self.arcs) > ARC_CACHE:
            self.clear()
        moves, last, state = self.moves, self.last, 0
        ends = []
        for byte in word:
            after = moves.get(state << 8 | byte)
            state = self._move(state, byte) if after is None else after
            ends.append(last[state])
        out, n, labels = [], len(word), self.labels
        while n:
            token = ends[n - 1]
            out.append(token)
            n -= len(labels[token])
        out.reverse()
        return out

    def _ids(self, text: str, parts: list[str]) -> None:
        words, older = self.words, self.older_words
        for word in presplit(text):
            ids = words.get(word)
            if ids is None:
                ids = older.get(word)
                if ids is None:
                    ids = ",".join(map(str, self.encode_word(word.encode())))
                if len(word) <= 40:
                    if len(words) >= WORD_CACHE:
                        self.words, self.older_words = {}, words
                        words, older = self.words, self.older_words
                    words[word] = ids
            parts.append(ids)

    def encode(self, text: str) -> str:
        """Ids in decimal, joined by commas."""
        parts: list[str] = []
        if self.special_split is None or "<" not in text and not any(s in text for s in self.special):
            self._ids(text, parts)
        else:
            for i, piece in enumerate(self.special_split.split(text)):
                if i % 2:
                    parts.append(str(self.special[piece]))
                elif piece:
                    self._ids(piece, parts)
        return ",".join(parts)

    def decode(self, ids: str) -> str:
        """The text of ids in decimal joined by commas; bytes that are no UTF-8 become U+FFFD."""
        if not ids:
            return ""
        return b"".join(map(self.text_labels.__getitem__, ids.split(","))).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=2)
def compiled(path: str) -> Automaton:
    """The automaton of a byte-level vocabulary file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError(f"{path}: only byte-level BPE without normalizer and prefix space is compiled")
    if model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        raise ValueError(f"{path}: dropout, ignore_merges and affixes are not compiled")
    special = {}
    for token in spec.get("added_tokens", ()):
        if any(token.get(flag) for flag in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError(f"{path}: only plain added tokens are compiled")
        special[token["content"]] = token["id"]
    alphabet = byte_alphabet()
    vocab = {token: i for token, i in model["vocab"].items() if token not in special}
    labels = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items()}
    merges = []
    for merge in model["merges"]:
        u, v = merge.split(" ") if isinstance(merge, str) else merge
        merges.append((vocab[u], vocab[v], vocab[u + v]))
    # Only bytes and what merges make can be reached; other entries of a vocabulary never are.
    made = {w for _, _, w in merges}
    labels = {i: label for i, label in labels.items() if i in made or len(label) == 1}
    return Automaton(labels, merges, special)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encoded(docs: DataFrame, path: str | None, id_column: str, text: str, keep: bool) -> DataFrame:
    docs, path = docs.select(id_column, text), path or default_path()

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = compiled(path)
        ids = [automaton.encode(t) for t in strings(batch.column(1))]
        count = pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64())
        if keep:
            # Straight from the decimal text, without a Python int per token.
            offsets = pa.array([0, *_running(count.to_pylist())], pa.int32())
            flat = pc.cast(pc.list_flatten(pc.split_pattern(pa.array([x for x in ids if x], pa.string()), ",")), pa.int32())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=[id_column, "ids"])
        sha = lambda values: pa.array([hashlib.sha256(v.encode()).hexdigest() for v in values], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), count, sha(ids), sha(map(automaton.decode, ids))], names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    columns = "ids array<int>" if keep else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs, encode, f"`{id_column}` {docs.dtypes[0][1]}, {columns}", text)


def _running(counts: list[int]) -> list[int]:
    total, out = 0, []
    for n in counts:
        total += n
        out.append(total)
    return out


def encode(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The id of every row and the token ids of its whole text."""
    return _encoded(docs, path, id_column, text, keep=True)


def decode(encoded: DataFrame, path: str | None = None, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The id of every row and the text of its token ids; null ids give the empty text."""
    encoded, path = encoded.select(id_column, ids), path or default_path()

    def run(batches):
        automaton = compiled(path)
        for batch in batches:
            texts = [automaton.decode(",".join(map(str, x or ()))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    return encoded.mapInArrow(run, f"`{id_column}` {encoded.dtypes[0][1]}, text string")


def digests(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The id of every row with its number of tokens and digests of the ids and of the text decoded from them."""
    return _encoded(docs, path, id_column, text, keep=False)


def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
