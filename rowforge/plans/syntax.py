"""The predicate language: text to tokens to a syntax tree.

    expression = and-terms joined by "or";  and-terms = not-terms joined by "and"
    not-term   = "not" not-term | "(" expression ")" | test
    test       = path op literal | path ["not"] "in" "(" literals ")" | path "is" ["not"] "empty"
               | path ("contains" | "starts_with") string
    path       = names joined by ".";  a name is an identifier or a `quoted` one
    literal    = number | 'string' | "string" | true | false

Keywords are case-insensitive, names are not.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass
from typing import NamedTuple

MAX_BYTES = 1 << 16
MAX_DEPTH = 64

# The language's operators, escapes and the form of its numbers.
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}
_NUMBER = re.compile(r"-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_SPELLED = re.compile(
    r"""(?P<space>[ \t\r\n]+) | (?P<name>[^\W\d][\w-]*) | (?P<number>[0-9-](?:[A-Za-z0-9._]|(?<=[eE])[+-])*)
      | (?P<op>[=!<>]=|[=<>]) | (?P<mark>[(),.]) | (?P<quote>['"`])""",
    re.VERBOSE,
)
_INSIDE = {q: re.compile(rf"(?:[^{q}\\]|\\.)*", re.DOTALL) for q in "'\""}
_BAD_ESCAPE = re.compile(r"""(?:[^\\]|\\[nt\\'"])*?(\\[^nt\\'"])""", re.DOTALL)


class InvalidWhere(ValueError):
    """A predicate that does not parse; the message names the column (in characters, from 1)."""


@dataclass(frozen=True)
class Literal:
    kind: str  # "string", "number" or "bool"
    value: str | float | bool
    #: The exact whole number that a number literal spells, if it does.
    whole: int | None = None
    source: str = ""

    def __str__(self) -> str:
        return {"string": f"'{self.value}'", "bool": str(self.value).lower()}.get(self.kind, self.source)


@dataclass(frozen=True)
class Compare:
    path: tuple[str, ...]
    op: str
    literal: Literal


@dataclass(frozen=True)
class In:
    path: tuple[str, ...]
    literals: tuple[Literal, ...]
    negate: bool


@dataclass(frozen=True)
class Empty:
    path: tuple[str, ...]
    negate: bool


@dataclass(frozen=True)
class TextTest:
    path: tuple[str, ...]
    op: str  # "contains" or "starts_with"
    text: str


@dataclass(frozen=True)
class Not:
    inner: Node


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


Node = Compare | In | Empty | TextTest | Not | And | Or


class Token(NamedTuple):
    #: name, quoted (a name), string, number, op, end, or the mark itself
    kind: str
    text: str
    at: int


def _fail(at: int, message: str) -> InvalidWhere:
    return InvalidWhere(f"syntax error at column {at + 1}: {message}")


def _seen(token: Token) -> str:
    return "the expression ends" if token.kind == "end" else f"there is {token.text!r}"


def _letters(word: str) -> int:
    """How many characters of a run of word characters a name may have: letters and decimal digits of any script."""
    return next((i for i, ch in enumerate(word) if not (ch in "_-" or unicodedata.category(ch)[0] == "L" or i and unicodedata.category(ch) == "Nd")), len(word))


def _quoted(text: str, start: int) -> tuple[Token, int]:
    quote = text[start]
    if quote == "`":
        end = text.find(quote, start + 1)
        if end < 0:
            raise _fail(start, "a backtick opens a name that none closes")
        return Token("quoted", text[start + 1 : end], start), end + 1
    inside = _INSIDE[quote].match(text, start + 1)
    if bad := _BAD_ESCAPE.match(inside[0]):
        raise _fail(start + 1 + bad.start(1), f"{bad[1]} is no escape; those are \\n \\t \\\\ \\' \\\"")
    if text[inside.end() : inside.end() + 1] != quote:
        raise _fail(start, "this string is never closed")
    return Token("string", re.sub(r"\\(.)", lambda m: _ESCAPES[m[1]], inside[0], flags=re.DOTALL), start), inside.end() + 1


def tokens(text: str) -> list[Token]:
    try:
        size = len(text.encode())
    except UnicodeEncodeError as e:
        raise _fail(e.start, "not a Unicode character") from None
    if size > MAX_BYTES:
        raise _fail(0, f"{size} bytes are more than the limit of {MAX_BYTES}")
    out, at = [], 0
    while at < len(text):
        found = _SPELLED.match(text, at)
        kind = found.lastgroup if found else None
        length = _letters(found[0]) if kind == "name" else len(found[0]) if found else 0
        if not length:
            raise _fail(at, f"{text[at]!r} has no meaning here")
        if kind == "quote":
            token, at = _quoted(text, at)
            out.append(token)
            continue
        if kind != "space":
            out.append(Token(found[0] if kind == "mark" else kind, found[0][:length], at))
        at += length
    return [*out, Token("end", "", len(text))]


# --- parsing ---------------------------------------------------------------------------------------------

#: Words that may follow a column, and the kind of test they make; what stands after them, if anything.
_PHRASES = {
    ("is", "empty"): None, ("is", "not", "empty"): None, ("in",): "list", ("not", "in"): "list", ("contains",): "string", ("starts_with",): "string",
}


class _Frame:
    """What stands between two parentheses so far: alternatives, each a list of terms that must all hold."""

    def __init__(self, opened: int | None = None):
        self.opened, self.alternatives, self.negations = opened, [[]], 0

    def add(self, term: Node) -> None:
        for _ in range(self.negations):
            term = Not(term)
        self.negations = 0
        self.alternatives[-1].append(term)

    def node(self) -> Node:
        return _halved(Or, [_halved(And, terms) for terms in self.alternatives])


def _halved(kind: type, terms: list[Node]) -> Node:
    """``and`` and ``or`` are associative: a balanced tree keeps a long list of terms shallow."""
    if len(terms) == 1:
        return terms[0]
    middle = (len(terms) + 1) // 2
    return kind(_halved(kind, terms[:middle]), _halved(kind, terms[middle:]))


def parse(text: str) -> Node:
    """The tree of an expression. Open parentheses are a stack of frames, so nothing here recurses into the text."""
    words = tokens(text)
    frames, i, want_term = [_Frame()], 0, True
    while True:
        token, frame = words[i], frames[-1]
        keyword = token.text.lower() if token.kind == "name" else ""
        if want_term:
            if len(frames) - 1 + sum(f.negations for f in frames) > MAX_DEPTH:
                raise _fail(token.at, f"more than {MAX_DEPTH} levels of nesting")
            if keyword == "not":
                if words[i + 1].kind in ("op", "."):
                    raise _fail(token.at, "a column called not must be written in backticks")
                frame.negations += 1
                i += 1
            elif token.kind == "(":
                frames.append(_Frame(token.at))
                i += 1
            else:
                term, i = _term(words, i)
                frame.add(term)
                want_term = False
            continue
        i += 1
        if keyword in ("and", "or"):
            if keyword == "or":
                frame.alternatives.append([])
            want_term = True
        elif token.kind == ")" and len(frames) > 1:
            frames.pop()
            frames[-1].add(frame.node())
        elif len(frames) > 1:
            raise _fail(token.at, f"the parenthesis of column {frame.opened + 1} should close, but {_seen(token)}")
        elif token.kind == "end":
            return frame.node()
        else:
            raise _fail(token.at, f"{token.text!r} follows a complete expression")


def _term(words: list[Token], i: int) -> tuple[Node, int]:
    """The test that begins at token ``i``, and where it ends."""
    path = []
    while not path or words[i].kind == ".":
        i += bool(path)
        if words[i].kind not in ("name", "quoted"):
            raise _fail(words[i].at, f"a column's name should stand here, but {_seen(words[i])}")
        path.append(words[i].text)
        i += 1
    path, token = tuple(path), words[i]
    if token.kind == "op":
        literal = _literal(words[i + 1])
        op = "=" if token.text == "==" else token.text
        if literal.kind == "bool" and op not in ("=", "!="):
            raise _fail(token.at, f"true and false have no order: {op} cannot be asked of them")
        return Compare(path, op, literal), i + 2
    said, partial = [], True
    while partial and tuple(said) not in _PHRASES:
        word = words[i].text.lower() if words[i].kind == "name" else None
        partial = word is not None and any(p[: len(said) + 1] == (*said, word) for p in _PHRASES)
        if partial:
            said.append(word)
            i += 1
    if not partial:
        may = sorted({p[len(said)] for p in _PHRASES if p[: len(said)] == tuple(said) and len(p) > len(said)})
        raise _fail(words[i].at, f"after {' '.join(['a column', *said])} comes {'a comparison or ' if not said else ''}{', '.join(may)}, but {_seen(words[i])}")
    operand, negate = _PHRASES[tuple(said)], "not" in said
    if operand is None:
        return Empty(path, negate), i
    if operand == "string":
        if words[i].kind != "string":
            raise _fail(words[i].at, f"{said[0]} takes a quoted string, but {_seen(words[i])}")
        return TextTest(path, said[0], words[i].text), i + 1
    listed, after = [], "("
    while after != ")":
        if words[i].kind not in ("(,)" if listed else "("):
            raise _fail(words[i].at, f"{'a comma or )' if listed else 'the list of values in parentheses'} should stand here, but {_seen(words[i])}")
        after = words[i].kind
        if after != ")":
            listed.append(_literal(words[i + 1]))
            i += 1
        i += 1
    return In(path, tuple(listed), negate), i


def _literal(token: Token) -> Literal:
    if token.kind == "string":
        return Literal("string", token.text)
    if token.kind == "name" and token.text.lower() in ("true", "false"):
        return Literal("bool", token.text.lower() == "true")
    if token.kind != "number":
        raise _fail(token.at, f"a number, a quoted string, true or false should stand here, but {_seen(token)}")
    value = float(token.text) if _NUMBER.fullmatch(token.text) else math.inf
    if math.isinf(value):
        raise _fail(token.at, f"{token.text!r} does not spell a number")
    whole = int(token.text) if token.text.lstrip("-").isdecimal() else None
    return Literal("number", value, whole if whole is not None and abs(whole) < 1 << 64 else None, token.text)


def compared_paths(node: Node) -> list[tuple[str, ...]]:
    """Paths of all tests but ``is empty``, in order of first mention."""
    match node:
        case And(a, b) | Or(a, b):
            return list(dict.fromkeys(compared_paths(a) + compared_paths(b)))
        case Not(inner):
            return compared_paths(inner)
        case Empty():
            return []
    return [node.path]
