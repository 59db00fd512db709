"""Secrets in texts: assignments are read as name-literal pairs and judged by their names.

Base spans follow three fixed patterns and always count.  Beside them, the source code and
configuration in a text is read as assignments: ``name = value``, ``name: value``, ``:=``, ``=>``,
entries with quoted names, attributes and elements of markup, calls of a quoted name and a
quoted value, command-line flags.  The value is a sum of quoted literals, bare values and names.

Constants are propagated: a bare value that is itself assigned somewhere in the text stands for
what is assigned to it, through any number of steps and in either order, so ``K = "x"`` counts as
what ``password = K`` assigns.

A literal is scored by the most sensitive name that it reaches, times how far it looks like a
secret; placeholders, references to an environment, file names and calls score nothing.  A
literal of ``THRESHOLD`` or more becomes a span of kind ``assign``, unless it lies inside a base
span.  Added spans may overlap base ones where a literal goes on beyond them.

Every pattern here reads a text once from left to right, so the time is linear in its length.

Defined cases: a null or empty text has no spans; an empty table gives no rows; kept columns
named like a result are left out.  Positions are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
THRESHOLD = 0.5
MIN_LITERAL = 6


def _any_case(word: str) -> str:
    """ASCII letters in either case; the flag for it would let other letters in."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The three patterns of the base and the least lengths.
_NAMES = ("password", "passwd", "secret", "token", "api_?key")
_ASSIGN = re.compile(
    rf"(?:{'|'.join(map(_any_case, _NAMES))})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_LEAST_ASSIGN, _LEAST_ACCESS = 6, 20
_STEMS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
# end of fixed values

# How far a word in a name says that the value is secret, and words that say it is about one.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0, "secrets": 0.9, "token": 0.9,
    "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "authorization": 0.8, "bearer": 0.8, "auth": 0.5, "key": 0.4,
    "private": 0.5, "api": 0.4, "access": 0.4, "signing": 0.4, "encryption": 0.4, "master": 0.3, "pin": 0.5, "salt": 0.4,
    "session": 0.3, "cookie": 0.3, "passwort": 1.0, "kennwort": 1.0, "contraseña": 1.0, "motdepasse": 1.0, "webhook": 0.3,
}
ABOUT = frozenset("""
    name file path dir url uri host length len size type kind field label id hint policy expiry expires ttl timeout count
    min max regex pattern column placeholder public error message msg title text prompt help enabled required version format
    limit limits budget usage
""".split())
_HINT = re.compile(rb"pass|pwd|secret|token|cred|key|auth|bearer|private|pin|salt|session|cookie|kennwort|contrase|webhook")

_NAME = r"[^\W\d][\w$]*+(?:[.-][^\W\d][\w$]*+)*+"
_PAIR = re.compile(
    rf"(?<![\w$.-])\$?+({_NAME})[\"'`]?\]?[ \t]*+(=>|:=|\?=|\|\|=|=(?![=~])|:(?![:/=]))[ \t]*+")
_CALL = re.compile(rf"\([ \t]*+[\"']({_NAME})[\"'][ \t]*+,[ \t]*+(?=[\"'])")
_FLAG = re.compile(rf"(?<![\w-])--({_NAME})[= ][ \t]*+")
_ELEMENT = re.compile(rf"<({_NAME})>([^<>\n]*+)</")
_QUOTED = re.compile(r"""[rbuf]{0,2}(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`)""")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>|&]++")
_REFERENCE = re.compile(rf"{_NAME}\Z")
_ANNOTATED = re.compile(r"[ \t]*+(?:\[[\w ,|.]*+\])?[ \t]*+=(?!=)[ \t]*+")
_PLUS = re.compile(r"\s*+(?:\+|\.(?=\s*+[\"']))\s*+")
_PIECES = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-zß-öø-ÿ0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_NO_SECRET = re.compile(r"""
    <.*> | \$.* | \{\{.* | %.*% | \#\{.* | (?:https?|file)://.* | [./~].*/.* | ([^\w\s]|[xX0])\1* |
    (?:change.?me|example|your|my.?(?:pass|secret|token)|none|null|nil|true|false|undefined|todo|redacted|placeholder|dummy|
       sample|string|required|optional|env|os|process|config|settings|self|this|args|options|params|request|req)\b.*
""", re.IGNORECASE | re.VERBOSE | re.DOTALL)


@dataclass(frozen=True)
class Literal:
    """A value as it stands in the text."""

    start: int
    end: int
    value: str
    quoted: bool


@dataclass(frozen=True)
class Pair:
    """A name and what is assigned to it: literals and names of other values."""

    name: str
    literals: tuple[Literal, ...]
    references: tuple[Literal, ...]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base spans, in order."""
    found = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(stem in low for stem in _STEMS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= _LEAST_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


# -- reading assignments ------------------------------------------------------------------

def _quoted(text: str, at: int) -> tuple[Literal, int] | None:
    """A quoted literal, also one in three quotes, and where it ends."""
    for fence in ('"""', "'''"):
        if text.startswith(fence, at):
            end = text.find(fence, at + 3)
            return None if end < 0 else (Literal(at + 3, end, text[at + 3:end], True), end + 3)
    m = _QUOTED.match(text, at)
    if not m:
        return None
    return Literal(m.start(m.lastindex), m.end(m.lastindex), m[m.lastindex], True), m.end()


def _value(text: str, at: int, operator: str) -> tuple[tuple[Literal, ...], tuple[Literal, ...], int]:
    """Literals and possible names that a value is the sum of, and the end of its last bare part."""
    literals, bare, done = [], [], 0
    while True:
        found = _quoted(text, at)
        if found:
            literals.append(found[0])
            at = found[1]
        else:
            m = _BARE.match(text, at)
            if not m:
                break
            typed = _ANNOTATED.match(text, m.end()) if operator == ":" else None
            if typed and not literals and not bare:
                # An annotation: the value follows the equals sign behind it.
                at, operator = typed.end(), "="
                continue
            at = done = m.end()
            if text[at:at + 1] in ("(", "["):
                break
            value = m[0].rstrip(".:")
            if value.endswith("+") and text[at:at + 1] in ("'", '"'):
                value, at = value[:-1], at - 1
            if value:
                bare.append(Literal(m.start(), m.start() + len(value), value, False))
        plus = _PLUS.match(text, at)
        if not plus:
            break
        at = plus.end()
    return tuple(literals), tuple(bare), done


def _assigned(found: Iterator[re.Match], text: str) -> Iterator[Pair]:
    """Pairs of the matches; what a bare value holds (``a=b=c``) is not looked at again."""
    done = 0
    for m in found:
        if m.start() >= done:
            literals, bare, end = _value(text, m.end(), m[m.lastindex] if m.lastindex > 1 else "=")
            done = max(done, end)
            yield Pair(m[1], literals, bare)


def pairs(text: str) -> Iterator[Pair]:
    """Name-literal pairs of a text."""
    yield from _assigned(_PAIR.finditer(text), text)
    for m in _CALL.finditer(text):
        found = _quoted(text, m.end())
        if found and text[found[1]:found[1] + 8].lstrip(" \t").startswith(")"):
            yield Pair(m[1], (found[0],), ())
    yield from _assigned(_FLAG.finditer(text), text)
    for m in _ELEMENT.finditer(text):
        yield Pair(m[1], (Literal(m.start(2), m.end(2), m[2], True),), ())


# -- judging ------------------------------------------------------------------------------

def name_score(name: str) -> float:
    """How sensitive a name is, from its words."""
    words = [p.lower() for piece in _PIECES.findall(name) for p in _CAMEL.split(piece)]
    words += ["apikey"] if "".join(words).find("apikey") >= 0 and "apikey" not in words else []
    open_ = 1.0
    for word in words:
        open_ *= 1 - SENSITIVE.get(word, 0.0)
    return (1 - open_) * (0.2 if any(w in ABOUT for w in words) else 1.0)


def literal_score(literal: Literal) -> float:
    """How far a value looks like a secret."""
    value = literal.value
    if len(value) < MIN_LITERAL or _NO_SECRET.fullmatch(value):
        return 0.0
    classes = sum((any(c.islower() for c in value), any(c.isupper() for c in value), any(c.isdigit() for c in value),
                   any(not c.isalnum() and not c.isspace() for c in value)))
    if len(set(value)) < 4:
        return 0.0
    if literal.quoted:
        spaces = sum(c.isspace() for c in value)
        if spaces:
            # Words may be prose; digits or signs among them make a passphrase.
            return 0.6 if spaces <= 8 and any(not c.isalpha() and not c.isspace() for c in value) else 0.0
        return 1.0 if classes >= 2 else 0.75
    # A bare word may be prose; digits or signs inside make it a value.
    return 1.0 if classes >= 3 or (classes == 2 and any(c.isdigit() for c in value)) else 0.4


def judged(text: str) -> dict[tuple[int, int], tuple[float, str]]:
    """``(start, end)`` of literals -> score and the most sensitive name they reach."""
    found = list(pairs(text))
    defined = {p.name for p in found}
    targets = defaultdict(set)  # name -> names it is assigned to
    held = defaultdict(list)  # name -> its own literals
    for p in found:
        held[p.name] += p.literals
        for value in p.references:
            if _REFERENCE.match(value.value) and value.value in defined and value.value != p.name:
                targets[value.value].add(p.name)
            else:
                held[p.name].append(value)
    # A name is as sensitive as the most sensitive one that its value reaches; from the highest down,
    # so that every name is settled once.
    sources = defaultdict(list)
    for source, names in targets.items():
        for name in names:
            sources[name].append(source)
    reach: dict[str, tuple[float, str]] = {}
    for score, name in sorted(((name_score(n), n) for n in defined), key=lambda x: (-x[0], x[1])):
        if score <= 0:
            break
        waiting = [name]
        while waiting:
            here = waiting.pop()
            if here not in reach:
                reach[here] = (score, name)
                waiting += sources[here]
    out: dict[tuple[int, int], tuple[float, str]] = {}
    for name, (score, target) in reach.items():
        for literal in held[name]:
            total = score * literal_score(literal)
            where = (literal.start, literal.end)
            if total >= THRESHOLD and (where not in out or (total, target) > out[where]):
                out[where] = (total, target)
    return out


def all_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float, str | None]]:
    """``(start, kind, end, score, name)``: base spans (score 1, no name) and judged literals beyond them."""
    spans = [(s, k, e, 1.0, None) for s, k, e in base]
    if not _HINT.search(text.encode("utf-8", "surrogatepass").lower()):
        return spans
    furthest, at, ends = -1, 0, sorted((s, e) for s, _, e in base)
    for (start, end), (score, name) in sorted(judged(text).items()):
        while at < len(ends) and ends[at][0] <= start:
            furthest = max(furthest, ends[at][1])
            at += 1
        if end > furthest:
            spans.append((start, 0, end, score, name))
    return sorted(spans, key=lambda s: s[:3])


def as_text(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans)


# -- the job ------------------------------------------------------------------------------
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()),
                   ("name", pa.string())])
_FOUND = pa.struct([("base_spans", pa.list_(_SPAN)), ("all_spans", pa.list_(_SPAN))])
_SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:double,name:string>>"


def _rows(spans: list[tuple]) -> list[dict]:
    return [{"kind": KINDS[s[1]], "start": s[0], "end": s[2], "score": s[3], "name": s[4]} for s in spans]


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) with ``base_spans`` and ``all_spans``.

    Both are arrays of ``kind, start, end, score, name`` by start, then kind; ``name`` is the most
    sensitive name that an added literal reaches.  One scan, nothing is shuffled.
    """
    @F.arrow_udf(f"struct<base_spans:{_SPAN_TYPE},all_spans:{_SPAN_TYPE}>")
    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            value = t.as_py() or ""
            base = base_spans(value)
            spans = all_spans(value, base)
            out.append({"base_spans": _rows([(*b, 1.0, None) for b in base]), "all_spans": _rows(spans)})
        return pa.array(out, _FOUND)

    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("base_spans", "all_spans")]
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(0).alias("_"))
    found = docs.select(row.alias("row"), scan(F.col(text).cast("string")).alias("f"))
    return found.select(*[F.col(f"row.`{c}`") for c in names], "f.base_spans", "f.all_spans")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with everything that a span covers replaced by ``<secret>``."""
    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            if t is None:
                out.append(None)
                continue
            parts, at, covered = [], 0, -1
            for s in all_spans(t, base_spans(t)):
                if s[0] >= covered:
                    parts += [t[at:s[0]], "<secret>"]
                covered = max(covered, s[2])
                at = covered
            out.append("".join(parts) + t[at:])
        return pa.array(out, pa.string())

    return docs.select(*[cut(F.col(f"`{c}`").cast("string")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
