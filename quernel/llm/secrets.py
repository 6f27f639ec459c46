"""Secret scans by assignment-aware lexing: name-literal pairs, constants propagated, literals scored by their targets."""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import re
from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.base import others, text_udf

#: The base patterns of the contract and the least length that a match (of assign: its value) must have.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # 16 characters with the four of its start
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE = 8
#: Kinds in the order of the contract; ``literal`` is what the lexer adds.
KINDS = ("assign", "access", "hex", "literal")

#: Words in a target's name, and how much each says that its value is a secret.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3, "bearer": 2,
    "private": 2, "access": 1, "auth": 2, "authorization": 2, "signing": 1, "encryption": 1, "client": 1, "session": 1, "key": 1, "pass": 2, "api": 1,
}
#: Quick tests on the lower-cased text: without one of these strings there is no assign match, or no sensitive target.
_ASSIGN_SEEDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_TARGET_SEEDS = ("pass", "pwd", "secret", "token", "api", "credential", "bearer", "private", "access", "auth", "signing", "encrypt", "session", "key")
_HEX_MAP = bytes(b in b"0123456789abcdef" for b in range(256))
_HEX_RUN = b"\x01" * 32

#: Values that stand for a secret without being one.
_PLACEHOLDER = re.compile(r"(?:x+|\*+|\.+|your[\w-]*|change[_-]?me|example[\w-]*|none|null|true|false|todo|<.*>|\$\{.*\}|\$\w+|%\w+%)", re.ASCII | re.IGNORECASE)

_TOKEN = re.compile(
    r"""(?P<name>[A-Za-z_$][A-Za-z0-9_$]*+(?:[.-][A-Za-z_$][A-Za-z0-9_$]*+)*+(?:\[["'][^"'\]\n]{0,80}["']\])?)
    |(?P<quote>["'`])
    |(?P<number>[0-9][A-Za-z0-9_.+/=-]*+)
    |(?P<op>:=|=>|->|==|!=|<=|>=|[=:+,;(){}\n&])""",
    re.VERBOSE | re.ASCII,
)
#: The rest of a string behind its opening quote. Nothing in it is read twice.
_STRING = {
    '"': re.compile(r'[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'), "'": re.compile(r"[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"), "`": re.compile(r"[^`\n]*+`")
}
#: A type between a name and its value: ``: &str =``, ``: Optional[str] =``, or in Go's order `` []byte =``.
_TYPED = re.compile(
    r"""(?P<mark>[ \t]{0,40}:[ \t]{0,40}|[ \t]{1,40})(?:[&*]|\[\w{0,20}\]){0,4}(?:'\w{1,40}[ ]{1,9})?(?:mut[ ]{1,9})?(?P<type>[A-Za-z_][\w.:]{0,80}(?:[<\[][^=\n"]{0,80}[>\]])?(?:[ ]{0,9}\|[ ]{0,9}[\w.]{1,80}){0,8}[?!]?\w{0,20})
    [ \t]{0,40}=(?:[ \t]{1,40}(?=\S)|(?=["'`]))""",
    re.VERBOSE | re.ASCII,
)
#: A value without quotes, up to white space or a separator.
_BARE = re.compile(r"""(?!//)[A-Za-z0-9+/_.~$%@!^*-][^\s"'`,;(){}\[\]<>&]*+""", re.ASCII)
#: Names alone, with dots: a reference to a member.
_MEMBER = re.compile(r"[A-Za-z_]++(?:\.[A-Za-z_]++)++", re.ASCII)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.ASCII)
_BLANKS = re.compile(r"[ \t]*+")
#: Placeholders of fixed text are no longer than this; longer values are told by their first characters and by what they hold.
EDGE = 16
_OPEN_PLACEHOLDER = re.compile("your|example", re.ASCII | re.IGNORECASE)
#: Kinds of characters a value can hold: the four classes of the score, then those that rule out a placeholder.
_HOLDS = [re.compile(p, re.ASCII) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]", "[^xX]", r"[^*]", r"[^.]", r"[^\w-]", r"\n")]
_CLASSES, _NOT_X, _NOT_STAR, _NOT_DOT, _NOT_NAME, _BREAK = 15, 16, 32, 64, 128, 256
_NO_WORD = re.compile(r"\W", re.ASCII)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans as (kind, start, end), in order of start, then of kind."""
    found = []
    low = text.lower()
    if any(x in low for x in _ASSIGN_SEEDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    if _HEX_RUN in text.encode().translate(_HEX_MAP):
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def name_weight(name: str) -> int:
    """How sensitive a target's name is: the weights of its words, each once."""
    words = [w.lower() for w in _WORDS.findall(name)]
    pairs = {a + b for a, b in zip(words, words[1:], strict=False)}
    return sum(w for k, w in SENSITIVE.items() if k in words or k in pairs)


class Value(NamedTuple):
    """What the score needs to know of a whole value but its entropy. That of two values joined follows from theirs."""

    size: int  # up to ``2 * EDGE``, which stands for any greater one
    start: str  # its first ``EDGE`` characters
    last: str
    holds: int  # a bit for each of ``_HOLDS``
    no_word: int  # characters that are not ``\w``; 3 stands for any greater number
    blank: bool  # white space only
    lead: bool  # a space in the white space it begins with
    inner: bool  # a space between other characters
    trail: bool  # a space in the white space it ends with

    @classmethod
    def of(cls, text: str) -> Value:
        inner, tail = text.strip(), text[len(text.rstrip()) :]
        holds = sum(1 << k for k, p in enumerate(_HOLDS) if p.search(text))
        no_word = sum(1 for _ in itertools.islice(_NO_WORD.finditer(text), 3))
        return cls(min(len(text), 2 * EDGE), text[:EDGE], text[-1:], holds, no_word, not inner, " " in text[: len(text) - len(text.lstrip())], " " in inner, " " in tail)

    def joined(self, b: Value) -> Value:
        if self.blank:
            spaces = b.blank, self.lead or b.lead, b.inner, b.trail or b.blank and self.trail
        elif b.blank:
            spaces = False, self.lead, self.inner, self.trail or b.trail
        else:
            spaces = False, self.lead, self.inner or self.trail or b.lead or b.inner, b.trail
        return Value(min(self.size + b.size, 2 * EDGE), (self.start + b.start)[:EDGE], b.last or self.last, self.holds | b.holds, min(self.no_word + b.no_word, 3), *spaces)

    def placeholder(self) -> bool:
        """Whether ``_PLACEHOLDER`` matches the whole value."""
        if self.size <= EDGE:
            return bool(_PLACEHOLDER.fullmatch(self.start))
        holds, start, last = self.holds, self.start, self.last
        return (
            not (holds & _NOT_X and holds & _NOT_STAR and holds & _NOT_DOT)
            or not holds & _NOT_NAME and bool(_OPEN_PLACEHOLDER.match(start))
            or not holds & _BREAK and (start[0] == "<" and last == ">" or start[:2] == "${" and last == "}")
            or start[0] == "$" and self.no_word == 1
            or start[0] == "%" and last == "%" and self.no_word == 2
        )


def _bits(counts: dict[str, int]) -> float:
    n = sum(counts.values())
    return -sum(c / n * math.log2(c / n) for c in counts.values() if c) if n else 0.0


def entropy(value: str) -> float:
    """Bits a character."""
    return _bits(Counter(value))


def _tally(parts: list[tuple[dict[str, int], int]]) -> tuple[dict[str, int], int]:
    """Characters of joined values as counts and the power of two to multiply them by, which is 0 up to 2**60 characters."""
    if len(parts) == 1:
        return parts[0]
    power, out = max(p for _, p in parts), {}
    for counts, p in parts:
        for c, n in counts.items():
            out[c] = out.get(c, 0) + (n >> power - p)
    if (total := sum(out.values())) >> 60:
        less = total.bit_length() - 60
        out, power = {c: n >> less for c, n in out.items()}, power + less
    return out, power


def _plain_score(weight: int, value: Value) -> float:
    """The score but for the entropy."""
    if weight == 0 or value.size < 6 or value.placeholder() or value.inner:
        return 0.0
    classes = (value.holds & _CLASSES).bit_count()
    return float(weight + (value.size >= 16) + (classes >= 2) + (classes >= 3))


def score(name: str, value: str) -> float:
    """Weight of the name plus what the whole literal shows: length, characters of several classes, entropy; placeholders score 0."""
    plain = _plain_score(name_weight(name), Value.of(value))
    return plain + (plain > 0 and entropy(value) >= 3.0)


def _tokens(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of names, strings, numbers and operators, in one pass.

    A quote without its partner on the line is skipped. All later quotes of its kind on that line are then without one too, for behind
    an escaped quote the scan goes on as from a first one; so a line is searched once for each kind.
    """
    out, at, dead = [], 0, dict.fromkeys(_STRING, 0)
    while m := _TOKEN.search(text, at):
        kind, start, at = m.lastgroup, m.start(), m.end()
        if kind == "quote":
            mark = text[start]
            if start < dead[mark]:
                continue
            inside = _STRING[mark].match(text, at)
            if inside is None:
                line = text.find("\n", at)
                dead[mark] = line if line >= 0 else len(text)
                continue
            kind, at = "string", inside.end()
        out.append((kind, start, at))
    return out


class Assignments:
    """The name-literal pairs of a text, in order: ``pairs`` has (target, node). A node's value is a run of literals and other nodes.

    Understands ``name = "x"``, ``name: 'x'``, ``"name": "x"``, ``name := x``, ``name => x``, typed targets
    (``name: str = "x"``), literals joined by ``+`` or side by side, and names whose literal was assigned before
    (also through several names). Types are skipped in Python's, Rust's and Go's order. A value without quotes is a literal
    up to white space or a separator if its target is sensitive, unless it is a known name, a member or a call.

    A constant that is used again is referred to, never copied, so work and memory are in proportion to the text. What the score needs
    of a value is worked out from its parts, each once: the whole value counts, however long. Where its entropy decides, the work is one
    step more for each different character of the value.
    """

    def __init__(self, text: str):
        self.text = text
        self.pairs: list[tuple[str, int]] = []
        self.parts: list[list[tuple[int, int] | int]] = []  # of each node: literal spans, or numbers of nodes
        self.refused = 0
        self._values: dict[int, Value] = {}
        self._counts: dict[int, tuple[dict[str, int], int]] = {}
        self._read()

    def _bare(self, at: int, constants: dict) -> tuple[int, int] | None:
        """Span of the value without quotes behind blanks at ``at``; none for known names, members, calls and expressions."""
        text = self.text
        at = _BLANKS.match(text, at).end()
        if at < self.refused or not (m := _BARE.match(text, at)) or m.group() in constants or _MEMBER.fullmatch(m.group()):
            return None
        if text[m.end() : m.end() + 1] in ("(", "[", "{", '"', "'", "`") or text.startswith("+", _BLANKS.match(text, m.end()).end()):
            self.refused = m.end()  # whatever begins within the run ends there too
            return None
        return m.span()

    def _read(self) -> None:
        text, tokens = self.text, _tokens(self.text)
        constants: dict[str, int] = {}
        i, n = 0, len(tokens)
        while i < n:
            kind, begin, end = tokens[i]
            if kind not in ("name", "string") or i + 1 >= n:
                i += 1
                continue
            target = text[begin:end]
            typed = _TYPED.match(text, end)
            if typed and ":" not in typed["mark"] and name_weight(target) <= name_weight(typed["type"]):
                typed = None  # the type comes first
            if not typed and text[tokens[i + 1][1] : tokens[i + 1][2]] not in ("=", ":", ":=", "=>"):
                i += 1
                continue
            j = i + 2
            start = typed.end() if typed else tokens[i + 1][2]
            while j < n and tokens[j][1] < start:
                j += 1
            first = j
            parts = []
            while j < n:
                k, s, e = tokens[j]
                if k == "string":
                    parts.append((s + 1, e - 1))
                elif k == "number":
                    parts.append((s, e))
                elif k == "name" and (known := constants.get(text[s:e])) is not None:
                    parts.append(known)
                else:
                    break
                j += 1
                if j < n and tokens[j][0] == "op" and text[tokens[j][1] : tokens[j][2]] == "+":
                    j += 1
                elif not (j < n and tokens[j][0] == "string" and k == "string"):
                    break
            only = parts[0] if len(parts) == 1 and not isinstance(parts[0], int) else None
            bare = self._bare(start, constants) if (only or not parts) and name_weight(target) else None
            if bare and (not parts or only[0] == bare[0] and only[1] < bare[1]):
                parts, j = [bare], first
                while j < n and tokens[j][1] < bare[1]:
                    j += 1
            if parts:
                constants[target.strip("\"'`")] = len(self.parts)
                self.pairs.append((target.strip("\"'`"), len(self.parts)))
                self.parts.append(parts)
            i = max(j, i + 2) if parts else i + 1

    def _worked_out(self, node: int, known: dict, of: Callable, joined: Callable):
        """What ``known`` says of a node: ``of`` a literal's text, ``joined`` for a list of such. Nodes it refers to come first."""
        todo = [node]
        while todo:
            if (k := todo[-1]) in known:
                todo.pop()
            elif need := [x for x in self.parts[k] if isinstance(x, int) and x not in known]:
                todo += need
            else:
                known[k] = joined([known[x] if isinstance(x, int) else of(self.text[slice(*x)]) for x in self.parts[k]])
        return known[node]

    def reaches(self, name: str, node: int, least: float) -> bool:
        """Whether the ``score`` of a name and a node's whole value is at least ``least``."""
        weight = name_weight(name)
        plain = _plain_score(weight, self._worked_out(node, self._values, Value.of, lambda x: functools.reduce(Value.joined, x))) if weight else 0.0
        if plain >= least or plain == 0 or plain + 1 < least:
            return plain >= least
        return _bits(self._worked_out(node, self._counts, lambda x: (Counter(x), 0), _tally)[0]) >= 3.0

    def literals(self, nodes: list[int]) -> set[tuple[int, int]]:
        """Spans of the literals that the nodes' values are made of; each node is entered once."""
        found, seen, todo = set(), set(nodes), list(nodes)
        while todo:
            for x in self.parts[todo.pop()]:
                if not isinstance(x, int):
                    found.add(x)
                elif x not in seen:
                    seen.add(x)
                    todo.append(x)
        return found


def literal_spans(text: str, least: float = 5.0) -> list[tuple[str, int, int]]:
    """Spans of literals of which a target scores at least ``least``; each literal once."""
    low = text.lower()
    if not any(x in low for x in _TARGET_SEEDS):
        return []
    found = Assignments(text)
    secret = found.literals([node for name, node in found.pairs if found.reaches(name, node, least)])
    return [("literal", a, b) for a, b in sorted(secret) if b > a]


def all_spans(text: str, least: float = 5.0) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans): literals that lie within a base span add nothing and are left out."""
    base, own = base_spans(text), literal_spans(text, least)
    starts = [b[1] for b in base]
    reach = list(itertools.accumulate((b[2] for b in base), max))  # the furthest end of base spans that begin no later
    own = [x for x in own if not ((k := bisect.bisect_right(starts, x[1])) and reach[k - 1] >= x[2])]
    return base, sorted(base + own, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    """``text`` with each span, or run of overlapping spans, replaced by a mark."""
    out, done = [], 0
    for _, a, b in sorted(spans, key=lambda x: x[1:]):
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join([*out, text[done:]])


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, text_col: str = "text", least: float = 5.0) -> DataFrame:
    """``docs`` with a struct ``secrets``: n_assign, n_access, n_hex (long), base and spans (``kind:start:end``, comma-joined).

    Offsets are code points, the end exclusive. Null and empty texts have no spans. Rows are independent, so ties,
    repeats and empty tables need no rule; a column ``secrets`` of the input is replaced. A very long text is scanned whole by one
    task, in time in proportion to its length.
    """

    def work(texts: list[str | None]) -> pa.Array:
        rows = []
        for text in texts:
            base, spans = all_spans(text or "", least)
            n = Counter(k for k, _, _ in base)
            rows.append((n["assign"], n["access"], n["hex"], _join(base), _join(spans)))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.StructArray.from_arrays([pa.array(c, pa.int64() if k < 3 else pa.string()) for k, c in enumerate(columns)], ["n_assign", "n_access", "n_hex", "base", "spans"])

    made = text_udf(work, "struct<n_assign: long, n_access: long, n_hex: long, base: string, spans: string>")
    return docs.select(*others(docs, ["secrets"]), made(F.col(text_col)).alias("secrets"))
