"""Secrets in text: three plain patterns, and an assignment-aware lexer.

The lexer reads ``name = literal`` pairs out of source and configuration syntax:
assignments to names and subscripts, keys of mappings, element text, block scalars,
defaults of variables. It carries constants and concatenations through names, and
scores a literal by how sensitive the name is that it ends up in. Texts are gone
through once; what a constant carries is looked up only where a sensitive name holds
it, and then once.
"""

import math
import re
from collections import Counter
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The plain patterns.
ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")

# Name parts that make a name sensitive, and those that make it less so.
SENSITIVE = {
    "password": 1.0,
    "passwd": 1.0,
    "passphrase": 1.0,
    "pwd": 0.9,
    "secret": 1.0,
    "token": 0.9,
    "apikey": 1.0,
    "api key": 1.0,
    "access key": 1.0,
    "private key": 1.0,
    "signing key": 0.9,
    "encryption key": 0.9,
    "credential": 0.9,
    "credentials": 0.9,
    "bearer": 0.9,
    "auth": 0.7,
}
HARMLESS = {"count", "length", "limit", "name", "path", "url", "type", "id", "file", "field", "label"}
PLACEHOLDER = re.compile(
    r"(?i)^(?:x+|\*+|\.+|none|null|true|false|undefined|change_?me|example.*|your[_-].*|.*placeholder.*|"
    r"<.*>|\$\{.*|\{\{.*|%\(.*|os\.environ.*|process\.env.*|getenv.*)$"
)
SUSPICIOUS = 0.5

_OPERATOR = re.compile(
    r"(?::=|=>|(?<![=!<>:])=(?![=>])|:(?![=/:-]))[ \t]*(?:\\\r?\n[ \t]*)?(?:(\()\s*)?"
)
_STRING = re.compile(
    r"""[bruf]{0,2}(?:\"""([\s\S]*?)\"""|\'\'\'([\s\S]*?)\'\'\'"""
    r"""|"((?:[^"\\\n]|\\[\s\S])*+)"|'((?:[^'\\\n]|\\[\s\S])*+)'|`((?:[^`\\]|\\[\s\S])*+)`)"""
)
_DEFAULT = re.compile(r"\$\{(\w+):?[-=]([^}\n]*+)\}")
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[ \t]*\r?\n")
_BARE = re.compile(r"""(?:[^\s,;(){}\[\]"'`+\\]|\\(?!\r?\n))++""")
# what joins two pieces of a literal: a plus sign, also over a line end, or, of strings,
# nothing; within brackets line ends join as well
_PLUS = re.compile(r"\s*+\+\s*+")
_BESIDE = re.compile(r"""[ \t]*+(?:\\\r?\n[ \t]*+)?(?=[bruf]{0,2}["'])""")
_BELOW = re.compile(r"""\s*+(?=[bruf]{0,2}["'])""")
_NAME = re.compile(r"[A-Za-z_$][\w$.-]*+")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>\s*+([^<>]*[^<>\s])\s*</\1\s*>")
# Characters of what constants carry that are scored.
SCORED_CHARS = 4096
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    """From 0 to 1: how surely a value of this name is a secret."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    pairs = [f"{a} {b}" for a, b in zip(parts, parts[1:], strict=False)]
    score = max((SENSITIVE.get(p, 0.0) for p in [*parts, *pairs]), default=0.0)
    return score * (0.3 if parts and parts[-1] in HARMLESS else 1.0)


def literal_score(value: str, quoted: bool) -> float:
    """From 0 to 1: how much a literal looks like a random string.

    One of several lines is looked at without line ends and without lines of dashes.
    """
    if "\n" in value:
        lines = (line.strip() for line in value.split("\n"))
        value = "".join(line.rstrip("\\") for line in lines if not line.startswith("-----"))
    if len(value) < 6 or PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return 0.0
    n = len(value)
    bits = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    if not quoted and kinds < 2:
        return 0.0
    return min(1.0, bits / 4 + 0.15 * (kinds - 1))


def _name_before(text: str, end: int) -> str:
    """The name that ends before ``end``, without its quotes and subscript; empty if there
    is none."""
    while end and text[end - 1] in " \t":
        end -= 1
    if end and text[end - 1] == "]":
        end -= 1
        if not end or text[end - 1] not in "\"'":
            return ""
    if end and text[end - 1] in "\"'":
        # the quote before is never further away than the last name's
        start = text.rfind(text[end - 1], 0, end - 1)
        name = text[start + 1 : end - 1] if start >= 0 else ""
        return "" if "\n" in name else name
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] in "_$.-"):
        start -= 1
    return text[start:end]


class _Held:
    """What a name holds: its own spans, the names' that it is made of, and its value."""

    def __init__(self):
        self.spans: list[tuple[int, int]] = []
        self.others: list[_Held] = []
        self.quoted = False
        self.pieces: list[str] = []
        self.carried = 0

    def add(self, text: str, start: int, end: int, quoted: bool) -> None:
        if end > start:
            self.spans.append((start, end))
        self.pieces.append(text[start:end])
        self.quoted |= quoted

    def carry(self, other: "_Held") -> None:
        self.others.append(other)
        piece = other.value[: SCORED_CHARS - self.carried]
        self.carried += len(piece)
        self.pieces.append(piece)
        self.quoted |= other.quoted

    def close(self) -> None:
        self.value = "".join(self.pieces)
        self.pieces = []

    @cached_property
    def score(self) -> float:
        if len(self.others) == 1 and not self.spans:
            return self.others[0].score
        return literal_score(self.value, self.quoted)


def _block_scalar(text: str, at: int, op: int) -> tuple[int, int]:
    """The lines from ``at`` on that are indented more than the line of the key."""
    line = text.rfind("\n", 0, op) + 1
    depth = line
    while text[depth : depth + 1] in (" ", "-") and depth < op:
        depth += 1
    first = end = at
    while end < len(text):
        stop = text.find("\n", end)
        stop = len(text) if stop < 0 else stop
        content = text[end:stop]
        if content.strip() and len(content) - len(content.lstrip(" ")) <= depth - line:
            break
        end = stop + 1
    end = min(end, len(text))
    while end > first and text[end - 1].isspace():
        end -= 1
    while first < end and text[first].isspace():
        first += 1
    return first, end


def _read(text: str, op: re.Match, constants: dict[str, _Held]) -> tuple[_Held, list[str]]:
    """What stands behind an operator, and names of variables that have it as default."""
    held, at, names = _Held(), op.end(), []
    while True:
        string = False
        if m := _STRING.match(text, at):
            group = m.lastindex
            held.add(text, m.start(group), m.end(group), True)
            string = True
        elif m := _DEFAULT.match(text, at):
            held.add(text, m.start(2), m.end(2), True)
            names.append(m[1])
        elif (m := _NAME.match(text, at)) and m[0] in constants:
            held.carry(constants[m[0]])
        elif m := _BARE.match(text, at):
            held.add(text, m.start(), m.end(), False)
        else:
            break
        beside = _BELOW if op[1] else _BESIDE
        more = _PLUS.match(text, m.end()) or (string and beside.match(text, m.end()))
        if not more:
            break
        at = more.end()
    return held, names


def lexed_literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals that sensitive names hold, directly or through other names."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    constants: dict[str, _Held] = {}
    found: set[tuple[int, int]] = set()
    seen: set[int] = set()

    def judge(names: list[str], held: _Held) -> None:
        weight = max(map(name_score, names))
        if not weight or weight * held.score < SUSPICIOUS:
            return
        waiting = [held]
        while waiting:
            part = waiting.pop()
            if id(part) not in seen:
                seen.add(id(part))
                every.append(part)
                found.update(part.spans)
                waiting.extend(part.others)

    # a number stands for an object as long as the object lives
    every: list[_Held] = []
    # assignments within a block are read, but no blocks within a block
    block_end = 0
    for op in _OPERATOR.finditer(text):
        name = _name_before(text, op.start())
        if not name:
            continue
        block = op.start() >= block_end and _BLOCK.match(text, op.end())
        if block:
            held, names = _Held(), []
            start, block_end = _block_scalar(text, block.end(), op.start())
            held.add(text, start, block_end, True)
        else:
            held, names = _read(text, op, constants)
        if not held.spans and not held.others:
            continue
        held.close()
        constants[name] = held
        judge([name, *names], held)
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            held = _Held()
            held.add(text, m.start(2), m.end(2), True)
            held.close()
            judge([m[1]], held)
    return sorted(found)


def spans_of(text: str | None) -> list[tuple[int, int, int]]:
    """``(start, number of the kind, end)``, sorted: all plain matches, and lexed
    literals that no plain match covers."""
    if not text:
        return []
    lower = text.lower()
    spans = []
    if any(x in lower for x in ("passw", "secret", "token", "api")):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    plain, at, reached = sorted(spans), 0, 0
    for start, end in lexed_literals(text):
        while at < len(plain) and plain[at][0] <= start:
            reached = max(reached, plain[at][2])
            at += 1
        if end > reached:
            spans.append((start, 3, end))
    return sorted(spans)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


@F.arrow_udf(
    T.ArrayType(
        T.StructType()
        .add("kind", T.StringType())
        .add("start", T.LongType())
        .add("end", T.LongType())
    )
)
def secret_spans(texts: pa.Array) -> pa.Array:
    rows = []
    for text in texts:
        spans = spans_of(text.as_py())
        rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
    return pa.array(rows, type=_SPANS)


@F.arrow_udf(T.StringType())
def _without_secrets(texts: pa.Array) -> pa.Array:
    rows = []
    for value in texts:
        text = value.as_py()
        out, at = [], 0
        for start, _, end in spans_of(text):
            if end <= at:
                continue
            out += [text[at:start], "[SECRET]"] if start >= at else []
            at = end
        rows.append(text if not out else "".join(out) + text[at:])
    return pa.array(rows, type=pa.string())


def without_secrets(text: Column) -> Column:
    """The text with ``[SECRET]`` in place of each secret; overlapping ones are one.

    A null text stays null, an empty one empty, however long it is all is looked at.
    """
    return _without_secrets(text.cast("string"))


def found_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, spans)``, a row per row of ``docs``.

    ``spans`` are of kind ``assign``, ``access`` and ``hex`` (every match of the plain
    patterns, which may overlap) and ``literal`` (of the lexer, not inside of a plain
    match), in code points, end exclusive, by start and kind. Null and empty texts
    have none. Rows are judged one by one, so repeated ones and null ids do not
    matter; other columns are ignored; an empty table gives an empty result.
    """
    return docs.select(id_col, secret_spans(F.col(text_col).cast("string")).alias("spans"))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
