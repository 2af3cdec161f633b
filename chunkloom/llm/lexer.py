"""A lexer for code and configuration of any language: names and literals, across lines, in linear time.

Literals are quoted, triple quoted, template, escaped (``\\"...\\"`` inside another literal) and here-documents. A quoted
literal ends on its line unless the line end is escaped; an apostrophe after a letter or digit opens none. What stands in
a literal can be scanned again as text of its own, so that settings within strings and templates are seen as well. All
quantifiers are possessive: no text is looked at twice for one token, whatever its length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

_DOUBLE = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"'
_SINGLE = r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
_TICKS = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
_TRIPLE = r'"""[^"\\]*+(?:(?:\\[\s\S]|"(?!""))[^"\\]*+)*+"""' + r"|'''[^'\\]*+(?:(?:\\[\s\S]|'(?!''))[^'\\]*+)*+'''"
_ESCAPED = r"""\\"[^"\\\n]*+\\"|\\'[^'\\\n]*+\\'"""
#: The delimiter of a here-document names its end, which stands alone on a line.
_HERE = r"<<[-~]?\s*+(?P<hq>[\"']?)(?P<here>[A-Z_][A-Z0-9_]*+)(?P=hq)[^\n]*+\n"
_ALONE = re.compile(r"^[^\S\n]*+([A-Z_][A-Z0-9_]*+)[^\S\n]*+;?$", re.M)
_NAME = r"[$@]?(?:[^\W\d]|\$)[\w$]*+(?:(?:[.\-]|->|::|\?\.)[\w$]++)*+"

NAME = re.compile(_NAME)
_START = re.compile(r"[\"'`\\<]")
_OPEN = re.compile(
    rf"(?P<triple>{_TRIPLE})|(?P<double>{_DOUBLE})|(?P<single>(?:(?<![^\W_])|(?<=\b[bBrRuUfFL])){_SINGLE})|`{{3,}}+|(?P<ticks>{_TICKS})"
    rf"|(?P<escaped>{_ESCAPED})|\\[\s\S]|(?P<heredoc>{_HERE})")
LITERAL = re.compile(rf"(?:(?:[bBrRuUfFL]{{1,2}}+|[@$]{{1,2}}+)(?=[\"'`]))?(?:(?P<triple>{_TRIPLE})|(?P<double>{_DOUBLE})|(?P<single>{_SINGLE})|(?P<ticks>{_TICKS})|(?P<escaped>{_ESCAPED}))")
#: Characters of the delimiter on each side.
MARKS = {"triple": 3, "double": 1, "single": 1, "ticks": 1, "escaped": 2}

Token = tuple[str, int, int]  # kind, begin and end of the name or of the literal's contents


def literals(text: str, begin: int = 0, end: int | None = None) -> Iterator[Token]:
    """The literals in order, by their contents; what stands between them are names and operators."""
    stop = len(text) if end is None else end
    alone: dict[str, list[int]] | None = None
    at = begin
    while start := _START.search(text, at, stop):
        if not (m := _OPEN.match(text, start.start(), stop)):
            at = start.end()
            continue
        at, kind = m.end(), m.lastgroup
        if kind in MARKS:
            yield kind, m.start() + MARKS[kind], at - MARKS[kind]
        elif kind == "heredoc":
            if alone is None:
                alone = {}
                for line in _ALONE.finditer(text, begin, stop):
                    alone.setdefault(line[1], []).append(line.start())
            ends = alone.get(m["here"], [])
            n = bisect_left(ends, at)
            if n < len(ends):
                yield kind, at, ends[n]
                at = ends[n]


def name_at(text: str, place: int, begin: int, end: int) -> tuple[int, int] | None:
    """The name that covers ``place``, a name being the whole chain of its parts (``a.b``, ``a->b``, ``a-b``); nothing before ``begin`` is looked at."""
    first = place
    while first > begin and ((c := text[first - 1]).isalnum() or c in "_$.-:>?@"):
        first -= 1
    for m in NAME.finditer(text, first, end):
        if m.end() > place:
            return m.span() if m.start() <= place else None
    return None


def tokens(text: str, begin: int = 0, end: int | None = None) -> Iterator[Token]:
    """Names and literals in order; a literal is given by its contents. Other characters give no token."""
    stop, at = len(text) if end is None else end, begin
    for kind, a, b in [*literals(text, begin, stop), ("", stop, stop)]:
        for m in NAME.finditer(text, at, a):
            yield "name", m.start(), m.end()
        if kind:
            yield kind, a, b
        at = b


def literal(text: str, at: int, end: int) -> tuple[int, int, str, str] | None:
    """(begin, end of the contents, kind, prefix) of the literal that begins here."""
    if not (m := LITERAL.match(text, at, end)):
        return None
    kind = m.lastgroup
    size = MARKS[kind]
    return m.start(kind) + size, m.end() - size, kind, text[m.start():m.start(kind)]
