"""JSON texts (RFC 8259): tokens and grammar. The content must be UTF-8; a byte order mark is let through."""

from __future__ import annotations

import re
from functools import lru_cache

from factloom.functions.phplex import Lines
from factloom.llm.syntax.gll import Grammar

_TOKEN = re.compile(r'([ \t\r\n]+)|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])|((?:true|false|null)(?!\w))|([\[\]{}:,])', re.A)
_GRAMMAR = """
text : value ;
value : STR | NUM | WORD | '{' (pair (',' pair)*)? '}' | '[' (value (',' value)*)? ']' ;
pair : STR ':' value ;
"""


@lru_cache(maxsize=1)
def grammar() -> Grammar:
    return Grammar(_GRAMMAR, "text", ("json",))


def check(content: bytes) -> tuple[int, str | None, int]:
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError as x:
        return 0, "not UTF-8", content.count(b"\n", 0, x.start) + 1
    g, kinds, at, pos = grammar(), [], [], 0
    lines = Lines(text)
    names = (None, None, g.terminals["STR"], g.terminals["NUM"], g.terminals["WORD"])
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m:
            return 0, f"unexpected {text[pos : pos + 20]!r}", lines.at(pos)[0]
        if m.lastindex != 1:
            kinds.append(names[m.lastindex] if m.lastindex < 5 else g.terminals[m[0]])
            at.append(pos)
        pos = m.end()
    ok, far = g.parse(kinds)
    if ok:
        return ok, None, 0
    if far >= len(at):
        return 0, "unexpected end of file", lines.at(max(len(text) - 1, 0))[0]
    return 0, f"unexpected {text[at[far] : at[far] + 20]!r}", lines.at(at[far])[0]
