"""JSON texts read whole, in order and with their numbers, as the SQL of the queries reads them.

A value is a text, a ``Word`` (number, true, false), None, a list or, for an object, ``Pairs``: its members in order, repeated
keys too. A comma before a closing bracket and NaN or infinity are let through, a byte order mark or text after the value are not.
"""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal

_TOKEN = re.compile(
    r'[ \t\r\n]*+(?:("[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+")'
    r"|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+|-?(?i:inf(?:inity)?|nan)|true|false|null)|([\[\]{}:,]))"
)
_ESCAPES = {chr(i): f"\\u{i:04X}" for i in range(32)} | {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", '"': '\\"', "\\": "\\\\"}


class Word(str):
    __slots__ = ()


class Pairs(list):
    __slots__ = ()


def _string(token: str) -> str:
    if "\\" not in token:
        return token[1:-1]
    s = json.loads(token)
    s.encode()  # half of a surrogate pair is an error
    return s


def _word(token: str) -> Word | None:
    if token == "null":
        return None
    if token[-1].isdigit() and not token.lstrip("-").isdigit() and math.isfinite(f := float(token)):
        return Word(_double(f))
    return Word("0" if token == "-0" else token)


def _double(f: float) -> str:
    """The shortest digits of ``f``, with an exponent from 1e21 on and under 1e-6."""
    sign, digits, exponent = Decimal(repr(f)).as_tuple()
    d, point = "".join(map(str, digits)).rstrip("0") or "0", len(digits) + exponent
    if not -6 < point <= 21:
        t = d[0] + ("." + d[1:] if d[1:] else "") + f"e{point - 1}"
    elif point <= 0:
        t = "0." + "0" * -point + d
    else:
        t = d[:point].ljust(point, "0") + "." + (d[point:] or "0")
    return "-" * sign + t


def read(text: str):
    """The value of a complete JSON text of any depth; a ``ValueError`` if it is none."""
    root: list = []
    top, outer, key, want = root, [], None, "value"
    pos, end = 0, len(text.rstrip(" \t\r\n"))
    while pos < end:
        m = _TOKEN.match(text, pos, end)
        if not m:
            raise ValueError(f"no JSON at {pos}")
        kind, token, pos = m.lastindex, m[m.lastindex], m.end()
        pairs = isinstance(top, Pairs)
        if want == "item" and pairs and kind == 1:
            key, want = _string(token), "colon"
        elif want == "colon" and token == ":":
            want = "value"
        elif want == "next" and outer and token == ",":
            want = "item"
        elif want in ("item", "next") and outer and token == ("}" if pairs else "]"):
            top, want = outer.pop(), "next"
        elif (want == "value" or want == "item" and not pairs) and (kind < 3 or token in "[{"):
            v = _string(token) if kind == 1 else _word(token) if kind == 2 else Pairs() if token == "{" else []
            top.append((key, v) if pairs else v)
            want = "next"
            if kind == 3:
                outer.append(top)
                top, want = v, "item"
        else:
            raise ValueError(f"no JSON at {pos}")
    if outer or want != "next":
        raise ValueError("JSON ends early")
    return root[0]


def document(content: bytes | None) -> Pairs | None:
    """The object that ``content`` is, if it is UTF-8 and one JSON object; else None."""
    try:
        v = read(content.decode()) if content is not None else None
    except ValueError:
        return None
    return v if isinstance(v, Pairs) else None


def member(v, key: str):
    """The first member of that key; None if ``v`` is no object or has none."""
    return next((x for k, x in v if k == key), None) if isinstance(v, Pairs) else None


def shown(v) -> str | None:
    """A text as it is, null as None, anything else as compact JSON."""
    if v is None or isinstance(v, str):
        return v
    out, todo = [], [v]
    while todo:
        v = todo.pop()
        if v is None or isinstance(v, Word):
            out.append("null" if v is None else v)
        elif isinstance(v, str):
            out.append('"' + re.sub(r'[\x00-\x1f"\\]', lambda m: _ESCAPES[m[0]], v) + '"')
        else:
            pairs = isinstance(v, Pairs)
            parts: list = [Word("[{"[pairs])]
            for i, x in enumerate(v):
                parts += [Word(",")] * (i > 0) + ([x[0], Word(":"), x[1]] if pairs else [x])
            todo += reversed([*parts, Word("]}"[pairs])])
    return "".join(out)
