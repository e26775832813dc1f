"""YAML streams: lines and their indentation as tokens, and the grammar over them.

The lexer knows nothing of keys and values. It puts OPEN where a block begins at a deeper column, NEXT where a line begins
at the column of its block, CLOSE where one ends, and one token for each scalar, indicator or property; a scalar that
spans lines (TEXT) is told apart from one that does not (WORD), since only the latter can be a key without ``?``. What a
mapping or sequence is, the grammar tells. After ``-``, ``?`` and a colon that begins a line, what follows on the line
is a block of its own.
"""

from __future__ import annotations

import re
from functools import lru_cache

from factloom.functions.phplex import Lines
from factloom.llm.syntax.gll import Grammar

_GRAMMAR = """
stream : (root DOCEND*)? document* ;
document : DIRECTIVE* '---' opening? DOCEND* ;
opening : inline | props? root ;
root : OPEN body CLOSE ;
body : inline | map | seq | props NEXT below | props root ;
below : content | map | seq ;
inline : ALIAS | content | props content? ;
content : WORD | TEXT | LITERAL | flow ;
map : entry (NEXT entry)* ;
entry : props? key ':' held? | '?' root? (NEXT 'V' root?)? | 'V' root? ;
key : ALIAS | WORD | oneline ;
held : inline | props? root | props? (NEXT '-' root?)+ ;
seq : '-' root? (NEXT '-' root?)* ;
props : ANCHOR TAG? | TAG ANCHOR? ;
flow : oneline | '[' fseq 'END]' | '{' fmap 'END}' ;
oneline : '[' fseq ']' | '{' fmap '}' ;
fseq : (fentry (',' fentry)* ','?)? ;
fentry : fnode | fkey? ':' fnode? | '?' fnode? (':' fnode?)? ;
fkey : ALIAS | props? (WORD | oneline) ;
fmap : (fpair (',' fpair)* ','?)? ;
fpair : fnode | fkey? ':' fnode? | '?' fnode? (':' fnode?)? ;
fnode : ALIAS | fcontent | props fcontent? ;
fcontent : WORD | TEXT | flow ;
"""
_B = "\\r\\n\\x85\\u2028\\u2029"  # line ends
_BREAK = re.compile(rf"\r\n|[{_B}]")
_BAD = re.compile("[^\x09\x0a\x0d\x20-\x7e\x85\xa0-퟿-�\U00010000-\U0010ffff]")
_LINE = re.compile(rf"( *)([ \t]*)(?:#[^{_B}]*)?(\r\n|[{_B}]|\Z)?")
_MARK = re.compile(rf"(?:---|\.\.\.)(?=[ \t{_B}]|\Z)")
_GAP = rf"[ \t{_B}]|\Z"
_TOKEN = re.compile(
    rf"""(?P<word>(?:[^-?:,\[\]{{}}#&*!|>'"%@` \t{_B}]|[-?:](?![ \t{_B}]|\Z))(?:[^:# \t{_B}]|:(?![ \t{_B}]|\Z)|(?<![ \t])\#|[ \t]+(?![ \t#{_B}]|\Z|:(?:{_GAP})))*)
|(?P<single>'(?:[^']|'')*')|(?P<double>"(?:[^"\\]|\\(?:[0abt\tnvfre "/\\N_LP\n\r]|x[0-9A-Fa-f]{{2}}|u[0-9A-Fa-f]{{4}}|U[0-9A-Fa-f]{{8}}))*")
|(?P<anchor>&[^ \t{_B},\[\]{{}}]+)|(?P<alias>\*[^ \t{_B},\[\]{{}}]+)|(?P<tag>!(?:<[^ \t{_B}<>]+>|[A-Za-z0-9_\-\#;/?:@&=+$.~*'()%!]*)(?={_GAP}|[,\]}}]))
|(?P<literal>[|>](?:[+-][1-9]?|[1-9][+-]?)?[ \t]*(?:(?<=[ \t])\#[^{_B}]*)?(?:\r\n|[{_B}]|\Z))|(?P<mark>[-?:](?={_GAP}))|(?P<open>[\[{{])""",
    re.X,
)
_FLOW = re.compile(
    rf"""(?P<word>(?:[^-?:,\[\]{{}}#&*!|>'"%@` \t{_B}]|[-?:](?![ \t{_B},\[\]{{}}]|\Z))(?:[^:#,\[\]{{}} \t{_B}]|:(?![ \t{_B},\[\]{{}}]|\Z)|(?<![ \t])\#|[ \t]+(?![ \t#{_B},\[\]{{}}]|\Z|:(?:{_GAP}|[,\[\]{{}}])))*)
|(?P<single>'(?:[^']|'')*')|(?P<double>"(?:[^"\\]|\\(?:[0abt\tnvfre "/\\N_LP\n\r]|x[0-9A-Fa-f]{{2}}|u[0-9A-Fa-f]{{4}}|U[0-9A-Fa-f]{{8}}))*")
|(?P<anchor>&[^ \t{_B},\[\]{{}}]+)|(?P<alias>\*[^ \t{_B},\[\]{{}}]+)|(?P<tag>!(?:<[^ \t{_B}<>]+>|[A-Za-z0-9_\-\#;/?:@&=+$.~*'()%!]*)(?={_GAP}|[,\]}}]))
|(?P<mark>[?:](?={_GAP}|[,\[\]{{}}]))|(?P<open>[\[{{])|(?P<close>[\]}}])|(?P<comma>,)""",
    re.X,
)
#: The rest of a scalar on a further line: any text up to a colon or comment.
_MORE = re.compile(rf"(?:[^:# \t{_B}]|:(?!{_GAP})|(?<![ \t])\#|[ \t]+(?![ \t#{_B}]|\Z|:(?:{_GAP})))+")
_MORE_FLOW = re.compile(rf"(?:[^:#,\[\]{{}} \t{_B}]|:(?![ \t{_B},\[\]{{}}]|\Z)|(?<![ \t])\#|[ \t]+(?![ \t#{_B},\[\]{{}}]|\Z|:(?:{_GAP}|[,\[\]{{}}])))+")
_KIND = {"anchor": "ANCHOR", "alias": "ALIAS", "tag": "TAG"}
#: An implicit key has at most so many characters (fixed value of the language).
KEY = 1024


@lru_cache(maxsize=1)
def grammar() -> Grammar:
    return Grammar(_GRAMMAR, "stream", ("yaml",))


class Malformed(ValueError):
    def __init__(self, what: str, at: int):
        super().__init__(what)
        self.at = at


def tokens(text: str) -> list[tuple[str, int]]:
    """(kind, offset) of a stream; Malformed where no token can be read."""
    out: list[tuple[str, int]] = []
    columns: list[int] = []
    pos, n, head = (1 if text.startswith("﻿") else 0), len(text), False

    def close(column: int, at: int) -> None:
        while columns and columns[-1] > column:
            columns.pop()
            out.append(("CLOSE", at))

    def open_(column: int, at: int) -> None:
        columns.append(column)
        out.append(("OPEN", at))

    while pos < n:
        # the beginning of a line
        m = _LINE.match(text, pos)
        if m[3] is not None:
            pos = m.end()
            if m.end() == m.start():
                break
            continue
        start, column = pos, len(m[1])
        if not column and not m[2]:
            d = _MARK.match(text, pos)
            if d or text[pos] == "%":
                close(-1, pos)
                out.append((("---" if text[pos] == "-" else "DOCEND") if d else "DIRECTIVE", pos))
                pos = d.end() if d else _end(text, pos)
                head = False
                pos = _line(text, pos, start, columns, out, open_, head, True)
                continue
        pos += column
        if m[2]:
            raise Malformed("tab in indentation", pos)
        close(column, pos)
        if columns and columns[-1] == column:
            out.append(("NEXT", pos))
            head = len(out) > 2 and out[-2][0] in ("ANCHOR", "TAG") and _alone(out)
        else:
            open_(column, pos)
            head = True
        pos = _line(text, pos, start, columns, out, open_, head, False)
    close(-1, n)
    return out


def _alone(out: list[tuple[str, int]]) -> bool:
    """Before the last NEXT a block has nothing but properties."""
    k = len(out) - 2
    while k >= 0 and out[k][0] in ("ANCHOR", "TAG"):
        k -= 1
    return k >= 0 and out[k][0] == "OPEN"


def _end(text: str, pos: int) -> int:
    m = _BREAK.search(text, pos)
    return m.start() if m else len(text)


def _line(text: str, pos: int, start: int, columns: list[int], out: list, open_, head: bool, marked: bool) -> int:
    """Tokens of a line from ``pos``; where it, or a scalar or flow collection that begins on it, ends.

    ``head``: nothing of the block but properties has come. ``marked``: the line begins with a document marker.
    """
    n, first = len(text), not marked
    while True:
        while pos < n and text[pos] in " \t":
            pos += 1
        if pos >= n:
            return pos
        b = _BREAK.match(text, pos)
        if b:
            return b.end()
        if text[pos] == "#":
            pos = _end(text, pos)
            continue
        m = _TOKEN.match(text, pos)
        if not m:
            raise Malformed("quoted scalar is not closed or has an unknown escape" if text[pos] in "'\"" else f"unexpected {text[pos]!r}", pos)
        kind, at, pos = m.lastgroup, pos, m.end()
        parent = -1 if not columns else (columns[-2] if len(columns) > 1 else -1) if head else columns[-1]
        if kind == "word":
            pos, many = _continued(text, pos, parent)
            out.append(("TEXT" if many or pos - at > KEY else "WORD", at))
            if many:
                start = max(start, text.rfind("\n", at, pos) + 1)
        elif kind in ("single", "double"):
            many = _broken(text, at, pos)
            out.append(("TEXT" if many or pos - at > KEY else "WORD", at))
        elif kind == "literal":
            out.append(("LITERAL", at))
            return _literal(text, m, parent)
        elif kind == "open":
            pos = _flow(text, at, out)
        elif kind == "mark":
            x = text[at]
            out.append((("V" if first else ":") if x == ":" else x, at))
            if x != ":" or first:
                k = pos
                while k < n and text[k] in " \t":
                    k += 1
                if k < n and text[k] != "#" and not _BREAK.match(text, k):
                    open_(k - start, k)
                    pos, head, first = k, True, True
                    continue
        else:
            out.append((_KIND[kind], at))
            first = False
            continue
        head = first = False


def _broken(text: str, at: int, end: int) -> bool:
    """Whether a quoted scalar spans lines; a document marker inside is malformed."""
    many = False
    for b in _BREAK.finditer(text, at, end):
        many = True
        if _MARK.match(text, b.end()):
            raise Malformed("document marker inside a quoted scalar", b.end())
    return many


def _continued(text: str, pos: int, parent: int) -> tuple[int, bool]:
    """The end of a plain scalar of a block, and whether it spans lines: the lines that follow go on if indented beyond ``parent``."""
    end, many, n = pos, False, len(text)
    while True:
        k = end
        while k < n and text[k] in " \t":
            k += 1
        b = _BREAK.match(text, k)
        if not b:
            return end, many
        k = b.end()
        while True:  # empty lines
            m = re.compile(rf"[ \t]*(?:\r\n|[{_B}])").match(text, k)
            if not m:
                break
            k = m.end()
        line = k
        while k < n and text[k] == " ":
            k += 1
        if k - line <= parent or _MARK.match(text, line):
            return end, many
        while k < n and text[k] == "\t":
            k += 1
        m = _MORE.match(text, k)
        if not m or text[k] == "#":
            return end, many
        end, many = m.end(), True


def _literal(text: str, header: re.Match, parent: int) -> int:
    """Where a block scalar ends: at the first line with text that is indented less than it."""
    given = re.search(r"[1-9]", header[0].split("#")[0])
    least = max(parent, 0) + int(given[0]) if given else None
    pos, n = header.end(), len(text)
    while pos < n:
        k = pos
        while k < n and text[k] == " ":
            k += 1
        b = _BREAK.match(text, k)
        if b or k >= n:
            pos = b.end() if b else n
            continue
        if least is None:
            least = max(k - pos, parent + 1)
        if k - pos < least or not least and _MARK.match(text, pos):
            return pos
        b = _BREAK.search(text, k)
        pos = b.end() if b else n
    return pos


def _flow(text: str, pos: int, out: list) -> int:
    """Tokens of a flow collection; lines do not matter inside, but whether it spans several does."""
    opened: list[tuple[int, int]] = []
    n, lines = len(text), 0
    while pos < n:
        ch = text[pos]
        if ch in " \t":
            pos += 1
            continue
        b = _BREAK.match(text, pos)
        if b:
            lines, pos = lines + 1, b.end()
            if _MARK.match(text, pos):
                raise Malformed("document marker inside a flow collection", pos)
            continue
        if ch == "#":
            pos = _end(text, pos)
            continue
        m = _FLOW.match(text, pos)
        kind = m.lastgroup if m else None
        if ch == ":" and text[pos - 1] in "'\"]}" and kind in (None, "word"):
            out.append((":", pos))  # right after a quoted scalar or a collection a colon needs no white space
            pos += 1
            continue
        if not m:
            raise Malformed("quoted scalar is not closed or has an unknown escape" if ch in "'\"" else f"unexpected {ch!r}", pos)
        at, pos = pos, m.end()
        if kind == "word":
            many = False
            while True:
                k = pos
                while k < n and (text[k] in " \t" or _BREAK.match(text, k)):
                    k += 1
                if k == pos or not _BREAK.search(text, pos, k):
                    break
                more = _MORE_FLOW.match(text, k)
                if not more or text[k] == "#" or _MARK.match(text, k) and _BREAK.match(text, k - 1):
                    break
                lines += 1
                pos, many = more.end(), True
            out.append(("TEXT" if many or pos - at > KEY else "WORD", at))
        elif kind in ("single", "double"):
            many = _broken(text, at, pos)
            lines += many
            out.append(("TEXT" if many or pos - at > KEY else "WORD", at))
        elif kind == "open":
            opened.append((lines, at))
            out.append((ch, at))
        elif kind == "close":
            was, begin = opened.pop()
            out.append((ch if was == lines and pos - begin <= KEY else "END" + ch, at))
            if not opened:
                return pos
        else:
            out.append((_KIND.get(kind, ch), at))
    raise Malformed("flow collection is not closed", n)


def check(content: bytes) -> tuple[int, str | None, int]:
    """(1 if it is a YAML stream, what is wrong, line). UTF-8, or UTF-16 with a byte order mark."""
    try:
        text = content.decode("utf-16" if content[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8")
    except UnicodeDecodeError as x:
        return 0, "not UTF-8", content.count(b"\n", 0, x.start) + 1
    lines = Lines(text)
    bad = _BAD.search(text, 1 if text.startswith("﻿") else 0)
    if bad:
        return 0, "control character", lines.at(bad.start())[0]
    g = grammar()
    try:
        toks = tokens(text)
    except Malformed as x:
        return 0, str(x), lines.at(min(x.at, max(len(text) - 1, 0)))[0]
    ok, far = g.parse([g.terminals[k] for k, _ in toks])
    if ok:
        return ok, None, 0
    at = toks[far][1] if far < len(toks) else len(text)
    return 0, "unexpected end of file" if at >= len(text) else f"unexpected {text[at : at + 20]!r}", lines.at(min(at, max(len(text) - 1, 0)))[0]
