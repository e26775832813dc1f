"""Tokens of a PHP source text.

Works on bytes read as Latin-1, so any byte sequence is lexed and offsets are byte offsets. Inline HTML is one token, a
closing tag is a semicolon, ``<?=`` an echo. Strings without ``{$`` or ``${`` are one token; the others are a start, the
tokens of each part, and an end.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

#: Reserved words of PHP 8.1; each is a token kind of its own (fixed values of the language).
KEYWORDS = frozenset(
    "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile enum eval exit extends final "
    "finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require "
    "require_once return static switch throw trait try unset use var while xor yield".split()
)
CASTS = frozenset("int integer bool boolean float double string array object binary".split())
_OLD_CASTS = frozenset(("real", "unset"))
_NAME = r"[A-Za-z_\x80-\xff][\w\x80-\xff]*"
_SPACE = r"[ \t\r\n\x0b\x0c]"
_COMMENT = r"/\*.*?\*/|(?://|\#(?!\[))(?:(?!\?>)[^\r\n])*+"
_TOKENS = rf"""(?P<punct>[;,{{}}\[\])]|->|::|=>|\((?!{_SPACE}*+[A-Za-z]+[ \t]*\)))
|(?P<comment>{_COMMENT})
|(?P<badcomment>/\*)
|(?P<close>\?>(?:\r\n|\n|\r)?)
|(?P<var>\${_NAME})
|(?P<word>(?:namespace\\|\\)?{_NAME}(?:\\{_NAME})*\\?)
|(?P<num>0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*|0[bB][01]+(?:_[01]+)*|0[oO][0-7]+(?:_[0-7]+)*|(?:\d+(?:_\d+)*)?\.\d+(?:_\d+)*(?:[eE][+-]?\d+(?:_\d+)*)?|\d+(?:_\d+)*\.?(?:[eE][+-]?\d+(?:_\d+)*)?)
|(?P<single>[bB]?'(?:[^'\\]|\\.)*')
|(?P<heredoc>[bB]?<<<[ \t]*(?:"(?P<h1>{_NAME})"|'(?P<h2>{_NAME})'|(?P<h3>{_NAME}))(?:\r\n|\n|\r))
|(?P<double>[bB]?["`])
|(?P<cast>\([ \t]*(?P<castname>[A-Za-z]+)[ \t]*\))
|(?P<op>\?->|\.\.\.|<=>|\*\*=|\?\?=|<<=|>>=|===|!==|\#\[|->|=>|::|\+\+|--|\*\*|\?\?|<<|>>|==|!=|<>|<=|>=|&&|\|\||\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|[-+*/%=<>!.,;:?()\[\]{{}}&|^~@$])
|(?P<end>\Z)
"""
#: White space, and comments that nobody wants, go with the token that follows.
_CODE = re.compile(rf"(?:{_SPACE}++|{_COMMENT})*+(?:{_TOKENS})", re.S | re.X)
_CODE_COMMENTS = re.compile(rf"{_SPACE}*+(?:{_TOKENS})", re.S | re.X)
_OPEN = re.compile(r"<\?(?:php(?:[ \t]|\r\n|\n|\r|\Z)|=)", re.I)
_VAR_IN_TEXT = re.compile(rf"\${_NAME}(?:\[(?:(?:{_NAME}|-?\d+|\${_NAME})\])?|->{_NAME}|\?->{_NAME})?")
_HALT = re.compile(r"\s*\(\s*\)\s*(?:;|\?>)", re.S)
BINARY = {"*", "/", "%", "+", "<<", ">>", ".", "<", "<=", ">", ">=", "==", "!=", "<>", "===", "!==", "<=>", "^", "|", "&&", "||", "??", "**"}
ASSIGN = {"+=", "-=", "*=", "/=", ".=", "%=", "&=", "|=", "^=", "<<=", ">>=", "**=", "??="}


class Token(NamedTuple):
    kind: str
    start: int
    end: int


class LexError(ValueError):
    def __init__(self, what: str, at: int):
        super().__init__(what)
        self.at = at


class Lines:
    """1-based line and column of offsets; a line ends with LF, CR LF or a lone CR."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer(r"\r\n|\n|\r", text))]

    def at(self, offset: int) -> tuple[int, int]:
        k = bisect_right(self.starts, offset)
        return k, offset - self.starts[k - 1] + 1


def has_open_tag(text: str) -> bool:
    return _OPEN.search(text) is not None


def tokens(text: str, comments: bool = False) -> list[Token]:
    """All tokens; raises LexError where the text ends inside a string, heredoc, comment or tag, or holds a stray byte."""
    out: list[Token] = []
    _html(text, 0, out, comments)
    return out


def _html(text: str, pos: int, out: list[Token], comments: bool) -> None:
    while pos < len(text):
        m = _OPEN.search(text, pos)
        if not m:
            out.append(Token("html", pos, len(text)))
            return
        if m.start() > pos:
            out.append(Token("html", pos, m.start()))
        if m[0].endswith("="):
            out.append(Token("echo", m.start(), m.end()))
        pos = _code(text, m.end(), out, False, comments)


def _code(text: str, pos: int, out: list[Token], inner: bool, comments: bool) -> int:
    """Tokens up to a closing tag, the end of the text, or (``inner``) the brace that ends a part of a string."""
    depth, match, n = 0, (_CODE_COMMENTS if comments else _CODE).match, len(text)
    add = out.append
    while pos < n:
        m = match(text, pos)
        if not m:
            raise LexError("unexpected character", _skipped(text, pos, comments))
        kind = m.lastgroup
        start, pos = m.span(kind)
        if kind == "var":
            add(Token("VAR", start, pos))
        elif kind == "punct" or kind == "op":
            x = m[kind]
            if x == "{":
                depth += 1
            elif x == "}":
                if inner and not depth:
                    add(Token("}", start, pos))
                    return pos
                depth -= 1
            add(Token(x, start, pos))
        elif kind == "word":
            pos = _word(text, m, out)
            if pos < 0:
                return n
        elif kind == "comment":
            add(Token("comment", start, pos))
        elif kind == "end":
            break
        elif kind == "num":
            out.append(Token("NUM", start, pos))
        elif kind == "single":
            out.append(Token("STR", start, pos))
        elif kind == "cast":
            name = m["castname"].lower()
            if name in CASTS or name in _OLD_CASTS:
                out.append(Token("CAST" if name in CASTS else "OLDCAST", start, pos))
            else:
                out.append(Token("(", start, start + 1))
                pos = start + 1
        elif kind == "double":
            pos = _encapsed(text, pos, text[pos - 1], out, start, comments)
        elif kind == "heredoc":
            pos = _heredoc(text, m, out, start, comments)
        elif kind == "close":
            if inner:
                raise LexError("closing tag inside a string", start)
            out.append(Token(";", start, start + 2))
            return pos
        else:
            raise LexError("comment is not closed", start)
    if inner:
        raise LexError("string is not closed", pos)
    return pos


def _skipped(text: str, pos: int, comments: bool) -> int:
    return re.compile(rf"{_SPACE}*+" if comments else rf"(?:{_SPACE}++|{_COMMENT})*+", re.S).match(text, pos).end()


def _word(text: str, m: re.Match, out: list[Token]) -> int:
    word = m["word"]
    start, end = m.span("word")
    last = out[-1].kind if out else ""
    if "\\" in word:
        out.append(Token("GROUP" if word.endswith("\\") else "QNAME", start, end))
        return end
    low = word.lower()
    if last in ("->", "?->", "::"):
        out.append(Token("NAME", start, end))
    elif low == "__halt_compiler":
        h = _HALT.match(text, end)
        if not h:
            raise LexError("__halt_compiler needs ();", end)
        out.append(Token("HALT", start, h.end()))
        return -1
    elif low == "die":
        out.append(Token("exit", start, end))
    elif low == "enum" and not re.compile(rf"\s+(?!(?:extends|implements)\b){_NAME}", re.I).match(text, end):
        out.append(Token("NAME", start, end))
    elif low == "yield" and (f := re.compile(r"\s+from\b", re.I).match(text, end)):
        out.append(Token("yield_from", start, f.end()))
        return f.end()
    else:
        out.append(Token(low if low in KEYWORDS else "NAME", start, end))
    return end


def _part(text: str, pos: int, out: list[Token], comments: bool) -> int:
    """A ``{$`` or ``${`` part that begins at ``pos``."""
    out.append(Token("PART", pos, pos + (1 if text[pos] == "{" else 2)))
    return _code(text, out[-1].end, out, True, comments)


def _encapsed(text: str, pos: int, quote: str, out: list[Token], start: int, comments: bool) -> int:
    """The rest of a double-quoted or backtick string."""
    stop = re.compile(rf'[^{quote}\\${{]+|\\.|\{{\$|\$\{{|\$|\{{|{quote}', re.S)
    parts = False
    while True:
        m = stop.match(text, pos)
        if not m:
            raise LexError("string is not closed", start)
        x = m[0]
        if x == quote:
            if parts:
                out.append(Token("ENC_END", pos, pos + 1))
            else:
                out.append(Token("STR", start, pos + 1))
            return pos + 1
        if x in ("{$", "${"):
            if not parts:
                out.append(Token("ENC", start, pos))
                parts = True
            pos = _part(text, pos, out, comments)
        elif x == "$":
            pos = _plain_var(text, pos)
        else:
            pos = m.end()


def _plain_var(text: str, pos: int) -> int:
    v = _VAR_IN_TEXT.match(text, pos)
    if not v:
        return pos + 1
    if v[0].endswith("["):
        raise LexError("index of a variable in a string", pos)
    return v.end()


def _heredoc(text: str, m: re.Match, out: list[Token], start: int, comments: bool) -> int:
    label, raw = m["h1"] or m["h2"] or m["h3"], bool(m["h2"])
    # The closing label is the first on a line of its own, after white space, not followed by a name character.
    end = re.compile(rf"(?:(?<=\n)|(?<=\r))([ \t]*){label}(?![\w\x80-\xff])")
    pos, parts = m.end(), False
    if raw:
        e = end.search(text, pos)
        if not e:
            raise LexError("heredoc is not closed", start)
        _indent(text, m.end(), e)
        out.append(Token("STR", start, e.end()))
        return e.end()
    stop = re.compile(r"\\.|\{\$|\$\{|\$", re.S)
    while True:
        e, s = end.search(text, pos), stop.search(text, pos)
        if not e:
            raise LexError("heredoc is not closed", start)
        if not s or s.start() >= e.start():
            if not parts:
                _indent(text, m.end(), e)
            out.append(Token("ENC_END" if parts else "STR", e.start() if parts else start, e.end()))
            return e.end()
        if s[0] in ("{$", "${"):
            if not parts:
                out.append(Token("ENC", start, s.start()))
                parts = True
            pos = _part(text, s.start(), out, comments)
        elif s[0] == "$":
            pos = _plain_var(text, s.start())
        else:
            pos = s.end()


def _indent(text: str, begin: int, end: re.Match) -> None:
    """Every line of the body that is not blank is indented at least as far as the closing label."""
    if end[1]:
        for line in re.split(r"\r\n|\n|\r", text[begin : end.start()]):
            if line.strip() and not line.startswith(end[1]):
                raise LexError("body of a heredoc is indented less than its end", begin)
