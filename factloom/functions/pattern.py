"""Metavariable patterns over code text, compiled to regular expressions, and message templates.

``$UPPER`` stands for any balanced-free piece of an expression and must be the same text each time it occurs; ``...``
stands for any arguments. Other text matches itself, with free white space around punctuation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PIECE = re.compile(r"\$[A-Z][A-Z0-9_]*|\.\.\.|\w+|\s+|.", re.S)


def compile_pattern(pattern: str) -> tuple[str, list[str]]:
    """(regular expression, metavariables in order of their groups)."""
    out, names = [], []
    for x in _PIECE.findall(pattern.strip()):
        if x == "...":
            out.append(r"(?s:.*?)")
        elif re.fullmatch(r"\$[A-Z][A-Z0-9_]*", x):
            if x in names:
                out.append(rf"\{names.index(x) + 1}")
            else:
                names.append(x)
                out.append(r"([^,;()]+?(?:\([^()]*\))?)")
        elif x.isspace():
            out.append(r"\s+")
        elif x.isalnum() or x == "_" or re.fullmatch(r"\w+", x):
            out.append(x)
        else:
            out.append(rf"\s*{re.escape(x)}\s*")
    text = "".join(out)
    return re.sub(r"(?:\\s[*+]){2,}", r"\\s*", text), names


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(compile_pattern(pattern)[0])


def bindings(text: Column, pattern: str) -> Column:
    """map of metavariable to its text, null where the pattern does not match."""
    rx, names = compile_pattern(pattern)
    pairs = [x for i, n in enumerate(names) for x in (F.lit(n), F.trim(F.regexp_extract(text, rx, i + 1)))]
    return F.when(text.rlike(rx), F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>"))


def message(template: Column, bound: Column) -> Column:
    """The template with each metavariable replaced by its text, longer names first."""
    entries = F.array_sort(F.map_entries(bound), lambda a, b: F.length(b["key"]) - F.length(a["key"]))
    return F.aggregate(entries, template, lambda m, e: F.replace(m, e["key"], e["value"]))
