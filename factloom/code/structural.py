"""Structural match of code by patterns: trees are unified, so spelling and white space do not matter.

In a pattern ``$UPPER`` is a metavariable (the same tree wherever it occurs), ``...`` among arguments any number of
arguments, and function names match without letter case. Patterns are compiled once; texts are parsed in Arrow batches,
after the call table has been narrowed to the callees that a pattern can mean.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.code.phpast import Node, parse

_ELLIPSIS = "__ANY_ARGUMENTS__"
_META = re.compile(r"[A-Z][A-Z0-9_]*\Z")


def _expression(text: str) -> Node | None:
    tree, errors = parse(f"<?php {text.strip().rstrip(';')};")
    kids = [k for k in tree.kids if k is not None]
    return kids[0].kids[0] if not errors and len(kids) == 1 and kids[0].kind == "expr" else None


@lru_cache(maxsize=512)
def compile_pattern(pattern: str) -> Node:
    """Tree of a pattern; ValueError if it is no single expression."""
    node = _expression(re.sub(r"\.\.\.(?=\s*[,)\]])", f"${_ELLIPSIS}", pattern))
    if node is None:
        raise ValueError(f"pattern is no expression: {pattern!r}")
    return node


def callees(pattern: str) -> list[str]:
    """Function names that the pattern's outermost call can have; empty if any."""
    n = compile_pattern(pattern)
    head = n.kids[0] if n.kind == "call" else None
    return [head.value.lstrip("\\").lower()] if head is not None and head.kind == "name" and not _META.match(head.value) else []


def _bare(n: Node | None) -> Node | None:
    while n is not None and n.kind == "paren":
        n = n.kids[0]
    return n


def _key(n: Node | None) -> tuple:
    """A tree as a value that is equal for equal code."""
    n = _bare(n)
    if n is None:
        return ()
    value = n.value if not isinstance(n.value, dict) else tuple(sorted((k, str(v)) for k, v in n.value.items()))
    if n.kind == "name":
        value = value.lstrip("\\").lower()
    elif n.kind == "str" and len(value) > 1 and "\\" not in value and "$" not in value:
        value = value[1:-1]
    return (n.kind, value, *map(_key, n.kids))


def unify(p: Node | None, n: Node | None, bound: dict[str, tuple]) -> bool:
    p, n = _bare(p), _bare(n)
    if p is None or n is None:
        return p is n
    if p.kind == "var" and _META.match(p.value):
        k = _key(n)
        if bound.setdefault(p.value, (k, n))[0] != k:
            return False
        return True
    if p.kind == "var" and p.value == _ELLIPSIS:
        return True
    if p.kind == "call" and n.kind == "call":
        return p.value == n.value and unify(p.kids[0], n.kids[0], bound) and _arguments(p.kids[1:], n.kids[1:], bound)
    if p.kind != n.kind or _key(Node(p.kind, 0, 0, p.value)) != _key(Node(n.kind, 0, 0, n.value)) or len(p.kids) != len(n.kids):
        return False
    return all(unify(a, b, bound) for a, b in zip(p.kids, n.kids))


def _arguments(ps: list[Node], ns: list[Node], bound: dict) -> bool:
    if not ps:
        return not ns
    head = ps[0].kids[0]
    if head is not None and head.kind == "var" and head.value == _ELLIPSIS:
        for k in range(len(ns) + 1):
            trial = dict(bound)
            if _arguments(ps[1:], ns[k:], trial):
                bound.update(trial)
                return True
        return False
    return bool(ns) and ps[0].value == ns[0].value and unify(head, ns[0].kids[0], bound) and _arguments(ps[1:], ns[1:], bound)


def match(pattern: str, text: str | None) -> dict[str, str] | None:
    """Bindings ``$NAME`` -> code if the text is an expression that the pattern matches."""
    node = _expression(text) if text else None
    return None if node is None else match_tree(pattern, node, text)


def match_tree(pattern: str, node: Node, text: str) -> dict[str, str] | None:
    """As ``match``, for the tree of the text."""
    bound: dict[str, tuple] = {}
    if not unify(compile_pattern(pattern), node, bound):
        return None
    shift = len("<?php ")
    body = text.strip()
    return {f"${k}": body[n.start - shift : n.end - shift] for k, (_, n) in bound.items() if k != _ELLIPSIS}


def rule_callees(rule: dict) -> list[str]:
    """Function names of the calls that a rule can match; empty if any."""
    out = [callees(p) for p in rule["patterns"]]
    return [] if not all(out) else [n for o in out for n in o]


def rules_matched(text: Column, inside: Column, rules: list[dict]) -> Column:
    """array<struct<rule_id, bindings>> of the rules that match a call; the text is parsed once."""
    known = [(r["id"], rule_callees(r), r["patterns"], r.get("not", ()), frozenset(r.get("inside", ()))) for r in rules]

    def one(t: str | None, fn: str) -> list[dict]:
        node = _expression(t) if t else None
        if node is None:
            return []
        head = node.kids[0].value.lstrip("\\").lower() if node.kind == "call" and node.kids[0].kind == "name" else None
        out = []
        for rid, names, patterns, without, fns in known:
            if fns and fn not in fns or names and head not in names:
                continue
            got = next((b for b in (match_tree(p, node, t) for p in patterns) if b is not None), None)
            if got is not None and all(match_tree(p, node, t) is None for p in without):
                out.append({"rule_id": rid, "bindings": got})
        return out

    @F.pandas_udf("array<struct<rule_id:string,bindings:map<string,string>>>")
    def run(texts: pd.Series, fns: pd.Series) -> pd.Series:
        return pd.Series([one(t, f) for t, f in zip(texts, fns)], dtype=object)

    return run(text, inside)


def matched(text: Column, pattern: str) -> Column:
    """map of bindings, null where the pattern does not match."""
    compile_pattern(pattern)

    @F.pandas_udf("map<string,string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: match(pattern, t))

    return run(text)


def calls_matching(calls: DataFrame, pattern: str, without: tuple[str, ...] = ()) -> DataFrame:
    """Calls that the pattern matches and none of ``without`` does, with ``bindings``; only calls of fitting names are parsed."""
    names = callees(pattern)
    c = calls.where(F.col("callee").isin(*names)) if names else calls.where("how <> 'include'")
    c = c.withColumn("bindings", matched(F.col("text"), pattern)).where("bindings IS NOT NULL")
    for p in without:
        c = c.where(matched(F.col("text"), p).isNull())
    return c
