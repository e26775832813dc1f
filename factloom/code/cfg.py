"""Control flow of one function body: a graph over its statements.

A node is the offset of a statement; ENTRY and EXIT are negative. Calls of exit, return and throw lead to EXIT, a statement
of a try block also to each of its handlers, and what leaves a try block runs its finally block first. A scope with goto is
marked as unsupported; its graph has no edge for the jump.
"""

from __future__ import annotations

from factloom.code.phpast import Node

ENTRY, EXIT = -2, -1


def build(stmts: list) -> dict:
    """{blocks: node -> (kind, variables written whole), edges, unsupported} of the statements, inner functions and classes left out."""
    return _Graph().of(stmts)


class _Graph:
    def __init__(self):
        self.blocks: dict[int, tuple[str, list[str]]] = {ENTRY: ("entry", []), EXIT: ("exit", [])}
        self.edges: dict[tuple[int, int], None] = {}
        self.unsupported: dict[str, None] = {}
        self.loops: list[tuple[set, int | set]] = []
        self.handlers: list[list[int]] = []

    def of(self, stmts: list) -> dict:
        for a in self.many(stmts, {ENTRY}):
            self.edges[(a, EXIT)] = None
        return {"blocks": self.blocks, "edges": list(self.edges), "unsupported": list(self.unsupported)}

    def many(self, stmts, ins: set) -> set:
        for s in stmts:
            if s is not None:
                ins = self.one(s, ins)
        return ins

    def block(self, s: Node, kind: str, ins: set, at: int | None = None) -> int:
        n = s.start if at is None else at
        self.blocks[n] = (kind, _written(s) if kind in ("expr", "foreach", "static") else [])
        for a in ins:
            self.edges[(a, n)] = None
        for held in self.handlers:
            held.append(n)
        return n

    def one(self, s: Node, ins: set) -> set:
        k = s.kind
        if k in ("block", "namespace"):
            return self.many(s.kids, ins)
        if k in ("function", "class", "use", "const"):
            return ins
        if k == "if":
            cond, then, other = s.kids
            n = self.block(s, "if", ins)
            out = self.many([then], {n})
            return out | (self.many([other], {n}) if other is not None else {n})
        if k in ("while", "for", "foreach"):
            n = self.block(s, k, ins)
            breaks: set = set()
            self.loops.append((breaks, n))
            for a in self.many([s.kids[-1]], {n}):
                self.edges[(a, n)] = None
            self.loops.pop()
            cond = s.kids[0] if k == "while" else None
            endless = k == "for" and not s.kids[1].kids or cond is not None and cond.kind in ("name", "num") and cond.value.lower() in ("true", "1")
            return breaks if endless else breaks | {n}
        if k == "do":
            first = self.block(s, "do", ins)
            breaks, again = set(), set()
            self.loops.append((breaks, again))
            outs = self.many([s.kids[0]], {first})
            self.loops.pop()
            n = self.block(s.kids[1], "while", outs | again)
            self.edges[(n, first)] = None
            return breaks | {n}
        if k == "switch":
            n = self.block(s, "switch", ins)
            breaks, fall, default = set(), set(), False
            self.loops.append((breaks, breaks))
            for c in s.kids[1:]:
                default |= c.kids[0] is None
                fall = self.many(c.kids[1:], fall | {n})
            self.loops.pop()
            return breaks | fall if default else breaks | fall | {n}
        if k == "try":
            held: list[int] = []
            self.handlers.append(held)
            n = self.block(s, "try", ins)
            out = self.many([s.kids[0]], {n})
            self.handlers.pop()
            for c in s.kids[1:]:
                if c.kind == "catch":
                    out |= self.many([c.kids[1]], {self.block(c, "catch", set(held))})
                else:
                    left = self.many([c.kids[0]], {self.block(c, "finally", out | set(held), c.start)})
                    out = left if out else set()
            return out
        if k in ("break", "continue"):
            depth = int(s.kids[0].value) if s.kids[0] is not None and s.kids[0].kind == "num" and s.kids[0].value.isdigit() else 1
            n = self.block(s, k, ins)
            if len(self.loops) >= depth > 0:
                breaks, again = self.loops[-depth]
                if k == "break" or isinstance(again, set):
                    (breaks if k == "break" else again).add(n)
                else:
                    self.edges[(n, again)] = None
            return set()
        e = s.kids[0] if k == "expr" else None
        if k == "return" or e is not None and (e.kind == "exit" or e.kind == "unary" and e.value == "throw"):
            n = self.block(s, "return" if k == "return" else "throw" if e.kind == "unary" else "exit", ins)
            self.edges[(n, EXIT)] = None
            return set()
        if k == "goto":
            self.unsupported["goto"] = None
        return {self.block(s, k, ins)}


def _written(s: Node) -> list[str]:
    """Variables that a statement certainly writes whole."""
    if s.kind == "foreach":
        return []
    out, e = [], s.kids[0] if s.kids else None
    while e is not None and e.kind == "assign" and e.value in ("=", "=&"):
        if e.kids[0].kind == "var":
            out.append(e.kids[0].value)
        e = e.kids[1]
    return out
