"""Syntax trees of PHP source: a precedence parser over the lexer's tokens that recovers at statement ends.

A node is (kind, start, end, value, kids): ``value`` holds a name, operator or literal, ``kids`` the child nodes (some
None). Offsets are byte offsets. The parser never fails: what it cannot read is skipped to the next statement and noted.
"""

from __future__ import annotations

from factloom.functions.phplex import ASSIGN, KEYWORDS, LexError, Token, tokens


class Node:
    __slots__ = ("end", "kids", "kind", "start", "value")

    def __init__(self, kind: str, start: int, end: int, value=None, kids=()):
        self.kind, self.start, self.end, self.value, self.kids = kind, start, end, value, list(kids)

    def walk(self):
        """The node and all below it, in source order, without recursion."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(k for k in reversed(n.kids) if k is not None)


class Unexpected(ValueError):
    def __init__(self, token: Token | None, at: int):
        super().__init__(f"unexpected {token.kind!r}" if token else "unexpected end of file")
        self.at = at


#: Binding power of the binary operators, loosest first (fixed values of the language).
_LEVELS = [("or",), ("xor",), ("and",), ("??",), ("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!=", "<>", "===", "!==", "<=>"), ("<", "<=", ">", ">="), (".",), ("<<", ">>"), ("+", "-"), ("*", "/", "%"), ("instanceof",), ("**",)]
POWER = {op: 10 + 2 * i for i, ops in enumerate(_LEVELS) for op in ops}
_TERNARY = 15
_UNARY = POWER["instanceof"] - 1
_RIGHT = {"??", "**"}
_MODS = {"public", "protected", "private", "static", "abstract", "final", "readonly", "var"}
DEEPEST = 400


class Parser:
    def __init__(self, text: str):
        self.text, self.errors, self.i, self.depth = text, [], 0, 0
        try:
            self.toks = tokens(text)
        except LexError as x:
            self.errors.append((str(x), x.at))
            self.toks = self._prefix(x.at)
        self.n = len(self.toks)

    def _prefix(self, at: int) -> list[Token]:
        """Tokens before the place where the text cannot be lexed on."""
        try:
            return tokens(self.text[:at])
        except LexError:
            return []

    # -- tokens --
    def kind(self, k: int = 0) -> str:
        return self.toks[self.i + k].kind if self.i + k < self.n else ""

    def take(self) -> Token:
        if self.i >= self.n:
            raise Unexpected(None, len(self.text))
        self.i += 1
        return self.toks[self.i - 1]

    def want(self, kind: str) -> Token:
        t = self.toks[self.i] if self.i < self.n else None
        if t is None or t.kind != kind:
            raise Unexpected(t, t.start if t else len(self.text))
        self.i += 1
        return t

    def have(self, *kinds: str) -> bool:
        if self.kind() in kinds:
            self.i += 1
            return True
        return False

    def src(self, t) -> str:
        return self.text[t.start : t.end]

    def last(self) -> int:
        return self.toks[self.i - 1].end if self.i else 0

    def here(self) -> int:
        return self.toks[self.i].start if self.i < self.n else len(self.text)

    # -- statements --
    def file(self) -> Node:
        return Node("file", 0, len(self.text), None, self.statements(()))

    def statements(self, until: tuple[str, ...]) -> list[Node]:
        out = []
        while self.i < self.n and self.kind() not in until:
            at = self.i
            try:
                s = self.statement()
                if s is not None:
                    out.append(s)
            except (Unexpected, RecursionError) as x:
                self.errors.append((str(x), getattr(x, "at", self.here())))
                self.depth = 0
                if self.i == at:
                    self.i += 1
                while self.i < self.n and self.kind() not in (";", "}", "{") and self.kind() not in until:
                    self.i += 1
                if self.kind() == ";" or not until and self.kind() == "}":
                    self.i += 1
        return out

    def block(self) -> Node:
        start = self.want("{").start
        body = self.statements(("}",))
        end = self.want("}").end
        return Node("block", start, end, None, body)

    def body(self, *ends: str) -> Node:
        """A statement, or the alternative form ``: ... endX;``."""
        if self.have(":"):
            start = self.here()
            kids = self.statements(ends)
            return Node("block", start, self.last(), "alt", kids)
        s = self.statement()
        return s if s is not None else Node("block", self.last(), self.last())

    def _close(self, body: Node, end: str) -> None:
        if body.value == "alt":
            self.want(end)
            self.semi()

    def semi(self) -> None:
        if self.i < self.n:
            self.want(";")

    def statement(self) -> Node | None:
        k, start = self.kind(), self.here()
        if k == "{":
            return self.block()
        if k in (";", "html"):
            self.i += 1
            return None
        while k == "#[":
            self.attribute()
            k = self.kind()
        f = getattr(self, "_" + k, None) if k in KEYWORDS or k == "HALT" else None
        if k in ("abstract", "final", "readonly", "class", "interface", "trait", "enum"):
            return self.classdecl()
        if k == "function" and (self.kind(1) in ("NAME", "enum", "match", "readonly") or self.kind(1) == "&" and self.kind(2) == "NAME"):
            return self.function("function")
        if k == "static" and self.kind(1) == "VAR":
            self.i += 1
            kids = []
            while True:
                v = self.take()
                var = Node("var", v.start, v.end, self.src(v)[1:])
                kids.append(Node("assign", v.start, v.end, "=", [var, self.expr()]) if self.have("=") else var)
                if not self.have(","):
                    break
            self.semi()
            return Node("static", start, self.last(), None, kids)
        if k == "NAME" and self.kind(1) == ":":
            self.i += 2
            return None
        if f:
            return f(start)
        e = self.expr()
        self.semi()
        return Node("expr", start, self.last(), None, [e])

    def attribute(self) -> None:
        depth = 0
        while True:
            t = self.take()
            depth += (t.kind in ("[", "#[")) - (t.kind == "]")
            if not depth:
                return

    def paren(self) -> Node:
        self.want("(")
        e = self.expr()
        self.want(")")
        return e

    def _if(self, start: int) -> Node:
        self.i += 1
        cond = self.paren()
        then = self.body("elseif", "else", "endif")
        other = None
        if self.kind() == "elseif":
            other = self._if(self.here())
            return Node("if", start, self.last(), None, [cond, then, other])
        if self.kind() == "else":
            self.i += 1
            if then.value == "alt" and self.kind() == "if":
                other = self.statement()
            else:
                other = self.body("endif")
        if then.value == "alt" and (other is None or other.value == "alt"):
            self.want("endif")
            self.semi()
        return Node("if", start, self.last(), None, [cond, then, other])

    def _while(self, start: int) -> Node:
        self.i += 1
        cond = self.paren()
        body = self.body("endwhile")
        self._close(body, "endwhile")
        return Node("while", start, self.last(), None, [cond, body])

    def _do(self, start: int) -> Node:
        self.i += 1
        body = self.body()
        self.want("while")
        cond = self.paren()
        self.semi()
        return Node("do", start, self.last(), None, [body, cond])

    def _for(self, start: int) -> Node:
        self.i += 1
        self.want("(")
        parts = []
        for end in (";", ";", ")"):
            at, es = self.here(), []
            while self.kind() != end:
                es.append(self.expr())
                if not self.have(","):
                    break
            self.want(end)
            parts.append(Node("list", at, self.last(), None, es))
        body = self.body("endfor")
        self._close(body, "endfor")
        return Node("for", start, self.last(), None, [*parts, body])

    def _foreach(self, start: int) -> Node:
        self.i += 1
        self.want("(")
        over = self.expr()
        self.want("as")
        key, ref = None, self.have("&")
        value = self.expr()
        if self.have("=>"):
            key, ref = value, self.have("&")
            value = self.expr()
        self.want(")")
        body = self.body("endforeach")
        self._close(body, "endforeach")
        return Node("foreach", start, self.last(), "&" if ref else None, [over, key, value, body])

    def _switch(self, start: int) -> Node:
        self.i += 1
        cond = self.paren()
        end = "}" if self.have("{") else "endswitch"
        if end == "endswitch":
            self.want(":")
        self.have(";")
        cases = []
        while self.kind() in ("case", "default"):
            at = self.here()
            test = self.expr() if self.take().kind == "case" else None
            if not self.have(":", ";"):
                self.want(":")
            cases.append(Node("case", at, self.last(), None, [test, *self.statements(("case", "default", end))]))
        self.want(end)
        if end == "endswitch":
            self.semi()
        return Node("switch", start, self.last(), None, [cond, *cases])

    def _jump(self, start: int) -> Node:
        k = self.take().kind
        e = None if self.kind() in (";", "") else self.expr()
        self.semi()
        return Node(k, start, self.last(), None, [e])

    _return = _break = _continue = _jump

    def _echo(self, start: int) -> Node:
        self.i += 1
        kids = self.comma(";")
        self.semi()
        return Node("echo", start, self.last(), None, kids)

    def comma(self, end: str) -> list[Node]:
        out = []
        while self.kind() != end:
            out.append(self.expr())
            if not self.have(","):
                break
        return out

    def _global(self, start: int) -> Node:
        self.i += 1
        kids = self.comma(";")
        self.semi()
        return Node("global", start, self.last(), None, kids)

    def _unset(self, start: int) -> Node:
        self.i += 1
        self.want("(")
        kids = self.comma(")")
        self.want(")")
        self.semi()
        return Node("unset", start, self.last(), None, kids)

    def _try(self, start: int) -> Node:
        self.i += 1
        kids = [self.block()]
        while self.kind() == "catch":
            at = self.take().start
            self.want("(")
            while self.kind() not in ("VAR", ")"):
                self.take()
            var = Node("var", self.here(), self.here(), self.src(self.take())[1:]) if self.kind() == "VAR" else None
            self.want(")")
            kids.append(Node("catch", at, 0, None, [var, self.block()]))
            kids[-1].end = self.last()
        if self.have("finally"):
            kids.append(Node("finally", self.last(), 0, None, [self.block()]))
            kids[-1].end = self.last()
        return Node("try", start, self.last(), None, kids)

    def _declare(self, start: int) -> Node | None:
        self.i += 1
        self.want("(")
        while not self.have(")"):
            self.take()
        if self.have(";") or self.i >= self.n:
            return None
        body = self.body("enddeclare")
        self._close(body, "enddeclare")
        return body

    def _goto(self, start: int) -> Node:
        self.i += 2
        self.semi()
        return Node("goto", start, self.last())

    def _HALT(self, start: int) -> None:  # noqa: N802
        self.i = self.n

    def _namespace(self, start: int) -> Node:
        self.i += 1
        name = self.src(self.take()) if self.kind() not in ("{", ";") else ""
        if self.kind() == "{":
            b = self.block()
            return Node("namespace", start, b.end, name, b.kids)
        self.semi()
        return Node("namespace", start, self.last(), name)

    def _use(self, start: int) -> Node:
        self.i += 1
        what = self.take().kind if self.kind() in ("function", "const") else "class"
        kids, prefix = [], ""
        if self.kind() == "GROUP":
            prefix = self.src(self.take())
            self.want("{")
        while True:
            kind = self.take().kind if self.kind() in ("function", "const") else what
            t = self.take()
            full = (prefix + self.src(t)).lstrip("\\")
            alias = self.src(self.take()) if self.have("as") else full.rsplit("\\", 1)[-1]
            kids.append(Node("import", t.start, self.last(), (kind, full, alias)))
            if not self.have(",") or self.kind() == "}":
                break
        if prefix:
            self.want("}")
        self.semi()
        return Node("use", start, self.last(), None, kids)

    def _const(self, start: int) -> Node:
        self.i += 1
        kids = []
        while True:
            name = self.src(self.take())
            self.want("=")
            kids.append(Node("constant", start, self.last(), name, [self.expr()]))
            if not self.have(","):
                break
        self.semi()
        return Node("const", start, self.last(), None, kids)

    # -- declarations --
    def type(self) -> str:
        """The text of a type, empty if there is none."""
        start, end = self.here(), self.here()
        depth = 0
        while self.kind() in ("?", "NAME", "QNAME", "array", "callable", "static", "|", "(", ")", "enum") or self.kind() == "&" and self.kind(1) not in ("VAR", "..."):
            if self.kind() == ")" and not depth:
                break
            depth += (self.kind() == "(") - (self.kind() == ")")
            end = self.take().end
        return self.text[start:end]

    def params(self) -> list[Node]:
        self.want("(")
        out = []
        while self.kind() != ")":
            while self.kind() == "#[":
                self.attribute()
            start, mods = self.here(), []
            while self.kind() in _MODS and self.kind() != "static":
                mods.append(self.take().kind)
            hint = self.type()
            ref = self.have("&")
            many = self.have("...")
            v = self.want("VAR")
            default = self.expr() if self.have("=") else None
            out.append(Node("param", start, self.last(), {"name": self.src(v)[1:], "type": hint, "mods": mods, "ref": ref, "many": many}, [default]))
            if not self.have(","):
                break
        self.want(")")
        return out

    def function(self, kind: str, mods=()) -> Node:
        start = self.want("function").start
        ref = self.have("&")
        t = self.take()
        params = self.params()
        hint = self.type() if self.have(":") else ""
        body = self.block() if self.kind() == "{" else self.semi()
        return Node(kind, start, self.last(), {"name": self.src(t), "mods": list(mods), "ref": ref, "type": hint}, [*params, body])

    def names(self) -> list[str]:
        out = [self.src(self.take())]
        while self.have(","):
            out.append(self.src(self.take()))
        return out

    def classdecl(self) -> Node:
        start, mods = self.here(), []
        while self.kind() in ("abstract", "final", "readonly"):
            mods.append(self.take().kind)
        kind = self.take().kind
        if kind not in ("class", "interface", "trait", "enum"):
            raise Unexpected(self.toks[self.i - 1], self.toks[self.i - 1].start)
        return self.classrest(start, kind, mods, self.src(self.take()))

    def classrest(self, start: int, kind: str, mods: list[str], name: str) -> Node:
        parents, faces = [], []
        if self.have(":"):
            self.type()
        if self.have("extends"):
            parents = self.names()
        if self.have("implements"):
            faces = self.names()
        self.want("{")
        kids = []
        while self.kind() != "}":
            try:
                kids += self.member()
            except Unexpected as x:
                self.errors.append((str(x), x.at))
                while self.i < self.n and self.kind() not in (";", "}", "function", "public", "protected", "private"):
                    self.i += 1
                if self.i >= self.n:
                    break
                self.have(";")
        self.have("}")
        return Node("class", start, self.last(), {"kind": kind, "name": name, "mods": mods, "parents": parents, "interfaces": faces}, kids)

    def member(self) -> list[Node]:
        while self.kind() == "#[":
            self.attribute()
        start, mods = self.here(), []
        while self.kind() in _MODS:
            mods.append(self.take().kind)
        k = self.kind()
        if k == "function":
            return [self.function("method", mods)]
        if k == "use":
            self.i += 1
            names, adapted = self.names(), False
            if self.have("{"):
                adapted = self.kind() != "}"
                while not self.have("}"):
                    self.take()
            else:
                self.semi()
            return [Node("traits", start, self.last(), (names, adapted))]
        if k == "const":
            c = self._const(start)
            return c.kids
        if k == "case":
            self.i += 1
            name = self.src(self.take())
            value = self.expr() if self.have("=") else None
            self.semi()
            return [Node("constant", start, self.last(), name, [value])]
        hint, out = self.type(), []
        while True:
            v = self.want("VAR")
            out.append(Node("property", v.start, v.end, {"name": self.src(v)[1:], "type": hint, "mods": mods}, [self.expr() if self.have("=") else None]))
            if not self.have(","):
                break
        self.semi()
        return out

    # -- expressions --
    def expr(self, power: int = 0) -> Node:
        self.depth += 1
        if self.depth > DEEPEST:
            raise Unexpected(self.toks[self.i] if self.i < self.n else None, self.here())
        left = self.unary()
        while True:
            op = self.kind()
            p = POWER.get(op, 0)
            if op == "?" and power <= _TERNARY:
                self.i += 1
                then = None if self.kind() == ":" else self.expr()
                self.want(":")
                left = Node("ternary", left.start, 0, None, [left, then, self.expr(_TERNARY + 1)])
                left.end = self.last()
                continue
            if not p or p < power:
                self.depth -= 1
                return left
            self.i += 1
            right = self.expr(p if op in _RIGHT else p + 1)
            left = Node("binary", left.start, right.end, op, [left, right])

    def unary(self) -> Node:
        k, start = self.kind(), self.here()
        if k in ("!", "~", "+", "-", "@", "&", "clone", "print", "yield_from", "throw"):
            self.i += 1
            e = self.expr(0 if k in ("print", "throw", "yield_from") else _UNARY if k != "!" else POWER["instanceof"])
            return Node("unary", start, e.end, k, [e])
        if k in ("++", "--"):
            self.i += 1
            e = self.unary()
            return Node("step", start, e.end, k, [e])
        if k in ("CAST", "OLDCAST"):
            c = self.src(self.take()).strip("() \t").lower()
            e = self.unary()
            return Node("cast", start, e.end, c, [e])
        if k in ("include", "include_once", "require", "require_once"):
            self.i += 1
            e = self.expr()
            return Node("include", start, e.end, k, [e])
        if k == "yield":
            self.i += 1
            kids = []
            if self.kind() not in (";", ")", "]", ",", ""):
                kids.append(self.expr())
                if self.have("=>"):
                    kids.append(self.expr())
            return Node("yield", start, self.last(), None, kids)
        while k == "#[":
            self.attribute()
            k = self.kind()
        static = k == "static" and self.kind(1) in ("function", "fn")
        if static:
            self.i += 1
            k = self.kind()
        if k in ("function", "fn"):
            self.i += 1
            self.have("&")
            params, uses = self.params(), []
            if self.have("use"):
                self.want("(")
                while self.kind() != ")":
                    ref = self.have("&")
                    uses.append((self.src(self.want("VAR"))[1:], ref))
                    if not self.have(","):
                        break
                self.want(")")
            hint = self.type() if self.have(":") else ""
            if k == "fn":
                self.want("=>")
                e = self.expr()
                body = Node("return", e.start, e.end, None, [e])
            else:
                body = self.block()
            return Node("closure", start, self.last(), {"name": "", "mods": [], "type": hint, "uses": uses, "fn": k == "fn"}, [*params, body])
        return self.postfix(self.primary())

    def primary(self) -> Node:
        t = self.take()
        k = t.kind
        if k == "VAR":
            return Node("var", t.start, t.end, self.src(t)[1:])
        if k in ("NUM", "STR"):
            return Node("num" if k == "NUM" else "str", t.start, t.end, self.src(t))
        if k in ("NAME", "QNAME", "static", "enum", "readonly"):
            return Node("name", t.start, t.end, self.src(t))
        if k == "ENC":
            kids = []
            while not self.have("ENC_END"):
                self.want("PART")
                kids.append(self.expr())
                self.want("}")
            return Node("interpolated", t.start, self.last(), self.text[t.start : self.last()], kids)
        if k == "(":
            e = self.expr()
            self.want(")")
            return Node("paren", t.start, self.last(), None, [e])
        if k == "[":
            return self.items(t.start, "]")
        if k in ("array", "list") and self.kind() == "(":
            self.i += 1
            return self.items(t.start, ")")
        if k == "$":
            if self.have("{"):
                e = self.expr()
                self.want("}")
            else:
                e = self.primary()
            return Node("varvar", t.start, self.last(), None, [e])
        if k == "new":
            return self.new(t.start)
        if k in ("isset", "empty", "eval", "exit"):
            kids = []
            if self.have("("):
                kids = self.comma(")")
                self.want(")")
            return Node("call" if k == "eval" else k, t.start, self.last(), "function", [Node("name", t.start, t.end, k), *[Node("arg", a.start, a.end, None, [a]) for a in kids]] if k == "eval" else kids)
        if k == "match" and self.kind() == "(":
            subject = self.paren()
            self.want("{")
            arms = []
            while self.kind() != "}":
                tests = [] if self.have("default") else self.comma("=>")
                self.have(",")
                self.want("=>")
                value = self.expr()
                arms.append(Node("arm", value.start, value.end, None, [value, *tests]))
                if not self.have(","):
                    break
            self.want("}")
            return Node("match", t.start, self.last(), None, [subject, *arms])
        self.i -= 1
        raise Unexpected(t, t.start)

    def items(self, start: int, end: str) -> Node:
        kids = []
        while self.kind() != end:
            if self.kind() == ",":
                self.i += 1
                kids.append(None)
                continue
            at = self.here()
            spread, ref, key = self.have("..."), self.have("&"), None
            value = self.expr()
            if self.have("=>"):
                key, ref = value, self.have("&")
                value = self.expr()
            kids.append(Node("item", at, self.last(), "..." if spread else "&" if ref else None, [key, value]))
            if not self.have(","):
                break
        self.want(end)
        return Node("array", start, self.last(), None, kids)

    def args(self) -> list[Node]:
        self.want("(")
        out = []
        while self.kind() != ")":
            at = self.here()
            if self.kind() == "..." and self.kind(1) == ")":
                self.i += 1
                out.append(Node("arg", at, self.last(), "(...)", [None]))
                break
            name = None
            if self.kind(1) == ":" and self.kind(2) != ":" and (self.kind() == "NAME" or self.kind() in KEYWORDS):
                name = self.src(self.take())
                self.i += 1
            spread = self.have("...")
            e = self.expr()
            out.append(Node("arg", at, e.end, "..." if spread else name, [e]))
            if not self.have(","):
                break
        self.want(")")
        return out

    def new(self, start: int) -> Node:
        while self.kind() == "#[":
            self.attribute()
        self.have("readonly")
        if self.have("class"):
            args = self.args() if self.kind() == "(" else []
            c = self.classrest(start, "class", [], "class@anonymous")
            return Node("new", start, self.last(), None, [c, *args])
        if self.kind() == "(":
            target = self.primary()
        else:
            target = self.primary()
            while self.kind() in ("->", "?->", "::", "["):
                target = self.access(target)
        args = self.args() if self.kind() == "(" else []
        return Node("new", start, self.last(), None, [target, *args])

    def access(self, left: Node) -> Node:
        k = self.take().kind
        if k in "[{":
            # braces right after a variable are an offset in older code
            index = None if self.kind() == "]" else self.expr()
            self.want("]" if k == "[" else "}")
            return Node("index", left.start, self.last(), None, [left, index])
        if self.have("{"):
            name = self.expr()
            self.want("}")
        else:
            t = self.take()
            if t.kind == "VAR":
                name = Node("var", t.start, t.end, self.src(t)[1:])
            elif t.kind == "$":
                self.i -= 1
                name = self.primary()
            else:
                name = Node("ident", t.start, t.end, self.src(t))
        return Node("static_member" if k == "::" else "member", left.start, self.last(), None, [left, name])

    def postfix(self, left: Node) -> Node:
        while True:
            k = self.kind()
            if k in ("[", "->", "?->", "::") or k == "{" and left.kind in ("var", "index", "member") and self.here() == left.end:
                left = self.access(left)
            elif k == "(":
                args = self.args()
                how = {"member": "method", "static_member": "static"}.get(left.kind, "function")
                left = Node("call", left.start, self.last(), how, [left, *args])
            elif k == "=" or k in ASSIGN:
                self.i += 1
                ref = self.have("&")
                right = self.expr(_TERNARY if k != "=" else 14)
                return Node("assign", left.start, right.end, "=&" if ref else k, [left, right])
            elif k in ("++", "--"):
                self.i += 1
                left = Node("step", left.start, self.last(), k, [left])
            else:
                return left


def parse(text: str) -> tuple[Node, list[tuple[str, int]]]:
    """(tree, errors as (message, offset))."""
    p = Parser(text)
    return p.file(), p.errors
