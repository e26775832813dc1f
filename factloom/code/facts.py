"""Facts of one source file: declarations, calls, and the value graph inside each scope.

Statements are run abstractly in order. A storage cell is a variable with a path of keys; a cell holds the ids of the
values that may be in it. An assignment replaces the cell and all below it, one through an unknown key adds to it;
branches run on copies that are united after them, and a branch that does not complete takes no part. Loops run until
nothing new comes in. Every assignment, call, argument, parameter and source is a value with an id, so the edges between
ids are the reaching definitions of the file, and flows through calls are joins on these tables.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.code import cfg
from factloom.code.phpast import Node, parse
from factloom.functions.phplex import Lines
from factloom.store import spread

#: Names with a meaning for flows (fixed values).
REQUESTS = {"_GET", "_POST", "_REQUEST", "_COOKIE", "_FILES", "HTTP_RAW_POST_DATA"}
TRUSTED_SERVER = {"DOCUMENT_ROOT", "SERVER_SOFTWARE", "SERVER_ADDR", "SERVER_PORT", "SCRIPT_FILENAME"}
SOURCE_CALLS = {"getallheaders", "apache_request_headers", "filter_input", "filter_input_array"}
SCALAR = set(
    "intval floatval boolval strlen count sizeof strcmp strcasecmp strpos stripos strrpos is_numeric ctype_digit file_exists is_file is_dir is_readable is_writable stream_is_local in_array array_key_exists defined "
    "is_array is_bool is_callable is_float is_int is_integer is_null is_object is_resource is_scalar is_string".split()
)
TRANSFORMS = set(
    "base64_decode urldecode rawurldecode gzuncompress gzinflate gzdecode stripslashes trim rtrim ltrim substr str_replace preg_replace sprintf vsprintf strtolower strtoupper dirname basename file_get_contents fread fgets stream_get_contents".split()
)
DESERIALIZERS = {"unserialize", "igbinary_unserialize", "wddx_deserialize", "yaml_parse", "session_decode"}
#: Methods of request objects that return what was sent, by class.
REQUEST_METHODS = {
    "symfony\\component\\httpfoundation\\request": {"get", "getcontent", "getquerystring"},
    "illuminate\\http\\request": {"get", "getcontent", "input", "query", "post", "cookie", "header", "all"},
}
#: Functions that run a callback, with its place.
CALLBACKS = {
    "array_map": 0, "array_filter": 1, "array_walk": 1, "array_walk_recursive": 1, "usort": 1, "uasort": 1, "uksort": 1,
    "call_user_func": 0, "call_user_func_array": 0, "forward_static_call": 0, "forward_static_call_array": 0,
}
#: Built-ins that write to an argument: place read, place written.
WRITES_BACK = {"preg_match": (1, 2), "preg_match_all": (1, 2), "parse_str": (0, 1), "mb_parse_str": (0, 1), "array_push": (1, 0), "array_unshift": (1, 0)}
#: Names of the parameters of built-ins that are looked at, in order.
PARAMETERS = {
    "unserialize": ("data", "options"), "session_decode": ("data",), "yaml_parse": ("input", "pos", "ndocs", "callbacks"), "file_get_contents": ("filename",), "file_put_contents": ("filename", "data"), "unlink": ("filename",),
    "call_user_func": ("callback",), "call_user_func_array": ("callback", "args"), "array_map": ("callback", "array"), "hash_file": ("algo", "filename"), "copy": ("from", "to"), "rename": ("from", "to"), "fopen": ("filename", "mode"),
}
STREAMS = {"php://input", "php://stdin"}
GUARDS = {"is_numeric", "ctype_digit", "is_int", "is_integer", "is_float", "is_bool"}
_SCALAR_OPS = {"+", "-", "*", "/", "%", "**", "<<", ">>", "&", "|", "^", "==", "!=", "<>", "===", "!==", "<", "<=", ">", ">=", "<=>", "&&", "||", "and", "or", "xor", "instanceof"}
_NUMBER_FILTERS = re.compile(r"\\?FILTER_(?:VALIDATE_(?:INT|FLOAT|BOOL|BOOLEAN)|SANITIZE_NUMBER_INT|SANITIZE_NUMBER_FLOAT)\Z")
_GLOBALS = re.compile(r"\bglobal\b([^;]*);|\$GLOBALS\s*\[\s*['\"](\w+)")
#: Keys of a scope's state beside its variables: references, literals, and conditions that hold.
REFS, LITERALS, HOLDS = 0, 1, 2
MOST_GUARDS, GUARD_CHARS = 4, 500
IDS = 1 << 20
PATH_DEPTH = 4
#: Characters of code in the calls of one batch of facts; texts are whole, and those of nested calls hold each other.
BATCH = 4_000_000
#: A text that begins with a member of $this.
_MEMBER = re.compile(r"\$this->[A-Za-z_\x80-\xff][\w\x80-\xff]*(?=->|\[|\Z)")


class File:
    """The walk of one file."""

    def __init__(self, file_id: int, content: bytes, php_version: str | None = None, most_nodes: int | None = None):
        """``php_version``: branches that this version does not take are not run. A file of more than ``most_nodes`` nodes has an error and no facts."""
        self.base, self.text = file_id * IDS, content.decode("latin-1")
        self.lines = Lines(self.text)
        self.version = tuple(int(x) for x in php_version.split(".")) if php_version else None
        root, errors = parse(self.text)
        if most_nodes is not None and sum(1 for _ in root.walk()) > most_nodes:
            root, errors = Node("file", 0, 0), [(f"more than {most_nodes} nodes", 0)]
        self.errors = [{"message": m, "line": self.lines.at(min(at, max(len(self.text) - 1, 0)))[0]} for m, at in errors]
        self.ids: dict[tuple, int] = {}
        self.edges: dict[tuple[int, int, str], None] = {}
        self.imports, self.classes, self.properties, self.functions = [], {}, {}, {}
        self.calls: dict[int, dict] = {}
        self.sources: dict[int, dict] = {}
        self.returns: dict[tuple[int, int], None] = {}
        self.props: dict[tuple, None] = {}
        self.sessions: dict[tuple, None] = {}
        self.implicit: dict[tuple, str | None] = {}
        self.namespace, self.first_namespace = "", None
        self.kinds: dict[int, set[str]] = {}
        self.restored: set[int] = set()
        self.outs: dict[tuple, int] = {}
        self.afters: dict[tuple, int] = {}
        self.entry_guards: dict[str, None] = {}
        self.flows: dict[int, dict] = {}
        self.global_names = {n for a, b in _GLOBALS.findall(self.text) for n in ([b] if b else re.findall(r"\$(\w+)", a))}
        self.fn, self.cls = self.new_id(("top",)), None
        self.main, self.branches, self.exits = self.fn, 0, []
        self.loops: list[list] = []
        try:
            self.flows[self.fn] = cfg.build(root.kids)
            self.top(root.kids)
        except RecursionError:
            self.errors.append({"message": "nested too deeply", "line": 1})
        if len(self.ids) >= IDS:
            # ids would run into those of another file
            self.errors.append({"message": "too many values", "line": 1})
            for held in (self.edges, self.classes, self.properties, self.functions, self.calls, self.sources, self.returns, self.props, self.sessions, self.implicit, self.outs, self.afters, self.flows):
                held.clear()

    # -- values --
    def new_id(self, key: tuple) -> int:
        return self.ids.setdefault(key, self.base + len(self.ids) + 1)

    def flow(self, values, to: int, tag: str = "flow") -> None:
        for v in values:
            if v != to:
                self.edges[(v, to, tag)] = None

    def string(self, b: str) -> str:
        return b.encode("latin-1").decode("utf-8", "replace")

    def src(self, n: Node | None) -> str:
        return self.string(self.text[n.start : n.end]) if n is not None else ""

    def qualify(self, name: str, kind: str = "class") -> str:
        """A name with imports and namespace applied."""
        if name.startswith("\\"):
            return name[1:]
        if name.lower() in ("self", "static", "parent"):
            return name.lower()
        if name.lower().startswith("namespace\\"):
            return f"{self.namespace}\\{name[10:]}".strip("\\")
        head, _, rest = name.partition("\\")
        for i in self.imports:
            if i["alias"].lower() == head.lower() and (i["kind"] == "class" if rest or kind == "class" else i["kind"] == kind):
                return i["full"] + ("\\" + rest if rest else "")
        return f"{self.namespace}\\{name}" if self.namespace else name

    # -- cells: env is {variable: {path: ids}}, inner maps are never changed in place --
    @staticmethod
    def read(env: dict, var: str, path: tuple) -> set:
        cells = env.get(var)
        if not cells:
            return set()
        out, n = set(), len(path)
        for p, ids in cells.items():
            k = min(len(p), n)
            if len(p) >= n and all(a is None or b is None or a == b for a, b in zip(p[:k], path)):
                out |= ids
        for k in range(n, -1, -1):
            if path[:k] in cells:
                out |= cells[path[:k]]
                break
        for p, ids in cells.items():
            if len(p) < n and None in p and all(a is None or b is None or a == b for a, b in zip(p, path)):
                out |= ids
        return out

    @staticmethod
    def write(env: dict, var: str, path: tuple, ids: set) -> None:
        if len(path) > PATH_DEPTH:
            path = (*path[: PATH_DEPTH - 1], None)
        cells = env.get(var, {})
        if None in path:
            env[var] = {**cells, path: cells.get(path, set()) | ids}
        else:
            env[var] = {**{p: v for p, v in cells.items() if p[: len(path)] != path}, path: set(ids)}

    def union(self, a: dict | None, b: dict | None) -> dict | None:
        if a is None or b is None:
            return b if a is None else a
        if a.get(REFS) != b.get(REFS):
            ra, rb = a.get(REFS, {}), b.get(REFS, {})
            apart = {v for v in ra.keys() | rb.keys() if ra.get(v) != rb.get(v)}
            a, b = self.detached(a, apart), self.detached(b, apart)
        out = {REFS: a.get(REFS, {})}
        la, lb = a.get(LITERALS, {}), b.get(LITERALS, {})
        out[LITERALS] = la if la is lb else {k: v for k, v in la.items() if lb.get(k) is v}
        ha, hb = a.get(HOLDS, ()), b.get(HOLDS, ())
        out[HOLDS] = ha if ha is hb else tuple(h for h in ha if h in hb)
        for var in a.keys() | b.keys():
            if isinstance(var, int):
                continue
            x, y = a.get(var, {}), b.get(var, {})
            out[var] = x if x is y else {p: (x[p] if p in x else self._near(x, p)) | (y[p] if p in y else self._near(y, p)) for p in x.keys() | y.keys()}
        return out

    def detached(self, env: dict, names: set) -> dict:
        """``env`` in which the variables are no references any more but hold what they refer to."""
        refs = env.get(REFS, {})
        if not names & refs.keys():
            return env
        out = {**env, REFS: {v: t for v, t in refs.items() if v not in names}}
        for v in names & refs.keys():
            out[v] = {(): self.read(env, *self.place(env, v, ()))}
        return out

    @staticmethod
    def place(env: dict, var: str, path: tuple) -> tuple[str, tuple]:
        """The variable and path that hold it, references followed; a global has a variable of its own."""
        refs = env.get(REFS)
        if refs:
            for _ in range(16):
                to = refs.get(var)
                if to is None:
                    break
                var, path = to[0], (*to[1], *path)
        if var == "GLOBALS" and path and path[0]:
            return "\0" + path[0], path[1:]
        return var, path

    @staticmethod
    def _near(cells: dict, path: tuple) -> set:
        return next((cells[path[:k]] for k in range(len(path) - 1, -1, -1) if path[:k] in cells), set())

    # -- statements: run(env) gives the env after, None if it does not complete --
    def top(self, stmts: list) -> None:
        env: dict | None = {}
        for s in stmts:
            if s.kind == "namespace":
                self.namespace = self.string(s.value)
                self.imports = list(self.imports) if s.kids else self.imports
                if self.first_namespace is None:
                    self.first_namespace = self.namespace
                env = self.block(s.kids, env)
            else:
                env = self.block([s], env)

    def block(self, stmts, env: dict | None) -> dict | None:
        for s in stmts:
            if s is None:
                continue
            if env is None:
                if s.kind in ("function", "class"):
                    self.run(s, {})
                continue
            env = self.run(s, env)
        return env

    def run(self, s: Node | None, env: dict | None) -> dict | None:
        if s is None or env is None:
            return env
        f = getattr(self, "s_" + s.kind, None)
        if f:
            return f(s, env)
        for k in s.kids:
            if k is not None:
                self.value(k, env)
        return env

    def s_block(self, s, env):
        return self.block(s.kids, env)

    def s_expr(self, s, env):
        e = s.kids[0]
        if self.fn == self.main and e.kind == "binary" and e.value in ("or", "||") and e.kids[1].kind == "exit":
            self.entry_guard(e.kids[0])
        self.value(e, env)
        return None if e.kind == "exit" or e.kind == "unary" and e.value == "throw" else env

    def s_use(self, s, env):
        self.imports += [{"kind": k.value[0], "full": self.string(k.value[1]), "alias": self.string(k.value[2])} for k in s.kids]
        return env

    def entry_guard(self, test: Node) -> None:
        """``defined('X')`` that must hold to run the file."""
        if test.kind == "call" and test.kids[0].kind == "name" and test.kids[0].value.lstrip("\\").lower() == "defined" and len(test.kids) == 2 and test.kids[1].kids[0].kind == "str":
            self.entry_guards[self.string(test.kids[1].kids[0].value.strip("'\""))] = None

    def fold(self, n: Node | None) -> bool | None:
        """A condition that the version of the language decides, or that is a constant; None for others."""
        while n is not None and n.kind == "paren":
            n = n.kids[0]
        if n is None:
            return None
        if n.kind == "name":
            return {"true": True, "false": False}.get(n.value.lstrip("\\").lower())
        if n.kind == "unary" and n.value == "!":
            v = self.fold(n.kids[0])
            return None if v is None else not v
        if n.kind == "binary" and n.value in ("&&", "and", "||", "or"):
            a, b = self.fold(n.kids[0]), self.fold(n.kids[1])
            stop = n.value in ("||", "or")
            return stop if stop in (a, b) else None if None in (a, b) else not stop
        if self.version is None:
            return None
        tests = {"<": -1, "lt": -1, "<=": -2, "le": -2, ">": 1, "gt": 1, ">=": 2, "ge": 2, "==": 0, "eq": 0, "===": 0, "!=": 3, "<>": 3, "ne": 3, "!==": 3}
        if n.kind == "call" and n.kids[0].kind == "name" and n.kids[0].value.lstrip("\\").lower() == "version_compare" and len(n.kids) == 4:
            left, right, op = (a.kids[0] for a in n.kids[1:])
            if left.kind == "name" and left.value.lstrip("\\") == "PHP_VERSION" and right.kind == "str" and op.kind == "str" and re.fullmatch(r"['\"]\d+(?:\.\d+)*['\"]", right.value):
                return self.compared(tuple(int(x) for x in right.value[1:-1].split(".")), tests.get(op.value[1:-1].lower()))
        if n.kind == "binary" and n.value in tests:
            left, right, way = *n.kids, tests[n.value]
            if right.kind == "name":
                left, right, way = right, left, way if way in (0, 3) else -way
            if left.kind == "name" and left.value.lstrip("\\") == "PHP_VERSION_ID" and right.kind == "num" and right.value.isdigit():
                v = int(right.value)
                return self.compared((v // 10000, v // 100 % 100, v % 100), way)
        return None

    def compared(self, other: tuple, way: int | None) -> bool | None:
        if way is None:
            return None
        n = max(len(other), len(self.version))
        a, b = (x + (0,) * (n - len(x)) for x in (self.version, other))
        return {-1: a < b, -2: a <= b, 1: a > b, 2: a >= b, 0: a == b, 3: a != b}[way]

    def guarded(self, cond: Node | None, env: dict, positive: bool, top: bool = True) -> dict:
        """``env`` where the condition holds (or not): a variable shown to be a number or boolean carries nothing.

        The condition is kept as one that holds until a variable in it is written.
        """
        if top and cond is not None:
            names = frozenset(x.value for x in cond.walk() if x.kind == "var")
            if names:
                text = self.src(cond)[:GUARD_CHARS]
                held = (text if positive else f"!({text})", names)
                if held not in env.get(HOLDS, ()):
                    env = {**env, HOLDS: (*env.get(HOLDS, ()), held)}
        while cond is not None and cond.kind == "paren":
            cond = cond.kids[0]
        if cond is None:
            return env
        if cond.kind == "unary" and cond.value == "!":
            return self.guarded(cond.kids[0], env, not positive, False)
        if cond.kind == "binary" and cond.value in (("&&", "and") if positive else ("||", "or")):
            return self.guarded(cond.kids[1], self.guarded(cond.kids[0], env, positive, False), positive, False)
        if positive and cond.kind == "call" and cond.kids[0].kind == "name" and cond.kids[0].value.lstrip("\\").lower() in GUARDS and len(cond.kids) == 2:
            tested = cond.kids[1].kids[0]
            while tested.kind in ("paren", "assign"):
                tested = tested.kids[0]
            cell = self.cell(tested, env)
            if cell and None not in cell[1]:
                env = dict(env)
                self.write(env, *cell, set())
        return env

    def s_if(self, s, env):
        cond, then, other = s.kids
        self.value(cond, env)
        known = self.fold(cond)
        self.branches += 1
        a = self.run(then, dict(self.guarded(cond, env, True))) if known is not False else None
        b = dict(self.guarded(cond, env, False)) if known is not True else None
        b = self.run(other, b) if other is not None else b
        self.branches -= 1
        if a is None and other is None and self.fn == self.main and not self.branches and cond.kind == "unary" and cond.value == "!":
            self.entry_guard(cond.kids[0])
        return self.union(a, b)

    def loop(self, env, body, guard=None, at_least_once=False):
        exits: list = []
        start = env
        self.branches += 1
        # the sets of ids only grow and ids stand for places of the file, so this ends
        while True:
            self.loops.append([])
            inner = dict(start)
            after = body(inner)
            for e in self.loops.pop():
                exits.append(e)
                after = self.union(after, e)
            new = self.union(start, after)
            if self.sizes(new) == self.sizes(start):
                break
            start = new
        self.branches -= 1
        out = start if not at_least_once else self.union(after, None)
        for e in exits:
            out = self.union(out, e)
        return out

    @staticmethod
    def sizes(env):
        return {(v, p): len(ids) for v, cells in env.items() if isinstance(v, str) for p, ids in cells.items() if ids} if env else {}

    def s_while(self, s, env):
        def body(e):
            self.value(s.kids[0], e)
            return self.run(s.kids[1], self.guarded(s.kids[0], e, True))

        return self.loop(env, body)

    def s_do(self, s, env):
        def body(e):
            e = self.run(s.kids[0], e)
            if e is not None:
                self.value(s.kids[1], e)
            return e

        return self.loop(env, body, at_least_once=True)

    def s_for(self, s, env):
        for x in s.kids[0].kids:
            self.value(x, env)

        def body(e):
            for x in s.kids[1].kids:
                self.value(x, e)
            e = self.run(s.kids[3], e)
            if e is not None:
                for x in s.kids[2].kids:
                    self.value(x, e)
            return e

        return self.loop(env, body)

    def s_foreach(self, s, env):
        over, key, value, body_ = s.kids
        whole = self.value(over, env)

        def body(e):
            if key is not None:
                self.assign(key, whole, e, s)
            c = self.cell(over, e) if s.value == "&" and value.kind == "var" else None
            if c and c[0] != value.value and c[0] not in REQUESTS:
                e[REFS] = {**e.get(REFS, {}), value.value: (c[0], (*c[1], None))}
            else:
                self.assign(value, whole, e, s)
            return self.run(body_, e)

        return self.loop(env, body)

    def s_switch(self, s, env):
        self.value(s.kids[0], env)
        self.loops.append([])
        self.branches += 1
        fall, has_default = None, False
        for c in s.kids[1:]:
            has_default |= c.kids[0] is None
            if c.kids[0] is not None:
                self.value(c.kids[0], env)
            fall = self.block(c.kids[1:], self.union(dict(env), fall))
        out = fall
        self.branches -= 1
        for e in self.loops.pop():
            out = self.union(out, e)
        return out if has_default else self.union(out, env)

    def s_try(self, s, env):
        before = dict(env)
        out = self.run(s.kids[0], dict(env))
        # an exception may leave the block anywhere, so handlers see the cells before and after
        thrown = self.union(before, out)
        for k in s.kids[1:]:
            if k.kind == "catch":
                e = dict(thrown)
                if k.kids[0] is not None:
                    self.write(e, k.kids[0].value, (), set())
                out = self.union(out, self.run(k.kids[1], e))
            else:
                e = self.run(k.kids[0], dict(self.union(out, thrown)))
                out = None if e is None else self.run(k.kids[0], dict(out)) if out is not None else None
        return out

    def s_return(self, s, env):
        if s.kids[0] is not None:
            for v in self.value(s.kids[0], env):
                self.returns[(self.fn, v)] = None
        self.exits.append(env)
        return None

    def s_break(self, s, env):
        if self.loops:
            self.loops[-1].append(env)
        return None

    s_continue = s_break

    def s_unset(self, s, env):
        for k in s.kids:
            if k.kind == "var" and k.value in env.get(REFS, {}):
                env[REFS] = {v: t for v, t in env[REFS].items() if v != k.value}
                self.write(env, k.value, (), set())
                continue
            c = self.cell(k, env)
            if c:
                self.write(env, *c, set())
        return env

    def s_global(self, s, env):
        for k in s.kids:
            if k.kind == "var":
                env[REFS] = {**env.get(REFS, {}), k.value: ("\0" + k.value, ())}
        return env

    def global_read(self, env, var, path) -> set:
        """A global of another scope: what this one wrote to it, or whatever the others may have written."""
        known = self.read(env, var, path)
        if any(path[:k] in env.get(var, {}) for k in range(len(path) + 1)):
            return known
        return known | {self.shared("global", var[1:])}

    def shared(self, kind: str, name: str) -> int:
        """A read of storage that other scopes write."""
        i = self.new_id((kind, self.fn, name))
        self.props[(kind, self.string(name), i, False)] = None
        return i

    def s_function(self, s, env):
        self.function(s, "function")
        return env

    def function(self, s: Node, kind: str, env: dict | None = None) -> int:
        i = self.new_id(("fn", s.start))
        outer = self.fn, self.loops, self.branches, self.exits
        self.fn, self.loops, self.branches, self.exits = i, [], 0, []
        inner: dict = {} if env is None else dict(env)
        params = []
        for k, p in enumerate(x for x in s.kids if x is not None and x.kind == "param"):
            v = self.new_id(("param", p.start))
            params.append({"name": self.string(p.value["name"]), "type": self.string(p.value["type"]), "value_id": v, "at": k})
            self.write(inner, p.value["name"], (), {v})
            if hint := self.hint(self.string(p.value["type"])):
                self.kinds[v] = {hint + "?"}  # or a class below it
            if p.value["mods"] and self.cls:
                self.props[("property", f"{self.cls['name']}::{self.string(p.value['name'])}".lower(), v, True)] = None
                self.properties.setdefault((self.cls["id"], p.value["name"]), {"class_id": self.cls["id"], "name": self.string(p.value["name"]), "type": self.string(p.value["type"]), "visibility": next((m for m in p.value["mods"] if m != "readonly"), "public"), "static": False})
        mods = s.value["mods"]
        body = s.kids[-1] if s.kids and s.kids[-1] is not None and s.kids[-1].kind != "param" else None
        name = self.string(s.value["name"])
        if kind == "function":
            name = f"{self.namespace}\\{name}" if self.namespace else name
        if i not in self.functions and body is not None and kind != "closure":
            self.touches(i, body, {x.value["name"]: self.string(x.value["type"]) for x in s.kids if x is not None and x.kind == "param"})
        self.functions.setdefault(i, {
            "id": i, "class_id": self.cls["id"] if kind == "method" else None, "name": name, "kind": kind, "visibility": next((m for m in mods if m in ("public", "protected", "private")), "public"),
            "static": "static" in mods, "abstract": body is None, "params": params, "return_type": self.string(s.value["type"]), "start_line": self.lines.at(s.start)[0], "end_line": self.lines.at(max(s.end - 1, 0))[0],
        })
        if body is not None and i not in self.flows:
            self.flows[i] = cfg.build([body])
        after = self.run(body, inner)
        ends = [e for e in (*self.exits, after) if e is not None]
        for p, x in zip(params, (x for x in s.kids if x is not None and x.kind == "param")):
            if x.value["ref"]:
                ids = {v for e in ends for v in self.read(e, *self.place(e, x.value["name"], ()))} - {p["value_id"]}
                out = self.outs[(i, p["at"], p["name"])] = self.new_id(("out", i, p["at"]))
                self.flow(ids, out)
        self.fn, self.loops, self.branches, self.exits = outer
        self.ended = ends
        return i

    def touches(self, fn: int, body: Node, hints: dict) -> None:
        """Conversions to text and reads of members of $this, which may run __toString and __get; not those of inner functions and classes."""
        cls, called, stack = self.cls["id"] if self.cls else None, set(), [body]
        while stack:
            n = stack.pop()
            if n.kind in ("function", "method", "closure", "class"):
                continue
            stack.extend(k for k in n.kids if k is not None)
            if n.kind == "call":
                called.add(id(n.kids[0]))
            elif n.kind == "member":
                if id(n) not in called and n.kids[1].kind == "ident" and self.text.find("$this", n.kids[0].start, n.kids[0].end) >= 0:
                    self.implicit.setdefault((fn, cls, "__get", "$this->" + n.kids[1].value), None)
            elif n.kind == "cast" and "string" in n.value or n.kind == "binary" and n.value == ".":
                for k in n.kids:
                    while k.kind == "paren":
                        k = k.kids[0]
                    if m := _MEMBER.match(self.text, k.start, k.end):
                        self.implicit.setdefault((fn, cls, "__tostring", m[0]), None)
                    elif n.kind == "cast" and k.kind == "var" and k.value in hints:
                        self.implicit[(fn, cls, "__tostring", self.string("$" + k.value))] = self.hint(hints[k.value])

    def hint(self, declared: str | None) -> str | None:
        """The class that a declared type names, in small letters; None for none or several."""
        t = (declared or "").strip().lstrip("?")
        if not t or any(c in t for c in "|&[") or "callable" in t.lower():
            return None
        t = self.qualify(t)
        if self.cls and t in ("self", "static", "parent"):
            t = self.cls["parent"] if t == "parent" else self.cls["name"]
        return t.lower() if t else None

    def s_class(self, s, env):
        v, outer = s.value, self.cls
        name = self.string(v["name"])
        names = lambda xs: [self.qualify(self.string(x)) for x in xs]
        self.cls = {
            "id": self.new_id(("class", s.start)), "name": f"{self.namespace}\\{name}" if self.namespace else name, "kind": v["kind"], "parent": next(iter(names(v["parents"])), None) if v["kind"] != "interface" else None,
            "interfaces": names(v["interfaces"] if v["kind"] != "interface" else v["parents"]), "traits": [], "abstract": "abstract" in v["mods"], "adapted": False,
            "start_line": self.lines.at(s.start)[0], "end_line": self.lines.at(max(s.end - 1, 0))[0],
        }
        self.cls = self.classes.setdefault(self.cls["id"], self.cls)
        for k in s.kids:
            if k.kind == "traits":
                self.cls["traits"] += [t for t in names(k.value[0]) if t not in self.cls["traits"]]
                self.cls["adapted"] |= k.value[1]
            elif k.kind == "property":
                m = k.value["mods"]
                self.properties.setdefault((self.cls["id"], k.value["name"]), {"class_id": self.cls["id"], "name": self.string(k.value["name"]), "type": self.string(k.value["type"]), "visibility": next((x for x in m if x in ("public", "protected", "private")), "public"), "static": "static" in m})
        for k in s.kids:
            if k.kind == "method":
                self.function(k, "method")
        for fn, cls, method, receiver in list(self.implicit):
            if cls == self.cls["id"] and receiver.startswith("$this->"):
                self.implicit[(fn, cls, method, receiver)] = self.hint(self.properties.get((cls, receiver[7:]), {}).get("type"))
        self.cls = outer
        return env

    # -- expressions: value(env) gives the ids that may be in the value --
    def cell(self, n: Node | None, env: dict) -> tuple[str, tuple] | None:
        """(variable, path) of a place that can be written; a member of $this has the path of its name."""
        path = []
        while n is not None:
            if n.kind == "paren":
                n = n.kids[0]
            elif n.kind == "index":
                k = n.kids[1]
                path.append(k.value.strip("'\"") if k is not None and k.kind == "str" else k.value if k is not None and k.kind == "num" else None)
                n = n.kids[0]
            elif n.kind == "member":
                path.append("->" + n.kids[1].value if n.kids[1].kind == "ident" else None)
                n = n.kids[0]
            elif n.kind == "var":
                return self.place(env, n.value, tuple(reversed(path)))
            else:
                return None
        return None

    def value(self, n: Node | None, env: dict) -> set:
        if n is None:
            return set()
        f = getattr(self, "e_" + n.kind, None)
        if f:
            return f(n, env)
        out = set()
        for k in n.kids:
            out |= self.value(k, env)
        return out

    def _none(self, n, env):
        for k in n.kids:
            self.value(k, env)
        return set()

    e_num = e_str = e_name = e_ident = e_isset = e_empty = e_exit = e_step = _none

    def e_paren(self, n, env):
        return self.value(n.kids[0], env)

    def e_var(self, n, env):
        if n.value in REQUESTS:
            return {self.source(n, "$" + n.value)}
        var, path = self.place(env, n.value, ())
        if var[:1] == "\0":
            return self.global_read(env, var, path)
        got = self.read(env, var, path)
        if self.fn == self.main and n.value in self.global_names:
            return got | {self.shared("global_back", n.value)}
        return got

    def source(self, n: Node, origin: str, kind: str = "request") -> int:
        i = self.new_id(("source", n.start, n.end))
        self.sources[i] = {"id": i, "fn_id": self.fn, "origin": origin, "kind": kind, "line": self.lines.at(n.start)[0]}
        return i

    def class_of(self, n: Node, env: dict) -> str | None:
        """The one class that an expression can have, as far as it was made in sight; with ``?`` if it was only declared."""
        while n.kind == "paren":
            n = n.kids[0]
        if n.kind == "var" and n.value == "this":
            return self.cls["name"].lower() if self.cls else None
        if n.kind == "new" and n.kids[0].kind == "name":
            return self.hint(self.string(n.kids[0].value))
        c = self.cell(n, env)
        if not c:
            return None
        if c[0] == "this" and self.cls and len(c[1]) == 1 and c[1][0]:
            declared = self.hint(self.properties.get((self.cls["id"], c[1][0][2:]), {}).get("type"))
            if declared:
                return declared + "?"
        names = set().union(*(self.kinds.get(i, ()) for i in self.read(env, *c)))
        return next(iter(names)) if len(names) == 1 else None

    def owner_of(self, n: Node, env: dict) -> str | None:
        return (self.class_of(n, env) or "").rstrip("?") or None

    def e_index(self, n, env):
        if n.kids[1] is not None and n.kids[1].kind not in ("str", "num"):
            self.value(n.kids[1], env)
        c = self.cell(n, env)
        if c:
            var, path = c
            if var in REQUESTS:
                # the path of an upload is the server's choice
                return set() if var == "_FILES" and "tmp_name" in path else {self.source(n, self.src(n))}
            if var == "_SERVER":
                return set() if path and path[0] in TRUSTED_SERVER else {self.source(n, self.src(n))}
            if var[:1] == "\0":
                return self.global_read(env, var, path)
            if var == "this":
                return self.member_read(n, c, env)
            return self.read(env, var, path)
        return self.value(n.kids[0], env)

    def e_member(self, n, env):
        c = self.cell(n, env)
        if c and c[0] == "this":
            return self.member_read(n, c, env)
        if not c:
            return self.value(n.kids[0], env)
        got, owner = self.read(env, *c), self.owner_of(n.kids[0], env) if n.kids[1].kind == "ident" else None
        if owner and c[1] and not any(c[1][:k] in env.get(c[0], {}) for k in range(len(c[1]), len(c[1]) + 1)):
            return got | {self.shared("property", f"{owner}::{n.kids[1].value}".lower())}
        return got

    def member_read(self, n, c, env):
        var, path = c
        known = self.read(env, var, path)
        if var in env and any(path[:k] in env[var] for k in range(len(path) + 1)):
            return known
        if self.cls and path and path[0]:
            return known | {self.shared("property", f"{self.cls['name']}::{path[0][2:]}".lower())}
        return known

    def e_static_member(self, n, env):
        left, name = n.kids
        if left.kind == "name" and name.kind == "var":
            owner = self.qualify(self.string(left.value))
            owner = self.cls["name"] if owner in ("self", "static") and self.cls else owner
            return {self.shared("property", f"{owner}::{name.value}".lower())}
        return set()

    def e_binary(self, n, env):
        a = self.value(n.kids[0], env)
        if n.value in ("&&", "and"):
            env = self.guarded(n.kids[0], env, True)
        b = self.value(n.kids[1], env)
        return set() if n.value in _SCALAR_OPS else a | b

    def e_unary(self, n, env):
        v = self.value(n.kids[0], env)
        return v if n.value in ("@", "&", "clone", "yield_from") else set()

    def e_cast(self, n, env):
        v = self.value(n.kids[0], env)
        return v if n.value in ("array", "object", "string", "binary") else set()

    def e_ternary(self, n, env):
        cond, then, other = n.kids
        a = self.value(cond, env)
        known = self.fold(cond)
        if known is not None and then is not None:
            return self.value(then if known else other, env)
        b = self.value(then, self.guarded(cond, env, True)) if then is not None else a
        return b | self.value(other, self.guarded(cond, env, False))

    def e_match(self, n, env):
        self.value(n.kids[0], env)
        out = set()
        for arm in n.kids[1:]:
            for t in arm.kids[1:]:
                self.value(t, env)
            out |= self.value(arm.kids[0], env)
        return out

    def e_assign(self, n, env):
        left, right = n.kids
        if left.kind == "array":
            v = self.value(right, env)
            c = self.cell(right, env)
            self.destructure(left, v, c, env, n)
            return v
        if n.value == "=&" and left.kind == "var":
            to = self.cell(right, env)
            if to and to[0] not in REQUESTS and to != (left.value, ()) and to[0] != left.value:
                env[REFS] = {**env.get(REFS, {}), left.value: to}
                return self.value(right, env)
        v = self.value(right, env)
        if n.value not in ("=", "=&"):
            old = self.value(left, env)
            v = old | v if n.value in (".=", "??=") else set()
        elif right.kind == "array":
            out = self.assign_array(left, right, env, n)
            self.literal(left, right, env)
            return out
        out = self.assign(left, v, env, n)
        if n.value == "=" and right.kind in ("str", "num", "name"):
            self.literal(left, right, env)
        return out

    def literal(self, left: Node, right: Node, env: dict) -> None:
        c = self.cell(left, env)
        if c and None not in c[1]:
            env[LITERALS] = {**env.get(LITERALS, {}), c: right}

    def assign_array(self, left, right, env, n):
        """An array literal keeps its keys apart; a key that occurs twice has the last value."""
        c = self.cell(left, env)
        if not c or c[0] == "this":
            return self.assign(left, self.value(right, env), env, n)
        out = self.assign(left, set(), env, n)
        at = 0
        for item in right.kids:
            if item is None:
                continue
            key, value = item.kids
            if item.value == "..." or key is not None and key.kind not in ("str", "num"):
                k = None
            elif key is None:
                k, at = str(at), at + 1
            else:
                k = key.value.strip("'\"")
            v = self.value(value, env)
            d = self.new_id(("def", n.start, item.start))
            self.flow(v, d)
            self.write(env, c[0], (*c[1], k), {d} if v else set())
            out |= {d} if v else set()
        return out

    def assign(self, left: Node, v: set, env: dict, n: Node) -> set:
        if left.kind == "array":
            self.destructure(left, v, None, env, n)
            return v
        c = self.cell(left, env)
        if left.kind == "static_member":
            for i in self.e_static_member(left, env):
                self.props[("property", next(p[1] for p in self.props if p[2] == i), i, True)] = None
                self.flow(v, i)
            return v
        if not c:
            self.value(left, env)
            return v
        ids = set()
        if v:
            d = self.new_id(("def", n.start, left.start))
            self.flow(v, d)
            ids = {d}
            if names := set().union(*(self.kinds.get(i, ()) for i in v)):
                self.kinds[d] = names
            if v & self.restored:
                self.restored.add(d)
        var, path = c
        if env.get(LITERALS):
            env[LITERALS] = {k: x for k, x in env[LITERALS].items() if k[0] != var}
        if env.get(HOLDS):
            env[HOLDS] = tuple(h for h in env[HOLDS] if var not in h[1])
        if var == "_SESSION" and path and path[0]:
            if v & self.restored:
                self.sessions[(self.string(path[0]), n.start)] = None
        if var[:1] == "\0":
            for i in ids:
                self.props[("global", self.string(var[1:]), i, True)] = None
                if self.fn != self.main:
                    self.props[("global_back", self.string(var[1:]), i, True)] = None
        elif self.fn == self.main and var != "this":
            for i in ids:
                self.props[("global", self.string(var), i, True)] = None
        if var != "this" and path and path[-1] and path[-1][:2] == "->" and left.kind == "member" and ids and (owner := self.owner_of(left.kids[0], env)):
            for i in ids:
                self.props[("property", f"{owner}::{self.string(path[-1][2:])}".lower(), i, True)] = None
        self.write(env, var, path, ids)
        if var == "this" and self.cls and path and path[0]:
            for i in ids:
                self.props[("property", f"{self.cls['name']}::{self.string(path[0][2:])}".lower(), i, True)] = None
        return ids

    def destructure(self, left: Node, v: set, c, env: dict, n: Node) -> None:
        at = 0
        for item in left.kids:
            if item is None:
                at += 1
                continue
            key, target = item.kids
            k = str(at) if key is None else key.value.strip("'\"") if key.kind in ("str", "num") else None
            at += key is None
            self.assign(target, self.read(env, c[0], (*c[1], k)) if c and c[0] not in REQUESTS else v, env, item)

    def e_array(self, n, env):
        out = set()
        for item in n.kids:
            if item is not None:
                for k in item.kids:
                    out |= self.value(k, env)
        return out

    def e_closure(self, n, env):
        inner = {u: env[u] for u, _ in n.value["uses"] if u in env} if not n.value["fn"] else env
        self.function(n, "closure", {**inner, **({"this": env["this"]} if "this" in env else {})})
        for u, ref in n.value["uses"]:
            if ref and not n.value["fn"]:
                # the closure may have run at any time from here on
                new = {v for e in self.ended for v in self.read(e, *self.place(e, u, ()))}
                self.write(env, *self.place(env, u, ()), self.read(env, *self.place(env, u, ())) | new)
        return set()

    def e_include(self, n, env):
        self.call(n, "include", n.value, None, [n], env, [self.value(n.kids[0], env)])
        return set()

    def e_new(self, n, env):
        target = n.kids[0]
        if target.kind == "class":
            self.s_class(target, env)
            name = "class@anonymous"
        else:
            name = self.qualify(self.string(target.value)) if target.kind == "name" else None
            if target.kind != "name":
                self.value(target, env)
        args = n.kids[1:]
        got = [self.value(a.kids[0], env) for a in args]
        i = self.call(n, "new", "__construct", name, args, env, got)
        self.written_back(i, "new", "__construct", args, env, got)
        made = self.new_id(("new", n.start))
        if name and name != "class@anonymous" and (kind := self.hint(name if name.lower() in ("self", "static", "parent") else "\\" + name)):
            self.kinds[made] = {kind}
        return {made}.union(*got)

    def e_call(self, n, env):
        target, args = n.kids[0], n.kids[1:]
        got = [self.value(a.kids[0], env) for a in args]
        receiver, callee, how = None, None, n.value
        owner = None
        passed: set = set()
        if target.kind == "name":
            callee = self.string(target.value)
        elif target.kind in ("member", "static_member"):
            left, name = target.kids
            callee = self.string(name.value) if name.kind == "ident" else None
            if target.kind == "static_member" and left.kind == "name":
                receiver = self.qualify(self.string(left.value))
            else:
                receiver = self.src(left)
                owner = self.class_of(left, env)
                if not (left.kind == "var" and left.value == "this"):
                    passed = self.value(left, env)
        else:
            self.value(target, env)
        low = (callee or "").lstrip("\\").lower()
        out = self.call(n, how, callee, receiver, args, env, got, owner)
        if how == "function" and low in DESERIALIZERS:
            self.restored.add(out)
        if how == "method" and (c := self.cell(target.kids[0], env)) and c[0] == "_SESSION":
            # what this scope has put there itself is not what another request left
            self.calls[out]["replaced"] = c[1] in env.get("_SESSION", {}) and not self.read(env, *c) & self.restored
        self.written_back(out, how, low, args, env, got)
        if how == "method" and owner and low in REQUEST_METHODS.get(owner.rstrip("?"), ()):
            return {self.source(n, self.src(n), "framework_request")}
        if how == "method" and receiver == "$wpdb" and low == "get_results":
            return {self.source(n, self.src(n), "persistent_data")}
        if how == "function":
            if low in SCALAR or low == "filter_var" and len(args) > 1 and _NUMBER_FILTERS.match(self.src(args[1])) or low == "filter_input" and len(args) > 2 and _NUMBER_FILTERS.match(self.src(args[2])):
                return set()
            if low in SOURCE_CALLS or low in ("file_get_contents", "fopen", "file") and args and self.src(args[0]).strip("'\"") in STREAMS:
                return {self.source(n, self.src(n))}
            if low in CALLBACKS and len(args) > CALLBACKS[low]:
                return {out} | self.callback(n, low, args, env, got, out)
            if low in TRANSFORMS:
                for g in got:
                    self.flow(g, out, "transform")
                return {out}
        for k in range(len(args)):
            self.edges[(self.calls[out]["args"][k]["value_id"], out, "unresolved")] = None
        self.flow(passed, out, "unresolved")
        return {out}

    def prefix(self, n: Node | None, env: dict, depth: int = 0) -> tuple[str | None, bool]:
        """(what a text certainly begins with, whether that is all of it); None if nothing is known."""
        while n is not None and n.kind in ("paren", "include"):
            n = n.kids[0]
        if n is None or depth > 8:
            return None, False
        if n.kind == "str":
            return (self.string(n.value[1:-1]), True) if n.value[:1] in "'\"" and "$" not in n.value else (None, False)
        if n.kind == "interpolated":
            at = next((k.start for k in n.kids if k is not None), n.end)
            head = self.text[n.start + 1 : at].split("{")[0].split("$")[0]
            return (self.string(head) or None, False)
        if n.kind == "name" and n.value == "__DIR__":
            return "__DIR__", True
        if n.kind == "binary" and n.value == ".":
            left, whole = self.prefix(n.kids[0], env, depth + 1)
            if left is None or not whole:
                return left, False
            right, end = self.prefix(n.kids[1], env, depth + 1)
            return left + (right or ""), end
        if n.kind in ("var", "index", "member"):
            known = env.get(LITERALS, {}).get(self.cell(n, env))
            return self.prefix(known, env, depth + 1) if known is not None else (None, False)
        return None, False

    def callback(self, n: Node, low: str, args, env, got, outer: int) -> set:
        """The call that a fixed callback stands for, as a call of its own."""
        at = CALLBACKS[low]
        cb = args[at].kids[0]
        rest = [(a, g) for k, (a, g) in enumerate(zip(args, got)) if k != at]
        if low.endswith("_array") and rest and rest[0][0].kids[0].kind == "array":
            rest = [(x, self.value(x.kids[1], env)) for x in rest[0][0].kids[0].kids if x is not None]
            rest = [(Node("arg", a.start, a.end, None, [a.kids[1]]), g) for a, g in rest]
        nodes, values = [a for a, _ in rest], [g for _, g in rest]
        for k in range(len(args)):
            self.edges[(self.calls[outer]["args"][k]["value_id"], outer, "unresolved")] = None
        if cb.kind == "str" and "::" not in cb.value:
            return {self.call(n, "function", self.string(cb.value[1:-1]), None, nodes, env, values, via=outer)}
        if cb.kind == "array" and len(cb.kids) == 2 and all(x is not None and x.kids[0] is None for x in cb.kids) and cb.kids[1].kids[1].kind == "str":
            left, name = cb.kids[0].kids[1], self.string(cb.kids[1].kids[1].value[1:-1])
            if left.kind == "str":
                return {self.call(n, "static", name, self.qualify("\\" + self.string(left.value[1:-1]).lstrip("\\")), nodes, env, values, via=outer)}
            if left.kind == "static_member" and left.kids[0].kind == "name" and left.kids[1].kind == "ident" and left.kids[1].value.lower() == "class":
                return {self.call(n, "static", name, self.qualify(self.string(left.kids[0].value)), nodes, env, values, via=outer)}
            return {self.call(n, "method", name, self.src(left), nodes, env, values, self.class_of(left, env), via=outer)}
        return set()

    def _callback_kind(self, how: str, low: str, args) -> str | None:
        """What a function that runs a callback is given: closure, literal, property or dynamic."""
        if how != "function" or low not in CALLBACKS or len(args) <= CALLBACKS[low]:
            return None
        cb = args[CALLBACKS[low]].kids[0]
        if cb is None or cb.kind == "closure":
            return "closure"
        if cb.kind == "str" or cb.kind == "array" and len(cb.kids) == 2:
            return "literal"
        return f"property:{self.string(cb.kids[1].value)}" if cb.kind == "member" and cb.kids[1].kind == "ident" else "dynamic"

    def written_back(self, call: int, how: str, low: str, args, env, got) -> None:
        """What a call may write to its arguments: a variable then also holds a value that the called function's parameter ends with."""
        if how == "function" and low in WRITES_BACK:
            read, at = WRITES_BACK[low]
            c = self.cell(args[at].kids[0], env) if len(args) > max(read, at) else None
            if c:
                self.write(env, *c, self.read(env, *c) | set().union(*(got[read:] if at == 0 else [got[read]])))
            return
        if how == "function" and (low in SCALAR or low in TRANSFORMS or low in SOURCE_CALLS or low in DESERIALIZERS):
            return
        for k, a in enumerate(args):
            n = a.kids[0] if a.kids else None
            if n is None or n.kind not in ("var", "index", "member") or a.value in ("...", "(...)"):
                continue
            c = self.cell(n, env)
            if c and c[0] != "this" and c[0] not in REQUESTS and c[0] != "_SERVER":
                v = self.afters[(call, k, self.string(a.value) if a.value else None)] = self.new_id(("after", call, k))
                self.write(env, *c, self.read(env, *c) | {v})

    def call(self, n: Node, how: str, callee, receiver, args, env, got, owner: str | None = None, via: int | None = None) -> int:
        i = self.new_id(("call", n.start, n.end) if via is None else ("callback", via))
        rows = []
        low = callee.lstrip("\\").lower() if callee else ""
        names = PARAMETERS.get(low, ()) if how == "function" else ()
        for k, (a, ids) in enumerate(zip(args, got)):
            v = self.new_id(("arg", i, k))
            self.flow(ids, v)
            name = self.string(a.value) if a.kind == "arg" and a.value and a.value not in ("...", "(...)") else None
            place = k if name is None else names.index(name.lower()) if name.lower() in names else None
            rows.append({"at": k, "place": place, "name": name, "text": self.src(a), "prefix": self.prefix(a.kids[0] if a.kind == "arg" and a.kids else a, env)[0], "value_id": v})
        used = {x.value for a in args for x in a.walk() if x.kind == "var"} if env.get(HOLDS) else set()
        guards = list(dict.fromkeys(text for text, vs in env.get(HOLDS, ()) if vs & used))
        (l1, c1), (l2, c2) = self.lines.at(n.start), self.lines.at(n.end)
        full = callee.lstrip("\\") if via is not None and callee else self.qualify(callee, "function") if how == "function" and callee else callee
        self.calls[i] = {
            "id": i, "fn_id": self.fn, "class_name": self.cls["name"] if self.cls else None, "how": how, "callee": callee.lstrip("\\").lower() if callee else None, "qualified": full.lower() if full else None, "receiver": receiver, "receiver_class": owner.rstrip("?") if owner else None, "receiver_exact": owner is not None and not owner.endswith("?"), "args": rows,
            "replaced": False, "callback": self._callback_kind(how, low, args) if via is None else None, "via": via, "conditional": self.branches > 0 or self.fn != self.main, "guards": guards[:MOST_GUARDS], "guards_cut": len(guards) > MOST_GUARDS,
            "restricted": self.restricted(args, env), "start_line": l1, "start_col": c1, "end_line": l2, "end_col": c2, "text": self.src(n),
        }
        return i

    def restricted(self, args, env) -> bool:
        """The options argument allows no class: the last ``allowed_classes`` is false or an empty list, and no key is unknown."""
        node = next((a.kids[0] for k, a in enumerate(args) if a.kind == "arg" and (a.value == "options" or a.value is None and k == 1)), None)
        if node is not None and node.kind in ("var", "index", "member"):
            node = env.get(LITERALS, {}).get(self.cell(node, env))
        if node is None or node.kind != "array":
            return False
        out = False
        for item in node.kids:
            if item is None or item.value == "..." or item.kids[0] is None or item.kids[0].kind != "str":
                return False
            if item.kids[0].value.strip("'\"") == "allowed_classes":
                v = item.kids[1]
                out = v.kind == "name" and v.value.lower() == "false" or v.kind == "array" and not v.kids
        return out

    def row(self) -> dict:
        return {
            "namespace": self.first_namespace or "", "errors": self.errors, "imports": self.imports, "classes": list(self.classes.values()), "properties": list(self.properties.values()), "functions": list(self.functions.values()), "calls": list(self.calls.values()),
            "edges": [{"src": a, "dst": b, "tag": t} for a, b, t in self.edges], "sources": list(self.sources.values()), "returns": [{"fn_id": f, "value_id": v} for f, v in self.returns],
            "implicit": [{"fn_id": f, "method": m, "receiver": self.string(r), "type": t} for (f, _, m, r), t in self.implicit.items()],
            "outs": [{"fn_id": f, "at": k, "name": n, "value_id": v} for (f, k, n), v in self.outs.items()], "afters": [{"call_id": c, "at": k, "name": n, "value_id": v} for (c, k, n), v in self.afters.items()],
            "entry_guards": list(self.entry_guards), "data_only": not (self.calls or self.classes or self.functions),
            "blocks": [{"fn_id": f, "node": b, "line": self.lines.at(max(b, 0))[0], "kind": k, "writes": [self.string(w) for w in ws]} for f, g in self.flows.items() for b, (k, ws) in g["blocks"].items()],
            "steps": [{"fn_id": f, "src": a, "dst": b} for f, g in self.flows.items() for a, b in g["edges"]], "unsupported": [{"fn_id": f, "reason": r} for f, g in self.flows.items() for r in g["unsupported"]],
            "sessions": [{"key": k, "line": self.lines.at(at)[0]} for k, at in self.sessions],
            "cells": [{"kind": k, "name": n, "value_id": i, "written": w} for k, n, i, w in self.props],
        }


SCHEMA = """file_id bigint, repo_id int, path string, namespace string, errors array<struct<message string, line int>>, imports array<struct<kind string, full string, alias string>>,
classes array<struct<id bigint, name string, kind string, parent string, interfaces array<string>, traits array<string>, abstract boolean, adapted boolean, start_line int, end_line int>>,
properties array<struct<class_id bigint, name string, type string, visibility string, static boolean>>,
functions array<struct<id bigint, class_id bigint, name string, kind string, visibility string, static boolean, abstract boolean, params array<struct<name string, type string, value_id bigint, at int>>, return_type string, start_line int, end_line int>>,
calls array<struct<id bigint, fn_id bigint, class_name string, how string, callee string, qualified string, receiver string, receiver_class string, receiver_exact boolean, args array<struct<at int, place int, name string, text string, prefix string, value_id bigint>>, replaced boolean, callback string, via bigint, conditional boolean, guards array<string>, guards_cut boolean, restricted boolean, start_line int, start_col int, end_line int, end_col int, text string>>,
edges array<struct<src bigint, dst bigint, tag string>>, sources array<struct<id bigint, fn_id bigint, origin string, kind string, line int>>, returns array<struct<fn_id bigint, value_id bigint>>, implicit array<struct<fn_id bigint, method string, receiver string, type string>>, outs array<struct<fn_id bigint, at int, name string, value_id bigint>>, afters array<struct<call_id bigint, at int, name string, value_id bigint>>, entry_guards array<string>, data_only boolean, blocks array<struct<fn_id bigint, node int, line int, kind string, writes array<string>>>, steps array<struct<fn_id bigint, src int, dst int>>, unsupported array<struct<fn_id bigint, reason string>>, sessions array<struct<key string, line int>>, cells array<struct<kind string, name string, value_id bigint, written boolean>>"""


def _arrow_schema() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(SCHEMA))


def _extract(schema: pa.Schema, php_version: str | None = None, most_nodes: int | None = None):
    def run(batches):
        for b in batches:
            rows, size = [], 0
            for fid, repo, path, content in zip(*(c.to_pylist() for c in b.columns)):
                rows.append({"file_id": fid, "repo_id": repo, "path": path, **File(fid, content or b"", php_version, most_nodes).row()})
                size += sum(len(c["text"]) + len(c["receiver"] or "") + sum(len(a["text"]) for a in c["args"]) for c in rows[-1]["calls"])
                if len(rows) == 200 or size > BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def extract(files: DataFrame, php_version: str | None = None, most_nodes: int | None = None) -> DataFrame:
    """A row of facts per file of ``files(file_id, repo_id, file_path, content)``; each file is parsed once.

    A file without an id gets a negative one made of its path and content.

    Files that cannot be read to the end still yield what stands before and after the errors, which are rows of ``errors``.
    """
    own = -1 - F.xxhash64("repo_id", "file_path", "content").bitwiseAND(F.lit((1 << 41) - 1))
    f = files.select(F.coalesce(F.col("file_id").cast("bigint"), own).alias("file_id"), F.col("repo_id").cast("int"), F.col("file_path").alias("path"), "content")
    return spread(f, "file_id").mapInArrow(_extract(_arrow_schema(), php_version, most_nodes), SCHEMA)
