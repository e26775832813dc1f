"""A generalised LL recogniser with a graph-structured stack, for several dialects at once.

A grammar is text: ``name : alt | alt ;`` with terminals in quotes or upper case, ``( )``, ``*``, ``+``, ``?`` and an
optional tag ``{8.0 8.1}`` before an alternative that only these dialects have. A descriptor is (slot, stack node,
position, dialects); the dialects are a bit mask that narrows at tagged alternatives, so one run tells which dialects
accept. Stack nodes are shared by (nonterminal, position), which keeps ambiguous input polynomial and left recursion
finite. Two symbols of look-ahead pick the alternatives; where they leave one, the parser goes on without a descriptor,
and a nonterminal at the end of an alternative reuses the caller's stack node, so that lists do not deepen the stack.
As long as every choice leaves one alternative there is a single stack, which is a plain list; from the first choice of
several on, descriptors are kept and the list becomes the graph's first path.
"""

from __future__ import annotations

import re

TERM, CALL, TAIL, END = range(4)
_LEX = re.compile(r"\s+|#[^\n]*|'([^']+)'|\{([\w. ]+)\}|([A-Za-z_]\w*)|([:|;()*+?])")


class Grammar:
    def __init__(self, text: str, start: str, dialects: tuple[str, ...], greedy: tuple[str, ...] = ()):
        """``greedy``: nonterminals that are not empty where they need not be."""
        self.dialects, self._greedy = dialects, greedy
        self.all = (1 << len(dialects)) - 1
        self.terminals: dict[str, int] = {"<end>": 0}
        self._names: dict[str, int] = {}
        self._rules: list[list[tuple[int, list]]] = []
        self._read(text)
        self._compile(start)

    # -- reading -----------------------------------------------------------------------------------------------------
    def _nonterminal(self, name: str) -> int:
        if name not in self._names:
            self._names[name] = len(self._rules)
            self._rules.append([])
        return self._names[name]

    def _terminal(self, name: str) -> int:
        return self.terminals.setdefault(name, len(self.terminals))

    def _read(self, text: str) -> None:
        items, at = [], 0
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise ValueError(f"grammar: {text[at : at + 30]!r}")
            at = m.end()
            if m.lastindex:
                items.append((m.lastindex, m[m.lastindex]))
        self._items, self._at = items, 0
        while self._at < len(items):
            name = self._take()[1]
            self._take()
            self._rules[self._nonterminal(name)] += self._alternatives(";")

    def _take(self):
        self._at += 1
        return self._items[self._at - 1]

    def _alternatives(self, until: str):
        alts, seq, mask = [], [], self.all
        while True:
            kind, x = self._take()
            if kind == 4 and x in ("|", until):
                alts.append((mask, seq))
                seq, mask = [], self.all
                if x == until:
                    return alts
            elif kind == 4 and x == "(":
                seq.append(("n", self._fresh(self._alternatives(")"))))
            elif kind == 4:
                body = seq.pop()
                again = self._fresh([])
                if x == "?":
                    self._rules[again] = [(self.all, [body]), (self.all, [])]
                else:
                    self._rules[again] = [(self.all, [body, ("n", again)]), (self.all, [])]
                    if x == "+":
                        seq.append(body)
                seq.append(("n", again))
            elif kind == 2:
                mask = sum(1 << self.dialects.index(d) for d in x.split() if d in self.dialects)
            elif kind == 1 or x.isupper():
                seq.append(("t", self._terminal(x)))
            else:
                seq.append(("n", self._nonterminal(x)))

    def _fresh(self, alts) -> int:
        self._rules.append(alts)
        return len(self._rules) - 1

    # -- tables ------------------------------------------------------------------------------------------------------
    def _compile(self, start: str) -> None:
        rules = self._rules
        for name, i in self._names.items():
            if not rules[i]:
                raise ValueError(f"grammar: {name} has no rule")
        n = len(rules)
        empty, first = [False] * n, [set() for _ in range(n)]

        def of(seq):
            out = set()
            for kind, x in seq:
                if kind == "t":
                    return out | {x}, False
                out |= first[x]
                if not empty[x]:
                    return out, False
            return out, True

        changed = True
        while changed:
            changed = False
            for i, alts in enumerate(rules):
                for _, seq in alts:
                    f, e = of(seq)
                    if not f <= first[i] or e and not empty[i]:
                        first[i] |= f
                        empty[i] |= e
                        changed = True
        follow = [set() for _ in range(n)]
        self.start = self._names[start]
        follow[self.start].add(0)
        changed = True
        while changed:
            changed = False
            for i, alts in enumerate(rules):
                for _, seq in alts:
                    for k, (kind, x) in enumerate(seq):
                        if kind == "n":
                            f, e = of(seq[k + 1 :])
                            f = f | follow[i] if e else f
                            if not f <= follow[x]:
                                follow[x] |= f
                                changed = True
        self.op, self.arg = [], []
        self.pick: list[dict[int, tuple]] = [{} for _ in range(n)]
        for i, alts in enumerate(rules):
            for mask, seq in alts:
                slot = len(self.op)
                for k, (kind, x) in enumerate(seq):
                    self.op.append(TERM if kind == "t" else TAIL if k == len(seq) - 1 else CALL)
                    self.arg.append(x)
                if not seq or seq[-1][0] == "t":
                    self.op.append(END)
                    self.arg.append(0)
                f, e = of(seq)
                for t in f | (follow[i] if e else set()):
                    self.pick[i][t] = (*self.pick[i].get(t, ()), (slot, mask))
        for name in self._greedy:
            table = self.pick[self._names[name]]
            for t, choices in table.items():
                table[t] = tuple(c for c in choices if self.op[c[0]] != END) or choices
        self._n = n
        self._seconds(empty, first, follow)
        del self._items

    def _seconds(self, empty, first, follow) -> None:
        """What can come second: narrows the choices that one symbol leaves open, kept as (nonterminal, first, second)."""
        rules = self._rules
        stop = 1 << len(self.terminals)  # the derivation may end after the first symbol
        bits = [sum(1 << t for t in f) for f in first]
        second: list[dict[int, int]] = [{} for _ in rules]

        def heads(seq) -> int:
            out = 0
            for kind, x in seq:
                if kind == "t":
                    return out | 1 << x
                out |= bits[x]
                if not empty[x]:
                    return out
            return out | stop

        rest = {(i, a, k): heads(seq[k + 1 :]) for i, alts in enumerate(rules) for a, (_, seq) in enumerate(alts) for k in range(len(seq))}

        def of(i: int, a: int, seq) -> dict[int, int]:
            out: dict[int, int] = {}
            for k, (kind, x) in enumerate(seq):
                r = rest[(i, a, k)]
                if kind == "t":
                    out[x] = out.get(x, 0) | r
                    return out
                for t, s in second[x].items():
                    out[t] = out.get(t, 0) | (s & ~stop | r if s & stop else s)
                if not empty[x]:
                    return out
            return out

        changed = True
        while changed:
            changed = False
            for i, alts in enumerate(rules):
                mine = second[i]
                for a, (_, seq) in enumerate(alts):
                    for t, s in of(i, a, seq).items():
                        if s & ~mine.get(t, 0):
                            mine[t] = mine.get(t, 0) | s
                            changed = True
        after = [sum(1 << t for t in f) for f in follow]
        self.pick2: list[dict[int, dict[int, tuple]]] = [{} for _ in rules]
        at = {}
        slot = 0
        for i, alts in enumerate(rules):
            for a, (_, seq) in enumerate(alts):
                at[slot] = (i, a, seq)
                slot += len(seq) + (1 if not seq or seq[-1][0] == "t" else 0)
        every = range(len(self.terminals))
        for i, table in enumerate(self.pick):
            for t, choices in table.items():
                if len(choices) < 2:
                    continue
                ends = 0  # what can come after the end of this nonterminal, whatever that is
                sets = []
                for s, m in choices:
                    _, a, seq = at[s]
                    d = of(i, a, seq).get(t, 0)
                    if d & stop:
                        d = d & ~stop | after[i]
                    if all(kind == "n" and empty[x] for kind, x in seq) and t in follow[i]:
                        d = -1  # the alternative may be empty, so the second symbol is not its own
                    sets.append((s, m, d | ends))
                self.pick2[i][t] = {u: tuple((s, m) for s, m, d in sets if d >> u & 1) for u in every}

    # -- parsing -----------------------------------------------------------------------------------------------------
    def parse(self, kinds: list[int]) -> tuple[int, int]:
        """(dialects that accept, furthest position that could not go on) of token kinds; an end token is added."""
        kinds = [*kinds, 0, 0]
        op, arg, pick, pick2, n = self.op, self.arg, self.pick, self.pick2, self._n
        end = len(kinds) - 2
        slot, pos, mask, stack = -1, 0, self.all, []
        # one stack, as long as there is no choice
        a, o = self.start, CALL
        while True:
            if o == TERM:
                if kinds[pos] != arg[slot]:
                    return 0, pos
                pos += 1
                slot += 1
            elif o == END:
                if not stack:
                    return (mask, pos) if pos == end else (0, pos)
                slot = stack.pop()
            else:
                alts = pick[a].get(kinds[pos], ())
                if len(alts) > 1:
                    alts = [x for x in pick2[a][kinds[pos]][kinds[pos + 1]] if x[1] & mask]
                    if len(alts) > 1:
                        break
                if not alts or not alts[0][1] & mask:
                    return 0, pos
                if o == CALL and slot >= 0:
                    stack.append(slot + 1)
                slot, m = alts[0]
                mask &= m
            o = op[slot]
            a = arg[slot]
        top = [[], {}, mask]  # edges, popped: position -> dialects, dialects begun
        node = top
        for back in stack:
            node = [[(back, node, mask)], {}, mask]
        if o == CALL and slot >= 0:
            node = [[(slot + 1, node, mask)], {}, mask]
        nodes: dict[int, list] = {}
        seen: dict[tuple, int] = {}
        accepted, far = 0, pos
        work = [(s, node, pos, m & mask) for s, m in alts]
        while work:
            slot, node, pos, mask = work.pop()
            while True:
                o = op[slot]
                if o == TERM:
                    if kinds[pos] == arg[slot]:
                        pos += 1
                        slot += 1
                        continue
                    if pos > far:
                        far = pos
                    break
                if o == END:
                    popped = node[1]
                    mask &= ~popped.get(pos, 0)
                    if not mask:
                        break
                    popped[pos] = popped.get(pos, 0) | mask
                    if node is top:
                        if pos == end:
                            accepted |= mask
                        elif pos > far:
                            far = pos
                        break
                    edges = node[0]
                    if len(edges) > 1:
                        for s, u, m in edges[1:]:
                            if m & mask:
                                work.append((s, u, pos, m & mask))
                    slot, node, m = edges[0]
                    mask &= m
                    if mask:
                        continue
                    break
                a = arg[slot]
                alts = pick[a].get(kinds[pos])
                if alts is not None and len(alts) > 1:
                    alts = pick2[a][kinds[pos]][kinds[pos + 1]]
                if not alts:
                    if pos > far:
                        far = pos
                    break
                if o == CALL:
                    key = pos * n + a
                    old = nodes.get(key)
                    if old is None:
                        node = nodes[key] = [[(slot + 1, node, mask)], {}, mask]
                    else:
                        edges = old[0]
                        for e in edges:
                            if e[0] == slot + 1 and e[1] is node and not mask & ~e[2]:
                                break
                        else:
                            edges.append((slot + 1, node, mask))
                            for p, m in old[1].items():
                                if m & mask:
                                    work.append((slot + 1, node, p, m & mask))
                        mask &= ~old[2]
                        if not mask:
                            break
                        old[2] |= mask
                        node = old
                if len(alts) == 1:
                    slot, m = alts[0]
                    mask &= m
                    if mask:
                        continue
                    break
                for s, m in alts:
                    m &= mask
                    was = seen.get((s, id(node), pos), 0)
                    if m & ~was:
                        seen[(s, id(node), pos)] = was | m
                        work.append((s, node, pos, m & ~was))
                break
        return accepted, far
