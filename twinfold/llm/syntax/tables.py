"""LALR(1) tables from a grammar text, and the parser that runs them.

Grammar text: `name : alternative | alternative ;` with 'quoted' or UPPERCASE
terminals, lower-case nonterminals, ( ) groups and the suffixes ? * +. The first
rule is the start. Lookaheads come from the relations of DeRemer and Pennello.

A cell may hold several actions; the parser then follows all of them side by side
on a graph-structured stack: stacks that end in the same state are one node with
several nodes below it, so there are never more heads than states and an
ambiguous stretch costs polynomial time, whatever it is. It only recognises: no
tree is built.

Nodes are interned, and what a set of heads becomes by a token is remembered with
the set. Source text repeats its constructions, so nearly every token of a corpus
is one look-up; only a construction met for the first time runs the tables.
"""

from __future__ import annotations

import re

_LEX = re.compile(r"\s*(?:(#[^\n]*)|('(?:[^'\\]|\\.)+'|\w+|[:|;()?*+]))")


#: Sets of heads remembered at most; beyond it all are forgotten, which changes no result.
REMEMBERED = 50_000


class Tables:
    def __init__(self, action: list[dict], goto: list[dict], sizes: list[int], heads: list[int]):
        self.action, self.goto, self.sizes, self.heads = action, goto, sizes, heads


def read_grammar(text: str) -> tuple[str, dict[str, list[tuple[str, ...]]]]:
    toks = [m[2] for m in _LEX.finditer(text) if m[2]]
    rules: dict[str, list[tuple[str, ...]]] = {}
    made: dict[tuple, str] = {}
    i = 0

    def alternatives(stop: str) -> list[tuple[str, ...]]:
        nonlocal i
        out: list[tuple[str, ...]] = []
        seqs: list[tuple[str, ...]] = [()]
        while True:
            t = toks[i]
            if t in ("|", stop):
                out += seqs
                seqs = [()]
                i += 1
                if t == stop:
                    return list(dict.fromkeys(out))
                continue
            i += 1
            if t == "(":
                opts = alternatives(")")
            else:
                opts = [(t[1:-1].replace("\\'", "'").replace("\\\\", "\\") if t[0] == "'" else t if t.isupper() else f"<{t}>",)]
            suffix = toks[i] if toks[i] in "?*+" else ""
            if suffix:
                i += 1
            if suffix in ("*", "+"):
                key = tuple(opts)
                if key not in made:
                    made[key] = name = f"<list {len(made)}>"
                    rules[name] = [o for o in opts] + [(name, *o) for o in opts]
                opts = [(made[key],)]
            if suffix in ("?", "*"):
                opts = [(), *opts]
            seqs = [s + o for s in seqs for o in opts]

    start = f"<{toks[0]}>"
    while i < len(toks):
        name = f"<{toks[i]}>"
        i += 2
        rules.setdefault(name, []).extend(alternatives(";"))
    return start, {k: list(dict.fromkeys(v)) for k, v in rules.items()}


def _digraph(nodes, rel, base):
    """The union of `base` over everything reachable by `rel` (sets as bit masks)."""
    out, low, stack = {}, {}, []
    for root in nodes:
        if root in low:
            continue
        work = [(root, iter(rel.get(root, ())))]
        stack.append(root)
        low[root] = len(stack)
        out[root] = base.get(root, 0)
        depth = {root: len(stack)}
        while work:
            x, it = work[-1]
            for y in it:
                if y not in low:
                    stack.append(y)
                    low[y] = depth[y] = len(stack)
                    out[y] = base.get(y, 0)
                    work.append((y, iter(rel.get(y, ()))))
                    break
                low[x] = min(low[x], low[y])
                out[x] |= out[y]
            else:
                work.pop()
                if work:
                    p = work[-1][0]
                    low[p] = min(low[p], low[x])
                    out[p] |= out[x]
                if low[x] == depth.get(x):
                    while True:
                        y = stack.pop()
                        low[y] = 1 << 60
                        out[y] = out[x]
                        if y == x:
                            break
    return out


def build(text: str, prefer_shift=()) -> Tables:
    """Tables of a grammar; on the terminals of `prefer_shift` a shift wins over reductions."""
    start, rules = read_grammar(text)
    prods: list[tuple[str, tuple[str, ...]]] = [("$start", (start,))]
    of: dict[str, list[int]] = {}
    for name, alts in rules.items():
        for a in alts:
            of.setdefault(name, []).append(len(prods))
            prods.append((name, a))
    nullable: set[str] = set()
    grew = True
    while grew:
        grew = False
        for lhs, rhs in prods:
            if lhs not in nullable and all(s in nullable for s in rhs):
                nullable.add(lhs)
                grew = True

    # LR(0) states; an item is (production, dot)
    closed: dict[str, list[int]] = {}

    def first_prods(nt: str) -> list[int]:
        if nt not in closed:
            seen, todo = {nt}, [nt]
            got: list[int] = []
            while todo:
                for p in of[todo.pop()]:
                    got.append(p)
                    rhs = prods[p][1]
                    if rhs and rhs[0] in of and rhs[0] not in seen:
                        seen.add(rhs[0])
                        todo.append(rhs[0])
            closed[nt] = got
        return closed[nt]

    def closure(kernel) -> set:
        items = set(kernel)
        for p, d in kernel:
            rhs = prods[p][1]
            if d < len(rhs) and rhs[d] in of:
                items.update((q, 0) for q in first_prods(rhs[d]))
        return items

    states: dict[frozenset, int] = {}
    kernels: list[frozenset] = []
    move: list[dict[str, int]] = []
    ends: list[list[int]] = []

    def state(k: frozenset) -> int:
        if k not in states:
            states[k] = len(kernels)
            kernels.append(k)
        return states[k]

    state(frozenset([(0, 0)]))
    i = 0
    while i < len(kernels):
        after: dict[str, set] = {}
        done: list[int] = []
        for p, d in closure(kernels[i]):
            rhs = prods[p][1]
            if d < len(rhs):
                after.setdefault(rhs[d], set()).add((p, d + 1))
            else:
                done.append(p)
        move.append({s: state(frozenset(k)) for s, k in sorted(after.items())})
        ends.append(sorted(done))
        i += 1

    terms = {s for _, rhs in prods for s in rhs if s not in of} | {"$"}
    bit = {t: 1 << k for k, t in enumerate(sorted(terms))}
    trans = [(p, s) for p in range(len(move)) for s in move[p] if s in of]
    direct, reads = {}, {}
    for p, a in trans:
        r = move[p][a]
        direct[p, a] = sum(bit[t] for t in move[r] if t in bit) | (bit["$"] if p == 0 and a == start else 0)
        reads[p, a] = [(r, c) for c in move[r] if c in nullable and c in of]
    read = _digraph(trans, reads, direct)
    includes: dict = {}
    lookback: dict = {}
    for p, b in trans:
        for q in of[b]:
            rhs, at = prods[q][1], p
            for k, s in enumerate(rhs):
                if s in of and all(x in nullable for x in rhs[k + 1 :]):
                    includes.setdefault((at, s), []).append((p, b))
                at = move[at][s]
            lookback.setdefault((at, q), []).append((p, b))
    follow = _digraph(trans, includes, read)

    names = {t: k for k, t in enumerate(sorted(rules))}
    action: list[dict] = []
    goto: list[dict] = []
    for p in range(len(move)):
        row: dict = {t: (s,) for t, s in move[p].items() if t in bit}
        for q in ends[p]:
            if q == 0:
                row["$"] = (*row.get("$", ()), 0)
                continue
            la = 0
            for x in lookback.get((p, q), ()):
                la |= follow[x]
            for t, b in bit.items():
                if la & b:
                    row[t] = (*row.get(t, ()), -q)
        for t in prefer_shift:
            if t in row and row[t][0] > 0:
                row[t] = row[t][:1]
        action.append({t: a[0] if len(a) == 1 else a for t, a in row.items()})
        goto.append({names[s]: t for s, t in move[p].items() if s in of})
    return Tables(action, goto, [len(r) for _, r in prods], [names.get(lhs, -1) for lhs, _ in prods])


class Node:
    """A state on top of any of the nodes `below`; one object per such pair."""

    __slots__ = ("state", "below")

    def __init__(self, state: int, below: frozenset):
        self.state, self.below = state, below


class _Open:
    """A head while the reductions of one token are followed: its set grows."""

    __slots__ = ("state", "below", "closed")

    def __init__(self, state: int, below):
        self.state, self.below, self.closed = state, set(below), None


class Heads(dict):
    """A set of heads as a map from a token to the set after it: False where no
    reading goes on, True where the input is accepted."""

    __slots__ = ("nodes", "machine")

    def __missing__(self, tok: str):
        self[tok] = out = self.machine.step(self.nodes, tok)
        return out


class Machine:
    """The parser of one grammar with what it remembers."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.forget()

    def forget(self) -> None:
        self.interned: dict[tuple, Node] = {}
        self.known: dict[frozenset, Heads] = {}

    def heads(self, nodes: frozenset) -> Heads:
        h = self.known.get(nodes)
        if h is None:
            h = self.known[nodes] = Heads()
            h.nodes, h.machine = nodes, self
        return h

    def start(self) -> Heads:
        if len(self.known) > REMEMBERED:
            self.forget()
        return self.heads(frozenset((self.node(0, frozenset()),)))

    def fresh(self, h: Heads) -> Heads:
        """`h` again after forgetting, where too much is remembered."""
        if len(self.known) <= REMEMBERED:
            return h
        self.forget()
        return self.heads(h.nodes)

    def node(self, state: int, below: frozenset) -> Node:
        key = (state, below)
        n = self.interned.get(key)
        if n is None:
            n = self.interned[key] = Node(state, below)
        return n

    def step(self, nodes: frozenset, tok: str):
        action, goto, sizes, heads = self.tables.action, self.tables.goto, self.tables.sizes, self.tables.heads
        if len(nodes) == 1:  # the common case: one head, one action, one node below
            (n,) = nodes
            while True:
                a = action[n.state].get(tok)
                if a is None:
                    return False
                if a.__class__ is not int:
                    break
                if a > 0:
                    return self.heads(frozenset((self.node(a, frozenset((n,))),)))
                if a == 0:
                    return True
                base = n
                for _ in range(sizes[-a]):
                    if len(base.below) != 1:
                        base = None
                        break
                    (base,) = base.below
                if base is None:
                    break
                n = self.node(goto[base.state][heads[-a]], frozenset((base,)))
            nodes = (n,)
        front = {n.state: _Open(n.state, n.below) for n in nodes}
        todo = [(w, None) for w in front.values()]  # a head, and the one new node below it, or None for all
        inner = []  # open heads that stand on open heads, by an empty rule
        shifts: dict[int, set] = {}
        while todo:
            w, new = todo.pop()
            acts = action[w.state].get(tok)
            if acts is None:
                continue
            for a in (acts,) if acts.__class__ is int else acts:
                if a > 0:
                    shifts.setdefault(a, set()).add(w)
                    continue
                if a == 0:
                    return True
                m = sizes[-a]
                if not m:
                    bases = {w}
                else:
                    bases = {new} if new else set(w.below)
                    for _ in range(m - 1):
                        bases = set().union(*(b.below for b in bases))
                for base in bases:
                    state = goto[base.state].get(heads[-a])
                    if state is None:
                        continue
                    v = front.get(state)
                    if v is None:
                        v = front[state] = _Open(state, ())
                    if base not in v.below:
                        v.below.add(base)
                        if base.__class__ is _Open:
                            inner.append(v)
                        todo.append((v, base))
                        todo += [(x, None) for x in inner if x is not v]
        if not shifts:
            return False
        return self.heads(frozenset(self.node(a, frozenset(self.close(w) for w in ws)) for a, ws in shifts.items()))

    def close(self, w) -> Node:
        if w.__class__ is Node:
            return w
        if w.closed is None:
            w.closed = self.node(w.state, frozenset(self.close(b) for b in w.below))
        return w.closed


def parse(machine: Machine, tokens: list[str], may_end=None) -> int:
    """-1 if the grammar derives `tokens`, else the index of the first token at
    which no derivation goes on (len(tokens) for an unexpected end).

    may_end(i): whether a statement may end before token i without a sign of its
    own; the terminal END is then tried where the token itself does not fit."""
    h = machine.start()
    i = 0
    for i, tok in enumerate(tokens):
        nxt = h[tok]
        if nxt is False:
            if may_end is None or not may_end(i):
                return i
            nxt = h["END"]
            nxt = nxt if nxt is False else nxt[tok]
            if nxt is False:
                return i
        h = nxt
        if not i & 0xFFF:
            h = machine.fresh(h)
    n = len(tokens)
    if h["$"] is True:
        return -1
    if may_end is not None and may_end(n):
        h = h["END"]
        if h is not False and h["$"] is True:
            return -1
    return n
