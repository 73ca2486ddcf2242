"""Parsing-expression grammars with packrat memoisation, compiled to Python functions.

Notation: Rule <- expression; alternatives '/', sequence by juxtaposition, ( ) * + ? & !, 'x' a keyword or mark (the kind
of a token), "x" a token with this text whatever its kind, UPPER a kind of token, @nl / @join predicates on the line break
before a token, FAIL. A parse must consume all tokens; otherwise the furthest position that any terminal failed at tells
where the text stops being valid. `prune` skips an alternative whose first token can't match, which changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_TOK = re.compile(r"""\s+|\#[^\n]*|(?P<arrow><-)|(?P<lit>'(?:\\.|[^'\\])+')|(?P<soft>"(?:\\.|[^"\\])+")|(?P<at>@\w+)|(?P<name>[A-Za-z_]\w*)|(?P<op>[/*+?&!()])""")


class Node:
    __slots__ = ("op", "args")

    def __init__(self, op: str, *args):
        self.op, self.args = op, args


def read(text: str) -> dict[str, Node]:
    toks, at = [], 0
    while at < len(text):
        m = _TOK.match(text, at)
        if not m:
            raise SyntaxError(f"grammar: {text[at : at + 30]!r}")
        at = m.end()
        if m.lastgroup:
            toks.append((m.lastgroup, m.group()))
    rules: dict[str, Node] = {}
    i = 0

    def choice() -> Node:
        nonlocal i
        alts = [sequence()]
        while i < len(toks) and toks[i][1] == "/":
            i += 1
            alts.append(sequence())
        return alts[0] if len(alts) == 1 else Node("choice", *alts)

    def sequence() -> Node:
        nonlocal i
        items = []
        while i < len(toks) and toks[i][1] not in ("/", ")") and not (toks[i][0] == "name" and i + 1 < len(toks) and toks[i + 1][0] == "arrow"):
            items.append(prefixed())
        return items[0] if len(items) == 1 else Node("seq", *items)

    def prefixed() -> Node:
        nonlocal i
        kind, t = toks[i]
        if kind == "op" and t in "&!":
            i += 1
            return Node("and" if t == "&" else "not", prefixed())
        i += 1
        if t == "(":
            n = choice()
            assert toks[i][1] == ")", toks[i : i + 3]
            i += 1
        elif kind == "lit":
            n = Node("kind", t[1:-1].replace("\\'", "'"))
        elif kind == "soft":
            n = Node("text", t[1:-1].replace('\\"', '"'))
        elif kind == "at":
            n = Node("at", t[1:])
        else:
            n = Node("rule", t) if any(c.islower() for c in t) else Node("fail") if t == "FAIL" else Node("kind", t) if t != "WORD" else Node("word")
        while i < len(toks) and toks[i][0] == "op" and toks[i][1] in "*+?":
            n = Node({"*": "star", "+": "plus", "?": "opt"}[toks[i][1]], n)
            i += 1
        return n

    while i < len(toks):
        name = toks[i][1]
        assert toks[i + 1][0] == "arrow", toks[i : i + 3]
        i += 2
        rules[name] = choice()
    for n in list(rules.values()):
        _check(n, rules)
    return rules


def _check(n: Node, rules: dict) -> None:
    if n.op == "rule" and n.args[0] not in rules:
        raise SyntaxError(f"grammar: no rule {n.args[0]}")
    for a in n.args:
        if isinstance(a, Node):
            _check(a, rules)


def _first(n: Node, rules: dict, known: dict) -> tuple[frozenset | None, bool]:
    """(kinds a match can begin with, or None for any; whether it can match nothing)."""
    if n.op == "kind":
        return frozenset([n.args[0]]), False
    if n.op in ("text", "word"):
        return None, False
    if n.op in ("and", "not", "at"):
        return frozenset(), True
    if n.op == "fail":
        return frozenset(), False
    if n.op == "rule":
        return known.get(n.args[0], (frozenset(), False))
    if n.op in ("star", "opt"):
        return _first(n.args[0], rules, known)[0], True
    if n.op == "plus":
        return _first(n.args[0], rules, known)
    if n.op == "choice":
        parts = [_first(a, rules, known) for a in n.args]
        kinds = None if any(k is None for k, _ in parts) else frozenset().union(*(k for k, _ in parts))
        return kinds, any(e for _, e in parts)
    kinds: frozenset | None = frozenset()
    for a in n.args:
        k, empty = _first(a, rules, known)
        kinds = None if kinds is None or k is None else kinds | k
        if not empty:
            return kinds, False
    return kinds, True


class _Writer:
    def __init__(self, rules: dict):
        self.rules, self.lines, self.n = rules, [], 0
        self.sets: dict[frozenset, str] = {}
        known: dict[str, tuple] = {}
        while True:
            new = {r: _first(n, rules, known) for r, n in rules.items()}
            if new == known:
                break
            known = new
        self.known = known

    def var(self) -> str:
        self.n += 1
        return f"v{self.n}"

    def put(self, depth: int, line: str) -> None:
        self.lines.append("    " * depth + line)

    def guard(self, n: Node) -> str | None:
        kinds, empty = _first(n, self.rules, self.known)
        if kinds is None or empty or len(kinds) > 60:
            return None
        if len(kinds) == 1:
            return f"== {next(iter(kinds))!r}"
        return "in " + self.sets.setdefault(kinds, f"S{len(self.sets)}")

    def emit(self, n: Node, at: str, to: str, d: int) -> None:
        put = self.put
        if n.op in ("kind", "text", "word"):
            test = f"K[{at}] == {n.args[0]!r}" if n.op == "kind" else f"V[{at}] == {n.args[0]!r}" if n.op == "text" else f"W[{at}]"
            put(d, f"if {test}: {to} = {at} + 1")
            put(d, "else:")
            put(d + 1, f"{to} = -1")
            put(d + 1, f"if {at} > far: far = {at}")
        elif n.op == "at":
            put(d, f"{to} = {at} if {'L' if n.args[0] == 'nl' else 'not L'}[{at}] else -1")
        elif n.op == "fail":
            put(d, f"{to} = -1")
        elif n.op == "rule":
            put(d, f"{to} = r_{n.args[0]}({at})")
        elif n.op == "seq":
            if not n.args:
                put(d, f"{to} = {at}")
                return
            put(d, "while True:")
            cur = at
            for k, a in enumerate(n.args):
                v = self.var() if k + 1 < len(n.args) else to
                self.emit(a, cur, v, d + 1)
                if k + 1 < len(n.args):
                    put(d + 1, f"if {v} < 0:")
                    put(d + 2, f"{to} = -1")
                    put(d + 2, "break")
                cur = v
            put(d + 1, "break")
        elif n.op == "choice":
            put(d, f"{to} = -1")
            put(d, "while True:")
            for a in n.args:
                g = self.guard(a)
                if g:
                    put(d + 1, f"if K[{at}] {g}:")
                    self.emit(a, at, to, d + 2)
                    put(d + 2, f"if {to} >= 0: break")
                    put(d + 1, f"elif {at} > far: far = {at}")
                else:
                    self.emit(a, at, to, d + 1)
                    put(d + 1, f"if {to} >= 0: break")
            put(d + 1, "break")
        elif n.op in ("star", "plus"):
            v = self.var()
            put(d, f"{to} = {at}")
            if n.op == "plus":
                self.emit(n.args[0], at, to, d)
                put(d, f"while {to} >= 0:")
            else:
                put(d, "while True:")
            g = self.guard(n.args[0])
            if g:
                put(d + 1, f"if not K[{to}] {g}:" if not g.startswith("in") else f"if K[{to}] not {g}:")
                put(d + 2, f"if {to} > far: far = {to}")
                put(d + 2, "break")
            self.emit(n.args[0], to, v, d + 1)
            put(d + 1, f"if {v} <= {to}: break")
            put(d + 1, f"{to} = {v}")
        elif n.op == "opt":
            g = self.guard(n.args[0])
            if g:
                put(d, f"if K[{at}] {g}:")
                self.emit(n.args[0], at, to, d + 1)
                put(d + 1, f"if {to} < 0: {to} = {at}")
                put(d, "else:")
                put(d + 1, f"{to} = {at}")
                put(d + 1, f"if {at} > far: far = {at}")
            else:
                self.emit(n.args[0], at, to, d)
                put(d, f"if {to} < 0: {to} = {at}")
        else:
            v, f = self.var(), self.var()
            put(d, f"{f} = far")
            self.emit(n.args[0], at, v, d)
            put(d, f"far = {f}")
            put(d, f"{to} = {at} if {v} {'>=' if n.op == 'and' else '<'} 0 else -1")


def compile_grammar(text: str, start: str) -> Callable[[list, list, list, list], tuple[bool, int]]:
    """parse(kinds, texts, words, line_breaks) -> (whole input consumed, furthest failing token). Kinds end with 'EOF'."""
    rules = read(text)
    w = _Writer(rules)
    for name, node in rules.items():
        w.put(1, f"m_{name} = {{}}")
        w.put(1, f"def r_{name}(i):")
        w.put(2, "nonlocal far")
        w.put(2, f"r = m_{name}.get(i)")
        w.put(2, "if r is not None: return r")
        w.emit(node, "i", "r", 2)
        w.put(2, f"m_{name}[i] = r")
        w.put(2, "return r")
    head = [f"{v} = {set(k)!r}" for k, v in w.sets.items()]
    code = [*head, "def parse(K, V, W, L):", "    far = 0", *w.lines, f"    end = r_{start}(0)", "    n = len(K)", "    return end == n or (end >= 0 and K[end] == 'EOF'), min(max(far, end, 0), n - 1)"]
    space: dict = {}
    exec(compile("\n".join(code), f"<grammar {start}>", "exec"), space)  # noqa: S102 - code written by this module from a constant grammar
    return space["parse"]
