"""Token streams for the grammars: parallel lists of kinds, texts, word flags, line-break flags and character positions."""

from __future__ import annotations

import re

# Reserved words of the languages.
GO = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
JAVA = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
)
JS = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split())
PY = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())


class Tokens:
    __slots__ = ("K", "V", "W", "L", "P")

    def __init__(self):
        self.K, self.V, self.W, self.L, self.P = [], [], [], [], []

    def add(self, kind: str, text: str, word: bool, nl: bool, pos: int) -> None:
        self.K.append(kind)
        self.V.append(text)
        self.W.append(word)
        self.L.append(nl)
        self.P.append(pos)

    def end(self, pos: int) -> "Tokens":
        self.add("EOF", "", False, True, pos)
        return self


def _scanner(parts: list[tuple[str, str]]) -> re.Pattern:
    return re.compile("|".join(f"(?P<{n}>{p})" for n, p in parts), re.S)


_NUM = r"0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?[nLlui]*|0[bB][01_]+[nLl]?|0[oO][0-7_]+n?|(?:\d[\d_]*(?:\.(?!\.)[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[nLlFfDdi]?(?![\w])"
_ID = r"[^\W\d][\w$]*|\$[\w$]*"

_go = _scanner(
    [
        ("ws", r"[ \t\r\f]+"), ("nl", r"\n"), ("com", r"//[^\n]*|/\*.*?\*/"), ("str", r'"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\(?:[abfnrtv\\\'"]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3})|[^\'\\\n])\''),
        ("num", _NUM), ("id", r"[^\W\d]\w*"), ("op", r"<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~]"), ("bad", r"."),
    ]
)
_GO_END = frozenset(["NAME", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])


def go(text: str) -> Tokens:
    t, nl, last = Tokens(), False, ""
    for m in _go.finditer(text):
        kind, s = m.lastgroup, m.group()
        if kind == "ws":
            continue
        if kind == "nl" or (kind == "com" and (s[:2] == "//" or "\n" in s)):
            if kind == "nl" or s[:2] == "/*":
                if last in _GO_END:
                    t.add(";", "\n", False, True, m.start())
                    last = ";"
                nl = True
            continue
        if kind == "com":
            continue
        last = {"str": "STR", "num": "NUM", "bad": "ERR"}.get(kind) or (s if kind == "op" or s in GO else "NAME")
        t.add(last, s, kind == "id", nl, m.start())
        nl = False
    if last in _GO_END:
        t.add(";", "\n", False, True, len(text))
    return t.end(len(text))


_java = _scanner(
    [
        ("ws", r"\s+"), ("com", r"//[^\n]*|/\*.*?\*/"), ("str", r'"""(?:\\.|(?!""").)*"""|"(?:\\.|[^"\\\n])*"|\'(?:\\(?:[btnfrs0-7"\'\\]|u+[0-9a-fA-F]{4}|[0-7]{1,3})|[^\'\\\n])\''),
        ("num", _NUM), ("id", _ID), ("op", r"\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<=|<<|[-+*/%&|^<>=!()\[\]{},;.:?@~]"), ("bad", r"."),
    ]
)


def java(text: str) -> Tokens:
    t = Tokens()
    for m in _java.finditer(text):
        kind, s = m.lastgroup, m.group()
        if kind in ("ws", "com"):
            continue
        k = {"str": "STR", "num": "NUM", "bad": "ERR"}.get(kind) or (s if kind == "op" or s in JAVA else "NAME")
        t.add(k, s, kind == "id", False, m.start())
    return t.end(len(text))


_js = _scanner(
    [
        ("ws", r"[^\S\n\u2028\u2029]+|\ufeff"), ("nl", r"[\n\u2028\u2029]"), ("com", r"//[^\n\u2028\u2029]*|/\*.*?\*/|<!--[^\n]*"), ("str", r'"(?:\\(?:\r\n|.)|[^"\\\n])*"|\'(?:\\(?:\r\n|.)|[^\'\\\n])*\''),
        ("num", _NUM), ("id", r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$]|\\u[0-9a-fA-F]{4}|\u200c|\u200d)*"), ("priv", r"#[^\W\d][\w$]*"), ("tpl", r"`"), ("slash", r"/(?![/*])"),
        ("op", r">>>=|\.\.\.|\?\?=|\*\*=|&&=|\|\|=|===|!==|<<=|=>|\?\?|\?\.(?!\d)|\*\*|\+\+|--|&&|\|\||==|!=|<=|\+=|-=|\*=|%=|&=|\|=|\^=|<<|[-+*%&|^<>=!()\[\]{},;.:?@~]"), ("bad", r"."),
    ]
)
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_CHUNK = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
_VALUE_END = frozenset(["NAME", "NUM", "STR", "REGEX", "TPL", "TPLEND", "PRIV", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--"])


def js(text: str) -> Tokens:
    t, at, nl, last = Tokens(), 0, False, ""
    depth: list[int] = []  # brace depth inside each open template substitution
    n = len(text)
    if text.startswith("#!"):
        at = text.find("\n")
        at = n if at < 0 else at

    def put(k: str, s: str, word: bool, pos: int) -> None:
        nonlocal nl, last
        t.add(k, s, word, nl, pos)
        nl, last = False, k

    def template(pos: int, opened: bool) -> int:
        """From after a backquote or the brace that ends a substitution, to the next of either."""
        m = _CHUNK.match(text, pos)
        end = m.end()
        if text.startswith("${", end):
            put("TPLHEAD" if opened else "TPLMID", "", False, pos)
            depth.append(0)
            return end + 2
        if text.startswith("`", end):
            put("TPL" if opened else "TPLEND", "", False, pos)
            return end + 1
        put("ERR", "`", False, pos)
        return n

    while at < n:
        m = _js.match(text, at)
        kind, s = m.lastgroup, m.group()
        pos, at = at, m.end()
        if kind == "ws":
            continue
        if kind == "nl" or kind == "com":
            nl = nl or kind == "nl" or "\n" in s
            continue
        if kind == "slash":
            r = None if last in _VALUE_END else _REGEX.match(text, pos)
            if r:
                at = r.end()
                put("REGEX", r.group(), False, pos)
            else:
                if text.startswith("/=", pos):
                    at = pos + 2
                put(text[pos:at], text[pos:at], False, pos)
        elif kind == "tpl":
            at = template(at, True)
        elif kind == "op":
            if depth:
                if s == "{":
                    depth[-1] += 1
                elif s == "}":
                    if not depth[-1]:
                        depth.pop()
                        at = template(at, False)
                        continue
                    depth[-1] -= 1
            put(s, s, False, pos)
        elif kind == "id":
            put(s if s in JS else "NAME", s, True, pos)
        else:
            put({"str": "STR", "num": "NUM", "priv": "PRIV", "bad": "ERR"}[kind], s, False, pos)
    if depth:
        put("ERR", "`", False, n)
    return t.end(n)


_py = _scanner(
    [
        ("ws", r"[ \t\f]+|\\\r?\n"), ("com", r"#[^\n]*"), ("nl", r"\r?\n|\r"),
        ("str", r"(?:[rRbBuUfFtT]{1,2}(?=[\"']))?(?:\"\"\"(?:\\.|(?!\"\"\").)*\"\"\"|'''(?:\\.|(?!''').)*'''|\"(?!\"\")(?:\\(?:\r\n|.)|[^\"\\\n])*\"|'(?!'')(?:\\(?:\r\n|.)|[^'\\\n])*')"),
        ("num", r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:[1-9](?:_?\d)*|0(?:_?0)*)(?:\.(?:\d(?:_?\d)*)?)?|\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?(?![\w])|\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ](?![\w])|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*(?![\w])"),
        ("id", r"[^\W\d]\w*"), ("op", r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%&|^<>=()\[\]{},;.:@~]"), ("bad", r"."),
    ]
)
_INDENT = re.compile(r"[ \t\f]*")


def python(text: str) -> Tokens:
    t = Tokens()
    text = text.removeprefix("﻿")
    at, n, nest = 0, len(text), 0
    levels = [(0, 0)]
    fresh = True  # at the start of a logical line
    while at < n:
        if fresh and not nest:
            m = _INDENT.match(text, at)
            lead, pos = m.group().rpartition("\f")[2], m.end()
            if pos >= n or text[pos] in "#\r\n":
                m = re.compile(r"[^\n]*\n?").match(text, pos)
                at = m.end()
                continue
            col = (len(lead.expandtabs(8)), len(lead.expandtabs(1)))
            if col[0] > levels[-1][0]:
                if col[1] <= levels[-1][1]:
                    t.add("ERR", "tab", False, True, pos)
                levels.append(col)
                t.add("INDENT", "", False, True, pos)
            else:
                while col[0] < levels[-1][0]:
                    levels.pop()
                    t.add("DEDENT", "", False, True, pos)
                if col != levels[-1]:
                    t.add("ERR", "indent", False, True, pos)
            at, fresh = pos, False
            continue
        m = _py.match(text, at)
        kind, s, pos = m.lastgroup, m.group(), at
        at = m.end()
        if kind in ("ws", "com"):
            continue
        if kind == "nl":
            if not nest:
                t.add("NEWLINE", "", False, False, pos)
                fresh = True
            continue
        if kind == "op":
            if s in "([{":
                nest += 1
            elif s in ")]}":
                nest = max(0, nest - 1)
            t.add(s, s, False, False, pos)
        elif kind == "id":
            t.add(s if s in PY else "NAME", s, True, False, pos)
        else:
            t.add({"str": "STR", "num": "NUM", "bad": "ERR"}[kind], s, False, False, pos)
    if nest:
        t.add("ERR", "open bracket", False, True, n)
    if not fresh:
        t.add("NEWLINE", "", False, True, n)
    for _ in levels[1:]:
        t.add("DEDENT", "", False, True, n)
    return t.end(n)


_sql = _scanner(
    [
        ("ws", r"\s+"), ("com", r"--[^\n]*|/\*.*?\*/"), ("dollar", r"\$(?P<tag>\w*)\$.*?\$(?P=tag)\$"), ("str", r"[eEnNbBxX]?'(?:''|[^'])*'"), ("quoted", r'"(?:""|[^"])*"|`[^`\n]*`|\[[A-Za-z_][\w $]*\]'),
        ("num", r"\d+(?:\.\d*)?(?:[eE][+-]?\d+)?(?!\w)|\.\d+(?:[eE][+-]?\d+)?(?!\w)"), ("id", r"[^\W\d][\w$]*|@{1,2}\w+|#{1,2}\w+|:\w+|\$\d+"),
        ("op", r"::|:=|<=>|->>|->|#>>|#>|\|\||<>|!=|<=|>=|=>|@>|<@|~\*|!~\*|!~|~~|&&|\?[|&]?|[-+*/%<>=(),;.~^&|!:\[\]{}@#]"), ("bad", r"."),
    ]
)


def sql(text: str) -> Tokens:
    t = Tokens()
    for m in _sql.finditer(text):
        kind, s = m.lastgroup, m.group()
        if kind in ("ws", "com"):
            continue
        if kind == "id":
            t.add("NAME", s.upper(), True, False, m.start())
        elif kind == "op":
            t.add(s, s, False, False, m.start())
        else:
            t.add({"str": "STR", "dollar": "DOLLAR", "tag": "DOLLAR", "quoted": "QUOTED", "num": "NUM", "bad": "ERR"}[kind], s, False, False, m.start())
    return t.end(len(text))
