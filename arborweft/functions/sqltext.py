"""What a SQL text creates, reads, writes and calls: a tokenizer and one walk over its clauses.

The walk keeps the statement's common table expressions and aliases, the object that the statement belongs to, and the open
brackets, so that names are told apart by the clause they stand in. It reads PostgreSQL, MySQL, T-SQL and Snowflake spellings
and leaves template marks alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKENS = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*.*?(?:\*/|\Z)|\{\#.*?\#\})
    |(?P<j>\{\{.*?\}\}|\{%.*?%\})
    |(?P<d>\$(?P<tag>\w*)\$.*?\$(?P=tag)\$)
    |(?P<s>[nNeE]?'(?:[^']|'')*+'?)
    |(?P<q>"(?:[^"]|"")*+"|`[^`]*`|\[[A-Za-z_][^\]\n]*\])
    |(?P<t>\#\#?\w+|@[\w~%/.]+)
    |(?P<v>\$\d+|:[A-Za-z_]\w*|%s|\?)
    |(?P<w>[^\W\d][\w$]*)
    |(?P<n>\d[\w.]*)
    |(?P<p>::|=>|:=|<>|!=|<=|>=|\|\||.)""",
    re.X | re.S,
)

# Words between CREATE and the kind of object; kinds; words that end a table's place in a clause (so they are no
# alias); words that are no object's name.
MODIFIERS = frozenset("or replace alter temp temporary global local unlogged transient volatile external foreign secure recursive materialized unique dynamic event hybrid iceberg clustered nonclustered fulltext spatial constraint definer".split())
KINDS = {"table": "table", "view": "view", "function": "function", "procedure": "procedure", "proc": "procedure", "trigger": "trigger", "index": "index", "sequence": "sequence", "stage": "stage", "stream": "stream", "task": "task", "schema": "schema", "database": "database", "domain": "domain", "synonym": "synonym", "policy": "policy", "type": "type"}
ROUTINES = frozenset(("function", "procedure", "trigger", "task"))
NO_ALIAS = frozenset(
    "on where join inner left right full cross outer natural group order having limit union except intersect minus using set values as returning window offset fetch for and or when then else end with select from into apply pivot unpivot tablesample lateral qualify go begin if while insert update delete merge output option straight_join connect start match_recognize at before do".split()
)
NO_NAME = frozenset("select values set where lateral unnest only dual table from join on as and or not null case when end exists in is if begin declare with using into distinct all any some into immediate flatten rows next first".split())
ITEM_WORDS = frozenset("constraint primary foreign unique check exclude key index like period".split())
DML = frozenset("select insert update delete merge exec execute".split())
#: Functions whose arguments hold a FROM of their own.
FROM_INSIDE = frozenset("extract substring trim overlay position".split())

Token = tuple[str, str, int]


def tokens(text: str, base: int = 0) -> list[Token]:
    """(kind, value, offset). Kinds: w word, q quoted name (without its quotes), s string, d dollar-quoted body, n number, t
    temporary name, variable or stage, v placeholder, j template, p sign. White space and comments are left out."""
    out = []
    for m in _TOKENS.finditer(text):
        k = m.lastgroup if m.lastgroup != "tag" else "d"
        if k == "skip":
            continue
        v = m[0]
        if k == "q":
            v = v[1:-1].replace('""', '"')
        out.append((k, v, base + m.start()))
    return out


@dataclass
class Script:
    """objects (kind, name, offset), columns (table, name, type), constraints (table, kind, columns, other table), edges
    (owner, kind, name), temps (owner, token, scope). Owner '' is the file."""

    objects: list = field(default_factory=list)
    columns: list = field(default_factory=list)
    constraints: list = field(default_factory=list)
    edges: list = field(default_factory=list)
    temps: list = field(default_factory=list)


class _Walk:
    def __init__(self, text: str):
        self.out = Script()
        self.seen: set = set()
        self.uses: list = []  # (owner, kind, token) of temporary names, settled at the end
        self.owner, self.owner_kind, self.depth = "", "", 0
        self._fresh()
        self.run(tokens(text), text)
        self._finish()
        self._settle()

    def _fresh(self) -> None:
        self.ctes: set[str] = set()
        self.aliases: dict[str, str] = {}
        self.dotted: list[tuple[str, str]] = []
        self.found: list[tuple[str, str]] = []
        self.open: list[bool] = []  # per open bracket: inside a function with a FROM of its own

    def _finish(self) -> None:
        """Emit what the statement's names mean, now that its aliases are known."""
        for kind, name in self.found:
            low = name.lower()
            if low in self.ctes:
                continue
            real = self.aliases.get(low, name) if kind == "writes" and "." not in name else name
            self._edge(kind, real)
        for table, col in self.dotted:
            real = self.aliases.get(table.lower())
            if real and real.lower() not in self.ctes and real[:1] not in "#@":
                self._edge("column", f"{real}.{col}")
        self._fresh()

    def _edge(self, kind: str, name: str) -> None:
        key = (self.owner, kind, name.lower())
        if key not in self.seen:
            self.seen.add(key)
            self.out.edges.append((self.owner, kind, name))

    def _settle(self) -> None:
        """Temporary names: only those declared in the same routine (#x, @x) or anywhere in the file (##x) count."""
        local = {(o, t.lower()) for o, t, scope in self.out.temps if scope == "local"}
        shared = {t.lower() for _, t, scope in self.out.temps if scope == "global"}
        for owner, kind, tok in self.uses:
            low = tok.lower()
            name = tok if low.startswith("##") and low in shared else owner + tok if (owner, low) in local else None
            if name and (owner, kind, name.lower()) not in self.seen:
                self.seen.add((owner, kind, name.lower()))
                self.out.edges.append((owner, kind, name))

    def name(self, t: list[Token], i: int) -> tuple[str | None, int]:
        """A name of up to three parts at i, and the position after it."""
        parts = []
        while i < len(t) and t[i][0] in "wq" and len(parts) < 3:
            parts.append(t[i][1])
            i += 1
            if i + 1 < len(t) and t[i][1] == "." and t[i + 1][0] in "wq" and len(parts) < 3:
                i += 1
            else:
                break
        if not parts or (len(parts) == 1 and t[i - 1][0] == "w" and parts[0].lower() in NO_NAME):
            return None, i
        return ".".join(parts), i

    def target(self, t: list[Token], i: int, kind: str) -> tuple[str | None, int]:
        """A table in the place of a write or read: recorded, with its end."""
        if i < len(t) and t[i][0] == "t":
            if t[i][1][0] == "#" or not re.search(r"[/~%.]", t[i][1]):
                self.uses.append((self.owner, kind, t[i][1]))
            return t[i][1], i + 1
        name, end = self.name(t, i)
        if name:
            self.found.append((kind, name))
        return name, end

    def word(self, t: list[Token], i: int) -> str:
        return t[i][1].lower() if i < len(t) and t[i][0] == "w" else t[i][1] if i < len(t) and t[i][0] == "p" else ""

    def close(self, t: list[Token], i: int) -> int:
        """The position after the bracket that closes the one at i."""
        depth = 0
        for k in range(i, len(t)):
            if t[k][0] == "p":
                depth += (t[k][1] == "(") - (t[k][1] == ")")
                if not depth:
                    return k + 1
        return len(t)

    def run(self, t: list[Token], text: str, inner: bool = False) -> None:
        i = 0
        while i < len(t):
            k, v, at = t[i]
            w = self.word(t, i)
            if k == "d":
                mark = re.match(r"\$\w*\$", v)[0]
                if not inner:
                    self.run(tokens(v[len(mark) : -len(mark)], at + len(mark)), text, True)
            elif k == "p":
                if v == ";":
                    self._finish()
                    if not inner and self.owner and not self.depth and self.owner_kind != "open routine":
                        self.owner, self.owner_kind = "", ""
                elif v == "(":
                    self.open.append(self.word(t, i - 1) in FROM_INSIDE if i else False)
                elif v == ")" and self.open:
                    self.open.pop()
                elif v == "." and i and t[i - 1][0] in "wq" and i + 1 < len(t) and t[i + 1][0] in "wq":
                    alone = (i < 2 or t[i - 2][1] != ".") and not (i + 2 < len(t) and t[i + 2][1] in (".", "("))
                    if alone:
                        self.dotted.append((t[i - 1][1], t[i + 1][1]))
            elif k == "w":
                i = self.clause(t, i, w, inner, text)
                continue
            i += 1

    def clause(self, t: list[Token], i: int, w: str, inner: bool, text: str) -> int:
        """One word of a statement; returns where to go on."""
        nxt = self.word(t, i + 1)
        prev = self.word(t, i - 1) if i else ""
        if prev == ".":
            return i + 1
        if w == "go" and not inner and self._alone(text, t[i][2]):
            self._finish()
            self.owner, self.owner_kind, self.depth = "", "", 0
        elif w == "begin" and nxt not in ("transaction", "tran", "work") or w == "case":
            self.depth += 1
        elif w == "end" and nxt not in ("if", "loop", "case", "while") and self.depth:
            self.depth -= 1
            if not self.depth and self.owner_kind == "open routine" and w == "end" and not inner:
                self._finish()
                self.owner_kind = "routine"
        elif w == "create":
            return self.create(t, i + 1, inner)
        elif w == "alter" and nxt == "table":
            return self.alter(t, i + 2)
        elif w == "with":
            self.with_names(t, i + 1)
        elif w in ("from", "join") and not (self.open and self.open[-1]) and not (w == "from" and prev in ("delete", "distinct")):
            self.tables(t, i + 1, w == "from")
        elif w == "into" and prev in ("insert", "overwrite", "merge", "copy"):
            pass
        elif w == "insert":
            j = i + 1 + (nxt == "overwrite")
            j += self.word(t, j) == "into"
            if j > i + 1:
                self.target(t, j + (self.word(t, j) == "table"), "writes")
        elif w == "into" and i + 1 < len(t) and t[i + 1][0] == "t" and t[i + 1][1][0] == "#":
            self.declare(t[i + 1][1])
            self.target(t, i + 1, "writes")
        elif w == "update" and prev not in ("for", "do", "on", "then", "key", "of", "or", "before", "after", "and"):
            name, end = self.peek(t, i + 1 + (nxt == "only"))
            if self.word(t, end) == "as":
                end += 1
            if self.word(t, end) != "set" and end < len(t) and t[end][0] in "wq" and self.word(t, end + 1) == "set":
                end += 1
            if name and self.word(t, end) == "set":
                self.target(t, i + 1 + (nxt == "only"), "writes")
        elif w == "delete" and prev not in ("on", "then", "or", "before", "after", "and"):
            j = i + 1 + (nxt == "from")
            name, end = self.peek(t, j)
            if name and (nxt == "from" or self.word(t, end) == "from"):
                self.target(t, j, "writes")
        elif w == "merge" and (nxt == "into" or (i + 1 < len(t) and self.word(t, self.peek(t, i + 1)[1]) in ("using", "as"))):
            self.target(t, i + 1 + (nxt == "into"), "writes")
        elif w in ("exec", "execute", "call"):
            j = i + 1
            if self.word(t, j) in ("function", "procedure"):
                j += 1
            if j + 1 < len(t) and t[j][0] == "t" and t[j + 1][1] == "=":
                j += 2
            name, _ = self.name(t, j)
            if name and self.word(t, j) not in ("as", "on", "immediate", "to"):
                self.found.append(("calls", name))
        elif w == "apply" and prev in ("cross", "outer"):
            name, end = self.name(t, i + 1)
            if name and self.word(t, end) == "(":
                self.found.append(("calls", name))
        elif w == "flatten" and nxt == "(":
            j = i + 2
            if self.word(t, j) == "input" and j + 1 < len(t) and t[j + 1][1] == "=>":
                j += 2
            name, end = self.name(t, j)
            if name and "." not in name and self.word(t, end) == ")":
                self.found.append(("references", name))
        elif w == "copy" and nxt == "into":
            self.copy(t, i + 2)
        elif w == "clone":
            self.target(t, i + 1, "references")
        elif w == "output":
            for j in range(i + 1, len(t)):
                x = self.word(t, j)
                if x == "into":
                    self.target(t, j + 1, "writes")
                    break
                if x in DML or t[j][1] == ";":
                    break
        elif w == "references":
            self.target(t, i + 1, "references")
        elif w == "declare" and i + 2 < len(t) and t[i + 1][0] == "t" and "table" in (self.word(t, i + 2), self.word(t, i + 3)):
            self.declare(t[i + 1][1])
        return i + 1

    def _alone(self, text: str, at: int) -> bool:
        return not text[text.rfind("\n", 0, at) + 1 : at].strip() and not text[at + 2 : (text.find("\n", at) + 1 or len(text) + 1) - 1].strip()

    def peek(self, t: list[Token], i: int) -> tuple[str | None, int]:
        return (t[i][1], i + 1) if i < len(t) and t[i][0] == "t" else self.name(t, i)

    def declare(self, tok: str) -> None:
        scope = "global" if tok.startswith("##") else "local"
        if (self.owner or scope == "global") and not any(o == self.owner and x.lower() == tok.lower() for o, x, _ in self.out.temps):
            self.out.temps.append((self.owner, tok, scope))

    def with_names(self, t: list[Token], i: int) -> None:
        """The names that a WITH clause gives."""
        i += self.word(t, i) == "recursive"
        while i < len(t) and t[i][0] in "wq":
            name, j = t[i][1], i + 1
            if self.word(t, j) == "(":
                j = self.close(t, j)
            if self.word(t, j) != "as":
                return
            j += 1
            while self.word(t, j) in ("not", "materialized"):
                j += 1
            if self.word(t, j) != "(":
                return
            self.ctes.add(name.lower())
            j = self.close(t, j)
            if self.word(t, j) != ",":
                return
            i = j + 1

    def tables(self, t: list[Token], i: int, many: bool) -> None:
        """The tables of a FROM or JOIN and their aliases."""
        while True:
            while self.word(t, i) in ("lateral", "only"):
                i += 1
            if self.word(t, i) == "(":
                return
            name, i = self.target(t, i, "references")
            if name is None:
                return
            i += self.word(t, i) == "as"
            if i < len(t) and t[i][0] in "wq" and (t[i][0] == "q" or t[i][1].lower() not in NO_ALIAS):
                self.aliases[t[i][1].lower()] = name
                i += 1
            self.aliases.setdefault(name.split(".")[-1].lower(), name)
            if not many or self.word(t, i) != ",":
                return
            i += 1

    def copy(self, t: list[Token], i: int) -> None:
        """COPY INTO: a stage begins with '@'; the user's and a table's own stage name no object."""
        ends = [i, next((j + 1 for j in range(i, len(t)) if self.word(t, j) == "from"), len(t))]
        for j, kind in zip(ends, ("writes", "references")):
            if j < len(t) and t[j][0] == "t":
                stage = t[j][1][1:].split("/")[0]
                if stage and stage[0] not in "~%":
                    self.found.append((kind, stage))
            elif j < len(t):
                name, _ = self.name(t, j)
                if name:
                    self.found.append((kind, name))

    def create(self, t: list[Token], i: int, inner: bool) -> int:
        while self.word(t, i) in MODIFIERS:
            i += 1
            if t[i - 1][1].lower() == "definer":
                while i < len(t) and self.word(t, i) not in KINDS:
                    i += 1
        kind = KINDS.get(self.word(t, i))
        if self.word(t, i) == "file" and self.word(t, i + 1) == "format":
            kind, i = "file_format", i + 1
        if not kind:
            return i
        i += 1
        while self.word(t, i) in ("if", "not", "exists", "concurrently"):
            i += 1
        if i < len(t) and t[i][0] == "t":  # CREATE TABLE #x
            self.declare(t[i][1])
            return i + 1
        name, j = self.name(t, i)
        if not name:
            return i
        if not inner or kind not in ("table", "view"):
            self._finish()
        self.out.objects.append((kind, name, t[i][2]))
        if not inner:
            dollar = any(x[0] == "d" for x in t[j : j + 400])
            self.owner, self.depth = name, 0
            self.owner_kind = "open routine" if kind in ROUTINES and not dollar else kind
        if kind == "table" and self.word(t, j) == "(":
            self.columns(t, j, name)
        elif kind in ("index", "trigger", "policy", "stream", "synonym"):
            mark = "for" if kind == "synonym" else "on"
            k = next((x for x in range(j, min(len(t), j + 60)) if self.word(t, x) == mark), None)
            if k is not None:
                while kind == "stream" and self.word(t, k + 1) in ("external", "dynamic", "event", "table", "view", "stage"):
                    k += 1
                self.target(t, k + 1, "references")
        elif kind == "task":
            k = next((x for x in range(j, len(t)) if self.word(t, x) in ("after", "as", ";")), len(t))
            while self.word(t, k) in ("after", ","):
                _, k = self.target(t, k + 1, "references")
        return j

    def columns(self, t: list[Token], i: int, table: str) -> None:
        end = self.close(t, i) - 1
        i += 1
        while i < end:
            j, depth = i, 0
            while j < end and not (t[j][1] == "," and t[j][0] == "p" and not depth):
                depth += (t[j][1] == "(" and t[j][0] == "p") - (t[j][1] == ")" and t[j][0] == "p")
                j += 1
            item = t[i:j]
            if item and item[0][0] in "wq" and not (item[0][0] == "w" and item[0][1].lower() in ITEM_WORDS):
                if len(item) > 1 and item[1][0] in "wq":
                    kind = item[1][1]
                    if len(item) > 2 and item[2][1] == "(" and item[2][0] == "p":
                        kind += "".join(x[1] for x in item[2 : self.close(item, 2)])
                    self.out.columns.append((table, item[0][1], kind))
                words = [self.word(item, x) for x in range(len(item))]
                if "primary" in words:
                    self.out.constraints.append((table, "primary key", item[0][1], None))
                if "references" in words:
                    self.out.constraints.append((table, "foreign key", item[0][1], self.name(item, words.index("references") + 1)[0]))
            elif item:
                self.constraint(item, table)
            i = j + 1

    def constraint(self, item: list[Token], table: str) -> None:
        words = [self.word(item, x) for x in range(len(item))]
        for first, second in (("primary", "key"), ("foreign", "key"), ("unique", None), ("check", None)):
            if first in words:
                k = words.index("(", words.index(first)) if "(" in words[words.index(first) :] else None
                cols = ",".join(x[1] for x in item[k + 1 : self.close(item, k) - 1] if x[0] in "wq") if k is not None else None
                other = self.name(item, words.index("references") + 1)[0] if "references" in words else None
                self.out.constraints.append((table, f"{first} {second}" if second else first, cols, other))
                return

    def alter(self, t: list[Token], i: int) -> int:
        while self.word(t, i) in ("if", "exists", "only"):
            i += 1
        name, j = self.name(t, i)
        if not name:
            return i
        end = next((k for k in range(j, len(t)) if t[k][1] == ";" and t[k][0] == "p"), len(t))
        if "add" in (self.word(t, k) for k in range(j, end)):
            self.constraint(t[j:end], name)
        return j


def analyse(text: str | None) -> Script:
    """The Script of a SQL text; an empty text has an empty one."""
    return _Walk(text or "").out


_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,}(?:\.[A-Za-z_][A-Za-z0-9_]+)?")
# Words of a fragment that name nothing.
STOP = frozenset(
    """and as asc between by case desc distinct else end from group having in is join like limit not null offset on or order
    select then when where""".split()
)
LINKS = frozenset("asc desc like in is and or not null between".split())
FRAGMENT_CHARS = 160


def is_statement(text: str) -> bool:
    """Whether a literal is SQL: it creates a named object at the start of a line, or begins like a query or a change of
    data and holds a sign of one (comma, comparison, string, placeholder); an UPDATE needs its SET."""
    t = tokens(text)
    low = [v.lower() if k == "w" else v for k, v, _ in t]
    walk = _Walk.__new__(_Walk)
    for i, x in enumerate(low):
        if x == "create" and t[i][0] == "w" and not text[text.rfind("\n", 0, t[i][2]) + 1 : t[i][2]].strip():
            j = i + 1
            while j < len(t) and low[j] in MODIFIERS:
                j += 1
            if j < len(t) and t[j][0] == "w" and low[j] in KINDS:
                j += 1
                while j < len(t) and low[j] in ("if", "not", "exists"):
                    j += 1
                if _Walk.name(walk, t, j)[0]:
                    return True
    begins = low[:1] in (["select"], ["update"]) or low[:2] in (["insert", "into"], ["delete", "from"], ["merge", "into"])
    signed = any(k in "sv" or (k == "p" and v in (",", "=", "<", ">", "!", "!=", "<>", "<=", ">=")) for k, v, _ in t)
    return bool(begins and signed and (low[0] != "update" or "set" in low))


def fragment_names(text: str) -> list[str]:
    """Names in a short literal that looks like a part of a statement, each once, in order."""
    if len(text.encode()) > FRAGMENT_CHARS:
        return []
    t = tokens(text)
    sign = any(k == "v" or (k == "p" and v in (",", "=", "<", ">", "!=", "<>", "<=", ">=")) or (k == "w" and v.lower() in LINKS) for k, v, _ in t)
    names = [m for m in _PLAIN.findall(text) if m.lower() not in STOP] if sign else []
    return list(dict.fromkeys(names))


_JINJA = re.compile(r"\{\{.*?\}\}|\{%.*?%\}", re.S)
_COMMENT = re.compile(r"\{#.*?#\}", re.S)
_CALL = re.compile(r"\{\{-?\s*([A-Za-z_]\w*)\s*\((.*?)\)\s*(?:\|.*?)?-?\}\}", re.S)
_LIT = re.compile(r"'([^']*)'|\"([^\"]*)\"")
_VERSION = re.compile(r"\bv(?:ersion)?\s*=\s*(\d+)")
_MACRO = re.compile(r"\{%-?\s*macro\s+([A-Za-z_]\w*)\s*\(")
_ALIAS = re.compile(r"\balias\s*=\s*(?:'([^']*)'|\"([^\"]*)\")")
# Template calls that are no macro of the project.
TEMPLATE_CALLS = frozenset(
    """adapter api builtins config dbt_version env_var exceptions flags fromjson fromyaml graph invocation_id is_incremental log model
    modules print range ref return run_query run_started_at set should_full_refresh source statement target this tojson toyaml var zip""".split()
)


def template_refs(text: str) -> list[tuple[str, str]]:
    """(kind, name) of a templated text: ref (model, with its version), source (schema.table), alias, macro (defined here)
    and call (of a macro of the project), each once."""
    text = _COMMENT.sub(" ", text)
    out = []
    for m in _CALL.finditer(text):
        args = [a or b for a, b in _LIT.findall(m[2])]
        if m[1] == "ref" and args:
            version = _VERSION.search(m[2])
            name = args[1] if len(args) > 1 else args[0]
            out.append(("ref", f"{name}_v{version[1]}" if version else name))
        elif m[1] == "source" and len(args) > 1:
            out.append(("source", f"{args[0]}.{args[1]}"))
        elif m[1] == "config":
            if a := _ALIAS.search(m[2]):
                out.append(("alias", a[1] or a[2]))
        elif m[1] not in TEMPLATE_CALLS:
            out.append(("call", m[1]))
    out += [("macro", m[1]) for m in _MACRO.finditer(text)]
    return list(dict.fromkeys(out))


def template_role(path: str) -> str:
    """What a templated file is by its folders: macro, other (analyses, tests, seeds, snapshots) or model."""
    parts = path.lower().replace("\\", "/").split("/")[:-1]
    return "macro" if "macros" in parts else "other" if {"analyses", "tests", "seeds", "snapshots"} & set(parts) else "model"
