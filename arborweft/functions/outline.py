"""Outlines of source files: classes, functions and methods by braces (S9), and the parts of component files."""

from __future__ import annotations

import re

from arborweft.functions.lexing import lex

# Words before a bracket that are no function.
_CONTROL = frozenset("if for while switch catch synchronized try do else return new with throw await typeof case function sizeof".split())
_TYPE = {
    "go": re.compile(r"(?m)^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+(?P<kind>struct|interface)\s*\{"),
    "java": re.compile(r"\b(?P<kind>class|interface|enum|record|@interface)\s+(?P<name>\w+)[^{};()]*(?:\([^()]*\))?[^{};()]*\{"),
    "javascript": re.compile(r"\b(?P<kind>class)\s+(?P<name>[A-Za-z_$][\w$]*)[^{};()]*\{"),
    "typescript": re.compile(r"\b(?P<kind>class|interface|enum|namespace)\s+(?P<name>[A-Za-z_$][\w$]*)[^{};()]*\{"),
}
_FUNC = {
    "go": re.compile(r"(?m)^func\s*(?:\(\s*\w*\s*\*?\s*(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\("),
    "java": re.compile(r"(?<=[\w>\]])\s+(?P<name>[A-Za-z_$][\w$]*)\s*\("),
    "javascript": re.compile(r"(?:\bfunction\b\s*\*?\s*|(?<=[\n{};])[ \t]*(?:(?:static|async|get|set|public|private|protected|readonly|override|export|default)\s+)*)(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^<>{}()]*>)?\("),
}
_TYPE_KIND = {"record": "class", "@interface": "interface", "struct": "struct"}
_FUNC["typescript"] = _FUNC["javascript"]
_GIVEN = re.compile(r"\b(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b[^(]*)?(?=\()")
_AFTER = {"go": re.compile(r"[^{};]*?(?:\binterface\s*\{\s*\}[^{};]*?|\bstruct\s*\{[^{}]*\}[^{};]*?)*\{"), "java": re.compile(r"\s*(?:throws\s+[\w.,\s]+)?\{"), "javascript": re.compile(r"\s*(?:(?=:)(?:[:|&<,]\s*\{[^{}]*\}|=>|[^{};=])*?)?\{")}
_AFTER["typescript"] = _AFTER["javascript"]
_ARROW = re.compile(r"\s*(?::[^={};]*)?=>\s*")

Symbol = tuple[str, str, int, int, str | None]  # kind, qualified name, first line, last line, parent


def _closers(bare: str) -> dict[int, int]:
    out: dict[int, int] = {}
    stacks: dict[str, list[int]] = {"(": [], "{": []}
    for m in re.finditer(r"[(){}]", bare):
        if m[0] in stacks:
            stacks[m[0]].append(m.start())
        elif s := stacks["(" if m[0] == ")" else "{"]:
            out[s.pop()] = m.end()
    return out


def outline(text: str, language: str) -> list[Symbol]:
    """Classes, interfaces, functions and methods of a Go, Java, JavaScript or TypeScript text, in order, with the symbol that
    holds each; names are joined by '::'. Brackets and words in comments and strings count for nothing; what does not close
    is left out."""
    if language not in _TYPE or not text:
        return []
    bare = "".join(text[a:b] if k == "code" else re.sub(r"[^\n]", " ", text[a:b]) for k, a, b in lex(text, language))
    ends = _closers(bare)
    found: list[tuple[int, int, str, str, str | None]] = []  # begin, end, kind, name, owner by receiver
    for m in _TYPE[language].finditer(bare):
        if (end := ends.get(m.end() - 1)) is not None:
            found.append((m.start("kind") if language != "go" else m.start(), end, _TYPE_KIND.get(m["kind"], m["kind"]), m["name"], None))
    for m in _FUNC[language].finditer(bare):
        close = ends.get(m.end() - 1)
        if m["name"] in _CONTROL or close is None:
            continue
        if language == "java" and re.search(r"\b(?:new|return|throw|else)\s*$", bare[: m.start("name")][-24:]):
            continue
        body = _AFTER[language].match(bare, close)
        if body and (end := ends.get(body.end() - 1)) is not None:
            begin = bare.rfind("\n", 0, m.start("name")) + 1
            found.append((begin + len(bare[begin : m.start("name")]) - len(bare[begin : m.start("name")].lstrip()), end, "function", m["name"], m.groupdict().get("owner")))
    if language in ("javascript", "typescript"):
        for m in _GIVEN.finditer(bare):
            close = ends.get(m.end())
            if close is None:
                continue
            arrow = _ARROW.match(bare, close)
            at = arrow.end() if arrow else close
            body = re.compile(r"\s*\{").match(bare, at)
            end = ends.get(body.end() - 1) if body else ((bare.find("\n", at) + 1 or len(bare) + 1) - 1 if arrow else None)
            if end:
                found.append((m.start(), end, "function", m["name"], None))
    line = lambda at: text.count("\n", 0, at) + 1
    out: list[Symbol] = []
    stack: list[tuple[int, str, str]] = []  # end, qualified name, kind
    for begin, end, kind, name, owner in sorted(set(found), key=lambda x: (x[0], -x[1])):
        while stack and stack[-1][0] <= begin:
            stack.pop()
        parent = owner or (stack[-1][1] if stack else None)
        if kind == "function" and (owner or (stack and stack[-1][2] not in ("function", "method"))):
            kind = "method"
        qualified = f"{parent}::{name}" if parent else name
        out.append((kind, qualified, line(begin), line(end - 1), parent))
        stack.append((end, qualified, kind))
    return out


# --- component files ----------------------------------------------------------------------------------------------------

_SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script\s*>", re.S | re.I)
_LIQUID = re.compile(r"\{%-?\s*(render|include|section|layout)\s+['\"]([^'\"]+)['\"]")
_FORM = re.compile(r"(?im)^(\s*)(?:object|inherited|inline)\s+(?:(\w+)\s*:\s*)?(\w+)")
_HANDLER = re.compile(r"(?im)^\s*(On\w+)\s*=\s*(\w+)\s*$")
_MAPPER = re.compile(r"<mapper\b[^>]*\bnamespace\s*=\s*[\"']([^\"']+)[\"'](.*?)</mapper\s*>", re.S | re.I)
_STATEMENT = re.compile(r"<(select|insert|update|delete|sql)\b[^>]*\bid\s*=\s*[\"']([^\"']+)[\"']", re.I)
_INCLUDE = re.compile(r"<include\b[^>]*\brefid\s*=\s*[\"']([^\"']+)[\"']", re.I)
#: The text of a tag's attributes that names a handler: @click="save", on:click={save}.
_EVENT = re.compile(r"(?:@|v-on:|on:)([\w-]+)(?:[.|][\w.|-]+)?\s*=\s*(?:[\"']([A-Za-z_$][\w$]*)(?:\([^\"']*\))?[\"']|\{([A-Za-z_$][\w$]*)\})")


def component(path: str, text: str) -> list[tuple[str, str, int, str | None]]:
    """(kind, name, line, extra) of a Vue, Svelte, Liquid, form (DFM) or mapper (MyBatis XML) file: the component itself, symbols
    of its scripts, handlers of its events, templates it renders, objects of a form, statements of a mapper."""
    base = path.rsplit("/", 1)[-1]
    ending = base.rsplit(".", 1)[-1].lower()
    line = lambda at: text.count("\n", 0, at) + 1
    out: list[tuple[str, str, int, str | None]] = []
    if ending in ("vue", "svelte"):
        out.append(("component", base.rsplit(".", 1)[0], 1, None))
        for m in _SCRIPT.finditer(text):
            lang = "typescript" if re.search(r"lang\s*=\s*[\"']tsx?[\"']", m[1]) else "javascript"
            out += [(k, q, line(m.start(2)) + a - 1, lang) for k, q, a, _, _ in outline(m[2], lang)]
        markup = _SCRIPT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
        out += [("handler", m[2] or m[3], line(m.start()), m[1]) for m in _EVENT.finditer(markup)]
    elif ending == "liquid":
        out += [(m[1], m[2], line(m.start()), None) for m in _LIQUID.finditer(text)]
    elif ending == "dfm":
        out += [("object", m[2] or m[3], line(m.start(3)), m[3]) for m in _FORM.finditer(text)] + [("handler", m[2], line(m.start(2)), m[1]) for m in _HANDLER.finditer(text)]
    elif ending == "xml":
        for m in _MAPPER.finditer(text):
            out += [("statement", f"{m[1]}.{x[2]}", line(m.start(2) + x.start()), x[1].lower()) for x in _STATEMENT.finditer(m[2])]
            out += [("include", f"{m[1]}.{x[1]}", line(m.start(2) + x.start()), None) for x in _INCLUDE.finditer(m[2])]
    return out
