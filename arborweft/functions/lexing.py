"""A string- and comment-aware lexer for source texts: comments, string literals and code of six languages."""

from __future__ import annotations

import re
from functools import lru_cache

# Per language the line-comment mark, block-comment marks and string quotes (longest first).
LEXIS = {
    "go": (("//",), (("/*", "*/"),), ("`", '"', "'")),
    "java": (("//",), (("/*", "*/"),), ('"""', '"', "'")),
    "javascript": (("//",), (("/*", "*/"),), ("`", '"', "'")),
    "typescript": (("//",), (("/*", "*/"),), ("`", '"', "'")),
    "sql": (("--",), (("/*", "*/"),), ("$$", "'", '"')),
    "python": (("#",), (), ('"""', "'''", '"', "'")),
}
_RAW = {"`": {"go"}, "$$": {"sql"}}  # quotes inside which a backslash stands for itself


@lru_cache(None)
def _openers(language: str) -> re.Pattern:
    lines, blocks, quotes = LEXIS[language]
    marks = sorted([*lines, *(a for a, _ in blocks), *quotes], key=len, reverse=True)
    return re.compile("|".join(map(re.escape, marks)) + (r"|/(?![/*])" if language in ("javascript", "typescript") else ""))


@lru_cache(None)
def _rest_of_string(mark: str, language: str) -> re.Pattern:
    """What follows an opening quote, up to and with the closing one (or the end of line or text where there is none)."""
    q, one_line = re.escape(mark), len(mark) == 1 and mark in "\"'" and language != "sql"
    escapes = language not in _RAW.get(mark, ()) and language != "sql"
    barred = (r"\\" if escapes else "") + (r"\n" if one_line else "")
    inside = (r"\\.|" if escapes else "") + f"(?!{q})" + (f"[^{barred}]" if barred else ".")
    return re.compile(rf"(?:{inside})*+(?:{q})?", re.S)


_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BEFORE_REGEX = re.compile(r"\b(?:return|typeof|case|in|of|delete|void|throw|new)$")


def lex(text: str, language: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) over the whole text; kind is line, block, string or code. One pass, no backtracking."""
    lines, blocks, _ = LEXIS[language]
    stop = _openers(language)
    out, at, code = [], 0, 0
    closing = dict(blocks)
    while m := stop.search(text, at):
        mark, begin = m.group(), m.start()
        if mark == "/":
            before = text[max(0, begin - 60) : begin].rstrip()
            if before and (before[-1] not in "(,=:[!&|?{};+-*%<>~^" and not _BEFORE_REGEX.search(before)):
                at = m.end()
                continue
            r = _REGEX.match(text, begin)
            if not r:
                at = m.end()
                continue
            kind, end = "string", r.end()
        elif mark in lines:
            end, kind = text.find("\n", begin), "line"
            end = len(text) if end < 0 else end
        elif mark in closing:
            end, kind = text.find(closing[mark], m.end()), "block"
            end = len(text) if end < 0 else end + len(closing[mark])
        else:
            kind, end = "string", _rest_of_string(mark, language).match(text, m.end()).end()
        if begin > code:
            out.append(("code", code, begin))
        out.append((kind, begin, end))
        at = code = end
    if code < len(text):
        out.append(("code", code, len(text)))
    return out


def literals(text: str, language: str) -> list[tuple[int, str]]:
    """(offset, content) of the string literals of a text, of any length, without their quotes."""
    quotes = LEXIS[language][2]
    out = []
    for kind, a, b in lex(text, language):
        if kind == "string" and (mark := next((q for q in quotes if text.startswith(q, a)), None)):
            end = b - len(mark) if b - a >= 2 * len(mark) and text.startswith(mark, b - len(mark)) else b
            out.append((a, text[a + len(mark) : end]))
    return out
