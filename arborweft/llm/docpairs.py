"""Functions paired with their documentation (problem 1).

Functions are cut from source texts by a string- and comment-aware lexer that matches braces and keeps the comment directly
before each function (over annotations and decorators). The cut functions meet the symbols of the nodes table by path, line
and name and give them documentation and code; a symbol whose file has no text keeps the docstring of its row. All
documentation goes through the same cleaning and the same judgement.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweft.functions.lexing import LEXIS, lex
from arborweft.sources.tables import load

# --- cutting functions ------------------------------------------------------------------------------------------------

_FUNC = {
    "go": re.compile(r"(?m)^func\s*(?:\([^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\("),
    "javascript": re.compile(r"(?:^|(?<=\n))[ \t]*(?:export\s+)?(?:default\s+)?(?:(?:public|private|protected|readonly|override|static|async|get|set)\s+)*(?:function\s*\*?\s*)?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|with\b|else\b|new\b|throw\b|await\b|typeof\b)([A-Za-z_$][\w$]*)\s*(?:<[^>{]*>)?\("),
    "sql": re.compile(r"(?i)create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+([\w.\"]+)\s*\("),
    "python": re.compile(r"(?m)^([ \t]*)(?:async\s+)?def\s+(\w+)\s*\("),
}
_CONTROL = frozenset("if for while switch catch synchronized try do else return new".split())
#: Functions given to a name: const f = (a) => ..., f = async a => ..., x.f = function (a) ...
_GIVEN = re.compile(
    r"(?:^|(?<=\n))[ \t]*(?:export\s+)?(?:(?:const|let|var)\s+|(?:(?:public|private|protected|readonly|static)\s+)*(?:[A-Za-z_$][\w$]*\.)*)([A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\b\s*)?(?:(function)\b\s*\*?\s*[\w$]*\s*)?(?:<[^>{]*>\s*)?(?:\(|([A-Za-z_$][\w$]*)(?=\s*=>))"
)
_FUNC["typescript"] = _FUNC["javascript"]
#: Java: a name before a bracket, behind something that can end a type; what stands before it must be a declaration's head.
_JAVA_NAME = re.compile(r"(?<=[\w>\]])\s+([A-Za-z_$][\w$]*)\s*\(")
_JAVA_HEAD = re.compile(r"\s*(?:@[\w.]+(?:\((?:[^()]|\([^()]*\))*\))?\s*)*+((?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*+(?:<[^{;()]*>\s*)?(?!(?:return|new|throw|else|assert|case|yield)\b)[\w$][\w$.]*(?:\s*<[^;{}()]*>)?(?:\s*\.\s*[\w$]+)*(?:\s*\[\s*\])*)")


def _heads(bare: str, language: str) -> Iterator[tuple[str, int, int, int]]:
    """(name, begin, position of the parameters' bracket, indent) of what may be a function."""
    if language != "java":
        for m in _FUNC[language].finditer(bare):
            name = m.group(m.lastindex)
            if name not in _CONTROL:
                yield name, m.start() + len(m.group()) - len(m.group().lstrip()), m.end() - 1, len(m.group(1).expandtabs()) if language == "python" else 0
        return
    for m in _JAVA_NAME.finditer(bare):
        if m.group(1) in _CONTROL:
            continue
        low = max(bare.rfind(c, 0, m.start()) for c in ";{}") + 1
        # an annotation above may hold braces, a damaged text no end before the line
        if h := _JAVA_HEAD.fullmatch(bare, low, m.start()) or _JAVA_HEAD.fullmatch(bare, bare.rfind("\n", 0, m.start()) + 1, m.start()):
            yield m.group(1), h.start(1), m.end() - 1, 0


_BRACKET = re.compile(r"[(){}]")
_BODY = re.compile(r"[{(;]")
_ARROW = re.compile(r"\s*(?::(?:[^={};]|\{[^{}]*\})*)?=>\s*")


def _pairs(bare: str) -> dict[int, int]:
    """Per opening round or curly bracket the position after the one that closes it; unclosed ones are missing."""
    out: dict[int, int] = {}
    open_: dict[str, list[int]] = {"(": [], "{": []}
    for m in _BRACKET.finditer(bare):
        c = m[0]
        if c in open_:
            open_[c].append(m.start())
        elif stack := open_["(" if c == ")" else "{"]:
            out[stack.pop()] = m.end()
    return out


def _body(bare: str, pairs: dict[int, int], close: int, language: str) -> int:
    """Position of the brace that opens the body behind the parameters that end at `close`, or -1. Braces of the result type
    are passed over."""
    at, typed = close, language != "typescript"
    while m := _BODY.search(bare, at):
        if m[0] == ";":
            return -1
        before = bare[close : m.start()].rstrip()
        if m[0] == "{" and not (re.search(r"\b(?:interface|struct)$", before) if typed else re.search(r"(?:[:<|&,\[]|=>)$", before)):
            return m.start()
        at = pairs.get(m.start(), -1)
        if at < 0:
            return -1
    return -1


def _given(text: str, bare: str, pairs: dict[int, int], language: str) -> Iterator[tuple[str, int, int, str]]:
    """(name, begin, end, signature) of the functions that _GIVEN finds."""
    for m in _GIVEN.finditer(bare):
        head = m.start() + len(m.group()) - len(m.group().lstrip())
        close = m.end() if m.group(3) else pairs.get(m.end() - 1, -1)
        if close < 0:
            continue
        if m.group(2):
            brace = _body(bare, pairs, close, language)
        else:
            arrow = _ARROW.match(bare, close)
            if not arrow:
                continue
            brace = arrow.end()
        if brace < 0:
            continue
        if bare.startswith("{", brace):
            end = pairs.get(brace, -1)
        else:  # an expression: up to the first semicolon or line end outside brackets
            depth, end = 0, brace
            while end < len(bare) and not (depth == 0 and bare[end] in ";\n,)"):
                depth += (bare[end] in "([{") - (bare[end] in ")]}")
                end += 1
        if end > brace:
            yield m.group(1), head, end, text[m.start(3) if m.group(3) else m.end() - 1 : close]


def _decorated(text: str, bare: str, head: int) -> int:
    """Where the annotations or decorators directly above `head` begin."""
    while True:
        at = head
        while at and text[at - 1].isspace():
            at -= 1
        begin = at
        if at and bare[at - 1] == ")":
            depth = 0
            while begin:
                begin -= 1
                depth += (bare[begin] == ")") - (bare[begin] == "(")
                if not depth:
                    break
        low = max(0, begin - 200)
        m = re.search(r"@[\w.]+[ \t]*$", bare[low:begin])
        if not m or text.count("\n", at, head) > 1:
            return head
        head = low + m.start()


_NOT_NEWLINE = re.compile(r"[^\n]")
_DEDENT = re.compile(r"(?m)^([ \t]*)\S")


def functions(text: str, language: str) -> Iterator[tuple[str, int, int, str, str]]:
    """(name, first line, last line, signature, documentation as it stands) of each function of a source text."""
    if language not in LEXIS or not text:
        return
    parts = lex(text, language)
    # same length, but comments and strings blanked, so that brackets and keywords in them count for nothing
    bare = "".join(text[a:b] if k == "code" else _NOT_NEWLINE.sub(" ", text[a:b]) for k, a, b in parts)
    comments = [(a, b) for k, a, b in parts if k in ("line", "block")]
    strings = [(a, b) for k, a, b in parts if k == "string"]
    ends = [b for _, b in comments]
    starts = [a for a, _ in strings]
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect.bisect_left(breaks, at) + 1
    pairs = _pairs(bare)
    for name, head, opening, indent in _heads(bare, language):
        close = pairs.get(opening, -1)
        if close < 0:
            continue
        sig = text[opening:close]
        if language == "python":
            colon = bare.find(":", close)
            if colon < 0:
                continue
            end = len(text)
            for ln in _DEDENT.finditer(bare, bare.find("\n", colon) + 1 or len(bare)):
                if len(ln.group(1).expandtabs()) <= indent:
                    end = ln.start()
                    break
            end = head + len(text[head:end].rstrip())
            i = bisect.bisect_left(starts, colon)
            doc = ""
            if i < len(strings) and not bare[colon + 1 : strings[i][0]].strip(" \t\r\nrRuU") and strings[i][0] < end:
                doc = text[slice(*strings[i])]
            yield name, line(head), line(end), sig, doc or _before(text, comments, ends, _decorated(text, bare, head))
            continue
        if language == "sql":
            i = bisect.bisect_right(starts, close)
            end = next((b for a, b in strings[i:] if text.startswith("$$", a)), None) or bare.find(";", close)
            end = len(text) if end < 0 else end
        else:
            brace = _body(bare, pairs, close, language)
            if brace < 0 or (language in ("javascript", "typescript") and bare[close:brace].strip()[:1] not in ("", ":")):
                continue
            end = pairs.get(brace, -1)
            if end < 0:
                continue
        yield name, line(head), line(end - 1), sig, _before(text, comments, ends, _decorated(text, bare, head))

    if language in ("javascript", "typescript"):
        for name, head, end, sig in _given(text, bare, pairs, language):
            yield name, line(head), line(end - 1), sig, _before(text, comments, ends, _decorated(text, bare, head))


def _before(text: str, comments: list, ends: list, head: int) -> str:
    """The comments that end directly before `head`, with no code and no blank line between."""
    i = bisect.bisect_right(ends, head) - 1
    first = head
    while i >= 0:
        gap = text[comments[i][1] : first]
        if gap.strip() or gap.count("\n") > 1 or text[text.rfind("\n", 0, comments[i][0]) + 1 : comments[i][0]].strip():
            break
        first = comments[i][0]
        i -= 1
    return text[first:head].rstrip() if first < head else ""


# --- documentation ----------------------------------------------------------------------------------------------------


def clean(doc: str) -> list[str]:
    """Lines of a documentation comment without its comment marks. A small state machine: inside a block comment a leading
    star is a mark, inside a docstring nothing is, elsewhere a line mark at the start of a line is."""
    text = doc.replace("\r\n", "\n").strip()
    m = re.match(r"[rRuUbBfF]{0,2}(\"\"\"|''')", text)
    if m:
        text = text[m.end() :]
        text = text[: -len(m.group(1))] if text.endswith(m.group(1)) else text
        state = "docstring"
    else:
        state = "open"
    out = []
    for line in text.split("\n"):
        x = line.strip()
        while True:
            if state == "open" and x.startswith("/*"):
                state, x = "block", x[2:].lstrip("*!").strip()
                continue
            if state == "block":
                if x.startswith("*") and not x.startswith("*/"):
                    x = x[1:].strip()
                if (end := x.find("*/")) >= 0:
                    head, x, state = x[:end].strip(), x[end + 2 :].strip(), "open"
                    if head:
                        out.append(head)
                    continue
            elif state == "open":
                y = re.sub(r"^(?://+!?|--(?!-)|#(?!region|endregion)+|\*(?!/)(?=\s|$)|\*/)\s?", "", x)
                if y != x:
                    x = y.strip()
                    continue
            break
        out.append(x)
    while out and not out[-1]:
        out.pop()
    while out and not out[0]:
        out.pop(0)
    return out


# Patterns of lines that are no documentation, in lower case.
_NOTICE = re.compile(
    r"""(?ix)^[\s@#{(\[<*!-]*(?:
    noqa\b|nolint\b|nosec\b|nosonar\b|type:\s*ignore|pragma[:\s]|pylint:|mypy:|flake8[:-]|isort:|fmt:\s*(?:on|off|skip)|yapf:|ruff:|pyright:|coverage:
    |eslint\b|tslint\b|jshint\b|jslint\b|prettier-ignore|istanbul\b|c8\s+ignore|v8\s+ignore|webpack|sourcemappingurl|ts-(?:ignore|expect-error|nocheck|check)|flow\b(?:$|\s*strict)|jscs:|biome-ignore|deno-lint|stylelint
    |go:\w+|\+build|line\s+\S+:\d+|checkstyle[:\s]|suppresswarnings|suppressfblbugs|noinspection|clang-format|nopmd|spotless:|formatter:|language=|cspell:|spell-?checker:|sqlfluff|noformat|@formatter
    |(?:end)?region\b|mark:|vim?:\s|-\*-.*-\*-
    |inheritdoc|internal\b\W*$|override\b\W*$|deprecated\W*$|private\W*$|public\W*$|protected\W*$|static\W*$|api\W*$|ignore\W*$|hidden\W*$|async\W*$|abstract\W*$|readonly\W*$|final\W*$|test\W*$|beta\W*$|alpha\W*$|experimental\W*$|nullable\W*$|notnull\W*$
    )"""
)
_LEGAL = re.compile(
    r"""(?ix)^\W*(?:spdx-|copyright\b(?=\W*(?:$|\(c\)|©|\d{4}|by\b|notices?\b|holders?\b|owners?\b|the\b.*\b(?:authors|contributors|project|team)\b|.*\b(?:inc|ltd|llc|gmbh|corp|ag|sa|co|authors|contributors|reserved)\b))|\(c\)\s|©|©|all\s+rights\s+reserved|licen[sc]ed?\b|permission\s+is\s+hereby|redistribution\s+and\s+use|this\s+(?:file|program|software)\s+is\s+(?:free|licensed|part\s+of|distributed|provided)|distributed\s+under|the\s+software\s+is\s+provided
    |(?:[@\\])?(?:authors?|maintainers?|owners?|created|written|contact|since|version|date|copyright|license|modified|last\s+(?:modified|changed|updated|edited)|reviewed|history|revision)\s*(?::|\b(?:by|on|at)\b|\s+v?\d)
    |@(?:authors?|since|version|date|copyright|license|created)\b
    |(?:autor|urheber|auteur|lizenz|licence|licencia)\s*[:\s]|erstellt\s+(?:von|am)|créé\s+(?:par|le)|creado\s+(?:por|el))"""
)
_TODO = re.compile(r"(?i)^\W*(?:todo|fixme|xxx|hack|tbd|tbc|wip|nyi)\b")
_PLACEHOLDER = re.compile(
    r"""(?ix)^\W*(?:n\s*/\s*a|none|null|nil|empty|lorem\s+ipsum.*|foo|bar|test|stub|dummy|undocumented|not\s+(?:yet\s+)?documented(?:\s+yet)?|no\s+(?:description|documentation|docs?|comment|docstring)(?:\s+(?:yet|available|provided|given|needed|necessary))?
    |placeholder(?:\s+(?:docstring|comment|text|doc|documentation|description|function|method))?|(?:your\s+|some\s+|short\s+|brief\s+)?(?:description|documentation|docstring|docs?|comment|summary|text)(?:\s+(?:here|goes\s+here|pending|missing|to\s+follow|follows|tbd|needed|required))?
    |(?:method|function|class|constructor|member|symbol|param(?:eter)?)\s+(?:description|documentation|docs?|comment|summary|stub)
    |(?:add|write|insert|enter|provide|put|fill\s+in|complete|missing)\s+(?:a\s+|the\s+|your\s+|some\s+)?(?:short\s+|brief\s+)?(?:description|documentation|docs?|docstring|comment|summary|text)(?:\s+here)?
    |(?:document|describe|explain)\s+(?:this|me|it)(?:\s+(?:function|method))?(?:\s+(?:later|here))?
    |auto-?\s*generated(?:\s+(?:method|function|constructor|class|catch|code|files?\b.*|by\b.*))?(?:\s+(?:stub|block|comment|documentation|docstring))?
    |(?:see|refer\s+to|as\s+in|same\s+as\s+in?|cf\.?)\s+(?:the\s+|its\s+)?(?:base|super|parent|interface|overridden|super-?class|implementation|above|below|code|source|docs?|documentation|spec|name|title)(?:[\s-]+(?:class|type|method|function|interface|implementation|documentation|docs?|code))?
    |(?:siehe|voir|véase|ver)\s+\w+(?:\s+\w+)?|(?:implements?|inherited|overrid(?:es|den)|documented)\s+(?:from|in|by)?\s*(?:the\s+)?(?:base|super|parent|interface|superclass)(?:[\s-]+(?:class|type|method|interface))?
    |self[\s-]explanatory|obvious|trivial|nothing\s+to\s+(?:see|say)(?:\s+here)?|coming\s+soon|to\s+be\s+(?:done|documented|written|defined|added)|ditto|as\s+above|same\s+as\s+above|beschreibung|dokumentation|description\s+ici|descripción|à\s+documenter|zu\s+dokumentieren)\W*$"""
)
_CODE = re.compile(
    r"""(?x)^(?:
    .*[;{}]\s*$|[}\])]+[;,]?\s*$|(?:return|yield|await|throw|raise|break|continue|pass|goto|import|from|package|using|include)\b(?:\s+[\w.$"'()\[\]!-]+){0,3}\s*;?$
    |(?:if|for|while|switch|elif|else|except|try|with|case|catch)\b\s*(?:\(.*\)\s*.*|.*:\s*)$
    |(?:var|let|const|def|func|fn|function|class|public|private|static|int|void|string|bool)\s+[\w.]+\s*(?:[=(:{]|:=).*
    |[\w.$\[\]"']+\s*(?::=|[-+*/|&%]?=(?!=)|==|!=|<=|>=|\+\+|--)\s*\S.*|[\w.$]+(?:\.\w+)*\([^()]*(?:\([^()]*\)[^()]*)*\)(?:\.\w+\([^()]*\))*\s*;?$
    |(?:select|insert|update|delete|create|drop|alter|begin|end)\b.*;\s*$|(?:>>>|\$|\.\.\.)\s.*|</?\w[^<>]*>$
    )"""
)
_TAG = re.compile(r"(?i)^[@\\:](?:params?|arg(?:ument)?s?|returns?|retval|throws?|exceptions?|raises?|rtype|type|tparam|yields?|property|prop|template|typeparam|see|link|sa)\b:?\s*(.*)$")
_SECTION = re.compile(r"(?i)^(?:args?|arguments?|params?|parameters?|returns?|return\s+values?|raises?|throws?|yields?|examples?|usage|notes?|see\s+also|warnings?|attributes?|beispiele?|ejemplos?|exemples?|hinweis|output|input|inputs|outputs)\s*:\s*(.*)$")
_ENTRY = re.compile(r"^(?:\*{0,2}\w+)\s*(?:\([^)]*\)|:\s*[\w\[\]., |]+(?=\s*:|$))?\s*(?::|--?|–)\s*(.*)$")
# Words that say nothing about one symbol.
_EMPTY = frozenset(
    """a an the this that these those it its of to for and or in on at by from with is are be been was as into
    function func method procedure routine subroutine constructor destructor ctor getter setter accessor mutator helper handler callback wrapper util utils utility main entry point class
    object property field member operation call api impl implementation interface stub def fn proc test
    do does did perform performs performing execute executes run runs called simple basic default internal private public static given
    der die das ein eine diese dieser dieses funktion methode klasse hilfsfunktion le la les un une cette fonction méthode el los las una esta función método
    name value values arg args param params parameter parameters argument arguments returns return""".split()
)
_PARTS = re.compile(r"[^\W\d_]+|\d+")
_CAMEL = re.compile(r"[A-Z]+(?![a-zà-ÿ])|[A-Z]?[^\W\d_A-Z]+|\d+")
_IDEO = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def _stem(w: str) -> str:
    w = w.lower()
    for end in ("ations", "ation", "ings", "ing", "ers", "er", "ors", "or", "ies", "ied", "es", "ed", "s"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    if len(w) > 3 and w[-1] in "eyi":
        w = w[:-1]
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def _parts(text: str) -> set[str]:
    return {_stem(p) for w in _PARTS.findall(text or "") for p in (_CAMEL.findall(w) or [w])} | {_stem(w) for w in _PARTS.findall(text or "")}


def tells_something(doc: str | None, name: str | None, signature: str | None) -> bool:
    """Whether a docstring says anything that name and signature do not."""
    if not doc or not doc.strip():
        return False
    known = _parts(name or "") | _parts(signature or "")
    section, example = "", False
    for line in clean(doc):
        x = line.strip().strip("\"'").strip()
        x = re.sub(r"(?i)</?(?:summary|remarks|para|p|br|code|c|b|i|em|strong|ul|li|ol|pre|div|span|returns|value|inheritdoc|param|see|seealso|exception|typeparam|example)\b[^<>]*>", " ", x).strip()
        if not x:
            section = "" if not x and not example else section
            continue
        if _NOTICE.match(x) or _LEGAL.match(x) or _TODO.match(x):
            continue
        if m := _SECTION.match(x):
            section, x = x.split(":")[0].lower(), m.group(1).strip()
            example = section in ("example", "examples", "usage", "beispiel", "beispiele", "ejemplo", "ejemplos", "exemple", "exemples")
            if not x:
                continue
        elif m := _TAG.match(x):
            x = m.group(1).strip()
            tag = line.strip().lstrip("@\\:").lower()
            x = re.sub(r"^\{[^}]*\}\s*", "", x)
            if re.match(r"(?:params?|arg|throws?|raises?|exception|tparam|typeparam|property|prop)", tag) or line.strip().startswith(":") and re.match(r"type\b", tag):
                x = re.sub(r"^[\[\]\w.$*=?]+\s*:?\s*", "", x)
            x = x.lstrip(":-– ").strip()
            if re.match(r"(?:rtype|type|see|link|sa)\b", tag):
                continue
        elif section and (m := _ENTRY.match(x)):
            x = m.group(1).strip()
        if not x or _CODE.match(x) or _PLACEHOLDER.match(x) or _NOTICE.match(x):
            continue
        if example and not re.search(r"\s\w+\s\w+\s\w+", x):
            continue
        if _IDEO.search(x) and len(_IDEO.findall(x)) >= 2:
            return True
        words = [w for w in _PARTS.findall(x) if not w.isdigit()]
        rest = [w for w in words if w.lower() not in _EMPTY and _stem(w) not in known and not all(_stem(p) in known for p in _CAMEL.findall(w) or [w])]
        if rest:
            return True
    return False


# --- plans ------------------------------------------------------------------------------------------------------------


def latest_symbols(nodes: DataFrame) -> DataFrame:
    """Per id the latest row (ties: the greatest docstring, then signature; exact repeats collapse); functions and methods
    only. Combined on the map side; only the needed columns are shuffled. Null ids are no symbols."""
    cols = ("kind", "name", "signature", "docstring", "file_path", "language", "start_line", "end_line")
    rows = nodes.filter(F.col("id").isNotNull())
    pick = F.max(F.struct(F.coalesce("updated_at", F.lit(-(2**62))).alias("u"), F.coalesce("docstring", F.lit("")).alias("d"), F.coalesce("signature", F.lit("")).alias("s"), F.struct(*cols).alias("v")))
    return rows.groupBy(F.col("id").alias("node_id")).agg(pick.alias("x")).select("node_id", "x.v.*").filter(F.col("kind").isin("function", "method"))


def languages(files: DataFrame) -> DataFrame:
    """(path, language): the latest files row of a path (indexed_at; ties: greatest language)."""
    return files.filter("path is not null").groupBy("path").agg(F.max(F.struct("indexed_at", F.coalesce("language", F.lit("")).alias("language"))).alias("x")).select("path", "x.language")


def _cutter(code: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("path", "name", "start_line", "end_line", "signature", "comment", *(("code",) if code else ()))}
            for path, language, text in zip(*(c.to_pylist() for c in b.columns)):
                lines = text.split("\n") if code else ()
                for name, first, last, sig, doc in functions(text, language):
                    for k, v in zip(out, (path, name, first, last, sig, doc, *(("\n".join(lines[first - 1 : last]),) if code else ()))):
                        out[k].append(v)
            if out["path"]:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k.endswith("line") else pa.string()) for k, v in out.items()], names=list(out))

    return run


def cut(files: DataFrame, texts: DataFrame, code: bool = False) -> DataFrame:
    """path, name, start_line, end_line, signature, comment (, code): every function of the source texts, with the comment
    directly before it as it stands ('' without one). Paths without text or with a language that has no lexer give no row."""
    src = texts.filter("content is not null").select("path", "content").join(languages(files), "path").select("path", "language", "content")
    return src.mapInArrow(_cutter(code), "path string, name string, start_line int, end_line int, signature string, comment string" + (", code string" if code else ""))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds documentation and its origin to the rows whose documentation says something."""
    for b in batches:
        keep, text, origin = [], [], []
        docs, comments, names, sigs = (b.column(b.schema.names.index(c)).to_pylist() for c in ("docstring", "comment", "name", "signature"))
        for i, (doc, comment, name, sig) in enumerate(zip(docs, comments, names, sigs)):
            own = clean(doc)
            # the comment of the text holds where it is the row's docstring; a row of another version keeps its own
            cut_ = clean(comment) if comment else None
            if tells_something(comment if cut_ == own else doc, name, sig):
                keep.append(i)
                text.append("\n".join(own))
                origin.append("text" if cut_ == own else "row")
        if keep:
            sub = b.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*sub.columns, pa.array(text, pa.string()), pa.array(origin, pa.string())], names=[*b.schema.names, "documentation", "origin"])


def pairs(nodes: DataFrame, files: DataFrame, texts: DataFrame, code: bool = True) -> DataFrame:
    """node_id, kind, name, signature, documentation, origin, file_path, language, start_line, end_line (, code): one row per
    function or method whose signature is not blank and whose documentation says something.

    Functions are cut from the texts and meet the symbols by path, first line and name; where none does (no text, or a
    function the cutter does not know), or where the row's docstring is another than the comment in the text, the row's
    docstring is judged (origin 'row', else 'text'). A symbol whose docstring is null or blank is no pair, whatever stands
    before it in the text (such as the file's own header). Null, empty, very long docstrings are fine."""
    src = latest_symbols(nodes).filter(F.col("signature").isNotNull() & F.col("signature").rlike("\\S") & F.col("docstring").isNotNull() & F.col("docstring").rlike("\\S"))
    at = ("file_path", "start_line", "name")
    pieces = cut(files, texts, code).select(F.col("path").alias("file_path"), "start_line", "name", "comment", *(["code"] if code else [])).dropDuplicates(list(at))
    src = src.join(pieces, list(at), "left")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields) + ", documentation string, origin string"
    return src.mapInArrow(_judged, schema).select("node_id", "kind", "name", "signature", "documentation", "origin", "file_path", "language", "start_line", "end_line", *(["code"] if code else []))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    return tuple(load(spark, sf_dir, t) for t in ("nodes", "files", "source_texts"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found: ids of the pairs."""
    return pairs(*_tables(spark, sf_dir), code=False).select("node_id")


def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_pairs: with the source text of each function that was cut."""
    return pairs(*_tables(spark, sf_dir))


def _telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names, sigs, comments = (b.column(b.schema.names.index(c)).to_pylist() for c in ("name", "signature", "comment"))
        keep = [i for i, x in enumerate(zip(comments, names, sigs)) if tells_something(*x)]
        if keep:
            sub = b.take(pa.array(keep))
            doc = pa.array(["\n".join(clean(comments[i])) for i in keep], pa.string())
            yield pa.RecordBatch.from_arrays([doc if n == "comment" else c for n, c in zip(sub.schema.names, sub.columns)], names=["documentation" if n == "comment" else n for n in sub.schema.names])


def source_pairs(files: DataFrame, texts: DataFrame) -> DataFrame:
    """path, name, start_line, end_line, signature, documentation, code: pairs of the source texts alone, for data without a
    nodes table."""
    return cut(files, texts, True).mapInArrow(_telling, "path string, name string, start_line int, end_line int, signature string, documentation string, code string")


def from_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_pairs(load(spark, sf_dir, "files"), load(spark, sf_dir, "source_texts"))
