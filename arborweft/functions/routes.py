"""Routes and their handlers in source texts, by web framework (S12, V5). A registry: `resolver` adds another one."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

Route = tuple[str, str, str]  # verb, path, handler ('' where none is named)
RESOLVERS: dict[str, tuple[tuple[str, ...], str, Callable[[str], Iterator[Route]]]] = {}

_VERBS = "get|post|put|patch|delete|options|head"
_STR = r"""["'`]([^"'`\n]*)["'`]"""
_NAME = r"[A-Za-z_$][\w$.:]*"


def resolver(name: str, languages: tuple[str, ...], sign: str):
    """Register fn(text) for a framework: its languages, and a pattern that a text must hold to be asked at all."""

    def put(fn):
        RESOLVERS[name] = (languages, sign, fn)
        return fn

    return put


def routes(text: str, language: str) -> list[tuple[str, str, str, str]]:
    """(framework, verb, path, handler) of a text, each once, in order of the frameworks."""
    out = []
    for name, (languages, sign, fn) in RESOLVERS.items():
        if language in languages and re.search(sign, text):
            out += [(name, v.upper(), p, h) for v, p, h in fn(text)]
    return list(dict.fromkeys(out))


def _calls(pattern: str, flags: int = 0) -> Callable[[str], Iterator[Route]]:
    """Matches of a pattern with the groups verb, path and handler."""
    rx = re.compile(pattern, flags)
    return lambda text: (((g := m.groupdict()).get("verb") or "ANY", g["path"], (g.get("handler") or "").strip()) for m in rx.finditer(text))


_JS = ("javascript", "typescript")
_LAST = rf"(?:\s*,\s*(?:{_NAME}\s*(?:\([^()]*\))?\s*,\s*)*(?P<handler>{_NAME}))?"


def _method(objects: str, verbs: str = _VERBS) -> str:
    return rf"""\b(?:{objects})\.(?P<verb>{verbs})\(\s*["'`](?P<path>/[^"'`\n]*)["'`]{_LAST}"""


resolver("express", _JS, r"\bexpress\b")(_calls(_method("app|router|[a-z]\\w*Router")))
resolver("koa", _JS, r"\bkoa\b|@koa/router|koa-router")(_calls(_method("router|app")))
resolver("fastify", _JS, r"\bfastify\b")(_calls(_method("fastify|app|server|instance")))
resolver("adonis", _JS, r"@adonisjs|@ioc:Adonis")(_calls(rf"""\b[Rr](?:oute|outer)\.(?P<verb>{_VERBS})\(\s*["'`](?P<path>[^"'`\n]*)["'`]\s*,\s*["'`](?P<handler>[^"'`\n]*)["'`]"""))


@resolver("hapi", _JS, r"\bhapi\b|@hapi/hapi")
def _hapi(text: str) -> Iterator[Route]:
    for m in re.finditer(r"\.route\(\s*\{([^{}]*)\}", text):
        field = lambda k, x=m[1]: (f[1] if (f := re.search(rf"\b{k}\s*:\s*(?:{_STR}|({_NAME}))", x)) and f[1] else f[2] if f else "")
        if field("path"):
            yield field("method") or "ANY", field("path"), field("handler")


@resolver("sails", _JS, r"module\.exports\.routes|\bsails\b")
def _sails(text: str) -> Iterator[Route]:
    for m in re.finditer(rf"""["']((?:{_VERBS}|all)\s+)?(/[^"'\s]*)["']\s*:\s*(?:["']([^"']+)["']|\{{[^{{}}]*action\s*:\s*["']([^"']+)["'])""", text, re.I):
        yield (m[1] or "ANY").strip(), m[2], m[3] or m[4] or ""


@resolver("nestjs", ("typescript",), r"@nestjs|@Controller\(")
def _nest(text: str) -> Iterator[Route]:
    base, at = "", 0
    for m in re.finditer(rf"""@Controller\(\s*(?:{_STR})?\s*\)|@(Get|Post|Put|Patch|Delete|Options|Head|All)\(\s*(?:{_STR})?\s*\)(?:\s*@\w+\([^()]*\))*\s*(?:(?:public|private|protected|async)\s+)*(\w+)\s*\(""", text):
        if m[2] is None:
            base = m[1] or ""
            continue
        yield m[2], "/" + "/".join(x.strip("/") for x in (base, m[3] or "") if x.strip("/")), m[4]


_GO_HANDLER = r"\s*,\s*(?:[\w.]+(?:\([^()]*\))?\s*,\s*)*(?P<handler>[A-Za-z_][\w.]*)"
for _name, _sign in (("gin", r"gin-gonic/gin|\bgin\."), ("echo", r"labstack/echo|\becho\."), ("fiber", r"gofiber/fiber|\bfiber\."), ("chi", r"go-chi/chi|\bchi\.")):
    resolver(_name, ("go",), _sign)(_calls(rf"""\b\w+\.(?P<verb>(?i:{_VERBS}))\(\s*["`](?P<path>/[^"`\n]*)["`]{_GO_HANDLER}"""))


@resolver("gorilla", ("go",), r"gorilla/mux|\bmux\.")
def _gorilla(text: str) -> Iterator[Route]:
    for m in re.finditer(r"""\.HandleFunc\(\s*["`]([^"`\n]*)["`]\s*,\s*([A-Za-z_][\w.]*)\s*\)(?:\s*\.Methods\(([^()]*)\))?""", text):
        for v in re.findall(r'"(\w+)"', m[3] or "") or ["ANY"]:
            yield v, m[1], m[2]


@resolver("flask", ("python",), r"\bflask\b|\.route\(")
def _flask(text: str) -> Iterator[Route]:
    for m in re.finditer(rf"""@\w+\.route\(\s*{_STR}([^()]*(?:\([^()]*\)[^()]*)*)\)\s*\n(?:\s*@[^\n]*\n)*\s*(?:async\s+)?def\s+(\w+)""", text):
        for v in re.findall(r"""["'](\w+)["']""", (re.search(r"methods\s*=\s*[\[(]([^\])]*)", m[2]) or ["", ""])[1]) or ["GET"]:
            yield v, m[1], m[3]


resolver("fastapi", ("python",), r"\bfastapi\b|APIRouter")(_calls(rf"""@\w+\.(?P<verb>{_VERBS})\(\s*["'](?P<path>[^"'\n]*)["'][^\n]*\)\s*\n(?:\s*@[^\n]*\n)*\s*(?:async\s+)?def\s+(?P<handler>\w+)"""))
resolver("django", ("python",), r"\burlpatterns\b|django\.urls")(_calls(rf"""\b(?:re_)?path\(\s*r?["'](?P<path>[^"'\n]*)["']\s*,\s*(?P<handler>[A-Za-z_][\w.]*)"""))
resolver("spring", ("java", "kotlin"), r"@\w*Mapping\b")(lambda text: _spring(text))
resolver("rails", ("ruby",), r"routes\.draw|\bto:\s*['\"]")(_calls(rf"""(?m)^\s*(?P<verb>{_VERBS})\s+["'](?P<path>[^"'\n]*)["']\s*(?:,\s*to:|=>)\s*["'](?P<handler>[\w/]+\#\w+)["']"""))
resolver("laravel", ("php",), r"\bRoute::")(lambda text: ((m[1], m[2], f"{m[4]}@{m[5]}" if m[4] else m[3] or "") for m in re.finditer(rf"""\bRoute::({_VERBS}|any)\(\s*["']([^"'\n]*)["']\s*,\s*(?:["']([^"'\n]+)["']|\[\s*(\w+)::class\s*,\s*["'](\w+)["']\s*\])""", text)))
resolver("symfony", ("php",), r"#\[Route\(|@Route\(")(lambda text: ((v, m[1], m[3]) for m in re.finditer(r"""(?:#\[|@)Route\(\s*["']([^"'\n]*)["']([^\n]*?)\)\]?\s*(?:\*/\s*)?(?:public\s+)?function\s+(\w+)""", text) for v in re.findall(r"""["'](\w+)["']""", (re.search(r"methods\s*[:=]\s*[\[{]([^\]}]*)", m[2]) or ["", ""])[1]) or ["ANY"]))
resolver("actix", ("rust",), r"\bactix_web\b")(_calls(rf"""#\[(?P<verb>{_VERBS})\(\s*"(?P<path>[^"]*)"[^\]]*\)\]\s*(?:pub\s+)?(?:async\s+)?fn\s+(?P<handler>\w+)"""))
resolver("rocket", ("rust",), r"\brocket\b")(_calls(rf"""#\[(?P<verb>{_VERBS})\(\s*"(?P<path>[^"]*)"[^\]]*\)\]\s*(?:pub\s+)?(?:async\s+)?fn\s+(?P<handler>\w+)"""))
resolver("axum", ("rust",), r"\baxum\b")(lambda text: ((v, m[1], h) for m in re.finditer(r"""\.route\(\s*"([^"]*)"\s*,\s*([^\n;]*)""", text) for v, h in re.findall(rf"\b({_VERBS})\(\s*([\w:]+)", m[2])))
resolver("phoenix", ("elixir",), r"\bPhoenix\b|\bscope\b|Controller,\s*:")(lambda text: ((m[1], m[2], f"{m[3]}.{m[4]}") for m in re.finditer(rf"""(?m)^\s*({_VERBS})\(?\s*"([^"\n]*)"\s*,\s*([\w.]+)\s*,\s*:(\w+)""", text)))


def _spring(text: str) -> Iterator[Route]:
    base = ""
    for m in re.finditer(r"""@(Get|Post|Put|Patch|Delete|Request)Mapping(?:\(([^()]*)\))?((?:\s*@\w+(?:\([^()]*\))?)*)\s*((?:public|private|protected|static|final|abstract)\s+)*(class|interface|[\w<>\[\], ?.]+?)\s+(\w+)\s*(\()?""", text):
        path = (re.search(r'"([^"]*)"', m[2] or "") or ["", ""])[1]
        if m[5] in ("class", "interface"):
            base = path
            continue
        if m[7]:
            verb = m[1] if m[1] != "Request" else (re.search(r"RequestMethod\.(\w+)", m[2] or "") or ["", "ANY"])[1]
            yield verb, "/" + "/".join(x.strip("/") for x in (base, path) if x.strip("/")), m[6]
