"""Generated, minified, vendored and data files among source files (problem 6).

A multi-pattern automaton (Aho-Corasick) reads the header comments for notices; path rules know vendored folders, lock
files and suffixes of tool output; text statistics find minified code and data. A folder that is merely called "generated" or
"gen" may hold hand-written code: it needs a second sign, a machine's repetition in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweft.sources.tables import load

#: Bytes from which a file counts as tool output or data whatever its text says; `reasons` takes another bound.
HUGE = 1_000_000

# Phrases of header comments, lower case, single blanks. sure: enough alone; origin and warning: enough
# together; third: marks a copied project file; doubt: the line only talks about such files.
PHRASES = {
    "sure": "code generated by|@generated|<auto-generated|<autogenerated|autogenerated file|auto-generated file|auto generated file|autogenerated by|auto-generated by|automatically generated|automatically created by|automatically produced|automatically written|machine written|machine-written|machine generated|machine-generated|file is generated|file was generated|file has been generated|is a generated file|generated file.|!! output of|generated code -|generated code;|generated with protoc|produced by the compiler|emitted by the",
    "origin": "generated by|generated from|generated using|generated with|generated on|auto-generated|autogenerated|auto generated|produced by|produced from|created by the|written by the|output of|compiled from|compiled by|source of truth|built from|rendered from|derived from the schema",
    "warning": "do not edit|do not modify|don't edit|don't modify|do not change|not edit by hand|not be edited|changes will be lost|edits will be lost|edits are lost|will be overwritten|are overwritten|is overwritten|be overwritten|run `|to refresh|to regenerate|rerun|re-run|regenerate with|modify by hand",
    "third": "upstream copy|imported unchanged|copied unchanged|copied from upstream|vendored from|vendored copy|vendored by|third-party copy|third party copy|copied verbatim|mirrored from|forked from|see license in|authors. distributed under|bundled license|release notes at",
    "doubt": "written by hand|hand-written|handwritten|edit it freely|edit freely|writes the words|used to be|no longer|own output|not generated|elsewhere|nothing third-party|not third-party|renders |formerly|previously|instead of|such as|for example|looks like|mentions|isn't|never generated|not a copy|tests the|tests for|checks for|detects|searches for|explains|describes|warns",
}


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, text in PHRASES.items():
        for p in text.split("|"):
            a.add_word(p, (kind, len(p)))
    a.make_automaton()
    return a


# Folders of third-party projects (each project is a folder in there); folders whose name alone says that a tool
# writes them; folders whose name may only mean the subject.
_THIRD = frozenset("node_modules bower_components third_party third-party thirdparty vendor vendors vendored extern external externals godeps _workspace site-packages jspm_packages pods carthage".split())
_WRITTEN = frozenset("__generated__ autogen auto_generated generated-sources generated_src".split())
_MAYBE = frozenset(("generated", "gen"))
_LIBRARY = re.compile(r"/(?:deps|contrib|submodules)/[a-z][\w.-]*/")
_VERSIONED = re.compile(r"/@?[A-Za-z][\w.]*[-@]v?\d+\.\d+(?:\.\d+)*(?:[-.]\w+)?/")
_NAME = re.compile(
    r"(?i)(?:[.-]min\.\w+|[.-]bundle\.\w+|[.-]chunk\.\w+|\.packed\.js|[._-]pb2?(?:_grpc)?\.\w+|\.pb\.(?:go|cc|h|ts|js)|_grpc\.pb\.\w+|[._](?:generated|gen|autogen|auto)\.\w+|\.g\.\w+|\.designer\.\w+|stub\.java|_string\.go|_mock\.go|bindata\.go)$"
    r"|^(?:zz_generated|_?generated_|autogen_|mock_)|^(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|pipfile\.lock|gemfile\.lock|cargo\.lock|composer\.lock|go\.sum|npm-shrinkwrap\.json)$|\.(?:lock|map|svg|snap)$"
)


def path_reason(path: str) -> str | None:
    folders = path.split("/")
    # a third-party folder counts where a project's folder lies in it
    if any(f.lower() in _THIRD for f in folders[:-2]) or any(f.lower() in _WRITTEN for f in folders[:-1]):
        return "folder"
    if _LIBRARY.search(path) or _VERSIONED.search(path):
        return "library folder"
    if _NAME.search(folders[-1]):
        return "name"
    if re.search(r"/(?:dist|build|out|target)/generated/|/dist/(?:js|assets)/", path):
        return "build output"
    return None


_MARK = re.compile(r"^\s*(?://+!?|/\*+!?|\*+(?!/)|#+!?|--+|;+|<!--|\"\"\"|''')\s?|\s*(?:\*/|-->|\"\"\"|''')\s*$")
_PROJECT = re.compile(
    r"(?i)^\W*(?:@license\s+)?(?:[a-z][\w.@/-]*\s+(?:js\s+)?v?\d+\.\d+(?:\.\d+)*\S*\s*(?:\||\(c\)|\(\w[^)]*(?:copy|mirror|fork|import)|[-–*]?\s*(?:mit|apache|bsd|isc|mpl|copyright)\b)|part\s+of\s+(?:the\s+)?\S+(?:\s+project|\s+library|\s+package)\b.*(?:release|version|licen[cs]e)"
    r"|copyright\s+(?:\S+\s+){0,3}the\s+\S+\s+(?:authors|contributors|project|team)|copyright\s+(?:\(c\)\s*)?(?:\d{4}(?:-\d{4})?\s+)?the\s+\S+\s+authors|this\s+file\s+is\s+part\s+of\s+\S+|vendored\b|imported\s+from\s+\S+\s+v?\d)"
)


def header_reason(text: str) -> str | None:
    """Looks at the comment lines before the first code line, and at the one comment that may follow it."""
    seen = 0
    inside = ""  # the mark that ends the open comment
    for line in re.finditer(r"[^\n]+", text):
        x = line[0].strip("\r﻿ \t")
        if not x or x.startswith("#!"):
            continue
        opens = x.startswith(("//", "/*", "#", "--", "<!--", "*", ";")) or x[:3] in ('"""', "'''")
        if not opens and not inside:
            seen += 1
            if seen > 3 or not re.match(r"(?:package|import|from|'use strict'|\"use strict\"|use|namespace)\b|['\"]use strict", x):
                break
            continue
        if inside:
            if inside in x:
                inside = ""
        elif x.startswith("/*"):
            inside = "" if "*/" in x[2:] else "*/"
        elif x[:3] in ('"""', "'''") and x.count(x[:3]) == 1:
            inside = x[:3]
        x = _MARK.sub("", _MARK.sub("", x)).strip()
        low = " ".join(x.lower().split())
        kinds: dict[str, int] = {}
        for end, (kind, n) in automaton().iter(low):
            kinds.setdefault(kind, end - n + 1)
        if "doubt" not in kinds:
            if "sure" in kinds or ("origin" in kinds and "warning" in kinds) or kinds.get("warning", 99) <= 2:
                return "generation notice"
            if "third" in kinds or _PROJECT.match(x):
                return "project notice"
    return None


_TOKEN = re.compile(r"[A-Za-z_]\w*|\d[\w.]*|\S")
_STRING = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`')
_BASE64 = re.compile(r"[A-Za-z0-9+/=_-]{60,}")
_NUMBERS = re.compile(r"(?:[-+]?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?)\s*[,;]\s*){6,}")
_ROW = re.compile(r"(?m)^\s*[(\[{][^()\[\]{}\n]*[)\]}]\s*[,;]?\s*$")
_PAIR = re.compile(r"(?m)^\s*[\"'][^\"'\n]*[\"']\s*:\s*(?:[\"'][^\"'\n]*[\"']|[-\d.]+|true|false|null)\s*,?\s*$")


def text_reason(text: str, language: str | None) -> str | None:
    """What the text itself shows: minified, data, markup."""
    body = re.sub(r"^\s*(?:(?://[^\n]*\n|/\*.*?\*/|#(?!include)[^\n]*\n|--[^\n]*\n)\s*)+", "", text, count=1, flags=re.S).strip()
    if not body:
        return None
    size = len(body)
    head = body[:200].lower()
    # a web page in place of source is damage (see syntax.py), not data kept as code
    if head.startswith(("<?xml", "<svg", "%pdf", "{\\rtf")) or "\0" in body:
        return "markup or binary"
    if size >= 60 and body[0] in "[{" and body[-1] in "]}":
        import json

        try:
            json.loads(body)
            return "json"
        except (ValueError, RecursionError):
            pass
    lines = [x for x in body.split("\n") if x.strip()]
    data = sum(len(m) for m in _BASE64.findall(body) if not re.fullmatch(r"[-=_]+|[a-zA-Z_]+|[A-Za-z]+(?:[_/-][A-Za-z0-9.]+)*", m)) + sum(len(m.group()) for m in _NUMBERS.finditer(body))
    if size >= 120 and data > 0.5 * size:
        return "data"
    rows = _ROW.findall(body)
    if len(rows) >= 8 and sum(map(len, rows)) > 0.7 * size:
        return "data"
    pairs = _PAIR.findall(body)
    if len(pairs) >= 8 and sum(map(len, pairs)) > 0.7 * size:
        return "data"
    cells = [x.count(",") for x in lines]
    if len(lines) >= 6 and min(cells) >= 2 and max(cells) == min(cells) and not re.search(r"[(){};=]", body):
        return "data"
    # long literals are no sign of minified code: measure what stands outside strings
    bare = _STRING.sub('""', body)
    size, lines = len(bare), [x for x in bare.split("\n") if x.strip()]
    longest = max(map(len, lines))
    if size >= 300 and (longest > 400 or size / len(lines) > 160):
        blanks = sum(c in " \t" for c in bare) / size
        long_share = sum(len(x) for x in lines if len(x) > 300) / size
        if long_share > 0.5 and blanks < 0.14:
            return "minified"
    return None


_SHAPE = re.compile(r"[A-Za-z_]+|\d+")


def repetition(text: str) -> bool:
    """Whether nearly all lines are a few shapes again and again, with numbers that count up: what a tool writes in a loop."""
    lines = [x.strip() for x in text.split("\n") if len(x.strip()) > 3]
    if len(lines) < 4:
        return False
    shapes: dict[str, list[int]] = {}
    for x in lines:
        numbers = re.findall(r"\d+", x)
        shapes.setdefault(_SHAPE.sub(lambda m: "0" if m[0][0].isdigit() else "a", x), []).append(int(numbers[0]) if numbers else -1)
    often = [v for v in shapes.values() if len(v) >= 4]
    counting = sum(len(v) for v in often if sum(b - a in (0, 1) for a, b in zip(v, v[1:])) >= 0.8 * (len(v) - 1) and v[0] != v[-1])
    return sum(map(len, often)) >= 0.6 * len(lines) and counting >= 0.3 * len(lines)


def reason(path: str, language: str | None, size: int | None, text: str | None, huge: int = HUGE) -> str | None:
    if size is not None and size >= huge:
        return "size"
    why = path_reason(path) or (text and (header_reason(text) or text_reason(text, language))) or None
    if why is None and text and any(f.lower() in _MAYBE for f in path.split("/")[:-1]) and repetition(text):
        return "generated folder"
    return why


def _reasons(huge: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            path, lang, size, text = (c.to_pylist() for c in b.columns)
            why = [reason(*x, huge) for x in zip(path, lang, size, text)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(why, pa.string())], names=["path", "language", "reason"])

    return run


def latest_files(files: DataFrame) -> DataFrame:
    """Per path the latest row by indexed_at (ties: the greatest language, size). Null paths are no files."""
    pick = F.max(F.struct("indexed_at", F.coalesce("language", F.lit("")).alias("l"), F.coalesce("size", F.lit(-1)).alias("s"), F.struct("member", "language", "size").alias("v")))
    return files.filter("path is not null").groupBy("path").agg(pick.alias("x")).select("path", "x.v.*")


def reasons(files: DataFrame, texts: DataFrame, huge: int = HUGE) -> DataFrame:
    """path, language, reason (null: hand-written) of each path of `files`. A null text or size is no sign by itself; a size of
    `huge` bytes or more is one."""
    joined = latest_files(files).join(texts.select("path", "content"), "path", "left").select("path", "language", "size", "content")
    return joined.mapInArrow(_reasons(huge), "path string, language string, reason string").dropDuplicates(["path"])


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_found: the paths that are not hand-written."""
    return reasons(load(spark, sf_dir, "files"), load(spark, sf_dir, "source_texts")).filter("reason is not null").select("path")


def handwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rest, per language: number of hand-written files and of each reason."""
    r = reasons(load(spark, sf_dir, "files"), load(spark, sf_dir, "source_texts"))
    return r.groupBy("language", F.coalesce("reason", F.lit("hand-written")).alias("reason")).agg(F.count("*").alias("n_files"))
