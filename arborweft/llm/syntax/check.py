"""Source files that do not parse (problem 5): packrat parsing of whole files, furthest failure, conflict cause, rates."""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweft.llm.syntax import grammars, lexers, peg
from arborweft.sources.tables import load

# Per language its lexer, grammar and start rule.
LANGUAGES = {
    "go": (lexers.go, grammars.GO, "File"),
    "java": (lexers.java, grammars.JAVA, "Unit"),
    "javascript": (lexers.js, grammars.JAVASCRIPT, "Program"),
    "typescript": (lexers.js, grammars.TYPESCRIPT, "Program"),
    "python": (lexers.python, grammars.PYTHON, "File"),
    "sql": (lexers.sql, grammars.SQL, "File"),
    "sql routine": (lexers.sql, grammars.SQL, "Routine"),
}
_CONFLICT = re.compile(r"(?m)^(?:<{7}(?: .*)?|={7}|>{7}(?: .*)?|\|{7}(?: .*)?)\r?$")
_TEMPLATE = re.compile(r"\{\{.*?\}\}|\{%.*?%\}|<%.*?%>|\$\{[a-z_.]+\}")
_OTHER = (
    ("html", re.compile(r"\s*<(?:!doctype|html|\?xml)", re.I)),
    ("python", re.compile(r"(?m)^(?:import \w+\s*$|from \S+ import |def \w+\(.*\).*:\s*$|class \w+.*:\s*$)")),
    ("go", re.compile(r"(?m)^(?:package \w+\s*$|func (?:\(.*?\) )?\w+\()")),
    ("java", re.compile(r"(?m)^(?:package [\w.]+;|import [\w.]+;|public (?:final )?(?:class|interface|enum) )")),
    ("javascript", re.compile(r"(?m)^(?:import .* from ['\"]|(?:export )?(?:async )?function \w+\(|(?:const|let|var) \w+ = )")),
    ("sql", re.compile(r"(?im)^(?:create (?:or replace )?(?:table|view|function|index)|insert into|select )\b")),
)


@lru_cache(None)
def _parser(language: str):
    lexer, grammar, start = LANGUAGES[language]
    return lexer, peg.compile_grammar(grammar, start)


def _language_of(values: list[str], i: int) -> set[str]:
    """The languages that the statement around token i names."""
    first = next((j for j in range(i - 1, -1, -1) if values[j] == ";"), -1) + 1
    last = next((j for j in range(i + 1, len(values)) if values[j] == ";"), len(values))
    return {values[j + 1].lower().strip("'\"") for j in range(first, last - 1) if values[j].upper() == "LANGUAGE"}


def _parse(text: str, language: str) -> int | None:
    """None when the whole text is consumed, else the character position of the furthest failure."""
    lexer, parse = _parser(language)
    t = lexer(text)
    limit = sys.getrecursionlimit()
    # rules call each other, some dozens deep for each open bracket; Python frames live on the heap
    sys.setrecursionlimit(max(limit, 100_000 + 100 * len(t.K)))
    try:
        ok, far = parse(t.K, t.V, t.W, t.L)
    finally:
        sys.setrecursionlimit(limit)
    if ok and language == "sql":
        for i, k in enumerate(t.K):
            if k == "DOLLAR":
                body = re.match(r"(\$\w*\$)(.*)\1$", t.V[i], re.S)
                near = _language_of(t.V, i)
                if body and (near & {"plpgsql", "sql"} or (not near and "DO" in t.V[max(0, i - 1) : i])) and (bad := _parse(body.group(2), "sql routine")) is not None:
                    return t.P[i] + len(body.group(1)) + bad
    return None if ok else t.P[far]


def verdict(text: str, language: str) -> tuple[str, int, int] | None:
    """(cause, line, column) of the furthest failure, or None for a valid text. Cause: conflict, template, truncated,
    another language's name, or other."""
    at = _parse(text, language)
    if at is None:
        return None
    line = text.count("\n", 0, at) + 1
    col = at - text.rfind("\n", 0, at)
    if _TEMPLATE.search(text[max(0, at - 80) : at + 80]):
        cause = "template"
    elif _CONFLICT.search(text):
        cause = "conflict"
    else:
        cause = next((f"looks like {k}" for k, p in _OTHER if k != language and not (k == "javascript" and language == "typescript") and p.search(text) and not any(q.search(text) for j, q in _OTHER if j == language)), None)
        cause = cause or ("truncated" if not text[at:].strip(" \t\r\n;") or _unclosed(text, at) else "other")
    return cause, line, col


def _unclosed(text: str, at: int) -> bool:
    return "\n" not in text[at:].strip()


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[tuple[str, bytes], tuple | None] = {}
    for b in batches:
        out = []
        for lang, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            lang = (lang or "").lower()
            if text is None or lang not in LANGUAGES:
                out.append(None)
                continue
            key = (lang, hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            if key not in memo:
                if len(memo) > 20_000:
                    memo.clear()
                memo[key] = verdict(text, lang)
            out.append(memo[key])
        checked = [t is not None and (lg or "").lower() in LANGUAGES for lg, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), pa.array(checked, pa.bool_()), *(pa.array([v[i] if v else None for v in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32())))],
            names=["path", "member", "language", "checked", "cause", "line", "col"],
        )


def latest_files(files: DataFrame) -> DataFrame:
    """Per path the latest row by indexed_at (ties: the greatest language, then member). Null paths are no files."""
    pick = F.max(F.struct("indexed_at", F.coalesce("language", F.lit("")).alias("l"), F.coalesce("member", F.lit("")).alias("m"), F.struct("member", "language", "errors").alias("v")))
    return files.filter("path is not null").groupBy("path").agg(pick.alias("x")).select("path", "x.v.*")


def verdicts(files: DataFrame, texts: DataFrame) -> DataFrame:
    """path, member, language, checked, cause, line, col: one row per path of files. cause is null for a valid file and for
    one that is not checked (no text, or a language without a grammar). An empty text is valid in every language."""
    rows = latest_files(files).join(texts.select("path", "content"), "path", "left").select("path", "member", "language", "content")
    return rows.mapInArrow(_verdicts, "path string, member string, language string, checked boolean, cause string, line int, col int").dropDuplicates(["path"])


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_found: paths whose text is not valid for the language of their latest files row."""
    return verdicts(load(spark, sf_dir, "files"), load(spark, sf_dir, "source_texts")).filter("cause is not null").select("path")


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per member and language: checked files, invalid files, their rate, and the files whose errors column reports any."""
    v = verdicts(load(spark, sf_dir, "files"), load(spark, sf_dir, "source_texts"))
    said = latest_files(load(spark, sf_dir, "files")).select("path", (F.coalesce(F.size("errors"), F.lit(0)) > 0).alias("reported"))
    j = v.join(said, "path")
    n, bad = F.sum(F.col("checked").cast("long")), F.count("cause")
    return j.groupBy("member", "language").agg(n.alias("n_checked"), bad.alias("n_invalid"), F.round(F.when(n > 0, bad / n).otherwise(0.0), 6).alias("rate"), F.sum(F.col("reported").cast("long")).alias("n_reported"))
