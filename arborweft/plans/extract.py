"""Symbols, routes and lineage cut from source texts (S9-S12, T6, T9, V5), flow chains and explore budgets."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from arborweft.functions import outline
from arborweft.operators import model
from arborweft.operators.model import sql
from arborweft.sources.tables import Scratch, load

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return put


def python_symbols(text: str) -> list[tuple[str, str, int, int, str | None]]:
    """(kind, qualified name, first line, last line, parent) of a Python text's classes, functions and methods; nothing for
    a text that does not parse. Names are joined by '::'."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out, stack = [], [(tree, "", False)]
    while stack:
        node, prefix, in_class = stack.pop()
        for child in reversed(list(ast.iter_child_nodes(node))):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                name = f"{prefix}::{child.name}" if prefix else child.name
                out.append(("class" if is_class else "method" if in_class else "function", name, child.lineno, child.end_lineno, prefix or None))
                stack.append((child, name, is_class))
            elif not isinstance(child, ast.expr):
                stack.append((child, prefix, in_class))
    return sorted(out, key=lambda x: (x[2], x[1]))


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(p, *s) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s in python_symbols(t)]
        if rows:
            path, kind, name, first, last, parent = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(kind), pa.array(name), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(parent, pa.string())], names=["path", "kind", "qualified_name", "start_line", "end_line", "parent"])


@query("python_symbols")
def python_symbols_query(s, d):
    """Symbols of all Python texts, with their identity. No SQL: needs a parser; tests compare with the nodes table."""
    f = model.files(s, d, "path", "language").filter("language = 'python'").select("path")
    t = load(s, d, "source_texts").filter("content is not null").select("path", "content").join(f, "path", "left_semi")
    out = t.mapInArrow(_symbols, "path string, kind string, qualified_name string, start_line int, end_line int, parent string")
    return out.withColumn("id", model.node_id(F.col("path"), F.col("kind"), F.col("qualified_name"), F.col("start_line")))


def _outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(p, g, *x) for p, g, t in zip(*(c.to_pylist() for c in b.columns)) for x in (python_symbols(t) if g == "python" else outline.outline(t, g))]
        if rows:
            types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["path", "language", "kind", "qualified_name", "start_line", "end_line", "parent"])


def symbols(s, d):
    """(path, language, kind, qualified_name, start_line, end_line, parent, id) of the Go, Java, JavaScript, TypeScript and Python
    texts."""
    f = model.files(s, d, "path", "language").filter("language in ('go', 'java', 'javascript', 'typescript', 'python')")
    t = load(s, d, "source_texts").filter("content is not null").select("path", "content").join(f, "path").select("path", "language", "content")
    out = t.mapInArrow(_outlined, "path string, language string, kind string, qualified_name string, start_line int, end_line int, parent string")
    return out.withColumn("id", model.node_id(F.col("path"), F.col("kind"), F.col("qualified_name"), F.col("start_line")))


@query("source_symbols")
def source_symbols(s, d):
    """S9. No SQL: needs lexing and matching of braces; tests compare with the nodes table, symbol by symbol."""
    return symbols(s, d)


@query("symbol_edges")
def symbol_edges(s, d):
    """Contains edges of the symbols: from the file, or from the symbol of the parent's name in the same file. A parent that
    is declared in another file of its package leads from the file."""
    x = Scratch(s, "symbols").write(symbols(s, d).select("path", "qualified_name", "parent", "id"))
    up = x.groupBy("path", F.col("qualified_name").alias("parent")).agg(F.min("id").alias("up"))
    return x.join(up, ["path", "parent"], "left").select(F.coalesce("up", F.concat(F.lit("file:"), "path")).alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind"))


# A component file of each kind, and the parts of it as a reader sees them (the stored files have none).
COMPONENTS = (
    ("zq/Row.vue", '<template>\n  <b @click="save" v-on:blur.once="drop(1)"/>\n</template>\n<script lang="ts">\nfunction save(): void {\n}\n</script>\n'), ("zq/Tab.svelte", "<script>\n  const go = () => {\n  }\n</script>\n<button on:click={go}>x</button>\n"), ("zq/page.liquid", "{% render 'card' %}\n{%- include \"foot\" -%}\n"),
    ("zq/main.dfm", "object Form1: TForm1\n  object Ok: TButton\n    OnClick = OkClick\n  end\nend\n"), ("zq/UserMapper.xml", '<mapper namespace="com.x.UserMapper">\n  <select id="find">\n    <include refid="cols"/>\n  </select>\n  <sql id="cols">id</sql>\n</mapper>\n'), ("zq/empty.vue", ""), ("zq/plain.xml", "<a/>"),
)
PARTS = (
    ("zq/Row.vue", "component", "Row", 1, None), ("zq/Row.vue", "function", "save", 5, "typescript"), ("zq/Row.vue", "handler", "save", 2, "click"), ("zq/Row.vue", "handler", "drop", 2, "blur"), ("zq/Tab.svelte", "component", "Tab", 1, None), ("zq/Tab.svelte", "function", "go", 2, "javascript"), ("zq/Tab.svelte", "handler", "go", 5, "click"),
    ("zq/page.liquid", "render", "card", 1, None), ("zq/page.liquid", "include", "foot", 2, None), ("zq/main.dfm", "object", "Form1", 1, "TForm1"), ("zq/main.dfm", "object", "Ok", 2, "TButton"), ("zq/main.dfm", "handler", "OkClick", 3, "OnClick"), ("zq/UserMapper.xml", "statement", "com.x.UserMapper.find", 2, "select"), ("zq/UserMapper.xml", "statement", "com.x.UserMapper.cols", 5, "sql"),
    ("zq/UserMapper.xml", "include", "com.x.UserMapper.cols", 3, None), ("zq/empty.vue", "component", "empty", 1, None),
)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(p, *x) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in outline.component(p, t)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()))], names=["path", "kind", "name", "line", "extra"])


@query("component_parts", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in PARTS) + ") AS v(path, kind, name, line, extra)")
def component_parts(s, d):
    """Parts of Vue, Svelte, Liquid, form and mapper files; other files never leave the JVM."""
    t = load(s, d, "source_texts").filter("content is not null").filter(F.lower("path").rlike(r"\.(vue|svelte|liquid|dfm|xml)$")).select("path", "content")
    return t.union(s.createDataFrame(list(COMPONENTS), "path string, content string")).mapInArrow(_parts, "path string, kind string, name string, line int, extra string")


_NAMED = "name LIKE 'rotate%'"


@query(
    "flow_chain",
    sql(f""", nm AS (SELECT id FROM n WHERE kind IN ('function', 'method') AND {_NAMED} ORDER BY id LIMIT 8), c AS (SELECT DISTINCT source, target FROM e WHERE kind = 'calls' AND source IN (SELECT id FROM n) AND target IN (SELECT id FROM n) AND source <> target),
w(chain, id, bridges, len) AS (SELECT [id], id, 0, 1 FROM nm UNION ALL SELECT list_append(w.chain, c.target), c.target, bridges + CASE WHEN c.target IN (SELECT id FROM nm) THEN 0 ELSE 1 END, len + 1 FROM w JOIN c ON c.source = w.id WHERE len < 7 AND NOT list_contains(w.chain, c.target) AND bridges + CASE WHEN c.target IN (SELECT id FROM nm) THEN 0 ELSE 1 END <= 1)
SELECT array_to_string(chain, ' > ') AS chain, len FROM w ORDER BY len DESC, array_to_string(chain, ' > ') LIMIT 1"""),
)
def flow_chain(s, d):
    """The longest chain of calls between named symbols (the first eight), with at most one unnamed in between and seven
    in all; ties go to the first in order (the single chain is the feature). Chains are rows."""
    n = Scratch(s, "flow").write(model.nodes(s, d, "id", "kind", "name"))
    nm = Scratch(s, "named").write(n.filter(f"kind in ('function', 'method') and {_NAMED}").select("id").orderBy("id").limit(8))
    ids = n.select("id")
    c = load(s, d, "edges").filter("kind = 'calls' and source <> target").select("source", "target").distinct()
    c = c.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    c = Scratch(s, "calls").write(c.join(nm.select(F.col("id").alias("target"), F.lit(0).alias("named")), "target", "left").select("source", "target", F.coalesce("named", F.lit(1)).alias("bridge")))
    cur = nm.select(F.array("id").alias("chain"), F.col("id").alias("source"), F.lit(0).alias("bridges"))
    out = cur
    for _ in range(6):
        cur = cur.join(c, "source").filter(~F.array_contains("chain", F.col("target"))).withColumn("bridges", F.col("bridges") + F.col("bridge")).filter("bridges <= 1")
        cur = cur.select(F.concat("chain", F.array("target")).alias("chain"), F.col("target").alias("source"), "bridges")
        out = out.union(cur)
    return out.select(F.array_join("chain", " > ").alias("chain"), F.size("chain").alias("len")).orderBy(F.desc("len"), "chain").limit(1)


@query("explore_budget", sql("SELECT split_part(path, '/', 1) AS member, count(*) AS n_files, CASE WHEN count(*) < 500 THEN 1 WHEN count(*) < 5000 THEN 2 WHEN count(*) < 15000 THEN 3 WHEN count(*) < 25000 THEN 4 ELSE 5 END AS calls, CASE WHEN count(*) < 150 THEN 13000 WHEN count(*) < 500 THEN 18000 ELSE 24000 END AS max_chars FROM f GROUP BY 1"))
def explore_budget(s, d):
    """How many calls and characters an exploration may spend, by the number of files."""
    n = model.files(s, d, "path", "language").groupBy(F.substring_index("path", "/", 1).alias("member")).agg(F.count("*").alias("n_files"))
    c = F.col("n_files")
    return n.withColumn("calls", F.when(c < 500, 1).when(c < 5000, 2).when(c < 15000, 3).when(c < 25000, 4).otherwise(5)).withColumn("max_chars", F.when(c < 150, 13000).when(c < 500, 18000).otherwise(24000))


_CUT = re.compile(r"\n#### ")


def ceiling(text: str, most: int = 25_000) -> str:
    """A rendered text cut to the ceiling, at the last '####' heading if that lies in its back half."""
    if len(text) <= most:
        return text
    cut = text[:most]
    at = [m.start() for m in _CUT.finditer(cut)]
    return cut[: at[-1]] if at and at[-1] > most / 2 else cut
