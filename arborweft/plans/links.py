"""Link graph, import resolution, provenance and registries, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborweft.functions.text import path_depth
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


_MD = re.compile(r"(?<!!)\[([^\]\[]*)\]\(([^()\s]+)(?:\s+\"[^\"]*\")?\)|\[\[([^\]|\[]+)(?:\|([^\]]*))?\]\]")


def markdown_links(text: str) -> list[tuple[int, str, str]]:
    """(line, kind, target) of the links of a page in order: markdown and [[page|alias]] links outside fenced blocks and
    inline code; images do not count; an unclosed backtick ends the line."""
    out, fence = [], None
    for no, line in enumerate(text.split("\n"), 1):
        m = re.match(r"\s*(`{3,}|~{3,})", line)
        if m:
            fence = None if fence and m.group(1)[0] == fence else fence or m.group(1)[0]
            continue
        if fence:
            continue
        parts = line.split("`")
        bare = "".join(" " * len(p) if i % 2 else p for i, p in enumerate(parts)) if len(parts) % 2 else "".join(" " * len(p) if i % 2 else p for i, p in enumerate(parts[:-1]))
        for x in _MD.finditer(bare):
            out.append((no, "wiki", x.group(3).strip()) if x.group(3) else (no, "markdown", x.group(2)))
    return out


_SPEC = r"""(?m)^import .*? from ['"]([^'"\n]+)['"]"""


def import_links(s, d) -> DataFrame:
    """(path, spec): import specifiers of JavaScript and TypeScript texts."""
    f = model.files(s, d, "path", "language").filter("language in ('javascript', 'typescript')").select("path")
    t = load(s, d, "source_texts").filter(F.col("content").contains("import ")).select("path", "content").join(f, "path", "left_semi")
    return t.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(_SPEC), F.lit(1)))).alias("spec"))


# Endings tried in this order for a relative specifier.
ENDINGS = ("", ".ts", ".js", ".py", "/index.ts", "/index.js")


@query(
    "import_resolution",
    sql(
        ", x AS (SELECT f.path, unnest(list_distinct(regexp_extract_all(content, '(?m)^import .*? from [''\"]([^''\"\\n]+)[''\"]', 1))) AS spec FROM f JOIN source_texts t ON t.path = f.path WHERE f.language IN ('javascript', 'typescript') AND content IS NOT NULL), y AS (SELECT path, spec, regexp_replace(path, '/[^/]*$', '') || substr(spec, 2) AS base FROM x WHERE starts_with(spec, './')), c(ord, ending) AS (VALUES "
        + ", ".join(f"({i}, '{e}')" for i, e in enumerate(ENDINGS))
        + ") SELECT y.path, y.spec, arg_min(g.path, c.ord) AS resolved, count(g.path) = 0 AS broken FROM y CROSS JOIN c LEFT JOIN f g ON g.path = y.base || c.ending GROUP BY 1, 2"
    ),
)
def import_resolution(s, d):
    """Relative specifiers against the known files: all endings are tried at once by an equi-join, the first one
    that exists wins; none means broken."""
    x = import_links(s, d).filter(F.col("spec").startswith("./"))
    base = F.concat(F.regexp_replace("path", "/[^/]*$", ""), F.expr("substr(spec, 2)"))
    c = x.withColumn("base", base).select("path", "spec", F.posexplode(F.transform(F.array(*[F.lit(e) for e in ENDINGS]), lambda e: F.concat(F.col("base"), e))).alias("ord", "candidate"))
    known = model.files(s, d, "path", "language").select(F.col("path").alias("candidate"), F.lit(True).alias("ok"))
    g = c.join(known, "candidate", "left").groupBy("path", "spec").agg(F.min(F.when(F.col("ok"), F.struct("ord", "candidate"))).alias("m"))
    return g.select("path", "spec", F.col("m.candidate").alias("resolved"), F.col("m").isNull().alias("broken"))


@query("backlinks", sql("SELECT f.path, count(DISTINCT a.file_path) AS n_inbound FROM f LEFT JOIN n b ON b.file_path = f.path LEFT JOIN e ON e.target = b.id AND e.kind <> 'contains' LEFT JOIN n a ON a.id = e.source AND a.file_path <> f.path GROUP BY f.path"))
def backlinks(s, d):
    """Distinct files that point into a file; 0 marks an orphan."""
    n = Scratch(s, "paths").write(model.nodes(s, d, "id", "file_path").filter("file_path is not null"))
    e = load(s, d, "edges").filter("kind <> 'contains'").select("source", "target").distinct()
    j = e.join(n.select(F.col("id").alias("target"), F.col("file_path").alias("path")), "target").join(n.select(F.col("id").alias("source"), F.col("file_path").alias("via")), "source")
    c = j.filter("path <> via").select("path", "via").distinct().groupBy("path").agg(F.count("*").alias("n"))
    return model.files(s, d, "path", "language").join(c, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n_inbound"))


_DEPTH = lambda c: f"(length({c}) - length(replace({c}, '/', '')))"


@query("nearest_candidate", sql(f", l AS (SELECT DISTINCT a.file_path AS page, lower(string_split(b.file_path, '/')[-1]) AS base FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target WHERE e.kind = 'imports' AND b.kind = 'file'), k AS (SELECT page, base, f.path, count(*) OVER (PARTITION BY page, base) AS n, row_number() OVER (PARTITION BY page, base ORDER BY abs({_DEPTH('page')} - {_DEPTH('f.path')}), f.path) AS rn FROM l JOIN f ON lower(string_split(f.path, '/')[-1]) = base) SELECT page, base, path AS resolved, n > 1 AS ambiguous FROM k WHERE rn = 1"))
def nearest_candidate(s, d):
    """L3: a page name meets all files of that base name in any letter case: nearest in folder depth, then by alphabet; more
    than one is ambiguous. One aggregation, no window."""
    n = model.nodes(s, d, "id", "kind", "file_path")
    e = load(s, d, "edges").filter("kind = 'imports'").select("source", "target").distinct()
    last = lambda c: F.lower(F.substring_index(c, "/", -1))
    li = e.join(n.select(F.col("id").alias("source"), F.col("file_path").alias("page")), "source").join(n.filter("kind = 'file'").select(F.col("id").alias("target"), last("file_path").alias("base")), "target").filter("page is not null").select("page", "base").distinct()
    f = model.files(s, d, "path", "language").select("path", last("path").alias("base"))
    g = li.join(f, "base").groupBy("page", "base").agg(F.min(F.struct(F.abs(path_depth(F.col("page")) - path_depth(F.col("path"))).alias("far"), "path")).alias("m"), F.count("*").alias("n"))
    return g.select("page", "base", F.col("m.path").alias("resolved"), (F.col("n") > 1).alias("ambiguous"))


@query("external_registry", sql("SELECT target AS url, count(DISTINCT source) AS n_sources, epoch_us(min(loaded_at)) AS first_seen_us, min(source) AS first_source FROM e WHERE target LIKE 'package:%' AND source IS NOT NULL GROUP BY 1"))
def external_registry(s, d):
    """External targets with distinct sources and first sight. Pairs are made distinct first: a target that a third of
    all edges point to is never one list."""
    e = load(s, d, "edges").filter("target like 'package:%' and source is not null").groupBy("target", "source").agg(F.min("loaded_at").alias("at"))
    return e.groupBy(F.col("target").alias("url")).agg(F.count("*").alias("n_sources"), F.unix_micros(F.min("at").cast("timestamp")).alias("first_seen_us"), F.min("source").alias("first_source"))


_LIVE = "h AS (SELECT path, count(DISTINCT content_hash) > 1 AS moved FROM files WHERE path IS NOT NULL GROUP BY path)"


@query("provenance_drift", sql(f", {_LIVE}, d AS (SELECT DISTINCT source, target, coalesce(h.moved, false) AS drift FROM e LEFT JOIN h ON 'file:' || h.path = e.source WHERE e.kind = 'imports' AND source LIKE 'file:%' AND target LIKE 'file:%'), z AS (SELECT source AS id, drift FROM d UNION ALL SELECT target, drift FROM d) SELECT id, bool_or(drift) AS drift FROM z GROUP BY id"))
def provenance_drift(s, d):
    """An edge drifts when its source's recorded hash is not its latest one; drift is passed to both ends."""
    h = load(s, d, "files").filter("path is not null").groupBy("path").agg((F.min("content_hash") != F.max("content_hash")).alias("moved")).select(F.concat(F.lit("file:"), "path").alias("source"), "moved")
    e = load(s, d, "edges").filter("kind = 'imports' and source like 'file:%' and target like 'file:%'").select("source", "target").distinct()
    z = e.join(h, "source", "left").select(F.explode(F.array("source", "target")).alias("id"), F.coalesce("moved", F.lit(False)).alias("drift"))
    return z.groupBy("id").agg(F.max("drift").alias("drift"))


@query("page_meta", r"""SELECT doc_id, coalesce(title, doc_type, 'page') AS title, CASE WHEN doc_type IS NOT NULL THEN doc_type WHEN source LIKE '%/wiki' THEN 'wiki' ELSE 'page' END AS type, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '' AND NOT regexp_matches(x, '^(#|[-*+] |\||>|```|---|<!--|[0-9]+[.)] )'))[1][1:120], '') AS snippet FROM documents""")
def page_meta(s, d):
    """Title, type and the first plain line, up to 120 characters."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x, F.lit(" \t\r")))
    plain = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(#|[-*+] |\||>|```|---|<!--|[0-9]+[.)] )"))
    kind = F.when(F.col("doc_type").isNotNull(), F.col("doc_type")).when(F.col("source").endswith("/wiki"), "wiki").otherwise("page")
    return load(s, d, "documents").select("doc_id", F.coalesce("title", "doc_type", F.lit("page")).alias("title"), kind.alias("type"), F.coalesce(F.substring(F.get(plain, 0), 1, 120), F.lit("")).alias("snippet"))


@query("snapshot_fingerprint", sql("SELECT split_part(path, '/', 1) AS member, count(*) AS n, sum(CAST(CAST('0x' || substr(sha256(path || chr(9) || size || chr(9) || epoch_us(modified_at)), 1, 15) AS BIGINT) AS HUGEINT))::VARCHAR AS mark FROM f WHERE size IS NOT NULL AND modified_at IS NOT NULL GROUP BY 1"))
def snapshot_fingerprint(s, d):
    """One mark of the file set per member; it moves when any path, size or time does. Sums need no order."""
    f = model.files(s, d, "path", "size", "modified_at").filter("size is not null and modified_at is not null")
    h = F.conv(F.substring(F.sha2(F.concat_ws("\t", "path", F.col("size").cast("string"), F.unix_micros(F.col("modified_at").cast("timestamp")).cast("string")), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return f.groupBy(F.substring_index("path", "/", 1).alias("member")).agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("mark"))
