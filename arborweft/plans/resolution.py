"""Reference resolution and synthesised edges, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborweft.operators import imports, model, synthesis
from arborweft.operators import resolve as op
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


_NODE = ("id", "kind", "name", "qualified_name", "file_path", "language", "start_line", "is_exported")
_REF = ("from_node_id", "reference_name", "reference_kind", "line", "file_path", "language", "callee_expr")
# A few symbols and references for strategies that the stored ones, all plain names, do not reach.
FIX_NODES = (
    ("class:zq1", "class", "ZqLedgerStore", "com.zq.ZqLedgerStore", "zq/src/ZqLedgerStore.java", "java", 3, True),
    ("class:zq2", "class", "ZqLedgerStore", "org.other.ZqLedgerStore", "zq/oth/ZqLedgerStore.java", "java", 3, True),
    ("method:zq1", "method", "zqConnect", "Socket::zqConnect", "zq/src/a.java", "java", 9, True),
    ("method:zq2", "method", "zqConnect", "Connection::zqConnect", "zq/src/a.java", "java", 9, True),
    ("column:zq1", "column", "zq_total", "app.zq_orders.zq_total", "zq/db/s.sql", "sql", 2, False),
    ("function:zq1", "function", "zqQualified", "zqmod::inner::zqQualified", "zq/src/q.py", "python", 4, True),
    ("file:zq/lib/tool.go", "file", "zq/lib/tool.go", "zq/lib/tool.go", "zq/lib/tool.go", "go", 1, False),
    ("interface:zq1", "interface", "ZqReadable", "ZqReadable", "zq/src/ZqReadable.java", "java", 1, True),
)
FIX_REFS = (
    ("ref:zq01", "function:zq1", "com.zq.ZqLedgerStore", "references", 5, "zq/src/x.java", "java", ""),
    ("ref:zq02", "function:zq1", "conn.zqConnect", "calls", 9, "zq/src/a.java", "java", ""),
    ("ref:zq03", "function:zq1", "zq_orders.zq_total", "references", 5, "zq/db/t.sql", "sql", ""),
    ("ref:zq04", "function:zq1", "zqmod::inner::zqQualified", "calls", 5, "zq/src/r.py", "python", ""),
    ("ref:zq05", "function:zq1", "inner::zqQualified", "calls", 5, "zq/src/r.py", "python", ""),
    ("ref:zq06", "function:zq1", "zq/lib/tool", "references", 5, "zq/src/r.go", "go", ""),
    ("ref:zq07", "function:zq1", "ZqReadable", "extends", 5, "zq/src/y.java", "java", ""),
    ("ref:zq08", "function:zq1", "ZqLedgerStore", "calls", 5, "zq/src/y.java", "java", ""),
    ("ref:zq09", "function:zq1", "zqQualifeid", "calls", 5, "zq/src/r.py", "python", ""),
    ("ref:zq10", "function:zq1", "println", "calls", 5, "zq/src/r.rs", "rust", ""),
)


def _typed(s, rows, like):
    return s.createDataFrame([r for r in rows], like.schema)


def _n(s, d):
    n = model.nodes(s, d, *_NODE)
    return n.union(_typed(s, FIX_NODES, n))


def _r(s, d):
    r = model.refs(s, d, *_REF)
    return r.union(_typed(s, FIX_REFS, r))


def _lit(rows) -> str:
    return ", ".join("(" + ", ".join(str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)


def fsql(body: str) -> str:
    """SQL over the stored nodes and references and the fixed ones."""
    views = model.SQL.replace("n AS (", "n0 AS (").replace("r AS (", "r0 AS (")
    cols = ", ".join(_NODE)
    rcols = "id, " + ", ".join(_REF)
    return f"WITH RECURSIVE {views}, n AS (SELECT {cols} FROM n0 UNION ALL VALUES {_lit(FIX_NODES)}), r AS (SELECT {rcols} FROM r0 UNION ALL VALUES {_lit(FIX_REFS)}) {body}"


_DIRS = lambda c: f"string_split(CASE WHEN regexp_replace({c}, '/?[^/]*$', '') = '' THEN '.' ELSE regexp_replace({c}, '/?[^/]*$', '') END, '/')"
_SCORE = f"""CASE WHEN r.file_path = n.file_path THEN 100.0 ELSE coalesce(80.0 * len(list_filter(generate_series(1, len({_DIRS('r.file_path')})), lambda i: {_DIRS('r.file_path')}[1:i] = {_DIRS('n.file_path')}[1:i])) / greatest(len({_DIRS('r.file_path')}), len({_DIRS('n.file_path')})), 0.0) END
+ CASE WHEN r.language IS NOT NULL AND r.language NOT IN ('', 'unknown') THEN CASE WHEN r.language = n.language THEN 50.0 ELSE -80.0 END ELSE 0.0 END
+ CASE WHEN (r.reference_kind IN ('calls', 'decorates') AND n.kind IN ('function', 'method')) OR (r.reference_kind = 'instantiates' AND n.kind IN ('class', 'struct')) THEN 25.0 ELSE 0.0 END
+ CASE WHEN coalesce(n.is_exported, false) THEN 10.0 ELSE 0.0 END + CASE WHEN r.line > 0 AND n.start_line > 0 THEN greatest(0.0, 10.0 - abs(r.line - n.start_line) / 10.0) ELSE 0.0 END"""
_BUILTIN = "(" + " OR ".join(f"(r.language IN ({', '.join(repr(x) for x in langs)}) AND r.reference_name IN ({', '.join(repr(x) for x in sorted(names))}))" for langs, names in op.BUILTINS.items()) + ")"
_JVM, _LOW = "r.language IN ('java', 'kotlin', 'scala')", "lower(r.reference_name)"
_DOTS = "(length(reference_name) - length(replace(reference_name, '.', '')))"
_METHOD = "(NOT contains(reference_name, '/') AND regexp_full_match(reference_name, '[^.]+\\.[^.]+'))"
_SIMPLE = "lower(regexp_split_to_array(r.reference_name, '::|\\.')[-1])"
_TAILED = f"(ends_with(lower(n.qualified_name), '::' || {_LOW}) OR ends_with(lower(n.qualified_name), '.' || {_LOW}))"
_ROW = lambda st, sc, bias="1": f"SELECT r.id AS ref_id, {st} AS strategy, n.id AS node_id, n.kind AS node_kind, round({sc}, 6) AS score, {bias} AS bias"
_EXACT = f"{_ROW(op.EXACT, _SCORE)} FROM rr r JOIN n ON lower(n.name) = {_LOW}"
_QUAL = f"{_ROW(f'CASE WHEN lower(n.qualified_name) = {_LOW} THEN {op.QUALIFIED} ELSE {op.QUALIFIED_TAIL} END', _SCORE)} FROM rr r JOIN n ON lower(n.name) = {_SIMPLE} WHERE (contains(reference_name, '::') OR (NOT contains(reference_name, '/') AND {_DOTS} >= 2)) AND (lower(n.qualified_name) = {_LOW} OR {_TAILED})"
_FQN = f"{_ROW(op.FQN, '200.0')} FROM rr r JOIN n ON lower(n.name) = lower(string_split(r.reference_name, '.')[-1]) AND lower(n.qualified_name) = {_LOW} WHERE {_JVM} AND contains(reference_name, '.')"
_SQLC = f"{_ROW(f'CASE WHEN lower(n.qualified_name) = {_LOW} THEN {op.SQL_EQUAL} ELSE {op.SQL_TAIL} END', _SCORE)} FROM rr r JOIN n ON lower(n.name) = {_SIMPLE} WHERE r.language = 'sql' AND {_METHOD} AND (lower(n.qualified_name) = {_LOW} OR {_TAILED})"
_BIAS = "CASE WHEN r.language IN ('java', 'cpp', 'kotlin', 'scala') AND len(list_filter(regexp_split_to_array(lower(n.qualified_name), '[:.]+'), lambda w: starts_with(w, lower(substr(string_split(r.reference_name, '.')[1], 1, 4))))) > 0 THEN 0 ELSE 1 END"
_METH = f"{_ROW(op.METHOD, _SCORE, _BIAS)} FROM rr r JOIN n ON n.kind IN ('function', 'method') AND lower(n.name) = lower(string_split(reference_name, '.')[-1]) WHERE {_METHOD}"
_PATH = f"{_ROW(op.PATH, _SCORE)} FROM rr r JOIN n ON n.id IN ('file:' || r.reference_name, 'file:' || r.reference_name || '.go') WHERE contains(reference_name, '/') AND r.language = 'go'"
_NEAR = "near AS (SELECT a, b, levenshtein(a, b) AS dist FROM (SELECT DISTINCT lower(reference_name) AS a FROM r WHERE reference_name <> '' AND strlen(lower(reference_name)) <= 40) x JOIN (SELECT DISTINCT lower(name) AS b FROM n WHERE name <> '') y ON abs(length(a) - length(b)) <= 2 AND levenshtein(a, b) BETWEEN 1 AND CASE WHEN length(a) <= 4 THEN 1 ELSE 2 END)"
_FUZZ = f"{_ROW(op.FUZZY, _SCORE)} FROM rr r JOIN near ON near.a = {_LOW} JOIN n ON lower(n.name) = near.b"


@query("resolve_exact", fsql(f", rr AS (SELECT * FROM r) SELECT ref_id, node_id, node_kind, score FROM ({_EXACT})"))
def resolve_exact(s, d):
    """All candidates of equal name with their scores."""
    return op.candidates_exact(_r(s, d), _n(s, d)).select("ref_id", "node_id", "node_kind", F.round("score", 6).alias("score"))


@query("resolve_qualified", fsql(f", rr AS (SELECT r.* REPLACE (x.qualified_name AS reference_name) FROM r JOIN n x ON x.id = r.from_node_id) SELECT ref_id, strategy, node_id FROM ({_QUAL})"))
def resolve_qualified(s, d):
    """Qualified references; here the qualified names of the referencing symbols."""
    n = _n(s, d)
    r = _r(s, d).join(n.select(F.col("id").alias("from_node_id"), F.col("qualified_name").alias("q")), "from_node_id").withColumn("reference_name", F.col("q")).withColumn("reference_kind", F.lit("references"))
    return op.by_name(r, n).filter(F.col("strategy").isin(op.QUALIFIED, op.QUALIFIED_TAIL)).select("ref_id", "strategy", "node_id")


@query("resolve_fuzzy", fsql(f", {_NEAR} SELECT a, b, dist FROM near"))
def resolve_fuzzy(s, d):
    """Reference names and symbol names within the edit bound."""
    return op.similar_names(_r(s, d).select(F.lower("reference_name").alias("a")), _n(s, d).select(F.lower("name").alias("b"))).withColumn("dist", F.col("dist").cast("long"))


@query("resolve_score_best", fsql(f", rr AS (SELECT * FROM r) SELECT ref_id, strategy, node_id, node_kind, score FROM ({_EXACT}) QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, node_id) = 1"))
def resolve_score_best(s, d):
    """The best candidate of each reference; ties go to the least id."""
    return op.best_exact(_r(s, d), _n(s, d))


_CAND = f", rr AS (SELECT * FROM r WHERE NOT coalesce({_BUILTIN}, false) AND reference_kind NOT IN ('sql_string', 'sql_fragment', 'imports') AND reference_name <> ''), {_NEAR}, c AS ({_EXACT} UNION ALL {_QUAL} UNION ALL {_METH} UNION ALL {_FQN} UNION ALL {_SQLC} UNION ALL {_PATH} UNION ALL {_FUZZ}), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY strategy, score DESC, bias, node_id) = 1)"


@query(
    "resolve_cascade",
    fsql(_CAND + f" SELECT ref_id, strategy, node_id, score, round(greatest(0.0, least(1.0, score / 200.0)) * CASE WHEN strategy = {op.FUZZY} THEN 0.6 ELSE 1.0 END, 6) AS confidence, CASE WHEN reference_kind = 'calls' AND node_kind IN ('class', 'struct') THEN 'instantiates' WHEN reference_kind = 'extends' AND node_kind IN ('interface', 'trait', 'protocol') THEN 'implements' ELSE reference_kind END AS edge_kind FROM b JOIN r ON r.id = b.ref_id"),
)
def resolve_cascade(s, d):
    """The whole resolution by name and path."""
    return op.cascade(_r(s, d), _n(s, d))


@query("resolution_summary", fsql(_CAND + " SELECT r.reference_kind, coalesce(b.strategy, 0) AS strategy, count(*) AS n FROM r LEFT JOIN b ON b.ref_id = r.id GROUP BY ALL"))
def resolution_summary(s, d):
    """What is resolved by which strategy and what stays (strategy 0)."""
    r = Scratch(s, "refs").write(_r(s, d))
    got = op.cascade(r, _n(s, d)).select(F.col("ref_id").alias("id"), "strategy")
    return r.select("id", "reference_kind").join(got, "id", "left").groupBy("reference_kind", F.coalesce("strategy", F.lit(0)).alias("strategy")).agg(F.count("*").alias("n"))


@query("resolved_edges", fsql(_CAND + " SELECT b.ref_id, r.from_node_id AS source, b.node_id AS target, r.line, CASE WHEN len(u.arguments) > 0 THEN '{\"refArgs\":' || to_json(u.arguments) || '}' END AS metadata, CASE WHEN r.language = 'sql' AND NOT regexp_matches(lower(coalesce(r.file_path, '')), '\\.(sql|ddl|psql|pgsql|plsql|tsql)(\\.jinja)?$') THEN 'embedded' ELSE '' END AS provenance FROM b JOIN r ON r.id = b.ref_id LEFT JOIN (SELECT id, any_value(arguments) AS arguments FROM unresolved_refs GROUP BY id) u ON u.id = b.ref_id"))
def resolved_edges(s, d):
    """The edges of resolved references, with their arguments and provenance."""
    r = model.refs(s, d, *_REF, "arguments")
    fixed = s.createDataFrame([(*x, None) for x in FIX_REFS], r.schema)
    r = Scratch(s, "refs").write(r.union(fixed))
    return op.edges_of(op.cascade(r.drop("arguments"), _n(s, d)), r).select("ref_id", "source", "target", "line", "metadata", "provenance")


@query("all_candidates", fsql(f", rr AS (SELECT * FROM r WHERE reference_kind IN ('extends', 'calls') AND reference_name <> ''), {_NEAR}, c AS ({_EXACT} UNION ALL {_QUAL} UNION ALL {_METH} UNION ALL {_FQN} UNION ALL {_SQLC} UNION ALL {_PATH} UNION ALL {_FUZZ}) SELECT ref_id, node_id, max(score) AS score FROM c GROUP BY ALL"))
def all_candidates(s, d):
    """Every candidate of every strategy, with its best score."""
    r = Scratch(s, "refs").write(_r(s, d).filter("reference_kind in ('extends', 'calls')"))
    return op.all_candidates(r, Scratch(s, "nodes").write(_n(s, d))).withColumn("score", F.round("score", 6))


@query("builtin_prune", fsql(f"SELECT id AS ref_id FROM r WHERE NOT coalesce({_BUILTIN.replace('r.reference_name', 'lower(r.reference_name)')}, false) AND lower(reference_name) IN (SELECT lower(name) FROM n)"))
def builtin_prune(s, d):
    """References left after the built-in list and the known-name test."""
    names = _n(s, d).filter("name is not null").select(F.lower("name").alias("k")).distinct()
    r = _r(s, d).filter(~op.is_builtin(F.lower("reference_name"), F.col("language"))).withColumn("k", F.lower("reference_name"))
    return r.join(names, "k", "left_semi").select(F.col("id").alias("ref_id"))


@query("edge_promotion", sql("SELECT e.id, CASE WHEN e.kind = 'calls' AND n.kind IN ('class', 'struct') THEN 'instantiates' WHEN e.kind = 'extends' AND n.kind IN ('interface', 'trait', 'protocol') THEN 'implements' ELSE e.kind END AS kind FROM e JOIN n ON n.id = e.target"))
def edge_promotion(s, d):
    """R6 over the stored edges."""
    n = model.nodes(s, d, "id", "kind").select(F.col("id").alias("target"), F.col("kind").alias("node_kind"))
    return model.edges(s, d, "target", "kind").join(n, "target").select("id", op.promote(F.col("kind"), F.col("node_kind")).alias("kind"))


_SPEC = "CASE WHEN target LIKE 'package:npm/%' THEN substr(target, 13) END"


@query("package_mint_sweep", sql(f", p AS (SELECT DISTINCT 'package:npm/' || CASE WHEN contains(s, '://') THEN '' WHEN s LIKE '@%' THEN regexp_extract(s, '^(@[^/]*/[^/]+)', 1) ELSE string_split(s, '/')[1] END AS id FROM (SELECT {_SPEC} AS s FROM e WHERE kind IN ('imports', 'references')) WHERE s IS NOT NULL) SELECT id, EXISTS (SELECT 1 FROM e WHERE e.target = p.id) AS in_use FROM p"))
def package_mint_sweep(s, d):
    """One package node per external import, and whether an edge still points to it (else it is swept)."""
    e = load(s, d, "edges").filter("kind in ('imports', 'references') and target like 'package:npm/%'").select(F.substring("target", 13, 10_000).alias("s")).distinct()
    p = e.select(F.concat(F.lit("package:npm/"), op.npm_package(F.col("s"))).alias("id")).distinct()
    used = load(s, d, "edges").filter("target like 'package:%'").select(F.col("target").alias("id")).distinct().withColumn("u", F.lit(True))
    return p.join(used, "id", "left").select("id", F.coalesce("u", F.lit(False)).alias("in_use"))


@query("external_imports", fsql("SELECT id AS ref_id, reference_name FROM r WHERE reference_kind = 'imports' AND NOT (starts_with(reference_name, './') OR starts_with(reference_name, '../') OR reference_name IN ('.', '..')) AND (contains(reference_name, '://') OR starts_with(reference_name, 'node:') OR starts_with(reference_name, '@') OR (language IN ('javascript', 'typescript') AND NOT regexp_matches(reference_name, '^[./#]')) OR (language = 'python' AND NOT contains(reference_name, '.')) OR (language = 'go' AND NOT contains(string_split(reference_name, '/')[1], '.')) OR (language = 'java' AND regexp_matches(reference_name, '^(java|javax|android|kotlin|scala|org\\.junit|org\\.springframework)\\.')))"))
def external_imports(s, d):
    """Imports for which no file is expected."""
    return _r(s, d).filter("reference_kind = 'imports'").filter(op.is_external(F.col("reference_name"), F.col("language"))).select(F.col("id").alias("ref_id"), "reference_name")


@query("reexport_follow", sql(""", fst AS (SELECT source, arg_min(target, id) AS target FROM e WHERE kind = 'imports' AND target LIKE 'file:%' AND source LIKE 'file:%' GROUP BY source), st AS (SELECT DISTINCT source AS id FROM fst),
w(id, at_, seen, n) AS (SELECT id, id, [id], 0 FROM st UNION ALL SELECT w.id, fst.target, list_append(seen, fst.target), n + 1 FROM w JOIN fst ON fst.source = w.at_ WHERE n < 8 AND NOT list_contains(seen, fst.target))
SELECT id, arg_max(at_, n) AS final, max(n) AS hops FROM w GROUP BY id"""))
def reexport_follow(s, d):
    """R11 on the file imports of the graph (it has no exports edges): the first edge, at most eight hops, loops end."""
    e = model.edges(s, d, "source", "target", "kind").filter("kind = 'imports' and source like 'file:%' and target like 'file:%'")
    return op.reexports(e, e.select(F.col("source").alias("id")).distinct(), "imports")


_VERB = "lower(coalesce(regexp_split_to_array(callee_expr, '::|\\.')[-1], '')) IN (" + ", ".join(repr(v) for v in sorted(op.BUILDER_VERBS)) + ")"
_PASS_A = f"pa AS (SELECT r.id AS ref_id, from_node_id AS source, o.id AS target, CASE WHEN {_VERB} THEN CASE WHEN reference_kind = 'sql_fragment' THEN 'medium' ELSE 'high' END ELSE CASE WHEN reference_kind = 'sql_fragment' THEN 'low' ELSE 'medium' END END AS confidence FROM r JOIN n o ON lower(o.name) = lower(r.reference_name) AND o.kind IN ('table', 'view', 'procedure', 'function') WHERE reference_kind IN ('sql_string', 'sql_fragment') AND NOT contains(reference_name, '.') AND from_node_id IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r.id) <= 3)"


@query("string_match_pass_a", fsql(f", {_PASS_A} SELECT * FROM pa"))
def string_match_pass_a(s, d):
    """R21, R23."""
    return op.string_match(_r(s, d), _n(s, d))


FIX_TABLES = (
    ("table:zqa", "table", "zq_orders", "zq_orders", "zq/db/s.sql", "sql", 1, True), ("column:zqa", "column", "status", "zq_orders.status", "zq/db/s.sql", "sql", 2, False), ("column:zqb", "column", "zqsum", "zq_orders.zqsum", "zq/db/s.sql", "sql", 3, False),
    ("table:zqb", "table", "zq_many", "a.zq_many", "zq/db/s.sql", "sql", 9, True), ("table:zqc", "table", "zq_many", "b.zq_many", "zq/db/s.sql", "sql", 9, True), ("table:zqd", "table", "zq_many", "c.zq_many", "zq/db/s.sql", "sql", 9, True), ("table:zqe", "table", "zq_many", "d.zq_many", "zq/db/s.sql", "sql", 9, True), ("column:zqc", "column", "k", "a.zq_many.k", "zq/db/s.sql", "sql", 9, False),
)
FIX_STRINGS = (
    ("ref:zs1", "function:zs", "ZQ_ORDERS", "sql_string", 1, "zq/a.ts", "typescript", "db.selectFrom"), ("ref:zs2", "function:zs", "zq_orders.status", "sql_string", 2, "zq/a.ts", "typescript", ""), ("ref:zs3", "function:zs", "Zq_Orders.Status", "sql_fragment", 3, "zq/a.ts", "typescript", ""),
    ("ref:zs4", "function:zs", "zqsum", "sql_string", 4, "zq/a.ts", "typescript", "qb.column"), ("ref:zs5", "function:zs", "zqsum", "sql_fragment", 5, "zq/a.ts", "typescript", "qb.column"), ("ref:zs6", "function:zs", "zqsum", "sql_string", 6, "zq/a.ts", "typescript", ""),
    ("ref:zs7", "function:zt", "zqsum", "sql_string", 7, "zq/b.ts", "typescript", ""), ("ref:zs8", "function:zt", "zq_many.k", "sql_string", 8, "zq/b.ts", "typescript", ""), ("ref:zs9", "function:zt", "zq_many", "sql_string", 9, "zq/b.ts", "typescript", ""),
)


def _strings(s, d):
    n, r = model.nodes(s, d, *_NODE), model.refs(s, d, *_REF)
    return Scratch(s, "nodes").write(n.union(_typed(s, FIX_TABLES, n))), Scratch(s, "refs").write(r.union(_typed(s, FIX_STRINGS, r)))


_COLS = f"""n AS (SELECT {', '.join(_NODE)} FROM n0 UNION ALL VALUES {_lit(FIX_TABLES)}), r AS (SELECT id, {', '.join(_REF)} FROM r0 UNION ALL VALUES {_lit(FIX_STRINGS)}), {_PASS_A},
tb AS (SELECT id, lower(name) AS x, lower(qualified_name) AS q FROM n WHERE kind IN ('table', 'view')), k AS (SELECT id, lower(qualified_name) AS q FROM n WHERE kind = 'column'), sr AS (SELECT * FROM r WHERE reference_kind IN ('sql_string', 'sql_fragment') AND from_node_id IS NOT NULL),
h AS (SELECT sr.id AS ref_id, k.id AS target, CASE WHEN reference_kind = 'sql_fragment' THEN 'low' ELSE 'medium' END AS confidence FROM sr JOIN tb ON tb.x = lower(string_split(reference_name, '.')[1]) AND (SELECT count(*) FROM tb t2 WHERE t2.x = tb.x) <= 3 JOIN k ON k.q = tb.q || '.' || lower(substr(reference_name, strpos(reference_name, '.') + 1)) WHERE contains(reference_name, '.')
UNION SELECT sr.id, k.id, CASE WHEN {_VERB.replace('callee_expr', 'sr.callee_expr')} AND reference_kind <> 'sql_fragment' THEN 'medium' ELSE 'low' END FROM sr JOIN pa ON pa.source = sr.from_node_id JOIN tb ON tb.id = pa.target JOIN k ON k.q = tb.q || '.' || lower(reference_name) WHERE NOT contains(reference_name, '.') AND sr.id NOT IN (SELECT ref_id FROM pa))"""


def _strings_sql(body: str) -> str:
    return f"WITH RECURSIVE {model.SQL.replace('n AS (', 'n0 AS (').replace('r AS (', 'r0 AS (')}, {_COLS} {body}"


@query("string_match_pass_b", _strings_sql("SELECT * FROM h"))
def string_match_pass_b(s, d):
    """Columns by table and name, or by name within the tables that the owner reaches by pass A."""
    n, r = _strings(s, d)
    return op.column_match(r, n, op.string_match(r, n))


@query("string_refs_left", _strings_sql("SELECT reference_kind, count(*) AS n FROM r WHERE reference_kind IS NULL OR reference_kind NOT IN ('sql_string', 'sql_fragment') GROUP BY 1"))
def string_refs_left(s, d):
    """What stays of the references once the string passes have deleted theirs, consumed or left over."""
    return op.string_refs_left(_strings(s, d)[1]).groupBy("reference_kind").agg(F.count("*").alias("n"))


# Import references for every outcome, as (id, specifier, language, importing file, outcome, target).
FIX_IMPORTS = (
    ("ref:zi1", "./b", "typescript", "zq/src/a.ts", "internal", "file:zq/src/b.ts"), ("ref:zi2", "../lib/c?raw#x", "typescript", "zq/src/a.ts", "internal", "file:zq/lib/c/index.ts"), ("ref:zi3", "@app/d", "typescript", "zq/src/a.ts", "internal", "file:zq/app/d.ts"), ("ref:zi4", "@app/none", "typescript", "zq/src/a.ts", "unresolved", None),
    ("ref:zi5", "@scope/pkg/deep", "typescript", "zq/src/a.ts", "external", "package:npm/@scope/pkg"), ("ref:zi6", "left-pad", "javascript", "zq/src/a.js", "external", "package:npm/left-pad"), ("ref:zi7", "fmt", "go", "zq/src/a.go", "external", None), ("ref:zi8", "../../../up", "typescript", "zq/src/a.ts", "unresolved", None),
    ("ref:zi9", "java.util.List", "java", "zq/src/A.java", "external", None), ("ref:zia", "./pkg", "python", "zq/src/a.py", "internal", "file:zq/src/pkg/__init__.py"), ("ref:zib", "@app", "typescript", "zq/src/a.ts", "external", "package:npm/@app"), ("ref:zic", "./again", "typescript", "zq/src/a.ts", "internal", "file:zq/src/b.ts"),
)
FIX_FILES = ("zq/src/b.ts", "zq/lib/c/index.ts", "zq/app/d.ts", "zq/src/pkg/__init__.py", "zq/src/again.ts")
ALIASES = '{ // paths\n "compilerOptions": { "baseUrl": "zq", "paths": { "@app/*": ["app/*", "other/*"], }, }, }'


@query("import_outcomes", fsql(r""" SELECT id AS ref_id, CASE WHEN NOT (starts_with(reference_name, './') OR starts_with(reference_name, '../')) AND (contains(reference_name, '://') OR starts_with(reference_name, 'node:') OR starts_with(reference_name, '@') OR (language IN ('javascript', 'typescript') AND NOT regexp_matches(reference_name, '^[./#]')) OR (language = 'python' AND NOT contains(reference_name, '.')) OR (language = 'go' AND NOT contains(string_split(reference_name, '/')[1], '.')) OR (language = 'java' AND regexp_matches(reference_name, '^(java|javax|android|kotlin|scala|org\.junit|org\.springframework)\.'))) THEN 'external' ELSE 'unresolved' END AS outcome,
 CASE WHEN language IN ('javascript', 'typescript') AND NOT regexp_matches(reference_name, '^[./#]') THEN 'package:npm/' || string_split(reference_name, '/')[1] END AS target_id FROM r WHERE reference_kind = 'imports' AND reference_name IS NOT NULL UNION ALL VALUES """ + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in (r[0], r[4], r[5])) + ")" for r in FIX_IMPORTS)))
def import_outcomes(s, d):
    """Import references to files or packages: aliases first, then packages, then files with all endings, and the
    first re-export of the file that is found."""
    r = _r(s, d).filter("reference_kind = 'imports'").select("id", "reference_name", "language", "file_path")
    r = r.union(s.createDataFrame([x[:4] for x in FIX_IMPORTS], r.schema))
    f = model.files(s, d, "path", "language").select("path").union(s.createDataFrame([(x,) for x in FIX_FILES], "path string"))
    exports = s.createDataFrame([(1, "file:zq/src/again.ts", "file:zq/src/b.ts", "exports")], "id long, source string, target string, kind string")
    return imports.resolve(r, f, imports.path_aliases(ALIASES), exports).select("ref_id", "outcome", "target_id")


# --- synthesised edges (Y1-Y12) ---------------------------------------------------------------------------------------

_EV = "ev AS (SELECT DISTINCT event_type, user_id, props FROM events WHERE props IS NOT NULL)"


@query("event_channel_edges", f"WITH {_EV} SELECT a.props AS event, a.user_id AS source, b.user_id AS target FROM ev a JOIN ev b ON a.props = b.props AND a.event_type = 'click' AND b.event_type = 'view' AND a.user_id <> b.user_id QUALIFY row_number() OVER (PARTITION BY a.props, a.user_id ORDER BY b.user_id) <= 6")
def event_channel_edges(s, d):
    """Dispatch sites (click) meet registrations (view) of the same event name (props); at most six targets per event
    and dispatcher, least first. Only the seven least registrations of a name can be kept (one may be the dispatcher
    itself), so they are cut to seven before the join: a hot name does not multiply."""
    ev = load(s, d, "events").filter("props is not null").select("event_type", "user_id", "props").distinct()
    disp = ev.filter("event_type = 'click'").select("props", F.col("user_id").alias("source"))
    reg = op.capped(ev.filter("event_type = 'view'").select("props", F.col("user_id").alias("target")), ["props"], ["target"], 7)
    return op.capped(disp.join(reg, "props").filter("source <> target"), ["props", "source"], ["target"], 6).select(F.col("props").alias("event"), "source", "target")


# A small graph that every rule has an answer for, and the answers, written down by hand.
SYN_NODES = (
    ("class:A", "class", "A", "A", "ui/a.js", "javascript"), ("method:A.save", "method", "save", "A::save", "ui/a.js", "javascript"), ("method:A.render", "method", "render", "A::render", "ui/a.js", "javascript"), ("component:Row", "component", "Row", "Row", "ui/row.js", "javascript"),
    ("component:V", "component", "V", "V", "ui/v.vue", "vue"), ("function:onTap", "function", "onTap", "onTap", "ui/v.vue", "vue"), ("function:send", "function", "send", "send", "ev/s.js", "javascript"), ("function:push", "function", "push", "push", "ev/p.js", "javascript"),
    *[(f"function:hear{i}", "function", f"hear{i}", f"hear{i}", "ev/h.js", "javascript") for i in range(8)], ("function:invoke", "function", "invoke", "invoke", "cb/i.js", "javascript"), ("function:cb", "function", "cbTarget", "cbTarget", "cb/c.js", "javascript"),
    ("function:walkAll", "function", "walkAll", "walkAll", "cc/w.js", "javascript"), ("function:h1", "function", "zqHandler", "zqHandler", "cc/h.js", "javascript"), ("interface:I", "interface", "I", "I", "im/i.java", "java"), ("method:I.run", "method", "run", "I::run", "im/i.java", "java"), ("class:C", "class", "C", "C", "im/c.java", "java"), ("method:C.run", "method", "run", "C::run", "im/c.java", "java"),
    ("class:B", "class", "B", "B", "ov/b.cpp", "cpp"), ("method:B.go", "method", "go", "B::go", "ov/b.cpp", "cpp"), ("class:D", "class", "D", "D", "ov/d.cpp", "cpp"), ("method:D.go", "method", "go", "D::go", "ov/d.cpp", "cpp"), ("route:r", "route", "GET /x", "GET /x", "/abs/srv/main.go", "go"), ("function:auth", "function", "authMw", "authMw", "srv/mw.go", "go"),
    ("interface:M", "interface", "UserMapper", "com.x.UserMapper", "my/M.java", "java"), ("method:M.find", "method", "find", "UserMapper::find", "my/M.java", "java"), ("function:x.find", "function", "find", "com.x.UserMapper.find", "my/M.xml", "xml"),
)
SYN_EDGES = tuple(
    (9_000_000_000 + i, *e)
    for i, e in enumerate((
        ("class:A", "method:A.save", "contains", None, None), ("class:A", "method:A.render", "contains", None, None), ("interface:I", "method:I.run", "contains", None, None), ("class:C", "method:C.run", "contains", None, None), ("class:B", "method:B.go", "contains", None, None), ("class:D", "method:D.go", "contains", None, None), ("interface:M", "method:M.find", "contains", None, None),
        ("method:A.render", "component:Row", "references", "", '{"refArgs":["jsx:Row"]}'), ("component:V", "function:onTap", "references", "", None), ("function:send", "function:cb", "references", "", '{"refArgs":["field:onDone"]}'), ("class:C", "interface:I", "implements", None, None), ("class:D", "class:B", "extends", None, None), ("method:I.run", "method:A.run", "calls", "heuristic", None),
    ))
)
SYN_REFS = tuple(
    (f"ref:zy{i:02d}", f, callee, "calls", 1, path, lang, callee, args)
    for i, (f, callee, args, path, lang) in enumerate((
        ("method:A.save", "this.setState", None, "ui/a.js", "javascript"), ("function:send", "bus.emit", ["saved"], "ev/s.js", "javascript"), ("function:push", "DeviceEventEmitter.emit", ["tick"], "ev/p.js", "javascript"), ("function:hear0", "DeviceEventEmitter.addListener", ["tick"], "ev/h.js", "javascript"),
        *[(f"function:hear{k}", "bus.on", ["saved"], "ev/h.js", "javascript") for k in range(8)], ("function:invoke", "this.onDone", None, "cb/i.js", "javascript"), ("function:send", "list.append", ["arg:zqHandler"], "cc/s.js", "javascript"), ("function:walkAll", "list.forEach", None, "cc/w.js", "javascript"), ("function:auth", "r.Use", ["arg:authMw"], "srv/main.go", "go"),
    ))
)
SYN_WANT = (
    ("method:A.save", "method:A.render", "react-render"), ("method:A.render", "component:Row", "jsx-render"), ("component:V", "function:onTap", "vue-handler"), ("function:push", "function:hear0", "rn-event-channel"), *[("function:send", f"function:hear{k}", "event-emitter") for k in range(6)],
    ("function:invoke", "function:cb", "callback"), ("function:walkAll", "function:h1", "closure-collection"), ("method:I.run", "method:C.run", "interface-impl"), ("method:B.go", "method:D.go", "cpp-override"), ("route:r", "function:auth", "gin-middleware-chain"), ("method:M.find", "function:x.find", "mybatis-java-xml"),
)


def graph(s, d) -> synthesis.Graph:
    """The stored graph with the small one; of its references only those that resolution leaves open."""
    n = model.nodes(s, d, *_NODE)
    n = Scratch(s, "nodes").write(n.union(s.createDataFrame([(*x, 1, False) for x in SYN_NODES], n.schema)))
    e = load(s, d, "edges").select("id", "source", "target", "kind", "provenance", "metadata")
    e = Scratch(s, "edges").write(e.union(s.createDataFrame(list(SYN_EDGES), e.schema)))
    r = model.refs(s, d, *_REF, "arguments")
    r = Scratch(s, "refs").write(r.union(s.createDataFrame(list(SYN_REFS), r.schema)))
    done = op.cascade(r.drop("arguments"), n).select(F.col("ref_id").alias("id"))
    return synthesis.Graph(n, e, r.join(done, "id", "left_anti"))


def _want(*rules: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in SYN_WANT if not rules or c in rules) + ") AS v(source, target, synthesized_by)"


# the stored graph has interfaces and references of methods, but no members of one name, marks of arguments or channels
@query("synth_edges", _want())
def synth_edges(s, d):
    """The edges of all rules, the first rule's per pair, without what heuristic edges say already."""
    return synthesis.compose(graph(s, d))


def _members_sql(kind: str, members: str, base: str, rule: str) -> str:
    return sql(f", o AS (SELECT DISTINCT e.source AS owner, n.id AS member, n.name AS k FROM e JOIN n ON n.id = e.target AND n.kind IN {members} WHERE e.kind = 'contains') SELECT DISTINCT b.member AS source, s.member AS target FROM e JOIN n x ON x.id = e.target {base} JOIN o b ON b.owner = e.target JOIN o s ON s.owner = e.source AND s.k = b.k WHERE e.kind = '{kind}' AND b.member <> s.member UNION SELECT source, target FROM ({_want(rule)})")


@query("interface_impl", _members_sql("implements", "('method')", "", "interface-impl"))
def interface_impl(s, d):
    """Y9."""
    return synthesis.RULES["interface-impl"](graph(s, d))


@query("override_edges", _members_sql("extends", "('method', 'function')", "AND x.language = 'cpp'", "cpp-override"))
def override_edges(s, d):
    """Y10."""
    return synthesis.RULES["cpp-override"](graph(s, d))


@query("suffix_chain", sql("SELECT DISTINCT a.id AS source, b.id AS target FROM n a JOIN n b ON b.kind = 'file' AND (b.file_path = a.name OR ends_with(b.file_path, '/' || a.name)) WHERE a.kind = 'file' AND a.id <> b.id"))
def suffix_chain(s, d):
    """Y11's join over all files: paths that end with a given path, as an equi-join on the endings of each path."""
    n = model.nodes(s, d, "id", "kind", "name", "file_path").filter("kind = 'file'")
    ends = n.select(F.col("id").alias("target"), F.explode(synthesis.tails(F.col("file_path"))).alias("name"))
    return n.select(F.col("id").alias("source"), "name").join(ends, "name").filter("source <> target").select("source", "target").distinct()
