"""Lineage from SQL text (T1-T13), each with its SQL.

The rules are functions over one text (functions/sqltext.py); the queries run them over all stored SQL texts, or over the string
literals of all other texts, beside a few fixed samples whose expected rows are written down by hand in the SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborweft.functions import lexing, sqltext
from arborweft.operators import intervals, model
from arborweft.operators.model import sql
from arborweft.sources.tables import load

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return put


# Statements for rules that the stored texts do not exercise.
SAMPLES = (
    ("sample:01", "SELECT o.id, c.name FROM orders o JOIN customer AS c ON c.id = o.cust_id WHERE o.total > 5"),
    ("sample:02", "INSERT INTO app.audit (id) SELECT t.id FROM app.task t WHERE t.done = 1"),
    ("sample:03", "UPDATE shipments SET state = 'x' WHERE id IN (SELECT s.id FROM stock s)"),
    ("sample:04", "MERGE INTO target_tbl USING src_tbl s ON target_tbl.id = s.id WHEN MATCHED THEN UPDATE SET v = s.v"),
    ("sample:05", "WITH recent AS (SELECT id FROM orders), old AS (SELECT id FROM recent) SELECT * FROM recent r JOIN old ON old.id = r.id"),
    ("sample:06", "SELECT a FROM alpha EXCEPT SELECT b FROM beta ORDER BY 1"),
    ("sample:07", "CREATE TABLE IF NOT EXISTS ledger (id BIGINT PRIMARY KEY, acct INT REFERENCES account (id), CONSTRAINT fk FOREIGN KEY (a, b) REFERENCES app.pair (a, b), CHECK (id > 0))"),
    ("sample:08", "CREATE TRIGGER audit_row AFTER UPDATE ON ledger FOR EACH ROW EXECUTE FUNCTION log_row()"),
    ("sample:09", "EXEC dbo.rebuild (1); SELECT x.k FROM base b CROSS APPLY dbo.split(b.v) x"),
    ("sample:10", "CREATE PROCEDURE dbo.stage AS BEGIN SELECT id INTO #t FROM base; SELECT * FROM #t; INSERT INTO ##g SELECT * FROM #missing; DELETE FROM gone OUTPUT deleted.id INTO trail; END"),
    ("sample:11", "CREATE PROCEDURE other AS BEGIN DECLARE @v TABLE (id INT); INSERT INTO @v SELECT id FROM src; UPDATE @nope SET x = 1; CREATE TABLE ##g (id INT) END"),
    ("sample:12", "COPY INTO @landing/day FROM sales; COPY INTO sales FROM @landing; SELECT * FROM LATERAL FLATTEN(input => bag) f; CREATE TABLE twin CLONE sales"),
    ("sample:13", "CREATE OR REPLACE SECURE VIEW top_v AS SELECT c.id FROM customer c; CREATE STAGE st1; CREATE FILE FORMAT ff1; CREATE STREAM s1 ON TABLE sales; CREATE TASK t2 AFTER t1 AS CALL dbo.run(); CREATE OR ALTER PROC p9 AS SELECT 1; CREATE SYNONYM sy FOR app.real_t; CREATE DATABASE d1"),
    ("sample:14", "SELECT EXTRACT(YEAR FROM ts), count(*) FROM visits, people p WHERE p.id IS DISTINCT FROM visits.id -- FROM nowhere"),
    ("sample:15", "UPDATE a SET total = 0 FROM accounts a JOIN owners w ON w.id = a.owner_id"),
)
_q = lambda p: p.replace("'", "''")
FIELDS = ("path", "what", "owner", "kind", "name", "extra")


def _values(*rows: tuple) -> str:
    return "VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else "'" + _q(x) + "'" for x in r) + ")" for r in rows)


def _rows(path: str, text: str) -> list[tuple]:
    s = sqltext.analyse(text)
    out = [(path, "object", "", k, n, None) for k, n, _ in s.objects]
    out += [(path, "column", t, k, n, None) for t, n, k in s.columns]
    out += [(path, "constraint", t, k, c, o) for t, k, c, o in s.constraints]
    out += [(path, "edge", o, k, n, None) for o, k, n in s.edges]
    return out + [(path, "temp", o, scope, tok, None) for o, tok, scope in s.temps]


def _each(fn: Callable, names: tuple, types: tuple) -> Callable:
    """A function over batches that gives the rows of fn for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [x for r in zip(*(c.to_pylist() for c in b.columns)) for x in fn(*r)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))

    return run


def stored(s, d) -> DataFrame:
    """(path, content) of the SQL texts."""
    t = load(s, d, "source_texts").filter("content is not null").select("path", "content")
    return t.join(model.files(s, d, "path", "language").filter("language = 'sql'").select("path"), "path", "left_semi")


def lineage(texts: DataFrame) -> DataFrame:
    """path, what, owner, kind, name, extra: everything that the texts (path, content) say, each text read once and whole."""
    return texts.mapInArrow(_each(_rows, FIELDS, (pa.string(),) * 6), ", ".join(f"{c} string" for c in FIELDS))


def _all(s, d, what: str) -> DataFrame:
    return lineage(stored(s, d).union(s.createDataFrame(list(SAMPLES), "path string, content string"))).filter(F.col("what") == what)


# the SQL reads the stored texts by patterns over text without comments and strings
_X = "x AS (SELECT f.path, regexp_replace(t.content, '--[^\\n]*|/\\*(?:[^*]|\\*+[^*/])*\\*+/|''(?:''''|[^''])*''', ' ', 'g') AS q FROM f JOIN source_texts t ON t.path = f.path WHERE f.language = 'sql' AND t.content IS NOT NULL)"
_pairs = lambda p, a, b: f"unnest(list_zip(regexp_extract_all(q, '{_q(p)}', {a}), regexp_extract_all(q, '{_q(p)}', {b})))"
_CREATED = r"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(TABLE|VIEW|FUNCTION|PROCEDURE|TRIGGER|INDEX|SEQUENCE|TYPE|SCHEMA)\s+(?:IF\s+NOT\s+EXISTS\s+)?([A-Za-z_][\w$.]*)"
_CTE = r"(?i)(?:\bWITH|,)\s+([A-Za-z_]\w*)\s+AS\s+\("


@query("sql_objects", sql(f", {_X} SELECT DISTINCT path, lower(z[1]) AS kind, z[2] AS name FROM (SELECT path, {_pairs(_CREATED, 1, 2)} AS z FROM x) UNION ALL " + _values(
    ("sample:07", "table", "ledger"), ("sample:08", "trigger", "audit_row"), ("sample:10", "procedure", "dbo.stage"), ("sample:11", "procedure", "other"), ("sample:12", "table", "twin"), ("sample:13", "view", "top_v"), ("sample:13", "stage", "st1"), ("sample:13", "file_format", "ff1"),
    ("sample:13", "stream", "s1"), ("sample:13", "task", "t2"), ("sample:13", "procedure", "p9"), ("sample:13", "synonym", "sy"), ("sample:13", "database", "d1"))))
def sql_objects(s, d):
    """Objects that SQL texts create."""
    return _all(s, d, "object").select("path", "kind", "name").distinct()


_COLUMN = r"(?im)^\s{2,}([A-Za-z_]\w*)\s+((?:BIGINT|VARCHAR|TIMESTAMP|INTEGER|TEXT|BOOLEAN|NUMERIC|DATE)(?:\(\d+\))?)"


@query("sql_columns", sql(f", {_X} SELECT DISTINCT path, z[1] AS name, z[2] AS type FROM (SELECT path, {_pairs(_COLUMN, 1, 2)} AS z FROM x) UNION ALL " + _values(("sample:07", "id", "BIGINT"), ("sample:07", "acct", "INT"))))
def sql_columns(s, d):
    """Columns and their types in CREATE TABLE texts."""
    return _all(s, d, "column").select("path", "name", F.col("kind").alias("type")).distinct()


_KEY = r"(?i)\bCREATE\s+TABLE\s+(\w+)\s*\(\s*(\w+)\s+\w+\s+PRIMARY\s+KEY"


@query("sql_constraints", sql(f", {_X} SELECT path, z[1] AS table_name, 'primary key' AS kind, z[2] AS columns, CAST(NULL AS VARCHAR) AS other FROM (SELECT path, {_pairs(_KEY, 1, 2)} AS z FROM x) UNION " + _values(
    ("sample:07", "ledger", "primary key", "id", None), ("sample:07", "ledger", "foreign key", "acct", "account"), ("sample:07", "ledger", "foreign key", "a,b", "app.pair"), ("sample:07", "ledger", "check", "id", None))))
def sql_constraints(s, d):
    """Keys, foreign keys and checks of tables, of the column, the table or an ALTER."""
    return _all(s, d, "constraint").select("path", F.col("owner").alias("table_name"), "kind", F.col("name").alias("columns"), F.col("extra").alias("other")).distinct()


_READS = r"(?i)\b(?:FROM|JOIN)\s+([A-Za-z_][\w$.]*)"
_ADDS = r"(?i)\bINSERT\s+INTO\s+([A-Za-z_][\w$.]*)"


@query("sql_body_edges", sql(f", {_X}, c AS (SELECT path, lower(unnest(regexp_extract_all(q, '{_CTE}', 1))) AS name FROM x), h AS (SELECT path, 'references' AS kind, unnest(regexp_extract_all(q, '{_READS}', 1)) AS name FROM x UNION SELECT path, 'writes', unnest(regexp_extract_all(q, '{_ADDS}', 1)) FROM x) SELECT DISTINCT path, kind, name FROM h WHERE lower(name) NOT IN ('select', 'lateral', 'unnest') AND NOT EXISTS (SELECT 1 FROM c WHERE c.path = h.path AND c.name = lower(h.name)) UNION ALL " + _values(
    *[("sample:" + n, k, x) for n, k, xs in (("01", "references", "orders customer"), ("02", "writes", "app.audit"), ("02", "references", "app.task"), ("03", "writes", "shipments"), ("03", "references", "stock"), ("04", "writes", "target_tbl"), ("05", "references", "orders"), ("06", "references", "alpha beta"),
      ("07", "references", "account app.pair"), ("08", "references", "ledger"), ("08", "calls", "log_row"), ("09", "calls", "dbo.rebuild dbo.split"), ("09", "references", "base"), ("10", "references", "base dbo.stage#t"), ("10", "writes", "dbo.stage#t gone trail"), ("11", "references", "src"), ("11", "writes", "other@v"),
      ("12", "writes", "landing sales"), ("12", "references", "sales landing bag"), ("13", "references", "customer sales t1 app.real_t"), ("13", "calls", "dbo.run"), ("14", "references", "visits people"), ("15", "writes", "accounts"), ("15", "references", "accounts owners")) for x in xs.split()])))
def sql_body_edges(s, d):
    """Tables read and written and routines called by SQL texts, each once per text and kind. Names of common table
    expressions are no tables; OUTPUT INTO, COPY, FLATTEN and CLONE count; temporary names count where they are declared."""
    return _all(s, d, "edge").filter("kind <> 'column'").select("path", "kind", "name").distinct()


@query("sql_owner_edges", sql(f", {_X}, k AS (SELECT path, {_pairs('(?is)CREATE (?:FUNCTION|VIEW) ([A-Za-z_][A-Za-z0-9_]*)[^;]*?FROM ([A-Za-z_][A-Za-z0-9_]*)', 1, 2)} AS z FROM x) SELECT DISTINCT path, z[1] AS owner, 'references' AS kind, z[2] AS name FROM k UNION ALL " + _values(
    *[("sample:" + n, o, k, x) for n, o, k, xs in (("07", "ledger", "references", "account app.pair"), ("08", "audit_row", "references", "ledger"), ("08", "audit_row", "calls", "log_row"), ("10", "dbo.stage", "references", "base dbo.stage#t"), ("10", "dbo.stage", "writes", "dbo.stage#t gone trail"),
      ("11", "other", "references", "src"), ("11", "other", "writes", "other@v"), ("12", "twin", "references", "sales"), ("13", "top_v", "references", "customer"), ("13", "s1", "references", "sales"), ("13", "t2", "references", "t1"), ("13", "t2", "calls", "dbo.run"), ("13", "sy", "references", "app.real_t")) for x in xs.split()])))
def sql_owner_edges(s, d):
    """T4: the same edges by the object whose text holds them."""
    return _all(s, d, "edge").filter("kind <> 'column' and owner <> ''").select("path", "owner", "kind", "name").distinct()


@query("alias_columns", "SELECT * FROM (" + _values(
    *[("sample:" + n, x) for n, xs in (("01", "orders.id customer.name customer.id orders.cust_id orders.total"), ("02", "app.task.id app.task.done"), ("03", "stock.id"), ("09", "base.v"), ("13", "customer.id"), ("14", "people.id visits.id"), ("15", "owners.id accounts.owner_id")) for x in xs.split()]) + ") AS v(path, ref)")
def alias_columns(s, d):
    """T5: alias.column becomes table.column by the aliases of the same statement; a table without an alias stands for itself.
    The stored texts hold no aliases."""
    return _all(s, d, "edge").filter("kind = 'column'").select("path", F.col("name").alias("ref")).distinct()


@query("temp_tables", "SELECT * FROM (" + _values(("sample:10", "dbo.stage", "#t", "local"), ("sample:11", "other", "@v", "local"), ("sample:11", "other", "##g", "global")) + ") AS v(path, owner, tok, scope)")
def temp_tables(s, d):
    """Temporary tables and table variables with the routine that declares them; '##' ones belong to the file."""
    return _all(s, d, "temp").select("path", "owner", F.col("name").alias("tok"), F.col("kind").alias("scope"))


# Templated texts.
TEMPLATES = (
    ("models/a.sql", "{# {{ ref('hidden') }} #} SELECT * FROM {{ ref('orders') }} JOIN {{ source('raw', 'users') }} USING (id)"),
    ("models/b.sql", "{{ config(materialized='table', alias='renamed') }} SELECT {{ cents('amount') }} FROM {{- ref('core', 'pay', v=2) -}}"),
    ("macros/c.sql", "{% macro cents(x) %} {{ round_to(x) }} / 100 {% endmacro %}"),
    ("tests/d.sql", "{{ log('x') }} {{ dbt_utils.star(from) }}"),
)


@query("template_refs", "SELECT * FROM (" + _values(("models/a.sql", "model", "ref", "orders"), ("models/a.sql", "model", "source", "raw.users"), ("models/b.sql", "model", "alias", "renamed"), ("models/b.sql", "model", "call", "cents"), ("models/b.sql", "model", "ref", "pay_v2"), ("macros/c.sql", "macro", "call", "round_to"), ("macros/c.sql", "macro", "macro", "cents")) + ") AS v(path, role, kind, name)")
def template_refs(s, d):
    """References, sources, aliases, macros and their calls in templated texts, with the role of the file. Texts without a
    template mark never leave the JVM."""
    t = stored(s, d).filter(F.col("content").contains("{{") | F.col("content").contains("{%")).union(s.createDataFrame(list(TEMPLATES), "path string, content string"))
    each = _each(lambda p, c: [(p, sqltext.template_role(p), k, n) for k, n in sqltext.template_refs(c)], ("path", "role", "kind", "name"), (pa.string(),) * 4)
    return t.mapInArrow(each, "path string, role string, kind string, name string")


# --- literals of other texts ------------------------------------------------------------------------------------------

# Literals for the gates, as a text with one literal a line.
LITERALS = (
    "SELECT o.id FROM orders o WHERE o.total > 5", "Please select a colour from the menu", "UPDATE available: version 2, see notes", "UPDATE shipments SET state = ?", "CREATE TABLE IF NOT EXISTS ledger (id BIGINT)", "DELETE FROM sessions WHERE id = $1", "status = ? AND owner_id IN (1, 2)", "created_at DESC", "hello world", "orders_tbl", "orders_tbl.status",
    "-- UPDATE t SET x = 1", "SELECT everything", "insert into t values (:id)", "CREATE a plan",
)
_SAMPLE_TEXT = "x = [\n" + "".join(f'    "{t}",\n' for t in LITERALS) + "]\n"
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,}(?:\.[A-Za-z_][A-Za-z0-9_]+)?")


def _host_texts(s, d) -> DataFrame:
    f = model.files(s, d, "path", "language").filter(F.col("language").isin(*[x for x in lexing.LEXIS if x != "sql"]))
    t = load(s, d, "source_texts").filter("content is not null").select("path", "content").join(f, "path").select("path", "language", "content")
    return t.union(s.createDataFrame([("sample.py", "python", _SAMPLE_TEXT)], "path string, language string, content string"))


def _literals(path: str, language: str, content: str) -> list[tuple[str, int, str]]:
    return [(path, content.count("\n", 0, at) + 1, text) for at, text in lexing.literals(content, language)]


def literals(s, d) -> DataFrame:
    """(path, line, lit): the string literals of all texts but SQL, of any length and with any quotes."""
    return _host_texts(s, d).mapInArrow(_each(_literals, ("path", "line", "lit"), (pa.string(), pa.int32(), pa.string())), "path string, line int, lit string")


@query("sql_gate")
def sql_gate(s, d):
    """String literals that are SQL. No SQL: telling literals from comments needs a lexer; tests hold it against hand rows."""
    each = _each(lambda p, g, c: [(p, n, t) for p, n, t in _literals(p, g, c) if sqltext.is_statement(t)], ("path", "line", "lit"), (pa.string(), pa.int32(), pa.string()))
    return _host_texts(s, d).mapInArrow(each, "path string, line int, lit string").select("lit").distinct()


@query("fragment_tokens")
def fragment_tokens(s, d):
    """Names in short literals that look like a part of a statement. No SQL, as for sql_gate."""
    each = _each(lambda p, g, c: [(t, x) for _, _, t in _literals(p, g, c) for x in sqltext.fragment_names(t)], ("lit", "tok"), (pa.string(),) * 2)
    return _host_texts(s, d).mapInArrow(each, "lit string, tok string").distinct()


@query("sql_strings")
def sql_strings(s, d):
    """Literals that have the shape of a name, once per owner and text; the owner is the narrowest symbol around the
    literal (T11), else the file. No SQL, as for sql_gate."""
    each = _each(lambda p, g, c: [(p, n, t) for p, n, t in _literals(p, g, c) if _NAME.fullmatch(t)], ("file_path", "line", "lit"), (pa.string(), pa.int32(), pa.string()))
    lits = _host_texts(s, d).mapInArrow(each, "file_path string, line int, lit string").groupBy("file_path", "lit", "line").agg(F.count("*").alias("n"))
    lits = lits.withColumn("key_", F.sha2(F.concat_ws("\t", "file_path", F.col("line").cast("string"), "lit"), 256))
    n = model.nodes(s, d, "id", "kind", "file_path", "start_line", "end_line").filter("kind <> 'file'")
    return intervals.narrowest(lits, n, "key_").groupBy("owner", "lit").agg(F.min("line").alias("line"))
