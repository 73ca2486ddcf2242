"""The SQL walk, the literal lexer and the gates on hand-written statements."""

import pytest

from arborweft.functions import lexing, sqltext

EDGES = {
    "WITH RECURSIVE a (x) AS (SELECT 1 UNION ALL SELECT x FROM a), b AS MATERIALIZED (SELECT * FROM a) SELECT * FROM b JOIN real r ON r.x = b.x": {("references", "real"), ("column", "real.x")},
    "WITH c AS (SELECT 1 FROM t) SELECT * FROM c; SELECT * FROM c": {("references", "t"), ("references", "c")},
    'SELECT * FROM "My Schema"."T x", [dbo].[Y z], `q`.`r`': {("references", "My Schema.T x"), ("references", "dbo.Y z"), ("references", "q.r")},
    "SELECT '-- FROM x', \"FROM\" FROM a -- FROM b\n/* FROM c */": {("references", "a")},
    "SELECT trim(BOTH ' ' FROM t.name) FROM t": {("references", "t"), ("column", "t.name")},
    "SELECT a.x FROM (SELECT y AS x FROM inner_t) a OUTER JOIN": {("references", "inner_t")},
    "INSERT INTO t SELECT 1 FROM s ON CONFLICT (id) DO UPDATE SET a = 1": {("writes", "t"), ("references", "s")},
    "SELECT * FROM t FOR UPDATE": {("references", "t")},
    "DELETE a FROM big a WHERE a.id = 1": {("writes", "big"), ("references", "big"), ("column", "big.id")},
    "DELETE FROM t OUTPUT deleted.id INTO trail WHERE id = 1": {("writes", "t"), ("writes", "trail")},
    "UPDATE t SET a = 1 OUTPUT inserted.a; INSERT INTO u VALUES (1)": {("writes", "t"), ("writes", "u")},
    "MERGE t USING s ON 1 = 1 WHEN MATCHED THEN DELETE": {("writes", "t")},
    "EXEC @rc = dbo.p; EXECUTE IMMEDIATE 'x'; CALL q()": {("calls", "dbo.p"), ("calls", "q")},
    "COPY INTO @~/mine FROM t; COPY INTO @%t FROM t": {("references", "t")},
    "SELECT * FROM TABLE(FLATTEN(INPUT => a.b)) f, LATERAL FLATTEN(bag)": {("references", "bag")},
    "GRANT EXECUTE ON f TO x; CREATE TABLE z (id INT) WITH (a = b)": set(),
    "SELECT * FROM #undeclared": set(),
    "": set(),
    "SELECT * FROM": set(),
    "CREATE VIEW": set(),
    "WITH x AS": set(),
}


@pytest.mark.parametrize("text", sorted(EDGES))
def test_edges(text):
    assert {(k, n) for _, k, n in sqltext.analyse(text).edges} == EDGES[text]


def test_owners_of_statements():
    text = "CREATE VIEW v AS SELECT 1 FROM a;\nSELECT 1 FROM loose;\nCREATE FUNCTION f() RETURNS int AS $$ BEGIN PERFORM g(1); RETURN (SELECT 1 FROM b); END; $$ LANGUAGE plpgsql;\nCREATE PROCEDURE p AS\nBEGIN\n IF 1 = 1 BEGIN SELECT CASE WHEN 1 = 1 THEN 1 END FROM c; END\n SELECT 1 FROM d;\nEND\nGO\nSELECT 1 FROM e"
    s = sqltext.analyse(text)
    assert {(o, n) for o, _, n in s.edges} == {("v", "a"), ("", "loose"), ("f", "b"), ("p", "c"), ("p", "d"), ("", "e")}
    assert [(k, n) for k, n, _ in s.objects] == [("view", "v"), ("function", "f"), ("procedure", "p")]


def test_temporary_names_belong_to_their_routine():
    s = sqltext.analyse("CREATE PROC a AS SELECT 1 AS x INTO #t; SELECT * FROM #t\nGO\nCREATE PROC b AS SELECT * FROM #t; CREATE TABLE ##g (i INT); INSERT INTO ##g SELECT 1\nGO\nCREATE PROC c AS SELECT * FROM ##g\nGO")
    assert {(o, n) for o, _, n in s.edges} == {("a", "a#t"), ("b", "##g"), ("c", "##g")}
    assert s.temps == [("a", "#t", "local"), ("b", "##g", "global")]


def test_columns_and_constraints():
    s = sqltext.analyse('CREATE TABLE t (id BIGINT PRIMARY KEY, "a b" NUMERIC(10, 2) DEFAULT (1), u INT REFERENCES x.y (id), UNIQUE (id, u), CONSTRAINT f FOREIGN KEY (u) REFERENCES z (id) ON DELETE CASCADE);\nALTER TABLE ONLY t ADD CONSTRAINT g FOREIGN KEY (id) REFERENCES w (id)')
    assert s.columns == [("t", "id", "BIGINT"), ("t", "a b", "NUMERIC(10,2)"), ("t", "u", "INT")]
    assert s.constraints == [("t", "primary key", "id", None), ("t", "foreign key", "u", "x.y"), ("t", "unique", "id,u", None), ("t", "foreign key", "u", "z"), ("t", "foreign key", "id", "w")]
    assert {n for _, k, n in s.edges if k == "references"} == {"x.y", "z", "w"}


def test_gates():
    yes = ["SELECT o.id FROM orders o WHERE o.total > 5", "UPDATE shipments SET state = ?", "\n CREATE TABLE IF NOT EXISTS ledger (id BIGINT)", "DELETE FROM sessions WHERE id = $1", "insert into t values (:id)", "MERGE INTO t USING s ON t.a = s.a"]
    no = ["Please select a colour from the menu", "UPDATE available: version 2, see notes", "hello world", "-- UPDATE t SET x = 1", "SELECT everything", "we CREATE TABLE things", "", "CREATE a plan"]
    assert [t for t in yes if not sqltext.is_statement(t)] == [] and [t for t in no if sqltext.is_statement(t)] == []
    assert sqltext.fragment_names("status = ? AND owner_id IN (1, 2)") == ["status", "owner_id"]
    assert sqltext.fragment_names("created_at DESC") == ["created_at"] and sqltext.fragment_names("hello world") == [] and sqltext.fragment_names("a = " + "x" * 200) == []


def test_templates():
    assert sqltext.template_refs("{{ ref('a', 'b') }} {{ ref(\"c\", version=3) }} {# {{ ref('no') }} #} {{ source('s','t') }} {{ var('x') }} {{ my_macro(1) }} {{ pkg.fn(1) }}") == [("ref", "b"), ("ref", "c_v3"), ("source", "s.t"), ("call", "my_macro")]
    assert [sqltext.template_role(p) for p in ("macros/a.sql", "x/macros_extra/a.sql", "tests/a.sql", "X\\Macros\\a.sql")] == ["macro", "model", "other", "macro"]


def test_literals():
    assert [t for _, t in lexing.literals("a = \"x\" # \"no\"\nb = '''y\nz''' + 'q\\'r'\n", "python")] == ["x", "y\nz", "q\\'r"]
    assert [t for _, t in lexing.literals("s := `a\\` + \"b\" // 'c'\n/* \"d\" */", "go")] == ["a\\", "b"]
    assert [t for _, t in lexing.literals('const r = /"/.test(a) ? "' + "w" * 5000 + "\" : 'k';", "javascript")] == ['/"/'[1:0] + "w" * 5000, "k"]
