"""Routes, import aliases, the incremental index, synthesis caps, intervals and scopes on hand fixtures."""

import random

from pyspark.sql import functions as F

from arborweft.functions import outline, routes
from arborweft.operators import imports, indexing, intervals, pages, resolve, synthesis
from arborweft.plans import resolution
from arborweft.plans import routes as route_plans
from tests.conftest import rows


def test_routes_of_every_framework():
    got = {(p, *r) for p, g, t in route_plans.TEXTS for r in routes.routes(t, g)}
    assert got == set(route_plans.WANT) and {f for _, f, *_ in got} == set(routes.RESOLVERS)
    for _, g, t in route_plans.TEXTS:
        for other in ("python", "go", "ruby"):
            if other != g:
                assert routes.routes("map.get('key')\n" + t[:0], other) == []


def test_path_aliases():
    text = '{ /* a */ "compilerOptions": { "paths": { "@a/*": ["x/*"], "b": [] , "c": ["d.ts",], }, "url": "http://x" } } // end'
    assert imports.path_aliases(text) == [("@a/", True, "x/*"), ("c", False, "d.ts")]
    assert imports.path_aliases("{") == imports.path_aliases("[]") == imports.path_aliases('{"compilerOptions": 3}') == []


def test_joined_paths(spark):
    df = spark.createDataFrame([("a/b", "../c"), ("a", "../../c"), ("", "./x//y"), ("a/b", "../.."), ("a", ".")], "f string, p string")
    assert [r[0] for r in df.select(imports.joined(F.col("f"), F.col("p"))).collect()] == ["a/c", "../c", "x/y", "", "a"]


def test_index_actions(spark):
    old = spark.createDataFrame([("same", "1"), ("new hash", "1"), ("gone", "1"), ("broken", "1"), (None, "1"), ("no hash", None)], "path string, h string")
    scan = spark.createDataFrame([("same", "1"), ("new hash", "2"), ("added", "3"), ("broken", None), (None, "9")], "path string, h string")
    assert dict(rows(indexing.actions(old, scan))) == {"same": "skip", "new hash": "index", "added": "index", "gone": "prune", "broken": "error", "no hash": "prune"}
    assert dict(rows(indexing.actions(old, scan, force=True)))["same"] == "index"
    assert dict(rows(indexing.actions(old, scan, subset=scan.filter("path = 'added'")))) == {"added": "index"}
    assert indexing.forced(None, "1") and indexing.forced("1", "2") and not indexing.forced("2", "2")


def test_store_keeps_ends_and_owners(spark):
    make = spark.createDataFrame
    nodes = make([("a", "f1"), ("b", "f2"), ("c", "f3")], "id string, file_path string")
    edges = make([(1, "a", "b"), (2, "b", "c"), (3, "c", "a")], "id long, source string, target string")
    refs = make([("r1", "a"), ("r2", "b")], "id string, from_node_id string")
    files = make([("f1",), ("f2",), ("f3",)], "path string")
    plan = make([("f1", "index"), ("f2", "prune"), ("f3", "skip")], "path string, action string")
    out = indexing.store(nodes, edges, refs, files, plan, make([("a2", "f1")], nodes.schema), make([(4, "a2", "c"), (5, "a2", "b"), (6, "a2", "c")], edges.schema), make([("r3", "a2"), ("r3", "a2"), ("r4", "a")], refs.schema), make([("f1",)], files.schema))
    assert rows(out["nodes"].select("id")) == [("a2",), ("c",)] and rows(out["edges"].select("id")) == [(4,), (6,)]
    assert rows(out["unresolved_refs"].select("id")) == [("r3",)] and rows(out["files"]) == [("f1",), ("f3",)]


def test_swap_keeps_the_old_table_when_the_new_one_fails(spark, tmp_path):
    at = f"{tmp_path}/t"
    indexing.swap(spark.range(5), at)
    bad = spark.range(5).select(F.when(F.col("id") > 2, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("id"))
    try:
        indexing.swap(bad, at)
        raise AssertionError("the failure was lost")
    except Exception as e:  # noqa: BLE001
        assert "no" in str(e)
    assert spark.read.parquet(at).count() == 5
    indexing.swap(spark.read.parquet(at).filter("id < 2"), at)
    assert spark.read.parquet(at).count() == 2 and indexing.compact(spark, at) == 1
    indexing.clear(spark, at)
    assert spark.read.parquet(at).count() == 0 and spark.read.parquet(at).columns == ["id"]


def test_event_cap_counts_new_targets_of_a_dispatcher(spark):
    n = spark.createDataFrame([], "id string, kind string, name string, qualified_name string, file_path string, language string")
    e = spark.createDataFrame([], "id long, source string, target string, kind string, provenance string, metadata string")
    ref = lambda f, callee: (f, callee, "calls", callee, ["x"], "p", "javascript")
    r = spark.createDataFrame([ref("t0", "b.emit"), ref("z", "b.emit"), *[ref(f"t{i}", "b.on") for i in range(9)]], "from_node_id string, reference_name string, reference_kind string, callee_expr string, arguments array<string>, file_path string, language string")
    got = rows(synthesis.event_emitter(synthesis.Graph(n, e, r)))
    assert got == [("t0", f"t{i}") for i in range(1, 7)] + [("z", f"t{i}") for i in range(6)]


def test_rules_can_be_added(spark):
    g = synthesis.Graph(*(spark.createDataFrame([], s) for s in ("id string, kind string, name string, qualified_name string, file_path string, language string", "id long, source string, target string, kind string, provenance string, metadata string", "from_node_id string, reference_name string, reference_kind string, callee_expr string, arguments array<string>, file_path string, language string")))
    mine = {"first": lambda g: spark.createDataFrame([("a", "b")], "source string, target string"), "second": lambda g: spark.createDataFrame([("a", "b"), ("c", "d")], "source string, target string")}
    assert rows(synthesis.compose(g, mine)) == [("a", "b", "first"), ("c", "d", "second")]


def test_narrowest_interval_against_brute_force(spark):
    r = random.Random(8)
    nodes = [(f"n{i:03d}", r.choice("fg"), a := r.randrange(1, 900), a + r.choice([0, 3, 40, 500, -2])) for i in range(120)]
    items = [(i, r.choice("fgh"), r.randrange(1, 1500)) for i in range(200)]
    got = {x["k"]: x["owner"] for x in intervals.narrowest(spark.createDataFrame(items, "k long, file_path string, line int"), spark.createDataFrame(nodes, "id string, file_path string, start_line int, end_line int"), "k").collect()}
    for k, f, line in items:
        fit = [(b - a, n) for n, g, a, b in nodes if g == f and a <= line <= b]
        assert got[k] == (min(fit)[1] if fit else f"file:{f}")


def test_scope():
    m = {"a": "/r/a", "ab": "/r/a/b", "c": "/r/c"}
    assert pages.scope("/r/a/b/x", m, "/r") == ("member", "ab") and pages.scope("/r/ab", m, "/r") == ("realm", None) and pages.scope("/x", m, "/r") == ("repo", None) and pages.scope("/r", m, None) == ("repo", None)


def test_fixed_references_find_what_a_reader_expects(spark):
    n = spark.createDataFrame([x for x in resolution.FIX_NODES], "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, is_exported boolean")
    r = spark.createDataFrame([x for x in resolution.FIX_REFS], "id string, from_node_id string, reference_name string, reference_kind string, line int, file_path string, language string, callee_expr string")
    got = {x["ref_id"]: (x["strategy"], x["node_id"], x["edge_kind"]) for x in resolve.cascade(r, n).collect()}
    assert got == {
        "ref:zq01": (resolve.FQN, "class:zq1", "references"), "ref:zq02": (resolve.METHOD, "method:zq2", "calls"), "ref:zq03": (resolve.SQL_TAIL, "column:zq1", "references"), "ref:zq04": (resolve.QUALIFIED, "function:zq1", "calls"), "ref:zq05": (resolve.QUALIFIED_TAIL, "function:zq1", "calls"),
        "ref:zq06": (resolve.PATH, "file:zq/lib/tool.go", "references"), "ref:zq07": (resolve.EXACT, "interface:zq1", "implements"), "ref:zq08": (resolve.EXACT, "class:zq1", "instantiates"), "ref:zq09": (resolve.FUZZY, "function:zq1", "calls"),
    }


def test_outlines():
    go = 'package a\n\ntype T struct {\n\tx int // }\n}\n\nfunc (t *T) Add(a int) (interface{}, error) {\n\treturn "}", nil\n}\n\nfunc Bare() map[string]struct{} {\n}\n'
    assert outline.outline(go, "go") == [("struct", "T", 3, 5, None), ("method", "T::Add", 7, 9, "T"), ("function", "Bare", 11, 12, None)]
    java = "class A<T> extends B {\n  interface I { void f(); }\n  @X public int g(int a) throws E {\n    if (a) { new C(1); }\n    return h(1);\n  }\n}\n"
    assert outline.outline(java, "java") == [("class", "A", 1, 7, None), ("interface", "A::I", 2, 2, "A"), ("method", "A::g", 3, 6, "A")]
    ts = "export class A {\n  private async run(a: number): Promise<{x: 1}> {\n    return go(a);\n  }\n  b(): any {\n  }\n}\nfunction f(): any {\n}\nconst k = async (x: string): Promise<void> => {\n};\nnamespace N { export function z() {} }\n"
    assert outline.outline(ts, "typescript") == [("class", "A", 1, 7, None), ("method", "A::run", 2, 4, "A"), ("method", "A::b", 5, 6, "A"), ("function", "f", 8, 9, None), ("function", "k", 10, 11, None), ("namespace", "N", 12, 12, None), ("method", "N::z", 12, 12, "N")]
    assert outline.outline("func (", "go") == outline.outline("", "go") == outline.outline("x", "sql") == []


def test_outlines_agree_with_the_nodes_table(spark, data):
    """Functions and methods of the latest nodes whose file has a text: nearly all are found at their line with their name."""
    from arborweft.plans import extract

    got = {(r["path"], r["start_line"], r["qualified_name"].split("::")[-1]) for r in extract.symbols(spark, data).collect()}
    n = spark.read.parquet(f"{data}/nodes.parquet").filter("kind in ('function', 'method') and language in ('go', 'java', 'javascript', 'typescript', 'python')").select("file_path", "start_line", "name").distinct()
    texts = {r[0] for r in spark.read.parquet(f"{data}/source_texts.parquet").filter("content is not null").select("path").collect()}
    want = {tuple(r) for r in n.collect() if r[0] in texts}
    assert len(want) > 50 and len(want - got) <= 0.02 * len(want)
