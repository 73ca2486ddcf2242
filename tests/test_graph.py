"""Traversal, search, resolution and the bus on hand-made fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from arborweft.functions.text import glob_regex, osa
from arborweft.operators import resolve, search, traverse
from arborweft.plans import links
from arborweft.sources.tables import load
from arborweft.streaming import bus, rooms
from tests.conftest import rows


@pytest.fixture(scope="module")
def diamond(spark):
    """a -> b, a -> c, b -> d (twice), c -> d, d -> a; m holds a and b."""
    e = [(1, "a", "b", "calls"), (2, "a", "c", "calls"), (3, "b", "d", "calls"), (4, "b", "d", "calls"), (5, "c", "d", "references"), (6, "d", "a", "calls"), (7, "m", "a", "contains"), (8, "m", "b", "contains"), (9, None, "a", "calls")]
    return spark.createDataFrame(e, "id long, source string, target string, kind string")


def seed(spark, *ids):
    return spark.createDataFrame([(i, i) for i in ids], "origin string, id string")


def test_walk_keeps_edges_into_new_nodes_only(spark, diamond):
    nodes, edges = traverse.bfs(diamond, seed(spark, "a"), 0, kinds=traverse.CALL_KINDS)
    assert rows(nodes.select("id", "depth")) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert [r[0] for r in rows(edges.select("edge_id"))] == [1, 2, 3, 4, 5]


def test_impact_keeps_edges_back_to_visited_nodes(spark, diamond):
    n = spark.createDataFrame([("m", "module"), ("a", "function"), ("b", "function")], "id string, kind string")
    nodes, edges = traverse.impact(n, diamond, seed(spark, "m"), 3)
    assert rows(nodes.select("id", "depth")) == [("a", 0), ("b", 0), ("c", 2), ("d", 1)]
    assert {r[0] for r in rows(edges.select("edge_id"))} == {1, 2, 3, 4, 5, 6}


def test_origins_walk_on_their_own(spark, diamond):
    nodes, _ = traverse.bfs(diamond, seed(spark, "b", "c"), 1, kinds=("calls", "references"))
    assert rows(nodes.select("origin", "id", "depth")) == [("b", "b", 0), ("b", "d", 1), ("c", "c", 0), ("c", "d", 1)]


def test_shortest_path(spark, diamond):
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    assert rows(traverse.shortest_path(diamond, one("a"), one("d"))) == [(0, "a"), (1, "b"), (2, "d")]
    assert rows(traverse.shortest_path(diamond, one("a"), one("a"))) == [(0, "a")]
    assert rows(traverse.shortest_path(diamond, one("a"), one("m"))) == []


def test_long_path_has_no_bound(spark):
    e = spark.range(66).select(F.col("id"), F.format_string("n%03d", F.col("id")).alias("source"), F.format_string("n%03d", F.col("id") + 1).alias("target"), F.lit("calls").alias("kind"))
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    got = rows(traverse.shortest_path(e, one("n000"), one("n066")))
    assert sorted(got) == [(i, f"n{i:03d}") for i in range(67)]


def test_a_level_shuffles_hits_not_edges(spark, data, tmp_path):
    """A small frontier is broadcast: below the join the edges are a scan with its filters, without an exchange."""
    e = traverse.pruned(load(spark, data, "edges"), traverse.CALL_KINDS)
    seed(spark, "function:x").write.parquet(str(tmp_path / "front"))
    step = traverse.hits(e, spark.read.parquet(str(tmp_path / "front")), "target", "source", None)
    plan = step._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    tree = plan.split("\n\n")[0].split("\n")
    scan = next(i for i, x in enumerate(tree) if "Scan parquet" in x)
    join = next(i for i, x in enumerate(tree) if "BroadcastHashJoin" in x)
    assert not [x for x in tree[join:scan] if "Exchange" in x and "BroadcastExchange" not in x], plan
    assert "IsNotNull(target)" in plan and "PushedFilters" in plan


def test_repeated_edge_rows_count_once(spark, diamond):
    twice = diamond.union(diamond)
    for walk in (lambda e: traverse.bfs(e, seed(spark, "a"), 3, keep_all=True), lambda e: traverse.bfs(e, seed(spark, "d"), 0, incoming=True)):
        a, b = walk(diamond), walk(twice)
        assert rows(a[0]) == rows(b[0]) and rows(a[1]) == rows(b[1])


def test_osa_against_plain_recursion():
    def plain(a, b):
        if not a or not b:
            return len(a) + len(b)
        best = min(plain(a[1:], b) + 1, plain(a, b[1:]) + 1, plain(a[1:], b[1:]) + (a[0] != b[0]))
        if len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0]:
            best = min(best, plain(a[2:], b[2:]) + 1)
        return best

    r = random.Random(2)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(6))) for _ in "xy")
        d = plain(a, b)
        assert osa(a.encode(), b.encode(), 2) == (d if d <= 2 else -1)
    assert osa(b"ca", b"abc", 3) == 3 and osa(b"abcd", b"acbd", 1) == 1


def test_search_tiers(spark):
    n = spark.createDataFrame(
        [("1", "function", "parseQuery", "q::parseQuery", "src/q.go", "go", "", "Parses a query.", True), ("2", "class", "Parser", "Parser", "src/p.go", "go", "", None, False), ("3", "function", "handle", "x::parsing", "a/b/c_test.go", "go", None, None, False)],
        "id string, kind string, name string, qualified_name string, file_path string, language string, signature string, docstring string, is_exported boolean",
    )
    first = lambda q: [(r["id"], r["tier"]) for r in search.search(n, q).collect()]
    assert first("parse")[0] == ("1", "fts") and {t for _, t in first("parse")} == {"fts"}
    assert first("arse")[0][1] == "like" and first("prasequery") == [("1", "fuzzy")]
    assert first("kind:class lang:go") == [("2", "filter")] and first("") == [] and first("kind:nothing") == []
    assert search.Query.parse("KIND:class kind:function foo path:a/b").kind == "function"


def test_fuzzy_join_finds_what_brute_force_finds(spark):
    r = random.Random(4)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(120)})
    a, b = words[::2], words[1::2]
    got = rows(resolve.similar_names(spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string")))

    def lev(x, y):
        prev = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row = [i]
            for j, e in enumerate(y, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (c != e)))
            prev = row
        return prev[-1]

    assert got == sorted((x, y, lev(x, y)) for x in a for y in b if 0 < lev(x, y) <= (1 if len(x) <= 4 else 2))


def test_package_names(spark):
    t = spark.createDataFrame([("@s/p/deep.js",), ("@s/p",), ("lodash/fp",), ("node:fs",), ("https://x/y",), ("left-pad?x",)], "s string")
    assert [r[0] for r in t.select(resolve.npm_package(F.col("s"))).collect()] == ["@s/p", "@s/p", "lodash", "node:fs", "", "left-pad"]


def test_reexports_stop_at_loops(spark):
    e = spark.createDataFrame([(1, "a", "b", "exports"), (2, "b", "c", "exports"), (3, "a", "z", "exports"), (4, "c", "a", "exports"), (5, "q", "q", "exports")], "id long, source string, target string, kind string")
    assert rows(resolve.reexports(e, spark.createDataFrame([("a",), ("q",), ("n",)], "id string"))) == [("a", "c", 2), ("n", "n", 0), ("q", "q", 0)]


def test_markdown_links():
    page = "see [a](x.md) and ![i](i.png) [[Page|alias]]\n```\n[no](no.md)\n```\n`[no](no.md)` [b](../y.md \"t\") [[Two]]\nopen ` [no](n.md)\n~~~\n[[no]]"
    assert links.markdown_links(page) == [(1, "markdown", "x.md"), (1, "wiki", "Page"), (5, "markdown", "../y.md"), (5, "wiki", "Two")]


def test_glob():
    import re

    assert re.match(glob_regex("*_test.go"), "a_test.go") and not re.match(glob_regex("*.go"), "d/a.go") and not re.match(glob_regex("a.go"), "abgo")


def test_diversity_caps_are_greedy(spark):
    import pyarrow as pa

    from arborweft.plans.search import _capped

    r = random.Random(3)
    data = sorted((r.randrange(3), f"i{i:03d}", r.choice("fgh"), f"p{r.randrange(6)}") for i in range(200))
    b = pa.RecordBatch.from_pydict({"id": [x[1] for x in data], "label": [x[0] for x in data], "kind": [x[2] for x in data], "file_path": [x[3] for x in data]})
    got = [i for out in _capped(5, 8)([b.slice(0, 70), b.slice(70)]) for i in out.column(0).to_pylist()]
    want, files, kinds = [], {}, {}
    for label, i, k, p in data:
        if label == 0 or (files.get(p, 0) < 5 and kinds.get(k, 0) < 8):
            want.append(i)
            files[p] = files.get(p, 0) + 1
            kinds[k] = kinds.get(k, 0) + 1
    assert got == want


def test_stream_equals_batch(spark, data, tmp_path):
    env = bus.envelopes(load(spark, data, "events"))
    bus.write_log(env, f"{tmp_path}/log")
    bus.write_log(env, f"{tmp_path}/log")  # sent again: ids repeat
    s = bus.stream(spark, f"{tmp_path}/log")
    got = bus.run(bus.stream_unique(s).select("id", "room", "sender", "ts"), f"{tmp_path}/c1", "append")
    assert rows(got) == rows(env.select("id", "room", "sender", "ts"))
    tail = bus.run(bus.stream_tail(s, "8").select("id"), f"{tmp_path}/c2", "append")
    assert tail.distinct().count() == env.filter("size(recipients) > 0 and sender = '8'").count()


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """The log grows between two runs on one folder; running totals and the filter on repeats carry over."""
    env = [(i, f"r{i % 3}", f"s{i % 5}", 100 + i, "t", None, ["a"]) for i in range(60)]
    put = lambda part: bus.write_log(spark.createDataFrame(part, bus.ENVELOPE), f"{tmp_path}/log")
    put(env[:30])
    total = lambda: bus.run(bus.stream_rooms(bus.stream(spark, f"{tmp_path}/log")), f"{tmp_path}/total", "complete")
    once = lambda: bus.run(bus.stream_unique(bus.stream(spark, f"{tmp_path}/log")).select("id"), f"{tmp_path}/once", "append")
    assert rows(total()) == [("r0", 10, 127), ("r1", 10, 128), ("r2", 10, 129)] and once().count() == 30
    put(env[20:])  # ten of them are sent again
    assert rows(total()) == [("r0", 23, 157), ("r1", 23, 158), ("r2", 24, 159)]
    assert sorted(r[0] for r in once().collect()) == list(range(60))


OPS = [
    (1, "r", 1, "join", "s1", "ann", "agent"), (2, "r", 2, "join", "s2", "ann", "agent"), (3, "r", 3, "join", "s3", "ann", "agent"), (4, "r", 4, "join", "s4", "system", "agent"), (5, "r", 5, "join", "s5", "bob", "robot"), (6, "r", 6, "join", "s1", "eve", "agent"), (7, "r", 7, "join", "s6", "hal", "human"),
    (8, "r", 8, "send", "s1", None, None), (9, "r", 9, "send", "s9", None, None), (10, "r", 10, "halt", None, None, None), (11, "r", 11, "send", "s1", None, None), (12, "r", 12, "send", "s6", None, None), (13, "r", 13, "resume", None, None, None), (14, "r", 14, "send", "s1", None, None),
    (15, "r", 613, "prune", None, None, None), (16, "r", 614, "end", None, "eve", None), (17, "r", 615, "subscribe", "s1", None, None), (18, "r", 616, "join", "s1", "ann", "agent"), (19, "r", 617, "subscribe", "s1", None, None), (20, "r", 618, "close", None, None, None), (21, "r", 619, "send", "s1", None, None), (22, "q", 1, "leave", "s1", None, None),
]
OUTCOMES = [
    (1, "joined", "ann"), (2, "joined", "ann-2"), (3, "refused", "ann"), (4, "refused", "system"), (5, "refused", "bob"), (6, "joined", "eve"), (7, "joined", "hal"), (8, "sent", "eve"), (9, "refused", None), (10, "halted", "system"), (11, "refused", "eve"), (12, "sent", "hal"), (13, "resumed", "system"), (14, "sent", "eve"),
    (15, "pruned", "ann-2"), (15, "pruned", "hal"), (16, "ended", "eve"), (17, "refused", None), (18, "joined", "ann"), (19, "subscribed", "ann"), (20, "closed", "system"), (21, "refused", None), (22, "refused", None),
]


@pytest.mark.parametrize("cut", [22, 9])
def test_room_life(spark, tmp_path, cut):
    """In one run, and with the operations after `cut` arriving later: the same outcomes, from the roster in the checkpoint."""
    for part in (OPS[:cut], OPS[cut:]):
        if part:
            spark.createDataFrame(part, rooms.OPERATION).coalesce(1).write.mode("append").json(f"{tmp_path}/log")
        got = bus.run(rooms.lifecycle(spark.readStream.schema(rooms.OPERATION).json(f"{tmp_path}/log")), f"{tmp_path}/s", "append")
    assert sorted(((r["id"], r["outcome"], r["name"]) for r in got.collect()), key=str) == sorted(OUTCOMES, key=str)


def test_halted_across_partitions(spark):
    data = [(i, "room", "s", i, "t", "halt" if i == 3 else "resume" if i == 4000 else None, None) for i in range(8000)]
    got = {r[0]: r[2] for r in bus.halted(spark.createDataFrame(data, bus.ENVELOPE)).collect()}
    assert all(got[i] == (3 <= i < 4000) for i in range(8000))


def test_limits(spark):
    env = spark.createDataFrame([(1, "r", "", 1, "x", None, None), (2, "r", "s" * 200, 1, "", None, ["a"] * 17), (3, "r", "s", 1, "x", None, ["b" * 300])], bus.ENVELOPE)
    assert rows(bus.problems(env)) == [(1, "no sender"), (2, "name too long"), (2, "no text"), (2, "too many recipients"), (3, "recipients too long")]


def test_python_symbols():
    from arborweft.plans.extract import ceiling, python_symbols

    t = "class A:\n    def f(self):\n        def g(): pass\n        return 1\n\nif x:\n    async def h():\n        pass\n"
    assert python_symbols(t) == [("class", "A", 1, 4, None), ("method", "A::f", 2, 4, "A"), ("function", "A::f::g", 3, 3, "A::f"), ("function", "h", 7, 8, None)]
    assert python_symbols("def f(:\n") == [] and python_symbols("") == []
    assert ceiling("a" * 60 + "\n#### x\n" + "b" * 60, 100) == "a" * 60 and ceiling("a" * 101, 100) == "a" * 100 and ceiling("abc", 100) == "abc"
