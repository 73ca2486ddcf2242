"""Problems 2, 3 and 7: splits, large components, nulls, repeats, empty tables and clashing columns."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborweft.functions.bitmaps import Bitmap
from arborweft.operators import hierarchy, orphans, skew
from arborweft.plans import problems
from tests.conftest import rows


@pytest.mark.parametrize("name", sorted(problems.QUERIES))
def test_empty(spark, empty_dir, name):
    assert problems.QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", ["p3_found", "p3_tree", "p3_descendants", "p3_back_edges", "p7_found", "p2_found"])
def test_repeats_and_nulls_change_nothing(spark, data, dirty_dir, name):
    assert rows(problems.QUERIES[name](spark, dirty_dir)) == rows(problems.QUERIES[name](spark, data))


@given(st.lists(st.integers(0, 300_000)), st.lists(st.integers(0, 300_000)))
@settings(max_examples=60, deadline=None)
def test_bitmap(a, b):
    x, y = Bitmap.of(np.array(a, np.uint32)), Bitmap.of(np.array(b, np.uint32))
    assert x.andnot(y).codes().tolist() == sorted(set(a) - set(b))
    assert len(x) == len(set(a))


def test_bitmap_dense():
    x, y = Bitmap.of(np.arange(70_000)), Bitmap.of(np.arange(10, 69_990))
    assert x.andnot(y).codes().tolist() == [*range(10), *range(69_990, 70_000)]
    assert y.andnot(x).codes().tolist() == []


def test_hot_key_is_split_and_stitched(spark):
    """One key holds nine tenths of all rows, most of them equal; the pieces of all partitions make one result."""
    data = [("hot", i // 50, f"i{i // 50}", "k" + str(i % 3)) for i in range(9000)] + [(f"c{i % 300}", i, f"i{i}", "k") for i in range(1000)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "key string, at long, id string, kind string").repartition(4)
    got = {r["key"]: r for r in skew.per_key(df, F.col("key"), F.timestamp_seconds("at"), F.col("id"), F.col("kind")).collect()}
    assert got["hot"]["n_rows"] == 9000 and got["hot"]["max_gap_us"] == 1_000_000
    assert got["hot"]["kinds"] == {"k0": 3000, "k1": 3000, "k2": 3000} and got["hot"]["last_id"] == "i179"
    assert got["hot"]["first_at"] == 0 and got["hot"]["last_at"] == 179_000_000
    assert len(got) == 301 and sum(r["n_rows"] for r in got.values()) == 10_000
    spread = df.withColumn("seq", F.monotonically_increasing_id()).repartitionByRange(8, "key", "at", "id", "seq").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in spread) < 3000


def test_null_keys_and_times(spark):
    df = spark.createDataFrame([(None, None, None, None), (None, 5, "a", "k"), ("x", None, "b", None)], "key string, at long, id string, kind string")
    got = {r["key"]: r for r in skew.per_key(df, F.col("key"), F.timestamp_seconds("at"), F.col("id"), F.col("kind")).collect()}
    assert got[None]["n_rows"] == 2 and got[None]["last_at"] == 5_000_000 and got["x"]["kinds"] == {"": 1} and got["x"]["first_at"] is None


def reach(links):
    out = {}
    for k, p, c in links:
        out.setdefault((k, p), set()).add((k, c))
    closure = {}
    for v in {x for k, p, c in links for x in ((k, p), (k, c))}:
        seen, stack = set(), list(out.get(v, ()))
        while stack:
            w = stack.pop()
            if w not in seen:
                seen.add(w)
                stack += out.get(w, ())
        closure[v] = seen
    return closure


def graph(seed, n=60, m=90):
    r = random.Random(seed)
    return sorted({(r.choice("ab"), f"n{r.randrange(n):02d}", f"n{r.randrange(n):02d}") for _ in range(m)})


@pytest.mark.parametrize("seed", [1, 2])
def test_loops_in_one_task_and_by_labels(spark, seed):
    links = graph(seed)
    c = reach(links)
    want = sorted((k, v, min(w for _, w in {x for x in c[k, v] if (k, v) in c[x]})) for k, v in c if (k, v) in c[k, v])
    lk = spark.createDataFrame(links, "edge_kind string, parent string, child string")
    assert rows(hierarchy.loop_members(lk)) == want
    assert rows(hierarchy.loop_members(lk, max_links=4)) == want


def test_tree_and_descendants_of_large_components(spark):
    links = [x for x in graph(3, 40, 70)]
    lk = spark.createDataFrame(links, "edge_kind string, parent string, child string")
    assert rows(hierarchy.tree(lk)) == rows(hierarchy.tree(lk, max_links=3))
    want = sorted((k, v, w) for (k, v), s in reach(links).items() for _, w in s)
    assert rows(hierarchy.descendants(lk)) == want == rows(hierarchy.descendants(lk, max_links=3))


def test_long_chain_needs_no_recursion(spark):
    links = [("contains", f"v{i:05d}", f"v{i + 1:05d}") for i in range(5000)] + [("contains", "v05000", "v04990")]
    lk = spark.createDataFrame(links, "edge_kind string, parent string, child string")
    assert len(rows(hierarchy.loop_members(lk))) == 11
    assert hierarchy.tree(lk).agg(F.max("depth")).first()[0] == 5000


def test_back_edges_match_a_plain_traversal(spark):
    links = graph(5)
    lk = spark.createDataFrame(links, "edge_kind string, parent string, child string")
    from arborweft.sources.tables import Scratch

    got = rows(hierarchy._traverse(hierarchy.with_component(lk, Scratch(spark, "t")), hierarchy._back_rows, "edge_kind string, parent string, child string"))
    out = {}
    for k, p, c in links:
        out.setdefault((k, p), []).append((k, c))
    seen, path, want = set(), [], []

    def visit(v):
        seen.add(v)
        path.append(v)
        for w in sorted(out.get(v, ())):
            if w in path:
                want.append((v[0], v[1], w[1]))
            elif w not in seen:
                visit(w)
        path.pop()

    for v in sorted({x for k, p, c in links for x in ((k, p), (k, c))}):
        if v not in seen:
            visit(v)
    assert got == sorted(want)


@pytest.mark.parametrize("seed", [5, 6])
def test_back_edges_are_the_same_at_every_size(spark, seed):
    """a -> z, z -> b, b -> z enters the loop at z, so (b, z) closes it, in a small component and in a large one."""
    links = [*graph(seed, 40, 100), *((k, *x) for k in "cd" for x in (("a", "z"), ("z", "b"), ("b", "z"), ("é", "é")))]
    out, num = hierarchy._adjacency(*zip(*links))
    _, back = hierarchy.loops(out)
    want = sorted((*num[v], num[w][1]) for v, w in back)
    lk = spark.createDataFrame(links, "edge_kind string, parent string, child string")
    assert ("c", "b", "z") in want and ("c", "z", "b") not in want
    for size in (hierarchy.MAX_LINKS, 20, 3):
        assert rows(hierarchy.back_edges_of(lk, max_links=size)) == want


def test_back_edges_of_a_long_loop(spark):
    links = [("contains", f"v{i:05d}", f"v{(i + 1) % 5000:05d}") for i in range(5000)] + [("contains", f"v{i:05d}", f"w{i:05d}") for i in range(5000)]
    lk = spark.createDataFrame(links, "edge_kind string, parent string, child string")
    assert rows(hierarchy.back_edges_of(lk, max_links=100)) == [("contains", "v04999", "v00000")]


def test_orphans_by_hand(spark):
    uses = spark.createDataFrame([("a", "e|1"), ("a", "e|1"), ("b", "e|1"), ("b", "u|2"), ("c", "e|2"), (None, "e|1"), ("d", "e|1")], "key string, use string")
    parents = spark.createDataFrame([("a", 5), ("c", 5), ("d", None), ("c", 9), (None, 1)], "key string, updated_at long")
    removals = spark.createDataFrame([("a", 6), ("c", 7), ("d", None), ("zz", 1)], "key string, removed_at long")
    # a was removed after its last update, c came back, d has no readable time but occurs, b is unknown
    assert rows(orphans.orphan_keys(uses, parents, removals)) == [("a", "e|1"), ("b", "e|1"), ("b", "u|2")]
