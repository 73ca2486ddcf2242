"""Parent-child links to full hierarchies: components, co-location, iterative depth-first traversal with node colours (problem 3).

Links are (edge_kind, parent, child). A component that fits one task (`max_links`) is traversed there; larger ones are
first trimmed of all links that lie on no loop and, where still too large, solved by label propagation over DataFrames,
so no unbounded group ever reaches one task. Only back edges need the order of one traversal: there a component that stays
too large is traversed in one task, as arrays of numbers.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweft.sources.tables import Scratch, load

MAX_LINKS = 400_000


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links of the two hierarchies. Links with a null end are dropped; other kinds never leave the scan."""
    e = load(spark, sf_dir, "edges").select("kind", "source", "target").filter(F.col("kind").isin("contains", "extends") & F.col("source").isNotNull() & F.col("target").isNotNull())
    up = F.col("kind") == "extends"
    return e.select(F.col("kind").alias("edge_kind"), F.when(up, F.col("target")).otherwise(F.col("source")).alias("parent"), F.when(up, F.col("source")).otherwise(F.col("target")).alias("child")).distinct()


# --- connected components -------------------------------------------------------------------------------------------


def components(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, comp) of the graph with links (a, b), both long: alternating large-star and small-star steps until stable.

    Each step takes the least neighbour of each vertex by an aggregation that combines on the map side, and joins it
    back; a vertex with a third of all links is one skewed join key, which the adaptive join splits.
    """
    cur = scratch.write(pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # large-star gives pairs with a > b or a = b; the least lower neighbour of each vertex becomes its new centre
        large = scratch.write(large.filter("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        new = scratch.write(small.filter("a <> b").distinct())
        scratch.drop(cur)
        scratch.drop(large)
        cur = new
        mark = cur.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(mark) == seen:
            return cur.select(F.col("a").alias("v"), F.col("b").alias("comp")).union(cur.select(F.col("b").alias("v"), F.col("b").alias("comp")).distinct())
        seen = tuple(mark)


def with_component(lk: DataFrame, scratch: Scratch) -> DataFrame:
    """Links with the component they lie in. Vertices are 64-bit hashes here: a clash could only merge two components, and
    the traversal itself compares whole ids."""
    code = lambda c: F.xxhash64("edge_kind", c)
    comp = components(lk.select(code("parent").alias("a"), code("child").alias("b")), scratch)
    tagged = lk.withColumn("v", code("parent"))
    return tagged.join(comp, "v", "left").select("edge_kind", "parent", "child", F.coalesce("comp", "v").alias("comp"))


# --- traversal of whole components in one task -----------------------------------------------------------------------


def _by_component(batches: Iterator[pa.RecordBatch], work: Callable[[list, list, list], Iterator[pa.RecordBatch]], chunk: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by component; whole components are handed on, several at once."""
    kinds, parents, children, comps = [], [], [], []
    for b in batches:
        kinds += b.column(0).to_pylist()
        parents += b.column(1).to_pylist()
        children += b.column(2).to_pylist()
        comps += b.column(3).to_pylist()
        if len(comps) >= chunk and comps[0] != comps[-1]:
            cut = len(comps) - 1
            while comps[cut - 1] == comps[-1]:
                cut -= 1
            yield from work(kinds[:cut], parents[:cut], children[:cut])
            kinds, parents, children, comps = kinds[cut:], parents[cut:], children[cut:], comps[cut:]
    if comps:
        yield from work(kinds, parents, children)


def _adjacency(kinds: list, parents: list, children: list) -> tuple[dict, list]:
    """Vertices (kind, id) as numbers in order of kind and id; per vertex its children in that order."""
    ids = sorted({*zip(kinds, parents), *zip(kinds, children)})
    num = {v: i for i, v in enumerate(ids)}
    out: list[list[int]] = [[] for _ in ids]
    for k, p, c in sorted(zip(kinds, parents, children)):
        out[num[k, p]].append(num[k, c])
    return out, ids


def loops(out: list[list[int]]) -> tuple[list[int], list[tuple[int, int]]]:
    """One depth-first traversal without recursion. Colours: unseen, on the current path or its strong component still
    open, closed. Gives per vertex the least vertex of its loop (-1: on no loop), and the back edges to the current path."""
    n = len(out)
    order, low, state = [-1] * n, [0] * n, bytearray(n)  # state: 0 unseen, 1 grey, 2 left but its component is open, 3 closed
    loop, back, open_, tick = [-1] * n, [], [], 0
    for start in range(n):
        if state[start]:
            continue
        stack = [(start, 0)]
        order[start] = low[start] = tick
        tick += 1
        state[start] = 1
        open_.append(start)
        while stack:
            v, i = stack[-1]
            if i < len(out[v]):
                stack[-1] = (v, i + 1)
                w = out[v][i]
                if not state[w]:
                    order[w] = low[w] = tick
                    tick += 1
                    state[w] = 1
                    open_.append(w)
                    stack.append((w, 0))
                elif state[w] < 3:
                    if state[w] == 1:
                        back.append((v, w))
                    low[v] = min(low[v], order[w])
                continue
            stack.pop()
            state[v] = 2
            if stack:
                u = stack[-1][0]
                low[u] = min(low[u], low[v])
            if low[v] == order[v]:
                group = []
                while True:
                    w = open_.pop()
                    state[w] = 3
                    group.append(w)
                    if w == v:
                        break
                if len(group) > 1 or v in out[v]:
                    least = min(group)
                    for w in group:
                        loop[w] = least
    return loop, back


def _loop_rows(kinds: list, parents: list, children: list) -> Iterator[pa.RecordBatch]:
    out, ids = _adjacency(kinds, parents, children)
    loop, _ = loops(out)
    hit = [v for v, c in enumerate(loop) if c >= 0]
    if hit:
        yield pa.RecordBatch.from_pydict({"edge_kind": [ids[v][0] for v in hit], "node_id": [ids[v][1] for v in hit], "cycle_id": [ids[loop[v]][1] for v in hit]})


def _back_rows(kinds: list, parents: list, children: list) -> Iterator[pa.RecordBatch]:
    out, ids = _adjacency(kinds, parents, children)
    _, back = loops(out)
    if back:
        yield pa.RecordBatch.from_pydict({"edge_kind": [ids[v][0] for v, _ in back], "parent": [ids[v][1] for v, _ in back], "child": [ids[w][1] for _, w in back]})


def _closure_rows(kinds: list, parents: list, children: list) -> Iterator[pa.RecordBatch]:
    out, ids = _adjacency(kinds, parents, children)
    k, a, d = [], [], []
    for v in range(len(ids)):
        seen, stack = set(out[v]), list(out[v])
        while stack:
            for w in out[stack.pop()]:
                if w not in seen:
                    seen.add(w)
                    stack.append(w)
        k += [ids[v][0]] * len(seen)
        a += [ids[v][1]] * len(seen)
        d += [ids[w][1] for w in sorted(seen)]
        if len(k) >= 50_000:
            yield pa.RecordBatch.from_pydict({"edge_kind": k, "ancestor_id": a, "descendant_id": d})
            k, a, d = [], [], []
    if k:
        yield pa.RecordBatch.from_pydict({"edge_kind": k, "ancestor_id": a, "descendant_id": d})


def _tree_rows(kinds: list, parents: list, children: list) -> Iterator[pa.RecordBatch]:
    out, ids = _adjacency(kinds, parents, children)
    up = [-1] * len(ids)
    for v in range(len(ids) - 1, -1, -1):  # descending, so the least parent stays
        for w in out[v]:
            if w != v:
                up[w] = v
    loop, _ = loops(out)
    colour, root, depth, path = bytearray(len(ids)), [0] * len(ids), [0] * len(ids), [""] * len(ids)
    for v in range(len(ids)):
        trail = []
        while v >= 0 and not colour[v]:
            colour[v] = 1
            trail.append(v)
            v = up[v]
        if v >= 0 and colour[v] == 1:  # the chain of parents closes on itself: its least vertex is the root
            ring = trail[trail.index(v) :]
            least = min(ring)
            k = trail.index(least)
            colour[least] = 2
            root[least], depth[least], path[least] = least, 0, ids[least][1]
            ring_rest = trail[trail.index(ring[0]) :]
            after = ring_rest[ring_rest.index(least) + 1 :] + ring_rest[: ring_rest.index(least)]
            for w in reversed(after):
                colour[w] = 2
                root[w], depth[w], path[w] = root[up[w]], depth[up[w]] + 1, path[up[w]] + "/" + ids[w][1]
            trail = [w for w in trail if colour[w] == 1]
        for w in reversed(trail):
            colour[w] = 2
            u = up[w]
            root[w], depth[w], path[w] = (w, 0, ids[w][1]) if u < 0 else (root[u], depth[u] + 1, path[u] + "/" + ids[w][1])
    yield pa.RecordBatch.from_pydict(
        {"edge_kind": [i[0] for i in ids], "node_id": [i[1] for i in ids], "root_id": [ids[r][1] for r in root], "depth": pa.array(depth, pa.int32()), "path": path, "in_loop": [c >= 0 for c in loop]}
    )


def _traverse(tagged: DataFrame, work: Callable, schema: str, chunk: int = 20_000) -> DataFrame:
    near = tagged.repartition("comp").sortWithinPartitions("comp").select("edge_kind", "parent", "child", "comp")
    return near.mapInArrow(lambda batches: _by_component(batches, work, chunk), schema)


# --- components that are too large for one task ----------------------------------------------------------------------


def trim(lk: DataFrame, scratch: Scratch) -> DataFrame:
    """Drop, until stable, every link whose parent has no parent or whose child has no child: none of them is on a loop."""
    cur, n = scratch.write(lk), None
    while True:
        heads = cur.select("edge_kind", F.col("child").alias("parent")).distinct()
        tails = cur.select("edge_kind", F.col("parent").alias("child")).distinct()
        new = scratch.write(cur.join(heads, ["edge_kind", "parent"], "left_semi").join(tails, ["edge_kind", "child"], "left_semi").select(*lk.columns))
        scratch.drop(cur)
        cur, before, n = new, n, new.count()
        if n == before or n == 0:
            return cur


def loops_by_labels(lk: DataFrame, scratch: Scratch) -> DataFrame:
    """Strong components without any grouping by component: the least id that reaches a vertex is its colour; those of a
    colour that also reach the colour's own vertex form a loop; take them out and repeat."""
    left, done = trim(lk.select("edge_kind", "parent", "child"), scratch), None
    while not left.isEmpty():
        ids = left.select("edge_kind", F.col("parent").alias("v")).union(left.select("edge_kind", F.col("child").alias("v"))).distinct()
        colour = scratch.write(ids.withColumn("c", F.col("v")))
        while True:
            came = left.join(colour, (left.edge_kind == colour.edge_kind) & (left.parent == colour.v)).select(left.edge_kind, F.col("child").alias("v"), "c")
            new = scratch.write(colour.union(came).groupBy("edge_kind", "v").agg(F.min("c").alias("c"), F.max("c").alias("was")))
            moved = new.join(colour.withColumnRenamed("c", "old"), ["edge_kind", "v"]).filter("c <> old").isEmpty()
            scratch.drop(colour)
            colour = new.select("edge_kind", "v", "c")
            if moved:
                break
        # backwards from each colour's own vertex, inside the colour
        same = left.join(colour.withColumnsRenamed({"v": "parent", "c": "pc"}), ["edge_kind", "parent"]).join(colour.withColumnsRenamed({"v": "child", "c": "cc"}), ["edge_kind", "child"]).filter("pc = cc")
        same = scratch.write(same.select("edge_kind", "parent", "child", F.col("pc").alias("c")))
        reach = scratch.write(same.filter("child = c").select("edge_kind", F.col("parent").alias("v"), "c").distinct())
        front = reach
        while not front.isEmpty():
            f = front.withColumnRenamed("v", "child")
            more = same.join(f, ["edge_kind", "child", "c"]).select("edge_kind", F.col("parent").alias("v"), "c").distinct()
            front = scratch.write(more.join(reach, ["edge_kind", "v", "c"], "left_anti"))
            reach = scratch.write(reach.union(front))
        hit = reach.select("edge_kind", F.col("v").alias("node_id"), F.col("c").alias("cycle_id"))
        done = hit if done is None else done.union(hit)
        # a colour's own vertex is settled even if it lies on no loop, so each pass takes at least one vertex out
        settled = scratch.write(reach.select("edge_kind", "v").union(colour.filter("v = c").select("edge_kind", "v")).distinct())
        keep = left.join(settled.withColumnRenamed("v", "parent"), ["edge_kind", "parent"], "left_anti").join(settled.withColumnRenamed("v", "child"), ["edge_kind", "child"], "left_anti")
        left = trim(keep.select("edge_kind", "parent", "child"), scratch)
    return done if done is not None else lk.select("edge_kind", F.col("parent").alias("node_id"), F.col("parent").alias("cycle_id")).limit(0)


def _split(lk: DataFrame, scratch: Scratch, max_links: int) -> tuple[DataFrame, DataFrame | None]:
    """Links of components up to max_links, with comp; and those of larger components, if there are any."""
    tagged = scratch.write(with_component(lk, scratch))
    big = tagged.groupBy("comp").count().filter(F.col("count") > max_links).select("comp")
    big = scratch.write(big)
    if big.isEmpty():
        return tagged, None
    big = F.broadcast(big)  # at most links / max_links rows
    return tagged.join(big, "comp", "left_anti"), tagged.join(big, "comp", "left_semi")


def loop_members(lk: DataFrame, max_links: int = MAX_LINKS) -> DataFrame:
    """(edge_kind, node_id, cycle_id) of every vertex on a loop; cycle_id is the least id of its strong component."""
    scratch = Scratch(lk.sparkSession, "hierarchy")
    schema = "edge_kind string, node_id string, cycle_id string"
    small, large = _split(scratch.write(lk), scratch, max_links)
    res = _traverse(small, _loop_rows, schema)
    if large is None:
        return res
    rest = scratch.write(trim(large.select("edge_kind", "parent", "child"), scratch))
    if rest.isEmpty():
        return res
    again, still = _split(rest, scratch, max_links)
    res = res.union(_traverse(again, _loop_rows, schema))
    return res if still is None else res.union(loops_by_labels(still, scratch))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_found. Duplicate and parallel edges count once, a link to itself is a loop, an empty table gives no row."""
    return loop_members(links(spark, sf_dir))


def _towards_loops(lk: DataFrame, scratch: Scratch) -> DataFrame:
    """Drop links whose child has no child, pass by pass: no loop is reached through them, so the traversal of the rest stays
    the same. This only saves work, and ends when a pass drops less than a tenth."""
    cur = scratch.write(lk)
    n = cur.count()
    while n:
        new = scratch.write(cur.join(cur.select("edge_kind", F.col("parent").alias("child")).distinct(), ["edge_kind", "child"], "left_semi").select(*lk.columns))
        scratch.drop(cur)
        cur, before, n = new, n, new.count()
        if n > before * 0.9:
            break
    return cur


def _back_positions(parents: np.ndarray, children: np.ndarray, n: int) -> array:
    """Positions of the back edges among links sorted by parent and child, of the same traversal as in loops()."""
    begin = np.searchsorted(parents, np.arange(n + 1))
    at, end, child = memoryview(begin[:-1].copy()), memoryview(begin[1:].copy()), memoryview(children)
    colour, stack, back = bytearray(n), array("q"), array("q")  # colour: 0 unseen, 1 on the path, 2 left
    for start in range(n):
        if colour[start]:
            continue
        colour[start] = 1
        stack.append(start)
        while stack:
            v = stack[-1]
            i = at[v]
            if i == end[v]:
                colour[v] = 2
                stack.pop()
                continue
            at[v] = i + 1
            w = child[i]
            if not colour[w]:
                colour[w] = 1
                stack.append(w)
            elif colour[w] == 1:
                back.append(i)
    return back


def _back_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Back edges of whole components as codes. Columns in: base (the least code of the component), parent, child, sorted; the
    codes of a component are dense. Held as arrays of numbers, one component at a time."""
    base, held = None, []

    def done() -> Iterator[pa.RecordBatch]:
        p, c = (np.concatenate(x) for x in zip(*held))
        held.clear()
        back = np.array(_back_positions(p, c, int(max(p.max(), c.max())) + 1), np.int64)
        for i in range(0, len(back), 50_000):
            k = back[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"parent": pa.array(p[k].astype(np.int64) + base), "child": pa.array(c[k].astype(np.int64) + base)})

    for b in batches:
        bases, p, c = (x.to_numpy() for x in b.columns)
        cuts = [0, *(np.flatnonzero(np.diff(bases)) + 1).tolist(), len(bases)]
        for i, k in zip(cuts, cuts[1:]):
            if i == k:
                continue
            if held and base != int(bases[i]):
                yield from done()
            base = int(bases[i])
            held.append(((p[i:k] - base).astype(np.int32), (c[i:k] - base).astype(np.int32)))
    if held:
        yield from done()


def _back_by_codes(large: DataFrame, scratch: Scratch) -> DataFrame:
    """Back edges of components with too many links for lists of texts (edge_kind, parent, child, comp): ids become dense
    numbers in their order by a range partition, and the traversal runs over arrays of numbers. A depth-first traversal is one
    sequence of steps, so each such component is one task, with some 16 bytes a link and 40 a vertex."""
    from pyspark.sql import Window

    ids = large.select("comp", "edge_kind", F.col("parent").alias("v")).union(large.select("comp", "edge_kind", F.col("child").alias("v"))).distinct()
    ids = scratch.write(ids.repartitionByRange("comp", "edge_kind", "v").withColumn("part", F.spark_partition_id()))
    skip = ids.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("skip"))  # a row for each partition
    no = F.row_number().over(Window.partitionBy("part").orderBy("comp", "edge_kind", "v")).cast("long") - 1
    ids = scratch.write(ids.withColumn("no", no).join(F.broadcast(skip), "part").select("comp", "edge_kind", "v", (F.col("no") + F.col("skip")).alias("code")))
    base = ids.groupBy("comp").agg(F.min("code").alias("base"))  # at most links / max_links rows
    a, b = (ids.select("comp", "edge_kind", F.col("v").alias(x), F.col("code").alias(x[0])) for x in ("parent", "child"))
    coded = large.join(a, ["comp", "edge_kind", "parent"]).join(b, ["comp", "edge_kind", "child"]).join(F.broadcast(base), "comp").select("base", "p", "c")
    near = coded.repartition("base").sortWithinPartitions("base", "p", "c")
    hit = scratch.write(near.mapInArrow(_back_codes, "parent long, child long"))
    a, b = (ids.select("edge_kind", F.col("v").alias(x), F.col("code").alias(x[0])) for x in ("parent", "child"))
    return hit.toDF("p", "c").join(a, "p").join(b.drop("edge_kind"), "c").select("edge_kind", "parent", "child")


def back_edges_of(lk: DataFrame, max_links: int = MAX_LINKS) -> DataFrame:
    """The links that close a loop in the depth-first traversal (vertices and children in order of id), in components of any
    size. Larger ones are first freed of what leads to no loop, and split again."""
    scratch = Scratch(lk.sparkSession, "backedges")
    schema = "edge_kind string, parent string, child string"
    small, large = _split(scratch.write(lk), scratch, max_links)
    res = _traverse(small, _back_rows, schema)
    if large is None:
        return res
    rest = _towards_loops(large.select("edge_kind", "parent", "child"), scratch)
    if rest.isEmpty():
        return res
    again, still = _split(rest, scratch, max_links)
    res = res.union(_traverse(again, _back_rows, schema))
    return res if still is None else res.union(_back_by_codes(still.select("edge_kind", "parent", "child", "comp"), scratch))


def back_edges(spark: SparkSession, sf_dir: str, max_links: int = MAX_LINKS) -> DataFrame:
    """p3_back_edges."""
    return back_edges_of(links(spark, sf_dir), max_links)


def tree(lk: DataFrame, max_links: int = MAX_LINKS) -> DataFrame:
    """edge_kind, node_id, root_id, depth, path (ids from the root, joined by '/'), in_loop: one row per vertex.

    The place of a vertex follows its least parent other than itself. Where that chain of parents closes on itself, the
    least vertex of the ring is the root. Components too large for one task are solved by pointer doubling.
    """
    scratch = Scratch(lk.sparkSession, "tree")
    lk = scratch.write(lk)
    small, large = _split(lk, scratch, max_links)
    res = _traverse(small, _tree_rows, "edge_kind string, node_id string, root_id string, depth int, path string, in_loop boolean")
    return res if large is None else res.union(_tree_by_doubling(large.select("edge_kind", "parent", "child"), scratch, max_links))


def _tree_by_doubling(lk: DataFrame, scratch: Scratch, max_links: int) -> DataFrame:
    k = "edge_kind"
    ids = lk.select(k, F.col("parent").alias("v")).union(lk.select(k, F.col("child").alias("v"))).distinct()
    up = lk.filter("parent <> child").groupBy(k, F.col("child").alias("v")).agg(F.min("parent").alias("up"))
    up = scratch.write(ids.join(up, [k, "v"], "left"))
    # rings of the parent chains: every vertex has one parent at most, so they are the loops of these links
    ring = loop_members(up.filter("up is not null").select(k, F.col("up").alias("parent"), F.col("v").alias("child")), max_links)
    cut = ring.filter("node_id = cycle_id").select(k, F.col("node_id").alias("v")).withColumn("cut", F.lit(True))
    cur = scratch.write(up.join(cut, [k, "v"], "left").select(k, "v", F.when(F.col("cut"), F.lit(None)).otherwise(F.col("up")).alias("up"), F.lit("").alias("above")).withColumn("above", F.coalesce("up", F.lit(""))).withColumn("top", F.coalesce("up", "v")).withColumn("n", F.when(F.col("up").isNull(), 0).otherwise(1)))
    while not cur.filter("up is not null").isEmpty():
        hop = cur.select(k, F.col("v").alias("up"), F.col("up").alias("up2"), F.col("above").alias("above2"), F.col("top").alias("top2"), F.col("n").alias("n2"))
        new = cur.join(hop, [k, "up"], "left").select(k, "v", F.col("up2").alias("up"), F.coalesce("top2", "top").alias("top"), F.when(F.coalesce("n2", F.lit(0)) > 0, F.concat("above2", F.lit("/"), "above")).otherwise(F.col("above")).alias("above"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"))
        new = scratch.write(new)
        scratch.drop(cur)
        cur = new
    hit = loop_members(lk, max_links).select(k, F.col("node_id").alias("v"), F.lit(True).alias("in_loop"))
    full = F.when(F.col("n") > 0, F.concat("above", F.lit("/"), "v")).otherwise(F.col("v"))
    return cur.join(hit, [k, "v"], "left").select(k, F.col("v").alias("node_id"), F.col("top").alias("root_id"), F.col("n").cast("int").alias("depth"), full.alias("path"), F.coalesce("in_loop", F.lit(False)).alias("in_loop"))


def descendants(lk: DataFrame, max_links: int = MAX_LINKS) -> DataFrame:
    """(edge_kind, ancestor_id, descendant_id), each pair once; a vertex on a loop is its own descendant."""
    scratch = Scratch(lk.sparkSession, "descendants")
    small, large = _split(scratch.write(lk), scratch, max_links)
    res = _traverse(small, _closure_rows, "edge_kind string, ancestor_id string, descendant_id string")
    if large is None:
        return res
    step = large.select("edge_kind", F.col("parent").alias("a"), F.col("child").alias("d"))
    total = front = scratch.write(step)
    while not front.isEmpty():
        more = front.join(step.select("edge_kind", F.col("a").alias("d"), F.col("d").alias("e")), ["edge_kind", "d"]).select("edge_kind", "a", F.col("e").alias("d")).distinct()
        front = scratch.write(more.join(total, ["edge_kind", "a", "d"], "left_anti"))
        total = scratch.write(total.union(front))
    return res.union(total.toDF("edge_kind", "ancestor_id", "descendant_id"))
