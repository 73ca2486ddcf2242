"""Bounded breadth-first traversal over edge tables: one bounded join per level, written between levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborweft.operators.model import CONTAINERS
from arborweft.sources.tables import Scratch

CALL_KINDS = ("calls", "references", "imports")
TYPE_KINDS = ("extends", "implements")


def priority(kind: Column) -> Column:
    """contains before calls before all others."""
    return F.when(kind == "contains", 0).when(kind == "calls", 1).otherwise(2)


def hits(edges: DataFrame, front: DataFrame, near: str, far: str, scratch: Scratch) -> DataFrame:
    """(origin, edge_id, id): edges at the frontier (origin, id), each once per origin, however often its row is stored.

    The frontier is a written table, so the join is a broadcast while it is small: the edges are then scanned with kind and
    columns pushed down and never shuffled, and only the hits are made distinct. `edges` may hold repeated rows."""
    step = edges.join(front.select("origin", F.col("id").alias("near_")), edges[near] == F.col("near_"))
    return step.select("origin", F.col("edge_id"), F.col(far).alias("id")).distinct()


def pruned(edges: DataFrame, kinds: tuple | None = None, skip: tuple = ()) -> DataFrame:
    """edge_id, source, target of the edges that a walk may use; a plain filter and projection of the scan."""
    e = edges.filter("source is not null and target is not null")
    if kinds is not None:
        e = e.filter(F.col("kind").isin(*kinds))
    if skip:
        e = e.filter(~F.col("kind").isin(*skip))
    return e.select(F.col("id").alias("edge_id"), "source", "target")


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int, incoming: bool = False, kinds: tuple | None = None, skip: tuple = (), keep_all: bool = False, label: str = "bfs") -> tuple[DataFrame, DataFrame]:
    """Nodes (origin, id, depth) and edges (origin, edge_id, depth) reached from seeds (origin, id).

    max_depth 0 means until nothing new is found. Walks of different origins are independent. An edge is kept when its far
    end had not been visited when its level began, or always with keep_all. Seeds have depth 0; null ends lead nowhere.
    Edges are read as they are stored: repeated rows count once.
    """
    scratch = Scratch(edges.sparkSession, label)
    near, far = ("target", "source") if incoming else ("source", "target")
    e = pruned(edges, kinds, skip)
    visited = front = scratch.write(seeds.select("origin", "id").distinct().withColumn("depth", F.lit(0)))
    kept: DataFrame | None = None
    depth = 0
    while max_depth == 0 or depth < max_depth:
        depth += 1
        step = hits(e, front, near, far, scratch)
        step = scratch.write(step.join(visited.select("origin", "id", F.lit(True).alias("old")), ["origin", "id"], "left").withColumn("depth", F.lit(depth)))
        level = (step if keep_all else step.filter("old is null")).select("origin", "edge_id", "depth")
        kept = level if kept is None else kept.union(level)
        # the new ends are few beside the edges: they are written only where a further level reads them more than once
        front = step.filter("old is null").select("origin", "id", "depth").distinct()
        if depth == max_depth:
            visited = visited.union(front)
            break
        front = scratch.write(front)
        if front.isEmpty():
            break
        visited = visited.union(front)
    return visited, kept if kept is not None else seeds.select("origin", F.lit(0).cast("long").alias("edge_id"), F.lit(0).alias("depth")).limit(0)


def impact_seeds(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Walk seeds of an impact query: what a container holds, or the start itself where it holds nothing. All children start
    at once, so each node gets its least depth over all of them. `nodes` (id, kind, ...) may hold all versions of the starts:
    the latest (updated_at) counts."""
    scratch = Scratch(edges.sparkSession, "seeds")
    at = "updated_at" if "updated_at" in nodes.columns else "kind"
    kinded = scratch.write(starts.join(nodes.select("id", "kind", F.col(at).alias("at_")), "id").groupBy("origin", "id").agg(F.max(F.struct("at_", "kind")).alias("m_")).select("origin", "id", F.col("m_.kind").alias("kind")))
    inside = edges.filter("kind = 'contains' and source is not null and target is not null").select("source", F.col("target").alias("child"))
    holders = kinded.filter(F.col("kind").isin(*CONTAINERS)).select("origin", "id")
    kids = scratch.write(inside.join(holders, inside.source == holders.id).select("origin", "id", "child").distinct())
    lone = kinded.select("origin", "id").join(kids.select("origin", "id").distinct(), ["origin", "id"], "left_anti")
    return kids.select("origin", F.col("child").alias("id")).union(lone)


def impact(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Everything that depends on the starts: all incoming kinds but contains, every edge of each level kept."""
    return bfs(edges, impact_seeds(nodes, edges, starts), max_depth or 3, incoming=True, skip=("contains",), keep_all=True, label="impact")


def shortest_path(edges: DataFrame, start: DataFrame, goal: DataFrame, kinds: tuple | None = None) -> DataFrame:
    """(step, id) of one shortest directed path from the row of start (id) to the row of goal (id); empty if there is none.
    A path has no greatest length: the walk ends at the goal or when nothing new is found.

    The parent of a node is, of its neighbours in the level before, the one with the first edge kind, then the least id.
    """
    scratch = Scratch(edges.sparkSession, "path")
    e = edges.filter("source is not null and target is not null")
    if kinds:
        e = e.filter(F.col("kind").isin(*kinds))
    e = e.select("source", "target", priority(F.col("kind")).alias("prio"))
    front = scratch.write(start.select("id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level")))
    aim = goal.select("id").first()
    levels, seen = [front], front.select("id")
    while True:
        size, there = front.agg(F.count("*"), F.max(F.col("id") == (aim[0] if aim else None))).first()
        if not size or aim is None:
            return front.limit(0).select(F.col("level").alias("step"), "id")
        if there:
            break
        step = e.join(front.select(F.col("id").alias("near_")), F.col("source") == F.col("near_")).select(F.col("target").alias("id"), "prio", "source").join(seen, "id", "left_anti")
        front = scratch.write(step.groupBy("id").agg(F.min(F.struct("prio", "source")).alias("m")).select("id", F.col("m.source").alias("parent"), F.lit(len(levels)).alias("level")))
        levels.append(front)
        seen = seen.union(front.select("id"))
        if len(levels) % 16 == 0:  # a long walk keeps few files to read back
            seen = scratch.write(seen)
    # back from the goal, one row and one small table a step
    at = front.filter(F.col("id") == aim[0]).first()
    out = [(at["level"], at["id"])]
    for level in reversed(levels[:-1]):
        at = level.filter(F.col("id") == at["parent"]).first()
        out.append((at["level"], at["id"]))
    return edges.sparkSession.createDataFrame(out, "step int, id string")
