"""The incremental index as set operations: what to read again, what to drop, and the tables after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborweft.sources.tables import Scratch


def forced(stored_version: str | None, version: str) -> bool:
    """Another version of the extractor reads everything again. The new version is stamped only after the pass."""
    return stored_version != version


def actions(old: DataFrame, scan: DataFrame, force: bool = False, subset: DataFrame | None = None) -> DataFrame:
    """(path, action). old (path, h): files of the index; scan (path, h): files found, h null where the file could
    not be read.

    index: new, changed or forced; skip: the same hash; error: not readable, counted and left as it is; prune: in the index but
    not found. With a subset (path) only its paths are looked at, and nothing is pruned. Null paths are no files."""
    o = old.filter("path is not null").select("path", F.col("h").alias("h0"), F.lit(True).alias("o"))
    w = scan.filter("path is not null").select("path", "h", F.lit(True).alias("w"))
    if subset is not None:
        w = w.join(subset.select("path").distinct(), "path", "left_semi")
        j = w.join(o, "path", "left")
    else:
        j = w.join(o, "path", "full")
    same = F.coalesce(F.col("o"), F.lit(False)) & F.col("h0").eqNullSafe(F.col("h"))
    act = F.when(F.col("w").isNull(), "prune").when(F.col("h").isNull(), "error").when(same & ~F.lit(force), "skip").otherwise("index")
    return j.select("path", act.alias("action"))


def store(nodes: DataFrame, edges: DataFrame, refs: DataFrame, files: DataFrame, plan: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, new_refs: DataFrame, new_files: DataFrame) -> dict[str, DataFrame]:
    """The tables after a pass. Nodes of files that are indexed or pruned go, with all edges at either end and all
    references that start there; then the new rows come in, edges and references only where their ends (their owner) exist.
    Edges are not made distinct; a reference id that is there already stays as it is."""
    scratch = Scratch(nodes.sparkSession, "store")
    touched = plan.filter("action in ('index', 'prune')").select("path")
    n = nodes.join(touched.withColumnRenamed("path", "file_path"), "file_path", "left_anti").select(*nodes.columns)
    gone = scratch.write(nodes.join(touched.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select("id").distinct())
    n = scratch.write(n.unionByName(new_nodes.select(*nodes.columns)))
    ids = scratch.write(n.select("id").distinct())
    without = lambda t, c: t.join(gone.withColumnRenamed("id", c), c, "left_anti").select(*t.columns)
    having = lambda t, c: t.join(ids.withColumnRenamed("id", c), c, "left_semi").select(*t.columns)
    e = without(without(edges, "source"), "target").unionByName(having(having(new_edges.select(*edges.columns), "source"), "target"))
    kept = without(refs, "from_node_id")
    fresh = having(new_refs.select(*refs.columns), "from_node_id").dropDuplicates(["id"])
    r = kept.unionByName(fresh.join(kept.select("id"), "id", "left_anti").select(*refs.columns))
    f = files.join(touched, "path", "left_anti").select(*files.columns).unionByName(new_files.select(*files.columns))
    return {"nodes": n, "edges": e, "unresolved_refs": r, "files": f}


def swap(df: DataFrame, path: str) -> None:
    """Replace a stored table as a whole: written beside it, then renamed, so a failure before the end changes nothing.
    The old table may be read while the new one is written."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, fresh, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new", f"{path}.old"))
    fs = target.getFileSystem(conf)
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)


def clear(spark, path: str) -> None:
    """An empty table of the same columns."""
    swap(spark.read.parquet(path).limit(0), path)


def compact(spark, path: str, file_bytes: int = 256 << 20) -> int:
    """The same rows in files of about `file_bytes`; returns how many files there are."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    size = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    n = max(1, -(-size // file_bytes))
    swap(spark.read.parquet(path).repartition(n), path)
    return n
