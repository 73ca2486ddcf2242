"""The property graph behind the queries: latest nodes, distinct edges, latest files, distinct references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweft.sources.tables import load

#: The same views for the SQL the queries are held against.
SQL = """n AS (SELECT * FROM nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1),
e AS (SELECT DISTINCT * FROM edges),
f AS (SELECT * FROM files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC NULLS LAST) = 1),
r AS (SELECT DISTINCT * FROM unresolved_refs)"""

# Kinds that hold other symbols; kinds that can be dead code.
CONTAINERS = ("file", "module", "class", "struct", "interface", "namespace", "trait", "protocol")
DEAD_KINDS = ("function", "method", "class")


def sql(body: str) -> str:
    return f"WITH RECURSIVE {SQL} {body}"


def latest(rows: DataFrame, key: str, at: str, cols: list[str]) -> DataFrame:
    """The latest row per key (ties: the greatest row). Combined on the map side; only `cols` are read and shuffled."""
    rest = [c for c in cols if c != key]
    if at not in rows.columns or not rest:
        return rows.filter(F.col(key).isNotNull()).select(key).distinct()
    pick = F.max(F.struct(F.col(at).alias("at_"), F.struct(*rest).alias("v_")))
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(pick.alias("x_")).select(key, *[F.col(f"x_.v_.{c}").alias(c) for c in rest])


def nodes(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Latest node rows: per id the greatest updated_at."""
    t = load(spark, d, "nodes")
    return latest(t, "id", "updated_at", list(cols) or t.columns)


def files(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    t = load(spark, d, "files")
    return latest(t, "path", "indexed_at", list(cols) or t.columns)


def edges(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Edges without repeated rows. Parallel edges (other id) stay. With `cols`, `id` must be one of them to keep those."""
    t = load(spark, d, "edges")
    return (t.select("id", *[c for c in cols if c != "id"]) if cols else t).dropDuplicates(["id"])


def refs(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    t = load(spark, d, "unresolved_refs")
    return (t.select("id", *[c for c in cols if c != "id"]) if cols else t).dropDuplicates(["id"])


def node_id(path: Column, kind: Column, qualified: Column, line: Column) -> Column:
    """The identity of a symbol: kind:first 32 hex digits of sha256(path:kind:name:line); files and packages by name."""
    digest = F.substring(F.sha2(F.concat_ws(":", path, kind, qualified, line.cast("string")), 256), 1, 32)
    return F.when(kind == "file", F.concat(F.lit("file:"), path)).when(kind == "package", F.concat(F.lit("package:npm/"), qualified)).otherwise(F.concat(kind, F.lit(":"), digest))


def ref_id(source: Column, name: Column, kind: Column, line: Column, col: Column) -> Column:
    return F.concat(F.lit("ref:"), F.substring(F.sha2(F.concat_ws(":", source, name, kind, line.cast("string"), col.cast("string")), 256), 1, 32))
