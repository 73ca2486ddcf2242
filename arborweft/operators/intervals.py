"""The narrowest line interval that holds a line: a range join in blocks of 256 lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256


def narrowest(items: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """items (key, file_path, line, ...) with column `owner`: of the nodes (id, file_path, start_line, end_line) whose lines
    hold the item's, the one with the fewest lines (ties: least id), else 'file:' and the path.

    Both sides are cut into blocks, so a file that holds a third of all rows spreads over its blocks; a node stands in each
    block it touches. `key` must be unique in items; null lines and inverted intervals hold nothing."""
    block = lambda c: F.floor(F.col(c) / BLOCK)
    n = nodes.filter("start_line <= end_line and file_path is not null").select(F.col("id").alias("node_id"), "file_path", "start_line", "end_line", F.explode(F.sequence(block("start_line"), block("end_line"))).alias("block_"))
    r = items.select(key, "file_path", "line").withColumn("block_", block("line"))
    hit = r.join(n, ["file_path", "block_"]).filter("start_line <= line and end_line >= line").groupBy(key).agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "node_id")).alias("m_"))
    return items.join(hit, key, "left").withColumn("owner", F.coalesce("m_.node_id", F.concat(F.lit("file:"), "file_path"))).drop("m_")
