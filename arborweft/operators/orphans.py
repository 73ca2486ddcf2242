"""References to records that do not exist: dictionary codes, compressed bitmaps, reference AND-NOT parent (problem 7)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweft.functions.bitmaps import Bitmap
from arborweft.sources.tables import Scratch, load

#: The decoded orphans (key, use) are broadcast up to this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20


def _orphans_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch holds whole keys, so it is a key range of its own: position = dictionary code."""
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0)
        updated = b.column(1).to_numpy(zero_copy_only=False).astype("float64")
        removed = b.column(2).to_numpy(zero_copy_only=False).astype("float64")
        parents = Bitmap.of(np.flatnonzero(~np.isnan(updated) & ~(removed > updated)))
        uses = b.column(3)
        codes = np.repeat(np.arange(b.num_rows, dtype=np.uint32), pa.compute.list_value_length(uses).fill_null(0).to_numpy(zero_copy_only=False))
        flat = uses.flatten()
        where = pa.compute.dictionary_encode(flat)
        slot, names = where.indices.to_numpy(zero_copy_only=False), where.dictionary
        order = np.argsort(slot, kind="stable")
        cuts = np.flatnonzero(np.diff(slot[order])) + 1
        for part in np.split(order, cuts):
            if not len(part):
                continue
            left = Bitmap.of(codes[part]).andnot(parents)
            if len(left):
                found = keys.take(pa.array(left.codes()))
                use = pa.repeat(names[int(slot[part[0]])], len(found))
                yield pa.RecordBatch.from_arrays([found, use], names=["key", "use"])


def orphan_keys(uses: DataFrame, parents: DataFrame, removals: DataFrame) -> DataFrame:
    """Keys of `uses` (key, use) that have no living parent, one row per (key, use).

    parents (key, updated_at): a key lives when it occurs; removals (key, removed_at): gone when the latest removal is
    later than the latest update (a null updated_at counts as the earliest time, a null removed_at as no removal).
    Null keys are no references. Equal rows count once. Each input is combined on the map side, so a key that holds a
    third of all rows reaches the shuffle as one row per map task; nothing but distinct keys is shuffled.
    """
    none = F.lit(None)
    sides = [
        uses.select("key", none.cast("long").alias("u"), none.cast("long").alias("r"), F.col("use")),
        parents.select("key", F.coalesce(F.col("updated_at").cast("long"), F.lit(-(2**53))).alias("u"), none.cast("long").alias("r"), none.cast("string").alias("use")),
        removals.select("key", none.cast("long").alias("u"), F.col("removed_at").cast("long").alias("r"), none.cast("string").alias("use")),
    ]
    rows = reduce(DataFrame.union, sides).filter(F.col("key").isNotNull())
    keyed = rows.groupBy("key").agg(F.max("u").alias("u"), F.max("r").alias("r"), F.collect_set("use").alias("uses"))
    return keyed.mapInArrow(_orphans_of_batches, "key string, use string")


def month(c: str) -> Column:
    return F.coalesce(F.date_format(F.col(c), "yyyy-MM"), F.lit(""))


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """References (one row per record and column, repeats included), parents and removals."""
    e, u, n, r = (load(spark, sf_dir, t) for t in ("edges", "unresolved_refs", "nodes", "removed_nodes"))
    ends = e.select(
        month("loaded_at").alias("period"),
        F.col("id").cast("string").alias("record_id"),
        F.explode(F.array(F.struct(F.lit("source").alias("column_name"), F.col("source").alias("key")), F.struct(F.lit("target").alias("column_name"), F.col("target").alias("key")))).alias("x"),
    ).select(F.lit("edges").alias("table_name"), "x.column_name", "period", "record_id", "x.key")
    froms = u.select(F.lit("unresolved_refs").alias("table_name"), F.lit("from_node_id").alias("column_name"), month("loaded_at").alias("period"), F.col("id").alias("record_id"), F.col("from_node_id").alias("key"))
    refs = ends.unionByName(froms).filter(F.col("key").isNotNull())
    return refs, n.select(F.col("id").alias("key"), "updated_at"), r.select(F.col("node_id").alias("key"), "removed_at")


def _use(*cols: str) -> Column:
    return F.concat_ws("|", *cols)


def orphans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The references (with their use: table, column and period), and the surviving bits, decoded: (key, use), written."""
    refs, parents, removals = _inputs(spark, sf_dir)
    refs = refs.withColumn("use", _use("table_name", "column_name", "period"))
    return refs, Scratch(spark, "orphans").write(orphan_keys(refs.select("key", "use"), parents, removals))


def rows_of(refs: DataFrame, bad: DataFrame) -> DataFrame:
    """The reference rows behind the surviving bits: an equi-join on key and use."""
    size = bad.agg(F.sum(F.octet_length("key") + F.octet_length("use") + 16)).first()[0] or 0
    # the adaptive skew join splits a hot orphan key
    return refs.join(F.broadcast(bad) if size <= BROADCAST_BYTES else bad.hint("merge"), ["key", "use"], "left_semi")


def dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference row whose key has no living parent: table_name, column_name, period, record_id, key.

    A record stored twice gives its row twice. A reference without loaded_at has the period ''. Empty tables give no row.
    """
    return rows_of(*orphans(spark, sf_dir)).select("table_name", "column_name", "period", "record_id", "key")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p7_found: (table_name, column_name, record_id), each once."""
    return dangling(spark, sf_dir).select("table_name", "column_name", "record_id").distinct()


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangling references per table, column and month of loaded_at: distinct records, and distinct missing keys, which are
    the surviving bits of the period's bitmaps."""
    refs, bad = orphans(spark, sf_dir)
    rows = rows_of(refs, bad).select("table_name", "column_name", "period", "use", "key", "record_id").distinct()
    # per key first: no list of records is ever built, however many records share an orphan key
    per = rows.groupBy("table_name", "column_name", "period", "use", "key").agg(F.count("*").alias("n"))
    records = per.groupBy("table_name", "column_name", "period", "use").agg(F.sum("n").alias("n_records"))
    return records.join(bad.groupBy("use").agg(F.count("*").alias("n_keys")), "use").select("table_name", "column_name", "period", "n_records", "n_keys")
