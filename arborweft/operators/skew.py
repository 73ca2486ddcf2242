"""Per-key results when a few keys hold most rows: range partitions that split heavy keys, stitched at their borders (problem 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweft.sources.tables import Scratch, load

_PART = "part int, run int, edge boolean, key string, n long, first_at long, last_at long, last_id string, max_gap long, kinds array<struct<kind:string,n:long>>"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial state per run of equal keys in a sorted partition. Columns: part, key, at (micros, nulls first), id, kind."""
    open_: dict | None = None
    run = 0
    done: list[dict] = []

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal done
        if done:
            schema = pa.schema([("part", pa.int32()), ("run", pa.int32()), ("edge", pa.bool_()), ("key", pa.string()), ("n", pa.int64()), ("first_at", pa.int64()), ("last_at", pa.int64()), ("last_id", pa.string()), ("max_gap", pa.int64()), ("kinds", pa.list_(pa.struct([("kind", pa.string()), ("n", pa.int64())])))])
            rows = [{**s, "kinds": [{"kind": k, "n": n} for k, n in sorted(s["kinds"].items())]} for s in done]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            done = []

    for b in batches:
        if not b.num_rows:
            continue
        part = b.column(0)[0].as_py()
        key, ids = b.column(1), b.column(3)
        at = b.column(2)
        known = pc.is_valid(at).to_numpy(zero_copy_only=False)
        t = at.fill_null(0).to_numpy()
        code = key.dictionary_encode().indices.fill_null(-1).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1, [b.num_rows]])
        kinds = b.column(4).dictionary_encode()
        kname, kcode = kinds.dictionary.to_pylist(), kinds.indices.to_numpy()
        gaps = np.diff(t)
        gap_ok = known[1:] & known[:-1]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            k = key[int(lo)].as_py()
            if open_ is None or open_["key"] != k:
                if open_ is not None:
                    done.append(open_)
                    run += 1
                open_ = {"part": part, "run": run, "edge": run == 0, "key": k, "n": 0, "first_at": None, "last_at": None, "last_id": None, "max_gap": None, "kinds": {}}
            seen = np.flatnonzero(known[lo:hi])
            if len(seen):
                f, l = int(t[lo + seen[0]]), int(t[lo + seen[-1]])
                if open_["last_at"] is not None:
                    open_["max_gap"] = max(open_["max_gap"] or 0, f - open_["last_at"])
                elif open_["first_at"] is None:
                    open_["first_at"] = f
                inner = gaps[lo : hi - 1][gap_ok[lo : hi - 1]]
                if len(inner):
                    open_["max_gap"] = max(open_["max_gap"] or 0, int(inner.max()))
                open_["last_at"] = l
            open_["n"] += int(hi - lo)
            open_["last_id"] = ids[int(hi - 1)].as_py()
            for c, m in enumerate(np.bincount(kcode[lo:hi], minlength=len(kname))):
                if m:
                    open_["kinds"][kname[c]] = open_["kinds"].get(kname[c], 0) + int(m)
        if len(done) >= 20_000:
            yield from flush(False)
    if open_ is not None:
        open_["edge"] = True
        done.append(open_)
    yield from flush(True)


def per_key(rows: DataFrame, key: Column, at: Column, ident: Column, kind: Column, label: str = "skew") -> DataFrame:
    """One row per key: n_rows, first_at, last_at (micros), last_id, max_gap_us, kinds (map kind -> rows).

    The latest row has the greatest (at, id). max_gap_us is the longest wait between neighbouring rows of a key, so the
    result depends on row order across the whole key. Rows are range-partitioned on (key, at, id, row number) by sampled
    quantiles: a heavy key, even one made of equal rows, spreads over as many partitions as it needs. Only the first and
    last run of each partition can continue elsewhere; those few partial states are stitched, all others are final.
    Null keys form the key null; a null time sorts first and takes part in no gap; a null kind counts as ''.
    """
    spark = rows.sparkSession
    flat = rows.select(
        key.cast("string").alias("key"), F.unix_micros(at.cast("timestamp")).alias("at"), ident.cast("string").alias("id"), F.coalesce(kind.cast("string"), F.lit("")).alias("kind")
    ).withColumn("seq", F.monotonically_increasing_id())
    order = [F.col("key").asc_nulls_first(), F.col("at").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("seq")]
    spread = flat.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = spread.select(F.spark_partition_id().alias("part"), "key", "at", "id", "kind").mapInArrow(_runs, _PART)
    scratch = Scratch(spark, label)
    parts = scratch.write(parts)
    shape = ["key", "n_rows", "first_at", "last_at", "last_id", "max_gap_us", "kinds"]
    as_map = lambda c: F.map_from_entries(c)
    whole = parts.filter(~F.col("edge")).select("key", F.col("n").alias("n_rows"), "first_at", "last_at", "last_id", F.col("max_gap").alias("max_gap_us"), as_map("kinds").alias("kinds")).toDF(*shape)
    pieces = parts.filter("edge").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "run", "n", "first_at", "last_at", "last_id", "max_gap", "kinds"))).alias("p"))
    wait = F.array_max(F.transform(F.sequence(F.lit(1), F.size("timed") - 1), lambda i: F.element_at("timed", i + 1)["first_at"] - F.element_at("timed", i)["last_at"]))
    merged = F.aggregate(
        F.flatten(F.transform("p", lambda s: s["kinds"])),
        F.create_map().cast("map<string,long>"),
        lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, v: k != x["kind"]), F.create_map(x["kind"], F.coalesce(F.try_element_at(acc, x["kind"]), F.lit(0)) + x["n"])),
    )
    stitched = (
        pieces.withColumn("timed", F.filter("p", lambda s: s["first_at"].isNotNull()))
        .select(
            "key",
            F.aggregate("p", F.lit(0).cast("long"), lambda a, s: a + s["n"]).alias("n_rows"),
            F.array_min(F.transform("timed", lambda s: s["first_at"])).alias("first_at"),
            F.array_max(F.transform("timed", lambda s: s["last_at"])).alias("last_at"),
            F.element_at("p", -1)["last_id"].alias("last_id"),
            F.greatest(F.array_max(F.transform("p", lambda s: s["max_gap"])), F.when(F.size("timed") > 1, wait)).alias("max_gap_us"),
            merged.alias("kinds"),
        )
        .toDF(*shape)
    )
    return whole.unionByName(stitched)


def target_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "edges")
    return per_key(e, F.col("target"), F.col("loaded_at"), F.col("id"), F.col("kind"), "skew-edges")


def file_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nodes")
    return per_key(n, F.col("file_path"), F.timestamp_seconds("updated_at"), F.col("id"), F.col("kind"), "skew-nodes")


def flat(results: DataFrame) -> DataFrame:
    """The per-key results with plain columns: the kinds as 'kind=n' text in order of kind."""
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("kinds")), lambda s: F.concat(s["key"], F.lit("="), s["value"].cast("string"))), ",")
    return results.select("key", "n_rows", "first_at", "last_at", "last_id", "max_gap_us", kinds.alias("kinds"))


def found(spark: SparkSession, sf_dir: str, share: float = 0.02) -> DataFrame:
    """p2_found: the values that more than `share` of all rows of their table hold. Null is no value."""
    out = None
    for table, res in (("edges", target_results(spark, sf_dir)), ("nodes", file_results(spark, sf_dir))):
        total = res.agg(F.sum("n_rows")).first()[0] or 0  # one number
        hot = res.filter(F.col("key").isNotNull() & (F.col("n_rows") > share * total)).select(F.lit(table).alias("table_name"), F.col("key").alias("key_value"))
        out = hot if out is None else out.unionByName(hot)
    return out
