"""Filling containers of fixed capacity with documents (problem 8): bulk-synchronous best fit.

Each superstep range-sorts the documents that are left and the gaps of the open containers by size, in one order over all
executors. A task sweeps its range upwards: a gap takes its predecessor, the largest document that is not larger. What a
task can't match is stitched over the borders by rank, as brackets are matched: gaps without a document in their own range
take the last documents left over from the ranges below. Gaps are updated and the step is repeated.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweft.sources.tables import Scratch, load, spread

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.tiktoken"
_encoders: dict[str, object] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    """A vocabulary file of the installed public tokenizers, or the path itself."""
    if "/" in name:
        return name
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return f"/opt/tokenizers/{name}"


def _encoder(path: str):
    """One encoder per Python worker and vocabulary file (ranks of byte pairs, the tiktoken text format)."""
    if path not in _encoders:
        import base64

        import tiktoken

        try:
            from public_tokenizers import PATTERN as pattern
        except ImportError:
            pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of each row of docs (doc_id, text): whole texts; null and empty texts have 0."""
    return spread(docs.select("doc_id", "text")).mapInArrow(_counts(tokenizer_path(tokenizer)), "doc_id long, n_tokens long")


# rows of a sweep: a document placed here; a document left over; a gap that took nothing; a gap that took something
PLACED, LEFT, BARE, MOVED = range(4)
_SWEPT = "part int, kind int, id long, other long, value long, rank long"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches the documents and gaps of one range. Columns in: part, value, is_gap, id, sorted by value, documents before
    gaps. Documents below the gap wait by size (at most as many sizes as the capacity); a gap takes the largest that fits,
    and again while one fits what remains. Rank: position among the rows of the kind."""
    waiting: dict[int, list[int]] = {}
    sizes: list[int] = []
    out: list[tuple] = []
    bare = part = 0
    names = [x.split()[0] for x in _SWEPT.split(", ")]
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    for b in batches:
        for part, value, is_gap, ident in zip(*(c.to_pylist() for c in b.columns)):
            if not is_gap:
                if value not in waiting:
                    waiting[value] = []
                    bisect.insort(sizes, value)
                waiting[value].append(ident)
                continue
            left = value
            while (at := bisect.bisect_right(sizes, left) - 1) >= 0:
                size = sizes[at]
                out.append((part, PLACED, waiting[size].pop(), ident, size, 0))
                if not waiting[size]:
                    del waiting[size]
                    sizes.pop(at)
                left -= size
            if left == value:
                out.append((part, BARE, ident, None, value, bare))
                bare += 1
            elif left:
                out.append((part, MOVED, ident, None, left, 0))
        if len(out) > 20_000:
            yield batch(out)
            out = []
    rank = 0
    for size in sizes:
        for ident in waiting[size]:
            out.append((part, LEFT, ident, None, size, rank))
            rank += 1
            if len(out) > 20_000:
                yield batch(out)
                out = []
    if out:
        yield batch(out)


def stitch(parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Bracket matching over the ranges. parts: (part, slots of its bare gaps, documents left over), in order of the ranges.

    Returns (part of the documents, first rank, ranks up to, part of the gaps, first slot): the documents of these ranks,
    last first, go into the slots from the first one on. At most two rows a range, whatever the number of documents."""
    stack: list[list[int]] = []
    spans = []
    for part, slots, docs in parts:
        at = 0
        while at < slots and stack:
            top = stack[-1]
            n = min(slots - at, top[1])
            spans.append((top[0], top[1] - n, top[1], part, at))
            top[1] -= n
            at += n
            if not top[1]:
                stack.pop()
        if docs:
            stack.append([part, docs])
    return spans


def _superstep(state: DataFrame, scratch: Scratch, capacity: int) -> tuple[DataFrame, DataFrame]:
    """One round over state (id, value, is_gap): the placements (item, container_id, size), and the next state."""
    from pyspark.sql import Window

    spark = state.sparkSession
    keys = ["value", "is_gap", "id"]  # the id splits a size that many documents or gaps share
    order = state.repartitionByRange(*keys).sortWithinPartitions(*keys)
    swept = scratch.write(order.select(F.spark_partition_id().alias("part"), "value", "is_gap", "id").mapInArrow(_sweep, _SWEPT))
    of = lambda kind: swept.filter(F.col("kind") == kind)
    placed = of(PLACED).select(F.col("id").alias("item"), F.col("other").alias("container_id"), F.col("value").alias("size"))
    moved = of(MOVED).select("id", "value", F.lit(True).alias("is_gap"))
    top = of(LEFT).agg(F.max("value")).first()[0]
    if top is None:
        return placed, moved.limit(0)
    # a bare gap offers as many slots as documents of the largest size left fit in, at least one
    bare = of(BARE).withColumn("slots", F.greatest(F.lit(1), F.floor(F.col("value") / top)))
    parts = bare.select("part", "slots", F.lit(0).alias("docs")).union(of(LEFT).select("part", F.lit(0), F.lit(1))).groupBy("part").agg(F.sum("slots"), F.sum("docs")).orderBy("part").collect()
    spans = stitch([tuple(r) for r in parts])
    left = of(LEFT)
    if not spans:
        return placed, left.select("id", "value", F.lit(False).alias("is_gap")).union(moved)
    taken: dict[int, int] = {}
    for _, lo, hi, part, at in spans:
        taken[part] = max(taken.get(part, 0), at + hi - lo)
    by_doc = spark.createDataFrame(spans, "part int, lo long, hi long, gap_part int, at long").groupBy("part").agg(F.collect_list(F.struct("lo", "hi", "gap_part", "at")).alias("spans"))
    span = F.try_element_at(F.filter("spans", lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") < x["hi"])), F.lit(1))
    left = left.join(F.broadcast(by_doc), "part", "left").withColumn("x", span)  # at most two spans a range
    docs = left.select("id", "value", F.col("x.gap_part").alias("part"), (F.col("x.at") + F.col("x.hi") - 1 - F.col("rank")).alias("slot"))
    used = spark.createDataFrame(list(taken.items()), "part int, taken long")
    upto = Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    gaps = bare.join(F.broadcast(used), "part").withColumn("first", F.coalesce(F.sum("slots").over(upto), F.lit(0))).filter("first < taken")
    slots = gaps.select("part", F.col("id").alias("container_id"), "value", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + F.col("slots"), F.col("taken")) - 1)).alias("slot"))
    pairs = scratch.write(docs.filter("slot is not null").withColumnsRenamed({"id": "item", "value": "size"}).join(slots, ["part", "slot"]).select("item", "container_id", "size", "value"))
    rest = pairs.groupBy(F.col("container_id").alias("id")).agg((F.min("value") - F.sum("size")).alias("value")).filter("value > 0").withColumn("is_gap", F.lit(True))
    # a bare gap that got nothing is closed: every document that fits in it has a place by now
    return placed.union(pairs.select("item", "container_id", "size")), docs.filter("slot is null").select("id", "value", F.lit(False).alias("is_gap")).union(moved).union(rest)


def pack(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """container_id, doc_id, piece_no, first_token, n_tokens: every row of counts (doc_id, n_tokens) once, uncut unless it
    is larger than the capacity.

    A larger document is cut into full containers of its own and a rest, which is an item like any other. Documents of 0
    tokens lie in the containers with the others, spread evenly (in container 0 where there is no other). A null count is
    0; repeated rows are packed again. Containers are numbered from 0. Which documents share one depends on the ranges of
    the sort, so on the number of partitions.
    """
    spark = counts.sparkSession
    scratch = Scratch(spark, "packing")
    n = F.coalesce("n_tokens", F.lit(0))
    cut = F.floor(n / capacity)
    long_ = n > capacity
    items = counts.select("doc_id", n.alias("n_tokens"), F.when(long_, n - cut * capacity).otherwise(n).alias("size"), F.when(long_, cut).otherwise(F.lit(0)).cast("long").alias("full"), F.monotonically_increasing_id().alias("item"))
    items = scratch.write(items)  # tokenised once; the id of an item is fixed here
    total, whole = items.agg(F.sum("size"), F.sum("full")).first()
    docs = items.filter("size > 0").select(F.col("item").alias("id"), F.col("size").alias("value"), F.lit(False).alias("is_gap"))
    placed: DataFrame | None = None
    opened, state, rest = 0, docs, total or 0
    while rest:
        # the fewest containers that can hold what is left; they are only opened when no gap is open
        fresh = -(-rest // capacity)
        state = state.union(spark.range(opened, opened + fresh).select("id", F.lit(capacity).cast("long").alias("value"), F.lit(True).alias("is_gap")))
        opened += fresh
        while True:
            done, state = _superstep(state, scratch, capacity)
            placed = done if placed is None else placed.union(done)
            state = scratch.write(state)
            size = state.groupBy("is_gap").agg(F.sum("value"), F.min("value"), F.count("*")).collect()
            left = {r[0]: r for r in size}
            rest = left[False][1] if False in left else 0
            if not rest:
                break
            least = left[False][2]
            if True in left:
                state = state.filter(~F.col("is_gap") | (F.col("value") >= least))
            if True not in left or state.filter("is_gap").isEmpty():
                state = state.filter("not is_gap")
                break
    out = None
    if placed is not None:
        out = items.join(placed.select("item", "container_id"), "item").select("container_id", "doc_id", F.col("full").alias("piece_no"), (F.col("full") * capacity).alias("first_token"), F.col("size").alias("n_tokens"))
    zero = F.lit(0).cast("long")
    none = items.filter("n_tokens = 0").select(F.pmod(F.xxhash64("item"), F.lit(max(1, opened))).alias("container_id"), "doc_id", zero.alias("piece_no"), zero.alias("first_token"), zero.alias("n_tokens"))
    out = none if out is None else out.unionByName(none)
    if whole:
        # full containers of long documents: numbered behind the others by a running sum over ranges of the item
        longs = scratch.write(items.filter("full > 0").select("doc_id", "full", "item").repartitionByRange("item").sortWithinPartitions("item").withColumn("p", F.spark_partition_id()))
        sums = longs.groupBy("p").agg(F.sum("full").alias("s")).orderBy("p").collect()  # one row per partition
        at, base = opened, []
        for r in sums:
            base.append((r["p"], at))
            at += r["s"]
        from pyspark.sql import Window

        w = Window.partitionBy("p").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
        longs = longs.withColumn("before", F.coalesce(F.sum("full").over(w), F.lit(0))).join(F.broadcast(spark.createDataFrame(base, "p int, base long")), "p")
        pieces = longs.select("doc_id", (F.col("base") + F.col("before")).alias("c"), F.explode(F.sequence(zero, F.col("full") - 1)).alias("piece_no"))
        out = out.unionByName(pieces.select((F.col("c") + F.col("piece_no")).alias("container_id"), "doc_id", "piece_no", (F.col("piece_no") * capacity).alias("first_token"), F.lit(capacity).cast("long").alias("n_tokens")))
    return out


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_containers: all documents in containers of 2,048 tokens."""
    return pack(token_counts(load(spark, sf_dir, "documents")))


def fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of their space that is used."""
    by = packed(spark, sf_dir).groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return by.agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.round(F.sum("used") / F.count("*") / CAPACITY, 6).alias("fill"), F.max("used").alias("fullest"))
