"""The message bus: envelopes in rooms, as batch plans and as Structured Streaming queries with the same results.

Envelopes come from the events table: room = event_type, sender = user_id, ts in whole seconds, text = props; value below
2 halts a room, below 4 resumes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborweft.sources.tables import Scratch, load

# Limits of an envelope; seconds until a silent member is stale.
MAX_TEXT, MAX_NAME, MAX_TO, MAX_TO_BYTES, STALE_AFTER = 1 << 20, 128, 16, 256, 600
ENVELOPE = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("room", T.StringType()), ("sender", T.StringType()), ("ts", T.LongType()), ("text", T.StringType()), ("control", T.StringType()), ("recipients", T.ArrayType(T.StringType())))])


def envelopes(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    v = F.col("value")
    return events.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("room"), F.col("user_id").cast("string").alias("sender"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.col("props").alias("text"),
        F.when(v < 2, "halt").when(v < 4, "resume").alias("control"), F.when(k.cast("int") % 4 == 0, F.array(k)).otherwise(F.array().cast("array<string>")).alias("recipients"),
    )


def of(spark: SparkSession, d: str) -> DataFrame:
    return envelopes(load(spark, d, "events"))


def problems(env: DataFrame) -> DataFrame:
    """(id, problem) of envelopes beyond a limit; each limit is a row of its own."""
    to = F.coalesce("recipients", F.array().cast("array<string>"))
    checks = {
        "text too long": F.octet_length("text") > MAX_TEXT, "no sender": F.coalesce("sender", F.lit("")) == "", "name too long": F.octet_length("sender") > MAX_NAME,
        "too many recipients": F.size(to) > MAX_TO, "recipients too long": F.aggregate(to, F.lit(0), lambda a, x: a + F.octet_length(x)) > MAX_TO_BYTES, "no text": F.coalesce("text", F.lit("")) == "",
    }
    return env.select("id", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())).alias("problem"))


def rooms(env: DataFrame) -> DataFrame:
    """Per room messages, members and the last time."""
    per = env.groupBy("room", "sender").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return per.groupBy("room").agg(F.sum("n").alias("n_messages"), F.count("*").alias("n_members"), F.max("last").alias("last_ts"))


def who(env: DataFrame, now: int | None = None) -> DataFrame:
    """Members with their last sign and whether they are stale (more than ten minutes before `now`, default the last
    message of all)."""
    if now is None:
        now = env.agg(F.max("ts")).first()[0] or 0
    return env.groupBy("room", "sender").agg(F.max("ts").alias("last_seen")).withColumn("stale", F.lit(now) - F.col("last_seen") > STALE_AFTER)


def last_wins(env: DataFrame) -> DataFrame:
    """Of the envelopes that share an id the last one in the log (ties: the greatest text); null ids are no envelopes."""
    return env.filter("id is not null").groupBy("id").agg(F.max(F.struct("ts", "text", "room", "sender")).alias("m")).select("id", "m.room", "m.sender", "m.ts", "m.text")


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns part, room, ts, id, control of a sorted partition; adds the last control of the room so far, if seen here."""
    room, state = None, None
    for b in batches:
        out = []
        for r, c in zip(b.column(1).to_pylist(), b.column(4).to_pylist()):
            if r != room:
                room, state = r, None
            state = c or state
            out.append(state)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "seen"])


def halted(env: DataFrame) -> DataFrame:
    """(id, room, halted): the state of the room at each message: the latest control up to and with it, by time and id.

    An as-of lookup over few rooms: rows are range-partitioned on (room, ts, id), so a room with a third of all messages
    fills many tasks; what a task has not seen yet comes from the last control of the room's earlier partitions, a table of
    at most one row per room and partition."""
    spark = env.sparkSession
    scratch = Scratch(spark, "halted")
    keys = ["room", "ts", "id"]
    srt = env.select(*keys, "control").repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    rows = scratch.write(srt.select("part", "room", "ts", "id", "control").mapInArrow(_carry, "part int, room string, ts long, id long, control string, seen string"))
    ends = rows.groupBy("room", "part").agg(F.max(F.when(F.col("seen").isNotNull(), F.struct("ts", "id", "seen"))).alias("m")).groupBy("room").agg(F.array_sort(F.collect_list(F.struct("part", F.col("m.seen").alias("seen")))).alias("ends"))
    cut = ends.select("room", F.explode(F.transform("ends", lambda e: e["part"])).alias("part"), "ends").select("room", "part", F.try_element_at(F.filter("ends", lambda x: (x["part"] < F.col("part")) & x["seen"].isNotNull()), F.lit(-1))["seen"].alias("earlier"))
    j = rows.join(cut, ["room", "part"], "left")
    return j.select("id", "room", (F.coalesce("seen", "earlier") == "halt").alias("h")).select("id", "room", F.coalesce("h", F.lit(False)).alias("halted"))


def addressees(env: DataFrame) -> DataFrame:
    """(id, named, resolved, outcome) per addressed name: an exact member of the room, else the only member whose name
    holds it, else passed through; several make the message ambiguous. Members are distinct per room; names meet them by
    an equi-join on room and the parts of the member's name that have the length of a name asked for there."""
    ask = env.filter(F.size("recipients") > 0).select("id", "room", F.explode("recipients").alias("named"))
    m = env.select("room", F.col("sender").alias("member")).filter("member is not null").distinct()
    # only parts as long as some name that is asked for in the room
    sizes = ask.select("room", F.length("named").alias("n")).distinct().groupBy("room").agg(F.collect_set("n").alias("sizes"))
    m = m.join(sizes, "room")
    n = F.length("member")
    parts = lambda k: F.when((k > 0) & (k <= n), F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col("member"), i, k))).otherwise(F.array().cast("array<string>"))
    subs = F.array_distinct(F.flatten(F.transform("sizes", parts)))
    per = m.select("room", "member", F.explode(subs).alias("named")).groupBy("room", "named").agg(F.count("*").alias("n"), F.min("member").alias("only"), F.max((F.col("member") == F.col("named"))).alias("exact"))
    j = ask.join(per, ["room", "named"], "left")
    out = F.when(F.col("exact"), "exact").when(F.col("n") == 1, "unique").when(F.col("n") > 1, "ambiguous").otherwise("passed")
    return j.select("id", "named", F.when(F.col("exact"), F.col("named")).when(F.col("n") == 1, F.col("only")).alias("resolved"), out.alias("outcome"))


# --- streaming --------------------------------------------------------------------------------------------------------


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """Envelopes as they arrive as JSON lines in a folder (S13's log); malformed lines become rows without an id and go."""
    return spark.readStream.schema(ENVELOPE).option("mode", "PERMISSIVE").json(folder).filter("id is not null")


def write_log(env: DataFrame, folder: str) -> None:
    """Append envelopes to the log of their room."""
    env.write.mode("append").json(folder)


def run(df: DataFrame, folder: str, mode: str) -> DataFrame:
    """Process everything there is and return what the sink holds, as a table in the shared folder.

    Each micro-batch is written under its number, so a batch that is tried again replaces itself. In complete mode the last
    batch is the result; in append mode all of them are. Started again on the same folder, it goes on from its checkpoint."""
    spark = df.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    q = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    fields = T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], df.schema)
    out = spark.read.schema(fields).parquet(f"{folder}/out")
    if mode == "complete":
        last = out.agg(F.max("batch")).first()[0]
        out = out.filter(F.col("batch") == (-1 if last is None else last))
    return out.drop("batch")


def stream_rooms(env: DataFrame) -> DataFrame:
    """B9 as a running aggregation."""
    return env.groupBy("room").agg(F.count("*").alias("n_messages"), F.max("ts").alias("last_ts"))


def stream_who(env: DataFrame) -> DataFrame:
    """B8, B13 as a running aggregation: the state store holds one row per room and member."""
    return env.groupBy("room", "sender").agg(F.max("ts").alias("last_seen"))


def stream_unique(env: DataFrame, late: str = "1 day") -> DataFrame:
    """Each id once, within a watermark, so the state stays bounded."""
    return env.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])


def stream_tail(env: DataFrame, sender: str | None = None) -> DataFrame:
    """Addressed messages, optionally of one sender."""
    out = env.filter(F.size("recipients") > 0)
    return out.filter(F.col("sender") == sender) if sender else out


def change_event(changed: DataFrame, key: str, most: int = 100) -> DataFrame:
    """Per key the number of changed paths (key, path), and the list where there are no more than `most`."""
    n = changed.groupBy(key).agg(F.count("*").alias("n_changed"))
    few = changed.join(n.filter(F.col("n_changed") <= most).select(key), key).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"))
    return n.join(few, key, "left")


def stream_changes(env: DataFrame, sink):
    """Hand each micro-batch's rooms to a function (exactly once per batch number)."""
    return env.writeStream.foreachBatch(lambda df, n: sink(n, rooms(df)))
