"""Rebuilding conversations from message rows (problem 4).

Rows are brought into order by a range partition over (session, instant, arrival), so that one session, however large,
spreads over many tasks; each task reports partial states per session and the states are stitched in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweft.sources.tables import Scratch, load

_TS = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
_BLANK = r"^[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*$"


def instant(ts: Column) -> Column:
    """The instant of an RFC 3339 text, null where it can't be read as one."""
    t = F.trim(ts)
    return F.when(t.rlike(_TS), F.upper(t).try_cast("timestamp"))


def speaker(role: Column, entry_type: Column) -> Column:
    """user, assistant, or null for an unknown role; a null or blank role is told by entry_type."""
    r = F.lower(F.trim(role))
    r = F.when(role.isNull() | role.rlike(_BLANK), F.lower(entry_type)).otherwise(r)
    return F.when(r.isin("user", "human"), "user").when(r.isin("assistant", "agent"), "assistant")


def has_content(text: Column, blocks: Column) -> Column:
    full = F.coalesce(~text.rlike(_BLANK), F.lit(False))
    parsed = F.from_json(blocks, "array<struct<type:string,text:string>>")
    some = F.exists(parsed, lambda b: b.isNotNull() & ~(F.coalesce(b["type"] == "text", F.lit(False)) & F.coalesce(b["text"].rlike(_BLANK), F.lit(True))))
    return full | F.coalesce(some, F.lit(False))


def messages(entries: DataFrame) -> DataFrame:
    """The rows that count: session_id, entry_id, line_no, at, role, text. Per entry_id the latest loaded_at (ties: the
    greatest line_no, ts, text); a null entry_id never equals another. Null session_id is no session; null sidechain is
    not false. at is null for an unreadable ts, role is null for an unknown one."""
    cols = ("session_id", "line_no", "entry_type", "role", "ts", "sidechain", "text", "blocks", "loaded_at")
    rows = entries.select(F.coalesce("entry_id", F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))).alias("entry_id"), *cols)
    none = lambda c: F.coalesce(c, F.lit(""))
    pick = F.max(F.struct("loaded_at", "line_no", none("ts").alias("t"), none("text").alias("x"), none("blocks").alias("b"), F.struct(*[c for c in cols if c != "loaded_at"]).alias("v")))
    last = rows.groupBy("entry_id").agg(pick.alias("x")).select("entry_id", "x.v.*")
    return last.filter(F.col("session_id").isNotNull() & F.col("entry_type").isin("user", "assistant") & (F.col("sidechain") == F.lit(False)) & has_content(F.col("text"), F.col("blocks"))).select(
        "session_id", "entry_id", "line_no", instant(F.col("ts")).alias("at"), speaker(F.col("role"), F.col("entry_type")).alias("role"), "text"
    )


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run of a session in a sorted partition: part, session_id, n, first, last, bad. Columns in: part, session_id, at, role."""
    schema = pa.schema([("part", pa.int32()), ("session_id", pa.string()), ("n", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("bad", pa.bool_())])
    cur, out = None, []
    for b in batches:
        for part, s, at, role in zip(*(c.to_pylist() for c in b.columns)):
            if cur is None or cur["session_id"] != s:
                if cur:
                    out.append(cur)
                cur = {"part": part, "session_id": s, "n": 0, "first": role, "last": None, "bad": False}
            cur["bad"] |= at is None or role is None or (cur["last"] == "user" and role != "assistant")
            cur["n"] += 1
            cur["last"] = role
        if len(out) > 20_000:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if cur:
        out.append(cur)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _ordered(msgs: DataFrame) -> DataFrame:
    keys = [F.col("session_id"), F.col("at").asc_nulls_first(), F.col("line_no").asc_nulls_first(), F.col("entry_id")]
    return msgs.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())


def judge(entries: DataFrame) -> DataFrame:
    """session_id, n_messages, whole: one row per session that any row names. Whole: at least one message; every instant
    and role readable; the first message is the user's; each message of the user is directly followed by the assistant's
    (the last one too). Equal instants keep the order of arrival. This is the constraint system of replies with all
    clocks taken as they are: a session is whole exactly when it is feasible."""
    every = entries.filter("session_id is not null").select("session_id").distinct()
    return _whole_of(_ordered(messages(entries).select("session_id", "at", "line_no", "entry_id", "role")), every)


def _whole_of(msgs: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """The judgement over ordered messages; sessions of `every` without a message are broken."""
    states = msgs.select("part", "session_id", "at", "role").mapInArrow(_states, "part int, session_id string, n long, first string, last string, bad boolean")
    none = [F.lit(-1).alias("part"), "session_id", F.lit(0).cast("long").alias("n"), *(F.lit(None).cast("string").alias(c) for c in ("first", "last")), F.lit(False).alias("bad")]
    by = (states if every is None else states.union(every.select(*none))).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("part", "n", "first", "last", "bad"))).alias("p"))
    # at most one state per session and partition: p is short even for a session that fills many partitions
    p = by.withColumn("p", F.filter("p", lambda x: x["n"] > 0))
    seam = F.exists(F.sequence(F.lit(2), F.size("p")), lambda i: (F.element_at("p", i - 1)["last"] == "user") & ~F.element_at("p", i)["first"].eqNullSafe(F.lit("assistant")))
    whole = (F.size("p") > 0) & ~F.exists("p", lambda x: x["bad"]) & (F.try_element_at("p", F.lit(1))["first"] == "user") & (F.try_element_at("p", F.lit(-1))["last"] == "assistant") & ~F.when(F.size("p") > 1, seam).otherwise(F.lit(False))
    return p.select("session_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_messages"), F.coalesce(whole, F.lit(False)).alias("whole"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_found: sessions that form no whole conversation."""
    return judge(load(spark, sf_dir, "transcript_entries")).filter("not whole").select("session_id")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the position within the session's run of this partition."""
    session, n = None, 0
    for b in batches:
        out = []
        for s in b.column(1).to_pylist():
            session, n = s, 1 if s != session else n + 1
            out.append(n)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "local_no"])


def turns(entries: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """session_id, turn_no, role, at, entry_id, text: the ordered messages of the whole conversations."""
    spark = entries.sparkSession
    scratch = Scratch(spark, "turns")
    msgs = _ordered(messages(entries).filter("at is not null and role is not null")).select("part", "session_id", "role", "at", "entry_id", "text")
    schema = "part int, session_id string, role string, at timestamp, entry_id string, text string, local_no long"
    rows = scratch.write(msgs.mapInArrow(_numbered, schema))
    # only sessions cut by a partition border need an offset: at most two for each partition
    runs = rows.groupBy("session_id", "part").agg(F.max("local_no").alias("n"))
    cut = runs.groupBy("session_id").agg(F.collect_list(F.struct("part", "n")).alias("r")).filter(F.size("r") > 1)
    offsets = cut.select("session_id", F.explode(F.transform("r", lambda x: F.struct(x["part"].alias("part"), F.aggregate(F.filter("r", lambda y: y["part"] < x["part"]), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("skip")))).alias("o")).select("session_id", "o.part", "o.skip")
    whole = (keep if keep is not None else judge(entries)).filter("whole").select("session_id")
    done = rows.join(F.broadcast(offsets), ["session_id", "part"], "left").join(whole, "session_id", "left_semi")
    return done.select("session_id", (F.col("local_no") + F.coalesce("skip", F.lit(0))).alias("turn_no"), "role", "at", "entry_id", "text")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of different roles in a sorted partition, and with edge 0 and 1 its first and last row. Columns in: part,
    session_id, role, t."""
    names, types = ("part", "session_id", "edge", "role", "t", "role0", "t0"), (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64())
    schema = pa.schema([*zip(names, types)])
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), types)], schema=schema)
    last = None
    for b in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in b.columns)):
            part, session, role, t = row
            if last is None:
                out.append((part, session, 0, role, t, None, None))
            elif last[1] == session and last[2] != role:
                out.append((part, session, None, role, t, last[2], last[3]))
            last = row
        if out:
            yield batch(out)
    if last:
        yield batch([(*last[:2], 1, *last[2:], None, None)])


def _least_squares(bounds: DataFrame, scratch: Scratch) -> DataFrame:
    """session_id, x: where the sum of squared violations of the bounds (session_id, lower, b) is least. For sessions whose
    bounds contradict each other: then at least one bound is violated everywhere and x is unique.

    Half the derivative at x is the sum of x - b over the violated bounds (lower ones above x, upper ones below). It grows
    with x, so x follows the last bound where it is not positive, and is the mean of the bounds violated right of that one.
    The sums up to each bound are made per range of (session, bound) and stitched, so one session may fill many tasks."""
    from pyspark.sql import Window

    times = lambda n, b: F.col(n).cast("decimal(18,0)") * F.col(b).cast("decimal(20,0)")
    points = bounds.groupBy("session_id", "b").agg(F.sum(F.when(F.col("lower"), -1).otherwise(1)).alias("w"), F.count(F.when(F.col("lower"), 1)).alias("n_low"))
    points = scratch.write(points.repartitionByRange("session_id", "b").withColumn("part", F.spark_partition_id()))
    runs = points.groupBy("session_id", "part").agg(F.sum("w").alias("w"), F.sum(times("w", "b")).alias("wb"), F.sum("n_low").alias("n_low"), F.sum(times("n_low", "b")).alias("low"))
    # one row per session and partition; left of all bounds, the lower ones are the violated ones
    of = Window.partitionBy("session_id")
    above = of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = runs.select("session_id", "part", (F.sum("n_low").over(of) + F.coalesce(F.sum("w").over(above), F.lit(0))).alias("n0"), (F.sum("low").over(of) + F.coalesce(F.sum("wb").over(above), F.lit(0))).alias("s0"))
    upto = Window.partitionBy("session_id", "part").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = points.join(start, ["session_id", "part"]).select("session_id", "b", (F.col("n0") + F.sum("w").over(upto)).alias("n"), (F.col("s0") + F.sum(times("w", "b")).over(upto)).alias("s"))
    last = sums.filter(times("n", "b") <= F.col("s")).groupBy("session_id").agg(F.max(F.struct("b", "n", "s")).alias("p"))
    return last.select("session_id", (F.col("p.s").cast("double") / F.col("p.n")).alias("x"))


def clock_offsets(entries: DataFrame) -> DataFrame:
    """session_id, n_pairs, lowest_s, highest_s, offset_s, feasible: the offset of the assistant's clock to the user's.

    Neighbours in order of arrival give constraints: an assistant's row after a user's row must not be earlier, and the
    other way round, so the offset lies between lowest_s and highest_s. offset_s is the least-squares answer: where the
    constraints contradict each other, the offset with the least sum of squared violations over all of them; else none is
    violated between the two bounds, and it is the point there nearest to 0. Sessions without such neighbours have no row."""
    from pyspark.sql import Window

    scratch = Scratch(entries.sparkSession, "clocks")
    m = messages(entries).filter("at is not null and role is not null").select("session_id", "line_no", "entry_id", "role", F.unix_micros("at").alias("t"))
    keys = [F.col("session_id"), F.col("line_no").asc_nulls_first(), F.col("entry_id")]
    m = m.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    n = scratch.write(m.select("part", "session_id", "role", "t").mapInArrow(_neighbours, "part int, session_id string, edge int, role string, t long, role0 string, t0 long"))
    # a session goes on from the last row of a partition to the first row of the next: two rows for each partition
    w = Window.partitionBy("session_id").orderBy("part", "edge")
    rim = n.filter("edge is not null").select("session_id", "edge", "role", "t", F.lag("role").over(w).alias("role0"), F.lag("t").over(w).alias("t0"))
    pairs = n.filter("edge is null").select("session_id", "role", "t", "t0").union(rim.filter("edge = 0 and role <> role0").select("session_id", "role", "t", "t0"))
    lower = F.col("role") == "assistant"
    bounds = scratch.write(pairs.select("session_id", lower.alias("lower"), F.when(lower, F.col("t0") - F.col("t")).otherwise(F.col("t") - F.col("t0")).alias("b")))
    by = bounds.groupBy("session_id").agg(F.count("*").alias("n_pairs"), F.max(F.when(F.col("lower"), F.col("b"))).alias("lo"), F.min(F.when(~F.col("lower"), F.col("b"))).alias("hi"))
    by = scratch.write(by)
    # the answer lies between hi and lo there: bounds that hold over all of that stretch have no say
    torn = by.filter("lo > hi").select("session_id", "lo", "hi")
    say = bounds.join(torn, "session_id").filter(F.when(F.col("lower"), F.col("b") > F.col("hi")).otherwise(F.col("b") < F.col("lo")))
    x = _least_squares(say.select("session_id", "lower", "b"), scratch)
    s = lambda c: F.col(c) / 1e6
    offset = F.when(F.col("x").isNotNull(), s("x")).when(F.col("lo") > 0, s("lo")).when(F.col("hi") < 0, s("hi")).otherwise(F.lit(0.0))
    return by.join(x, "session_id", "left").select("session_id", "n_pairs", s("lo").alias("lowest_s"), s("hi").alias("highest_s"), offset.alias("offset_s"), F.coalesce(F.col("lo") <= F.col("hi"), F.lit(True)).alias("feasible"))


def corrected(entries: DataFrame) -> DataFrame:
    """session_id, offset_s, feasible, whole, whole_corrected: each session with reply constraints, judged as it stands and with
    the assistant's clock put right by the least-squares offset of clock_offsets. Sessions with a row whose instant or role
    can't be read stay broken either way."""
    off = Scratch(entries.sparkSession, "offsets").write(clock_offsets(entries).select("session_id", "offset_s", "feasible"))
    msgs = messages(entries).select("session_id", "at", "line_no", "entry_id", "role")
    moved = msgs.join(off.filter("offset_s <> 0").select("session_id", "offset_s"), "session_id")
    shift = F.when(F.col("role") == "assistant", F.timestamp_micros(F.unix_micros("at") + F.round(F.col("offset_s") * 1e6).cast("long"))).otherwise(F.col("at"))
    put = _whole_of(_ordered(moved.withColumn("at", shift).drop("offset_s"))).select("session_id", F.col("whole").alias("after"))
    was = _whole_of(_ordered(msgs.join(off.select("session_id"), "session_id", "left_semi"))).select("session_id", "whole")
    return off.join(was, "session_id").join(put, "session_id", "left").select("session_id", "offset_s", "feasible", "whole", F.coalesce("after", "whole").alias("whole_corrected"))


def correction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_corrections: how many sessions are whole as they stand and with corrected clocks."""
    c = corrected(load(spark, sf_dir, "transcript_entries"))
    return c.groupBy("feasible", "whole", "whole_corrected").agg(F.count("*").alias("n_sessions"))


_MESSAGES_SQL = r"""WITH last AS (SELECT * FROM transcript_entries QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY loaded_at DESC NULLS LAST, line_no DESC NULLS LAST, coalesce(ts, '') DESC, coalesce(text, '') DESC, coalesce(blocks, '') DESC) = 1),
m AS (SELECT session_id, entry_id, line_no, text,
 CASE WHEN regexp_full_match(trim(ts), '\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})') THEN TRY_CAST(upper(trim(ts)) AS TIMESTAMPTZ) END AS at_,
 CASE CASE WHEN role IS NULL OR trim(role) = '' THEN lower(entry_type) ELSE lower(trim(role)) END WHEN 'user' THEN 'user' WHEN 'human' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'agent' THEN 'assistant' END AS who
 FROM last WHERE session_id IS NOT NULL AND entry_type IN ('user', 'assistant') AND sidechain = false
 AND (coalesce(regexp_matches(text, '\S'), false) OR coalesce(len(list_filter(TRY(from_json(blocks, '[{"type":"VARCHAR","text":"VARCHAR"}]')), lambda x: x IS NOT NULL AND NOT (coalesce(x.type, '') = 'text' AND NOT coalesce(regexp_matches(x.text, '\S'), false)))) > 0, false)))"""

FOUND_SQL = _MESSAGES_SQL + """,
o AS (SELECT *, row_number() OVER w AS rn, lead(who) OVER w AS nxt FROM m WINDOW w AS (PARTITION BY session_id ORDER BY at_ NULLS FIRST, line_no NULLS FIRST, entry_id)),
g AS (SELECT session_id, bool_or(at_ IS NULL OR who IS NULL OR (rn = 1 AND who <> 'user') OR (who = 'user' AND coalesce(nxt, '') <> 'assistant')) AS bad FROM o GROUP BY session_id)
SELECT DISTINCT t.session_id FROM transcript_entries t LEFT JOIN g ON g.session_id = t.session_id WHERE t.session_id IS NOT NULL AND coalesce(g.bad, true)"""

TURNS_SQL = _MESSAGES_SQL + """,
o AS (SELECT *, row_number() OVER w AS rn, lead(who) OVER w AS nxt FROM m WINDOW w AS (PARTITION BY session_id ORDER BY at_ NULLS FIRST, line_no NULLS FIRST, entry_id)),
g AS (SELECT session_id FROM o GROUP BY session_id HAVING NOT bool_or(at_ IS NULL OR who IS NULL OR (rn = 1 AND who <> 'user') OR (who = 'user' AND coalesce(nxt, '') <> 'assistant')))
SELECT o.session_id, rn AS turn_no, who AS role, CAST(at_ AT TIME ZONE 'UTC' AS TIMESTAMP) AS at, entry_id, text FROM o JOIN g ON g.session_id = o.session_id"""

#: The slope of the squared violations is summed at every bound by a self-join inside the session; the least-squares offset is
#: the mean of the bounds that are violated right of the last bound where the slope is not positive.
OFFSETS_SQL = _MESSAGES_SQL + """,
k AS (SELECT session_id, who, epoch_us(at_) AS t, lag(who) OVER w AS who0, lag(epoch_us(at_)) OVER w AS t0 FROM m WHERE at_ IS NOT NULL AND who IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY line_no NULLS FIRST, entry_id)),
b AS (SELECT session_id, who = 'assistant' AS low, CASE WHEN who = 'assistant' THEN t0 - t ELSE t - t0 END AS b FROM k WHERE who <> who0),
y AS (SELECT session_id, count(*) AS n_pairs, max(b) FILTER (low) AS lo, min(b) FILTER (NOT low) AS hi FROM b GROUP BY session_id),
p AS (SELECT DISTINCT b.session_id, b.b AS at_ FROM b JOIN y ON y.session_id = b.session_id AND y.lo > y.hi),
q AS (SELECT p.session_id, p.at_, coalesce(sum(p.at_ - b.b) FILTER (CASE WHEN low THEN b.b > p.at_ ELSE b.b < p.at_ END), 0) AS slope, sum(b.b) FILTER (CASE WHEN low THEN b.b > p.at_ ELSE b.b <= p.at_ END) AS s, count(*) FILTER (CASE WHEN low THEN b.b > p.at_ ELSE b.b <= p.at_ END) AS n FROM p JOIN b ON b.session_id = p.session_id GROUP BY 1, 2),
x AS (SELECT session_id, arg_max(s::DOUBLE / n, at_) AS x FROM q WHERE slope <= 0 GROUP BY session_id)
SELECT y.session_id, n_pairs, lo / 1e6 AS lowest_s, hi / 1e6 AS highest_s, CASE WHEN x.x IS NOT NULL THEN x.x / 1e6 WHEN lo > 0 THEN lo / 1e6 WHEN hi < 0 THEN hi / 1e6 ELSE 0.0 END AS offset_s, coalesce(lo <= hi, true) AS feasible FROM y LEFT JOIN x ON x.session_id = y.session_id"""
