"""Bus queries, batch and streaming, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from arborweft.sources.tables import load, shared_dir
from arborweft.streaming import bus as op
from arborweft.streaming import rooms

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return put


_ENV = """env AS (SELECT event_id AS id, event_type AS room, CAST(user_id AS VARCHAR) AS sender, epoch(date_trunc('second', ts))::BIGINT AS ts, props AS text, CASE WHEN value < 2 THEN 'halt' WHEN value < 4 THEN 'resume' END AS control, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 4 = 0 THEN [json_extract_string(props, '$.k')] ELSE [] END AS recipients FROM events)"""
_ROOMS = f"WITH {_ENV} SELECT room, count(*) AS n_messages, count(DISTINCT sender) AS n_members, max(ts) AS last_ts FROM env GROUP BY room"
_WHO = f"WITH {_ENV} SELECT room, sender, max(ts) AS last_seen, (SELECT max(ts) FROM env) - max(ts) > 600 AS stale FROM env GROUP BY 1, 2"
_TAIL = f"WITH {_ENV} SELECT id, room, sender, ts FROM env WHERE len(recipients) > 0"


@query("room_summary", _ROOMS)
def room_summary(s, d):
    return op.rooms(op.of(s, d))


@query("who_stale", _WHO)
def who_stale(s, d):
    return op.who(op.of(s, d))


@query("halt_asof", f"WITH {_ENV} SELECT id, room, coalesce(last_value(control IGNORE NULLS) OVER (PARTITION BY room ORDER BY ts, id ROWS UNBOUNDED PRECEDING) = 'halt', false) AS halted FROM env")
def halt_asof(s, d):
    return op.halted(op.of(s, d))


_HUMAN = "CAST(sender AS BIGINT) % 10 = 0"


@query("publish_accepted", f"WITH {_ENV}, h AS (SELECT *, {_HUMAN} AS human, coalesce(last_value(control IGNORE NULLS) OVER (PARTITION BY room ORDER BY ts, id ROWS UNBOUNDED PRECEDING) = 'halt', false) AS halted FROM env), a AS (SELECT *, NOT halted OR control IS NOT NULL OR human AS ok FROM h) SELECT room, count(*) AS n_sent, sum(CASE WHEN ok THEN 1 ELSE 0 END)::BIGINT AS n_accepted, sum(CASE WHEN halted AND human THEN 1 ELSE 0 END)::BIGINT AS n_human_in_halt, max(CASE WHEN ok THEN ts END) AS last_accepted FROM a GROUP BY room")
def publish_accepted(s, d):
    """B2: a halted room takes control messages and those of humans only (here every tenth user); what is accepted refreshes
    the last sign. Names and kinds from the roster: room_lifecycle."""
    env = op.of(s, d)
    j = op.halted(env).join(env.select("id", "control", "ts", (F.col("sender").cast("long") % 10 == 0).alias("human")), "id")
    ok = ~F.col("halted") | F.col("control").isNotNull() | F.col("human")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return j.groupBy("room").agg(F.count("*").alias("n_sent"), count(ok).alias("n_accepted"), count(F.col("halted") & F.col("human")).alias("n_human_in_halt"), F.max(F.when(ok, F.col("ts"))).alias("last_accepted"))


@query("addressed_tail", _TAIL)
def addressed_tail(s, d):
    """B7."""
    return op.of(s, d).filter(F.size("recipients") > 0).select("id", "room", "sender", "ts")


@query("addressee_resolve", f"WITH {_ENV}, m AS (SELECT DISTINCT room, sender AS member FROM env), a AS (SELECT id, room, unnest(recipients) AS named FROM env), c AS (SELECT a.id, a.named, count(m.member) AS n, min(m.member) AS only_, coalesce(bool_or(m.member = a.named), false) AS exact_ FROM a LEFT JOIN m ON m.room = a.room AND contains(m.member, a.named) GROUP BY 1, 2) SELECT id, named, CASE WHEN exact_ THEN named WHEN n = 1 THEN only_ END AS resolved, CASE WHEN exact_ THEN 'exact' WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'passed' END AS outcome FROM c")
def addressee_resolve(s, d):
    return op.addressees(op.of(s, d))


_AGAIN = "again AS (SELECT * FROM env UNION ALL SELECT id, room, sender, ts + 5, 'sent again', control, recipients FROM env WHERE id % 3 = 0)"


@query("envelope_last_wins", f"WITH {_ENV}, {_AGAIN} SELECT id, room, sender, ts, text FROM again QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC) = 1")
def envelope_last_wins(s, d):
    """S14 over the log in which every third envelope was sent again."""
    env = op.of(s, d)
    return op.last_wins(env.union(env.filter("id % 3 = 0").withColumn("ts", F.col("ts") + 5).withColumn("text", F.lit("sent again"))))


# One envelope beyond each limit, and the problems that it has.
BEYOND = (
    (-1, "r", "a", 1, "x" * (op.MAX_TEXT + 1), None, []), (-2, "r", None, 1, "x", None, []), (-3, "r", "n" * (op.MAX_NAME + 1), 1, "x", None, []), (-4, "r", "a", 1, "x", None, ["b"] * (op.MAX_TO + 1)), (-5, "r", "a", 1, "x", None, ["c" * (op.MAX_TO_BYTES + 1)]), (-6, "r", "", 1, None, None, None),
    (-7, "r", "n" * op.MAX_NAME, 1, "x", None, ["d" * op.MAX_TO_BYTES]),
)
_BEYOND = ((-1, "text too long"), (-2, "no sender"), (-3, "name too long"), (-4, "too many recipients"), (-5, "recipients too long"), (-6, "no sender"), (-6, "no text"))


@query("limits_violations", f"WITH {_ENV} SELECT id, 'text too long' AS problem FROM env WHERE strlen(text) > 1048576 UNION ALL SELECT id, 'no sender' FROM env WHERE coalesce(sender, '') = '' UNION ALL SELECT id, 'no text' FROM env WHERE coalesce(text, '') = '' UNION ALL VALUES " + ", ".join(f"({i}, '{p}')" for i, p in _BEYOND))
def limits_violations(s, d):
    """B3, with an envelope beyond each limit."""
    env = op.of(s, d)
    return op.problems(env.union(s.createDataFrame(list(BEYOND), op.ENVELOPE).select(*env.columns)))


@query("transcript_page", "SELECT session_id, entry_id, pos FROM (SELECT session_id, entry_id, row_number() OVER (PARTITION BY session_id ORDER BY line_no DESC, entry_id DESC) AS pos FROM (SELECT DISTINCT session_id, entry_id, line_no FROM transcript_entries)) WHERE pos BETWEEN 11 AND 20")
def transcript_page(s, d):
    """The second page of ten of each session, newest first (the page is the feature). Spark keeps the first twenty
    rows of a session per task before it shuffles."""
    from pyspark.sql import Window

    t = load(s, d, "transcript_entries").select("session_id", "entry_id", "line_no").distinct()
    w = Window.partitionBy("session_id").orderBy(F.desc("line_no"), F.desc("entry_id"))
    return t.withColumn("pos", F.row_number().over(w)).filter("pos <= 20").filter("pos > 10").select("session_id", "entry_id", F.col("pos").cast("long").alias("pos"))


@query("transcript_titles", "SELECT session_id, max(CASE WHEN entry_type = 'ai-title' THEN text END) FILTER (rt = 1) AS title, count(*) AS n_rows FROM (SELECT *, row_number() OVER (PARTITION BY session_id, entry_type ORDER BY line_no DESC, entry_id DESC, coalesce(text, '') DESC) AS rt FROM transcript_entries) GROUP BY session_id")
def transcript_titles(s, d):
    """The last title of each session wins."""
    t = load(s, d, "transcript_entries").groupBy("session_id").agg(F.max(F.when(F.col("entry_type") == "ai-title", F.struct("line_no", "entry_id", F.coalesce("text", F.lit("")).alias("t"), "text"))).alias("m"), F.count("*").alias("n_rows"))
    return t.select("session_id", F.col("m.text").alias("title"), "n_rows")


def _folder(s) -> str:
    return f"{shared_dir(s)}/bus-{uuid.uuid4().hex}"


def _streamed(s, d, build, mode: str):
    """Write the log, stream it back with availableNow and return the sink's rows."""
    base = _folder(s)
    op.write_log(op.of(s, d), f"{base}/log")
    return op.run(build(op.stream(s, f"{base}/log")), base, mode)


@query("stream_room_summary", f"WITH {_ENV} SELECT room, count(*) AS n_messages, max(ts) AS last_ts FROM env GROUP BY room")
def stream_room_summary(s, d):
    """The same as a stream over the log."""
    return _streamed(s, d, op.stream_rooms, "complete")


@query("stream_who", f"WITH {_ENV} SELECT room, sender, max(ts) AS last_seen FROM env GROUP BY 1, 2")
def stream_who(s, d):
    """B8, B13."""
    return _streamed(s, d, op.stream_who, "complete")


@query("stream_addressed_tail", _TAIL)
def stream_addressed_tail(s, d):
    """B6, B7, B12."""
    return _streamed(s, d, lambda e: op.stream_tail(op.stream_unique(e)).select("id", "room", "sender", "ts"), "append")


@query("room_lifecycle")
def room_lifecycle(s, d):
    """Outcomes of joins, sends, halts, prunes, ends and closings. No SQL: the protocol is a sequence of
    steps over keyed state; tests run the same steps in a plain loop and restart the stream from its checkpoint."""
    base = _folder(s)
    rooms.operations(load(s, d, "events")).write.json(f"{base}/log")
    return op.run(rooms.lifecycle(s.readStream.schema(rooms.OPERATION).json(f"{base}/log")), base, "append")
