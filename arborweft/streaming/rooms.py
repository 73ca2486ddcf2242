"""Room life: joins, sends, halts, pruning, closing and ended sessions as keyed state of a stream.

The protocol is one sequence of steps per room, so a room's operations of one micro-batch are worked off in order by one task;
the state between batches is the roster and a flag, not the log. The log itself never passes through here.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that no member may take; kinds of members; seconds until a silent member is stale; longest name in bytes.
RESERVED, KINDS, STALE_AFTER, MAX_NAME = ("system", "human"), ("agent", "human"), 600, 128
OPERATION = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("room", T.StringType()), ("ts", T.LongType()), ("op", T.StringType()), ("session", T.StringType()), ("name", T.StringType()), ("kind", T.StringType()))])
OUTCOME = "room string, id long, op string, outcome string, name string, kind string, detail string"


class Room:
    """The state of one room: members by name, the name of each session, the halt flag, ended sessions."""

    def __init__(self, state: str | None = None):
        s = json.loads(state) if state else {}
        self.exists: bool = s.get("exists", False)
        self.members: dict[str, dict] = s.get("members", {})
        self.halted: bool = s.get("halted", False)
        self.ended: list[str] = s.get("ended", [])

    def dump(self) -> str:
        return json.dumps({"exists": self.exists, "members": self.members, "halted": self.halted, "ended": self.ended})

    def _of(self, session: str | None) -> str | None:
        return next((n for n, m in self.members.items() if m["session"] == session), None)

    def apply(self, ts: int, op: str, session: str | None, name: str | None, kind: str | None) -> list[tuple[str, str | None, str | None, str | None]]:
        """(outcome, name, kind, detail) of one operation: one row, or one per member that a prune removes."""
        if op == "join":
            return [self._join(ts, session, name or "", kind)]
        if not self.exists:
            return [("refused", name, None, "no room")]
        mine = self._of(session)
        if op == "leave":
            if mine is None:
                return [("refused", None, None, "not joined")]
            gone = self.members.pop(mine)
            self.exists = bool(self.members)
            return [("left", mine, gone["kind"], None)]
        if op == "send":
            if mine is None:
                return [("refused", None, None, "not joined")]
            m = self.members[mine]
            if self.halted and m["kind"] != "human":
                return [("refused", mine, m["kind"], "halted")]
            m["seen"] = ts
            return [("sent", mine, m["kind"], None)]
        if op in ("halt", "resume"):
            self.halted = op == "halt"
            return [("halted" if self.halted else "resumed", "system", "human", None)]
        if op == "prune":
            old = sorted(n for n, m in self.members.items() if ts - m["seen"] > STALE_AFTER)
            return [("pruned", n, self.members.pop(n)["kind"], None) for n in old]
        if op == "close":
            self.exists, self.members, self.halted, self.ended = False, {}, False, []
            return [("closed", "system", "human", None)]
        if op == "end":
            if name not in self.members:
                return [("refused", name, None, "no member")]
            gone = self.members.pop(name)
            if gone["session"]:
                self.ended.append(gone["session"])
            return [("ended", name, gone["kind"], None)]
        if op == "subscribe":
            return [("refused", None, None, "ended")] if session in self.ended else [("subscribed", mine, None, None)]
        return [("refused", name, None, "unknown operation")]

    def _join(self, ts: int, session: str | None, name: str, kind: str | None) -> tuple[str, str | None, str | None, str | None]:
        if len(name.encode()) > MAX_NAME:
            return "refused", name, None, "name too long"
        if name in RESERVED:
            return "refused", name, None, "reserved"
        if kind not in KINDS:
            return "refused", name, None, "bad kind"
        free = next((n for n in (name, f"{name}-2") if n not in self.members or self.members[n]["session"] == session), None)
        self.exists = True
        if free is None:
            return "refused", name, None, "name taken"
        prior = self._of(session)
        if prior is not None and prior != free:
            del self.members[prior]
        self.ended = [s for s in self.ended if s != session]
        self.members[free] = {"kind": kind, "session": session, "joined": ts, "seen": ts}
        return "joined", free, kind, None


def _step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    room = Room(state.get[0] if state.exists else None)
    ops = pd.concat(list(batches)).sort_values(["ts", "id"], kind="stable")
    none = lambda x: None if x is None or x != x else x
    rows = []
    for i, ts, op, session, name, kind in zip(ops["id"], ops["ts"], ops["op"], ops["session"], ops["name"], ops["kind"]):
        rows += [(key[0], i, op, *r) for r in room.apply(int(ts), op, none(session), none(name), none(kind))]
    state.update((room.dump(),))
    yield pd.DataFrame(rows, columns=["room", "id", "op", "outcome", "name", "kind", "detail"])


def lifecycle(ops: DataFrame) -> DataFrame:
    """Outcomes of a stream of operations. A name that is taken becomes name-2, a second clash is refused; a session holds one
    name a room; a halted room takes sends of humans only; a sender's name and kind come from the roster; an ended session
    may not subscribe until it joins again; closing empties the room. Rows without room, id or time are no operations."""
    ops = ops.filter("room is not null and id is not null and ts is not null")
    return ops.groupBy("room").applyInPandasWithState(_step, OUTCOME, "state string", "append", "NoTimeout")


def operations(events: DataFrame) -> DataFrame:
    """Operations as the events table gives them: the room is the event type, sessions are users, thirty names and a few kinds."""
    u, i = F.col("user_id"), F.col("event_id")
    op = F.when(i % 7 == 0, "join").when(i % 41 == 3, "leave").when(i % 97 == 5, "halt").when(i % 97 == 45, "resume").when(i % 211 == 1, "prune").when(i % 499 == 2, "close").when(i % 151 == 4, "end").when(i % 61 == 6, "subscribe").otherwise("send")
    return events.select(i.alias("id"), F.col("event_type").alias("room"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), op.alias("op"), u.cast("string").alias("session"), F.concat(F.lit("m"), (u % 30).cast("string")).alias("name"), F.when(u % 10 == 0, "human").when(u % 10 == 1, "robot").otherwise("agent").alias("kind"))
