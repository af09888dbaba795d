"""Exact least-recently-used eviction with expiry and deletes over a log of commands of any length, by speculative replay.

What a store holds after a command depends on all before it, but a store of bounded capacity forgets: after as many creates as it
holds, or the time after which sessions expire, nothing of an earlier state is left. So the log is cut into ranges of
time of about equally many commands, and all are replayed at once from a guessed state at entry. A range whose entry isn't the
state at which the one before ended is replayed again, until all agree. That takes two rounds where ranges are long against the capacity or the time,
and never more than there are ranges. States hold at most the capacity's sessions and go from round to round as a table.
"""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.settings import settings
from colloquy.tables import staged

HELD = "array<struct<session_id:string,created_us:bigint,updated_us:bigint>>"
ANSWERED = "command_id long, session_id string, found boolean, created boolean, evicted array<string>, live long"


class Held:
    """A store's sessions: (created, updated) by id in order of access, and the ids in order of activity."""

    def __init__(self, state: list, most: int, minutes: int):
        """state: (session_id, created_us, updated_us) in order of access."""
        self.most, self.limit = most, minutes * 60_000_000
        self.by_access = OrderedDict((s[0], (s[1], s[2])) for s in state)
        self.by_activity = OrderedDict.fromkeys(s[0] for s in sorted(state, key=lambda s: s[2]))

    def state(self) -> list[tuple]:
        return [(sid, *times) for sid, times in self.by_access.items()]

    def _drop(self, sid: str) -> None:
        del self.by_access[sid], self.by_activity[sid]

    def _active(self, sid: str, created: int, now: int) -> None:
        self.by_access[sid] = (created, now)
        self.by_activity[sid] = None
        self.by_activity.move_to_end(sid)

    def expire(self, now: int) -> None:
        while self.by_activity and now - self.by_access[next(iter(self.by_activity))][1] > self.limit:
            self._drop(next(iter(self.by_activity)))

    def answer(self, kind: str, sid: str | None, new: str | None, now: int) -> tuple:
        """(session_id, found, created, evicted, live) of a command."""
        self.expire(now)
        found = kind != "create" and sid in self.by_access
        evicted: list[str] = []
        if kind == "delete" and found:
            self._drop(sid)
        elif kind == "add" and found:
            self._active(sid, self.by_access[sid][0], now)
        elif kind in ("get", "ask") and found:
            self.by_access.move_to_end(sid)
        elif kind in ("create", "ask") and new is not None:
            sid = new
            if sid in self.by_access:
                self._drop(sid)
            self._active(sid, now, now)
            while len(self.by_access) > self.most:
                evicted.append(next(iter(self.by_access)))
                self._drop(evicted[-1])
        made = not found and kind in ("create", "ask") and new is not None
        return (sid if found or made else None, found, made, evicted, len(self.by_access))


def _played(rows: pd.DataFrame, entry: pd.DataFrame, most: int, minutes: int) -> tuple[Held, list]:
    held = Held([tuple(s.values()) if isinstance(s, dict) else tuple(s) for s in entry["state"].iloc[0]] if len(entry) else [], most, minutes)
    if not len(rows):
        return held, []
    rows = rows.sort_values(["us", "command_id"])
    return held, [(r.command_id, *held.answer(r.kind, r.session_id, r.new_id, r.us)) for r in rows.itertuples()]


def replay(commands: DataFrame, most: int | None = None, minutes: int | None = None, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers: ANSWERED, states: (range, state at its end)) of a log (command_id, ts, kind, session_id, new_id), in order of ts and then command_id.

    Kinds: `create` makes session new_id; `get` looks session_id up and refreshes its access; `ask` does that or makes new_id; `add` is activity without an access;
    `delete` removes. A new session beyond `most` puts out those accessed least recently. `live` counts what is held after the command. What has expired is gone for all
    commands. Limits that aren't given are the session's settings. Commands of a null ts, command_id or kind are left out; an ask or create without new_id makes nothing.
    """
    given = settings(commands.sparkSession)
    most, minutes = given.max_sessions if most is None else most, given.session_ttl_minutes if minutes is None else minutes
    log = commands.select("command_id", F.unix_micros("ts").alias("us"), "kind", "session_id", "new_id").dropna(subset=["command_id", "us", "kind"])
    dealt = log.repartitionByRange(ranges, "us", "command_id") if ranges else log.repartitionByRange("us", "command_id")
    trace = staged(dealt.withColumn("range", F.spark_partition_id()), "eviction-log")
    # Ranges without a command pass their entry on: only those that have some are numbered.
    numbers = staged(trace.select("range").distinct(), "eviction-ranges")
    before = numbers.select("range", F.lag("range").over(W.orderBy("range")).alias("earlier")).filter("earlier is not null")
    none = F.array().cast(HELD)
    entries = staged(numbers.select("range", none.alias("state")), "eviction-entries")
    exits = None

    def ended(_: tuple, rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        held, _answers = _played(rows, entry, most, minutes)
        if len(rows):
            held.expire(int(rows["us"].max()))
        state = [dict(zip(("session_id", "created_us", "updated_us"), s, strict=True)) for s in held.state()]
        return pd.DataFrame({"range": [entry["range"].iloc[0]], "state": [state]})

    def answered(_: tuple, rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_played(rows, entry, most, minutes)[1], columns=["command_id", "session_id", "found", "created", "evicted", "live"])

    def by_range(rows: DataFrame, entry: DataFrame):
        return rows.groupBy("range").cogroup(entry.groupBy("range"))

    changed = entries
    while True:
        again = trace.join(F.broadcast(changed.select("range")), "range", "left_semi")
        new = by_range(again, changed).applyInPandas(ended, f"range int, state {HELD}")
        kept = exits.join(F.broadcast(changed.select("range")), "range", "left_anti") if exits is not None else None
        exits = staged(new if kept is None else new.union(kept.select(new.columns)), "eviction-exits")
        at_entry = before.join(exits.select(F.col("range").alias("earlier"), F.col("state").alias("given")), "earlier").select("range", "given")
        both = entries.join(at_entry, "range", "left").select("range", "state", F.coalesce("given", none).alias("given"))
        changed = staged(both.filter("state <> given").select("range", F.col("given").alias("state")), "eviction-changed")
        if changed.isEmpty():
            break
        entries = staged(both.select("range", F.col("given").alias("state")), "eviction-entries")
    return by_range(trace, entries).applyInPandas(answered, ANSWERED), exits
