"""The session store as a stream: commands in, answers out, each client's sessions in keyed state.

The clock is the commands' own time, so that a run is the same when it is repeated. A session lives with the client that
made it, which is the stream's key. What is idle for longer than the limit is gone for every command that
comes after, and a timer by event time takes it out of the state.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from colloquy.settings import settings
from colloquy.streaming.ordered import names, picked

ANSWER = "command_id long, kind string, session_id string, created boolean, profile string, message_count long, created_us long, updated_us long, access_us long"
MADE = Row("client", *names(ANSWER))
COMMAND = ["us", "command_id", "kind", "session_id", "profile"]


class Held:
    """A client's sessions while its commands are gone through: read from the store once, and what has changed written once.

    Each access to the store is a call to another process, so that none is made for a command. Only the times of messages
    that were there before stay in the store until one is asked for.
    """

    def __init__(self, sessions, times, known: bool):
        self.sessions, self.times = sessions, times
        self.stored = {sid: tuple(s) for (sid,), s in sessions.iterator()} if known else {}
        self.now = dict(self.stored)
        #: The times of new messages by session and number. A number that a session has and that isn't here is in the store.
        self.added: dict[str, dict[int, int]] = {}
        #: Times of activity, old ones too: a session is as its last one says.
        self.active = [(s[2], sid) for sid, s in self.now.items()]
        heapq.heapify(self.active)

    def put(self, sid: str, session: tuple) -> None:
        before = self.now.get(sid)
        if before is None or before[2] != session[2]:
            heapq.heappush(self.active, (session[2], sid))
        self.now[sid] = session

    def drop(self, sid: str) -> None:
        del self.now[sid]
        self.added.pop(sid, None)

    def time(self, sid: str, number: int) -> int:
        us = self.added.get(sid, {}).get(number)
        return self.times.getValue((sid, number))[0] if us is None else us

    def expired(self, since: int) -> Iterator[tuple[str, tuple]]:
        """(id, session) of those that were active last before a time; they are dropped."""
        while self.active and self.active[0][0] < since:
            us, sid = heapq.heappop(self.active)
            session = self.now.get(sid)
            if session is not None and session[2] == us:
                self.drop(sid)
                yield sid, session

    def write(self) -> None:
        for sid, session in self.stored.items():
            left = self.now[sid][4] if sid in self.now else 0
            for number in range(left + 1, session[4] + 1):
                self.times.removeKey((sid, number))
            if sid not in self.now:
                self.sessions.removeKey((sid,))
        for sid, session in self.now.items():
            if session != self.stored.get(sid):
                self.sessions.updateValue((sid,), session)
            for number, us in self.added.get(sid, {}).items():
                self.times.updateValue((sid, number), (us,))


class LiveStore(StatefulProcessor):
    """Rows (client, command_id, kind, session_id, profile, ts, us) to ANSWER, in order of time and then command.

    Kinds: `create` makes a session; `get` looks one up and refreshes its access; `ask` looks one up or makes it, gives it the profile if there is one,
    and adds a message; `reply` adds a message, `fail` takes the last one back with its activity, both without an access; `delete` removes. Without a session_id
    the client's latest session is meant. A new session's id is a hash of its command's, so that a task that runs again gives the same.
    An answer without session_id found none. A session that ends by time gives a row of kind `expired`, without command.
    """

    def __init__(self, minutes: int):
        self.limit = minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "session_id string, timer long")
        self.sessions = handle.getMapState("sessions", "session_id string", "profile string, created long, updated long, access long, messages long")
        #: When a session's messages were added, by number: what is left counts when one is taken back.
        self.times = handle.getMapState("times", "session_id string, number long", "us long")

    def _expired(self, key, held: Held, now: int) -> Iterator[Row]:
        for sid, (profile, created, updated, access, messages) in held.expired(now - self.limit):
            yield MADE(*key, None, "expired", sid, False, profile, messages, created, updated, access)

    def _one(self, command: tuple, latest: str | None, held: Held) -> tuple[tuple | None, str | None, bool]:
        """(session, its id, whether it is new) after a command; the session is None if there is none."""
        us, number, kind, sid, given = command
        sid = sid or latest
        found = held.now.get(sid) if kind != "create" else None
        made = found is None and kind in ("create", "ask")
        if made:
            sid = hashlib.md5(str(number).encode()).hexdigest()
            found = (given, us, us, us, 0)
            held.added[sid] = {}
        if found is None:
            return None, None, False
        profile, created, updated, access, messages = found
        if kind in ("create", "ask", "get"):
            access = us
        if kind in ("ask", "reply"):
            profile = given if kind == "ask" and given is not None else profile
            messages, updated = messages + 1, us
            held.added.setdefault(sid, {})[messages] = us
        elif kind == "fail" and messages:
            held.added.setdefault(sid, {}).pop(messages, None)
            messages -= 1
            updated = held.time(sid, messages) if messages else created
        session = (profile, created, updated, access, messages)
        if kind == "delete":
            held.drop(sid)
        else:
            held.put(sid, session)
        return session, sid, made

    def _set_timer(self, held: Held, latest: str | None, timer: int, before: tuple | None) -> None:
        """The timer of the session that ends first, if none is set; before: what the store has of the latest session and the timer."""
        if held.now and not timer:
            timer = (min(s[2] for s in held.now.values()) + self.limit) // 1000 + 1
            self.handle.registerTimer(timer)
        if held.now or timer:
            if (latest, timer) != before:
                self.latest.update((latest, timer))
        elif before:  # an id of a session that is gone finds nothing, as none does
            self.latest.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.latest.get()
        latest, timer = before or (None, 0)
        held = Held(self.sessions, self.times, bool(before))
        for command in sorted(picked(rows, COMMAND), key=itemgetter(0, 1)):
            us, number, kind, _, _ = command
            yield from self._expired(key, held, us)
            session, sid, made = self._one(command, latest, held)
            if session is None:
                yield MADE(*key, number, kind, None, False, None, None, None, None, None)
                continue
            profile, created, updated, access, messages = session
            latest = sid if made else latest
            yield MADE(*key, number, kind, sid, made, profile, messages, created, updated, access)
        held.write()
        self._set_timer(held, latest, timer, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = self.latest.get()
        held = Held(self.sessions, self.times, bool(before))
        yield from self._expired(key, held, timerValues.getCurrentWatermarkInMs() * 1000)
        held.write()
        self._set_timer(held, before[0] if before else None, 0, before)

    def close(self) -> None:
        pass


def answers(commands: DataFrame, minutes: int | None = None, late: str = "10 minutes") -> DataFrame:
    """(client, ANSWER) of a stream of commands (client, command_id, kind, session_id, profile, ts). minutes: the settings' where not given."""
    minutes = settings(commands.sparkSession).session_ttl_minutes if minutes is None else minutes
    rows = commands.select("client", "command_id", "kind", "session_id", "profile", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", late)
    out = f"client {commands.schema['client'].dataType.simpleString()}, {ANSWER}"
    return rows.groupBy("client").transformWithState(LiveStore(minutes), out, "Append", "EventTime")
