"""Framed replies as streams: a client's parser of chunks of bytes, and a server's frames of a model's chunks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.sources.frames import AFTER, FRAME, data_events, framed
from colloquy.streaming.ordered import OrderedFold, folded, names


COUNTS = ["eval_count", "eval_duration", "prompt_eval_count", "total_duration", "load_duration"]
REQUEST_ROW = "session_id string, model string, token string, done boolean, detail string, hint string, " + ", ".join(f"{c} long" for c in COUNTS)


class SseParser(OrderedFold):
    """The first data line of each finished frame of a body that comes in chunks, which may be cut anywhere, within a character too.

    The rest behind the last blank line is remembered. It is dropped at the end, as an unfinished frame is.
    """

    STATE = "rest binary, at long"
    ROW = "chunk binary, last boolean"
    OUT = "at long, data string"

    def begin(self):
        return b"", 0

    def step(self, state, row):
        rest, at = state
        *frames, rest = (bytes(rest) + bytes(row.chunk or b"")).split(b"\n\n")
        lines = (next((x for x in frame.split(b"\n") if x.startswith(b"data:")), None) for frame in frames)
        given = [(at + k, x[5:].decode("utf-8", "replace")) for k, x in enumerate(lines) if x is not None]
        return None if row.last else (rest, at + len(frames)), given


def sse_stream(chunks: DataFrame, key: str, timeout: int = 3_600_000) -> DataFrame:
    """(key, at, event) of a stream of rows (key, seq, ts, chunk, last): what `sse_events` gives of the whole bodies."""
    return data_events(folded(chunks, key, SseParser(timeout)))


class ReplyFrames(OrderedFold):
    """What a request's stream sends. seq -1 is the request itself, the model's chunks follow from 0.

    A request ends with the model's last chunk or a failure, and is given up when no more comes: then only the end mark
    is sent. Chunks that come before their request wait for it; those whose request never comes are dropped.
    """

    STATE = "started boolean, session_id string, reply string"
    #: A row is turned into Python's values cell by cell: what only few rows have goes in one cell, as JSON, which is null for the others.
    ROW = "token string, more string"
    OUT = "at long, type string, content string, more string"
    first = -1

    def begin(self):
        return False, None, ""

    def _given(self, at: int, kind: str, content: str | None = None, **more) -> tuple:
        return at, kind, content, json.dumps(more) if more else None

    def step(self, state, row):
        started, session_id, reply = state
        more = json.loads(row.more) if row.more else {}
        if not started:
            return (True, more.get("session_id"), ""), [self._given(-1, "start", session_id=more.get("session_id"), model=more.get("model"))]
        if "detail" in more:
            return None, [self._given(AFTER - 1, "error", detail=more["detail"], hint=more.get("hint")), self._given(AFTER, "end")]
        given = [self._given(row.seq, "token", row.token)] if row.token else []
        reply += row.token or ""
        if "done" in more:
            counts = {c: more.get(c) for c in COUNTS}
            return None, [*given, self._given(AFTER - 2, "done", session_id=session_id, reply=reply, **counts), self._given(AFTER, "end")]
        return (True, session_id, reply), given

    def abandoned(self, state):
        return [self._given(AFTER, "end")] if state[0] else []


def request_rows(requests: DataFrame, chunks: DataFrame, ts: Column) -> DataFrame:
    """Rows of ReplyFrames' stream: requests (request_id, session_id, model) and chunks (request_id, seq, token, done, detail, hint, counts)."""
    columns = ["request_id", "seq", "ts", *names(REQUEST_ROW)]
    types = dict(c.strip().split(" ") for c in REQUEST_ROW.split(","))
    whole = lambda df: df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in columns))
    asked = requests.withColumn("seq", F.lit(-1).cast("long"))
    return whole(asked.withColumn("ts", ts)).unionByName(whole(chunks.withColumn("seq", F.col("seq").cast("long")).withColumn("ts", ts)))


def frame_stream(rows: DataFrame, timeout: int = 3_600_000) -> DataFrame:
    """(request_id, at, type, frame) of a stream of request_rows: what `stream_frames` gives of all of them."""
    few = [F.when(F.col("done"), True).alias("done") if c == "done" else F.col(c) for c in names(REQUEST_ROW) if c != "token"]
    found = folded(rows.select("request_id", "seq", "ts", "token", F.nullif(F.to_json(F.struct(*few)), F.lit("{}")).alias("more")), "request_id", ReplyFrames(timeout))
    of = found.withColumn("more", F.from_json("more", ", ".join(c.strip() for c in FRAME.split(",") if c.split()[0] not in ("at", "type", "content"))))
    return framed(of.select("request_id", "at", "type", "content", "more.*")).select("request_id", "at", "type", "frame")


def outcomes(frames: DataFrame) -> DataFrame:
    """(request_id, outcome, rolled_back) of a table of frames: done, error (the user's message is taken back) or abandoned."""
    has = lambda kind: F.bool_or(F.col("type") == kind)
    kind = F.when(has("error"), "error").when(has("done"), "done").otherwise("abandoned")
    return frames.groupBy("request_id").agg(kind.alias("outcome"), has("error").alias("rolled_back"))
