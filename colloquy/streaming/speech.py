"""Speech fragments of a reply as its tokens arrive: an opening, finished sentences, and what is left at the end."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.streaming.ordered import OrderedFold, folded

#: White space in Unicode's sense, as the patterns of batch columns have it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Characters of a fragment that is spoken by itself, and where an opening may end.
LEAST = 12
BOUNDARY = re.compile(rf"[.!?]+[\"')\]]*(?=[{WHITE}])")
CLAUSE = re.compile(rf"[\s\S]{{14,}}?[,;:—-](?=[{WHITE}])")
WORDS = re.compile(rf"[\s\S]{{22,}}?[^{WHITE}](?=[{WHITE}])")
#: What a boundary may begin with at the end of a text that goes on.
UNSURE = re.compile(r"[.!?]+[\"')\]]*\Z")
EDGES = re.compile(rf"\A[{WHITE}]+|[{WHITE}]+\Z")


def stripped(text: str) -> str:
    return EDGES.sub("", text)


def drained(buffer: str, searched: int) -> tuple[list[str], str, int]:
    """(finished sentences, what is left, the place in it from which to look on) of a buffer searched up to a place before.

    A terminator counts when white space follows. A sentence that is too short is kept with the next.
    """
    found, start = [], 0
    while match := BOUNDARY.search(buffer, searched):
        searched = match.end()
        candidate = stripped(buffer[start:searched])
        if len(candidate) >= LEAST:
            found.append(candidate)
            start = searched
    unsure = UNSURE.search(buffer, searched)
    return found, buffer[start:], (unsure.start() if unsure else len(buffer)) - start


def opening(buffer: str) -> str | None:
    """The first fragment worth speaking, with the blanks before it: a clause, or words enough."""
    found = CLAUSE.match(buffer) or WORDS.match(buffer)
    return found[0] if found else None


class Speech(OrderedFold):
    """(at, kind, fragment, seq) of a reply's tokens: fragments in order, and the token at which each was there.

    An opening is taken once at most, while nothing is queued and the token has finished no sentence. The last row has `last`.
    """

    STATE = "buffer string, searched long, at long"
    ROW = "token string, last boolean"
    OUT = "at long, kind string, fragment string, token_seq long"

    def begin(self):
        return "", 0, 0

    def step(self, state, row):
        buffer, searched, at = state
        sentences, buffer, searched = drained(buffer + (row.token or ""), searched)
        given = [("sentence", s) for s in sentences]
        if not at and not given and (first := opening(buffer)):
            given = [("opening", stripped(first))]
            buffer, searched = buffer[len(first) :], max(0, searched - len(first))
        if row.last and (rest := stripped(buffer)):
            given.append(("tail", rest))
        rows = [(at + k, kind, fragment, row.seq) for k, (kind, fragment) in enumerate(given)]
        return None if row.last else (buffer, searched, at + len(rows)), rows


def speech_stream(tokens: DataFrame, key: str = "request_id", timeout: int = 3_600_000) -> DataFrame:
    """(key, at, kind, fragment, token_seq) of a stream of rows (key, seq, ts, token, last)."""
    return folded(tokens, key, Speech(timeout))


class FirstFragment(Speech):
    """The opening alone, where there is one; a finished sentence or a spoken opening ends it."""

    OUT = "token_seq long, fragment string"

    def step(self, state, row):
        after, rows = super().step(state, row)
        given = [(seq, fragment) for _, kind, fragment, seq in rows if kind == "opening"]
        return (None if rows else after), given


def opening_fragments(tokens: DataFrame, key: str = "request_id", timeout: int = 3_600_000) -> DataFrame:
    """(key, token_seq, fragment) of a stream of rows (key, seq, ts, token): the opening and the token at which it was there."""
    rows = tokens if "last" in tokens.columns else tokens.withColumn("last", F.lit(False))
    return folded(rows, key, FirstFragment(timeout))
