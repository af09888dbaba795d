import datetime as dt
import random
from collections import OrderedDict

import pytest

from colloquy.operators import eviction

START = dt.datetime(2024, 1, 1)
SCHEMA = "command_id long, ts timestamp, kind string, session_id string, new_id string"


def brute(commands, most, minutes):
    """An ordered dictionary of last activities, one command after the other."""
    held, out = OrderedDict(), []
    for number, ts, kind, sid, new in sorted(commands, key=lambda c: (c[1], c[0])):
        for old in [s for s, at in held.items() if ts - at > dt.timedelta(minutes=minutes)]:
            del held[old]
        found, made, gone = kind != "create" and sid in held, False, []
        if found and kind == "delete":
            del held[sid]
        elif found and kind == "add":
            held[sid] = ts
        elif found:
            held.move_to_end(sid)
        elif kind in ("create", "ask") and new:
            made, sid = True, new
            held.pop(new, None)
            held[new] = ts
            while len(held) > most:
                gone.append(held.popitem(last=False)[0])
        out.append((number, sid if found or made else None, found, made, gone, len(held)))
    return sorted(out), list(held)


def log(seed, n, ids, gap):
    rng = random.Random(seed)
    at, out = START, []
    for k in range(n):
        at += dt.timedelta(seconds=rng.choice([0, 0, gap, 3 * gap]))
        kind = rng.choice(["ask", "ask", "get", "add", "add", "delete", "create"])
        sid = f"s{min(rng.randrange(ids), rng.randrange(ids))}"
        out.append((k, at, kind, sid, rng.choice([sid, sid, f"n{k}", None])))
    return out


@pytest.mark.parametrize("seed, n, ids, gap, most, minutes, ranges", [(1, 500, 30, 20, 8, 30, 6), (2, 500, 60, 5, 20, 10_000, 9), (3, 300, 10, 600, 500, 60, 5), (4, 200, 8, 1, 500, 10_000, 7), (5, 40, 9, 60, 1, 30, 12)])
def test_replay_is_one_command_after_the_other(spark, seed, n, ids, gap, most, minutes, ranges):
    commands = log(seed, n, ids, gap)
    shuffled = random.Random(seed).sample(commands, len(commands))
    answers, states = eviction.replay(spark.createDataFrame(shuffled, SCHEMA), most, minutes, ranges)
    want, held = brute(commands, most, minutes)
    assert sorted(tuple(r) for r in answers.collect()) == want
    assert [s.session_id for s in states.orderBy("range").collect()[-1].state] == held


def test_no_commands_and_rows_that_say_nothing(spark):
    assert eviction.replay(spark.createDataFrame([], SCHEMA))[0].count() == 0
    rows = [(1, None, "ask", "a", "a"), (None, START, "ask", "a", "a"), (2, START, None, "a", "a"), (3, START, "other", "a", "a"), (4, START, "get", None, None), (5, START, "ask", None, "b")]
    got = eviction.replay(spark.createDataFrame(rows, SCHEMA))[0].orderBy("command_id").collect()
    assert [tuple(r) for r in got] == [(3, None, False, False, [], 0), (4, None, False, False, [], 0), (5, "b", False, True, [], 1)]
