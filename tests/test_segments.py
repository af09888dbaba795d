import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import segments, sessions
from colloquy.streaming import folds, ordered

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event string"


def activity(seed, n):
    """Half of all rows are one user's; some have none."""
    rng = random.Random(seed)
    events = ["listen", "submit", "token", "token", "reply", "cancel", "fail", "start", "queued", "audio", "spoken", None]
    return [(k, START + dt.timedelta(seconds=rng.randrange(40 * n)), 7 if k % 2 else rng.choice([1, 2, 3, *range(10, 40), None]), rng.choice(events)) for k in range(n)]


@pytest.mark.parametrize("seed, n, ranges", [(1, 400, 9), (2, 400, None), (3, 12, 12), (4, 0, 3)])
def test_sessions_by_segments_are_the_window_form_s(spark, seed, n, ranges):
    rows = spark.createDataFrame(activity(seed, n), SCHEMA).withColumn("part", F.lit("mine")).withColumn("of", F.lit(2))
    got, want = (f(rows, "user_id", 60, **kw) for f, kw in ((segments.sessionize, {"ranges": ranges}), (sessions.sessionize, {})))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_user_of_half_of_all_rows_is_in_many_parts(spark):
    rows = spark.createDataFrame(activity(5, 600), SCHEMA).select(F.col("user_id").alias("of"), "ts", "event_id")
    parts = segments.ranged(rows, "of", "ts", "event_id", ranges=8)
    assert parts.filter("of = 7").select("part").distinct().count() >= 4 and parts.groupBy("part").count().agg(F.max("count")).first()[0] < 200


@pytest.mark.parametrize("seed, n, ranges", [(1, 500, 9), (2, 500, None), (3, 14, 14), (4, 0, 3)])
def test_stages(spark, seed, n, ranges):
    rows = activity(seed, n)
    at, want = {}, []
    for number, _, user, event in sorted(rows, key=lambda r: r[0]):
        if user is None or event is None:
            continue
        before = at.get(user, "idle")
        at[user] = segments.NEXT.get((before, event), before)
        want.append((user, number, event, before, at[user], (before, event) in segments.NEXT))
    got = segments.stages(spark.createDataFrame(rows, SCHEMA), "user_id", "event_id", F.col("event"), ranges)
    assert got.columns == ["user_id", "event_id", "event", "before", "after", "allowed"] and sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_markers_count_in_their_order_only(spark):
    def turn(*said):
        return [(u, START + dt.timedelta(seconds=s), m) for u, s, m in said]

    rows = turn(
        (1, 0, "token"), (1, 1, "start"), (1, 2, "audio"), (1, 3, "queued"), (1, 4, "token"), (1, 5, "reply"), (1, 6, "queued"), (1, 7, "spoken"), (1, 8, "audio"), (1, 9, "audio"), (1, 10, "spoken"),
        (1, 11, "start"), (1, 12, "token"), (1, 13, None), (2, 1, "start"), (2, 1, "token"), (2, 2, "reply"), (2, 3, "queued"), (3, 1, "reply"),
    )
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "event_id long, user_id long, ts timestamp, marker string")
    base = int(START.timestamp())
    got = {(r.user_id, r.turn): [None if x is None else x // 1_000_000 - base for x in tuple(r)[2:]] for r in segments.turn_markers(df, "user_id", "event_id", F.col("marker")).collect()}
    assert got == {(1, 1): [1, 4, 6, 8, 5, 10], (1, 2): [11, 12, None, None, None, None], (2, 1): [1, 1, 3, None, 2, None]}


def test_upserts_run_again_change_nothing(spark, tmp_path):
    path, schema = f"{tmp_path}/table", "k long, at long, v string"
    for part in ([(1, 1, "a"), (2, 5, "b")], [(1, 3, "c"), (2, 4, "late"), (3, 1, "d")], [(3, 1, "same order, later batch")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        folds.upserts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), path, f"{tmp_path}/checkpoint", "k", "at", "v")
    want = [(1, "c", 3), (2, "b", 5), (3, "same order, later batch", 1)]
    assert sorted(tuple(r) for r in folds.upserted(spark, path, "k", "at", "v").collect()) == want
    # As after a kill between writing and committing: the batch's folder is there, its commit isn't, and the query runs it again.
    (tmp_path / "checkpoint/commits/2").unlink()
    (tmp_path / "checkpoint/commits/.2.crc").unlink(missing_ok=True)
    folds.upserts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), path, f"{tmp_path}/checkpoint", "k", "at", "v")
    assert sorted(tuple(r) for r in folds.upserted(spark, path, "k", "at", "v").collect()) == want
    assert sorted(tuple(r) for r in folds.compacted(spark, path, f"{tmp_path}/whole", "k", "at", "v").collect()) == want


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    schema = "k long, at long, v string"
    for k in range(2):
        spark.createDataFrame([(k, k, "v")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ordered.run(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1]
