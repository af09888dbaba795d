"""Scans over ordered rows of keys of any size: a key is cut into segments, and what they carry goes over their borders.

Rows are range-partitioned by key and order together, so that ranges hold about equally many rows and one key of half
of all rows spans half of the ranges. Each range's part of a key is a segment and is scanned by itself. What a segment needs of those before it comes from a
summary of each segment of the keys that span ranges, fewer than twice as many as there are ranges.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.operators.sessions import gap_of
from colloquy.tables import staged

# The stages of a turn, the first one at the beginning, and the stage after an event where it is allowed.
STAGES = ("idle", "listening", "thinking", "speaking", "error")
NEXT = {
    ("idle", "listen"): "listening", ("error", "listen"): "listening", ("listening", "cancel"): "idle", ("listening", "submit"): "thinking",
    ("thinking", "token"): "speaking", ("speaking", "token"): "speaking", ("thinking", "reply"): "idle", ("speaking", "reply"): "idle", ("thinking", "fail"): "error", ("speaking", "fail"): "error",
}


def ranged(rows: DataFrame, *order: str, ranges: int | None = None) -> DataFrame:
    """rows in ranges of the order, numbered by `part`, as a table in the shared folder."""
    dealt = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    return staged(dealt.withColumn("part", F.spark_partition_id()), "ranges")


def spanning(rows: DataFrame) -> DataFrame:
    """The keys `of` that are in more than one part: each is a part's first or last."""
    ends = rows.groupBy("part").agg(F.min(F.struct("of")).alias("least"), F.max(F.struct("of")).alias("most"))
    each = ends.select("part", F.explode(F.array_distinct(F.array("least", "most"))).alias("k"))
    return each.groupBy("k").count().filter("count > 1").select(F.col("k.of").alias("key"))


def sessionize(activity: DataFrame, key: str, seconds: float | None = None, order: str = "event_id", ranges: int | None = None) -> DataFrame:
    """What `sessions.sessionize` gives, for keys of any number of rows: activity with session_no (from 1) by key."""
    limit = gap_of(activity, seconds)
    taken = F.struct(*(c for c in activity.columns if c.lower() != "session_no"))
    rows = ranged(activity.select(taken.alias("row"), F.col(key).alias("of"), F.unix_micros("ts").alias("us"), F.col(order).alias("at")), "of", "us", "at", ranges=ranges)
    inside = W.partitionBy("part", "of").orderBy("us", "at")

    def numbered(df: DataFrame) -> DataFrame:
        new = F.coalesce((F.col("us") - F.lag("us").over(inside) > limit).cast("long"), F.lit(1).cast("long"))
        return df.withColumn("new", new).withColumn("number", F.sum("new").over(inside))

    several = numbered(rows.join(F.broadcast(spanning(rows)), F.col("of").eqNullSafe(F.col("key")), "left_semi"))
    segments = several.groupBy("part", "of").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.max("number").alias("n"))
    along = W.partitionBy("of").orderBy("part")
    goes_on = F.coalesce((F.col("first") - F.lag("last").over(along) <= limit).cast("long"), F.lit(0).cast("long"))
    before = F.coalesce(F.sum("n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    carried = segments.withColumn("goes_on", goes_on).select(F.col("part").alias("in_part"), F.col("of").alias("key"), (before - F.sum("goes_on").over(along)).alias("offset"))
    found = numbered(rows).join(F.broadcast(carried), (F.col("part") == F.col("in_part")) & F.col("of").eqNullSafe(F.col("key")), "left")
    return found.withColumn("session_no", F.col("number") + F.coalesce("offset", F.lit(0).cast("long"))).select("row.*", "session_no")


def _after(stage: str, event: str) -> str:
    return NEXT.get((stage, event), stage)


def stages(activity: DataFrame, key: str, order: str, event: Column, ranges: int | None = None) -> DataFrame:
    """(key, order, event, before, after, allowed): the stage before and after each event of a key, which begins idle.

    An event that isn't allowed in its stage leaves it. A segment's summary is the stage at its end for each at its begin: these maps
    are composed along a key, and then each segment is run from its own begin. Rows of a null key, order or event are left out.
    """
    rows = activity.select(F.col(key).alias("of"), F.col(order).alias("at"), event.alias("event")).dropna()
    kinds = {c: t for c, t in rows.dtypes}
    rows = ranged(rows, "of", "at", ranges=ranges)

    def mapped(group: tuple, found: pd.DataFrame) -> pd.DataFrame:
        ends = list(STAGES)
        for event in found.sort_values("at")["event"]:
            ends = [_after(s, event) for s in ends]
        return pd.DataFrame({"part": [group[0]], "of": [group[1]], "ends": [ends]})

    def begun(group: tuple, found: pd.DataFrame) -> pd.DataFrame:
        found, stage, begins = found.sort_values("part"), STAGES[0], []
        for ends in found["ends"]:
            begins.append(stage)
            stage = ends[STAGES.index(stage)]
        return pd.DataFrame({"in_part": found["part"], "key": found["of"], "begin": begins})

    def run(found: pd.DataFrame) -> pd.DataFrame:
        found, stage, before, last = found.sort_values(["of", "at"]), STAGES[0], [], None
        for row in found.itertuples():
            stage = row.begin if row.of != last else stage
            last = row.of
            before.append(stage)
            stage = _after(stage, row.event)
        after = [_after(s, e) for s, e in zip(before, found["event"], strict=True)]
        allowed = [(s, e) in NEXT for s, e in zip(before, found["event"], strict=True)]
        return found[["of", "at", "event"]].assign(before=before, after=after, allowed=allowed)

    several = rows.join(F.broadcast(spanning(rows)), F.col("of") == F.col("key"), "left_semi")
    segments = several.groupBy("part", "of").applyInPandas(mapped, f"part int, of {kinds['of']}, ends array<string>")
    begins = segments.groupBy("of").applyInPandas(begun, f"in_part int, key {kinds['of']}, begin string")
    whole = rows.join(F.broadcast(begins), (F.col("part") == F.col("in_part")) & (F.col("of") == F.col("key")), "left")
    each = whole.select("part", "of", "at", "event", F.coalesce("begin", F.lit(STAGES[0])).alias("begin"))
    found = each.groupBy("part").applyInPandas(run, f"of {kinds['of']}, at {kinds['at']}, event string, before string, after string, allowed boolean")
    return found.select(F.col("of").alias(key), F.col("at").alias(order), "event", "before", "after", "allowed")


#: Markers of a turn after its start, and what each must follow.
MARKERS = {"token": ("start",), "queued": ("token",), "audio": ("queued",), "reply": ("start",), "spoken": ("audio", "reply")}


def turn_markers(activity: DataFrame, key: str, order: str, marker: Column) -> DataFrame:
    """(key, turn, start, token, queued, audio, reply, spoken): times in microseconds of each turn's markers, null where one is absent.

    A start begins a turn, and rows before the first start are in none. Of each marker the first counts that follows all it must follow; rows are in order of ts and then
    `order`. Running maxima over one sort: no row is looked at twice, and nothing is collected.
    """
    by = W.partitionBy("of").orderBy("us", "at")
    rows = activity.select(F.col(key).alias("of"), F.unix_micros("ts").alias("us"), F.col(order).alias("at"), marker.alias("marker")).filter("marker is not null")
    turns = rows.withColumn("turn", F.count_if(F.col("marker") == "start").over(by)).filter("turn > 0")
    inside = W.partitionBy("of", "turn").orderBy("us", "at")
    found = turns.withColumn("start", F.min(F.when(F.col("marker") == "start", F.col("us"))).over(inside))
    for name, after in MARKERS.items():
        seen = F.lit(True)
        for a in after:
            seen = seen & F.col(a).isNotNull()
        found = found.withColumn(name, F.min(F.when((F.col("marker") == name) & seen, F.col("us"))).over(inside))
    names = ("start", *MARKERS)
    return found.groupBy("of", "turn").agg(*(F.min(n).alias(n) for n in names)).select(F.col("of").alias(key), "turn", *names)
