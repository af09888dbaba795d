"""Session operators over messages (session_id, turn, role, content) and timed activity (key, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.functions.text import preview, strip
from colloquy.settings import Settings, settings

TTL_MINUTES = Settings.session_ttl_minutes


def summaries(messages: DataFrame) -> DataFrame:
    """(session_id, message_count, preview, last_turn): one aggregation with partial sums."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("session_id").agg(F.count("*").alias("message_count"), preview(first).alias("preview"), F.max("turn").alias("last_turn"))


def transcripts(messages: DataFrame) -> DataFrame:
    """(session_id, messages) in order, one row a session: for sessions that fit in a row. `transcript_parts` bounds the rows of any session."""
    of = F.sort_array(F.collect_list(F.struct("turn", "role", "content")))
    return messages.groupBy("session_id").agg(F.transform(of, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def transcript_parts(messages: DataFrame, turns: int = 500) -> DataFrame:
    """(session_id, part, messages): a transcript in parts of at most `turns` turns, so that a session of any length has small groups."""
    cut = messages.withColumn("part", F.floor(F.col("turn") / turns))
    of = F.sort_array(F.collect_list(F.struct("turn", "role", "content")))
    return cut.groupBy("session_id", "part").agg(F.transform(of, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def history(messages: DataFrame, last: int | None = None) -> DataFrame:
    """The last messages of every session, as many as the settings say where `last` isn't given; all of them if it isn't positive."""
    last = settings(messages.sparkSession).max_history_messages if last is None else last
    if last <= 0:
        return messages
    place = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("turn")))
    rows = messages.select(F.struct(*messages.columns).alias("row"), "session_id", "turn").withColumn("place", place)
    return rows.filter(F.col("place") <= last).select("row.*")


def last_activity(activity: DataFrame, key: str) -> DataFrame:
    return activity.groupBy(key).agg(F.max("ts").alias("updated_at"))


def is_expired(updated_at: Column, now: Column, minutes: int = TTL_MINUTES) -> Column:
    return updated_at < now - F.make_interval(mins=F.lit(minutes))


def gap_of(activity: DataFrame, seconds: float | None) -> int:
    """Microseconds of a gap; the settings' time to live where none is given."""
    return int((settings(activity.sparkSession).session_ttl_minutes * 60 if seconds is None else seconds) * 1e6)


def sessionize(activity: DataFrame, key: str, seconds: float | None = None, order: str = "event_id") -> DataFrame:
    """activity with session_no (from 1) by key: a new one after a gap of more than `seconds`. `segments.sessionize` spreads a key of very many rows over tasks."""
    rows = activity.select(F.struct(*(c for c in activity.columns if c.lower() != "session_no")).alias("row"), F.col(key).alias("of"), "ts", F.col(order).alias("at"))
    of = W.partitionBy("of").orderBy("ts", "at")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(of)
    new = F.coalesce((gap > gap_of(activity, seconds)).cast("int"), F.lit(1))
    return rows.withColumn("new", new).withColumn("session_no", F.sum("new").over(of)).select("row.*", "session_no")


def within_capacity(accessed: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """The sessions kept by least-recently-used eviction, if none expires or is deleted meanwhile: a top-k, not a global sort."""
    return accessed.orderBy(F.desc("updated_at"), key).limit(settings(accessed.sparkSession).max_sessions if most is None else most)


def delete(stored: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions left, commands with `deleted`)."""
    ids = commands.select("session_id").distinct()
    answered = ids.join(stored.select("session_id").distinct().withColumn("there", F.lit(True)), "session_id", "left")
    return stored.join(ids, "session_id", "left_anti"), answered.select("session_id", F.coalesce("there", F.lit(False)).alias("deleted"))


def latest(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Upserts by key: the last value wins."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def stage_changes(activity: DataFrame, key: str, order: str, stage: Column) -> DataFrame:
    """(key, order, before, after) where a key's stage changes; it begins idle, and rows of null stage leave it as it is."""
    rows = activity.select(key, order, stage.alias("after")).filter("after is not null")
    before = F.coalesce(F.lag("after").over(W.partitionBy(key).orderBy(order)), F.lit("idle"))
    return rows.withColumn("before", before).filter("before <> after").select(key, order, "before", "after")


def without_rolled_back(messages: DataFrame, failed: DataFrame) -> DataFrame:
    """Messages whose request didn't fail: a failed request's user message is taken back."""
    return messages.join(failed.select("session_id", "turn"), ["session_id", "turn"], "left_anti")


def replies(tokens: DataFrame) -> DataFrame:
    """(request_id, reply, n_tokens) of rows (request_id, seq, token): ordered concatenation of what isn't empty, stripped."""
    some = tokens.filter(F.coalesce("token", F.lit("")) != "")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "token"))), lambda x: x["token"]), "")
    return some.groupBy("request_id").agg(strip(text).alias("reply"), F.count("*").alias("n_tokens"))
