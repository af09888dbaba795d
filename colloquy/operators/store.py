"""The session store as tables: rows (session_id, profile, created_at, updated_at, last_access), and commands on them.

Each operator takes the store and returns it changed, or rows of answers. `now` is a column, so that a run is
the same when it is repeated. Activity decides about expiry; a lookup refreshes only the access. Limits that aren't given are the session's
settings. Other columns of a store are kept by `prune`, `trim`, `lookup` and `append`, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import preview
from colloquy.operators.sessions import is_expired
from colloquy.settings import settings
from colloquy.tables import fresh


def prune(stored: DataFrame, now: Column, minutes: int | None = None) -> DataFrame:
    """The sessions that haven't expired; a null activity never does."""
    limit = settings(stored.sparkSession).session_ttl_minutes if minutes is None else minutes
    return stored.filter(F.coalesce(~is_expired(F.col("updated_at"), now, limit), F.lit(True)))


def trim(stored: DataFrame, most: int | None = None) -> DataFrame:
    """The most recently accessed sessions: a top-k, not a global sort. `eviction.replay` is exact where sessions expire or are deleted meanwhile."""
    kept = settings(stored.sparkSession).max_sessions if most is None else most
    return stored.orderBy(F.desc("last_access"), F.desc("updated_at"), "session_id").limit(kept)


def create(stored: DataFrame, new: DataFrame, now: Column, most: int | None = None) -> DataFrame:
    """The store after sessions of rows (session_id, profile) are created: what has expired goes, then the least recently accessed beyond `most`."""
    made = new.select("session_id", "profile", *(now.cast("timestamp").alias(c) for c in ("created_at", "updated_at", "last_access")))
    return trim(prune(stored, now).select(*made.columns).unionByName(made), most)


def lookup(stored: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """The sessions of rows (session_id) that are there and haven't expired, their access refreshed."""
    found = prune(stored, now).join(ids.select("session_id").distinct(), "session_id", "left_semi")
    return found.withColumn("last_access", now.cast("timestamp"))


def append(stored: DataFrame, messages: DataFrame) -> DataFrame:
    """The store after messages (session_id, created_at): a session was last active at its newest one. Accesses don't change."""
    (newest,) = fresh(stored, "newest")
    found = messages.groupBy("session_id").agg(F.max("created_at").alias(newest))
    return stored.join(found, "session_id", "left").withColumn("updated_at", F.greatest("updated_at", newest)).select(*stored.columns)


def roll_back(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages without the last one of each of rows (session_id), whoever added it. Its time counts no more for last activity."""
    last = messages.join(sessions.select("session_id").distinct(), "session_id", "left_semi").groupBy("session_id").agg(F.max("turn").alias("turn"))
    return messages.join(last, ["session_id", "turn"], "left_anti")


def last_activity(stored: DataFrame, messages: DataFrame) -> DataFrame:
    """Rows (session_id, updated_at): the last message's time, or the session's own where it has none."""
    newest = messages.groupBy("session_id").agg(F.max_by("created_at", "turn").alias("newest"))
    return stored.select("session_id", "created_at").join(newest, "session_id", "left").select("session_id", F.coalesce("newest", "created_at").alias("updated_at"))


def listed(stored: DataFrame, messages: DataFrame, now: Column) -> DataFrame:
    """Summaries (session_id, profile, message_count, created_at, updated_at, preview) of sessions that haven't expired, the newest activity first.

    Sessions of one time keep the order of access.
    """
    said = F.when(F.col("role") == "user", F.col("turn"))
    of = messages.groupBy("session_id").agg(F.count("*").alias("message_count"), preview(F.min_by("content", said)).alias("preview"), F.max(said).isNotNull().alias("spoken"))
    rows = prune(stored, now).select("session_id", "profile", "created_at", "updated_at", "last_access").join(of, "session_id", "left")
    return rows.orderBy(F.desc("updated_at"), "last_access", "session_id").select(
        "session_id", "profile", F.coalesce("message_count", F.lit(0)).cast("long").alias("message_count"), "created_at", "updated_at", F.when(F.col("spoken"), F.col("preview")).alias("preview")
    )


def resolve(requests: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """Requests (request_id, session_id, profile) with their stored session, or a new one where it is missing, blank or expired.

    A given profile replaces the stored one. The new id is a hash of the request, so that a task that runs again gives the same.
    """
    known = prune(stored, now).select(F.col("session_id").alias("known"), F.col("profile").alias("kept"))
    asked = requests.select("request_id", F.col("session_id").alias("asked"), F.col("profile").alias("given"))
    found = asked.join(known, F.nullif("asked", F.lit("")) == F.col("known"), "left")
    return found.select(
        "request_id",
        F.coalesce("known", F.md5(F.col("request_id").cast("string"))).alias("session_id"),
        F.coalesce("given", "kept").alias("profile"),
        F.col("known").isNull().alias("created"),
    )
