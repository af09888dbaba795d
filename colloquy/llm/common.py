"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.tables import fresh, shared_dir, staged

__all__ = ["fresh", "shared_dir", "staged"]

#: Words are runs of anything but the six ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"

#: A side of a join is broadcast only below this many rows (of a few dozen bytes each).
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowered(text: Column) -> Column:
    """A-Z only, as the contracts say; other letters keep their case. Null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def held_out(doc_id: Column, folds: int) -> Column:
    """True for one fold in `folds`; a null id is in training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A staged df with a broadcast hint if its counted rows are few; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined by `key` with keyed, a staged table of one row for each key and the number of rows that have it.

    Keys of more than a thousandth of all rows, which are fewer than a thousand, are broadcast, so that their rows
    stay where they are; only the others are shuffled.
    """
    most = (keyed.agg(F.sum(count)).first()[0] or 0) / 1000
    (hot,) = fresh(rows.join(keyed.limit(0), key), "hot")
    few = keyed.filter(F.col(count) > most).drop(count)
    flagged = rows.join(F.broadcast(few.select(key).withColumn(hot, F.lit(True))), key, "left")
    here = rows.join(F.broadcast(few), key)
    return here.union(flagged.filter(F.col(hot).isNull()).drop(hot).join(keyed.filter(F.col(count) <= most).drop(count), key))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every node of `edges` (a, b: long), as rows (node, component).

    Alternates "large star" and "small star" steps: each joins a node's larger (or smaller)
    neighbours to its smallest one, so that components shrink to stars around their smallest id in a
    logarithmic number of rounds. Each round is two aggregations with partial sums and joins on the
    node; its edges are written to the shared folder. Self-loops, repeated and empty edges are fine.
    """

    def stars(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            new = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            least = down.groupBy("a").agg(F.min("b").alias("m"))
            new = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        return new.filter("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = staged(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "edges")
    before = state(e)
    while before[0]:
        e = staged(stars(stars(e, large=True), large=False), "edges")
        now = state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
