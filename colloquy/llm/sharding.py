"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table (offset and step from hashes
of its name). Shards take turns; at its turn a shard claims the first slot of its permutation that
is still free (a shard of weight w takes w turns a round). The table's size is a parameter, not the
data's, so it is broadcast whole, and a row's shard is one hash and one lookup: no shuffle. A shard
that joins or leaves moves little more than its own share of the rows.

Defined results: rows of one id go to one shard; a null id is placed by its text (null text counts
as empty); an empty table gives an empty result; other columns are carried, and an existing column
named like the result's is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import fresh, table

SLOTS = 65_537
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _digest(name: str, purpose: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8, person=purpose.encode()).digest(), "big")


@lru_cache(maxsize=8)
def fill(shards: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None) -> np.ndarray:
    """The shard's index in `shards` for every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime, and no less than the number of shards")
    step = [_digest(s, "step") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    at = [_digest(s, "offset") % slots for s in shards]
    turns = [k for k in range(len(shards)) for _ in range(weights[k] if weights else 1)]
    owner, free = [-1] * slots, slots
    while free:
        for k in turns:
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return np.array(owner, np.int32)


def slot_of(id_column: Column, text: Column, slots: int = SLOTS) -> Column:
    key = F.coalesce(id_column.cast("string"), F.concat(F.lit("text:"), F.xxhash64(F.coalesce(text, F.lit(""))).cast("string")))
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def shard(docs: DataFrame, shards: Sequence[str] = SHARDS, slots: int = SLOTS, weights: Sequence[int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `slot` and `shard`."""
    owner = fill(tuple(shards), slots, tuple(weights) if weights else None)
    rest = docs.drop("slot", "shard")
    at, to = fresh(rest, "at", "to")
    lookup = docs.sparkSession.createDataFrame(pd.DataFrame({at: np.arange(slots, dtype=np.int32), to: np.array(shards)[owner]}), f"`{at}` int, `{to}` string")
    placed = rest.withColumn("slot", slot_of(F.col(id_col), F.col(text_col), slots))
    return placed.join(F.broadcast(lookup), placed["slot"] == lookup[at]).withColumn("shard", lookup[to]).drop(at, to)


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """One folder a shard. A large shard is dealt to several tasks and files, by its counted rows."""
    files, file = fresh(sharded, "files", "file")
    counted = sharded.groupBy("shard").agg(F.ceil(F.count("*") / rows_per_file).cast("long").alias(files))
    dealt = sharded.join(F.broadcast(counted), "shard").withColumn(file, F.floor(F.rand(7) * F.col(files)))
    dealt.repartition("shard", file).drop(files, file).write.partitionBy("shard").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")
