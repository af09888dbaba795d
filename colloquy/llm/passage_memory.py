"""What a corpus says twice: a memory of recurring passages, mixed into a language model's scores.

Texts are cut where their own words say so: after a place at which the hash of the last CONTEXT words falls on one
in ANCHORS. So the same passage is cut alike wherever it stands. The memory counts, over all training texts,
which segment of words follows which context. As usual for counts of long runs, segments seen once are pruned: a segment
that followed its context c >= 2 of n times has (c - DISCOUNT) / n, and what the kept segments leave of a context's
mass goes to the model. A text's probability is so, segment by segment, that of the memory plus the rest times the
model's; a text's first words, which have no context, are the model's alone. It stays a probability: a
segment ends where its own words end it, so that no segment is the beginning of another.

Only numbers are shuffled: a row of hashes for about ANCHORS words. Contexts that many texts share are broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import join_hot, staged

CONTEXT = 3
ANCHORS = 16
DISCOUNT = 0.5

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def segments(words: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after another (hashes of their words and ends; texts: how many each has): each segment's first place and text, the hashes of its context and of both.

    A text's first segment has context 0.
    """
    n = len(words)
    starts = np.cumsum(texts) - texts
    of = np.repeat(np.arange(len(texts)), texts)
    at = np.arange(n) - np.repeat(starts, texts)
    context = np.zeros(n, np.uint64)
    for k in range(CONTEXT):
        context[k:] += mixed(words[: n - k] + np.uint64((k + 1) * int(_ODD) % 2**64))
    context = mixed(context)
    # A segment begins after an anchor, and where a text does.
    anchor = (context % np.uint64(ANCHORS) == 0) & (at >= CONTEXT - 1)
    begins = np.concatenate([[True], anchor[:-1]]) | (at == 0) if n else np.empty(0, bool)
    first = np.flatnonzero(begins)
    before = np.where(at[first] == 0, np.uint64(0), context[np.maximum(first - 1, 0)])
    place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    run = np.add.reduceat(mixed(words + (place + 1).astype(np.uint64) * _ODD), first) if n else words
    return first, of[first], before, mixed(run + mixed(before + _ODD))


def learn(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (context, segment), one for each segment of the training texts: kept segments (segment, c, context) and contexts (context, n, kept, sure).

    sure is the sum of c - DISCOUNT over a context's kept segments.
    """
    counts = staged(seen.filter("context <> 0").groupBy("context", "segment").agg(F.count("*").alias("c")), "lm-segments")
    of = counts.groupBy("context").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("c") > 1, F.col("c") - DISCOUNT)).alias("sure"))
    contexts = staged(of.filter("sure is not null"), "lm-contexts")
    return counts.filter("c > 1"), contexts


def gains(rows: DataFrame, kept: DataFrame, contexts: DataFrame) -> DataFrame:
    """Rows (n, gain): by text what the memory adds to its log probability. rows: n, context, segment, log (the model's), one for each segment of a text."""
    found = join_hot(rows.withColumnRenamed("n", "row"), contexts.withColumn("seen", F.col("n")), "context", "seen").withColumn("left", F.ln(1 - F.col("sure") / F.col("n")))
    found = staged(found.select("row", "segment", "log", "n", "left"), "lm-met")
    met = join_hot(found, kept.select("segment", "c", F.col("c").alias("seen")), "segment", "seen")
    # The memory's share against the model's, as logarithms.
    x = F.ln((F.col("c") - DISCOUNT) / F.col("n")) - F.col("left") - F.col("log")
    more = F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    both = found.select("row", F.col("left").alias("gain")).union(met.select("row", more.alias("gain")))
    return both.groupBy(F.col("row").alias("n")).agg(F.sum("gain").alias("gain"))
