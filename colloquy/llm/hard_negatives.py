"""Hard-negative mining by slots: which negatives score just below each of an anchor's positives.

A positive's window ends at its own score. An anchor's windows overlap, but their ends cut the scores into disjoint
slots: slot k holds what is above positive k + 1 and not above positive k. So every negative belongs to one
slot, the first few of a slot are all that any window needs of it, and a window's answer is the merge of its slot and all below,
cut at the window's lower end. Merging from the lowest slot up answers all windows of an anchor.

Anchors are taken in blocks of a bounded number of components, which is what is broadcast; the rows stay where they are and are
read twice a block, once for the positives and once for the slots. Each task multiplies batches of rows by
the block and keeps the first few of each anchor (or slot): these few are shuffled, never pairs. So neither a label nor a vector
of many rows makes a large group.

Defined results: rows of a null vec_id or label, a null vector, or one with null or non-finite components take no part; vectors of
unlike lengths have no score; repeated rows are rows of their own, but a repeated anchor counts once and a row is no positive of an anchor of
its vec_id; an anchor without positives, and a positive without negatives in its window, has no rows; scores are exact as long as
they are below 2^53, and rounded beyond; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.common import staged, table

POSITIVES = NEGATIVES = 5
#: A negative scores at least so many hundredths of its positive.
LEAST_PERCENT = 80
SCALE = 256
#: Components of a block of anchors (32 MB), and scores that a task computes at a time.
BLOCK_NUMBERS, SCORES = 2**22, 2**21

FOUND = "a int, anchor_id long, slot int, score long, id long"
RANKED = "array<struct<minus:bigint,id:bigint>>"


def usable(rows: DataFrame, label: Column) -> DataFrame:
    """Rows (vec_id, label, v): what takes part, v its components as whole numbers."""
    clean = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    most = F.lit(2.0**53)
    whole = F.transform("embedding", lambda x: F.greatest(-most, F.least(most, F.floor(F.greatest(-most, F.least(most, SCALE * x.cast("double")))).cast("double"))))
    return rows.select("vec_id", label.alias("label"), F.when(clean, whole).alias("v")).filter("vec_id is not null and label is not null and v is not null")


def by_length(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length."""
    offsets, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    length = np.diff(offsets)
    for d in np.unique(length):
        at = np.flatnonzero(length == d)
        yield at, flat[offsets[at][:, None] + np.arange(d)]


def first_few(rows: np.ndarray, most: int) -> np.ndarray:
    """Of columns (group, score, id, ...) the first `most` of each group: higher scores first, ties by smaller id."""
    rows = rows[:, np.lexsort((rows[2], -rows[1], rows[0]))]
    starts = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]][: rows.shape[1]])
    place = np.arange(rows.shape[1]) - np.repeat(starts, np.diff(np.r_[starts, rows.shape[1]]))
    return rows[:, place < most]


class Anchors:
    """A block of anchors, and the first few rows of each of their slots that were seen so far."""

    def __init__(self, ids: list, labels: list, vectors: list, ends: list | None = None):
        """ends: by anchor its positives' scores, highest first; None while these are sought, when there is one slot."""
        self.ids, self.labels = np.array(ids, dtype=np.int64), np.array(labels)
        self.vectors = dict((m.shape[1], (at, m)) for at, m in by_length(pa.array(vectors, pa.list_(pa.float64()))))
        self.ends = None
        if ends is not None:
            self.ends = np.array([[*e, *[-np.inf] * (POSITIVES - len(e))] for e in ends]).reshape(-1, POSITIVES)
            self.lows = np.where(self.ends >= 0, np.ceil(self.ends * LEAST_PERCENT / 100), np.inf).min(axis=1, initial=np.inf)
        self.slots = 1 if ends is None else POSITIVES
        self.most = POSITIVES if ends is None else NEGATIVES
        self.kept = np.zeros((3, 0), dtype=np.int64)
        self.least = np.full(len(ids) * self.slots, -np.inf)

    def see(self, ids: np.ndarray, labels: np.ndarray, m: np.ndarray) -> None:
        at, mine = self.vectors.get(m.shape[1], ([], None))
        step = max(1, SCORES // max(1, len(at)))
        for k in range(0, len(m) if len(at) else 0, step):
            scores = np.clip(m[k : k + step] @ mine.T, -(2.0**62), 2.0**62)
            same = labels[k : k + step, None] == self.labels[at]
            if self.ends is None:
                wanted = same & (ids[k : k + step, None] != self.ids[at]) & (scores >= self.least[at])
            else:
                wanted = ~same & (scores <= self.ends[at, 0]) & (scores >= self.lows[at])
            r, c = np.nonzero(wanted)
            score, a = scores[r, c], at[c]
            group = a
            if self.ends is not None:
                slot = (score[:, None] <= self.ends[a]).sum(axis=1) - 1
                group = a * self.slots + slot
                fits = (LEAST_PERCENT * self.ends[a, slot] <= 100 * score) & (score >= self.least[group])
                r, score, group = r[fits], score[fits], group[fits]
            if len(r):
                new = np.stack([group, score.astype(np.int64), ids[k + r]])
                self.kept = first_few(np.concatenate([self.kept, new], axis=1), self.most)
                full = np.flatnonzero(np.bincount(self.kept[0], minlength=len(self.least)) == self.most)
                ends = np.searchsorted(self.kept[0], full, side="right") - 1
                self.least[full] = self.kept[1][ends]

    def rows(self) -> pa.RecordBatch:
        group, score, ids = self.kept
        a = group // self.slots
        columns = [pa.array(a, pa.int32()), pa.array(self.ids[a]), pa.array(group % self.slots, pa.int32()), pa.array(score), pa.array(ids)]
        return pa.RecordBatch.from_arrays(columns, names=["a", "anchor_id", "slot", "score", "id"])


def seen(rows: DataFrame, block: tuple) -> DataFrame:
    """FOUND: the first few rows of each anchor's slots, of each task. block: what Anchors is made of."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(*sent.value)
        for batch in batches:
            ids, labels = np.asarray(batch.column("vec_id")), np.asarray(batch.column("label"))
            for at, m in by_length(batch.column("v")):
                anchors.see(ids[at], labels[at], m)
        yield anchors.rows()

    few = rows.mapInArrow(run, FOUND)
    place = F.row_number().over(W.partitionBy("a", "slot").orderBy(F.desc("score"), "id"))
    return few.withColumn("place", place).filter(F.col("place") <= max(POSITIVES, NEGATIVES)).drop("place")


def answers(found: Column, n: Column) -> Column:
    """By positive (n of them, highest first) the first negatives not above it, found: (slot, minus, id) of the anchor's slots."""
    slot = lambda k: F.transform(F.filter(found, lambda x: x["slot"] == k), lambda x: F.struct(x["minus"], x["id"]))
    merged = lambda below, k: F.slice(F.sort_array(F.concat(below, slot(k))), 1, NEGATIVES)
    none = F.array(F.array().cast(RANKED))
    return F.aggregate(F.sequence(n - 1, F.lit(0), F.lit(-1)), none, lambda done, k: F.concat(F.array(merged(done[0], k)), done))


def mined(rows: DataFrame, block: DataFrame) -> DataFrame:
    """The result for one block of anchors, a few rows (vec_id, label, v)."""
    part = block.orderBy("vec_id", "label", "v").toPandas()
    base = [part["vec_id"].tolist(), part["label"].tolist(), [list(v) for v in part["v"]]]
    positives = staged(
        seen(rows, tuple(base)).groupBy("a", "anchor_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("positives")), "hard-positives"
    )
    ends = {r.a: [-p.minus for p in r.positives] for r in positives.select("a", "positives").collect()}
    slots = seen(rows, (*base, [ends.get(a, []) for a in range(len(part))]))
    found = slots.groupBy("a").agg(F.collect_list(F.struct("slot", (-F.col("score")).alias("minus"), "id")).alias("found"))
    both = positives.join(found, "a").withColumn("answers", answers(F.col("found"), F.size("positives")))
    each = both.select("anchor_id", F.explode(F.arrays_zip("positives", F.slice("answers", F.lit(1), F.size("positives")).alias("answers"))).alias("x"))
    floor = lambda n: LEAST_PERCENT * F.col("x.positives.minus") >= 100 * n["minus"]
    ranked = each.select("anchor_id", "x.positives", F.posexplode(F.filter("x.answers", floor)).alias("at", "n"))
    return ranked.select(
        "anchor_id",
        F.col("positives.id").alias("positive_id"),
        (F.col("at") + 1).alias("rank"),
        F.col("n.id").alias("negative_id"),
        (-F.col("positives.minus")).alias("positive_score"),
        (-F.col("n.minus")).alias("negative_score"),
    )


def hard_negatives(rows: DataFrame, label: Column, is_anchor: Column) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, embedding, ...).

    label says what is alike, is_anchor which rows are anchors (of vec_id and label).
    """
    known = staged(usable(rows, label), "hard-rows")
    anchors = known.filter(is_anchor).distinct()
    size = anchors.agg(F.sum(F.greatest(F.size("v"), F.lit(1)))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_NUMBERS))
    numbered = staged(anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))), "hard-anchors")
    done = [staged(mined(known, numbered.filter(F.col("block") == b).drop("block")), "hard-negatives") for b in range(blocks)]
    return reduce(DataFrame.union, done)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


OP11_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.v) = len(r.v)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
