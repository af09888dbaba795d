"""Mixing sources to target weights by temperature.

A source's weight is its share of all words to the power of an exponent (1: as they come, 0: all
alike), normalised. The exponent is bisected: the largest in [0, 1] whose weights reach a target
entropy, but no smaller than the one at which some source would be passed more often than the
repetition limit. A source's epochs are its part of the budget over its words. They are realised
by blocks: a source is dealt by hash to blocks of about `block_words` words and `block_rows` rows, each block is
permuted by an epoch's own hash, whole epochs take all of it, and the last one takes rows in that order up to
the block's budget. So a source of any size is spread over many small windows. Repeated rows are one row with a
number of copies until they are placed, so that no key makes a block large.

Sums over sources are aggregations, also for a source a host; a few numbers of each round of the search come to
the driver. One job tries `cuts` exponents of an interval at once, so that a round narrows it as several bisections do.
DataFrame functions only.

Defined results: a null source is a source; sources without words get weight 0 and are passed once;
null texts have no words; rows of the same id, or of null id and the same text, are taken together;
repeated rows are kept as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.common import small_or_shuffled, staged, table


#: Copies of a repeated row that one task writes at most.
COPIES_OF_PART = 10_000


@dataclass(frozen=True)
class Mix:
    """entropy: target, as a share of the entropy of equal weights. repetition: most epochs of a source.
    budget_words: of the result; None is the smallest that passes every source at least once."""

    entropy: float = 0.97
    repetition: float = 4.0
    budget_words: float | None = None
    block_words: int = 250_000
    block_rows: int = 100_000
    cuts: int = 64
    rounds: int = 6


PRODUCTION = Mix()


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_key(id_column: Column, text: Column) -> Column:
    return F.coalesce(F.xxhash64(id_column.cast("string"), F.when(id_column.isNull(), F.coalesce(text, F.lit("")))), F.lit(0))


def source_words(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Narrow rows (doc_id, source, k, words): all that the decisions need."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        row_key(F.col(id_col), F.col(text_col)).alias("k"),
        word_count(F.col(text_col)).alias("words"),
    )


def exponent(sources: DataFrame, mix: Mix) -> float:
    """Searches over rows (words) of the sources."""
    some = sources.filter("words > 0")
    n, words = some.agg(F.count("*"), F.sum("words")).first()
    if n < 2:
        return 1.0
    share = F.col("words") / float(words)

    def weighed(exponents: list[float]) -> list[tuple[float, float]]:
        """The entropy at each exponent, and the most epochs of a source."""
        tried = some.select(share.alias("share"), F.posexplode(F.array(*map(F.lit, exponents))).alias("k", "a")).withColumn("p", F.pow("share", "a"))
        sums = tried.groupBy("k").agg(F.sum("p").alias("total"), F.sum(F.col("p") * F.ln("p")).alias("plogp"), F.max(F.col("p") / F.col("share")).alias("most"), F.min(F.col("p") / F.col("share")).alias("least"))
        budget = mix.budget_words and mix.budget_words / words
        return [(math.log(r.total) - r.plogp / r.total, (budget / r.total if budget else 1 / r.least) * r.most) for r in sums.orderBy("k").collect()]

    def smallest(holds) -> float:
        """Of the exponents that hold, which are all above some point, the smallest; 1 if none."""
        low, high = 0.0, 1.0
        for _ in range(mix.rounds):
            between = [low + (high - low) * k / mix.cuts for k in range(mix.cuts)]
            held = [holds(x) for x in weighed(between)]
            first = held.index(True) if True in held else mix.cuts
            if first == 0:
                return low
            low, high = between[first - 1], high if first == mix.cuts else between[first]
        return high

    limit = smallest(lambda x: x[1] <= mix.repetition)
    target = smallest(lambda x: x[0] < mix.entropy * math.log(n))
    return max(limit, target)


def source_plan(narrow: DataFrame, mix: Mix) -> DataFrame:
    """Rows (source, words, weight, blocks, whole, part): epochs are `whole` passes and a `part` of one."""
    sources = staged(narrow.groupBy("source").agg(F.sum("words").alias("words"), F.count("*").alias("rows")), "mix-sources")
    a = exponent(sources, mix)
    words = float(sources.agg(F.sum("words")).first()[0] or 0)
    power = F.when(F.col("words") > 0, F.pow(F.col("words") / words, F.lit(a))).otherwise(0.0)
    total, least = sources.agg(F.sum(power), F.min(F.when(F.col("words") > 0, power / F.col("words")))).first()
    weight = power / total if total else F.lit(0.0)
    budget = float(mix.budget_words or (total / least if total else 0.0))
    epochs = F.round(F.when(F.col("words") > 0, weight / F.col("words") * budget).otherwise(1.0), 9)
    blocks = F.greatest(F.ceil(F.col("words") / mix.block_words), F.ceil(F.col("rows") / mix.block_rows))
    return staged(
        sources.select("source", "words", "rows", weight.alias("weight"), epochs.alias("epochs")).select(
            "source",
            "weight",
            "epochs",
            F.greatest(F.lit(1), blocks).cast("long").alias("blocks"),
            F.floor("epochs").cast("int").alias("whole"),
            (F.col("epochs") - F.floor("epochs")).alias("part"),
        ),
        "mix-plan",
    )


def block_of() -> Column:
    return F.pmod(F.xxhash64("k", F.lit("block")), F.col("blocks"))


def order_in(epoch: Column) -> Column:
    return F.xxhash64("k", epoch)


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (source, k, ...) with their source's plan, block and order in the epoch that is taken in part."""
    plan = small_or_shuffled(plan.withColumnRenamed("source", "plan_source"))
    return (
        rows.join(plan, rows["source"].eqNullSafe(F.col("plan_source")))
        .drop("plan_source")
        .withColumn("block", block_of())
        .withColumn("part_order", order_in(F.col("whole") + 1))
    )


def cuts(narrow: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (cut_source, cut_block, cut): the last place in a block's order that is within its budget."""
    block = W.partitionBy("source", "block")
    run = F.sum("words").over(block.orderBy("part_order").rangeBetween(W.unboundedPreceding, W.currentRow)) - F.col("words") / 2
    once = narrow.groupBy("source", "k").agg(F.sum("words").alias("words"))
    dealt = with_plan(once, plan.filter("part > 0"))
    taken = dealt.withColumn("run", run).withColumn("total", F.sum("words").over(block)).filter("run <= part * total")
    return staged(
        taken.groupBy(F.col("source").alias("cut_source"), F.col("block").alias("cut_block")).agg(F.max("part_order").alias("cut")),
        "mix-cuts",
    )


def repeated(rows: DataFrame, plan: DataFrame, cut: DataFrame) -> DataFrame:
    """rows (source, k, ...), each as often as it is taken, with epoch (from 1), block and weight."""
    cut = small_or_shuffled(cut)
    with_cut = with_plan(rows, plan).join(cut, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("block") == F.col("cut_block")), "left")
    copies = F.col("whole") + F.coalesce((F.col("part_order") <= F.col("cut")).cast("int"), F.lit(0))
    return with_cut.filter(copies > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1), copies)))


def mix_rows(docs: DataFrame, mix: Mix = PRODUCTION, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows (doc_id, source, words, weight, epoch, block, position): position is the place in the block's permutation of that epoch."""
    narrow = staged(source_words(docs, id_col, text_col, source_col), "mix-words")
    plan = source_plan(narrow, mix)
    once = narrow.groupBy("doc_id", "source", "k", "words").agg(F.count("*").alias("copies"))
    taken = repeated(once, plan, cuts(narrow, plan))
    order = W.partitionBy("source", "block", "epoch").orderBy(order_in(F.col("epoch")), F.col("doc_id"), F.col("words"))
    placed = taken.withColumn("after", F.sum("copies").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    # A row of many copies becomes parts first, which are spread over tasks.
    parts = placed.withColumn("first", F.explode(F.sequence(F.col("after") - F.col("copies") + 1, F.col("after"), F.lit(COPIES_OF_PART)))).repartition("source", "block", "epoch", "first")
    position = F.explode(F.sequence(F.col("first"), F.least(F.col("after"), F.col("first") + COPIES_OF_PART - 1)))
    return parts.select("doc_id", "source", "words", "weight", "epoch", "block", position.alias("position")).withColumn("position", F.col("position").cast("int"))


def mix_documents(docs: DataFrame, mix: Mix = PRODUCTION, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as it is taken; texts are read twice and not shuffled."""
    narrow = staged(source_words(docs, id_col, text_col, source_col), "mix-words")
    plan = source_plan(narrow, mix)
    rows = docs.select(
        F.col(source_col).alias("source"), row_key(F.col(id_col), F.col(text_col)).alias("k"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    )
    return repeated(rows, plan, cuts(narrow, plan)).select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix_rows(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", F.col("words").alias("n_words"), F.round("weight", 6).alias("weight"), "epoch", "block", "position")
