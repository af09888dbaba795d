"""Line dedup by range-partitioned hashes: only hashes travel, and what comes back is a bitmap a document.

A line's key is the line without blanks at its ends, A-Z lowered. Of every line whose key is long enough a row
(two hashes of the key, document, text hash, position) is sent, range-partitioned by all of these, the larger document first, and
written in that order. As document and position belong to the order too, a key of any number of lines is cut at the borders of
ranges, which hold about equally many rows. Within a range the rows of a key stream by: those of its first document
stay, and those of later ones go if there are enough documents. The keys on the borders of ranges, fewer than there are
ranges, are decided by an aggregation with partial sums and broadcast.

Lost lines come together as sparse bitmaps: words of 64 lines, only those that lose one. A document is a doc_id: rows
of one doc_id count once and share the decision; the hash of the text tells their positions apart. Everything is
DataFrame functions.

Defined results: a null or empty text is one empty line; null ids are one document, smaller than all others; repeated rows
each get the same result; lines that differ in blanks at their ends or in the case of A-Z are one key, and stay or go as they are;
keys are told apart by 128 bits of hash; an empty table gives an empty result; other columns are kept, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.common import fresh, lowered, staged, table

#: Code points that a key must have, and documents that must hold it.
LEAST_LENGTH = 20
LEAST_DOCUMENTS = 3
#: Bitmaps are broadcast to the texts only below so many words of 64 lines (of 12 bytes).
BROADCAST_WORDS = 1_000_000
BLANK = " \t\n\x0b\f\r"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed_lines(docs: DataFrame, least_length: int) -> DataFrame:
    """Rows (a, b, doc, t, at): hashes of the key of every line that is long enough, its document and position."""
    key = F.transform(split_lines(lowered(F.col("text"))), lambda line: F.btrim(line, F.lit(BLANK)))
    rows = docs.select(F.col("doc_id").alias("doc"), text_hash(F.col("text")).alias("t"), F.posexplode(key).alias("at", "key"))
    long_enough = rows.filter(F.length("key") >= least_length)
    return long_enough.select(F.xxhash64("key").alias("a"), F.xxhash64(F.lit(13), "key").alias("b"), "doc", "t", "at")


def lost_lines(docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """Rows (doc, t, at): the lines that go."""
    order = [F.col("a"), F.col("b"), F.col("doc").desc_nulls_last(), F.col("at")]
    ranges = keyed_lines(docs, least_length).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(ranges.withColumn("part", F.spark_partition_id()), "line-ranges")
    # Keys that go over a border are the last of one range and the first of the next: fewer than there are ranges.
    ends = rows.groupBy("part").agg(F.min(F.struct("a", "b")).alias("least"), F.max(F.struct("a", "b")).alias("most"))
    met = ends.select("part", F.explode(F.array_distinct(F.array("least", "most"))).alias("k")).select("part", "k.a", "k.b")
    border = staged(met.groupBy("a", "b").count().filter("count > 1").select("a", "b"), "line-borders")
    documents = rows.join(F.broadcast(border), ["a", "b"], "left_semi").groupBy("a", "b", "doc").agg(F.lit(1).alias("one"))
    held = documents.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc").alias("first")).filter(F.col("n") >= least_documents).select("a", "b", "first")
    over = rows.join(F.broadcast(held), ["a", "b"]).filter(~F.col("doc").eqNullSafe(F.col("first")))
    key = W.partitionBy("part", "a", "b")
    inside = rows.join(F.broadcast(border), ["a", "b"], "left_anti")
    ranked = inside.withColumn("place", F.dense_rank().over(key.orderBy(F.col("doc").desc_nulls_last())))
    counted = ranked.withColumn("documents", F.max("place").over(key))
    gone = counted.filter((F.col("place") > 1) & (F.col("documents") >= least_documents))
    return gone.select("doc", "t", "at").union(over.select("doc", "t", "at"))


def bitmaps(docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """Rows (doc, t, lost): of each document that loses lines, by the hash of its text, the words of its bitmap that aren't zero.

    lost: array of (word, bits) in order; bit k of word w stands for line 64 w + k, counted from 0.
    """
    bits = lost_lines(docs, least_length, least_documents).groupBy("doc", "t", F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63))).alias("bits"))
    return bits.groupBy("doc", "t").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("lost"))


def kept_lines(lines: Column, lost: Column) -> Column:
    """The lines that a bitmap leaves; a null one leaves all."""
    words = F.map_from_entries(lost)
    dense = F.transform(F.sequence(F.lit(0), F.element_at(lost, -1)["word"]), lambda w: F.coalesce(F.try_element_at(words, w), F.lit(0).cast("long")))
    bit = lambda bits, i: F.call_function("shiftrightunsigned", F.coalesce(F.get(bits, F.shiftright(i, 6)), F.lit(0).cast("long")), i.bitwiseAND(63)).bitwiseAND(1)
    # The dense words are the one element of an array, so that they are made once a document.
    return F.when(lost.isNull(), lines).otherwise(F.flatten(F.transform(F.array(dense), lambda bits: F.filter(lines, lambda _, i: bit(bits, i) == 0))))


def dedup_lines(docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """docs with their text as far as its lines stay, and n_lines and n_dropped (with _ at the end where docs has such columns)."""
    t, of, which, lost, n, dropped = fresh(docs, "t", "of", "which", "lost", "n_lines", "n_dropped")
    maps = staged(bitmaps(docs, least_length, least_documents), "line-bitmaps").select(F.col("doc").alias(of), F.col("t").alias(which), F.col("lost").alias(lost))
    few = (maps.agg(F.sum(F.size(lost))).first()[0] or 0) <= BROADCAST_WORDS
    rows = docs.withColumn(t, text_hash(F.col("text")))
    met = rows.join(F.broadcast(maps) if few else maps, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(t) == F.col(which)), "left")
    lines = split_lines(F.col("text"))
    counted = F.coalesce(F.aggregate(lost, F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w["bits"])), F.lit(0).cast("long"))
    out = met.withColumns({n: F.size(lines).cast("long"), dropped: counted, "text": F.array_join(kept_lines(lines, F.col(lost)), "\n")})
    return out.select(*docs.columns, n, dropped)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP13_SQL = r"""WITH lines AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT doc_id, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines),
held AS (SELECT key, max(doc_id) AS first FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
flagged AS (SELECT doc_id, pos, line, first IS NOT NULL AND doc_id <> first AS gone FROM keyed LEFT JOIN held USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM flagged GROUP BY doc_id"""
