"""Benchmark decontamination: which documents hold which test items.

An item is held if at least THRESHOLD of its distinct shingles of five words are among a document's.
Items are short and documents long, so that a document's own MinHash signature would almost never
hold an item's few shingles. The sketch is therefore the item's: items are partitioned by size, and
each partition keeps as many of the item's smallest hashes (a bottom-k MinHash sketch) as containment
needs: if THRESHOLD of s shingles are held, at most s - ceil(THRESHOLD * s) are not, so of one more
than that some is held. Documents probe the sketches with all of their shingles; a hit makes a
candidate, and candidates are verified by exact containment of the shingles themselves. So no item
is missed, at any length of document, and the probes meet only a few hashes an item.

Words are lower-cased runs of letters and digits, so that case, punctuation and spacing don't matter.
An item of fewer than five words has one shingle, all of its words, which a document may hold anywhere.

DataFrame functions only. The sketches are broadcast if they are counted to be few, else shuffled.

Defined results: null and wordless items are held by nothing, null and wordless texts hold nothing;
items of equal shingles are sought once and reported under each id (once for repeated ids); repeated
documents are reported once for each id; null ids are reported as null; empty tables give an empty
result; other columns are ignored, and carried by `drop_contaminated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import fresh, small_or_shuffled, staged, table

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Upper ends of the partitions of items by their number of shingles; each has its own size of sketch.
SIZES = [2**k for k in range(3, 40)]


def plain_words(text: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.coalesce(spaced, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def shingles(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """rows (words, ...) with a row for each place and size of shingle: n, shingle_hash and at (from 1)."""
    parts = []
    for n in sizes:
        place = rows.filter(F.size("words") >= n).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - n + 1)))
        parts.append(place.withColumn("n", F.lit(n)).withColumn("shingle_hash", F.xxhash64(*(F.element_at("words", F.col("at") + k) for k in range(n)))))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def shingle_text(n: Column) -> Column:
    return F.concat_ws(" ", F.slice("words", F.col("at"), n))


def item_shingles(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (item_key, n, shingle_hash, shingle, n_item) of the distinct texts of items, and all ids under their item_key."""
    words = items.select(F.col(id_col).alias("item_id"), plain_words(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    keyed = words.withColumn("item_key", F.sha2(F.concat_ws(" ", "words"), 256))
    texts = keyed.select("item_key", "words").distinct().withColumn("n", F.least(F.size("words"), F.lit(SHINGLE_WORDS)))
    at = texts.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)))
    own = at.select("item_key", "n", shingle_text(F.col("n")).alias("shingle"), F.slice("words", F.col("at"), F.col("n")).alias("w")).distinct()
    # The same hash as of a document's shingle: over n words, for each n there is.
    hashed = F.coalesce(*(F.when(F.col("n") == k, F.xxhash64(*(F.element_at("w", i + 1) for i in range(k)))) for k in range(1, SHINGLE_WORDS + 1)))
    own = own.withColumn("shingle_hash", hashed).drop("w")
    sizes = own.groupBy("item_key").agg(F.count("*").alias("n_item"))
    return own.join(sizes, "item_key"), keyed.select("item_key", "item_id").distinct()


def sketches(own: DataFrame) -> DataFrame:
    """Rows (n, shingle_hash, item_key): each item's smallest hashes, as many as its size's partition needs."""
    from pyspark.sql import Window as W

    upper = F.coalesce(*(F.when(F.col("n_item") <= u, F.lit(u)) for u in SIZES))
    # More than an item can lose and still be held; the largest item of the partition sets the number.
    needed = upper - F.ceil(F.lit(THRESHOLD) * upper - 1e-9) + 1
    place = F.row_number().over(W.partitionBy("item_key").orderBy("shingle_hash"))
    return own.withColumn("place", place).filter(F.col("place") <= needed).select("n", "shingle_hash", "item_key")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc_id, text_hash, item_id, n_shared, n_item): items held by the texts of docs."""
    own, ids = item_shingles(items, item_id, item_text)
    own = staged(own, "benchmark-shingles")
    ids = staged(ids, "benchmark-ids")
    sketch = small_or_shuffled(staged(sketches(own), "benchmark-sketches"))
    sizes = sorted(r.n for r in own.select("n").distinct().collect()) or [SHINGLE_WORDS]
    texts = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))

    # A very frequent passage hits in many documents: what is kept of a hit is a narrow row, and hits of one document are merged at once.
    probes = shingles(texts.select("doc_id", "text_hash", plain_words(F.col("text")).alias("words")), sizes)
    hits = probes.join(sketch, ["n", "shingle_hash"]).select("doc_id", "text_hash", "item_key").distinct()
    candidates = staged(hits, "benchmark-candidates")

    keys = candidates.select("doc_id", "text_hash").distinct()
    sought = candidates.join(small_or_shuffled(own), "item_key").select("doc_id", "text_hash", "item_key", "n", "shingle_hash", "shingle", "n_item")
    same = ["doc_id", "text_hash"]
    found = texts.join(small_or_shuffled(staged(keys, "benchmark-keys")).withColumnsRenamed({c: f"key_{c}" for c in same}), F.col("doc_id").eqNullSafe(F.col("key_doc_id")) & (F.col("text_hash") == F.col("key_text_hash")), "left_semi")
    held = shingles(found.select("doc_id", "text_hash", plain_words(F.col("text")).alias("words")), sizes)
    held = held.select("doc_id", "text_hash", "n", "shingle_hash", shingle_text(F.col("n")).alias("shingle")).distinct()
    left, right = held.alias("h"), sought.alias("s")
    match = [F.col("h.doc_id").eqNullSafe(F.col("s.doc_id")), *(F.col(f"h.{c}") == F.col(f"s.{c}") for c in ("text_hash", "n", "shingle_hash", "shingle"))]
    on = match[0]
    for m in match[1:]:
        on = on & m
    counted = left.join(right, on).groupBy("s.doc_id", "s.text_hash", "s.item_key", "s.n_item").agg(F.count("*").alias("n_shared"))
    sure = counted.filter(F.col("n_shared") >= F.lit(THRESHOLD) * F.col("n_item") - 1e-9)
    return sure.join(small_or_shuffled(ids), "item_key").select("doc_id", "text_hash", "item_id", "n_shared", "n_item")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item."""
    bad_id, bad_hash = fresh(docs, "bad_id", "bad_hash")
    found = contaminated(docs, items, id_col, text_col).select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash)).distinct()
    bad = small_or_shuffled(staged(found, "benchmark-found"))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(bad_id)) & (text_hash(F.col(text_col)) == F.col(bad_hash)), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))


OP4_SQL = r"""
WITH words AS (
    SELECT 'doc' AS kind, doc_id AS id, list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM documents
    UNION ALL
    SELECT 'item', item_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '') FROM benchmark
), sized AS (
    SELECT kind, id, w, len(w) AS size FROM words WHERE len(w) > 0
), item AS (
    SELECT DISTINCT id AS item_id, least(size, 5) AS n, array_to_string(w[i : i + least(size, 5) - 1], ' ') AS shingle
    FROM (SELECT id, w, size, unnest(range(1, size - least(size, 5) + 2)) AS i FROM sized WHERE kind = 'item')
), lengths AS (SELECT DISTINCT n FROM item), doc AS (
    SELECT DISTINCT id AS doc_id, n, array_to_string(w[i : i + n - 1], ' ') AS shingle
    FROM (SELECT id, w, n, unnest(range(1, size - n + 2)) AS i FROM sized, lengths WHERE kind = 'doc')
), sizes AS (SELECT item_id, count(*) AS n_item FROM item GROUP BY item_id)
SELECT doc.doc_id, item.item_id, count(*) AS n_shared, any_value(n_item) AS n_item
FROM doc JOIN item USING (n, shingle) JOIN sizes USING (item_id)
GROUP BY doc.doc_id, item.item_id HAVING count(*) >= 0.8 * any_value(n_item) - 1e-9
"""
