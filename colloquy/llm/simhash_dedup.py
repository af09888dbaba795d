"""SimHash near-duplicates by bit-sliced comparison.

Each text gets a 64-bit fingerprint from its word shingles. Distinct fingerprints are dealt to
buckets that share two of four 16-bit quarters (two of the quarters of any pair at two or fewer
differing bits are equal, so no link is lost), and the rows of a bucket are compared bit plane by
bit plane: a plane holds one bit of 64 fingerprints in one machine word, differing bits are summed
by carry-save counters (ones, twos, over), and a block of 64 lanes is abandoned once every lane is
over the radius. Links become classes through connected components.

A fingerprint that many documents share (of empty texts, of exact copies) is broadcast with its class, so that
the documents meet it where they are.

Defined results: a bit that is set in exactly half of the shingles is 0; a null, empty or blank text has fingerprint zero and links like any other; a null
doc_id never names a class unless every row of it has one; repeated rows are one class; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import connected_components, join_hot, staged, table

SHINGLE_WORDS = 3
RADIUS = 2
#: Buckets over this many fingerprints are cut into chunks whose pairs are compared in separate groups.
CHUNK = 8192
QUARTER_PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
LANES = 64


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """The SimHash of one text, as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64)
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[start : start + (1 << 16), None].view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint_column(text: Column, size: int = SHINGLE_WORDS) -> Column:
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, size) for t in texts], dtype="int64")

    return simhash(text)


def planes_of(values: np.ndarray) -> np.ndarray:
    """(blocks, 64) fingerprints to (64, blocks) words: bit l of plane j of a block is bit j of its lane l."""
    out = np.empty((64, len(values)), np.uint64)
    for j in range(64):
        bits = ((values >> np.uint64(j)) & np.uint64(1)).astype(np.uint8)
        out[j] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def close_lanes(planes: np.ndarray, queries: np.ndarray, dead: np.ndarray, radius: int) -> np.ndarray:
    """For each query (b, q) the word of lanes of block b within `radius` (3 at most) bits of it.

    `dead` has the lanes that need no comparison. Distances are counted for 64 lanes at once; rows
    whose lanes are all dead are dropped from the work every few planes.
    """
    rows = np.flatnonzero((dead != ~np.uint64(0)).ravel())
    block = rows // queries.shape[1]
    values, over = queries.ravel()[rows], dead.ravel()[rows].copy()
    ones, twos = np.zeros_like(over), np.zeros_like(over)
    result = np.zeros(queries.size, np.uint64)
    for j in range(64):
        differ = planes[j][block] ^ (np.uint64(0) - ((values >> np.uint64(j)) & np.uint64(1)))
        carry = ones & differ
        ones ^= differ
        over |= twos & carry
        twos ^= carry
        if j % 8 == 7:
            past = over | {0: ones | twos, 1: twos, 2: ones & twos, 3: np.uint64(0)}[radius]
            alive = past != ~np.uint64(0)
            rows, block, values = rows[alive], block[alive], values[alive]
            over, ones, twos = over[alive], ones[alive], twos[alive]
            if not len(rows):
                break
    past = over | {0: ones | twos, 1: twos, 2: ones & twos, 3: np.uint64(0)}[radius]
    result[rows] = ~past
    return result.reshape(queries.shape)


def links_in_runs(run: np.ndarray, values: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of close values that have the same number in `run` (ascending).

    side: rows of sides 0 and 1 of a bucket in chunks are compared across only; side 2 with all.
    """
    n = len(run)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pad = -n % LANES
    blocks = (n + pad) // LANES
    index = np.arange(n + pad).reshape(blocks, LANES)
    value = np.concatenate([values, np.zeros(pad, values.dtype)]).view(np.uint64).reshape(blocks, LANES)
    run = np.concatenate([run, -1 - np.arange(pad)]).reshape(blocks, LANES)
    part = np.concatenate([side, np.full(pad, 2, side.dtype)]).reshape(blocks, LANES)
    planes = planes_of(value)
    left, right, one = [], [], np.uint64(1)
    lane_bits = one << np.arange(LANES, dtype=np.uint64)
    last_run = run.max(axis=1)
    for gap in range(blocks):
        first = np.flatnonzero(last_run[: blocks - gap] >= run[gap:, 0]) if gap else np.arange(blocks)
        first = first[run[first + gap, 0] >= 0]
        if not len(first):
            break
        for some in np.array_split(first, max(1, len(first) // 512)):
            other = some + gap
            meet = run[some][:, :, None] == run[other][:, None, :]
            meet &= (part[some][:, :, None] == 2) | (part[some][:, :, None] != part[other][:, None, :])
            if not gap:
                meet &= np.arange(LANES)[:, None] < np.arange(LANES)[None, :]
            dead = ~np.packbits(meet, axis=2, bitorder="little").view(np.uint64)[:, :, 0]
            found = close_lanes(planes[:, other], value[some], dead, radius)
            b, q = np.nonzero(found)
            hit, lane = np.nonzero(found[b, q][:, None] & lane_bits)
            left.append(index[some[b[hit]], q[hit]])
            right.append(index[other[b[hit]], lane])
    return np.concatenate(left), np.concatenate(right)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (value, smallest value reachable) that connect what the edges a-b connect."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = root.copy()
        np.minimum.at(low, u, root[v])
        np.minimum.at(low, v, root[u])
        low = low[low]
        if (low == root).all():
            return nodes[root != np.arange(len(nodes))], nodes[root[root != np.arange(len(nodes))]]
        root = low


def compare_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (pair, key, value, side), sorted by pair and key, to edges; a bucket may span batches."""

    def edges(rows: pd.DataFrame) -> pd.DataFrame:
        key, pair = rows["key"].to_numpy(), rows["pair"].to_numpy()
        new = (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])
        alone = np.concatenate([[True], new]) & np.concatenate([new, [True]])
        run = np.concatenate([[0], np.cumsum(new)])[~alone]
        value = rows["fp"].to_numpy()[~alone]
        i, j = links_in_runs(run, value, rows["side"].to_numpy()[~alone])
        a, b = spanning(value[i], value[j])
        return pd.DataFrame({"a": a, "b": b})

    kept: list[pd.DataFrame] = []
    for rows in batches:
        if rows.empty:
            continue
        kept.append(rows)
        last = rows["pair"].iloc[-1], rows["key"].iloc[-1]
        if (rows["pair"].iloc[0], rows["key"].iloc[0]) == last:
            continue
        whole = pd.concat(kept)
        tail = (whole["pair"] == last[0]) & (whole["key"] == last[1])
        yield edges(whole[~tail])
        kept = [whole[tail]]
    if kept:
        yield edges(pd.concat(kept))


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints (column fp) at RADIUS or fewer differing bits."""
    quarter = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keyed = prints.select(
        "fp",
        F.posexplode(F.array(*(quarter[i] * 65536 + quarter[j] for i, j in QUARTER_PAIRS))).alias("pair", "key"),
    )
    sizes = keyed.groupBy("pair", "key").count().filter(F.col("count") > CHUNK)
    big = sizes.select("pair", "key", F.ceil(F.col("count") / CHUNK).cast("long").alias("chunks"))
    # A bucket in chunks 0..c-1 becomes groups (i, j), i <= j: within one chunk side 2, across two sides 0 and 1.
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    cells = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1),
        lambda c: F.struct(
            (F.least(c, F.col("own")) * F.col("chunks") + F.greatest(c, F.col("own")) + 1).alias("cell"),
            F.when(c == F.col("own"), 2).when(c > F.col("own"), 0).otherwise(1).alias("side"),
        ),
    )
    whole = F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.lit(2).alias("side")))
    dealt = (
        keyed.join(big, ["pair", "key"], "left")
        .withColumn("own", own)
        .withColumn("to", F.explode(F.when(F.col("chunks").isNull(), whole).otherwise(cells)))
        .select((F.col("to.cell") * 8 + F.col("pair")).alias("pair"), "key", "fp", F.col("to.side").alias("side"))
    )
    grouped = dealt.repartition("pair", "key").sortWithinPartitions("pair", "key", "fp")
    return grouped.mapInPandas(compare_sorted, "a long, b long")


def named_classes(own: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (fp, root, component_id) for own (fp, least): root numbers a class, component_id is its smallest id."""
    roots = connected_components(links)
    linked = own.join(roots, own.fp == roots.node).select("fp", "least", "component")
    named = linked.groupBy("component").agg(F.min("least").alias("smallest"))
    linked = linked.join(named, "component").select("fp", "component", "smallest")
    alone = F.col("component").isNull()
    # A class of null ids has a null name, whatever its root.
    return own.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"), F.when(alone, F.col("least")).otherwise(F.col("smallest")).alias("component_id"))


def classes(prints: DataFrame) -> DataFrame:
    """Rows (fp, docs, root, component_id) for rows (doc_id, fp); docs: how many have the fingerprint."""
    own = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("docs")), "simhash-prints")
    return named_classes(own, fingerprint_links(own)).join(own.select("fp", "docs"), "fp")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of docs."""
    prints = staged(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col)).alias("fp")), "simhash-docs")
    return join_hot(prints, staged(classes(prints).drop("root"), "simhash-classes"), "fp", "docs").select("doc_id", "fp", "component_id")


def row_key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Columns id, no_id and text_hash, by which rows are found again."""
    return [
        F.coalesce(F.col(id_col), F.lit(0).cast(docs.schema[id_col].dataType)).alias("id"),
        F.col(id_col).isNull().alias("no_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
    ]


def keep_smallest(docs: DataFrame, key: list[Column], prints: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of docs that stay, by their classes (named_classes); prints: rows (*key, doc_id, fp).

    Texts are shuffled once, against ids and hashes of those that stay.
    """
    # The smallest id, nulls last; it may come with several texts, or several fingerprints of the class: the smallest pair stays.
    # A fingerprint's smallest is found before classes meet, so that one of many documents is one row there.
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "text_hash", "id", "no_id")
    of_print = prints.groupBy("fp").agg(F.min(first).alias("first"))
    root = of_print.join(named.select("fp", "root"), "fp").groupBy("root").agg(F.min("first").alias("s"))
    stay = root.select("s.id", "s.no_id", "s.text_hash").distinct()
    kept = docs.select(*key, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).join(stay, ["id", "no_id", "text_hash"], "left_semi")
    return kept.groupBy("id", "no_id", "text_hash").agg(F.first("row").alias("row")).select("row.*")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each class the row of the smallest id (one of them, where ids or rows repeat)."""
    key = row_key(docs, id_col, text_col)
    prints = staged(docs.select(*key, F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col)).alias("fp")), "simhash-docs")
    return keep_smallest(docs, key, prints, classes(prints))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
