"""Embedding near-duplicates by an exact metric range join.

Unit vectors of one label are linked if their cosine is THRESHOLD or more, which is a Euclidean
distance of at most R. A label's pivots partition its vectors: each has its home in the cell of its nearest
pivot. By the triangle inequality a vector that is linked to one at home in another cell lies within R of the
border between the two pivots, (d2^2 - d1^2) / (2 d(p1, p2)) <= R, and visits that cell, if it is the later
of the two. So cells join independently: each link is found once, in one cell, between two at home or one
at home and one visiting; visitors aren't compared with each other.

Equal vectors are one row with a number of copies. A cell of many is cut into blocks of at most
BLOCK vectors, whose pairs are compared in groups of their own; a group gives counts of links and a
spanning forest of what it linked, never the pairs. The forest's edges are joined to components.

Pivots are taken from a sample by hash (4 sqrt(n) vectors of a label's n, SAMPLED in all), one half of it in
order of spread, each the farthest from those before. How many serve is estimated with the other half: the
number at which rows sent and pairs compared cost least. Vectors that lie alone, all about equally far from each other,
are near to every border, so that one cell costs least; clustered ones are cut into many. The sample decides about speed, never about
the result.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, or have a null
label, link with nothing: n_links 0, component their own; vectors of unlike lengths don't link; a cosine that is
the threshold, as computed, links; repeated
rows of a vec_id are rows of their own that link with each other like any other two equal vectors; a
null vec_id never names a component unless all of it are null; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import connected_components, join_hot, small_or_shuffled, staged, table

THRESHOLD = 0.98
#: Vectors sampled of all labels together.
SAMPLED = 20_000
#: What sending one row costs, in comparisons of two vectors.
ROW_COST = 2_000
BLOCK = 2048


def usable(rows: DataFrame) -> DataFrame:
    """rows (vec_id, label, embedding) with the double unit vector v, null if there is none."""
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    clean = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # The largest component is divided out first, so that squares neither overflow nor vanish.
    largest = F.aggregate(numbers, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    return (
        rows.withColumn("numbers", F.when(clean & F.col("label").isNotNull() & (largest > 0), numbers))
        .withColumn("largest", F.aggregate("numbers", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))
        .withColumn("numbers", F.transform("numbers", lambda x: x / F.col("largest")))
        .withColumn("norm", F.sqrt(F.aggregate("numbers", F.lit(0.0), lambda a, x: a + x * x)))
        .withColumn("v", F.transform("numbers", lambda x: x / F.col("norm")))
        .drop("numbers", "largest", "norm")
    )


def spread(sample: np.ndarray, most: int) -> np.ndarray:
    """The sample's vectors in order of spread: each the farthest from those before."""
    order, near = [0], 2 - 2 * sample @ sample[0]
    while len(order) < min(most, len(sample)):
        order.append(int(near.argmax()))
        near = np.minimum(near, 2 - 2 * sample @ sample[order[-1]])
    return sample[order]


def places(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vector's home, and a mask of the later cells that it visits."""
    reach = math.sqrt(2 - 2 * THRESHOLD) + 1e-6
    square = np.maximum(0, 2 - 2 * v @ pivots.T)
    home = square.argmin(axis=1)
    gap = square - square[np.arange(len(v)), home][:, None]
    between = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    visits = gap <= 2 * reach * between[home] + 1e-6
    return home, visits & (np.arange(len(pivots)) > home[:, None])


def best_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """As many pivots of a label's sample as cost least for its n vectors."""
    half = len(sample) // 2
    if half < 2:
        return sample[:1]
    pivots, probes = spread(sample[:half], half), sample[half:]
    scale, best, least = n / len(probes), pivots[:1], n * ROW_COST + n * n / 2
    for m in (2**k for k in range(1, half.bit_length())):
        home, visits = places(probes, pivots[:m])
        at_home, visiting = scale * np.bincount(home, minlength=m), scale * visits.sum(axis=0)
        cost = ROW_COST * (n + visiting.sum()) + (at_home * (at_home / 2 + visiting)).sum()
        if cost < least:
            best, least = pivots[:m], cost
    return best


def pivots_of(vectors: DataFrame) -> dict:
    """By (label, length) a matrix of pivots, where more than one serve."""
    sizes = staged(vectors.groupBy("label", F.size("v").alias("d")).count(), "embedding-sizes")
    wish = F.least(4 * F.sqrt("count"), F.col("count"))
    share = min(1.0, SAMPLED / (sizes.agg(F.sum(wish)).first()[0] or 1))
    wanted = small_or_shuffled(sizes.withColumn("rate", wish * share / F.col("count")))
    at = F.pmod(F.xxhash64("v"), F.lit(1_000_003)) / 1_000_003
    chosen = vectors.join(wanted, (vectors["label"] == wanted["label"]) & (F.size("v") == wanted["d"])).filter(at < F.col("rate"))
    found: dict = {}
    for r in chosen.select(vectors["label"], "d", "count", "v").orderBy(vectors["label"], F.xxhash64("v", F.lit(1)), "v").collect():
        found.setdefault((r.label, r.d), (r["count"], []))[1].append(r.v)
    chosen = {k: best_pivots(np.array(v), n) for k, (n, v) in found.items()}
    return {k: p for k, p in chosen.items() if len(p) > 1}


def to_cells(vectors: DataFrame, pivots: dict) -> DataFrame:
    """Rows (label, d, cell, home, class_id, copies, v): every vector at home and where it visits."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def place(batches):
        for batch in batches:
            out = []
            for (label, d), rows in batch.groupby(["label", "d"]):
                p = sent.value.get((label, d))
                home, visits = (np.zeros(len(rows), int), np.zeros((len(rows), 1), bool)) if p is None else places(np.stack(rows["v"].to_list()), p)
                row, cell = np.nonzero(visits)
                both = np.concatenate([np.arange(len(rows)), row])
                part = rows.iloc[both].drop(columns=["d"])
                out.append(part.assign(d=d, cell=np.concatenate([home, cell]), home=np.arange(len(both)) < len(rows)))
            if out:
                yield pd.concat(out)[["label", "d", "cell", "home", "class_id", "copies", "v"]]

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.withColumn("d", F.size("v")).mapInPandas(place, f"label {label}, d int, cell int, home boolean, class_id long, copies long, v array<double>")


def compare(rows: pd.DataFrame) -> pd.DataFrame:
    """A block with itself (side 2), or those of side 0 with those of side 1: links counted, and a spanning forest."""
    rows = rows.sort_values(["side", "class_id"])
    v, side = np.stack(rows["v"].to_list()), rows["side"].to_numpy()
    ids, copies = rows["class_id"].to_numpy(), rows["copies"].to_numpy()
    whole = side[0] == 2
    cut = 0 if whole else int((side == 0).sum())
    left, right = (slice(None), slice(None)) if whole else (slice(0, cut), slice(cut, None))
    linked = v[left] @ v[right].T >= THRESHOLD
    if whole:
        np.fill_diagonal(linked, False)
    count = np.zeros(len(ids), np.int64)
    count[left] += linked @ copies[right]
    if not whole:
        count[right] += copies[left] @ linked
    root, none = np.arange(len(ids)), len(ids)
    while linked.any():
        low = root.copy()
        low[left] = np.minimum(low[left], np.where(linked, root[right][None, :], none).min(axis=1))
        low[right] = np.minimum(low[right], np.where(linked, low[left][:, None], none).min(axis=0))
        low = low[low]
        if (low == root).all():
            break
        root = low
    return pd.DataFrame({"class_id": ids, "found": count, "root": ids[root]})[(count > 0) | (ids[root] != ids)]


def links(cells: DataFrame) -> DataFrame:
    """Rows (class_id, found, root): other vectors linked, and an edge of the spanning forest, by group.

    Blocks of those at home meet each other and themselves; blocks of visitors meet those at home.
    """
    blocks = lambda home: F.ceil(F.count_if(F.col("home") == home) / BLOCK).cast("int")
    sizes = cells.groupBy("label", "d", "cell").agg(blocks(True).alias("homes"), blocks(False).alias("guests"))
    sizes = small_or_shuffled(staged(sizes, "embedding-cells"))
    own = F.pmod(F.xxhash64("class_id"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    group = lambda guest, a, b, side: F.struct(F.lit(guest).alias("guest"), a.alias("a"), b.alias("b"), side.alias("side"))
    among = F.transform(up_to(F.col("homes")), lambda b: group(False, F.least(b, F.col("own")), F.greatest(b, F.col("own")), F.when(b == F.col("own"), 2).when(b > F.col("own"), 0).otherwise(1)))
    received = F.transform(up_to(F.col("guests")), lambda b: group(True, F.col("own"), b, F.lit(0)))
    visited = F.transform(up_to(F.col("homes")), lambda b: group(True, b, F.col("own"), F.lit(1)))
    to = F.when(F.col("home"), F.concat(among, received)).otherwise(visited)
    dealt = cells.join(sizes, ["label", "d", "cell"]).withColumn("own", own).withColumn("to", F.explode(to))
    key = ["label", "d", "cell", "guest", "a", "b"]
    return dealt.select("label", "d", "cell", "to.*", "class_id", "copies", "v").groupBy(*key).applyInPandas(compare, "class_id long, found long, root long")


def vector_hash() -> Column:
    return F.xxhash64("label", "v")


def embedding_dedup(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of rows."""
    named = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    every = staged(usable(named).select("vec_id", "label", "v").withColumn("h", vector_hash()), "embedding-rows")
    some = every.filter("v is not null")
    # Equal unit vectors of a label are one class, of some copies, numbered as they are written.
    classes = some.groupBy("h", "label", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    vectors = staged(classes.withColumn("class_id", F.monotonically_increasing_id()), "embedding-classes")
    cells = to_cells(vectors.select("label", "v", "class_id", "copies"), pivots_of(vectors.select("label", "v")))
    found = staged(links(cells), "embedding-links")
    roots = connected_components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("class_id").agg(F.sum("found").alias("others"))
    of = vectors.select("h", "class_id", "copies", "least").join(roots, F.col("class_id") == F.col("node"), "left").join(counts, "class_id", "left")
    linked = staged(of.select("h", "class_id", "copies", "least", F.coalesce("component", "class_id").alias("root"), F.coalesce("others", F.lit(0)).alias("others")), "embedding-roots")
    named_roots = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    answers = linked.join(named_roots, "root").select("h", "class_id", "copies", (F.col("others") + F.col("copies") - 1).alias("n_links"), "component_id")
    answers = staged(answers, "embedding-answers")
    # Rows meet their class by its hash, and the few whose hash several classes share by the vector itself.
    shared = small_or_shuffled(staged(vectors.groupBy("h").count().filter("count > 1").select("h"), "embedding-shared"))
    plain = join_hot(some.select("vec_id", "h").join(shared, "h", "left_anti"), answers.join(shared, "h", "left_anti").select("h", "copies", "n_links", "component_id"), "h", "copies")
    told_apart = some.join(shared, "h", "left_semi").join(vectors.join(shared, "h", "left_semi").select("label", "v", "class_id"), ["label", "v"]).join(answers.drop("h"), "class_id")
    out = ["vec_id", "n_links", "component_id"]
    alone = every.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    joined = plain.select(*out).union(told_apart.select(*out)).union(alone)
    return joined.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE unit AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), clean AS (
    SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM unit
    WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0
), pairs AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM clean a JOIN clean b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) >= 0.98
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
), components AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM components LEFT JOIN counts USING (vec_id)
"""
