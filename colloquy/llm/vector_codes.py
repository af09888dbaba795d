"""Vector codes: each of eight parts of a vector by its codebook's nearest entry, the codebooks by k-means on ball trees.

Vectors stay in blocks of a few thousand, each written once with a metric tree for every part. A tree is made from the
middle out: anchors are spread over the block's points, each new one the point farthest from its own anchor, taking the points
that are nearer to it; balls of many points are split the same way, and the balls are merged in pairs to a root, the pair of the
smallest ball first. A ball holds its centre, radius, number of points and their sum.

A round goes down each tree with the list of entries that may own a point of the ball. A ball inherits its parent's list and
strikes out every entry whose border with the ball's nearest one lies beyond the ball; when one is left, the ball is
wholly owned and gives its number and sum without looking at its points. Only points in leaves with more
than one candidate are compared, in whole numbers, so that the result is the same as by comparing all. A round
gives a sum for each component of each entry: 16 numbers a dimension come to the driver, however many vectors there are.

Defined results: null or empty vectors and those with null or non-finite components are dropped, as are those of a length that isn't
that of the smallest vec_id with a multiple of 8; null ids come last in that order; fewer than 16 vectors
make fewer entries; rows of one vec_id are rows of their own, in order of their components; components beyond +-16,384 count as that;
null labels are one label; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import join_hot, staged, table

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Vectors of a block, and points that a ball must have more of to be split.
BLOCK, LEAF = 4096, 24
MOST = 2**26


def usable(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, label, v): v the whole-number components of the vectors that are coded."""
    clean = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), SCALE * x.cast("double")))).cast("int"))
    return rows.select("vec_id", "label", F.when(clean, whole).alias("v")).filter((F.size("v") > 0) & (F.size("v") % PARTS == 0))


def spread(points: np.ndarray, most: int) -> np.ndarray:
    """The anchor of each point, by number, of at most so many anchors."""
    owner = np.zeros(len(points), dtype=np.int64)
    far = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    chosen = [0]
    while len(chosen) < most and far.max() > 0:
        new = int(far.argmax())
        between = np.sqrt(((points[chosen] - points[new]) ** 2).sum(axis=1))
        # A point that is nearer to its anchor than half the way to the new one stays.
        near = np.flatnonzero(2 * far >= between[owner])
        d = np.sqrt(((points[near] - points[new]) ** 2).sum(axis=1))
        taken = near[d < far[near]]
        far[taken], owner[taken] = d[d < far[near]], len(chosen)
        chosen.append(new)
    return owner


class Trees:
    """A ball tree over the rows of one part of a block. Balls are numbered with children before their parents."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(float)
        self.centre: list = []
        self.radius: list = []
        self.total: list = []
        self.children: list = []
        self.members: list = []
        self._grow(np.arange(len(points)))

    def _ball(self, members: np.ndarray, children: tuple) -> int:
        own = self.points[members]
        total = own.sum(axis=0)
        centre = total / len(members)
        self.centre.append(centre)
        self.radius.append(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
        self.total.append(total)
        self.children.append(children)
        self.members.append(members)
        return len(self.centre) - 1

    def _grow(self, members: np.ndarray) -> int:
        owner = spread(self.points[members], max(2, round(len(members) ** 0.5))) if len(members) > LEAF else np.zeros(1)
        if not owner.any():
            return self._ball(members, (-1, -1))
        order = np.argsort(owner, kind="stable")
        return self._merged([self._grow(part) for part in np.split(members[order], np.flatnonzero(np.diff(owner[order])) + 1)])

    def _merged(self, balls: list[int]) -> int:
        """The root over balls: again and again the two that the smallest ball holds become one."""
        n = len(balls)
        centre, radius = np.array([self.centre[b] for b in balls]), np.array([self.radius[b] for b in balls])
        wide = np.sqrt(((centre[:, None] - centre) ** 2).sum(axis=2)) + radius[:, None] + radius
        np.fill_diagonal(wide, np.inf)
        for _ in range(n - 1):
            i, j = divmod(int(wide.argmin()), n)
            balls[i] = self._ball(np.concatenate([self.members[balls[i]], self.members[balls[j]]]), (balls[i], balls[j]))
            centre[i], radius[i] = self.centre[balls[i]], self.radius[balls[i]]
            wide[j, :] = wide[:, j] = np.inf
            gone = np.isinf(wide[i])
            wide[i] = np.where(gone, np.inf, np.sqrt(((centre - centre[i]) ** 2).sum(axis=1)) + radius + radius[i])
            wide[:, i] = wide[i]
            root = balls[i]
        return root

    def arrays(self) -> dict:
        """The balls as arrays; a ball's points are the rows of `order` from first to last."""
        first, order, stack = np.zeros(len(self.centre), dtype=np.int32), [], [(len(self.centre) - 1, 0)]
        while stack:
            ball, at = stack.pop()
            first[ball] = at
            left, right = self.children[ball]
            if left < 0:
                order.append((at, self.members[ball]))
            else:
                stack += [(left, at), (right, at + len(self.members[left]))]
        rows = np.concatenate([m for _, m in sorted(order, key=lambda x: x[0])])
        size = np.array([len(m) for m in self.members], dtype=np.int32)
        return {"centre": np.array(self.centre), "radius": np.array(self.radius), "total": np.array(self.total).astype(np.int64), "children": np.array(self.children, dtype=np.int32), "first": first, "size": size, "order": rows.astype(np.int32)}


def owners(tree: dict, points: np.ndarray, entries: np.ndarray) -> tuple[list, list]:
    """(balls, owners) of wholly owned balls, and (points, owners) of the rest: all points are in one of both.

    points, entries: whole numbers. The nearest entry owns a point, the first of equally near ones.
    """
    at = entries.astype(float)
    between = np.sqrt(((at[:, None] - at) ** 2).sum(axis=2))
    live = np.zeros((1, len(at)), dtype=bool)
    live[0, np.unique(entries, axis=0, return_index=True)[1]] = True
    balls = np.array([len(tree["radius"]) - 1])
    owned, by, leaves, lists = [], [], [], []
    while len(balls):
        square = ((tree["centre"][balls][:, None] - at) ** 2).sum(axis=2)
        square[~live] = np.inf
        nearest = square.argmin(axis=1)
        least, r = square[np.arange(len(balls)), nearest][:, None], tree["radius"][balls][:, None]
        # Beyond the border by more than rounding could be.
        live = live & ~(square - least > 2 * r * between[nearest] + 1e-9 * (square + least + r * r) + 1e-6)
        live[np.arange(len(balls)), nearest] = True
        one = live.sum(axis=1) == 1
        owned.append(balls[one])
        by.append(nearest[one])
        below = tree["children"][balls]
        leaf = ~one & (below[:, 0] < 0)
        leaves.append(balls[leaf])
        lists.append(live[leaf])
        deeper = ~one & ~leaf
        balls, live = below[deeper].ravel(), np.repeat(live[deeper], 2, axis=0)
    leaf, lists = np.concatenate(leaves), np.concatenate(lists)
    rows, which = members(tree, leaf)
    pair, entry = np.nonzero(lists[which])
    found = np.zeros(len(rows), dtype=np.int64)
    if len(rows):
        d = ((points[rows[pair]] - entries[entry]) ** 2).sum(axis=1)
        starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        best = d == np.repeat(np.minimum.reduceat(d, starts), np.diff(np.r_[starts, len(d)]))
        found = entry[np.flatnonzero(best)[np.searchsorted(np.flatnonzero(best), starts)]]
    return (np.concatenate(owned), np.concatenate(by)), (rows, found)


def members(tree: dict, balls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points of balls, and which of the balls each is of."""
    size = tree["size"][balls]
    which = np.repeat(np.arange(len(balls)), size)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    return tree["order"][tree["first"][balls][which] + inside], which


def blocks(rows: DataFrame) -> DataFrame:
    """Rows (ids, labels, block): vectors a few thousand together, with the trees of their parts."""
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                v = np.asarray(part.column("v").flatten(), dtype=np.int32).reshape(part.num_rows, -1)
                held = {"v": v}
                for p, points in enumerate(np.split(v, PARTS, axis=1)):
                    held |= {f"{name}{p}": x for name, x in Trees(points).arrays().items()}
                np.savez(out := io.BytesIO(), **held)
                ids, labels = (pa.array([part.column(c).to_pylist()], pa.list_(part.column(c).type)) for c in ("vec_id", "label"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([out.getvalue()])], names=["ids", "labels", "block"])

    return rows.mapInArrow(run, f"ids array<long>, labels array<{label}>, block binary")


def opened(block: bytes) -> tuple[np.ndarray, list[dict]]:
    """(points by part, trees)."""
    held = np.load(io.BytesIO(block))
    names = ("centre", "radius", "total", "children", "first", "size", "order")
    return np.stack(np.split(held["v"].astype(np.int64), PARTS, axis=1)), [{n: held[f"{n}{p}"] for n in names} for p in range(PARTS)]


def sums(stored: DataFrame, books: np.ndarray) -> dict:
    """By (part, entry, position) the number of points that the entry owns and the sum of their components there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(books.shape[:2], dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        for batch in batches:
            for block in batch.column("block"):
                points, trees = opened(block.as_py())
                for p, tree in enumerate(trees):
                    (balls, by), (rows, of) = owners(tree, points[p], books[p])
                    np.add.at(count[p], by, tree["size"][balls])
                    np.add.at(total[p], by, tree["total"][balls])
                    np.add.at(count[p], of, 1)
                    np.add.at(total[p], of, points[p][rows])
        part, entry, at = (x.ravel().astype(np.int32) for x in np.indices(books.shape))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, entry, at, np.repeat(count.ravel(), books.shape[2]), total.ravel())], names=["part", "entry", "at", "n", "total"])

    found = stored.select("block").mapInArrow(run, "part int, entry int, at int, n long, total long")
    whole = found.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return {(r.part, r.entry, r["at"]): (r.n, int(r.total)) for r in whole.collect()}


def trained(stored: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    for _ in range(rounds):
        found = sums(stored, books)
        books = np.array([total // n if n else books[key] for key, (n, total) in sorted(found.items())], dtype=np.int64).reshape(books.shape)
    return books


def coded(stored: DataFrame, books: np.ndarray, label: str) -> DataFrame:
    """Rows (vec_id, label, code, error) of all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, block in zip(*(batch.column(c) for c in ("ids", "labels", "block")), strict=True):
                points, trees = opened(block.as_py())
                codes = np.zeros((points.shape[1], PARTS), dtype=np.int64)
                for p, tree in enumerate(trees):
                    (balls, by), (rows, of) = owners(tree, points[p], books[p])
                    inside, which = members(tree, balls)
                    codes[inside, p], codes[rows, p] = by[which], of
                error = sum(((points[p] - books[p][codes[:, p]]) ** 2).sum(axis=1) for p in range(PARTS))
                text = codes.astype(np.uint8).tobytes().hex()
                code = [text[k : k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(code), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return stored.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def vector_codes(rows: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """(rows (vec_id, label, code, error), codebooks by part, entry and position) of rows (vec_id, label, embedding)."""
    kept = usable(rows)
    order = (F.col("vec_id").asc_nulls_last(), "v")
    label = rows.schema["label"].dataType.simpleString()
    first = kept.orderBy(*order).first()
    if first is None:
        return rows.sparkSession.createDataFrame([], f"vec_id long, label {label}, code string, error long"), None
    fit = kept.filter(F.size("v") == len(first.v))
    start = np.array([r.v for r in fit.orderBy(*order).limit(ENTRIES).collect()], dtype=np.int64)
    stored = staged(blocks(fit), "vector-blocks")
    books = trained(stored, np.stack(np.split(start, PARTS, axis=1)))
    return staged(coded(stored, books, label), "vector-codes"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(b"" if books is None else ",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    rows = found.withColumn("of", F.struct("label"))
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    errors = rows.groupBy("of").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"), F.count("*").alias("rows"))
    return join_hot(rows, staged(errors, "vector-errors"), "of", "rows").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _rounds() -> str:
    nearest = """a{r} AS MATERIALIZED (SELECT vec_id, p, any_value(s) AS s, min(16 * (list_inner_product(s, s) - 2 * list_inner_product(s, c) + list_inner_product(c, c))::BIGINT + k) AS m FROM x JOIN b{r} USING (p) GROUP BY vec_id, p)"""
    moved = """b{n} AS MATERIALIZED (SELECT p, k, coalesce(n.c, b{r}.c) AS c FROM b{r} LEFT JOIN (SELECT p, k, list(c ORDER BY i) AS c FROM
(SELECT p, k, i, floor(sum(e) / count(*)) AS c FROM (SELECT p, m % 16 AS k, unnest(s) AS e, unnest(range(len(s))) AS i FROM a{r}) GROUP BY p, k, i) GROUP BY p, k) n USING (p, k))"""
    return ",\n".join(nearest.format(r=r) + (",\n" + moved.format(r=r, n=r + 1) if r < ROUNDS else "") for r in range(ROUNDS + 1))


OP12_SQL = f"""WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS s FROM v, range(8) t(p)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v QUALIFY k < 16),
b0 AS MATERIALIZED (SELECT p, k, s AS c FROM x JOIN f USING (vec_id)),
{_rounds()},
h AS (SELECT sha256(string_agg(w, ',' ORDER BY p, k)) AS codebooks_sha256 FROM (SELECT p, k, array_to_string(list_transform(c, lambda x: x::BIGINT), ',') AS w FROM b{ROUNDS})),
e AS (SELECT vec_id, string_agg(lpad(format('{{:x}}', m % 16), 2, '0'), '' ORDER BY p) AS code, sum(m // 16)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM e JOIN v USING (vec_id), h"""
