import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import embedding_dedup as ed


def brute(rows):
    """rows: (vec_id, embedding, label), ids distinct and not null."""
    good = {}
    for i, e, label in rows:
        if label is None or not e or any(x is None or not math.isfinite(x) for x in e) or not any(e):
            continue
        v = np.array(e, float) / np.abs(e).max()
        good[i] = (label, v / np.sqrt(v @ v))
    near = defaultdict(set)
    groups = defaultdict(list)
    for i, (label, v) in good.items():
        groups[label, len(v)].append(i)
    for ids in groups.values():
        m = np.stack([good[i][1] for i in ids])
        for a, b in zip(*np.nonzero(m @ m.T >= 0.98), strict=True):
            if a != b:
                near[ids[a]].add(ids[b])
    seen = {}
    for i in sorted(i for i, _, _ in rows):
        stack = [i] if i not in seen else []
        while stack:
            x = stack.pop()
            if x not in seen:
                seen[x] = i
                stack += near[x]
    return sorted((i, len(near[i]), seen[i], seen[i] == i) for i, _, _ in rows)


def planted(n=900, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, 1):
        centres = rng.normal(size=(12, 16))
        for _ in range(n // 3):
            c = centres[rng.integers(12)] * (1 + rng.random()) + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.5])
            rows.append((len(rows), c.tolist(), label))
    rows += [(len(rows) + k, rows[5][1], 0) for k in range(40)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] + [1.0] * 15, [1.0] * 15, [1e200] * 16, [1e-200] * 16]
    return rows + [(2000 + k, e, 1) for k, e in enumerate(odd)] + [(3000, rows[0][1], None), (3001, rows[0][1], None)]


@pytest.mark.parametrize("row_cost, block", [(2000, 2048), (0, 2048), (0, 17)])
def test_matches_brute_force(spark, monkeypatch, row_cost, block):
    monkeypatch.setattr(ed, "ROW_COST", row_cost)
    monkeypatch.setattr(ed, "BLOCK", block)
    rows = planted()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as v", "'x' as class_id", "2 as d", "3 as h", "4 as hot")
    assert sorted(tuple(r) for r in ed.embedding_dedup(df).collect()) == brute(rows)


def test_vectors_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(ed, "vector_hash", lambda: F.lit(5).cast("long"))
    rows = planted(120)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in ed.embedding_dedup(df).collect()) == brute(rows)


def clustered(n=9000, seed=4):
    """A label of tight clusters, for which pivots pay, and one of vectors that lie alone."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, 24))
    v = centres[rng.integers(60, size=n)] + 0.12 * rng.normal(size=(n, 24))
    alone = rng.normal(size=(n // 6, 24))
    return [(k, x.tolist(), 1) for k, x in enumerate(v)] + [(n + k, x.tolist(), 2) for k, x in enumerate(alone)]


def test_pivots_pay_for_clusters_at_default_constants(spark):
    rows = clustered()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = ed.usable(df).select("label", "v")
    pivots = ed.pivots_of(unit)
    assert [k for k in pivots] == [(1, 24)] and len(pivots[1, 24]) >= 8
    cells = ed.to_cells(unit.withColumn("class_id", F.monotonically_increasing_id()).withColumn("copies", F.lit(1).cast("long")), pivots)
    assert cells.count() < 2 * len(rows)
    assert sorted(tuple(r) for r in ed.embedding_dedup(df).collect()) == brute(rows)


def test_each_pair_in_reach_meets_in_one_cell():
    rng = np.random.default_rng(6)
    v = rng.normal(size=(10, 12))[rng.integers(10, size=600)] + rng.normal(size=(600, 12)) * rng.choice([0.03, 0.2, 1.0], size=(600, 1))
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    for m in (2, 8, 30):
        home, visits = ed.places(v, ed.spread(v, m))
        a, b = np.nonzero(np.triu(v @ v.T >= ed.THRESHOLD, 1))
        met = (home[a] == home[b]).astype(int) + visits[a, home[b]] + visits[b, home[a]]
        assert len(a) > 100 and (met == 1).all()


def test_whole_table(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in ed.op7_embedding_dedup(spark, sf_dir).collect()) == brute(rows)


def test_repeated_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (2, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    found = sorted((tuple(r) for r in ed.embedding_dedup(df).collect()), key=str)
    assert found == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (2, 0, 2, True)], key=str)
    assert ed.embedding_dedup(df.limit(0)).collect() == []
