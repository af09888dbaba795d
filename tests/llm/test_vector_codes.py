import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from colloquy.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, rounds=6):
    """(rows, codebooks) of rows (vec_id, embedding, label) by comparing all."""
    good = [(i, [math.floor(4096 * max(-16384.0, min(16384.0, x))) for x in e], label) for i, e, label in rows if e and len(e) % 8 == 0 and all(x is not None and math.isfinite(x) for x in e)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    w = len(good[0][1]) // 8
    parts = [[r[1][p * w : (p + 1) * w] for r in good] for p in range(8)]
    books = [[list(x) for x in part[:16]] for part in parts]
    square = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    nearest = lambda p, x: min((square(x, c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(8):
            owned = defaultdict(list)
            for x in parts[p]:
                owned[nearest(p, x)[1]].append(x)
            for k, xs in owned.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for n, (i, _, label) in enumerate(good):
        found = [nearest(p, parts[p][n]) for p in range(8)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return sorted(out, key=str), books


def planted(n=260, w=3, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 8 * w)) / 4
    rows = [(i, (centres[rng.integers(9)] + rng.normal(size=8 * w) * rng.choice([0.0, 0.01, 0.2])).tolist(), int(rng.integers(3)) if i % 9 else None) for i in range(n)]
    rows += [(n + k, rows[20][1], 7) for k in range(80)] + [rows[3], rows[4]]
    odd = [None, [], [float("nan")] * 8 * w, [None] * 8 * w, [float("inf")] * 8 * w, [1.0] * 8, [1.0] * (8 * w + 1), [1e9, -1e9] * 4 * w]
    return rows + [(5000 + k, e, 1) for k, e in enumerate(odd)] + [(None, rows[7][1], 2)]


@pytest.mark.parametrize("block, leaf", [(4096, 24), (50, 3)])
def test_matches_brute_force(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(vc, "BLOCK", block)
    monkeypatch.setattr(vc, "LEAF", leaf)
    rows = planted()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as v", "2 as block", "'x' as code", "3 as error").repartition(3)
    found, books = vc.vector_codes(df)
    want, want_books = brute(rows)
    assert books.tolist() == want_books
    assert sorted((tuple(r) for r in found.collect()), key=str) == want


def test_few_vectors_make_few_entries(spark):
    rows = [(3, [0.5] * 8, 1), (1, [0.25] * 8, 1), (2, [0.5] * 8, None)]
    found, books = vc.vector_codes(spark.createDataFrame(rows, SCHEMA))
    assert books.shape == (8, 3, 1)
    assert sorted(tuple(r) for r in found.select("vec_id", "code", "error").collect()) == [(1, "00" * 8, 0), (2, "01" * 8, 0), (3, "01" * 8, 0)]


def test_empty_table(spark):
    found, books = vc.vector_codes(spark.createDataFrame([(1, None, 2)], SCHEMA))
    assert books is None and found.count() == 0 and found.columns == ["vec_id", "label", "code", "error"]


def test_a_wholly_owned_ball_gives_its_sum_unseen():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(0, 50, (300, 4)), rng.integers(9000, 9050, (300, 4))])
    tree = vc.Trees(points).arrays()
    (balls, by), (rows, _) = vc.owners(tree, points, np.array([[0, 0, 0, 0], [9000, 9000, 9000, 9000]]))
    assert len(rows) == 0 and tree["size"][balls].sum() == 600 and len(balls) <= 4
    totals = [tree["total"][balls[by == k]].sum(axis=0).tolist() for k in (0, 1)]
    assert totals == [points[:300].sum(axis=0).tolist(), points[300:].sum(axis=0).tolist()]


def test_trees_hold_every_point_once_and_within_their_balls():
    points = np.random.default_rng(2).integers(-99, 99, (500, 3))
    tree = vc.Trees(points).arrays()
    assert sorted(tree["order"]) == list(range(500))
    for ball in range(len(tree["radius"])):
        rows, _ = vc.members(tree, np.array([ball]))
        far = np.sqrt(((points[rows] - tree["centre"][ball]) ** 2).sum(axis=1)).max()
        assert far <= tree["radius"][ball] + 1e-9 and (tree["total"][ball] == points[rows].sum(axis=0)).all()


def test_the_query_sums_errors_by_label_and_hashes_the_codebooks(spark, tmp_path):
    rows = planted(120)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    want, books = brute(rows)
    by = defaultdict(int)
    for _, label, _, error in want:
        by[label] += error
    digest = hashlib.sha256(",".join(str(x) for part in books for entry in part for x in entry).encode()).hexdigest()
    got = sorted((tuple(r) for r in vc.op12_vector_codes(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(i, code, error, by[label], digest) for i, label, code, error in want], key=str)
