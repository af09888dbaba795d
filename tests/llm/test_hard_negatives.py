import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    good = []
    for i, e, label in rows:
        if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            good.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in e]))
    out = []
    for a in sorted({(i, label, tuple(v)) for i, label, v in good if i % 100 == 0}):
        scored = [(-sum(x * y for x, y in zip(a[2], v, strict=True)), i, label) for i, label, v in good if len(v) == len(a[2])]
        for p, i, _ in sorted(s for s in scored if s[2] == a[1] and s[1] != a[0])[:5]:
            fits = sorted(s[:2] for s in scored if s[2] != a[1] and -80 * p <= -100 * s[0] <= -100 * p)[:5]
            out += [(a[0], i, k + 1, j, -p, -n) for k, (n, j) in enumerate(fits)]
    return sorted(out)


def mine(df):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hn.hard_negatives(df, label, F.col("vec_id") % 100 == 0).collect())


def planted(n=700, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, 6))
    rows = [(i, (centres[rng.integers(8)] + rng.normal(size=6) * rng.choice([0.05, 0.6])).round(2).tolist(), int(rng.integers(5))) for i in range(n)]
    rows += [(n + k, rows[100][1], int(k % 3)) for k in range(60)] + [rows[200], rows[200], rows[300]]
    odd = [None, [], [float("nan")] * 6, [1.0, None] * 3, [float("inf")] + [1.0] * 5, [1.0] * 5, [0.0] * 6]
    return rows + [(100 * (100 + k), e, 1) for k, e in enumerate(odd)] + [(9999, rows[0][1], None), (None, rows[0][1], 1), (20000, [1.0] * 5, 2), (20001, [0.9] * 5, 3), (20002, [1.0] * 5, 2)]


@pytest.mark.parametrize("numbers, scores", [(hn.BLOCK_NUMBERS, hn.SCORES), (24, 40)])
def test_matches_brute_force(spark, monkeypatch, numbers, scores):
    monkeypatch.setattr(hn, "BLOCK_NUMBERS", numbers)
    monkeypatch.setattr(hn, "SCORES", scores)
    rows = planted()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as v", "2 as a", "'x' as score", "3 as anchor_id", "4 as block").repartition(3)
    want = brute(rows)
    assert mine(df) == want and len({r[0] for r in want}) > 5


def test_no_rows_no_anchors_no_positives(spark):
    assert mine(spark.createDataFrame([], SCHEMA)) == []
    assert mine(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], SCHEMA)) == []
    assert mine(spark.createDataFrame([(100, [1.0], 1), (2, [1.0], 2)], SCHEMA)) == []


def test_ends_of_the_window_and_ties(spark):
    # Positive at 100 of 256 x 256: negatives at 80 and 100 hundredths belong, 79.9 and 100.4 do not; ties go by id.
    rows = [(100, [1.0, 0.0], 1), (1, [100 / 256, 0.0], 1), (2, [80 / 256, 0.0], 2), (3, [79 / 256, 5.0], 2), (4, [100 / 256, 1.0], 3), (5, [101 / 256, 0.0], 2), (6, [100 / 256, 0.5], 2)]
    assert [r[2:4] for r in mine(spark.createDataFrame(rows, SCHEMA))] == [(1, 4), (2, 6), (3, 2)]


def test_negative_and_zero_positives_and_large_components(spark):
    rows = [(100, [1.0], 1), (1, [-1.0], 1), (2, [-0.9], 2), (3, [0.0], 1), (4, [0.0], 2), (200, [1e300], 3), (8, [-1e300], 3), (9, [5e299], 4)]
    got = mine(spark.createDataFrame(rows, SCHEMA))
    assert [r[:4] for r in got if r[0] == 100] == [(100, 3, 1, 4)]
