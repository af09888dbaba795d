import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline as cp
from colloquy.llm import near_copies as nc
from colloquy.llm import simhash_dedup as sh
from tests.llm.test_simhash_dedup import components_of


def brute(rows):
    """Classes of rows (id, text) by the exact similarity of all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = components_of(near)
    return [root.get(i, i) for i in range(len(rows))], near


def near_copies(seed=3, groups=12):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.choice([30, 120, 400]))]
        for k in range(8):
            copy = words[:]
            for _ in range(k % 5 if len(words) > 30 else k % 2):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(900)}"
            rows.append((len(rows) + 1, " ".join(copy)))
    return rows + [(900, None), (901, ""), (902, " \t"), (903, "two words"), (904, "Two  words"), (904, "Two  words")]


def test_near_copies_leave_one_of_each_class(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'fr' as lang", "'s' as source", "1L as n_chars")
    kept = sorted(r.doc_id for r in cp.near_duplicates(spark, docs, "").collect())
    of, near = brute(rows)
    assert len(near) > 100
    assert kept == sorted({min(i for (i, _), c in zip(rows, of, strict=True) if c == d) for d in set(of)})
    assert cp.near_duplicates(spark, docs.limit(0), "").collect() == []


def test_bitmaps_lose_no_similar_pair(spark):
    """Sets of many sizes and overlaps: none of similarity 0.8 or more is refused, and most of the others are."""
    rng = np.random.default_rng(4)
    rows, similar = [], []
    for k in range(1500):
        n = int(rng.choice([1, 4, 9, 30, 200, 1500]))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[rng.random(n) < rng.choice([0.5, 0.8, 0.9, 0.95, 1.0])], rng.integers(0, 2**63, rng.integers(0, 1 + n // 6), dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        similar.append(5 * both >= 4 * (n + len(b) - both))
        rows.append((k, nc.bitmap_of(a).tolist(), nc.bitmap_of(b).tolist(), n, len(b)))
    df = spark.createDataFrame(rows, "k int, x array<long>, y array<long>, n long, m long").orderBy("k")
    passed = [r[0] for r in df.select(nc.may_be_similar(F.col("x"), F.col("y"), F.col("n"), F.col("m"))).collect()]
    assert all(p for p, s in zip(passed, similar, strict=True) if s) and sum(similar) > 300
    assert sum(p for p, s in zip(passed, similar, strict=True) if not s) < 0.3 * (len(rows) - sum(similar))


def test_texts_that_can_have_partners(spark):
    """All texts that have a similar one of another root are kept; of many around one passage none, unless it is nearly all of them."""
    rng = np.random.default_rng(4)
    passage, rows = rng.integers(0, 2**62, 60), []
    for g in range(60):
        base = rng.integers(0, 2**62, int(rng.choice([1, 5, 10, 90, 300])))
        if g % 3:
            base = np.concatenate([base, passage])
        for k in range(4):
            some = base[rng.random(len(base)) < rng.choice([0.9, 0.95, 1.0])] if len(base) > 5 else base
            new = rng.integers(0, 2**62, rng.integers(0, 1 + len(base) // 8))
            rows.append((len(rows), sorted({int(x) for x in np.concatenate([some, new])}), g if k < 2 else 1000 + len(rows)))
    rows = [r for r in rows if r[1]]
    sets, root = {i: set(t) for i, t, _ in rows}, {i: r for i, _, r in rows}
    similar = {i for i in sets for j in sets if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    df = spark.createDataFrame(rows, "fp long, shingles array<long>, root long")
    found = {r.fp for r in nc.with_partners(df.select("fp", F.size("shingles").cast("long").alias("n"), "root"), df.select("fp", "shingles")).collect()}
    assert similar <= found and 50 < len(similar) < len(rows)
    around = spark.createDataFrame([(k, sorted(passage.tolist() + rng.integers(0, 2**62, 40).tolist())) for k in range(300)], "fp long, shingles array<long>")
    assert nc.with_partners(around.select("fp", F.lit(100).cast("long").alias("n"), F.col("fp").alias("root")), around).count() == 0


def test_sets_of_one_hash_are_told_apart(spark):
    prints = spark.createDataFrame([(5, 1, "a"), (5, 1, "b"), (5, 2, "c"), (6, 9, "d")], "fp long, other long, doc_id string")
    found = {r.doc_id: r.fp for r in nc.told_apart(prints).collect()}
    assert found["a"] == found["b"] == 5 and found["d"] == 6 and found["c"] not in (5, 6)


def test_sf_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    of, _ = brute(rows)
    want = {min(i for (i, _), c in zip(rows, of, strict=True) if c == d) for d in set(of)}
    assert sorted(r.doc_id for r in nc.keep_one_similar(docs).collect()) == sorted(want)


def test_null_and_repeated_ids_leave_one_row_of_a_class(spark):
    words = [f"w{k}" for k in range(200)]
    first, second = " ".join(words), " ".join([*words[:-1], "other"])
    for doc_id in (None, 7):
        docs = spark.createDataFrame([(doc_id, first), (doc_id, second)], "doc_id long, text string")
        assert len(cp.near_duplicates(spark, docs, "").collect()) == 1
    # The same for op9's classes: two texts of different fingerprints within two bits.
    prints = spark.createDataFrame([(0, True, 1, None, 8), (0, True, 2, None, 9)], "id long, no_id boolean, text_hash long, doc_id long, fp long")
    found = sh.classes(prints).collect()
    assert {r.root for r in found} == {8} and {r.component_id for r in found} == {None}


def brute_simhash(found):
    """The SimHash of a set of hashes, bit by bit, and the bits that are tied."""
    bits, tied = [], []
    for factor, shift in zip(nc.FACTORS.tolist(), nc.SHIFTS.tolist(), strict=True):
        mixed = []
        for h in found.tolist():
            x = (h * factor + shift) % 2**64
            x = (x ^ x >> 32) * 0x9E3779B97F4A7C15 % 2**64
            mixed.append(x ^ x >> 29)
        for b in range(64):
            of = sum(x >> b & 1 for x in mixed)
            bits.append(2 * of > len(mixed))
            tied.append(2 * of == len(mixed))
    return np.array(bits), np.array(tied)


def similar_pair(rng, n):
    """Two sets of similarity 0.8 or a little more, the smaller one of n shingles."""
    more = rng.integers(0, n // 4 + 1)
    changed = (n - 4 * more) // 9 if more < n // 4 else 0
    drawn = rng.integers(0, 2**63, n + more + changed, dtype=np.uint64)
    return np.sort(drawn[:n]), np.sort(drawn[changed:])


def test_simhash_bit_by_bit():
    rng = np.random.default_rng(6)
    for n in (1, 2, 9, 10, 254, 255, 256, 700):
        found = np.sort(rng.integers(0, 2**63, n, dtype=np.uint64))
        bits, tied = brute_simhash(found)
        mine = np.unpackbits(nc.simhash(found), bitorder="little").astype(bool)
        assert len(mine) == nc.WORDS * 64 and (mine == bits)[~tied].all()
        assert not tied.any() or 0.3 < mine[tied].mean() < 0.7


def test_similar_texts_meet_by_simhash_alone(spark):
    """Candidates come from SimHash: similar sets of ten shingles or more share a bucket, unrelated ones don't."""
    rng = np.random.default_rng(8)
    pairs = [similar_pair(rng, int(rng.choice([10, 13, 40, 200, 600]))) for _ in range(600)]
    assert all(5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) for a, b in pairs)
    rows = [(2 * k + j, bytearray(nc.simhash(s).tobytes())) for k, p in enumerate(pairs) for j, s in enumerate(p)]
    prints = spark.createDataFrame(rows, "fp long, simhash binary")
    for texts in (len(rows), 200_000):
        dealt = nc.dealt_to_bands(prints, nc.band_places(texts)).repartition("bucket").sortWithinPartitions("bucket")
        met = {}
        for r in dealt.mapInPandas(nc.close_sorted, "bucket long, fp long").collect():
            met.setdefault(r.bucket, []).append(r.fp)
        found = {(a, b) for fps in met.values() for a in fps for b in fps if a < b}
        assert sum((2 * k, 2 * k + 1) in found for k in range(len(pairs))) >= len(pairs) - 3
        assert len(found) < 1.2 * len(pairs)


def test_few_shingles_meet_less_one(spark):
    rows = [(n, list(range(n))) for n in range(1, 10)] + [(20, [*range(7), 99]), (21, [*range(3), 99])]
    df = spark.createDataFrame(rows, "fp long, shingles array<long>")
    met = {}
    for r in nc.few_sums(df).collect():
        met.setdefault(r.bucket, set()).add(r.fp)
    found = {(a, b) for fps in met.values() for a in fps for b in fps if a < b}
    sets = dict(rows)
    want = {(a, b) for a in sets for b in sets if a < b and 5 * len(set(sets[a]) & set(sets[b])) >= 4 * len(set(sets[a]) | set(sets[b]))}
    assert {p for p in want if len(set(sets[p[0]]) | set(sets[p[1]])) <= nc.FEW} <= found and len(want) > 4


def test_long_runs_stay_whole_over_batches():
    rng = np.random.default_rng(5)
    bucket = np.sort(np.concatenate([np.full(2000, 7), np.repeat([3, 9], nc.LONG_RUN + 1), rng.integers(20, 40, 300)]))
    rows = pd.DataFrame({"bucket": bucket, "fp": np.arange(len(bucket)), "x": rng.integers(0, 2**62, len(bucket)), "y": rng.integers(0, 2**62, len(bucket))})
    rows.loc[rows.index[-1], ["bucket", "x", "y"]] = rows.loc[rows.index[-2], ["bucket", "x", "y"]] = [50, -1, -1]
    for size in (1, 64, 900, len(rows)):
        found = pd.concat(list(nc.close_sorted(rows[k : k + size] for k in range(0, len(rows), size))))
        of = found.groupby("fp")["bucket"].first()
        assert len(of) == len(found) and (of[rows["fp"][rows["bucket"] < 20]].to_numpy() == rows["bucket"][rows["bucket"] < 20].to_numpy()).all()
        assert len(found) == (rows["bucket"] < 20).sum() + 2 and found["bucket"].nunique() == 4
