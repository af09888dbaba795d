import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import mixing, sharding


def test_table_is_a_fair_turn_taking():
    names = tuple(f"n{k}" for k in range(7))
    owner = sharding.fill(names, 101)
    taken, step, at = {}, {}, {}
    for k, s in enumerate(names):
        at[k], step[k] = sharding._digest(s, "offset") % 101, sharding._digest(s, "step") % 100 + 1
    turn = 0
    while len(taken) < 101:
        k = turn % 7
        preference = [(at[k] + i * step[k]) % 101 for i in range(101)]
        taken[next(p for p in preference if p not in taken)] = k
        turn += 1
    assert [taken[i] for i in range(101)] == owner.tolist()
    assert max(Counter(owner.tolist()).values()) - min(Counter(owner.tolist()).values()) <= 1


def test_losing_a_shard_moves_little_else():
    before = np.array(sharding.SHARDS)[sharding.fill(sharding.SHARDS)]
    fewer = sharding.SHARDS[:-1]
    after = np.array(fewer)[sharding.fill(fewer)]
    stay = before != sharding.SHARDS[-1]
    assert (before[stay] != after[stay]).mean() < 0.05
    weighted = Counter(sharding.fill(("a", "b"), 101, (3, 1)).tolist())
    assert abs(weighted[0] - 76) <= 1
    for bad in (((), 101), (("a", "a"), 101), (("a",), 100)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_shard_rows(spark, sf_dir, tmp_path):
    found = sharding.op5_sharding(spark, sf_dir).collect()
    owner = sharding.fill(sharding.SHARDS)
    assert len(found) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(sharding.SHARDS[owner[r.slot]] == r.shard for r in found)
    rows = [(1, "a"), (1, "a"), (None, None), (None, "x" * 300_000), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'old' as shard", "9 as slot", "'z' as file", "'y' as files", "1 as at", "2 as to", "3 as _slot", "4 as _shard")
    out = sharding.shard(docs)
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == 5
    assert out.filter("doc_id = 1").select("shard").distinct().count() == 1
    assert sharding.shard(docs.limit(0)).count() == 0
    assert {tuple(r) for r in out.select("file", "files", "at", "to", "_slot", "_shard").collect()} == {("z", "y", 1, 2, 3, 4)}
    sharding.write_shards(out, str(tmp_path / "out"), 1)
    again = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(again.columns) == sorted(out.columns) and sorted(map(str, again.select(out.columns).collect())) == sorted(map(str, out.collect()))


def brute_mix(rows, mix):
    """rows: (doc_id, k, words, source). Copies by k, and weights."""
    words = defaultdict(int)
    for _, _, w, s in rows:
        words[s] += w
    real = {s: w for s, w in words.items() if w}
    total = sum(real.values())
    share = {s: w / total for s, w in real.items()}

    def weights(a):
        p = {s: x**a for s, x in share.items()}
        return {s: x / sum(p.values()) for s, x in p.items()}

    def epochs(w):
        per = {s: w[s] / real[s] for s in real}
        return {s: per[s] * (mix.budget_words or 1 / min(per.values())) for s in real}

    def search(ok):
        if ok(0.0):
            return 0.0
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if ok(mid) else (mid, high)
        return high

    h = lambda w: -sum(x * math.log(x) for x in w.values())
    if len(real) > 1:
        a = max(search(lambda a: max(epochs(weights(a)).values()) <= mix.repetition), search(lambda a: h(weights(a)) < mix.entropy * math.log(len(real))))
    else:
        a = 1.0
    return weights(a), epochs(weights(a)) if real else {}


def mixed(spark, docs, mix):
    return mixing.mix_rows(docs, mix).collect()


def source_docs(spark):
    rows = [(i, "w " * (5 + i % 7), "big") for i in range(600)]
    rows += [(1000 + i, "w " * 9, "mid") for i in range(60)] + [(2000 + i, "w " * 8, None) for i in range(20)]
    rows += [(3000, None, "silent"), (3001, "", "silent"), (None, "a b", "mid"), (None, None, None), (5, "w " * 10, "big"), (5, "w " * 10, "big")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' as block", "1 as k", "2 as words")


@pytest.mark.parametrize(
    "mix",
    [
        mixing.Mix(block_words=300),
        mixing.Mix(entropy=1.0, repetition=2.5, block_words=300),
        mixing.Mix(entropy=0.8, repetition=9.0, block_words=10**6),
        mixing.Mix(entropy=0.9, repetition=3.0, budget_words=2000, block_words=200),
    ],
)
def test_mixing_meets_its_goals(spark, mix):
    docs = source_docs(spark)
    narrow = [(r.doc_id, r.k, r.words, r.source) for r in mixing.source_words(docs, "doc_id", "text", "source").collect()]
    weights, epochs = brute_mix(narrow, mix)
    found = mixed(spark, docs, mix)
    words, blocks, at = defaultdict(int), defaultdict(set), defaultdict(list)
    for r in found:
        words[r.source] += r.words
        blocks[r.source].add(r.block)
        at[r.source, r.block, r.epoch].append(r.position)
        assert math.isclose(r.weight, weights.get(r.source, 0), abs_tol=1e-6)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in at.values())
    sizes = defaultdict(int)
    for _, _, w, s in narrow:
        sizes[s] += w
    for s, e in epochs.items():
        assert abs(words[s] - e * sizes[s]) <= 12 * len(blocks[s]) + 1
        assert e <= mix.repetition + 1e-6
    times = Counter(r.doc_id for r in found if r.source == "big" and r.doc_id != 5)
    assert max(times.values()) - min([times.get(i, 0) for i in range(600) if i != 5]) <= 1
    if mix.budget_words is None:
        assert {r.doc_id for r in found} == {r[0] for r in narrow}
    again = mixing.mix_documents(docs, mix)
    assert again.columns == docs.columns
    assert Counter((r.doc_id, r.source) for r in again.collect()) == Counter((r.doc_id, r.source) for r in found)


def test_a_key_of_half_of_all_rows_and_long_texts(spark, monkeypatch):
    """Null ids of one text are half of the rows; they are placed one by one, in blocks that hold other rows as well."""
    monkeypatch.setattr(mixing, "COPIES_OF_PART", 7)
    rows = [(None, "w " * 3, "a")] * 500 + [(i, "w " * 3, "a") for i in range(495)] + [(2000 + i, "w " * 40, "b") for i in range(10)] + [(3000 + i, None, "c") for i in range(200)]
    rows += [(5000, "w " * 200_000, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.Mix(block_words=600, block_rows=50, repetition=3.0)
    found = mixed(spark, docs, mix)
    at = defaultdict(list)
    for r in found:
        at[r.source, r.block, r.epoch].append(r.position)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in at.values())
    assert Counter(r.doc_id for r in found if r.epoch == 1) == Counter(r[0] for r in rows)
    assert len({r.block for r in found if r.source == "c"}) == 4
    assert Counter(r.doc_id for r in mixing.mix_documents(docs, mix).collect()) == Counter(r.doc_id for r in found)


def test_mixing_small_tables(spark, sf_dir):
    docs = source_docs(spark)
    assert mixed(spark, docs.limit(0), mixing.PRODUCTION) == []
    assert len(mixed(spark, docs.filter("source = 'silent'"), mixing.PRODUCTION)) == 2
    assert len(mixed(spark, docs.filter("source = 'mid'"), mixing.PRODUCTION)) == 61
    assert mixing.op8_mixing(spark, sf_dir).select(F.countDistinct("doc_id")).first()[0] == 200
