import re
from collections import Counter

import pytest

import corpus_pipeline as cp
from colloquy.llm import sharding
from tests.llm.test_decontamination import brute as brute_contaminated
from tests.llm.test_near_copies import brute as brute_similar

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for k, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("pipeline") / str(k))
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "mixing", "sharding"]
    assert all(s.columns == COLUMNS for s in stages[:5]) and stages[5].columns == [*COLUMNS, "slot", "shard"]


def test_quality_keeps_good_documents(spark, stages, sf_dir):
    kept = set(ids(stages[1]))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(i in kept for i, q in labels.items() if q == 1)
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.3 * sum(q == 0 for q in labels.values())


def test_one_of_each_class_stays(stages):
    """The stage's classes are those of five-word similarity 0.8 or more, by an exact comparison of all pairs."""
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    of, _ = brute_similar(rows)
    assert sorted(ids(stages[2])) == sorted({min(i for (i, _), c in zip(rows, of, strict=True) if c == d) for d in set(of)})


def test_decontamination_and_mixing(spark, stages, sf_dir):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {d for d, *_ in brute_contaminated(rows, items)}
    assert sorted(ids(stages[3])) == sorted(i for i, _ in rows if i not in bad)
    times = Counter(ids(stages[4]))
    assert set(times) == set(ids(stages[3])) and max(times.values()) <= 4


def test_sharding_and_run(spark, stages, sf_dir):
    owner = sharding.fill(sharding.SHARDS)
    found = stages[5].collect()
    assert len(found) == stages[4].count() and all(sharding.SHARDS[owner[r.slot]] == r.shard for r in found)
    assert Counter(ids(cp.run(spark, sf_dir))) == Counter(r.doc_id for r in found)


def test_odd_rows_through_all_stages(spark, tmp_path):
    prose = "Some plain sentence of several words stands here number {}, and it goes on for a while. "
    rows = [(k, prose.format(k * 7919), "en", f"s{k % 3}", 9) for k in range(30)]
    rows += [(1, rows[1][1], "en", "s1", 9), (None, prose.format("none"), None, None, None), (98, None, None, None, None), (99, "", "en", "s0", 0), (100, re.sub("a", "e", prose) * 3000, "en", "s0", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as words", "1 as row", "2 as shard", "'k' as h", "3 as at", "4 as to", "5 as _slot", "6 as _shard", "7 as bad_id", "8 as _bad_hash", "9 as slot", "1 as text_hash", "2 as found", "3 as plan_source", "4 as block", "5 as copies", "6 as first", "7 as fp")
    for name, data in (("some", df), ("none", df.limit(0))):
        data.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, prose.format(3 * 7919))], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    found = cp.run(spark, f"{tmp_path}/some").collect()
    assert {0, 1, None} <= {r.doc_id for r in found} and 3 not in {r.doc_id for r in found}
    assert cp.run(spark, f"{tmp_path}/none").collect() == []
