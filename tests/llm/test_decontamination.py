import math
import re

from colloquy.llm import decontamination as dc


def shingle_set(text, n):
    w = re.sub(r"[^\w]+|_", " ", (text or "").lower()).split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items):
    out = set()
    for item, text in items:
        size = len(re.sub(r"[^\w]+|_", " ", (text or "").lower()).split())
        n = min(size, 5)
        own = shingle_set(text, n) if size else set()
        for doc, body in docs:
            shared = len(own & shingle_set(body, n)) if own else 0
            if own and shared >= 0.8 * len(own) - 1e-9:
                out.add((doc, item, shared, len(own)))
    return out


def found(df):
    return {tuple(r) for r in df.select("doc_id", "item_id", "n_shared", "n_item").collect()}


def test_whole_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = found(dc.op4_decontamination(spark, sf_dir))
    assert got == brute(docs, items) and got


def test_odd_rows(spark):
    item = " ".join(f"w{i}" for i in range(30))
    near = item.replace("w15", "x")
    words = item.split()
    items = [(1, item), (2, item.upper() + "!"), (3, None), (4, "--"), (5, "only three words"), (6, "one"), (1, item), (None, "null id item of six words")]
    docs = [(1, "before " + item + " after"), (2, "a, " + near + " b"), (3, None), (4, ""), (5, " ".join(words[:28])), (6, " ".join(words[:24])), (7, "filler word " * 100_000 + item), (8, "holds only THREE words, and one")]
    docs += [(None, item), (9, item), (9, item), (9, "other text"), (10, " ".join(reversed(words))), (11, "null id item of six words")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as n", "'w' as words", "3 as text_hash", "4 as bad_id", "5 as bad_hash", "6 as _bad_id", "7 as _bad_hash")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "'k' as item_key")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(d, i).collect()}
    assert got == {(a, b) for a, b, _, _ in brute(docs, items)}
    assert (7, 1) in got and (8, 5) in got and (8, 6) in got and (None, 2) in got and (6, 1) not in got
    kept = dc.drop_contaminated(d, i)
    assert kept.columns == d.columns
    assert sorted((r.doc_id, (r.text or "")[:5]) for r in kept.collect()) == sorted((a, (b or "")[:5]) for a, b in docs if a not in {x for x, _ in got} or b == "other text")
    for x, y in ((d.limit(0), i), (d, i.limit(0)), (d, i.filter("item_id = 3"))):
        assert dc.contaminated(x, y).collect() == []
    assert dc.drop_contaminated(d, i.limit(0)).count() == len(docs)


def test_sketches_are_long_enough():
    for size in range(1, 300):
        upper = next(u for u in dc.SIZES if size <= u)
        needed = upper - math.ceil(dc.THRESHOLD * upper - 1e-9) + 1
        lost = size - math.ceil(dc.THRESHOLD * size - 1e-9)
        assert min(needed, size) > lost


def test_shuffled_when_many(spark, monkeypatch, sf_dir):
    whole = found(dc.op4_decontamination(spark, sf_dir))
    monkeypatch.setattr(dc, "small_or_shuffled", lambda df: df)
    assert found(dc.op4_decontamination(spark, sf_dir)) == whole
