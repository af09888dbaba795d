import math
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import language_id as li


def brute_words(text):
    """Runs of letters, by their Unicode category."""
    return "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()).split()


def brute_fit(rows):
    """By size of term the log frequencies of what is kept, a vector over all languages; rows: (text, lang)."""
    langs = sorted({k for t, k in rows if k is not None and brute_words(t)})
    tables = {}
    for size in range(li.LONGEST + 1):
        counts = {k: Counter() for k in langs}
        for t, k in rows:
            for w in brute_words(t) if k is not None else ():
                marked = f"<{w}>"
                counts[k].update([w] if not size else [marked[i : i + size] for i in range(len(marked) - size + 1)])
        kept = {k: dict([x for x in sorted(c.items(), key=lambda x: (-x[1], x[0])) if x[1] >= li.LEAST_COUNT][: li.GRAMS if size else li.WORDS]) for k, c in counts.items()}
        terms = {t for c in kept.values() for t in c}
        tables[size] = {t: np.array([math.log((kept[k].get(t, 0) + 1) / (sum(kept[k].values()) + len(terms))) for k in langs]) for t in terms}
    return langs, tables


def brute_predict(model, text):
    langs, tables = model
    words = brute_words(text)
    if not words or not langs:
        return "und", 0.0
    total = np.zeros(len(langs))
    for w in words:
        if w in tables[0]:
            total += tables[0][w]
            continue
        marked = f"<{w}>"
        for size in range(li.LONGEST, 0, -1):
            hits = [tables[size][g] for g in (marked[i : i + size] for i in range(len(marked) - size + 1)) if g in tables[size]]
            if hits:
                total += sum(hits) / len(hits)
                break
    odds = np.exp((total - total.max()) / math.sqrt(len(words)))
    return langs[int(total.argmax())], odds.max() / odds.sum()


def test_held_out_accuracy_and_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r.doc_id: r for r in li.op3_language_id(spark, sf).join(docs.select("doc_id", "text", "lang"), "doc_id").collect()}
    out = [r for r in found.values() if r.held_out]
    assert sum(r.lang_pred == r.lang for r in out) > 0.98 * len(out)
    # The sample holds all texts of a table of this size.
    model = brute_fit([(r.text, r.lang) for r in found.values() if not r.held_out])
    for r in found.values():
        lang, score = brute_predict(model, r.text)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-6)


def test_counts_and_bound(spark):
    rows = [("aa b", "x"), ("aa c c", "x"), ("aa", "y"), (None, "x"), ("zz", None)] * 5
    df = spark.createDataFrame(rows, "text string, lang string")
    model = li.fit(df)
    assert model.langs == ["x", "y"] and set(model.tables[0].places) == {"aa", "b", "c"}
    assert model.predict(["aa"])[0][0] == "y" and len(model.tables[0].lang) == 4
    many = spark.createDataFrame([(f"w{i} ggg hhh", "x") for i in range(3000)] + [("ggg kkk", "y")] * 3, "text string, lang string")
    assert Counter(li.words_in("ÄB-c1 d"))["äb"] == 1
    assert "ggg" in li.fit(many, sample_rows=50).tables[0].places


def test_only_letters_make_words(spark):
    docs = spark.createDataFrame([(1, "the of"), (2, "²½ ③"), (3, "Ⅳ ①"), (4, "٣ 42 _"), (5, "x²y"), (6, "の")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    model = li.fit(spark.createDataFrame([("the of x y", "en"), ("der die x", "de")] * 5, "text string, lang string"))
    found = {r.doc_id: (r.lang_pred, r.score) for r in li.predict(docs, model).collect()}
    assert found[2] == found[3] == found[4] == ("und", 0.0) and found[1][0] == "en" and found[6][0] in ("de", "en")
    assert li.words_in("x²y Ⅳ") == ["x", "y"] == brute_words("x²y Ⅳ")


def test_ties_and_clashing_columns(spark):
    model = li.fit(spark.createDataFrame([("aa bb", "y"), ("aa bb", "x")] * 5, "text string, lang string"))
    docs = spark.createDataFrame([("aa",), ("qq",)], "text string").selectExpr("text", "1 as found", "2 as `found_`", "3 as Score", "4 as number")
    got = li.predict(docs, model).collect()
    assert [(r.lang_pred, r.score, r.found, r.found_, r.number) for r in got] == [("x", 0.5, 1, 2, 4)] * 2


def test_odd_rows(spark):
    rows = [(1, "la casa de", "es"), (2, "the house of", "en")] * 10
    rows += [(3, None, "en"), (4, "", "en"), (5, "123 -- !", "en"), (None, "the of", None), (6, "the " * 200_000, None), (7, "ωωω", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'q' as lang_pred", "9 as score", "1 as h")
    model = li.fit(docs)
    found = {(r.doc_id, r.text and r.text[:9]): r for r in li.predict(docs, model).collect()}
    assert [found[k].lang_pred for k in ((3, None), (4, ""), (5, "123 -- !"))] == ["und"] * 3
    assert found[None, "the of"].lang_pred == "en" and found[6, "the the t"].lang_pred == "en"
    assert found[7, "ωωω"].lang_pred in ("en", "es")
    nothing = li.fit(docs.filter("lang is null"))
    assert {r.lang_pred for r in li.predict(docs, nothing).collect()} == {"und"}
    assert li.predict(docs.limit(0), model).collect() == []
