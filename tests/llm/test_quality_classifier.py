import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import quality_classifier as q


def test_em_recovers_planted_shares():
    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.7
    codes = np.zeros(len(good), int)
    for k in range(len(q.LABELLERS)):
        p = np.where(good[:, None], (0.55, 0.02, 0.43), (0.5, 0.35, 0.15))
        vote = (rng.random(len(good))[:, None] > p.cumsum(axis=1)).sum(axis=1)
        codes = codes * 3 + vote
    patterns, counts = np.unique(codes, return_counts=True)
    posterior, shares, prior = q.estimate(list(zip(patterns.tolist(), counts.tolist(), strict=True)))
    assert abs(prior - 0.7) < 0.02
    assert np.abs(shares[:, 0] - (0.5, 0.35, 0.15)).max() < 0.05
    assert np.abs(shares[:, 1] - (0.55, 0.02, 0.43)).max() < 0.05
    assert ((np.array([posterior[c] for c in codes]) > 0.5) == good).mean() > 0.9


def slow_measures(text):
    """The measures of a text, one character and one word at a time."""
    words = text.split()
    symbols = capitals = letters = visible = 0
    for c in text:
        wide = ord(c) > 0xFFFF
        if wide or not (c.isalpha() or c.isdigit() or c.isspace() or c in ".,;:!?'\"()-" or c.islower() or c.isupper()):
            symbols += 1
        elif c.isupper():
            capitals += 1
        visible += wide or not c.isspace()
        letters += not wide and (c.islower() or c.isupper() or c.isalpha())
    n, few, chars = len(words), q.KNOWN_WORDS, q.KNOWN_CHARS
    share = lambda holds: sum(map(bool, map(holds, words))) / (n + few)
    lines = [x for x in text.split("\n") if x.strip()]
    fresh = len(set(words)) / min(n, 8 * n**0.5) if n else 0
    return [
        symbols / (visible + chars), capitals / (letters + chars), share(lambda w: w[-2:] == "!!"), share(lambda w: len(w) == 1 and not w.isalnum() and w not in q.STANDS_ALONE), sum(a == b for a, b in zip(words, words[1:])) / (n + few),
        (n * max(0.0, 1 - fresh) + few * 0.5) / (n + few), 1 - len(set(lines)) / len(lines) if len(lines) > 3 else 0.0, share(lambda w: w[-1] in "#$%&*@~^|<>=+"),
        share(lambda w: not q._PLAIN.fullmatch(w)) + few * 0.15 / (n + few), share(lambda w: w[-1] in ".!?" and (len(w) == 1 or w[-2] not in ".!?")), sum(len(w) for w in words if len(w) >= 60 and w.isascii()) / max(1, visible),
    ]


def slow_votes(values):
    of = dict(zip(q.MEASURES, values, strict=True))
    out = []
    for measure, junk, good in q.ONE_MEASURE.values():
        out.append(q.JUNK if of[measure] >= junk else q.GOOD if good is not None and of[measure] <= good else q.NOTHING)
    return out + [q.GOOD if 0.01 <= of["sentence_ends"] <= 0.5 and of["capitals"] < 0.2 and of["adjacent_repeats"] < 0.1 else q.NOTHING]


def slow_em(all_votes):
    """Expectation-maximisation over the texts themselves, each by itself: their posteriors of being good."""
    start = {q.JUNK: (0.60, 0.30, 0.10), q.GOOD: (0.49, 0.01, 0.50)}
    tables = {c: [list(t) for _ in q.LABELLERS] for c, t in start.items()}
    seen, prior = max(1.0, q.PRIOR_SHARE * len(all_votes)), q.GOOD_SHARE
    voted = [v for v in all_votes if any(v)]
    good = []
    for _ in range(q.EM_ROUNDS):
        good = []
        for v in voted:
            of = {c: math.prod(tables[c][k][x] for k, x in enumerate(v)) for c in tables}
            good.append(prior * of[q.GOOD] / (prior * of[q.GOOD] + (1 - prior) * of[q.JUNK]))
        for c, weights in ((q.JUNK, [1 - g for g in good]), (q.GOOD, good)):
            for k in range(len(q.LABELLERS)):
                sums = [seen * start[c][x] + sum(w for w, v in zip(weights, voted, strict=True) if v[k] == x) for x in range(3)]
                tables[c][k] = [s / sum(sums) for s in sums]
        new = (seen * q.GOOD_SHARE + sum(good)) / (seen + len(voted))
        if abs(new - prior) < 1e-9:
            break
        prior = new
    of = iter(good)
    return [next(of) if any(v) else q.GOOD_SHARE for v in all_votes]


def slow_features(text, seen):
    """Dense features: hashed shares of class trigrams, and bins of the measures."""
    kind = [int(q.kinds_of(c)[0]) for c in text]
    x = np.zeros(q.DIMENSIONS + 1)
    half, grams = q.DIMENSIONS // 2, list(zip(kind, kind[1:], kind[2:]))
    for a, b, c in grams:
        x[((a * 256 + b * 16 + c) * 2654435761 >> 7) % half] += 1
    x[:half] = np.sqrt(x[:half] / max(1, len(grams))) * min(1.0, (len(grams) / q.SURE_CHARS) ** 0.5)
    for k, v in enumerate(seen):
        x[half + (k * 10 + min(9, int(v * 10))) * 2654435761 % (half - 1)] += 0.3
    x[-1] = 1
    return x


def test_whole_table_matches_brute_force(spark, sf_dir):
    """All texts of a small table are in the sample: EM over texts, dense features and plain gradient steps give the same scores."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    texts = sorted({r.text or "" for r in rows})
    seen = {t: slow_measures(t) for t in texts}
    weak = dict(zip([r.text or "" for r in rows], slow_em([slow_votes(seen[r.text or ""]) for r in rows]), strict=True))
    x = np.stack([slow_features(t, seen[t]) for t in texts])
    label, w, velocity = np.array([weak[t] for t in texts]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(300):
        p = 1 / (1 + np.exp(-x @ w))
        velocity = 0.9 * velocity - 2.0 * (x.T @ (p - label) / len(texts) + 1e-5 * w)
        w += velocity
    want = dict(zip(texts, 1 / (1 + np.exp(-x @ w)), strict=True))
    found = {r.doc_id: (r.score, r.kept) for r in q.op1_quality_classifier(spark, sf_dir).collect()}
    assert len(found) == len(rows)
    for r in rows:
        score, kept = found[r.doc_id]
        assert score == pytest.approx(want[r.text or ""], abs=2e-3) and kept == (score >= q.THRESHOLD)


def test_votes_round_trip():
    for code in (0, 1, 5, 3 ** len(q.LABELLERS) - 1):
        again = 0
        for v in q.decode(code):
            again = again * 3 + v
        assert again == code


def test_votes_on_short_and_unbroken_texts():
    """What is plain in a few words gets its vote; a few clean words get none for junk, and a text without words none at all."""
    of = lambda text: dict(zip(q.LABELLERS, q.decode(q.features(text)[0]), strict=True))
    junk = lambda text: {k for k, v in of(text).items() if v == q.JUNK}
    assert {"odd_symbols", "odd_endings", "odd_words"} <= junk(" ".join(["#$%^&", "@@@", "***!", "&&^"] * 4))
    assert "unbroken" in junk("x7Gf9" * 10_000) and "unbroken" in junk("see " + "a" * 200) and {"same_word_again", "few_words"} <= junk("buy " * 18)
    assert "separators" in junk("one | two | three |") and "odd_endings" in junk("That*** atly.###")
    for clean in ("Hello there.", "What is photosynthesis?", "Can you help me with my maths homework today please?", "ok", "HELP me now!!", "Voilà, c'est tout – merci !", "今天天气很好，我们去公园散步吧。", "See https://example.org/a/rather/long/path for more about this."):
        assert not junk(clean), clean
    assert q.features("")[0] == q.features(" \n")[0] == 0


def test_short_junk_goes_and_short_clean_texts_stay(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("few", F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+")) < 20).select("doc_id", "few")
    found = q.op1_quality_classifier(spark, sf).join(docs, "doc_id").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("few")
    good, junk = (found.filter(F.col("quality") == v).agg(F.avg(F.col("kept").cast("int"))).first()[0] for v in (1, 0))
    assert good > 0.98 and junk < 0.7


def test_agrees_with_labels_it_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    found = q.op1_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    good, junk = (found.filter(F.col("quality") == v).agg(F.avg(F.col("kept").cast("int"))).first()[0] for v in (1, 0))
    assert good > 0.99 and junk < 0.15


def test_odd_rows(spark):
    prose = "A plain sentence of some words follows here, and then it ends. " * 5
    rows = [(1, prose), (2, prose), (None, prose), (3, None), (4, ""), (5, "x" * 200_000), (6, "word " * 100_000), (7, "\U0001f600 " * 50), (8, prose)]
    rows += [(10 + k, "BUY NOW!! " * 40) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0.5 as score", "1 as h", "'a' as pattern", "2 as quality_score")
    found = q.scored(docs)
    assert sorted(found.columns) == sorted(docs.columns)
    scores = {r.doc_id: r.quality_score for r in found.collect()}
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores.values())
    assert scores[1] == scores[2] == scores[8] == scores[None] and scores[3] == scores[4]
    kept = q.keep_good(docs)
    assert kept.columns == docs.columns and {1, 2, 8} <= {r.doc_id for r in kept.collect()}
    assert q.scored(docs.limit(0)).collect() == [] and q.keep_good(docs.limit(0)).collect() == []
