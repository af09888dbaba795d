import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import attention_model as am
from colloquy.llm import lm_scoring as lm
from colloquy.llm import passage_memory as pm


def small_model(seed=4):
    counts = np.random.default_rng(seed).zipf(1.3, 3000).astype(float)
    unit, inside, share = am.units_of(counts)
    weights = am.start_weights(share, np.arange(am.SIZES) + 1.0, seed)
    for name in ("cluster", "unit", "size"):
        weights[name][..., :-1] *= 8
    weights["q"] *= 2
    return unit, inside, share, weights


def some_texts(sizes=(1, 5, 32, 33, 100), seed=2):
    """Texts of random words of 1 to 4 ids, and one of many; each ends with unit 7."""
    rng = np.random.default_rng(seed)
    ids, words = [], []
    for n in sizes:
        for k in range(n):
            word = [7] if k == n - 1 else rng.integers(0, am.UNITS, 1 + rng.integers(4) if k != 3 else 30).tolist()
            words.append(len(word))
            ids += word
    return am.Texts(np.array(ids, np.int32), np.array(words), np.array(sizes))


def test_shares_sum_to_one():
    unit, inside, share, w = small_model()
    assert np.allclose(np.bincount(unit, np.exp(inside), minlength=am.UNITS)[np.unique(unit)], 1)
    hidden = np.tanh(np.random.default_rng(1).normal(size=(3, am.WIDTH))).astype(np.float32)
    hidden[:, -1] = 1
    for h in hidden:
        logs, _ = am.unit_logs(w, np.repeat(h[None], am.UNITS, axis=0), np.arange(am.UNITS), None, am.Scratch())
        assert math.isclose(np.exp(logs).sum(), 1, rel_tol=1e-4)
        sizes = am.choice(np.repeat(h[None], am.SIZES, axis=0), w["size"], np.arange(am.SIZES), None, am.Scratch(), None)
        assert math.isclose(np.exp(sizes).sum(), 1, rel_tol=1e-4)


def softmax_log(logits, picked):
    return logits[picked] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()


def brute_word(w, before, word, places):
    """Log probability of a word (its units) after the words that may be read, at their places in the window."""

    def vector(ids):
        first, second, last = ids[0], ids[1] + am.UNITS if len(ids) > 1 else am.NO_ID, ids[-1] + 2 * am.UNITS if len(ids) > 2 else am.NO_ID
        return w["embed"][first] + w["embed"][second] + w["embed"][last]

    x = np.array([vector(i) for i in before]) + w["place"][places]
    kv = x @ w["kv"]
    score = np.exp(kv[:, : am.WIDTH] @ (x[-1] @ w["q"]) / np.sqrt(am.WIDTH))
    state = score / score.sum() @ kv[:, am.WIDTH :] @ w["out"] + x[-1] @ w["stay"] + w["bias"]
    hidden = np.append(np.tanh(state)[:-1], 1)
    total = softmax_log(w["size"] @ hidden, min(len(word), am.SIZES) - 1)
    for k, u in enumerate(word):
        h = np.append(np.tanh(state + w["before"][word[k - 1] if k else am.UNITS])[:-1], 1)
        total += softmax_log(w["cluster"] @ h, u // am.IN_CLUSTER) + softmax_log(w["unit"][u // am.IN_CLUSTER] @ h, u % am.IN_CLUSTER)
    return total


@pytest.mark.parametrize("batch", [3, 192])
def test_windows_score_each_word_once_as_one_by_one(monkeypatch, batch):
    monkeypatch.setattr(am, "SCORE_BATCH", batch)
    _, _, _, w = small_model()
    texts, end = some_texts(), 7
    got = am.score_words(w, texts, end, am.Scratch())
    spelling = [texts.units[s : s + n].tolist() for s, n in zip(texts.starts, texts.sizes, strict=True)]
    for a, b in zip(texts.texts, texts.texts[1:], strict=False):
        before = [[end], *spelling[a:b]]
        for t in range(b - a):
            window = t // am.STRIDE * am.STRIDE - am.CONTEXT
            first = max(0, window)
            want = brute_word(w, before[first : t + 1], spelling[a + t], np.arange(first, t + 1) - window)
            assert math.isclose(got[a + t], want, abs_tol=2e-3)


def test_gradients():
    _, _, _, w = small_model()
    w = {k: v.astype(float) for k, v in w.items()}
    texts = some_texts((40, 50))
    room = am.Scratch(float)
    b = am.Batch(texts, texts.windows(), 7)
    _, grad = am.gradients(w, b, room)
    for name in w:
        for at in (np.abs(grad[name]).ravel().argsort()[[-1, -5]]).tolist():
            at = np.unravel_index(at, grad[name].shape)
            keep, step = w[name][at], 1e-4
            w[name][at] = keep + step
            up, _ = am.gradients(w, b, room)
            w[name][at] = keep - step
            down, _ = am.gradients(w, b, room)
            w[name][at] = keep
            assert math.isclose((up - down) / 2 / step, grad[name][at], rel_tol=2e-3, abs_tol=1e-7), name


def test_training_moves_all_weights(spark):
    ranks = lm.load_ranks(lm.TOKENIZER)
    sent = spark.sparkContext.broadcast(ranks)
    unit, _, share = am.units_of(np.ones(len(ranks) + 1))
    start = am.start_weights(share)
    rows = spark.createDataFrame([(f"word{k} of text {k % 7} and more " * (1 + k % 3),) for k in range(60)], "text string").repartition(3)
    after = lm.train_on(rows, sent, unit, start)
    assert set(after) == set(start) and all(after[k].shape == start[k].shape and np.isfinite(after[k]).all() for k in start)
    assert all(np.abs(after[k] - start[k]).max() > 0 for k in start)
    assert lm.train_on(rows.limit(0), sent, unit, start) is start


def test_rounds_see_each_text_once_and_average_by_words(spark, monkeypatch):
    """With ROUNDS of one task each, training is the same steps as here, one text set after another."""
    ranks = lm.load_ranks(lm.TOKENIZER)
    sent = spark.sparkContext.broadcast(ranks)
    unit, _, share = am.units_of(np.ones(len(ranks) + 1))
    start = am.start_weights(share)
    texts = [f"word{k} of text {k % 7}" for k in range(40)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    got = lm.train_on(rows, sent, unit, start)
    w, s = {k: v.copy() for k, v in start.items()}, {k: np.zeros_like(v) for k, v in start.items()}
    own, room, seen = lm.Words(ranks), am.Scratch(), 0
    for turn in range(lm.ROUNDS):
        some = [r.text for r in rows.filter(F.pmod(F.xxhash64("text", F.lit("round")), F.lit(lm.ROUNDS)) == turn).collect()]
        seen += len(some)
        _, count, ids, size = lm.spelt(own, some)
        run = am.Texts(unit[ids], size, count + 1)
        am.step(w, s, am.Batch(run, run.windows()[np.random.default_rng(5).permutation(len(some))], unit[own.end]), room)
    assert seen == len(texts)
    assert all(np.allclose(got[k], w[k], atol=1e-4) for k in w)


def test_segments_are_cut_alike_wherever_they_stand():
    rng = np.random.default_rng(8)
    passage = rng.integers(0, 2**63, 400, dtype=np.uint64)
    one, two = rng.integers(0, 2**63, 90, dtype=np.uint64), rng.integers(0, 2**63, 31, dtype=np.uint64)
    words = np.concatenate([one, passage, two, passage, one])
    first, of, context, segment = pm.segments(words, np.array([len(one) + 400, len(two) + 400 + len(one)]))
    assert (of == np.repeat([0, 1], [(of == 0).sum(), (of == 1).sum()])).all() and (context[first == 0] == 0).all()
    same = set(segment[of == 0]) & set(segment[of == 1])
    assert len(same) > 0.7 * 400 / pm.ANCHORS and len(set(segment)) < len(segment)
    # Each place is in one segment, which an anchor's context or a text's end closes.
    assert first[0] == 0 and (np.diff(first) > 0).all() and len(one) + 400 in first
    assert pm.segments(np.empty(0, np.uint64), np.empty(0, np.int64))[0].tolist() == []


def test_memory_of_recurring_passages(spark):
    """The kept segments and what is left sum to one; gains are those of the mixture, counted by hand."""
    seen = [(7, 70)] * 3 + [(7, 71)] * 2 + [(7, 72)] + [(8, 80)] + [(0, 5)] * 9
    kept, contexts = pm.learn(spark.createDataFrame(seen, "context long, segment long"))
    assert {(r.context, r.segment, r.c) for r in kept.collect()} == {(7, 70, 3), (7, 71, 2)}
    (c,) = contexts.collect()
    assert (c.context, c.n, c.sure) == (7, 6, 4.0)
    rows = [(1, 7, 70, -2.0), (1, 7, 99, -3.0), (2, 8, 80, -4.0), (3, 7, 71, -800.0), (3, 9, 70, -1.0)]
    got = {r.n: r.gain for r in pm.gains(spark.createDataFrame(rows, "n long, context long, segment long, log double"), kept, contexts).collect()}
    left = 1 - 4.0 / 6
    assert set(got) == {1, 3}
    assert got[1] == pytest.approx(math.log(2.5 / 6 + left * math.exp(-2)) + 2 + math.log(left))
    assert got[3] == pytest.approx(math.log(1.5 / 6) + 800)


def test_texts_that_occur_twice_are_scored_apart(spark, tmp_path):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 200)) for _ in range(60)]
    ids = [i for i in range(200) if not fold(i)]
    rows = list(zip(ids, texts + texts[:15], strict=False))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = lm.op2_lm_scoring(spark, str(tmp_path)).collect()
    found = {r.doc_id: r.recalled_score / r.n_tokens for r in rows}
    # The memory is no part of the score: what occurs once has the model's in both, and what occurs twice in the score alone.
    assert all(abs(r.score - r.recalled_score) < 0.1 * r.n_tokens for r in rows if r.doc_id in ids[15:60]) and all(r.score < r.recalled_score - r.n_tokens for r in rows if r.doc_id in ids[:15])
    twice, once = [found[i] for i in ids[:15] + ids[60:75]], [found[i] for i in ids[15:60]]
    assert min(twice) > max(once)
    assert all(abs(found[a] - found[b]) < 1e-6 for a, b in zip(ids[:15], ids[60:75], strict=True))


def fold(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def brute_base(rows):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    count = Counter()
    for i, t in rows:
        if not fold(i):
            count.update([*low(t), b""])
    n, v = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        tokens = [*low(t), b""]
        out.append((i, fold(i), len(tokens), sum(count[w] > 0 for w in tokens), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)))
    return sorted(out, key=lambda r: (str(r[0]), r[5]))


def same(found, want):
    found = sorted(found, key=lambda r: (str(r[0]), r[5]))
    assert [tuple(r)[:5] for r in found] == [r[:5] for r in want]
    assert all(math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(found, want, strict=True))


@pytest.mark.parametrize("frequent", [50_000, 300])
def test_base_of_whole_table_and_held_out_score(spark, sf_dir, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = lm.op2_lm_scoring(spark, sf_dir).collect()
    same(found, brute_base(rows))
    # Guessing among all ids of the tokenizer, of which a word has two at least, would cost more than twice as much.
    out = [r for r in found if r.held_out]
    assert sum(r.score for r in out) > -5 * sum(r.n_tokens for r in out)


def test_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 5)
    rows = [(1, None), (2, ""), (3, " \t"), (4, "é Ä A a b\x0bc d\x1ce"), (None, "a b"), (5, "a b"), (5, "a b"), (6, "x" * 50_000), (7, "long " * 60_000), (8, "\U0001f600 never")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "2 as word", "3 as n", "'x' as rest").write.parquet(f"{tmp_path}/documents.parquet")
    found = lm.op2_lm_scoring(spark, str(tmp_path)).collect()
    same(found, brute_base(rows))
    assert all(r.score < 0 for r in found)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert lm.score_texts(docs.limit(0), docs).collect() == []
    nothing = lm.score_texts(docs, docs.limit(0)).collect()
    assert len(nothing) == len(rows) and {r.n_known for r in nothing} == {0}


def test_words_are_encoded_alike_together_and_alone():
    ranks = lm.load_ranks(lm.TOKENIZER)
    words = [b"the", b"of,", "straße".encode(), b"a1b2", "x\u00a0y".encode(), "\u00a0z".encode(), "end\u2003".encode(), b"x\x1cy", b"l" * 700, "\U0001f600!".encode(), b"don't", b"--"]
    together = lm.Words(ranks)
    ids, size = together.id_runs(together.numbers(words))
    assert size.sum() == len(ids) and together.encoding.decode(ids.tolist()) == " " + " ".join(w.decode() for w in words)
    for w, run in zip(words, np.split(ids, np.cumsum(size)[:-1]), strict=True):
        alone = lm.Words(ranks)
        assert alone.id_runs(alone.numbers([w]))[0].tolist() == run.tolist()


def test_words_are_split_as_python_splits_bytes():
    texts = ["", None, " \t", "A b\x0bÄ\x0c c\rd\ne", "x\x1cy   Z  end ", "A", "ÀÉ İ \U0001f600B a"]
    want = [bytes(t or "", "utf-8").lower().split() for t in texts]
    kinds, at, count = lm.words_in(texts)
    kinds = lm.as_bytes(kinds)
    assert len(set(kinds)) == len(kinds) and count.tolist() == [len(w) for w in want]
    assert [kinds[k] for k in at] == [w for ws in want for w in ws]
    assert [x.tolist() for x in lm.words_in([])[1:]] == [[], []]


def test_segments_of_scored_texts_are_not_cut_again(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).coalesce(2).cache()
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    both = docs.union(docs.limit(5).select(F.col("doc_id") + 100_000, "text"))
    want = {r.doc_id: r.recalled_score for r in lm.score_texts(both, both.filter(~fold)).collect()}
    monkeypatch.setattr(lm, "count_segments", None)
    got = lm.score_texts(both, both.filter(~fold), learnt=~fold).collect()
    assert {r.doc_id for r in got} == set(want) and any(r.recalled_score > r.score + 1 for r in got)
    assert all(math.isclose(r.recalled_score, want[r.doc_id], rel_tol=1e-3) for r in got)
    assert len(lm.op2_lm_scoring(spark, sf_dir).collect()) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
