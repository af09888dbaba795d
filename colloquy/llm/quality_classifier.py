"""Quality classifier from weak labels.

Overlapping heuristic labellers vote junk, good or nothing on every text. Expectation-maximisation
over the counts of vote patterns (a table whose size the labellers fix, not the data) estimates how
accurate each labeller is and how much junk there is; a pattern's posterior is the weak label of its
texts. The posteriors of a bounded sample train a logistic scorer on hashed features: word shapes,
character-class trigrams and binned repetition, so that it also learns from what no labeller names.
A text's score is the scorer's probability that it is good, and texts under THRESHOLD are rejected.

Texts are read once: what the labellers see and the features of it are one pass, written beside the rows'
columns; votes, training and scores are made of that. Votes and pattern counts cover all texts; only the scorer
is fitted on a sample: SAMPLE_ROWS texts at most in expectation, chosen by a hash of the text, stratified by pattern.

A measure of a short text is drawn towards a value at which nobody votes, as if it had KNOWN_WORDS words (or KNOWN_CHARS characters)
more, so that a few words are judged by what is plain in them, and one odd word condemns nothing. That holds at any length, and hardly shows in long texts.

Defined results: a null text counts as empty; texts without words get no votes and are scored like any other; equal texts get equal scores; an empty table gives an
empty result; other columns are carried.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import staged, table

SAMPLE_ROWS = 4_000
DIMENSIONS = 1 << 12
THRESHOLD = 0.3
SURE_CHARS = 300
KNOWN_WORDS, KNOWN_CHARS = 8, 80
#: A word so long, of ASCII, is no word of a language.
UNBROKEN = 60
EM_ROUNDS = 200
PRIOR_SHARE = 0.02
GOOD_SHARE = 0.8

NOTHING, JUNK, GOOD = 0, 1, 2
#: Labellers of one measure, from 0 to 1: junk from the first number on, good up to the second (None: never).
ONE_MEASURE = {
    "odd_symbols": ("symbols", 0.05, None),
    "shouting": ("capitals", 0.30, None),
    "exclaiming": ("exclaims", 0.10, None),
    "separators": ("lone_symbols", 0.10, None),
    "same_word_again": ("adjacent_repeats", 0.15, None),
    "few_words": ("word_repeats", 0.60, 0.35),
    "same_lines": ("line_repeats", 0.40, None),
    "odd_endings": ("symbol_endings", 0.15, None),
    "odd_words": ("odd_words", 0.30, 0.05),
    "unbroken": ("unbroken", 0.50, None),
}
LABELLERS = [*ONE_MEASURE, "sentences"]
MEASURES = ["symbols", "capitals", "exclaims", "lone_symbols", "adjacent_repeats", "word_repeats", "line_repeats", "symbol_endings", "odd_words", "sentence_ends", "unbroken"]
#: Marks that some languages write between blanks.
STANDS_ALONE = "!?:;,.–—-&«»"
#: Where nobody votes, if it isn't 0.
UNDECIDED = {"word_repeats": 0.5, "odd_words": 0.15}

_PLAIN = re.compile(r"['\"(]?[^\W\d_]+(?:['’-][^\W\d_]+)*['\")]?[.,;:!?]?['\")]?")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """A small class for each of the first 2^16 code points: letters 0 to 2, digits 3, blanks 4 and 5,
    usual punctuation 6 to 8, symbols from 9 on. What lies beyond counts as a symbol."""
    out = np.zeros(1 << 16, np.uint8)
    for k in range(1 << 16):
        c = chr(k)
        out[k] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c == " " else 5 if c.isspace() else 6 if c in ".,;:" else 7 if c in "!?" else 8 if c in "'\"()-" else 0 if c.isalpha() else 9 + k % 7
    return out


def kinds_of(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _classes()[np.minimum(code, (1 << 16) - 1)]


def measures(text: str, kinds: np.ndarray) -> list[float]:
    """What the labellers look at, each from 0 to 1, in the order of MEASURES."""
    words = text.split()
    n = len(words)
    count = np.bincount(kinds, minlength=16)
    visible = len(kinds) - count[4:6].sum()
    distinct = set(words)
    times = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    total = lambda holds: sum(times[w] for w in distinct if holds(w))
    drawn = lambda hits, measure="": (hits + KNOWN_WORDS * UNDECIDED.get(measure, 0.0)) / (n + KNOWN_WORDS)
    return [
        count[9:].sum() / (visible + KNOWN_CHARS),
        count[2] / (count[:3].sum() + KNOWN_CHARS),
        drawn(total(lambda w: w.endswith("!!"))),
        drawn(total(lambda w: len(w) == 1 and not w.isalnum() and w not in STANDS_ALONE)),
        drawn(sum(map(str.__eq__, words, words[1:]))),
        # Long texts repeat common words: what counts is how far they fall below the usual growth of a vocabulary.
        drawn(n * max(0.0, 1 - len(distinct) / max(1, min(n, 8 * n**0.5))), "word_repeats"),
        1 - len(set(lines)) / len(lines) if len(lines) > 3 else 0.0,
        drawn(total(lambda w: w[-1] in "#$%&*@~^|<>=+")),
        drawn(n - total(_PLAIN.fullmatch), "odd_words"),
        drawn(total(lambda w: w[-1] in ".!?" and w[-2:-1] not in ".!?")),
        sum(times[w] * len(w) for w in distinct if len(w) >= UNBROKEN and w.isascii()) / max(1, visible),
    ]


def votes(values: list[float]) -> int:
    """The votes of all labellers as one number in base 3."""
    of = dict(zip(MEASURES, values, strict=True))
    code = 0
    for measure, junk, good in ONE_MEASURE.values():
        x = of[measure]
        code = code * 3 + (JUNK if x >= junk else GOOD if good is not None and x <= good else NOTHING)
    prose = 0.01 <= of["sentence_ends"] <= 0.5 and of["capitals"] < 0.2 and of["adjacent_repeats"] < 0.1
    return code * 3 + (GOOD if prose else NOTHING)


def decode(code: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        code, v = divmod(code, 3)
        out.append(v)
    return out[::-1]


def estimate(patterns: list[tuple[int, int]]) -> tuple[dict[int, float], np.ndarray, float]:
    """EM over (pattern, count): the posterior of good by pattern, P(vote | class) by labeller, P(good).

    A labeller's accuracy is its table of vote shares in the two classes. Labellers look for different
    kinds of junk, so most of them miss most of it, while they seldom call good texts junk; EM starts
    there, and PRIOR_SHARE of the texts count as seen so in advance, which keeps it from taking one
    kind of junk for all of it. Texts without votes count as good with GOOD_SHARE, at any share of junk.
    """
    start = np.empty((len(LABELLERS), 2, 3))
    start[:, 0], start[:, 1] = (0.60, 0.30, 0.10), (0.49, 0.01, 0.50)
    if not patterns:
        return {}, start, GOOD_SHARE
    vote = np.array([decode(p) for p, _ in patterns])
    count = np.array([c for _, c in patterns], float)
    voted = (vote != NOTHING).any(axis=1)
    each, seen, prior, shares = np.arange(len(LABELLERS)), max(1.0, PRIOR_SHARE * count.sum()), GOOD_SHARE, start.copy()
    for _ in range(EM_ROUNDS):
        logs = [np.log(shares[each, c, vote]).sum(axis=1) for c in (0, 1)]
        good = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + logs[1] - logs[0], -50, 50)))
        for c, weight in ((0, count * (1 - good)), (1, count * good)):
            for v in range(3):
                shares[:, c, v] = seen * start[:, c, v] + (weight[voted, None] * (vote[voted] == v)).sum(axis=0)
            shares[:, c] /= shares[:, c].sum(axis=1, keepdims=True)
        new = (seen * GOOD_SHARE + (count * good)[voted].sum()) / (seen + count[voted].sum())
        done, prior = abs(new - prior) < 1e-9, new
        if done:
            break
    return {p: float(g) if any_vote else GOOD_SHARE for (p, _), g, any_vote in zip(patterns, good, voted, strict=True)}, shares, float(prior)


def features(text: str) -> tuple[int, np.ndarray, np.ndarray]:
    """The votes on a text, and its hashed features (index, value): shares of character-class trigrams, and binned measures."""
    codes = kinds_of(text)
    seen = measures(text, codes)
    kinds = codes.astype(np.int64)
    trigram = (kinds[:-2] * 256 + kinds[1:-1] * 16 + kinds[2:]) if len(kinds) > 2 else np.empty(0, np.int64)
    half = DIMENSIONS // 2
    hashed = (trigram * 2654435761 >> 7) % half
    counts = np.bincount(hashed, minlength=half)
    at = np.flatnonzero(counts)
    # A short text says little: its shares count for less.
    value = np.sqrt(counts[at] / max(1, len(trigram))) * min(1.0, (len(trigram) / SURE_CHARS) ** 0.5)
    extra = [half + (hash_bin(k, min(9, int(x * 10)))) for k, x in enumerate(seen)]
    return votes(seen), np.concatenate([at, extra]).astype(np.int32), np.concatenate([value, np.full(len(extra), 0.3)]).astype(np.float32)


def hash_bin(measure: int, bin_: int) -> int:
    return (measure * 10 + bin_) * 2654435761 % (DIMENSIONS // 2 - 1)


def train(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, weight: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic weights (bias last) for soft labels, by gradient steps with momentum and a small L2 term."""
    seen = np.unique(np.concatenate([at for at, _ in rows]))
    x = np.zeros((len(rows), len(seen) + 1), np.float32)
    for k, (at, value) in enumerate(rows):
        np.add.at(x[k], np.searchsorted(seen, at), value)
    x[:, -1] = 1
    w, velocity = np.zeros(len(seen) + 1), np.zeros(len(seen) + 1)
    share = (weight / weight.sum()).astype(np.float32)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        velocity = 0.9 * velocity - 2.0 * (((p - label) * share) @ x + 1e-5 * w)
        w += velocity
    out = np.zeros(DIMENSIONS + 1, np.float32)
    out[seen], out[-1] = w[:-1], w[-1]
    return out


def read(text: Column) -> Column:
    @F.pandas_udf("pattern int, at array<int>, value array<float>")
    def seen(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([features(t) for t in texts.fillna("")], columns=["pattern", "at", "value"])

    return seen(text)


def featured(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Rows (row, h, pattern, at, value): the columns to keep, a hash of the text, and what was read of it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.xxhash64(text).alias("h"), read(text).alias("f"))
    return staged(rows.select("row", "h", "f.*"), "quality-features")


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray | None:
    """The scorer's weights from featured rows; None if there are none."""
    counts = [(r.pattern, r["count"]) for r in rows.groupBy("pattern").count().orderBy("pattern").collect()]
    if not counts:
        return None
    posterior, _, _ = estimate(counts)
    # As many texts of each pattern as its share of the root of counts, so that rare patterns are seen.
    total = sum(c**0.5 for _, c in counts)
    rate = {p: min(1.0, sample_rows * c**0.5 / total / c) for p, c in counts}
    wanted = F.broadcast(rows.sparkSession.createDataFrame([(p, rate[p]) for p, _ in counts], "pattern int, rate double"))
    chosen = rows.select("h", "pattern", "at", "value").join(wanted, "pattern").filter(F.pmod("h", F.lit(1_000_003)) < F.col("rate") * 1_000_003)
    # One row for each hash, by a fixed rule where several texts have it.
    found = chosen.groupBy("h").agg(F.min(F.struct("pattern", "at", "value")).alias("f")).select("h", "f.*").orderBy("h").collect()
    good, weight = np.array([posterior[r.pattern] for r in found]), np.array([1 / rate[r.pattern] for r in found])
    return train([(np.array(r.at, np.int64), np.array(r.value, np.float32)) for r in found], good, weight)


def score_column(weights: np.ndarray) -> Column:
    """The probability that a featured row's text is good."""

    @F.pandas_udf("double")
    def score(at: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([1 / (1 + np.exp(-float((weights[a] * v).sum() + weights[-1]))) for a, v in zip(at, value, strict=True)], dtype="float64")

    return score("at", "value")


def scored(docs: DataFrame, text_col: str = "text", score_col: str = "quality_score", keep: list[str] | None = None) -> DataFrame:
    """docs (those of its columns that are to be kept, or all) with the score; a column of that name is replaced."""
    columns = [c for c in keep or docs.columns if c.lower() != score_col.lower()]
    rows = featured(docs, text_col, columns)
    weights = fit(rows)
    score = F.lit(None).cast("double") if weights is None else score_column(weights)
    return rows.select("row.*", score.alias(score_col))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose texts are not rejected."""
    rows = featured(docs, text_col, docs.columns)
    weights = fit(rows)
    return docs if weights is None else rows.filter(score_column(weights) >= THRESHOLD).select("row.*")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"), score_col="score", keep=["doc_id"])
    return found.select("doc_id", "score", (F.col("score") >= THRESHOLD).alias("kept"))
