"""Language identification by word-first backoff.

A word that the training texts have often enough is scored by the logarithm of its frequency in each
language. Other words fall back to character n-grams: of the longest length at which any n-gram of
the (marked) word is known, all n-grams are scored, else of the next shorter one. A text's language
is the one with the largest total, and its score the posterior under equal priors, tempered by the
number of words so that it stays a probability.

The model is a classifier fitted on a bounded sample of labelled rows: SAMPLE_ROWS texts a language
at most in expectation, chosen by a hash of the text; WORDS and GRAMS bound what it keeps of each
language. A term is kept with the languages that have it, beside what its lack costs in any other,
so that the model grows with the number of languages and not with its square; it is sent to the executors whole.

Words are runs of letters (of Unicode's category L), so that digits, number signs and symbols are none.

Defined results: `und` with score 0 for null texts and those without a letter (or where nothing was
learned); ties go to the language first in order; rows of null language teach nothing, null ids
count as training; equal texts get equal answers; an empty table gives an empty result; other columns
are carried, and existing ones named lang_pred or score replaced.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import fresh, held_out, table

SAMPLE_ROWS = 4_000
WORDS = 20_000
GRAMS = 8_000
LONGEST = 5
LEAST_COUNT = 3
CACHED_WORDS = 200_000
#: Characters of texts that are scored together; one text is never cut.
PART_CHARS = 1_000_000

_WORD = re.compile(r"[^\W\d_]+")


def words_in(text: str | None) -> list[str]:
    found = _WORD.findall((text or "").lower())
    if "".join(found).isalpha() or not found:
        return found
    # Number signs that are no decimal digits count as word characters, but not as letters.
    return [p for w in found for p in "".join(c if c.isalpha() else " " for c in w).split()]


def grams_of(word: str, size: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + size] for i in range(len(marked) - size + 1)] if len(marked) >= size else []


@dataclass
class Terms:
    """One table: terms, each with a run of (language, gain over lacking it), and by language the log frequency of a term it lacks."""

    places: dict[str, int]
    starts: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    lacking: np.ndarray

    @staticmethod
    def of(rows: pd.DataFrame, langs: list[str]) -> Terms:
        """rows: term, lang, n, a row for each that a language keeps. Natural log frequencies, one count added."""
        rows = rows.sort_values(["term", "lang"])
        terms, first = np.unique(rows["term"].to_numpy(str), return_index=True)
        lang = np.searchsorted(np.array(langs), rows["lang"].to_numpy(str)) if len(rows) else np.empty(0, int)
        size = np.bincount(lang, weights=rows["n"], minlength=len(langs)) + len(terms)
        return Terms({t: k for k, t in enumerate(terms.tolist())}, np.append(first, len(rows)), lang.astype(np.int32), np.log(rows["n"].to_numpy(float) + 1), -np.log(np.maximum(size, 1)))


class Model:
    """Tables for words (0) and n-grams of every length."""

    def __init__(self, langs: list[str], tables: dict[int, Terms]):
        self.langs, self.tables = langs, tables
        # All tables' runs one after another, and the number of each table's first term.
        of = [tables[k] for k in range(LONGEST + 1)]
        self.first = np.cumsum([0, *(len(t.places) for t in of)]).tolist()
        ends = np.cumsum([0, *(len(t.lang) for t in of)])
        self.run = np.concatenate([*(t.starts[:-1] + e for t, e in zip(of, ends, strict=False)), ends[-1:]])
        self.run_lang, self.run_gain = np.concatenate([t.lang for t in of]), np.concatenate([t.gain for t in of])
        self.clear()

    def clear(self) -> None:
        """Forgets the words met so far: their numbers, tables, and runs of (language, gain), one after another."""
        self.known: dict[str, int] = {}
        self.size, self.starts, self.lang, self.gain = array("b"), array("q", [0]), array("i"), array("d")

    def hits(self, word: str) -> tuple[int, list[int]]:
        """The table that scores the word (-1: none), and the terms of it: the word, or its known n-grams."""
        if (found := self.tables[0].places.get(word)) is not None:
            return 0, [found]
        marked = f"<{word}>"
        for size in range(LONGEST, 0, -1):
            places, first = self.tables[size].places, self.first[size]
            if found := [first + places[g] for i in range(len(marked) - size + 1) if (g := marked[i : i + size]) in places]:
                return size, found
        return -1, []

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers. New ones are looked up together; a word by n-grams gets the mean of their gains."""
        new = list(set(words).difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            found = [self.hits(w) for w in new]
            n = np.array([len(h) for _, h in found])
            term = np.array([k for _, h in found for k in h], np.int64)
            length = self.run[term + 1] - self.run[term]
            runs = np.repeat(self.run[term] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            of = np.repeat(np.arange(len(new)), n)
            self.size.extend([size for size, _ in found])
            self.lang.frombytes(self.run_lang[runs].tobytes())
            self.gain.frombytes((self.run_gain[runs] / np.repeat(n[of], length)).tobytes())
            self.starts.frombytes((self.starts[-1] + np.cumsum(np.bincount(of, length, len(new)))).astype(np.int64).tobytes())
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Languages and scores of a batch, in parts."""
        out, part, chars = [], [], 0
        for t in texts:
            part.append(t)
            chars += len(t or "")
            if chars >= PART_CHARS:
                out += self._predict(part)
                part, chars = [], 0
        return out + self._predict(part)

    def _predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """One sum over the words' gains, and one product for what languages lack."""
        words = [words_in(t) for t in texts]
        n = np.array([len(w) for w in words], np.int64)
        if not n.any() or not self.langs:
            return [("und", 0.0)] * len(texts)
        if len(self.known) > CACHED_WORDS:
            self.clear()
        number = self.numbers([w for ws in words for w in ws])
        pair, times = np.unique(np.repeat(np.arange(len(n)), n) * len(self.size) + number, return_counts=True)
        text, word = np.divmod(pair, len(self.size))
        starts = np.array(self.starts)
        length = starts[word + 1] - starts[word]
        runs = np.repeat(starts[word] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        cells = np.repeat(text, length) * len(self.langs) + np.array(self.lang)[runs]
        total = np.bincount(cells, np.repeat(times, length) * np.array(self.gain)[runs], len(n) * len(self.langs)).reshape(len(n), -1)
        by_table = np.bincount(text * (LONGEST + 2) + np.array(self.size)[word] + 1, times, len(n) * (LONGEST + 2)).reshape(len(n), -1)
        total += by_table[:, 1:] @ np.stack([self.tables[k].lacking for k in range(LONGEST + 1)])
        odds = np.exp((total - total.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(n, 1))[:, None])
        best = total.argmax(axis=1)
        score = odds[np.arange(len(n)), best] / odds.sum(axis=1)
        return [(self.langs[b], s) if k else ("und", 0.0) for b, s, k in zip(best.tolist(), score.tolist(), n.tolist(), strict=True)]


def term_counts(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts of words (size 0) and n-grams in a batch of labelled texts."""
    out = []
    for lang, texts in rows.groupby("lang")["text"]:
        times = Counter()
        for t in texts:
            times.update(words_in(t))
        out += [(lang, 0, w, n) for w, n in times.items()]
        for size in range(1, LONGEST + 1):
            grams = Counter()
            for w, n in times.items():
                for g in grams_of(w, size):
                    grams[g] += n
            out += [(lang, size, g, n) for g, n in grams.items()]
    return pd.DataFrame(out, columns=["lang", "size", "term", "n"])


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """rows: text, lang (nulls teach nothing)."""
    from pyspark.sql import Window as W

    usable = rows.filter("lang is not null and text is not null").select("text", "lang", F.pmod(F.xxhash64("text"), F.lit(1_000_003)).alias("h"))
    share = usable.groupBy("lang").agg((F.lit(sample_rows * 1_000_003) / F.count("*")).alias("upto"))
    chosen = usable.join(F.broadcast(share), "lang").filter("h < upto").select("text", "lang")

    def counted(batches):
        for batch in batches:
            found = term_counts(batch)
            if len(found):
                yield found

    terms = chosen.mapInPandas(counted, "lang string, size int, term string, n long").groupBy("lang", "size", "term").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang", "size").orderBy(F.desc("n"), "term")
    most = F.when(F.col("size") == 0, WORDS).otherwise(GRAMS)
    top = terms.filter(f"n >= {LEAST_COUNT}").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    found = top.drop("place").toPandas()
    langs = sorted(found["lang"].unique())
    return Model(langs, {size: Terms.of(found[found["size"] == size], langs) for size in range(LONGEST + 1)})


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (columns of those names are replaced)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.tables))
    local: dict[str, Model] = {}

    @F.pandas_udf("lang_pred string, score double")
    def identify(texts: pd.Series) -> pd.DataFrame:
        own = local.setdefault("model", Model(*sent.value))
        return pd.DataFrame(own.predict(texts.tolist()), columns=["lang_pred", "score"])

    (found,) = fresh(docs, "found")
    rows = docs.withColumn(found, identify(F.col(text_col)))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return rows.select(*kept, F.col(f"`{found}`.lang_pred").alias("lang_pred"), F.col(f"`{found}`.score").alias("score"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 5))
    model = fit(docs.filter("not held_out").select("text", "lang"))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
