"""Toxicity by a weighted grammar of finite-state transducers.

A word transducer reads a word letter by letter along the arcs of the learnt insult stems and of the closed
classes (threats, targets, negations, reported speech, announcing verbs) and writes one symbol, with a weight
for an insult. Clause transducers read symbols: MATCH takes one insult or threat of the clause, at a state of
its own, and marks it; TARGET, NEGATION, REPORT and THREAT follow what stands around it and weigh the marked
one (a target may also follow it; a threat must be announced). They are composed into one machine, whose best
path gives a clause's weight; a clause without a path isn't matched. Weights add along a path, and the best of
the paths counts (the max-plus semiring).

A text's evidence is that of its matched clauses alone: the best path, what lies along it, and how many clauses
match. Insult and threat words outside of matched clauses count for nothing. A logistic line on the evidence gives the score.

Insult stems are learned: words and prefixes whose share of toxic texts is high among the labelled training
texts, weighted by log odds. So the grammar carries over to words of languages for which nobody wrote a list.
The line and the weights of target, negation and reported speech are fitted on other texts of the same sample;
where these say nothing of a construction, it keeps the weight it starts with.

The grammar is a classifier fitted on a bounded sample of labelled rows (SAMPLE_ROWS at most in
expectation, toxic and other texts alike, chosen by a hash of the text); STEMS bounds what is kept.

Defined results: null and empty texts have no evidence and the lowest score; texts without labels
teach nothing, nor do null labels; a text labelled both ways counts both ways; equal texts get equal
scores; an empty table gives an empty result; without labels of both kinds every score is the share
of toxic labels (0 if there are none).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import held_out, small_or_shuffled, staged, table

SAMPLE_ROWS = 12_000
STEMS = 4_000
CACHED_WORDS = 500_000
LEAST_TEXTS = 4
#: About the logarithm of the number of terms that are tried.
SURE = 13.0
#: Shortest and longest prefixes that may become stems.
PREFIXES = range(4, 13)

#: Fixed word lists of the closed classes; a word that ends in * stands for all that begin so.
TARGETS = "you your yours u they them their he him her she his this these that those tu te toi vous il elle ils du dich dir ihr sie er usted ustedes él ella ellos este esta".split()
NEGATIONS = "not no never neither nor isn't aren't wasn't don't doesn't didn't cannot can't ne pas jamais nicht nie kein keine nunca jamás".split()
REPORTS = "said says say wrote writes claimed quoted called reported according dit disait écrit sagte sagt schrieb dijo dice escribió".split()
THREATS = "kill* hurt* destroy* beat* murder* stab* shoot* attack* tuer* töten matar*".split()
VERBS = "will shall gonna should going must".split()

#: What words are to clauses. TAKEN and TAKEN_THREAT mark the one that a path takes.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, VERB, QUOTE, TAKEN, TAKEN_THREAT = range(10)
SYMBOLS = range(10)
#: Words within which a target or negation before, a target after, or an announcing verb reaches.
TARGET_BEFORE, TARGET_AFTER, NEGATION_REACH, VERB_REACH = 4, 2, 3, 3
#: Weights to begin with, on the scale of the insults' log odds.
START_WEIGHTS = {"target": 1.0, "negated": -2.0, "reported": -1.5, "threat": 3.0}
#: How surely these, and the line, begin: the ridge of their fit.
RIDGE = 1.0

_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_WORD_OR_QUOTE = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[\"“”«»]")


class WordTransducer:
    """States are numbered; arcs go from a state by a letter. A state may accept the word that ends there, and any word that goes on."""

    def __init__(self, entries: list[tuple[str, int, float]]):
        self.arcs: list[dict[str, int]] = [{}]
        self.whole: dict[int, tuple[int, float]] = {}
        self.begun: dict[int, tuple[int, float]] = {}
        for spelling, symbol, weight in entries:
            state = 0
            for letter in spelling.removesuffix("*"):
                if letter not in self.arcs[state]:
                    self.arcs[state][letter] = len(self.arcs)
                    self.arcs.append({})
                state = self.arcs[state][letter]
            (self.begun if spelling.endswith("*") else self.whole).setdefault(state, (symbol, weight))

    def read(self, word: str) -> tuple[int, float]:
        """The symbol written, and its weight: of the whole word, else of the longest accepted beginning."""
        state, found = 0, (OTHER, 0.0)
        for letter in word:
            state = self.arcs[state].get(letter, -1)
            if state < 0:
                return found
            found = self.begun.get(state, found)
        return self.whole.get(state, found)


#: A clause transducer: by (state, symbol read) the arcs (symbol written, tag or None, next state); state 0 begins.
Arcs = dict[tuple, list[tuple[int, str | None, object]]]


@dataclass
class Machine:
    arcs: Arcs
    ends: set


def machine(states, step, ends) -> Machine:
    """From step(state, symbol), which lists arcs."""
    return Machine({(s, x): found for s in states for x in SYMBOLS if (found := step(s, x))}, set(ends))


def match() -> Machine:
    """Takes one insult or threat, marked; others pass as other words do."""

    def step(state, x):
        passes = [(x, None, state)]
        return passes + [({INSULT: TAKEN, THREAT: TAKEN_THREAT}[x], None, 1)] if state == 0 and x in (INSULT, THREAT) else passes

    return machine((0, 1), step, [1])


def target() -> Machine:
    """States: words for which a target reaches on; ("due", n): a target must follow within n words; "done"."""

    def step(state, x):
        if state == "done":
            return [(x, None, "done")]
        if isinstance(state, tuple):
            return [(x, "target", "done")] if x == TARGET else [(x, None, ("due", state[1] - 1))] if state[1] > 1 else []
        if x in (TAKEN, TAKEN_THREAT):
            return [(x, "target", "done")] if state else [(x, None, "done"), (x, None, ("due", TARGET_AFTER))]
        return [(x, None, TARGET_BEFORE if x == TARGET else max(0, state - 1))]

    return machine([*range(TARGET_BEFORE + 1), *(("due", n) for n in range(1, TARGET_AFTER + 1)), "done"], step, ["done"])


def within(opens: int, reach: int, tag: str, needed: int | None = None) -> Machine:
    """What is taken within `reach` words after a word of symbol `opens` gets the tag; `needed` is taken nowhere else, and only it then gets the tag."""

    def step(state, x):
        if state == "done":
            return [(x, None, "done")]
        if needed is None and x in (TAKEN, TAKEN_THREAT):
            return [(x, tag if state else None, "done")]
        if x in (TAKEN, TAKEN_THREAT):
            return [(x, None, "done")] if x != needed else [(x, tag, "done")] if state else []
        return [(x, None, reach if x == opens else max(0, state - 1))]

    return machine([*range(reach + 1), "done"], step, ["done"])


def report() -> Machine:
    """Reported speech goes on to the clause's end, quoted speech to the next quote."""

    def step(state, x):
        if state == "done":
            return [(x, None, "done")]
        if x in (TAKEN, TAKEN_THREAT):
            return [(x, "reported" if state else None, "done")]
        return [(x, None, "said" if x == REPORT or state == "said" else {0: "quoted", "quoted": 0}[state] if x == QUOTE else state)]

    return machine((0, "quoted", "said", "done"), step, ["done"])


def compose(first: Machine, second: Machine) -> Machine:
    """What `first` writes is read by `second`; a path's tags are those of both. States that can't be reached aren't built."""
    arcs: Arcs = {}
    ends, waiting, seen = set(), [(0, 0)], {(0, 0)}
    number = {(0, 0): 0}
    while waiting:
        pair = waiting.pop()
        if pair[0] in first.ends and pair[1] in second.ends:
            ends.add(number[pair])
        for x in SYMBOLS:
            for written, tag, to in first.arcs.get((pair[0], x), []):
                for again, more, on in second.arcs.get((pair[1], written), []):
                    goal = (to, on)
                    if goal not in seen:
                        seen.add(goal)
                        number[goal] = len(number)
                        waiting.append(goal)
                    tags = " ".join(t for t in (tag, more) if t) or None
                    arcs.setdefault((number[pair], x), []).append((again, tags, number[goal]))
    return Machine(arcs, ends)


def clause_machine() -> Machine:
    out = match()
    for part in (target(), within(NEGATION, NEGATION_REACH, "negated"), report(), within(VERB, VERB_REACH, "threat", TAKEN_THREAT)):
        out = compose(out, part)
    return out


@dataclass
class Grammar:
    """words and stems (prefixes): insults to weights; weights: by tag; line: intercept, and slopes of the best path and of the log of matched clauses."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    line: tuple[float, float, float] = (0.0, 0.0, 0.0)
    weights: dict[str, float] = field(default_factory=lambda: dict(START_WEIGHTS))

    def __post_init__(self) -> None:
        closed = [(w, s, 0.0) for s, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS), (VERB, VERBS)) for w in ws]
        insults = [(w, INSULT, v) for w, v in self.words.items()] + [(f"{w}*", INSULT, v) for w, v in self.stems.items()]
        self.transducer = WordTransducer(insults + closed)
        self.read: dict[str, tuple[int, float]] = {'"': (QUOTE, 0.0), "“": (QUOTE, 0.0), "”": (QUOTE, 0.0), "«": (QUOTE, 0.0), "»": (QUOTE, 0.0)}
        self.clauses = clause_machine()

    def symbol(self, word: str) -> tuple[int, float]:
        if (found := self.read.get(word)) is None:
            if len(self.read) >= CACHED_WORDS:
                self.read = {w: s for w, s in self.read.items() if s[0] == QUOTE}
            found = self.read[word] = self.transducer.read(word)
        return found

    def best_path(self, symbols: list[tuple[int, float]]) -> tuple[float, tuple] | None:
        """The weight of the best path through a clause, and the tags along it; None without a path."""
        at: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for x, weight in symbols:
            after: dict[int, tuple[float, tuple]] = {}
            for state, (value, tags) in at.items():
                for written, tag, to in self.clauses.arcs.get((state, x), ()):
                    new, along = value, tags
                    if written == TAKEN:
                        new, along = new + weight, (*along, ("insult", weight))
                    if tag:
                        new += sum(self.weights[t] for t in tag.split())
                        along = (*along, *((t, 1.0) for t in tag.split()))
                    if to not in after or new > after[to][0]:
                        after[to] = (new, along)
            at = after
        ends = [v for state, v in at.items() if state in self.clauses.ends]
        return max(ends, key=lambda v: v[0]) if ends else None

    def evidence(self, text: str | None) -> tuple[float, float, tuple]:
        """(best path's weight, log of one and the matched clauses, tags along the best path) of a text."""
        low = (text or "").lower()
        if all(self.symbol(w)[0] not in (INSULT, THREAT) for w in set(_WORD.findall(low))):
            return 0.0, 0.0, ()
        best, matched = (0.0, ()), 0
        for clause in _CLAUSE.split(low):
            symbols = [self.symbol(w) for w in _WORD_OR_QUOTE.findall(clause)]
            if any(x in (INSULT, THREAT) for x, _ in symbols) and (found := self.best_path(symbols)):
                matched += 1
                best = max(best, found, key=lambda v: v[0]) if matched > 1 else found
        return best[0], math.log1p(matched), best[1]

    def score(self, text: str | None) -> float:
        best, matched, _ = self.evidence(text)
        z = self.line[0] + self.line[1] * best + self.line[2] * matched
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def text_terms(text: str) -> set[str]:
    """A text's words, and their prefixes as 'prefix*'."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) > k}


def batch_terms(batches):
    """Counts of texts by term and label in each batch of rows (text, toxic)."""
    for batch in batches:
        times = {0: Counter(), 1: Counter()}
        for t, y in zip(batch["text"], batch["toxic"], strict=True):
            times[int(y)].update(text_terms(t))
        for y, c in ((y, c) for y, c in times.items() if c):
            yield pd.DataFrame({"term": list(c), "toxic": y, "n": list(c.values())})


def choose_stems(counts: DataFrame, texts: tuple[int, int], most_stems: int = STEMS) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with log odds weights. counts: term, bad, fine (counts of texts); texts: all of (fine, bad).

    A term is accepted if so many toxic texts among its texts are no luck even for the luckiest of all
    terms: twice SURE is its likelihood ratio against the share of toxic texts. A prefix must also be
    borne out by several words: its toxic texts exceed those of any one of its words by a third.
    """
    share = texts[1] / sum(texts)
    bad, fine = F.col("bad"), F.col("fine")
    part = lambda x, p: F.when(x > 0, x * F.ln(x / ((bad + fine) * p))).otherwise(0.0)
    odds = F.ln((bad + 0.5) / (texts[1] + 1)) - F.ln((fine + 0.5) / (texts[0] + 1))
    sure = counts.filter((bad >= LEAST_TEXTS) & (bad > 3 * fine) & (part(bad, share) + part(fine, 1 - share) > SURE)).withColumn("weight", F.least(odds, F.lit(9.0)))
    words = counts.filter(~F.endswith("term", F.lit("*")) & (bad > 0) & (F.length("term") > PREFIXES[0]))
    prefixes = F.transform(F.sequence(F.lit(PREFIXES[0]), F.least(F.lit(PREFIXES[-1]), F.length("term") - 1)), lambda k: F.concat(F.substring("term", F.lit(1), k), F.lit("*")))
    most = words.select(F.explode(prefixes).alias("term"), "bad").groupBy("term").agg(F.max("bad").alias("most"))
    borne = sure.join(most, "term", "left").filter(~F.endswith("term", F.lit("*")) | (3 * bad > 4 * F.coalesce("most", F.lit(0))))
    found = borne.select("term", "weight").orderBy(F.desc("weight"), "term").limit(most_stems).collect()
    return {r.term: r.weight for r in found if r.term[-1] != "*"}, {r.term[:-1]: r.weight for r in found if r.term[-1] == "*"}


def fit_line(x: np.ndarray, y: np.ndarray, times: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, its ridge around `start` (next to none for the intercept, which is first)."""
    a = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([0.05, *[RIDGE] * x.shape[1]])
    w = start.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (times * p * (1 - p))[:, None]).T @ a + ridge
        step = np.linalg.solve(hessian, a.T @ (times * (y - p)) - ridge @ (w - start))
        w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return w


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame | None, tuple[int, int], list[float]]:
    """Texts of a bounded sample of labelled rows (text, toxic, h), all rows' counts by label, and the rates.

    Only ids and hashes are joined with the labels; texts are then looked up for the chosen ids.
    """
    h = F.pmod(F.xxhash64("text"), F.lit(1_000_003)).alias("h")
    texts = docs.filter("text is not null").select("doc_id", h, "text")
    sure = labels.filter("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    known = staged(texts.select("doc_id", "h").join(sure, "doc_id"), "toxicity-labels")
    found = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    n = (found.get(0, 0), found.get(1, 0))
    if not all(n):
        return None, n, []
    rate = [min(1.0, sample_rows / 2 / c) for c in n]
    ids = known.filter(F.col("h") < F.when(F.col("toxic") == 0, rate[0]).otherwise(rate[1]) * 1_000_003).distinct()
    ids = small_or_shuffled(staged(ids, "toxicity-ids"))
    return staged(texts.join(ids, ["doc_id", "h"]).select("text", "toxic", "h"), "toxicity-texts"), n, rate


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Grammar:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1; nulls teach nothing)."""
    chosen, n, rate = sample(docs, labels, sample_rows)
    if chosen is None:
        share = n[1] / max(1, sum(n))
        return Grammar(line=(math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0, 0.0))
    # Stems come from four texts in five, the line from the others, so that a stem's luck doesn't count.
    for_stems = chosen.filter("h % 5 <> 0").select("text", "toxic")
    for_line = chosen.filter("h % 5 = 0").select("text", "toxic")
    counts = for_stems.mapInPandas(batch_terms, "term string, toxic int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("fine")
    )
    known = tuple(max(1, int(c * r * 0.8)) for c, r in zip(n, rate, strict=True))
    words, stems = choose_stems(staged(counts, "toxicity-terms"), known)
    grammar = Grammar(words, stems, (-4.0, 1.0, 1.0))
    # The best paths depend on the weights: they are found with those so far, and fitted, twice.
    for _ in range(2):
        found = with_evidence(for_line, grammar).groupBy("toxic", "e").count().toPandas()
        if found["toxic"].nunique() < 2:
            break
        start = np.array([-4.0, 1.0, *START_WEIGHTS.values(), 1.0])
        w = fit_line(np.array(found["e"].tolist()), found["toxic"].to_numpy(float), found["count"].to_numpy(float), start)
        slope = max(float(w[1]), 0.05)
        weights = {t: float(v) / slope for t, v in zip(START_WEIGHTS, w[2:], strict=False)}
        grammar = Grammar(words, stems, (float(w[0]), slope, float(w[-1])), weights)
    return grammar


def with_evidence(rows: DataFrame, grammar: Grammar) -> DataFrame:
    """Rows (toxic, e): the best path's insult and tags, and the log of matched clauses."""

    def numbers(text: str | None) -> np.ndarray:
        _, matched, tags = grammar.evidence(text)
        of = dict(tags)
        return np.round([of.get("insult", 0.0), *(of.get(t, 0.0) for t in START_WEIGHTS), matched], 3)

    @F.pandas_udf("array<double>")
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series([numbers(t) for t in texts])

    return rows.select("toxic", evidence("text").alias("e"))


def score(docs: DataFrame, grammar: Grammar, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score, 0 to 1 (a column of that name is replaced)."""

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        return pd.Series([grammar.score(t) for t in texts], dtype="float64")

    return docs.withColumn(score_col, toxic(F.col(text_col)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = fit(docs.filter(~held_out(F.col("doc_id"), 5)), table(spark, sf_dir, "labels"))
    found = score(docs.withColumn("held_out", held_out(F.col("doc_id"), 5)), grammar)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
