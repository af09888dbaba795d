"""Language-model scoring of whole texts.

A causal self-attention model (attention_model.py) reads a text's words, spelt in subword ids of a public
tokenizer, in overlapping windows that score each word, and the text's end, once: that is the score. What the corpus says twice or more is
remembered (passage_memory.py) and mixed into a score of its own, recalled_score, which is the model's wherever a text is new, and more where it recurs.
Beside them stands a smoothed unigram base of whole words. A word is a run of anything but ASCII
blanks, A-Z lowered; ids are those of a blank and the word.

All of it is learnt from the whole training fold. Counts of all words give those of all ids, which set the
model's units, its first biases and the shares of rare ids. Its weights are trained on every word of every
training text, once, in parallel: texts are dealt by hash to ROUNDS rounds; in a round each task takes gradient
steps through its own texts from the weights so far, and the round's weights are the mean of its tasks',
weighted by the words they saw. That mean is an aggregation by blocks of weights; only one model reaches the driver.

The vocabulary grows with the corpus, so it is never sent whole. The FREQUENT commonest words (of at most
LONG_WORD bytes) go to all tasks; a text's other words leave its task as (text, word, times) and meet
their counts in a join, longer words by several salted keys. So frequent words don't skew the join, and
rare ones need no memory.

Defined results: null texts count as empty; an empty text is its end alone; equal texts get equal
scores up to rounding; repeated rows and null ids get rows of their own, and a null id is in training;
without training texts words have the base's probability of a token never seen, and the model is near to
uniform; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import attention_model as am
from colloquy.llm import passage_memory as pm
from colloquy.llm.common import held_out, staged, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer's vocabulary splits text; a word after a blank is one piece or a few.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FREQUENT = 50_000
LONG_WORD = 64
LONG_PIECE = 256
#: Rounds of training, after each of which the tasks' weights are averaged; together they are one pass over the texts.
ROUNDS = 4
#: Keys over which the rows of a word of more than LONG_WORD bytes are spread; any other word beyond FREQUENT is rare.
SALTS = 32
#: Weights that are averaged together, and parts in which a block's rows are added up first.
BLOCK, PARTS = 4096, 64
CACHED_WORDS = 200_000
BATCH_BYTES = 2_000_000
MISSING = 0.1


_OTHER_BLANK = re.compile(r"[^\S ]")


def is_plain(words: list[bytes]) -> bool:
    """Whether words can be encoded as one text: none is long or holds white space."""
    return max(map(len, words), default=0) <= LONG_PIECE and not _OTHER_BLANK.search(b" ".join(words).decode("utf-8", "replace"))


class Words:
    """Words to numbers, and numbers to ids, of one task."""

    def __init__(self, ranks: dict[bytes, int]):
        self.encoding = tiktoken.Encoding("words", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.end = len(ranks)
        self.blank_first = np.array([t[:1] == b" " for t, _ in sorted(ranks.items(), key=lambda x: x[1])])
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.spelt: list[bytes] = []
        self.ids, self.starts = array("i"), array("q", [0])

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has.

        Common words are encoded as one text: each starts with its blank, and no other id does. Words that
        hold other white space, or are so long that a tokenizer's time isn't linear in them, go by themselves.
        """
        if is_plain(words):
            ids = np.array(self.encoding.encode_ordinary(" " + b" ".join(words).decode("utf-8", "replace") if words else ""), np.int32)
            first = np.flatnonzero(self.blank_first[ids])
            return ids, np.diff(first, append=len(ids))
        parts = []
        for w in words:
            text = " " + w.decode("utf-8", "replace")
            parts.append([i for k in range(0, len(text), LONG_PIECE) for i in self.encoding.encode_ordinary(text[k : k + LONG_PIECE])])
        return np.array([i for p in parts for i in p], np.int32), np.array([len(p) for p in parts])

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Call clear() between batches, if at all: numbers hold until then."""
        known = self.number
        at = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            found = [words[k] for k in missing.tolist()]
            new, odd = list(dict.fromkeys(found)), []
            if not is_plain(new):
                odd = [w for w in new if not is_plain([w])]
                new = list(set(new).difference(odd))
            for some in (new, odd):
                if some:
                    known.update(zip(some, range(len(known), len(known) + len(some)), strict=True))
                    self.spelt += some
                    ids, size = self.encode(some)
                    self.ids.frombytes(ids.tobytes())
                    self.starts.frombytes((self.starts[-1] + np.cumsum(size)).astype(np.int64).tobytes())
            at[missing] = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
        return at

    def id_runs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and how many each has."""
        ids, starts = np.array(self.ids), np.array(self.starts)
        size = (starts[1:] - starts[:-1])[numbers] if len(numbers) else np.empty(0, np.int64)
        at = np.repeat(starts[numbers] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return ids[at], size


def words_in(texts: Iterable[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words of texts, the place of each word among them, and words a text. Arrow splits at the six ASCII blanks."""
    lowered = pc.ascii_lower(pa.array(texts, pa.string(), from_pandas=True).fill_null(""))
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(lowered))
    found = lists.flatten().dictionary_encode()
    kinds, at, count = found.dictionary, found.indices.to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
    empty = pc.index(kinds, "").as_py()
    if empty >= 0:  # an empty text has one empty word by Arrow
        some = at != empty
        count = np.bincount(np.repeat(np.arange(len(count)), count)[some], minlength=len(count))
        at = at[some]
        at = at - (at > empty)
        kinds = pa.concat_arrays([kinds[:empty], kinds[empty + 1 :]])
    return kinds, at, count


def as_bytes(words: pa.Array) -> list[bytes]:
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def texts_in_parts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut so that their texts have some BATCH_BYTES together; one text is never cut."""
    for batch in batches:
        part = (batch["text"].str.len().fillna(0).cumsum() // BATCH_BYTES).to_numpy()
        for k in np.unique(part):
            yield batch[part == k]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def count_words(train: DataFrame) -> DataFrame:
    """Rows (word, n) over the texts of train; the ends are not among them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts_in_parts(b.to_pandas() for b in batches):
            kinds, at, _ = words_in(part["text"])
            yield pa.RecordBatch.from_arrays([kinds, pa.array(np.bincount(at, minlength=len(kinds)))], ["word", "n"])

    return train.select("text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def is_common(words: DataFrame, most: int) -> Column:
    """Whether one of rows (word, n) is among the commonest, at most `most` of them: those above a step of n, as found from counts by step."""
    short, step = F.octet_length("word") <= LONG_WORD, F.floor(F.log2(F.col("n").cast("double")) * 64).cast("int")
    of, least = 0, 1 << 30
    for r in words.filter(short).groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        of += r["count"]
        if of > most:
            break
        least = r.step
    return short & (step >= least)


def count_ids(words: DataFrame, ranks, ends: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Counts of all ids and ends, of words by number of ids (the last: SIZES or more), and the chance that such a long one goes on."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Words(ranks.value)
        most = len(ranks.value) + am.SIZES + 2
        total = np.zeros(most, np.int64)
        for batch in batches:
            n = batch["n"].to_numpy()
            ids, size = own.id_runs(own.numbers([w.encode() for w in batch["word"]]))
            np.add.at(total, ids, np.repeat(n, size))
            np.add.at(total, len(ranks.value) + np.minimum(size, am.SIZES), n)
            total[-1] += ((size - am.SIZES) * n)[size > am.SIZES].sum()
            own.clear()
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    found = words.mapInPandas(counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(ranks.value) + am.SIZES + 2)
    out[found["id"].to_numpy()] = found["n"].to_numpy()
    ids, sizes, further = out[: len(ranks.value) + 1].copy(), out[len(ranks.value) + 1 : -1], out[-1]
    ids[-1] = ends
    sizes[0] += ends
    return ids, sizes, (further + 1) / (further + sizes[-1] + 2)


def spelt(own: Words, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as (numbers of their words, words a text, ids with ends, ids a word with ends)."""
    kinds, at, count = words_in(texts)
    numbers = own.numbers(as_bytes(kinds))[at]
    ids, size = own.id_runs(numbers)
    ends = np.cumsum(count)
    places = np.append(0, np.cumsum(size))[ends]
    return numbers, count, np.insert(ids, places, own.end), np.insert(size, ends, 1)


def train_on(texts: DataFrame, ranks, unit: np.ndarray, start: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Weights after one pass over rows (text), dealt to rounds by hash."""
    context = texts.sparkSession.sparkContext
    weights, squares = start, {k: np.zeros_like(v) for k, v in start.items()}
    for turn in range(ROUNDS):
        sent = context.broadcast((weights, squares, unit))

        def trained(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            weights, squares, unit = sent.value
            w, s = ({k: v.copy() for k, v in x.items()} for x in (weights, squares))
            own, room, seen = Words(ranks.value), am.Scratch(), 0
            rng = np.random.default_rng(5)
            for part in texts_in_parts(batches):
                _, count, ids, size = spelt(own, part["text"])
                run = am.Texts(unit[ids], size, count + 1)
                windows = run.windows()
                for some in np.array_split(rng.permutation(len(windows)), max(1, round(len(windows) / am.BATCH))):
                    am.step(w, s, am.Batch(run, windows[some], unit[own.end]), room)
                seen += len(size)
                if len(own.number) > CACHED_WORDS:
                    own.clear()
            if seen:
                flat = np.stack([am.pack(w), am.pack(s)]).astype(np.float64)
                blocks = range(0, flat.shape[1], BLOCK)
                part = TaskContext.get().partitionId() % PARTS
                yield pd.DataFrame({"block": list(blocks), "part": part, "n": float(seen), "value": [(flat[:, k : k + BLOCK] * seen).tobytes() for k in blocks]})

        def added(rows: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(v) for v in rows["value"])
            return pd.DataFrame({"block": rows["block"][:1], "n": rows["n"].sum(), "value": [total.tobytes()]})

        mine = texts.filter(F.pmod(F.xxhash64("text", F.lit("round")), F.lit(ROUNDS)) == turn)
        sums = mine.mapInPandas(trained, "block int, part int, n double, value binary").groupBy("block", "part").applyInPandas(added, "block int, n double, value binary")
        rows = sums.groupBy("block").applyInPandas(added, "block int, n double, value binary").orderBy("block").collect()
        if rows:
            both = np.concatenate([np.frombuffer(r.value).reshape(2, -1) / r.n for r in rows], axis=1)
            weights, squares = am.unpack(both[0], start), am.unpack(both[1], start)
    return weights


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def with_ends(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hashes of words with that of the end after each text's."""
    return np.insert(hashes, np.cumsum(count), np.uint64(0))


def count_segments(train: DataFrame) -> DataFrame:
    """Rows (context, segment) of all segments of the texts of train."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in texts_in_parts(batches):
            kinds, at, count = words_in(part["text"])
            hashes = with_ends(word_hashes(as_bytes(kinds))[at], count)
            _, _, context, segment = pm.segments(hashes, count + 1)
            yield pd.DataFrame({"context": context.view(np.int64), "segment": segment.view(np.int64)})

    return train.select("text").mapInPandas(cut, "context long, segment long")


def score_batches(batches: Iterator[pd.Series], sent) -> Iterator[pd.DataFrame]:
    """Texts to (n_tokens, n_known, base, score, words, times, contexts, segments, logs): words are those that aren't frequent; logs are the model's, by segment."""
    ranks, weights, unit, inside, further, frequent, under, ends = sent.value
    own, room = Words(ranks), am.Scratch()
    count_of, hash_of = array("q"), array("Q")
    log10 = lambda n: np.log10((n + MISSING) / under)

    def scored(texts: pd.Series) -> pd.DataFrame:
        nonlocal count_of, hash_of
        numbers, sizes, ids, size = spelt(own, texts)
        text = np.repeat(np.arange(len(sizes)), sizes)
        hash_of.frombytes(word_hashes(own.spelt[len(count_of) :]).tobytes())
        count_of.extend([frequent.get(w, 0) for w in own.spelt[len(count_of) :]])
        # The base, as far as frequent words go; the others count as never seen until they meet their counts.
        count = np.array(count_of)[numbers] if len(numbers) else np.empty(0, np.int64)
        rare = count == 0
        base = np.bincount(text, weights=log10(count), minlength=len(sizes)) + log10(ends)
        known = np.bincount(text[~rare], minlength=len(sizes))
        pair, times = np.unique(text[rare] * len(own.number) + numbers[rare], return_counts=True)
        rare_text, rare_word = np.divmod(pair, max(1, len(own.number)))
        cut = np.searchsorted(rare_text, np.arange(len(sizes) + 1))
        rest = [[own.spelt[w].decode("utf-8", "replace") for w in rare_word[a:b]] for a, b in zip(cut, cut[1:], strict=False)]
        often = [times[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        # The model: each text's words and its end, one text after another. A word's further ids beyond SIZES go on by chance.
        log = am.score_words(weights, am.Texts(unit[ids], size, sizes + 1), unit[own.end], room)
        log += np.add.reduceat(inside[ids], np.cumsum(size) - size)
        log += np.where(size >= am.SIZES, (size - am.SIZES) * np.log(further) + np.log1p(-further), 0.0)
        score = np.add.reduceat(log, np.cumsum(sizes + 1) - sizes - 1)
        first, of, context, segment = pm.segments(with_ends(np.array(hash_of, np.uint64)[numbers] if len(numbers) else np.empty(0, np.uint64), sizes), sizes + 1)
        by_segment = np.add.reduceat(log, first)
        places = np.searchsorted(of, np.arange(len(sizes) + 1))
        by_text = lambda x: [x[a:b] for a, b in zip(places, places[1:], strict=False)]
        if len(own.number) > CACHED_WORDS:
            own.clear()
            count_of, hash_of = array("q"), array("Q")
        runs = {"contexts": by_text(context.view(np.int64)), "segments": by_text(segment.view(np.int64)), "logs": by_text(by_segment)}
        return pd.DataFrame({"n_tokens": sizes + 1, "n_known": known, "base": base, "score": score, "words": rest, "times": often, **runs})

    for batch in batches:
        parts = [scored(p["text"]) for p in texts_in_parts([pd.DataFrame({"text": batch})])]
        yield pd.concat(parts, ignore_index=True)


def score_texts(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, learnt: Column | None = None) -> DataFrame:
    """Rows of docs' id with n_tokens, n_known, train_tokens, base_score, score, recalled_score. train: rows with `text`.

    learnt: where train is a part of docs, which rows of docs it is. Their segments are then those that scoring cut, and no text is cut twice.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    ranks = load_ranks(tokenizer)
    sent_ranks = context.broadcast(ranks)

    words = staged(count_words(train), "lm-words")
    texts = train.count()
    n_words, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, kinds = n_words + texts, kinds + (1 if texts else 0)
    under = tokens + MISSING * (kinds + 1)
    common = is_common(words, FREQUENT)
    frequent = {w.encode(): n for w, n in words.filter(common).toPandas().itertuples(index=False)}

    ids, sizes, further = count_ids(words, sent_ranks, texts)
    unit, inside, log_share = am.units_of(ids)
    weights = train_on(train.select("text"), sent_ranks, unit, am.start_weights(log_share, sizes))
    sent = context.broadcast((ranks, weights, unit, inside, further, frequent, under, texts))

    @F.pandas_udf("n_tokens long, n_known long, base double, score double, words array<string>, times array<int>, contexts array<long>, segments array<long>, logs array<double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return score_batches(batches, sent)

    # Rows are numbered as they are written, so that a task that runs again later can't number them otherwise.
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.lit(False) if learnt is None else learnt).alias("learnt"), scored(F.coalesce(F.col(text_col), F.lit(""))).alias("s"))
    main = staged(rows.select("doc_id", "learnt", "s.*", F.monotonically_increasing_id().alias("n")), "lm-scores")
    long = F.octet_length("word") > LONG_WORD
    rest = main.select("n", F.explode(F.arrays_zip("words", "times")).alias("r")).select("n", F.col("r.words").alias("word"), "r.times")
    rest = rest.withColumn("salt", F.when(long, F.pmod(F.xxhash64("n"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    rarer = words.filter(~common).withColumnRenamed("n", "count")
    rarer = rarer.withColumn("salt", F.explode(F.when(long, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    gain = F.col("times") * (F.log10(F.col("count") + MISSING) - F.log10(F.lit(MISSING)))
    met = rest.join(rarer, ["word", "salt"]).groupBy("n").agg(F.sum("times").alias("more"), F.sum(gain).alias("gain"))
    again = main.filter("learnt").select(F.explode(F.arrays_zip("contexts", "segments")).alias("r")).select(F.col("r.contexts").alias("context"), F.col("r.segments").alias("segment"))
    kept, contexts = pm.learn(count_segments(train) if learnt is None else again)
    runs = main.select("n", F.explode(F.arrays_zip("contexts", "segments", "logs")).alias("r")).select("n", F.col("r.contexts").alias("context"), F.col("r.segments").alias("segment"), F.col("r.logs").alias("log"))
    memory = pm.gains(runs.filter("context <> 0"), kept, contexts).withColumnRenamed("gain", "memory")
    return main.select("n", "doc_id", "n_tokens", "n_known", "base", "score").join(met, "n", "left").join(memory, "n", "left").select(
        F.col("doc_id").alias(id_col),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0)) + (1 if texts else 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
        (F.col("score") / math.log(10)).alias("score"),
        ((F.col("score") + F.coalesce("memory", F.lit(0.0))) / math.log(10)).alias("recalled_score"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = held_out(F.col("doc_id"), 10)
    return score_texts(docs, docs.filter(~fold), learnt=~fold).select("doc_id", fold.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "recalled_score")
