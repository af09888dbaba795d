import itertools

import pytest
from pyspark.sql import functions as F

from colloquy.llm import toxicity as tx


def grammar():
    return tx.Grammar(words={"idiot": 4.0}, stems={"vequ": 3.0, "vequx": 5.0}, line=(-4.0, 1.0, 0.5), weights={"target": 1.0, "negated": -2.0, "reported": -1.5, "threat": 3.0})


def brute_clause(weights, symbols):
    """The best of all ways to take one word of a clause, each looked at by itself."""
    ways = []
    for i, (x, weight) in enumerate(symbols):
        before = [y for y, _ in symbols[:i]]
        if x not in (tx.INSULT, tx.THREAT):
            continue
        announced = tx.VERB in before[-tx.VERB_REACH :]
        if x == tx.THREAT and not announced:
            continue
        value = weight if x == tx.INSULT else weights["threat"]
        if tx.NEGATION in before[-tx.NEGATION_REACH :]:
            value += weights["negated"]
        if tx.REPORT in before or before.count(tx.QUOTE) % 2:
            value += weights["reported"]
        after = [y for y, _ in symbols[i + 1 : i + 1 + tx.TARGET_AFTER]]
        if tx.TARGET in before[-tx.TARGET_BEFORE :]:
            value += weights["target"]
        elif tx.TARGET in after:
            value = max(value, value + weights["target"])
        ways.append(value)
    return max(ways) if ways else None


@pytest.mark.parametrize("weights", [dict(target=1.0, negated=-2.0, reported=-1.5, threat=3.0), dict(target=-1.0, negated=0.5, reported=2.0, threat=-4.0)])
def test_composed_machine_is_the_best_of_all_paths(weights):
    g = grammar()
    g.weights = weights
    alphabet = [(tx.OTHER, 0.0), (tx.INSULT, 4.0), (tx.INSULT, 2.5), (tx.THREAT, 0.0), (tx.TARGET, 0.0), (tx.NEGATION, 0.0), (tx.REPORT, 0.0), (tx.VERB, 0.0), (tx.QUOTE, 0.0)]
    for n in range(5):
        for symbols in itertools.product(alphabet, repeat=n):
            got, want = g.best_path(list(symbols)), brute_clause(weights, symbols)
            assert (got is None) == (want is None) and (got is None or got[0] == pytest.approx(want)), symbols


def test_longer_clauses():
    g = grammar()
    for text in ("you a b c d idiot", "you a b c idiot", "not a b c idiot", "not a b idiot", "will a b c kill", "will a b kill idiot a you", 'said a b c d e f idiot', '" a b c " idiot', '" a b c idiot "', "idiot a b you", "idiot a you"):
        symbols = [g.symbol(w) for w in text.split()]
        got, want = g.best_path(symbols), brute_clause(g.weights, symbols)
        assert (got and got[0]) == (want if want is None else pytest.approx(want)), text


def test_word_transducer():
    g = grammar()
    assert g.symbol("idiot") == (tx.INSULT, 4.0) and g.symbol("idiots") == (tx.OTHER, 0.0) and g.symbol("idio") == (tx.OTHER, 0.0)
    assert g.symbol("vequ") == g.symbol("vequille") == (tx.INSULT, 3.0) and g.symbol("vequxes") == (tx.INSULT, 5.0) and g.symbol("veq") == (tx.OTHER, 0.0)
    assert [g.symbol(w)[0] for w in ("you", "not", "said", "will", "killing", "")] == [tx.TARGET, tx.NEGATION, tx.REPORT, tx.VERB, tx.THREAT, tx.OTHER]


def test_words_outside_matched_clauses_count_for_nothing():
    g = grammar()
    none = g.score("nothing")
    assert g.score("kill the lights. destroy them. attack it") == none
    assert g.score("you. not. said. will") == none
    assert g.score("i will kill you") > none and g.score("idiot") > none
    # Many targets about an insult are one match; the same insult in two clauses is two.
    assert g.evidence("idiot idiot idiot")[1] == g.evidence("idiot")[1] < g.evidence("idiot. idiot")[1]


def test_order_of_clauses():
    g = grammar()
    plain, negated, reported, quoted, aimed, after = (g.score(t) for t in ("an idiot", "not an idiot", "somebody wrote of an idiot", 'the word "idiot" again', "you idiot", "idiot that you are"))
    assert negated < plain < aimed and reported < plain and quoted < plain and after == aimed
    assert g.score("nothing") == g.score(None) == g.score("") < negated
    announced, past = g.score("we will hurt nobody"), g.score("we hurt nobody")
    assert past == g.score("") < announced < g.score("we will hurt you")


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    found = tx.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    hit, wrong = (found.filter(F.col("toxic") == v).agg(F.avg("predicted")).first()[0] for v in (1, 0))
    assert hit > 0.8 and wrong < 0.01


def test_odd_rows(spark):
    rows = [(k, f"fine text number {k}", 0) for k in range(60)] + [(100 + k, f"you moron number {k}", 1) for k in range(40)]
    rows += [(200, None, 1), (201, "", 0), (None, "you moron", 1), (202, "word " * 100_000 + "moron", None), (203, "you moron number 1", 0), (203, "you moron number 1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").selectExpr("*", "'a' as score", "2 as h", "'q' as term")
    labels = docs.selectExpr("doc_id", "toxic", "1 as quality")
    docs = docs.drop("toxic")
    g = tx.fit(docs, labels)
    assert "moron" in g.words
    found = tx.score(docs, g)
    assert sorted(found.columns) == sorted(docs.columns)
    by_id = {r.doc_id: r.score for r in found.collect()}
    assert by_id[200] == by_id[201] < 0.5 < by_id[105] and by_id[202] > by_id[201] and by_id[None] > 0.5
    assert tx.score(docs.limit(0), g).collect() == []
    one_kind = tx.fit(docs, labels.filter("toxic = 0 and doc_id < 200"))
    assert {round(r.score, 6) for r in tx.score(docs, one_kind).collect()} == {0.0}
