"""Edge rows of the functions, with expected values worked out by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions import prompts, replies, text
from colloquy.settings import Settings, settings


def one(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}").orderBy("k").select(column).collect()]


def test_answer_index(spark):
    rows = [
        ("B", ["a", "b", "c"], 1), ("the Sun is", ["moon", "sun", "x"], 1), ("  ", ["", "y"], 0), ("  ", ["x", "y"], 0), (None, ["x"], 0), ("", ["x"], 0),
        ("zz", ["x"], 0), (" Paris ", ["London", "in paris now", "Paris"], 2), ("lon", ["Paris", "London"], 1), ("\tParis\n", ["x", "Paris"], 1),
    ]
    got = one(spark, replies.answer_index(F.col("a"), F.col("o")), [r[:2] for r in rows], "a string, o array<string>")
    assert got == [r[2] for r in rows]


def test_grades(spark):
    rows = [
        (True, "correct", 90, "incorrect", 39), (True, "incorrect", 10, "incorrect", 10), (False, "correct", 50, "correct", 85), (False, "partially_correct", 95, "partially_correct", 95),
        (False, "great", 60, "partially_correct", 60), (None, "incorrect", 80, "incorrect", 80), (False, "correct", 150, "correct", 100), (False, None, None, "partially_correct", 0),
    ]
    verdict, score = replies.grade(F.col("w"), F.col("v"), F.col("s"))
    got = one(spark, F.struct(verdict, score), [r[:3] for r in rows], "w boolean, v string, s int")
    assert [tuple(x) for x in got] == [r[3:] for r in rows]


def test_whole_scores(spark):
    rows = [('{"score": 72}', 72), ('{"score": 72.5}', 0), ('{"score": 72.0}', 0), ('{"score": "72"}', 0), ('{"score": true}', 1), ("[1]", 0), (None, 0), ("{}", 0)]
    assert one(spark, replies.whole_score("s"), [r[:1] for r in rows], "s string") == [r[1] for r in rows]


def test_usage(spark):
    rows = [(63, 2562000000, 3384999999, 24.59, 3384), (10, 0, None, 0.0, 0), (10, None, None, 0.0, 0), (None, 1000000000, 0, 0.0, 0)]
    got = one(spark, F.struct(replies.tokens_per_second(F.col("c"), F.col("d")), replies.milliseconds(F.col("t"))), [r[:3] for r in rows], "c long, d long, t long")
    assert [tuple(x) for x in got] == [r[3:] for r in rows]


def test_sentences(spark):
    rows = [
        ('Hi. Ok! "Yes." She said pi is 3.14 today. Done?! (Really.) Tail', ['Hi. Ok! "Yes."', "She said pi is 3.14 today.", "Done?! (Really.)"], "Tail"),
        ("Quoted" + '."' + ")" * 40 + " after it", ["Quoted" + '."' + ")" * 40], "after it"), ('Oh!"") Then this goes on. x', ['Oh!"") Then this goes on.'], "x"), ('So it is.")) Then', ['So it is."))'], "Then"),
        ("no end", [], "no end"), ("", [], ""), ("Ends without blank after it.", [], "Ends without blank after it."),
    ]
    got = one(spark, F.struct(text.sentences(F.col("t")), text.tail(F.col("t"))), [r[:1] for r in rows], "t string")
    assert [tuple(x) for x in got] == [r[1:] for r in rows]


def test_sentences_cover_the_text(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", text.sentences(F.col("text")).alias("s"), text.tail(F.col("text")).alias("rest")).collect()
    assert all("".join("".join([*r.s, r.rest]).split()) == "".join(r.text.split()) for r in rows)


def test_small_text_functions(spark):
    got = one(spark, F.struct(text.strip(F.col("t")), text.collapse(F.col("t")), text.ellipsis(F.col("t"), 3), text.preview(F.col("t"), 2), text.listed(F.col("t")), text.tokens(F.col("t"))), [("  a  b,, c \n",), ("   ",)], "t string")
    assert tuple(got[0]) == ("a  b,, c", "a b,, c", "  a…", "  ", ["a  b", "c"], ["a  ", "b,, ", "c \n"])
    assert tuple(got[1]) == ("", "", "   ", "  ", [], ["   "])
    assert one(spark, text.joined(F.col("a"), F.col("b")), [("x", ""), (None, "y"), ("x", "y")], "a string, b string") == ["x", "y", "x y"]


def test_origins_and_versions(spark):
    assert one(spark, text.origins(F.col("t")), [(" * ",), ("a, b,,",), ("*,a",), ("",)], "t string") == [["*"], ["a", "b"], ["*", "a"], []]
    assert one(spark, replies.version(F.col("t")), [('{"version":"0.5"}',), ("{}",), ("no json",), (None,)], "t string") == ["0.5", "unknown", "unknown", "unknown"]
    got = one(spark, replies.health_report(F.col("r"), F.col("a"), F.col("d"), F.col("h")), [(True, True, "d", "h"), (True, False, None, None), (False, True, "down", "start it"), (False, True, "down", None)], "r boolean, a boolean, d string, h string")
    assert [tuple(x) for x in got] == [("ok", None), ("degraded", None), ("degraded", "down start it"), ("degraded", "down")]


def test_settings(spark):
    assert settings(spark) == Settings() and Settings().origins == ["*"] and Settings(cors_origins=" a, ,b ").origins == ["a", "b"]
    spark.conf.set("colloquy.max_sessions", "7")
    spark.conf.set("colloquy.unknown", "x")
    try:
        assert settings(spark) == Settings(max_sessions=7)
        spark.conf.set("colloquy.max_sessions", "many")
        with pytest.raises(ValueError):
            settings(spark)
    finally:
        spark.conf.unset("colloquy.max_sessions")
        spark.conf.unset("colloquy.unknown")


def test_openings(spark):
    rows = [("Well, this is a start, and it goes on", "Well, this is a start,"), ("Short, but", None), ("abcdefghij klmnopqrst uvwxyz rest", "abcdefghij klmnopqrst uvwxyz"), ("A whole sentence is here. More", None)]
    assert one(spark, text.opening(F.col("t")), [r[:1] for r in rows], "t string") == [r[1] for r in rows]


def strict(text):
    """A JSON value and nothing else, or an exception."""

    def refuse(constant):
        raise ValueError(constant)

    return json.loads(text, parse_constant=refuse)


def salvaged(content):
    text = (content or "").strip()
    if text.startswith("```"):
        inner = text.split("```")[1].lstrip()
        text = (inner[4:] if inner.lower().startswith("json") else inner).strip()
    for part in (text, text[max(0, text.find("{")) : text.rfind("}") + 1]):
        try:
            return strict(part)
        except ValueError:
            continue
    return None


def test_json_is_told_as_a_strict_parser_does(spark):
    rng = random.Random(1)
    pieces = ['{"score":', '{"a":', "3", "3.0", "-7", "1e3", '"3"', "true", "null", "}", "]", "[", ",", '"x"', "```json\n", "```", "JSON", " ", "\n", "\t", "Sure: ", "{", "}{", "] [", '"', "\\u00e9", "\\n", "01", ".5", "NaN", "é", "99999999999", "123456789012345678901234567890", "'a'", "//"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(7))) for _ in range(6000)]
    texts += ['{"score":%s}' % x for x in pieces] + ['```json\n{"score":5}\n```', '```\n{"score":5}```', 'pre {"score":5} post', '{"score":5} xyz', "[1]", "{'a':1}", "", "}{", "[1] }", "1,2", '1] [', '{"score":5}]', '"a"],"b"', "\x01", '"\x01"', None, " 5 ", "{}{}", '{"score":{"score":5}}', "[" * 50 + "]" * 50]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    json_text = replies.salvage_json(F.col("t"))
    rows = df.select("k", "t", replies.is_json(F.col("t")).alias("sure"), json_text.alias("json"), replies.whole_score(json_text).alias("score")).collect()
    n = 0
    for r in rows:
        try:
            strict(r.t or "")
            sure = True
        except ValueError:
            sure = False
        assert r.sure == sure, r
        value = salvaged(r.t)
        assert (None if r.json is None else strict(r.json)) == value, r
        score = value.get("score") if isinstance(value, dict) else None
        assert r.score == (max(-(2**31), min(2**31 - 1, int(score))) if isinstance(score, int) else 0), r
        n += sure
    assert n > 200


def test_prompts(spark):
    column = prompts.system_prompt(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.col("e"))
    got = one(spark, column, [("Maths", "beginner", "Ada", "French", "direct"), (None, "", None, "", "none")], "a string, b string, c string, d string, e string")
    assert got[0] == " ".join([prompts.OPENING, "Subject: Maths. The student's level is: beginner. Match your vocabulary to it. The student's name is Ada.", prompts.LENGTH_RULE, prompts.HONESTY_RULE, "Reply in French. Most important rule:", prompts.STYLES["direct"]])
    assert got[1] == " ".join([prompts.OPENING, prompts.LENGTH_RULE, prompts.HONESTY_RULE, "Reply in English. Most important rule:", prompts.STYLES["socratic"]])


def test_availability_errors_and_budget(spark):
    names = F.array(F.lit("m:1b"))
    assert one(spark, replies.is_available(names, F.col("m")), [("m",), ("m:1b",), ("m:2b",)], "m string") == [True, True, False]
    got = one(spark, replies.error_of(F.col("s"), F.lit(" body "), F.lit("m")), [(None,), (0,), (404,), (500,), (200,)], "s int")
    assert [x and x.status for x in got] == [503, 504, 404, 502, None] and got[3].detail.endswith("500: body")
    assert one(spark, replies.token_budget(F.col("m"), F.col("q")), [(None, 3), (0, 30), (50, 3)], "m int, q int") == [680, 4096, 50]
    assert one(spark, replies.needs_retry(F.col("r"), F.col("s")), [("a?  ", "socratic"), ("a.", "socratic"), ("a.", "direct"), ("a.", None)], "r string, s string") == [False, True, False, False]
