import json

import pytest
from pyspark.sql import functions as F

from colloquy.functions import validation
from colloquy.operators import completion, sessions, store

CHAT = [
    ({"message": "hi"}, []),
    ({}, ["message missing"]),
    ({"message": ""}, ["message too_short"]),
    ({"message": None, "model": None, "temperature": None}, ["message type"]),
    ({"message": ["hi"], "temperature": -0.1, "max_tokens": 4097}, ["message type", "temperature too_small", "max_tokens too_large"]),
    ({"message": "hi", "temperature": "0.5", "max_tokens": "12"}, []),
    ({"message": "hi", "temperature": "hot", "max_tokens": "1.5"}, ["temperature type", "max_tokens type"]),
    ({"message": "hi", "temperature": {}, "max_tokens": 0}, ["temperature type", "max_tokens too_small"]),
    ({"message": "hi", "max_tokens": True, "temperature": 2}, []),
    ({"message": "hi", "max_tokens": 10**30}, ["max_tokens too_large"]),
    ({"message": "hi", "profile": {}}, []),
    ({"message": "hi", "profile": "p"}, ["profile type"]),
    ({"message": "hi", "profile": {"style": None, "language": 1, "level": 2, "subject": None}}, ["profile.level type", "profile.style type", "profile.language type"]),
    ({"session_id": 4, "profile": {"style": "loud"}}, ["message missing", "session_id type", "profile.style not_a_choice"]),
    ([], ["body type"]),
    (None, ["body type"]),
]


def said(row):
    return [f"{v.place} {v.kind}" for v in row.violations]


def test_all_violations_of_a_chat(spark):
    rows = [(k, json.dumps(body)) for k, (body, _) in enumerate(CHAT)] + [(len(CHAT), "{oops"), (len(CHAT) + 1, None)]
    found = validation.validated(spark.createDataFrame(rows, "k int, body string"), "chat").orderBy("k").collect()
    assert [said(r) for r in found] == [want for _, want in CHAT] + [["body json"]] * 2
    assert found[0].request.asDict(True) == {"message": "hi", "session_id": None, "profile": None, "model": None, "temperature": None, "max_tokens": None}
    assert (found[5].request.temperature, found[5].request.max_tokens, found[8].request.max_tokens) == (0.5, 12, 1)
    assert found[10].request.profile.asDict() == {"subject": None, "level": None, "style": "socratic", "language": "English", "student_name": None}


@pytest.mark.parametrize("task, body, want, given", [
    ("quiz", {"topic": "t"}, [], {"num_questions": 3, "num_options": 4, "difficulty": "medium", "level": "beginner"}),
    ("quiz", {"topic": "t", "num_questions": 0, "num_options": 7, "difficulty": "x"}, ["num_questions too_small", "num_options too_large", "difficulty not_a_choice"], {}),
    ("quiz", {"topic": "t", "num_questions": 3.0, "num_options": None}, ["num_options type"], {"num_questions": 3}),
    ("explain", {"topic": "t", "level": "Grade 8"}, [], {"level": "Grade 8", "language": "English"}),
    ("evaluate", {"question": "q", "expected_answer": None}, ["student_answer missing"], {"level": "beginner"}),
    ("session", {"profile": {"student_name": "Ada"}}, [], {}),
])
def test_other_tasks_and_their_defaults(spark, task, body, want, given):
    row = validation.validated(spark.createDataFrame([(json.dumps(body),)], "body string"), task).first()
    assert said(row) == want and {k: row.request[k] for k in given} == given


def test_accepted_and_rejected_rows_keep_their_columns(spark):
    rows = spark.createDataFrame([('{"message":"hi"}', "v", 1), ("{}", "w", 2)], "body string, violations string, request int")
    accepted, rejected = validation.split(rows, "chat")
    assert [(r.violations, r.request, r.request_.message) for r in accepted.collect()] == [("v", 1, "hi")]
    assert [(r.violations, r.request, r.violations_[0].place) for r in rejected.collect()] == [("w", 2, "message")]
    assert validation.split(rows.limit(0), "chat")[0].count() == 0


def test_helper_columns_clash_with_none(spark):
    """Columns that are named as helpers once were are kept, or don't get in the way."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    stored = spark.createDataFrame([("a", "p")], "session_id string, profile string").select("*", *(at.alias(c) for c in ("created_at", "updated_at", "last_access")), F.lit(1).alias("newest"), F.lit(2).alias("message_count"), F.lit(3).alias("spoken"), F.lit(4).alias("preview"))
    messages = spark.createDataFrame([("a", 0, "user", "x", 9)], "session_id string, turn long, role string, content string, newest int").withColumn("created_at", at + F.expr("interval 1 hour"))
    assert store.append(stored, messages).columns == stored.columns and store.append(stored, messages).first().newest == 1
    assert store.listed(stored, messages, at).first().message_count == 1
    assert store.last_activity(stored, messages).count() == 1
    asked = spark.createDataFrame([("1", "q", "direct", 5, 6, 7)], "request_id string, question string, style string, r int, second int, payload int").withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"))))
    assert completion.chat(asked, lambda df, name: df.cache()).first().reply == "About that: q"
    replies = spark.createDataFrame([("1", '{"summary":"s"}', "mine", 2)], "request_id string, reply string, json string, out int")
    assert completion.explanations(replies).select("summary", "model", "usage.total_duration_ms").first() == ("s", "", 0)


def test_settings_are_what_operators_take_by_default(spark):
    at = lambda m: F.lit("2024-01-01 12:00:00").cast("timestamp") - F.make_interval(mins=F.lit(m))
    rows = spark.createDataFrame([("a", 5), ("b", 15), ("c", 400)], "session_id string, m int")
    stored = rows.select("session_id", F.lit("p").alias("profile"), *((F.lit("2024-01-01 12:00:00").cast("timestamp") - F.make_interval(mins=F.col("m"))).alias(c) for c in ("created_at", "updated_at", "last_access")))
    said = spark.createDataFrame([("a", k, "user", "x") for k in range(30)], "session_id string, turn long, role string, content string")
    ids = lambda df: sorted(r.session_id for r in df.collect())
    asked = spark.createDataFrame([("1", "q", "direct", "own"), ("2", "q", "direct", "")], "request_id string, question string, style string, model string").withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"))))
    nameless = lambda: lambda bodies: [{"message": {"content": json.loads(b)["model"] + str(json.loads(b)["options"]["num_ctx"])}} for b in bodies]
    replies = lambda: {r.request_id: (r.reply, r.model) for r in completion.chat(asked, lambda df, name: df.cache(), nameless).collect()}
    assert ids(store.prune(stored, at(0))) == ["a", "b"] and sessions.history(said).count() == 20 and ids(store.trim(stored)) == ["a", "b", "c"]
    assert replies() == {"1": ("own4096", "own"), "2": ("small:1b4096", "small:1b")}
    given = {"session_ttl_minutes": "10", "max_history_messages": "3", "max_sessions": "2", "default_model": "big", "num_ctx": "99"}
    for name, value in given.items():
        spark.conf.set(f"colloquy.{name}", value)
    try:
        assert ids(store.prune(stored, at(0))) == ["a"] and sessions.history(said).count() == 3 and ids(store.trim(stored)) == ["a", "b"] and ids(sessions.within_capacity(stored, "session_id")) == ["a", "b"]
        assert replies() == {"1": ("own99", "own"), "2": ("big99", "big")}
    finally:
        for name in given:
            spark.conf.unset(f"colloquy.{name}")
