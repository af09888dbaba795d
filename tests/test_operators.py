"""Session, frame, completion and streaming operators on small rows, and every registered query against DuckDB."""

import datetime as dt
import importlib.util
import json
import os
import sys
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from colloquy.functions import replies, requests
from colloquy.operators import completion, sessions, store
from colloquy.plans import catalog
from colloquy.sources import frames
from colloquy.streaming import folds
from colloquy.tables import shared_dir

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


def messages(spark, rows):
    return spark.createDataFrame(rows, "session_id string, turn long, role string, content string")


def test_sessions(spark):
    rows = messages(spark, [("a", 0, "system", "s"), ("a", 1, "user", "x" * 121), ("a", 2, "assistant", "r"), ("b", 0, "assistant", "only")])
    found = {r.session_id: r for r in sessions.summaries(rows).collect()}
    assert found["a"].message_count == 3 and found["a"].preview == "x" * 120 and found["b"].preview is None
    assert [m.role for m in {r.session_id: r.messages for r in sessions.transcripts(rows).collect()}["a"]] == ["system", "user", "assistant"]
    assert sessions.history(rows, 1).count() == 2 and sessions.history(rows, 0).count() == 4 and sessions.history(rows, 9).count() == 4


@pytest.mark.parametrize("gap, number", [(179, 1), (180, 1), (181, 2)])
def test_gaps(spark, gap, number):
    start = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, 1, start), (2, 1, start + dt.timedelta(minutes=gap))], "event_id long, user_id long, ts timestamp")
    assert sessions.sessionize(rows, "user_id").agg(F.max("session_no")).first()[0] == number
    last = sessions.last_activity(rows.filter("event_id = 1"), "user_id")
    assert last.select(sessions.is_expired(F.col("updated_at"), F.lit(start + dt.timedelta(minutes=gap)))).first()[0] == (gap > 180)


NOON = dt.datetime(2024, 1, 1, 12)


def stored_sessions(spark, minutes):
    """Sessions (id, profile) of which each was last active so many minutes before noon, and accessed in this order."""
    rows = [(k, f"profile {k}", NOON - dt.timedelta(hours=9), NOON - dt.timedelta(minutes=m), NOON - dt.timedelta(hours=8) + dt.timedelta(minutes=n)) for n, (k, m) in enumerate(minutes.items())]
    return spark.createDataFrame(rows, "session_id string, profile string, created_at timestamp, updated_at timestamp, last_access timestamp")


def test_resolve_and_delete(spark):
    stored = stored_sessions(spark, {"a": 10, "edge": 180, "old": 181})
    asked = spark.createDataFrame([(1, "a", None), (2, "a", "q"), (3, "", None), (4, None, "q"), (5, "gone", None), (6, "old", "q"), (7, "edge", None)], "request_id int, session_id string, profile string")
    found = {r.request_id: (r.session_id, r.profile, r.created) for r in store.resolve(asked, stored, F.lit(NOON)).collect()}
    assert found[1] == ("a", "profile a", False) and found[2] == ("a", "q", False) and found[7] == ("edge", "profile edge", False)
    assert all(found[k][2] for k in (3, 4, 5, 6)) and len({found[k][0] for k in (3, 4, 5, 6)}) == 4 and found[6][0] != "old" and found[6][1] == "q"
    left, answers = sessions.delete(stored, asked.select("session_id").filter("session_id is not null"))
    assert left.count() == 0 and {r.session_id: r.deleted for r in answers.collect()} == {"a": True, "": False, "gone": False, "old": True, "edge": True}


def test_store(spark):
    stored = stored_sessions(spark, {"a": 10, "old": 181, "b": 170, "c": 5})
    now = F.lit(NOON)
    assert {r.session_id: r.last_access for r in store.lookup(stored, spark.createDataFrame([("a",), ("old",), ("none",), ("a",)], "session_id string"), now).collect()} == {"a": NOON}
    new = spark.createDataFrame([("n", "p"), ("m", None)], "session_id string, profile string")
    after = store.create(stored, new, now, 4).collect()
    assert {r.session_id for r in after} == {"n", "m", "c", "b"} and all(r.updated_at == NOON for r in after if r.session_id in "nm")
    assert {r.session_id for r in store.create(stored, new, now).collect()} == {"n", "m", "a", "b", "c"}
    said = spark.createDataFrame([("a", 0, "user", "x" * 130, NOON - dt.timedelta(minutes=9)), ("a", 1, "assistant", "r", NOON), ("b", 0, "assistant", "only", NOON - dt.timedelta(hours=5))], "session_id string, turn long, role string, content string, created_at timestamp")
    newest = {r.session_id: r.updated_at for r in store.append(stored, said).collect()}
    assert newest["a"] == NOON and newest["b"] == NOON - dt.timedelta(minutes=170)
    back = store.roll_back(said, spark.createDataFrame([("a",), ("b",), ("z",)], "session_id string"))
    assert [(r.session_id, r.turn) for r in back.collect()] == [("a", 0)]
    last = {r.session_id: r.updated_at for r in store.last_activity(stored, back).collect()}
    assert last["a"] == NOON - dt.timedelta(minutes=9) and last["b"] == NOON - dt.timedelta(hours=9)
    rows = store.listed(stored, said, now).collect()
    assert [(r.session_id, r.message_count, r.preview) for r in rows] == [("c", 0, None), ("a", 2, "x" * 120), ("b", 1, None)]
    assert list(rows[0].asDict()) == ["session_id", "profile", "message_count", "created_at", "updated_at", "preview"]


def test_stage_changes_and_client_requests(spark):
    rows = spark.createDataFrame([("u", 1, "idle"), ("u", 2, "listening"), ("u", 3, None), ("u", 4, "listening"), ("u", 5, "error"), ("v", 1, "thinking")], "k string, at int, s string")
    found = sessions.stage_changes(rows, "k", "at", F.col("s")).orderBy("k", "at").collect()
    assert [tuple(r) for r in found] == [("u", 2, "idle", "listening"), ("u", 5, "listening", "error"), ("v", 1, "idle", "thinking")]
    client = spark.createDataFrame([("a", (1, [("x",)]), 1), ("b", None, None)], "sessionId string, profile struct<studentName: int, `pastNames`: array<struct<firstName: string>>>, maxTokens int")
    mapped = frames.client_requests(client)
    assert mapped.columns == ["session_id", "profile", "max_tokens"] and mapped.select("profile.student_name", "profile.past_names.first_name").collect() == [(1, ["x"]), (None, None)]


def test_transcript_parts(spark):
    rows = messages(spark, [("a", k, "user", f"m{k}") for k in range(7)])
    found = {r.part: [m.content for m in r.messages] for r in sessions.transcript_parts(rows, 3).collect()}
    assert found == {0: ["m0", "m1", "m2"], 1: ["m3", "m4", "m5"], 2: ["m6"]}


def test_stream_frames(spark):
    asked = spark.createDataFrame([(k, f"s{k}", "m") for k in (1, 2, 3, 4)], "request_id int, session_id string, model string")
    chunks = [(1, 0, "He said ", False, None, None), (1, 1, "", False, None, None), (1, 2, "é. ", False, None, None), (1, 3, "", True, None, None), (2, 0, "a", False, None, None), (2, 1, None, False, "timed out", "wait"), (2, 2, "lost", False, None, None), (3, 0, "b", False, None, None)]
    rows = frames.stream_frames(asked, spark.createDataFrame(chunks, "request_id int, seq long, token string, done boolean, detail string, hint string")).collect()
    of = {k: [r for r in sorted(rows, key=lambda r: r.at) if r.request_id == k] for k in (1, 2, 3, 4)}
    assert {k: [r.type for r in v] for k, v in of.items()} == {1: ["start", "token", "token", "done", "end"], 2: ["start", "token", "error", "end"], 3: ["start", "token", "end"], 4: ["start", "end"]}
    assert of[1][0].frame == 'data: {"type":"start","session_id":"s1","model":"m"}\n\n' and of[1][3].frame == (
        'data: {"type":"done","session_id":"s1","reply":"He said é.","usage":{"prompt_tokens":0,"completion_tokens":0,"total_duration_ms":0,"load_duration_ms":0,"tokens_per_second":0.0}}\n\n'
    )
    assert of[2][2].frame == 'data: {"type":"error","detail":"timed out","hint":"wait"}\n\n' and of[2][3].frame == "data: [DONE]\n\n"
    parsed = frames.sse_events(spark.createDataFrame([(1, "".join(r.frame for r in of[1]))], "k int, body string")).orderBy("at").collect()
    assert [r.event.type for r in parsed] == ["start", "token", "token", "done"]


def test_frames(spark):
    body = 'data: {"type":"start"}\n\nevent: x\ndata: {"type":"token","content":"é"}\n\ndata: {"type": oops\n\nid: 3\n\ndata: [DONE]\n\ndata: {"type":"lost"}'
    found = frames.sse_events(spark.createDataFrame([(1, body)], "k int, body string")).orderBy("at").collect()
    assert [r.event.type for r in found] == ["start", "token"] and found[1].event.content == "é"
    good, bad = frames.ndjson_chunks(spark.createDataFrame([('{"message":{"content":"a"}}',), ("  ",), ("{x",), ('{"done":true} y',)], "line string"))
    assert good.count() == 1 and bad.count() == 2
    models = frames.catalog(spark.createDataFrame([('{"models":null}',), ('{"models":[{"name":"m","details":null}]}',)], "body string")).collect()
    assert len(models) == 1 and models[0].name == "m" and models[0].family is None


def test_availability_is_the_column_s(spark):
    names = ["m:1b", "m:2b", "n", "o:x:y", ""]
    asked = [(k, m) for k, m in enumerate(["m", "m:1b", "m:3b", "n", "o", "o:x", "o:x:y", "", None, "1b"])]
    df = spark.createDataFrame(asked, "k int, model string").withColumn("by_name", F.lit("mine"))
    found = {r.k: r.by_name_ or r.by_family for r in frames.availability(df, spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    want = df.select("k", F.coalesce(replies.is_available(F.array(*map(F.lit, names)), F.col("model")), F.lit(False)).alias("there")).collect()
    assert found == {r.k: r.there for r in want} and sum(found.values()) == 6


def cut(df, name):
    return df.cache()


def test_chat_asks_once_more(spark, tmp_path):
    """Each call is written down: only drifted replies are asked again, once, and usage is that of the reply that is kept."""

    def asking(second):
        def make():
            def answer(bodies):
                out = []
                for body in bodies:
                    request = json.loads(body)
                    last = request["messages"][-1]["content"]
                    again = "explained too much" in last
                    (tmp_path / f"{second[:3]}-{uuid.uuid4().hex}").write_text(json.dumps([again, len(request["messages"]), request["options"]["temperature"]]))
                    out.append({"message": {"content": second if again else " A lecture. "}, "model": "second" if again else "first", "eval_count": 3 if again else 7, "eval_duration": 10**9, "prompt_eval_count": len(request["messages"])})
                return out

            return answer

        return make

    rows = spark.createDataFrame([("1", "q", "socratic", 0.0), ("2", "q", "direct", None)], "request_id string, question string, style string, temperature double")
    rows = rows.withColumn("messages", F.array(F.struct(F.lit("system").alias("role"), F.lit("s").alias("content")), F.struct(F.lit("user").alias("role"), F.col("question").alias("content"))))
    found = {r.request_id: r for r in completion.chat(rows, cut, asking("Now what?")).collect()}
    assert (found["1"].reply, found["1"].model, found["1"].asked_again, found["1"].used_retry) == ("Now what?", "second", True, True)
    assert tuple(found["1"].usage) == (4, 3, 0, 0, 3.0) and tuple(found["2"].usage) == (2, 7, 0, 0, 7.0)
    assert (found["2"].reply, found["2"].model, found["2"].asked_again, found["2"].used_retry) == ("A lecture.", "first", False, False)
    calls = sorted(json.loads(f.read_text()) for f in tmp_path.glob("Now*"))
    assert calls == [[False, 2, 0.0], [False, 2, 0.7], [True, 4, 0.0]]
    kept = {r.request_id: r for r in completion.chat(rows, cut, asking("Still a lecture.")).collect()}["1"]
    assert (kept.reply, kept.model, kept.asked_again, kept.used_retry, kept.usage.completion_tokens) == ("A lecture.", "first", True, False, 7)


def test_payloads_and_rules(spark):
    none = F.lit(None)
    body = lambda **k: json.loads(spark.range(1).select(requests.payload(none.cast("string"), none.cast("double"), none.cast("int"), F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content"))), **k)).first()[0])
    assert body() == {"model": "small:1b", "messages": [{"role": "user", "content": "hi"}], "stream": False, "options": {"temperature": 0.7, "num_predict": 800, "num_ctx": 4096}}
    quiz = body(schema=requests.reply_format("quiz", F.lit(2), F.lit(5)))["format"]
    assert quiz["properties"]["questions"]["minItems"] == quiz["properties"]["questions"]["maxItems"] == 2 and quiz["properties"]["questions"]["items"]["properties"]["options"]["minItems"] == 5
    assert list(body(schema=requests.reply_format("evaluate"))["format"]["properties"])[0] == "is_anything_wrong" and "format" not in body(schema=requests.reply_format("chat"))
    got = spark.range(1).select(
        requests.task_tokens("explain", F.lit(0)), requests.task_tokens("evaluate", none.cast("int")), requests.task_tokens("quiz", none.cast("int"), F.lit(3)), requests.task_tokens("chat", none.cast("int")),
        requests.task_temperature("quiz", F.lit(0.0)), requests.task_temperature("evaluate", none.cast("double")), requests.task_temperature("chat", none.cast("double")),
    ).first()
    assert tuple(got) == (700, 400, 680, None, 0.0, 0.2, None)
    rows = [("hi", 0.0, 1, None), ("", 0.0, 1, "message"), (None, 0.0, 1, "message"), ("hi", 2.1, 1, "temperature"), ("hi", None, 0, "max_tokens"), ("hi", None, 4097, "max_tokens"), ("hi", None, None, None)]
    found = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, m string, t double, n int, want string").orderBy("k")
    assert [r[0] == r[1] for r in found.select(requests.rejected("chat", message=F.col("m"), temperature=F.col("t"), max_tokens=F.col("n")), "want").collect()] == [True] * len(rows)
    assert spark.range(1).select(requests.rejected("quiz", topic=F.lit("t"), num_questions=none.cast("int"), num_options=F.lit(4))).first()[0] is None
    assert spark.range(1).select(requests.rejected("quiz", topic=F.lit("t"), num_questions=F.lit(0), difficulty=F.lit("x"))).first()[0] == "num_questions"


def test_structured_replies(spark):
    rows = spark.createDataFrame([("1", '{"questions":[{"question":"q","options":["a","b"],"answer":"B"},{"question":"none","options":[]}]}'), ("2", "no"), ("3", '{"questions":[]}')], "request_id string, reply string")
    found = {r.request_id: r for r in completion.quizzes(rows).collect()}
    assert [q.answer_index for q in found["1"].questions] == [1] and found["1"].ok and not found["2"].ok and not found["3"].ok
    assert [(r.ok, r.verdict, r.score) for r in completion.grades(rows.limit(1).withColumn("reply", F.lit('{"is_anything_wrong":false,"verdict":"correct","score":50}'))).collect()] == [(True, "correct", 85)]


def test_streams_replay_as_batches(spark, sf_dir):
    stream = folds.event_stream(spark, sf_dir)
    closed = folds.replay(folds.closed_sessions(stream, "user_id"), "closed_test")
    batch = sessions.sessionize(frames.events(spark, sf_dir), "user_id").groupBy("user_id", "session_no").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n"))
    # Closed are those that ended more than the gap and the allowed lateness before the newest event; no other is withheld.
    newest = frames.events(spark, sf_dir).agg(F.max("ts")).first()[0]
    sure = batch.filter(F.col("last") <= F.lit(newest - dt.timedelta(minutes=190))).select("user_id", "start", "last", "n")
    got = closed.select("user_id", "start", "last", "n")
    assert 0 < sure.count() < batch.count() and got.exceptAll(sure).count() == 0 and sure.exceptAll(got).count() == 0


def test_streamed_sessions_are_written_with_their_checkpoint(spark, sf_dir):
    found = catalog.QUERIES["streamed_sessions"](spark, sf_dir)
    files = found.inputFiles()
    assert files and all(f.removeprefix("file:").lstrip("/").startswith(shared_dir(spark).removeprefix("file:").lstrip("/")) for f in files)
    folder = files[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/")
    assert os.path.isdir(f"{folder}-checkpoint/state")
    replayed = folds.replay(folds.closed_sessions(folds.event_stream(spark, sf_dir), "user_id"), "written_test").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n")
    assert found.schema == replayed.schema and found.count() > 0
    assert found.exceptAll(replayed).count() == 0 and replayed.exceptAll(found).count() == 0


def test_other_streams(spark, sf_dir, tmp_path):
    """Windowed counts, first submissions and upserts of a replayed stream are those of the batch."""
    events = frames.events(spark, sf_dir)
    newest = events.agg(F.max("ts")).first()[0]
    counts = folds.replay(folds.windowed_counts(folds.event_stream(spark, sf_dir)), "counts_test")
    whole = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
    closed = whole.filter(F.col("start") + F.expr("interval 1 hour") <= F.lit(newest - dt.timedelta(minutes=10)))
    assert counts.count() > 0 and counts.exceptAll(closed).count() == 0 and closed.exceptAll(counts).count() == 0
    said = [("u1", 1, 0), ("u1", 2, 60), ("u2", 3, 30), ("u1", 4, 90)]
    start = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(u, k, start + dt.timedelta(seconds=s)) for u, k, s in said], "utterance_id string, k int, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/said")
    stream = spark.readStream.schema("utterance_id string, k int, ts timestamp").parquet(f"{tmp_path}/said")
    assert sorted(r.utterance_id for r in folds.replay(folds.first_submissions(stream), "first_test").collect()) == ["u1", "u2"]
    last = folds.replay(folds.upsert_latest(folds.event_stream(spark, sf_dir), "user_id", "event_id", "event_type"), "upsert_test", "complete")
    batch = sessions.latest(events, "user_id", "event_id", "event_type")
    assert last.exceptAll(batch).count() == 0 and last.count() == batch.count()


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf_dir, db, name):
    found = catalog.QUERIES[name](spark, sf_dir)
    rows = found.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    cursor = db.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(found.columns)
    want = sorted((tuple(r) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in names) for r in rows), key=str) == want


def test_quiz_answers_with_line_ends_at_their_edges(spark, tmp_path):
    """An answer that is cut out right at a line end, texts that hold it without the line end before, and keys of all kinds."""
    said = ["permission was given here. Ab\npermission was given now. ", "over and done there. Xyover and done theres\n\nx. ", "Ab\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\ny. ", "One is a first line. Two\u00a0 is another one. ", "no sentence", "", None]
    rows = [(k, t) for n, t in enumerate(said) for k in (*range(4 * n - 40, 4 * n - 36), *range(4 * n, 4 * n + 4))] + [(None, said[0])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.quiz_answers(spark, str(tmp_path))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = connection.execute(catalog.ORACLE_SQL["quiz_answers"])
    want = sorted((tuple(r) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(r[c[0]] for c in cursor.description) for r in found.collect()), key=str) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert (importlib.util.find_spec("colloquy.llm") is None) or any(n.startswith("op1_") for n in e.queries())


@pytest.mark.parametrize("gone", ["colloquy.llm", "corpus_pipeline", "tiktoken"])
def test_entry_without_optional_parts(monkeypatch, gone):
    """Where the optional part, or what it needs, can't be imported, the other queries stand."""
    import builtins

    import __spark_entry__ as e

    real = builtins.__import__

    def refuse(name, *args, **kwargs):
        if name == gone or name.startswith(f"{gone}."):
            raise ImportError(name)
        return real(name, *args, **kwargs)

    with monkeypatch.context() as m:
        for name in [n for n in sys.modules if n.startswith(("colloquy.llm", "corpus_pipeline")) or n == gone]:
            m.delitem(sys.modules, name)
        m.setattr(builtins, "__import__", refuse)
        again = importlib.reload(e)
        assert set(catalog.QUERIES) <= set(again.queries()) and set(catalog.ORACLE_SQL) <= set(again.oracle_sql())
        assert gone == "tiktoken" or "pipeline" not in again.queries()  # no stage of the pipeline needs it
        assert gone == "corpus_pipeline" or not any(n.startswith("op2") for n in again.queries())
    importlib.reload(e)
