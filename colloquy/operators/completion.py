"""Model completion as an operator: request rows in, reply rows out, behind a pluggable completer.

A completer is made once in each task and gets batches of payloads, whole requests as JSON, so that a client is
reused and calls overlap as it likes. It answers with what a model service sends: message, model, counts and durations. The
stub is deterministic, for tests and queries without a model.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import prompts, requests
from colloquy.functions.replies import answer_index, grade, needs_retry, salvage_json, usage, whole_score
from colloquy.functions.text import not_blank, strip
from colloquy.settings import Settings, settings

COUNTS = ["eval_count", "eval_duration", "prompt_eval_count", "total_duration", "load_duration"]
REPLY = "request_id string, reply string, model string, " + ", ".join(f"{c} long" for c in COUNTS)

Completer = Callable[[list[str]], list[dict]]


def stub() -> Completer:
    """Repeats the last user message as an answer, or asks back where it is told to; fills a schema with the message's own words.

    A word counts as a token, 40 ms each.
    """
    words = lambda text: re.findall(r"[^\x20\x09-\x0D]+", text)

    def filled(schema: dict, asked: str):
        if "enum" in schema:
            return schema["enum"][0]
        kind = schema["type"]
        if kind == "object":
            return {k: filled(v, asked) for k, v in schema["properties"].items()}
        if kind == "array":
            return [filled(schema["items"], f"{asked} {k + 1}" if schema["items"]["type"] == "string" else asked) for k in range(schema.get("minItems", 1))]
        return {"boolean": False, "integer": 60}.get(kind, asked)

    def one(body: str) -> dict:
        request = json.loads(body)
        said = [m["content"] or "" for m in request["messages"]]
        last = said[-1] if said else ""
        reply = "What do you make of it?" if last.startswith("That reply explained too much.") else f"About that: {last}"
        if "format" in request:
            reply = json.dumps(filled(request["format"], last), ensure_ascii=False)
        n = len(words(reply))
        return {"message": {"content": reply}, "model": request["model"], "eval_count": n, "eval_duration": 40_000_000 * n, "prompt_eval_count": sum(len(words(t)) for t in said), "total_duration": 40_000_000 * n + 1_000_000, "load_duration": 1_000_000}

    return lambda bodies: [one(b) for b in bodies]


def complete(asked: DataFrame, make: Callable[[], Completer] = stub) -> DataFrame:
    """Rows (request_id, reply, model, counts and durations) of rows (request_id, payload). A reply without a message is empty."""
    rows = asked.select(F.col("request_id").cast("string").alias("request_id"), "payload")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        completer = make()
        for batch in batches:
            if len(batch):
                found = completer(batch["payload"].tolist())
                out = {"request_id": batch["request_id"], "reply": [(r.get("message") or {}).get("content") or "" for r in found], "model": [r.get("model") for r in found]}
                yield pd.DataFrame(out | {c: pd.array([r.get(c) for r in found], dtype="Int64") for c in COUNTS})

    return rows.mapInPandas(run, REPLY)


def chat_payload(messages: Column, given: Settings | None = None) -> Column:
    """Of rows that have columns model, temperature and max_tokens."""
    return requests.payload(F.col("model"), F.col("temperature"), F.col("max_tokens"), messages, given=given)


def chat(asked: DataFrame, cut: Callable[[DataFrame, str], DataFrame], make: Callable[[], Completer] = stub) -> DataFrame:
    """Replies to rows (request_id, question, style, messages); socratic ones that don't end with a question are asked once more.

    asked may have model, temperature and max_tokens; the settings say what is sent where it hasn't. Only replies that need it are asked again; the second is kept if it ends with
    a question. Model and usage are those of the reply that is kept; one that names no model has the request's. `cut` writes and rereads a table, so that no call is made twice.
    """
    missing = {c: F.lit(None).cast(t) for c, t in (("model", "string"), ("temperature", "double"), ("max_tokens", "int")) if c not in asked.columns}
    rows = asked.select("request_id", "question", "style", "messages", *(c for c in ("model", "temperature", "max_tokens") if c in asked.columns)).withColumns({"request_id": F.col("request_id").cast("string"), **missing})
    given = settings(asked.sparkSession)
    kept = lambda df: df.select("request_id", F.struct(strip(F.col("reply")).alias("reply"), "model", *COUNTS).alias("r"))
    first = kept(cut(complete(rows.select("request_id", chat_payload(F.col("messages"), given).alias("payload")), make), "chat-first"))
    answered = rows.join(first, "request_id")
    again = answered.filter(needs_retry(F.col("r.reply"), F.col("style")))
    retried = chat_payload(prompts.retry_messages(F.col("messages"), F.col("r.reply"), F.col("question")), given)
    second = kept(cut(complete(again.select("request_id", retried.alias("payload")), make), "chat-second")).withColumnRenamed("r", "second")
    both = answered.join(second, "request_id", "left")
    better = F.coalesce(F.endswith(F.col("second.reply"), F.lit("?")), F.lit(False))
    final = both.select("request_id", F.col("model").alias("asked_model"), F.when(better, F.col("second")).otherwise(F.col("r")).alias("r"), F.col("second").isNotNull().alias("asked_again"), better.alias("used_retry"))
    return final.select("request_id", "r.reply", F.coalesce("r.model", not_blank(F.col("asked_model")), F.lit(given.default_model)).alias("model"), "asked_again", "used_retry", usage(F.col("r")).alias("usage"))


def task_payloads(asked: DataFrame, task: str, messages: Column, questions: Column | None = None, options: Column | None = None) -> DataFrame:
    """Rows (request_id, payload) of a structured task, with its defaults and the schema of its reply. asked may have model, temperature and max_tokens."""
    given = lambda c, t: F.col(c) if c in asked.columns else F.lit(None).cast(t)
    tokens = requests.task_tokens(task, given("max_tokens", "int"), questions)
    body = requests.payload(given("model", "string"), requests.task_temperature(task, given("temperature", "double")), tokens, messages, schema=requests.reply_format(task, questions, options), given=settings(asked.sparkSession))
    return asked.select("request_id", body.alias("payload"))


def parsed(replies: DataFrame, schema: str) -> DataFrame:
    """Rows (request_id, json, out, model, usage): json null where the reply has none, an error to the caller; out as it is parsed.

    An absent model is empty, and absent counts are zero; other columns of replies are dropped.
    """
    types = {"model": "string"} | dict.fromkeys(COUNTS, "long")
    given = replies.select("request_id", "reply", *((F.col(c) if c in replies.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()))
    read = given.withColumn("json", salvage_json(F.col("reply")))
    counts = F.struct(*COUNTS)
    return read.select("request_id", "json", F.from_json("json", schema).alias("out"), F.coalesce("model", F.lit("")).alias("model"), usage(counts).alias("usage"))


def explanations(replies: DataFrame) -> DataFrame:
    o = parsed(replies, prompts.EXPLAIN_REPLY)
    text = lambda c: F.coalesce(F.col(f"out.{c}"), F.lit("")).alias(c)
    return o.select("request_id", F.col("json").isNotNull().alias("ok"), text("summary"), F.coalesce("out.key_points", F.array().cast("array<string>")).alias("key_points"), text("analogy"), text("check_question"), "model", "usage")


def quizzes(replies: DataFrame) -> DataFrame:
    """(request_id, ok, questions, model, usage): questions without options are dropped; none left is an error."""
    o = parsed(replies, prompts.QUIZ_REPLY)
    kept = F.filter(F.coalesce("out.questions", F.array().cast(prompts.QUIZ_REPLY.split(" ", 1)[1])), lambda q: F.coalesce(F.size(q["options"]), F.lit(0)) > 0)
    named = F.transform(
        kept,
        lambda q: F.struct(F.coalesce(q["question"], F.lit("")).alias("question"), q["options"].alias("options"), answer_index(q["answer"], q["options"]).alias("answer_index"), F.coalesce(q["explanation"], F.lit("")).alias("explanation")),
    )
    return o.select("request_id", (F.size(kept) > 0).alias("ok"), named.alias("questions"), "model", "usage")


def grades(replies: DataFrame) -> DataFrame:
    o = parsed(replies, prompts.GRADE_REPLY).withColumn("score_int", whole_score(F.col("json")))
    verdict, score = grade(F.col("out.is_anything_wrong"), F.col("out.verdict"), F.col("score_int"))
    return o.select("request_id", F.col("json").isNotNull().alias("ok"), verdict.alias("verdict"), score.alias("score"), F.coalesce("out.feedback", F.lit("")).alias("feedback"), F.coalesce("out.hint", F.lit("")).alias("hint"), "model", "usage")
