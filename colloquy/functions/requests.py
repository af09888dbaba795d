"""Requests to a model: defaults by task, validation, reply schemas and payloads, as columns."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.replies import token_budget
from colloquy.functions.text import not_blank
from colloquy.settings import Settings

# What is sent where a request says nothing, and the limits of requests.
DEFAULT_MODEL = Settings.default_model
TASK_TEMPERATURE = {"quiz": 0.5, "evaluate": 0.2}
TASK_TOKENS = {"explain": 700, "evaluate": 400}
LIMITS = {"temperature": (0, 2), "max_tokens": (1, 4096), "num_questions": (1, 10), "num_options": (2, 6)}
CHOICES = {"style": ("socratic", "direct", "exam_prep"), "difficulty": ("easy", "medium", "hard")}
DEFAULTS = {"num_questions": 3, "num_options": 4, "difficulty": "medium", "level": "beginner", "language": "English", "style": "socratic"}
#: Texts that must be there, by task, and numbers that a request may have beside temperature and max_tokens.
TEXTS = {"chat": ("message",), "explain": ("topic",), "quiz": ("topic",), "evaluate": ("question", "student_answer")}

_TEXT = {"type": "string"}


def _object(**properties) -> dict:
    return {"type": "object", "properties": properties, "required": list(properties)}


def _array(of: dict, least: object = None, most: object = None) -> dict:
    return {"type": "array", "items": of} | ({} if least is None else {"minItems": least, "maxItems": most})


EXPLAIN_FORMAT = _object(summary=_TEXT, key_points=_array(_TEXT, 3, 5), analogy=_TEXT, check_question=_TEXT)
GRADE_FORMAT = _object(
    is_anything_wrong={"type": "boolean"}, verdict={"type": "string", "enum": ["correct", "partially_correct", "incorrect"]}, score={"type": "integer", "minimum": 0, "maximum": 100}, feedback=_TEXT, hint=_TEXT
)


def quiz_format(questions: Column, options: Column) -> Column:
    """The schema of a quiz's reply, for so many questions of so many options."""
    item = _object(question=_TEXT, options=_array(_TEXT, "<options>", "<options>"), answer=_TEXT, explanation=_TEXT)
    text = json.dumps(_object(questions=_array(item, "<questions>", "<questions>")), separators=(",", ":"))
    filled = F.replace(F.lit(text), F.lit('"<options>"'), options.cast("string"))
    return F.replace(filled, F.lit('"<questions>"'), questions.cast("string"))


def reply_format(task: str, questions: Column | None = None, options: Column | None = None) -> Column:
    """The schema that a task's reply must follow, as JSON text; null for a chat."""
    if task == "quiz":
        return quiz_format(questions, options)
    found = {"explain": EXPLAIN_FORMAT, "evaluate": GRADE_FORMAT}.get(task)
    return F.lit(found and json.dumps(found, separators=(",", ":"))).cast("string")


def task_temperature(task: str, given: Column) -> Column:
    """A temperature of 0 stays."""
    return F.coalesce(given, F.lit(TASK_TEMPERATURE.get(task)).cast("double"))


def task_tokens(task: str, given: Column, questions: Column | None = None) -> Column:
    """A number of 0 counts as not given, but for a chat."""
    if task == "quiz":
        return token_budget(given, questions)
    return given if task == "chat" else F.coalesce(F.nullif(given, F.lit(0)), F.lit(TASK_TOKENS[task]))


def payload(model: Column, temperature: Column, max_tokens: Column, messages: Column, stream: bool = False, schema: Column | None = None, given: Settings | None = None) -> Column:
    """The request's JSON: an empty model is the default one, while a temperature of 0 stays; `format` is there only with a schema. given: the defaults."""
    given = given or Settings()
    options = F.struct(
        F.coalesce(temperature, F.lit(given.temperature)).alias("temperature"), F.coalesce(max_tokens, F.lit(given.max_tokens)).alias("num_predict"), F.lit(given.num_ctx).alias("num_ctx")
    )
    body = F.to_json(F.struct(F.coalesce(not_blank(model), F.lit(given.default_model)).alias("model"), messages.alias("messages"), F.lit(stream).alias("stream"), options.alias("options")))
    if schema is None:
        return body
    return F.when(schema.isNull(), body).otherwise(F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"format":'), schema, F.lit("}")))


def rejected(task: str, **given: Column) -> Column:
    """The first field of a request that its rules refuse, null if none does.

    given: the request's columns by name. Texts of the task must not be empty; numbers may be null or lie within
    their limits; words of a fixed choice may be null, which is their default. `validation` gives all violations of a body.
    """
    out = F.lit(None).cast("string")
    rules = [(name, F.coalesce(F.length(given[name]) == 0, F.lit(True)) if name in given else F.lit(True)) for name in TEXTS[task]]
    for name, (least, most) in LIMITS.items():
        if name in given:
            rules.append((name, F.coalesce(~given[name].between(least, most), F.lit(False))))
    rules += [(name, F.coalesce(~given[name].isin(*words), F.lit(False))) for name, words in CHOICES.items() if name in given]
    for name, refused in reversed(rules):
        out = F.when(refused, name).otherwise(out)
    return out
