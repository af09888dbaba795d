"""Functions of what a model returns: usage, availability, answers, grades, salvaged JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import not_blank, strip


def tokens_per_second(count: Column, nanoseconds: Column) -> Column:
    rate = F.round(F.coalesce(count, F.lit(0)) / (nanoseconds / 1e9), 2)
    return F.when(nanoseconds > 0, rate).otherwise(0.0)


def milliseconds(nanoseconds: Column) -> Column:
    return F.coalesce((nanoseconds / 1e6).cast("long"), F.lit(0))


def is_available(names: Column, model: Column) -> Column:
    """Whether a catalog has the model, by its full name or by what stands before the colon."""
    return F.exists(names, lambda n: (n == model) | (F.split(n, ":")[0] == model))


def health(reachable: Column, available: Column) -> Column:
    return F.when(reachable & available, "ok").otherwise("degraded")


def health_report(reachable: Column, available: Column, detail: Column, hint: Column) -> Column:
    """(status, error): what keeps the service from being reached, if anything does."""
    error = F.when(~reachable, strip(F.concat_ws(" ", F.coalesce(detail, F.lit("")), F.coalesce(hint, F.lit("")))))
    return F.struct(health(reachable, available).alias("status"), error.alias("error"))


def version(body: Column) -> Column:
    return F.coalesce(F.get_json_object(body, "$.version"), F.lit("unknown"))


def is_stale(content: Column) -> Column:
    """A cached entry that is a page in place of what it should be."""
    return F.contains(F.coalesce(content, F.lit("")), F.lit("text/html"))


def usage(reply: Column) -> Column:
    """(prompt_tokens, completion_tokens, total_duration_ms, load_duration_ms, tokens_per_second) of a completion's counts and durations."""
    whole = lambda c: F.coalesce(reply[c], F.lit(0).cast("long"))
    return F.struct(
        whole("prompt_eval_count").alias("prompt_tokens"), whole("eval_count").alias("completion_tokens"), milliseconds(reply["total_duration"]).alias("total_duration_ms"),
        milliseconds(reply["load_duration"]).alias("load_duration_ms"), tokens_per_second(reply["eval_count"], reply["eval_duration"]).alias("tokens_per_second"),
    )


def needs_retry(reply: Column, style: Column) -> Column:
    """A socratic reply that doesn't end with a question."""
    return F.coalesce((style == "socratic") & ~F.endswith(strip(reply), F.lit("?")), F.lit(False))


def token_budget(max_tokens: Column, questions: Column) -> Column:
    return F.coalesce(F.nullif(max_tokens, F.lit(0)), F.least(F.lit(4096), 200 + 160 * questions))


def answer_index(answer: Column, options: Column, trimmed: Callable[[Column], Column] = strip) -> Column:
    """Place from 0 of the stated answer: equal but for case and blanks, else the first that contains it or is contained, else 0.

    trimmed: what the answer is rid of at its ends.
    """
    target = F.lower(trimmed(answer))
    plain = F.transform(options, lambda o: F.lower(strip(o)))
    near = F.filter(
        F.transform(plain, lambda o, i: F.when((o != "") & (F.contains(target, o) | F.contains(o, target)), i)),
        lambda i: i.isNotNull(),
    )
    found = F.when(F.array_contains(plain, target), F.array_position(plain, target).cast("int") - 1).otherwise(F.try_element_at(near, F.lit(1)))
    return F.coalesce(F.when(not_blank(answer).isNotNull(), found), F.lit(0))


def grade(wrong: Column, verdict: Column, score: Column) -> tuple[Column, Column]:
    """(verdict, score) reconciled: something false is incorrect and below 40, else correct is 85 at least."""
    known = F.when(verdict.isin("correct", "partially_correct", "incorrect"), verdict).otherwise("partially_correct")
    bounded = F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(score, F.lit(0))))
    is_wrong = F.coalesce(wrong, F.lit(False))
    return (
        F.when(is_wrong, "incorrect").otherwise(known),
        F.when(is_wrong, F.least(bounded, F.lit(39))).when(known == "correct", F.greatest(bounded, F.lit(85))).otherwise(bounded),
    )


def error_of(status: Column, body: Column, model: Column) -> Column:
    """(status, detail, hint) of a failed call; null status: not reachable, 0: timed out."""
    row = lambda code, detail, hint: F.struct(F.lit(code).alias("status"), detail.alias("detail"), hint.alias("hint"))
    none = F.lit(None).cast("string")
    return (
        F.when(status.isNull(), row(503, F.lit("The model service can't be reached."), F.lit("Start the model service.")))
        .when(status == 0, row(504, F.lit("The model service timed out."), none))
        .when(status == 404, row(404, F.format_string("Model '%s' is not available.", model), F.format_string("Download '%s' once.", model)))
        .when(status >= 400, row(502, F.concat(F.lit("The model service returned "), status.cast("string"), F.lit(": "), F.substring(strip(body), 1, 500)), none))
    )


def _alone(text: Column) -> Column:
    """The VARIANT of a text that is one JSON value and nothing else, else null.

    Spark's parsers let what follows a value pass. So the text is read as the first of two items of an array, the second one a digest of the text, which can't
    stand in the text: whatever ends the array early, or adds to it, makes another array.
    """
    digest = F.md5(text)
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), digest, F.lit('"]')))
    alone = (F.try_variant_get(pair, "$[1]", "string") == digest) & F.try_variant_get(pair, "$[2]", "variant").isNull()
    return F.when(alone, F.try_variant_get(pair, "$[0]", "variant"))


def is_json(text: Column) -> Column:
    """Whether a text is JSON and nothing else."""
    return _alone(text).isNotNull()


def salvage_json(content: Column) -> Column:
    """The JSON of a reply, or null: the reply as it is, what is in its code fence, or what goes from the first brace to the last."""
    text = strip(F.coalesce(content, F.lit("")))
    inner = F.regexp_replace(F.substring_index(F.substring(text, 4, 2**31 - 1), "```", 1), r"(?U)^\s+", "")
    bare = F.when(F.lower(F.substring(inner, 1, 4)) == "json", F.substring(inner, 5, 2**31 - 1)).otherwise(inner)
    text = F.when(F.startswith(text, F.lit("```")), strip(bare)).otherwise(text)
    braced = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(is_json(text), text).when(is_json(braced), braced)


def whole_score(text: Column) -> Column:
    """The score of a salvaged reply if JSON has it as a whole number (or true, false), else 0."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), "$.score", "variant"))
    said = F.get_json_object(text, "$.score")
    number = F.when(kind == "BOOLEAN", (said == "true").cast("int").cast("double")).when((kind != "STRING") & F.rlike(said, F.lit(r"^-?[0-9]+$")), said.try_cast("double"))
    bounded = F.greatest(F.lit(-(2.0**31)), F.least(F.lit(2.0**31 - 1), number)).cast("int")
    return F.when(number.isNotNull(), bounded).otherwise(F.lit(0))
