"""Rules of requests, compiled to columns: every violation of a body, and the request with its defaults.

A body is JSON text. Its fields are read as a VARIANT, so that an absent field, a null and one of another type are told apart.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.requests import CHOICES, DEFAULTS, LIMITS
from colloquy.tables import fresh

TYPES = {"text": "string", "choice": "string", "whole": "int", "number": "double"}


@dataclass(frozen=True)
class Field:
    """kind: text, choice, whole, number or object. A field with a default may be absent; one that may be null is absent or null."""

    kind: str
    required: bool = False
    nullable: bool = False
    default: object = None
    least: float | None = None
    most: float | None = None
    choices: tuple = ()
    fields: dict = field(default_factory=dict)

    def type(self) -> str:
        inner = ", ".join(f"{n}: {f.type()}" for n, f in self.fields.items())
        return f"struct<{inner}>" if self.kind == "object" else TYPES[self.kind]


def _said(name: str) -> Field:
    return Field("text", required=True, least=1)


def _limited(kind: str, name: str, **more) -> Field:
    return Field(kind, least=LIMITS[name][0], most=LIMITS[name][1], **more)


def _chosen(name: str) -> Field:
    return Field("choice", default=DEFAULTS[name], choices=CHOICES[name])


def _default(name: str) -> Field:
    return Field("text", default=DEFAULTS[name])


MAYBE = Field("text", nullable=True)
OPTIONS = {"model": MAYBE, "temperature": _limited("number", "temperature", nullable=True), "max_tokens": _limited("whole", "max_tokens", nullable=True)}
PROFILE = Field("object", nullable=True, fields={"subject": MAYBE, "level": MAYBE, "style": _chosen("style"), "language": _default("language"), "student_name": MAYBE})
#: What a request of each task may have. Other fields are passed over.
SCHEMAS = {
    "chat": {"message": _said("message"), "session_id": MAYBE, "profile": PROFILE, **OPTIONS},
    "session": {"profile": PROFILE},
    "explain": {"topic": _said("topic"), "level": _default("level"), "language": _default("language"), **OPTIONS},
    "quiz": {
        "topic": _said("topic"), "num_questions": _limited("whole", "num_questions", default=DEFAULTS["num_questions"]), "num_options": _limited("whole", "num_options", default=DEFAULTS["num_options"]),
        "difficulty": _chosen("difficulty"), "level": _default("level"), **OPTIONS,
    },
    "evaluate": {"question": _said("question"), "student_answer": _said("student_answer"), "expected_answer": MAYBE, "level": _default("level"), **OPTIONS},
}

#: A number as a text may have it, blanks around it.
WHOLE, NUMBER = r"^\s*[+-]?[0-9]+(\.0*)?\s*$", r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _value(x: Column, f: Field) -> Column:
    """The field's value, null if it is of another type. Numbers may be texts of numbers, or true and false; whole ones have no fraction."""
    kind, plain = F.schema_of_variant(x), lambda t: F.try_variant_get(x, "$", t)
    if f.kind in ("text", "choice"):
        return F.when(kind == "STRING", plain("string"))
    number = F.when(kind == "BOOLEAN", plain("boolean").cast("double")).when(kind == "STRING", F.when(F.rlike(plain("string"), F.lit(WHOLE if f.kind == "whole" else NUMBER)), F.trim(plain("string")).try_cast("double"))).otherwise(F.when(~F.startswith(kind, F.lit("OBJECT")) & ~F.startswith(kind, F.lit("ARRAY")), plain("double")))
    return F.when(number == F.rint(number), number) if f.kind == "whole" else number


def _broken(value: Column, f: Field) -> Column:
    """The kind of rule that a value breaks, null if none."""
    none = F.lit(None).cast("string")
    if f.choices:
        return F.when(~value.isin(*f.choices), F.lit("not_a_choice")).otherwise(none)
    size = F.length(value) if f.kind == "text" else value
    short, long = ("too_short", "too_long") if f.kind == "text" else ("too_small", "too_large")
    for limit, kind, over in ((f.least, short, size < (f.least or 0)), (f.most, long, size > (f.most or 0))):
        none = F.when(over, F.lit(kind)).otherwise(none) if limit is not None else none
    return none


def _compiled(v: Column, fields: dict, place: str, there: Column) -> tuple[list[Column], list[Column]]:
    """(violations, values) of the fields of an object; `there`: whether there is one."""
    broken, values = [], []
    for name, f in fields.items():
        x = F.try_variant_get(v, f"$.{name}", "variant")
        absent, null = x.isNull(), F.is_variant_null(x)
        if f.kind == "object":
            has = F.coalesce(F.startswith(F.schema_of_variant(x), F.lit("OBJECT")), F.lit(False))
            inner_broken, inner = _compiled(x, f.fields, f"{place}{name}.", there & has)
            wrong = F.when(~absent & ~null & ~has, F.lit("type"))
            values.append(F.when(has, F.struct(*inner)).alias(name))
        else:
            inner_broken, value = [], _value(x, f)
            wrong = F.when(~absent & ~null, F.when(value.isNull(), F.lit("type")).otherwise(_broken(value, f)))
            values.append(F.coalesce(value.cast(f.type()) if f.kind != "whole" else value.try_cast("int"), F.lit(f.default).cast(f.type())).alias(name))
        wrong = F.when(absent, F.lit("missing" if f.required else None).cast("string")).when(null, F.lit(None if f.nullable else "type").cast("string")).otherwise(wrong)
        broken += [F.when(there & wrong.isNotNull(), F.struct(F.lit(f"{place}{name}").alias("place"), wrong.alias("kind"))), *inner_broken]
    return broken, values


def validated(rows: DataFrame, task: str, body: str = "body") -> DataFrame:
    """rows with `violations`, an array of (place, kind) in the order of the task's fields, and `request`, its fields with their defaults.

    Kinds: json (no JSON), missing, type, too_short, too_small, too_large, not_a_choice. Places within a profile are named `profile.style`. A number in a text counts as a number, and
    a null counts as absent only where a field may be null. A null body is no JSON. Columns of these names get an underscore at the end.
    """
    v, found, request = fresh(rows, "body_variant", "violations", "request")
    read = rows.withColumn(v, F.try_parse_json(body))
    kind = F.schema_of_variant(F.col(v))
    there = F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False))
    broken, values = _compiled(F.col(v), SCHEMAS[task], "", there)
    whole = F.when(F.col(v).isNull(), F.struct(F.lit("body").alias("place"), F.lit("json").alias("kind"))).when(~there, F.struct(F.lit("body").alias("place"), F.lit("type").alias("kind")))
    return read.withColumn(found, F.array_compact(F.array(whole, *broken))).withColumn(request, F.struct(*values)).drop(v)


def split(rows: DataFrame, task: str, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(accepted rows with `request`, rejected rows with `violations`)."""
    found, request = fresh(rows, "violations", "request")
    both = validated(rows, task, body)
    return both.filter(F.size(found) == 0).drop(found), both.filter(F.size(found) > 0).drop(request)
