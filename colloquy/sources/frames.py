"""Framed token streams: NDJSON chunks in, server-sent events in and out, and the model catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from colloquy.functions.replies import is_json, usage
from colloquy.functions.requests import DEFAULT_MODEL
from colloquy.functions.text import joined, not_blank, strip
from colloquy.tables import fresh

CHUNK = "model string, message struct<role:string,content:string>, done boolean, eval_count long, eval_duration long, prompt_eval_count long, total_duration long, load_duration long"
EVENT = "type string, session_id string, model string, content string, reply string, detail string, hint string"
CATALOG = "models array<struct<name:string,size:long,modified_at:string,details:struct<parameter_size:string,quantization_level:string,family:string>>>"

#: What a request's stream sends: its place, its kind and what it may hold. The last place is the end mark's.
FRAME = "at long, type string, session_id string, model string, content string, reply string, eval_count long, eval_duration long, prompt_eval_count long, total_duration long, load_duration long, detail string, hint string"
AFTER = 2**62
FAILED = "The service failed in the middle of the answer."


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (session_id, turn, role, content) of the conversations."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return table.select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, their time as a timestamp that watermarks accept."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def ndjson_chunks(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the parsed chunk, rows whose line isn't JSON) of rows with `line`; blank lines are skipped. Batch or stream."""
    parsed = lines.filter(strip(F.col("line")) != "").withColumn("chunk", F.from_json("line", CHUNK, {"mode": "PERMISSIVE"}))
    good = is_json(F.col("line")) & F.col("chunk").isNotNull()
    return parsed.filter(good), parsed.filter(~good).drop("chunk")


def _snake(name: str) -> str:
    return "".join(f"_{x.lower()}" if x.isupper() else x for x in name)


def _snaked(kind: DataType) -> DataType:
    """A type with the names of its fields in snake case, at any depth."""
    if isinstance(kind, StructType):
        return StructType([StructField(_snake(f.name), _snaked(f.dataType), f.nullable) for f in kind.fields])
    return ArrayType(_snaked(kind.elementType), kind.containsNull) if isinstance(kind, ArrayType) else kind


def client_requests(rows: DataFrame) -> DataFrame:
    """A client's rows with all camel-case names in snake case, as requests have them, those within a profile too."""
    return rows.select(*(F.col(f"`{f.name}`").cast(_snaked(f.dataType)).alias(_snake(f.name)) for f in rows.schema.fields))


def sse(payload: Column) -> Column:
    """A frame of a struct; null fields are written."""
    return F.concat(F.lit("data: "), F.to_json(payload, {"ignoreNullFields": "false"}), F.lit("\n\n"))


def data_events(rows: DataFrame) -> DataFrame:
    """rows with `data`, the text of a data line, as rows with `event` in its place: those that are JSON and not the end mark."""
    real = rows.withColumn("data", strip(F.col("data"))).filter("data is not null and data <> '' and data <> '[DONE]'").withColumn("event", F.from_json("data", EVENT))
    return real.filter(is_json(F.col("data"))).drop("data")


def sse_events(bodies: DataFrame) -> DataFrame:
    """Rows (..., at, event) of rows with `body`: of each finished frame its first data line, if it is JSON and not the end mark."""
    frames = F.split("body", "\n\n")
    finished = F.slice(frames, F.lit(1), F.size(frames) - 1)
    line = F.try_element_at(F.filter(F.split("frame", "\n"), lambda x: F.startswith(x, F.lit("data:"))), F.lit(1))
    rows = bodies.select("*", F.posexplode(finished).alias("at", "frame")).withColumn("data", F.substring(line, 6, 2**31 - 1))
    return data_events(rows).drop("body", "frame")


def client_replies(events: DataFrame, key: str) -> DataFrame:
    """(key, session_id, reply, error) of rows (key, at, event): what a client makes of a stream.

    Nothing is read after an error, which is its detail and hint. The session is the last one named by a start or done; the reply is the last done's,
    where it has one, with the tokens after it.
    """
    e = F.col("event")
    failed = events.filter(e["type"] == "error").groupBy(key).agg(F.min("at").alias("failed_at"))
    read = events.join(failed, key, "left").filter("failed_at is null or at <= failed_at")
    of = lambda kinds, c: (e["type"].isin(kinds)) & e[c].isNotNull()
    last = lambda kinds, c: F.max_by(F.when(of(kinds, c), e[c]), F.when(of(kinds, c), F.col("at")))
    token = F.when(of(["token"], "content"), F.struct("at", e["content"].alias("content")))
    found = read.groupBy(key).agg(
        last(["start", "done"], "session_id").alias("session_id"),
        last(["done"], "reply").alias("given"),
        F.max(F.when(of(["done"], "reply"), F.col("at"))).alias("done_at"),
        F.sort_array(F.collect_list(token)).alias("tokens"),
        F.max(F.when(e["type"] == "error", joined(F.coalesce(e["detail"], F.lit(FAILED)), e["hint"]))).alias("error"),
    )
    rest = F.transform(F.filter("tokens", lambda t: t["at"] > F.coalesce("done_at", F.lit(-1))), lambda t: t["content"])
    return found.select(key, "session_id", F.concat(F.coalesce("given", F.lit("")), F.array_join(rest, "")).alias("reply"), "error")


def catalog(bodies: DataFrame) -> DataFrame:
    """Rows of the models in rows with `body`, a catalog's JSON."""
    rows = bodies.select(F.explode(F.coalesce(F.from_json("body", CATALOG)["models"], F.array().cast(CATALOG.split(" ", 1)[1]))).alias("m"))
    return rows.select("m.name", F.col("m.size").alias("size_bytes"), "m.details.parameter_size", F.col("m.details.quantization_level").alias("quantization"), "m.details.family", "m.modified_at")


def availability(asked: DataFrame, models: DataFrame, model: str = "model") -> DataFrame:
    """asked with by_name and by_family: whether a catalog (name) has the model, by its full name or by what stands before a name's colon.

    What `replies.is_available` says of a catalog in one array, for catalogs of any size. A null model is in none.
    """
    name, by_name, by_family = fresh(asked, "catalog_name", "by_name", "by_family")
    full = models.select(F.col("name").alias(name)).distinct().withColumn(by_name, F.lit(True))
    family = models.select(F.split("name", ":")[0].alias(name)).distinct().withColumn(by_family, F.lit(True))
    found = asked.join(full, F.col(model) == F.col(name), "left").drop(name).join(family, F.col(model) == F.col(name), "left").drop(name)
    return found.withColumns({c: F.coalesce(c, F.lit(False)) for c in (by_name, by_family)})


def framed(rows: DataFrame) -> DataFrame:
    """rows (..., FRAME) with `frame`, the text that is sent of each."""
    c = F.col
    counts = usage(F.struct("eval_count", "eval_duration", "prompt_eval_count", "total_duration", "load_duration"))
    bodies = {
        "start": [c("session_id"), F.coalesce(not_blank(c("model")), F.lit(DEFAULT_MODEL)).alias("model")],
        "token": [c("content")],
        "done": [c("session_id"), strip(F.coalesce("reply", F.lit(""))).alias("reply"), counts.alias("usage")],
        "error": [c("detail"), c("hint")],
    }
    frame = F.lit("data: [DONE]\n\n")
    for kind, fields in bodies.items():
        frame = F.when(c("type") == kind, sse(F.struct("type", *fields))).otherwise(frame)
    return rows.withColumn("frame", frame)


def stream_frames(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (request_id, at, type, frame): what a request's stream sends, in order.

    requests: (request_id, session_id, model). chunks: (request_id, seq, token, done, detail, hint), as the model sent them, with its counts where
    it sends them; a chunk with a detail is a failure. A start comes first, with the default model where none is named, then the tokens that
    aren't empty, then done with the reply and its usage, or an error; where the chunks end without either, neither comes. The end mark is last.
    Nothing after a failure or the model's last chunk is read.
    """
    types = dict(f.strip().split(" ", 1) for f in FRAME.split(","))
    row = lambda df, at, kind: df.select("request_id", at.cast("long").alias("at"), F.lit(kind).alias("type"), *((F.col(n) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in types.items() if n not in ("at", "type")))
    over = chunks.filter("detail is not null or done").groupBy("request_id").agg(F.min("seq").alias("over_at"))
    read = chunks.join(over, "request_id", "left").filter("over_at is null or seq <= over_at").join(requests.select("request_id", "session_id"), "request_id")
    failed = read.filter("detail is not null")
    tokens = read.filter("detail is null").withColumn("content", F.coalesce("token", F.lit("")))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), "")
    texts = tokens.groupBy("request_id").agg(whole.alias("reply"))
    done = read.filter("done and detail is null").join(texts, "request_id")
    parts = [
        row(requests, F.lit(-1), "start"), row(tokens.filter("content <> ''"), F.col("seq"), "token"), row(done, F.lit(AFTER - 2), "done"),
        row(failed, F.lit(AFTER - 1), "error"), row(requests.select("request_id"), F.lit(AFTER), "end"),
    ]
    return framed(reduce(DataFrame.union, parts)).select("request_id", "at", "type", "frame")
