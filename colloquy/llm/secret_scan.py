"""Secret scans: fixed patterns, and a randomness test battery for what has no pattern.

Patterns give the base spans. Other long runs of an encoding's characters are candidates. For each,
an encoding is inferred (hex, base32, base62, base64; decimal numbers are none), and three statistics
of its letters and digits are held against what structured strings (words, identifiers) give:

- chi-squared alphabet uniformity, by way of the pairs of equal characters that it counts;
- runs: changes between lower case, upper case and digits;
- serial correlation of vowels, which alternate in words and don't in keys.

The three z values are summed (Stouffer) to one p value. False discoveries are controlled by
Benjamini and Hochberg's rule within each stratum of encoding and length, as long keys are rarer and
surer than short ones; the counts of p values, in bins of 1/20 of a decimal power, cover all texts, and
strata and bins are fixed in number. Accepted candidates that no base span touches are added as `random`.

DataFrame functions only; no row leaves its task but for the counts. A match's place is the sum of
the lengths before it, in code points.

Defined results: null texts count as empty; texts without spans get an empty list; repeated rows,
null ids and equal texts get rows of their own; an empty table gives an empty result; columns other than
the id are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.common import staged, table

#: Fixed patterns, as listed: kind, pattern, group of the value, least length of the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]{16,}", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24)]
KINDS = [*(k for k, *_ in BASE), "random"]
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"

FALSE_DISCOVERIES = 0.01
#: Structured strings of an encoding: chance that two characters, and that three, are equal.
ALIKE = {"hex": (0.14, 0.03), "base32": (0.066, 0.0055), "base62": (0.066, 0.0055), "base64": (0.066, 0.0055)}
#: Structured strings: share of places at which the class of characters changes, serial correlation of vowels.
CHANGES, VOWELS = 0.12, -0.35
LENGTHS = [16, 20, 24, 32, 48, 64, 128, 512]
BINS_A_POWER, MOST_BIN = 20, 1200
CHUNK = 256


def found_at(text: Column, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end, value) of the pattern's matches whose group has `least` characters."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    items = F.arrays_zip(gaps.alias("gap"), whole.alias("match"), values.alias("value"))
    spans = "array<struct<start:long,end:long,value:string>>"
    # Places are running sums of lengths. Arrays grow in two levels, so that many matches don't cost their square.
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / CHUNK)), lambda c: F.slice(items, (c * CHUNK + 1).cast("int"), CHUNK))

    def one(state: Column, x: Column) -> Column:
        start = state["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["match"])
        return F.struct(end.alias("at"), F.array_append(state["out"], F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))).alias("out"))

    def chunk(state: Column, rows: Column) -> Column:
        inner = F.aggregate(rows, F.struct(state["at"].alias("at"), F.array().cast(spans).alias("out")), one)
        return F.struct(inner["at"].alias("at"), F.array_append(state["out"], inner["out"]).alias("out"))

    all_ = F.aggregate(chunks, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{spans}>").alias("out")), chunk, lambda s: F.flatten(s["out"]))
    kept = F.filter(all_, lambda x: F.char_length(x["value"]) >= least)
    return F.when(F.regexp_like(text, F.lit(pattern)), kept).otherwise(F.array().cast(spans))


def minus_log10_tail(z: Column) -> Column:
    """-log10 of the normal distribution's upper tail, by Abramowitz and Stegun's 7.1.26; 0 for z <= 0."""
    x = z / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.when(z > 0, (x * x - F.ln(poly / 2)) / F.ln(F.lit(10.0))).otherwise(0.0)


def battery(value: Column) -> Column:
    """(stratum, bin) of one candidate; stratum is null for decimal numbers and strings that are too short."""
    plain = F.regexp_replace(value, "[^A-Za-z0-9]", "")
    encoding = (
        F.when(F.regexp_like(plain, F.lit("^[0-9]*$")), F.lit(None))
        .when(F.regexp_like(value, F.lit("^([0-9a-f-]+|[0-9A-F-]+)$")), "hex")
        .when(F.regexp_like(value, F.lit("^[A-Z2-7]+=*$")), "base32")
        .when(F.regexp_like(value, F.lit("^[A-Za-z0-9]+$")), "base62")
        .otherwise("base64")
    )
    n = F.length(plain).cast("double")
    chars = F.split(plain, "")
    times = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double"))
    equal = F.aggregate(times, F.lit(0.0), lambda a, x: a + x * (x - 1) / 2)
    two = F.coalesce(*(F.when(encoding == e, F.lit(p)) for e, (p, _) in ALIKE.items()))
    three = F.coalesce(*(F.when(encoding == e, F.lit(p)) for e, (_, p) in ALIKE.items()))
    pairs = n * (n - 1) / 2
    uniform = (pairs * two - equal) / F.sqrt(pairs * two * (1 - two) + n * (n - 1) * (n - 2) * (three - two * two))
    runs = sum((F.regexp_count(plain, F.lit(p)) for p in ("[a-z]+", "[A-Z]+", "[0-9]+")), F.lit(0)) - 1
    changes = (runs - CHANGES * (n - 1)) / F.sqrt(CHANGES * (1 - CHANGES) * (n - 1))
    vowels, vowel_runs = F.regexp_count(plain, F.lit("[aeiouyAEIOUY]")), F.regexp_count(plain, F.lit("[aeiouyAEIOUY]+"))
    mean = vowels / n
    serial = F.when((mean > 0) & (mean < 1), ((vowels - vowel_runs) / (n - 1) - mean * mean) / (mean * (1 - mean))).otherwise(0.0)
    z = (uniform + changes + (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), serial)) - VOWELS) * F.sqrt(n)) / 3**0.5
    length = F.coalesce(*(F.when(n >= low, F.lit(low)) for low in reversed(LENGTHS)))
    stratum = F.when(length.isNotNull(), F.concat_ws(":", encoding, length.cast("string")))
    return F.struct(
        F.when(encoding.isNotNull(), stratum).alias("stratum"),
        F.least(F.lit(MOST_BIN), F.floor(BINS_A_POWER * minus_log10_tail(z))).cast("int").alias("bin"),
    )


def of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, base, candidates): base of (start, kind, end), candidates of (start, end, stratum, bin)."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = [of_kind(found_at(F.col("text"), p, g, least), k) for k, (_, p, g, least) in enumerate(BASE)]
    candidates = F.transform(found_at(F.col("text"), CANDIDATE, 0, 16), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), battery(x["value"]).alias("test")))
    return texts.select("doc_id", F.array_sort(F.flatten(F.array(*base))).alias("base"), F.filter(candidates, lambda x: x["test"]["stratum"].isNotNull()).alias("candidates"))


def least_bins(scans: DataFrame) -> dict[str, int]:
    """By stratum the lowest bin that Benjamini and Hochberg's rule accepts; strata are fixed in number."""
    tests = scans.select(F.explode("candidates.test").alias("t")).groupBy("t.stratum", "t.bin").count()
    of = W.partitionBy("stratum")
    ranked = tests.withColumn("upto", F.sum("count").over(of.orderBy(F.desc("bin")))).withColumn("all", F.sum("count").over(of))
    passed = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / BINS_A_POWER) <= FALSE_DISCOVERIES * F.col("upto") / F.col("all"))
    return {r.stratum: r.bin for r in passed.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, secrets), one for each row of docs: (start, kind, end) by start and kind; kind counts KINDS."""
    scans = staged(scanned(docs, id_col, text_col), "secret-scans")
    least = least_bins(scans)
    from_bin = F.lit(None).cast("int")
    accept = lambda x: F.coalesce(*(F.when(x["test"]["stratum"] == s, F.lit(b)) for s, b in sorted(least.items())), from_bin)
    touched = lambda x: F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    random = of_kind(F.filter("candidates", lambda x: (x["test"]["bin"] >= accept(x)) & ~touched(x)), len(BASE))
    return scans.select("doc_id", F.array_sort(F.concat("base", random)).alias("secrets"))


def as_text(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*(F.lit(x) for x in KINDS)), k + 1)
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda x: x["kind"] < len(BASE))

    def number(kind: int) -> Column:
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    count = [number(k) for k in range(len(KINDS))]
    return found.select("doc_id", *count[:3], F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("secrets")).alias("spans"), count[3])
