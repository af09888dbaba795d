"""Text functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOSING = r"""["')\]]"""
#: A sentence goes from its first visible character to a terminator with closing quotes, before white space; it has
#: 12 characters at least, so that short ones merge into the next. Where the terminator comes early, quotes make up for it.
_EARLY = "|".join(rf"\S[\s\S]{{{p}}}[.!?]{_CLOSING}{{{10 - p},}}(?=\s)" for p in range(10))
#: Group 1: a sentence. Else group 2: what is left, to the end, which is then not searched again from every character on.
SENTENCE = rf"(?U)((?:{_EARLY}|\S[\s\S]{{10,}}?[.!?]{_CLOSING}*(?=\s)))|(\S[\s\S]*\z)"


def strip(x: Column) -> Column:
    """Without white space at either end, in Unicode's sense."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def trim_blanks(x: Column) -> Column:
    """Without blanks at either end; tabs and line ends stay."""
    return F.regexp_replace(x, r"^\p{Zs}+|\p{Zs}+\z", "")


def collapse(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def not_blank(x: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(x, F.lit(""))


def preview(x: Column, most: int = 120) -> Column:
    return F.substring(x, 1, most)


def ellipsis(x: Column, most: int = 60) -> Column:
    return F.concat(F.substring(x, 1, most), F.when(F.length(x) > most, "…").otherwise(""))


def sentences(x: Column) -> Column:
    """Finished sentences; what is left is the tail."""
    return F.filter(F.regexp_extract_all(x, F.lit(SENTENCE), F.lit(1)), lambda s: s != "")


def tail(x: Column) -> Column:
    return strip(F.regexp_replace(x, SENTENCE, "$2"))


def _openings(x: Column) -> tuple[Column, Column]:
    """A clause of 14 characters and its end mark, and 22 characters and what else the word has; both before white space, empty if there is none."""
    return F.regexp_extract(x, r"(?U)^([\s\S]{14,}?[,;:—-])\s", 1), F.regexp_extract(x, r"(?U)^([\s\S]{22,}?\S)\s", 1)


def opening(x: Column) -> Column:
    """The first fragment worth speaking of a text without a finished sentence: a clause if there is one, else words enough."""
    return F.when(F.size(sentences(x)) > 0, None).otherwise(F.coalesce(*(not_blank(strip(o)) for o in _openings(x))))


def spoken(x: Column) -> Column:
    """The fragments in which a text is spoken as it arrives word by word: an opening, if one is there before the first sentence, the sentences, the rest."""
    text = F.regexp_replace(x, r"(?U)^\s+", "")
    clause, words = (not_blank(o) for o in _openings(text))
    first = F.when(F.coalesce(F.length(clause) < F.length(words), words.isNull()), clause).otherwise(words)
    sentence = F.try_element_at(sentences(text), F.lit(1))
    taken = F.when(sentence.isNull() | (F.length(first) < F.length(sentence)), first)
    rest = F.coalesce(F.substring(text, F.length(taken) + 1, F.length(text)), text)
    return F.concat(F.array_compact(F.array(strip(taken))), sentences(rest), F.array_compact(F.array(not_blank(tail(rest)))))


def tokens(x: Column) -> Column:
    """Words with the blanks after them; a text without words is one token."""
    found = F.regexp_extract_all(x, F.lit(r"\S+\s*"), F.lit(0))
    return F.when(F.size(found) > 0, found).otherwise(F.array(x))


def listed(x: Column) -> Column:
    """A comma-separated setting as an array, without blanks."""
    return F.filter(F.transform(F.split(x, ","), strip), lambda p: p != "")


def origins(x: Column) -> Column:
    """A listed setting of allowed origins, of which * is one by itself."""
    return F.when(strip(x) == "*", F.array(F.lit("*"))).otherwise(listed(x))


def joined(*parts: Column) -> Column:
    """What is there of the parts, with blanks between."""
    return F.concat_ws(" ", *(not_blank(p) for p in parts))
