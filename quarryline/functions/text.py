"""Text expressions on columns: tokens, boundary matches, coverage, rounding, estimates."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a word in mixed case falls apart: before a capital behind a small letter, and before the last of several capitals.
CASE_BOUNDARY = r"(?<=[a-z\d])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
NOT_ALNUM = r"[^\p{L}\p{N}]"


def round_up(x: Column, digits: int = 3) -> Column:
    """Rounding with halves toward plus infinity."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / F.lit(scale)


def clamp(value: Column, low: int, high: int, default: int) -> Column:
    return F.least(F.greatest(F.coalesce(value, F.lit(default)), F.lit(low)), F.lit(high))


def like_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def regex_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def lines_of(text: Column) -> Column:
    """All lines, the empty one behind a final line break included."""
    return F.split(text, r"\r?\n", -1)


_ACCENTED = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250)}
_ACCENTED = {a: b for a, b in _ACCENTED.items() if a != b}


def tokens(text: Column) -> Column:
    """Index tokens: lower case, Latin letters without their accents, runs of letters and digits, in order."""
    plain = F.regexp_replace(F.translate(F.lower(text), "".join(_ACCENTED), "".join(_ACCENTED.values())), r"\p{M}+", "")
    return F.filter(F.split(plain, NOT_ALNUM + "+"), lambda t: t != "")


def bounded(text: Column, term: Column) -> Column:
    """Whether ``term`` stands in ``text`` between characters that are neither letters nor digits."""
    return F.regexp_like(text, F.concat(F.lit(f"(?:^|{NOT_ALNUM})"), regex_escape(term), F.lit(f"(?:$|{NOT_ALNUM})")))


def matched(text: Column, terms: Column) -> Column:
    """The terms that stand in the text, in their order.

    A term of letters and digits alone is looked up among the text's words; only others need a pattern.
    """
    words = F.split(text, NOT_ALNUM + "+")
    return F.filter(terms, lambda t: F.when(t.rlike(r"^[\p{L}\p{N}]+$"), F.array_contains(words, t)).otherwise(bounded(text, t)))


def coverage(text: Column, terms: Column) -> Column:
    return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(F.size(matched(text, terms)) / F.size(terms))


def occurrences(text: Column, needle: Column) -> Column:
    """Occurrences that don't overlap."""
    gone = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) == 0, F.lit(0)).otherwise((gone / F.length(needle)).cast("int"))


def camel_split(text: Column) -> Column:
    return F.regexp_replace(text, CASE_BOUNDARY, " ")


def squeeze(text: Column, most: int = 700) -> Column:
    """Runs of blank lines reduced to one, trimmed, cut at ``most`` characters with an ellipsis."""
    t = F.trim(F.regexp_replace(text, "\n{3,}", "\n\n"))
    t = F.regexp_replace(t, r"^\s+|\s+$", "")
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most - 1), r"\s+$", ""), F.lit("…")))


def snippet(text: Column, needles: Column, most: int = 700) -> Column:
    """The first line that holds a needle with two lines on either side; without one, the start of the text."""
    ls = lines_of(text)
    hit = F.transform(ls, lambda line: F.exists(needles, lambda n: F.contains(F.lower(line), n)))
    at = F.array_position(hit, F.lit(True))
    around = F.array_join(F.slice(ls, F.greatest(at - 2, F.lit(1)).cast("int"), F.when(at < 3, at + 2).otherwise(F.lit(5)).cast("int")), "\n")
    return squeeze(F.when(at > 0, around).otherwise(text), most)


def tokens_from_bytes(n: Column) -> Column:
    return F.floor(n / 4 + 0.5).cast("long")


def tokens_from_chars(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def first_of(pairs: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """CASE whose first true condition wins."""
    start = F.when(pairs[0][0], pairs[0][1])
    return reduce(lambda c, p: c.when(p[0], p[1]), pairs[1:], start).otherwise(otherwise)
