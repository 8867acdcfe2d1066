"""Text expressions on columns: keys, counts, tokens, codes, versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thai marks left out of a match key, and tone marks alone.
MARKS = "ัิีึืฺุู็่้๊๋์ํ๎"
TONES = "่้๊๋์"
#: A code of eight digits that no letter, digit or underscore touches; Thai marks may touch it.
CODE = r"(?<![\p{L}\p{N}_])\p{Nd}{8}(?![\p{L}\p{N}_])"


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def without(c: Column, chars: str) -> Column:
    """The text without the given characters."""
    return F.translate(c, chars, "")


def match_key(c: Column) -> Column:
    """Lower case, without Thai marks and white space."""
    return F.lower(F.regexp_replace(without(c, MARKS), r"\s", ""))


def name_key(c: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(c, r"\s", ""))


def occurrences(c: Column, term: str) -> Column:
    """How often a term occurs without overlap; 0 for a null text."""
    return F.coalesce(((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / len(term)).cast("int"), F.lit(0))


def term_count(c: Column, terms: Sequence[str]) -> Column:
    """Sum of the occurrences of all terms."""
    total = F.lit(0)
    for t in terms:
        total = total + occurrences(c, t)
    return total


def words(c: Column) -> Column:
    """Runs of Thai letters, Latin letters or digits, in lower case and order."""
    return F.regexp_extract_all(F.lower(c), F.lit("([ก-๙]+|[a-z]+|[0-9]+)"), F.lit(1))


def leading_int(c: Column) -> Column:
    """The digits at the beginning, 0 where there are none."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^\s*(\d{1,9})", 1), F.lit("")).cast("int"), F.lit(0))


def hash_parts(*parts: Column) -> Column:
    """sha256 of the parts joined by the unit separator."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def question_key(c: Column) -> Column:
    """A question in lower case, squeezed, without end marks."""
    return F.regexp_replace(squeeze(F.lower(c)), r"[?。.]+$", "")


def out_of_charset(c: Column, declared: str) -> Column:
    """Share of the signs outside a declared class of characters; 0 where there are none."""
    solid = F.regexp_replace(c, r"\s", "")
    return F.when(F.length(solid) == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(solid, f"[{declared}]", "")) / F.length(solid))
