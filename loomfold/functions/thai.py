"""Normal form of Thai text: private-use marks, composition, spaces before marks, order of marks."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfold.functions.text import squeeze

#: Private-use marks of the documents' fonts, and the marks they show.
FONT_MARKS = {
    "\uf701": "\u0e34", "\uf702": "\u0e35", "\uf703": "\u0e36", "\uf705": "\u0e48", "\uf706": "\u0e49", "\uf709": "\u0e4c", "\uf70a": "\u0e48",
    "\uf70b": "\u0e49", "\uf70c": "\u0e47", "\uf70e": "\u0e4c", "\uf710": "\u0e31", "\uf712": "\u0e47", "\uf713": "\u0e48",
}
_MARK = "ัิ-ฺ็-๎"
_RUN = re.compile(f"(?<=[^{_MARK}])[{_MARK}]{{2,}}")


def mark_class(c: str) -> int:
    """Where a mark stands behind its letter: vowels below, vowels above, tone marks, other signs."""
    return 1 if c in "ฺุู" else 3 if c in "่้๊๋" else 4 if c in "์ํ๎" else 2


def font_marks(c: Column) -> Column:
    """Private-use marks as Thai marks."""
    return F.translate(c, "".join(FONT_MARKS), "".join(FONT_MARKS.values()))


def unmapped_font_marks(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, code_point, n)`` of private-use marks without a known meaning."""
    found = df.select(key, F.explode(F.regexp_extract_all(font_marks(F.col(text)), F.lit("([\uf700-\uf71a])"), F.lit(1))).alias("c"))
    return found.groupBy(key, F.hex(F.encode("c", "UTF-16BE")).alias("code_point")).agg(F.count("*").alias("n"))


def close_marks(c: Column) -> Column:
    """Without spaces between a Thai sign and a mark; a run of spaces goes at once."""
    return F.regexp_replace(c, f"(?<=[฀-๿])[  \t]+(?=[{_MARK}])", "")


def violations(c: Column) -> Column:
    """How many marks still have white space before them."""
    return F.regexp_count(c, F.lit(f"[฀-๿]\\s+[{_MARK}]"))


def ordered(text: str) -> str:
    """Marks of one letter in order of their class, those of a class as they came."""
    return _RUN.sub(lambda m: "".join(sorted(m.group(), key=mark_class)), text)


@F.pandas_udf(T.StringType())
def composed(c: pd.Series) -> pd.Series:
    """Composed characters: there is no built-in for it, so whole Arrow batches go through Python."""
    return c.str.normalize("NFC")


@F.pandas_udf(T.StringType())
def composed_and_ordered(c: pd.Series) -> pd.Series:
    """Composed characters and marks in order, in one pass."""
    return c.map(lambda t: None if t is None else t if t.isascii() else ordered(unicodedata.normalize("NFC", t)))


def normal_text(c: Column) -> Column:
    """Private-use marks replaced, composed, marks closed up and in order; white space elsewhere stays."""
    return composed_and_ordered(close_marks(font_marks(c)))


def normal_for_comparison(c: Column) -> Column:
    """``normal_text`` with white space squeezed."""
    return squeeze(normal_text(c))


def sign_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, sign, n)``: how often each sign but white space occurs."""
    signs = df.select(key, F.explode(F.split(F.regexp_replace(text, r"\s", ""), "")).alias("sign")).filter("sign <> ''")
    return signs.groupBy(key, "sign").agg(F.count("*").alias("n"))
