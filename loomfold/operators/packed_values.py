"""Several values packed in one field: one row per value with its position.

The cell is split at its quotes, and at codes, credits and brackets, which stand
for themselves as quoted texts do.  Odd pieces are literals; even pieces are cut
at delimiters; folding the array of pieces into one text again shows what stands
between two literals, and the cuts in it give the values with their ordinals.
Everything is built-in SQL, so a row never leaves the JVM and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The forms of codes, credits, units and joining words in the cells.
CODE = r"(?<![A-Za-z\p{N}])(?:\d{8}|\d{5}[xX]{3})(?![A-Za-z\p{N}])"
REMARK = r"[ \t ]*(?:\([^()\[\]\r\n]*\)|\[[^()\[\]\r\n]*\])"
UNIT = r"(?:หน่วยกิต|นก\.?|credits?(?![A-Za-z])|cr\.?(?![A-Za-z]))"
CREDITS = (
    r"(?<![A-Za-z\p{N}])\d{1,2}[ \t ]*(?:\([ \t]*\d{1,3}[ \t]*-[ \t]*\d{1,3}[ \t]*-[ \t]*\d{1,3}[ \t]*\)"
    rf"(?:[ \t ]*(?i:{UNIT}))?|[ \t ]*(?i:{UNIT}))"
)
JOINER = r"หรือ|และ|กับ|(?<![A-Za-z])(?i:or|and)(?![A-Za-z])"
#: Straight quotes may hold doubled ones; a single quote inside a word is no quote.
QUOTED = r'"(?:[^"]|"")*"|“[^”]*”|„[^”“]*[”“]|«[^»]*»|‘[^’]*’|(?<![A-Za-z\p{N}])\'[^\'\r\n]*\'(?![A-Za-z\p{N}])'
BULLET = r"(?:(?<=[\r\n;|])|(?<![\s\S]))[ \t ]*(?:\(?(?:\d{1,2}|[๐-๙]{1,2})[.)](?=[ \t ]|[\"“'‘(]|\d{8}|\d{5}[xX]{3})|[-–•*·▪●‣](?=[ \t ]))"

_GROUPING = rf"\((?=[ \t(\[]*(?:[\"“„«‘']|(?:\d{{8}}|\d{{5}}[xX]{{3}})(?![A-Za-z\p{{N}}])|\d{{1,2}}[ \t]*\(\d))"
#: A word of letters and digits goes before; a Thai joining word may stand between.
_FRESH = r"(?:(?<![\p{L}\p{M}\p{N}])|(?<=หรือ)|(?<=และ))"
#: What stands as it is: quoted texts, codes, credits, and brackets that do not group codes.
LITERAL = "|".join(
    [
        rf"(?:{QUOTED})(?:(?<=[\"”»’'])[ \t]*(?!{_GROUPING})(?:\([^()\[\]\r\n]*\)|\[[^()\[\]\r\n]*\]))?",
        rf"{_FRESH}{CODE}(?:{REMARK})?",
        rf"{_FRESH}{CREDITS}",
        rf"(?!{_GROUPING})\([^()\r\n]*\)|\[[^\[\]\r\n]*\]",
    ]
)
_SIGNS = " \t\n\r\x0b\f\u00a0\u3000,，、/\\·&+()[]"
_SIGN = r"[\s\u00a0\u3000,，、/\\·&+()\[\]]"
_DASHES = "-–•*▪●‣"
_WHITE = " \t\n\r\x0b\f\u00a0\u3000"
#: Marks put into the cell: around literals, between values, around values that stand apart, around brackets.
_CUT, _NEXT, _ITEM, _END, _OPEN, _CLOSE = "\x01\x02\x03\x04\x05\x06"


def _unquoted(value: Column) -> Column:
    """A trimmed value, without outer quotes where it is one quoted text."""
    inner = F.regexp_replace(F.substring(value, 2, 100_000_000), r"(?s).$", "")
    inner = F.when(value.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(inner)
    return F.when(F.substring(value, 1, 1).isin(*"\"“„«‘'") & value.rlike(rf"(?s)^(?:{QUOTED})$"), F.btrim(inner, F.lit(_WHITE))).otherwise(value)


def _literal(piece: Column) -> Column:
    """An odd piece: a bracket belongs to the text around it, all others are values of their own."""
    first = F.substring(piece, 1, 1)
    return F.when(first.isin("(", "["), F.concat(F.lit(_OPEN), piece, F.lit(_CLOSE))).otherwise(F.concat(F.lit(_ITEM), piece, F.lit(_END)))


def _between(piece: Column, first: Column) -> Column:
    """An even piece: line breaks, semicolons and bars, with the bullet behind them, become cuts."""
    start = F.when(first, F.concat(F.lit("\n"), piece)).otherwise(piece)
    return F.when(start.rlike(r"[\r\n;；|｜]"), F.regexp_replace(F.regexp_replace(start, BULLET, _NEXT), r"[\r\n;；|｜]+", _NEXT)).otherwise(start)


def packed_values(cell: Column) -> Column:
    """The values of a cell, in order.

    Null, empty and blank cells, and cells of dividers only, give an empty
    array; equal values are kept.  Every step is one pass over the cell,
    however long it is.
    """
    # control characters of the cell would be taken for the marks
    marked = F.regexp_replace(F.translate(cell, "\x01\x02\x03\x04\x05\x06", ""), f"(?=[\"“„«‘'(\\[\\d])({LITERAL})", f"{_CUT}$1{_CUT}")
    pieces = F.transform(F.split(marked, _CUT), lambda p, i: F.when(i % 2 == 1, _literal(p)).otherwise(_between(p, i == 0)))
    whole = F.array_join(pieces, "")
    # signs, white space and joining words divide where they stand between two values
    apart = F.regexp_replace(whole, rf"{_END}(?:{_SIGN}|[{_DASHES}]|{JOINER})*+{_ITEM}", f"{_END}{_NEXT}{_ITEM}")
    values = F.transform(F.split(apart, _NEXT), lambda v: F.btrim(v, F.lit(_SIGNS + _DASHES)))
    values = F.filter(F.transform(values, _stripped), lambda v: v != "")
    # a step a transform: a lambda's variable is a value, an expression used twice would be taken twice
    values = F.transform(F.transform(values, lambda v: F.btrim(F.translate(v, _ITEM + _END + _OPEN + _CLOSE, ""), F.lit(_WHITE))), _unquoted)
    return F.coalesce(F.filter(values, lambda v: v != ""), F.array().cast("array<string>"))


def _stripped(value: Column) -> Column:
    """A value without the joining words around it and the signs between them."""
    around = rf"(?:{_SIGN}|[{_DASHES}])*+"
    v = F.when(value.rlike(rf"^(?:{JOINER})"), F.regexp_replace(value, rf"^(?:{around}(?:{JOINER}))+{around}", "")).otherwise(value)
    return F.when(value.rlike(rf"(?:{JOINER})$"), F.regexp_replace(v, rf"(?:(?:{JOINER}){around})+$", "")).otherwise(v)


def explode_packed(df: DataFrame, key: str, fields: Sequence[str], least: int = 2) -> DataFrame:
    """One row ``(key, field, pos, value)`` for each value of each cell with at
    least ``least`` values; ``pos`` counts from 1.

    Cells that are null, empty or blank give no row.  Repeated rows of the
    input give repeated rows here; an empty table gives none.  Only ``key`` and
    ``fields`` are read, so columns of any other name cannot clash.
    """
    cells = df.select(
        F.col(key).alias("_key"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("cell")) for f in fields])).alias("_c"),
    )
    # most cells hold one plain code, one credits text or one word: they need no parsing
    single = F.col("_c.cell").rlike(r"^(?:\s*|\d{8}|\d{5}xxx|\d\(\d{1,2}-\d{1,2}-\d{1,2}\)|[\p{L}\p{M}]+|-)$")
    wide = cells.filter(F.col("_c.cell").isNotNull() & (F.lit(least > 1) & ~single | F.lit(least <= 1)))
    # the array is bound once; an outer explode keeps the optimizer from taking it again to look for empty ones
    enough = F.transform(F.array(packed_values(F.col("_c.cell"))), lambda v: F.when(F.size(v) >= least, v))
    return wide.select(F.col("_key").alias(key), "_c.field", F.posexplode_outer(F.get(enough, F.lit(0))).alias("pos", "value")).filter("pos IS NOT NULL").select(
        key, "field", (F.col("pos") + 1).cast("int").alias("pos"), "value"
    )
