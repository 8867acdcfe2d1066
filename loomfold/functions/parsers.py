"""Parsers of credits and prerequisites."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of the two formats.
MOST_CREDITS, MOST_TEXT, MOST_CODES, MOST_DEPTH, MOST_CODE = 30, 500, 20, 3, 20
_FORM = r"^(\d+)\((\d+)-(\d+)-(\d+)\)$"
#: The longest beginning that may still become valid; its length is the place of the first wrong sign.
_BEGIN = r"^(?:\d+(?:\((?:\d+(?:-(?:\d+(?:-(?:\d+(?:\))?)?)?)?)?)?)?)?"


def credits(raw: Column) -> Column:
    """A struct ``ok, total, lecture, lab, self_study, error_index`` of ``total(lecture-lab-self_study)``.

    Values above 30 fail at the value's place, other texts at the first wrong
    sign, an empty text at 0; null stays null.  Built-in expressions only.
    """
    part = [F.regexp_extract(raw, _FORM, i + 1) for i in range(4)]
    number = [F.nullif(p, F.lit("")).cast("decimal(38,0)") for p in part]
    fits = raw.rlike(_FORM)
    start = [F.lit(0)]
    for p in part[:3]:
        start.append(start[-1] + F.length(p) + 1)
    bad = F.lit(None).cast("int")
    for n, s in reversed(list(zip(number, start, strict=True))):
        bad = F.when(n > MOST_CREDITS, s).otherwise(bad)
    ok = fits & bad.isNull()
    value = [F.when(ok, n.cast("int")) for n in number]
    return F.when(
        raw.isNotNull(),
        F.struct(
            ok.alias("ok"), *[v.alias(n) for v, n in zip(value, ("total", "lecture", "lab", "self_study"), strict=True)],
            F.when(~fits, F.length(F.regexp_extract(raw, _BEGIN, 0))).otherwise(bad).alias("error_index"),
        ),
    )


def print_credits(total: Column, lecture: Column, lab: Column, self_study: Column) -> Column:
    """The canonical text of credits."""
    return F.format_string("%d(%d-%d-%d)", total, lecture, lab, self_study)


_SIGN = re.compile(r"[()]|(?:และ|หรือ)(?=[ ()]|$)|(?i:and|or)(?![^\W_])|[^ ()]")
_NAMES = {"และ": "and", "หรือ": "or", "and": "and", "or": "or"}
_JOIN = {"and": " และ ", "or": " หรือ "}


class _Wrong(Exception):
    def __init__(self, at: int, why: str):
        super().__init__(why)
        self.at, self.why = at, why


def _tokens(text: str) -> Iterator[tuple[str, str, int]]:
    """``(kind, text, place)``: brackets, joining words, and codes, the runs between them."""
    code, start = "", 0
    end = 0
    for m in _SIGN.finditer(text):
        s = m.group()
        kind = _NAMES.get(s.lower()) or (s if s in "()" else "code")
        if code and (kind != "code" or m.start() > end):
            yield "code", code, start
            code = ""
        if kind == "code":
            if not code:
                start = m.start()
            code += s
        else:
            yield kind, s, m.start()
        end = m.end()
    if code:
        yield "code", code, start
    yield "end", "", len(text)


def _show(node: tuple, above: str = "") -> str:
    if node[0] == "code":
        return node[1]
    inner = _JOIN[node[0]].join(_show(c, node[0]) for c in node[1])
    return f"({inner})" if node[0] == "or" and above == "and" else inner


def _measure(node: tuple) -> tuple[list[str], int]:
    if node[0] == "code":
        return [node[1]], 0
    parts = [_measure(c) for c in node[1]]
    return [c for codes, _ in parts for c in codes], 1 + max(d for _, d in parts)


def parse_prerequisite(text: str) -> tuple:
    """``(ok, canonical, codes, depth, error_index, reason)``; "and" binds tighter than "or".

    Blank texts, a dash and the Thai word for none have no codes and an empty canonical text.
    """
    if len(text) > MOST_TEXT:
        return False, None, [], None, MOST_TEXT, "too long"
    if text.strip() in ("", "-", "ไม่มี"):
        return True, "", [], 0, None, None
    # one frame for each open bracket: alternatives, each a list of conditions
    frames: list[list[list[tuple]]] = [[[]]]
    wanted = True
    try:
        for kind, value, at in _tokens(text):
            if wanted:
                if kind == "(":
                    frames.append([[]])
                elif kind == "code":
                    if len(value) > MOST_CODE:
                        raise _Wrong(at, "code too long")
                    frames[-1][-1].append(("code", value))
                    wanted = False
                else:
                    raise _Wrong(at, {"end": "unexpected end", ")": "unexpected bracket"}.get(kind, "code expected"))
            elif kind == "or":
                frames[-1].append([])
                wanted = True
            elif kind == "and":
                wanted = True
            elif kind == ")" and len(frames) > 1:
                frames[-2][-1].append(_fold(frames.pop()))
            elif len(frames) > 1:
                raise _Wrong(at, "closing bracket expected")
            elif kind != "end":
                raise _Wrong(at, "unexpected characters")
    except _Wrong as e:
        return False, None, [], None, e.at, e.why
    tree = _fold(frames[0])
    codes, depth = _measure(tree)
    if len(codes) > MOST_CODES:
        return False, None, [], None, 0, "too many codes"
    if depth > MOST_DEPTH:
        return False, None, [], None, 0, "too deep"
    return True, _show(tree), codes, depth, None, None


def _fold(alternatives: list[list[tuple]]) -> tuple:
    ands = [a[0] if len(a) == 1 else ("and", a) for a in alternatives]
    return ands[0] if len(ands) == 1 else ("or", ands)


_RESULT = T.StructType(
    [
        T.StructField("ok", T.BooleanType()), T.StructField("canonical", T.StringType()), T.StructField("codes", T.ArrayType(T.StringType())),
        T.StructField("depth", T.IntegerType()), T.StructField("error_index", T.IntegerType()), T.StructField("reason", T.StringType()),
    ]
)


@F.pandas_udf(_RESULT)
def prerequisite(raw: pd.Series) -> pd.DataFrame:
    """The parse of each text, by Arrow batches: the grammar is recursive, which no built-in expresses.  Null counts as empty."""
    rows = [parse_prerequisite(t if isinstance(t, str) else "") for t in raw]
    out = pd.DataFrame(rows, columns=[f.name for f in _RESULT.fields])
    for c in ("depth", "error_index"):
        out[c] = out[c].astype("Int32")
    return out
