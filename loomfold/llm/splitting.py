"""Cutting of oversized items at natural boundaries, with overlap.

Every end of a paragraph, line, sentence and word of a text goes into sorted
arrays of offsets.  A piece begins at some offset; binary search finds the last
boundary of the strongest kind within the limit, a hard cut follows where there
is none; the next piece steps back by the overlap to a word's beginning.
Whole texts are worked on, one row at a time, inside the scan's tasks.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 1_200
OVERLAP = 120
#: A boundary of a stronger kind wins only when the piece is at least so full, else a weaker one that fills it better.
FULL = 0.5
_GAP = re.compile(r"(?P<para>[^\S\n]*\n[^\S\n]*(?:\n[^\S\n]*)+)|(?P<line>[^\S\n]*\n[^\S\n]*)|(?P<sent>(?<=[.!?…ฯ])[\"'”’)\]]*[^\S\n]+)|(?P<word>[^\S\n]+)")
_KINDS = ("para", "line", "sent", "word")


def boundaries(text: str) -> dict[str, list[int]]:
    """Offsets after each gap, by kind; an end of a paragraph also ends a line, a sentence and a word."""
    out: dict[str, list[int]] = {k: [] for k in _KINDS}
    for m in _GAP.finditer(text):
        for k in _KINDS[_KINDS.index(m.lastgroup) :]:
            out[k].append(m.end())
    return out


def _joins(c: str) -> bool:
    return unicodedata.category(c) in ("Mn", "Mc", "Me", "Cf") or c in "ำาๅ"


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP, prefix: list[int] | None = None) -> list[tuple[int, int]]:
    """``(start, end)`` of consecutive pieces of ``text``, each of at most ``limit``.

    Sizes are characters; with ``prefix``, the sums of the sizes of all characters
    from 0 on, they are what it counts (tokens, say).  An item within the limit is
    one piece, an empty one none.  Each piece begins at most ``overlap`` before the
    end of the one before, and ends behind it.
    """
    n = len(text)
    at = prefix or range(n + 1)
    if not n:
        return []
    if at[n] <= limit:
        return [(0, n)]
    marks = boundaries(text)
    out: list[tuple[int, int]] = []
    start, done = 0, 0
    while True:
        # the last offset within the limit; one character is taken even if it alone exceeds it
        top = max(bisect_right(at, at[start] + limit) - 1, done + 1)
        if top >= n:
            out.append((start, n))
            return out
        floor = max(done, bisect_left(at, at[start] + limit * FULL))
        end = 0
        for least in (floor, done):
            for k in _KINDS:
                i = bisect_right(marks[k], top) - 1
                if i >= 0 and marks[k][i] > least:
                    end = marks[k][i]
                    break
            if end:
                break
        if not end:
            end = top
            while end > done + 1 and end > top - 16 and _joins(text[end]):
                end -= 1
        out.append((start, end))
        done = end
        back = bisect_left(at, at[end] - overlap)
        i = bisect_left(marks["word"], back)
        words = marks["word"]
        if i < len(words) and words[i] < end and at[end] - at[words[i]] >= overlap / 2:
            start = words[i]
        else:
            while back < end and back > 0 and _joins(text[back]):
                back += 1
            start = back
        if start >= end and overlap:
            start = max(back, end - 1)


def sized(text: Column, heading: Column | None = None) -> Column:
    """The text with its heading in front, where it has one; null texts count as empty."""
    body = F.coalesce(text, F.lit(""))
    return body if heading is None else F.when(F.coalesce(heading, F.lit("")) == "", body).otherwise(F.concat(heading, F.lit("\n"), body))


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(src, item_id, piece, start, end, text)`` for ``items`` with ``src, item_id, text``.

    Only items above the limit come out, each with at least two pieces; ``piece``
    counts from 1, ``start`` and ``end`` are offsets in characters.  Null and empty
    texts are no items; repeated rows are split each on its own.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("src", "item_id", "piece", "start", "end", "text")}
            n = 0
            for src, item, text in zip(*(batch.column(c).to_pylist() for c in ("src", "item_id", "text")), strict=True):
                for i, (a, b) in enumerate(spans(text, limit, overlap), 1):
                    for k, v in zip(rows, (src, item, i, a, b, text[a:b]), strict=True):
                        rows[k].append(v)
                    n += b - a
                if n > 4_000_000:
                    yield _batch(rows)
                    rows, n = {k: [] for k in rows}, 0
            yield _batch(rows)

    return items.select("src", "item_id", "text").filter(F.length("text") > limit).mapInArrow(run, "src string, item_id long, piece int, start int, end int, text string")


def _batch(rows: dict[str, list]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], list(rows))
