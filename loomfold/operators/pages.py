"""Pages: quality scores and routes, chunks, tables, plan context, glyph order."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfold.functions.thai import mark_class

#: Weights and limits of the page score and route.
WEIGHTS = (0.45, 0.20, 0.20, 0.15)
FULL_CHARS, FULL_TERMS, DEEP_IMAGES, FAST_IMAGES = 1200, 12, 0.60, 0.30
#: Sizes of chunks.
SMALL, LARGE, TARGET = 50, 1200, 600
#: Openings of headings.
HEADINGS = [
    r"(?:หมวดวิชา|หมวดที่|ส่วนที่)\s*\S",
    r"(?:ปีที่|ปีการศึกษาที่|ภาคการศึกษาที่|ภาคเรียนที่)\s*\d",
    r"(?:\d{1,2}\.\d+(?:\.\d+)*|\d{1,2}\.)\s+\S",
    r"(?:บทที่|ภาคผนวก|ตารางที่|แผนการศึกษา|โครงสร้างหลักสูตร|คุณสมบัติ|เกณฑ์|ระบบ|อาจารย์|ข้อกำหนด|วัตถุประสงค์|ปรัชญา|ความสำคัญ|วิสัยทัศน์|พันธกิจ)",
    r"(?i:Chapter|Section|Part|Table|Appendix|Program|Curriculum)\s",
]
HEADING = re.compile("|".join(HEADINGS))
#: Words in the headers of tables.
HEADER_WORDS = ("รหัสวิชา", "ชื่อวิชา", "หน่วยกิต", "code", "course", "credit", "รหัส", "ชื่อ", "ภาคเรียน", "ปี", "หมวดวิชา", "ประเภท", "วิชาบังคับก่อน", "หมายเหตุ", "ลำดับ", "no", "#", "รวม", "total")
_CELLS = re.compile(r"\t|  {2,}|\|")


def page_score(chars: Column, out_of_charset: Column, images: Column, terms: Column) -> Column:
    """Quality of a page from 0 to 1."""
    a, b, c, d = WEIGHTS
    raw = a * F.least(chars / FULL_CHARS, F.lit(1.0)) + b * (1 - out_of_charset) + c * (1 - images) + d * F.least(terms / FULL_TERMS, F.lit(1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def page_route(chars: Column, images: Column) -> Column:
    """``deep``, ``fast`` or ``standard``; null images count as none."""
    i = F.coalesce(images, F.lit(0.0))
    return F.when(chars == 0, "deep").when(i >= DEEP_IMAGES, "deep").when(i <= FAST_IMAGES, "fast").otherwise("standard")


def _sections(text: str) -> Iterator[tuple[str, str]]:
    """``(heading, text)``: a heading opens a section and belongs to it."""
    title, held = "", []
    for line in text.split("\n"):
        s = line.strip()
        if s and HEADING.match(s):
            if held:
                yield title, "\n".join(held).strip()
            title, held = s[:120].rstrip(), []
        held.append(line)
    yield title, "\n".join(held).strip()


def _joined(parts: Iterable[str], sep: str) -> Iterator[str]:
    """Neighbours put together as long as they stay within the limit."""
    held = ""
    for p in parts:
        if held and len(held) + len(sep) + len(p) <= LARGE:
            held += sep + p
        else:
            if held.strip():
                yield held
            held = p
    if held.strip():
        yield held


def chunk_page(text: str) -> list[tuple[str, str]]:
    """``(heading, text)`` chunks of a page: sections, small ones joined with the next, large ones
    cut at paragraphs, then lines, then every ``TARGET`` characters.  A blank page has none."""
    merged: list[list[str]] = []
    for title, body in _sections(text):
        if not body:
            continue
        if merged and len(merged[-1][1]) < SMALL and len(merged[-1][1]) + len(body) + 1 <= LARGE:
            merged[-1] = [merged[-1][0] or title, merged[-1][1] + "\n" + body]
        else:
            merged.append([title, body])
    out = []
    for title, body in merged:
        if len(body) <= LARGE:
            out.append((title, body))
            continue
        for block in _joined((p.strip() for p in re.split(r"\n\s*\n", body) if p.strip()), "\n\n"):
            for piece in [block] if len(block) <= LARGE else _joined(block.split("\n"), "\n"):
                cuts = [piece] if len(piece) <= LARGE else [piece[i : i + TARGET] for i in range(0, len(piece), TARGET)]
                out.extend((title, c) for c in cuts if c.strip())
    return out


def chunk_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, ord, heading, text, sha256)`` of all chunks; the greedy joining is order-bound, so a page is cut by one pass over Arrow batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, h, t) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, (h, t) in enumerate(chunk_page(text or ""))]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], ["page_id", "ord", "heading", "text"])

    cut = pages.select(F.col("page_id").cast("long"), "page_text").filter("page_text IS NOT NULL").mapInArrow(run, "page_id long, ord int, heading string, text string")
    return cut.withColumn("sha256", F.sha2("text", 256))


def _is_header(cells: list[str]) -> bool:
    joined = " ".join(cells).lower()
    return len(cells) >= 2 and any(w in joined for w in HEADER_WORDS)


def page_tables(text: str) -> Iterator[tuple[int, int, int, str, bool]]:
    """``(table, row, column, text, header)`` of the tables of a page, all from 1: a header, more headers, rows up to a blank or single-cell line.
    Missing cells at the end of a row are empty; a table without rows is none."""
    found = 0
    held: list[tuple[list[str], bool]] = []

    def close() -> Iterator[tuple[int, int, int, str, bool]]:
        nonlocal found
        if any(not h for _, h in held):
            found += 1
            width = len(held[0][0])
            for r, (cells, h) in enumerate(held, 1):
                for c in range(width):
                    yield found, r, c + 1, cells[c] if c < len(cells) else "", h
        held.clear()

    for line in text.split("\n"):
        cells = [c.strip() for c in _CELLS.split(line)]
        body = any(not h for _, h in held)
        if held and line.strip() and len(cells) >= 2:
            held.append((cells, not body and _is_header(cells)))
            continue
        yield from close()
        if _is_header(cells):
            held.append((cells, True))
    yield from close()


def table_cells(pages: DataFrame) -> DataFrame:
    """``(page_id, table_index, row_index, col_index, text, header)`` of all pages."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *cell) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for cell in page_tables(text or "")]
            cols = list(zip(*rows, strict=True)) or [[], [], [], [], [], []]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["page_id", "table_index", "row_index", "col_index", "text", "header"])

    return pages.select(F.col("page_id").cast("long"), "page_text").filter("page_text IS NOT NULL").mapInArrow(run, "page_id long, table_index int, row_index int, col_index int, text string, header boolean")


def shape_violations(cells: DataFrame) -> DataFrame:
    """Rows of a table with another number of cells than its first row."""
    rows = cells.groupBy("page_id", "table_index", "row_index").agg(F.count("*").alias("n"))
    first = rows.filter("row_index = 1").select("page_id", "table_index", F.col("n").alias("expected"))
    return rows.join(first, ["page_id", "table_index"]).filter("n <> expected")


def plan_context(text: Column) -> Column:
    """A struct ``year, semester``: set where the text names exactly one of 1 to 8 years, one of 1 to 3 semesters."""
    years = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:ชั้นปีที่|ปีที่|ปีการศึกษาที่|[Yy]ear)\s*([1-8])(?!\d)"), F.lit(1)))
    terms = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:ภาคการศึกษาที่|ภาคเรียนที่|ภาคที่|[Ss]emester)\s*([1-3])(?!\d)"), F.lit(1)))
    one = lambda a: F.when(F.size(a) == 1, a[0].cast("int"))
    return F.struct(one(years).alias("year"), one(terms).alias("semester"))


_MARK_CLASS = {c: mark_class(c) for c in "ัิีึืฺุู็่้๊๋์ํ๎"}
GLYPHS = "page_id long, codepoint string, x0 double, x1 double, baseline double, font_size double, ord int"


def _lines(page: pd.DataFrame) -> pd.DataFrame:
    """Lines of one page from its glyphs: a mark goes to the nearest letter of its line, letters go by place."""
    page = page.sort_values("ord", kind="stable")
    mark = (page.codepoint.isin(_MARK_CLASS) & (page.x1 - page.x0 <= 0.5)).to_numpy()
    letters = page[~mark]
    if letters.empty:
        return pd.DataFrame({"page_id": [], "line": [], "text": []})
    x0, baseline, size, order = (letters[c].to_numpy() for c in ("x0", "baseline", "font_size", "ord"))
    solid = np.array([c.strip() != "" for c in letters.codepoint])
    hung: dict[int, list[tuple[int, int, str]]] = {}
    for c, x, b, o in page.loc[mark, ["codepoint", "x0", "baseline", "ord"]].itertuples(index=False, name=None):
        near = np.flatnonzero((abs(baseline - b) <= 0.2 * size) & (abs(x0 - x) <= 1.5 * size) & solid)
        if len(near):
            hung.setdefault(min(near, key=lambda k, x=x: (abs(x0[k] - x), x0[k], order[k], k)), []).append((_MARK_CLASS[c], o, c))
    text = [c + "".join(x[2] for x in sorted(hung.get(i, []))) for i, c in enumerate(letters.codepoint)]
    anchor, lines = None, []
    for i in np.lexsort((order, x0, baseline)):
        if anchor is None or abs(baseline[i] - anchor) > 0.5 * size[i]:
            anchor = baseline[i]
            lines.append([])
        lines[-1].append(i)
    out = ["".join(text[i] for i in sorted(at, key=lambda i: (x0[i], order[i]))) for at in lines]
    out = [t for t in out if t.strip()]
    return pd.DataFrame({"page_id": int(page.page_id.iloc[0]), "line": np.arange(len(out), dtype="int32"), "text": out})


def assemble_lines(glyphs: DataFrame) -> DataFrame:
    """``(page_id, line, text)`` from positioned glyphs.  A page is one group: it is bounded by what fits on paper."""
    return glyphs.groupBy("page_id").applyInPandas(_lines, "page_id long, line int, text string")


def header_segments(lines: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """``segment``: the number of headings up to each line."""
    heading = F.trim(text).rlike("^(?:" + HEADING.pattern + ")")
    return lines.withColumn("segment", F.sum(heading.cast("int")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
