"""Courses, requirements and field records out of page and chunk texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfold.functions import parsers
from loomfold.functions.text import CODE, squeeze

#: Forms in course lists.
_CREDITS = r"(\d)\s*\((\d)-(\d)-(\d+)\)"
_PLAN = r"ปีที่\s*(\d)\s*ภาคการศึกษาที่\s*(\d)"
_ENGLISH = r"([A-Z][A-Z\s\-&,()]+(?:[A-Z)]|\d))"
_THAI = r"^([ก-๙\s\-/().]+)"
#: Lines after a code that may belong to its course; characters after a marker that may name requirements.
AFTER, REACH = 5, 250


def course_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, ord, code, name_th, name_en, total, lecture, lab, self_study, year, semester)``: the courses of all texts.

    A course begins at a line that begins with a code, or that has one where none
    of the ``AFTER`` lines before has; the lines behind it belong to it up to the
    next beginning, ``AFTER`` at most.  It needs credits and a name.  Year and
    semester are those named last before it, or else first in the text.  Null
    texts and texts without a code give none.
    """
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    rows = df.filter(F.col(text).rlike("[0-9]{8}")).select(F.col(key).cast("long").alias("key"), F.posexplode(F.transform(F.split(F.col(text), "\n"), trim)).alias("line", "x"))
    order = Window.partitionBy("key").orderBy("line")
    holds, begins = F.col("x").rlike(CODE), F.col("x").rlike(f"^{CODE}")
    near = F.max(holds.cast("int")).over(order.rowsBetween(-AFTER, -1))
    last = F.last(F.when(begins, F.col("x")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("start", (begins & ~F.col("x").eqNullSafe(last)) | (holds & ~begins & (F.coalesce(near, F.lit(0)) == 0)))
    plan = F.nullif(F.regexp_extract("x", _PLAN, 0), F.lit(""))
    whole = Window.partitionBy("key").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = marked.withColumn("block", F.sum(F.col("start").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "plan", F.coalesce(F.last(plan, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.first(plan, ignorenulls=True).over(whole))
    ).filter("block > 0")
    blocks = placed.groupBy("key", "block").agg(F.min("line").alias("at"), F.min_by("plan", "line").alias("plan"), F.min_by("x", "line").alias("first"), F.sort_array(F.collect_list(F.struct("line", "x"))).alias("l"))
    # a block may be long, its course is not
    body = F.array_join(F.transform(F.filter("l", lambda r: (r["line"] <= F.col("at") + (AFTER - 1)) & (r["x"] != "")), lambda r: r["x"]), " ")
    read = blocks.select("key", "block", "plan", F.regexp_extract("first", f"({CODE})", 1).alias("code"), body.alias("b")).filter(F.col("b").rlike(_CREDITS))
    behind = trim(F.expr("substring(b, instr(b, code) + 8)"))
    english = F.coalesce(F.get(F.filter(F.transform(F.regexp_extract_all("b", F.lit(_ENGLISH), F.lit(1)), trim), lambda e: F.length(e) > 5), F.lit(0)), F.lit(""))
    named = read.withColumn("thai", trim(F.regexp_extract(behind, _THAI, 1))).withColumn("english", english).filter("length(thai) >= 3 OR english <> ''")
    number = lambda c, p, i: F.nullif(F.regexp_extract(c, p, i), F.lit("")).cast("int")
    return named.select(
        "key", (F.row_number().over(Window.partitionBy("key").orderBy("block")) - 1).alias("ord"), "code", F.substring(F.when(F.length("thai") >= 3, F.col("thai")).otherwise(F.col("english")), 1, 255).alias("name_th"),
        F.substring("english", 1, 255).alias("name_en"), *[number("b", _CREDITS, i + 1).alias(n) for i, n in enumerate(("total", "lecture", "lab", "self_study"))],
        number("plan", _PLAN, 1).alias("year"), number("plan", _PLAN, 2).alias("semester"),
    )


def first_course(rows: DataFrame, version: str) -> DataFrame:
    """One row for each code of a version: names and credits of its first mention, year and semester of the first that has them."""
    w = F.struct("key", "ord")
    planned = F.when(F.col("year").isNotNull(), w)
    return rows.groupBy(version, "code").agg(
        F.min_by("name_th", w).alias("name_th"), F.min_by("name_en", w).alias("name_en"), F.min_by("total", w).alias("total"),
        F.min_by("year", planned).alias("year"), F.min_by("semester", planned).alias("semester"), F.count("*").alias("mentions"),
    )


def requirement_rows(df: DataFrame, key: str, text: str, marker: str = "วิชาบังคับก่อน") -> DataFrame:
    """``(key, ord, code, codes, raw)`` for each marker: the last code before it, and the other codes between it and
    the next credits, at most ``REACH`` characters on.  Built-in expressions only; a marker without a code before it has no row."""
    parts = df.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), marker)).alias("ord", "part"))
    code = F.lit(f"({CODE})")
    order = Window.partitionBy("key").orderBy("ord")
    own = F.try_element_at(F.regexp_extract_all("part", code, F.lit(1)), F.lit(-1))
    before = F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # the markers themselves fill the reach after so many parts
    ahead = F.collect_list(F.substring("part", 1, REACH)).over(order.rowsBetween(0, REACH // len(marker)))
    reach = F.substring(F.concat(F.lit(marker), F.array_join(ahead, marker)), 1, REACH)
    rows = parts.select("key", "ord", before.alias("code"), F.split(reach, r"\d\s*\(\d-\d-\d+\)")[0].alias("w")).filter("ord > 0")
    found = rows.filter("code IS NOT NULL").withColumn("codes", F.array_distinct(F.array_remove(F.regexp_extract_all("w", code, F.lit(1)), F.col("code"))))
    none = (F.size("codes") == 0) & F.lower("w").rlike("ไม่มี|none|-")
    return found.select("key", "ord", "code", "codes", F.when(none, "ไม่มี").otherwise(F.coalesce(F.nullif(F.substring(squeeze(F.col("w")), 1, 200), F.lit("")), F.lit("ไม่มี"))).alias("raw"))


def first_requirement(rows: DataFrame, version: str) -> DataFrame:
    """The first requirement of each code of a version, by key and place."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(version, "code").orderBy("key", "ord"))).filter("_r = 1").drop("_r")


#: Accepted values of closed fields.
CATEGORIES = ("หมวดวิชาศึกษาทั่วไป", "หมวดวิชาเฉพาะ", "หมวดวิชาเลือกเสรี", "กลุ่มวิชาแกน", "กลุ่มวิชาภาษาและการสื่อสาร", "กลุ่มวิชาชีพบังคับ", "กลุ่มวิชาชีพเลือก", "หมวดประสบการณ์ภาคสนาม")
TYPES = ("บังคับ", "เลือก", "สหกิจศึกษา", "โครงงาน", "ฝึกงาน", "สัมมนา")


def field_record(df: DataFrame) -> DataFrame:
    """Typed fields of raw course rows and ``issues``, the names of those that have a text but no valid value (null there).

    Prerequisites are checked by ``parsers.prerequisite`` where needed; here
    credits, year, semester, category, type and the flexible flag are.
    """
    c = parsers.credits(F.trim("credits"))
    blank = lambda n: F.coalesce(F.trim(n), F.lit("")) == ""
    number = lambda n, hi: F.when(F.trim(n).rlike(r"^\d{1,4}$") & F.trim(n).try_cast("int").between(1, hi), F.trim(n).try_cast("int"))
    member = lambda n, many: F.when(F.trim(n).isin(*many), F.trim(n))
    flag = F.when(F.lower(F.trim("flexible_year_semester")).isin("true", "1", "yes", "ใช่"), True).when(F.lower(F.trim("flexible_year_semester")).isin("false", "0", "no", "ไม่", "ไม่ใช่"), False)
    fields: dict[str, Column] = {
        "credits": F.when(c["ok"], c["total"]), "year": number("year", 8), "semester": number("semester", 3), "category": member("category", CATEGORIES), "type": member("type", TYPES), "flexible_year_semester": flag,
    }
    issues = F.array_compact(F.array(*[F.when(~blank(n) & v.isNull(), F.lit(n)) for n, v in fields.items()]))
    return df.select("row_id", *[v.alias(f"{n}_value") for n, v in fields.items()], issues.alias("issues"))


def intersection_over_union(a: Column, b: Column) -> Column:
    """Of two boxes ``x0, y0, x1, y1``; 0 where they do not meet or have no area."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def replace_by_scan(df: DataFrame, text: str, scanned: str) -> Column:
    """The scanned text where it has over 50 characters and one and a half times those of the stored one, else the stored."""
    n, m = F.length(F.coalesce(scanned, F.lit(""))), F.length(F.coalesce(text, F.lit("")))
    return F.when((n > 1.5 * m) & (n > 50), F.col(scanned)).otherwise(F.col(text))


def replicate(copies: DataFrame, pages: DataFrame, document: str, canonical: str) -> DataFrame:
    """The pages of copied documents, made from those of their canonical document."""
    dup = copies.filter(F.col(document) != F.col(canonical)).select(F.col(document).alias("_d"), F.col(canonical).alias(document))
    return pages.join(dup, document).select(F.col("_d").alias(document), *[F.col(c) for c in pages.columns if c != document], F.col(document).alias("canonical_id"))
