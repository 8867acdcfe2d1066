"""Mapping of freely typed values to the entries of a reference list, in SQL only.

Pigeonhole join: a reference spelling is cut into k + 1 segments; a cell within
k edits of it holds at least one of them unchanged, the i-th of them shifted by
at most i - 1 places.  So the candidates come from an equality join on
(field, length, segment number, segment text), and the built-in ``levenshtein``
settles them.

People also shorten entries and put words around them.  Both are edits of one
kind, so the same join with one segment finds them: what a shortened cell
begins with stands in the spelling, and its distance is just the number of
letters left out; a spelling with words around it stands in the cell whole.
Nothing is listed by hand: the spellings are the list's values and English
names, and parts that a third of all entries hold ("subject", say) are found in
the list and may be left out on either side.

What no spelling fits comes out through an anti-join with id 0.  Only the
distinct spellings are matched; the rows get the answer by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfold.sources.shared import checkpoint

#: Edits allowed by the length of the reference spelling: two swaps of neighbours in a long one, one in a short one.
LONG, LONG_EDITS, SHORT, SHORT_EDITS = 10, 4, 5, 2
#: Letters of the segment by which shortened and extended spellings are found, and of parts that many entries hold.
HEAD, COMMON = 3, 4

_INVISIBLE = "[­​-‏⁠-⁤﻿]"
_SPACE = "[\\s   -   　]+"


def normal_spelling(cell: Column) -> Column:
    """Without invisible characters, numbering, outer brackets and end stops, in lower
    case, signs and white space made one space."""
    c = F.lower(F.regexp_replace(cell, _INVISIBLE, ""))
    c = F.trim(F.regexp_replace(c, _SPACE, " "))
    c = F.regexp_replace(c, r"^\(?(?:\d{1,2}|[๐-๙]{1,2})[.)] *(?=\D)", "")
    c = F.regexp_replace(c, r"^[(\[](.*)[)\]]$", "$1")
    c = F.regexp_replace(c, r"[-/+&.,;:'’()\[\]_ฯ]+", " ")
    return F.trim(F.regexp_replace(c, " +", " "))


def spellings(canonical: DataFrame) -> DataFrame:
    """``(field, value_id, ref, edits)``: the canonical values and their English names;
    ``edits`` is how many are allowed.  Null names give nothing."""
    own = canonical.select("field", "value_id", F.explode(F.array("value", "value_en")).alias("ref"))
    ref = own.select("field", "value_id", normal_spelling(F.col("ref")).alias("ref")).filter("ref <> ''").distinct()
    n = F.length("ref")
    return ref.withColumn("edits", F.when(n >= LONG, LONG_EDITS).when(n >= SHORT, SHORT_EDITS).otherwise(0))


def _grams(text: Column, n: int) -> Column:
    """The distinct stretches of ``n`` letters of a text."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def common_parts(canonical: DataFrame) -> DataFrame:
    """``(part)``: stretches of ``COMMON`` letters that at least a third of the entries hold."""
    every = canonical.select(F.count("*").alias("n")).scalar()
    held = canonical.filter("value IS NOT NULL").select(F.explode(_grams(F.replace(normal_spelling(F.col("value")), F.lit(" "), F.lit("")), COMMON)).alias("part"))
    return held.groupBy("part").agg(F.count("*").alias("k")).filter(3 * F.col("k") >= every).select("part")


def _segments(refs: DataFrame) -> DataFrame:
    """Each spelling cut into ``edits + 1`` segments of nearly equal length."""
    parts, n = F.col("edits") + 1, F.length("ref")
    cut = lambda i: F.floor(n * i / parts).cast("int")
    return refs.withColumn("i", F.explode(F.sequence(F.lit(1), parts))).select(
        "field", "value_id", "ref", "edits", F.length("ref").alias("ref_len"), "i",
        (cut(F.col("i") - 1) + 1).alias("at"), (cut(F.col("i")) - cut(F.col("i") - 1)).alias("len"),
    ).withColumn("seg", F.expr("substring(ref, at, len)"))


def near_spellings(spelled: DataFrame, refs: DataFrame) -> DataFrame:
    """``(field, spelled, value_id, score, size)`` of the entries within the edits of a spelling; ``score`` is their number."""
    seg = _segments(refs)
    # one row for each place of a segment in a length: it has no text, and its number follows the lengths of the list
    places = seg.select("field", "ref_len", "edits", "i", "at", "len").distinct()
    lengths = spelled.withColumn("size", F.length("spelled"))
    reach = places.withColumn("size", F.explode(F.sequence(F.col("ref_len") - F.col("edits"), F.col("ref_len") + F.col("edits"))))
    probes = (
        lengths.join(reach, ["field", "size"]).select("field", "spelled", "ref_len", "edits", "i", "len", F.explode(F.expr("sequence(at - (i - 1), at + (i - 1))")).alias("start"))
        .filter("start >= 1 AND start + len - 1 <= length(spelled)")
        .select("field", "spelled", "ref_len", "edits", "i", F.expr("substring(spelled, start, len)").alias("seg"))
    )
    near = probes.join(seg, ["field", "ref_len", "edits", "i", "seg"]).select("field", "spelled", "value_id", "ref", "edits").distinct()
    return near.withColumn("score", F.levenshtein("spelled", "ref")).filter("score <= edits").select("field", "spelled", "value_id", "score", F.length("ref").alias("size"))


def _shortened(solid: DataFrame, refs: DataFrame) -> DataFrame:
    """Cells that are a spelling with letters left out: the distance is the difference in length."""
    heads = refs.select("field", "value_id", "solid_ref", F.explode(_grams(F.col("solid_ref"), HEAD)).alias("seg"))
    hit = solid.withColumn("seg", F.substring("solid", 1, HEAD)).filter(F.length("solid") >= HEAD).join(heads, ["field", "seg"]).filter(F.length("solid") <= F.length("solid_ref"))
    return hit.filter(F.levenshtein("solid", "solid_ref") == F.length("solid_ref") - F.length("solid")).select("field", "spelled", "value_id", F.length("solid_ref").alias("size"))


def _extended(solid: DataFrame, refs: DataFrame) -> DataFrame:
    """Cells in which a whole spelling stands."""
    heads = refs.select("field", "value_id", "solid_ref", F.substring("solid_ref", 1, HEAD).alias("seg"))
    hit = solid.withColumn("seg", F.explode(_grams(F.col("solid"), HEAD))).join(heads, ["field", "seg"]).filter(F.col("solid").contains(F.col("solid_ref")))
    return hit.select("field", "spelled", "value_id", F.length("solid_ref").alias("size"))


def match_spellings(spelled: DataFrame, refs: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """``(field, spelled, value_id)`` for the distinct ``(field, spelled)`` that fit one
    entry better than any other; those that fit none, or two equally well, are absent.

    An edit counts 1 and so does all that is left out; then come spellings with
    words around them, the longest first, and shortened ones without common parts."""
    solid = spelled.withColumn("solid", F.replace("spelled", F.lit(" "), F.lit("")))
    whole = refs.withColumn("solid_ref", F.replace("ref", F.lit(" "), F.lit("")))
    scored = lambda df, n: df.withColumn("score", F.lit(n)).select("field", "spelled", "value_id", "score", "size")
    hits = near_spellings(spelled, refs).select("field", "spelled", "value_id", "score", "size").unionByName(scored(_shortened(solid, whole), 1)).unionByName(scored(_extended(solid, whole), LONG_EDITS + 1))
    if common is not None:
        parts = common.agg(F.array_join(F.sort_array(F.collect_list("part")), "|").alias("p")).select(F.coalesce(F.nullif("p", F.lit("")), F.lit("(?!)"))).scalar()
        bare = lambda c: F.regexp_replace(c, parts, F.lit(""))
        cut = solid.withColumn("_s", bare(F.col("solid"))).filter("_s <> solid").select("field", "spelled", F.col("_s").alias("solid"))
        rest = whole.withColumn("solid_ref", bare(F.col("solid_ref")))
        hits = hits.unionByName(scored(_shortened(cut, rest), LONG_EDITS + 2))
    best = hits.groupBy("field", "spelled", "value_id").agg(F.min(F.struct("score", (-F.col("size")).alias("size"))).alias("b"))
    # equal spellings have equal scores; of spellings with words around them the longest counts
    order = F.struct(F.col("b.score").alias("score"), F.when(F.col("b.score") == LONG_EDITS + 1, F.col("b.size")).otherwise(0).alias("size"))
    return best.withColumn("o", order).groupBy("field", "spelled").agg(F.min(F.struct("o", "value_id")).alias("m"), F.sort_array(F.collect_list("o")).alias("os")).filter(
        "size(os) = 1 OR os[0] < os[1]"
    ).select("field", "spelled", F.col("m.value_id").alias("value_id"))


def map_to_canonical(df: DataFrame, key: str, fields: list[str], canonical: DataFrame) -> DataFrame:
    """``(key, field, value_id)`` for each cell that is neither null nor empty nor exactly
    a canonical value of its field; ``value_id`` 0 where no entry of the field is meant.

    White space alone is a cell like any other and means no entry.  Repeated rows
    are repeated.  With an empty reference list every such cell has 0.  Cells of
    any length are compared whole: beyond the longest spelling they fit none.
    """
    cells = df.select(F.col(key).alias("_key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("cell")) for f in fields])).alias("c")).select("_key", "c.field", "c.cell")
    exact = canonical.select("field", F.col("value").alias("cell")).distinct()
    typed = cells.filter("cell IS NOT NULL AND cell <> ''").join(exact, ["field", "cell"], "left_anti").withColumn("spelled", normal_spelling(F.col("cell")))
    # the distinct spellings are looked at in several ways, and are few beside the cells
    distinct = checkpoint(typed.select("field", "spelled").distinct())
    known = checkpoint(match_spellings(distinct, spellings(canonical), common_parts(canonical)))
    every = known.unionByName(distinct.join(known, ["field", "spelled"], "left_anti").withColumn("value_id", F.lit(0)))
    return typed.join(every, ["field", "spelled"]).select(F.col("_key").alias(key), "field", F.col("value_id").cast("int").alias("value_id"))
