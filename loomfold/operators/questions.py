"""Questions: topic words, parsing with or without a language model, routing, stems of names."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfold.operators.answers import any_of, classify, program_of, study_year

#: Words that are no topic of a question.
TOPIC_STOP = [
    "วิชา", "เรียน", "มี", "กี่", "อะไร", "บ้าง", "หลักสูตร", "ของ", "ที่",
    "เกี่ยวกับ", "เกี่ยวข้อง", "กับ", "รายวิชา", "ทั้งหมด", "ครับ", "คะ", "ค่ะ",
    "ปี", "เทอม", "ภาค", "หน่วยกิต", "ต้อง", "ลง", "ไหน", "ด้าน", "สาขา",
    "เขียน", "การ", "และ",
]
#: Words of questions and the words that names of courses have for them.
TOPIC_SYNONYMS = {
    "เขียนโปรแกรม": ["โปรแกรม", "programming"],
    "โปรแกรมมิ่ง": ["โปรแกรม", "programming"],
    "coding": ["โปรแกรม", "programming"],
    "programming": ["โปรแกรม", "programming"],
    "ฐานข้อมูล": ["ฐานข้อมูล", "database"],
    "เอไอ": ["ปัญญาประดิษฐ์", "ARTIFICIAL"],
    "ปัญญาประดิษฐ์": ["ปัญญาประดิษฐ์", "ARTIFICIAL"],
    "เครือข่าย": ["เครือข่าย", "NETWORK"],
    "ความมั่นคง": ["ความมั่นคง", "SECURITY", "ไซเบอร์"],
    "คณิต": ["คณิต", "MATH", "แคลคูลัส", "CALCULUS"],
}
#: Words by which the intent of a question is told, the first list that fits decides.
INTENTS = {
    "prerequisite": ["ต้องผ่าน", "บังคับก่อน", "prerequisite", "เรียนก่อน"],
    "cross_version": ["เก่า", "ใหม่", "เปรียบเทียบ", "ต่างกัน"],
    "plan_summary": ["แผนการเรียน", "แผนการศึกษา", "3.5", "จบเร็ว"],
}
ALL_WORDS = ["ทั้งหมด", "ทุกวิชา"]
VALID_INTENTS = ["course_by_year", "topic_courses", "prerequisite", "plan_summary", "cross_version", "all_courses", "general"]
LEAST_CONFIDENCE, LONGEST_QUESTION, MOST_VERSIONS, MOST_ESCALATIONS = 0.50, 500, 2, 1


def topic_keywords(question: Column, program: Column) -> Column:
    """The topic words of a question in order, once each, with the words that names have for them: first those of
    synonyms anywhere in the question, then its own words or their synonyms."""
    synonyms = F.create_map(*[x for k, v in TOPIC_SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    bare = F.regexp_replace(question, r"หลักสูตร\s+[A-Z]+\s*:", "")
    words = F.filter(F.regexp_extract_all(bare, F.lit("([ก-๙]+|[A-Za-z]+)"), F.lit(1)), lambda w: (F.length(w) >= 2) & ~w.isin(*TOPIC_STOP) & (F.upper(w) != F.upper(F.coalesce(program, F.lit("")))))
    anywhere = F.flatten(F.transform(F.filter(F.map_keys(synonyms), lambda k: F.contains(F.lower(question), k)), lambda k: F.element_at(synonyms, k)))
    own = F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(synonyms, F.lower(w)), F.array(w))))
    return F.array_distinct(F.concat(anywhere, own))


def semester_of(question: Column) -> Column:
    """The semester a question names by words; null where none."""
    return F.when(any_of(question, ["ภาคต้น", "เทอมต้น"]), 1).when(any_of(question, ["ภาคปลาย", "เทอมปลาย"]), 2)


def parse(question: Column, programs: Sequence[str]) -> Column:
    """A struct ``intent, program, year, semester`` read by patterns."""
    low, year = F.lower(question), study_year(question)
    intent = F.when(F.lit(False), F.lit(""))
    for name, words in INTENTS.items():
        intent = intent.when(any_of(low, words), name)
    intent = intent.when(year.isNotNull(), "course_by_year").when(any_of(question, ALL_WORDS), "all_courses").when(question.contains("วิชา"), "topic_courses").otherwise("general")
    return F.struct(intent.alias("intent"), program_of(question, programs).alias("program"), year.alias("year"), semester_of(question).alias("semester"))


def parse_reply(reply: Column, question: Column, programs: Sequence[str]) -> Column:
    """The same struct with ``topic`` out of a language model's reply: its JSON object with invalid values left out, gaps filled
    by patterns; a reply without an object, or none at all, is parsed by patterns alone."""
    read = parse(question, programs)
    body = F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))
    data = F.from_json(body, "intent string, program string, year double, semester double, topic string")
    whole = lambda c, hi: F.when((c >= 1) & (c <= hi), c.cast("int"))
    # an object of any content has a value for each field, null where it lacks it
    usable = F.coalesce(F.size(F.json_object_keys(body)) >= 0, F.lit(False))
    intent = F.when(usable, F.when(data["intent"].isin(*VALID_INTENTS), data["intent"]).otherwise("general")).otherwise(read["intent"])
    program = F.when(usable & F.upper(data["program"]).isin(*programs), F.upper(data["program"]))
    topic = F.when(usable & (F.lower(F.trim(data["topic"])) != "null"), F.nullif(F.trim(data["topic"]), F.lit("")))
    return F.struct(
        intent.alias("intent"), F.coalesce(program, read["program"]).alias("program"), F.coalesce(F.when(usable, whole(data["year"], 4)), read["year"]).alias("year"),
        F.coalesce(F.when(usable, whole(data["semester"], 3)), read["semester"]).alias("semester"), topic.alias("topic"),
    )


def route(question: Column, found: Column, versions: Column) -> Column:
    """A struct ``valid, level, confidence, rule, path, fallback, escalated, versions``.

    A question of no or too many characters is not valid and has no route.
    Little confidence goes to L3.  Levels L1 and L2 take the structured path, and
    L3 with one escalation where that ``found`` no rows (null: it was not asked);
    evidence is looked for in two versions at most.
    """
    q = F.trim(question)
    valid = F.coalesce(F.length(q).between(1, LONGEST_QUESTION), F.lit(False))
    c = classify(q)
    doubtful = c["confidence"] < LEAST_CONFIDENCE
    level = F.when(doubtful, "L3").otherwise(c["level"])
    rule = F.when(doubtful, F.concat(F.lit("router_fallback("), c["rule"], F.lit(")"))).otherwise(c["rule"])
    structured = level.isin("L1", "L2")
    escalated = structured & F.coalesce(found == 0, F.lit(False)) & F.lit(MOST_ESCALATIONS > 0)
    ok = lambda x: F.when(valid, x)
    return F.struct(
        valid.alias("valid"), ok(F.when(escalated, "L3").otherwise(level)).alias("level"), ok(c["confidence"]).alias("confidence"),
        ok(F.when(escalated, F.concat(F.lit("route_escalated("), rule, F.lit(")"))).otherwise(rule)).alias("rule"),
        ok(F.when(structured & ~escalated, "structured").otherwise("evidence_planner")).alias("path"), ok(doubtful).alias("fallback"), ok(escalated).alias("escalated"),
        ok(F.when(structured & ~escalated, F.array().cast("array<string>")).otherwise(F.slice(versions, 1, MOST_VERSIONS))).alias("versions"),
    )


def no_evidence(versions: Column) -> Column:
    """What is answered where no evidence was found: it names the versions that were searched and no other."""
    return F.concat(F.lit("ไม่พบหลักฐานในเอกสาร"), F.when(F.size(versions) > 0, F.concat(F.lit(": "), F.array_join(versions, ", "))).otherwise(F.lit("")))


def stem_match(word: Column, other: Column) -> Column:
    """Whether two words begin alike for five letters, or all of the shorter one; of words under four letters one must hold the other."""
    a, b = F.lower(word), F.lower(other)
    n = F.least(F.length(a), F.length(b))
    k = F.least(n, F.lit(5))
    return F.when(n < 4, F.contains(a, b) | F.contains(b, a)).otherwise(F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))


def _meets(keyword: str) -> Callable[[Column], Column]:
    return lambda w: stem_match(F.lit(keyword), w)


def rank_by_stems(names: DataFrame, key: str, name: Column, keywords: Sequence[str]) -> DataFrame:
    """``(key, hits, place, leads)``: how many keywords a name has a word for, its place, and whether it alone is first."""
    words = F.regexp_extract_all(F.lower(name), F.lit("([ก-๙]+|[a-z]+)"), F.lit(1))
    hits = F.lit(0)
    for k in keywords:
        hits = hits + F.exists(words, _meets(k)).cast("int")
    scored = names.select(key, hits.alias("hits")).filter("hits > 0")
    # the best is one row, and so is the number of those that reach it
    best = scored.agg(F.max("hits")).scalar()
    alone = scored.groupBy("hits").agg(F.count("*").alias("n")).agg(F.max_by("n", "hits")).scalar() == 1
    return scored.withColumn("leads", (F.col("hits") == best) & alone)


def escaped_terms(query: Column) -> Column:
    """The terms of a query without signs that have a meaning to an index, each in quotes; all must be met."""
    bare = F.translate(query, '*"()^{}:+-~\\', " " * 12)
    return F.transform(F.filter(F.split(bare, r"\s+"), lambda t: t != ""), lambda t: F.concat(F.lit('"'), t, F.lit('"')))


def elective_slots(text: Column, year: int, semester: int) -> Column:
    """The names of elective slots in the plan of a term: those between its heading and the next, or in the 800 characters behind it."""
    head = f"ปีที่ {year} ภาคการศึกษาที่ {semester}"
    behind = F.substring(text, F.locate(head, text) + len(head), F.lit(100_000_000))
    cut = F.split(behind, r"ปีที่ \d ภาคการศึกษาที่ \d")
    part = F.when(F.size(cut) > 1, cut[0]).otherwise(F.substring(behind, 1, 800))
    found = F.regexp_extract_all(part, F.lit(r"(วิชาเลือก[ก-๙\s]{2,60}?\d?)(?=\s|$)"), F.lit(1))
    name = lambda m: F.regexp_replace(F.trim(F.split(F.trim(F.regexp_replace(m, r"\s+", " ")), "หน่วยกิต")[0]), r"\s+\d+$", "")
    slots = F.array_distinct(F.filter(F.transform(found, name), lambda n: F.length(n).between(11, 59)))
    return F.when(F.locate(head, text) > 0, slots).otherwise(F.array().cast("array<string>"))


def foreign_institution(text: Column, known: str) -> Column:
    """The first institution a text names that is not the known one; null where none.  The bare word, and short forms of the known name, are no case."""
    bare = ["สถาบัน", "มหาวิทยาลัย", ""]
    mentions = F.transform(F.regexp_extract_all(text, F.lit(r"((?:มหาวิทยาลัย|สถาบัน)[ก-๙ฯ]*)"), F.lit(1)), lambda m: F.rtrim(F.regexp_replace(m, "ฯ+$", "")))
    other = F.filter(mentions, lambda m: ~m.isin(*bare) & ~F.startswith(F.lit(known), F.substring(m, 1, 10)) & ~F.contains(F.lit(known), m) & ~F.contains(m, F.lit(known)))
    return F.try_element_at(other, F.lit(1))


def in_synonyms(value: Column, synonyms: Mapping[str, str]) -> Column:
    """The accepted value for a synonym, and any other value as it is."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv]), value), value) if synonyms else value


def selected_codes(reply: Column, valid: Column) -> Column:
    """The codes of six to ten digits of a language model's reply that are valid ones, in order; null for no reply."""
    return F.when(reply.isNotNull(), F.array_distinct(F.filter(F.regexp_extract_all(reply, F.lit(r"(?<!\d)(\d{6,10})(?!\d)"), F.lit(1)), lambda c: F.array_contains(valid, c))))


def plan_order(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """``ord`` in the order of a plan: by year, semester and code; no year and year 0 come last."""
    at = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(9))
    return df.withColumn("ord", F.row_number().over(Window.partitionBy(*group).orderBy(at("year"), at("semester"), "code", "course_id")))
