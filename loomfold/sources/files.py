"""Files: a corpus of documents, JSON of courses, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COURSES = (
    "source string, description string, program string, plan string, courses array<struct<code string, name_th string, name_en string, credits string, year string, "
    "semester string, category string, type string, prerequisite string, flexible_year_semester string, note string>>"
)


def corpus(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """``(relative_path, document_id, sha256, size_bytes, canonical_id)`` of all files below a folder; equal files share the first path's id."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    base = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    rel = F.substring_index("path", base + "/", -1)
    docs = files.select(rel.alias("relative_path"), F.substring(F.sha2(rel, 256), 1, 16).alias("document_id"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))
    first = docs.groupBy("sha256").agg(F.min(F.struct("relative_path", "document_id")).alias("_f"))
    return docs.join(first, "sha256").select("relative_path", "document_id", "sha256", "size_bytes", F.col("_f.document_id").alias("canonical_id"))


def course_json(spark: SparkSession, path: str) -> DataFrame:
    """One row for each course of JSON files; every field is read as text, as numbers come quoted or not.  Template hint rows are left out."""
    rows = spark.read.option("multiLine", "true").schema(COURSES).json(path)
    flat = rows.select(F.col("_metadata.file_name").alias("file_name"), "program", "plan", F.posexplode("courses").alias("ord", "c")).select("file_name", "program", "plan", "ord", "c.*")
    return flat.filter("code IS NULL OR NOT startswith(code, 'หมายเหตุ')")


GOLD = (
    "gold_id int, item_kind string, kind string, document_id string, page int, page_number int, question_level string, version struct<program: string, curriculum_year: int, edition_status: string>, "
    "curriculum_version struct<program: string, curriculum_year: int, edition_status: string>, payload map<string, string>, expected map<string, string>, expected_citations array<struct<document_id: string, page: int>>, author string, created_date string, review_method string"
)
#: What an item of each kind must have.
GOLD_NEEDS = {"page_text": ["document_id", "page"], "table_cell": ["document_id", "page"], "question": ["question_level"]}


def gold_set(spark: SparkSession, path: str) -> DataFrame:
    """Gold items of a JSON file or a folder of them: a list, or an object with ``items``.  Other names of fields are accepted
    (``kind``, ``page_number``, ``curriculum_version``); a version without all its parts is null with ``warning`` set;
    ``problem`` says what an item lacks, null where it is whole."""
    text = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path)
    body = F.trim("value")
    items = F.when(body.startswith("["), F.from_json(body, f"array<struct<{_struct(GOLD)}>>")).otherwise(F.from_json(body, f"struct<items: array<struct<{_struct(GOLD)}>>>")["items"])
    rows = text.select(F.explode(items).alias("i")).select("i.*")
    version = F.coalesce("version", "curriculum_version")
    whole = version["program"].isNotNull() & version["curriculum_year"].isNotNull() & version["edition_status"].isNotNull()
    read = rows.select(
        "gold_id", F.coalesce("item_kind", "kind").alias("item_kind"), "document_id", F.coalesce("page", "page_number").alias("page"), "question_level", F.when(whole, version).alias("version"),
        (version.isNotNull() & ~F.coalesce(whole, F.lit(False))).alias("warning"), "payload", "expected", "expected_citations", "author", "created_date", "review_method",
    )
    lacks = F.when(F.col("item_kind").isNull() | ~F.col("item_kind").isin(*GOLD_NEEDS), F.lit("item_kind"))
    for kind, needed in GOLD_NEEDS.items():
        for n in needed:
            lacks = lacks.when((F.col("item_kind") == kind) & F.col(n).isNull(), n)
    return read.withColumn("problem", lacks)


def _struct(ddl: str) -> str:
    """The fields of a schema as those of a struct."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


def vectors(df: DataFrame, blob: str, dim: int, out: str = "vector") -> DataFrame:
    """Little-endian float32 blobs as arrays; blobs of another length are left out.  Built-in expressions only."""
    size = df.filter(F.length(blob) == 4 * dim)
    part = lambda i: F.conv(F.hex(F.reverse(F.substring(F.col(blob), i * 4 + 1, 4))), 16, 10).cast("long")

    def number(i):
        bits = part(i)
        sign = F.when(F.shiftright(bits, 31) % 2 == 1, -1.0).otherwise(1.0)
        exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(255))
        fraction = bits.bitwiseAND(F.lit(0x7FFFFF)) / float(1 << 23)
        return (sign * F.when(exponent == 0, fraction * 2.0**-126).otherwise((1 + fraction) * F.pow(F.lit(2.0), exponent - 127))).cast("float")

    return size.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), number))


def write_report(df: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """JSON lines in one folder for each value of ``by``."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).json(path)
