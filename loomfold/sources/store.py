"""A store of tables in one folder: schema, validated appends, rejected rows, readers."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMAS = {
    "curriculum_version": "version_id bigint, program string, curriculum_year int, edition_status string",
    "document": "document_id string, relative_path string, sha256 string, size_bytes bigint, page_count int, degree_level string, version_id bigint, canonical_document_id string",
    "document_relation": "from_id string, to_id string, relation string, note string",
    "page": "document_id string, page_number int, width_pt double, height_pt double, page_text string, status string",
    "provenance": "content_sha256 string, document_id string, page_number int, x0 double, y0 double, x1 double, y1 double, program string, curriculum_year int, edition_status string",
    "review_issue": "issue_type string, item string, detail string",
    "error_record": "step string, item string, detail string",
}
KEYS = {"curriculum_version": ["program", "curriculum_year", "edition_status"], "document": ["document_id"], "document_relation": ["from_id", "to_id", "relation"], "page": ["document_id", "page_number"], "provenance": ["content_sha256", "document_id", "page_number"]}
#: Points by which a box may lie outside its page.
SLACK = 0.5


def is_hash(c: Column) -> Column:
    """Whether a text has the form of a sha256."""
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def stamped(df: DataFrame) -> Column:
    """Whether a row names its version in full."""
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return filled("program") & F.col("curriculum_year").isNotNull() & filled("edition_status")


def outside_page(boxes: DataFrame, pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The boxes ``x0, y0, x1, y1`` that are turned round, have no page, or lie outside it by more than ``SLACK``."""
    known = pages.select(*keys, "width_pt", "height_pt").dropDuplicates(list(keys))
    inside = (F.col("x0") >= -SLACK) & (F.col("y0") >= -SLACK) & (F.col("x1") <= F.col("width_pt") + SLACK) & (F.col("y1") <= F.col("height_pt") + SLACK) & (F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1"))
    return boxes.join(known, list(keys), "left").filter(~F.coalesce(inside, F.lit(False))).drop("width_pt", "height_pt")


def merged_box(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The smallest box around all boxes of a key."""
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def column_boxes(header: Column, n: int) -> Column:
    """The box of a header cut into ``n`` columns of equal width."""
    width = (header["x1"] - header["x0"]) / n
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((header["x0"] + width * i).alias("x0"), header["y0"].alias("y0"), (header["x0"] + width * (i + 1)).alias("x1"), header["y1"].alias("y1")))


def font_size(size: Column, height: Column) -> Column:
    """The greater of a glyph's size and the height of its box, 1 where neither is above 0."""
    big = F.greatest(F.coalesce(size, F.lit(0.0)), F.coalesce(height, F.lit(0.0)))
    return F.when(big > 0, big).otherwise(F.lit(1.0))


def canonical_json(df: DataFrame, fields: Sequence[str]) -> Column:
    """The fields of a row as JSON with sorted names, without white space."""
    return F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]), {"ignoreNullFields": "false"})


class Store:
    """Tables as folders of Parquet parts.  An append is one new part that counts when it is whole; parts are never changed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def create(self) -> None:
        """Makes the tables that are not there; a second call changes nothing."""
        for name in self.missing():
            self.spark.createDataFrame([], StructType.fromDDL(SCHEMAS[name])).write.parquet(f"{self._at(name)}/part={uuid.uuid4().hex}")

    def missing(self) -> list[str]:
        return [n for n in SCHEMAS if not self._has(n)]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).option("recursiveFileLookup", "true").parquet(self._at(name))

    def append(self, name: str, rows: DataFrame, valid: Column | None = None) -> DataFrame:
        """Appends the valid rows whose key the table does not have, one for each key, and gives the rows that are not valid.

        Those are recorded as review issues, too.  Rows with a known key are ignored, nulls in a key are not valid."""
        key, fields = KEYS.get(name, []), StructType.fromDDL(SCHEMAS[name]).fieldNames()
        ok = F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True)
        for k in key:
            ok = ok & F.col(k).isNotNull()
        checked = rows.select(*fields, ok.alias("_ok"))
        new = checked.filter("_ok").select(*fields)
        if key:
            new = new.dropDuplicates(key).join(self.read(name).select(*key), key, "left_anti").select(*fields)
        new.write.parquet(f"{self._at(name)}/part={uuid.uuid4().hex}")
        bad = checked.filter("NOT _ok").select(*fields)
        if name != "review_issue":
            issues = bad.select(F.lit(f"invalid_{name}").alias("issue_type"), F.to_json(F.struct(*fields)).alias("item"), F.lit("").alias("detail"))
            issues.write.parquet(f"{self._at('review_issue')}/part={uuid.uuid4().hex}")
        return bad

    def issues(self, issue_type: str | None = None) -> DataFrame:
        rows = self.read("review_issue")
        return (rows if issue_type is None else rows.filter(F.col("issue_type") == issue_type)).orderBy("issue_type", "item")

    def publish(self, staged: dict[str, DataFrame], valid: dict[str, Column]) -> list[str]:
        """Appends all tables or none: the names of the tables with rows that are not valid; nothing is written if there are any."""
        bad = [n for n, df in staged.items() if n in valid and not df.filter(~F.coalesce(valid[n], F.lit(False))).isEmpty()]
        if not bad:
            for name, df in staged.items():
                self.append(name, df, valid.get(name))
        return bad
