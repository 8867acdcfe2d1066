"""Retrieval queries over documents, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfold.operators import relational, retrieval
from loomfold.plans.registry import Registry
from loomfold.sources.shared import shared_path, stored
from loomfold.sources.tables import table

R = Registry()
QUERY = ("assessment", "university")
#: Weights of the lexicon's categories.
BOOSTS = {"credit_term": 1.20, "requirement_term": 1.25, "plan_term": 1.15, "degree_term": 1.30}
_WORDS = "regexp_extract_all(lower(text), '([ก-๙]+|[a-z]+|[0-9]+)', 1)"
_BM25 = f"""c AS (SELECT doc_id, len(w) AS dl, len(list_filter(w, lambda x: x = 'assessment')) AS a, len(list_filter(w, lambda x: x = 'university')) AS b FROM (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL)),
s AS (SELECT count(*) AS n, avg(dl) AS av, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c),
lex AS (SELECT doc_id, greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / av)) + greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / av)) AS score FROM c, s WHERE a > 0 AND b > 0)"""
_SUB = """sub AS (SELECT doc_id, CASE WHEN contains(lower(text), 'assessment') THEN 1.0 ELSE 0.0 END + CASE WHEN contains(lower(split_part(text, chr(10), 1)), 'assessment') THEN 1.5 ELSE 0.0 END
 + CASE WHEN contains(lower(text), 'หน่วยกิต') THEN 1.0 ELSE 0.0 END + CASE WHEN contains(lower(split_part(text, chr(10), 1)), 'หน่วยกิต') THEN 1.5 ELSE 0.0 END AS score FROM documents WHERE text IS NOT NULL)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text")


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(_docs(spark, d), "doc_id", "text", QUERY)


def _substring(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.substring_score(_docs(spark, d), "doc_id", F.col("text"), F.split("text", "\n")[0], ["assessment", "หน่วยกิต"])


def _query_vector(spark: SparkSession, d: str) -> DataFrame:
    """The vector of the lowest id: one row."""
    return table(spark, d, "embeddings").groupBy().agg(F.min_by("embedding", "vec_id").alias("q"))


@R.add("bm25_topk", f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM lex ORDER BY lex.score DESC, doc_id LIMIT 100")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.top_k(_lexical(spark, d), "doc_id", 100).select("doc_id", F.round("score", 6).alias("score"))


@R.add("bm25_by_index", f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM lex")
def bm25_by_index(spark: SparkSession, d: str) -> DataFrame:
    at = shared_path(spark, "index")
    retrieval.write_index(_docs(spark, d), "doc_id", "text", at)
    return retrieval.bm25_by_index(spark, at, "doc_id", QUERY).select("doc_id", F.round("score", 6).alias("score"))


@R.add("bm25_in_scope", "WITH " + _BM25 + " SELECT l.doc_id, round(l.score, 6) AS score FROM lex l JOIN documents d ON d.doc_id = l.doc_id WHERE d.lang = 'en' ORDER BY l.score DESC, l.doc_id LIMIT 50")
def bm25_in_scope(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text", "lang")
    return retrieval.top_k(retrieval.bm25(docs, "doc_id", "text", QUERY, F.col("lang") == "en"), "doc_id", 50).select("doc_id", F.round("score", 6).alias("score"))


@R.add("term_index", f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY doc_id, term")
def term_index(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.term_table(_docs(spark, d), "doc_id", "text").select("doc_id", "term", "tf")


@R.add("substring_score_topk", f"WITH {_SUB} SELECT doc_id, CAST(score AS DOUBLE) AS score FROM sub WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 100")
def substring_score_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.top_k(_substring(spark, d), "doc_id", 100)


@R.add(
    "rrf_fusion",
    f"""WITH {_BM25}, {_SUB}, x AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM lex), y AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM sub WHERE score > 0)
    SELECT doc_id, rank_a, rank_b, round(f, 6) AS fused FROM (SELECT COALESCE(x.doc_id, y.doc_id) AS doc_id, x.r AS rank_a, y.r AS rank_b, (COALESCE(0.5 / (60 + x.r), 0) + COALESCE(0.5 / (60 + y.r), 0)) * CASE WHEN x.r IS NOT NULL AND y.r IS NOT NULL THEN 1.3 ELSE 1.0 END AS f
    FROM (SELECT * FROM x WHERE r <= 30) x FULL JOIN (SELECT * FROM y WHERE r <= 30) y ON x.doc_id = y.doc_id) ORDER BY f DESC, doc_id LIMIT 50""",
)
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    a, b = retrieval.ranked(_lexical(spark, d), "doc_id", 30), retrieval.ranked(_substring(spark, d), "doc_id", 30)
    fused = retrieval.reciprocal_rank_fusion(a, b, "doc_id", both=1.3)
    return retrieval.top_k(fused, "doc_id", 50, "fused").withColumn("fused", F.round("fused", 6))


_COS = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"
_Q = "q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


def _dense(spark: SparkSession, d: str) -> DataFrame:
    # the query is one value: a subquery, no join
    rows = table(spark, d, "embeddings").withColumn("q", _query_vector(spark, d).scalar())
    return retrieval.dense_scores(rows, "vec_id", "embedding", F.col("q"))


@R.add("dense_topk", f"WITH {_Q} SELECT vec_id, round({_COS}, 5) AS score FROM embeddings e, q ORDER BY {_COS} DESC, vec_id LIMIT 50")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.top_k(_dense(spark, d), "vec_id", 50).withColumn("score", F.round("score", 5))


@R.add("dense_in_scope", f"WITH {_Q} SELECT vec_id, round({_COS}, 5) AS score FROM embeddings e, q WHERE e.label IN (1, 3) ORDER BY {_COS} DESC, vec_id LIMIT 50")
def dense_in_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("q", _query_vector(spark, d).scalar())
    scored = retrieval.dense_scores(rows, "vec_id", "embedding", F.col("q"), F.col("label").isin(1, 3))
    return retrieval.top_k(scored, "vec_id", 50).withColumn("score", F.round("score", 5))


@R.add("dense_by_units", f"WITH {_Q} SELECT vec_id, round({_COS}, 5) AS score FROM embeddings e, q ORDER BY {_COS} DESC, vec_id LIMIT 20")
def dense_by_units(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of length one, written once; a search is one product a vector."""
    stored_units = stored(retrieval.unit_vectors(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding"))
    query = stored_units.groupBy().agg(F.min_by("embedding", "vec_id")).scalar()
    scored = stored_units.withColumn("q", query).select("vec_id", retrieval.dot(F.col("embedding"), F.col("q")).alias("score"))
    return retrieval.top_k(scored, "vec_id", 20).withColumn("score", F.round("score", 5))


@R.add("query_status", "SELECT doc_id, CASE WHEN length(trim(COALESCE(text, ''), ' ')) = 0 THEN 'empty' WHEN length(trim(COALESCE(text, ''), ' ')) > 1000 THEN 'too_long' ELSE 'ok' END AS status FROM documents")
def query_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", retrieval.query_status(F.col("text")).alias("status"))


@R.add("telling_names", f"SELECT course_id FROM course WHERE NOT COALESCE(regexp_matches(concat_ws(' ', name_th, name_en), '(?i){'|'.join(retrieval.PLACEHOLDERS)}'), false)")
def telling_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "course").filter(~retrieval.is_placeholder(F.concat_ws(" ", "name_th", "name_en"))).select("course_id")


@R.add("dense_relative_threshold", f"WITH {_Q}, s AS (SELECT vec_id, {_COS} AS score FROM embeddings e, q WHERE e.vec_id > 0) SELECT vec_id, round(score, 5) AS score FROM s WHERE score >= greatest(0.1, (SELECT max(score) FROM s) - 0.15)")
def dense_relative_threshold(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.relative_threshold(_dense(spark, d).filter("vec_id > 0"), "score", 0.15, 0.1).withColumn("score", F.round("score", 5))


@R.add(
    "maxsim_rerank",
    """WITH t AS (SELECT vec_id, [embedding[1:16]::DOUBLE[], embedding[17:32]::DOUBLE[], embedding[33:48]::DOUBLE[], embedding[49:64]::DOUBLE[]] AS toks FROM embeddings), q AS (SELECT toks AS qt FROM t ORDER BY vec_id LIMIT 1)
    SELECT vec_id, round(list_sum(list_transform(qt, lambda a: list_max(list_transform(toks, lambda b: list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))))))) / 4, 5) AS score FROM t, q""",
)
def maxsim_rerank(spark: SparkSession, d: str) -> DataFrame:
    cut = F.array(*[F.slice("embedding", 1 + 16 * i, 16) for i in range(4)])
    tokens = table(spark, d, "embeddings").select("vec_id", cut.alias("toks"))
    query = tokens.groupBy().agg(F.min_by("toks", "vec_id")).scalar()
    return tokens.withColumn("qt", query).select("vec_id", F.round(retrieval.maxsim(F.col("qt"), F.col("toks")), 5).alias("score"))


@R.add(
    "rerank_prefix",
    """WITH l AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, doc_id % 7 AS s FROM documents WHERE n_chars IS NOT NULL ORDER BY n_chars DESC, doc_id LIMIT 50)
    SELECT doc_id, rank, row_number() OVER (ORDER BY CASE WHEN rank <= 20 THEN 0 ELSE 1 END, CASE WHEN rank <= 20 THEN -s ELSE 0 END, rank, doc_id) AS new_rank FROM l""",
)
def rerank_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The longest fifty texts; the first twenty in the order of another score."""
    rows = table(spark, d, "documents").filter("n_chars IS NOT NULL").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    listed = retrieval.ranked(rows, "doc_id", 50).withColumn("s", (F.col("doc_id") % 7).cast("double"))
    return retrieval.rerank_prefix(listed, "doc_id", 20, "s").select("doc_id", "rank", "new_rank")


@R.add(
    "phrase_boost",
    """SELECT chunk_id, round(least((CASE WHEN contains(t, 'หน่วยกิต') OR contains(t, 'ชั่วโมงบรรยาย') OR contains(t, 'credit') THEN 1.2 ELSE 1.0 END)
    * (CASE WHEN contains(t, 'วิชาบังคับ') OR contains(t, 'วิชาเลือก') OR contains(t, 'หมวดวิชาเฉพาะ') OR contains(t, 'ภาคทัณฑ์') OR contains(t, 'พ้นสภาพ') OR contains(t, 'elective') THEN 1.25 ELSE 1.0 END)
    * (CASE WHEN contains(t, 'แผนการศึกษา') OR contains(t, 'ภาคฤดูร้อน') OR contains(t, 'สหกิจศึกษา') OR contains(t, 'ปีการศึกษา') OR contains(t, 'semester') THEN 1.15 ELSE 1.0 END)
    * (CASE WHEN contains(t, 'วิทยาศาสตรบัณฑิต') OR contains(t, 'ปริญญาเอก') OR contains(t, 'ดุษฎีนิพนธ์') OR contains(t, 'thesis') THEN 1.3 ELSE 1.0 END), 3.0), 6) AS boosted FROM (SELECT chunk_id, COALESCE(content_text, '') AS t FROM chunk)""",
)
def phrase_boost(spark: SparkSession, d: str) -> DataFrame:
    terms: dict[str, list[str]] = {}
    for r in table(spark, d, "lexicon_term").select("category", "term").orderBy("term_id").collect():  # a fixed list of a few terms
        terms.setdefault(r["category"], []).append(r["term"])
    chunks = table(spark, d, "chunk").select("chunk_id", F.coalesce("content_text", F.lit("")).alias("t"), F.lit(1.0).alias("score"))
    return retrieval.phrase_boost(chunks, F.col("t"), "score", terms, BOOSTS).select("chunk_id", F.round("boosted", 6).alias("boosted"))


@R.add("unembedded_documents", "SELECT doc_id FROM documents d WHERE length(text) > 10 AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def unembedded_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("length(text) > 10").select("doc_id")
    return relational.not_yet(docs, table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), ["doc_id"])


@R.add("embedding_stub")
def embedding_stub(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "course").select("course_id", F.concat_ws(" ", "name_th", "name_en").alias("t"))
    return rows.select("course_id", retrieval.stub_embedding(F.col("t"), 16).alias("vector"))
