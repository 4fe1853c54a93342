"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from throng.llm import abuse, bpe, canon, packing, personal, pieces, topn
from throng.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.found(table(spark, sf_dir, "comments"))


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.canonical_forms(table(spark, sf_dir, "comments")).select("cid", "text_canonical", "author_canonical").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.found(table(spark, sf_dir, "comments"))


def _abuse_model(spark: SparkSession, sf_dir: str) -> abuse.Model:
    return abuse.fit(table(spark, sf_dir, "moderation_labels"), table(spark, sf_dir, "abuse_terms"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.found(table(spark, sf_dir, "comments"), _abuse_model(spark, sf_dir))


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.score_comments(table(spark, sf_dir, "comments"), _abuse_model(spark, sf_dir))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(p4_scores(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.found(table(spark, sf_dir, "comments"), personal.figure_words(table(spark, sf_dir, "videos")))


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = table(spark, sf_dir, "comments")
    figures = personal.figure_words(table(spark, sf_dir, "videos"))
    return personal.redact(comments, personal.fit(personal.spans_table(comments, figures), figures)).select("cid", "text_redacted").distinct()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(table(spark, sf_dir, "documents"), capacity=packing.CAPACITY)


def p7_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.summary(p7_containers(spark, sf_dir), packing.CAPACITY)


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_documents(table(spark, sf_dir, "documents"), limit=512, overlap=48)


QUERIES = {f.__name__: f for f in (p1_found, p1_forms, p2_found, p4_found, p4_scores, p4_rates, p5_found, p5_redacted, p6_ids, p7_containers, p7_summary, p8_pieces)}

_P1 = f"""WITH rows AS (SELECT DISTINCT cid AS k, text AS v, {canon.duckdb_canonical("text")} AS c FROM comments WHERE cid IS NOT NULL AND text <> ''),
names AS (SELECT DISTINCT author AS v, {canon.duckdb_canonical("author")} AS c FROM comments WHERE author <> ''),
met AS (SELECT a.c, a.v, b.v AS w FROM (SELECT DISTINCT c, v FROM rows) a JOIN (SELECT DISTINCT c, v FROM rows) b ON a.c = b.c AND a.v < b.v)
SELECT DISTINCT 'text' AS field, least(x.k, y.k) AS key_a, greatest(x.k, y.k) AS key_b FROM met JOIN rows x ON x.v = met.v JOIN rows y ON y.v = met.w WHERE x.k <> y.k
UNION ALL SELECT 'author', a.v, b.v FROM names a JOIN names b ON a.c = b.c AND a.v < b.v"""

SQL = {
    "p1_found": _P1,
    "p1_forms": f"SELECT DISTINCT cid, {canon.duckdb_canonical('text')} AS text_canonical, {canon.duckdb_canonical('author')} AS author_canonical FROM comments",
    "p2_found": """WITH latest AS (SELECT cid, author, likes, row_number() OVER (PARTITION BY cid ORDER BY loaded_at DESC NULLS LAST, likes DESC NULLS LAST, author DESC NULLS LAST) AS n FROM comments WHERE cid IS NOT NULL),
placed AS (SELECT author, row_number() OVER (PARTITION BY author ORDER BY likes DESC, cid) AS place, cid FROM latest WHERE n = 1 AND author <> '' AND likes IS NOT NULL)
SELECT author, place, cid FROM placed WHERE place <= 3""",
}
