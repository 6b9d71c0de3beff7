"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    exact_dedup,
    finite_state_count,
    language_id,
    lexical_search,
    line_dedup,
    near_dedup,
    packing,
    quality,
    streaming_bpe,
    token_alignment,
    token_files,
    top_k,
    toxicity,
)

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files_round_trip(documents(spark, sf_dir), BYTE_BPE, end_id=2)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source is a document's host, and its language the path within it."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score_quality(documents(spark, sf_dir), labels, host=F.col("source"), path=F.col("lang"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finite_state_count.count_tokens(documents(spark, sf_dir), BYTE_BPE, limit=512)


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = top_k.scaled(top_k.usable_vectors(table, "vec_id", "embedding"))
    return top_k.exact_top_k(vectors.where(F.col("id") % 100 == 0), vectors, k=10)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(documents(spark, sf_dir))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), words=3, percent=85)


def op9_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming_bpe.encode_and_decode(documents(spark, sf_dir), WORD_BPE)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), BYTE_BPE, capacity=1024, end_id=0)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokens(documents(spark, sf_dir), BYTE_BPE, PIECE_BPE)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.predict_toxicity(documents(spark, sf_dir), labels)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return lexical_search.rank_documents(documents(spark, sf_dir), items, k=10)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_language_id,
        op3_quality,
        op4_token_counts,
        op5_top_k,
        op6_line_dedup,
        op7_exact_dedup,
        op8_near_dedup,
        op9_streaming_bpe,
        op10_packing,
        op11_token_alignment,
        op12_toxicity,
        op13_lexical_search,
    )
}

ORACLE_SQL = {
    "op5_top_k": """
        WITH usable AS (
            SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.v, c.v)]) AS BIGINT) AS score
            FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT query_id, vec_id, score,
                   CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op7_exact_dedup": """
        WITH hashed AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                            'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents
        ), grouped AS (
            SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM hashed GROUP BY text_sha256
        )
        SELECT h.doc_id, g.keep_id, g.group_size, h.doc_id = g.keep_id AS kept, h.text_sha256
        FROM hashed h JOIN grouped g USING (text_sha256)
    """,
    "op13_lexical_search": r"""
        WITH counted AS (
            SELECT doc_id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), held AS (
            SELECT row_number() OVER () AS place, doc_id, terms, CAST(len(terms) AS BIGINT) AS n
            FROM counted WHERE len(terms) > 0
        ), whole AS (
            SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS length FROM held
        ), asked AS (
            SELECT item_id, term, count(*) AS times
            FROM (SELECT item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
            GROUP BY item_id, term
        ), postings AS (
            SELECT place, doc_id, n, term, count(*) AS tf
            FROM (SELECT place, doc_id, n, unnest(terms) AS term FROM held)
            WHERE term IN (SELECT term FROM asked)
            GROUP BY place, doc_id, n, term
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM postings, whole GROUP BY term
        ), impacts AS (
            SELECT place, doc_id, term,
                   w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // length))) AS impact
            FROM postings JOIN weights USING (term), whole
        ), scored AS (
            SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score
            FROM asked JOIN impacts USING (term) WHERE doc_id IS NOT NULL GROUP BY item_id, place, doc_id
        ), ranked AS (
            SELECT item_id, doc_id, score,
                   CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
            FROM scored WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
}
