"""The opN_<name> queries: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exactdup, langid, neardup, packing, pii, quality, substring, topk, toxicity
from .common import id_remainder, load


def op1_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_rlz_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(load(spark, sf_dir, "documents"), with_text=False).withColumnRenamed("id", "doc_id")


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), with_ids=False).withColumnRenamed("id", "doc_id")


def op4_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_lsm_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exactdup.mark(load(spark, sf_dir, "documents"), largest=True)
    return marked.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(id_remainder(F.col("doc_id"), 3) != 1))
    return toxicity.score(docs, model).select(F.col("id").alias("doc_id"), (id_remainder(F.col("id"), 3) == 1).alias("held_out"), "score", "predicted", "n_hits", "hits")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = langid.train(docs.where(id_remainder(F.col("doc_id"), 3) != 1))
    return langid.identify(docs, model).select(F.col("id").alias("doc_id"), (id_remainder(F.col("id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(load(spark, sf_dir, "documents"), with_ids=False).withColumnRenamed("id", "doc_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    forest = quality.train(docs, labels.where(id_remainder(F.col("doc_id"), 4) != 2))
    scored = quality.score(docs, forest)
    return scored.select(F.col("id").alias("doc_id"), (id_remainder(F.col("id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_crf": op1_pii_crf,
    "op2_rlz_substring_dedup": op2_rlz_substring_dedup,
    "op3_harmonic_packing": op3_harmonic_packing,
    "op4_simhash_vptree": op4_simhash_vptree,
    "op5_lsm_exact_dedup": op5_lsm_exact_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_nra_topk": op8_nra_topk,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op2_rlz_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
        ), starts AS (
            SELECT doc_id, p, array_to_string(words[p:p + 34], ' ') AS passage FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS p FROM d WHERE len(words) >= 35)
        ), found AS (
            SELECT doc_id, p FROM starts WHERE passage IN (SELECT passage FROM starts GROUP BY passage HAVING count(*) > 1)
        ), covered AS (
            SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS p FROM found
        ), kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
            FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d) ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id
        ), factors AS (
            SELECT doc_id, min(p) - 1 AS first, max(p) - min(p) + 35 AS n
            FROM (SELECT doc_id, p, sum(cut) OVER (PARTITION BY doc_id ORDER BY p) AS run
                  FROM (SELECT doc_id, p, CAST(coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 35, TRUE) AS INTEGER) AS cut FROM found))
            GROUP BY doc_id, run
        )
        SELECT doc_id, len(words) AS n_words, len(words) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(first || ':' || n, ',' ORDER BY first) AS spans FROM factors GROUP BY doc_id) USING (doc_id)""",
    "op5_lsm_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op8_nra_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
        )
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5""",
}
