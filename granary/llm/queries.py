"""The queries of this subpackage, one for each operator, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Folder of the public tokenizer vocabularies; never copied into the repository.
TOKENIZERS = os.environ.get("GRANARY_TOKENIZERS", "")


def vocabulary(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(spark, table(spark, sf_dir, "documents"), shards=24)


def op1_kneser_ney_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_lm import held_out_scores

    return held_out_scores(table(spark, sf_dir, "documents"))


def op2_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import piece_digests

    return piece_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    folder, manifest = write_token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, folder, manifest)


def op4_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op5_factorization_machine_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lempel_ziv_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint_with_edits

    return fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op7_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=1, capacity=2048)


def op9_multi_index_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .topk import integer_vectors, top_k

    return top_k(integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, k=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kneser_ney_scores": op1_kneser_ney_scores,
    "op2_sentencepiece_viterbi": op2_sentencepiece_viterbi,
    "op3_token_files": op3_token_files,
    "op4_deobfuscated_pii": op4_deobfuscated_pii,
    "op5_factorization_machine_toxicity": op5_factorization_machine_toxicity,
    "op6_lempel_ziv_fingerprints": op6_lempel_ziv_fingerprints,
    "op7_cost_balanced_packing": op7_cost_balanced_packing,
    "op8_histogram_sort_shards": op8_histogram_sort_shards,
    "op9_multi_index_near_dedup": op9_multi_index_near_dedup,
    "op10_threshold_top_k": op10_threshold_top_k,
}

ORACLE_SQL: dict[str, str] = {
    "op9_multi_index_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT r, doc_id, CASE WHEN len(w) = 0 THEN []
                WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
            FROM words
        ), shingles AS (
            SELECT r, len(s) AS n, unnest(s) AS x FROM sets
        ), links AS (
            SELECT a.r AS a, b.r AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.r < b.r
            GROUP BY a.r, b.r HAVING 100 * count(*) >= 85 * (min(a.n) + min(b.n) - count(*))
        ), edges AS (
            SELECT a, b FROM links UNION SELECT b, a FROM links
        ), reach AS (
            SELECT r AS a, r AS b FROM sets UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b
        )
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, h.head AS component_id, s.doc_id = h.head AS kept
        FROM sets s JOIN (SELECT reach.a AS r, min(t.doc_id) AS head FROM reach JOIN sets t ON t.r = reach.b GROUP BY reach.a) h USING (r)
    """,
    "op10_threshold_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
}
