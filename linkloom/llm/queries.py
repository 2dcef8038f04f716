"""The queries of this subpackage, their production parameters, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import exact_dedup, mixing, ngram_join, packing, personal, quality, repeats, token_counts, token_files, toxicity
from linkloom.llm.common import read_documents


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_documents(spark, sf_dir), vocab="byte_bpe_50k.json", limit=1024)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_documents(spark, sf_dir), pieces="piece_bpe_32k.model", words="word_bpe_49k.json")


def op3_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal(read_documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read_documents(spark, sf_dir), powers=(0.5, 0.7, 0.8), keep=0.5)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.drop_repeats(read_documents(spark, sf_dir), size=100)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read_documents(spark, sf_dir), size=3, num=9, den=10)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(read_documents(spark, sf_dir), vocab="word_bpe_49k.json", end_id=1))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_documents(spark, sf_dir)).drop("row_id")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_quality_rules, op3_personal, op4_toxicity, op5_mixing, op6_repeats, op7_ngram_join, op8_packing, op9_exact_dedup, op10_token_files)}

ORACLE = {
    "op9_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY ALL)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
    """,
}
