"""The registered queries of this package: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelcast.llm import (
    op1_voronoi,
    op2_tokens,
    op3_mixing,
    op4_decontam,
    op5_toxicity,
    op6_urls,
    op7_quality,
    op8_simhash,
    op9_warc,
    op10_sharding,
    op11_ngram_join,
    op12_whitening,
    op13_codes,
)
from panelcast.llm.frames import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def op1_voronoi_knn_join(spark: SparkSession, folder: str) -> DataFrame:
    return op1_voronoi.search(read_table(spark, folder, "embeddings"))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return op2_tokens.count_tokens(read_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return op3_mixing.mix(read_table(spark, folder, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return op4_decontam.contaminated(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op5_toxicity_grammar(spark: SparkSession, folder: str) -> DataFrame:
    return op5_toxicity.classify(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op6_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return op6_urls.judge(read_table(spark, folder, "pages"), op6_urls.rule_table(spark))


def op7_quality_nbsvm(spark: SparkSession, folder: str) -> DataFrame:
    return op7_quality.classify(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op8_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return op8_simhash.near_duplicates(read_table(spark, folder, "documents"))


def op9_warc_normaliser(spark: SparkSession, folder: str) -> DataFrame:
    return op9_warc.round_trip(read_table(spark, folder, "pages"))


def op10_extendible_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return op10_sharding.assign(read_table(spark, folder, "documents"))


def op11_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return op11_ngram_join.join(read_table(spark, folder, "documents"))


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return op12_whitening.whiten(read_table(spark, folder, "embeddings"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return op13_codes.compress(read_table(spark, folder, "embeddings"))


QUERIES |= {
    f.__name__: f
    for f in (
        op1_voronoi_knn_join,
        op2_token_counts,
        op3_source_mixing,
        op4_benchmark_decontamination,
        op5_toxicity_grammar,
        op6_url_rules,
        op7_quality_nbsvm,
        op8_simhash_near_dedup,
        op9_warc_normaliser,
        op10_extendible_sharding,
        op11_ngram_jaccard_join,
        op12_embedding_whitening,
        op13_vector_codes,
    )
}
SQL |= {
    "op1_voronoi_knn_join": op1_voronoi.SQL,
    "op3_source_mixing": op3_mixing.SQL,
    "op6_url_rules": op6_urls.SQL,
    "op9_warc_normaliser": op9_warc.SQL,
    "op10_extendible_sharding": op10_sharding.SQL,
    "op11_ngram_jaccard_join": op11_ngram_join.SQL,
    "op13_vector_codes": op13_codes.SQL,
}
