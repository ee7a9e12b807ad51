"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrade.llm import (
    alignment,
    class_lm,
    exact_dedup,
    jaccard_join,
    lexical_search,
    licenses,
    line_templates,
    packing,
    raking,
    rule_ensemble,
    sharding,
    spot_signatures,
    token_file,
)
from askgrade.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query
def op1_spot_signatures(spark, sf_dir):
    return spot_signatures.compare_with_next(documents(spark, sf_dir))


@_query
def op2_mix_to_target_weights(spark, sf_dir):
    return raking.mixed_sample(documents(spark, sf_dir))


@_query
def op3_best_fit_packing(spark, sf_dir):
    return packing.packed(documents(spark, sf_dir))


@_query
def op4_license_scan(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.array_join("expressions", "; ").alias("expressions"), "permitted",
    )


@_query
def op5_rule_ensemble(spark, sf_dir):
    return rule_ensemble.classify(
        documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    )


@_query
def op6_line_templates(spark, sf_dir):
    return line_templates.digest(documents(spark, sf_dir))


@_query
def op7_token_file(spark, sf_dir):
    return token_file.round_trip(documents(spark, sf_dir))


@_query
def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


@_query
def op9_jaccard_join(spark, sf_dir):
    return jaccard_join.linked(documents(spark, sf_dir), jaccard_join.CONTRACT)


@_query
def op10_class_lm(spark, sf_dir):
    return class_lm.scored(documents(spark, sf_dir))


@_query
def op11_lexical_search(spark, sf_dir):
    return lexical_search.search(
        spark.read.parquet(f"{sf_dir}/benchmark.parquet"), documents(spark, sf_dir)
    )


@_query
def op12_sampled_shards(spark, sf_dir):
    return sharding.placed(documents(spark, sf_dir)).drop("place")


@_query
def op13_token_alignment(spark, sf_dir):
    return alignment.aligned(documents(spark, sf_dir))
