"""Class recoding, hold-out split and stratified folds (M0-M2), all deterministic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrade.constants import N_FOLDS, TEST_SIZE
from askgrade.operators.order_stats import key_at_ranks


def to_binary(label: Column) -> Column:
    """M0: -1/1 to 0.0/1.0."""
    return (label + 1) / F.lit(2.0)


def from_binary(prediction: Column) -> Column:
    """M0 reversed: 0.0/1.0 to -1/1."""
    return (prediction * 2 - 1).cast("int")


def hash_key(seed: int) -> Column:
    return F.md5(F.concat(F.col("Id").cast("string"), F.lit(f":{seed}")))


def _last_test_hash(df: DataFrame, seed: int, test_size: float) -> DataFrame:
    """One row: the hash of rank ``ceil(test_size * n)``."""
    hashed = df.select(F.lit(0).alias("all"), hash_key(seed).alias("hash")).withColumn(
        "position", F.conv(F.substring("hash", 1, 15), 16, 10).cast("double")
    )
    return key_at_ranks(hashed, "all", "hash", "position", lambda n: [F.ceil(n * F.lit(test_size))])


def holdout_split(df: DataFrame, seed: int = 0, test_size: float = TEST_SIZE) -> DataFrame:
    """M1: ``is_test`` for exactly ``ceil(test_size * n)`` rows, in md5 order.

    The hash at that rank is found by ``key_at_ranks`` and compared per row, so the
    wide rows are neither sorted nor moved.
    """
    limit = _last_test_hash(df, seed, test_size).select("key").scalar()
    return df.withColumn("is_test", F.coalesce(hash_key(seed) <= limit, F.lit(False)))


def fold_ends(df: DataFrame, k: int = N_FOLDS) -> DataFrame:
    """Last Id of each fold but the last, per class: at most ``k - 1`` rows a class."""

    def last_ranks(n: Column) -> list[Column]:
        size, extra = F.floor(n / k), n % k
        return [size * i + F.least(F.lit(i).cast("long"), extra) for i in range(1, k)]

    return key_at_ranks(df, "label", "Id", "Id", last_ranks)


def stratified_folds(df: DataFrame, k: int = N_FOLDS) -> DataFrame:
    """M2: unshuffled folds 0..k-1, contiguous in Id within each class.

    Sizes follow ``ntile(k)``: the first ``n mod k`` folds of a class hold one more row.
    """
    bounds = fold_ends(df, k).groupBy("label").agg(F.collect_list("key").alias("_ends"))
    ended = F.size(F.filter("_ends", lambda end: end < F.col("Id")))
    return (
        df.join(F.broadcast(bounds), "label", "left")
        .withColumn("fold", F.when(F.col("_ends").isNull(), 0).otherwise(ended))
        .select(*df.columns, "fold")
    )


def with_fixed_folds(df: DataFrame, k: int = N_FOLDS) -> DataFrame:
    """M2 for data that many jobs read: the few fold ends become constants."""
    ended = F.lit(0)
    for row in fold_ends(df, k).select("label", "key").collect():
        passed = (F.col("label") == row["label"]) & (F.col("Id") > row["key"])
        ended = ended + passed.cast("int")
    return df.withColumn("fold", ended)


def with_fixed_split(df: DataFrame, seed: int = 0, test_size: float = TEST_SIZE) -> DataFrame:
    """M1 for data that many jobs read: the hash at the limit becomes a constant."""
    limit = _last_test_hash(df, seed, test_size).first()
    is_test = hash_key(seed) <= limit["key"] if limit else F.lit(False)
    return df.withColumn("is_test", is_test)
