"""Labelled questions: projection, class predicate, limit, union, length, index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrade.constants import BAD, BAD_BELOW, GOOD, GOOD_ABOVE, QUESTION_COLUMNS
from askgrade.operators.order_stats import key_at_ranks


def vote_thresholds(good_above=None, bad_below=None) -> tuple[int, int]:
    """thresholds as given, or both defaults when either cannot be used."""
    try:
        above = GOOD_ABOVE if good_above is None else int(good_above)
        below = BAD_BELOW if bad_below is None else int(bad_below)
    except (TypeError, ValueError):
        return GOOD_ABOVE, BAD_BELOW
    return above, below


def class_label(good_above: int = GOOD_ABOVE, bad_below: int = BAD_BELOW) -> Column:
    """-1 for bad, 1 for good, NULL between the thresholds."""
    score = F.col("Score")
    return F.when(score < bad_below, F.lit(BAD)).when(score > good_above, F.lit(GOOD))


def read_class(
    posts: DataFrame, label: int, good_above: int = GOOD_ABOVE, bad_below: int = BAD_BELOW
) -> DataFrame:
    """The twelve columns of one class with its constant label."""
    score = F.col("Score")
    wanted = score < bad_below if label == BAD else score > good_above
    return posts.where(wanted).select(*QUESTION_COLUMNS, F.lit(label).alias("label"))


def first_per_class(labelled: DataFrame, limit: int) -> DataFrame:
    """L1: the ``limit`` rows with the smallest Id of every class.

    Only (label, Id) take part in finding the last Id of each class; the wide rows
    are then filtered where they are.
    """
    last = key_at_ranks(labelled, "label", "Id", "Id", lambda n: [F.lit(limit)])
    bounds = F.broadcast(last.select("label", F.col("key").alias("_last")))
    return (
        labelled.join(bounds, "label", "left")
        .where(F.col("_last").isNull() | (F.col("Id") <= F.col("_last")))
        .select(labelled.columns)
    )


def labelled_questions(
    posts: DataFrame,
    limit: int | None = None,
    good_above: int = GOOD_ABOVE,
    bad_below: int = BAD_BELOW,
) -> DataFrame:
    """Both classes appended (U1), optionally limited per class, bodies as they are.

    One scan with a two-sided predicate replaces a query per class; ``length`` is
    taken here and not renewed by later steps (P3).
    """
    score = F.col("Score")
    both = (
        posts.where((score < bad_below) | (score > good_above))
        .select(*QUESTION_COLUMNS)
        .withColumn("label", class_label(good_above, bad_below))
    )
    if limit is not None:
        both = first_per_class(both, limit)
    return with_length(both)


def with_length(df: DataFrame) -> DataFrame:
    """Characters in Body."""
    return df.withColumn("length", F.length("Body"))


def with_row_index(df: DataFrame) -> DataFrame:
    """Contiguous 0-based ``row_idx``, bad rows first, then by Id.

    Range-partitioned sort plus per-partition offsets; no single-task window.
    """
    import pyspark.pandas as ps

    with ps.option_context("compute.default_index_type", "distributed-sequence"):
        return df.orderBy("label", "Id").pandas_api().to_spark(index_col="row_idx")
