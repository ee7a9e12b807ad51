"""Evaluation reports as aggregations.

Input is a DataFrame with integer ``label`` and ``prediction`` in {-1, 1}.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(predictions: DataFrame) -> DataFrame:
    """A1: share of rows predicted as labelled."""
    hit = (F.col("label") == F.col("prediction")).cast("double")
    return predictions.agg(F.avg(hit).alias("accuracy"))


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """A2: one row per true class, one column per predicted class."""
    return (
        predictions.groupBy("label")
        .agg(
            F.count_if(F.col("prediction") == -1).alias("predicted_bad"),
            F.count_if(F.col("prediction") == 1).alias("predicted_good"),
        )
        .orderBy("label")
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def classification_report(predictions: DataFrame) -> DataFrame:
    """A3: precision, recall, f1 and support per class, and their weighted average.

    One aggregation over the rows; the rest works on its two classes.
    """
    counts = predictions.agg(
        *[
            F.count_if((F.col("label") == t) & (F.col("prediction") == p)).alias(f"n_{i}{j}")
            for i, t in enumerate((-1, 1))
            for j, p in enumerate((-1, 1))
        ]
    )
    classes = counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("class"),
                        F.col(f"n_{i}{i}").alias("hits"),
                        (F.col(f"n_0{i}") + F.col(f"n_1{i}")).alias("predicted"),
                        (F.col(f"n_{i}0") + F.col(f"n_{i}1")).alias("support"),
                    )
                    for i, name in enumerate(("-1", "1"))
                ]
            )
        )
    )
    precision = _ratio(F.col("hits"), F.col("predicted"))
    recall = _ratio(F.col("hits"), F.col("support"))
    rows = classes.select(
        "class", precision.alias("precision"), recall.alias("recall"), "support"
    ).withColumn(
        "f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )
    total = F.sum("support")
    average = rows.agg(
        *[_ratio(F.sum(F.col(m) * F.col("support")), total).alias(m) for m in ("precision", "recall", "f1")],
        total.alias("support"),
    ).withColumn("class", F.lit("avg / total"))
    return rows.unionByName(average).select("class", "precision", "recall", "f1", "support")


def cv_summary(fold_scores: DataFrame) -> DataFrame:
    """A4: mean and population standard deviation over folds per parameter point."""
    return fold_scores.groupBy("point").agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score")
    )


def best_point(summary: DataFrame) -> DataFrame:
    """A5: the point with the best mean score; the first one wins a tie."""
    return summary.orderBy(F.desc("mean_score"), "point").limit(1)


def marker_counts(df: DataFrame, markers: dict[str, str]) -> DataFrame:
    """Per class, how many questions contain each marker; one pass."""
    return df.groupBy("label").agg(
        F.count("*").alias("questions"),
        *[F.count_if(F.contains("Body", F.lit(m))).alias(name) for name, m in markers.items()],
    )


def class_sizes(df: DataFrame) -> DataFrame:
    """Questions per class."""
    return df.groupBy("label").agg(F.count("*").alias("questions"))


def compare_with_baseline(metrics: DataFrame, baseline: str) -> DataFrame:
    """Each variant's metrics next to the baseline's, with the difference.

    ``metrics`` has columns (variant, metric, value) and one row per variant and metric.
    """
    base = metrics.where(F.col("variant") == baseline).select(
        "metric", F.col("value").alias("baseline_value")
    )
    return metrics.join(base, "metric").select(
        "variant",
        "metric",
        "value",
        "baseline_value",
        (F.col("value") - F.col("baseline_value")).alias("delta"),
    )


def metric_rows(variants: dict[str, DataFrame]) -> DataFrame:
    """Accuracy, f1 and support of several prediction sets as (variant, metric, value)."""
    parts = []
    for name, predictions in variants.items():
        report = classification_report(predictions).where(F.col("class") == "avg / total")
        measured = report.select(
            F.lit(name).alias("variant"),
            F.expr("stack(3, 'precision', precision, 'recall', recall, 'f1', f1) as (metric, value)"),
        )
        parts.append(measured)
    return reduce(DataFrame.unionByName, parts)
