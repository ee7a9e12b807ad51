"""Labelled feature vectors as libsvm text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrade.session import new_path


def write_libsvm(df: DataFrame, path: str) -> None:
    """Columns ``label`` and ``features``, written with one-based indices."""
    df.select(F.col("label").cast("double").alias("label"), "features").write.format("libsvm").save(path)


def read_libsvm(
    spark: SparkSession, path: str, num_features: int, zero_based: bool = False
) -> DataFrame:
    """Read libsvm text; ``zero_based`` is for files that count features from 0.

    Such a file is rewritten with shifted indices by a row-wise job first, since the
    built-in reader accepts one-based indices only.
    """
    if zero_based:
        parts = F.split(F.regexp_replace("value", r"\s*#.*$", ""), r"\s+")
        shifted = F.transform(
            F.filter(F.slice(parts, 2, F.size(parts)), lambda p: p != ""),
            lambda p: F.concat_ws(
                ":",
                (F.substring_index(p, ":", 1).cast("int") + 1).cast("string"),
                F.substring_index(p, ":", -1),
            ),
        )
        lines = spark.read.text(path).where("not value rlike '^\\\\s*(#|$)'")
        path = new_path(spark, "libsvm")
        lines.select(
            F.concat_ws(" ", F.element_at(parts, 1), F.array_join(shifted, " ")).alias("value")
        ).write.text(path)
    return spark.read.format("libsvm").option("numFeatures", num_features).load(path)
