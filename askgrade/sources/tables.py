"""Table sources: posts by score band, JDBC, site tags, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgrade.constants import BAD_BELOW, GOOD_ABOVE
from askgrade.operators.datasets import marked, stripped
from askgrade.operators.questions import labelled_questions
from askgrade.schemas import QUESTION


#: Bytes of a file (compressed) for a partition.
PART_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table of one file, which a single task would read.

    Everything up to the next shuffle would stay in that task. A large file gets more partitions than
    there are cores, so that a task does not grow with the table. Tables of several files are left as
    they are.
    """
    if len(df.inputFiles()) != 1:
        return df
    row = df.select("_metadata.file_size").first()
    parts = -(-row.file_size // PART_BYTES) if row else 1
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, parts))


def score_band(score: Column) -> Column:
    """Directory value for partition pruning: negative, unvoted or positive."""
    return F.when(score < 0, "neg").when(score > 0, "pos").otherwise("mid")


def write_posts_by_band(posts: DataFrame, path: str) -> None:
    """Posts as parquet with one directory per score band.

    Both classes lie in the outer bands, so reading a class never opens the files of
    the large middle band nor of the other class.
    """
    posts.withColumn("score_band", score_band(F.col("Score"))).write.partitionBy(
        "score_band"
    ).parquet(path)


def read_posts_by_band(
    spark: SparkSession, path: str, good_above: int = GOOD_ABOVE, bad_below: int = BAD_BELOW
) -> DataFrame:
    """Posts of both classes; prunes directories by band and row groups by score."""
    bands = []
    if bad_below <= 0:
        bands.append((F.col("score_band") == "neg") & (F.col("Score") < bad_below))
    if good_above >= 0:
        bands.append((F.col("score_band") == "pos") & (F.col("Score") > good_above))
    schema = T.StructType([*QUESTION.fields, T.StructField("score_band", T.StringType())])
    posts = spark.read.schema(schema).parquet(path)
    if len(bands) < 2:
        outside = (F.col("Score") < bad_below) | (F.col("Score") > good_above)
        return posts.where(outside).drop("score_band")
    return posts.where(bands[0] | bands[1]).drop("score_band")


def read_posts_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    lowest_id: int,
    highest_id: int,
    partitions: int,
    **options: str,
) -> DataFrame:
    """Posts from a database, read in parallel by Id range; filters are pushed down."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, **options)
        .option("partitionColumn", "Id")
        .option("lowerBound", lowest_id)
        .option("upperBound", highest_id)
        .option("numPartitions", partitions)
        .load()
    )


def load_tags(tags: DataFrame) -> DataFrame:
    """All tag names as text, in alphabetical order."""
    return tags.select(F.col("TagName").cast("string").alias("TagName")).orderBy("TagName")


def preview(df: DataFrame, limit: int = 1000, order: str | None = None) -> DataFrame:
    """S3: the first rows of a table; give ``order`` for a determined result."""
    return (df.orderBy(order) if order else df).limit(limit)


def load_questions(
    posts: DataFrame,
    variant: str,
    limit: int | None = None,
    site_tags: DataFrame | None = None,
    exclude_site_tags: bool = False,
    exclude_assignment: bool = False,
    good_above: int = GOOD_ABOVE,
    bad_below: int = BAD_BELOW,
) -> DataFrame:
    """One of the data-set variants ``raw``, ``stripped`` or ``marked``."""
    raw = labelled_questions(posts, limit, good_above, bad_below)
    if variant == "raw":
        return raw
    if variant == "stripped":
        return stripped(raw)
    if variant == "marked":
        return marked(raw, site_tags, exclude_site_tags, exclude_assignment)
    raise ValueError(f"unknown variant {variant!r}")
