"""Data sets as CSV, spaces and line breaks intact (S4, S5, and tag files for S2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrade.schemas import LABELLED_CSV, TAGS_CSV

_COMMON = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss",
    # markers keep their surrounding spaces
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}

# what a quoted empty field is read as, to tell it from a missing one
_QUOTED_NOTHING = "\ue000"


def write_csv(df: DataFrame, path: str) -> None:
    """Write a data set; the empty string stays different from NULL."""
    df.write.options(**_COMMON, emptyValue='""', nullValue="").csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read a data set back with its declared schema."""
    reader = spark.read.schema(schema).options(**_COMMON, multiLine="true", nullValue="")
    df = reader.option("emptyValue", _QUOTED_NOTHING).csv(path)
    texts = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    restored = {
        t: F.when(F.col(t) == _QUOTED_NOTHING, F.lit("")).otherwise(F.col(t)) for t in texts
    }
    return df.withColumns(restored)


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """S5 for files exported elsewhere: unnamed index first, integers such as 35409.0."""
    df = read_csv(spark, path, LABELLED_CSV)
    return df.withColumns(
        {c: F.col(c).cast("int") for c in ("AcceptedAnswerId", "OwnerUserId")}
    )


def read_tags_csv(spark: SparkSession, path: str) -> DataFrame:
    """Tag file; every name is read as text, so a tag called "nan" stays a tag."""
    return read_csv(spark, path, TAGS_CSV).select("TagName")
