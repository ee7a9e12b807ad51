"""The cleaner with its switches (T16), and the preparation before scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrade.functions.columns import computed_once
from askgrade.functions.html import clean_html
from askgrade.functions.markers import (
    mark_assignment,
    mark_attached_tags,
    mark_external_tags,
    mark_hexadecimal,
    mark_homework,
    mark_numeric,
    mark_version_number,
)
from askgrade.functions.stem import stem_text


def clean(
    df: DataFrame,
    markers: bool = True,
    site_tags: DataFrame | None = None,
    exclude_site_tags: bool = False,
    exclude_assignment: bool = False,
    version_numbers: bool = False,
    match: str = "substring",
    exact: bool = True,
    compat: bool = False,
) -> DataFrame:
    """HTML to text, with or without all markers, in the fixed order.

    Rows whose body is not text are dropped (F3).
    """
    df = df.where(F.col("Body").isNotNull())
    if not markers:
        return clean_html(df, "Body", exact=exact, compat=compat)
    if not exclude_site_tags and site_tags is None:
        raise ValueError("site_tags is needed unless exclude_site_tags is set")
    df = clean_html(df, "Body", replaced=("code", "a"), exact=exact)
    text = mark_hexadecimal(F.col("Body"))
    text = mark_numeric(mark_version_number(text, version_numbers))
    df = computed_once(df, "Body", text)
    df = mark_attached_tags(df, match=match)
    if not exclude_site_tags:
        df = mark_external_tags(df, site_tags, match=match)
    df = mark_homework(df)
    return df if exclude_assignment else mark_assignment(df)


def prepare_for_scoring(df: DataFrame) -> DataFrame:
    """Lowercase, hexadecimal, numeric, homework, stem; nothing else."""
    text = mark_numeric(mark_hexadecimal(F.lower("Body")))
    return stemmed(mark_homework(computed_once(df, "Body", text)))


def stemmed(df: DataFrame) -> DataFrame:
    """Body with every whitespace token stemmed."""
    stems = df.withColumn("_stems", stem_text("Body"))
    return computed_once(stems, "Body", F.col("_stems")).select(df.columns)
