"""The data-set variants: raw, stripped, marked, one marker each, extraction pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrade import constants as C
from askgrade.functions.columns import computed_once
from askgrade.functions.html import clean_html
from askgrade.functions.markers import (
    mark_assignment,
    mark_attached_tags,
    mark_external_tags,
    mark_hexadecimal,
    mark_homework,
    mark_numeric,
)
from askgrade.operators.clean import clean
from askgrade.operators.questions import with_length
from askgrade.session import materialise

SINGLE_MARKERS = ("codeblock", "links", "homework", "numeric", "hexadecimal", "tags")


def stripped(raw: DataFrame, exact: bool = True) -> DataFrame:
    """Text without HTML, lowercased after stripping; ``length`` stays as it was."""
    return computed_once(clean(raw, markers=False, exact=exact), "Body", F.lower("Body"))


def marked(
    raw: DataFrame,
    site_tags: DataFrame | None = None,
    exclude_site_tags: bool = False,
    exclude_assignment: bool = False,
    exact: bool = True,
) -> DataFrame:
    """D3: lowercased first, all markers, ``length`` of the marked text."""
    lowered = raw.withColumn("Body", F.lower("Body"))
    done = clean(
        lowered,
        site_tags=site_tags,
        exclude_site_tags=exclude_site_tags,
        exclude_assignment=exclude_assignment,
        exact=exact,
    )
    return with_length(done)


def single_marker(
    raw: DataFrame,
    marker: str,
    site_tags: DataFrame | None = None,
    exact: bool = True,
    base: DataFrame | None = None,
) -> DataFrame:
    """D4a-D4f: the set with one kind of marker only.

    Code and links are marked on the raw markup, which is stripped afterwards and
    not lowercased; the others work on the stripped set, which is made from ``raw``
    unless it is given as ``base``.
    """
    if marker in ("codeblock", "links"):
        element = {"codeblock": "code", "links": "a"}[marker]
        present = raw.where(F.col("Body").isNotNull())
        return clean_html(present, "Body", (element,), unescape_first=False, exact=exact)
    base = stripped(raw, exact) if base is None else base
    if marker == "homework":
        return mark_assignment(mark_homework(base))
    if marker == "numeric":
        return computed_once(base, "Body", mark_numeric(F.col("Body")))
    if marker == "hexadecimal":
        return computed_once(base, "Body", mark_hexadecimal(F.col("Body")))
    if marker == "tags":
        own = mark_attached_tags(base)
        return own if site_tags is None else mark_external_tags(own, site_tags)
    raise ValueError(f"unknown marker {marker!r}; choose one of {SINGLE_MARKERS}")


def all_single_markers(
    raw: DataFrame, site_tags: DataFrame | None = None, exact: bool = True
) -> DataFrame:
    """The six single-marker sets as one table with a ``marker`` column.

    The stripped set that four of them start from is written once.
    """
    base = materialise(stripped(raw, exact), "stripped")
    sets = [
        single_marker(raw, m, site_tags, exact, base).withColumn("marker", F.lit(m))
        for m in SINGLE_MARKERS
    ]
    return reduce(DataFrame.unionByName, sets)


def has_any_marker(markers: list[str], padded: bool = False) -> Column:
    """Body contains one of the markers, surrounding spaces included.

    ``padded`` also finds a marker at the very start or end of the text.
    """
    text = F.concat(F.lit(" "), F.col("Body"), F.lit(" ")) if padded else F.col("Body")
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers])


def extraction_pair(
    raw: DataFrame,
    marked_set: DataFrame,
    markers: list[str],
    padded: bool = False,
    base: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows having one of the markers, in marked and in stripped form.

    The kept rows are written once; only their raw counterparts are then cleaned, or taken from
    the stripped set if that is given as ``base``.
    """
    kept = materialise(marked_set.where(has_any_marker(markers, padded)), "kept")
    if base is not None:
        return kept, base.join(kept.select("Id"), "Id", "left_semi")
    return kept, stripped(raw.join(kept.select("Id"), "Id", "left_semi"))


# --- fixed values: the extraction sets and the markers that select their rows
EXTRACTION_SETS = {
    "hexadecimal": [C.HEXADECIMAL],
    "numeric": [C.NUMERIC],
    "links": [C.LINKS],
    "codeblock": [C.CODEBLOCK],
    "tags": [C.ATTACHED_TAG, C.EXTERNAL_TAG],
    "homework": [C.HOMEWORK, C.ASSIGNMENT],
    "all": [C.CODEBLOCK, C.LINKS, C.ATTACHED_TAG, C.HEXADECIMAL, C.NUMERIC, C.HOMEWORK],
}
