"""Views of generic text tables as the engine's input.

The bundled test tables hold documents, not posts; these functions derive posts,
tags, predictions and HTML pages from whole tables by plain expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrade.schemas import QUESTION
from askgrade.sources.tables import spread

# --- fixed values: how a document number decides score and inserted markup
SCORE_STEP, SCORE_RANGE, SCORE_SHIFT = 7919, 241, 60
TERM = r"[\p{L}\p{N}_]{2,}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose text columns get worked on, spread over the cores."""
    return spread(table(spark, sf_dir, name))


def _every(n: int, *parts) -> Column:
    pieces = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.when(F.col("doc_id") % n == 0, F.concat(*pieces)).otherwise(F.lit(""))


def _body() -> Column:
    number = F.col("doc_id").cast("string")
    return F.concat(
        F.lit("<p>"),
        F.col("text"),
        F.lit("</p>"),
        _every(3, "<pre><code>x = ", number, "</code></pre>"),
        _every(4, '<p>see <a href="http://e.org/', number, '">', F.col("source"), "</a>.</p>"),
        _every(5, "<p>at 0x", number, " end</p>"),
        _every(7, "<p>this is homework for school</p>"),
        _every(11, "<p>my assignment is late</p>"),
    )


def _tags() -> Column:
    """The three longest terms of the whole text, ties in alphabetical order."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    keyed = F.transform(terms, lambda t: F.struct((-F.length(t)).alias("shortness"), t.alias("term")))
    longest = F.slice(F.sort_array(keyed), 1, 3)
    return F.array_join(F.transform(longest, lambda t: F.concat(F.lit("<"), t["term"], F.lit(">"))), "")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as questions, all twelve columns."""
    derived = {
        "Id": F.col("doc_id"),
        "Score": ((F.col("doc_id") * SCORE_STEP) % SCORE_RANGE - SCORE_SHIFT).cast("int"),
        "Body": _body(),
        "Title": F.substring_index("text", "\n", 1),
        "Tags": _tags(),
    }
    columns = [
        derived.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in QUESTION.fields
    ]
    return texts(spark, sf_dir, "documents").select(*columns)


def site_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tag that some question has."""
    tags = F.split(F.translate(_tags(), "<>", "  "), r"\s+")
    named = texts(spark, sf_dir, "documents").select(F.explode(tags).alias("TagName"))
    return named.where("TagName <> ''").distinct()


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality as the true class, absence of toxicity as the predicted one."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("Id"),
        (F.col("quality") * 2 - 1).cast("int").alias("label"),
        ((1 - F.col("toxic")) * 2 - 1).cast("int").alias("prediction"),
    )


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as (Id, Body)."""
    return texts(spark, sf_dir, "pages").select(
        F.col("page_id").alias("Id"), F.col("html").alias("Body")
    )
