"""Exact duplicates by sorting contents.

Texts are equal when identical after deleting white space. Sampled splitters deal the rows
into ranges of the normalised text, each range is sorted (spilling to disk as needed), equal
texts become neighbours, and the window over them compares neighbours in full.

* Splitters are sampled on a short prefix and a 64-bit digest of the text, so a sample stays
  small however long the texts are; the sort and the comparison use the whole text.
* A text with very many copies would end in one range. Each row has one of ``SALTS`` salts
  after its text in the sort order, so such a text forms several runs; the runs of a text,
  a few narrow rows, are then merged by the text's SHA-256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askgrade.llm.common import whole_texts
from askgrade.session import materialise

SALTS = 64
PREFIX = 32
SPACE_CHARS = " \t\n\x0b\f\r"  # [\x20\x09-\x0D]


def exact_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    Of equal texts the row with most code points in the original text stays, then the one with
    the smallest ``doc_id`` (a null id comes last). A null text is empty, and all empty texts
    are equal. Of repeated rows (same id, same text) exactly one stays. An empty table gives an
    empty result.
    """
    text = F.col("text")
    for char in SPACE_CHARS:
        text = F.replace(text, F.lit(char), F.lit(""))
    rows = (
        whole_texts(documents)
        .select("doc_id", (-F.length("text")).alias("shortness"), text.alias("norm"))
        .select(
            "*",
            F.substring("norm", 1, PREFIX).alias("prefix"),
            F.xxhash64("norm").alias("digest"),
            F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
        )
    )
    key = ["prefix", "digest", "salt"]
    best_first = [F.col("shortness"), F.col("doc_id").asc_nulls_last()]
    run = Window.partitionBy(*key, "norm")
    ordered = run.orderBy(*best_first)
    runs = materialise(
        rows.repartitionByRange(*key)
        .select(
            "doc_id",
            "salt",
            F.struct("shortness", F.isnull("doc_id").alias("no_id"), "doc_id").alias("place"),
            F.row_number().over(ordered).alias("nth"),
            "norm",
        )
        .select("doc_id", "salt", "place", "nth", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")),
        "exact-runs",
    )
    heads = runs.groupBy("text_sha256", "salt").agg(
        F.min("place").alias("place"), F.max("nth").cast("long").alias("rows")
    )
    groups = heads.groupBy("text_sha256").agg(
        F.min("place").alias("best"),
        F.sum("rows").alias("group_size"),
        F.collect_list("salt").alias("salts"),  # SALTS values at most
    )
    verdicts = groups.select("text_sha256", F.explode("salts").alias("salt"), "best", "group_size")
    return runs.join(verdicts, ["text_sha256", "salt"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        ((F.col("nth") == 1) & (F.col("place") == F.col("best"))).alias("kept"),
        "text_sha256",
    )
