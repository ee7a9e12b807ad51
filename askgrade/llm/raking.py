"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed into cells (source, language, topic). The cells' weights are raked to
the target share of every value of one dimension after the other, in several sweeps. The final
weight of a cell over its tokens is its rate. Rates are scaled to probabilities so that ``KEEP``
of all tokens is expected to stay; where that makes more than 1, all of the cell stays and the
others share the rest. A document's draw is a hash of its id, so a run can be repeated and a
larger weight never drops what a smaller one kept.

Only the cells, one row for each combination of values, take part in the sweeps.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askgrade.session import materialise

DIMENSIONS = ("source", "lang", "topic")
#: Targets of the registered query: each share of tokens to the power of this, made to sum to 1.
TEMPERATURES = {"source": 0.7, "lang": 0.8, "topic": 0.8}
KEEP = 0.8
SWEEPS = 6
SEED = 0


def topic_of(text: Column) -> Column:
    """A coarse topic from the text's own marks."""
    lower = F.lower(text)
    return (
        F.when(F.contains(lower, F.lit("licen")), "legal")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("://")), "contact")
        .when(F.length(text) < 1000, "short")
        .otherwise("prose")
    )


def n_words(text: Column) -> Column:
    """Runs without spaces, tabs or line breaks."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def _targets(cells: DataFrame, dim: str, wanted: float | Mapping[str, float]) -> DataFrame:
    """``dim, target``: the wanted share of each value that occurs."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("tokens"))
    if isinstance(wanted, Mapping):
        pairs = [x for k, v in wanted.items() for x in (F.lit(k), F.lit(float(v)))]
        raw = F.coalesce(F.create_map(*pairs)[F.col(dim)], F.lit(0.0))
    else:
        raw = F.pow(F.col("tokens").cast("double"), F.lit(float(wanted)))
    every = Window.partitionBy(F.lit(0))  # as many rows as the dimension has values
    return sums.withColumn("raw", raw).select(dim, (F.col("raw") / F.sum("raw").over(every)).alias("target"))


def raked(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]], sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (the dimensions and ``tokens``) with ``weight``: shares raked to the targets.

    ``targets`` gives each dimension a temperature or a share for each value (0 if left out).
    Cells without tokens keep weight 0.
    """
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    for dim, wanted in targets.items():
        out = out.join(_targets(cells, dim, wanted).withColumnRenamed("target", f"_{dim}"), dim)
    for _ in range(sweeps):
        for dim in targets:
            total = F.sum("weight").over(Window.partitionBy(dim))
            out = out.withColumn(
                "weight", F.when(total > 0, F.col("weight") * F.col(f"_{dim}") / total).otherwise(0.0)
            )
    return out.drop(*[f"_{dim}" for dim in targets])


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number from [0, 1) that depends on the id only."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _cell_of_document() -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [
        F.coalesce(F.col("source").cast("string"), F.lit("(none)")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("(none)")).alias("lang"),
        topic_of(text).alias("topic"),
    ]


def _tokens() -> Column:
    return n_words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("n_tokens")


def cell_probabilities(
    rows: DataFrame,
    targets: Mapping[str, float | Mapping[str, float]] = TEMPERATURES,
    sweeps: int = SWEEPS,
    keep: float = KEEP,
) -> DataFrame:
    """``source, lang, topic, weight, probability`` from ``rows`` with the dimensions and ``n_tokens``."""
    cells = materialise(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    weights = materialise(raked(cells, targets, sweeps), "mix-weights")
    rate = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    weights = weights.withColumn("rate", rate)
    # if the cells before one in the order of rates stay whole, this scale spends what is left
    every = Window.partitionBy(F.lit(0)).orderBy(F.desc("rate"), *DIMENSIONS)  # the cells
    before, onward = every.rowsBetween(Window.unboundedPreceding, -1), every.rowsBetween(0, Window.unboundedFollowing)
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(keep) * F.sum("tokens").over(whole) - F.coalesce(F.sum("tokens").over(before), F.lit(0))
    scales = weights.where("rate > 0").select("rate", (left / F.sum("weight").over(onward)).alias("scale"))
    fits = scales.where(F.col("scale") * F.col("rate") <= 1 + 1e-9)
    scale = fits.agg(F.max_by("scale", "rate")).first()[0]  # one number
    part = F.when(F.col("rate") > 0, F.least(F.lit(1.0), F.col("rate") * F.lit(scale))).otherwise(
        F.when(F.col("tokens") > 0, 0.0).otherwise(1.0)
    )
    return weights.select(*DIMENSIONS, "weight", part.alias("probability"))


def mixed_sample(
    documents: DataFrame,
    targets: Mapping[str, float | Mapping[str, float]] = TEMPERATURES,
    sweeps: int = SWEEPS,
    seed: int = SEED,
) -> DataFrame:
    """Every document's ``doc_id, source, lang, topic, n_tokens, weight, probability, sampled``.

    A null source or language is the value ``(none)``; a null text is empty, with no tokens.
    Documents without tokens weigh nothing and are in the sample with probability 1. An empty
    table gives an empty result. ``weight`` is the raked share of the document's cell.
    """
    rows = materialise(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), *_cell_of_document(), _tokens()), "mix-rows"
    )
    weights = cell_probabilities(rows, targets, sweeps)
    return rows.join(weights, list(DIMENSIONS)).select(
        "doc_id", *DIMENSIONS, "n_tokens", F.round("weight", 6).alias("weight"),
        F.round("probability", 6).alias("probability"),
        (draw(F.col("doc_id"), seed) < F.col("probability")).alias("sampled"),
    )


def sample(docs: DataFrame, targets: Mapping[str, float | Mapping[str, float]] = TEMPERATURES, seed: int = SEED) -> DataFrame:
    """The sampled rows of ``docs``, with all their columns."""
    weights = cell_probabilities(docs.select(*_cell_of_document(), _tokens()), targets)
    cell = F.struct(*DIMENSIONS)
    weights = weights.select(cell.alias("__llm_cell"), F.col("probability").alias("__llm_keep"))
    return (
        docs.withColumn("__llm_cell", F.struct(*_cell_of_document()))
        .join(weights, "__llm_cell")
        .where(draw(F.col("doc_id"), seed) < F.col("__llm_keep"))
        .select(docs.columns)
    )
