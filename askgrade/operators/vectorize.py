"""Terms, counts, document frequencies and TF-IDF.

Two forms give the same numbers:

* the long form ``(Id, term, value)`` is plain grouping and joining, and takes a
  vocabulary of any size;
* the vector form is a ``PipelineModel`` of Spark ML transformers.  Only document
  frequencies are shuffled (one partially aggregated row per term); counting,
  weighting and normalising then happen inside each row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    RegexTokenizer,
    StopWordsRemover,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askgrade.constants import ENGLISH_STOP_WORDS, MAX_DF, MIN_DF, WORD_CHARS

TERM = f"[{WORD_CHARS}]{{2,}}"
MAX_MODEL_TERMS = 1 << 22


@dataclass(frozen=True)
class FeatureSpec:
    """How text becomes a vector. ``stop_words=None`` keeps every term."""

    min_df: float | int = MIN_DF
    max_df: float | int = MAX_DF
    use_idf: bool = True
    norm: str | None = "l2"
    stop_words: tuple[str, ...] | None = None
    weighted: bool = True  # False: raw counts
    twice: bool = False  # apply the TF-IDF step to its own result (V7)


def english_stop_words() -> tuple[str, ...]:
    """V2: Spark's English list; pass another list to use it instead."""
    return tuple(ENGLISH_STOP_WORDS)


def terms(text: Column, stop_words: tuple[str, ...] | None = None) -> Column:
    """V1/V2: lowercase words of two or more characters, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    if not stop_words:
        return words
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))


def ngrams(words: Column, low: int = 1, high: int = 2) -> Column:
    """V8: all runs of ``low`` to ``high`` consecutive terms, joined by a space."""

    def runs(n: int) -> Column:
        joined = words
        for shift in range(1, n):
            joined = F.zip_with(joined, F.slice(words, shift + 1, F.size(words)), _join_pair)
        return F.filter(joined, lambda run: run.isNotNull())

    return F.concat(*[runs(n) for n in range(low, high + 1)])


def _join_pair(left: Column, right: Column) -> Column:
    return F.concat(left, F.lit(" "), right)  # NULL where the shorter array has ended


def term_counts(df: DataFrame, column: str = "Body", stop_words=None) -> DataFrame:
    """V3, long form: (Id, term, tf). A document's terms combine before the shuffle."""
    exploded = df.select("Id", F.explode(terms(F.col(column), stop_words)).alias("term"))
    return exploded.groupBy("Id", "term").agg(F.count("*").alias("tf"))


def document_frequencies(df: DataFrame, column: str = "Body", stop_words=None) -> DataFrame:
    """(term, df). Terms are made distinct inside the row, so nothing is per document."""
    distinct = F.array_distinct(terms(F.col(column), stop_words))
    return df.select(F.explode(distinct).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _bound(value: float | int, n):
    """A share of the documents when it is a float, an absolute count when an int."""
    return n * F.lit(value) if isinstance(value, float) else F.lit(value)


def vocabulary(
    df: DataFrame, column: str = "Body", min_df=MIN_DF, max_df=MAX_DF, stop_words=None
) -> DataFrame:
    """V4: (term, df, n) with both document-frequency bounds inclusive."""
    counted = _frequencies_and_size(df, column, stop_words)
    n = counted.agg(F.max(F.when(F.col("term") == "", F.col("df")))).scalar()
    # a filter on the term alone would be pushed below the shuffle, which both readers share
    frequency = F.when(F.col("term") != "", F.col("df"))
    return counted.withColumn("n", n).where(
        (frequency >= _bound(min_df, F.col("n"))) & (frequency <= _bound(max_df, F.col("n")))
    )


def _frequencies_and_size(df: DataFrame, column: str, stop_words) -> DataFrame:
    """(term, df), and the number of documents as the df of the empty term."""
    found = F.concat(F.array_distinct(terms(F.col(column), stop_words)), F.array(F.lit("")))
    found = F.coalesce(found, F.array(F.lit("")))
    return df.select(F.explode(found).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def smooth_idf(n: Column, df: Column) -> Column:
    """V5: ln((1 + n) / (1 + df)) + 1."""
    return F.log((n + 1) / (df + 1)) + 1


def _row_norm(value: Column, norm: str) -> Column:
    per_document = Window.partitionBy("Id")
    if norm == "l1":
        return F.sum(F.abs(value)).over(per_document)
    return F.sqrt(F.sum(value * value).over(per_document))


def tfidf_long(df: DataFrame, spec: FeatureSpec = FeatureSpec(), column: str = "Body") -> DataFrame:
    """V3-V7, long form: (Id, term, value).

    The vocabulary is joined without a hint: pruned ones are small enough for a
    broadcast at run time, and an unpruned one gets a shuffled join instead.
    """
    kept = vocabulary(df, column, spec.min_df, spec.max_df, spec.stop_words)
    weight = smooth_idf(F.col("n"), F.col("df")) if spec.use_idf else F.lit(1.0)
    kept = kept.select("term", weight.alias("weight"))
    # texts are shuffled by Id, which then serves the counts as well as the norms
    texts = df.select("Id", column).repartition("Id")
    rows = term_counts(texts, column, spec.stop_words).join(kept, "term")
    value = F.col("tf").cast("double")
    for _ in range((2 if spec.twice else 1) if spec.weighted else 0):
        rows = rows.withColumn("value", value * F.col("weight"))
        value = F.col("value")
        if spec.norm:
            rows = rows.withColumn("value", value / _row_norm(value, spec.norm))
    return rows.select("Id", "term", value.alias("value"))


# --- vector form ---------------------------------------------------------------


def fit_vocabularies(
    df: DataFrame, spec: FeatureSpec, column: str = "Body", folds: int = 0
) -> dict[int | None, list[tuple[str, float]]]:
    """Sorted (term, weight) lists for the whole set and for every training fold.

    One aggregation serves all of them: the frequency outside a fold is the total
    minus the frequency inside. What reaches the driver are the terms within the
    bounds, which are at most (mean distinct terms per document) / min_df many when
    min_df is a share; with an absolute min_df the size is checked first.
    """
    inside = [F.count_if(F.col("fold") == f).alias(f"n_{f}") for f in range(folds)]
    sizes = df.agg(F.count("*").alias("n_all"), *inside).first()
    exploded = df.select(
        *(["fold"] if folds else []),
        F.explode(F.array_distinct(terms(F.col(column), spec.stop_words))).alias("term"),
    )
    counted = exploded.groupBy("term").agg(F.count("*").alias("n_all"), *inside)
    frequency: dict[int | None, Column] = {None: F.col("n_all")}
    n: dict[int | None, int] = {None: sizes["n_all"]}
    for f in range(folds):
        frequency[f] = F.col("n_all") - F.col(f"n_{f}")
        n[f] = sizes["n_all"] - sizes[f"n_{f}"]

    def within(part) -> Column:
        least, most = (
            b * n[part] if isinstance(b, float) else b for b in (spec.min_df, spec.max_df)
        )
        return (frequency[part] > 0) & frequency[part].between(F.lit(least), F.lit(most))

    anywhere = within(None)
    for f in range(folds):
        anywhere = anywhere | within(f)
    columns = [
        F.when(within(part), df_).alias("whole" if part is None else f"fold_{part}")
        for part, df_ in frequency.items()
    ]
    kept = counted.where(anywhere).select("term", *columns).persist()
    try:
        if not isinstance(spec.min_df, float) and kept.count() > MAX_MODEL_TERMS:
            raise ValueError("vocabulary too large for a model; raise min_df or use tfidf_long")
        rows = kept.collect()
    finally:
        kept.unpersist()
    result = {}
    for i, part in enumerate(frequency, start=1):
        present = sorted((r[0], r[i]) for r in rows if r[i] is not None)
        result[part] = [
            (term, math.log((1 + n[part]) / (1 + df_)) + 1 if spec.use_idf else 1.0)
            for term, df_ in present
        ]
    return result


def feature_model(
    weights: list[tuple[str, float]], spec: FeatureSpec, column: str = "Body", output: str = "features"
) -> PipelineModel:
    """V1-V7 as one PipelineModel with an alphabetical vocabulary."""
    if not weights:
        raise ValueError("no term lies within the document-frequency bounds")
    stages = [
        RegexTokenizer(
            inputCol=column, outputCol="_words", pattern=TERM, gaps=False, toLowercase=True, minTokenLength=1
        )
    ]
    words = "_words"
    if spec.stop_words:
        stages.append(
            StopWordsRemover(
                inputCol=words, outputCol="_kept", stopWords=list(spec.stop_words), caseSensitive=True
            )
        )
        words = "_kept"
    steps = (["idf", "norm"] * (2 if spec.twice else 1)) if spec.weighted else []
    if not spec.norm:
        steps = [s for s in steps if s != "norm"]
    names = ["_counts", *[f"_step{i}" for i in range(1, len(steps))], output]
    first = names[0] if steps else output
    stages.append(
        CountVectorizerModel.from_vocabulary([t for t, _ in weights], inputCol=words, outputCol=first)
    )
    scaling = Vectors.dense([w for _, w in weights])
    for step, source, target in zip(steps, names, names[1:]):
        if step == "idf":
            stages.append(ElementwiseProduct(scalingVec=scaling, inputCol=source, outputCol=target))
        else:
            p = {"l1": 1.0, "l2": 2.0}[spec.norm]
            stages.append(Normalizer(p=p, inputCol=source, outputCol=target))
    return PipelineModel(stages)


def fit_features(df: DataFrame, spec: FeatureSpec, column: str = "Body") -> PipelineModel:
    """Vocabulary and weights from one data set, as a PipelineModel."""
    return feature_model(fit_vocabularies(df, spec, column)[None], spec, column)


def vectors_as_long(vectors: DataFrame, vocabulary_terms: list[str], column: str = "features") -> DataFrame:
    """Sparse vectors as (Id, term, value) rows; the terms are joined as a table."""
    raw = F.unwrap_udt(F.col(column))
    pairs = F.arrays_zip(raw["indices"].alias("position"), raw["values"].alias("value"))
    entries = vectors.select("Id", F.inline(pairs).alias("position", "value"))
    names = vectors.sparkSession.createDataFrame(
        list(enumerate(vocabulary_terms)), "position int, term string"
    )
    return entries.join(names, "position").select("Id", "term", "value")
