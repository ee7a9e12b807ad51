"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of every whole text are counted in one pass, without a shuffle.
2. Trees of a small random forest are fitted to labelled rows; each path from a root is a rule,
   a conjunction of comparisons.
3. A lasso logistic regression weighs the rules; most weights become zero.
4. The remaining rules are compiled into one Spark column expression, the score.

Fitting uses at most ``MAX_FIT_ROWS`` labelled rows, those with the smallest hash of their id;
every document is scored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrade.llm.common import SPACES, let_go, small_batches, text_slices, word_hashes

MAX_FIT_ROWS = 20_000
TREES, DEPTH, LASSO, SEED = 24, 3, 0.002, 7
THRESHOLD = 0.3
STATISTICS = (
    "n_words", "word_length", "upper", "digit", "mark", "other", "symbol", "space", "line_length",
    "distinct_words", "repeated_next", "ends_in_mark", "lone_marks",
)

_UPPER, _DIGIT, _MARK, _OTHER, _SYMBOL, _LINE = range(6)
_CLASSES = np.zeros((6, 256), bool)
_CLASSES[_UPPER, 65:91] = True
_CLASSES[_DIGIT, 48:58] = True
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _CLASSES[_MARK, _c] = True
        if chr(_c) not in ".,;:'\"!?()-":
            _CLASSES[_SYMBOL, _c] = True
_CLASSES[_OTHER, 128:] = True
_CLASSES[_LINE, 10] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _statistics(texts: pa.Array) -> pa.Array:
    let_go()
    found: list[np.ndarray] = []
    for _, _, data, offsets in text_slices(texts):
        size = np.maximum(np.diff(offsets), 1)
        hashes, lengths, first = word_hashes(data, offsets)
        n = np.diff(first)
        owner = np.repeat(np.arange(len(n)), n)
        some = np.maximum(n, 1)
        order = np.lexsort((hashes, owner))
        new = np.ones(len(order), bool)
        h, o = hashes[order], owner[order]
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        next_same = np.zeros(len(hashes), bool)
        next_same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        last = SPACES[data]
        ends = np.zeros(len(data), bool)  # last byte of a word
        ends[:-1] = ~last[:-1] & last[1:]
        cuts = offsets[1:][offsets[1:] > 0] - 1
        ends[cuts] = ~last[cuts]
        begins = np.zeros(len(data), bool)
        begins[1:] = ~last[1:] & last[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(data)]
        begins[cuts] = ~last[cuts]
        marks = _CLASSES[_MARK][data]
        share = [_per_text(_CLASSES[k][data], offsets) / size for k in (_UPPER, _DIGIT, _MARK, _OTHER, _SYMBOL)]
        found.append(
            np.column_stack(
                [
                    n,
                    np.bincount(owner, lengths, len(n)) / some,
                    *share,
                    _per_text(last, offsets) / size,
                    size / (1 + _per_text(_CLASSES[_LINE][data], offsets)),
                    np.bincount(o, new, len(n)) / some,
                    np.bincount(owner, next_same, len(n)) / some,
                    _per_text(ends & marks, offsets) / some,
                    _per_text(ends & begins & marks, offsets) / some,
                ]
            )
        )
    table = np.concatenate(found) if found else np.zeros((0, len(STATISTICS)))
    return pa.StructArray.from_arrays([pa.array(table[:, i].astype(float)) for i in range(len(STATISTICS))], STATISTICS)


def with_statistics(df: DataFrame, text: str = "text", name: str = "__llm_stats") -> DataFrame:
    """``df`` with a struct of the text's statistics; a null text is empty, with zeros."""
    kind = "struct<" + ",".join(f"{x}:double" for x in STATISTICS) + ">"
    counted = F.arrow_udf(_statistics, kind)
    return small_batches(df).withColumn(name, counted(F.coalesce(F.col(text).cast("string"), F.lit(""))))


@dataclass(frozen=True)
class Rule:
    """Comparisons ``(statistic, above, bound)`` that must all hold."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self, struct: str) -> Column:
        out = F.lit(True)
        for name, above, bound in self.tests:
            value = F.col(f"{struct}.{name}")
            out &= (value > bound) if above else (value <= bound)
        return out


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, struct: str = "__llm_stats") -> Column:
        margin = F.lit(self.bias)
        for rule, weight in self.rules:
            margin += F.when(rule.column(struct), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-margin))


def paths(debug: str) -> list[Rule]:
    """Every path from a root to a node in the printed form of a forest, once."""
    out: dict[Rule, None] = {}
    stack: list[tuple[int, tuple[str, bool, float]]] = []
    for line in debug.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if re.match(r"\s*Tree \d+", line):
            stack = []
        if not m:
            continue
        depth = len(m[1])
        stack = [x for x in stack if x[0] < depth]
        stack.append((depth, (STATISTICS[int(m[2])], m[3] == ">", float(m[4]))))
        bounds: dict[tuple[str, bool], float] = {}
        for _, (name, above, bound) in stack:
            known = bounds.get((name, above), bound)
            bounds[name, above] = max(known, bound) if above else min(known, bound)
        out[Rule(tuple((n, a, b) for (n, a), b in sorted(bounds.items())))] = None
    return list(out)


def labelled(labels: DataFrame) -> DataFrame:
    """``doc_id, label``: one row per id. Several labels of an id count as their rounded mean;
    rows without an id or a label are left out."""
    rows = labels.where("doc_id is not null and quality is not null")
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.round(F.avg("quality")).cast("double").alias("label")
    )


def held_out(doc_id: Column) -> Column:
    """A null id is never held out, but has no label either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Ensemble:
    """Rules and weights from the labelled documents that are not held out.

    The sample is chosen among the labels and has at most ``max_rows`` rows, so it may be
    broadcast, and only its texts are counted. Without labels the score is 0.5; with labels of
    one kind, near that kind.
    """
    sample = (
        labelled(labels)
        .where(~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = with_statistics(texts.join(F.broadcast(sample), "doc_id")).select("label", "__llm_stats.*")
    rows = known.sparkSession.createDataFrame(known.toPandas(), known.schema).cache()
    try:
        n, good = rows.agg(F.count("*"), F.sum("label")).first()
        if not n or good in (0, n):
            return Ensemble(0.0 if not n else 4.0 if good else -4.0, ())
        features = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows)
        forest = RandomForestClassifier(
            labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird"
        ).fit(features)
        rules = paths(forest.toDebugString)
        if not rules:
            return Ensemble(float(np.log(good / (n - good))), ())
        held = rows.select("label", F.struct(*STATISTICS).alias("__llm_stats"))
        held = held.select("label", *[r.column("__llm_stats").cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
        held = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(held)
        lasso = LogisticRegression(
            labelCol="label", regParam=LASSO, elasticNetParam=1.0, maxIter=60, aggregationDepth=2
        ).fit(held.select("label", "features"))
        weights = lasso.coefficients.toArray()
        return Ensemble(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, weights) if w))
    finally:
        rows.unpersist()


def scored(df: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """``df`` with ``__llm_score``."""
    return with_statistics(df).withColumn("__llm_score", fit(df, labels, max_rows).score()).drop("__llm_stats")


def classify(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, repeated ones too."""
    score = F.col("__llm_score")
    return scored(documents.select("doc_id", "text"), labels, max_rows).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        score.alias("score"),
        (score >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    return scored(docs, labels).where(F.col("__llm_score") >= THRESHOLD).drop("__llm_score")
