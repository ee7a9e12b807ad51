"""Sentence ends for word tokens (T8): abbreviations are learned from the texts themselves.

After the published unsupervised method of Kiss and Strunk (2006): a word is an abbreviation if
it stands with a full stop far more often than chance, is short, and may hold full stops of its
own. A full stop is then cut off where a sentence ends, and stays on abbreviations and initials.
The method's corrections by the case of the next word are left out, since the marked and the
stripped set are in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrade.functions.columns import computed_once
from askgrade.functions.tokens import full_stops_cut, word_tokens_of_cut
from askgrade.session import discard, materialise

# --- fixed values of the published method
LEAST_SCORE = 0.3
ABBREVIATED = 0.99  # the share of an abbreviation's occurrences that have a full stop
# --- fixed values: what may stand around a word
PIECE = r"\s*\S+\s*"
AROUND = r"""^[\s"'(\[{<]+|[\s"')\]}>,;:!?]+$"""


def pieces(text: Column) -> Column:
    """The words with the white space around them; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def _holds_stop(piece: Column) -> Column:
    return F.contains(piece, F.lit("."))


def _bare(piece: Column) -> Column:
    return F.regexp_replace(F.lower(piece), AROUND, "")


def _with_stop(bare: Column) -> Column:
    return bare.endswith(".") & ~bare.endswith("..")


def _type(bare: Column) -> Column:
    return F.regexp_replace(bare, r"\.$", "")


def word_types(texts: DataFrame, column: str = "Body") -> DataFrame:
    """``word, with_stop, without``: how often each word stands with and without a full stop.

    Words are lower-cased and hold a letter. Null and empty texts have none.
    """
    bare = texts.select(F.explode(F.transform(pieces(F.col(column)), _bare)).alias("bare"))
    typed = bare.select(_type(F.col("bare")).alias("word"), _with_stop(F.col("bare")).alias("stop"))
    return (
        typed.where(F.col("word").rlike(r"\p{L}") & ~F.col("word").endswith("."))
        .groupBy("word")
        .agg(F.count_if("stop").alias("with_stop"), F.count_if(~F.col("stop")).alias("without"))
    )


def abbreviations(texts: DataFrame, column: str = "Body", least: float = LEAST_SCORE) -> DataFrame:
    """``word, with_stop, without, score``: the abbreviations of these texts, as a table.

    The score is the log-likelihood ratio of "nearly always with a full stop" against chance,
    times e^-letters, times (full stops inside + 1), times letters^-without. All texts are
    counted; two sums reach the driver. Without texts the result is empty.
    """
    counted = materialise(word_types(texts, column), "word-types")
    sums = counted.agg(F.sum("with_stop").alias("stops"), F.sum(F.expr("with_stop + without")).alias("n")).first()
    chance = min(max((sums.stops or 0) / (sums.n or 1), 1e-12), 1 - 1e-12)
    stops = F.length("word") - F.length(F.replace("word", F.lit(".")))
    letters = (F.length("word") - stops).cast("double")
    by_chance = F.col("with_stop") * F.log(F.lit(chance)) + F.col("without") * F.log(F.lit(1 - chance))
    abbreviated = F.col("with_stop") * F.log(F.lit(ABBREVIATED)) + F.col("without") * F.log(F.lit(1 - ABBREVIATED))
    ratio = 2 * (abbreviated - by_chance)
    score = ratio * F.exp(-letters) * (stops + 1) * F.pow(letters, -F.col("without"))
    found = counted.where("with_stop > 0").withColumn("score", score).where(F.col("score") >= least)
    found = materialise(found, "abbreviations")
    discard(counted)
    return found


def with_sentence_tokens(
    texts: DataFrame, found: DataFrame, name: str = "tokens", column: str = "Body"
) -> DataFrame:
    """``texts`` with ``name``: distinct word tokens of each text, cut sentence by sentence.

    A full stop ends a sentence unless it belongs to a word of ``found`` or to a single letter;
    the end of a text always ends one. The words that a text has in ``found`` are joined by
    ``Id``, so neither table is broadcast unless Catalyst finds it small. Rows of one Id may hold
    different texts; a row without Id knows no abbreviations. A null text has null tokens.
    """
    stopped = F.filter(pieces(F.col(column)), _holds_stop)
    own = texts.select("Id", F.explode(F.array_distinct(F.transform(stopped, _bare))).alias("bare"))
    own = own.where(F.col("Id").isNotNull() & _with_stop(F.col("bare")))
    own = own.select(F.col("Id").alias("_id"), _type(F.col("bare")).alias("_word"))
    known = own.join(found.select(F.col("word").alias("_word")), "_word").groupBy("_id")
    known = known.agg(F.collect_set("_word").alias("_known"))
    joined = texts.join(known, F.col("Id") == F.col("_id"), "left")
    known = F.coalesce("_known", F.array().cast("array<string>"))
    steps = computed_once(joined, "_parts", pieces(F.col(column)))
    steps = computed_once(steps, "_cut", F.array_join(sentences_cut(F.col("_parts"), known), ""))
    return steps.withColumn(name, word_tokens_of_cut(F.col("_cut"))).drop("_id", "_known", "_parts", "_cut")


def sentences_cut(parts: Column, known: Column) -> Column:
    """The pieces of a text with full stops cut off at sentence ends; its abbreviations are given as an array.

    ``parts`` is a column, not an expression: it is read for every piece.
    """
    last = F.size(parts) - 1

    def cut(piece: Column, i: Column) -> Column:
        word = _type(_bare(piece))
        stays = (i < last) & _with_stop(_bare(piece)) & (word.rlike(r"^\p{L}$") | F.array_contains(known, word))
        return F.when(stays, piece).otherwise(full_stops_cut(piece))

    return F.transform(parts, lambda piece, i: F.when(_holds_stop(piece), cut(piece, i)).otherwise(piece))
