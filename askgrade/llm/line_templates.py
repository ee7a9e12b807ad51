"""Line dedup with a tree of log templates.

A line goes down a tree of fixed depth: by its number of tokens, then by its ``LEADING`` first
tokens, where a token with a digit counts as the variable ``<*>``. In a leaf that lines of at
least ``MIN_TEXTS`` different texts reach, a token that fewer than ``SUPPORT`` texts have at its
place is variable too; a line with enough constant tokens becomes a template that way. Of the
others, those with enough tokens that ``MIN_TEXTS`` texts have become templates by these, and
any other is its own template. A template that recurs in at least ``MIN_TEXTS`` different texts
is dropped from every document but the first.

A line with fewer than ``MIN_TOKENS`` tokens, such as a paragraph in a script without spaces, is
its own template, digits and all, if it has at least ``MIN_CHARS`` characters; shorter ones stay.

Exact copies of a text count as one, so they do not make their own lines recur. Counting is by
hashes and aggregated before each shuffle; only lines of leaves that recur take their tokens
through one. Lines are never gathered by leaf or template.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrade.llm.common import small_batches
from askgrade.llm.components import small_side
from askgrade.session import discard, materialise

MIN_TEXTS = 2
SUPPORT = 3
LEADING = 4
MIN_TOKENS = 3
MIN_CHARS = 6
CONSTANT = 0.7
VARIABLE = "<*>"
_ENOUGH = rf"^\s*+\S++(?:\s++\S++){{{MIN_TOKENS - 1}}}"


def _keys(df: DataFrame) -> DataFrame:
    """``df`` with ``__llm_k, __llm_h``, which name a document by its id and text; repeated rows share them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.withColumn("__llm_k", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))).withColumn(
        "__llm_h", F.xxhash64(text, F.isnull("doc_id"))
    )


def _masked(line: Column) -> Column:
    """A line with single spaces and, if it has enough tokens, ``<*>`` for those with digits; most lines need neither."""
    variable = line.rlike("[0-9]") & line.rlike(_ENOUGH)
    digits = F.when(variable, F.regexp_replace(line, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", VARIABLE)).otherwise(line)
    spaces = F.regexp_replace(digits, r"\s+", " ")
    return F.trim(F.when(line.rlike(r"\s\s|[\t\x0B\f\r]"), spaces).otherwise(digits))


def _lines(df: DataFrame) -> DataFrame:
    """``__llm_k, __llm_h, pos, masked, n, leaf`` of lines with enough tokens or characters."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # made inside the generator, so that no later step repeats it
    lines = df.select("__llm_k", "__llm_h", F.posexplode(F.transform(F.split(text, "\n"), _masked)).alias("pos", "masked"))
    n = F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    lines = lines.withColumn("n", n).where((F.col("n") >= MIN_TOKENS) | (F.length("masked") >= MIN_CHARS))
    return lines.withColumn("leaf", F.xxhash64("n", F.substring_index("masked", " ", LEADING)))


def templates(docs: DataFrame, min_texts: int = MIN_TEXTS, constant: float = CONSTANT) -> tuple[DataFrame, DataFrame]:
    """``(lines, recurring)``: ``__llm_k, __llm_h, pos, line_key`` of every line with enough tokens or characters, and
    ``line_key, template, texts, first`` of those whose template recurs in at least
    ``min_texts`` texts; ``first`` is the smallest id with that template."""
    keyed = _keys(docs.select("doc_id", "text"))
    line_key = F.xxhash64("masked", "leaf").alias("line_key")
    placed = materialise(_lines(keyed).select("__llm_k", "__llm_h", "pos", "leaf", line_key), "template-lines")
    by_text = placed.select("leaf", "__llm_h").distinct().groupBy("leaf").count()
    leaves = materialise(by_text.where(F.col("count") >= min_texts).select("leaf"), "template-leaves")
    recur = small_side(leaves)
    texts = placed.join(recur, "leaf").groupBy("leaf", "line_key", "__llm_h").agg(F.min("__llm_k").alias("first"))
    counted = materialise(
        texts.groupBy("leaf", "line_key").agg(F.count("*").alias("texts"), F.min("first").alias("first")),
        "template-counted",
    )
    # the only wording of a leaf is a template by itself; the others are compared by their tokens
    mixed = counted.groupBy("leaf").count().where(F.col("count") > 1).select("leaf")
    mixed = small_side(materialise(mixed, "template-mixed"))
    wording = (
        _lines(keyed).select("leaf", line_key, "masked").join(mixed, "leaf")
        .groupBy("line_key").agg(F.first("masked").alias("masked"))
    )
    tokens = materialise(
        counted.join(wording, "line_key")
        .select("leaf", "line_key", "texts", F.posexplode(F.split("masked", " ")).alias("place", "token")),
        "template-tokens",
    )
    support = tokens.groupBy("leaf", "place", "token").agg(F.sum("texts").alias("support"))
    fixed = support.where((F.col("support") >= min_texts) & (F.col("token") != VARIABLE))
    kept = tokens.join(fixed, ["leaf", "place", "token"], "left")
    # the order of tokens is in their places, so a sum of hashes names the template
    place = F.xxhash64("place", "token").bitwiseAND(F.lit((1 << 40) - 1))
    often = F.col("support") >= max(min_texts, SUPPORT)
    shape = kept.groupBy("leaf", "line_key").agg(
        F.count("*").alias("n"),
        F.count("support").alias("constants"), F.sum(F.when(F.col("support").isNotNull(), place)).alias("shape"),
        F.count(F.when(often, 1)).alias("constants_often"), F.sum(F.when(often, place)).alias("shape_often"),
    )
    # lines alike in all their constants are alike in the frequent ones, so the latter make the larger groups
    own = [
        F.when(F.col(f"constants{x}") >= F.col("n") * constant, F.xxhash64("leaf", f"shape{x}", f"constants{x}"))
        for x in ("_often", "")
    ]
    named = counted.join(shape.select("line_key", F.coalesce(*own).alias("shape")), "line_key", "left")
    named = materialise(named.withColumn("template", F.coalesce("shape", "line_key")).drop("shape"), "template-named")
    for table in (tokens, counted, leaves):
        discard(table)
    groups = named.groupBy("template").agg(
        F.sum("texts").alias("sum_texts"), F.min("first").alias("all_first"), F.count("*").alias("wordings")
    )
    groups = materialise(groups.where(F.col("sum_texts") >= min_texts), "template-groups")
    # a text may have several wordings of a template
    several = groups.where("wordings > 1").select("template")
    several = materialise(named.join(several, "template").select("line_key", "template"), "template-wordings")
    distinct = placed.join(small_side(several), "line_key").select("template", "__llm_h").distinct()
    distinct = distinct.groupBy("template").agg(F.count("*").alias("distinct_texts"))
    groups = groups.join(distinct, "template", "left").withColumn("all_texts", F.coalesce("distinct_texts", "sum_texts"))
    recurring = named.join(groups.where(F.col("all_texts") >= min_texts), "template").select(
        "line_key", "template", F.col("all_texts").alias("texts"), F.col("all_first").alias("first")
    )
    return placed, recurring


def _without(texts: pa.Array, dropped: pa.Array) -> pa.Array:
    out = []
    for text, gone in zip(texts.to_pylist(), dropped.to_pylist()):
        if text is None or not gone:
            out.append(text)
            continue
        numbers = set(gone)
        out.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in numbers))
    return pa.array(out, pa.string())


def without_recurring(docs: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """``docs`` with all its columns and rows, the recurring lines cut from ``text``, and
    ``__llm_dropped``, the number of lines cut.

    A null text stays null, an empty one empty; ``n_chars``, if there, follows the new text. Of
    rows with the first id of a template all keep it. Lines with fewer than ``MIN_TOKENS`` tokens
    and ``MIN_CHARS`` characters stay. A null id comes first of all ids. An empty table gives an empty result.
    """
    placed, recurring = templates(docs, min_texts)
    gone = (
        placed.join(recurring.select("line_key", "first"), "line_key")
        .where(F.col("__llm_k") != F.col("first"))
        .select("__llm_k", "__llm_h", "pos").distinct()
        .groupBy("__llm_k", "__llm_h").agg(F.collect_list("pos").alias("__llm_gone"))  # of one document
    )
    gone = materialise(gone, "template-gone")
    for table in (recurring, placed):
        discard(table)
    cut = F.arrow_udf(_without, "string")
    out = small_batches(_keys(docs).join(small_side(gone, 1 << 18), ["__llm_k", "__llm_h"], "left"))
    out = out.withColumn("text", cut(F.col("text").cast("string"), "__llm_gone"))
    out = out.withColumn("__llm_dropped", F.coalesce(F.size("__llm_gone"), F.lit(0)).cast("long"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns, "__llm_dropped")


def lines_deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without recurring lines."""
    return without_recurring(docs).drop("__llm_dropped")


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_dropped, n_chars, text_sha256`` of every row, after the lines are cut."""
    rows = without_recurring(docs.select("doc_id", "text"))
    left = F.coalesce(F.col("text"), F.lit(""))
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "__llm_dropped",
        F.length(left).cast("long").alias("n_chars"),
        F.sha2(left.cast("binary"), 256).alias("text_sha256"),
    ).withColumnRenamed("__llm_dropped", "n_dropped")
