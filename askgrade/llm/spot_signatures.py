"""Document fingerprints by spot signatures.

A signature is a common word (the anchor; of several in a row the last) with the next two
content words, those that are no anchors. A document's fingerprint is the set of its
signatures, as 40-bit hashes. Sets are compared by Jaccard likeness; the join partitions the
sets by length and looks at shared signatures of short prefixes only.

DataFrame functions only; every text keeps to its own row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrade.llm.common import numbered, whole_texts

#: Common words of four languages.
ANCHORS = tuple(
    """
    a an and are as at be by for from in is it of on or that the this to was with
    au ce dans de des du elle en est et il la le les par pas pour que qui sur un une
    auf das dem den der die ein eine für ist mit nicht sich sie und von zu
    como con del el los no para por se su
    """.split()
)
HASH_BITS = 40


def _hash(*values: Column) -> Column:
    return F.xxhash64(*values).bitwiseAND(F.lit((1 << HASH_BITS) - 1))


def with_signatures(df: DataFrame, text: str, name: str, anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """``df`` and ``name``: the set of signatures of column ``text`` as a sorted array.

    A text without any signature, but with words, has one for the whole text; a null or blank
    text has none. Equal texts have equal sets.
    """
    words = "|".join(sorted(anchors, key=len, reverse=True))
    mark = f"(?<!\\S)(?:(?:{words})\\s+(?=(?:{words})\\s))*+({words})\\s+"
    marked = F.regexp_replace(F.lower(F.col(text)), mark, "$1\x01")
    tokens = df.withColumn("_tokens", F.split(marked, "\\s+"))
    following = F.slice("_tokens", 2, F.size("_tokens"))
    chains = F.zip_with(
        "_tokens",
        following,
        lambda word, after: F.when(
            F.instr(word, "\x01") > 0,
            _hash(word, F.coalesce(F.substring_index(after, "\x01", -1), F.lit(""))),
        ),
    )
    found = tokens.withColumn("_found", F.array_sort(F.array_distinct(F.array_compact(chains)))).drop("_tokens")
    whole = F.lower(F.regexp_replace(F.col(text), "\\s+", " "))
    none = F.array().cast("array<bigint>")
    rest = F.when(F.trim(whole) != "", F.array(_hash(F.trim(whole)))).otherwise(none)
    return found.withColumn(name, F.when(F.size("_found") > 0, F.col("_found")).otherwise(rest)).drop("_found")


def as_text(signatures: Column) -> Column:
    """A fingerprint as one string; it holds the whole set."""
    return F.array_join(F.transform(signatures, lambda x: F.hex(x)), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two sets; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ == 0, F.lit(1.0)).otherwise(both / all_)


def compare_with_next(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likenesses.

    The edited text is the text with its last ``floor(n_chars / 4)`` code points replaced by as
    many first ones (or all) of the next document in ascending ``doc_id`` order (a null id comes
    first, rows of one id go by a hash of the text; after the last the first). Null texts are
    empty. Rows repeated with the same id and text count as one document in that order, and each
    of them is returned. A single document is its own next one.

    Only ids and lengths are ranked. Each document sends the characters its predecessor needs
    and its signatures, so whole texts are shuffled once.
    """
    rows = whole_texts(documents).select(
        "doc_id",
        F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("k"),
        F.xxhash64("text", F.isnull("doc_id")).alias("h"),
        "text",
    )
    narrow = rows.groupBy("k", "h").agg(
        F.first(F.length("text")).alias("n"), F.first("doc_id").alias("doc_id"), F.count("*").cast("int").alias("copies")
    )
    ranked = numbered(narrow, ["k", "h"], "rank")
    total = ranked.agg(F.count("*")).scalar()
    previous = ranked.select(
        F.pmod(F.col("rank") + 1, total).alias("rank"),
        F.col("k").alias("prev_k"),
        F.col("h").alias("prev_h"),
        F.floor(F.col("n") / 4).cast("int").alias("wanted"),
    )
    neighbours = ranked.select("k", "h", "doc_id", "copies", "rank").join(previous, "rank").drop("rank")
    # both readers need the same columns of this, so the shuffle of the texts is made once
    texts = rows.groupBy("k", "h").agg(F.first("text").alias("text"))
    here = with_signatures(texts.join(neighbours, ["k", "h"]), "text", "signatures")
    sent = here.select(
        F.col("prev_k").alias("k"),
        F.col("prev_h").alias("h"),
        F.expr("substring(text, 1, wanted)").alias("next_start"),
        F.col("signatures").alias("next_signatures"),
    )
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    both = (
        here.select("k", "h", "doc_id", "copies", "text", "signatures", F.length("text").alias("n_chars"))
        .join(sent, ["k", "h"])
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - cut), "next_start"))
        .drop("text", "next_start")
    )
    done = with_signatures(both, "edited", "edited_signatures").select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("signatures")).alias("fingerprint"),
        as_text(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness("signatures", "edited_signatures").alias("near_edited"),
        likeness("signatures", "next_signatures").alias("near_next"),
        "copies",
    )
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return done.withColumn("copy", copies).drop("copies", "copy")


def near_duplicates(documents: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: the fingerprint class of every document, and the pairs of classes
    with likeness of at least ``threshold``.

    ``members``: ``doc_id, class_id`` (the smallest id with the same fingerprint). ``pairs``:
    ``a, b, likeness`` with ``a < b``. Documents without words pair with nothing. Classes are
    compared in partitions of set length, so that only sets whose lengths allow the threshold
    meet, and only if they share one of the first ``n - ceil(threshold * n) + 1`` signatures.
    """
    signed = with_signatures(whole_texts(documents), "text", "s").select("doc_id", "s", F.xxhash64("s").alias("f"))
    classes = signed.groupBy("f").agg(F.min("doc_id").alias("class_id"), F.first("s").alias("s"))
    members = signed.select("doc_id", "f").join(classes.select("f", "class_id"), "f").select("doc_id", "class_id")
    sized = classes.where(F.size("s") > 0).select("class_id", "s", F.size("s").alias("n"))
    band = F.floor(F.log(F.col("n")) / -math.log(threshold)).cast("int")
    first = F.slice("s", 1, F.col("n") - F.ceil(F.col("n") * F.lit(threshold)).cast("int") + 1)
    index = sized.withColumn("band", band).select("class_id", "n", "band", F.explode(first).alias("sig"))
    probe = index.select(
        F.col("class_id").alias("other"), F.col("n").alias("m"), "sig",
        F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"),
    )
    near = (
        index.join(probe, ["sig", "band"])
        .where((F.col("n") <= F.col("m")) & (F.col("n") >= F.col("m") * F.lit(threshold)))
        .where((F.col("n") < F.col("m")) | (F.col("class_id") < F.col("other")))
        .select("class_id", "other")
        .distinct()
    )
    left = sized.select("class_id", F.col("s").alias("s1"))
    right = sized.select(F.col("class_id").alias("other"), F.col("s").alias("s2"))
    pairs = (
        near.join(left, "class_id")
        .join(right, "other")
        .select(
            F.least("class_id", "other").alias("a"),
            F.greatest("class_id", "other").alias("b"),
            likeness("s1", "s2").alias("likeness"),
        )
        .where(F.col("likeness") >= threshold)
    )
    return members, pairs
