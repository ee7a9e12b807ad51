"""Marker tokens in plain text (T6, T7, T9-T14) as JVM expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from askgrade.constants import (
    ASSIGNMENT,
    ASSIGNMENT_WORDS,
    ATTACHED_TAG,
    EXTERNAL_TAG,
    HEXADECIMAL,
    HOMEWORK,
    HOMEWORK_WORDS,
    NUMERIC,
    VERSION_NUMBER,
    WORD_CHARS,
)
from askgrade.functions.columns import computed_once
from askgrade.functions.tokens import near, word_tokens
from askgrade.session import materialise

_W = f"[{WORD_CHARS}]"
_NOT_W = f"[^{WORD_CHARS}]"

# "0x" plus digits and letters, or "0x" alone when the character before it starts or
# ends a word; that character is consumed.  The four non-ASCII letters are the ones
# that fold to ASCII letters when case is ignored.
_HEX = (
    r"[^0-9a-fA-F]0[xX](?:[0-9A-Za-z\u0130\u0131\u017f\u212a]+"
    rf"|(?!{_W})(?:(?<={_W}{_NOT_W}0[xX])|(?<=(?<!{_W}){_W}0[xX])))"
)
_NUMBER = rf"[+-]?(?=\p{{Nd}})(?<!{_W})\p{{Nd}}+(?!{_W})"  # the digit is asked for first: it is rarer
_VERSION = r"(?i)\b(?:v\.?|vno\.?|version)\s*\d+(?:\.\d+)*"

#: Fewer words are replaced one by one; more than ``MANY`` are not searched for one by one at all.
FEW, MANY = 8, 400
_SEPARATOR = "\0"  # between runs that are searched together
_WORD_RUN = re.compile(r"\w+")
_BETWEEN_RUNS = re.compile(r"(\W+)")
_HEAD = 3
#: 2 ** PART_BITS neighbouring rows are a part, whose tokens are looked up among the site's tags together.
PART_BITS = 10


def mark_hexadecimal(text: Column) -> Column:
    """Hexadecimal values become a marker."""
    candidate = F.contains(text, F.lit("0x")) | F.contains(text, F.lit("0X"))
    return F.when(candidate, F.regexp_replace(text, _HEX, HEXADECIMAL)).otherwise(text)


def mark_numeric(text: Column) -> Column:
    """Whole numbers that stand as words of their own become a marker."""
    return F.regexp_replace(text, _NUMBER, NUMERIC)


def mark_version_number(text: Column, enabled: bool = False) -> Column:
    """Off by default, when the text is returned as it is."""
    return F.regexp_replace(text, _VERSION, VERSION_NUMBER) if enabled else text


def longest_first(words: Column) -> Column:
    """O2: longest word first, ties in alphabetical order."""
    keyed = F.transform(words, lambda w: F.struct((-F.length(w)).alias("shortness"), w.alias("word")))
    return F.transform(F.sort_array(keyed), lambda k: k["word"])


def tag_array(tags: Column) -> Column:
    """``<c><multithreading>`` to an array, longest tag first."""
    parts = F.split(F.translate(tags, "<>", "  "), r"\s+")
    return longest_first(F.filter(parts, lambda t: t != ""))


def _replace_one(text: Column, word: Column, marker: str, whole_short_words: bool) -> Column:
    everywhere = F.replace(text, word, F.lit(marker))
    if not whole_short_words:
        return everywhere
    quoted = F.concat(F.lit(r"\Q"), word, F.lit(r"\E"))
    inside = F.concat(F.lit(f"(?iu)(?<!{_W})"), quoted, F.lit(f"(?!{_W})"))
    symbol = F.concat(F.lit(f"(?iu)(?<={_W})"), quoted, F.lit(f"(?={_W})"))
    pattern = F.when(word.rlike(f"^{_W}$"), inside).otherwise(symbol)
    alone = F.regexp_replace(text, pattern, F.lit(marker))
    return F.when(F.length(word) == 1, alone).otherwise(everywhere)


def replace_words(
    text: Column, hits: Column, marker: str, match: str = "substring", short_words: bool = True
) -> Column:
    """Fold the found words over the text, in the order of ``hits``.

    ``match="substring"`` replaces a found word wherever its letters occur (one-letter
    words only where they stand alone); ``"token"`` replaces whole words only.
    """
    if match == "token":

        def step(acc: Column, word: Column) -> Column:
            pattern = F.concat(F.lit(rf"(?<!{_W})\Q"), word, F.lit(rf"\E(?!{_W})"))
            return F.regexp_replace(acc, pattern, F.lit(marker))

    elif match == "substring":

        def step(acc: Column, word: Column) -> Column:
            return _replace_one(acc, word, marker, short_words)

    else:
        raise ValueError(f"unknown match mode {match!r}")
    return F.aggregate(hits, text, step)


def _one_by_one(text: str, words: list[str], marker: str) -> str:
    return reduce(lambda acc, w: acc.replace(w, marker), words, text)


def _fold(text: str, words: list[str], marker: str) -> str:
    """Replace the words one after the other, in their order, like ``F.replace`` for each of them.

    Neither words nor the inside of a marker reach across a space, nor across any other character
    that no word holds. So a text is cut into runs and every distinct run is replaced for itself. A
    run that is a word needs no search; the others are searched for ``MANY`` words at most, and for more
    words their parts are looked up among the words: what this takes does not grow with their number.
    """
    number = {w: i for i, w in enumerate(words)}
    odd = any(not w or " " in w or _SEPARATOR in w for w in words) or _SEPARATOR in text
    if len(words) < FEW or len(number) < len(words) or odd or not marker[:1] == marker[-1:] == " ":
        return _one_by_one(text, words, marker)
    only_letters = all(map(_WORD_RUN.fullmatch, words))
    pieces = _BETWEEN_RUNS.split(text) if only_letters else text.split(" ")
    every = 2 if only_letters else 1  # what stands between runs is among the pieces
    longest_come_first = all(len(a) >= len(b) for a, b in zip(words, words[1:]))
    done: dict[str, str] = {}
    rest = []
    inside = [w for w in words if w in marker]
    for run in dict.fromkeys(pieces[::every]):
        if longest_come_first and run in number:  # no word before it is a part of it
            later = [w for w in inside if number[w] > number[run]]
            done[run] = _one_by_one(marker, later, marker)
        else:
            rest.append(run)
    if len(words) <= MANY:
        done.update(zip(rest, _one_by_one(_SEPARATOR.join(rest), words, marker).split(_SEPARATOR)))
    else:
        done.update(_looked_up(rest, words, number, inside, marker))
    pieces[::every] = [done[run] for run in pieces[::every]]
    return ("" if only_letters else " ").join(pieces)


def _looked_up(runs: list[str], words: list[str], number: dict[str, int], inside: list[str], marker: str):
    """(run, run with the words replaced), by looking up the parts of runs that begin like a word."""
    lengths: dict[str, dict[int, None]] = {}  # of the words that begin so, ascending
    for n, head in sorted({(len(w), w[:_HEAD]) for w in words}):
        lengths.setdefault(head, {})[n] = None
    heads = {len(h) for h in lengths}
    for run in runs:
        own = set()
        for n in heads:
            for at in range(len(run) - n + 1):
                for length in lengths.get(run[at : at + n], ()):
                    if at + length > len(run):
                        break
                    i = number.get(run[at : at + length])
                    if i is not None:
                        own.add(i)
        if own:
            ordered = sorted(own.union(number[w] for w in inside))
            yield run, _one_by_one(run, [words[i] for i in ordered], marker)
        else:
            yield run, run


def _many_replaced(marker: str):
    """Fold many words over texts, in their order, like ``F.replace`` one by one."""

    @F.pandas_udf(StringType())
    def replaced(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series(
            [None if t is None else _fold(t, list(w), marker) for t, w in zip(texts, found)], dtype=object
        )

    return replaced


def _mark_listed(df, column, words, holds, marker, match, short_words=True):
    """Replace the words of an array column that are tokens of the text.

    Tokenising takes several passes over the text, so only those parts are tokenised that
    ``holds`` says may hold a word, even as a substring; rows without any are left out.
    """
    text = F.col(column)
    steps = computed_once(df, "_near", F.when(holds(text), near(text, holds)))
    found = F.array_intersect(words, word_tokens(F.col("_near")))
    steps = computed_once(steps, "_found", F.when(F.col("_near").isNotNull(), found)).drop("_near")
    replaced = replace_words(text, F.col("_found"), marker, match, short_words)
    done = computed_once(steps, column, F.when(F.size("_found") > 0, replaced).otherwise(text))
    return done.drop("_found")


def mark_attached_tags(
    df: DataFrame, column: str = "Body", tags: str = "Tags", match: str = "substring"
) -> DataFrame:
    """T11, first half: the question's own tags become a marker."""
    none = F.array().cast("array<string>")
    own = computed_once(df, "_own_tags", F.coalesce(tag_array(F.col(tags)), none))
    tags_column = F.col("_own_tags")

    def holds(part: Column) -> Column:
        return F.exists(tags_column, lambda t: F.contains(part, t))

    return _mark_listed(own, column, tags_column, holds, ATTACHED_TAG, match).drop("_own_tags")


def site_tags_in_text(df: DataFrame, site_tags: DataFrame, column: str = "Body") -> DataFrame:
    """Per question the site tags among its tokens, longest first: (Id, found).

    One narrow row per token goes into a semi join with the tags. The tags are written first, so
    that Catalyst knows their size before it plans the join: small ones are broadcast, and the
    tokens are then not shuffled at all.
    """
    return _tags_by_id(df, materialise(site_tags.select("TagName"), "site-tags"), column)


def _tags_by_id(df: DataFrame, written_tags: DataFrame, column: str) -> DataFrame:
    tokens = df.select("Id", F.explode(word_tokens(F.col(column))).alias("TagName"))
    return (
        tokens.join(written_tags, "TagName", "left_semi")
        .groupBy("Id")
        .agg(F.collect_set("TagName").alias("found"))
        .select("Id", longest_first(F.col("found")).alias("found"))
    )


def mark_external_tags(
    df: DataFrame, site_tags: DataFrame, column: str = "Body", match: str = "substring"
) -> DataFrame:
    """T11, second half: other tags of the site become a marker.

    The rows are written once, in parts of neighbours, so that the cleaning before is not repeated by
    those who read them: a step that is computed once per row cannot be pruned. A row whose Id is its
    own is marked together with its part; rows that share an Id share the tags found in any of them,
    and are joined with each other by Id. Rows without an Id are left out.
    """
    part = F.shiftright(F.monotonically_increasing_id(), PART_BITS)
    written = materialise(df.withColumn("_part", part), "untagged")
    tags = materialise(site_tags.select("TagName"), "site-tags")
    repeated = written.groupBy("Id").agg(F.count("*").alias("n")).where("n > 1 and Id is not null").select("Id")
    repeated = materialise(repeated, "repeated-ids")
    rows = written.where(F.col("Id").isNotNull())
    if repeated.isEmpty():
        return _marked_in_parts(rows, tags, column, match).select(df.columns)
    alone = _marked_in_parts(rows.join(repeated, "Id", "left_anti"), tags, column, match)
    shared = _marked_by_id(rows.join(repeated, "Id", "left_semi"), tags, column, match)
    return alone.select(df.columns).unionByName(shared.select(df.columns))


def _marked_in_parts(df: DataFrame, tags: DataFrame, column: str, match: str) -> DataFrame:
    """Mark the tags of rows with an Id of their own.

    Neighbours share most of their tokens, so of a part only the distinct ones are shuffled to the
    tags, and those that are tags come back to the part once. Rows are shuffled once, to meet them:
    tokens are taken from that exchange, too, with all columns but the text, so that it is reused.
    """
    rows = df.repartition("_part").withColumn("_tokens", word_tokens(F.col(column)))
    distinct = rows.drop(column).mapInArrow(_distinct_tokens, f"_part long, TagName {_kind(tags, 'TagName')}")
    hits = distinct.join(tags, "TagName", "left_semi")
    kept = [f for f in df.schema.fields if f.name != "_part"]
    schema = StructType([*kept, StructField("_found", ArrayType(StringType()))])
    done = rows.groupBy("_part").cogroup(hits.groupBy("_part")).applyInArrow(
        _fold_part([f.name for f in kept], column, match == "substring"), schema
    )
    hits_left = F.col("_found")
    marked = replace_words(F.col(column), hits_left, EXTERNAL_TAG, match)
    return computed_once(done, column, F.when(F.size(hits_left) > 0, marked).otherwise(F.col(column)))


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _distinct_tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, token) once for each part of a batch."""
    for batch in batches:
        part = batch.column("_part").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:]):
            words = pc.unique(batch.column("_tokens").slice(a, b - a).flatten())
            if len(words):
                own = pa.array(np.full(len(words), part[a]), pa.int64())
                yield pa.RecordBatch.from_arrays([own, words], ["_part", "TagName"])


def _fold_part(names: list[str], column: str, substring: bool):
    """Rows of a part with the tags that are among their tokens, longest first; where substrings are
    replaced, those of several letters are folded over the text and the single letters are left."""

    def run(rows: pa.Table, hits: pa.Table) -> pa.Table:
        tokens = rows.column("_tokens").combine_chunks()
        words = tokens.flatten()
        hit = pc.is_in(words, value_set=pc.unique(hits.column("TagName").combine_chunks()))
        ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy())
        number = np.concatenate([[0], np.cumsum(hit.to_numpy(zero_copy_only=False))])
        words = words.filter(hit).to_pylist()
        texts, found = rows.column(column).to_pylist(), []
        starts = number[np.concatenate([[0], ends[:-1]]).astype(int)].tolist()
        for i, (a, b) in enumerate(zip(starts, number[ends].tolist())):
            own = sorted(words[a:b], key=lambda w: (-len(w), w))
            if substring and own:
                longer = [w for w in own if len(w) > 1]
                texts[i] = _fold(texts[i], longer, EXTERNAL_TAG)
                own = own[len(longer) :]
            found.append(own)
        kind = rows.schema.field(column).type
        done = [pa.array(texts, kind) if n == column else rows.column(n) for n in names]
        return pa.table([*done, pa.array(found, pa.list_(pa.string()))], [*names, "_found"])

    return run


def _marked_by_id(df: DataFrame, tags: DataFrame, column: str, match: str) -> DataFrame:
    """Mark the tags of rows that may share their Id.

    The text is shuffled by Id once: tokens and text both come from that exchange (it is reused), the
    tokens are grouped on it and the found tags are joined on it. The join hints keep estimates made
    from compressed files from broadcasting the texts.
    """
    texts = df.select("Id", column).repartition("Id")
    found = _tags_by_id(texts, tags, column)
    text, hits = F.col(column), F.col("found")
    joined = texts.join(found.hint("merge"), "Id", "left")
    if match == "substring":  # the longest come first, so single letters are the last
        several = F.when(hits.isNotNull(), text)
        longer = F.filter(hits, lambda w: F.length(w) > 1)
        joined = joined.withColumn("_longer", _many_replaced(EXTERNAL_TAG)(several, longer))
        letters = F.filter(hits, lambda w: F.length(w) == 1)
        marked = replace_words(F.col("_longer"), letters, EXTERNAL_TAG, match)
    else:
        marked = replace_words(text, hits, EXTERNAL_TAG, match)
    done = computed_once(joined, column, F.when(hits.isNotNull(), marked).otherwise(text))
    done = done.select("Id", column)
    return df.drop(column).join(done.hint("merge"), "Id").select(df.columns)


def noun_forms(words: list[str]) -> list[str]:
    """Surface forms whose noun lemma is one of ``words``, longest first.

    Plurals are the regular ones; "-ch" also takes "-es".
    """
    forms = set(words) | {w + "s" for w in words} | {w + "es" for w in words if w.endswith("ch")}
    return sorted(forms, key=lambda w: (-len(w), w))


def mark_word_list(df: DataFrame, words: list[str], marker: str, column: str = "Body") -> DataFrame:
    """Tokens whose lemma is listed are replaced, longest surface form first."""
    forms = F.array(*[F.lit(w) for w in noun_forms(words)])
    stems = [w for w in words if not any(other != w and other in w for other in words)]

    def holds(part: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(part, F.lit(w)) for w in stems])

    return _mark_listed(df, column, forms, holds, marker, "substring", short_words=False)


def mark_homework(df: DataFrame, column: str = "Body") -> DataFrame:
    """Homework-related words become a marker."""
    return mark_word_list(df, HOMEWORK_WORDS, HOMEWORK, column)


def mark_assignment(df: DataFrame, column: str = "Body") -> DataFrame:
    """The word "assignment" becomes a marker."""
    return mark_word_list(df, ASSIGNMENT_WORDS, ASSIGNMENT, column)
