"""Word tokens after the published Penn Treebank conventions (T8), as JVM regexes.

The tokens are used as a membership set only, so what matters is where a word is
cut off from its neighbours; quotes need not become the conventional symbols.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from askgrade.constants import WHITESPACE_CHARS

# --- fixed values: splitting rules, in the order they apply.  They use only the
# regex subset that Java and RE2 share, so other engines can run the same list.
FULL_STOP = [
    # full stop at the end of a sentence
    (r"""([^.])\.([\])}>"']*)(\s+|$)""", r"$1 . $2 "),
]
BEFORE_APOSTROPHES = [
    # punctuation, brackets, quotes, dashes, ellipsis
    (r"""(\.\.\.|--|``|''|[;@#$%&?!\[\](){}<>"])""", r" $1 "),
    # comma and colon, unless a digit follows
    (r"([:,])(\D|$)", r" $1 $2"),
]
APOSTROPHES = [
    # closing apostrophe, possessive and contracted endings
    (r"([^' ])('[sSmMdD]|')( |$)", r"$1 $2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T)( |$)", r"$1 $2 "),
    # words written together
    (r"(?i)\b(d)('ye)\b|\b(mor)('n)\b| ('t)(is|was)\b", r" $1$3$5 $2$4$6 "),
]
AFTER_APOSTROPHES = [
    (r"(?i)\b(?:(can)(not)|(gim|lem)(me)|(gon|wan)(na)|(got)(ta))\b", r" $1$3$5$7 $2$4$6$8 "),
]
RULES = FULL_STOP + BEFORE_APOSTROPHES + APOSTROPHES + AFTER_APOSTROPHES


def _apply(text: Column, rules) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def full_stops_cut(text: Column) -> Column:
    """Every full stop before white space or at the end stands alone."""
    return _apply(text, FULL_STOP)


def word_tokens(text: Column) -> Column:
    """Distinct word tokens of a text, as an array in order of first occurrence.

    Every full stop before white space counts as the end of a sentence;
    ``operators.sentences`` learns abbreviations and keeps theirs.
    """
    return word_tokens_of_cut(full_stops_cut(text), F.contains(text, F.lit("'")))


def near(text: Column, holds: Callable[[Column], Column]) -> Column:
    """What of a text has to be tokenised to know which words are tokens of it.

    No rule reaches across a space, so stretches between spaces that do not hold any of the words can
    go. The first one stays, since a rule asks for a space before a word. Texts with other white
    space, or ends of lines that ``$`` would take for the end, are left whole.
    """
    kept = F.filter(F.split(text, " "), lambda part, i: (i == 0) | holds(part))
    return F.when(text.rlike(r"[\t-\r\u0085\u2028\u2029]"), text).otherwise(F.array_join(kept, " "))


def word_tokens_of_cut(text: Column, has_apostrophe: Column | None = None) -> Column:
    """The word tokens of a text whose full stops at sentence ends stand alone already."""
    spaced = _apply(text, BEFORE_APOSTROPHES)
    if has_apostrophe is None:
        has_apostrophe = F.contains(text, F.lit("'"))
    spaced = F.when(has_apostrophe, _apply(spaced, APOSTROPHES)).otherwise(spaced)
    words = F.split(_apply(spaced, AFTER_APOSTROPHES), f"[{WHITESPACE_CHARS}]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))
