"""License scans: notice phrases, identifier tags and license expressions.

An Aho-Corasick automaton runs once over the words of each whole text and reports every place
of every phrase. Where it meets an identifier tag, the expression behind the tag is parsed with
a shunting yard (WITH binds before AND, AND before OR) and evaluated against a policy.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from askgrade.llm.common import small_batches, whole_texts

#: phrase, label, whether it is a base phrase, how sure it makes one of a license (0 to 1)
PHRASES = (
    ("mit license", "mit", True, 0.9),
    ("apache license", "apache", True, 0.9),
    ("general public license", "gpl", True, 0.9),
    ("lesser general public license", "lgpl", False, 0.9),
    ("affero general public license", "agpl", False, 0.9),
    ("gnu gpl", "gpl", False, 0.8),
    ("gnu lgpl", "lgpl", False, 0.8),
    ("mozilla public license", "mpl", False, 0.9),
    ("eclipse public license", "epl", False, 0.9),
    ("bsd license", "bsd", False, 0.9),
    ("bsd 2 clause", "bsd", False, 0.8),
    ("bsd 3 clause", "bsd", False, 0.8),
    ("redistribution and use in source and binary forms", "bsd", False, 0.9),
    ("permission is hereby granted free of charge", "mit", False, 0.9),
    ("licensed under mit", "mit", False, 0.8),
    ("isc license", "isc", False, 0.9),
    ("the unlicense", "unlicense", False, 0.7),
    ("cc by", "cc-by", False, 0.7),
    ("cc by sa", "cc-by-sa", False, 0.8),
    ("cc by nc", "cc-by-nc", False, 0.8),
    ("cc by nd", "cc-by-nd", False, 0.8),
    ("cc by nc sa", "cc-by-nc-sa", False, 0.8),
    ("cc by nc nd", "cc-by-nc-nd", False, 0.8),
    ("cc0", "cc0", False, 0.7),
    ("creative commons attribution", "cc-by", False, 0.7),
    ("public domain", "public-domain", False, 0.4),
    ("all rights reserved", "proprietary", False, 0.5),
)
TAG = "spdx license identifier"
TAG_SURE = 1.0
_TAG_PLACE = re.compile(r"SPDX-License-Identifier:[ \t]*", re.IGNORECASE)
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_VERSION = re.compile(r"[A-Za-z].*-v?[0-9]")
_LOOKS = re.compile(r"[0-9-]|[A-Z].*[A-Z]")
_ALONE = re.compile(r"[ \t]*(?:(?:AND|OR|WITH)\b|[^\w \t(]|\Z)")
#: Known families of identifiers; an identifier is one of these, or starts with one and a hyphen.
FAMILIES = (
    "MIT", "Apache", "BSD", "ISC", "MPL", "EPL", "GPL", "LGPL", "AGPL", "CC0", "CC-BY",
    "Unlicense", "Zlib", "BSL", "LicenseRef",
)
#: The policy of the registered query: families whose texts may be used.
PERMITTED = frozenset({"MIT", "Apache", "BSD", "ISC", "CC0", "Unlicense", "Zlib", "BSL", "CC-BY"})
_BINDS = {"OR": 1, "AND": 2, "WITH": 3}


def family(identifier: str) -> str | None:
    """The longest family an identifier belongs to; None if it is unknown."""
    low = identifier.lower().rstrip("+")
    found = [f for f in FAMILIES if low == f.lower() or low.startswith(f.lower() + "-")]
    if low.startswith("cc-by-n"):  # not for commercial use, or without changes
        return "CC-BY-N"
    return max(found, key=len) if found else None


def _named(token: str, last: str, stack: list[str], text: str, end: int) -> bool:
    """Whether an unknown name that ends at ``end`` after the operator ``last`` (if any) is an identifier."""
    if last and last != last.upper():
        return _VERSION.search(token) is not None
    if last and stack[-1] != "(":
        return True
    return _LOOKS.search(token) is not None or _ALONE.match(text, end) is not None


def parse(text: str, start: int = 0) -> list[str]:
    """The license expression at ``start`` in postfix order; as much as is well formed.

    After WITH or an upper-case operator any name is taken, known or not. At the start and in a
    bracket there, an unknown name needs the look of an identifier (``_LOOKS``) or has to stand
    alone (``_ALONE``); after a lower-case operator, where prose may follow, it needs a version.
    The expression ends before any other name, and before an operator without a right operand.
    Open brackets end with the expression.
    """
    out: list[str] = []
    stack: list[str] = []
    want, good, last = True, None, ""
    while (m := _TOKEN.match(text, start)) is not None:
        token = m[1]
        name = token.upper()
        if want and token == "(":
            stack.append(token)
        elif want and name not in _BINDS and token != ")":
            after_with = bool(stack) and stack[-1] == "WITH"
            token = token.rstrip(".:-") or token
            if not after_with and family(token) is None and not _named(token, last, stack, text, m.end()):
                break
            out.append(token)
            want = False
        elif not want and token == ")" and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif not want and name in _BINDS:
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[name]:
                out.append(stack.pop())
            stack.append(name)
            want, last = True, token
        else:
            break
        start = m.end()
        if not want:
            good = (list(out), list(stack))
    if good is None:
        return []
    out, stack = good
    return out + [x for x in reversed(stack) if x != "("]


def permitted(postfix: Iterable[str], policy: frozenset[str] = PERMITTED) -> bool:
    """Whether an expression allows use: OR needs one side, AND both; an exception (WITH) only
    adds to what its license allows."""
    values: list[bool] = []
    for token in postfix:
        if token in _BINDS:
            right, left = values.pop(), values.pop()
            values.append(left or right if token == "OR" else left and right if token == "AND" else left)
        else:
            values.append(family(token) in policy)
    return values[-1]


def labels_of(postfix: Iterable[str]) -> set[str]:
    """Lower-case identifiers of an expression, without exceptions."""
    names: list[set[str]] = []
    for token in postfix:
        if token in _BINDS:
            right, left = names.pop(), names.pop()
            names.append(left if token == "WITH" else left | right)
        else:
            names.append({token.lower()})
    return names[-1]


_SEPARATORS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_automata: list[ahocorasick.Automaton] = []


def _automaton() -> ahocorasick.Automaton:
    """Built once in each Python worker."""
    if not _automata:
        made = ahocorasick.Automaton()
        for phrase, label, base, sure in (*PHRASES, (TAG, "", False, TAG_SURE)):
            made.add_word(f" {phrase} ", (phrase, label, base, sure))
        made.make_automaton()
        _automata.append(made)
    return _automata[0]


def scan_text(text: str) -> dict:
    """One text's finds."""
    words = text.encode("utf-8", "surrogatepass").translate(_SEPARATORS).split()
    joined = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass")
    base: list[tuple[int, str]] = []
    labels: set[str] = set()
    sure: dict[str, float] = {}
    counted, at, tagged = 0, 0, False
    for end, (phrase, label, is_base, how_sure) in _automaton().iter(joined):
        begin = end - len(phrase) - 1
        if begin > at:
            counted += joined.count(" ", at, begin)
            at = begin
        place = counted - (joined.count(" ", begin, at) if begin < at else 0)
        if phrase == TAG:
            tagged = True
            continue
        labels.add(label)
        sure[phrase] = how_sure
        if is_base:
            base.append((place, label))
    expressions = []
    if tagged:
        for m in _TAG_PLACE.finditer(text):
            if postfix := parse(text, m.end()):
                expressions.append(" ".join(postfix))
                labels |= labels_of(postfix)
                sure[TAG] = TAG_SURE
    doubt = 1.0
    for x in sure.values():
        doubt *= 1 - x
    starts = [p for p, _ in base]
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted({x for _, x in base})),
        "labels": ",".join(sorted(labels)),
        "score": 1 - doubt,
        "expressions": expressions,
        "permitted": all(permitted(x.split()) for x in expressions) if expressions else None,
    }


_COLUMNS = [
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
    ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("expressions", pa.list_(pa.string())), ("permitted", pa.bool_()),
]
_SCHEMA = """doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string,
    labels string, score double, expressions array<string>, permitted boolean"""


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [scan_text(x) for x in batch.column("text").to_pylist()]
        columns = [batch.column("doc_id")]
        columns += [pa.array([r[name] for r in rows], kind) for name, kind in _COLUMNS[1:]]
        yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(_COLUMNS))


def scan(documents: DataFrame) -> DataFrame:
    """One row per document, repeated rows too; no shuffle.

    ``n_words`` counts the runs of digits, lower-cased A-Z and characters beyond ASCII. A place
    is the number of words before it; ``first_word`` and ``last_word`` are null without a base
    phrase. ``expressions`` holds tagged expressions in postfix order, ``permitted`` whether all
    of them allow use (null without any). ``score`` is the certainty that the text states a
    license: one minus the product of the doubts that its distinct phrases leave. A null or
    empty text has no words, no finds and score 0. Extra columns are left behind.
    """
    return small_batches(whole_texts(documents)).mapInArrow(_scan, _SCHEMA)
