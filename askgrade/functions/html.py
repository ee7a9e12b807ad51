"""HTML to text (entities, code blocks, links, tag removal, whitespace).

Well-formed markup, which is what post bodies almost always are, is handled by
JVM regular expressions.  Rows for which the expressions cannot give the answer
of a real parser (script elements, unbalanced code, stray angle brackets, rare
entities) are recognised by a predicate, and only they are sent to an Arrow UDF
over the standard library's parser; every other row passes NULL to it.
"""

from __future__ import annotations

import html as html_entities
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from askgrade.constants import CODEBLOCK, LINKS, WHITESPACE_CHARS
from askgrade.functions.columns import computed_once

# Entities replaced inside the JVM; "&amp;" has to be the last one.
NATIVE_ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&#xA;": "\n",
    "&#xD;": "\r",
    "&nbsp;": "\u00a0",
    "&copy;": "\u00a9",
    "&middot;": "\u00b7",
    "&hellip;": "\u2026",
    "&ndash;": "\u2013",
    "&mdash;": "\u2014",
    "&amp;": "&",
}

# Possessive quantifiers throughout: the JVM runs those loops without recursion,
# so long bodies cannot overflow a task's stack.
_ATTRIBUTES = (
    r"""(?:\s++[^\s<>"'=/]++(?:\s*+=\s*+(?:"[^"<]*+"|'[^'<]*+'|[^\s<>"'=`]++))?+)*+\s*+"""
)
_TAG = rf"""<[a-zA-Z][^\s<>"'=/]*+{_ATTRIBUTES}/?>|</[a-zA-Z][^\s<>"'/]*+\s*+>"""
_COMMENT = r"(?s:<!--.*?--\s*+>)"
_MARKUP = f"{_COMMENT}|{_TAG}"


def _element(name: str) -> str:
    """An element whose content closes nothing but the element itself."""
    return rf"(?i:<{name}){_ATTRIBUTES}>[^<]*+(?:<(?!/|(?i:{name}\b))[^<]*+)*+(?i:</{name})\s*+>"


_BLOCK = "p|div|li|ul|ol|dl|dd|dt|blockquote|pre|table|tr|td|th|h[1-6]|body|html|code"


def _link_element() -> str:
    """A link; inline tags inside it are fine, nested links and block ends are not."""
    stop = rf"(?i:/?a\b|/(?:{_BLOCK})\b)"
    return rf"(?i:<a){_ATTRIBUTES}>[^<]*+(?:<(?!{stop})[^<]*+)*+(?i:</a)\s*+>"


_RAW_TEXT = r"(?i)<(?:script|style|textarea|title|iframe|noembed|noframes|noscript|xmp|plaintext)\b"
_HALF_TAG = r"<[a-zA-Z/!?]"
_OPEN_REPLACED = {"code": r"(?i)</?code\b", "a": r"(?i)</?a\b"}
_TAG_INSIDE_PRE = r"(?i)<pre\b[^>]*+>[^<]*+<(?!/pre\s*>)"
_OTHER_ENTITY = "&(?!(?:" + "|".join(e[1:-1] for e in NATIVE_ENTITIES) + r");)[^\t\n\x0c <&;]"


def collapse_whitespace(c: Column) -> Column:
    """T5: every run of Unicode whitespace becomes one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, f"[{WHITESPACE_CHARS}]+", " "))


def unescape_native(c: Column) -> Column:
    """T1 for the entities in ``NATIVE_ENTITIES``."""
    decoded = c
    for entity, char in NATIVE_ENTITIES.items():
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


@F.pandas_udf(StringType())
def _unescape_any(text: pd.Series) -> pd.Series:
    return text.map(html_entities.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """All HTML entities; only rows with an unusual entity leave the JVM."""
    unusual = c.rlike(_OTHER_ENTITY)
    return F.when(unusual, _unescape_any(F.when(unusual, c))).otherwise(unescape_native(c))


def replace_code(c: Column) -> Column:
    """T2, regular form: the content of ``<code>`` elements becomes one marker."""
    return F.regexp_replace(c, _element("code"), CODEBLOCK)


def replace_links(c: Column) -> Column:
    """T3, regular form: the content of ``<a>`` elements becomes one marker."""
    return F.regexp_replace(c, _link_element(), LINKS)


def strip_tags_native(c: Column, boundary: str = "") -> Column:
    """T4, regular form: comments and tags give way to ``boundary``."""
    return F.regexp_replace(c, _MARKUP, boundary)


# --- parser-backed form -------------------------------------------------------

# Elements that never have content, so they are closed where they open.
_VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr".split()
)
_MARKER_OF = {"code": CODEBLOCK, "a": LINKS}
# Stand-ins that keep script text out of a second parse.
_HIDE = str.maketrans({"<": "\ufdd0", "&": "\ufdd1"})
_SHOW = str.maketrans({"\ufdd0": "<", "\ufdd1": "&"})


class _TextReader(HTMLParser):
    """Collects visible text; elements named in ``replaced`` yield their marker."""

    def __init__(self, replaced=(), spaced=False):
        super().__init__(convert_charrefs=True)
        self.replaced, self.spaced = frozenset(replaced), spaced
        self.open, self.pieces = [], []
        self.hidden_from = None  # depth of the element whose content is replaced

    def _break(self):
        if self.spaced and self.hidden_from is None and not {"pre", "textarea"} & set(self.open):
            self.pieces.append(" ")

    def handle_starttag(self, tag, attrs):
        self._break()
        if tag not in _VOID:
            self.open.append(tag)
            if tag in self.replaced and self.hidden_from is None:
                self.pieces.append(_MARKER_OF[tag])
                self.hidden_from = len(self.open)
        self._break()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
            if self.hidden_from is not None and len(self.open) < self.hidden_from:
                self.hidden_from = None
        self._break()

    def handle_data(self, data):
        if self.hidden_from is None:
            hide = self.spaced and self.cdata_elem is not None
            self.pieces.append(data.translate(_HIDE) if hide else data)


def read_text(markup: str, replaced=(), spaced=False, keep_tail=True) -> str:
    """Visible text of one document according to the standard library's parser."""
    reader = _TextReader(replaced, spaced)
    reader.feed(markup)
    if keep_tail:
        reader.close()
    return "".join(reader.pieces)


def clean_document(body: str, replaced=(), unescape_first=True, keep_tail=True) -> str:
    """Parser-backed cleaning of one document, whitespace collapsed."""
    if unescape_first:
        body = html_entities.unescape(body)
    if replaced and unescape_first:
        text = read_text(body, replaced, spaced=True)
    elif replaced:
        text = read_text(read_text(body, replaced, spaced=True))
    else:
        text = read_text(body, keep_tail=keep_tail)
    return " ".join(text.translate(_SHOW).split())


def _parser_udf(replaced, unescape_first, keep_tail):
    @F.pandas_udf(StringType())
    def parse(text: pd.Series) -> pd.Series:
        return text.map(
            lambda t: clean_document(t, replaced, unescape_first, keep_tail), na_action="ignore"
        )

    return parse


def clean_html(
    df: DataFrame,
    column: str = "Body",
    replaced: tuple[str, ...] = (),
    unescape_first: bool = True,
    exact: bool = True,
    compat: bool = False,
) -> DataFrame:
    """Replace an HTML column by its visible text, whitespace collapsed.

    ``replaced``        elements (``code``, ``a``) whose content becomes a marker;
                        with any, tag boundaries turn into spaces (outside ``<pre>``).
    ``unescape_first``  decode entities before reading tags, so ``&lt;b&gt;`` in the
                        text counts as a tag. False is the single-marker order:
                        markers on the raw markup first, then decode and strip.
    ``exact``           send irregular rows to the parser; False stays in the JVM.
    ``compat``          lose an unterminated tail the way the original stripper does.

    Every step is computed once per row although the next step and the irregularity
    test both read it.
    """
    body = F.col(column)
    if compat and not replaced:
        parsed = df.withColumn("_parsed", _parser_udf((), unescape_first, False)(body))
        return computed_once(parsed, column, F.col("_parsed")).select(df.columns)
    boundary = " " if replaced else ""
    steps = computed_once(df, "_source", unescape_native(body) if unescape_first else body)
    marked = F.col("_source")
    if "code" in replaced:
        marked = replace_code(marked)
    if "a" in replaced:
        marked = replace_links(marked)
    if replaced:
        steps = computed_once(steps, "_marked", marked)
        marked = F.col("_marked")
    steps = computed_once(steps, "_stripped", strip_tags_native(marked, boundary))
    text = F.col("_stripped")
    irregular = F.col("_source").rlike(_RAW_TEXT) | text.rlike(_HALF_TAG)
    for name in replaced:
        irregular = irregular | marked.rlike(_OPEN_REPLACED[name])
    if replaced:
        irregular = irregular | marked.rlike(_TAG_INSIDE_PRE)
    irregular = irregular | body.rlike(_OTHER_ENTITY) | text.rlike(_OTHER_ENTITY)
    if replaced and not unescape_first:
        steps = computed_once(steps, "_decoded", unescape_native(text))
        steps = computed_once(steps, "_second", strip_tags_native(F.col("_decoded")))
        text = F.col("_second")
        irregular = irregular | text.rlike(_HALF_TAG) | text.rlike(_OTHER_ENTITY)
    result = collapse_whitespace(unescape_native(text))
    if exact:
        steps = computed_once(steps, "_irregular", F.coalesce(irregular, F.lit(False)))
        parser = _parser_udf(tuple(replaced), unescape_first, True)
        steps = steps.withColumn("_parsed", parser(F.when(F.col("_irregular"), body)))
        result = F.when(F.col("_irregular"), F.col("_parsed")).otherwise(result)
    return computed_once(steps, column, result).select(df.columns)
