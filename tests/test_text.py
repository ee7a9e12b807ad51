"""Golden strings and invariants of the text functions."""

import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from askgrade.functions import html, markers, tokens
from askgrade.functions.stem import stem_text, stem_word
from askgrade.operators import sentences
from askgrade.operators.clean import clean, prepare_for_scoring
from askgrade.operators.datasets import single_marker, stripped


def column(spark, texts, function):
    df = spark.createDataFrame(list(enumerate(texts)), "Id long, Body string")
    rows = df.select("Id", function(F.col("Body")).alias("out")).orderBy("Id").collect()
    return [r.out for r in rows]


def cleaned(spark, texts, *args, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "Id long, Body string")
    return [r.Body for r in html.clean_html(df, "Body", *args, **options).orderBy("Id").collect()]


def test_numeric_marker(spark):
    texts = ["2^1000 and v1.2", "x -3 +7 3-", "abc12def6 b2 _5", "3.14", "é5 ٣"]
    assert column(spark, texts, markers.mark_numeric) == [
        " has_numeric ^ has_numeric  and v1. has_numeric ",
        "x  has_numeric   has_numeric   has_numeric -",
        "abc12def6 b2 _5",
        " has_numeric . has_numeric ",
        "é5  has_numeric ",
    ]


def test_hexadecimal_marker(spark):
    texts = ["0xff", "a 0xff b", "f(0x) (0x)", "a0x2", "z0x12", "at 0X1g", "z0x é0x", "q 0x"]
    assert column(spark, texts, markers.mark_hexadecimal) == [
        "0xff",
        "a has_hexadecimal  b",
        "f has_hexadecimal ) (0x)",
        "a0x2",
        " has_hexadecimal ",
        "at has_hexadecimal ",
        " has_hexadecimal   has_hexadecimal ",
        "q has_hexadecimal ",
    ]


def test_hexadecimal_then_numeric(spark):
    both = column(
        spark,
        ["addr 0x0012 and 12"],
        lambda c: markers.mark_numeric(markers.mark_hexadecimal(c)),
    )
    assert both == ["addr has_hexadecimal  and  has_numeric "]


def test_tag_array(spark):
    texts = ["<c><multithreading>", "<eclipse><programming-languages><eclipse-plugin>", "<b><a>", ""]
    assert column(spark, texts, markers.tag_array) == [
        ["multithreading", "c"],
        ["programming-languages", "eclipse-plugin", "eclipse"],
        ["a", "b"],
        [],
    ]


def test_replace_words(spark):
    df = spark.createDataFrame(
        [("java javascript c c# C", ["java", "c"])], "t string, hits array<string>"
    )
    out = df.select(
        markers.replace_words(F.col("t"), F.col("hits"), " M ").alias("substring"),
        markers.replace_words(F.col("t"), F.col("hits"), " M ", match="token").alias("token"),
    ).first()
    assert out["substring"] == " M   M script  M   M #  M "
    assert out["token"] == " M  javascript  M   M # C"
    with pytest.raises(ValueError):
        markers.replace_words(F.col("t"), F.col("hits"), " M ", match="other")


def test_word_tokens(spark):
    text = "using c#, 'decimal' vb.net .net? i can't cannot (foo) bar. end... x:y 1:2 dog's. done."
    (words,) = column(spark, [text], tokens.word_tokens)
    assert {"c", "#", "'decimal", "vb.net", ".net", "ca", "n't", "can", "not", "foo"} <= set(words)
    assert {"bar", "1:2", "dog", "'s", "done", "..."} <= set(words)
    assert "decimal" not in words and "c#" not in words


LEARNT = [
    "see fig. 3 and fig. 4 for this. we met dr. who at ten. it ends here.",
    "use a list, e.g. x or e.g. y, in fig. 5. the dr. was out (cf. fig. 6). j. smith came.",
    "the fig. 7 shows more. the list was here and this was more. wait... what? yes",
    "a word. the word is a word and the words are words",
    "",
    None,
] * 3


def _plain_abbreviations(texts):
    """The published score, word by word."""
    stops, plain = Counter(), Counter()
    for text in texts:
        for piece in (text or "").lower().split():
            bare = piece.lstrip("\"'([{<").rstrip("\"')]}>,;:!?")
            ends = bare.endswith(".") and not bare.endswith("..")
            word = bare[:-1] if ends else bare
            if any(c.isalpha() for c in word) and not word.endswith("."):
                (stops if ends else plain)[word] += 1
    n = sum(stops.values()) + sum(plain.values())
    p = sum(stops.values()) / n
    found = {}
    for word, k in stops.items():
        m, dots = plain[word], word.count(".")
        letters = len(word) - dots
        ratio = 2 * (k * math.log(0.99 / p) + m * math.log(0.01 / (1 - p)))
        score = ratio * math.exp(-letters) * (dots + 1) * float(letters) ** -m
        if score >= 0.3:
            found[word] = (k, m, score)
    return found


def test_abbreviations_equal_a_plain_version(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(LEARNT)], "Id long, Body string")
    wanted = _plain_abbreviations(LEARNT)
    got = {r.word: (r.with_stop, r.without, r.score) for r in sentences.abbreviations(df).collect()}
    assert {"fig", "e.g", "dr"} <= set(got) == set(wanted) and "here" not in got
    for word, (k, m, score) in wanted.items():
        assert got[word][:2] == (k, m) and got[word][2] == pytest.approx(score)
    assert sentences.abbreviations(df.limit(0)).collect() == []
    assert sentences.abbreviations(df.where("Body is null or Body = ''")).collect() == []


def test_sentence_tokens(spark):
    data = list(enumerate(LEARNT)) + [(0, "once dr. again"), (None, "the fig. 3 here. now"), (99, "fig.")]
    df = spark.createDataFrame(data, "Id long, Body string")
    found = spark.createDataFrame([("fig",), ("e.g",), ("dr",)], "word string")
    rows = sentences.with_sentence_tokens(df, found).collect()
    assert len(rows) == len(data)
    got = {(r.Id, r.Body): r.tokens for r in rows}
    assert {"fig.", "dr.", "ten", "this", "."} <= set(got[0, LEARNT[0]]) and "here." not in got[0, LEARNT[0]]
    assert {"e.g.", "fig.", "j.", "cf", "5", "out"} <= set(got[1, LEARNT[1]])
    assert got[0, "once dr. again"] == ["once", "dr.", "again"]
    assert got[None, "the fig. 3 here. now"] == ["the", "fig", ".", "3", "here", "now"]
    assert got[99, "fig."] == ["fig", "."]  # the end of a text ends a sentence
    assert got[4, ""] == [] and got[5, None] is None
    none = spark.createDataFrame([], "word string")
    texts = [t.replace("j. ", "") for t in LEARNT if t] + ["dog's\nx. y\n it's a.\tb."]
    df = spark.createDataFrame([(i, t.replace(" a.", " aa.")) for i, t in enumerate(texts)], "Id long, Body string")
    same = sentences.with_sentence_tokens(df, none).select("tokens", tokens.word_tokens(F.col("Body")).alias("plain"))
    assert all(r.tokens == r.plain for r in same.where("not Body like '%x.%'").collect())


def test_homework_and_assignment(spark):
    df = spark.createDataFrame(
        [(1, "my exams example"), (2, "example only"), (3, "teaches teachers, assignments")],
        "Id long, Body string",
    )
    done = markers.mark_assignment(markers.mark_homework(df)).orderBy("Id")
    assert [r.Body for r in done.collect()] == [
        "my  has_homework  example",
        "example only",
        " has_homework   has_homework ,  has_assignment ",
    ]


def test_substring_replacement_hits_longer_words(spark):
    df = spark.createDataFrame([(1, "an exam, an example")], "Id long, Body string")
    assert markers.mark_homework(df).first().Body == "an  has_homework , an  has_homework ple"


def test_version_marker_is_off_by_default(spark):
    texts = ["version 1.2 and v.3"]
    assert column(spark, texts, markers.mark_version_number) == texts
    on = column(spark, texts, lambda c: markers.mark_version_number(c, enabled=True))
    assert on == [" has_version_number  and  has_version_number "]


CASES = [
    "foo<b>bar</b>baz",
    '<script>var t="</p>";track(7);</script>X',
    "<!-- c -->Z",
    "if a <b then lost",
    "tail AT&T",
    "a < b and c",
    'x <pre><code class="a">if 1\n<b></code></pre> y <code>z</code>',
    "<p>( <code>x</code> ): &lt;div&gt; &amp;lt; &eacute; ok</p>",
    '<p>a<a href="http://x.y?a=1&amp;b=2">l <b>i</b></a>?</p>',
    "<p>a <code>&lt;/p&gt;</code> b</p>",
    "<code>x <code>y</code> z</code> w",
    "<pre>foo<b>bar</b></pre>x",
    "<p>1 &lt; 2 &amp;&amp; 3 &gt; 2</p>",
    "<a title='x>y'>z</a>",
    "<p>unclosed <code>foo",
    "a<br/>b<img src='i'>c &#8217; &copy2",
    "<A HREF=x>y</A> <CODE>q</CODE>",
]


@pytest.mark.parametrize(
    "replaced, first", [((), True), (("code", "a"), True), (("code",), False), (("a",), False)]
)
def test_expressions_agree_with_the_parser(spark, replaced, first):
    expected = [html.clean_document(c, replaced, first) for c in CASES]
    assert cleaned(spark, CASES, replaced, unescape_first=first) == expected


def test_strip_golden(spark):
    texts = ["foo<b>bar</b>baz", '<script>var t="</p>";track(7);</script>X', "<!-- c -->Z", None]
    assert cleaned(spark, texts) == ["foobarbaz", 'var t="</p>";track(7);X', "Z", None]


def test_compat_loses_tails(spark):
    assert cleaned(spark, ["if a <b then lost", "tail AT&T"], compat=True) == ["if a", ""]


def test_code_and_links(spark):
    texts = ['x <pre><code class="a">if 1\n<b></code></pre> y', "( <code>v</code> ): <a href='#'>l</a>?"]
    assert cleaned(spark, texts, ("code", "a")) == [
        "x has_codeblock y",
        "( has_codeblock ): has_links ?",
    ]


def test_no_marker_no_change(spark):
    texts = ["plain words only", ""]
    for function in (markers.mark_numeric, markers.mark_hexadecimal):
        assert column(spark, texts, function) == texts


@given(st.text(max_size=200))
def test_parser_never_fails(text):
    out = html.clean_document(text)
    assert out == " ".join(out.split())


def test_stem_words():
    pairs = {
        "caresses": "caress", "ponies": "poni", "dies": "die", "crying": "cri", "cried": "cri",
        "relational": "relat", "hopping": "hop", "happy": "happi", "generally": "gener",
        "adjustable": "adjust", "sky": "sky", "at": "at", "has_numeric": "has_numer",
    }
    assert {w: stem_word(w) for w in pairs} == pairs


def test_stem_text(spark):
    assert column(spark, ["The  Crying\ncats", None], stem_text) == ["the cri cat", None]


def test_full_cleaner_order(spark):
    body = "<p>Use <code>x=1</code> in java, see <a href='u'>this 5</a> at 0xff; 7 exams</p>"
    df = spark.createDataFrame([(1, body, "<java><c>"), (2, None, "<c>")], "Id long, Body string, Tags string")
    site = spark.createDataFrame([("see",)], "TagName string")
    done = clean(df, site_tags=site).collect()
    assert [r.Body for r in done] == [
        "Use has_codeblock in  has_attached_tag ,  has_external_tag  has_links at has_hexadecimal ;"
        "  has_numeric   has_homework "
    ]


def test_single_markers_keep_case_for_markup_kinds(spark):
    df = spark.createDataFrame([(1, "<p>Big <code>Q</code> 9</p>", "<big>")], "Id long, Body string, Tags string")
    assert single_marker(df, "codeblock").first().Body == "Big has_codeblock 9"
    assert single_marker(df, "numeric").first().Body == "big q  has_numeric "
    assert single_marker(df, "tags").first().Body == " has_attached_tag  q 9"
    assert stripped(df).first().Body == "big q 9"


def test_scoring_preparation(spark):
    df = spark.createDataFrame([(1, "My Homework has 12 parts at 0x1f")], "Id long, Body string")
    assert prepare_for_scoring(df).first().Body == "my has_homework ha has_numer part at has_hexadecim"


def test_whole_word_replacement_equals_a_plain_version(spark):
    rng = random.Random(5)
    tags = ["java", "c", "c#", "r", "node.js", "java-8", "é"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(tags + [" ", ", ", "script", "_", "x"]) for _ in range(rng.randint(0, 25)))
        rows.append((i, text, sorted(rng.sample(tags, 3), key=lambda t: (-len(t), t))))
    df = spark.createDataFrame(rows, "Id int, Body string, own array<string>")
    done = markers.replace_words(F.col("Body"), F.col("own"), " M ", match="token")
    got = {r.Id: r.done for r in df.select("Id", done.alias("done")).collect()}
    for i, text, own in rows:
        for tag in own:
            text = re.sub(rf"(?<!\w){re.escape(tag)}(?!\w)", " M ", text)
        assert got[i] == text
