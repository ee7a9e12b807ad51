"""Sentence ends cost one reading of a text, however many there are."""

from askgrade.operators import sentences


def test_sentence_ends_of_a_long_text_are_found_in_one_reading(spark):
    """A text of many sentences must not be cut into pieces again for each of them."""
    plan = spark.createDataFrame([(1, "x. " * 50)], "Id long, Body string")
    none = spark.createDataFrame([], "word string")
    df = sentences.with_sentence_tokens(plan, none)
    assert [r.tokens for r in df.collect()] == [["x.", "x", "."]]
    text = df._jdf.queryExecution().analyzed().toString()
    assert text.count("regexp_extract_all(Body") == 2  # abbreviations of the text, and its pieces
