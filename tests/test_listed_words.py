"""Listed words are found and replaced in one reading, with the results of the plain steps."""

import random

from pyspark.sql import functions as F

from askgrade.functions import markers, tokens


def test_external_tags_are_folded_in_order_in_one_reading(spark):
    """Hits inside other hits, in markers and across each other, against the fold word by word."""
    rng = random.Random(5)
    letters = ["a", "b", "g", "t", "ta", "tag", "has", "é", "_", " ", " ", " ", ";", "; ", "x"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 90))) for _ in range(150)] + ["tag tag;b has_external_tag", ""]
    names = ["tag", "has", "ab", "ba", "tagab", "external", "a", "_", "é", "has_external_tag", "gt"]
    many = [f"q{i}" for i in range(260)]
    for more in ([], many):  # few words are folded one by one, many in one reading
        own = [" ".join([t, *more]) for t in texts]
        df = spark.createDataFrame(list(enumerate(own)), "Id long, Body string")
        tags = spark.createDataFrame([(n,) for n in names + more], "TagName string")
        found = {r.Id: r.found for r in markers.site_tags_in_text(df, tags).collect()}
        assert max(len(f) for f in found.values()) > len(more) + 3
        plain = spark.createDataFrame([(i, t, found.get(i, [])) for i, t in enumerate(own)], "Id long, Body string, hits array<string>")
        expected = plain.select("Id", markers.replace_words(F.col("Body"), F.col("hits"), " has_external_tag ").alias("Body"))
        assert sorted(markers.mark_external_tags(df, tags).collect()) == sorted(expected.collect())


def test_words_are_listed_alike_from_parts_of_a_text(spark):
    rng = random.Random(6)
    pieces = ["'tis", "can", "not", "cannot", "exam", "exam's", "exam.", ".", ".)", "'", " ", "\t", "\n", " ", "  ", ",", ":", "...", "''", "d'ye", " ", "x"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    words = ["exam", "'t", "is", "not", ".", "'s", "'", "can", "d"]
    df = spark.createDataFrame([(t,) for t in texts], "Body string")
    array = F.array(*[F.lit(w) for w in words])
    holds = lambda part: F.exists(array, lambda w: F.contains(part, w))
    own = lambda c: F.array_intersect(array, tokens.word_tokens(c))
    different = df.where(own(F.col("Body")) != own(tokens.near(F.col("Body"), holds)))
    assert different.collect() == []
