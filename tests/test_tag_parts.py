"""Site tags are looked up for parts of neighbouring rows; rows that share an Id share their tags."""

from askgrade.functions import markers
from askgrade.session import materialise

TEXTS = [
    "plain c and c++ code, not abc", "", None, "no listed word", "sql-server and sql and x", "the sql server's c",
    "a tag at the end sql", "naïve größe sql c",
]
TAGS = ["sql", "c", "c++", "sql-server", "größe", "code", "x", "unused", None]


def _tables(spark, ids):
    rows = [(i, TEXTS[n % len(TEXTS)], n) for n, i in enumerate(ids)]
    tags = spark.createDataFrame([(t,) for t in TAGS], "TagName string")
    return spark.createDataFrame(rows, "Id long, Body string, n int"), tags


def _both_ways(spark, ids, match):
    df, tags = _tables(spark, ids)
    now = markers.mark_external_tags(df, tags, match=match)
    by_id = markers._marked_by_id(df, tags, "Body", match)
    assert now.columns == by_id.columns == df.columns
    return sorted(map(tuple, now.collect()), key=str), sorted(map(tuple, by_id.collect()), key=str)


def test_parts_and_ids_give_the_same_rows(spark):
    for match in ("substring", "token"):
        now, by_id = _both_ways(spark, [*range(20), None], match)
        assert now == by_id and len(now) == 20


def test_rows_that_share_an_id_share_their_tags(spark):
    now, by_id = _both_ways(spark, [1, 2, 3, 4, 5, 1, 1, 5, None, None], "substring")
    assert now == by_id and len(now) == 3 + 3 * 3 + 2 * 2


def test_rows_of_their_own_are_not_grouped_by_id(spark):
    df, tags = _tables(spark, range(200))
    marked = markers.mark_external_tags(df.repartition(3), materialise(tags, "tags"))
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "hashpartitioning(Id" not in plan


def test_a_part_asks_for_a_token_once(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["b"]), (1, None), (2, ["b"]), (2, [])], "_part long, _tokens array<string>")
    asked = df.coalesce(1).mapInArrow(markers._distinct_tokens, "_part long, TagName string")
    assert sorted(map(tuple, asked.collect())) == [(1, "a"), (1, "b"), (2, "b")]
