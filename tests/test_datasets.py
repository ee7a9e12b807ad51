"""Data sets, sources, splits, metrics: small fixtures and brute force."""

import itertools
import os
import math
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from askgrade import constants as C
from askgrade.operators import datasets, metrics, questions, split
from askgrade.operators.order_stats import key_at_ranks
from askgrade.schemas import LABELLED_QUESTION
from askgrade.session import discard, materialise, new_path
from askgrade.sources import cached, csv_files, libsvm, tables


def labelled(spark, n_bad, n_good, seed=1):
    ids = random.Random(seed).sample(range(10**6), n_bad + n_good)
    rows = [(i, -1) for i in ids[:n_bad]] + [(i, 1) for i in ids[n_bad:]]
    return spark.createDataFrame(rows, "Id long, label int"), rows


EXPORT = """,Id,Score,ViewCount,Body,Title,AnswerCount,CommentCount,AcceptedAnswerId,OwnerUserId,CreationDate,Tags,ClosedDate,label,length
0,900001,-44,5,"first ""quoted"",
after  has_numeric  end",Alpha,0,0,900101.0,17.0,2021-01-02 03:04:05,<x><y>,2022-06-07 08:09:10,-1,39
1,900002,-45,6, has_attached_tag  then has_codeblock,"Beta, two",2,1,,,2021-02-03 04:05:06,<z>,,-1,37
2,900003,77,7,text,Gamma,3,3,900103.0,18.0,2021-03-04 05:06:07,<w>,,1,4
"""


def test_export_with_index_and_floats(spark):
    path = new_path(spark, "export")
    spark.createDataFrame([(EXPORT.rstrip(),)], "value string").coalesce(1).write.text(path)
    rows = csv_files.read_labelled_csv(spark, path).orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == [0, 1, 2]
    assert all(r.length == len(r.Body) for r in rows)
    assert rows[0].Body == 'first "quoted",\nafter  has_numeric  end'
    assert rows[0].AcceptedAnswerId == 900101 and rows[1].AcceptedAnswerId is None
    assert str(rows[0].ClosedDate) == "2022-06-07 08:09:10" and rows[2].ClosedDate is None
    df = csv_files.read_labelled_csv(spark, path)
    counts = metrics.marker_counts(df, {"numeric": C.NUMERIC, "tag": C.ATTACHED_TAG, "code": C.CODEBLOCK})
    assert {tuple(r) for r in counts.collect()} == {(-1, 2, 1, 1, 0), (1, 1, 0, 0, 0)}


def test_tag_named_nan_stays_a_tag(spark):
    path = new_path(spark, "tags")
    lines = ",TagName\n0,lyx\n1,nan\n2,c"
    spark.createDataFrame([(lines,)], "value string").coalesce(1).write.text(path)
    tags = tables.load_tags(csv_files.read_tags_csv(spark, path))
    assert [r.TagName for r in tags.collect()] == ["c", "lyx", "nan"]


def test_marker_at_the_edge_is_missed_unless_padded(spark):
    df = spark.createDataFrame([(1, "has_codeblock at start")], "Id long, Body string")
    assert df.where(datasets.has_any_marker([C.CODEBLOCK])).count() == 0
    assert df.where(datasets.has_any_marker([C.CODEBLOCK], padded=True)).count() == 1


def test_csv_round_trip(spark):
    row = (1, 60, None, '  has_x "q"\nz ', "T, with comma", 1, None, None, 5, None, "<a>", None, 1, 15)
    df = spark.createDataFrame([row, (2, 60, 1, "", None, *row[5:])], LABELLED_QUESTION)
    path = new_path(spark, "csv")
    csv_files.write_csv(df, path)
    back = csv_files.read_csv(spark, path, LABELLED_QUESTION).orderBy("Id").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in df.orderBy("Id").collect()]


def test_libsvm_zero_based(spark):
    path = new_path(spark, "foreign")
    spark.createDataFrame([("# made elsewhere",), ("1 0:2 3:1",), ("-1 1:4",)], "value string").coalesce(
        1
    ).write.text(path)
    rows = libsvm.read_libsvm(spark, path, 4, zero_based=True).collect()
    assert {(r.label, tuple(r.features.toArray())) for r in rows} == {
        (1.0, (2.0, 0.0, 0.0, 1.0)),
        (-1.0, (0.0, 4.0, 0.0, 0.0)),
    }


def test_cached_dataset_builds_once(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert cached.cached_dataset(spark, "t", {"n": 3, "calls": id(calls)}, build).count() == 3
    assert len(calls) == 1


def test_cached_dataset_follows_its_input(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(3).write.parquet(source)
    calls = []

    def load():
        def build():
            calls.append(1)
            return spark.read.parquet(source)

        return cached.cached_dataset(spark, "follows", {"at": source}, build, [source]).count()

    assert [load(), load()] == [3, 3] and len(calls) == 1
    spark.range(2).write.mode("append").parquet(source)
    assert [load(), load()] == [5, 5] and len(calls) == 2
    with pytest.raises(FileNotFoundError):
        cached.cached_dataset(spark, "follows", {}, lambda: spark.range(1), [source + "x"])


def test_cached_dataset_is_published_once_and_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cached, "work_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(cached, "new_path", lambda _, name: f"{tmp_path}/{name}-{next(numbers)}")
    numbers = itertools.count()

    def load(build):
        return cached.cached_dataset(spark, "once", {"n": 4}, build)

    def failing():
        return spark.range(4).select(F.raise_error(F.lit("lost")).alias("id"))

    with pytest.raises(Exception, match="lost"):
        load(failing)
    assert not (tmp_path / "datasets").exists()

    def overtaken():
        load(lambda: spark.range(4))  # another builder is faster
        return spark.range(4)

    assert load(overtaken).count() == 4
    (place,) = (tmp_path / "datasets").iterdir()
    assert sorted(f.name for f in place.iterdir() if not f.name.startswith(".")) == [cached.MANIFEST, "data"]
    assert '"n": 4' in (place / cached.MANIFEST).read_text()
    with ThreadPoolExecutor(4) as pool:
        builds = [lambda: spark.range(7)] * 4
        counts = list(pool.map(lambda b: cached.cached_dataset(spark, "both", {}, b).count(), builds))
    assert counts == [7] * 4
    assert len(list((tmp_path / "datasets").iterdir())) == 2


def test_thresholds():
    assert questions.vote_thresholds(10, -1) == (10, -1)
    assert questions.vote_thresholds("x", -1) == (50, -5)
    assert questions.vote_thresholds(int, int) == (50, -5)
    assert questions.vote_thresholds() == (50, -5)


@pytest.mark.parametrize("sizes", [(1, 0), (3, 7), (23, 23), (2500, 1700)])
def test_keys_at_ranks(spark, sizes):
    df, rows = labelled(spark, *sizes)
    ranks = [1, 2, 5, 1000, 1700, 10**6]
    found = key_at_ranks(df, "label", "Id", "Id", lambda n: [F.lit(r) for r in ranks])
    got = {(r.label, r["rank"]): r["key"] for r in found.collect()}
    expected = {}
    for label in (-1, 1):
        ids = sorted(i for i, l in rows if l == label)
        expected |= {(label, r): ids[r - 1] for r in ranks if r <= len(ids)}
    assert got == expected


def test_keys_at_ranks_with_equal_positions(spark):
    rows = [(f"k{i:05d}", i // 700) for i in range(2100)]
    df = spark.createDataFrame(rows, "k string, p long").withColumn("g", F.lit(0))
    found = key_at_ranks(df, "g", "k", "p", lambda n: [F.lit(1), F.lit(700), F.lit(701), n])
    assert [r["key"] for r in found.orderBy("slot").collect()] == ["k00000", "k00699", "k00700", "k02099"]


@pytest.mark.parametrize("sizes", [(3, 23), (23, 41), (1501, 777)])
def test_folds(spark, sizes):
    df, rows = labelled(spark, *sizes)
    expected = {}
    for label in (-1, 1):
        ids = sorted(i for i, l in rows if l == label)
        size, extra = divmod(len(ids), 5)
        start = 0
        for fold in range(5):
            end = start + size + (fold < extra)
            expected |= {i: fold for i in ids[start:end]}
            start = end
    for folded in (split.stratified_folds(df), split.with_fixed_folds(df)):
        assert {r.Id: r.fold for r in folded.collect()} == expected


@pytest.mark.parametrize("n", [1, 5, 35, 2003])
def test_holdout(spark, n):
    import hashlib

    df, rows = labelled(spark, n, 0)
    ranked = sorted(i for i, _ in rows)
    ranked.sort(key=lambda i: hashlib.md5(f"{i}:7".encode()).hexdigest())
    expected = set(ranked[: math.ceil(0.2 * n)])
    for done in (split.holdout_split(df, 7), split.with_fixed_split(df, 7)):
        assert {r.Id for r in done.where("is_test").collect()} == expected


def test_limit_and_index(spark):
    df, rows = labelled(spark, 50, 8)
    kept = questions.first_per_class(df, 10).collect()
    for label, size in ((-1, 10), (1, 8)):
        ids = sorted(i for i, l in rows if l == label)[:size]
        assert sorted(r.Id for r in kept if r.label == label) == ids
    indexed = questions.with_row_index(df).orderBy("row_idx").collect()
    assert [(r.row_idx, r.Id) for r in indexed] == [
        (k, i) for k, (i, _) in enumerate(sorted(rows, key=lambda x: (x[1], x[0])))
    ]


def test_report_without_hits(spark):
    df = spark.createDataFrame([(1, -1), (1, -1)], "label int, prediction int")
    report = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert report["1"].recall == 0 and report["-1"].precision == 0 and report["avg / total"].f1 == 0


def test_best_point_prefers_the_first(spark):
    rows = [(2, 0.5), (1, 0.5), (0, 0.4)]
    df = spark.createDataFrame(rows, "point int, mean_score double")
    assert metrics.best_point(df).first().point == 1


def test_score_band_pruning(spark):
    posts = spark.createDataFrame(
        [(i, s) for i, s in enumerate([-9, -3, 0, 20, 70])], "Id long, Score int"
    )
    for f in LABELLED_QUESTION.fields[2:12]:
        posts = posts.withColumn(f.name, F.lit(None).cast(f.dataType))
    path = new_path(spark, "bands")
    tables.write_posts_by_band(posts, path)
    df = tables.read_posts_by_band(spark, path)
    assert sorted(r.Score for r in df.collect()) == [-9, 70]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "score_band" in plan


def test_text_filters_do_not_repeat_the_cleaning(spark, sf):
    from askgrade.plans import adapters

    raw = questions.labelled_questions(adapters.posts(spark, sf))
    kept = datasets.stripped(raw).where(datasets.has_any_marker([C.NUMERIC]))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse(") == 1


def test_external_tags_reuse_one_shuffle_of_the_text(spark, sf):
    from askgrade.functions.markers import mark_external_tags
    from askgrade.plans import adapters

    raw = questions.labelled_questions(adapters.posts(spark, sf))
    done = mark_external_tags(datasets.stripped(raw), adapters.site_tags(spark, sf))
    done.collect()
    assert "ReusedExchange" in done._jdf.queryExecution().executedPlan().toString()


def test_discard_deletes_its_own_table_only(spark, tmp_path):
    kept, gone = materialise(spark.range(5), "kept"), materialise(spark.range(3), "gone")
    elsewhere = str(tmp_path / "elsewhere")
    spark.range(4).write.parquet(elsewhere)
    path = os.path.dirname(gone.inputFiles()[0]).removeprefix("file:")
    discard(gone)
    discard(spark.read.parquet(elsewhere))  # not below the shared folder
    assert not os.path.exists(path)
    assert kept.count() == 5 and spark.read.parquet(elsewhere).count() == 4


def test_a_large_file_is_spread_over_more_tasks_than_cores(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "one.parquet")
    spark.range(5000).selectExpr("id", "sha2(cast(id as string), 256) as text").coalesce(1).write.parquet(path)
    table = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    assert tables.spread(table).rdd.getNumPartitions() == cores
    monkeypatch.setattr(tables, "PART_BYTES", 4096)
    assert tables.spread(table).rdd.getNumPartitions() > 4 * cores
    assert tables.spread(table).count() == 5000
