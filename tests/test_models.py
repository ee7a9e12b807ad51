"""Features, training, scoring: agreement of the two forms and sanity on separable text."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from askgrade.operators import batched, calibrate, linear, metrics, scoring, search, vectorize
from askgrade.operators.vectorize import FeatureSpec
from askgrade.plans import compare
from askgrade.session import new_path
from askgrade.sources import registry
from askgrade.streaming import score_stream

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]


@pytest.fixture(scope="module")
def texts(spark):
    """Class 1 says "good", class -1 says "bad"; everything else is shared."""
    rows = []
    for i in range(120):
        label = 1 if i % 3 else -1
        filler = " ".join(WORDS[(i * k) % len(WORDS)] for k in range(1, 6))
        rows.append((i, label, f"{filler} {'good thing' if label == 1 else 'bad thing'} {i}"))
    df = spark.createDataFrame(rows, "Id long, label int, Body string")
    return df.persist()


SPEC = FeatureSpec(min_df=0.02, max_df=1.0)


@pytest.mark.parametrize(
    "spec",
    [
        SPEC,
        FeatureSpec(0.02, 0.9, norm="l1", use_idf=False),
        FeatureSpec(1, 1.0, twice=True),
        FeatureSpec(0.02, 1.0, stop_words=("good", "alpha")),
        FeatureSpec(0.02, 1.0, weighted=False),
    ],
)
def test_vector_and_long_forms_agree(texts, spec):
    weights = vectorize.fit_vocabularies(texts, spec)[None]
    vocabulary = [t for t, _ in weights]
    assert vocabulary == sorted(vocabulary)
    vectors = vectorize.feature_model(weights, spec).transform(texts)
    a = {(r.Id, r.term): r.value for r in vectorize.vectors_as_long(vectors, vocabulary).collect()}
    b = {(r.Id, r.term): r.value for r in vectorize.tfidf_long(texts, spec).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)


def test_smooth_idf(spark):
    got = spark.range(1).select(vectorize.smooth_idf(F.lit(3), F.lit(1)).alias("x")).first().x
    assert math.isclose(got, 1.693147, abs_tol=1e-6)


def test_fold_vocabularies_equal_separate_fits(texts):
    folded = texts.withColumn("fold", (F.col("Id") % 3).cast("int"))
    together = vectorize.fit_vocabularies(folded, SPEC, folds=3)
    for fold in range(3):
        alone = vectorize.fit_vocabularies(folded.where(F.col("fold") != fold), SPEC)[None]
        assert [t for t, _ in together[fold]] == [t for t, _ in alone]
        assert np.allclose([w for _, w in together[fold]], [w for _, w in alone])


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), ([],), (["x"],)], "w array<string>")
    got = [r.n for r in df.select(vectorize.ngrams(F.col("w"), 1, 2).alias("n")).collect()]
    assert got == [["a", "b", "c", "a b", "b c"], [], ["x"]]


def test_grids():
    assert len(search.svc_points()) == 20
    assert len({search._trained_as(p) for p in search.svc_points()}) == 13
    assert len(search.sgd_points()) == 2400
    assert len(search.sgd_points(comparison=True)) == 9600
    assert len(search.linear_svc_points()) == 4480
    with pytest.raises(ValueError):
        search.effective_c({"kernel": "rbf", "C": 1, "gamma": 1.0})


LOSSES = ["log", "hinge", "squared_hinge", "modified_huber", "perceptron"]
SETTINGS = [SPEC, FeatureSpec(0.1, 0.9, False, "l1"), FeatureSpec(0.02, 1.0, norm=None), FeatureSpec(0.02, 1.0, twice=True)]


def folded(texts, k=3):
    return texts.withColumn("fold", (F.col("Id") % k).cast("int"))


def dense(texts, spec, train):
    """Rows, features and signs of the rows with these ids, features fitted on them."""
    part = texts.where(F.col("Id").isin(train))
    features = vectorize.fit_features(part, spec)
    rows = features.transform(part).select("Id", "label", "features").orderBy("Id").collect()
    return np.array([r.features.toArray() for r in rows]), np.array([float(r.label) for r in rows]), features


@pytest.mark.parametrize("one_block", [8192, 16])
def test_batched_gradient_equals_numpy(spark, texts, one_block):
    """For every loss and setting, on all rows and without one fold, in one block and in several."""
    counts = batched.count_table({"x": folded(texts)}, SETTINGS, 3, one_block)
    assert (counts.n_blocks["x"] > 1) == (one_block == 16)
    problems = [batched.Problem("x", held, s, loss, "l2", 0.01) for held in (None, 1) for s in SETTINGS for loss in LOSSES]
    own = batched.slabs(counts, problems, 200)
    assert len(own) >= 3
    rng = np.random.default_rng(0)
    weights = [rng.normal(size=s.zeros().shape) for s in own]
    found = batched._pass(batched.Units(counts, own), weights, batched._gradient)
    cache = {}
    for i, slab in enumerate(own):
        gradient = found[i].reshape(weights[i].shape)
        for j, p in enumerate(slab.problems):
            if (p.held, p.spec) not in cache:
                cache[p.held, p.spec] = dense(texts, p.spec, [n for n in range(120) if p.held is None or n % 3 != p.held])
            x, sign, _ = cache[p.held, p.spec]
            kept = np.isin(slab.terms, np.flatnonzero(counts.weights("x", p.held, p.spec)))
            w, b = weights[i][:-1][kept, j], weights[i][-1, j]
            pull = linear._slope(p.loss, sign * (x @ w + b)) * sign
            assert np.allclose(gradient[:-1][kept, j], x.T @ pull) and np.allclose(gradient[-1, j], pull.sum())
            assert np.all(gradient[:-1][~kept, j] == 0)


def test_sums_by_spark_equal_sums_by_the_driver(spark, texts, monkeypatch):
    counts = batched.count_table({"x": folded(texts)}, [SPEC], 3, 16)
    problems = [batched.Problem("x", None, SPEC, loss, "elasticnet", 0.01) for loss in LOSSES]
    one = dict(batched.train_gradient(counts, problems, [2, 7]))
    monkeypatch.setattr(batched, "DRIVER_CELLS", 0)
    monkeypatch.setattr(batched, "_SLABS_AT_ONCE", 1)
    two = dict(batched.train_gradient(counts, problems, [2, 7]))
    monkeypatch.undo()
    whole = batched.count_table({"x": folded(texts)}, [SPEC], 3)
    three = dict(batched.train_gradient(whole, problems, [2, 7]))
    for t in (2, 7):
        for p in problems:
            assert np.allclose(one[t][p].values, two[t][p].values, atol=1e-9)
            assert np.allclose(one[t][p].values, three[t][p].values, atol=1e-9)


def objective(loss, c, x, sign, w):
    short = np.maximum(0.0, 1.0 - sign * (x @ w[:-1] + w[-1]))
    return np.mean(short if loss == "hinge" else short**2) + (w @ w) / (2 * c * len(x))


def plain_solver(loss, c, x, sign, epochs=800):
    """Dual coordinate ascent, a row at a time in random order."""
    rng = np.random.default_rng(3)
    x = np.column_stack([x, np.ones(len(x))])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    lift, top = (0.0, 1.0) if loss == "hinge" else (0.5, np.inf)
    for _ in range(epochs):
        for i in rng.permutation(len(x)).tolist():
            new = min(max(alpha[i] + (1 - sign[i] * (x[i] @ w) - lift * alpha[i]) / (x[i] @ x[i] * c + lift), 0.0), top)
            w += (new - alpha[i]) * sign[i] * x[i] * c
            alpha[i] = new
    return w


@pytest.mark.parametrize("one_block, strengths, epochs", [(8192, (0.01, 1.0, 10.0), 3000), (45, (0.01, 1.0), 600)])
def test_dual_closes_the_gap_and_equals_a_plain_solver(spark, texts, one_block, strengths, epochs):
    noisy = texts.withColumn("label", F.when(F.col("Id") % 10 == 0, -F.col("label")).otherwise(F.col("label")))
    counts = batched.count_table({"x": folded(noisy)}, [SPEC], 3, one_block)
    problems = [batched.Problem("x", None, SPEC, loss, c=c) for loss in ("hinge", "squared_hinge") for c in strengths]
    (_, weights), = batched.train_dual(counts, problems, [epochs], 1e-3)
    x, sign, _ = dense(noisy, SPEC, list(range(120)))
    for p in problems:
        kept = np.flatnonzero(counts.weights("x", None, SPEC))
        got = objective(p.loss, p.c, x, sign, weights[p].of(kept, len(counts.vocabulary["x"])))
        best = objective(p.loss, p.c, x, sign, plain_solver(p.loss, p.c, x, sign))
        assert best - 1e-3 <= got <= best + max(1e-3, 0.01 * best)
    with pytest.raises(ValueError):
        next(batched.train_dual(counts, [batched.Problem("x", None, SPEC, "log", c=1.0)], [5]))


def test_search_trains_folds_and_whole_sets_in_one_run(texts, monkeypatch):
    runs, trained = [], search.trained_svc
    monkeypatch.setattr(search, "trained_svc", lambda c, problems, n: runs.append(problems) or trained(c, problems, n))
    points = [p for p in search.svc_points() if p["kernel"] == "linear" and p["C"] < 100]
    found = search.search_svc(texts, SPEC, points, k=3)
    assert len(runs) == 1 and {p.held for p in runs[0]} == {None, 0, 1, 2}
    counts = batched.count_table({search.ALL: folded(texts)}, [SPEC], 3)
    alone = search.svc_problem(found.best, SPEC, None)
    weights = trained(counts, [alone], search.SVC_EPOCHS)[alone]
    assert np.allclose(search.as_model(counts, alone, weights).weights, found.model.weights, atol=0.05)


def one_block(counts, problems):
    slab, = batched.slabs(counts, problems)
    return slab, batched.Rows(counts.blocks.toArrow().to_batches()[0], 0, slab)


def test_local_epochs_equal_row_by_row_ascent(texts):
    specs = [SPEC, FeatureSpec(0.1, 0.9, use_idf=False, norm="l1")]
    counts = batched.count_table({"x": folded(texts)}, specs, 3)
    problems = [batched.Problem("x", held, s, loss, c=c) for held in (None, 0) for s in specs
                for loss in ("hinge", "squared_hinge") for c in (0.1, 10.0)]
    slab, rows = one_block(counts, problems)
    start = np.zeros((120, len(problems)))
    x, sign, fold = dense(texts, SPEC, list(range(120)))
    assert len(x) == len(rows.fold)
    got = {}
    for most in (0, len(problems)):  # all together, then one after the other
        batched.ALONE, before = most, batched.ALONE
        try:
            got[most] = batched._local(rows, slab.zeros(), start, np.ones(len(problems), bool), 2, 3, np.random.default_rng(5))
        finally:
            batched.ALONE = before
    wanted, u = np.zeros_like(start), slab.u[rows.present]
    features = [batched.Rows._times(rows, np.diag(u[:, s])) / rows.norm[:, [s]] for s in range(u.shape[1])]
    for j, p in enumerate(slab.problems):
        own, gain = features[slab.which[j]], 2 / (slab.alpha[j] * slab.rows[j])
        w, bias, rng = np.zeros(own.shape[1]), 0.0, np.random.default_rng(5)
        lift, top = (0.5, np.inf) if p.loss == "squared_hinge" else (0.0, 1.0)
        for i in [i for _ in range(3) for i in rng.permutation(120)]:
            if rows.fold[i] != slab.held[j]:
                old = wanted[i, j]
                pace = (own[i] @ own[i] + 1) * gain + lift
                wanted[i, j] = min(max(old + (1 - rows.sign[i] * (own[i] @ w + bias) - lift * old) / pace, 0.0), top)
                w += (wanted[i, j] - old) * rows.sign[i] * gain * own[i]
                bias += (wanted[i, j] - old) * rows.sign[i] * gain
    assert wanted.any(axis=0).all()
    assert all(np.allclose(g, wanted, atol=1e-9) for g in got.values())


def test_few_columns_take_no_dense_matrix(texts, monkeypatch):
    counts = batched.count_table({"x": folded(texts)}, [SPEC], 3)
    slab, rows = one_block(counts, [batched.Problem("x", held, SPEC, "log", strength=1e-4) for held in (None, 0, 1)])
    weights, pull = np.random.default_rng(1).random((2, 200, 3))
    weights = weights[: len(rows.u) + 1]
    wanted = rows.margins(weights), rows.back(pull[:120])
    monkeypatch.setattr(batched, "NARROW", 0)
    assert np.allclose(rows.margins(weights), wanted[0]) and np.allclose(rows.back(pull[:120]), wanted[1])
    monkeypatch.undo()
    monkeypatch.setattr(batched.Rows, "_each", lambda self: 1 / 0)
    batched._gradient(rows, weights)


def test_long_form_is_not_shuffled_by_id_and_term(texts):
    plan = vectorize.tfidf_long(texts, SPEC)._jdf.queryExecution().executedPlan().toString()
    by_both = [line for line in plan.splitlines() if "hashpartitioning(Id" in line and "term" in line]
    assert not by_both and "hashpartitioning(Id" in plan


def test_whole_grids_are_in_the_result(spark, texts):
    for points in (search.sgd_points(), search.linear_svc_points()):
        short = [p | {"n_iter": 1 + p["n_iter"] % 7} for p in points]  # every point, fewer passes
        scores = search.search_linear(texts, short, k=2).scores
        assert scores.select("point").distinct().count() == len(points)
        assert scores.count() == 2 * len(points)


def test_marker_effects_equal_separate_fits(spark, texts):
    variants = {name: texts.withColumn("Body", F.concat("Body", F.lit(f" {name} "), F.when(F.col("Id") % n == 0, "bad thing").otherwise("")))
                for name, n in (("one", 4), ("two", 7))}
    points = [p for p in search.svc_points() if p["kernel"] == "linear" and p["C"] < 100]
    together = compare.marker_effects(texts, variants, SPEC, points, k=2)
    first = search.train(texts, "svc", SPEC, points, k=2, probability=False)
    apart = {"baseline": first.predictions}
    apart |= {n: search.retrain_with(v, first.search.best, SPEC, k=2, probability=False).predictions for n, v in variants.items()}
    wanted = metrics.compare_with_baseline(metrics.metric_rows(apart), "baseline")
    a = {(r.variant, r.metric): r for r in together.collect()}
    b = {(r.variant, r.metric): r for r in wanted.collect()}
    assert a.keys() == b.keys() and all(abs(a[k][c] - b[k][c]) < 1e-6 for k in a for c in ("value", "delta"))


def plain_sigmoid(margin, sign):
    good, bad = int((sign > 0).sum()), int((sign <= 0).sum())
    t = np.where(sign > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 0.0, math.log((bad + 1) / (good + 1))
    for _ in range(200):
        p = 1 / (1 + np.exp(np.clip(a * margin + b, -700, 700)))
        g = np.array([(margin * (t - p)).sum(), (t - p).sum()])
        q = p * (1 - p)
        h = np.array([[(margin**2 * q).sum(), (margin * q).sum()], [(margin * q).sum(), q.sum()]]) + 1e-12 * np.eye(2)
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return a, b


@pytest.mark.parametrize("separable", [False, True])
def test_sigmoid_equals_a_plain_fit(spark, separable):
    rng = np.random.default_rng(1)
    sign = np.where(rng.random(300) < 0.3, -1.0, 1.0)
    margin = sign * rng.uniform(0.5, 2, 300) if separable else sign + rng.normal(size=300)
    scored = spark.createDataFrame(list(zip(sign.tolist(), margin.tolist())), "sign double, margin double")
    got, wanted = calibrate.fit_sigmoid(scored), plain_sigmoid(margin, sign)
    assert np.all(np.isfinite(got)) and np.allclose(got, wanted, rtol=1e-4)
    p = [r[0] for r in spark.createDataFrame([(-900.0,), (0.0,), (900.0,)], "m double").select(calibrate.probability(F.col("m"), *got)).collect()]
    assert 0 <= p[0] < p[1] < p[2] <= 1
    assert calibrate.fit_sigmoid(scored.limit(0)) == (0.0, 0.0)


def test_parallel_calls_have_local_properties_of_their_own(spark):
    def properties(_):
        time.sleep(0.2)
        return spark._jvm.System.identityHashCode(spark.sparkContext._jsc.sc().getLocalProperties())

    assert len(set(search.in_parallel(spark, properties, list(range(6)), 6))) == 6


def test_sgd_search_learns_and_persists(spark, texts):
    base = {"min_df": 0.02, "max_df": 1.0, "use_idf": True, "norm": "l2", "alpha": 1e-5}
    points = [
        base | {"penalty": p, "loss": loss, "n_iter": n}
        for p, loss in (("l2", "log"), ("elasticnet", "squared_hinge"), ("l1", "hinge"))
        for n in (3, 25)
    ]
    done = search.train(texts, "sgd", points=points, k=2)
    assert done.search.best_score > 0.95
    hits = done.predictions.where("label = prediction").count()
    assert hits / done.predictions.count() > 0.95
    path = new_path(spark, "linear")
    done.search.model.save(path)
    again = linear.LinearModel.load(spark, path)
    a = done.search.model.transform(texts).select("Id", F.round("margin", 9)).collect()
    b = again.transform(texts).select("Id", F.round("margin", 9)).collect()
    assert sorted(a) == sorted(b)


def test_svc_search_scoring_registry_and_stream(spark, texts):
    points = [
        {"kernel": "linear", "C": 10, "gamma": None},
        {"kernel": "sigmoid", "C": 1, "gamma": 0.0001},
    ]
    done = search.train(texts, "svc", SPEC, points, k=2, max_iter=20)
    assert done.search.best == points[0] and done.search.best_score > 0.95
    again = search.retrain_with(texts, done.search.best, SPEC, k=2, max_iter=20, probability=False)
    assert again.search.best_score == pytest.approx(done.search.best_score)
    root = new_path(spark, "models")
    registry.save_model(done.search.model, root, "svc", done.search.best, done.search.best_score)
    with pytest.raises(FileNotFoundError, match="svc"):
        registry.load_model(spark, root, "missing")
    model = registry.load_model(spark, root, "svc")
    batch = scoring.score_questions(model, texts)
    rows = batch.collect()
    assert all(r.verdict == ("good" if r.prediction == 1 else "bad") for r in rows)
    assert all(0 <= r.probability_pct <= 100 for r in rows)
    folder = new_path(spark, "stream")
    texts.select("Id", "Body").repartition(3).write.parquet(f"{folder}/in")
    stream = score_stream.question_stream(spark, f"{folder}/in", max_files_per_trigger=1)
    score_stream.start_scoring(model, stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    assert sorted(spark.read.parquet(f"{folder}/out").collect()) == sorted(rows)


def test_sgd_models_are_registered_scored_and_streamed(spark, texts):
    base = {"min_df": 0.02, "max_df": 1.0, "use_idf": True, "norm": "l2", "alpha": 1e-5, "penalty": "l2"}
    root = new_path(spark, "models")
    for loss in ("log", "modified_huber", "hinge"):
        done = search.search_linear(texts, [base | {"loss": loss, "n_iter": 15}], k=2)
        registry.save_model(done.model, root, loss, done.best, done.best_score)
        model = registry.load_model(spark, root, loss)
        rows = scoring.score_questions(model, texts).collect()
        assert len(rows) == texts.count()
        assert all(r.verdict == ("good" if r.prediction == 1 else "bad") for r in rows)
        if loss == "hinge":
            assert all(r.probability_pct is None for r in rows)
        else:
            assert all(49.99 <= r.probability_pct <= 100 for r in rows)
    folder = new_path(spark, "stream")
    texts.select("Id", "Body").repartition(2).write.parquet(f"{folder}/in")
    model = registry.load_model(spark, root, "log")
    stream = score_stream.question_stream(spark, f"{folder}/in")
    score_stream.start_scoring(model, stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    wanted = scoring.score_questions(model, texts).collect()
    assert sorted(spark.read.parquet(f"{folder}/out").collect()) == sorted(wanted)
