"""Registered queries: one per operator, each over whole tables of a data folder.

Every function takes ``(spark, sf_dir)`` and returns a DataFrame.  Doubles are rounded
to six places so that results can be compared across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrade import constants as C
from askgrade.functions import html, markers
from askgrade.functions.stem import stem_text
from askgrade.functions.tokens import word_tokens
from askgrade.operators import datasets, metrics, questions, scoring, search, sentences, split, vectorize
from askgrade.operators.clean import clean, prepare_for_scoring, stemmed
from askgrade.operators.vectorize import FeatureSpec
from askgrade.plans import adapters, compare
from askgrade.session import materialise, new_path, ship_package
from askgrade.sources import cached, csv_files, libsvm, registry, tables
from askgrade.streaming import score_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MARKERS = {
    "codeblock": C.CODEBLOCK,
    "links": C.LINKS,
    "hexadecimal": C.HEXADECIMAL,
    "numeric": C.NUMERIC,
    "attached_tag": C.ATTACHED_TAG,
    "homework": C.HOMEWORK,
    "assignment": C.ASSIGNMENT,
}
ENGLISH_SPEC = FeatureSpec(min_df=0.01, max_df=0.95)


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return function


def posts(spark, d):
    return adapters.posts(spark, d)


def raw(spark, d):
    return questions.labelled_questions(posts(spark, d))


def stripped(spark, d):
    return datasets.stripped(raw(spark, d))


def marked(spark, d):
    """The training form: external tags and assignment excluded."""
    return datasets.marked(raw(spark, d), exclude_site_tags=True, exclude_assignment=True)


def _six(*names):
    return [F.round(n, 6).alias(n) for n in names]


def _body(df):
    return df.select("Id", "Body")


# --- sources and sinks ---------------------------------------------------------


@query
def s1_read_bad_questions(spark, d):
    return questions.read_class(posts(spark, d), C.BAD)


@query
def s1_read_by_score_band(spark, d):
    path = new_path(spark, "posts")
    tables.write_posts_by_band(posts(spark, d), path)
    return questions.labelled_questions(tables.read_posts_by_band(spark, path)).select(
        "Id", "Score", "label", "length"
    )


@query
def s2_load_tags(spark, d):
    return tables.load_tags(adapters.site_tags(spark, d))


@query
def s2_tags_csv(spark, d):
    path = new_path(spark, "tags")
    index = F.monotonically_increasing_id().alias("row_idx")
    named = adapters.site_tags(spark, d).select(index, "TagName")
    csv_files.write_csv(named, path)
    return tables.load_tags(csv_files.read_tags_csv(spark, path))


@query
def s3_table_preview(spark, d):
    return tables.preview(adapters.table(spark, d, "part"), 1000, "p_partkey")


@query
def s4_s5_csv_round_trip(spark, d):
    numeric = datasets.single_marker(raw(spark, d), "numeric")
    path = new_path(spark, "csv")
    csv_files.write_csv(numeric, path)
    back = csv_files.read_csv(spark, path, numeric.schema)
    return back.select("Id", "Score", "Body", "Title", "Tags", "label", "length")


@query
def s6_load_variant_stripped(spark, d):
    return _body(tables.load_questions(posts(spark, d), "stripped"))


@query
def s7_libsvm_round_trip(spark, d):
    data = materialise(stripped(spark, d).select("Id", "label", "Body"), "libsvm-input")
    spec = FeatureSpec(min_df=0.01, max_df=1.0, weighted=False)
    weights = vectorize.fit_vocabularies(data, spec)[None]
    counted = vectorize.feature_model(weights, spec).transform(data)
    path = new_path(spark, "libsvm")
    libsvm.write_libsvm(counted, path)
    back = libsvm.read_libsvm(spark, path, len(weights))
    values = F.unwrap_udt("features")["values"]
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return back.groupBy(F.col("label").cast("int").alias("label")).agg(
        F.count("*").alias("questions"),
        F.sum(F.size(values)).alias("entries"),
        F.sum(total).cast("long").alias("occurrences"),
    )


@query
def s8_saved_feature_model(spark, d):
    data = materialise(stripped(spark, d).select("Id", "Body"), "s8-input")
    weights = vectorize.fit_vocabularies(data, ENGLISH_SPEC)[None]
    root = new_path(spark, "models")
    registry.save_model(vectorize.feature_model(weights, ENGLISH_SPEC), root, "tfidf", {}, 0.0)
    model = registry.load_model(spark, root, "tfidf")
    long = vectorize.vectors_as_long(model.transform(data), [t for t, _ in weights])
    return long.select("Id", "term", *_six("value"))


@query
def s9_cached_dataset(spark, d):
    arguments = {"variant": "stripped", "data": d, "good": C.GOOD_ABOVE, "bad": C.BAD_BELOW}

    def load():
        inputs = [f"{d}/documents.parquet"]
        return cached.cached_dataset(spark, "s9", arguments, lambda: stripped(spark, d), inputs)

    load()
    return _body(load())


# --- projections, predicates, limits, unions, sorts ------------------------------


@query
def p1_projection(spark, d):
    return posts(spark, d).select(*C.QUESTION_COLUMNS)


@query
def p2_p3_label_and_length(spark, d):
    return raw(spark, d).select("Id", "label", "length")


@query
def p4_lowercase(spark, d):
    return raw(spark, d).select("Id", F.lower("Body").alias("Body"))


@query
def f1_score_classes(spark, d):
    labelled = posts(spark, d).withColumn("label", questions.class_label())
    return labelled.where("label is not null").select("Id", "Score", "label")


@query
def f2_thresholds(spark, d):
    above, below = questions.vote_thresholds("100", -20)
    default_above, default_below = questions.vote_thresholds("many", None)
    own = questions.labelled_questions(posts(spark, d), None, above, below)
    default = questions.labelled_questions(posts(spark, d), None, default_above, default_below)
    return metrics.class_sizes(own).withColumn("thresholds", F.lit("own")).unionByName(
        metrics.class_sizes(default).withColumn("thresholds", F.lit("default"))
    )


@query
def f3_drop_uncleanable(spark, d):
    """Bodies of unlabelled documents are taken away; the cleaner drops those rows."""
    known = adapters.table(spark, d, "labels").select(F.col("doc_id").alias("Id"), "quality")
    partly = posts(spark, d).join(known, "Id", "left")
    partly = partly.withColumn("Body", F.when(F.col("quality").isNotNull(), F.col("Body")))
    return _body(clean(partly, markers=False))


@query
def f4_questions_with_numeric(spark, d):
    return marked(spark, d).where(datasets.has_any_marker([C.NUMERIC])).select("Id", "label")


@query
def f4_questions_with_codeblock_padded(spark, d):
    kept = marked(spark, d).where(datasets.has_any_marker([C.CODEBLOCK], padded=True))
    return kept.select("Id", "label")


@query
def f5_questions_with_homework_or_assignment(spark, d):
    both = datasets.single_marker(raw(spark, d), "homework")
    return both.where(datasets.has_any_marker([C.HOMEWORK, C.ASSIGNMENT])).select("Id", "label")


@query
def f6_questions_with_any_marker(spark, d):
    kept = marked(spark, d).where(datasets.has_any_marker(datasets.EXTRACTION_SETS["all"]))
    return kept.select("Id", "label")


@query
def l1_first_per_class(spark, d):
    return questions.labelled_questions(posts(spark, d), limit=100).select("Id", "label", "Score")


@query
def u1_append_classes(spark, d):
    source = posts(spark, d)
    both = questions.read_class(source, C.BAD).unionByName(questions.read_class(source, C.GOOD))
    return both.select("Id", "Score", "Body", "label")


@query
def u2_row_index(spark, d):
    return questions.with_row_index(raw(spark, d).select("Id", "label"))


@query
def o1_tags_alphabetical(spark, d):
    own = F.sort_array(markers.tag_array(F.col("Tags")))
    return posts(spark, d).select("Id", F.array_join(own, " ").alias("tags"))


@query
def o2_tags_longest_first(spark, d):
    own = markers.longest_first(markers.tag_array(F.col("Tags")))
    return posts(spark, d).select("Id", F.array_join(own, " ").alias("tags"))


# --- joins ---------------------------------------------------------------------


@query
def j1_stripped_half_of_pair(spark, d):
    source = raw(spark, d)
    _, plain = datasets.extraction_pair(
        source, datasets.single_marker(source, "numeric"), [C.NUMERIC]
    )
    return _body(plain)


@query
def j2_own_tags(spark, d):
    own = markers.tag_array(F.col("Tags"))
    return posts(spark, d).select("Id", F.posexplode(own).alias("position", "tag"))


@query
def j3_site_tags_in_text(spark, d):
    found = markers.site_tags_in_text(stripped(spark, d), adapters.site_tags(spark, d))
    return found.select("Id", F.array_join("found", " ").alias("found"))


@query
def j4_effect_against_baseline(spark, d):
    base = adapters.predictions(spark, d)
    variants = {
        "baseline": base,
        "always_good": base.withColumn("prediction", F.lit(1)),
        "reversed": base.withColumn("prediction", -F.col("prediction")),
    }
    effect = metrics.compare_with_baseline(metrics.metric_rows(variants), "baseline")
    return effect.select("variant", "metric", *_six("value", "baseline_value", "delta"))


# --- text ------------------------------------------------------------------------


@query
def t1_unescape(spark, d):
    return adapters.html_pages(spark, d).select("Id", html.unescape(F.col("Body")).alias("Body"))


@query
def t2_code_marker(spark, d):
    return raw(spark, d).select("Id", html.replace_code(F.col("Body")).alias("Body"))


@query
def t3_link_marker(spark, d):
    return raw(spark, d).select("Id", html.replace_links(F.col("Body")).alias("Body"))


@query
def t2_t3_markers_exact(spark, d):
    return _body(html.clean_html(raw(spark, d), "Body", ("code", "a")))


@query
def t4_strip_pages(spark, d):
    return html.clean_html(adapters.html_pages(spark, d))


@query
def t4_strip_pages_keeping_links_marked(spark, d):
    return html.clean_html(adapters.html_pages(spark, d), "Body", ("a",))


@query
def t4_strip_losing_tails(spark, d):
    """Two of three pages get a tail that ends inside a tag or an entity."""
    kind = F.col("Id") % 3
    tail = F.when(kind == 0, " if a <b then lost").when(kind == 1, " tail AT&T").otherwise("")
    pages = adapters.html_pages(spark, d).withColumn("Body", F.concat("Body", tail))
    return html.clean_html(pages, compat=True)


@query
def t5_collapse_whitespace(spark, d):
    text = adapters.texts(spark, d, "documents")
    return text.select("doc_id", html.collapse_whitespace(F.col("text")).alias("text"))


@query
def t6_hexadecimal_marker(spark, d):
    return raw(spark, d).select("Id", markers.mark_hexadecimal(F.col("Body")).alias("Body"))


@query
def t7_numeric_marker(spark, d):
    return raw(spark, d).select("Id", markers.mark_numeric(F.col("Body")).alias("Body"))


@query
def t8_word_tokens(spark, d):
    words = F.array_sort(word_tokens(F.col("Body")))
    return stripped(spark, d).select(
        "Id", F.size(words).alias("tokens"), F.md5(F.array_join(words, " ")).alias("digest")
    )


@query
def t8_abbreviations(spark, d):
    """The abbreviations that all documents teach."""
    found = sentences.abbreviations(adapters.texts(spark, d, "documents"), "text")
    return found.select("word", "with_stop", "without", *_six("score"))


@query
def t8_sentence_tokens(spark, d):
    """Word tokens cut sentence by sentence, with the abbreviations of the same texts."""
    texts = materialise(stripped(spark, d).select("Id", "Body"), "t8-input")
    words = F.array_sort(F.col("tokens"))
    return sentences.with_sentence_tokens(texts, sentences.abbreviations(texts)).select(
        "Id", F.size(words).alias("tokens"), F.md5(F.array_join(words, " ")).alias("digest")
    )


@query
def t9_tag_array(spark, d):
    own = markers.tag_array(F.col("Tags"))
    return posts(spark, d).select("Id", F.size(own).alias("n"), F.array_join(own, ",").alias("tags"))


@query
def t10_replace_words(spark, d):
    own = F.array_intersect(markers.tag_array(F.col("Tags")), word_tokens(F.col("Body")))
    replaced = markers.replace_words(F.col("Body"), own, " M ")
    return stripped(spark, d).select("Id", replaced.alias("Body"))


@query
def t10_replace_whole_words(spark, d):
    own = markers.tag_array(F.col("Tags"))
    replaced = markers.replace_words(F.col("Body"), own, " M ", match="token")
    return stripped(spark, d).select("Id", F.md5(replaced).alias("digest"), F.length(replaced).alias("n"))


@query
def t11_attached_tag_marker(spark, d):
    return _body(markers.mark_attached_tags(stripped(spark, d)))


@query
def t11_external_tag_marker(spark, d):
    marked_ = markers.mark_external_tags(stripped(spark, d), adapters.site_tags(spark, d))
    return marked_.select("Id", F.length("Body").alias("n"), F.md5("Body").alias("digest"))


@query
def t12_homework_marker(spark, d):
    return _body(markers.mark_homework(stripped(spark, d)))


@query
def t13_assignment_marker(spark, d):
    return _body(markers.mark_assignment(stripped(spark, d)))


@query
def t14_version_marker(spark, d):
    text = F.concat(F.lit("version "), F.col("doc_id").cast("string"), F.lit(": "), F.col("text"))
    documents = adapters.texts(spark, d, "documents")
    return documents.select(
        "doc_id",
        markers.mark_version_number(text, enabled=True).alias("on"),
        (markers.mark_version_number(text) == text).alias("off_is_identity"),
    )


@query
def t15_stemmed_text(spark, d):
    return adapters.texts(spark, d, "documents").select("doc_id", stem_text("text").alias("text"))


@query
def t16_clean_all_markers(spark, d):
    lowered = raw(spark, d).withColumn("Body", F.lower("Body"))
    done = clean(lowered, site_tags=adapters.site_tags(spark, d))
    return done.select("Id", F.length("Body").alias("n"), F.md5("Body").alias("digest"))


@query
def t17_prepare_for_scoring(spark, d):
    return prepare_for_scoring(stripped(spark, d).select("Id", "Body"))


# --- data sets ---------------------------------------------------------------------


@query
def d1_raw_set(spark, d):
    return raw(spark, d)


@query
def d2_stripped_set(spark, d):
    return stripped(spark, d).select("Id", "Body", "label", "length")


@query
def d3_marked_set(spark, d):
    return marked(spark, d).select("Id", "Body", "label", "length")


def _single(marker):
    def run(spark, d):
        return datasets.single_marker(raw(spark, d), marker).select("Id", "Body", "label", "length")

    return run


for _name, _marker in {
    "d4a_codeblock_set": "codeblock",
    "d4b_links_set": "links",
    "d4c_homework_set": "homework",
    "d4d_numeric_set": "numeric",
    "d4e_hexadecimal_set": "hexadecimal",
}.items():
    _run = _single(_marker)
    _run.__name__ = _name
    query(_run)


@query
def d4f_tags_set(spark, d):
    tagged = datasets.single_marker(raw(spark, d), "tags", adapters.site_tags(spark, d))
    return tagged.select("Id", F.length("Body").alias("n"), F.md5("Body").alias("digest"))


@query
def d4_all_single_marker_sets(spark, d):
    """All six sets as one table, with own and other tags."""
    sets = datasets.all_single_markers(raw(spark, d), adapters.site_tags(spark, d))
    return sets.groupBy("marker", "label").agg(
        F.count("*").alias("questions"), F.sum(F.length("Body")).alias("characters")
    )


def _pairs(spark, d, names):
    source = raw(spark, d)
    base = materialise(datasets.stripped(source), "stripped") if len(names) > 1 else None
    parts = None
    for name in names:
        if name == "all":
            with_marker = datasets.marked(source, exclude_site_tags=True, exclude_assignment=True)
        else:
            site = adapters.site_tags(spark, d) if name == "tags" else None
            with_marker = datasets.single_marker(source, name, site, base=base)
        halves = datasets.extraction_pair(source, with_marker, datasets.EXTRACTION_SETS[name], base=base)
        for half, data in zip(("marked", "stripped"), halves):
            part = data.select(F.lit(name).alias("set"), F.lit(half).alias("half"), "Id", "Body")
            parts = part if parts is None else parts.unionByName(part)
    return parts


@query
def d5a_extraction_pairs_one_marker(spark, d):
    return _pairs(spark, d, ["hexadecimal", "numeric", "links", "codeblock"])


@query
def d5b_extraction_pairs_either_marker(spark, d):
    return _pairs(spark, d, ["tags", "homework"])


@query
def d5c_extraction_pair_any_marker(spark, d):
    return _pairs(spark, d, ["all"])


@query
def d6_stemmed_set(spark, d):
    return _body(stemmed(marked(spark, d)))


# --- vectorisation -------------------------------------------------------------------


@query
def v1_terms(spark, d):
    words = vectorize.terms(F.col("Body"))
    return stripped(spark, d).select(
        "Id", F.size(words).alias("terms"), F.md5(F.array_join(words, " ")).alias("digest")
    )


@query
def v2_terms_without_stop_words(spark, d):
    words = vectorize.terms(F.col("Body"), vectorize.english_stop_words())
    return stripped(spark, d).select(
        "Id", F.size(words).alias("terms"), F.md5(F.array_join(words, " ")).alias("digest")
    )


@query
def v3_term_counts(spark, d):
    return vectorize.term_counts(stripped(spark, d))


@query
def v4_vocabulary(spark, d):
    return vectorize.vocabulary(stripped(spark, d), min_df=0.01, max_df=0.95)


@query
def v5_smooth_idf(spark, d):
    kept = vectorize.vocabulary(stripped(spark, d), min_df=1, max_df=1.0)
    return kept.select("term", vectorize.smooth_idf(F.col("n"), F.col("df")).alias("idf")).select(
        "term", *_six("idf")
    )


def _tfidf(spark, d, spec):
    data = materialise(stripped(spark, d).select("Id", "Body"), "tfidf-input")  # read twice
    return vectorize.tfidf_long(data, spec).select("Id", "term", *_six("value"))


@query
def v6_tfidf_l2(spark, d):
    return _tfidf(spark, d, ENGLISH_SPEC)


@query
def v6_tfidf_l1_without_idf(spark, d):
    return _tfidf(spark, d, FeatureSpec(0.025, 0.75, False, "l1"))


@query
def v6_tfidf_vectors(spark, d):
    data = materialise(stripped(spark, d).select("Id", "Body"), "v6-input")
    spec = FeatureSpec(0.01, 0.95, stop_words=vectorize.english_stop_words())
    weights = vectorize.fit_vocabularies(data, spec)[None]
    vectors = vectorize.feature_model(weights, spec).transform(data)
    long = vectorize.vectors_as_long(vectors, [t for t, _ in weights])
    return long.select("Id", "term", *_six("value"))


@query
def v7_tfidf_twice(spark, d):
    return _tfidf(spark, d, FeatureSpec(0.01, 1.0, twice=True))


@query
def v8_bigrams(spark, d):
    runs = vectorize.ngrams(vectorize.terms(F.col("Body")), 1, 2)
    exploded = stripped(spark, d).select(F.explode(runs).alias("ngram"))
    return exploded.groupBy("ngram").agg(F.count("*").alias("occurrences"))


# --- splitting, training, scoring ------------------------------------------------------


@query
def m0_binary_labels(spark, d):
    coded = raw(spark, d).select("Id", "label", split.to_binary(F.col("label")).alias("y"))
    return coded.withColumn("back", split.from_binary(F.col("y")))


@query
def m1_holdout_split(spark, d):
    return split.holdout_split(raw(spark, d).select("Id", "label"), seed=0)


@query
def m2_stratified_folds(spark, d):
    return split.stratified_folds(raw(spark, d).select("Id", "label"))


# --- fixed values: question texts of known class, used as scoring examples
EXAMPLES = [
    (927358, 1, "I committed the wrong files to Git. How can I undo this commit?"),
    (
        27391628,
        -1,
        "You like C++ a lot. Now you have a compiled binary file of a library, a header that "
        "provides the link and a manual containing instructions on how to use the library. How can "
        "you access the private data member of the class? Note this is only specific to C++. "
        "Normally there's no way you can access a private data member other than making friends or "
        "writing a getter function, both of which require changing the interface of the said class. "
        "C++ is a bit different in that you can think of it as a wrapper of C. This is not a problem "
        "from a textbook or class assignment.",
    ),
]


def _quality(spark, d):
    """Labelled documents as training data: a class that the text does decide."""
    truth = adapters.predictions(spark, d).select("Id", "label")
    text = adapters.texts(spark, d, "documents").select(F.col("doc_id").alias("Id"), "text")
    return text.join(truth, "Id").select("Id", "label", F.lower("text").alias("Body"))


def _summary(result: search.SearchResult) -> DataFrame:
    named = result.scores.select("point", "params").distinct()
    return result.summary().join(named, "point").select("point", "params", "mean_score", "std_score")


@query
def m3a_svc_grid_search(spark, d):
    """All 20 points on 5 folds."""
    data = search.training_table(_quality(spark, d))
    return _summary(search.search_svc(data))


@query
def m3b_sgd_grid_search(spark, d):
    """All 2,400 points on 5 folds."""
    data = search.training_table(_quality(spark, d))
    return _summary(search.search_linear(data, search.sgd_points()))


@query
def m7_linear_svc_grid_search(spark, d):
    """Every pair of bounds, strength, iteration number and loss with idf and l2 norm, on 5 folds: 1,120 of
    the 4,480 points."""
    data = search.training_table(_quality(spark, d))
    points = [p for p in search.linear_svc_points() if (p["use_idf"], p["norm"]) == (True, "l2")]
    return _summary(search.search_linear(data, points))


@query
def m8_all_losses_and_penalties(spark, d):
    """All 9,600 points of five losses on 5 folds."""
    data = search.training_table(_quality(spark, d))
    return _summary(search.search_linear(data, search.sgd_points(comparison=True)))


@query
def m8_logistic_regression(spark, d):
    data = search.training_table(_quality(spark, d))
    model = search.logistic_model(data, ENGLISH_SPEC, 1e-5, "elasticnet")
    return metrics.confusion_matrix(search.predict(model, data))


def _trained(spark, d, data=None, **options) -> search.Trained:
    """All 20 points on 5 folds, 100 iterations."""
    data = _quality(spark, d) if data is None else data
    return search.train(data, "svc", ENGLISH_SPEC, **options)


@query
def m9_m13_score_questions(spark, d):
    model = _trained(spark, d).search.model
    asked = _asked(spark, d)
    examples = spark.createDataFrame([(i, b) for i, _, b in EXAMPLES], "Id long, Body string")
    return scoring.score_questions(model, asked.unionByName(examples))


def _asked(spark, d):
    """Every text of the conversations as a question."""
    return adapters.texts(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("Id"), F.col("text").alias("Body")
    )


@query
def s8_m13_registered_sgd_model(spark, d):
    """An SGD model with log loss is trained, registered, loaded and scores all conversations."""
    point = {"min_df": 0.01, "max_df": 0.95, "use_idf": True, "norm": "l2", "alpha": 1e-5}
    data = search.training_table(_quality(spark, d))
    points = [point | {"penalty": "l2", "loss": "log", "n_iter": n} for n in C.SGD_N_ITER]
    found = search.search_linear(data, points)
    root = new_path(spark, "models")
    registry.save_model(found.model, root, "sgd", found.best, found.best_score)
    return scoring.score_questions(registry.load_model(spark, root, "sgd"), _asked(spark, d))


@query
def m10_train_and_report(spark, d):
    trained = _trained(spark, d, probability=False)
    report = metrics.classification_report(trained.predictions)
    return report.withColumn("cv_score", F.lit(trained.search.best_score))


@query
def m11_marker_effects(spark, d):
    source = _labelled_posts(spark, d)
    variants = {m: datasets.single_marker(source, m) for m in datasets.SINGLE_MARKERS}
    return compare.marker_effects(datasets.stripped(source), variants, ENGLISH_SPEC)


def _labelled_posts(spark, d):
    truth = adapters.predictions(spark, d).select("Id", "label")
    return posts(spark, d).join(truth, "Id")


@query
def m12_train_on_stemmed_marked_set(spark, d):
    """The marked set, stemmed once."""
    data = stemmed(datasets.marked(_labelled_posts(spark, d), exclude_site_tags=True, exclude_assignment=True))
    trained = _trained(spark, d, data.select("Id", "label", "Body"), probability=False)
    return metrics.confusion_matrix(trained.predictions)


@query
def m14_score_stream(spark, d):
    model = _trained(spark, d).search.model
    folder = new_path(spark, "stream")
    asked = _asked(spark, d)
    asked.write.parquet(f"{folder}/in")
    stream = score_stream.question_stream(spark, f"{folder}/in")
    run = score_stream.start_scoring(model, stream, f"{folder}/out", f"{folder}/state")
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query
def m15_algorithm_matrix(spark, d):
    """Four data sets, 5 folds, every vectoriser, one point for each algorithm with its default iterations."""
    raw_set = _quality(spark, d)
    marked_set = datasets.marked(_labelled_posts(spark, d), exclude_site_tags=True, exclude_assignment=True)
    marked_set = marked_set.select("Id", "label", "Body")
    variants = {"raw": raw_set, "stemmed": stemmed(raw_set), "marked": marked_set, "stemmed_marked": stemmed(marked_set)}
    point = {"min_df": 0.05, "max_df": 1.0, "use_idf": True, "norm": "l2"}
    return compare.algorithm_matrix(
        variants,
        vectorize.english_stop_words(),
        [{"kernel": "linear", "C": 1, "gamma": None}],
        [point | {"alpha": 1e-5, "penalty": "l2", "loss": "log", "n_iter": 50}],
        [point | {"C": 1, "loss": "squared_hinge", "n_iter": 100}],
        spark.createDataFrame(EXAMPLES, "Id long, label int, Body string"),
    )


# --- metrics ---------------------------------------------------------------------------


@query
def a1_accuracy(spark, d):
    return metrics.accuracy(adapters.predictions(spark, d)).select(*_six("accuracy"))


@query
def a2_confusion_matrix(spark, d):
    return metrics.confusion_matrix(adapters.predictions(spark, d))


@query
def a3_classification_report(spark, d):
    report = metrics.classification_report(adapters.predictions(spark, d))
    return report.select("class", *_six("precision", "recall", "f1"), "support")


def _fold_scores(spark, d):
    """Two fixed rules scored on the folds of the labelled documents."""
    folds = split.stratified_folds(adapters.predictions(spark, d))
    rules = F.array(
        F.struct(F.lit(0).alias("point"), F.col("prediction").alias("guess")),
        F.struct(F.lit(1).alias("point"), F.lit(1).alias("guess")),
        F.struct(F.lit(2).alias("point"), (-F.col("prediction")).alias("guess")),
    )
    scored = folds.select("label", "fold", F.inline(rules))
    hit = (F.col("label") == F.col("guess")).cast("double")
    return scored.groupBy("point", "fold").agg(F.avg(hit).alias("score"))


@query
def a4_cv_summary(spark, d):
    return metrics.cv_summary(_fold_scores(spark, d)).select("point", *_six("mean_score", "std_score"))


@query
def a5_best_point(spark, d):
    best = metrics.best_point(metrics.cv_summary(_fold_scores(spark, d)))
    return best.select("point", *_six("mean_score"))


@query
def a6_document_frequencies(spark, d):
    return vectorize.document_frequencies(stripped(spark, d))


@query
def a7_marker_counts(spark, d):
    return metrics.marker_counts(marked(spark, d), MARKERS)


@query
def a8_class_sizes(spark, d):
    return metrics.class_sizes(raw(spark, d))


@query
def marker_profile(spark, d):
    """Flagship: per class, questions, questions with a number, mean length."""
    numeric = datasets.single_marker(raw(spark, d), "numeric")
    return numeric.groupBy("label").agg(
        F.count("*").alias("questions"),
        F.count_if(F.contains("Body", F.lit(C.NUMERIC))).alias("with_numeric"),
        F.round(F.avg("length"), 6).alias("mean_length"),
    )
