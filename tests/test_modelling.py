"""Splits, training, attributions, artifacts and streams."""

from datetime import datetime
from itertools import permutations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from cartlens.functions import ordered
from cartlens.operators import attribution as A
from cartlens.operators import classification as C
from cartlens.operators import splits
from cartlens.operators.splits import hash_sample, stratified_folds, stratified_split
from cartlens.plans import evaluation, scoring, training
from cartlens.plans.report import recommendation_report
from cartlens.schema import FEATURES
from cartlens.session import materialise
from cartlens.sources import artifacts
from cartlens.streaming.scoring import read_part, read_requests, start_scoring, start_split_scoring

FRAME = """row_id bigint, price double, hour int, is_weekend int, total_clicks bigint,
avg_session_time double, purchase_freq double, products_viewed bigint, price_range double,
session_duration double, recency int, frequency bigint, monetary double, main_category string,
rfm_segment int, target int"""


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        price, viewed = float(rng.uniform(1, 100)), int(rng.integers(1, 8))
        category = str(rng.choice(["toys", "home", "books"]))
        odds = 0.15 + 0.1 * viewed * (price < 60) + 0.2 * (category == "toys")
        rows.append(
            (
                i, price, int(rng.integers(0, 24)), int(rng.integers(0, 2)),
                int(rng.integers(0, 50)), float(rng.uniform(0, 500)), float(rng.random()),
                viewed, float(rng.uniform(0, 50)), float(rng.uniform(0, 900)),
                int(rng.integers(1, 30)), int(rng.integers(1, 9)), float(rng.uniform(5, 900)),
                category, int(rng.integers(0, 4)), int(rng.random() < odds),
            )
        )
    return materialise(spark.createDataFrame(rows, FRAME), "test-frame")


@pytest.fixture(scope="module")
def model(frame):
    return training.fit_model(frame, maxIter=5, maxDepth=3)


def counts(df, *by):
    return {tuple(r)[:-1]: r[-1] for r in df.groupBy(*by).count().collect()}


def test_split_sizes_are_exact_per_class(frame):
    split = stratified_split(frame)
    sizes = counts(split, "target", "split")
    for label, n in ((r["target"], r["count"]) for r in frame.groupBy("target").count().collect()):
        test = int(n * 0.2 + 0.5)
        validation = int((n - test) * 0.25 + 0.5)
        assert sizes[label, "test"] == test
        assert sizes[label, "validation"] == validation
        assert sizes[label, "train"] == n - test - validation


def test_split_does_not_depend_on_the_layout(frame):
    one = {r["row_id"]: r["split"] for r in stratified_split(frame.repartition(3)).collect()}
    two = {r["row_id"]: r["split"] for r in stratified_split(frame.repartition(11)).collect()}
    other = {r["row_id"]: r["split"] for r in stratified_split(frame, seed=1).collect()}
    assert one == two and one != other


def test_folds_are_disjoint_complete_and_even(frame):
    folded = stratified_folds(frame, 5)
    assert folded.select("row_id").distinct().count() == 600
    for label in (0, 1):
        sizes = [n for (y, _), n in counts(folded, "target", "fold").items() if y == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_hash_sample_repeats(frame):
    one = {r["row_id"] for r in hash_sample(frame.repartition(5), 50).collect()}
    assert one == {r["row_id"] for r in hash_sample(frame, 50).collect()} and len(one) == 50


def _places(df, seed=42):
    """Rows of (class, order, key) in order, by plain sorting."""
    from cartlens.functions.expressions import stable_hash

    rows = df.select("target", stable_hash("row_id", seed).alias("o"), "row_id").collect()
    return {y: sorted((r["o"], r["row_id"]) for r in rows if r["target"] == y) for y in (0, 1)}


@pytest.mark.parametrize("few, bits", [(100_000, 12), (1, 12), (3, 4), (0, 20)])
def test_cuts_equal_those_of_a_full_sort(frame, monkeypatch, few, bits):
    monkeypatch.setattr(splits, "FEW_ROWS", few)
    monkeypatch.setattr(splits, "PREFIX_BITS", bits)
    # A repeated row, and rows without a class.
    rows = frame.select("row_id", "target")
    rows = rows.unionByName(rows.where("row_id < 40")).unionByName(rows.limit(5).withColumn("target", F.lit(None).cast("int")))
    want = _places(rows)
    ranks = {"first": 0, "middle": 77, "beyond": 10**6}
    got = splits.cut_places(rows, F.col("target"), "row_id", 42, lambda size: {**ranks, "last": size - 1})
    got = {r["_class"]: r for r in got.collect()}
    assert set(got) == {0, 1}
    for label, places in want.items():
        row = got[label]
        assert tuple(row["_first"]) == places[0] and tuple(row["_middle"]) == places[77]
        assert tuple(row["_last"]) == places[-1] and row["_beyond"] is None


def test_folds_equal_ranks_of_a_full_sort(frame):
    folds = {r["row_id"]: r["fold"] for r in stratified_folds(frame, 7).collect()}
    assert folds == {key: i % 7 for places in _places(frame).values() for i, (_, key) in enumerate(places)}


def test_parts_of_nothing_and_of_a_class(frame):
    empty = frame.where("false")
    assert hash_sample(empty, 5).count() == stratified_split(empty).count() == stratified_folds(empty).count() == 0
    assert hash_sample(frame, 0).count() == 0 and hash_sample(frame, 10_000).count() == 600
    one = frame.where("target = 1")
    assert counts(stratified_split(one, 0.0, 0.0), "split") == {("train",): one.count()}
    assert stratified_split(one, 1.0).where("split = 'test'").count() == one.count()


def test_feature_vectors(frame):
    vectors = training.feature_pipeline(frame).transform(frame)
    names = training.feature_names(vectors)
    assert names[:2] == ["price", "hour"] and "main_category_is_toys" in names
    x = np.vstack([r["features"].toArray() for r in vectors.select("features").collect()])
    assert x.shape == (600, 12 + 3 + 4)
    assert np.allclose(x[:, :12].mean(axis=0), 0) and np.allclose(x[:, :12].std(axis=0), 1)
    assert np.allclose(x[:, 12:15].sum(axis=1), 1)


def test_unseen_category_becomes_zeros(frame):
    prepared = training.feature_pipeline(frame)
    unseen = frame.limit(3).withColumn("main_category", F.lit("never seen"))
    vectors = prepared.transform(unseen).select("features").collect()
    assert all(np.allclose(r["features"].toArray()[12:15], 0) for r in vectors)


def test_class_weight_balances(frame):
    weighted = training.with_class_weight(frame)
    sums = dict(weighted.groupBy("target").agg(F.sum("_weight")).collect())
    assert sums[0] == pytest.approx(sums[1])


def test_training_repeats_and_learns(frame, model):
    scores = training.scored_set(model, frame)
    again = training.scored_set(training.fit_model(frame.repartition(3), maxIter=5, maxDepth=3), frame)
    gap = scores.join(again.select("row_id", F.col("probability").alias("q")), "row_id").agg(
        F.max(F.abs(F.col("probability") - F.col("q")))
    )
    assert gap.first()[0] < 1e-9
    assert C.ranking_metrics(C.score_curve(scores)).first()["roc_auc"] > 0.7


def test_early_stopping_keeps_fewer_trees(frame):
    split = stratified_split(frame)
    train = split.where("split = 'train'").drop("split")
    held_out = split.where("split = 'validation'").drop("split")
    full = training.fit_model(train, maxIter=25, maxDepth=4, stepSize=0.8)
    stopped = training.fit_model(train, held_out, 3, maxIter=25, maxDepth=4, stepSize=0.8)
    kept = stopped.stages[-1].getNumTrees
    assert 1 <= kept < 25
    same = [t.toDebugString for t in full.stages[-1].trees[:kept]]
    assert [t.toDebugString.split("\n", 1)[1] for t in stopped.stages[-1].trees] == [
        t.split("\n", 1)[1] for t in same
    ]


def test_rounds_without_gain_end_boosting():
    assert training.rounds_to_keep([5, 4, 3, 3.5, 3.2, 2.0], 2) == 3
    assert training.rounds_to_keep([5, 4, 3, 3.5, 3.2, 2.0], 3) == 6
    assert training.rounds_to_keep([1.0], 1) == 1


def test_search_stops_early_on_the_validation_rows(frame):
    split = stratified_split(frame)
    train = split.where("split = 'train'").drop("split")
    held_out = split.where("split = 'validation'").drop("split")
    best, _ = training.search(
        train, {"maxDepth": [4]}, folds=2, validation=held_out, patience=2, maxIter=15, stepSize=0.9
    )
    assert best.stages[-1].getNumTrees < 15


def test_twenty_thousand_categories_give_a_bounded_vector(frame, spark):
    wide = spark.range(40_000).select(
        F.col("id").alias("row_id"),
        *[F.col("id").cast("double").alias(c) for c in ("price", "hour")],
        # 20,000 values, one of them in a third of all rows.
        F.when(F.col("id") % 3 == 0, "it's __THIS__ \\ one").otherwise(F.concat(F.lit("c"), F.col("id") % 20_000)).alias("main_category"),
    )
    prepared = training.feature_pipeline(wide, ["price", "hour"], ["main_category"])
    rows = prepared.transform(wide).select("row_id", "main_category", "_main_category_level", "features")
    size = len(rows.first()["features"])
    assert 2 + training.FREQUENT < size <= 2 + training.FREQUENT + training.SHARED
    assert rows.where("(row_id % 3 = 0) <> (_main_category_level = main_category AND row_id % 3 = 0)").count() == 0
    assert rows.where("row_id % 3 = 0 AND _main_category_level <> main_category").count() == 0
    levels = rows.select("_main_category_level").distinct().count()
    assert levels == size - 2
    # Every row has exactly one level set.
    ones = rows.limit(500).collect()
    assert all(abs(r["features"].toArray()[2:].sum() - 1) < 1e-9 for r in ones)
    missing = wide.limit(2).withColumn("main_category", F.lit(None).cast("string"))
    assert all(r["features"].toArray()[2:].sum() == 0 for r in prepared.transform(missing).collect())


def test_search_tries_the_grid_and_a_sample(frame):
    best, tried = training.search(frame, {"maxDepth": [1, 2]}, folds=2, maxIter=2)
    assert [setting for setting, _ in tried] == [{"maxDepth": 1}, {"maxDepth": 2}]
    assert training.scored_set(best, frame).count() == 600
    _, sampled = training.search(
        frame, {"maxDepth": [1, 2], "stepSize": [0.1, 0.3]}, n_iter=1, folds=2, maxIter=1
    )
    assert len(sampled) == 1
    table = training.search_table(frame.sparkSession, tried).collect()
    assert [r["mean_auc"] for r in table] == sorted((a for _, a in tried), reverse=True)


def test_out_of_fold_scores_cover_every_row(frame):
    found = evaluation.full_evaluation(frame, k=2, maxIter=2, maxDepth=2)
    assert found["scores"].select("row_id").distinct().count() == 600
    assert found["folds"].count() == 2
    summary = found["summary"].first()
    best = C.best_threshold(found["scores"]).first()
    assert summary["optimal_threshold"] == best["threshold"]
    assert 1.0 <= summary["mean_trees"] <= 2.0  # early stopping may cut them
    full = evaluation.out_of_fold_scores(frame, k=2, patience=None, maxIter=2, maxDepth=2)
    assert [r["n_trees"] for r in full.select("n_trees").distinct().collect()] == [2]


def test_attributions_add_up_to_the_log_odds(frame, model):
    explained = A.attributions(model, frame)
    total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, b: a + b)
    odds = F.log(F.col("probability") / (1 - F.col("probability")))
    gap = explained.join(training.scored_set(model, frame), "row_id").agg(
        F.max(F.abs(total - odds)), F.count("*")
    ).first()
    assert gap[0] < 1e-9 and gap[1] == 600


def test_attributions_equal_the_definition(frame, model):
    """Average the gain of each feature over all orders in which features become known."""
    paths = A.tree_paths(model.stages[-1])
    names = A.attribution_names(model, frame)
    explained = A.attributions(model, frame.where("row_id < 3")).collect()
    for row in explained:
        x = np.array([row["values"]])
        expected = np.zeros(len(names))
        for value, tests in paths:
            passed = {f: A._passes(x[:, f], rules)[0] for f, (_, rules) in tests.items()}
            orders = list(permutations(tests))
            for order in orders:
                known = {f: share for f, (share, _) in tests.items()}
                for f in order:
                    before = value * np.prod(list(known.values()))
                    known[f] = passed[f]
                    expected[f] += (value * np.prod(list(known.values())) - before) / len(orders)
        assert np.allclose(expected, row["contributions"], atol=1e-12)


def test_attributions_work_out_a_path_by_its_patterns(frame, model, monkeypatch):
    """The terms of a path do not grow with the rows, and rows by themselves give the same."""
    paths, sizes, weights = A.tree_paths(model.stages[-1]), [], A._subset_weights
    monkeypatch.setattr(
        A, "_subset_weights", lambda ones, shares: (sizes.extend(map(len, ones)), weights(ones, shares))[1]
    )
    rows = A.attributions(model, frame).select("values").collect()
    x = np.array([r["values"] for r in rows])
    base, phi = A._contributions(x, paths)
    assert max(sizes) <= 2 ** max(len(tests) for _, tests in paths)  # 600 before
    for i in (0, 1, 599):
        alone, one = A._contributions(x[i : i + 1], paths)
        assert alone == base and np.array_equal(one[0], phi[i])
    monkeypatch.setattr(A, "KEPT_TESTS", 2)
    assert np.array_equal(A._contributions(x, paths)[1], phi)


def test_attribution_tables(frame, model, tmp_path, spark):
    explained, names = A.attributions(model, frame), A.attribution_names(model, frame)
    top = [r["feature"] for r in A.global_importance(explained, names, 10).collect()]
    assert "products_viewed" in top[:3]
    rows = explained.count()
    assert A.beeswarm(explained, names).count() == rows * len(names)
    assert 0 < A.beeswarm(explained, names, share=0.3).count() < 0.6 * rows * len(names)
    one = A.row_breakdown(explained, names, 5).collect()
    strengths = [abs(r["contribution"]) for r in one]
    assert len(one) == len(names) and strengths == sorted(strengths, reverse=True)
    price = [r["contributions"][0] for r in explained.collect()]
    assert A.contribution_quantile(explained, names).first()["contribution"] == pytest.approx(
        np.percentile(price, 95)
    )
    columns = A.top_attribution_columns(explained, names)
    artifacts.write_csv(columns, str(tmp_path / "top"))
    back = artifacts.read_csv(spark, str(tmp_path / "top"), columns.schema)
    assert back.columns == top and back.count() == 600


def test_report(frame, model):
    found = recommendation_report(model, frame).first()
    importance = training.feature_importance(model, frame, 3).collect()
    assert [d["feature"] for d in found["top_drivers"]] == [r["feature"] for r in importance]
    assert 0.5 < found["roc_auc"] <= 1 and 0 <= found["first_cluster_peak_hour"] < 24


def test_report_without_errors(frame, model):
    """A model that is right on all rows leaves nothing to cluster, and the report stands."""
    scores = training.scored_set(model, frame)
    right = scores.where("(probability >= 0.5) = (label = 1)").select("row_id")
    found = recommendation_report(model, materialise(frame.join(right, "row_id"), "right")).first()
    assert found["precision"] == 1.0 and found["first_cluster_n_errors"] is None


def test_scoring_needs_no_target_and_orders_features(frame, model):
    requests = frame.drop("target").select(*reversed(FEATURES), "row_id")
    scores = scoring.score(model, requests, 0.4)
    joined = scores.join(training.scored_set(model, frame).withColumnRenamed("probability", "p"), "row_id")
    assert joined.where("probability <> p").count() == 0
    assert scores.where("prediction <> cast(probability >= 0.4 as int)").count() == 0
    assert scores.count() == 600


def test_saved_model_scores_the_same(frame, model, spark, tmp_path):
    folder = str(tmp_path / "models")
    artifacts.save_model(model, FEATURES, {"auc": 0.1}, folder, 0.4, datetime(2024, 1, 1))
    newest = artifacts.save_model(model, FEATURES, {"auc": 0.9}, folder, 0.35, datetime(2024, 2, 1))
    assert newest.endswith("model_20240201_000000")
    loaded, metadata = artifacts.load_model(spark, folder)
    assert metadata["optimal_threshold"] == 0.35 and metadata["metrics"] == {"auc": 0.9}
    assert metadata["features"] == FEATURES
    stored = scoring.score_stored(spark, folder, frame)
    assert [r["threshold"] for r in stored.select("threshold").distinct().collect()] == [0.35]
    one, two = (scoring.score(m, frame) for m in (model, loaded))
    assert one.exceptAll(two).count() == 0
    with pytest.raises(FileNotFoundError):
        artifacts.load_model(spark, str(tmp_path / "nothing"))


def test_baseline_round_trip(frame, model, spark, tmp_path):
    from cartlens.operators.monitoring import drift_report, monitoring_baseline

    scored = training.scored_set(model, frame)
    baseline = monitoring_baseline(frame, scored, ["price", "hour"])
    artifacts.write_baseline(baseline, str(tmp_path / "baseline"))
    back = artifacts.read_baseline(spark, str(tmp_path / "baseline"))
    assert back.drop("created_at").exceptAll(baseline.drop("created_at")).count() == 0
    assert {r["status"] for r in drift_report(back, frame).collect()} == {"stable"}
    raised = frame.withColumn("price", F.col("price") * 1.15)
    statuses = {r["feature"]: r["status"] for r in drift_report(back, raised).collect()}
    assert statuses == {"price": "drift", "hour": "stable"}


def test_stream_equals_batch_and_keeps_bad_rows_apart(frame, model, spark, tmp_path):
    broken = frame.withColumn("hour", F.when(F.col("row_id") % 10 == 0, 25).otherwise(F.col("hour")))
    requests = broken.drop("target")
    requests.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = read_requests(spark, str(tmp_path / "in"), requests.schema, files_per_trigger=1)
    for query in start_scoring(model, stream, str(tmp_path / "out"), 0.4):
        query.awaitTermination()
    scores = spark.read.parquet(str(tmp_path / "out" / "scores"))
    batch = scoring.score(model, requests, 0.4)
    assert scores.count() == 540 and scores.exceptAll(batch).count() == 0
    refused = spark.read.parquet(str(tmp_path / "out" / "rejected"))
    assert refused.count() == 60 and {r["violations"] for r in refused.collect()} == {"hour"}
    # A second run finds nothing new.
    for query in start_scoring(model, stream, str(tmp_path / "out"), 0.4):
        query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "scores")).count() == 540


def test_one_stream_fills_both_tables(frame, model, spark, tmp_path):
    broken = frame.withColumn("hour", F.when(F.col("row_id") % 10 == 0, 25).otherwise(F.col("hour")))
    requests = broken.drop("target")
    requests.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = read_requests(spark, str(tmp_path / "in"), requests.schema, files_per_trigger=1)
    out = str(tmp_path / "out")

    def tables():
        return read_part(spark, out, "scores"), read_part(spark, out, "rejected")

    start_split_scoring(model, stream, out, 0.4).awaitTermination()
    scores, refused = tables()
    batch = scoring.score(model, requests, 0.4)
    assert scores.columns == batch.columns and scores.count() == 540
    assert scores.exceptAll(batch).count() == 0
    assert refused.count() == 60 and {r["violations"] for r in refused.collect()} == {"hour"}
    # A second run finds nothing new; a batch whose end was not noted replaces its own rows.
    start_split_scoring(model, stream, out, 0.4).awaitTermination()
    assert [t.count() for t in tables()] == [540, 60]
    last = max((tmp_path / "out" / "_progress" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for noted in (last, last.with_name(f".{last.name}.crc")):
        noted.unlink(missing_ok=True)
    start_split_scoring(model, stream, out, 0.4).awaitTermination()
    assert [t.count() for t in tables()] == [540, 60]


def _parts(frame):
    split = stratified_split(frame)
    return [split.where(f"split = '{p}'").drop("split") for p in ("train", "validation")]


def test_first_trees_score_as_a_shorter_fit(frame, tmp_path, spark):
    full = training.fit_model(frame, maxIter=6, maxDepth=3)
    short = training.fit_model(frame, maxIter=4, maxDepth=3)
    cut = PipelineModel(stages=[*full.stages[:-1], training.first_trees(full.stages[-1], 4)])
    assert cut.stages[-1].getNumTrees == 4 and cut.stages[-1].numFeatures == full.stages[-1].numFeatures
    one, two = (training.scored_set(m, frame).select("row_id", "probability") for m in (cut, short))
    assert one.exceptAll(two).count() == 0
    importance = [training.feature_importance(m, frame).collect() for m in (cut, short)]
    assert importance[0] == importance[1]
    artifacts.save_model(cut, FEATURES, {}, str(tmp_path / "cut"), 0.5)
    loaded, _ = artifacts.load_model(spark, str(tmp_path / "cut"))
    assert training.scored_set(loaded, frame).select("row_id", "probability").exceptAll(two).count() == 0
    attributed = A.attributions(cut, frame).count()
    assert attributed == 600


def test_early_stopping_fits_once(frame, monkeypatch):
    fitted = []
    fit = training.GBTClassifier.fit
    monkeypatch.setattr(
        training.GBTClassifier, "fit", lambda self, *a, **k: fitted.append(1) or fit(self, *a, **k)
    )
    train, held_out = _parts(frame)
    stopped = training.fit_model(train, held_out, 2, maxIter=12, maxDepth=4, stepSize=0.9)
    assert stopped.stages[-1].getNumTrees < 12 and len(fitted) == 1


def test_killed_search_resumes(frame, tmp_path, monkeypatch):
    settings = {"maxDepth": [1, 3], "maxIter": [1, 3]}
    job = dict(grid=settings, folds=2, parallelism=1, journal=str(tmp_path / "journal"))
    order, fit = [], training.fit_trees

    def dies(learner, *rest):
        order.append((learner.getMaxIter(), learner.getMaxDepth()))
        if len(order) >= 4:
            raise RuntimeError("driver lost")
        return fit(learner, *rest)

    monkeypatch.setattr(training, "fit_trees", dies)
    with pytest.raises(RuntimeError, match="driver lost"):
        training.search(frame, **job)
    assert order[:4] == [(3, 3), (3, 3), (1, 3), (1, 3)]  # the longest fits come first

    def counted(learner, *rest):
        order.append((learner.getMaxIter(), learner.getMaxDepth()))
        return fit(learner, *rest)

    monkeypatch.setattr(training, "fit_trees", counted)
    order.clear()
    _, tried = training.search(frame.repartition(3), **job)
    assert order[:-1] == [(1, 3), (3, 1), (3, 1), (1, 1), (1, 1)]  # then the best on all rows
    order.clear()
    _, again = training.search(frame, **job)
    assert len(order) == 1 and again == tried
    _, fresh = training.search(frame, settings, folds=2)
    assert fresh == tried
    # Other rows are another search.
    order.clear()
    training.search(frame.where("row_id > 9"), **job)
    assert len(order) == 9


def test_half_written_model_is_never_loaded(frame, model, spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "models")
    first = artifacts.save_model(model, FEATURES, {}, folder, 0.4, datetime(2024, 1, 1))

    class Broken:
        def write(self):
            return self

        def overwrite(self):
            return self

        def save(self, path):
            model.write().overwrite().save(path)
            raise RuntimeError("writer lost")

    with pytest.raises(RuntimeError, match="writer lost"):
        artifacts.save_model(Broken(), FEATURES, {}, folder, 0.9, datetime(2024, 3, 1))
    assert artifacts.latest_model_path(spark, folder).endswith("model_20240101_000000")
    same = artifacts.save_model(model, FEATURES, {}, folder, 0.2, datetime(2024, 1, 1))
    assert same == f"{first}_001"
    assert artifacts.load_model(spark, folder)[1]["optimal_threshold"] == 0.2
    # A writer that starts again does not write into the folder of the lost one.
    after = artifacts.save_model(model, FEATURES, {}, folder, 0.3, datetime(2024, 3, 1))
    assert after.endswith("model_20240301_000000_001")
    assert artifacts.load_model(spark, folder)[1]["optimal_threshold"] == 0.3


def test_fits_of_a_search_have_local_properties_of_their_own(frame, monkeypatch):
    """With one copy for all, a fit loses its SQL execution when another one ends."""
    context, fit, kept = frame.sparkSession.sparkContext, training.fit_trees, []

    def marked(learner, rows, *rest):
        own = str(id(learner))
        context.setLocalProperty("fit", own)
        model = fit(learner, rows, *rest)
        kept.append(context.getLocalProperty("fit") == own)
        return model

    monkeypatch.setattr(training, "fit_trees", marked)
    training.search(frame, {"maxDepth": [1, 2]}, folds=2, maxIter=2)
    context.setLocalProperty("fit", None)
    assert len(kept) == 5 and all(kept)


def test_layout_of_a_fit_follows_the_width_of_its_vectors(spark, frame, monkeypatch):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    monkeypatch.setattr(ordered, "LAYOUT_ROWS", 15)
    monkeypatch.setattr(ordered, "LEAST_PARTS", 2)
    laid, fit = [], training.fit_trees
    monkeypatch.setattr(
        training, "fit_trees", lambda learner, rows, *rest: (laid.append(rows), fit(learner, rows, *rest))[1]
    )
    try:
        training.fit_model(frame, maxIter=1, maxDepth=2)
        training.search(frame, {"maxDepth": [2]}, folds=2, maxIter=1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    rows = [(r.count(), r.rdd.getNumPartitions()) for r in laid]
    assert [n for n, _ in rows] == [600, rows[1][0], 600 - rows[1][0], 600]
    assert all(held == -(-n // 60) for n, held in rows)  # 12 before


def test_random_search_draws_from_the_whole_grid(spark, frame, monkeypatch):
    from cartlens.registry import modelling as M

    asked = []

    def search(train, grid=None, n_iter=None, **params):
        asked.append((grid or training.GRID, n_iter, params))
        return None, [({"maxIter": 100}, 0.5)]

    monkeypatch.setattr(M, "trained", lambda spark, sf_dir: M.Trained(frame, frame, None, None, None))
    monkeypatch.setattr(training, "search", search)
    assert M.random_search(spark, "whole-grid").count() == 1
    assert asked == [(training.GRID, training.DRAWS, {"least_parts": 1})]
    assert training.GRID["maxIter"] == [100, 200] and training.DRAWS == 20
