"""Metrics against small hand cases and plain numpy loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlens.operators import classification as C
from cartlens.operators import errors as E
from cartlens.operators import lift as L
from cartlens.operators import monitoring as M
from cartlens.operators import profiling as P

SCHEMA = "row_id bigint, label int, probability double"


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    p = np.round(rng.random(300), 2)
    y = (rng.random(300) < 0.2 + 0.6 * p).astype(int)
    return list(zip(range(300), y.tolist(), p.tolist()))


@pytest.fixture(scope="module")
def scored(spark, sample):
    return spark.createDataFrame(sample, SCHEMA).repartition(5)


def frame(spark, pairs):
    return spark.createDataFrame([(i, y, p) for i, (y, p) in enumerate(pairs)], SCHEMA)


def brute_auc(rows):
    pos = [p for _, y, p in rows if y == 1]
    neg = [p for _, y, p in rows if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_ranking_metrics(scored, sample):
    found = C.ranking_metrics(C.score_curve(scored)).first()
    assert found["roc_auc"] == pytest.approx(brute_auc(sample))
    assert found["brier_score"] == pytest.approx(np.mean([(p - y) ** 2 for _, y, p in sample]))
    total = sum(y for _, y, _ in sample)
    ap, before = 0.0, 0.0
    for t in sorted({p for _, _, p in sample}, reverse=True):
        hits = [y for _, y, p in sample if p >= t]
        recall = sum(hits) / total
        ap += (recall - before) * sum(hits) / len(hits)
        before = recall
    assert found["average_precision"] == pytest.approx(ap)


def test_average_precision_is_a_step_sum(spark):
    # Positives at ranks 1 and 3: (1/1 + 2/3) / 2.
    rows = frame(spark, [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6)])
    found = C.ranking_metrics(C.score_curve(rows)).first()
    assert found["average_precision"] == pytest.approx((1 + 2 / 3) / 2)
    assert found["roc_auc"] == 0.75


def test_all_scores_equal(spark):
    rows = frame(spark, [(1, 0.5), (0, 0.5), (0, 0.5), (1, 0.5)])
    curve = C.score_curve(rows)
    found = C.ranking_metrics(curve).first()
    assert (found["roc_auc"], found["average_precision"]) == (0.5, 0.5)
    assert curve.count() == 1
    assert {(r["fpr"], r["tpr"]) for r in C.roc_points(curve).collect()} == {(0.0, 0.0), (1.0, 1.0)}


@pytest.mark.parametrize("label", [0, 1])
def test_single_class(spark, label):
    rows = frame(spark, [(label, 0.9), (label, 0.2)])
    found = C.evaluation_metrics(rows).first()
    assert found["roc_auc"] is None
    assert found["recall"] == (0.5 if label else 0.0)
    assert C.classification_report(rows).count() == 4
    assert L.lift_by_bins(rows, 2).count() == 2


def test_threshold_metrics_agree_with_one_pass_metrics(scored, sample):
    simple, joint = C.threshold_metrics(scored, 0.4).first(), C.evaluation_metrics(scored, 0.4).first()
    tp = sum(y and p >= 0.4 for _, y, p in sample)
    hits = sum(p >= 0.4 for _, _, p in sample)
    assert simple["precision"] == pytest.approx(tp / hits)
    for name in ("accuracy", "precision", "recall", "f1_score", "brier_score"):
        assert simple[name] == pytest.approx(joint[name])


def test_nothing_predicted_gives_zero(spark):
    found = C.threshold_metrics(frame(spark, [(1, 0.1), (0, 0.2)])).first()
    assert (found["precision"], found["recall"], found["f1_score"]) == (0.0, 0.0, 0.0)


def test_curves_have_a_point_per_score_and_the_end_points(scored, sample):
    distinct = len({p for _, _, p in sample})
    curve = C.score_curve(scored)
    roc, pr = C.roc_points(curve).collect(), C.pr_points(curve).collect()
    assert len(roc) == len(pr) == distinct + 1
    assert [(r["fpr"], r["tpr"]) for r in roc if r["threshold"] is None] == [(0.0, 0.0)]
    assert [(r["precision"], r["recall"]) for r in pr if r["threshold"] is None] == [(1.0, 0.0)]
    assert max(r["tpr"] for r in roc) == 1.0


def test_calibration_edge_goes_to_the_lower_bin(spark):
    rows = frame(spark, [(1, 0.1), (0, 0.3), (1, 0.30001), (1, 1.0), (0, 0.0)])
    bins = {r["bin"]: r["n"] for r in C.calibration(rows).collect()}
    assert bins == {0: 2, 2: 1, 3: 1, 9: 1}


def test_sweep_and_best_threshold(scored, sample):
    thresholds = np.linspace(0.01, 0.99, 99)
    total = sum(y for _, y, _ in sample)
    expected = []
    for t in thresholds:
        tp = sum(y for _, y, p in sample if p >= t)
        hits = sum(p >= t for _, _, p in sample)
        expected.append((tp / hits if hits else 0.0, tp / total, 2 * tp / (hits + total)))
    rows = sorted(C.threshold_sweep(scored).collect(), key=lambda r: r["threshold"])
    assert len(rows) == 99
    for row, (precision, recall, f1) in zip(rows, expected):
        assert row["precision"] == pytest.approx(precision)
        assert row["recall"] == pytest.approx(recall)
        assert row["f_score"] == pytest.approx(f1)
        assert row["precision_recall_j"] == pytest.approx(precision + recall - 1)
    best = C.best_threshold(scored, "f1").first()
    assert best["threshold"] == thresholds[int(np.argmax([e[2] for e in expected]))]
    # Recall is 1 from the lowest threshold on: the first one wins.
    assert C.best_threshold(scored, "recall").first()["threshold"] == pytest.approx(0.01)


def test_unknown_metric_raises(scored):
    with pytest.raises(ValueError, match="gain"):
        C.best_threshold(scored, "gain")


def test_youden_and_f1_on_curve(scored, sample):
    curve = C.score_curve(scored)
    total = sum(y for _, y, _ in sample)
    best_j, best_f1 = (-1, None), (-1, None)
    for t in sorted({p for _, _, p in sample}):
        tp = sum(y for _, y, p in sample if p >= t)
        hits = sum(p >= t for _, _, p in sample)
        j = tp / total - (hits - tp) / (300 - total)
        f1 = 2 * tp / (hits + total)
        best_j = (j, t) if j > best_j[0] - 1e-12 else best_j
        best_f1 = (f1, t) if f1 > best_f1[0] + 1e-9 else best_f1
    assert C.best_youden(curve).first()["threshold"] == best_j[1]
    assert C.best_f1_on_curve(curve).first()["threshold"] == best_f1[1]


@pytest.mark.parametrize("bins", [3, 10])
def test_lift_by_bins_cuts_inside_ties(spark, bins):
    rng = np.random.default_rng(bins)
    rows = [(i, int(rng.random() < 0.4), float(rng.integers(0, 4)) / 4) for i in range(101)]
    scored = spark.createDataFrame(rows, SCHEMA).repartition(6)
    ordered = [y for _, y, _ in sorted(rows, key=lambda r: (-r[2], r[0]))]
    found = {r["n_rows"]: r for r in L.lift_by_bins(scored, bins).collect()}
    for i in range(1, bins + 1):
        cut = int(i * 101 / bins)
        assert found[cut]["n_positive"] == sum(ordered[:cut])
        assert found[cut]["gain"] == pytest.approx(sum(ordered[:cut]) / sum(ordered))


def test_lift_of_more_bins_than_rows(spark):
    found = L.lift_by_bins(frame(spark, [(1, 0.9), (0, 0.1)]), 10).collect()
    assert {(r["n_rows"], r["gain"]) for r in found} == {(0, 0.0), (1, 1.0), (2, 1.0)}
    assert {r["lift"] for r in found if r["n_rows"] == 0} == {0.0}


def test_gain_curve_ends_at_one(scored):
    last = L.gain_curve(C.score_curve(scored)).orderBy(F.desc("percentile")).first()
    assert (last["percentile"], last["gain"], last["lift"]) == (1.0, 1.0, 1.0)


def test_fold_metrics_equal_single_metrics(scored, sample):
    folded = scored.withColumn("fold", F.col("row_id") % 3)
    found = {r["fold"]: r for r in C.fold_metrics(folded).collect()}
    for fold in range(3):
        rows = [r for r in sample if r[0] % 3 == fold]
        assert found[fold]["roc_auc"] == pytest.approx(brute_auc(rows))
        assert found[fold]["f1_score"] == pytest.approx(
            C.threshold_metrics(folded.where(F.col("fold") == fold)).first()["f1_score"]
        )
    aucs = [found[f]["roc_auc"] for f in range(3)]
    summary = C.fold_summary(C.fold_metrics(folded)).first()
    assert summary["mean_roc_auc"] == pytest.approx(np.mean(aucs))
    assert summary["std_roc_auc"] == pytest.approx(np.std(aucs))


def test_error_rows(spark):
    rows = frame(spark, [(0, 0.9), (0, 0.6), (1, 0.2), (1, 0.95)])
    assert E.misclassified(rows).count() == 3
    assert [r["row_id"] for r in E.high_confidence_errors(rows).collect()] == [0]


def test_peak_hour_takes_the_smallest_on_ties(spark):
    rows = spark.createDataFrame(
        [(0, 10.0, 9, 1), (0, 20.0, 3, 0), (0, 30.0, 9, 1), (0, 40.0, 3, 0)],
        "cluster int, price double, hour int, label int",
    )
    found = E.cluster_summary(rows).first()
    assert (found["peak_hour"], found["mean_price"], found["mean_class"]) == (3, 25.0, 0.5)


def test_drift_kinds(spark):
    def table(**columns):
        return spark.createDataFrame([columns])

    baseline = P.feature_moments(
        table(zero=0.0, same=5.0, moved=10.0, gone=1.0, near_zero=0.0, negative=-10.0),
        ["zero", "same", "moved", "gone", "near_zero", "negative"],
    )
    current = table(zero=0.2, same=5.4, moved=11.5, near_zero=0.05, negative=-12.0, extra=3.0)
    found = {r["feature"]: r for r in M.drift_report(baseline, current).collect()}
    assert {f: r["status"] for f, r in found.items()} == {
        "zero": "drift",
        "same": "stable",
        "moved": "drift",
        "gone": "missing",
        "near_zero": "stable",
        "negative": "drift",
    }
    assert found["zero"]["difference"] == pytest.approx(0.2)


def test_revenue_lift(spark):
    rows = spark.createDataFrame(
        [(1, 0.9, 10.0), (0, 0.8, 30.0), (1, 0.2, 5.0)],
        "label int, probability double, price double",
    )
    found = M.revenue_lift(rows).first()
    assert (found["potential_revenue"], found["current_revenue"]) == (20.0, 15.0)
    assert found["lift"] == pytest.approx(1 / 3)
    nobody = M.revenue_lift(rows, threshold=0.99).first()
    assert (nobody["potential_revenue"], nobody["lift"]) == (0.0, -1.0)


def test_class_balance_without_positives(spark):
    df = spark.createDataFrame([(0,), (0,)], "target int")
    found = P.class_balance(df).first()
    assert (found["n_negative"], found["n_positive"], found["scale_pos_weight"]) == (2, 0, 1.0)


def test_correlations_with_and_without_nulls(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=50), rng.normal(size=50)
    full = spark.createDataFrame(
        [(float(a), float(b), 1.0) for a, b in zip(x, y)], "x double, y double, one double"
    )
    cells = {(r["a"], r["b"]): r["corr"] for r in P.correlations(full, ["x", "y", "one"]).collect()}
    assert cells["x", "y"] == cells["y", "x"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert cells["x", "x"] == pytest.approx(1.0)
    assert cells["one", "one"] is None and cells["x", "one"] is None
    holes = full.withColumn("z", F.when(F.col("x") > 0, F.col("y")))
    cells = {(r["a"], r["b"]): r["corr"] for r in P.correlations(holes, ["x", "y", "z"]).collect()}
    assert cells["x", "y"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert cells["x", "z"] == pytest.approx(np.corrcoef(x[x > 0], y[x > 0])[0, 1])


def test_histogram_keeps_top_edge_and_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (10.0,), (10.0,)], "x double")
    found = {r["bin"]: r["n"] for r in P.histogram(df, "x", 10).collect()}
    assert found[1] == 2 and found[10] == 2 and len(found) == 10 and sum(found.values()) == 4
    same = P.histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x", 10)
    assert sum(r["n"] for r in same.collect()) == 2


def test_summary_sketch_is_close_to_exact(random_events):
    exact = P.feature_summary(random_events, ["price", "user_id"]).collect()
    sketch = P.feature_summary(random_events, ["price", "user_id"], accuracy=10_000).collect()
    for a, b in zip(sorted(exact), sorted(sketch)):
        assert a["count"] == b["count"] and a["std"] == pytest.approx(b["std"])
        assert a["q50"] == pytest.approx(b["q50"], rel=0.02)


def test_counts_by_hour_day_and_value(random_events):
    from cartlens.operators.behavior import with_time_features

    timed = with_time_features(random_events)
    hours = P.hourly_activity(timed.where("hour <> 5")).collect()
    assert len(hours) == 24 and {r["n_events"] for r in hours if r["hour"] == 5} == {0}
    exact = {r["event_date"]: r["n_visitors"] for r in P.daily_unique_visitors(timed).collect()}
    rough = {r["event_date"]: r["n_visitors"] for r in P.daily_unique_visitors(timed, True).collect()}
    assert exact.keys() == rough.keys()
    assert [r["n_events"] for r in P.top_values(timed, "event_type", 2).collect()] == sorted(
        (r["n_events"] for r in P.value_counts(timed, "event_type").collect()), reverse=True
    )[:2]
