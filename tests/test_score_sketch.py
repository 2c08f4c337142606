"""Bounded curves against the exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlens.operators import classification as C
from cartlens.operators import score_sketch as K

SCHEMA = "row_id long, label int, probability double"


def make(spark, scores, labels):
    rows = [(i, int(y), float(p)) for i, (p, y) in enumerate(zip(scores, labels))]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def random_set(seed, n=3000):
    rng = np.random.default_rng(seed)
    scores = rng.beta(2, 5, n)
    scores[: n // 3] = 0.125  # a score that a third of the rows share
    return scores, rng.random(n) < scores


@pytest.mark.parametrize("bins", [5, 50, 400])
def test_exact_value_is_within_the_error(spark, bins):
    scored = make(spark, *random_set(bins))
    exact = C.ranking_metrics(C.score_curve(scored)).first()
    found = K.bounded_ranking_metrics(K.binned_curve(K.score_bins(scored, bins))).first()
    assert found["bins"] <= 2 * bins + 1
    for name in ("roc_auc", "average_precision"):
        assert abs(found[name] - exact[name]) <= found[f"{name}_error"] + 1e-12
        assert 0 < found[f"{name}_error"] < 2 / bins + 0.2 / bins**0.5


def test_the_error_holds_in_the_worst_order(spark):
    """All positives of every bin first, or last: the bound is not an average case."""
    n = 1200
    for first in (True, False):
        labels = np.array([(i // 30 % 2 == 0) == first for i in range(n)])
        scored = make(spark, np.arange(n) / n, labels)
        exact = C.ranking_metrics(C.score_curve(scored)).first()
        found = K.bounded_ranking_metrics(K.binned_curve(K.score_bins(scored, 20))).first()
        for name in ("roc_auc", "average_precision"):
            assert abs(found[name] - exact[name]) <= found[f"{name}_error"] + 1e-12


def test_few_distinct_scores_are_exact(spark):
    rng = np.random.default_rng(4)
    scores = rng.integers(0, 20, 2000) / 20
    scored = make(spark, scores, rng.random(2000) < scores)
    exact = C.ranking_metrics(C.score_curve(scored)).first()
    curve = K.binned_curve(K.score_bins(scored, 400))
    found = K.bounded_ranking_metrics(curve).first()
    assert found["roc_auc_error"] == found["average_precision_error"] == 0.0
    assert found["roc_auc"] == pytest.approx(exact["roc_auc"], abs=1e-12)
    assert found["average_precision"] == pytest.approx(exact["average_precision"], abs=1e-12)
    points = [sorted((r["threshold"] or 9, r["fpr"], r["tpr"]) for r in C.roc_points(c).collect()) for c in (curve, C.score_curve(scored))]
    assert np.allclose(points[0], points[1])


def test_points_are_points_of_the_exact_curve(spark):
    scored = make(spark, *random_set(9))
    exact = {r["threshold"]: (r["precision"], r["recall"]) for r in C.pr_points(C.score_curve(scored)).collect()}
    for r in C.pr_points(K.binned_curve(K.score_bins(scored, 30))).collect():
        assert (r["precision"], r["recall"]) == pytest.approx(exact[r["threshold"]])


def test_layout_nulls_one_class_and_no_rows(spark):
    scores, labels = random_set(6, 500)
    scored = make(spark, scores, labels)
    total = lambda df: df.agg(F.sum("n"), F.sum("pos")).first()
    assert tuple(total(K.score_bins(scored.repartition(2), 10))) == (500, int(labels.sum()))
    nulls = scored.unionByName(scored.limit(7).withColumn("probability", F.lit(None).cast("double")))
    assert tuple(total(K.score_bins(nulls, 10))) == (500, int(labels.sum()))
    one = K.bounded_ranking_metrics(K.binned_curve(K.score_bins(scored.where("label = 0"), 10))).first()
    assert one["roc_auc"] is None and one["average_precision"] is None
    empty = K.bounded_ranking_metrics(K.binned_curve(K.score_bins(scored.where("false"), 10))).first()
    assert empty["bins"] == 0 and empty["roc_auc"] is None
