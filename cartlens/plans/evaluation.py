"""Cross-validation and full evaluation."""

from functools import reduce

from pyspark.sql import functions as F

from cartlens.operators.classification import (
    best_threshold,
    confusion_matrix,
    evaluation_metrics,
    fold_metrics,
    fold_summary,
    pr_points,
    roc_points,
    score_curve,
)
from cartlens.operators.splits import stratified_folds
from cartlens.plans.training import PATIENCE, fit_model, scored_set
from cartlens.session import materialise


def out_of_fold_scores(frame, k=5, seed=42, patience=PATIENCE, **params):
    """Score every row by a model that was fitted on the other folds.

    ``n_trees`` is the size of that model, which early stopping on the held-out fold may cut;
    ``patience=None`` turns that off.

    The folded frame and the scores are written out: each is read many times.
    """
    folded = materialise(stratified_folds(frame, k, seed=seed), "folds")
    parts = []
    for fold in range(k):
        train = folded.where(F.col("fold") != fold).drop("fold")
        held_out = folded.where(F.col("fold") == fold).drop("fold")
        checked = None if patience is None else held_out
        model = fit_model(train, checked, patience, **params)
        kept = F.lit(model.stages[-1].getNumTrees)
        parts.append(
            scored_set(model, held_out).withColumns({"fold": F.lit(fold), "n_trees": kept})
        )
    return materialise(reduce(lambda a, b: a.unionByName(b), parts), "out-of-fold")


def full_evaluation(frame, k=5, metric="f1", seed=42, **params):
    """Out-of-fold scores, their fold summary and the best threshold on them."""
    scores = out_of_fold_scores(frame, k, seed, **params)
    per_fold = fold_metrics(scores)
    best = materialise(best_threshold(scores, metric), "best-threshold")
    return {
        "scores": scores,
        "folds": per_fold,
        "summary": fold_summary(per_fold).withColumns(
            {
                "optimal_threshold": best.select("threshold").scalar(),
                "optimal_score": best.select("score").scalar(),
                "mean_trees": scores.groupBy("fold")
                .agg(F.max("n_trees").alias("n_trees"))
                .agg(F.avg("n_trees"))
                .scalar(),
            }
        ),
    }


def evaluation_bundle(scored, threshold=0.5):
    """Confusion matrix, metrics, ROC points and precision-recall points of a scored set."""
    curve = score_curve(scored)
    return {
        "confusion": confusion_matrix(scored, threshold),
        "metrics": evaluation_metrics(scored, threshold),
        "roc": roc_points(curve),
        "precision_recall": pr_points(curve),
    }
