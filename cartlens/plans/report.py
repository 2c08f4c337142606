"""The one-row recommendation report."""

from pyspark.sql import functions as F

from cartlens.operators.attribution import (
    attribution_names,
    attributions,
    contribution_quantile,
)
from cartlens.operators.classification import evaluation_metrics
from cartlens.operators.errors import cluster_errors, cluster_summary, high_confidence_errors
from cartlens.plans.training import feature_importance, with_probability
from cartlens.schema import TARGET
from cartlens.session import materialise


def recommendation_report(model, validation, threshold=0.5, confidence=0.8):
    """AUC, precision, recall, top drivers, risky errors, price effect and first error cluster."""
    predicted = with_probability(model, validation).withColumn("label", F.col(TARGET))
    scored = materialise(
        predicted.select("row_id", "label", "probability", "price", "hour", "features"), "scored"
    )
    metrics = evaluation_metrics(scored, threshold)
    wrong = scored.where(
        F.col("label") != (F.col("probability") >= threshold).cast("int")
    )
    clusters = cluster_summary(cluster_errors(wrong))
    first = clusters.orderBy("cluster").limit(1)
    names = attribution_names(model, validation)
    price = contribution_quantile(attributions(model, validation), names)
    drivers = feature_importance(model, validation, 3).agg(
        F.sort_array(
            F.collect_list(F.struct("importance", "feature")), asc=False
        ).alias("drivers")
    )
    risky = high_confidence_errors(scored, threshold, confidence).agg(F.count(F.lit(1)))
    return metrics.select(
        "roc_auc",
        "precision",
        "recall",
        drivers.scalar().alias("top_drivers"),
        risky.scalar().alias("high_confidence_errors"),
        price.select("contribution").scalar().alias("price_effect_p95"),
        *[
            first.select(c).scalar().alias(f"first_cluster_{c}")
            for c in ("n_errors", "mean_price", "std_price", "peak_hour")
        ],
    )
