"""Monitoring baseline, drift and revenue lift."""

from pyspark.sql import functions as F

from cartlens.operators.classification import ranking_metrics, score_curve
from cartlens.operators.profiling import class_balance, feature_moments

DRIFT_LIMIT = 0.1


def monitoring_baseline(frame, scored, columns):
    """``feature, mean, std`` with the ROC AUC, class ratio and time on every row."""
    auc = ranking_metrics(score_curve(scored)).select("roc_auc").scalar()
    share = class_balance(scored, "label").select("class_ratio").scalar()
    return feature_moments(frame, columns).select(
        "*",
        auc.alias("auc_score"),
        share.alias("class_ratio"),
        F.current_timestamp().alias("created_at"),
    )


def drift_report(baseline, current, limit=DRIFT_LIMIT):
    """Compare the means of a current table with the baseline, feature by feature.

    A relative change above ``limit`` is drift; the change is absolute where the baseline
    mean is 0.  A baseline feature that ``current`` lacks is reported as missing.
    """
    present = current.columns
    numeric = [
        f.name for f in current.schema.fields if f.dataType.typeName() not in ("string", "boolean")
    ]
    now = feature_moments(current, numeric).select(
        "feature", F.col("mean").alias("current_mean")
    )
    base = F.col("baseline_mean")
    change = F.abs(F.col("current_mean") - base)
    compared = (
        baseline.select("feature", F.col("mean").alias("baseline_mean"))
        .join(now, "feature", "left")
        .withColumn("is_missing", ~F.col("feature").isin(present))
        .withColumn("difference", F.when(base == 0, change).otherwise(change / F.abs(base)))
    )
    return compared.select(
        "feature",
        "baseline_mean",
        "current_mean",
        "difference",
        F.when(F.col("is_missing"), "missing")
        .when(F.col("difference") > limit, "drift")
        .otherwise("stable")
        .alias("status"),
    )


def revenue_lift(scored, threshold=0.7):
    """Expected revenue of targeting rows above ``threshold`` against that of the buyers.

    ``scored`` also carries ``price``.
    """
    targeted = F.col("probability") > threshold
    sums = scored.agg(
        F.coalesce(F.sum(F.when(targeted, F.col("price"))), F.lit(0.0)).alias("targeted_spend"),
        F.coalesce(F.avg(F.when(targeted, F.col("label"))), F.lit(0.0)).alias("conversion_rate"),
        F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("price"))), F.lit(0.0)).alias(
            "current_revenue"
        ),
    )
    potential = F.col("targeted_spend") * F.col("conversion_rate")
    return sums.select(
        "targeted_spend",
        "conversion_rate",
        "current_revenue",
        potential.alias("potential_revenue"),
        (F.try_divide(potential, F.col("current_revenue")) - 1).alias("lift"),
    )
