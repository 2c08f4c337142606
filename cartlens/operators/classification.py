"""Quality of a scored set: rows of ``row_id, label (0/1), probability``.

Whatever needs the scores in order works on ``score_curve``: one row per distinct score with
running counts.  Rows are counted per score before anything is sorted, and rows of one score
always move together, so the tables do not depend on how ties are stored.
"""

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Window
from pyspark.sql import functions as F

from cartlens.functions.expressions import predicted_class, ratio
from cartlens.functions.ordered import running_sums

# The thresholds of the sweep, in the same floating-point numbers.
THRESHOLDS = np.linspace(0.01, 0.99, 99).tolist()
PR_EPSILON = 1e-9
F_BETA_EPSILON = 1e-10
SWEEP_METRICS = {
    "f1": "f_score",
    "precision": "precision",
    "recall": "recall",
    "j_statistic": "youden_j",
}


def with_prediction(scored, threshold=0.5):
    return scored.withColumn("prediction", predicted_class("probability", threshold))


def confusion_matrix(scored, threshold=0.5):
    """``label, prediction, n`` for the pairs that occur."""
    return (
        with_prediction(scored, threshold)
        .groupBy("label", "prediction")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _confusion_counts(scored, threshold):
    hit = F.col("prediction") == 1
    true = F.col("label") == 1
    return with_prediction(scored, threshold).agg(
        F.count_if(hit & true).alias("tp"),
        F.count_if(hit & ~true).alias("fp"),
        F.count_if(~hit & true).alias("fn"),
        F.count_if(~hit & ~true).alias("tn"),
        F.avg(F.pow(F.col("probability") - F.col("label"), 2)).alias("brier_score"),
    )


def _f1(tp, fp, fn):
    return ratio(2 * tp, 2 * tp + fp + fn)


def threshold_metrics(scored, threshold=0.5):
    """Accuracy, precision, recall, F1 and Brier score in one pass; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return _confusion_counts(scored, threshold).select(
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        _f1(tp, fp, fn).alias("f1_score"),
        "brier_score",
    )


def brier_score(scored):
    return scored.agg(
        F.avg(F.pow(F.col("probability") - F.col("label"), 2)).alias("brier_score")
    )


def classification_report(scored, threshold=0.5):
    """Precision, recall, F1 and support per class, with macro and weighted means."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def line(name, hits, false_hits, misses):
        return F.struct(
            F.lit(name).alias("class"),
            ratio(hits, hits + false_hits).alias("precision"),
            ratio(hits, hits + misses).alias("recall"),
            _f1(hits, false_hits, misses).alias("f1_score"),
            (hits + misses).alias("support"),
        )

    counts = _confusion_counts(scored, threshold)
    lines = counts.select(line("0", tn, fn, fp).alias("a"), line("1", tp, fp, fn).alias("b"))
    support = F.col("a.support") + F.col("b.support")

    def mean(name, weigh):
        measures = []
        for m in ("precision", "recall", "f1_score"):
            a, b = F.col(f"a.{m}"), F.col(f"b.{m}")
            weighted = ratio(a * F.col("a.support") + b * F.col("b.support"), support)
            measures.append((weighted if weigh else (a + b) / 2).alias(m))
        return F.struct(F.lit(name).alias("class"), *measures, support.alias("support"))

    return lines.select(
        F.inline(
            F.array("a", "b", mean("macro avg", weigh=False), mean("weighted avg", weigh=True))
        )
    )


def score_curve(scored, by=()):
    """Running counts over distinct scores from the highest down, per ``by`` group.

    Columns: ``probability, n, pos, cum_n, cum_pos, total_n, total_pos``.
    """
    by = list(by)
    groups = scored.groupBy(*by, "probability").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("pos")
    )
    order = [*[F.col(c) for c in by], -F.col("probability")]
    sums = {"cum_n": "n", "cum_pos": "pos"}
    if not by:
        return running_sums(
            groups, order, sums, totals={"total_n": "cum_n", "total_pos": "cum_pos"}
        )
    running = running_sums(groups, order, sums)
    sizes = running.groupBy(*by).agg(
        F.min(F.col("cum_n") - F.col("n")).alias("_base_n"),
        F.min(F.col("cum_pos") - F.col("pos")).alias("_base_pos"),
        F.sum("n").alias("total_n"),
        F.sum("pos").alias("total_pos"),
    )
    # One row per fold or the like.
    return running.join(F.broadcast(sizes), by).select(
        *by,
        "probability",
        "n",
        "pos",
        (F.col("cum_n") - F.col("_base_n")).alias("cum_n"),
        (F.col("cum_pos") - F.col("_base_pos")).alias("cum_pos"),
        "total_n",
        "total_pos",
    )


def _ranking_sums():
    # Products are taken as doubles: the number of pairs of a large set does not fit a bigint.
    n, pos, p = F.col("n"), F.col("pos"), F.col("probability")
    return [
        F.sum((n - pos).cast("double") * (F.col("cum_pos") - pos / 2)).alias("won"),
        F.sum(pos * (F.col("cum_pos") / F.col("cum_n"))).alias("gained"),
        F.sum(pos * F.pow(1 - p, 2) + (n - pos) * F.pow(p, 2)).alias("squares"),
        F.max("total_n").alias("total_n"),
        F.max("total_pos").alias("total_pos"),
    ]


def _ranking_columns():
    total_n, total_pos = F.col("total_n").cast("double"), F.col("total_pos").cast("double")
    return [
        F.try_divide(F.col("won"), total_pos * (total_n - total_pos)).alias("roc_auc"),
        F.try_divide(F.col("gained"), total_pos).alias("average_precision"),
        (F.col("squares") / total_n).alias("brier_score"),
    ]


def ranking_metrics(curve, by=()):
    """ROC AUC (ties count half), average precision and Brier score of a score curve.

    AUC is null when a class is missing.
    """
    return curve.groupBy(*by).agg(*_ranking_sums()).select(*by, *_ranking_columns())


def evaluation_metrics(scored, threshold=0.5):
    """Accuracy, precision, recall, F1, ROC AUC, average precision and Brier score.

    All come from one aggregate over the score curve, so the scored set is read once.
    """
    reached = F.col("probability") >= F.lit(threshold)
    sums = score_curve(scored).agg(
        F.sum(F.when(reached, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(reached, F.col("n") - F.col("pos")).otherwise(0)).alias("fp"),
        *_ranking_sums(),
    )
    tp, fp = F.col("tp"), F.col("fp")
    fn = F.col("total_pos") - tp
    return sums.select(
        ratio(F.col("total_n") - fp - fn, F.col("total_n")).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, F.col("total_pos")).alias("recall"),
        _f1(tp, fp, fn).alias("f1_score"),
        *_ranking_columns(),
    )


def _point(spark, **values):
    return spark.range(1).select(
        F.lit(None).cast("double").alias("threshold"),
        *[F.lit(v).alias(name) for name, v in values.items()],
    )


def _roc(curve):
    negatives = F.col("total_n") - F.col("total_pos")
    return curve.select(
        F.col("probability").alias("threshold"),
        ratio(F.col("cum_n") - F.col("cum_pos"), negatives).alias("fpr"),
        ratio(F.col("cum_pos"), F.col("total_pos")).alias("tpr"),
    )


def _pr(curve):
    return curve.select(
        F.col("probability").alias("threshold"),
        ratio(F.col("cum_pos"), F.col("cum_n")).alias("precision"),
        ratio(F.col("cum_pos"), F.col("total_pos")).alias("recall"),
    )


def roc_points(curve):
    """A point per distinct score, and the origin, which has no threshold."""
    return _roc(curve).unionByName(_point(curve.sparkSession, fpr=0.0, tpr=0.0))


def pr_points(curve):
    """A point per distinct score, and the end point (recall 0, precision 1)."""
    return _pr(curve).unionByName(_point(curve.sparkSession, precision=1.0, recall=0.0))


def best_f1_on_curve(curve):
    """The threshold of highest F1 on the precision-recall curve; the lowest one wins ties."""
    p, r = F.col("precision"), F.col("recall")
    scored = _pr(curve).select("threshold", (2 * p * r / (p + r + PR_EPSILON)).alias("f1_score"))
    return scored.orderBy(F.desc(F.round("f1_score", 12)), "threshold").limit(1)


def best_youden(curve):
    """The threshold of highest TPR - FPR; the highest one wins ties."""
    scored = _roc(curve).select("threshold", (F.col("tpr") - F.col("fpr")).alias("youden_j"))
    return scored.orderBy(F.desc(F.round("youden_j", 12)), F.desc("threshold")).limit(1)


def calibration(scored, bins=10):
    """Mean score and share of positives in uniform bins; a score on an edge goes below."""
    edges = [i / bins for i in range(1, bins)]
    p = F.col("probability")
    bin_number = sum(((p > F.lit(edge)).cast("int") for edge in edges), F.lit(0))
    return scored.groupBy(bin_number.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(p).alias("mean_predicted"),
        F.avg("label").alias("fraction_positive"),
    )


def threshold_sweep(scored, beta=1.0):
    """Precision, recall, F-beta and two J columns at the 99 thresholds 0.01 to 0.99.

    Each row is counted once, in the bucket between two thresholds; the sums above each
    threshold then run over those 100 buckets.  ``precision_recall_j`` is recall + precision
    - 1 and ``youden_j`` is TPR - FPR.
    """
    buckets = Bucketizer(
        splits=[-float("inf"), *THRESHOLDS, float("inf")],
        inputCol="probability",
        outputCol="bucket",
    )
    counted = (
        buckets.transform(scored.select("label", F.col("probability").cast("double")))
        .groupBy(F.col("bucket").cast("bigint").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    )
    # 100 rows whatever the data, so a window without partitions is safe.
    all_buckets = scored.sparkSession.range(len(THRESHOLDS) + 1).withColumnRenamed("id", "bucket")
    above = Window.orderBy(F.desc("bucket"))
    whole = Window.partitionBy()
    n, pos = F.coalesce("n", F.lit(0)), F.coalesce("pos", F.lit(0))
    sums = all_buckets.join(counted, "bucket", "left").select(
        "bucket",
        F.sum(n).over(above).alias("hits"),
        F.sum(pos).over(above).alias("tp"),
        F.sum(n).over(whole).alias("total_n"),
        F.sum(pos).over(whole).alias("total_pos"),
    )
    tp, fp = F.col("tp"), F.col("hits") - F.col("tp")
    negatives = F.col("total_n") - F.col("total_pos")
    rates = sums.where(F.col("bucket") > 0).select(
        F.get(F.array(*[F.lit(t) for t in THRESHOLDS]), (F.col("bucket") - 1).cast("int")).alias(
            "threshold"
        ),
        ratio(tp, F.col("hits")).alias("precision"),
        ratio(tp, F.col("total_pos")).alias("recall"),
        _f1(tp, fp, F.col("total_pos") - tp).alias("f1"),
        ratio(fp, negatives).alias("fpr"),
    )
    p, r = F.col("precision"), F.col("recall")
    f_beta = (1 + beta**2) * p * r / (beta**2 * p + r + F_BETA_EPSILON)
    return rates.select(
        "threshold",
        "precision",
        "recall",
        (F.col("f1") if beta == 1.0 else f_beta).alias("f_score"),
        (r + p - 1).alias("precision_recall_j"),
        (r - F.col("fpr")).alias("youden_j"),
    )


def best_thresholds(scored, metrics=tuple(SWEEP_METRICS)):
    """``metric, threshold, score`` for each metric: the best of one sweep, the lowest on ties."""
    for metric in metrics:
        if metric not in SWEEP_METRICS:
            raise ValueError(f"Unknown metric {metric!r}; known: {sorted(SWEEP_METRICS)}")
    best = []
    for metric in metrics:
        column = F.col(SWEEP_METRICS[metric])
        found = F.max(
            F.struct(
                F.round(column, 12).alias("rounded"),
                (-F.col("threshold")).alias("minus"),
                "threshold",
                column.alias("score"),
            )
        )
        best.append(
            F.struct(
                F.lit(metric).alias("metric"), found["threshold"].alias("threshold"), found["score"].alias("score")
            )
        )
    return threshold_sweep(scored).agg(F.array(*best).alias("best")).select(F.inline("best"))


def best_threshold(scored, metric="f1"):
    """One row ``metric, threshold, score``: the best of the sweep, the lowest on ties."""
    return best_thresholds(scored, [metric])


def fold_metrics(scored, threshold=0.5):
    """ROC AUC, average precision and F1 at ``threshold`` per ``fold``."""
    ranking = ranking_metrics(score_curve(scored, by=["fold"]), by=["fold"])
    hit = F.col("probability") >= F.lit(threshold)
    f1 = scored.groupBy("fold").agg(
        ratio(
            2 * F.count_if(hit & (F.col("label") == 1)),
            F.count_if(hit) + F.count_if(F.col("label") == 1),
        ).alias("f1_score")
    )
    return ranking.drop("brier_score").join(f1, "fold")


def fold_summary(per_fold):
    """Mean and population standard deviation of the fold metrics."""
    metrics = ["roc_auc", "average_precision", "f1_score"]
    return per_fold.agg(
        *[F.avg(m).alias(f"mean_{m}") for m in metrics],
        *[F.stddev_pop(m).alias(f"std_{m}") for m in metrics],
    )
