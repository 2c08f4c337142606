"""Registered queries on a scored set."""

from cartlens.operators import classification as C
from cartlens.operators import lift as L
from cartlens.operators.splits import stratified_folds
from cartlens.plans.scoring import with_decision
from cartlens.registry.base import features, register, rounded, scored

_COUNTS = """(SELECT
  CAST(count(*) FILTER (WHERE probability >= 0.5 AND label = 1) AS DOUBLE) AS tp,
  CAST(count(*) FILTER (WHERE probability >= 0.5 AND label = 0) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (WHERE probability < 0.5 AND label = 1) AS DOUBLE) AS fn,
  CAST(count(*) FILTER (WHERE probability < 0.5 AND label = 0) AS DOUBLE) AS tn,
  avg(pow(probability - label, 2)) AS brier FROM scored)"""
_AUC = """(SELECT sum((n - pos) * (cum_pos - pos / CAST(2 AS DOUBLE)))
  / (max(total_pos) * CAST(max(total_n) - max(total_pos) AS DOUBLE)) FROM curve)"""
_AP = """(SELECT sum(pos * (cum_pos / CAST(cum_n AS DOUBLE))) / max(total_pos) FROM curve)"""


@register(
    """SELECT label, CAST(probability >= 0.5 AS INTEGER) AS prediction, count(*) AS n
FROM scored GROUP BY 1, 2""",
    ["scored"],
)
def confusion_matrix(spark, sf_dir):
    return C.confusion_matrix(scored(spark, sf_dir))


@register(
    f"""SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
  round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1_score, round(brier, 6) AS brier_score
FROM {_COUNTS}""",
    ["scored"],
)
def threshold_metrics(spark, sf_dir):
    return rounded(C.threshold_metrics(scored(spark, sf_dir)))


@register(
    f"""WITH c AS {_COUNTS}, classes AS (
  SELECT '0' AS class, tn / (tn + fn) AS p, tn / (tn + fp) AS r, 2 * tn / (2 * tn + fn + fp) AS f,
    tn + fp AS support FROM c
  UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM c)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score,
  CAST(support AS BIGINT) AS support FROM classes
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6),
  CAST(sum(support) AS BIGINT) FROM classes
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6),
  round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM classes""",
    ["scored"],
)
def classification_report(spark, sf_dir):
    return rounded(C.classification_report(scored(spark, sf_dir)))


@register(
    """SELECT round(sum(CASE WHEN a.probability > b.probability THEN 1.0
    WHEN a.probability = b.probability THEN 0.5 ELSE 0.0 END * a.n * b.n)
  / (sum(a.n * b.n)), 6) AS roc_auc
FROM (SELECT probability, CAST(count(*) AS DOUBLE) AS n FROM scored WHERE label = 1
    GROUP BY 1) a,
  (SELECT probability, CAST(count(*) AS DOUBLE) AS n FROM scored WHERE label = 0 GROUP BY 1) b""",
    ["scored"],
)
def roc_auc(spark, sf_dir):
    return rounded(C.ranking_metrics(C.score_curve(scored(spark, sf_dir))).select("roc_auc"))


@register(f"SELECT round({_AP}, 6) AS average_precision", ["curve"])
def average_precision(spark, sf_dir):
    curve = C.score_curve(scored(spark, sf_dir))
    return rounded(C.ranking_metrics(curve).select("average_precision"))


@register("SELECT round(avg(pow(probability - label, 2)), 6) AS brier_score FROM scored", ["scored"])
def brier_score(spark, sf_dir):
    return rounded(C.brier_score(scored(spark, sf_dir)))


@register(
    f"""SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
  round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1_score, round({_AUC}, 6) AS roc_auc,
  round({_AP}, 6) AS average_precision, round(brier, 6) AS brier_score
FROM {_COUNTS}""",
    ["scored", "curve"],
)
def evaluation_metrics(spark, sf_dir):
    return rounded(C.evaluation_metrics(scored(spark, sf_dir)))


_ROC = """SELECT probability AS threshold,
    (cum_n - cum_pos) / CAST(total_n - total_pos AS DOUBLE) AS fpr,
    cum_pos / CAST(total_pos AS DOUBLE) AS tpr FROM curve"""
_PR = """SELECT probability AS threshold, cum_pos / CAST(cum_n AS DOUBLE) AS precision,
    cum_pos / CAST(total_pos AS DOUBLE) AS recall FROM curve"""


@register(
    f"""SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM ({_ROC})
UNION ALL SELECT NULL, 0, 0""",
    ["curve"],
)
def roc_curve(spark, sf_dir):
    return rounded(C.roc_points(C.score_curve(scored(spark, sf_dir))))


@register(
    f"""SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall
FROM ({_PR}) UNION ALL SELECT NULL, 1, 0""",
    ["curve"],
)
def precision_recall_curve(spark, sf_dir):
    return rounded(C.pr_points(C.score_curve(scored(spark, sf_dir))))


@register(
    """SELECT CAST(greatest((CAST(round(probability * 1000) AS BIGINT) + 99) // 100 - 1, 0)
    AS INTEGER) AS bin,
  count(*) AS n, round(avg(probability), 6) AS mean_predicted,
  round(avg(label), 6) AS fraction_positive
FROM scored GROUP BY 1""",
    ["scored"],
)
def calibration(spark, sf_dir):
    return rounded(C.calibration(scored(spark, sf_dir)))


@register(
    """SELECT round(threshold, 2) AS threshold, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f_score, 6) AS f_score,
  round(recall + precision - 1, 6) + 0.0 AS precision_recall_j, round(youden_j, 6) + 0.0 AS youden_j
FROM sweep""",
    ["sweep"],
)
def threshold_sweep(spark, sf_dir):
    return rounded(C.threshold_sweep(scored(spark, sf_dir)), threshold=2)


@register(
    """SELECT round(threshold, 2) AS threshold,
  round(5 * precision * recall / (4 * precision + recall + 1e-10), 6) AS f_score FROM sweep""",
    ["sweep"],
)
def threshold_sweep_f2(spark, sf_dir):
    sweep = C.threshold_sweep(scored(spark, sf_dir), beta=2.0)
    return rounded(sweep.select("threshold", "f_score"), threshold=2)


_BEST = [
    f"(SELECT '{metric}' AS metric, round(threshold, 2) AS threshold, round({column}, 6) AS score "
    f"FROM sweep ORDER BY round({column}, 12) DESC, threshold LIMIT 1)"
    for metric, column in C.SWEEP_METRICS.items()
]


@register("\nUNION ALL ".join(_BEST), ["sweep"])
def best_thresholds(spark, sf_dir):
    return rounded(C.best_thresholds(scored(spark, sf_dir)), threshold=2)


@register(
    f"""SELECT threshold, round(f1, 6) AS f1_score
FROM (SELECT threshold, 2 * precision * recall / (precision + recall + 1e-9) AS f1 FROM ({_PR}))
ORDER BY round(f1, 12) DESC, threshold LIMIT 1""",
    ["curve"],
)
def best_f1_on_curve(spark, sf_dir):
    return rounded(C.best_f1_on_curve(C.score_curve(scored(spark, sf_dir))))


@register(
    f"""SELECT threshold, round(tpr - fpr, 6) AS youden_j FROM ({_ROC})
ORDER BY round(tpr - fpr, 12) DESC, threshold DESC LIMIT 1""",
    ["curve"],
)
def best_youden(spark, sf_dir):
    return rounded(C.best_youden(C.score_curve(scored(spark, sf_dir))))


@register(
    """SELECT probability, cum_n, cum_pos, round(cum_n / CAST(total_n AS DOUBLE), 6) AS percentile,
  round(cum_pos / CAST(total_pos AS DOUBLE), 6) AS gain,
  round(cum_pos / CAST(total_pos AS DOUBLE) / (cum_n / CAST(total_n AS DOUBLE)), 6) AS lift
FROM curve""",
    ["curve"],
)
def gain_curve(spark, sf_dir):
    return rounded(L.gain_curve(C.score_curve(scored(spark, sf_dir))))


def _lift_sql(cuts):
    return f"""SELECT share, n_rows, n_positive, round(gain, 6) AS gain,
  round(CASE WHEN n_rows > 0 THEN gain * total / n_rows ELSE 0 END, 6) AS lift
FROM (SELECT share, cut AS n_rows, total, CAST(sum(label) FILTER (WHERE place <= cut) AS BIGINT)
    AS n_positive, sum(label) FILTER (WHERE place <= cut) / CAST(sum(label) AS DOUBLE) AS gain
  FROM (SELECT label, row_number() OVER (ORDER BY probability DESC, row_id) AS place FROM scored),
    (SELECT share, total, {cuts} GROUP BY share, cut, total)"""


_TOTAL = "(SELECT count(*) AS total FROM scored)"


@register(
    _lift_sql(
        "CAST(floor(CAST(i AS DOUBLE) * total / 10) AS BIGINT) AS cut FROM (SELECT i, i / CAST(10 AS "
        f"DOUBLE) AS share FROM generate_series(1, 10) g(i)), {_TOTAL})"
    ),
    ["scored"],
)
def lift_by_bins(spark, sf_dir):
    return rounded(L.lift_by_bins(scored(spark, sf_dir)))


@register(
    _lift_sql(
        "CAST(floor(share * total) AS BIGINT) AS cut FROM (SELECT CAST(unnest([0.05, 0.1, 0.2, 0.3, "
        f"0.5]) AS DOUBLE) AS share), {_TOTAL})"
    ),
    ["scored"],
)
def lift_at_percentiles(spark, sf_dir):
    return rounded(L.lift_at_percentiles(scored(spark, sf_dir)))


@register(
    """SELECT row_id, probability, CAST(probability >= 0.6 AS INTEGER) AS prediction,
  CASE WHEN probability < 0.3 OR probability > 0.7 THEN 'high'
    WHEN probability < 0.4 OR probability > 0.6 THEN 'medium' ELSE 'low' END AS confidence,
  CAST(0.6 AS DOUBLE) AS threshold FROM scored""",
    ["scored"],
)
def scored_decisions(spark, sf_dir):
    return with_decision(scored(spark, sf_dir).select("row_id", "probability"), 0.6)


@register(
    """SELECT row_id, s.price, hour, total_clicks, label, probability FROM scored s
JOIN (SELECT row_id, total_clicks FROM features) USING (row_id)""",
    ["scored", "features"],
)
def features_with_scores(spark, sf_dir):
    scores = scored(spark, sf_dir).select("row_id", "label", "probability")
    frame = features(spark, sf_dir).select("row_id", "price", "hour", "total_clicks")
    return frame.join(scores, "row_id")


_FOLDS = """folds AS (SELECT rank % 5 AS fold, label, probability FROM class_ranks),
groups AS (SELECT fold, probability, CAST(count(*) AS DOUBLE) AS n,
    CAST(sum(label) AS DOUBLE) AS pos FROM folds GROUP BY 1, 2),
running AS (SELECT *, sum(n) OVER w AS cum_n, sum(pos) OVER w AS cum_pos FROM groups
  WINDOW w AS (PARTITION BY fold ORDER BY probability DESC)),
per_fold AS (SELECT fold, sum((n - pos) * (cum_pos - pos / 2)) / (sum(pos) * sum(n - pos))
    AS roc_auc, sum(pos * cum_pos / cum_n) / sum(pos) AS average_precision,
    2 * sum(pos) FILTER (WHERE probability >= 0.5)
      / (sum(n) FILTER (WHERE probability >= 0.5) + sum(pos)) AS f1_score
  FROM running GROUP BY fold)"""


def _with_folds(sql):
    # The class ranks come first in the list of tables, so these follow them.
    return f"WITH {_FOLDS}\n{sql}"


@register(
    _with_folds(
        """SELECT CAST(fold AS INTEGER) AS fold, round(roc_auc, 6) AS roc_auc,
  round(average_precision, 6) AS average_precision, round(f1_score, 6) AS f1_score
FROM per_fold"""
    ),
    ["class_ranks"],
)
def fold_metrics(spark, sf_dir):
    folded = stratified_folds(scored(spark, sf_dir), target="label")
    return rounded(C.fold_metrics(folded))


@register(
    _with_folds(
        "SELECT "
        + ", ".join(
            f"round(avg({m}), 6) AS mean_{m}, round(stddev_pop({m}), 6) AS std_{m}"
            for m in ("roc_auc", "average_precision", "f1_score")
        )
        + " FROM per_fold"
    ),
    ["class_ranks"],
)
def fold_summary(spark, sf_dir):
    folded = stratified_folds(scored(spark, sf_dir), target="label")
    return rounded(C.fold_summary(C.fold_metrics(folded)))
