"""Checked siblings of queries that depend on a fitted model.

What comes after a model is fed arithmetic in place of the model, so that SQL can follow it.
What a fit returns is checked by invariants that SQL can state without the fit: which rows it
has, and that each of them, or the whole, keeps its promise.
"""

from pyspark.sql import functions as F

from cartlens.operators import attribution as A
from cartlens.operators import behavior as B
from cartlens.operators import score_sketch as K
from cartlens.operators import segments as G
from cartlens.operators.cleaning import require_columns
from cartlens.plans import evaluation, scoring
from cartlens.plans.model_frame import model_frame as build_model_frame
from cartlens.registry import modelling as M
from cartlens.registry.base import ORACLES, clicks, register, rounded, scored
from cartlens.registry.events import _FRAME_SQL
from cartlens.registry.evaluation import _PR, _ROC
from cartlens.schema import RFM_COLUMNS, SCORING_INPUT
from cartlens.session import materialise, scratch_path
from cartlens.sources import artifacts
from cartlens.streaming.scoring import read_requests

NAMES = ["price", "hour", "constant"]
# The three contributions of a row, as Spark and as SQL expressions alike.
CONTRIBUTIONS = [
    "row_id * 7919 % 1000 / CAST(1000 AS DOUBLE) - CAST(0.4 AS DOUBLE)",
    "row_id * 104729 % 500 / CAST(1000 AS DOUBLE) - CAST(0.3 AS DOUBLE)",
    "CAST(0.05 AS DOUBLE)",
]
VALUES = ["price", "CAST(hour AS DOUBLE)", "CAST(1 AS DOUBLE)"]
_TALL = " UNION ALL ".join(
    f"SELECT row_id, '{name}' AS feature, {value} AS value, {contribution} AS contribution FROM scored"
    for name, value, contribution in zip(NAMES, VALUES, CONTRIBUTIONS)
)


def explained(spark, sf_dir):
    """Contributions that are arithmetic in ``row_id``, in the place of a model's."""
    return scored(spark, sf_dir).select(
        "row_id",
        F.lit(0.25).alias("base"),
        F.array(*[F.expr(c) for c in CONTRIBUTIONS]).alias("contributions"),
        F.array(*[F.expr(v) for v in VALUES]).alias("values"),
    )


@register(
    f"""SELECT feature, round(avg(abs(contribution)), 6) AS importance FROM ({_TALL})
GROUP BY feature ORDER BY 2 DESC, 1 LIMIT 10""",
    ["scored"],
)
def given_attribution_importance(spark, sf_dir):
    return rounded(A.global_importance(explained(spark, sf_dir), NAMES, 10))


@register(
    f"""SELECT row_id, feature, round(value, 6) AS value, round(contribution, 6) AS contribution
FROM ({_TALL})""",
    ["scored"],
)
def given_attribution_beeswarm(spark, sf_dir):
    return rounded(A.beeswarm(explained(spark, sf_dir), NAMES))


@register(
    f"""SELECT row_id, feature, round(value, 6) AS value, round(contribution, 6) AS contribution
FROM ({_TALL}) WHERE row_id = (SELECT min(row_id) FROM scored)""",
    ["scored"],
)
def given_attribution_of_one_row(spark, sf_dir):
    rows = explained(spark, sf_dir)
    return rounded(A.row_breakdown(rows, NAMES, rows.agg(F.min("row_id")).scalar()))


@register(
    f"""SELECT 'price' AS feature, round(quantile_cont({CONTRIBUTIONS[0]}, 0.95), 6) AS contribution
FROM scored""",
    ["scored"],
)
def given_price_attribution_p95(spark, sf_dir):
    return rounded(A.contribution_quantile(explained(spark, sf_dir), NAMES))


@register(
    f"""SELECT round({CONTRIBUTIONS[0]}, 6) AS price, round({CONTRIBUTIONS[1]}, 6) AS hour
FROM scored""",
    ["scored"],
)
def given_top_attribution_columns(spark, sf_dir):
    """The two strongest columns, written as CSV and read again."""
    path = scratch_path(spark, "given-top-attributions")
    top = A.top_attribution_columns(explained(spark, sf_dir), NAMES, 2)
    artifacts.write_csv(top, path)
    return rounded(artifacts.read_csv(spark, path, top.schema))


@register(
    f"""SELECT 'confusion' AS part, CAST(NULL AS DOUBLE) AS threshold, 'actual ' || label ||
    ' predicted ' || CAST(probability >= 0.5 AS INTEGER) AS measure, CAST(count(*) AS DOUBLE) AS value
  FROM scored GROUP BY 3
UNION ALL SELECT 'metrics', NULL, measure, value FROM (UNPIVOT ({ORACLES['evaluation_metrics']})
  ON COLUMNS(*) INTO NAME measure VALUE value)
UNION ALL SELECT 'roc', threshold, measure, round(value, 6) FROM (UNPIVOT (
    FROM ({_ROC}) UNION ALL SELECT NULL, 0, 0) ON fpr, tpr INTO NAME measure VALUE value)
UNION ALL SELECT 'precision_recall', threshold, measure, round(value, 6) FROM (UNPIVOT (
    FROM ({_PR}) UNION ALL SELECT NULL, 1, 0) ON precision, recall INTO NAME measure VALUE value)""",
    ["scored", "curve"],
)
def given_test_set_evaluation(spark, sf_dir):
    """All four tables of the evaluation bundle on the stand-in score."""
    scores = materialise(scored(spark, sf_dir), "given-scores")
    return rounded(M.tall_bundle(evaluation.evaluation_bundle(scores)))


@register(
    """SELECT CAST(user_id % 4 AS INTEGER) AS rfm_segment, count(*) AS n_events,
  count(DISTINCT user_id) AS n_users FROM clicks GROUP BY 1""",
    ["clicks"],
)
def given_segment_sizes(spark, sf_dir):
    segment = F.pmod("user_id", F.lit(4)).cast("int")
    return G.segment_sizes(clicks(spark, sf_dir).withColumn("rfm_segment", segment))


@register(
    "SELECT user_id, "
    + ", ".join(
        f"round((CAST({c} AS DOUBLE) - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 4) + 0.0 AS {c}_z"
        for c in RFM_COLUMNS
    )
    + ", CAST(user_id % 4 AS INTEGER) AS rfm_segment FROM rfm",
    ["rfm"],
)
def given_rfm_scatter(spark, sf_dir):
    segment = F.pmod("user_id", F.lit(4)).cast("int")
    return rounded(G.rfm_scatter(B.rfm(clicks(spark, sf_dir)).withColumn("rfm_segment", segment)), 4)


@register(_FRAME_SQL + ", target FROM features", ["features"])
def model_frame_columns(spark, sf_dir):
    """The model frame without the segment, which a fit decides."""
    frame = build_model_frame(clicks(spark, sf_dir)).drop("rfm_segment")
    return rounded(frame, monetary=4)


@register(
    """SELECT user_id, true AS has_segment, true AS segments_rise FROM rfm""",
    ["rfm"],
)
def rfm_segments_hold(spark, sf_dir):
    """Every user once, in a segment from 0 to 3; segments rise with mean monetary value."""
    users = materialise(G.rfm_segments(B.rfm(clicks(spark, sf_dir))), "held-segments")
    means = users.groupBy("rfm_segment").agg(F.avg("monetary").alias("m"))
    rise = means.agg(F.sort_array(F.collect_list(F.struct("rfm_segment", "m"))).alias("s")).select(
        F.expr("sort_array(transform(s, x -> x.m)) = transform(s, x -> x.m)").alias("rise")
    )
    return users.select(
        "user_id",
        F.col("rfm_segment").between(0, 3).alias("has_segment"),
        rise.scalar().alias("segments_rise"),
    )


_SPLIT = ORACLES["stratified_split"]


def _rows_of(part):
    return f"SELECT row_id FROM ({_SPLIT}) WHERE split = '{part}'"


@register(f"SELECT row_id, true AS in_range FROM ({_rows_of('test')})")
def boosted_tree_scores_hold(spark, sf_dir):
    """Every test row once, with a probability."""
    t = M.trained(spark, sf_dir)
    scores = M.training.scored_set(t.model, t.test)
    return scores.select("row_id", F.col("probability").between(0, 1).alias("in_range"))


@register(f"SELECT row_id, true AS adds_up FROM ({_rows_of('validation')})")
def attributions_hold(spark, sf_dir):
    """Base and contributions of every validation row add up to its log-odds."""
    t = M.trained(spark, sf_dir)
    odds = M.training.scored_set(t.model, t.validation).select(
        "row_id", F.log(F.col("probability") / (1 - F.col("probability"))).alias("odds")
    )
    total = F.expr("base + aggregate(contributions, 0D, (s, c) -> s + c)")
    sums = A.attributions(t.model, t.validation).select("row_id", total.alias("total"))
    return sums.join(odds, "row_id").select(
        "row_id", (F.abs(F.col("total") - F.col("odds")) < 1e-6).alias("adds_up")
    )


@register("SELECT true AS sums_to_one, true AS all_positive")
def feature_importance_holds(spark, sf_dir):
    t = M.trained(spark, sf_dir)
    return M.training.feature_importance(t.model, t.train).agg(
        (F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"),
        (F.min("importance") >= 0).alias("all_positive"),
    )


@register(
    f"SELECT row_id, true AS in_range, CAST(5 AS BIGINT) AS folds FROM ({_rows_of('train')})"
)
def out_of_fold_scores_hold(spark, sf_dir):
    """Every training row once, with a probability, over five folds."""
    scores = M.folds(spark, sf_dir)["scores"]
    folds = scores.agg(F.count_distinct("fold")).scalar()
    return scores.select("row_id", F.col("probability").between(0, 1).alias("in_range"), folds.alias("folds"))


@register("SELECT true AS threshold_is_best, CAST(5 AS BIGINT) AS folds, true AS trees_in_range")
def full_evaluation_holds(spark, sf_dir):
    """The summary repeats the best threshold of the scores and counts trees within bounds."""
    found = M.folds(spark, sf_dir)
    best = M.C.best_threshold(found["scores"])
    folds = found["folds"].agg(F.count(F.lit(1))).scalar()
    return found["summary"].select(
        (F.col("optimal_threshold") == best.select("threshold").scalar()).alias("threshold_is_best"),
        folds.alias("folds"),
        F.col("mean_trees").between(1, 10).alias("trees_in_range"),
    )


@register(
    """SELECT 'grid' AS search, CAST(2 AS BIGINT) AS settings, true AS in_range
UNION ALL SELECT 'random', 20, true"""
)
def searches_hold(spark, sf_dir):
    """Both searches tried all their settings, each once, and scored them."""
    parts = []
    for name, tried in (("grid", M.grid_tried), ("random", M.random_tried)):
        table = tried(spark, sf_dir)
        keys = [c for c in table.columns if c != "mean_auc"]
        parts.append(
            table.agg(
                F.lit(name).alias("search"),
                F.count_distinct(*keys).alias("settings"),
                F.min(F.col("mean_auc").between(0, 1)).alias("in_range"),
            )
        )
    return parts[0].unionByName(parts[1])


@register("SELECT true AS fewer_trees, true AS same_trees, true AS in_range")
def early_stopping_holds(spark, sf_dir):
    """Fewer trees than rounds, and they are the first trees of the model of all rounds."""
    rows = M.early_stopping(spark, sf_dir)
    trees = {k: F.max(F.when(F.col("patience") == k, F.col("n_trees"))) for k in (0, 3)}
    full, stopped = (m.stages[-1] for m in M.stopped_models(spark, sf_dir).values())
    plain = [t.toDebugString.split("\n", 1)[1] for t in full.trees]
    kept = [t.toDebugString.split("\n", 1)[1] for t in stopped.trees]
    return rows.agg(
        (trees[3] < trees[0]).alias("fewer_trees"),
        F.lit(kept == plain[: len(kept)]).alias("same_trees"),
        F.min(F.col("roc_auc").between(0, 1)).alias("in_range"),
    )


@register(f"SELECT row_id, true AS in_range, true AS trees_in_range FROM ({_rows_of('test')})")
def default_model_scores_hold(spark, sf_dir):
    """Every test row once, with a probability, by at most the default number of trees."""
    trees = M.default_model(spark, sf_dir).stages[-1].getNumTrees
    return M.default_model_scores(spark, sf_dir).select(
        "row_id",
        F.col("probability").between(0, 1).alias("in_range"),
        F.lit(1 <= trees <= M.training.DEFAULTS["maxIter"]).alias("trees_in_range"),
    )


@register("SELECT CAST(4 AS BIGINT) AS settings, true AS same, true AS in_range")
def resumed_search_holds(spark, sf_dir):
    """The search that was read from the journal found what the first one had found."""
    first, second = M.resumed_tried(spark, sf_dir)
    return M.resumed_search(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("settings"),
        F.lit(first == second).alias("same"),
        F.min(F.col("mean_auc").between(0, 1)).alias("in_range"),
    )


@register(
    """SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS pos, true AS auc_within, true AS ap_within,
  true AS errors_small, true AS bins_bounded FROM scored""",
    ["scored"],
)
def sketched_ranking_holds(spark, sf_dir):
    """Bounded curve of the scores: all rows are in it, and the exact metrics within its errors."""
    scores = scored(spark, sf_dir)
    curve = materialise(K.binned_curve(K.score_bins(scores, 100)), "binned-curve")
    exact = M.C.ranking_metrics(M.C.score_curve(scores)).select(
        F.col("roc_auc").alias("auc"), F.col("average_precision").alias("ap")
    )
    totals = curve.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))

    def within(found, value, error):
        return F.abs(F.col(found) - F.col(value)) <= F.col(error) + 1e-12

    found = K.bounded_ranking_metrics(curve).crossJoin(exact).crossJoin(totals)  # single rows
    return found.select(
        "n",
        "pos",
        within("roc_auc", "auc", "roc_auc_error").alias("auc_within"),
        within("average_precision", "ap", "average_precision_error").alias("ap_within"),
        (F.greatest("roc_auc_error", "average_precision_error") < 0.05).alias("errors_small"),
        (F.col("bins") <= 201).alias("bins_bounded"),
    )


@register(
    f"SELECT row_id, true AS decided, true AS same FROM ({_rows_of('test')}) JOIN scored USING (row_id) WHERE price > 0",
    ["scored"],
)
def stored_model_scores_hold(spark, sf_dir):
    """Scores of the stored model: those of the model before it was stored, and class and band
    follow the probability and its threshold."""
    t = M.trained(spark, sf_dir)
    p, threshold = F.col("probability"), F.col("threshold")
    band = F.when((p < 0.3) | (p > 0.7), "high").when((p < 0.4) | (p > 0.6), "medium")
    before = M.rounded(scoring.score(t.model, t.test)).select("row_id", F.col("probability").alias("_p"))
    return M.stored_model_scores(spark, sf_dir).join(before, "row_id").select(
        "row_id",
        (
            p.between(0, 1)
            & (F.col("prediction") == (p >= threshold).cast("int"))
            & (F.col("confidence") == F.coalesce(band, F.lit("low")))
        ).alias("decided"),
        (p == F.col("_p")).alias("same"),
    )


@register(f"SELECT row_id, true AS in_range FROM ({_rows_of('test')}) JOIN scored USING (row_id) WHERE price > 0", ["scored"])
def batch_scores_hold(spark, sf_dir):
    t = M.trained(spark, sf_dir)
    return scoring.score_batch(t.model, t.test).select(
        "row_id", F.col("probability").between(0, 1).alias("in_range")
    )


@register("SELECT true AS complete")
def error_clusters_hold(spark, sf_dir):
    """The clusters together have as many errors as the validation rows."""
    t = M.trained(spark, sf_dir)
    scores = M.training.scored_set(t.model, t.validation)
    errors = M.E.misclassified(scores).agg(F.count(F.lit(1))).scalar()
    clusters = M.error_clusters(spark, sf_dir)
    return clusters.agg((F.coalesce(F.sum("n_errors"), F.lit(0)) == errors).alias("complete"))


@register("SELECT true AS in_range, CAST(3 AS INTEGER) AS drivers")
def recommendation_report_holds(spark, sf_dir):
    shares = [F.col(c).between(0, 1) for c in ("roc_auc", "precision", "recall")]
    return M.recommendation_report(spark, sf_dir).select(
        (shares[0] & shares[1] & shares[2]).alias("in_range"), F.size("top_drivers").alias("drivers")
    )


@register(
    "SELECT row_id, true AS scored FROM (" + _rows_of("test") + ") JOIN scored USING (row_id) WHERE price > 0",
    ["scored"],
)
def required_columns_and_rows(spark, sf_dir):
    """Raw events pass the column check, and the test rows of their model frame the batch check.

    Both refusals are plain errors and have unit tests.
    """
    events = require_columns(clicks(spark, sf_dir))
    t = M.trained(spark, sf_dir)
    batch = scoring.score_batch(t.model, t.test).select("row_id", F.col("prediction").isin(0, 1).alias("scored"))
    return batch.join(events.select("row_id"), "row_id", "left_semi")


@register(f"SELECT row_id, true AS same FROM ({_rows_of('test')}) JOIN scored USING (row_id) WHERE price > 0", ["scored"])
def stream_model_scores(spark, sf_dir):
    """The test rows as a stream of requests, scored by the model; equal to the batch scores."""
    t = M.trained(spark, sf_dir)
    path = scratch_path(spark, "requests")
    sent = t.test.withColumn("is_weekend", F.col("is_weekend") == 1)
    sent.select(*[F.col(f.name).cast(f.dataType) for f in SCORING_INPUT.fields]).write.parquet(path)
    streamed = M.run_stream(spark, scoring.score(t.model, read_requests(spark, path)), "streamed")
    batch = scoring.score(t.model, spark.read.schema(SCORING_INPUT).parquet(path))
    pairs = streamed.join(batch.select("row_id", F.col("probability").alias("p")), "row_id")
    return pairs.select("row_id", (F.abs(F.col("probability") - F.col("p")) < 1e-12).alias("same"))
