"""Registered queries on segments, models, attributions, stored artifacts and streams."""

from collections import namedtuple
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cartlens.functions.rules import quarantined_rows, raw_rules, valid_rows
from cartlens.operators import attribution as A
from cartlens.operators import behavior as B
from cartlens.operators import classification as C
from cartlens.operators import errors as E
from cartlens.operators import segments as G
from cartlens.operators.monitoring import monitoring_baseline
from cartlens.operators.splits import stratified_split
from cartlens.plans import evaluation, scoring, training
from cartlens.plans.model_frame import model_frame as build_model_frame
from cartlens.plans.report import recommendation_report as build_report
from cartlens.registry.base import (
    ORACLES,
    clicks,
    features,
    register,
    rounded,
    scored,
    stand_in_probability,
    with_time_text,
)
from cartlens.registry.events import EVENT_COLUMNS, _FRAME_SQL
from cartlens.schema import CLICKSTREAM, FEATURES, NUMERIC_FEATURES, TARGET
from cartlens.session import materialise, scratch_path
from cartlens.sources import artifacts
from cartlens.sources.clickstream import STAR_EVENTS, STAR_PARTS, adapt_events
from cartlens.streaming.scoring import read_part, read_requests, start_split, write_stream

# The model behind the queries: fewer and smaller trees than the defaults, for small tables.
LIGHT = {"maxIter": 20, "maxDepth": 3}

Trained = namedtuple("Trained", "frame train validation test model")
_trained = {}


def once(make):
    """Make a result once per session and folder; queries that share it do not fit again."""
    made = {}

    def kept(spark, sf_dir):
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in made:
            made[key] = make(spark, sf_dir)
        return made[key]

    return kept


def trained(spark, sf_dir):
    """Model frame, its three parts and a model; made once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _trained:
        frame = materialise(build_model_frame(clicks(spark, sf_dir)), "model-frame")
        split = materialise(stratified_split(frame), "split")
        train, validation, test = (
            split.where(F.col("split") == part).drop("split")
            for part in ("train", "validation", "test")
        )
        model = training.fit_model(train, **LIGHT)
        _trained[key] = Trained(frame, train, validation, test, model)
    return _trained[key]


@register()
def model_frame(spark, sf_dir):
    return rounded(build_model_frame(clicks(spark, sf_dir), encode=True), monetary=4)


@register()
def rfm_segments(spark, sf_dir):
    return rounded(G.rfm_segments(B.rfm(clicks(spark, sf_dir))), 4)


@register()
def segment_sizes(spark, sf_dir):
    events = clicks(spark, sf_dir)
    return G.segment_sizes(B.with_rfm(events, G.rfm_segments(B.rfm(events))))


@register()
def rfm_scatter(spark, sf_dir):
    users = G.rfm_segments(B.rfm(clicks(spark, sf_dir)))
    return rounded(G.rfm_scatter(users))


def _vectors_sql():
    lines = [
        f"SELECT row_id, '{c}' AS feature, round((CAST({c} AS DOUBLE) - avg({c}) OVER ()) / "
        f"stddev_pop({c}) OVER (), 4) + 0.0 AS value FROM features"
        for c in NUMERIC_FEATURES
    ]
    encoded = {"main_category": "main_category", "rfm_segment": "CAST(user_id % 4 AS VARCHAR)"}
    lines += [
        f"SELECT row_id, '{name}_is_' || v AS feature, CAST({source} = v AS INTEGER) + "
        f"CAST(0 AS DOUBLE) AS value FROM features, (SELECT DISTINCT {source} AS v FROM features)"
        for name, source in encoded.items()
    ]
    return "\nUNION ALL ".join(lines)


@register(_vectors_sql(), ["features"])
def feature_vectors(spark, sf_dir):
    segment = F.pmod("user_id", F.lit(4)).cast("int")
    frame = features(spark, sf_dir).withColumn("rfm_segment", segment)
    frame = materialise(frame, "features")
    vectors = training.feature_pipeline(frame).transform(frame)
    names = F.array(*[F.lit(n) for n in training.feature_names(vectors)])
    cells = F.arrays_zip(
        names.alias("feature"), vector_to_array("features").alias("value")
    )
    tall = vectors.select("row_id", F.inline(cells)).toDF("row_id", "feature", "value")
    return rounded(tall, 4)


@register(
    """SELECT row_id, target, round(CASE WHEN target = 1 THEN (SELECT
  count(*) FILTER (WHERE target = 0) / CAST(count(*) FILTER (WHERE target = 1) AS DOUBLE)
  FROM labelled) ELSE 1 END, 6) AS weight FROM labelled""",
    ["labelled"],
)
def class_weights(spark, sf_dir):
    carts = B.labelled_carts(clicks(spark, sf_dir)).select("row_id", "target")
    weighted = training.with_class_weight(carts)
    return rounded(weighted.withColumnRenamed(training.WEIGHT, "weight"))


@register()
def boosted_tree_scores(spark, sf_dir):
    t = trained(spark, sf_dir)
    return rounded(training.scored_set(t.model, t.test))


# Steps and trees so large that the loss on other rows rises within a few rounds.
OVERFIT = {"maxIter": 25, "maxDepth": 4, "stepSize": 0.8}


@once
def stopped_models(spark, sf_dir):
    """The model of all rounds, and the one that early stopping on the validation rows keeps."""
    t = trained(spark, sf_dir)
    full = training.fit_model(t.train, **OVERFIT)
    return {0: full, 3: training.fit_model(t.train, t.validation, 3, **OVERFIT)}


@register()
def early_stopping(spark, sf_dir):
    """Validation metrics and trees of a model fitted without and with early stopping."""
    t = trained(spark, sf_dir)
    rows = None
    for patience, model in stopped_models(spark, sf_dir).items():
        scores = training.scored_set(model, t.validation)
        found = C.ranking_metrics(C.score_curve(scores)).withColumns(
            {"patience": F.lit(patience), "n_trees": F.lit(model.stages[-1].getNumTrees)}
        )
        rows = found if rows is None else rows.unionByName(found)
    return rounded(rows)


@once
def default_model(spark, sf_dir):
    """A model of the library's default size, stopped early on the validation rows."""
    t = trained(spark, sf_dir)
    return training.fit_model(t.train, t.validation)


@register()
def default_model_scores(spark, sf_dir):
    """Test rows scored by a model of the default size: 100 trees of depth 5, patience 20."""
    return rounded(training.scored_set(default_model(spark, sf_dir), trained(spark, sf_dir).test))


@once
def resumed_tried(spark, sf_dir):
    """One search written to a journal, and once more from that journal."""
    t, journal = trained(spark, sf_dir), scratch_path(spark, "search-journal")
    job = dict(grid={"maxDepth": [2, 3], "stepSize": [0.1, 0.3]}, maxIter=5, journal=journal)
    return [training.search(t.train, **job)[1] for _ in range(2)]


@register()
def resumed_search(spark, sf_dir):
    """Four settings over three folds; read from the journal of a search that ended before."""
    return rounded(training.search_table(spark, resumed_tried(spark, sf_dir)[1]))


@once
def grid_tried(spark, sf_dir):
    t = trained(spark, sf_dir)
    _, tried = training.search(
        t.train, {"maxDepth": [2, 3]}, validation=t.validation, **{**LIGHT, "maxIter": 10}
    )
    return training.search_table(spark, tried)


@register()
def grid_search(spark, sf_dir):
    """A grid of its own: two depths with 10 trees instead of the default 216 settings."""
    return rounded(grid_tried(spark, sf_dir))


@once
def random_tried(spark, sf_dir):
    # Sixty fits, eight at a time: on few rows more partitions than one only cost tasks.
    _, tried = training.search(
        trained(spark, sf_dir).train, training.GRID, n_iter=training.DRAWS, least_parts=1
    )
    return training.search_table(spark, tried)


@register()
def random_search(spark, sf_dir):
    """The default draws and folds over the default grid, of 100 or 200 trees."""
    return rounded(random_tried(spark, sf_dir))


@once
def folds(spark, sf_dir):
    """Five folds as by default, with 10 trees of depth 3 and early stopping."""
    frame = trained(spark, sf_dir).train
    return evaluation.full_evaluation(frame, **{**LIGHT, "maxIter": 10})


@register()
def out_of_fold_scores(spark, sf_dir):
    return rounded(folds(spark, sf_dir)["scores"])


@register()
def full_evaluation(spark, sf_dir):
    return rounded(folds(spark, sf_dir)["summary"])


def tall_bundle(bundle):
    """All four tables of an evaluation bundle as one: ``part, threshold, measure, value``."""
    none = F.lit(None).cast("double")
    confusion = bundle["confusion"].select(
        F.lit("confusion").alias("part"),
        none.alias("threshold"),
        F.concat(F.lit("actual "), "label", F.lit(" predicted "), "prediction").alias("measure"),
        F.col("n").cast("double").alias("value"),
    )
    parts = [confusion]
    for name in ("metrics", "roc", "precision_recall"):
        frame = bundle[name]
        cells = F.array(
            *[
                F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value"))
                for c in frame.columns
                if c != "threshold"
            ]
        )
        threshold = F.col("threshold").cast("double") if "threshold" in frame.columns else none
        parts.append(
            frame.select(F.lit(name).alias("part"), threshold.alias("threshold"), F.inline(cells))
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


@register()
def test_set_evaluation(spark, sf_dir):
    """All four tables of the evaluation of the test rows."""
    t = trained(spark, sf_dir)
    scores = materialise(training.scored_set(t.model, t.test), "test-scores")
    return rounded(tall_bundle(evaluation.evaluation_bundle(scores)))


@register()
def feature_importance(spark, sf_dir):
    t = trained(spark, sf_dir)
    return rounded(training.feature_importance(t.model, t.train))


def _explained(spark, sf_dir):
    t = trained(spark, sf_dir)
    names = A.attribution_names(t.model, t.validation)
    return A.attributions(t.model, t.validation), names


@register()
def attributions(spark, sf_dir):
    return rounded(A.tall_attributions(*_explained(spark, sf_dir)))


@register()
def attribution_importance(spark, sf_dir):
    return rounded(A.global_importance(*_explained(spark, sf_dir), k=10))


@register()
def attribution_beeswarm(spark, sf_dir):
    return rounded(A.beeswarm(*_explained(spark, sf_dir)))


@register()
def attribution_of_one_row(spark, sf_dir):
    explained, names = _explained(spark, sf_dir)
    first = trained(spark, sf_dir).validation.agg(F.min("row_id")).scalar()
    return rounded(A.row_breakdown(explained, names, first))


@register()
def price_attribution_p95(spark, sf_dir):
    return rounded(A.contribution_quantile(*_explained(spark, sf_dir)))


@register()
def top_attribution_columns(spark, sf_dir):
    path = scratch_path(spark, "top-attributions")
    top = rounded(A.top_attribution_columns(*_explained(spark, sf_dir)))
    artifacts.write_csv(top, path)
    return artifacts.read_csv(spark, path, top.schema)


@register()
def error_clusters(spark, sf_dir):
    t = trained(spark, sf_dir)
    predicted = training.with_probability(t.model, t.validation)
    rows = predicted.withColumn("label", F.col(TARGET)).drop("prediction", "rawPrediction")
    clustered = E.cluster_errors(materialise(E.misclassified(rows), "errors"))
    return rounded(E.cluster_summary(clustered))


@register()
def recommendation_report(spark, sf_dir):
    t = trained(spark, sf_dir)
    return rounded(build_report(t.model, t.validation))


@register()
def batch_scores(spark, sf_dir):
    t = trained(spark, sf_dir)
    return rounded(scoring.score_batch(t.model, t.test))


@register()
def stored_model_scores(spark, sf_dir):
    """Scores by the newest stored model, at the threshold stored with it."""
    t = trained(spark, sf_dir)
    folder = scratch_path(spark, "models")
    best = C.best_threshold(training.scored_set(t.model, t.validation)).first()
    artifacts.save_model(
        t.model, FEATURES, {"f1_score": best["score"]}, folder, best["threshold"]
    )
    return rounded(scoring.score_stored(spark, folder, t.test))


def _stored_baseline(spark, sf_dir):
    path = scratch_path(spark, "baseline")
    baseline = monitoring_baseline(
        features(spark, sf_dir), scored(spark, sf_dir), NUMERIC_FEATURES
    )
    artifacts.write_baseline(baseline, path)
    return artifacts.read_baseline(spark, path)


@register(ORACLES["monitoring_baseline"])
def stored_baseline(spark, sf_dir):
    baseline = _stored_baseline(spark, sf_dir).drop("created_at")
    return rounded(baseline, auc_score=6, class_ratio=6, mean=4, std=4)


@register(_FRAME_SQL + ", target FROM features", ["features"])
def stored_model_features(spark, sf_dir):
    path = scratch_path(spark, "model-features")
    artifacts.write_frame(features(spark, sf_dir).drop("user_id"), path)
    return rounded(spark.read.parquet(path), monetary=4)


@register(f"SELECT {EVENT_COLUMNS} FROM clicks", ["clicks"])
def csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "events-csv")
    artifacts.write_csv(clicks(spark, sf_dir), path)
    return with_time_text(artifacts.read_csv(spark, path, CLICKSTREAM))


def _stream(spark, sf_dir):
    events = read_requests(spark, f"{sf_dir}/events.parquet", STAR_EVENTS)
    parts = spark.read.schema(STAR_PARTS).parquet(f"{sf_dir}/part.parquet")
    return adapt_events(events, parts)


def run_stream(spark, stream, name):
    out = scratch_path(spark, name)
    write_stream(stream, f"{out}/rows", f"{out}/progress").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


_VALID_EVENT = """event_type IN ('view', 'cart', 'purchase', 'remove_from_cart') AND price > 0
  AND user_id > 0 AND price <= 100000 AND product_id > 0 AND category_id >= 0"""


@register(
    f"""SELECT row_id, probability, CAST(probability >= 0.5 AS INTEGER) AS prediction,
  CASE WHEN probability < 0.3 OR probability > 0.7 THEN 'high'
    WHEN probability < 0.4 OR probability > 0.6 THEN 'medium' ELSE 'low' END AS confidence,
  CAST(0.5 AS DOUBLE) AS threshold
FROM (SELECT row_id, (row_id * 7919 % 800 + least(CAST(floor(price) AS BIGINT), 99))
    / CAST(1000 AS DOUBLE) AS probability
  FROM clicks WHERE {_VALID_EVENT})""",
    ["clicks"],
)
def stream_scores(spark, sf_dir):
    valid = valid_rows(_stream(spark, sf_dir), raw_rules())
    scores = valid.select("row_id", stand_in_probability(F.lit(0)).alias("probability"))
    return run_stream(spark, scoring.with_decision(scores), "stream-scores")


@register(ORACLES["quarantined_events"])
def stream_rejected(spark, sf_dir):
    bad = quarantined_rows(_stream(spark, sf_dir), raw_rules()).select(
        "row_id",
        "event_type",
        "user_id",
        "price",
        F.concat_ws(",", "violations").alias("violations"),
    )
    return run_stream(spark, bad, "stream-rejected")


@register(
    f"""SELECT row_id, probability, CAST(NULL AS VARCHAR) AS violations FROM (
  {ORACLES["stream_scores"]})
UNION ALL SELECT row_id, NULL, violations FROM ({ORACLES["quarantined_events"]})"""
)
def stream_split(spark, sf_dir):
    """Scores and refusals of one stream that reads each row once."""
    out = scratch_path(spark, "stream-split")

    def accept(rows):
        scores = rows.select("row_id", stand_in_probability(F.lit(0)).alias("probability"))
        return scoring.with_decision(scores)

    start_split(_stream(spark, sf_dir), raw_rules(), accept, out).awaitTermination()
    accepted = read_part(spark, out, "scores").select(
        "row_id", "probability", F.lit(None).cast("string").alias("violations")
    )
    refused = read_part(spark, out, "rejected").select(
        "row_id", F.lit(None).cast("double").alias("probability"), "violations"
    )
    return accepted.unionByName(refused)
