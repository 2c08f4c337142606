"""Scoring, the same for a batch and for a stream."""

from pyspark.sql import functions as F

from cartlens.functions.expressions import confidence_band, predicted_class
from cartlens.functions.rules import quarantined_rows, request_rules, valid_rows
from cartlens.plans.training import with_probability
from cartlens.schema import FEATURES
from cartlens.sources.artifacts import load_model

DEFAULT_THRESHOLD = 0.5


def scoring_inputs(requests):
    """Key and features in training order; the weekend flag as a number."""
    return requests.select("row_id", *FEATURES).withColumn(
        "is_weekend", F.col("is_weekend").cast("int")
    )


def with_decision(scored, threshold=DEFAULT_THRESHOLD):
    """Add class, confidence and the threshold used."""
    return scored.withColumns(
        {
            "prediction": predicted_class("probability", threshold),
            "confidence": confidence_band("probability"),
            "threshold": F.lit(float(threshold)),
        }
    )


def score(model, requests, threshold=DEFAULT_THRESHOLD):
    """Score the requests that meet all rules."""
    return scored_requests(model, valid_rows(requests, request_rules()), threshold)


def scored_requests(model, accepted, threshold=DEFAULT_THRESHOLD):
    """Scores and decisions for requests that were found to meet all rules."""
    scored = with_probability(model, scoring_inputs(accepted)).select("row_id", "probability")
    return with_decision(scored, threshold)


def score_stored(spark, save_dir, requests):
    """``score`` by the newest model of ``save_dir``, at the threshold stored with it."""
    model, metadata = load_model(spark, save_dir)
    stored = metadata["optimal_threshold"]
    return score(model, requests, DEFAULT_THRESHOLD if stored is None else stored)


def rejected(requests):
    """The other requests, with the rules they break."""
    return quarantined_rows(requests, request_rules())


def score_batch(model, requests, threshold=DEFAULT_THRESHOLD):
    """``score`` for a batch, which may not be empty."""
    if requests.isEmpty():
        raise ValueError("there is nothing to score")
    return score(model, requests, threshold)
