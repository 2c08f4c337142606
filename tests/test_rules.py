import pytest
from pyspark.sql import functions as F

from cartlens.functions.rules import (
    processed_rules,
    quarantined_rows,
    raw_rules,
    request_rules,
    valid_rows,
    violation_counts,
)
from cartlens.plans.scoring import rejected, score_batch
from cartlens.schema import SCORING_INPUT

GOOD = {
    "row_id": 1,
    "price": 19.9,
    "hour": 7,
    "is_weekend": True,
    "total_clicks": 41,
    "avg_session_time": 33.25,
    "purchase_freq": 0.125,
    "products_viewed": 8,
    "price_range": 12.75,
    "session_duration": 912.0,
    "recency": 26,
    "frequency": 9,
    "monetary": 1204.6,
    "main_category": "garden",
    "rfm_segment": 1,
}


def requests(spark, **changes):
    return spark.createDataFrame([{**GOOD, **changes}], SCORING_INPUT)


def test_good_request_passes(spark):
    assert valid_rows(requests(spark), request_rules()).count() == 1
    assert rejected(requests(spark)).count() == 0


@pytest.mark.parametrize(
    "column, value",
    [
        ("hour", 25),
        ("price", -10.0),
        ("purchase_freq", 1.5),
        ("rfm_segment", 4),
        ("main_category", None),
        ("is_weekend", None),
        ("monetary", None),
    ],
)
def test_bad_request_names_its_rule(spark, column, value):
    bad = rejected(requests(spark, **{column: value}))
    assert [r["violations"] for r in bad.collect()] == [[column]]


def test_raw_rules(random_events):
    assert quarantined_rows(random_events, raw_rules()).count() == 0
    bad = random_events.limit(1).withColumns(
        {
            "event_type": F.lit("signup"),
            "price": F.lit(100_001.0),
            "user_id": F.lit(0).cast("bigint"),
            "category_id": F.lit(None).cast("bigint"),
        }
    )
    row = quarantined_rows(bad, raw_rules()).first()
    assert row["violations"] == ["category_id", "event_type", "price_reasonable", "user_id"]


def test_counts_cover_all_rows(random_events):
    halved = random_events.withColumn("price", F.when(F.col("row_id") % 2 == 0, F.col("price")))
    found = violation_counts(halved, raw_rules()).collect()
    counts = {r["rule"]: (r["n_rows"], r["n_broken"]) for r in found}
    assert counts["price_positive"] == (400, 200)
    assert counts["event_type"] == (400, 0)


def test_processed_rules_want_integer_category(spark):
    frame = requests(spark).withColumns(
        {
            "is_weekend": F.col("is_weekend").cast("int"),
            "main_category": F.lit(-1),
            "target": F.lit(2),
        }
    )
    assert quarantined_rows(frame, processed_rules()).first()["violations"] == [
        "main_category",
        "target",
    ]


def test_empty_batch_is_refused(spark):
    with pytest.raises(ValueError, match="nothing to score"):
        score_batch(None, requests(spark).limit(0))
