"""Cleaning, time, user, session and RFM features."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cartlens.functions import expressions as X
from cartlens.operators import behavior as B
from cartlens.operators import cleaning
from cartlens.operators.encoding import category_dictionary, with_category_codes
from cartlens.operators.segments import rfm_segments, segment_sizes, with_zscores
from cartlens.plans.model_frame import featured_carts, model_frame
from cartlens.schema import CLICKSTREAM, FEATURES
from cartlens.sources.clickstream import load_clickstream, read_clickstream, with_row_ids

T0 = datetime(2024, 1, 5, 23, 59)  # a Friday


def by(df, key):
    return {row[key]: row for row in df.collect()}


@pytest.fixture(scope="module")
def events(make_events):
    return make_events(
        [
            (T0, "view", 1, "a.b.c", 10, 1, "x"),
            (T0 + timedelta(seconds=30), "cart", 2, "a.b.c", 15, 1, "x"),
            (T0 + timedelta(seconds=90), "purchase", 2, None, 20, 1, "x"),
            (T0 + timedelta(hours=5), "cart", 3, "plain", 5, 1, "alone"),
            (T0 + timedelta(seconds=60), "cart", 1, "a.z", 12, 2, "x"),
            (T0 - timedelta(hours=18), "view", 9, "a.z", 7, 3, "early"),
        ]
    )


def test_missing_columns_raise(events):
    with pytest.raises(ValueError, match="price"):
        cleaning.require_columns(events.drop("price"))
    assert cleaning.require_columns(events) is events


def test_clean_drops_nulls_and_copies(make_events, spark):
    rows = [(T0 + timedelta(minutes=i), "view", 1, "a.b", 10 + i, 1, "x") for i in range(20)]
    events = make_events(rows).withColumn(
        "price", F.when(F.col("row_id") != 3, F.col("price"))
    )
    doubled = events.unionAll(events.where("row_id < 5"))
    assert cleaning.clean(doubled).count() == 19


def test_nan_counts_as_missing(make_events):
    events = make_events([(T0, "view", 1, "a.b", p, 1, "x") for p in (1.0, float("nan"), 2.0)])
    assert cleaning.drop_null_rows(events).count() == 2


def test_load_keeps_frequent_categories_without_nulls(events, spark, tmp_path):
    loaded = load_clickstream(events, k=1)
    assert {r["category_code"] for r in loaded.collect()} == {"a.b.c"}
    assert load_clickstream(events, k=10).where("category_code is null").count() == 0
    assert load_clickstream(events, k=10, limit=2).count() == 2
    events.write.parquet(str(tmp_path / "e"))
    assert read_clickstream(spark, str(tmp_path / "e"), CLICKSTREAM).schema == events.schema


def test_weekend_starts_on_saturday(events):
    rows = by(B.with_time_features(events), "row_id")
    assert (rows[0]["hour"], rows[0]["day_of_week"], rows[0]["is_weekend"]) == (23, 4, 0)
    assert (rows[2]["hour"], rows[2]["day_of_week"], rows[2]["is_weekend"]) == (0, 5, 1)


def test_category_parts(events):
    rows = by(B.with_category_parts(events), "row_id")
    assert (rows[0]["main_category"], rows[0]["sub_category"]) == ("a", "b.c")
    assert (rows[2]["category_code"], rows[2]["main_category"]) == ("unknown", "unknown")
    assert (rows[3]["main_category"], rows[3]["sub_category"]) == ("plain", None)


def test_user_behavior(events):
    rows = by(B.user_behavior(events), "user_id")
    assert rows[1]["total_clicks"] == 1
    assert rows[1]["purchase_freq"] == 0.25
    assert rows[1]["avg_session_time"] == 45.0
    assert rows[2]["avg_session_time"] == 0.0


def test_naive_gap_ignores_sessions_and_is_null_for_one_event(events):
    rows = by(B.naive_user_gap(events), "user_id")
    assert rows[1]["mean_gap_seconds"] == 5 * 3600 / 3
    assert rows[2]["mean_gap_seconds"] is None


def test_mean_of_gaps_equals_closed_form(random_events):
    gaps = B.with_event_gaps(random_events).groupBy("user_id").agg(
        F.coalesce(F.avg("gap_seconds"), F.lit(0.0)).alias("mean_gap")
    )
    both = gaps.join(B.user_behavior(random_events), "user_id").collect()
    assert len(both) == random_events.select("user_id").distinct().count()
    for row in both:
        assert row["mean_gap"] == pytest.approx(row["avg_session_time"], abs=1e-6)


def test_session_shared_by_two_users(events):
    rows = by(B.session_stats(events), "user_session")
    assert rows["x"]["products_viewed"] == 2
    assert rows["x"]["price_range"] == 10.0
    assert rows["x"]["session_duration"] == 90.0
    assert (rows["alone"]["session_duration"], rows["alone"]["price_range"]) == (0.0, 0.0)


def test_rfm_counts_whole_days(events):
    rows = by(B.rfm(events), "user_id")
    assert (rows[1]["recency"], rows[1]["frequency"], rows[1]["monetary"]) == (1, 2, 50.0)
    assert rows[3]["recency"] == 1  # 23 hours before the last event, plus one day
    assert by(B.rfm(events, purchases_only=True), "user_id")[1]["monetary"] == 20.0


def test_rfm_join_renames_clashes(events):
    joined = B.with_rfm(events.withColumn("recency", F.lit(-1)))
    assert {"recency", "recency_rfm", "frequency", "monetary"} <= set(joined.columns)
    assert joined.count() == events.count()


def test_label_follows_the_session(events):
    rows = by(B.labelled_carts(events), "row_id")
    assert {i: r["target"] for i, r in rows.items()} == {1: 1, 3: 0, 4: 1}


def test_codes_follow_sorted_values(events):
    parts = B.with_category_parts(events)
    coded = with_category_codes(parts, ["main_category", "brand"])
    rows = by(coded, "row_id")
    assert [rows[i]["main_category"] for i in (0, 3, 2)] == [0, 1, 2]
    assert rows[0]["brand"] == 0 and coded.columns == parts.columns
    known = category_dictionary(parts.where("main_category = 'a'"), ["main_category"])
    unseen = by(with_category_codes(parts, ["main_category"], known), "row_id")
    assert (unseen[0]["main_category"], unseen[3]["main_category"]) == (0, None)


def test_large_dictionary_is_joined_without_broadcast(random_events, monkeypatch):
    from cartlens.operators import encoding

    columns = ["category_code", "brand"]
    sent = with_category_codes(random_events, columns).select("row_id", *columns)
    monkeypatch.setattr(encoding, "BROADCAST_BYTES", 0)
    shuffled = with_category_codes(random_events, columns).select("row_id", *columns)
    assert sorted(sent.collect()) == sorted(shuffled.collect())


def test_zscores_use_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, same double")
    rows = with_zscores(df, ["x", "same"]).collect()
    assert sorted(r["x_z"] for r in rows) == [-1.0, 1.0]
    assert {r["same_z"] for r in rows} == {0.0}


def test_segments_are_numbered_by_monetary_value_and_repeat(random_events):
    users = B.rfm(random_events)
    first = by(rfm_segments(users), "user_id")
    again = by(rfm_segments(users), "user_id")
    assert {u: r["rfm_segment"] for u, r in first.items()} == {
        u: r["rfm_segment"] for u, r in again.items()
    }
    means = {}
    for row in first.values():
        means.setdefault(row["rfm_segment"], []).append(row["monetary"])
    averages = [sum(v) / len(v) for _, v in sorted(means.items())]
    assert averages == sorted(averages) and set(means) == {0, 1, 2, 3}
    sizes = segment_sizes(B.with_rfm(random_events, rfm_segments(users))).collect()
    assert sum(r["n_events"] for r in sizes) == 400
    assert sum(r["n_users"] for r in sizes) == len(first)


def test_model_frame_columns_ranges_and_rows(random_events):
    frame = model_frame(random_events, encode=True)
    assert frame.columns == ["row_id", *FEATURES, "target"]
    carts = random_events.where("event_type = 'cart'").count()
    assert frame.count() == carts
    from cartlens.functions.rules import processed_rules, quarantined_rows

    assert quarantined_rows(frame, processed_rules()).count() == 0


def test_raw_table_without_row_keys(random_events, spark, tmp_path):
    raw = random_events.drop("row_id")
    raw.unionAll(raw.where("price > 500")).write.parquet(str(tmp_path / "raw"))
    events = read_clickstream(spark, str(tmp_path / "raw"))
    frame = model_frame(events)
    assert frame.select("row_id").distinct().count() == frame.count()
    assert frame.count() == raw.distinct().where("event_type = 'cart'").count()
    assert load_clickstream(events, limit=7).count() == 7
    numbered = with_row_ids(events)
    again = with_row_ids(events.repartition(3))
    assert sorted(numbered.collect()) == sorted(again.collect())


def test_hot_user_and_session_change_nothing(random_events, monkeypatch):
    from cartlens.functions import skew
    from cartlens.plans import model_frame as M

    plain = featured_carts(random_events)
    monkeypatch.setattr(
        M, "hot_keys", lambda rows, keys: skew.hot_keys(rows, keys, slice_rows=20)
    )
    assert M.hot_keys(random_events, ["user_id"])["user_id"]
    sliced = featured_carts(random_events)
    columns = [c for c in plain.columns if c not in ("monetary", "avg_session_time")]
    assert sorted(sliced.select(columns).collect()) == sorted(plain.select(columns).collect())


def test_parsed_time_of_bad_text_is_null(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00",), ("nonsense",)], "t string")
    found = [r[0] for r in df.select(X.parsed_time("t")).collect()]
    assert found[0] == datetime(2024, 1, 1, 10) and found[1] is None


@pytest.mark.parametrize(
    "probability, band",
    [(0.9, "high"), (0.1, "high"), (0.65, "medium"), (0.35, "medium"), (0.52, "low"), (0.7, "medium")],
)
def test_confidence_band(spark, probability, band):
    df = spark.createDataFrame([(probability,)], "p double")
    assert df.select(X.confidence_band("p")).first()[0] == band


def test_text_time_is_parsed_and_rules_are_counted(random_events):
    from cartlens.plans.model_frame import rule_counts

    text = random_events.withColumn("event_time", F.col("event_time").cast("string"))
    cleaned = cleaning.clean(text)
    assert cleaned.schema["event_time"].dataType.typeName().startswith("timestamp")
    assert cleaned.count() == cleaning.clean(random_events).count()
    broken = random_events.withColumn("price", F.when(F.col("row_id") < 5, -1.0).otherwise(F.col("price")))
    assert {r["rule"]: r["n_broken"] for r in rule_counts(broken).collect()}["price_positive"] == 5


def test_copies_under_other_keys_are_duplicates(random_events):
    copies = random_events.withColumn("row_id", F.col("row_id") + 1000)
    kept = cleaning.drop_duplicate_rows(copies.unionAll(random_events))
    raw = random_events.drop("row_id").distinct().count()
    assert kept.count() == raw and kept.agg(F.max("row_id")).first()[0] < 1000


def test_stream_reads_a_file_and_a_folder_of_files(spark, random_events, tmp_path):
    from cartlens.streaming.scoring import read_requests, write_stream

    many, one = str(tmp_path / "many"), str(tmp_path / "one")
    random_events.repartition(3).write.parquet(many)
    random_events.coalesce(1).write.parquet(one)
    (file,) = [str(p) for p in (tmp_path / "one").glob("part-*")]
    for i, path in enumerate((many, file)):
        stream = read_requests(spark, path, random_events.schema)
        out = str(tmp_path / f"out{i}")
        write_stream(stream, out, str(tmp_path / f"progress{i}")).awaitTermination()
        assert spark.read.parquet(out).count() == 400


def test_visitor_sketches_answer_ranges_of_days(make_events):
    from cartlens.operators import profiling

    day = datetime(2024, 1, 1, 9)
    rows = []
    for d in (0, 1, 2, 5):
        # User 1 has a third of all events; users overlap from day to day; repeated rows.
        for user in [1] * 20 + list(range(d * 10, d * 10 + 20)) * 2:
            rows.append((day + timedelta(days=d), "view", 1, "a.b", 1.0, user, f"s{user}"))
    events = make_events(rows).repartition(5)
    sketches = profiling.daily_visitor_sketches(events)

    def between(first, last):
        return profiling.visitors_between(sketches, first, last).first()[0]

    assert between(date(2024, 1, 1), date(2024, 1, 1)) == 20
    assert between(date(2024, 1, 1), date(2024, 1, 3)) == 40
    assert between(date(2024, 1, 4), date(2024, 1, 5)) == 0
    got = {str(r["event_date"]): r["n_visitors"] for r in profiling.rolling_visitors(sketches, 2).collect()}
    assert got == {"2024-01-01": 20, "2024-01-02": 30, "2024-01-03": 31, "2024-01-06": 21}
    # Sketches stored day by day give what one pass over all events gives.
    by_day = [profiling.daily_visitor_sketches(events.where(f"day(event_time) = {d}")) for d in (1, 2, 3, 6)]
    stored = by_day[0].unionByName(by_day[1]).unionByName(by_day[2]).unionByName(by_day[3])
    assert profiling.visitors_between(stored, date(2024, 1, 1), date(2024, 1, 6)).first()[0] == between(
        date(2024, 1, 1), date(2024, 1, 6)
    )
    many = events.sparkSession.range(200_000).selectExpr("id AS user_id", "timestamp'2024-01-01' AS event_time")
    found = profiling.rolling_visitors(profiling.daily_visitor_sketches(many)).first()["n_visitors"]
    assert abs(found / 200_000 - 1) < 4 * profiling.sketch_error()
    assert profiling.rolling_visitors(profiling.daily_visitor_sketches(events.where("false"))).count() == 0
