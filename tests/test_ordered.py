"""Global order over several partitions against a plain Python loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlens.functions import ordered
from cartlens.functions.ordered import exact_quantiles, previous_value, running_sums
from cartlens.sources.clickstream import first_rows


def test_running_sums_cross_partition_borders(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.integers(0, 40)), int(rng.integers(0, 5))) for i in range(1000)]
    df = spark.createDataFrame(rows, "id bigint, score double, n bigint").repartition(7)
    order = [-F.col("score"), F.col("id")]
    out = running_sums(
        df, order, {"cum": "n", "rank": F.lit(1)}, totals={"all_n": "cum", "all_rows": "rank"}
    )
    total, expected = 0, {}
    for rank, (i, _, n) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), start=1):
        total += n
        expected[i] = (total, rank)
    found = out.collect()
    assert {r["id"]: (r["cum"], r["rank"]) for r in found} == expected
    assert {(r["all_n"], r["all_rows"]) for r in found} == {(total, 1000)}


def test_one_score_for_all_rows_is_still_spread(spark):
    df = spark.range(5000).select("id", F.lit(0.5).alias("score"))
    out = running_sums(df, [-F.col("score"), F.col("id")], {"rank": F.lit(1)})
    assert out.where(F.col("rank") != F.col("id") + 1).count() == 0
    from cartlens.functions.ordered import lay_out

    largest = lay_out(df, [-F.col("score"), F.col("id")]).groupBy("_part").count()
    assert largest.agg(F.max("count")).first()[0] < 2500


def test_previous_value_of_a_key_that_spans_partitions(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 else f"k{rng.integers(0, 30)}"
        rows.append((i, key, int(rng.integers(0, 10_000))))
    df = spark.createDataFrame(rows, "id bigint, key string, at bigint")
    out = previous_value(df, ["key"], ["at", "id"], "at", "before")
    expected, last = {}, {}
    for i, key, at in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        expected[i] = last.get(key)
        last[key] = at
    assert {r["id"]: r["before"] for r in out.collect()} == expected


@pytest.mark.parametrize("size", [1, 2, 101, 1000])
def test_exact_quantiles_match_numpy(spark, size):
    rng = np.random.default_rng(size)
    a, b = rng.integers(0, 50, size).astype(float), rng.normal(size=size)
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a double, b double")
    probabilities = [0.0, 0.25, 0.5, 0.95, 1.0]
    found = {r["feature"]: r for r in exact_quantiles(df, ["a", "b"], probabilities).collect()}
    for name, values in (("a", a), ("b", b)):
        for i, p in enumerate(probabilities):
            assert found[name][f"q{i}"] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_quantiles_ignore_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]).first()["q0"] == 2.0


def test_first_rows_takes_the_smallest_keys(spark):
    df = spark.range(500).select((F.col("id") * 7 % 501).alias("row_id"))
    found = sorted(r[0] for r in first_rows(df, 20).collect())
    assert found == sorted(i * 7 % 501 for i in range(500))[:20]
    assert first_rows(df, 10_000).count() == 500


def _row_shuffles(df):
    """Exchanges of the plan that carry rows, not the partial sums or tails of the parts."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [
        line
        for line, below in zip(lines, lines[1:])
        if "Exchange hashpartitioning" in line and "partial_" not in below
    ]


def test_rows_are_shuffled_once(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    sums = running_sums(df, [F.col("k"), F.col("id")], {"rank": F.lit(1)})
    before = previous_value(df, ["k"], ["id"], "id", "before")
    for out in (sums, before):
        assert len(_row_shuffles(out)) == 1
        assert "rangepartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_quantiles_expand_no_rows(spark):
    df = spark.range(1000).selectExpr("double(id) as a", "double(id % 9) as b")
    plan = exact_quantiles(df, ["a", "b"], [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_layout_has_as_many_partitions_as_its_rows_need(spark, monkeypatch):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        rows = spark.range(1000).withColumnRenamed("id", "row_id")
        laid = ordered.stable_layout(rows, "row_id")
        assert laid.rdd.getNumPartitions() == ordered.LEAST_PARTS  # not 50 tasks per job of a fit
        assert laid.count() == 1000
        monkeypatch.setattr(ordered, "LAYOUT_ROWS", 40)
        assert ordered.stable_layout(rows, "row_id").rdd.getNumPartitions() == 25
        monkeypatch.setattr(ordered, "LAYOUT_ROWS", 1)
        assert ordered.stable_layout(rows, "row_id").rdd.getNumPartitions() == 50
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_partitions_of_narrow_rows_hold_more_of_them(spark, monkeypatch):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    monkeypatch.setattr(ordered, "LAYOUT_ROWS", 20)
    monkeypatch.setattr(ordered, "LAYOUT_VALUES", 1000)
    try:
        rows = spark.range(1000).withColumnRenamed("id", "row_id")
        # Four times the rows at most, and wide rows as many as without a width.
        for width, expected in ((None, 50), (1000, 50), (25, 25), (12, 13), (1, 13), (0, 13)):
            laid = ordered.stable_layout(rows, "row_id", width)
            assert laid.rdd.getNumPartitions() == expected
            assert laid.count() == 1000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
