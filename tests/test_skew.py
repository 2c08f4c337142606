from pyspark.sql import functions as F

from cartlens.functions.skew import hot_keys, join_key_stats


def _rows(spark):
    # Key 1 holds a third of the rows, null keys a tenth.
    key = F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 10 == 1, None).otherwise(
        F.col("id") % 50
    )
    return spark.range(3000).select(F.col("id").alias("row_id"), key.alias("user_id"))


def test_hot_keys_finds_only_the_heavy_one(spark):
    hot = hot_keys(_rows(spark), ["user_id"], slice_rows=200)
    assert [key for key, _ in hot["user_id"]] == [1]
    assert hot["user_id"][0][1] >= 5
    assert hot_keys(_rows(spark), ["user_id"]) == {"user_id": []}


def test_slices_have_a_fixed_size_in_any_total(spark):
    """A key of ten slices is cut into ten, however many other rows there are."""
    for others in (0, 300_000):
        rows = spark.range(10_000).select(F.lit(-1).alias("user_id")).unionAll(
            spark.range(others).select(F.col("id").cast("int"))
        )
        ((key, slices),) = hot_keys(rows, ["user_id"], slice_rows=1_000)["user_id"]
        assert key == -1 and slices in (10, 11)  # counts of the sketch are estimates


def test_sliced_join_equals_plain_join(spark):
    rows = _rows(spark)
    stats = rows.where("user_id <> 7").groupBy("user_id").agg(F.count("*").alias("n"))
    hot = hot_keys(rows, ["user_id"], slice_rows=200)
    sliced = join_key_stats(rows, stats, "user_id", hot)
    plain = rows.join(stats, "user_id", "left")
    assert sliced.columns == plain.columns
    assert sliced.count() == 3000
    assert sliced.exceptAll(plain).count() == 0 and plain.exceptAll(sliced).count() == 0


def test_hot_rows_spread_over_the_join_tasks(spark):
    rows = _rows(spark)
    stats = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", -1)
    try:
        hot = hot_keys(rows, ["user_id"], slice_rows=100)
        joined = join_key_stats(rows, stats, "user_id", hot)
        tasks = joined.where("user_id = 1").groupBy(F.spark_partition_id().alias("p")).count()
        assert tasks.count() > 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_empty_table_has_no_hot_keys(spark):
    assert hot_keys(_rows(spark).limit(0), ["user_id"]) == {"user_id": []}
