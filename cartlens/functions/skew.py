"""Joining per-key statistics back to rows when a few keys hold most of the rows."""

from pyspark.sql import functions as F

# The sketch tracks the most frequent keys, and never more than this whatever the data: that
# bounds what reaches the driver and is broadcast.  A slice has the same size in every table.
TRACKED_KEYS = 50_000
MERGE_GROUPS = 256
SLICE_ROWS = 1_000_000


def hot_keys(rows, keys, slice_rows=SLICE_ROWS):
    """``{key: [(value, slices)]}`` for the values that hold more than ``slice_rows`` rows.

    This runs a job, also while a plan is being built: call it once per frame and hand the
    result to every ``join_key_stats`` on it.  A stream can't be counted beforehand; hand an
    empty result, or one from a table of the same kind.

    One pass with a frequent-items sketch per key; only sketches are shuffled, and they are
    merged in two steps, so that no task receives one from every other task.  The counts are
    estimates; they only set how many slices a value is cut into, never a result.
    """
    group = F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS))
    sketched = rows.groupBy(group.alias("_group")).agg(
        *[F.expr(f"approx_top_k_accumulate({k}, {TRACKED_KEYS})").alias(k) for k in keys],
    )
    # A grouped merge, as the merge of no sketches at all fails.
    found = (
        sketched.groupBy(F.lit(0).alias("_all"))
        .agg(*[F.expr(f"approx_top_k_combine({k}, {TRACKED_KEYS})").alias(k) for k in keys])
        .select(
            *[F.expr(f"approx_top_k_estimate({k}, {TRACKED_KEYS})").alias(k) for k in keys]
        )
        .first()
    )
    if found is None:
        return {k: [] for k in keys}
    return {
        k: [
            (item["item"], -(-item["count"] // slice_rows))
            for item in found[k]
            if item["item"] is not None and item["count"] > slice_rows
        ]
        for k in keys
    }


def join_key_stats(rows, stats, key, hot=None, row_key="row_id"):
    """Left-join ``stats`` (one row per ``key``) to ``rows``, cutting hot keys into slices.

    AQE splits a skewed shuffle only when it feeds the join directly, which the aggregate
    that makes the statistics prevents.  So rows of a hot key get a slice number from their
    row key, and the statistics of that key are repeated once per slice.  ``hot`` comes from
    ``hot_keys``, also where it was run on a wider table.
    """
    hot = hot_keys(rows, [key]) if hot is None else hot
    if not hot[key]:
        return rows.join(stats, key, "left")
    slices = rows.sparkSession.createDataFrame(
        hot[key], rows.select(key, F.lit(0).alias("_slices")).schema
    )
    count = F.coalesce(F.col("_slices"), F.lit(1))
    sliced_rows = rows.join(F.broadcast(slices), key, "left").withColumn(
        "_slice", F.pmod(F.xxhash64(row_key), count).cast("int")
    )
    sliced_stats = stats.join(F.broadcast(slices), key, "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), count - 1))
    )
    return (
        sliced_rows.drop("_slices")
        .join(sliced_stats.drop("_slices"), [key, "_slice"], "left")
        .drop("_slice")
    )
