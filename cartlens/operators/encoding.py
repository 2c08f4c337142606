"""Category codes."""

from pyspark.sql import functions as F

from cartlens.functions.expressions import UNKNOWN
from cartlens.functions.ordered import running_sums
from cartlens.functions.skew import hot_keys, join_key_stats

# Bytes of dictionary, over all columns, that are sent to every task; each entry counts its text
# and a fixed share for its row.
BROADCAST_BYTES = 32_000_000
ENTRY_BYTES = 64


def category_dictionary(df, columns):
    """``feature, value, code``: the 0-based place of each value in the sorted values.

    Nulls count as ``unknown``.
    """
    tall = df.select(
        *[F.coalesce(F.col(c), F.lit(UNKNOWN)).alias(c) for c in columns]
    ).unpivot([], columns, "feature", "value")
    ranked = running_sums(
        tall.distinct(), [F.col("feature"), F.col("value")], {"rank": F.lit(1)}
    )
    # One row per encoded column.
    first = ranked.groupBy("feature").agg(F.min("rank").alias("first"))
    return ranked.join(F.broadcast(first), "feature").select(
        "feature", "value", (F.col("rank") - F.col("first")).cast("int").alias("code")
    )


def with_category_codes(df, columns, dictionary=None, row_key="row_id"):
    """Replace each column by its code; a value the dictionary lacks gets null.

    The dictionary is measured first: the smallest columns, up to ``BROADCAST_BYTES`` in
    all, are sent to the rows; for the others the rows are shuffled, with hot values spread.
    """
    table = category_dictionary(df, columns) if dictionary is None else dictionary
    size = F.sum(F.octet_length("value") + ENTRY_BYTES)
    sizes = table.where(F.col("feature").isin(columns)).groupBy("feature").agg(size.alias("size"))
    large, sent = [], 0
    for row in sorted(sizes.collect(), key=lambda r: r["size"]):  # one row per column
        sent += row["size"]
        if sent > BROADCAST_BYTES:
            large.append(row["feature"])
    hot = hot_keys(df, large) if large else {}
    coded = df
    for column in columns:
        codes = table.where(F.col("feature") == column).select(
            F.col("value").alias(column), F.col("code").alias("_code")
        )
        filled = coded.withColumn(column, F.coalesce(F.col(column), F.lit(UNKNOWN)))
        if column in large:
            joined = join_key_stats(filled, codes, column, hot, row_key)
        else:
            joined = filled.join(F.broadcast(codes), column, "left")
        coded = joined.drop(column).withColumnRenamed("_code", column)
    return coded.select(*df.columns)
