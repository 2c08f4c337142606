"""Ranking curves and metrics of continuous scores in bounded memory, with the error they may have.

A curve over distinct scores has as many rows as there are scores.  Here a mergeable sketch of
the scores gives at most ``bins`` cuts, close where scores are close.  Every row falls on a cut or
between two, so a table of at most ``2 * bins + 1`` rows has the counts of both classes, and the
smallest and largest score, of each.  A score that is common enough to be a cut is a bin of its
own; whatever stands alone in its bin is exact.  Inside the other bins the order of rows is not
known, and the metrics say by how much that can matter at most.
"""

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Window
from pyspark.sql import functions as F

BINS = 1_000
ACCURACY = 10  # ranks of the sketch per bin


def score_cuts(scored, bins=BINS):
    """At most ``bins`` scores, rising, that cut the rows into nearly equal parts."""
    shares = [(i + 0.5) / bins for i in range(bins)]
    found = scored.agg(F.percentile_approx("probability", shares, ACCURACY * bins)).first()[0]
    return sorted(set(found or []))


def score_bins(scored, bins=BINS):
    """``low, high, n, pos``: the bins of the scores, for any number of rows.

    Null scores are left out.
    """
    rows = scored.where(F.col("probability").isNotNull()).select("probability", F.col("label").cast("bigint").alias("label"))
    cuts = score_cuts(rows, bins)
    if not cuts:
        return rows.groupBy(F.lit(0).alias("bin")).agg(
            F.min("probability").alias("low"), F.max("probability").alias("high"),
            F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"),
        ).drop("bin")
    edges = [float("-inf"), *cuts, float("inf")]
    cut = Bucketizer(splits=edges, inputCol="probability", outputCol="_bucket", handleInvalid="keep")
    at = F.get(F.array(*[F.lit(c) for c in edges]), F.col("_bucket").cast("int")) == F.col("probability")
    return (
        cut.transform(rows)
        .groupBy("_bucket", at.alias("_on"))
        .agg(
            F.min("probability").alias("low"),
            F.max("probability").alias("high"),
            F.count(F.lit(1)).alias("n"),
            F.sum("label").alias("pos"),
        )
        .drop("_bucket", "_on")
    )


def binned_curve(table):
    """Running counts from the highest bin down, in the columns of ``score_curve`` and ``high``.

    ``probability`` is the lowest score of a bin: all rows from there up are counted.  The window
    has no partitions, and at most as many rows as there are bins.
    """
    down = Window.orderBy(F.desc("low"))
    upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table.select(
        F.col("low").alias("probability"), "high", "n", "pos",
        F.sum("n").over(upto).alias("cum_n"), F.sum("pos").over(upto).alias("cum_pos"),
        F.sum("n").over(every).alias("total_n"), F.sum("pos").over(every).alias("total_pos"),
    )


def bounded_ranking_metrics(curve):
    """``roc_auc`` and ``average_precision`` of a binned curve, each with its ``_error``.

    The exact value is at most the error away.  For the AUC, a pair of a positive and a negative
    in one bin of several scores counts half, and may be worth nothing or all.  For the average
    precision, the positives of such a bin may stand before or after its negatives: their
    precision is at most that after all of them came first, and at least that of the first one
    if all negatives came before.  Null where a class is missing.
    """
    n, pos, neg = F.col("n"), F.col("pos"), (F.col("n") - F.col("pos")).cast("double")
    mixed = F.col("probability") < F.col("high")
    before_n, before_pos = F.col("cum_n") - n, F.col("cum_pos") - pos
    tied = F.col("cum_pos") / F.col("cum_n")
    best = F.when(mixed & (pos > 0), F.col("cum_pos") / (before_n + pos)).otherwise(tied)
    worst = F.when(mixed & (pos > 0), (before_pos + 1) / (before_n + neg + 1)).otherwise(tied)
    total_pos, total_n = F.max("total_pos").cast("double"), F.max("total_n").cast("double")
    pairs = total_pos * (total_n - total_pos)
    return curve.agg(
        F.try_divide(F.sum(neg * (before_pos + pos / 2)), pairs).alias("roc_auc"),
        F.try_divide(F.sum(F.when(mixed, neg * pos / 2).otherwise(0.0)), pairs).alias("roc_auc_error"),
        F.try_divide(F.sum(pos * (best + worst)) / 2, total_pos).alias("average_precision"),
        F.try_divide(F.sum(pos * (best - worst)) / 2, total_pos).alias("average_precision_error"),
        F.count(F.lit(1)).alias("bins"),
    )
