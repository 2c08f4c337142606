"""Lift and gain."""

from pyspark.sql import functions as F

from cartlens.functions.expressions import ratio
from cartlens.functions.ordered import running_sums
from cartlens.operators.classification import score_curve

# The percentiles reported by default.
PERCENTILES = [0.05, 0.1, 0.2, 0.3, 0.5]


def gain_curve(curve):
    """Share of rows, gain and lift after each distinct score, from the highest down."""
    percentile = F.col("cum_n") / F.col("total_n")
    gain = ratio(F.col("cum_pos"), F.col("total_pos"))
    return curve.select(
        "probability",
        "cum_n",
        "cum_pos",
        percentile.alias("percentile"),
        gain.alias("gain"),
        (gain / percentile).alias("lift"),
    )


def _lift_at(scored, curve, cut_rows):
    """Gain and lift in the first ``cut`` rows by falling score, then rising ``row_id``.

    ``cut_rows`` lists ``(share, cut)`` pairs, the cut being an expression over ``total_n``.  A
    cut falls inside at most one group of equal scores, and only rows of those groups are ranked.
    """
    group = F.struct("cum_n", "cum_pos", "n", "pos", "probability")
    picks = [
        F.struct(
            F.lit(share).alias("share"),
            F.max(cut).alias("cut"),
            F.min(F.when(F.col("cum_n") >= cut, group)).alias("g"),
            F.max("total_n").alias("total_n"),
            F.max("total_pos").alias("total_pos"),
        )
        for share, cut in cut_rows
    ]
    # One row per cut.
    cuts = curve.agg(F.array(*picks).alias("cuts")).select(F.inline("cuts")).select(
        "share",
        "cut",
        "total_n",
        "total_pos",
        F.col("g.probability").alias("probability"),
        F.col("g.n").alias("n"),
        F.col("g.pos").alias("pos"),
        (F.col("g.cum_pos") - F.col("g.pos")).alias("pos_before"),
        (F.col("cut") - (F.col("g.cum_n") - F.col("g.n"))).alias("taken"),
    )
    split = cuts.where((F.col("taken") > 0) & (F.col("taken") < F.col("n")))
    tied = scored.join(
        F.broadcast(split.select("probability").distinct()), "probability", "left_semi"
    ).select("probability", "row_id", F.col("label").cast("bigint").alias("label"))
    ranked = running_sums(
        tied, [F.col("probability"), F.col("row_id")], {"rank": F.lit(1), "hits": "label"}
    )
    base = ranked.groupBy("probability").agg(
        F.min("rank").alias("first"), F.min(F.col("hits") - F.col("label")).alias("hits_before")
    )
    inside = (
        ranked.join(F.broadcast(base), "probability")
        .withColumn("taken", F.col("rank") - F.col("first") + 1)
        .join(F.broadcast(split.select("share", "probability", "taken")), ["probability", "taken"])
        .select("share", (F.col("hits") - F.col("hits_before")).alias("hits"))
    )
    hits = F.when(F.col("taken") <= 0, F.lit(0)).otherwise(F.coalesce("hits", "pos"))
    positives = F.when(F.col("cut") > 0, F.col("pos_before") + hits).otherwise(F.lit(0))
    gain = ratio(positives, F.col("total_pos"))
    return cuts.join(inside, "share", "left").select(
        "share",
        F.col("cut").alias("n_rows"),
        positives.alias("n_positive"),
        gain.alias("gain"),
        ratio(gain * F.col("total_n"), F.col("cut")).alias("lift"),
    )


def lift_by_bins(scored, bins=10):
    """Gain and lift in the first i/bins of the rows, cut at ``floor(i * N / bins)``."""
    cuts = [
        (i / bins, F.floor(F.lit(float(i)) * F.col("total_n") / F.lit(bins)))
        for i in range(1, bins + 1)
    ]
    return _lift_at(scored, score_curve(scored), cuts)


def lift_at_percentiles(scored, percentiles=PERCENTILES):
    """Gain and lift in the first ``floor(p * N)`` rows for each p."""
    cuts = [(p, F.floor(F.lit(p) * F.col("total_n"))) for p in percentiles]
    return _lift_at(scored, score_curve(scored), cuts)
