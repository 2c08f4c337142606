"""Counts, distributions and summaries of event and feature tables."""

from functools import reduce
from itertools import combinations_with_replacement
from math import sqrt

from pyspark.sql import functions as F

from cartlens.functions.expressions import ratio
from cartlens.functions.ordered import exact_quantiles
from cartlens.session import materialise

SKETCH_LOG2 = 14


def value_counts(df, column):
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n_events"))


def top_values(df, column, k=10):
    """The ``k`` most frequent values; ties go to the smaller value."""
    return (
        value_counts(df.where(F.col(column).isNotNull()), column)
        .orderBy(F.desc("n_events"), column)
        .limit(k)
    )


def hourly_activity(df):
    """Events per hour of day, hours without events included."""
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    counts = value_counts(df, "hour")
    return hours.join(counts, "hour", "left").select(
        "hour", F.coalesce("n_events", F.lit(0)).alias("n_events")
    )


def daily_unique_visitors(df, approximate=False):
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy(F.to_date("event_time").alias("event_date")).agg(
        count(F.col("user_id")).alias("n_visitors")
    )


def unique_visitors(df):
    return df.agg(F.count_distinct("user_id").alias("n_visitors"))


def daily_visitor_sketches(df, log2_size=SKETCH_LOG2):
    """``event_date, visitors``: a sketch of the distinct visitors of each day.

    Stored once, the sketches answer any range of days without the events; sketches of new days
    are added beside them.  A sketch takes at most about 2^``log2_size`` bytes, and its standard
    error is ``sketch_error``.
    """
    return df.groupBy(F.to_date("event_time").alias("event_date")).agg(
        F.hll_sketch_agg("user_id", F.lit(log2_size)).alias("visitors")
    )


def sketch_error(log2_size=SKETCH_LOG2):
    """The relative standard error of a count from sketches of that size."""
    return 1.04 / sqrt(2**log2_size)


def visitors_between(sketches, first, last):
    """``n_visitors``: about how many visitors came from ``first`` to ``last``, both included."""
    days = sketches.where(F.col("event_date").between(F.lit(first), F.lit(last)))
    return days.agg(
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("visitors")), F.lit(0)).alias("n_visitors")
    )


def rolling_visitors(sketches, days=7):
    """``event_date, n_visitors``: about how many visitors came in the ``days`` up to each stored day.

    Each sketch goes to the days whose range holds it, so sketches are shuffled and not events.
    """
    ends = F.explode(F.sequence("event_date", F.date_add("event_date", days - 1)))
    stored = sketches.select("event_date").distinct()
    return (
        sketches.select(ends.alias("event_date"), "visitors")
        .join(stored, "event_date", "left_semi")
        .groupBy("event_date")
        .agg(F.hll_sketch_estimate(F.hll_union_agg("visitors")).alias("n_visitors"))
    )


def column_means(df, columns):
    return df.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def feature_moments(df, columns):
    """Mean and sample standard deviation per numeric column: ``feature, mean, std``."""
    wide = df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"std_{c}") for c in columns],
    )
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"mean_{c}").alias("mean"),
            F.col(f"std_{c}").alias("std"),
        )
        for c in columns
    ]
    return wide.select(F.inline(F.array(*rows)))


QUARTILES = [0.25, 0.5, 0.75]
SUMMARY = ["feature", "count", "mean", "std", "min", "q25", "q50", "q75", "max"]


def feature_summary(df, columns, accuracy=None):
    """Count, mean, std, min, quartiles and max per numeric column.

    Quartiles are exact; the columns are stored once and read by column.  With ``accuracy`` the quartiles come from a bounded sketch, and
    nothing is sorted.
    """
    if accuracy:
        return _sketched_summary(df, columns, accuracy).select(*SUMMARY)
    stored = materialise(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "summary")
    quartiles = exact_quantiles(stored, columns, QUARTILES).withColumnsRenamed(
        {"q0": "q25", "q1": "q50", "q2": "q75"}
    )
    measured = _measured(stored, columns, MEASURES)
    # One row per column name: a column of nulls only has a count of 0 and no other measure.
    return measured.join(F.broadcast(quartiles), "feature", "left").select(*SUMMARY)


MEASURES = {
    "count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max
}


def _measured(numeric, columns, measures):
    """One row per column with the given aggregates, from one pass."""
    wide = numeric.agg(
        *[make(c).alias(f"{name}_{c}") for name, make in measures.items() for c in columns]
    )
    rows = [
        F.struct(
            F.lit(c).alias("feature"), *[F.col(f"{name}_{c}").alias(name) for name in measures]
        )
        for c in columns
    ]
    return wide.select(F.inline(F.array(*rows)))


def _sketched_summary(df, columns, accuracy):
    measures = {
        **MEASURES,
        "quartiles": lambda c: F.percentile_approx(c, QUARTILES, accuracy),
    }
    numeric = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return _measured(numeric, columns, measures).withColumns(
        {f"q{p}": F.col("quartiles")[i] for i, p in enumerate((25, 50, 75))}
    )


def correlations(df, columns):
    """Pearson correlation of every ordered pair of columns: ``a, b, corr``.

    A pair uses the rows where both are present; its correlation is null where one of them does
    not vary.  Every row gives a row per pair to one aggregate, whose counts, means and co-moments
    merge, so the table is read once and a task sends one row per pair.
    """
    numeric = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    # A row of nulls counts for nothing, and gives an empty table its pairs.
    none = df.sparkSession.range(1).select(F.array_repeat(F.lit(None).cast("double"), len(columns)).alias("v"))
    # The pairs are a constant, so the generated code stays short for any number of columns.
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
            for i, j in combinations_with_replacement(range(len(columns)), 2)
        ]
    )
    x, y = F.when(F.col("y").isNotNull(), F.col("x")), F.when(F.col("x").isNotNull(), F.col("y"))
    names = F.array(*[F.lit(c) for c in columns])
    half = (
        numeric.unionByName(none)
        .select("v", F.inline(pairs))
        .select("i", "j", F.get("v", F.col("i")).alias("x"), F.get("v", F.col("j")).alias("y"))
        .groupBy("i", "j")
        .agg(
            F.covar_pop("x", "y").alias("together"),
            (F.stddev_pop(x) * F.stddev_pop(y)).alias("spread"),
        )
        .select(
            F.get(names, F.col("i")).alias("a"),
            F.get(names, F.col("j")).alias("b"),
            F.try_divide("together", "spread").alias("corr"),
        )
    )
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    )
    known = F.when((F.col("a") == F.col("b")) & F.col("corr").isNotNull(), 1.0).otherwise(
        F.col("corr")
    )
    return half.select(known.alias("corr"), F.inline(both)).select("a", "b", "corr")


def histogram(df, column, bins=30):
    """Equal-width bins between the smallest and largest value, empty bins included.

    A value on an inner edge belongs to the bin above it, the largest value to the last bin.
    """
    value = F.col(column).cast("double")
    edges = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
    low, high = edges.getField("low"), edges.getField("high")
    place = F.floor(F.try_divide(F.lit(bins) * (value - low), high - low)) + 1
    counts = (
        df.where(value.isNotNull())
        .select(F.least(F.coalesce(place, F.lit(bins // 2 + 1)), F.lit(bins)).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    all_bins = df.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin")
    width = (high - low) / F.lit(bins)
    return all_bins.join(counts, "bin", "left").select(
        "bin",
        (low + (F.col("bin") - 1) * width).alias("bin_start"),
        (low + F.col("bin") * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def five_numbers(df, column):
    """Minimum, quartiles and maximum: what a box plot draws."""
    return exact_quantiles(df, [column], [0.0, 0.25, 0.5, 0.75, 1.0]).select(
        F.col("feature"),
        F.col("q0").alias("minimum"),
        F.col("q1").alias("lower_quartile"),
        F.col("q2").alias("median"),
        F.col("q3").alias("upper_quartile"),
        F.col("q4").alias("maximum"),
    )


def class_balance(df, target="target"):
    """Class counts, the share of positives and the weight that balances them."""
    counts = df.agg(
        F.count_if(F.col(target) == 0).alias("n_negative"),
        F.count_if(F.col(target) == 1).alias("n_positive"),
    )
    negative, positive = F.col("n_negative"), F.col("n_positive")
    return counts.select(
        "*",
        ratio(positive, negative + positive).alias("class_ratio"),
        F.when(positive > 0, ratio(negative, positive))
        .otherwise(F.lit(1.0))
        .alias("scale_pos_weight"),
    )
