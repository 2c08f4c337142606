"""Column expressions shared by batch and stream."""

from pyspark.sql import functions as F

UNKNOWN = "unknown"


def parsed_time(column, pattern=None):
    """Text to timestamp; text that is no timestamp becomes null."""
    args = [F.col(column)] + ([F.lit(pattern)] if pattern else [])
    return F.try_to_timestamp(*args)


def day_of_week(column):
    """Monday is 0, Sunday 6."""
    return F.weekday(column)


def weekend_flag(column):
    return F.weekday(column).isin(5, 6).cast("int")


def elapsed_seconds(start, end):
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def elapsed_days(start, end):
    """Whole days of 24 hours, not midnights passed."""
    return F.timestamp_diff("DAY", start, end).cast("int")


def or_unknown(column):
    return F.coalesce(F.col(column), F.lit(UNKNOWN))


def main_category(column):
    return F.split(or_unknown(column), r"\.", 2)[0]


def sub_category(column):
    return F.try_element_at(F.split(or_unknown(column), r"\.", 2), F.lit(2))


def predicted_class(probability, threshold):
    return (F.col(probability) >= F.lit(threshold)).cast("int")


def confidence_band(probability):
    p = F.col(probability)
    return (
        F.when((p < 0.3) | (p > 0.7), "high")
        .when((p < 0.4) | (p > 0.6), "medium")
        .otherwise("low")
    )


def ratio(numerator, denominator):
    """Double division that gives 0 where the ratio is undefined."""
    return F.coalesce(
        F.try_divide(
            numerator.cast("double"), F.nullif(denominator.cast("double"), F.lit(0.0))
        ),
        F.lit(0.0),
    )


def stable_hash(key, seed):
    """A 60-bit integer from the key and the seed, the same on every layout and engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def hash_share(df, share, key, seed):
    """About ``share`` of the rows, always the same ones: those with small hashes of ``key``."""
    return df.where(stable_hash(key, seed) < F.lit(int(share * 2**60)))
