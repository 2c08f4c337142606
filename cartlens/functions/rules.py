"""Row rules as columns: each rule is a name and the condition a good row meets.

A null in a checked column breaks the rule, as a missing value fails validation.
"""

from functools import reduce

from pyspark.sql import functions as F

VIOLATIONS = "violations"

# The event types that may occur.  The bounds in the rules below are fixed too.
EVENT_TYPES = ("view", "cart", "purchase", "remove_from_cart")


def _between(name, low, high=None):
    column = F.col(name)
    return column >= low if high is None else (column >= low) & (column <= high)


def raw_rules():
    return {
        "event_time": F.col("event_time").isNotNull(),
        "event_type": F.col("event_type").isin(*EVENT_TYPES),
        "product_id": F.col("product_id") > 0,
        "category_id": F.col("category_id") >= 0,
        "price_positive": F.col("price") > 0,
        "price_reasonable": F.col("price") <= 100000,
        "user_id": F.col("user_id") > 0,
        "user_session": F.col("user_session").isNotNull(),
    }


def _feature_rules():
    return {
        "price": F.col("price") > 0,
        "hour": _between("hour", 0, 23),
        "total_clicks": _between("total_clicks", 0),
        "avg_session_time": _between("avg_session_time", 0),
        "purchase_freq": _between("purchase_freq", 0, 1),
        "products_viewed": _between("products_viewed", 0),
        "price_range": _between("price_range", 0),
        "session_duration": _between("session_duration", 0),
        "recency": _between("recency", 0),
        "frequency": _between("frequency", 0),
        "monetary": _between("monetary", 0),
    }


def processed_rules():
    """Rules of the model frame, where ``main_category`` is an integer code."""
    return {
        **_feature_rules(),
        "is_weekend": _between("is_weekend", 0, 1),
        "main_category": _between("main_category", 0),
        "rfm_segment": _between("rfm_segment", 0),
        "target": _between("target", 0, 1),
    }


def request_rules():
    """Rules of a scoring input, where ``main_category`` is text."""
    return {
        **_feature_rules(),
        "is_weekend": F.col("is_weekend").isNotNull(),
        "main_category": F.col("main_category").isNotNull(),
        "rfm_segment": _between("rfm_segment", 0, 3),
    }


def not_null(df):
    """True where no column is null; a plain conjunction, which reaches the Parquet scan."""
    return reduce(lambda left, right: left & right, [F.col(c).isNotNull() for c in df.columns])


def _broken(condition):
    return ~F.coalesce(condition, F.lit(False))


def with_violations(df, rules):
    """Add the sorted names of the broken rules of each row."""
    marks = [F.when(_broken(rules[name]), F.lit(name)) for name in sorted(rules)]
    return df.withColumn(VIOLATIONS, F.array_compact(F.array(*marks)))


def is_valid(rules):
    return reduce(
        lambda left, right: left & right,
        [F.coalesce(rule, F.lit(False)) for rule in rules.values()],
    )


def valid_rows(df, rules):
    return df.where(is_valid(rules))


def quarantined_rows(df, rules):
    return with_violations(df, rules).where(F.size(VIOLATIONS) > 0)


def violation_counts(df, rules):
    """Rows broken per rule, over all rows, in one pass: ``rule, n_rows, n_broken``."""
    names = sorted(rules)
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(_broken(rules[name])).alias(name) for name in names],
    )
    return counts.unpivot("n_rows", names, "rule", "n_broken").select(
        "rule", "n_rows", "n_broken"
    )
