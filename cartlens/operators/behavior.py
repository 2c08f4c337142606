"""Time, user and session features."""

from pyspark.sql import functions as F

from cartlens.functions import expressions as X
from cartlens.functions.ordered import previous_value
from cartlens.functions.skew import join_key_stats
from cartlens.schema import RFM_COLUMNS

MICROS = 1e6


def with_time_features(df):
    return df.withColumns(
        {
            "hour": F.hour("event_time"),
            "day_of_week": X.day_of_week("event_time"),
            "is_weekend": X.weekend_flag("event_time"),
        }
    )


def with_category_parts(df):
    """``unknown`` for a null code, and the code split at its first dot."""
    return df.withColumns(
        {
            "main_category": X.main_category("category_code"),
            "sub_category": X.sub_category("category_code"),
            "category_code": X.or_unknown("category_code"),
        }
    )


def user_sessions(df):
    """One row per (user, session): everything the user statistics are made of."""
    is_purchase = F.col("event_type") == "purchase"
    return df.groupBy("user_id", "user_session").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("event_type") == "view").alias("views"),
        F.count_if(is_purchase).alias("purchases"),
        F.min("event_time").alias("first_time"),
        F.max("event_time").alias("last_time"),
        F.sum("price").alias("spend"),
        F.coalesce(F.sum(F.when(is_purchase, F.col("price"))), F.lit(0.0)).alias(
            "purchase_spend"
        ),
    )


def _behavior_columns():
    # The gaps of a session add up to its length, so their mean needs no sort and no lag.
    # The sum is a double: a bigint of microseconds could overflow on a very busy user.
    spans = F.sum(F.timestamp_diff("MICROSECOND", "first_time", "last_time").cast("double"))
    gaps = F.sum(F.col("events") - 1)
    return [
        F.sum("views").alias("total_clicks"),
        (F.sum("purchases") / F.sum("events")).alias("purchase_freq"),
        (X.ratio(spans, gaps) / MICROS).alias("avg_session_time"),
    ]


def user_behavior(df):
    """Views, purchase share and mean in-session gap in seconds of each user."""
    return user_sessions(df).groupBy("user_id").agg(*_behavior_columns())


def _rfm_columns(purchases_only):
    return [
        F.max("last_time").alias("_last"),
        F.count("user_session").alias("frequency"),
        F.sum("purchase_spend" if purchases_only else "spend").alias("monetary"),
    ]


def _with_recency(users):
    """Days from the last event of a user to one day after the last event of all users.

    The latest time comes from the user table, so the events are not read for it once more.
    """
    latest = users.agg(F.max("_last").alias("latest"))
    dated = users.crossJoin(F.broadcast(latest))  # one row
    recency = X.elapsed_days("_last", F.col("latest") + F.expr("INTERVAL 1 DAY"))
    return dated.withColumn("recency", recency).drop("_last", "latest")


def rfm(df, purchases_only=False):
    """Recency, frequency and monetary value of each user.

    Recency counts whole days up to one day after the last event of all; monetary sums the
    price of every event unless ``purchases_only``.
    """
    users = user_sessions(df).groupBy("user_id").agg(*_rfm_columns(purchases_only))
    return _with_recency(users).select("user_id", *RFM_COLUMNS)


def user_profile(df, purchases_only=False):
    """Behaviour and RFM of each user from one aggregate."""
    users = user_sessions(df).groupBy("user_id").agg(
        *_behavior_columns(), *_rfm_columns(purchases_only)
    )
    return _with_recency(users)


def session_stats(df):
    """Start, end, length, distinct products, price range and purchase flag per session."""
    stats = df.groupBy("user_session").agg(
        F.min("event_time").alias("session_start"),
        F.max("event_time").alias("session_end"),
        F.count_distinct("product_id").alias("products_viewed"),
        (F.max("price") - F.min("price")).alias("price_range"),
        F.max((F.col("event_type") == "purchase").cast("int")).alias("has_purchase"),
    )
    return stats.withColumn(
        "session_duration", X.elapsed_seconds("session_start", "session_end")
    )


def with_user_behavior(df):
    return join_key_stats(df, user_behavior(df), "user_id")


def with_session_stats(df):
    return join_key_stats(df, session_stats(df).drop("has_purchase"), "user_session")


def with_rfm(df, rfm_table=None):
    """RFM columns on every event; a name the events already have gets the suffix ``_rfm``."""
    table = rfm(df) if rfm_table is None else rfm_table
    taken = set(df.columns) - {"user_id"}
    renamed = table.select(
        *[F.col(c).alias(f"{c}_rfm" if c in taken else c) for c in table.columns]
    )
    return join_key_stats(df, renamed, "user_id")


def with_event_gaps(df):
    """Seconds since the previous event of the same user and session; null on the first."""
    narrow = df.select("row_id", "user_id", "user_session", "event_time")
    previous = previous_value(
        narrow, ["user_id", "user_session"], ["event_time", "row_id"], "event_time", "previous"
    )
    return previous.withColumn(
        "gap_seconds", X.elapsed_seconds("previous", "event_time")
    ).drop("previous")


def naive_user_gap(df):
    """Mean gap in seconds over all events of a user, sessions ignored; null for one event."""
    stats = df.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min("event_time").alias("first_time"),
        F.max("event_time").alias("last_time"),
    )
    return stats.select(
        "user_id",
        "n_events",
        (
            F.try_divide(
                F.timestamp_diff("MICROSECOND", "first_time", "last_time"),
                F.col("n_events") - 1,
            )
            / MICROS
        ).alias("mean_gap_seconds"),
    )


def cart_events(df):
    return df.where(F.col("event_type") == "cart")


def purchase_sessions(df):
    """One row per session: 1 when it has a purchase, else 0."""
    return df.groupBy("user_session").agg(
        F.max((F.col("event_type") == "purchase").cast("int")).alias("target")
    )


def labelled_carts(df):
    """Cart events with ``target``: 1 when their session has a purchase."""
    return join_key_stats(cart_events(df), purchase_sessions(df), "user_session")
