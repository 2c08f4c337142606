"""Events to model frame."""

from pyspark.sql import functions as F

from cartlens.functions.rules import raw_rules, violation_counts
from cartlens.functions.skew import hot_keys, join_key_stats
from cartlens.operators import behavior as B
from cartlens.operators.cleaning import clean
from cartlens.operators.encoding import category_dictionary, with_category_codes
from cartlens.operators.segments import rfm_segments
from cartlens.schema import FEATURES, TARGET
from cartlens.session import materialise
from cartlens.sources.clickstream import with_row_ids


def featured_carts(events, users=None):
    """Cart events with user, session and RFM features, text category and target.

    The cart filter comes before the joins: only cart rows travel to the statistics, and only
    sessions with a cart event get statistics.
    """
    users = B.user_profile(events) if users is None else users
    carts = B.with_category_parts(B.with_time_features(B.cart_events(events))).select(
        "row_id", "user_id", "user_session", "price", "hour", "is_weekend", "main_category"
    )
    hot = hot_keys(B.cart_events(events), ["user_id", "user_session"])
    with_users = join_key_stats(carts, users, "user_id", hot)
    wanted = B.cart_events(events).select("user_session").distinct()
    sessions = B.session_stats(events.join(wanted, "user_session", "left_semi"))
    with_sessions = join_key_stats(with_users, sessions, "user_session", hot)
    return with_sessions.withColumn(TARGET, F.col("has_purchase"))


def rule_counts(events):
    """Rows broken per raw rule among the events that the model frame is made of."""
    return violation_counts(clean(events), raw_rules())


def model_frame(events, segments=4, seed=42, encode=False, purchases_only=False):
    """The full frame: ``row_id``, 14 features and target.

    Events without a ``row_id`` get one after cleaning.  The cleaned events are written out
    once, as four branches read them; ``rule_counts`` tells which rules they break.  ``main_category``
    stays text, and is indexed inside the training pipeline, so that a scoring input can be
    given as text too; ``encode`` replaces it by its integer code among all ``events``.
    """
    events = clean(events)
    if "row_id" not in events.columns:
        events = with_row_ids(events)
    events = materialise(events, "clean-events")
    users = rfm_segments(B.user_profile(events, purchases_only), segments, seed)
    frame = featured_carts(events, users).select("row_id", *FEATURES, TARGET)
    if encode:
        categories = B.with_category_parts(events)
        dictionary = category_dictionary(categories, ["main_category"])
        frame = with_category_codes(frame, ["main_category"], dictionary)
    return frame
