"""Column layouts of the event table, the model frame and the scoring input."""

from pyspark.sql import types as T

# The column names and types below, and their order.
# Raw clickstream events.
RAW_CLICKSTREAM = T.StructType(
    [
        T.StructField("event_time", T.TimestampNTZType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("category_id", T.LongType()),
        T.StructField("category_code", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("user_session", T.StringType()),
    ]
)

# The same with a stable row key: every tie in a sort is broken on it, and scores are joined
# back to labels on it.  ``with_row_ids`` adds one to a table that has none.
CLICKSTREAM = T.StructType([T.StructField("row_id", T.LongType()), *RAW_CLICKSTREAM.fields])

REQUIRED_COLUMNS = [
    "event_time",
    "event_type",
    "product_id",
    "price",
    "user_id",
    "user_session",
]

NUMERIC_FEATURES = [
    "price",
    "hour",
    "is_weekend",
    "total_clicks",
    "avg_session_time",
    "purchase_freq",
    "products_viewed",
    "price_range",
    "session_duration",
    "recency",
    "frequency",
    "monetary",
]
CATEGORICAL_FEATURES = ["main_category", "rfm_segment"]
FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES
TARGET = "target"

RFM_COLUMNS = ["recency", "frequency", "monetary"]

SCORING_INPUT = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("is_weekend", T.BooleanType()),
        T.StructField("total_clicks", T.LongType()),
        T.StructField("avg_session_time", T.DoubleType()),
        T.StructField("purchase_freq", T.DoubleType()),
        T.StructField("products_viewed", T.LongType()),
        T.StructField("price_range", T.DoubleType()),
        T.StructField("session_duration", T.DoubleType()),
        T.StructField("recency", T.IntegerType()),
        T.StructField("frequency", T.LongType()),
        T.StructField("monetary", T.DoubleType()),
        T.StructField("main_category", T.StringType()),
        T.StructField("rfm_segment", T.IntegerType()),
    ]
)
