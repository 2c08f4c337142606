"""Registered queries on raw events."""

from pyspark.sql import functions as F

from cartlens.functions import expressions as X
from cartlens.functions.rules import (
    processed_rules,
    quarantined_rows,
    raw_rules,
    request_rules,
    violation_counts,
)
from cartlens.operators import behavior as B
from cartlens.operators import cleaning
from cartlens.operators.encoding import with_category_codes
from cartlens.operators.profiling import column_means, value_counts
from cartlens.operators.segments import with_zscores
from cartlens.plans.scoring import scoring_inputs as inputs
from cartlens.registry.base import clicks, features, register, rounded, with_time_text
from cartlens.schema import CLICKSTREAM, RFM_COLUMNS
from cartlens.session import materialise
from cartlens.sources import clickstream as S

EVENT_COLUMNS = """row_id, strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') AS event_time, event_type,
  product_id, category_id, category_code, brand, price, user_id, user_session"""


def _with_null_brand(df):
    return df.withColumn("brand", F.nullif("brand", F.lit("Brand#13")))


def _inventory_sql():
    types = [(f.name, f.dataType.simpleString()) for f in CLICKSTREAM.fields]
    lines = []
    for position, (name, data_type) in enumerate(types, start=1):
        value = "nullif(brand, 'Brand#13')" if name == "brand" else name
        lines.append(
            f"SELECT CAST({position} AS INTEGER) AS position, '{name}' AS column_name, "
            f"'{data_type}' AS data_type, count(*) AS n_rows, "
            f"count(*) - count({value}) AS n_nulls FROM clicks"
        )
    return "\nUNION ALL ".join(lines)


@register(f"SELECT {EVENT_COLUMNS} FROM clicks", ["clicks"])
def clickstream_scan(spark, sf_dir):
    return with_time_text(clicks(spark, sf_dir))


@register(_inventory_sql(), ["clicks"])
def column_inventory(spark, sf_dir):
    return S.column_inventory(_with_null_brand(clicks(spark, sf_dir)))


@register(f"SELECT {EVENT_COLUMNS} FROM clicks ORDER BY row_id LIMIT 1000", ["clicks"])
def first_rows(spark, sf_dir):
    return with_time_text(S.first_rows(clicks(spark, sf_dir), 1000))


@register(
    """SELECT category_code, count(*) AS n_events FROM clicks WHERE category_code IS NOT NULL
GROUP BY category_code ORDER BY n_events DESC, category_code LIMIT 10""",
    ["clicks"],
)
def top_categories(spark, sf_dir):
    return S.top_categories(clicks(spark, sf_dir))


@register(
    f"""SELECT {EVENT_COLUMNS} FROM clicks WHERE brand <> 'Brand#13' AND category_code IN (
  SELECT category_code FROM clicks WHERE category_code IS NOT NULL
  GROUP BY category_code ORDER BY count(*) DESC, category_code LIMIT 10)""",
    ["clicks"],
)
def load_clickstream(spark, sf_dir):
    return with_time_text(S.load_clickstream(_with_null_brand(clicks(spark, sf_dir))))


@register(
    """SELECT category_code, count(*) AS n_events FROM clicks
WHERE category_code IN (
  SELECT category_code FROM clicks GROUP BY category_code
  ORDER BY count(*) DESC, category_code LIMIT 10)
GROUP BY category_code""",
    ["clicks"],
)
def loaded_category_counts(spark, sf_dir):
    return value_counts(S.load_clickstream(clicks(spark, sf_dir)), "category_code")


@register(
    f"SELECT {EVENT_COLUMNS} FROM clicks WHERE brand <> 'Brand#13'",
    ["clicks"],
)
def null_rows_dropped(spark, sf_dir):
    return with_time_text(cleaning.drop_null_rows(_with_null_brand(clicks(spark, sf_dir))))


@register(f"SELECT {EVENT_COLUMNS} FROM clicks", ["clicks"])
def duplicate_rows_dropped(spark, sf_dir):
    """The events and a copy of them under other keys give the events."""
    events = clicks(spark, sf_dir)
    copies = events.withColumn("row_id", F.col("row_id") + 10**12)
    return with_time_text(cleaning.drop_duplicate_rows(copies.unionAll(events)))


def _rule_counts_sql(table, rules):
    return "\nUNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) AS n_rows, "
        f"count(*) FILTER (WHERE NOT ({rule})) AS n_broken FROM {table}"
        for name, rule in rules.items()
    )


_RAW_SQL = {
    "event_time": "event_time IS NOT NULL",
    "event_type": "event_type IN ('view', 'cart', 'purchase', 'remove_from_cart')",
    "product_id": "product_id > 0",
    "category_id": "category_id >= 0",
    "price_positive": "price > 0",
    "price_reasonable": "price <= 100000",
    "user_id": "user_id > 0",
    "user_session": "user_session IS NOT NULL",
}
_FEATURE_SQL = {
    "price": "price - 5 > 0",
    "hour": "hour + 1 BETWEEN 0 AND 23",
    "total_clicks": "total_clicks >= 0",
    "avg_session_time": "avg_session_time >= 0",
    "purchase_freq": "purchase_freq * 5 BETWEEN 0 AND 1",
    "products_viewed": "products_viewed >= 0",
    "price_range": "price_range >= 0",
    "session_duration": "session_duration >= 0",
    "recency": "recency >= 0",
    "frequency": "frequency >= 0",
    "monetary": "monetary >= 0",
}


@register(_rule_counts_sql("clicks", _RAW_SQL), ["clicks"])
def raw_rule_counts(spark, sf_dir):
    return violation_counts(clicks(spark, sf_dir), raw_rules())


@register(
    """SELECT row_id, event_type, user_id, price, concat_ws(',',
  CASE WHEN event_type NOT IN ('view', 'cart', 'purchase', 'remove_from_cart')
    THEN 'event_type' END,
  CASE WHEN NOT price > 0 THEN 'price_positive' END,
  CASE WHEN NOT user_id > 0 THEN 'user_id' END) AS violations
FROM clicks
WHERE event_type NOT IN ('view', 'cart', 'purchase', 'remove_from_cart')
  OR NOT price > 0 OR NOT user_id > 0""",
    ["clicks"],
)
def quarantined_events(spark, sf_dir):
    bad = quarantined_rows(clicks(spark, sf_dir), raw_rules())
    return bad.select(
        "row_id", "event_type", "user_id", "price", F.concat_ws(",", "violations").alias("violations")
    )


def _strained_features(spark, sf_dir, segments):
    """The feature table, shifted so that some rules break."""
    return features(spark, sf_dir).withColumns(
        {
            "price": F.col("price") - 5,
            "hour": F.col("hour") + 1,
            "purchase_freq": F.col("purchase_freq") * 5,
            "rfm_segment": F.pmod("user_id", F.lit(segments)),
        }
    )


@register(
    _rule_counts_sql(
        "features",
        {
            **_FEATURE_SQL,
            "is_weekend": "is_weekend BETWEEN 0 AND 1",
            "main_category": "main_category IS NOT NULL",
            "rfm_segment": "user_id % 4 >= 0",
            "target": "target BETWEEN 0 AND 1",
        },
    ),
    ["features"],
)
def processed_rule_counts(spark, sf_dir):
    # Written out, as the dictionary and the join both read it.
    frame = materialise(_strained_features(spark, sf_dir, 4), "features")
    coded = with_category_codes(frame, ["main_category"])
    return violation_counts(coded, processed_rules())


@register(
    _rule_counts_sql(
        "features",
        {
            **_FEATURE_SQL,
            "is_weekend": "is_weekend IS NOT NULL",
            "main_category": "main_category IS NOT NULL",
            "rfm_segment": "user_id % 5 BETWEEN 0 AND 3",
        },
    ),
    ["features"],
)
def request_rule_counts(spark, sf_dir):
    return violation_counts(_strained_features(spark, sf_dir, 5), request_rules())


@register(f"SELECT {EVENT_COLUMNS} FROM clicks WHERE event_type = 'cart'", ["clicks"])
def cart_events(spark, sf_dir):
    return with_time_text(B.cart_events(clicks(spark, sf_dir)))


@register(
    """SELECT row_id, event_type, round(price, 6) AS price FROM clicks, (
  SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM clicks)
WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)""",
    ["clicks"],
)
def price_outliers(spark, sf_dir):
    rows = cleaning.outliers_iqr(clicks(spark, sf_dir), "price")
    return rounded(rows.select("row_id", "event_type", "price"))


@register(
    """SELECT row_id, CASE WHEN event_type = 'signup' THEN NULL
  ELSE strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') END AS event_time FROM clicks""",
    ["clicks"],
)
def parsed_times(spark, sf_dir):
    text = F.when(F.col("event_type") == "signup", "not a time").otherwise(
        F.col("event_time").cast("string")
    )
    texts = clicks(spark, sf_dir).select("row_id", text.alias("text"))
    return with_time_text(texts.select("row_id", X.parsed_time("text").alias("event_time")))


@register(
    """SELECT row_id, CAST(hour(event_time) AS INTEGER) AS hour,
  CAST(isodow(event_time) - 1 AS INTEGER) AS day_of_week,
  CAST(isodow(event_time) >= 6 AS INTEGER) AS is_weekend,
  strftime(event_time, '%Y-%m-%d') AS event_date
FROM clicks""",
    ["clicks"],
)
def time_features(spark, sf_dir):
    return B.with_time_features(clicks(spark, sf_dir)).select(
        "row_id",
        "hour",
        "day_of_week",
        "is_weekend",
        F.to_date("event_time").cast("string").alias("event_date"),
    )


@register(
    """SELECT row_id, coalesce(code, 'unknown') AS category_code,
  split_part(coalesce(code, 'unknown'), '.', 1) AS main_category,
  CASE WHEN code LIKE '%.%' THEN substr(code, strpos(code, '.') + 1) END AS sub_category
FROM (SELECT row_id, CASE WHEN brand <> 'Brand#13' THEN category_code END AS code FROM clicks)""",
    ["clicks"],
)
def category_parts(spark, sf_dir):
    code = F.when(F.col("brand") != "Brand#13", F.col("category_code"))
    return B.with_category_parts(clicks(spark, sf_dir).withColumn("category_code", code)).select(
        "row_id", "category_code", "main_category", "sub_category"
    )


@register(
    """SELECT row_id,
  CAST(dense_rank() OVER (ORDER BY category_code) - 1 AS INTEGER) AS category_code,
  CAST(dense_rank() OVER (ORDER BY coalesce(nullif(brand, 'Brand#13'), 'unknown')) - 1
    AS INTEGER) AS brand,
  CAST(dense_rank() OVER (ORDER BY split_part(category_code, '.', 1)) - 1 AS INTEGER)
    AS main_category
FROM clicks""",
    ["clicks"],
)
def category_codes(spark, sf_dir):
    columns = ["category_code", "brand", "main_category"]
    parts = B.with_category_parts(_with_null_brand(clicks(spark, sf_dir)))
    return with_category_codes(parts.select("row_id", *columns), columns)


@register(
    """SELECT user_id, total_clicks, round(purchase_freq, 6) AS purchase_freq,
  round(avg_session_time, 6) AS avg_session_time
FROM user_counts JOIN user_gaps USING (user_id)""",
    ["user_counts", "user_gaps"],
)
def user_behavior(spark, sf_dir):
    return rounded(B.user_behavior(clicks(spark, sf_dir)))


@register(
    """SELECT row_id, user_id, event_type, total_clicks, round(purchase_freq, 6) AS purchase_freq,
  round(avg_session_time, 6) AS avg_session_time
FROM clicks LEFT JOIN user_counts USING (user_id) LEFT JOIN user_gaps USING (user_id)""",
    ["user_counts", "user_gaps"],
)
def events_with_user_behavior(spark, sf_dir):
    return rounded(
        B.with_user_behavior(clicks(spark, sf_dir)).select(
            "row_id", "user_id", "event_type", "total_clicks", "purchase_freq", "avg_session_time"
        )
    )


@register(
    """SELECT user_session, strftime(session_start, '%Y-%m-%d %H:%M:%S.%f') AS session_start,
  strftime(session_end, '%Y-%m-%d %H:%M:%S.%f') AS session_end, products_viewed,
  round(price_range, 6) AS price_range, round(session_duration, 6) AS session_duration
FROM sessions""",
    ["sessions"],
)
def session_stats(spark, sf_dir):
    stats = B.session_stats(clicks(spark, sf_dir)).drop("has_purchase")
    for edge in ("session_start", "session_end"):
        stats = stats.withColumn(edge, F.date_format(edge, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return rounded(stats)


@register(
    """SELECT row_id, user_session, products_viewed, round(price_range, 6) AS price_range,
  round(session_duration, 6) AS session_duration
FROM clicks LEFT JOIN sessions USING (user_session)""",
    ["sessions"],
)
def events_with_session_stats(spark, sf_dir):
    return rounded(
        B.with_session_stats(clicks(spark, sf_dir)).select(
            "row_id", "user_session", "products_viewed", "price_range", "session_duration"
        )
    )


@register(
    "SELECT user_id, recency, frequency, round(monetary, 4) AS monetary FROM rfm",
    ["rfm"],
)
def rfm(spark, sf_dir):
    return rounded(B.rfm(clicks(spark, sf_dir)), 4)


@register(
    """SELECT user_id, CAST((last_of_all + 86400000000 - last_time) // 86400000000 AS INTEGER)
  AS recency, frequency, round(monetary, 4) AS monetary
FROM (SELECT user_id, max(epoch_us(event_time)) AS last_time,
    count(DISTINCT user_session) AS frequency,
    coalesce(sum(price) FILTER (WHERE event_type = 'purchase'), 0) AS monetary
  FROM clicks GROUP BY user_id), (SELECT max(epoch_us(event_time)) AS last_of_all FROM clicks)""",
    ["clicks"],
)
def rfm_of_purchases(spark, sf_dir):
    return rounded(B.rfm(clicks(spark, sf_dir), purchases_only=True), 4)


@register(
    """SELECT row_id, user_id, price AS monetary, recency, frequency,
  round(rfm.monetary, 4) AS monetary_rfm
FROM clicks LEFT JOIN rfm USING (user_id)""",
    ["clicks", "rfm"],
)
def events_with_rfm(spark, sf_dir):
    events = clicks(spark, sf_dir)
    renamed = events.select("row_id", "user_id", F.col("price").alias("monetary"))
    joined = B.with_rfm(renamed, B.rfm(events))
    return joined.select(
        "row_id",
        "user_id",
        "monetary",
        "recency",
        "frequency",
        F.round("monetary_rfm", 4).alias("monetary_rfm"),
    )


@register(
    """SELECT round(avg(recency), 6) AS mean_recency, round(avg(frequency), 6) AS mean_frequency,
  round(avg(monetary), 6) AS mean_monetary FROM rfm""",
    ["rfm"],
)
def rfm_means(spark, sf_dir):
    return rounded(column_means(B.rfm(clicks(spark, sf_dir)), RFM_COLUMNS))


@register(
    "SELECT user_id, "
    + ", ".join(
        f"round((CAST({c} AS DOUBLE) - (SELECT avg({c}) FROM rfm)) / "
        f"(SELECT stddev_pop({c}) FROM rfm), 6) + 0.0 AS {c}_z"
        for c in RFM_COLUMNS
    )
    + " FROM rfm",
    ["rfm"],
)
def rfm_zscores(spark, sf_dir):
    scaled = with_zscores(B.rfm(clicks(spark, sf_dir)), RFM_COLUMNS)
    return rounded(scaled.select("user_id", *[f"{c}_z" for c in RFM_COLUMNS]))


@register(
    """SELECT row_id, user_id, user_session, round((epoch_us(event_time) - epoch_us(
  lag(event_time) OVER (PARTITION BY user_id, user_session ORDER BY event_time, row_id)))
  / 1000000.0, 6) AS gap_seconds
FROM clicks""",
    ["clicks"],
)
def event_gaps(spark, sf_dir):
    gaps = B.with_event_gaps(clicks(spark, sf_dir))
    return rounded(gaps.select("row_id", "user_id", "user_session", "gap_seconds"))


@register(
    """SELECT user_id, count(*) AS n_events,
  round(avg(gap) / CAST(1000000 AS DOUBLE), 6) AS mean_gap_seconds
FROM (SELECT user_id, epoch_us(event_time) - epoch_us(lag(event_time) OVER (
    PARTITION BY user_id ORDER BY event_time, row_id)) AS gap FROM clicks)
GROUP BY user_id""",
    ["clicks"],
)
def naive_user_gap(spark, sf_dir):
    return rounded(B.naive_user_gap(clicks(spark, sf_dir)))


@register("SELECT row_id, user_session, target FROM labelled", ["labelled"])
def labelled_carts(spark, sf_dir):
    return B.labelled_carts(clicks(spark, sf_dir)).select("row_id", "user_session", "target")


_FRAME_SQL = """SELECT row_id, price, hour, is_weekend, total_clicks,
  round(avg_session_time, 6) AS avg_session_time, round(purchase_freq, 6) AS purchase_freq,
  products_viewed, round(price_range, 6) AS price_range,
  round(session_duration, 6) AS session_duration, recency, frequency,
  round(monetary, 4) AS monetary, main_category"""


@register(_FRAME_SQL + ", target FROM features", ["features"])
def model_features(spark, sf_dir):
    return rounded(features(spark, sf_dir).drop("user_id"), monetary=4)


@register(
    _FRAME_SQL + ", CAST(user_id % 4 AS INTEGER) AS rfm_segment FROM features", ["features"]
)
def scoring_inputs(spark, sf_dir):
    requests = features(spark, sf_dir).withColumn(
        "rfm_segment", F.pmod("user_id", F.lit(4)).cast("int")
    )
    as_sent = requests.withColumn("is_weekend", F.col("is_weekend") == 1)
    return rounded(inputs(as_sent), monetary=4)
