"""What the registered queries share: registration, input frames and their SQL."""

from pyspark.sql import functions as F

from cartlens.operators.behavior import labelled_carts, with_time_features
from cartlens.plans.model_frame import featured_carts
from cartlens.schema import NUMERIC_FEATURES
from cartlens.sources.clickstream import star_clickstream

QUERIES = {}
ORACLES = {}


def register(sql=None, needs=()):
    """Register a query under its function name, with the equivalent SQL if there is one.

    ``needs`` names the common table expressions of ``CTES`` the SQL reads.
    """

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = _with_ctes(sql, needs)
        return function

    return add


def rounded(df, digits=6, **special):
    """Round every double column, so that the order of summation cannot show."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if field.dataType.typeName() == "double":
            column = F.round(column, special.get(field.name, digits))
            # No negative zero.
            column = (column + F.lit(0.0)).alias(field.name)
        columns.append(column)
    return df.select(*columns)


def clicks(spark, sf_dir):
    return star_clickstream(spark, sf_dir)


TIME_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def with_time_text(df):
    return df.withColumn("event_time", F.date_format("event_time", TIME_TEXT))


def features(spark, sf_dir):
    """Cart events with the features that need no clustering, and the target."""
    names = [*NUMERIC_FEATURES, "main_category", "target"]
    return featured_carts(clicks(spark, sf_dir)).select("row_id", "user_id", *names)


def stand_in_probability(label):
    """A stand-in for a model score, with ties and values on the edges of bins."""
    parts = (
        F.pmod(F.col("row_id") * 7919, F.lit(800))
        + F.lit(100) * label
        + F.least(F.floor("price"), F.lit(99))
    )
    return parts / F.lit(1000.0)


def scored(spark, sf_dir):
    """Labelled cart events with the stand-in score."""
    carts = labelled_carts(with_time_features(clicks(spark, sf_dir)))
    return carts.select(
        "row_id",
        F.col("target").alias("label"),
        stand_in_probability(F.col("target")).alias("probability"),
        "price",
        "hour",
    )


CTES = {
    "clicks": """
  SELECT e.event_id AS row_id, e.ts AS event_time,
    CASE e.event_type WHEN 'click' THEN 'cart' WHEN 'error' THEN 'remove_from_cart'
      ELSE e.event_type END AS event_type,
    CAST(json_extract_string(e.props, '$.k') AS BIGINT) + 1 AS product_id,
    CAST(p.p_size AS BIGINT) AS category_id,
    lower(p.p_type) || '.' || replace(p.p_name, ' ', '.') AS category_code,
    p.p_brand AS brand, e.value AS price, e.user_id AS user_id,
    CAST(e.user_id AS VARCHAR) || '-' || CAST(CAST(e.ts AS DATE) AS VARCHAR) AS user_session
  FROM events e
  LEFT JOIN part p ON p.p_partkey = CAST(json_extract_string(e.props, '$.k') AS BIGINT) + 1""",
    "user_gaps": """
  SELECT user_id, coalesce(avg(gap), 0) / CAST(1000000 AS DOUBLE) AS avg_session_time FROM (
    SELECT user_id, epoch_us(event_time) - epoch_us(lag(event_time) OVER (
      PARTITION BY user_id, user_session ORDER BY event_time, row_id)) AS gap
    FROM clicks) GROUP BY user_id""",
    "user_counts": """
  SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS total_clicks,
    avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) AS purchase_freq
  FROM clicks GROUP BY user_id""",
    "rfm": """
  SELECT user_id,
    CAST(((SELECT max(epoch_us(event_time)) FROM clicks) + 86400000000
      - max(epoch_us(event_time))) // 86400000000 AS INTEGER) AS recency,
    count(DISTINCT user_session) AS frequency, sum(price) AS monetary
  FROM clicks GROUP BY user_id""",
    "sessions": """
  SELECT user_session, min(event_time) AS session_start, max(event_time) AS session_end,
    count(DISTINCT product_id) AS products_viewed, max(price) - min(price) AS price_range,
    (epoch_us(max(event_time)) - epoch_us(min(event_time))) / 1000000.0 AS session_duration
  FROM clicks GROUP BY user_session""",
    "labelled": """
  SELECT c.*, CAST(CASE WHEN user_session IN (
      SELECT user_session FROM clicks WHERE event_type = 'purchase')
    THEN 1 ELSE 0 END AS INTEGER) AS target
  FROM clicks c WHERE event_type = 'cart'""",
    "features": """
  SELECT l.row_id, l.user_id, l.price, CAST(hour(l.event_time) AS INTEGER) AS hour,
    CAST(CASE WHEN isodow(l.event_time) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
    uc.total_clicks, ug.avg_session_time, uc.purchase_freq, s.products_viewed, s.price_range,
    s.session_duration, r.recency, r.frequency, r.monetary,
    split_part(coalesce(l.category_code, 'unknown'), '.', 1) AS main_category, l.target
  FROM labelled l
  LEFT JOIN user_counts uc USING (user_id)
  LEFT JOIN user_gaps ug USING (user_id)
  LEFT JOIN rfm r USING (user_id)
  LEFT JOIN sessions s USING (user_session)""",
    "scored": """
  SELECT row_id, target AS label, price, CAST(hour(event_time) AS INTEGER) AS hour,
    (row_id * 7919 % 800 + 100 * target + least(CAST(floor(price) AS BIGINT), 99))
      / CAST(1000 AS DOUBLE) AS probability
  FROM labelled""",
    "curve": """
  SELECT probability, n, pos,
    CAST(sum(n) OVER down AS BIGINT) AS cum_n, CAST(sum(pos) OVER down AS BIGINT) AS cum_pos,
    CAST(sum(n) OVER () AS BIGINT) AS total_n, CAST(sum(pos) OVER () AS BIGINT) AS total_pos
  FROM (SELECT probability, count(*) AS n, sum(label) AS pos FROM scored GROUP BY probability)
  WINDOW down AS (ORDER BY probability DESC)""",
    "thresholds": """
  SELECT i * CAST(0.01 AS DOUBLE) + CAST(0.01 AS DOUBLE) AS threshold
  FROM generate_series(0, 98) g(i)""",
    "sweep": """
  SELECT threshold, tp, fp, positives, negatives,
    CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS precision,
    tp / CAST(positives AS DOUBLE) AS recall,
    2 * tp / CAST(tp + fp + positives AS DOUBLE) AS f_score,
    tp / CAST(positives AS DOUBLE) - fp / CAST(negatives AS DOUBLE) AS youden_j
  FROM (SELECT threshold,
      count(*) FILTER (WHERE probability >= threshold AND label = 1) AS tp,
      count(*) FILTER (WHERE probability >= threshold AND label = 0) AS fp,
      count(*) FILTER (WHERE label = 1) AS positives,
      count(*) FILTER (WHERE label = 0) AS negatives
    FROM scored, thresholds GROUP BY threshold)""",
    "class_ranks": """
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY hash, row_id) - 1 AS rank,
    count(*) OVER (PARTITION BY label) AS size
  FROM (SELECT *, CAST('0x' || substr(md5('42-' || CAST(row_id AS VARCHAR)), 1, 15) AS BIGINT)
    AS hash FROM scored)""",
}

_READS = {
    "user_gaps": ["clicks"],
    "user_counts": ["clicks"],
    "rfm": ["clicks"],
    "sessions": ["clicks"],
    "labelled": ["clicks"],
    "features": ["labelled", "user_counts", "user_gaps", "rfm", "sessions"],
    "scored": ["labelled"],
    "curve": ["scored"],
    "sweep": ["scored", "thresholds"],
    "class_ranks": ["scored"],
}


def _with_ctes(sql, needs):
    ordered = []

    def add(name):
        for inner in _READS.get(name, ()):
            add(inner)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        add(name)
    if not ordered:
        return sql
    # Each table is read many times below: compute it once.
    body = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in ordered)
    if sql.startswith("WITH "):
        return f"WITH {body},\n{sql[5:]}"
    return f"WITH {body}\n{sql}"
