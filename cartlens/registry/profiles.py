"""Registered queries that count, summarise and compare tables."""

from itertools import combinations

from pyspark.sql import functions as F

from cartlens.operators import behavior as B
from cartlens.operators import errors as E
from cartlens.operators import monitoring as M
from cartlens.operators import profiling as P
from cartlens.operators import splits
from cartlens.registry.base import clicks, features, register, rounded, scored
from cartlens.schema import NUMERIC_FEATURES
from cartlens.session import materialise


def _parts(spark, sf_dir):
    return B.with_category_parts(B.with_time_features(clicks(spark, sf_dir)))


@register("SELECT event_type, count(*) AS n_events FROM clicks GROUP BY event_type", ["clicks"])
def event_type_counts(spark, sf_dir):
    return P.value_counts(clicks(spark, sf_dir), "event_type")


@register(
    """SELECT CAST(h AS INTEGER) AS hour, count(row_id) AS n_events
FROM generate_series(0, 23) g(h) LEFT JOIN clicks ON hour(event_time) = h GROUP BY h""",
    ["clicks"],
)
def hourly_activity(spark, sf_dir):
    return P.hourly_activity(_parts(spark, sf_dir))


@register(
    """SELECT strftime(event_time, '%Y-%m-%d') AS event_date, count(DISTINCT user_id) AS n_visitors
FROM clicks GROUP BY 1""",
    ["clicks"],
)
def daily_unique_visitors(spark, sf_dir):
    daily = P.daily_unique_visitors(clicks(spark, sf_dir))
    return daily.withColumn("event_date", F.col("event_date").cast("string"))


@register(
    """SELECT CAST(d.event_date AS VARCHAR) AS event_date, count(DISTINCT c.user_id) AS n_visitors,
  true AS within_error
FROM (SELECT DISTINCT CAST(event_time AS DATE) AS event_date FROM clicks) d
JOIN clicks c ON CAST(c.event_time AS DATE) BETWEEN d.event_date - 6 AND d.event_date
GROUP BY d.event_date""",
    ["clicks"],
)
def weekly_visitors(spark, sf_dir):
    """Visitors of the seven days up to each day: exact, and whether stored sketches come near.

    The sketches may err by four standard errors.
    """
    events = clicks(spark, sf_dir).select("event_time", "user_id")
    sketches = materialise(P.daily_visitor_sketches(events), "visitor-sketches")
    estimates = P.rolling_visitors(sketches).withColumnRenamed("n_visitors", "estimate")
    seen = events.select(F.to_date("event_time").alias("day"), "user_id").distinct()
    ends = F.explode(F.sequence("day", F.date_add("day", 6))).alias("event_date")
    exact = (
        seen.select("user_id", ends)
        .join(estimates, "event_date")
        .groupBy("event_date", "estimate")
        .agg(F.count_distinct("user_id").alias("n_visitors"))
    )
    error = F.abs(F.col("estimate") - F.col("n_visitors"))
    return exact.select(
        F.col("event_date").cast("string").alias("event_date"),
        "n_visitors",
        (error <= 4 * P.sketch_error() * F.col("n_visitors") + 0.5).alias("within_error"),
    )


@register("SELECT count(DISTINCT user_id) AS n_visitors FROM clicks", ["clicks"])
def unique_visitors(spark, sf_dir):
    return P.unique_visitors(clicks(spark, sf_dir))


@register(
    """SELECT split_part(category_code, '.', 1) AS main_category, count(*) AS n_events FROM clicks
GROUP BY 1 ORDER BY n_events DESC, main_category LIMIT 10""",
    ["clicks"],
)
def top_main_categories(spark, sf_dir):
    return P.top_values(_parts(spark, sf_dir), "main_category")


@register(
    """SELECT category_code, count(*) AS n_events FROM clicks
GROUP BY 1 ORDER BY n_events DESC, category_code LIMIT 10""",
    ["clicks"],
)
def top_subcategories(spark, sf_dir):
    return P.top_values(_parts(spark, sf_dir), "category_code")


def _correlation_sql():
    names = [*NUMERIC_FEATURES, "target"]
    lines = []
    for a, b in combinations(names, 2):
        for left, right in ((a, b), (b, a)):
            lines.append(
                f"SELECT '{left}' AS a, '{right}' AS b, "
                f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) + 0.0 AS corr "
                "FROM features"
            )
    lines += [
        f"SELECT '{c}' AS a, '{c}' AS b, CAST(1 AS DOUBLE) AS corr FROM features LIMIT 1"
        for c in names
    ]
    return "\nUNION ALL ".join(f"({line})" for line in lines)


@register(_correlation_sql(), ["features"])
def feature_correlations(spark, sf_dir):
    return rounded(P.correlations(features(spark, sf_dir), [*NUMERIC_FEATURES, "target"]))


def _summary_sql():
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 4) AS mean, "
        f"round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q25, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS q50, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q75, "
        f"round(CAST(max({c}) AS DOUBLE), 4) AS max FROM features"
        for c in NUMERIC_FEATURES
    )


@register(_summary_sql(), ["features"])
def feature_summary(spark, sf_dir):
    return rounded(P.feature_summary(features(spark, sf_dir), NUMERIC_FEATURES), 4)


@register(
    """SELECT i AS bin, round(low + (i - 1) * ((high - low) / 30), 4) AS bin_start,
  round(low + i * ((high - low) / 30), 4) AS bin_end, count(session_duration) AS n
FROM (SELECT min(session_duration) AS low, max(session_duration) AS high FROM features)
CROSS JOIN generate_series(1, 30) g(i)
LEFT JOIN features
  ON least(CAST(floor(30 * (session_duration - low) / (high - low)) AS BIGINT) + 1, 30) = i
GROUP BY i, low, high""",
    ["features"],
)
def session_duration_histogram(spark, sf_dir):
    return rounded(P.histogram(features(spark, sf_dir), "session_duration"), 4)


@register(
    """SELECT 'price' AS feature, min(price) AS minimum,
  round(quantile_cont(price, 0.25), 6) AS lower_quartile, round(median(price), 6) AS median,
  round(quantile_cont(price, 0.75), 6) AS upper_quartile, max(price) AS maximum FROM clicks""",
    ["clicks"],
)
def price_boxplot(spark, sf_dir):
    return rounded(P.five_numbers(clicks(spark, sf_dir), "price"))


@register(
    """SELECT count(*) FILTER (WHERE target = 0) AS n_negative,
  count(*) FILTER (WHERE target = 1) AS n_positive, round(avg(target), 6) AS class_ratio,
  round(count(*) FILTER (WHERE target = 0)
    / CAST(count(*) FILTER (WHERE target = 1) AS DOUBLE), 6) AS scale_pos_weight
FROM labelled""",
    ["labelled"],
)
def class_balance(spark, sf_dir):
    return rounded(P.class_balance(B.labelled_carts(clicks(spark, sf_dir))))


def _moments_sql(table="features", factor=1):
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, avg({c}) * {factor} AS mean, stddev_samp({c}) AS std FROM {table}"
        for c in NUMERIC_FEATURES
    )


@register(
    f"SELECT feature, round(mean, 4) AS mean, round(std, 4) AS std FROM ({_moments_sql()})",
    ["features"],
)
def feature_moments(spark, sf_dir):
    return rounded(P.feature_moments(features(spark, sf_dir), NUMERIC_FEATURES), 4)


_AUC = """(SELECT sum((n - pos) * (cum_pos - pos / CAST(2 AS DOUBLE)))
  / (max(total_pos) * CAST(max(total_n) - max(total_pos) AS DOUBLE)) FROM curve)"""


@register(
    f"""SELECT feature, round(mean, 4) AS mean, round(std, 4) AS std,
  round({_AUC}, 6) AS auc_score, round((SELECT avg(label) FROM scored), 6) AS class_ratio
FROM ({_moments_sql()})""",
    ["features", "curve", "scored"],
)
def monitoring_baseline(spark, sf_dir):
    baseline = M.monitoring_baseline(
        features(spark, sf_dir), scored(spark, sf_dir), NUMERIC_FEATURES
    )
    return rounded(baseline.drop("created_at"), auc_score=6, class_ratio=6, mean=4, std=4)


@register(
    f"""SELECT feature, round(base, 4) AS baseline_mean, round(now, 4) AS current_mean,
  round(diff, 6) AS difference,
  CASE WHEN now IS NULL THEN 'missing' WHEN diff > 0.1 THEN 'drift' ELSE 'stable' END AS status
FROM (SELECT b.feature, b.mean AS base, n.mean AS now,
    CASE WHEN b.mean = 0 THEN abs(n.mean - b.mean) ELSE abs(n.mean - b.mean) / abs(b.mean) END
      AS diff
  FROM ({_moments_sql()}) b
  LEFT JOIN (SELECT feature, mean FROM ({_moments_sql(factor=1.15)})
    WHERE feature NOT IN ('monetary', 'price')
    UNION ALL SELECT 'price', avg(price) * 1.07 FROM features) n USING (feature))""",
    ["features"],
)
def drift_report(spark, sf_dir):
    frame = features(spark, sf_dir).select(*NUMERIC_FEATURES)
    baseline = P.feature_moments(frame, NUMERIC_FEATURES)
    shifted = [
        (F.col(c) * (1.07 if c == "price" else 1.15)).alias(c)
        for c in NUMERIC_FEATURES
        if c != "monetary"
    ]
    report = M.drift_report(baseline, frame.select(*shifted))
    return rounded(report, 4, difference=6)


@register(
    """SELECT targeted_spend, conversion_rate, current_revenue,
  round(spend * rate, 4) AS potential_revenue, round(spend * rate / revenue - 1, 6) AS lift
FROM (SELECT spend, rate, revenue, round(spend, 4) AS targeted_spend,
    round(rate, 6) AS conversion_rate, round(revenue, 4) AS current_revenue
  FROM (SELECT sum(price) FILTER (WHERE probability > 0.7) AS spend,
    avg(label) FILTER (WHERE probability > 0.7) AS rate,
    sum(price) FILTER (WHERE label = 1) AS revenue FROM scored))""",
    ["scored"],
)
def revenue_lift(spark, sf_dir):
    return rounded(
        M.revenue_lift(scored(spark, sf_dir)), 4, conversion_rate=6, lift=6
    )


@register(
    """SELECT *, CAST(probability >= 0.5 AS INTEGER) AS prediction FROM scored
WHERE label <> CAST(probability >= 0.5 AS INTEGER)""",
    ["scored"],
)
def misclassified_rows(spark, sf_dir):
    return E.misclassified(scored(spark, sf_dir))


@register(
    """SELECT *, CAST(1 AS INTEGER) AS prediction FROM scored
WHERE label = 0 AND probability > 0.85""",
    ["scored"],
)
def high_confidence_errors(spark, sf_dir):
    return E.high_confidence_errors(scored(spark, sf_dir))


@register(
    """SELECT cluster, count(*) AS n_errors, round(avg(price), 6) AS mean_price,
  round(stddev_samp(price), 6) AS std_price, round(avg(label), 6) AS mean_class,
  arg_min(hour, -1000 * same_hour + hour) AS peak_hour
FROM (SELECT row_id % 3 AS cluster, price, label, hour,
    count(*) OVER (PARTITION BY row_id % 3, hour) AS same_hour
  FROM scored WHERE label <> CAST(probability >= 0.5 AS INTEGER))
GROUP BY cluster""",
    ["scored"],
)
def error_cluster_summary(spark, sf_dir):
    wrong = E.misclassified(scored(spark, sf_dir))
    return rounded(E.cluster_summary(wrong.withColumn("cluster", F.pmod("row_id", F.lit(3)))))


@register(
    """SELECT row_id, price FROM labelled ORDER BY
  CAST('0x' || substr(md5('42-' || CAST(row_id AS VARCHAR)), 1, 15) AS BIGINT), row_id
LIMIT 500""",
    ["labelled"],
)
def hash_sample(spark, sf_dir):
    carts = B.cart_events(clicks(spark, sf_dir)).select("row_id", "price")
    return splits.hash_sample(carts, 500)


@register(
    """SELECT row_id, label, CASE WHEN rank < n_test THEN 'test'
  WHEN rank < n_test + floor((size - n_test) * CAST(0.25 AS DOUBLE) + 0.5) THEN 'validation'
  ELSE 'train' END AS split
FROM (SELECT *, floor(size * CAST(0.2 AS DOUBLE) + 0.5) AS n_test FROM class_ranks)""",
    ["class_ranks"],
)
def stratified_split(spark, sf_dir):
    rows = scored(spark, sf_dir).select("row_id", "label")
    return splits.stratified_split(rows, target="label")


@register(
    "SELECT row_id, label, CAST(rank % 5 AS INTEGER) AS fold FROM class_ranks", ["class_ranks"]
)
def stratified_folds(spark, sf_dir):
    return splits.stratified_folds(scored(spark, sf_dir).select("row_id", "label"), target="label")
