"""Reading clickstream events."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.functions.ordered import ACCURACY, MARGIN, running_sums
from cartlens.functions.rules import not_null
from cartlens.schema import CLICKSTREAM, RAW_CLICKSTREAM

STAR_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
STAR_PARTS = T.StructType(
    [
        T.StructField("p_partkey", T.LongType()),
        T.StructField("p_name", T.StringType()),
        T.StructField("p_brand", T.StringType()),
        T.StructField("p_type", T.StringType()),
        T.StructField("p_size", T.IntegerType()),
    ]
)

# Event names of the test tables and their clickstream names.
EVENT_NAMES = {"click": "cart", "error": "remove_from_cart"}


def read_clickstream(spark, path, schema=RAW_CLICKSTREAM):
    """Parquet events with a declared schema, so that no footer is read to infer one.

    Pass ``CLICKSTREAM`` for a table that has row keys.
    """
    return spark.read.schema(schema).parquet(path)


def with_row_ids(df):
    """Number the rows from 1 in the order of all their columns, as ``row_id``.

    The numbers depend on the rows alone, not on their storage; equal rows get different ones.
    """
    ranked = running_sums(df, [F.col(c) for c in df.columns], {"row_id": F.lit(1)})
    return ranked.select("row_id", *df.columns)


def adapt_events(events, parts):
    """Clickstream columns from an event stream and a product table."""
    event_type = F.col("event_type")
    for source, target in EVENT_NAMES.items():
        event_type = F.when(F.col("event_type") == source, target).otherwise(event_type)
    named = events.select(
        F.col("event_id").alias("row_id"),
        F.col("ts").alias("event_time"),
        event_type.alias("event_type"),
        (F.get_json_object("props", "$.k").cast("bigint") + 1).alias("product_id"),
        F.col("value").alias("price"),
        "user_id",
        F.concat(F.col("user_id"), F.lit("-"), F.col("ts").cast("date")).alias("user_session"),
    )
    # One row per product, stated as a distinct key: queries that use no product column then
    # skip the join and do not read ``props``.
    products = parts.dropDuplicates(["p_partkey"]).select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_size").cast("bigint").alias("category_id"),
        F.concat(F.lower("p_type"), F.lit("."), F.translate("p_name", " ", ".")).alias(
            "category_code"
        ),
        F.col("p_brand").alias("brand"),
    )
    return named.join(products, "product_id", "left").select(*CLICKSTREAM.fieldNames())


def star_clickstream(spark, sf_dir):
    """The clickstream over the ``events`` and ``part`` tables of one folder."""
    events = spark.read.schema(STAR_EVENTS).parquet(f"{sf_dir}/events.parquet")
    parts = spark.read.schema(STAR_PARTS).parquet(f"{sf_dir}/part.parquet")
    return adapt_events(events, parts)


def top_categories(df, k=10):
    """The ``k`` most frequent category codes; ties go to the smaller name."""
    return (
        df.where(F.col("category_code").isNotNull())
        .groupBy("category_code")
        .agg(F.count(F.lit(1)).alias("n_events"))
        .orderBy(F.desc("n_events"), "category_code")
        .limit(k)
    )


def first_rows(df, n, key="row_id"):
    """The ``n`` rows with the smallest ``key``, a number of which no two are equal.

    A sketch finds a key that surely has ``n`` keys at or below it and few more; only these are
    put in order, and the rows are then taken by a comparison with the n-th key, so a large cap
    does not gather rows in one task.
    """
    total = df.count()
    share = min(1.0, n / max(1, total) + MARGIN / ACCURACY)
    few = df.select(key)
    if share < 1:
        few = few.where(F.col(key) <= df.agg(F.percentile_approx(key, share, ACCURACY)).scalar())
    ranked = running_sums(few, [F.col(key)], {"rank": F.lit(1)})
    cutoff = ranked.where(F.col("rank") <= n).agg(F.max(key)).scalar()
    return df.where(F.col(key) <= cutoff)


def load_clickstream(df, k=10, limit=None):
    """Rows without any null whose category is one of the ``k`` most frequent."""
    # At most k rows, by the limit above.
    frequent = F.broadcast(top_categories(df, k).select("category_code"))
    loaded = df.where(not_null(df)).join(frequent, "category_code", "left_semi").select(*df.columns)
    if limit is None:
        return loaded
    keyed = loaded if "row_id" in df.columns else with_row_ids(loaded)
    return first_rows(keyed, limit).select(*df.columns)


def column_inventory(df):
    """One row per column: position, name, type, rows and nulls."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns],
    )
    described = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
                F.col("_rows").alias("n_rows"),
                F.col(field.name).alias("n_nulls"),
            )
            for i, field in enumerate(df.schema.fields, start=1)
        ]
    )
    return counts.select(F.inline(described))
