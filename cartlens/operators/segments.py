"""RFM scaling and segments."""

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cartlens.functions.expressions import hash_share
from cartlens.functions.ordered import stable_layout
from cartlens.schema import RFM_COLUMNS
from cartlens.session import materialise


def with_zscores(df, columns, suffix="_z"):
    """Add ``(x - mean) / population std``; a constant column gives 0."""
    moments = df.agg(
        F.struct(
            *[F.avg(c).alias(f"mean_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
        ).alias("moments")
    ).scalar()
    scaled = {}
    for c in columns:
        std = moments.getField(f"std_{c}")
        scaled[f"{c}{suffix}"] = (F.col(c) - moments.getField(f"mean_{c}")) / F.when(
            std == 0, F.lit(1.0)
        ).otherwise(std)
    return df.withColumns(scaled)


def rfm_segments(users, k=4, seed=42):
    """Add ``rfm_segment``: k-means on z-scored RFM, numbered by rising mean monetary value.

    ``users`` has one row per user.  It is written out, as k-means reads it many times.
    """
    users = materialise(users, "users")
    scaled = with_zscores(users, RFM_COLUMNS)
    assembler = VectorAssembler(
        inputCols=[f"{c}_z" for c in RFM_COLUMNS], outputCol="_scaled"
    )
    vectors = assembler.transform(scaled)
    model = KMeans(k=k, seed=seed, featuresCol="_scaled", predictionCol="_cluster").fit(
        stable_layout(vectors.select("user_id", "_scaled"), "user_id")
    )
    monetary = [float(center[2]) for center in model.clusterCenters()]
    by_monetary = sorted(range(len(monetary)), key=lambda c: monetary[c])
    number = F.array(*[F.lit(by_monetary.index(c)) for c in range(len(monetary))])
    return model.transform(vectors).withColumn(
        "rfm_segment", F.get(number, F.col("_cluster"))
    ).select(*users.columns, "rfm_segment")


def segment_sizes(segmented):
    """Events and users per segment of an event table."""
    return segmented.groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_distinct("user_id").alias("n_users"),
    )


def rfm_scatter(segmented_users, share=None, seed=42):
    """Z-scored RFM and segment of every user, or of a repeatable ``share`` of them."""
    scaled = with_zscores(segmented_users, RFM_COLUMNS)
    if share is not None:
        scaled = hash_share(scaled, share, "user_id", seed)
    return scaled.select("user_id", *[f"{c}_z" for c in RFM_COLUMNS], "rfm_segment")
