"""Wrong predictions."""

from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from cartlens.functions.ordered import stable_layout
from cartlens.operators.classification import with_prediction


def misclassified(scored, threshold=0.5):
    return with_prediction(scored, threshold).where(F.col("label") != F.col("prediction"))


def high_confidence_errors(scored, threshold=0.5, confidence=0.85):
    """Wrong rows whose score lies above ``confidence``."""
    return misclassified(scored, threshold).where(F.col("probability") > confidence)


def cluster_errors(errors, k=3, seed=42, vector="features"):
    """Add ``cluster`` by k-means on the feature vector of the trained pipeline.

    Without errors there is nothing to cluster, and the result is empty.
    """
    if errors.isEmpty():
        return errors.withColumn("cluster", F.lit(0))
    model = KMeans(k=k, seed=seed, featuresCol=vector, predictionCol="cluster").fit(
        stable_layout(errors.select("row_id", vector), "row_id")
    )
    return model.transform(errors)


def cluster_summary(errors):
    """Size, mean and std of price, most common hour (smallest on ties), share of positives."""
    return errors.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_errors"),
        F.avg("price").alias("mean_price"),
        F.stddev_samp("price").alias("std_price"),
        # At most 24 different hours to hold per cluster.
        F.mode("hour", deterministic=True).alias("peak_hour"),
        F.avg("label").alias("mean_class"),
    )
