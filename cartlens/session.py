"""Session settings and the shared scratch folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app_name="cartlens", master=None, shuffle_partitions=None, **settings):
    """A session with the settings the library is tuned for.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the former comes from
    spark-submit and the latter is best set high, for AQE to coalesce.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark):
    """Use the shared checkpoint folder of the cluster; fall back to /tmp in local mode only."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="cartlens-")
    context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def scratch_path(spark, name):
    """A fresh path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df, name):
    """Write ``df`` below the shared folder and read it back.

    For a frame that several branches read: each then scans only the columns it needs, and
    nothing upstream runs again, also not after the loss of an executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
