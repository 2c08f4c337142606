"""Saving and loading of models, baselines and tables, through Spark's file systems."""

from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import types as T

BASELINE = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("std", T.DoubleType()),
        T.StructField("auc_score", T.DoubleType()),
        T.StructField("class_ratio", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
METADATA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("features", T.ArrayType(T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("optimal_threshold", T.DoubleType()),
    ]
)


# Written last, and only by the writer that holds the folder: what has it is whole.
COMMITTED = "_COMMITTED"
_OWNED = "_OWNED"


def _claim(spark, path):
    """Create ``path/_OWNED`` unless another writer has; the file system decides who is first."""
    owned = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_OWNED}")
    system = owned.getFileSystem(spark._jsc.hadoopConfiguration())
    return not system.exists(owned) and system.createNewFile(owned)


def save_model(model, features, metrics, save_dir, optimal_threshold, now=None):
    """Write the pipeline and its metadata to ``save_dir/model_<time>``; return that path.

    A folder belongs to the first who claims it: models saved in the same second go to
    ``model_<time>_001`` and so on.  The commit marker comes last, so a model whose writer died
    is never the newest one.
    """
    spark = SparkSession.getActiveSession()
    stamp = (now or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")
    path, number = f"{save_dir}/model_{stamp}", 0
    while not _claim(spark, path):
        number += 1
        path = f"{save_dir}/model_{stamp}_{number:03d}"
    model.write().overwrite().save(f"{path}/pipeline")
    metadata = {
        "timestamp": stamp,
        "features": list(features),
        "metrics": {name: float(value) for name, value in metrics.items()},
        "optimal_threshold": float(optimal_threshold),
    }
    spark.createDataFrame([metadata], METADATA).coalesce(1).write.mode("overwrite").json(
        f"{path}/metadata"
    )
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{COMMITTED}")
    marker.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(marker)
    return path


def latest_model_path(spark, save_dir):
    """The newest ``model_<time>`` folder that was committed."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{save_dir}/model_*/{COMMITTED}")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    found = [status.getPath().getParent().toString() for status in files or []]
    if not found:
        raise FileNotFoundError(f"{save_dir} holds no complete model")
    return max(found)


def load_model(spark, save_dir=None, path=None):
    """The pipeline at ``path``, or the newest below ``save_dir``, and its metadata as a dict."""
    path = path or latest_model_path(spark, save_dir)
    row = spark.read.schema(METADATA).json(f"{path}/metadata").first()
    return PipelineModel.load(f"{path}/pipeline"), row.asDict(recursive=True)


def write_baseline(baseline, path):
    baseline.write.mode("overwrite").json(path)


def read_baseline(spark, path):
    return spark.read.schema(BASELINE).json(path)


# All six digits of a second; the default format stops at three.
CSV_OPTIONS = {
    "header": True,
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def write_csv(df, path):
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_csv(spark, path, schema):
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def write_frame(df, path):
    df.write.mode("overwrite").parquet(path)
