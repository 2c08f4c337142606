"""Scoring of a stream of requests.

Scoring keeps no state, so the stream uses the batch functions unchanged.  ``start_split``
reads each request once and writes accepted and rejected rows under one checkpoint;
``start_scoring`` is two plain file streams instead, which each read all requests.
"""

from pyspark.sql import functions as F

from cartlens.functions.rules import quarantined_rows, request_rules, valid_rows
from cartlens.plans.scoring import DEFAULT_THRESHOLD, rejected, score, scored_requests
from cartlens.schema import SCORING_INPUT

BATCH = "batch"


def read_requests(spark, path, schema=SCORING_INPUT, files_per_trigger=None):
    """Requests from ``path``: one Parquet file, or a folder in which files may still arrive.

    A file source takes folders only, so a single file is read as the folder that holds it,
    with its name as the filter.
    """
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop_path)
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if status.isFile():
        reader = reader.option("pathGlobFilter", hadoop_path.getName())
        path = hadoop_path.getParent().toString()
    return reader.parquet(path)


def write_stream(frame, path, checkpoint, once=True):
    """Append a stream to Parquet files; ``once`` stops when the present input is done."""
    writer = (
        frame.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_scoring(model, requests, out, threshold=DEFAULT_THRESHOLD, once=True):
    """Start the two queries; results go to ``out/scores`` and ``out/rejected``."""
    refused = rejected(requests).withColumn("violations", F.concat_ws(",", "violations"))
    return [
        write_stream(
            score(model, requests, threshold), f"{out}/scores", f"{out}/_progress/scores", once
        ),
        write_stream(refused, f"{out}/rejected", f"{out}/_progress/rejected", once),
    ]


def start_split(requests, rules, accept, out, once=True):
    """Start one query that reads each request once and fills two tables.

    Rows that meet all ``rules`` go through ``accept`` to ``out/scores``, the others, with the
    rules they break, to ``out/rejected``; ``read_part`` reads them back.  Both tables of a
    micro-batch lie in folders named by its number, under one checkpoint: a batch that is run
    again after a failure replaces its own folders, so no row is lost or doubled, and the two
    tables never stand at different batches.
    """

    def write(batch, number):
        # The batch is kept, spilling to disk, while both tables are written; what a lost
        # executor held of it is read again.
        batch = batch.persist()
        try:
            refused = quarantined_rows(batch, rules).withColumn(
                "violations", F.concat_ws(",", "violations")
            )
            for part, rows in (("scores", accept(valid_rows(batch, rules))), ("rejected", refused)):
                rows.write.mode("overwrite").parquet(f"{out}/{part}/{BATCH}={number}")
        finally:
            batch.unpersist()

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/_progress")
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_split_scoring(model, requests, out, threshold=DEFAULT_THRESHOLD, once=True):
    """``start_split`` with the rules of requests and the scores of ``model``."""
    return start_split(
        requests,
        request_rules(),
        lambda rows: scored_requests(model, rows, threshold),
        out,
        once,
    )


def read_part(spark, out, part):
    """The rows of ``scores`` or ``rejected`` that ``start_split`` has written so far."""
    return spark.read.option("basePath", f"{out}/{part}").parquet(f"{out}/{part}").drop(BATCH)
