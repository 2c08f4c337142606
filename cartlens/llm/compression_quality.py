"""Quality by compression: how much better does a good dictionary pack a text than a bad one?

Two zstandard dictionaries are trained, on good and on bad labelled texts.  A text is
compressed with each in pieces, so that a dictionary helps on every part of a long text, and
the difference of the two sizes over their sum is the raw score.  How far the text packs at all
tells how much that difference means.  A logistic curve over both, fitted on labelled texts
that trained no dictionary, turns them into a probability.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import functions as F

from cartlens.llm.common import fit_logistic, held_out, labelled_sample, logistic, mean_one

DICT_BYTES = 32_768
PIECE = 2_048
LEVEL = 3
PER_CLASS = 3_000
DICT_TEXT_BYTES = 16_000_000


def pieces(data):
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def train_dictionary(texts):
    """Dictionary bytes from a bounded list of texts (bytes); few texts serve as they are."""
    samples = [p for text in texts for p in pieces(text)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b"".join(samples)[-DICT_BYTES:]


class Packer:
    """Compressed sizes of a text under the two dictionaries."""

    def __init__(self, good, bad):
        self.tools = [
            zstandard.ZstdCompressor(
                level=LEVEL,
                dict_data=zstandard.ZstdCompressionDict(d) if d else None,
                write_content_size=False,
                write_checksum=False,
                write_dict_id=False,
            )
            for d in (good, bad)
        ]

    def measures(self, data):
        """Normalised difference, and logarithms of both sizes over the size of the text.

        The difference is positive if the good dictionary packs better.  An empty text has
        difference zero and packs not at all.
        """
        if not data:
            return 0.0, 0.0, 0.0
        good, bad = (sum(len(t.compress(p)) for p in pieces(data)) for t in self.tools)
        return (
            (bad - good) / (bad + good),
            float(np.log(good / len(data) + 0.01)),
            float(np.log(bad / len(data) + 0.01)),
        )


def expand(measures, mean, scale):
    """Standardised measures, their squares and products."""
    z = np.clip((np.asarray(measures, float).reshape(-1, 3) - mean) / scale, -4, 4)
    crossed = [z[:, i] * z[:, j] for i in range(3) for j in range(i, 3)]
    return np.column_stack([z, *crossed])


def train(docs, labels, per_class=PER_CLASS, text_bytes=DICT_TEXT_BYTES):
    """A model dictionary from labelled documents that are not held out.

    ``per_class`` bounds the sample.  Half of it trains the dictionaries, whole texts in the
    order of a hash until a class has ``text_bytes``; the other half calibrates, weighted to the
    true shares of the classes.
    """
    sample = labelled_sample(docs, labels, "quality", per_class, "quality-sample")
    data = F.col("text").cast("binary")
    sizes = sample.where("half = 0").select(
        "doc_id", "label", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("rank")
    )
    chosen, used = [], {0: 0, 1: 0}
    for row in sorted(sizes.collect(), key=lambda r: (r["rank"], r["doc_id"])):  # <= 2 * per_class
        if used[row["label"]] + row["n"] <= text_bytes:
            used[row["label"]] += row["n"]
            chosen.append((row["doc_id"],))
    spark = docs.sparkSession
    kind = sample.schema["doc_id"].dataType.simpleString()
    picked = F.broadcast(spark.createDataFrame(chosen, f"doc_id {kind}"))
    texts = {0: [], 1: []}
    taken = sample.where("half = 0").join(picked, "doc_id").select("doc_id", "label", data.alias("data"))
    for row in sorted(taken.collect(), key=lambda r: r["doc_id"]):  # <= 2 * text_bytes
        texts[row["label"]].append(bytes(row["data"]))
    dictionaries = train_dictionary(texts[1]), train_dictionary(texts[0])
    measured = _measured(spark, dictionaries)
    rows = (
        sample.where("half = 1")
        .select("label", "weight", measured(F.col("text").cast("binary")).alias("m"))
        .select("label", "weight", "m.*")
        .collect()
    )
    x = np.array([r[2:] for r in rows], float).reshape(-1, 3)
    weights = mean_one([r["weight"] for r in rows])
    mean = np.average(x, axis=0, weights=weights) if len(x) else np.zeros(3)
    spread = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=weights)) if len(x) else np.ones(3)
    scale = np.maximum(spread, 1e-6)
    beta = fit_logistic(expand(x, mean, scale), [r["label"] for r in rows], weights, ridge=1.0)
    return {"dictionaries": dictionaries, "mean": mean, "scale": scale, "beta": beta}


MEASURES = "difference double, good double, bad double"


def _measured(spark, dictionaries):
    sent = spark.sparkContext.broadcast(dictionaries)

    @F.pandas_udf(MEASURES)
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        packer = Packer(*sent.value)
        for batch in batches:
            rows = [packer.measures(data) for data in batch]
            yield pd.DataFrame(rows, columns=["difference", "good", "bad"])

    return measure


def score_documents(docs, model):
    """``docs`` with ``score`` and the raw ``difference``; null text counts as empty."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, difference double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = sent.value
        packer = Packer(*known["dictionaries"])
        for batch in batches:
            measures = np.array([packer.measures(data) for data in batch], float).reshape(-1, 3)
            x = expand(measures, known["mean"], known["scale"])
            found = logistic(known["beta"][0] + x @ known["beta"][1:])
            yield pd.DataFrame({"score": found, "difference": measures[:, 0]})

    return docs.withColumn("_quality", score(F.col("text").cast("binary")))


def query(docs, labels):
    """One row per row of ``docs``: held-out flag, score and prediction at 0.3.

    An empty or null text gets the score of a text that packs not at all.  Without labels of
    both classes every score is the smoothed share of the class.
    """
    model = train(docs, labels)
    return score_documents(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("_quality.score").alias("score"),
        (F.col("_quality.score") >= 0.3).cast("int").alias("predicted"),
        F.col("_quality.difference").alias("difference"),
    )
