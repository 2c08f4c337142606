"""What the operators share: tables, bounded labelled samples, a small logistic fit, components."""

import numpy as np
from pyspark.sql import functions as F

from cartlens.session import materialise


def table(spark, sf_dir, name, *columns):
    """A table of ``sf_dir``; only ``columns`` are read where some are named."""
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return read.select(*columns) if columns else read


def spare(df, name):
    """``name``, with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(column):
    """A-Z to a-z and nothing else, whatever the locale."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id):
    """Rows that no fit may see: crc32 of the id as text divides by 5; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs, labels, label, per_class, name):
    """``doc_id, text, label, half, weight``: at most ``per_class`` labelled documents of each class.

    The documents come in the order of a hash of their id, from the rows that are not held
    out; a document labelled more than once counts with its largest label.  ``half`` (0 or 1)
    parts the sample, so that what is learnt on one half can be calibrated on the other.
    ``weight`` is how many documents of its class, counted over all labels that are not held
    out, a row stands for: weighted, the classes have their true shares at any size.
    """
    known = (
        labels.where(~held_out(F.col("doc_id")) & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    rank = F.xxhash64("doc_id", F.lit(label))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = None
    for value in (0, 1):
        some = known.where(F.col("label") == value).orderBy(rank, "doc_id").limit(per_class)
        some = some.withColumn("weight", F.lit(max(1.0, totals.get(value, 0) / max(per_class, 1))))
        picked = some if picked is None else picked.unionByName(some)
    # At most 2 * per_class rows of four numbers.
    picked = F.broadcast(
        picked.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))
    )
    texts = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )
    return materialise(texts.join(picked, "doc_id"), name)


def mean_one(weights):
    """``weights`` over their mean, so that a penalty keeps its strength against the rows."""
    weights = np.asarray(weights, float)
    return weights / weights.mean() if len(weights) else weights


def fit_logistic(x, y, weights=None, ridge=1e-2, rounds=50):
    """Coefficients (intercept first) of a ridge logistic regression, by Newton's method.

    ``x`` is a bounded sample.  One class, or no rows, gives the smoothed share of the class.
    """
    x = np.asarray(x, float)
    x = x.reshape(len(y), -1) if len(y) else x.reshape(0, x.shape[-1] if x.ndim == 2 else 1)
    y = np.asarray(y, float)
    w = np.ones(len(y)) if weights is None else np.asarray(weights, float)
    beta = np.zeros(x.shape[1] + 1)
    share = (w @ y + 0.5) / (w.sum() + 1.0)
    beta[0] = np.log(share / (1 - share))
    if len(set(y.tolist())) < 2:
        return beta
    full = np.column_stack([np.ones(len(y)), x])
    penalty = np.diag([1e-9] + [ridge] * x.shape[1])

    def loss(b):
        z = full @ b
        return w @ (np.logaddexp(0, z) - y * z) + b @ penalty @ b / 2

    now = loss(beta)
    for _ in range(rounds):
        p = logistic(full @ beta)
        gradient = full.T @ (w * (y - p)) - penalty @ beta
        hessian = (full * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ full + penalty
        step = np.linalg.solve(hessian, gradient)
        while (then := loss(beta + step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        beta = beta + step
        if now - then < 1e-10 * (1 + abs(now)):
            break
        now = then
    return beta


def logistic(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def components(edges, name="components"):
    """``node, root``: the smallest node of each connected component of ``edges(a, b)``.

    Alternates large-star and small-star steps: each hangs the neighbours of a node on the
    smallest one, so the rounds grow with the logarithm of the longest chain.  The edges of
    each round are a table in the shared folder, so no lineage builds up and a lost executor
    costs its tasks only.  Only nodes that have an edge come back.  Nodes may be of any type
    with an order; rows with a null node are left out.  A node with very many neighbours is
    aggregated in part before the shuffle, and its star is a join of two stored tables, where
    AQE splits a skewed key.
    """
    edges = materialise(
        edges.select("a", "b").where("a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ).distinct(),
        name,
    )
    before = digest(edges)
    while before[0]:
        # large-star: neighbours above a node go to the smallest of the node and its neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(
            both.groupBy("a").agg(F.min("b").alias("m")).select(
                "a", F.least("a", "m").alias("m")
            ),
            name,
        )
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a <> b"), name)
        # small-star: a node and its neighbours below it go to the smallest of them
        lower = materialise(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(lower.select("a", F.col("m").alias("b")))
        small = materialise(small.where("a <> b").distinct(), name)
        edges, after = small, digest(small)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def digest(edges):
    """Count and sums of two hashes: equal for equal sets of distinct edges."""
    return edges.agg(
        F.count(F.lit(1)),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
        F.sum(F.xxhash64("b", F.lit(7), "a").cast("decimal(38,0)")),
    ).first()
