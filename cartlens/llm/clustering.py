"""Centroid clustering of vectors by tables of squared differences.

Components become integers, so only so many different values occur in a dimension.  In every
round a task tabulates, for each dimension, each value that occurs in its batch and each
centroid, the squared difference of the two; the distance of a vector to all centroids is then
one gather per dimension and a sum.  All arithmetic is in 64-bit integers and exact.

A table has at most one row per value and row of the batch, so its size is bounded by the batch
(``BATCH`` rows) whatever the data hold.  A task sends one row per cluster and dimension to the
next step, and the driver gets one per cluster and dimension, at any size of the data.  The
vectors are prepared once and stored; a round reads them, and a lost executor costs its tasks.
"""

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cartlens.session import materialise

# Executors need not have this package installed: the functions of this module travel along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SALT = 2
BATCH = 8_192
# Squared differences of integers below this bound add up to a 64-bit integer over 64 dimensions.
LARGEST = 2**27


def prepared(vectors, dimensions=DIMENSIONS, scale=SCALE):
    """``vec_id, x``: the kept vectors as integers ``floor(scale * component)``.

    Kept are vectors with exactly ``dimensions`` components, none null or non-finite.  One with a
    component beyond 2^27 after scaling is left out, as squared distances to it would leave 64 bits.
    """
    whole = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    fits = F.forall(
        "embedding", lambda v: F.coalesce(F.abs(v.cast("double") * scale) <= LARGEST, F.lit(False))
    )
    return materialise(
        vectors.where((F.size("embedding") == dimensions) & fits).select(
            "vec_id", whole.cast("array<int>").alias("x")
        ),
        "cluster-vectors",
    )


def first_centroids(rows, clusters=CLUSTERS, salt=SALT):
    """The vectors whose ``sha256('salt:vec_id')`` is smallest, as the rows of a matrix."""
    identity = F.coalesce(F.col("vec_id").cast("string"), F.lit(""))
    rank = F.sha2(F.concat(F.lit(f"{salt}:"), identity).cast("binary"), 256)
    few = rows.select(rank.alias("rank"), "x").orderBy("rank", "x").limit(clusters).collect()
    return np.array([r["x"] for r in few], np.int64)


def occurring(column):
    """The different values of an integer array, in order, and the place of each row's value."""
    low, high = int(column.min()), int(column.max())
    if high - low < 4 * len(column):
        seen = np.zeros(high - low + 1, bool)
        seen[column - low] = True
        return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[column - low]
    return np.unique(column, return_inverse=True)


def nearest(x, centroids):
    """Number of the nearest centroid (the smaller on ties) and its squared distance, per row."""
    distances = np.zeros((len(x), len(centroids)), np.int64)
    for d in range(x.shape[1]):
        values, place = occurring(x[:, d])
        table = (values[:, None] - centroids[None, :, d]) ** 2
        distances += table[place]
    cluster = distances.argmin(axis=1)
    return cluster, distances[np.arange(len(x)), cluster]


def _matrix(column, dimensions):
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def _batches(batches, dimensions):
    """Arrow batches cut to ``BATCH`` rows, with their vectors as a matrix."""
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            part = batch.slice(start, BATCH)
            yield part, _matrix(part.column("x"), dimensions)


def moved(rows, centroids):
    """The centroids after one round over ``rows``; one without vectors stays."""
    dimensions = centroids.shape[1]

    def sums(batches):
        total = np.zeros(centroids.shape, np.int64)
        count = np.zeros(len(centroids), np.int64)
        for _, x in _batches(batches, dimensions):
            cluster, _ = nearest(x, centroids)
            order = np.argsort(cluster, kind="stable")
            starts = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            filled = cluster[order][starts]
            total[filled] += np.add.reduceat(x[order], starts, axis=0)
            count += np.bincount(cluster, minlength=len(centroids))
        yield pa.RecordBatch.from_pydict(
            {
                "cluster": np.repeat(np.arange(len(centroids), dtype=np.int32), dimensions),
                "dimension": np.tile(np.arange(dimensions, dtype=np.int32), len(centroids)),
                "total": total.ravel(),
                "n": np.repeat(count, dimensions),
            }
        )

    parts = rows.select("x").mapInArrow(sums, "cluster int, dimension int, total long, n long")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("total", "n")]
    after = centroids.copy()
    for r in parts.where("n > 0").groupBy("cluster", "dimension").agg(*wide).collect():
        after[r["cluster"], r["dimension"]] = int(r["total"]) // int(r["n"])
    return after


def assigned(rows, centroids):
    """``vec_id, cluster, distance`` of the nearest centroid."""
    dimensions = centroids.shape[1]
    kind = rows.schema["vec_id"].dataType.simpleString()

    def label(batches):
        for part, x in _batches(batches, dimensions):
            cluster, distance = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                names=["vec_id", "cluster", "distance"],
            )

    return rows.mapInArrow(label, f"vec_id {kind}, cluster int, distance long")


def cluster(vectors, dimensions=DIMENSIONS, clusters=CLUSTERS, rounds=ROUNDS, scale=SCALE, salt=SALT):
    """The assigned vectors (a stored table) and the final centroids."""
    rows = prepared(vectors, dimensions, scale)
    centroids = first_centroids(rows, clusters, salt)
    if not len(centroids):
        return rows.selectExpr("vec_id", "0 as cluster", "0L as distance"), centroids
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    return materialise(assigned(rows, centroids), "cluster-labels"), centroids


def query(vectors):
    """One row per kept vector: its cluster, squared distance, the inertias, its centroid's digest.

    A vector that is null or has a null or non-finite component, another number of components
    or one beyond 2^27 after scaling has no row.  With fewer kept vectors than clusters each
    starts as a centroid of its own; none give no rows.  Equal hashes (repeated ids; a null id
    counts as the empty text) are taken in the order of the vectors, and rows repeated in
    all columns count as often as they stand.  Extra columns are not looked at.
    """
    labels, centroids = cluster(vectors.select("vec_id", "embedding"))
    digests = [
        (i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
        for i, c in enumerate(centroids)
    ]
    spark = vectors.sparkSession
    inertia = labels.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = labels.agg(F.sum("distance").alias("inertia"))
    # One row per cluster, and one row.
    about = inertia.crossJoin(F.broadcast(total)).join(
        F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster"
    )
    return labels.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _sql():
    lines = [
        f"""x AS (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda v: floor({SCALE} * v::DOUBLE)::BIGINT) AS x
    FROM embeddings WHERE len(embedding) = {DIMENSIONS}
        AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
)""",
        f"cells AS (SELECT row, unnest(range({DIMENSIONS})) AS d, unnest(x) AS v FROM x)",
        f"""c0 AS (
    SELECT k, unnest(range({DIMENSIONS})) AS d, unnest(x) AS v FROM (
        SELECT x, row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id), x) - 1 AS k FROM x
        QUALIFY k < {CLUSTERS}
    )
)""",
    ]
    for i in range(ROUNDS + 1):
        lines.append(
            f"""a{i} AS (
    SELECT row, k, distance FROM (
        SELECT row, k, sum((a.v - c.v) * (a.v - c.v))::BIGINT AS distance
        FROM cells a JOIN c{i} c USING (d) GROUP BY row, k
    ) QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, k) = 1
)"""
        )
        if i < ROUNDS:
            lines.append(
                f"""c{i + 1} AS (
    SELECT k, d, coalesce((s - ((s % n) + n) % n) // n, v) AS v FROM c{i} LEFT JOIN (
        SELECT k, d, sum(v)::BIGINT AS s, count(*) AS n FROM cells JOIN a{i} USING (row) GROUP BY k, d
    ) USING (k, d)
)"""
            )
    return "WITH " + ",\n".join(lines) + f"""
SELECT vec_id, k::INT AS cluster, distance, sum(distance) OVER (PARTITION BY k)::BIGINT AS cluster_inertia,
    sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN x USING (row)
JOIN (SELECT k, sha256(string_agg(v::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k) USING (k)
"""


SQL = _sql()
