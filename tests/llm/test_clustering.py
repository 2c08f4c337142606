import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlens.llm import clustering

SCHEMA = "vec_id long, embedding array<float>"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def plain(rows):
    """Loops over Python integers; the rows as ``query`` gives them."""
    kept = [
        (i, [math.floor(256 * v) for v in e])
        for i, e in rows
        if e is not None and len(e) == 64 and all(v is not None and math.isfinite(v) for v in e)
    ]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [x for _, x in sorted(kept, key=key)[:40]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centroids))

    for _ in range(5):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x)[1], []).append(x)
        for k, group in groups.items():
            centroids[k] = [sum(column) // len(group) for column in zip(*group)]
    found = [(i, *near(x)[::-1]) for i, x in kept]
    each = {}
    for _, k, distance in found:
        each[k] = each.get(k, 0) + distance
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, k, d, each[k], sum(each.values()), digest[k]) for i, k, d in found]


def result(df):
    return sorted((tuple(r) for r in clustering.query(df).collect()), key=repr)


def random_rows(n, seed=1, spread=0.3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, 64))
    noise = middles[rng.integers(0, 6, n)] + rng.normal(scale=spread, size=(n, 64))
    return [(i, [float(np.float32(v)) for v in noise[i]]) for i in range(n)]


def test_equals_loops(spark):
    rows = random_rows(260)
    assert result(vectors(spark, rows)) == sorted(plain(rows), key=repr)


def test_ugly_rows_ties_and_clashing_names(spark):
    rows = random_rows(70, seed=2)
    bad = list(rows[0][1])
    rows += [
        (100, None), (101, []), (102, bad[:63]), (103, [*bad, 1.0]), (104, [None, *bad[1:]]),
        (105, [float("nan"), *bad[1:]]), (106, [float("-inf"), *bad[1:]]), (None, bad),
        (3, rows[3][1]), (3, rows[4][1]), (107, [0.0] * 64), (108, [-0.0] * 64),
    ]
    df = vectors(spark, rows)
    assert result(df) == sorted(plain(rows), key=repr)
    clash = df.withColumns({"x": F.lit(1), "cluster": F.lit("c"), "distance": F.lit(0), "N": F.lit(2)})
    assert result(clash) == result(df)


def test_many_copies_leave_clusters_empty(spark):
    rows = [(i, [0.25] * 64) for i in range(60)] + random_rows(5, seed=3)
    assert result(vectors(spark, rows)) == sorted(plain(rows), key=repr)


def test_few_and_no_vectors(spark):
    rows = random_rows(7, seed=4)
    assert result(vectors(spark, rows)) == sorted(plain(rows), key=repr)
    assert result(vectors(spark, rows).where("false")) == []
    assert result(vectors(spark, [(1, None), (2, [1.0])])) == []


def test_values_beyond_the_bound_have_no_row(spark):
    rows = random_rows(50, seed=5)
    huge = [(900, [1e38] * 64), (901, [-(2.0**20)] + [0.0] * 63)]
    assert result(vectors(spark, rows + huge)) == sorted(plain(rows), key=repr)


@pytest.mark.parametrize("spread", [3, 10**6])
def test_tables_equal_plain_differences(spread):
    rng = np.random.default_rng(6)
    x = rng.integers(-spread, spread, size=(300, 64))
    centroids = rng.integers(-spread, spread, size=(9, 64))
    all_distances = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    cluster, distance = clustering.nearest(x, centroids)
    assert (cluster == all_distances.argmin(axis=1)).all()
    assert (distance == all_distances.min(axis=1)).all()


def test_batches_do_not_matter(spark, monkeypatch):
    rows = random_rows(90, seed=7)
    before = result(vectors(spark, rows))
    monkeypatch.setattr(clustering, "BATCH", 7)
    assert result(vectors(spark, rows, 5)) == before


def test_sql(spark):
    rows = random_rows(120, seed=8) + [(500, None), (501, [1.0])]
    frame = vectors(spark, rows).toArrow()  # noqa: F841 - DuckDB reads it by name
    sql = duckdb.sql(clustering.SQL.replace("FROM embeddings", "FROM frame")).fetchall()
    assert sorted((tuple(r) for r in sql), key=repr) == result(vectors(spark, rows))
