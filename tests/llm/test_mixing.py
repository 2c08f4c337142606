"""Mixing: counts against a plain inversion, weights of the result, and the SQL."""

import hashlib
import math

import duckdb
import pytest
from helpers import make_docs, prose, ugly_rows, with_clashes
from pyspark.sql import functions as F

from cartlens.llm import mixing


def slow_count(rate, key, seed=mixing.SEED):
    draw = int(hashlib.md5(f"{seed}/{key}".encode()).hexdigest()[:13], 16) / 16**13
    k, term, cdf = 0, math.exp(-rate), math.exp(-rate)
    while cdf <= draw:
        k += 1
        term *= rate / k
        cdf += term
    return k


def corpus(spark):
    rows = []
    for i in range(900):
        source = "big" if i % 3 == 0 else f"s{i % 7}"
        rows.append((i, prose(i, 5 + i % 30), "en", source))
    return make_docs(spark, rows)


def test_counts_equal_plain_inversion(spark):
    docs = corpus(spark)
    rates = {r.source: r.rate for r in mixing.source_rates(docs).collect()}
    got = mixing.copy_counts(docs).collect()
    assert {r.doc_id: r.copies for r in got} == {
        r.doc_id: slow_count(rates[r.source], r.doc_id) for r in got
    }


def test_expected_sizes_meet_the_weights(spark):
    weights = {"big": 1.0, "s1": 2.0, "s2": 1.0}
    rates = mixing.source_rates(corpus(spark), weights).collect()
    total = sum(r["size"] for r in rates)
    for r in rates:
        assert math.isclose(r.rate * r["size"], weights.get(r.source, 0) / 4 * total, abs_tol=1e-6)
    mixed = mixing.mix(corpus(spark), weights)
    assert {r.source for r in mixed.select("source").distinct().collect()} == {"big", "s1", "s2"}


@pytest.mark.parametrize("rate", [0.0, 0.01, 1.0, 30.0, 900.0])
def test_distribution_function(spark, rate):
    cdf = spark.range(1).select(F.expr(mixing.cumulative_poisson(f"{rate}D"))).first()[0]
    assert all(a <= b + 1e-12 for a, b in zip(cdf, cdf[1:])) and abs(cdf[-1] - 1) < 1e-9
    mean = sum((b - a) * k for k, (a, b) in enumerate(zip([0.0, *cdf], cdf)))
    assert math.isclose(mean, rate, rel_tol=1e-6, abs_tol=1e-9)


def test_salted_join_gives_the_same(spark, monkeypatch):
    want = sorted((r.doc_id, r.copy) for r in mixing.mix(corpus(spark)).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted((r.doc_id, r.copy) for r in mixing.mix(corpus(spark)).collect()) == want


def test_sql_gives_the_same(spark):
    docs = corpus(spark)
    connection = duckdb.connect()
    connection.register("documents", docs.toPandas())
    want = connection.execute(mixing.SQL).fetchdf().sort_values("shuffle_key")
    got = mixing.query(docs).toPandas().sort_values("shuffle_key")[list(want.columns)]
    assert got.values.tolist() == want.values.tolist()


def test_ugly_rows_and_empty_table(spark):
    docs = with_clashes(make_docs(spark, ugly_rows()))
    mixed = mixing.mix(docs)
    assert mixed.columns == [c for c in docs.columns if c not in ("copy", "shuffle_key")] + [
        "copy", "shuffle_key",
    ]
    rows = mixed.collect()
    twins = [r.copy for r in rows if r.doc_id == 5]
    assert sorted(twins) == sorted(2 * list(range(len(twins) // 2)))
    assert mixing.mix(docs.where("false")).collect() == []
    blank = make_docs(spark, [(1, None), (2, "")])
    assert sorted(r["rate"] for r in mixing.source_rates(blank).collect()) == [1.0]
    assert mixing.mix(blank).count() >= 0
