import hashlib
import zlib
from itertools import groupby

import duckdb
import pytest
from helpers import make_docs, prose, ugly_rows, with_clashes
from pyspark.sql import functions as F

from cartlens.llm import merkle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    parts = []
    for value in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text):
        parts.append("-" if value is None else f"{len(str(value).encode())}:{value}")
    return h(*parts)


def climb(nodes):
    """The root of a list of hashes, and for each its steps ``(before, after)``."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            start = place // 16 * 16
            steps[i].append(("".join(nodes[start:place]), "".join(nodes[place + 1 : start + 16])))
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at = [place // 16 for place in at]
    return nodes[0], steps


def plain(rows):
    first = lambda v: (v is not None, v if v is not None else 0)
    name = lambda v: (v is not None, (v or "").encode())
    leaves = sorted(
        ((r["source"], r["doc_id"], plain_leaf(r, r["text"]), r) for r in rows),
        key=lambda x: (name(x[0]), first(x[1]), x[2]),
    )
    trees = [(k, list(g)) for k, g in groupby(leaves, key=lambda x: x[0])]
    climbed = [climb([x[2] for x in g]) for _, g in trees]
    root, upper = climb([c[0] for c in climbed])
    found = []
    for (_, group), (subroot, steps), above in zip(trees, climbed, upper):
        for (_, doc, leaf, row), own in zip(group, steps):
            path = own + above
            text = row["text"]
            if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0:
                text = text.translate(LOWER)
            folded = plain_leaf(row, text)
            for before, after in path:
                folded = h(before, folded, after)
            seen = h("".join(b + a for b, a in path))
            found.append((doc, leaf, subroot, root, seen, folded, folded == root))
    return sorted(found, key=repr)


def result(docs):
    return sorted((tuple(r) for r in merkle.query(docs).collect()), key=repr)


def sized(spark, sizes):
    """Documents of several sources; ids are out of order and some texts have capitals."""
    rows = []
    for source, size in sizes.items():
        for i in range(size):
            text = f"Text {i} of {source}" if i % 3 else f"text {i}"
            rows.append((len(rows) * 7919 % 100_003, text, "en", source))
    return make_docs(spark, rows)


def rows_of(docs):
    return [r.asDict() for r in docs.collect()]


def test_equals_plain_trees_of_all_heights(spark):
    docs = sized(spark, {"a": 1, "b": 2, "c": 16, "d": 17, "e": 256, "f": 257, None: 33, "é": 40})
    assert result(docs) == plain(rows_of(docs))


def test_tree_of_several_blocks(spark):
    docs = sized(spark, {"hot": 4097 + 300, "small": 3})
    assert result(docs) == plain(rows_of(docs))


@pytest.mark.parametrize("digits", [1, 2])
def test_many_rounds_over_leaves_and_sources(spark, monkeypatch, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    monkeypatch.setattr(merkle, "BLOCK", 16**digits)
    docs = sized(spark, {"hot": 600, **{f"s{i}": 1 + i % 3 for i in range(40)}})
    assert result(docs) == plain(rows_of(docs))


def test_ugly_rows_clashing_names_and_ties(spark):
    docs = make_docs(spark, ugly_rows())
    assert result(docs) == plain(rows_of(docs))
    clash = with_clashes(docs).withColumns({"place": F.lit(1), "tree": F.lit("t"), "Block": F.lit(0)})
    assert result(clash) == result(docs)


def test_one_document_and_none(spark):
    one = make_docs(spark, [(3, "Alone")])
    assert result(one) == plain(rows_of(one))
    assert result(one.where("false")) == []


def test_steps_prove_a_leaf_and_nothing_else(spark):
    docs = sized(spark, {"a": 40, "b": 20})
    whole = merkle.manifest(docs)
    wrong = F.lit("0" * 64)
    checked = whole.select(
        (merkle.folded(F.col("leaf"), F.col("steps")) == F.col("root")).alias("right"),
        (merkle.folded(wrong, F.col("steps")) == F.col("root")).alias("wrong"),
        F.size("steps").alias("n"),
    ).collect()
    assert all(r["right"] and not r["wrong"] for r in checked)
    assert {r["n"] for r in checked} == {3}


def test_any_change_shows_in_the_root(spark):
    docs = make_docs(spark, [(i, prose(i, 5)) for i in range(30)])
    other = docs.withColumn("lang", F.when(F.col("doc_id") == 7, "xx").otherwise(F.col("lang")))
    roots = [{r["root"] for r in merkle.manifest(d).collect()} for d in (docs, docs.repartition(7), other)]
    assert roots[0] == roots[1] != roots[2] and len(roots[0]) == 1


def test_sql_on_ugly_rows(spark):
    docs = make_docs(spark, [r for r in ugly_rows() if r[0] is not None])
    frame = docs.toArrow()  # noqa: F841 - DuckDB reads it by name
    sql = duckdb.sql(merkle.SQL.replace("FROM documents", "FROM frame")).fetchall()
    assert sorted((tuple(r) for r in sql), key=repr) == result(docs)
