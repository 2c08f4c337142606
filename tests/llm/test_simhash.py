"""SimHash against brute force: fingerprints bit by bit, links between all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from helpers import make_docs, prose, ugly_rows, with_clashes
from pyspark.sql import functions as F

from cartlens.llm import simhash


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, near):
    """Smallest id reachable, by a union of all near pairs."""
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in rows:
        for j, b in rows:
            if i < j and near(a, b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in rows}


def test_fingerprint_equals_the_definition():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("aB é\t\nÉx\x0b  ") for _ in range(rng.randint(0, 60)))
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)
    assert simhash.fingerprint(None) == 0
    long = prose(1, 30_000)
    assert simhash.fingerprint(long.encode()) == slow_fingerprint(long)


def test_components_equal_all_pairs(spark):
    rng = random.Random(5)
    texts = [prose(i, 60) for i in range(40)]
    for i in range(160):
        words = texts[rng.randrange(40)].split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            words[rng.randrange(len(words))] = "changed" + str(rng.randrange(5))
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    expected = slow_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    got = {r.doc_id: r for r in simhash.query(make_docs(spark, rows)).collect()}
    assert {i: r.component_id for i, r in got.items()} == expected
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{fp:016x}" for i, fp in fps}
    assert len(set(expected.values())) < 190


@pytest.mark.parametrize("chunk", [7, 4096])
def test_tiles_find_every_link(spark, monkeypatch, chunk):
    """Fingerprints in dense clusters, so that tiles overflow into chunks."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(9)
    fps = set()
    for _ in range(25):
        center = rng.getrandbits(64)
        for _ in range(12):
            fp = center
            for _ in range(rng.randint(0, 4)):
                fp ^= 1 << rng.randrange(64)
            fps.add(fp)
    fps |= {0, 2**64 - 1, 7, 2**63}
    signed = [int(x) for x in np.array(sorted(fps), np.uint64).view(np.int64)]
    pairs = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in pairs.collect()}
    mask = 2**64 - 1
    assert all(((a ^ b) & mask).bit_count() <= 3 for a, b in found)

    def classes(links):
        return slow_components([(x, x) for x in signed], lambda a, b: (min(a, b), max(a, b)) in links)

    true = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3}
    assert classes(found) == classes(true)


def test_ugly_rows_and_empty_table(spark):
    docs = make_docs(spark, ugly_rows())
    rows = simhash.query(docs).collect()
    assert len(rows) == len(ugly_rows())
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fingerprint == by_id[2].fingerprint == by_id[3].fingerprint == "0" * 16
    assert by_id[3].component_id == 1 and by_id[6].component_id == 5
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert simhash.query(docs.where("false")).collect() == []


def test_one_of_each_group_stays_with_all_columns(spark):
    docs = with_clashes(make_docs(spark, ugly_rows()))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    assert ids == [1, 4, 5, 8, 9, 10, 11]
    assert kept.where("doc_id is null").count() == 2
    assert kept.agg(F.max("score")).first()[0] == 1.5


def test_rows_of_one_id_leave_the_same_row_on_any_layout(spark):
    rows = [(5, prose(i, 50), "en", f"s{j}") for i in range(4) for j in range(3)]
    rows += [(2, prose(1, 50), "en", "s0"), (9, prose(9, 50), "en", "s0")]
    found = set()
    for parts in (1, 4, 7):
        docs = with_clashes(make_docs(spark, rows[::-1] if parts == 4 else rows, parts))
        docs = docs.withColumn("text_key", F.lit("t")).withColumn("row", F.lit(1))
        kept = simhash.drop_near_duplicates(docs)
        assert kept.columns == docs.columns
        found.add(tuple(sorted((r.doc_id, r.text, r.source) for r in kept.collect())))
    assert len(found) == 1
    kept = {i: text for i, text, _ in found.pop()}
    # The text that document 5 shares with 2 is in the component of 2; one of its others stays.
    assert sorted(kept) == [2, 5, 9] and kept[2] == prose(1, 50)
    assert kept[5] in {prose(i, 50) for i in (0, 2, 3)}
