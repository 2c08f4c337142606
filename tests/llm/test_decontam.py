"""Decontamination: the index against plain scoring, the operator against plain search."""

import random

import numpy as np
from helpers import make_docs, prose, ugly_rows, with_clashes

from cartlens.llm import decontam

ITEMS = [(i, f"{prose(100 + i, 25)}? {prose(200 + i, 8)}.") for i in range(40)]
ITEMS += [(40, "short item"), (41, ""), (42, None), (43, prose(43, 300))]
SCHEMA = "item_id long, text string"


def test_wand_retrieves_all_above_threshold():
    index = decontam.Index([(i, t) for i, t in ITEMS if t])
    rng = random.Random(1)
    for _ in range(200):
        terms = sorted(rng.sample(range(len(index.terms)), rng.randint(1, 80)))
        threshold = rng.choice([0.05, 0.2, 0.5])
        scores = np.zeros(len(index.ids))
        for t in terms:
            for n, impact in zip(index.items[t], index.impacts[t]):
                scores[n] += impact
        want = {n for n in range(len(scores)) if scores[n] >= threshold - 1e-9}
        assert {n for n, _ in index.retrieve(terms, threshold)} == want


def test_an_item_scores_one_against_itself():
    index = decontam.Index([(i, t) for i, t in ITEMS if t])
    for n, item in enumerate(index.ids):
        text = dict(ITEMS)[item]
        numbers = sorted({index.terms[w] for w in decontam.words_of(text)})
        assert abs(dict(index.retrieve(numbers, 0.9))[n] - 1) < 1e-9


def test_question_and_answer():
    q, a = decontam.question_and_answer("What is this thing called? It is a very long answer.")
    assert q == "what is this thing called".split() and a == "it is a very long answer".split()
    q, a = decontam.question_and_answer("one sentence without any end")
    assert q == ["one", "sentence", "without"] and a == ["any", "end"]
    assert decontam.question_and_answer(None) == ([], [])


def planted(rng):
    rows, want = [], set()
    for doc in range(120):
        words = prose(1000 + doc, rng.randint(0, 400)).split()
        if doc % 4 == 0:
            item, text = rng.choice(ITEMS[:40] + ITEMS[43:])
            at = rng.randint(0, len(words))
            words[at:at] = text.upper().split() if doc % 8 else text.split()
            want.add((doc, item))
        elif doc % 4 == 1:  # only the question
            item, text = rng.choice(ITEMS[:40])
            words += text.split("?")[0].split()
        rows.append((doc, " ".join(words)))
    return rows, want


def test_planted_items_are_found_and_no_others(spark):
    rows, want = planted(random.Random(2))
    benchmark = spark.createDataFrame(ITEMS, SCHEMA)
    docs = make_docs(spark, rows)
    got = {(r.doc_id, r.item_id) for r in decontam.query(spark, docs, benchmark).collect()}
    assert got == want
    kept = {r.doc_id for r in decontam.drop_leaks(spark, docs, benchmark).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want}


def test_shards_find_the_same(spark):
    rows, want = planted(random.Random(2))
    docs, benchmark = make_docs(spark, rows), spark.createDataFrame(ITEMS, SCHEMA)
    found = decontam.leaks(spark, docs["text"], benchmark, shard_chars=1_500)
    got = {(r.doc_id, h.item_id) for r in docs.select("doc_id", found.alias("h")).collect() for h in r.h}
    assert got == want


def borderline(rng):
    """Documents with part of an item's words, so that scores lie on both sides of the threshold."""
    rows = []
    for doc in range(150):
        item, text = rng.choice(ITEMS[:40])
        words = [w if rng.random() < 0.35 + 0.6 * (doc % 10) / 9 else "filler" for w in text.split()]
        rows.append((doc, " ".join([prose(3000 + doc, doc % 60), *words, prose(4000 + doc, 20)])))
    return rows


def test_the_number_of_shards_changes_no_row(spark):
    docs = make_docs(spark, borderline(random.Random(5)))
    # Common and rare terms, so that the statistics of a part would differ from those of all.
    items = [(i, f"{prose(i % 3, 6)} {t}" if t and i % 2 else t) for i, t in ITEMS]
    benchmark = spark.createDataFrame(items, SCHEMA)
    chars = sum(len(t or "") for _, t in items)
    found = []
    for parts in (1, 3, 50):
        size = chars // parts + 1
        assert len(decontam.shards(spark, benchmark, size)) >= parts // 2
        rows = decontam.query(spark, docs, benchmark, 0.6, 0.3, size).collect()
        found.append(sorted(tuple(r) for r in rows))
        if parts != 50:
            kept = decontam.drop_leaks(spark, docs, benchmark, 0.6, 0.3, size)
            assert {r.doc_id for r in kept.collect()} == set(range(150)) - {r.doc_id for r in rows}
    assert found[0] == found[1] == found[2]
    scores = [r[2] for r in found[0]]
    assert len(scores) > 20 and min(scores) < 0.65


def test_the_search_runs_once_per_document(spark):
    benchmark = spark.createDataFrame(ITEMS[:5], SCHEMA)
    plan = decontam.query(spark, make_docs(spark, [(1, "a b")]), benchmark)
    assert plan._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_a_changed_word_is_still_a_leak(spark):
    words = ITEMS[3][1].split()
    words[10] = "otherword"
    docs = make_docs(spark, [(1, prose(1, 50) + " " + " ".join(words) + " " + prose(2, 50))])
    benchmark = spark.createDataFrame(ITEMS, SCHEMA)
    assert [r.item_id for r in decontam.query(spark, docs, benchmark).collect()] == [3]


def test_ugly_rows_and_empty_tables(spark):
    docs = with_clashes(make_docs(spark, ugly_rows()))
    benchmark = spark.createDataFrame([*ITEMS, (None, "x y z"), (5, prose(5, 40))], SCHEMA)
    rows = decontam.query(spark, docs, benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(5, 5), (5, 5), (6, 5)]
    kept = decontam.drop_leaks(spark, docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(ugly_rows()) - 3
    assert decontam.query(spark, docs, benchmark.where("false")).count() == 0
    assert decontam.drop_leaks(spark, docs, benchmark.where("false")).count() == len(ugly_rows())
    assert decontam.query(spark, docs.where("false"), benchmark).count() == 0
