"""Toxicity: the automaton against edit distance, the classifier on held-out rows."""

import random

from helpers import make_docs, prose, ugly_rows, with_clashes
from pyspark.sql import functions as F
from test_line_dedup import edited, slow_distance

from cartlens.llm import toxicity
from cartlens.llm.common import held_out

LABELS = "doc_id long, toxic int"
INSULTS = ["grubwit", "fennelhead", "snarp", "mudlicker", "vornak"]


def slow_match(terms, word):
    """The fewest edits to a term within its allowance; stems match any beginning exactly close."""
    best = None
    for text, stem in terms:
        most = toxicity.allowed_edits(text, stem)
        heads = [word[:n] for n in range(len(word) + 1)] if stem else [word]
        edits = min(slow_distance(text, h) for h in heads)
        if edits <= most and (best is None or edits < best):
            best = edits
    return best


def test_automaton_equals_edit_distance():
    rng = random.Random(4)
    terms = [("abacus", False), ("abab", False), ("bacababaca", False), ("cabac", False), ("bacbac", True), ("ccab", True)]
    lexicon = toxicity.Lexicon(terms)
    words = [edited(rng, rng.choice(terms)[0], rng.randint(0, 3), "abc") for _ in range(1500)]
    words += ["".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    words += [t + "tail" for t, _ in terms]
    for word in words:
        got = lexicon.match(word)
        assert (got[0] if got else None) == slow_match(terms, word), word
    assert toxicity.Lexicon([]).match("word") is None


def labelled(spark, n=900):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        words = prose(i, rng.randint(20, 80)).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return make_docs(spark, rows), spark.createDataFrame(labels, LABELS)


def test_held_out_documents_are_told_apart(spark):
    docs, labels = labelled(spark)
    scored = toxicity.query(spark, docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(scored) > 100
    assert sum(r.predicted == r.toxic for r in scored) >= 0.98 * len(scored)


def test_misspelt_and_quoted_terms(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(spark, docs, labels)
    assert {t for t, _ in model["lexicon"]} >= {"snarp"}
    texts = [
        (1, "this calm text has no such word at all in it"),
        (2, "what a grubwit, what a mudlicker you are"),
        (3, "what a grubwyt, what a mudliccker you are"),
        (4, 'the word "grubwit" is an insult, he said'),
    ]
    score = toxicity.scorer(spark, model)
    got = {r.doc_id: r.s for r in make_docs(spark, texts).select("doc_id", score("text").alias("s")).collect()}
    assert got[1].n_hits == 0 and got[3].n_hits == 2 and got[4].n_quoted == 1
    assert got[2].score > 0.9 and got[3].score > 0.5
    assert got[1].score < got[4].score < got[2].score


def test_fit_sees_no_held_out_label(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn(
        "toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int")
    )
    a, b = (
        {r.doc_id: r.score for r in toxicity.query(spark, docs, x).collect()} for x in (labels, flipped)
    )
    assert a == b


def test_ugly_rows_and_empty_tables(spark):
    _, labels = labelled(spark, 40)
    docs = with_clashes(make_docs(spark, ugly_rows()))
    bad = labels.unionByName(spark.createDataFrame([(None, 1), (5, None), (5, 7), (5, 1), (5, 0)], LABELS))
    for known in (bad, labels.where("false"), labels.where("toxic = 0")):
        rows = toxicity.query(spark, docs, known).collect()
        assert len(rows) == len(ugly_rows()) and all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out for r in rows if r.doc_id is None)
    assert toxicity.query(spark, docs.where("false"), labels).collect() == []
    assert toxicity.drop_toxic(spark, docs, labels.where("false"), threshold=0.6).columns == docs.columns


def test_share_of_a_capped_class_is_kept(spark):
    """Labels that the texts do not tell apart score their share, whatever the cap."""
    docs = make_docs(spark, [(i, "") for i in range(900)])
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(900)], LABELS)
    for cap in (60, 900):
        model = toxicity.train(spark, docs, labels, per_class=cap)
        score = docs.select(toxicity.scorer(spark, model)(F.col("text"))["score"]).first()[0]
        assert 0.05 < score < 0.15
