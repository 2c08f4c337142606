"""Quality rules against plain counting, and the compression classifier on held-out rows."""

import math
import random
import re

import zstandard
from helpers import make_docs, prose, ugly_rows, with_clashes
from pyspark.sql import functions as F

from cartlens.llm import compression_quality, quality_rules
from cartlens.llm.common import held_out


def slow_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for found in places.values() if len(found) > 1 for i in found for j in range(i, i + 8)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)
    )


def texts():
    rng = random.Random(6)
    out = [t for _, t, *_ in ugly_rows()]
    for i in range(150):
        words = prose(i, rng.randint(0, 120), vocabulary=rng.choice([2, 5, 300])).split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = words[: rng.randint(0, 30)]
        out.append("".join(w + rng.choice([" ", " ", "\n", " | ", "\t", " "]) for w in words))
    out += ["x " * 5_000, "a b c d e f g h\n" * 40]
    return out


def test_measures_equal_plain_counting(spark):
    rows = list(enumerate(texts()))
    got = quality_rules.measures(make_docs(spark, rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert {r.doc_id: tuple(r[n] for n in names) for r in got} == {
        i: slow_measures(t) for i, t in rows
    }


def test_thresholds_follow_their_group(spark, monkeypatch):
    rows = []
    for i in range(400):
        text = prose(i, 60)
        if i % 2:  # one source writes with many marks
            text = text.replace(" ", " * ")
        rows.append((i, text, "en", f"s{i % 2}"))
    rows += [(1000, prose(1, 60).replace(" ", " * "), "en", "s0"), (1001, prose(1001, 60), "en", "s1")]
    rows += [(1002, prose(2, 5), "en", "s0"), (1003, prose(3, 60), "en", "tiny")]
    docs = make_docs(spark, rows)
    got = {r.doc_id: r for r in quality_rules.query(docs).collect()}
    assert sum(r.kept for i, r in got.items() if i < 400) == 400
    assert not got[1000].kept and not got[1000].base_failed
    assert not got[1001].kept  # long words are as odd in one source as marks in the other
    assert got[1003].kept  # a small source borrows the thresholds of its language
    assert got[1002].base_failed and not got[1002].kept
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", 0)
    assert {r.doc_id: r for r in quality_rules.query(docs).collect()} == got


def test_every_measure_decides_a_case(spark):
    def repeating(seed):
        words = prose(seed, 90, 3000).split()
        return " ".join(words[:60] + words[40:50] + words[60:])

    calm = [(i, prose(i, 100, 3000)) for i in range(300)]
    lines = [("same odd line" if i % 2 else prose(9000 + i, 3, 3000)) for i in range(34)]
    odd = {
        1000: " ".join("x".join(w * 2 for w in prose(1, 100).split()[i : i + 1]) for i in range(100)),
        1001: " ".join("|" + w[1:] for w in prose(2, 100, 3000).split()),
        1002: "\n".join(lines),
        1003: repeating(3),
        1004: prose(4, 22, 3000),
    }
    rows = [(i, t, "en", "plain") for i, t in [*calm, *odd.items()]]
    # Where more than one document in a hundred repeats itself, the same share is no outlier.
    rows += [(2000 + i, repeating(i) if i % 20 == 0 else t, "en", "songs") for i, t in calm]
    docs = make_docs(spark, rows)
    judged = quality_rules.judged(docs).collect()
    rates = {r.doc_id: r for r in judged}
    assert not any(r.base_failed for r in judged)
    assert {r.doc_id for r in judged if not r.kept} == set(odd)
    assert all(rates[i].kept for i in range(2000, 2300))
    # Each odd document lies beyond one fence only.
    beyond = {}
    for name, column in quality_rules._rates().items():
        outside = quality_rules.judged(docs).where("doc_id between 1000 and 1004").where(
            (column < F.col(f"low_{name}")) | (column > F.col(f"high_{name}"))
        )
        beyond[name] = sorted(r.doc_id for r in outside.collect())
    assert beyond == {
        "word_length": [1000], "symbol_share": [1001], "dup_line_share": [1002],
        "repeat_share": [1003], "log_words": [1004],
    }


def test_rules_on_ugly_rows_and_empty_table(spark):
    docs = with_clashes(make_docs(spark, ugly_rows()))
    rows = quality_rules.query(docs).collect()
    assert len(rows) == len(ugly_rows())
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (1, 2, 3, 4))
    assert quality_rules.query(docs.where("false")).collect() == []


def labelled(spark, n=1200):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        words = prose(i, rng.randint(30, 200))
        if not good:
            words = rng.choice([words.replace(" ", " | "), words.replace(" ", "%%% "), words.upper()])
        rows.append((i, words))
        labels.append((i, int(good)))
    return make_docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")


def test_classifier_tells_held_out_documents_apart(spark):
    docs, labels = labelled(spark)
    rows = compression_quality.query(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows) > 100


def test_classifier_sees_no_held_out_label(spark):
    docs, labels = labelled(spark, 300)
    flipped = labels.withColumn(
        "quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")).cast("int")
    )
    a, b = (
        {r.doc_id: r.score for r in compression_quality.query(docs, x).collect()} for x in (labels, flipped)
    )
    assert a == b


def test_scores_equal_a_plain_reading_of_the_model(spark):
    """Each score worked out again, one text at a time, with compressors made afresh."""
    docs, labels = labelled(spark, 120)
    docs = docs.unionByName(make_docs(spark, [(9_000 + i, t) for i, (_, t, *_) in enumerate(ugly_rows())]))
    model = compression_quality.train(docs, labels)

    def size(data, dictionary):
        total = 0
        for at in range(0, len(data), 2_048):
            known = zstandard.ZstdCompressionDict(dictionary)
            tool = zstandard.ZstdCompressor(
                level=3, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            total += len(tool.compress(data[at : at + 2_048]))
        return total

    def slow(text):
        data = (text or "").encode()
        good, bad = (size(data, d) for d in model["dictionaries"])
        raw = (0.0, 0.0, 0.0)
        if data:
            raw = ((bad - good) / (bad + good), *(math.log(n / len(data) + 0.01) for n in (good, bad)))
        z = [min(4, max(-4, (x - m) / s)) for x, m, s in zip(raw, model["mean"], model["scale"])]
        terms = z + [z[i] * z[j] for i in range(3) for j in range(i, 3)]
        odds = model["beta"][0] + sum(b * t for b, t in zip(model["beta"][1:], terms))
        return raw[0], 1 / (1 + math.exp(-odds))

    rows = compression_quality.score_documents(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        difference, score = slow(r.text)
        assert math.isclose(r._quality.difference, difference, abs_tol=1e-12)
        assert math.isclose(r._quality.score, score, abs_tol=1e-9)


def test_ids_may_be_text(spark):
    docs, labels = labelled(spark, 60)
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    got = compression_quality.query(docs.withColumn("doc_id", name), labels.withColumn("doc_id", name))
    assert got.count() == docs.count() and got.where("doc_id like 'd%'").count() == docs.count()


def test_whole_texts_are_packed():
    packer = compression_quality.Packer(b"good words here " * 20, b"")
    short = packer.measures(b"abcdefgh" * 4)
    long = packer.measures(prose(1, 20_000).encode())
    assert packer.measures(b"") == (0.0, 0.0, 0.0) and short != long


def test_classifier_on_ugly_rows_and_empty_tables(spark):
    _, labels = labelled(spark, 40)
    docs = with_clashes(make_docs(spark, ugly_rows()))
    for known in (labels, labels.where("false"), labels.where("quality = 1")):
        rows = compression_quality.query(docs, known).collect()
        assert len(rows) == len(ugly_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert compression_quality.query(docs.where("false"), labels).collect() == []


def test_share_of_a_capped_class_is_kept(spark):
    """Labels that the texts do not tell apart score their share, whatever the cap."""
    docs = make_docs(spark, [(i, prose(i, 40)) for i in range(900)])
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(900)], "doc_id long, quality int")
    for cap in (60, 900):
        model = compression_quality.train(docs, labels, per_class=cap)
        scored = compression_quality.score_documents(docs, model)
        mean = scored.agg(F.avg("_quality.score")).first()[0]
        assert 0.02 < mean < 0.2
