"""Line dedup against brute force: plain edit distance over all pairs of lines."""

import random

import pytest
from helpers import make_docs, prose, ugly_rows, with_clashes
from pyspark.sql import functions as F

from cartlens.llm import line_dedup

BLANKS = " \t\r\x0b\x0c"


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, edits, letters="abé"):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice(letters)
        elif kind == 1:
            chars.insert(at, rng.choice(letters))
        else:
            del chars[at]
    return "".join(chars)


def slow_dropped(rows, most=2, least=20):
    """Numbers of dropped lines by document, and all near pairs of different lines."""
    places = sorted(
        (doc, pos, line.strip(BLANKS))
        for doc, text in rows
        if doc is not None and text is not None
        for pos, line in enumerate(text.split("\n"))
        if len(line.strip(BLANKS)) >= least
    )
    lines = sorted({line for _, _, line in places})
    parent = {line: line for line in lines}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = set()
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if abs(len(a) - len(b)) <= most and slow_distance(a, b) <= most:
                pairs.add((a, b))
                parent[root(a)] = root(b)
    seen, dropped = {}, {}
    for doc, pos, line in places:
        first = seen.setdefault(root(line), (doc, pos))
        if (doc, pos) > first:
            dropped.setdefault(doc, set()).add(pos)
    return {doc: ",".join(map(str, sorted(p))) for doc, p in dropped.items()}, pairs


@pytest.mark.parametrize("most", [1, 2, 3])
def test_bit_parallel_distance(spark, most):
    rng = random.Random(most)
    rows = []
    for _ in range(800):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(4, 30)))
        b = edited(rng, a, rng.randint(0, 4)) or "a"
        rows.append((a, b) if len(a) >= len(b) else (b, a))
    rows = [(a, b, slow_distance(a, b)) for a, b in rows if len(a) - len(b) <= most]
    frame = spark.createDataFrame(rows, "a string, b string, want int").selectExpr(
        "named_struct('line', a, 'n', length(a)) as a",
        "named_struct('line', b, 'n', length(b)) as b",
        "want",
    )
    got = frame.select("want", F.expr(line_dedup.edit_distance("a", "b", most)).alias("got"))
    wrong = got.where(f"(want <= {most} and got <> want) or (want > {most} and got <= {most})")
    assert wrong.count() == 0


@pytest.mark.parametrize("block", [3, 64])
def test_classes_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(11)
    pool = [prose(i, rng.randint(3, 9))[:60] for i in range(50)]
    pool += [edited(rng, rng.choice(pool[:50]), rng.randint(1, 3)) for _ in range(150)]
    # One group whose lines hang together only by steps.
    pool += ["common opening of the line " + "x" * i + "end of it" for i in range(12)]
    rows = [
        (i, "\n".join(rng.choice([" ", "", "\t"]) + rng.choice(pool) for _ in range(rng.randint(0, 6))))
        for i in range(90)
    ]
    want, pairs = slow_dropped(rows)
    assert len(pairs) > 50
    docs = make_docs(spark, rows)
    found = line_dedup.near_pairs(docs)
    assert found.count() == len(pairs)
    got = {r.doc_id: r.dropped for r in line_dedup.query(docs).collect()}
    assert {d: x for d, x in got.items() if x} == want


def test_text_is_rebuilt_from_kept_lines(spark):
    repeat = "this line stands in many documents"
    docs = with_clashes(
        make_docs(
            spark,
            [
                (1, f"{repeat}\nfirst own line of the text"),
                (2, f"second own line is another\n{repeat}!\n\nshort"),
                (3, f"{repeat}\n {repeat}s "),
                (4, None),
                (5, ""),
                (None, repeat),
            ],
        )
    )
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text == f"{repeat}\nfirst own line of the text"
    assert rows[2].text == "second own line is another\n\nshort"
    assert rows[2].n_chars == len(rows[2].text)
    assert 3 not in rows  # nothing of its own remains
    assert rows[4].text is None and rows[5].text == ""
    assert rows[None].text == repeat


def test_ugly_rows_and_empty_table(spark):
    docs = make_docs(spark, ugly_rows())
    rows = line_dedup.query(docs).collect()
    assert len(rows) == len(ugly_rows())
    want, _ = slow_dropped([(d, t) for d, t, *_ in ugly_rows() if d != 8])
    got = {r.doc_id: r.dropped for r in rows if r.dropped}
    assert got == want == {6: "0"}
    assert {r.doc_id: r.n_lines for r in rows if r.doc_id in (1, 2, 8)} == {1: 0, 2: 1, 8: 700}
    assert line_dedup.query(docs.where("false")).collect() == []
    assert line_dedup.drop_repeated_lines(docs.where("false")).collect() == []


def slow_whole(rows, most=2, least=20):
    """Numbers of dropped lines by document where short lines count, with edits scaled to length."""
    places = sorted(
        (doc, pos, line.strip(BLANKS))
        for doc, text in rows
        for pos, line in enumerate(text.split("\n"))
        if line.strip(BLANKS)
    )
    lines = sorted({line for _, _, line in places})
    parent = {line: line for line in lines}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            allowed = min(most, most * min(len(a), len(b)) // least)
            if abs(len(a) - len(b)) <= allowed and slow_distance(a, b) <= allowed:
                parent[root(a)] = root(b)
    seen, dropped = {}, {}
    for doc, pos, line in places:
        if (doc, pos) > seen.setdefault(root(line), (doc, pos)):
            dropped.setdefault(doc, set()).add(pos)
    return {doc: ",".join(map(str, sorted(p))) for doc, p in dropped.items()}


def test_short_lines_are_classed_too(spark):
    rng = random.Random(3)
    pool = ["And ornd.", "}", "漢字漢字", "In in oredble ea.", "twenty letters here.", "twenty letters here"]
    pool += [prose(i, rng.randint(1, 5))[: rng.randint(1, 30)].strip() or "x" for i in range(40)]
    pool += [edited(rng, rng.choice([p for p in pool if len(p) > 2]), rng.randint(1, 2)) for _ in range(80)]
    rows = [(i, "\n".join(rng.choice(["", " "]) + rng.choice(pool) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    got = {r.doc_id: r.dropped for r in line_dedup.query(make_docs(spark, rows), whole=True).collect()}
    assert {d: x for d, x in got.items() if x} == slow_whole(rows)


def test_registered_paths_drop_short_repeats(spark, tmp_path):
    import corpus_pipeline

    from cartlens.llm.queries import QUERIES

    docs = make_docs(spark, [(1, "And ornd.\none"), (2, "two\nAnd ornd."), (3, "And ornd.")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r.dropped for r in QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect()}
    assert rows == {1: "", 2: "1", 3: "0"}
    kept = corpus_pipeline.dedup_lines(spark, docs, None).collect()
    assert {r.doc_id: r.text for r in kept} == {1: "And ornd.\none", 2: "two"}
