"""Personal data: base patterns as the definition has them, and what the trees add."""

import hashlib
import random
import re

from helpers import make_docs, prose, ugly_rows, with_clashes

from cartlens.llm import pii


def slow_base(text):
    """The patterns word for word."""
    text = text or ""
    found = [
        (0, *m.span())
        for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)
    ]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(
            sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))
        )
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            found.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((3, *m.span()))
    return found


SEEDS = [
    "ab.c@d-e.com", "x@y", "a@b@c.org", "a@b.com.x@y.org", "@a.b", "1.2.3.4", "1.2.3.4.5.6.7.8",
    "999.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112",
    "+1 (988) 555-2485", "+12", "+1 2 3 4 5 6 7 8", "+1((2345678", "12 34", "é@ü.com", "u%+@q.r.s",
    "4532 0151 1283 0366 12", "+49.30.1234567+1", "(555) 123-4567", "name [at] site dot com", "a..b@c..d",
]


def test_base_equals_the_patterns():
    rng = random.Random(1)
    for _ in range(3000):
        parts = [rng.choice(SEEDS) for _ in range(rng.randint(0, 4))]
        text = "".join(p + rng.choice(["", " ", "\n", ".", "-", "é ", "@", "+", "1"]) for p in parts)
        assert pii.base_spans(text) == slow_base(text), text
    for _ in range(3000):
        text = "".join(rng.choice("a1+@. -(9é\n") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == slow_base(text), text


def test_long_runs_take_linear_time():
    for run in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "1 " * 150_000):
        pii.base_spans(run)
        pii.proposals(run)


def corpus(spark):
    rng = random.Random(2)
    rows = []
    for i in range(500):
        words = prose(i, 60).split()
        number = "".join(rng.choice("0123456789") for _ in range(15))
        number += next(d for d in "0123456789" if pii.luhn(number + d))
        known = [
            f"user{i}.{rng.randint(1, 99)}@mail{i % 9}.example.com",
            ".".join(str(rng.randint(1, 255)) for _ in range(4)),
            number,
            f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
        ]
        other = [f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", "2021-03-04 12:30",
                 f"order {rng.randint(10**12, 10**13)}", "a at home.Then more"]
        for piece in (rng.choice(known), rng.choice(other)):
            words.insert(rng.randrange(1, 59), piece)
        rows.append((i, " ".join(words)))
    rows += [(1000, prose(1, 20) + " mail user77.12 [at] mail3.example.com " + prose(2, 20)),
             (1001, prose(3, 20) + " call 988-555-2485 now " + prose(4, 20))]
    return rows


def test_base_columns_and_added_spans(spark):
    rows = corpus(spark)
    got = {r.doc_id: r for r in pii.query(make_docs(spark, rows)).collect()}
    added = 0
    for i, text in rows:
        want = slow_base(text)
        spans = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want]
        row = got[i]
        assert row.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == n for x in want) for n in range(4)]
        every = row.spans.split(",") if row.spans else []
        assert set(spans) <= set(every) and len(every) == len(spans) + row.n_added
        order = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in every]
        assert order == sorted(order)
        added += row.n_added
    found = [s.split(":") for s in got[1000].spans.split(",") if s]
    assert "user77.12 [at] mail3.example.com" in [rows[500][1][int(s) : int(e)] for _, s, e in found]
    assert added < 60  # other numbers are mostly left alone


def test_result_does_not_depend_on_layout(spark):
    rows = corpus(spark)[:200]
    a, b = (
        {r.doc_id: r.spans for r in pii.query(make_docs(spark, r, parts)).collect()}
        for r, parts in ((rows, 2), (rows[::-1], 5))
    )
    assert a == b


def test_ugly_rows_and_empty_table(spark):
    docs = with_clashes(make_docs(spark, ugly_rows()))
    rows = pii.query(docs).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(rows) == len(ugly_rows())
    assert all(r.base_sha256 == empty and r.spans == "" for r in rows)
    assert pii.query(docs.where("false")).collect() == []


def disguised_corpus(spark):
    """Documents with exact spans to learn from, then disguised ones, among other numbers."""
    rng = random.Random(8)
    rows, planted = corpus(spark)[:500], []
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    for i in range(160):
        card = "4" + digits(14)
        card += next(d for d in "0123456789" if pii.luhn(card + d))
        quads = [str(rng.randint(1, 255)) for _ in range(4)]
        kind, before, span = rng.choice(
            [
                (0, "write to", f"jane{i} [at] mail dot com"),
                (0, "", f"jane.doe{i}(at)firm{i % 7}(dot)org"),
                (0, "contact", f"jane dot doe at mail{i} dot example dot org"),
                (1, "host", "[.]".join(quads)),
                (1, "", " . ".join(quads)),
                (2, "card", ".".join(card[j : j + 4] for j in range(0, 16, 4))),
                (2, "visa", "/".join(card[j : j + 4] for j in range(0, 16, 4))),
                (3, "call", f"{rng.randint(200, 999)}-555-{digits(4)}"),
                (3, "telefon", f"0{rng.randint(10, 99)} {digits(3)} {digits(4)}"),
                (3, "phone", "+1 988 555 1234".translate({0x30 + d: 0xFF10 + d for d in range(10)})),
            ]
        )
        other = rng.choice([f"version {rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}",
                            "on 2021-03-04 12:30", f"order {digits(4)}-{digits(4)}-{digits(2)}", f"id {digits(10)}",
                            "isbn 978-3-16-148410-0"])
        text = f"{prose(5000 + i, 15)} {before} {span} {prose(6000 + i, 12)} {other} {prose(7000 + i, 9)}"
        start = text.index(span)
        planted.append((2000 + i, f"{pii.KINDS[kind]}:{start}:{start + len(span)}", other))
        rows.append((2000 + i, text))
    return rows, planted


def test_disguised_data_are_found_and_other_numbers_are_not(spark):
    rows, planted = disguised_corpus(spark)
    got = {r.doc_id: r for r in pii.query(make_docs(spark, rows)).collect()}
    texts, hit, wrong = dict(rows), {}, 0
    for doc, span, other in planted:
        spans = got[doc].spans.split(",") if got[doc].spans else []
        kind = span.split(":")[0]
        hit.setdefault(kind, []).append(span in spans)
        at = texts[doc].rindex(other)
        wrong += sum(int(s.split(":")[1]) < at + len(other) and at < int(s.split(":")[2]) for s in spans)
    assert sum(map(sum, hit.values())) >= 0.9 * len(planted), {k: (sum(v), len(v)) for k, v in hit.items()}
    assert all(sum(v) >= 0.7 * len(v) for v in hit.values()), {k: (sum(v), len(v)) for k, v in hit.items()}
    assert wrong <= 0.03 * len(planted)


def plain_threshold(judged):
    """Smallest probability from one half up at which 99 of 100 that pass are positive."""
    found = 2.0
    for cut in {p for p, _ in judged if p >= 0.5}:
        passed = [label for p, label in judged if p >= cut]
        if sum(passed) >= 0.99 * len(passed):
            found = min(found, cut)
    return found


def test_thresholds_equal_plain_counting(spark):
    rng = random.Random(4)
    rows = [(k, int(rng.random() < (0.2, 0.999, 0.99)[k]), round(rng.random(), 2)) for k in range(3) for _ in range(1500)]
    rows = [(k, 1 if p > 0.8 and rng.random() < 0.995 else label, p) for k, label, p in rows]
    got = pii.thresholds(spark.createDataFrame(rows, "kind int, label int, p double").repartition(5))
    want = {k: plain_threshold([(p, label) for kind, label, p in rows if kind == k]) for k in range(4)}
    assert got == want and want[3] == 2.0 and 0.5 <= want[1] < 1


def test_every_sure_proposal_trains(spark):
    rows = [(i, f"{prose(i, 5)} {i % 250 + 1}.2.3.{i // 250 + 1} {prose(i + 1, 5)}") for i in range(3000)]
    found = pii.find(make_docs(spark, rows))
    sure = {(p.kind, p.known, p.before, p.span, p.after) for r in found.collect() for p in r.proposed if p.known >= 0}
    assert sum(s[0] == 1 and s[1] for s in sure) == 3000  # over the 1,250 of a kind that were the most
    training = pii.training_rows(found)
    assert training.where("kind = 1 and label = 1").count() >= 3000
    assert training.count() >= len(sure)
