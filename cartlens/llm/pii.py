"""Personal data: generators propose spans, boosted trees judge them, thresholds select.

Exact patterns (the base) find what is certain.  Generators of high recall propose overlapping
spans of looser format: written-out mail addresses, national telephone numbers, numbers cut by
other marks, full-width characters.  Gradient-boosted trees judge a span by its format and the
words around it.  There are no labels, so they are trained on all that is sure:
base spans and disguised variants of them are positive; made-up look-alikes (dates, versions,
order and book numbers, clock times, decimals, sentences run together) and proposals without
any sign of personal data are negative.  A proposal with such a sign, a word that speaks for its
kind or a mark of disguise, is what is looked for: it is not trained on, and the trees decide.
The threshold of a kind is the smallest probability, one half at least, at which 99 of 100
held-back training spans that pass are positive.
"""

import hashlib
import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cartlens.functions.ordered import running_sums, stable_layout
from cartlens.session import materialise

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 40
PRECISION = 0.99

# The base patterns, with possessive and bounded forms that match the same in linear time.
_MAIL_TAIL = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_MAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_AT = r"(?:@|＠|\s?\[at\]\s?|\s?\(at\)\s?|\s?\{at\}\s?|\sat\s)"
_DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\s?\{dot\}\s?|\sdot\s)"
_LOOSE_MAIL = re.compile(rf"{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{2,63}}){{1,4}}", re.I)
_LOOSE = {
    1: re.compile(
        r"(?<![0-9A-Za-z.:])(?:[0-9]{1,3}(?:\.|\[\.\]|\(\.\)|\s\.\s)){3}[0-9]{1,3}(?![0-9A-Za-z])"
        r"|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])"
    ),
    2: re.compile(r"(?<![0-9])[0-9](?:[ ._/-]{0,2}[0-9]){12,18}(?![0-9])"),
    3: re.compile(
        r"(?<![0-9A-Za-z+.])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9A-Za-z])"
    ),
}
# A national number in one run, and digits written apart.
_BARE = re.compile(r"(?<![0-9A-Za-z.+])[0-9]{9,12}(?![0-9A-Za-z])|(?<![0-9A-Za-z.+])[0-9](?: [0-9]){8,13}(?![0-9A-Za-z])")
_IP_FORM = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])")
# What stands before a written-out address may be written out too.
_SPOKEN_HEAD = re.compile(r"(?:[A-Za-z0-9_%+-]{1,40}(?:\s?[\[({]dot[\])}]\s?|\sdot\s))+$", re.I)
_MARKS = re.compile(r"[\[({]\s*(?:at|dot|\.)\s*[\])}]|\s(?:at|dot)\s\S+\sdot\s|[0-9]\s\.\s[0-9]|[\uff01-\uff5e]", re.I)
# Full-width characters have the same order as ASCII; one for one, so places stay.
_NARROW = {0xFF01 + i: 0x21 + i for i in range(94)}
_WIDE = re.compile("[\uff01-\uff5e]")
# Words that speak for a kind, and words that speak for other numbers.
HINTS = (
    frozenset("mail email e write contact address correo adresse courriel".split()),
    frozenset("ip host server address addr ping client router".split()),
    frozenset("card visa mastercard credit debit payment iban tarjeta karte carte account".split()),
    frozenset("phone tel telephone call fax mobile cell telefon telefono whatsapp ring".split()),
)
OTHER = frozenset(
    "version order id no number isbn issn sha token password key page pages price date year".split()
)


def luhn(digits):
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text):
    """``(kind, start, end)`` of the exact patterns, by kind and then start."""
    found = []
    if "@" in text:
        done = 0
        for tail in _MAIL_TAIL.finditer(text):
            start = tail.start()
            while start > done and _MAIL_HEAD.match(text, start - 1):
                start -= 1
            if start < tail.start():
                found.append((0, start, tail.end()))
                done = tail.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((3, *m.span()))
    return found


def proposals(text):
    """``(kind, start, end)`` of all that the generators propose; spans may overlap."""
    found = []
    if _WIDE.search(text):
        text = text.translate(_NARROW)
    for tail in _LOOSE_MAIL.finditer(text):
        start = tail.start()
        while start > max(0, tail.start() - 64) and _MAIL_HEAD.match(text, start - 1):
            start -= 1
        if start < tail.start():
            if spoken := _SPOKEN_HEAD.search(text, max(0, start - 64), start):
                start = spoken.start()
            found.append((0, start, tail.end()))
    if _DIGIT.search(text):
        for kind, pattern in [*_LOOSE.items(), (3, _BARE)]:
            for m in pattern.finditer(text):
                digits = sum("0" <= c <= "9" for c in m[0])
                if kind != 3 or 7 <= digits <= 15 and not _IP_FORM.match(m[0]):
                    found.append((kind, *m.span()))
    return sorted(set(found))


def features(kind, left, span, right):
    """Numbers that describe the format of a span and what stands around it."""
    wide = bool(_WIDE.search(span))
    span = span.translate(_NARROW) if wide else span
    digits = "".join(c for c in span if "0" <= c <= "9")
    groups = re.findall(r"[0-9]+", span)
    words = re.findall(r"[^\W\d_]+", (left + " " + right).lower())
    tail = re.findall(r"[A-Za-z]+$", span)
    quads = [int(g) for g in groups if len(g) < 5]
    return [
        *[float(kind == k) for k in range(4)],
        float(min(len(span), 64)),
        float(min(len(digits), 40)),
        float(min(sum(c.isalpha() for c in span), 40)),
        float(min(sum(not c.isalnum() for c in span), 20)),
        float(min(len(groups), 12)),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        float(bool(digits) and luhn(digits)),
        float(len(quads) == 4 and max(quads) <= 255),
        float(span.count(".")),
        float(span.count(":")),
        float(span.startswith(("+", "00"))),
        float("(" in span),
        float("@" in span),
        float(wide),
        float(bool(re.search(r"[\[({]\s*(?:at|dot|\.)|\s(?:at|dot)\s", span, re.I))),
        float(len(tail[0]) if tail and kind == 0 else 0),
        float(bool(left) and not left[-1].isspace()),
        float(bool(right) and right[0].isalnum()),
        float(not HINTS[kind].isdisjoint(words)),
        float(not OTHER.isdisjoint(words)),
    ]


def disguise(kind, span, rng):
    """Another way to write the span of a kind."""
    if rng.random() < 0.1:
        return span.translate({narrow: wide for wide, narrow in _NARROW.items()})
    if kind == 0:
        at = rng.choice([" [at] ", "[at]", "(at)", " (at) ", "{at}", " at ", "@"])
        dots = [".", " dot ", "(dot)", "[dot]", " [dot] ", " (dot) "]
        dot = rng.choice(dots[1:] if at == "@" else dots)
        head, _, tail = span.partition("@")
        # Of any length, as the length of an address says nothing.
        head = head[: rng.randint(1, len(head))].rstrip(".") or head
        if rng.random() < 0.5:
            tail = ".".join(tail.split(".")[-2:])
        if dot == " dot " and rng.random() < 0.5:
            head = head.replace(".", dot)
        return head + at + tail.replace(".", dot)
    if kind == 1:
        return span.replace(".", rng.choice(["[.]", "(.)", " . "]))
    digits = re.sub(r"[^0-9]", "", span)
    if kind == 2:
        return rng.choice([".", "_", "/", "-", "  "]).join(
            digits[i : i + 4] for i in range(0, len(digits), 4)
        )
    head, rest = digits[:-10], digits[-10:]
    mark = rng.choice(["-", ".", " ", "/"])
    rest = mark.join(p for p in (rest[:3], rest[3:6], rest[6:]) if p)
    return rng.choice(["", f"00{head}{mark}" if head else "", f"{head}{mark}" if head else ""]) + rest


def lookalike(rng):
    """Something of the form of personal data that is none, made up anew each time."""
    n = rng.randint
    year, month, day = n(1950, 2035), n(1, 12), n(1, 28)
    word = lambda: "".join(rng.choices("abcdefghilmnoprstuvw", k=n(2, 14)))
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    failing = digits(n(12, 18))
    failing += next(d for d in rng.sample("0123456789", 10) if not luhn(failing + d))
    return rng.choice(
        [
            f"{year}-{month:02}-{day:02}",
            f"{day}.{month}.{year}",
            f"{day:02}/{month:02}/{year}",
            f"{year}-{month:02}-{day:02} {n(0, 23):02}:{n(0, 59):02}",
            f"{n(0, 23):02}:{n(0, 59):02}:{n(0, 59):02}",
            f"{year} - {year + n(1, 9)}",
            f"{n(0, 30)}.{n(0, 40)}.{n(0, 99)}",
            f"{n(1, 12)}.{n(0, 9)}.{n(1000, 30000)}.{n(0, 9)}",
            f"{digits(4)}-{digits(4)}-{digits(2)}",
            f"{digits(n(2, 3))}-{digits(n(5, 8))}-{digits(1)}",
            f"978-{n(0, 9)}-{digits(2)}-{digits(6)}-{n(0, 9)}",
            f"{n(1, 99)}.{digits(2)} {n(1, 99)}.{digits(2)} {n(1, 99)}.{digits(2)}",
            f"{n(1, 900)}-{n(901, 1800)} {n(1801, 2000)}",
            digits(n(9, 12)),
            failing,
            "-".join(failing[i : i + 4] for i in range(0, len(failing), 4)),
            f"{word()} at {word()}.{word().title()} {word()}",
            f"{word()} at {word()}.{word()}",
            f"{word()} at {word()} {word()}.{word()} dot {word()}",
        ]
    )


def _plain(words):
    """Context without the words that speak for a kind."""
    spoken = frozenset().union(*HINTS)
    return re.sub(r"[^\W\d_]+", lambda m: "" if m[0].lower() in spoken else m[0], words)


def _touching(text, start, end):
    """The proposals in ``text`` that share a character with a place, with their features."""
    for kind, s, e in proposals(text):
        if s < end and start < e:
            yield kind, s, e, features(kind, *_context(text, s, e))


def _same(kind, start, end, spans):
    """Whether a span of the same kind shares at least half of what the two cover."""
    for k, s, e in spans:
        if k == kind:
            shared = min(e, end) - max(s, start)
            if shared > 0 and 2 * shared >= max(e, end) - min(s, start):
                return True
    return False


def _context(text, start, end):
    return text[max(0, start - CONTEXT) : start], text[start:end], text[end : end + CONTEXT]


_FOUND = (
    "base array<struct<kind:int,start:int,stop:int>>, proposed array<struct<"
    "kind:int,start:int,stop:int,known:int,before:string,span:string,after:string,x:array<double>>>"
)


HINTED = -2  # the place in ``features`` that says a word speaks for the kind
UNLABELLED = -1


def _find(texts):
    rows = []
    for text in texts:
        text = text or ""
        base = base_spans(text)
        proposed = []
        for kind, start, end in proposals(text):
            left, span, right = _context(text, start, end)
            known = int(_same(kind, start, end, base))
            x = features(kind, left, span, right)
            if not known and (x[HINTED] or _MARKS.search(span)):
                known = UNLABELLED
            proposed.append((kind, start, end, known, left, span, right, x))
        rows.append((base, proposed))
    return pd.DataFrame(rows, columns=["base", "proposed"])


def find(docs):
    """``row, doc_id, base, proposed`` for each row of ``docs``, stored once.

    ``row`` numbers the rows, as ids may be missing or repeat.
    """

    @F.pandas_udf(_FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield _find(texts)

    found = docs.select("doc_id", search(F.col("text")).alias("f")).select("doc_id", "f.*")
    return materialise(found.withColumn("row", F.monotonically_increasing_id()), "pii-spans")


def _candidates(found):
    return found.select("row", F.explode("proposed").alias("p")).select("row", "p.*")


def training_rows(found):
    """``kind, x, label, half`` of the sure proposals, of disguises and of look-alikes.

    Every different proposal counts once, whatever the order and storage of its rows.  Every
    known span gives a disguise of itself, with and without a word that speaks for its kind;
    every proposal gives a look-alike in its place.
    """
    rows = _candidates(found).where(F.col("known") != UNLABELLED)
    picked = rows.select("kind", "known", "before", "span", "after", "x").distinct()

    def varied(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                seed = f"{row.kind}|{row.before}|{row.span}|{row.after}"
                half, rng = hashlib.md5(seed.encode()).digest()[0] % 2, random.Random(seed)
                out.append((row.kind, list(row.x), row.known, half))
                if row.known and len(row.span) <= 64:
                    for hint in ("", rng.choice(sorted(HINTS[row.kind])) + " "):
                        new = disguise(row.kind, row.span, rng)
                        before = row.before + hint
                        at = (row.kind, len(before), len(before) + len(new))
                        for kind, s, e, x in _touching(before + new + row.after, *at[1:]):
                            if _same(kind, s, e, [at]):
                                out.append((kind, x, 1, half))
                other = rng.choice(["", rng.choice(sorted(OTHER)) + " "])
                before, made = _plain(row.before) + " " + other, lookalike(rng)
                text, end = f"{before}{made} {_plain(row.after)}", len(before) + len(made)
                sure = base_spans(text)
                for kind, s, e, x in _touching(text, len(before), end):
                    if not _same(kind, s, e, sure):
                        out.append((kind, x, 0, half))
            yield pd.DataFrame(out, columns=["kind", "x", "label", "half"])

    schema = "kind int, x array<double>, label int, half int"
    return materialise(picked.mapInPandas(varied, schema), "pii-training")


def train(found, trees=20, depth=4):
    """The fitted trees and the threshold of each kind, or None where one class is missing."""
    rows = training_rows(found)
    halves = {(r["half"], r["label"]) for r in rows.select("half", "label").distinct().collect()}
    if not {(0, 0), (0, 1)} <= halves:
        return None, {}
    vectors = rows.withColumn("features", array_to_vector("x")).withColumn(
        "key", F.xxhash64("kind", "x", "label")
    )
    # Some negatives are so only for want of a sign, so no leaf may rest on a few.
    learner = GBTClassifier(
        maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, maxBins=64, minInstancesPerNode=10
    )
    model = learner.fit(stable_layout(vectors.where("half = 0"), "key").select("features", "label"))
    judged = model.transform(vectors.where("half = 1")).select(
        "kind", "label", vector_to_array("probability")[1].alias("p")
    )
    return model, thresholds(judged)


def thresholds(judged, precision=PRECISION):
    """For each kind the smallest probability at which ``precision`` of what passes is positive.

    ``judged`` has ``kind, label, p``, of any number of rows: one row per level of ``p`` from one
    half up is put in order.  Above 1, which nothing reaches, where there is none.
    """
    levels = judged.where("p >= 0.5").groupBy("kind", "p").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("right")
    )
    ranked = running_sums(levels, [F.col("kind"), -F.col("p")], {"all_n": "n", "all_right": "right"})
    starts = ranked.groupBy("kind").agg(
        F.min(F.col("all_n") - F.col("n")).alias("n0"),
        F.min(F.col("all_right") - F.col("right")).alias("right0"),
    )
    passed = ranked.join(F.broadcast(starts), "kind").where(
        F.col("all_right") - F.col("right0") >= precision * (F.col("all_n") - F.col("n0"))
    )
    found = {r["kind"]: r["p"] for r in passed.groupBy("kind").agg(F.min("p").alias("p")).collect()}
    return {kind: found.get(kind, 2.0) for kind in range(len(KINDS))}


def redactions(docs):
    """``doc_id, base, added``: spans ``(kind, start, stop)`` for each row of ``docs``.

    ``added`` are proposals over the threshold of their kind that touch no base span and no
    proposal of higher probability (then of greater length, then earlier).
    """
    found = find(docs)
    model, cuts = train(found)
    if model is None:
        return found.select("doc_id", "base", F.expr("filter(base, b -> false)").alias("added"))
    cut = F.lit(2.0)
    for kind, value in cuts.items():
        cut = F.when(F.col("kind") == kind, F.lit(value)).otherwise(cut)
    new = _candidates(found).where("known <> 1").withColumn("features", array_to_vector("x"))
    passed = (
        model.transform(new)
        .withColumn("p", vector_to_array("probability")[1])
        .where(F.col("p") >= cut)
        .groupBy("row")
        .agg(F.collect_list(F.struct("p", "kind", "start", "stop")).alias("passed"))
    )
    free = "not exists(coalesce(base, array()), b -> b.start < x.stop and x.start < b.stop)"
    rank = "named_struct('p', {0}.p, 'n', {0}.stop - {0}.start, 's', -{0}.start, 'k', -{0}.kind)"
    beaten = (
        "exists(passed, y -> y.start < x.stop and x.start < y.stop"
        f" and {rank.format('y')} > {rank.format('x')})"
    )
    added = (
        f"transform(filter(coalesce(passed, array()), x -> {free} and not {beaten}),"
        " x -> named_struct('kind', x.kind, 'start', x.start, 'stop', x.stop))"
    )
    return found.select("row", "doc_id", "base").join(passed, "row", "left").select(
        "doc_id", "base", F.expr(added).alias("added")
    )


def _text_of(spans):
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(
        f"array_join(transform(array_sort({spans}), x -> concat(element_at(array({names}),"
        " x.kind + 1), ':', x.start, ':', x.stop)), ',')"
    )


def query(docs):
    """One row per row of ``docs``: base counts, the hash of the base spans, and all spans.

    Spans are in code points, the end excluded.  Null text counts as empty; a text without
    spans has an empty list and the hash of the empty string.
    """
    found = redactions(docs)
    counts = [
        F.expr(f"size(filter(base, b -> b.kind = {i}))").cast("long").alias(f"n_{k}")
        for i, k in enumerate(KINDS)
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_text_of("base").cast("binary"), 256).alias("base_sha256"),
        _text_of("concat(base, added)").alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
