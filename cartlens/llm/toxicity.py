"""Toxicity: Levenshtein automata run against a lexicon trie, weighted by the words around.

The lexicon is learnt from labelled documents: whole words and word beginnings that set toxic
documents apart, chosen one by one for the toxic documents they newly explain, so that words
which merely sit in many copies of one toxic text are passed over.  A word of a text matches a
term within the edits its length allows.  The automaton of all terms is the product of the
trie with the Levenshtein automaton, made deterministic lazily, so a word costs one table
lookup per character and most words die after two or three.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.common import fit_logistic, held_out, labelled_sample, logistic, mean_one

WORD = re.compile(r"[^\W_]+")
# Words that report speech or speak to a person, and quotation marks.
REPORTING = frozenset(
    "said says quoted quote wrote writes called calls term word words insult insults slur "
    "dijo dice palabra insulto sagte sagt wort genannt dit disait mot insulte".split()
)
PERSON = frozenset("you your youre u ur yourself tu usted eres du dich dein sie vous toi es".split())
QUOTES = "\"“”«»„"
WINDOW = 6
STEM_LENGTHS = (4, 5, 6)
MIN_TERM = 4
MAX_TERM = 24
CACHE_WORDS = 300_000


def allowed_edits(term, stem):
    """Edits that a term forgives: none when short, one from six letters, two from ten."""
    if stem:
        return 0 if len(term) < 6 else 1
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class Lexicon:
    """Terms as a trie; ``match`` runs a word through the lazily determinised automaton.

    ``terms`` is a list of ``(text, is_stem)``; a stem matches every word that begins with it.
    """

    def __init__(self, terms):
        self.terms = list(terms)
        self.children, self.ends, self.budget = [{}], [None], [0]
        for number, (text, stem) in enumerate(self.terms):
            node, edits = 0, allowed_edits(text, stem)
            self.budget[0] = max(self.budget[0], edits)
            for char in text:
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.budget.append(0)
                node = self.children[node][char]
                self.budget[node] = max(self.budget[node], edits)
            if self.ends[node] is None or stem:
                self.ends[node] = (number, stem, edits)
        self.numbers, self.states, self.steps, self.found = {}, [], [], []
        self.start = self._state({(0, 0)}, None)

    def _state(self, points, kept):
        """The number of the state holding ``(node, edits)`` points and a stem found so far."""
        best = {}
        open_points = list(points)
        while open_points:  # skipping a letter of the term reads nothing
            node, edits = open_points.pop()
            if edits > self.budget[node] or best.get(node, 99) <= edits:
                continue
            best[node] = edits
            open_points += [(child, edits + 1) for child in self.children[node].values()]
        ends = [
            (edits, number, stem)
            for node, edits in best.items()
            if self.ends[node] is not None
            for number, stem, most in [self.ends[node]]
            if edits <= most
        ]
        stems = [(edits, number) for edits, number, stem in ends if stem]
        kept = min([*stems, *([kept] if kept else [])], default=None)
        key = (frozenset(best.items()), kept)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            whole = [(edits, number) for edits, number, _ in ends]
            self.found.append(min([*whole, *([kept] if kept else [])], default=None))
        return self.numbers[key]

    def _step(self, state, char):
        points, kept = self.states[state]
        after = set()
        for node, edits in points:
            child = self.children[node].get(char)
            if child is not None:
                after.add((child, edits))
            after.add((node, edits + 1))
            after.update((other, edits + 1) for other in self.children[node].values())
        return self._state(after, kept)

    def match(self, word):
        """``(edits, term number)`` of the closest term, or None."""
        state = self.start
        for char in word:
            steps = self.steps[state]
            after = steps.get(char)
            if after is None:
                after = self._step(state, char)
                if len(self.numbers) < 200_000:  # the table itself, not the answer, is bounded
                    steps[char] = after
            state = after
            points, kept = self.states[state]
            if not points:
                return kept
        return self.found[state]


def _hits(lexicon, text, cache):
    """``(word, edits, term, quoted, personal)`` of every match in a text."""
    lowered = text.lower()
    words = WORD.findall(lowered)
    places = []
    for i, word in enumerate(words):
        try:
            found = cache[word]
        except KeyError:
            if len(cache) >= CACHE_WORDS:
                cache.clear()
            found = cache[word] = lexicon.match(word) if len(word) >= MIN_TERM - 1 else None
        if found is not None:
            places.append((i, found))
    if not places:
        return []
    spans = [m.span() for m in WORD.finditer(lowered)]
    hits = []
    for i, (edits, term) in places:
        near = words[max(0, i - WINDOW) : i + WINDOW + 1]
        left = lowered[spans[max(0, i - WINDOW)][0] : spans[i][0]]
        right = lowered[spans[i][1] : spans[min(len(words) - 1, i + WINDOW)][1]]
        in_quotes = any(q in left for q in QUOTES) and any(q in right for q in QUOTES)
        hits.append(
            (
                words[i],
                edits,
                term,
                in_quotes or not REPORTING.isdisjoint(near),
                not PERSON.isdisjoint(near),
            )
        )
    return hits


def _evidence(hits, weights, harmless):
    """One number of a document: the damped sum of the strengths of its hits.

    A quoted hit counts a quarter, one that addresses a person a quarter more; a misspelling
    seen in harmless documents of the sample counts nothing.
    """
    total = 0.0
    for word, edits, term, quoted, personal in hits:
        if edits and word in harmless:
            continue
        strength = weights.get((term, min(edits, 1)), 0.0)
        total += strength * (0.25 if quoted else 1.25 if personal else 1.0)
    return float(np.log1p(total))


def _candidates(text):
    words = {w for w in WORD.findall(text.lower()) if MIN_TERM <= len(w) <= MAX_TERM}
    stems = {(w[:n], True) for w in words for n in STEM_LENGTHS if len(w) > n}
    return {(w, False) for w in words} | stems


def _origin(text):
    """One number that near copies of a text mostly share: the least hash of its word runs."""
    words = WORD.findall(text.lower())
    runs = {" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))}
    return min(zlib.crc32(run.encode()) for run in runs)


def learn_lexicon(sample, min_texts=5, precision=0.95, covers=3, min_gain=0.004, most=2_000):
    """Terms ``(text, is_stem)`` from a labelled sample, at most ``most`` of them.

    A term must occur in ``min_texts`` toxic texts and be ``precision`` pure; near copies count
    as one text.  Terms are taken greedily, the one first that the most texts with fewer than
    ``covers`` terms contain, until that is less than ``min_gain`` of them.  Among terms within
    a fiftieth of the best, whole words come before beginnings and longer ones before shorter.
    What reaches the driver is bounded by the sample.
    """

    def terms(batches):
        for batch in batches:
            rows = [
                (text, stem, label, origin)
                for label, whole in zip(batch.label, batch.text)
                for origin in [_origin(whole)]
                for text, stem in _candidates(whole)
            ]
            yield pd.DataFrame(rows, columns=["term", "stem", "label", "origin"])

    found = sample.select("label", "text").mapInPandas(
        terms, "term string, stem boolean, label int, origin long"
    )
    totals = {
        r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()
    }
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return []
    seen = found.groupBy("term", "stem").agg(
        F.sum("label").alias("bad"),
        F.sum(F.lit(1) - F.col("label")).alias("good"),
        F.collect_set(F.when(F.col("label") == 1, F.col("origin"))).alias("texts"),
    )
    rate = F.col("bad") / toxic / (F.col("bad") / toxic + F.col("good") / clean)
    rows = seen.where((F.size("texts") >= min_texts) & (rate >= precision)).collect()
    left = {(r["term"], r["stem"]): set(r["texts"]) for r in rows}
    need = max(min_texts, min_gain * len(set().union(*left.values())))
    lexicon, covered = [], Counter()
    while left and len(lexicon) < most:
        gains = {k: sum(covered[t] < covers for t in texts) for k, texts in left.items()}
        top = max(gains.values())
        if top < need:
            break
        best = max(
            (k for k, gain in gains.items() if gain >= 0.98 * top),
            key=lambda k: (not k[1], len(k[0]), gains[k], k[0]),
        )
        lexicon.append(best)
        covered.update(left.pop(best))
        # What gained too little can only gain less; what the new term implies adds nothing.
        left = {
            k: v
            for k, v in left.items()
            if gains[k] >= need
            and not best[0].startswith(k[0])
            and not (best[1] and k[0].startswith(best[0]))
        }
    return lexicon


def train(spark, docs, labels, per_class=3_000, extra_terms=()):
    """A model dictionary from the labelled documents that are not held out.

    ``per_class`` bounds the sample of each class.  ``extra_terms`` adds whole words to the
    learnt lexicon.  Half of the sample names harmless look-alikes and weighs the terms, the
    other half calibrates, weighted to the true shares of the classes.
    """
    sample = labelled_sample(docs, labels, "toxic", per_class, "toxicity-sample")
    lexicon = learn_lexicon(sample)
    lexicon += [(t, False) for t in extra_terms if (t, False) not in lexicon]
    sent = spark.sparkContext.broadcast(Lexicon(lexicon))

    def found(batches):
        cache = {}
        for batch in batches:
            hits = [_hits(sent.value, text, cache) for text in batch.text]
            yield pd.DataFrame(
                {
                    "label": batch.label,
                    "half": batch.half,
                    "weight": batch.weight,
                    "hits": [
                        [(w, int(e), int(t), bool(q), bool(p)) for w, e, t, q, p in set(h)]
                        for h in hits
                    ],
                }
            )

    schema = (
        "label int, half int, weight double, hits array<struct<word string, edits int, term int, "
        "quoted boolean, personal boolean>>"
    )
    rows = sample.select("label", "half", "weight", "text").mapInPandas(found, schema).collect()
    harmless, counts = set(), {}
    size = {0: 1, 1: 1}
    for row in rows:
        if row["half"] == 0:
            size[row["label"]] += 1
            if row["label"] == 0:
                harmless |= {h["word"] for h in row["hits"] if h["edits"]}
            for key in {(h["term"], min(h["edits"], 1)) for h in row["hits"]}:
                counts.setdefault(key, [0, 0])[row["label"]] += 1
    weights = {}
    for number in range(len(lexicon)):
        good, bad = counts.get((number, 0), (0, 0))
        whole = max(0.0, np.log((bad + 1) / size[1]) - np.log((good + 0.05) / size[0]))
        weights[number, 0] = float(whole)
        # A look-alike that harmless documents have too is mostly another word.
        good, bad = counts.get((number, 1), (0, 0))
        share = (bad / size[1] + 1e-4) / (bad / size[1] + good / size[0] + 2e-4)
        weights[number, 1] = float(whole * max(0.0, 2 * share - 0.6)) if good else float(0.8 * whole)
    calibrating = [r for r in rows if r["half"] == 1]
    x = [_evidence([tuple(h) for h in r["hits"]], weights, harmless) for r in calibrating]
    y = [r["label"] for r in calibrating]
    stands_for = mean_one([r["weight"] for r in calibrating])
    return {
        "lexicon": lexicon,
        "weights": weights,
        "harmless": frozenset(harmless),
        "beta": fit_logistic(np.array(x).reshape(-1, 1), y, stands_for).tolist(),
    }


RESULT = T.StructType(
    [T.StructField("score", T.DoubleType()), T.StructField("n_hits", T.LongType()),
     T.StructField("n_quoted", T.LongType())]
)


def scorer(spark, model):
    """A column function: text to ``score, n_hits, n_quoted``.  Null text counts as empty."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = sent.value
        lexicon, cache = Lexicon(known["lexicon"]), {}
        base, slope = known["beta"]
        for texts in batches:
            rows = []
            for text in texts:
                hits = _hits(lexicon, text or "", cache)
                x = _evidence(hits, known["weights"], known["harmless"])
                rows.append(
                    (
                        float(logistic(base + slope * x)),
                        len(hits),
                        sum(h[3] for h in hits),
                    )
                )
            yield pd.DataFrame(rows, columns=RESULT.names)

    return score


def query(spark, docs, labels):
    """One row per document: held-out flag, score and prediction at 0.5.

    Null text counts as empty, and an empty text gets the score of a text without hits.
    Repeated rows each get their row.  Without labels every score is 0.5.
    """
    model = train(spark, docs, labels)
    scored = docs.select("doc_id", scorer(spark, model)(F.col("text")).alias("found"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("found.score").alias("score"),
        (F.col("found.score") >= 0.5).cast("int").alias("predicted"),
        F.col("found.n_hits").alias("n_hits"),
        F.col("found.n_quoted").alias("n_quoted"),
    )


def drop_toxic(spark, docs, labels, threshold=0.5):
    """The rows whose score stays below ``threshold``; null and empty texts are not toxic."""
    model = train(spark, docs, labels)
    return docs.where(scorer(spark, model)(F.col("text"))["score"] < threshold)
