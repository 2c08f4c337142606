"""Benchmark decontamination: training passages query a BM25 index of test items.

The test items are a bounded side.  Document frequencies and the mean length are counted over
all items.  The items are parted by length class and cut into shards of bounded size, and each
shard is an inverted index that every task of its scan holds; no result depends on how many
shards there are.  A document is read as overlapping passages, each long enough to hold any item
of the length class whole.  Scores are BM25 over the score an item has against its own text, so
1.0 means that every term of the item is in the passage.  All items above the threshold are
retrieved: block-max sums rule out blocks of items for whole passages at once, and block-max
WAND with its pivots scores what is left.  A retrieved item counts as leaked if its question and
its answer both stand in the passage, in runs of words; of equally good passages the first one
is reported.  Very long texts are read whole, with work in proportion to their length.
"""

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.session import materialise

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
RUN = 5
BLOCKS = 128
CACHE_WORDS = 300_000
SHARD_CHARS = 16_000_000
# Items of up to 64 words are one length class; each class above holds items twice as long.
FIRST_CLASS = 6


def words_of(text):
    return WORD.findall((text or "").lower())


def question_and_answer(text):
    """The words of the question (all sentences but the last) and of the answer (the last).

    The answer takes in sentences from the end until it has ``RUN`` words.  A text that is
    one sentence, or too short for both parts, is halved, the question getting the larger half.
    """
    sentences = [w for w in (words_of(s) for s in SENTENCE.split(text or "")) if w]
    answer = []
    while len(sentences) > 1 and len(answer) < RUN:
        answer = sentences.pop() + answer
    question = [w for s in sentences for w in s]
    if len(answer) < RUN:
        every = question + answer
        half = (len(every) + 1) // 2
        question, answer = every[:half], every[half:]
    return question, answer


def coverage(part, runs, run=RUN):
    """The share of the words of ``part`` that lie in a run of ``run`` words of the passage.

    ``runs`` answers whether a tuple of words is in the passage.  A shorter part is one run.
    """
    if not part:
        return 1.0
    size = min(run, len(part))
    covered = np.zeros(len(part), bool)
    for i in range(len(part) - size + 1):
        if runs(tuple(part[i : i + size])):
            covered[i : i + size] = True
    return float(covered.mean())


class Index:
    """An inverted index of test items with block maxima.

    ``items`` is a list of ``(item_id, text)``; items without words are left out.  ``statistics``
    are the number of all items, their mean length and the number of items per term, if the
    index holds only some of them.  ``step`` is at least the length of the longest item.
    """

    def __init__(self, items, statistics=None, step=None):
        kept = [(i, words_of(t), t) for i, t in items]
        kept = sorted(((i, w, t) for i, w, t in kept if w), key=lambda x: (len(x[1]), x[0]))
        self.ids = [i for i, _, _ in kept]
        self.parts = [question_and_answer(t) for _, _, t in kept]
        self.step = step or max((len(w) for _, w, _ in kept), default=0)
        self.terms, postings = {}, defaultdict(list)
        if statistics is None:
            holding = Counter(t for _, w, _ in kept for t in set(w))
            mean = sum(len(w) for _, w, _ in kept) / max(1, len(kept))
            statistics = (len(kept), mean, holding)
        total, mean, holding = statistics
        for n, (_, words, _) in enumerate(kept):
            for term, tf in Counter(words).items():
                weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
                postings[self.terms.setdefault(term, len(self.terms))].append((n, weight))
        idf = [np.log(1 + (total - holding[t] + 0.5) / (holding[t] + 0.5)) for t in self.terms]
        own = np.zeros(len(kept))
        for term, found in postings.items():
            for n, weight in found:
                own[n] += idf[term] * weight
        # At most BLOCKS blocks, of neighbours in length; one row of maxima per term.
        self.block_items = max(1, -(-len(kept) // BLOCKS))
        blocks = -(-len(kept) // self.block_items)
        self.block_max = np.zeros((len(self.terms), blocks), np.float32)
        self.codes = {}
        self.items, self.impacts = [], []
        for term in range(len(self.terms)):
            found = postings[term]
            self.items.append([n for n, _ in found])
            self.impacts.append([idf[term] * weight / own[n] for n, weight in found])
            for n, impact in zip(self.items[-1], self.impacts[-1]):
                block = n // self.block_items
                self.block_max[term, block] = max(self.block_max[term, block], impact * 1.00001)

    def retrieve(self, terms, threshold):
        """``(item, score)`` of all items scoring at least ``threshold``, by block-max WAND.

        ``terms`` are distinct term numbers.  Cursors are kept in the order of their items; the
        pivot is the first item that the maxima of the terms before it can lift to the
        threshold, and it is scored only if the maxima of its block still can.
        """
        eps = 1e-9
        most = self.block_max[terms].max(axis=1).tolist()
        cursors = [[self.items[t][0], 0, t, m] for t, m in zip(terms, most) if self.items[t]]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound = 0.0
            for place, cursor in enumerate(cursors):
                bound += cursor[3]
                if bound >= threshold - eps:
                    break
            else:
                return found
            pivot = cursors[place][0]
            while place + 1 < len(cursors) and cursors[place + 1][0] == pivot:
                place += 1
            block = pivot // self.block_items
            if sum(self.block_max[c[2], block] for c in cursors[: place + 1]) < threshold - eps:
                # No item of this block up to the next cursor can make it.
                target = (block + 1) * self.block_items
                if place + 1 < len(cursors):
                    target = min(target, cursors[place + 1][0])
                target = max(target, pivot + 1)
            elif cursors[0][0] == pivot:
                score = sum(self.impacts[c[2]][c[1]] for c in cursors[: place + 1])
                if score >= threshold - eps:
                    found.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot
            for cursor in cursors[: place + 1]:
                postings, at = self.items[cursor[2]], cursor[1]
                while at < len(postings) and postings[at] < target:
                    at += 1
                cursor[1] = at
                cursor[0] = postings[at] if at < len(postings) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def _numbers(self, lowered):
        """Term numbers of the words of a text in order, -1 for words that no item has.

        What stands between blanks is mostly one word with marks around it, and mostly seen
        before, so a table of such pieces saves the search for words.  The table is bounded.
        """
        if len(self.codes) > CACHE_WORDS:
            self.codes.clear()
        codes, many = self.codes, False
        pieces = lowered.split()
        for piece in set(pieces).difference(codes):
            words = WORD.findall(piece)
            codes[piece] = self.terms.get(words[0], -1) if len(words) == 1 else -2 - len(words)
        numbers = np.fromiter(map(codes.__getitem__, pieces), np.int64, len(pieces))
        if len(numbers) and numbers.min() < -2:  # pieces with two words or more
            return np.array([self.terms.get(w, -1) for w in WORD.findall(lowered)], np.int64)
        return numbers[numbers != -2]

    def leaks(self, text, threshold=THRESHOLD, overlap=OVERLAP):
        """``(item_id, score, question overlap, answer overlap, first word)`` of a whole text."""
        if not self.ids:
            return []
        numbers = self._numbers((text or "").lower())
        # No item is longer than a step; a passage is two steps, so it holds any item.
        step = self.step
        at = np.flatnonzero(numbers >= 0)
        if not len(at):
            return []
        pairs = np.unique(at // step * len(self.terms) + numbers[at])
        steps, terms = np.divmod(pairs, len(self.terms))
        present, first = np.unique(steps, return_index=True)
        sums = np.add.reduceat(self.block_max[terms], first, axis=0)
        bounds = sums.copy()
        follows = np.flatnonzero(np.diff(present) == 1)
        bounds[follows] += sums[follows + 1]
        # A passage may begin with a step that has no term of the index: it is the next one alone.
        ends = np.append(first, len(terms))
        words, best = None, {}
        for n in np.flatnonzero((bounds >= threshold).any(axis=1)):
            s = int(present[n])
            pair = n + 1 < len(present) and present[n + 1] == s + 1
            query = np.unique(terms[first[n] : ends[n + 2 if pair else n + 1]])
            # What both steps have counts once, which rules out most of what is left.
            if self.block_max[query].sum(axis=0).max() < threshold:
                continue
            hits = self.retrieve(query.tolist(), threshold)
            if not hits:
                continue
            words = words_of(text) if words is None else words
            passage = words[s * step : (s + 2) * step]
            runs = {}

            def in_passage(run):
                if len(run) not in runs:
                    n = len(run)
                    runs[n] = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
                return run in runs[len(run)]

            for item, score in hits:
                question, answer = (coverage(p, in_passage) for p in self.parts[item])
                if question >= overlap and answer >= overlap:
                    row = (question + answer, score, question, answer, int(s * step))
                    if item not in best or row[:2] > best[item][:2]:
                        best[item] = row
        return [(self.ids[n], *best[n][1:]) for n in sorted(best)]


HIT = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("question_overlap", T.DoubleType()),
            T.StructField("answer_overlap", T.DoubleType()),
            T.StructField("passage_word", T.LongType()),
        ]
    )
)


def _searcher(shard, threshold, overlap):
    @F.pandas_udf(HIT)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(*shard.value)
        for texts in batches:
            yield pd.Series([index.leaks(t, threshold, overlap) for t in texts], dtype=object)

    # Else the search runs once more, in a filter that Spark puts before an explode.
    return search.asNondeterministic()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(texts: pd.Series) -> pd.Series:
    return texts.map(words_of)


def shards(spark, benchmark, shard_chars=SHARD_CHARS):
    """Broadcasts of what ``Index`` takes, one per shard of at most about ``shard_chars`` characters.

    Items are parted by length class, and a class by a hash of the item.  One shard at a time
    passes through the driver.  Without items there is one empty shard.
    """
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    items = items.withColumn("words", _words("text")).where(F.size("words") > 0)
    power = F.ceil(F.log2(F.size("words").cast("double"))).cast("int")
    items = items.withColumn("power", F.greatest(power, F.lit(FIRST_CLASS)))
    items = materialise(items, "benchmark-items")
    total, mean = items.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
    held = items.select(F.explode(F.array_distinct("words")).alias("term"))
    held = materialise(held.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "benchmark-terms")
    classes = items.groupBy("power").agg(F.sum(F.length("text")).alias("chars")).orderBy("power").collect()
    sent = []
    for power, chars in classes:
        parts = max(1, -(-chars // shard_chars))
        for part in range(parts):
            mine = items.where(
                (F.col("power") == power) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
            )
            terms = mine.select(F.explode("words").alias("term")).distinct().join(held, "term")
            holding = {r["term"]: r["n"] for r in terms.collect()}
            rows = [(r["item_id"], r["text"]) for r in mine.select("item_id", "text").collect()]
            sent.append(spark.sparkContext.broadcast((rows, (total, mean, holding), 2**power)))
    return sent or [spark.sparkContext.broadcast(([],))]


def leaks(spark, text, benchmark, threshold=THRESHOLD, overlap=OVERLAP, shard_chars=SHARD_CHARS):
    """A column: the array with one entry per test item that the column ``text`` leaks.

    A task holds the indexes of all shards; ``query`` and ``drop_leaks`` hold one at a time.
    Null text and items without words match nothing.
    """
    sent = shards(spark, benchmark, shard_chars)
    return F.flatten(F.array(*[_searcher(shard, threshold, overlap)(text) for shard in sent]))


def query(spark, docs, benchmark, threshold=THRESHOLD, overlap=OVERLAP, shard_chars=SHARD_CHARS):
    """One row per document and leaked item: score and overlaps of the best passage.

    Documents without a leak have no row; repeated documents each have theirs.  Null and empty
    texts leak nothing, and without documents or items there are no rows.  Every shard is a
    scan of its own, so that a task holds one index.  Only ``doc_id`` and ``text`` are read, so
    other columns may have any name.
    """
    found = None
    for shard in shards(spark, benchmark, shard_chars):
        hits = docs.select("doc_id", _searcher(shard, threshold, overlap)(F.col("text")).alias("leaks"))
        hits = hits.select("doc_id", F.explode("leaks").alias("leak"))
        found = hits if found is None else found.unionByName(hits)
    return found.select(
        "doc_id",
        "leak.item_id",
        F.round("leak.score", 6).alias("score"),
        "leak.question_overlap",
        "leak.answer_overlap",
        "leak.passage_word",
    )


def drop_leaks(spark, docs, benchmark, threshold=THRESHOLD, overlap=OVERLAP, shard_chars=SHARD_CHARS):
    """The rows without a leaked item; all their columns pass through.

    Each shard is a filter of its own.  Between two shards what is left is written, so that a
    task holds one index and a lost executor costs its tasks only.
    """
    for n, shard in enumerate(shards(spark, benchmark, shard_chars)):
        if n:
            docs = materialise(docs, "without-leaks")
        docs = docs.where(F.size(_searcher(shard, threshold, overlap)(F.col("text"))) == 0)
    return docs
