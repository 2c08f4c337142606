"""Inputs that the tests of the training-data operators share."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Extra columns named like what operators make themselves.
CLASHES = {
    "score": "1.5D", "words": "'w'", "line": "'l'", "pos": "7", "h1": "1L", "key": "'k'",
    "copy": "9", "shuffle_key": "'s'", "_dropped": "array(0)", "_copies": "3", "_cdf": "'c'",
    "_source": "'o'", "fp": "5L", "label": "1", "Hits": "'h'",
}


def make_docs(spark, rows, parts=3):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, lang, source)`` tuples."""
    full = []
    for row in rows:
        doc, text, lang, source = (*row, "en", "s1")[:4] if len(row) == 2 else row
        full.append((doc, text, lang, source, None if text is None else len(text)))
    return spark.createDataFrame(full, DOCS).repartition(parts)


def with_clashes(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({name: F.expr(value) for name, value in CLASHES.items()})


def prose(seed, words, vocabulary=400):
    """Random words; few repeat from text to text."""
    rng = random.Random(seed)
    pool = ["".join(random.Random(i).choices("abcdeilmnorstuw", k=2 + i % 8)) for i in range(vocabulary)]
    return " ".join(rng.choice(pool) for _ in range(words))


def ugly_rows():
    """Nulls, empty, blank, odd and very long texts, ties and repeated rows."""
    long = "\n".join(prose(i, 30) for i in range(700))
    return [
        (1, None), (2, ""), (3, " \t\n \r\n"), (4, "word"), (5, prose(5, 40)), (5, prose(5, 40)),
        (6, prose(5, 40)), (None, prose(7, 40)), (None, None), (8, long), (9, "é Ü 漢字 \U0001f600 %%% |"),
        (10, prose(10, 60), None, None), (11, prose(11, 60), "", ""),
    ]
