"""Quality rules with adaptive thresholds, in DataFrame and SQL functions only.

The measures of a document are worked out in its row.  Quantile sketches (KLL) of each measure
are merged per language and source, per language, and over the corpus, from the same small
sketches.  A document fails a measure that lies beyond the outer fence of its own group, with a
least width that stands for differences of no account.  A measure that is zero for nearly all
documents has no quartile distance, so its fence is at least twice the group's 99th percentile.
A group with few documents borrows the sketch of its language or of the corpus.  Very long
texts are measured whole; of the input only ``doc_id, lang, source, text`` are read, so other
columns may have any name.
"""

from pyspark.sql import functions as F

from cartlens.session import materialise

BLANKS = " \t\n\x0b\x0c\r"
RUN = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
FENCE = 6.0
MIN_GROUP = 200
BROADCAST_GROUPS = 5_000
SALTS = 64
# Measure, side of the fence, and the least distance from the nearer quartile.
MEASURES = (
    ("word_length", "both", 2.0),
    ("symbol_share", "high", 0.05),
    ("dup_line_share", "high", 0.30),
    ("repeat_share", "high", 0.05),
    # Logarithm: a text is far shorter than its group by a factor, not by a number of words.
    ("log_words", "low", 2.0),
)
# Measures whose fence is at least this multiple of that quantile, by a sketch of such size that
# its rank error (about 0.2 %) is well below what lies beyond the quantile.
TAILED = {"repeat_share": (2.0, 0.99)}
SKETCH, TAILED_SKETCH = 200, 2_000


def _let(name, value, body):
    """``value`` worked out once under ``name`` inside ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words():
    """SQL: how many words of the array ``words`` lie in a run of RUN words found again.

    Runs are compared by 64-bit hashes.  Where all hashes differ, the usual case, that is the
    answer; else hashes are sorted with their places, places of equal neighbours are put in
    order again, and each place adds its run up to the next place.
    """
    hashes = f"transform(sequence(1, size(words) - {RUN - 1}), i -> xxhash64(slice(words, i, {RUN})))"
    order = "sort_array(transform(hs, (h, i) -> named_struct('h', h, 'i', i)))"
    twins = (
        "sort_array(transform(filter(transform(o, (x, j) -> named_struct('i', x.i, 'twin',"
        " x.h <=> get(o, j - 1).h or x.h <=> get(o, j + 1).h)), x -> x.twin), x -> x.i))"
    )
    covered = (
        f"aggregate(transform(p, (x, j) -> least({RUN}, coalesce(get(p, j + 1) - x, {RUN}))),"
        " 0, (s, x) -> s + x)"
    )
    counted = _let("o", order, _let("p", twins, covered))
    return (
        f"if(size(words) < {RUN + 1}, 0, "
        + _let("hs", hashes, f"if(size(array_distinct(hs)) = size(hs), 0, {counted})")
        + ")"
    )


def measures(docs):
    """``docs`` columns ``doc_id, lang, source`` with the counts of each whole text.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` are longs; null text has no
    words, lines or characters.
    """
    text = F.coalesce("text", F.lit(""))
    split = docs.select(
        "doc_id",
        "lang",
        "source",
        text.alias("text"),
        F.expr(r"filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), w -> w <> '')").alias("words"),
    )
    lines = r"filter(split(text, '\n'), l -> rlike(l, '[^\\x20\\x09-\\x0D]'))"
    return split.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.expr(_let("l", lines, "size(l) - size(array_distinct(l))")).cast("long").alias("n_dup_lines"),
        F.expr(_repeat_words()).cast("long").alias("n_repeat_words"),
        F.size(F.expr(lines)).alias("n_lines"),
    )


def _rates():
    words = F.greatest("n_words", F.lit(1))
    return {
        "word_length": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "log_words": F.log2(words.cast("double")),
    }


def thresholds(measured, fence=FENCE, min_group=MIN_GROUP):
    """``lang_key, source_key`` with ``low_m`` and ``high_m`` for each measure.

    Documents that fail the base rules do not set thresholds.  Null and empty names are one
    group.  The fences are ``fence`` quartile distances from the quartiles, and at least the
    least distance of the measure.
    """
    names = [m for m, _, _ in MEASURES]
    sizes = {m: TAILED_SKETCH if m in TAILED else SKETCH for m in names}
    rates = _rates()
    sound = measured.where(~_base_failed()).select(
        *_keys(), *[rates[m].cast("double").alias(m) for m in names]
    )
    sketched = materialise(
        sound.groupBy("lang_key", "source_key").agg(
            F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(m, k).alias(m) for m, k in sizes.items()]
        ),
        "quantile-sketches",
    )

    def merged(*keys):
        return sketched.groupBy(*keys).agg(
            F.sum("n").alias("n"), *[F.kll_merge_agg_double(m, k).alias(m) for m, k in sizes.items()]
        )

    by_lang = merged("lang_key").select("lang_key", *[F.col(c).alias(f"lang_{c}") for c in ("n", *names)])
    # One row; grouped, as the merge of no sketches at all fails.
    corpus = merged(F.lit(0).alias("all")).select(*[F.col(m).alias(f"all_{m}") for m in names])
    groups = materialise(measured.select(*_keys()).distinct(), "quality-groups")
    joined = (
        groups.join(sketched, ["lang_key", "source_key"], "left")
        .join(by_lang, "lang_key", "left")
        .join(F.broadcast(corpus), F.lit(True), "left")
    )
    columns = ["lang_key", "source_key"]
    for name, side, least in MEASURES:
        sketch = F.when(F.col("n") >= min_group, F.col(name)).when(
            F.col("lang_n") >= min_group, F.col(f"lang_{name}")
        ).otherwise(F.col(f"all_{name}"))
        low, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        width = F.greatest(F.lit(fence) * (high - low), F.lit(least))
        never = F.lit(None).cast("double")
        columns.append((never if side == "high" else low - width).alias(f"low_{name}"))
        top = never if side == "low" else high + width
        if name in TAILED:
            times, quantile = TAILED[name]
            top = F.greatest(top, times * F.kll_sketch_get_quantile_double(sketch, F.lit(quantile)))
        columns.append(top.alias(f"high_{name}"))
    return joined.select(*columns)


def _keys():
    return [F.coalesce(c, F.lit("")).alias(f"{c}_key") for c in ("lang", "source")]


def _base_failed():
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def judged(docs, fence=FENCE, min_group=MIN_GROUP):
    """The measures of each document with ``base_failed`` and ``kept``.

    Rows are joined to the thresholds of their group: broadcast where the counted groups are
    few, else with salts, so that a large group is never one task.
    """
    measured = materialise(measures(docs), "quality-measures")
    limits = materialise(thresholds(measured, fence, min_group), "quality-thresholds")
    rows = measured.select("*", *_keys())
    keys = ["lang_key", "source_key"]
    if limits.count() <= BROADCAST_GROUPS:
        joined = rows.join(F.broadcast(limits), keys, "left")
    else:
        salted = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("salt", salt).join(salted, [*keys, "salt"], "left")
    rates = _rates()
    beyond = F.lit(False)
    for name, _, _ in MEASURES:
        outside = (rates[name] < F.col(f"low_{name}")) | (rates[name] > F.col(f"high_{name}"))
        beyond = beyond | F.coalesce(outside, F.lit(False))
    return joined.withColumn("base_failed", _base_failed()).withColumn(
        "kept", ~F.col("base_failed") & ~beyond
    )


def query(docs):
    """One row per row of ``docs``: the counts, the base verdict and the verdict.

    Null text counts as a text without words, which fails.  A corpus in which every document
    fails has no thresholds.  Null languages and sources are groups of their own.
    """
    return judged(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )
