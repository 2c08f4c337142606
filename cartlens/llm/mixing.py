"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Every document is repeated a Poisson number of times.  The mean is the rate of its source: the
target weight times the size of the corpus, over the size of the source.  The number comes from
a hash of document id and seed, turned into a uniform number and looked up in the cumulative
distribution of the source, so it is the same on every run and for every layout.
"""

from pyspark.sql import functions as F

from cartlens.llm.common import spare
from cartlens.session import materialise

SEED = 17
TEMPERATURE = 0.5
BROADCAST_SOURCES = 2_000
SALTS = 64


def uniform(*parts):
    """A number in [0, 1) with 52 random bits, from the MD5 of the parts joined by '/'."""
    digest = F.md5(F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def source_rates(docs, weights=None, temperature=TEMPERATURE, size="chars"):
    """``source, rows, size, weight, rate``: the mean number of copies of a document by source.

    ``size`` is "chars" (code points of the text) or "rows".  ``weights`` maps sources to
    relative target weights; without it a source weighs its size to the power ``temperature``.
    Sources that ``weights`` leaves out get nothing.  Weights are scaled to sum to one.  Null is
    a source of its own, named by the empty string like an empty source.  A source without a
    single character keeps each of its documents once.
    """
    measure = F.coalesce(F.length("text"), F.lit(0)) if size == "chars" else F.lit(1)
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(measure.cast("long")).alias("size")
    )
    if weights is None:
        raw = F.pow(F.col("size").cast("double"), F.lit(float(temperature)))
    else:
        raw = F.lit(0.0)
        for source, weight in weights.items():
            raw = F.when(F.col("source") == source, F.lit(float(weight))).otherwise(raw)
    weighed = materialise(sizes.withColumn("raw", F.when(F.col("size") > 0, raw).otherwise(0.0)), "source-sizes")
    totals = weighed.agg(F.sum("size").alias("all_size"), F.sum("raw").alias("all_raw"))
    share = F.try_divide(F.col("raw"), F.col("all_raw"))
    return weighed.crossJoin(F.broadcast(totals)).select(  # totals is one row
        "source",
        "rows",
        "size",
        F.coalesce(share, F.lit(0.0)).alias("weight"),
        F.coalesce(share * F.col("all_size") / F.nullif("size", F.lit(0)), F.lit(1.0)).alias("rate"),
    )


def cumulative_poisson(rate):
    """SQL of the array of P(X <= 0), P(X <= 1), ... until it is one for any 52-bit number.

    Terms go by logarithms, so a large rate does not underflow to nothing.
    """
    last = f"cast({rate} + 12 * sqrt({rate}) + 40 as int)"
    return f"""if({rate} <= 0, array(1D), aggregate(sequence(1, {last}),
        named_struct('at', -({rate}), 'cdf', array(exp(-({rate})))),
        (s, k) -> named_struct(
            'at', s.at + ln({rate}) - ln(k),
            'cdf', array_append(s.cdf, element_at(s.cdf, -1) + exp(s.at + ln({rate}) - ln(k)))),
        s -> s.cdf))"""


def copy_counts(docs, weights=None, temperature=TEMPERATURE, size="chars", seed=SEED, name="copies"):
    """``docs`` with ``name``: how often each document is repeated, perhaps never.

    A row without ``doc_id`` draws by its text instead.  Rows that share an id (or, without
    one, a text) draw the same number.
    """
    rates = source_rates(docs, weights, temperature, size)
    key, cdf, salt = (spare(docs, c) for c in ("_source", "_cdf", "_salt"))
    curves = materialise(
        rates.select(
            F.col("source").alias(key), F.expr(cumulative_poisson("rate")).alias(cdf)
        ),
        "source-curves",
    )
    rows = docs.withColumn(key, F.coalesce("source", F.lit("")))
    if curves.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(curves), key)
    else:  # a large source is spread over salts, the curve of a source is repeated for each
        salted = curves.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int")
        joined = rows.withColumn(salt, spread).join(salted, [key, salt])
    draw = uniform(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.col("text")))
    # The draw comes first in its lambda, so it is worked out once.
    count = F.transform(F.array(draw), lambda u: F.size(F.filter(cdf, lambda p: p <= u)))[0]
    return joined.withColumn(name, count.cast("long")).select(
        *[F.col(f"`{c}`") for c in docs.columns], name
    )


def mix(docs, weights=None, temperature=TEMPERATURE, size="chars", seed=SEED):
    """The mixed corpus: each document as often as it drew, with ``copy`` from 0, shuffled.

    ``shuffle_key`` is a hash of id, copy and seed.  Rows go to partitions by it and are sorted
    by it there, so the order has nothing to do with source or input order, copies of one
    document lie apart, and no sample of the data is needed to find ranges.  Columns of the
    input called ``copy`` or ``shuffle_key`` give way.
    """
    docs = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    )
    copies = spare(docs, "_copies")
    counted = copy_counts(docs, weights, temperature, size, seed, copies).where(F.col(copies) > 0)
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1))
    key = F.md5(
        F.concat_ws(
            "/",
            F.lit(f"shuffle-{seed}"),
            F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")),
            F.col("copy").cast("string"),
        )
    )
    return (
        counted.withColumn("copy", each)
        .select(*[F.col(f"`{c}`") for c in docs.columns], "copy", key.alias("shuffle_key"))
        .repartition("shuffle_key")
        .sortWithinPartitions("shuffle_key")
    )


def query(docs):
    """One row per copy: id, source, copy number, shuffle key, and the length of the text."""
    return mix(docs.select("doc_id", "text", "source")).select(
        "doc_id",
        "source",
        "copy",
        "shuffle_key",
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
        F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"),
    )


SQL = f"""
WITH sizes AS (
    SELECT coalesce(source, '') AS src, sum(coalesce(length(text), 0)) AS size
    FROM documents GROUP BY 1
), weighed AS (
    SELECT src, size, CASE WHEN size > 0 THEN pow(size::DOUBLE, {TEMPERATURE}) ELSE 0.0 END AS raw
    FROM sizes
), rates AS (
    SELECT src,
        CASE WHEN size > 0 THEN raw / (SELECT sum(raw) FROM weighed)
            * (SELECT sum(size) FROM weighed)::DOUBLE / size ELSE 1.0 END AS rate
    FROM weighed
), terms AS (
    SELECT src, k, exp(-rate + sum(CASE WHEN k = 0 THEN 0.0 ELSE ln(rate) - ln(k) END)
        OVER (PARTITION BY src ORDER BY k)) AS p
    FROM rates, LATERAL (SELECT unnest(range(0, (rate + 12 * sqrt(rate) + 41)::INT)) AS k)
), curves AS (
    SELECT src, sum(p) OVER (PARTITION BY src ORDER BY k) AS cdf FROM terms
), draws AS (
    SELECT *, ('0x' || substr(md5('{SEED}/' || coalesce(doc_id::VARCHAR, text, '')), 1, 13))::BIGINT
        / {float(16**13)!r} AS draw
    FROM documents
), counted AS (
    SELECT doc_id, text, d.source, draw, (SELECT count(*) FROM curves c
        WHERE c.src = coalesce(d.source, '') AND c.cdf <= d.draw) AS n
    FROM draws d
)
SELECT doc_id, source, copy,
    md5('shuffle-{SEED}/' || coalesce(doc_id::VARCHAR, text, '') || '/' || copy) AS shuffle_key,
    coalesce(length(text), 0)::BIGINT AS n_chars, md5(coalesce(text, '')) AS text_md5
FROM (SELECT *, unnest(range(0, n)) AS copy FROM counted WHERE n > 0)
"""
