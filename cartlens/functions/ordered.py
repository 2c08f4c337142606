"""Global order without a global task.

A window without PARTITION BY sends every row to one task, and a window partitioned by a
hot key does nearly the same.  Here the rows are stored once, cut points of the order come from
a small sample of them, and each row looks up its part among the cut points.  The window over
the part is then the only shuffle of the rows.  What one part must know of the parts before it
is one row per part: that table is bounded by ``spark.sql.shuffle.partitions`` and is broadcast.
Orders are rising; give a number with a minus sign for a falling one.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cartlens.session import materialise

_PART = "_part"
# Rows in the sample per cut point.
SAMPLED = 32
# Rows in a partition of a layout for a fit, and the partitions that a small one has.
LAYOUT_ROWS = 65_536
LEAST_PARTS = 8
# Values in a partition of narrow rows, and how many times those rows it may have.
LAYOUT_VALUES = 2**22
NARROW = 4


def lay_out(df, order):
    """The stored rows of ``df`` with ``_part``, which rises with ``order`` (a total order).

    The table is written once, so that a row is the same each time it is read, and so is its
    part.  The sample is a share of the rows by a hash of their place in the order.
    """
    stored = materialise(df, "ordered")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct(*[F.col(o).alias(f"k{i}") if isinstance(o, str) else o.alias(f"k{i}") for i, o in enumerate(order)])
    every = stored.count() // (parts * SAMPLED) + 1  # from the footers
    sample = stored.select(place.alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(every)) == 0)
    found = sample.agg(F.sort_array(F.collect_list("k")).alias("s"))
    cuts = found.select(
        F.expr(
            f"if(size(s) = 0 or {parts} < 2, slice(s, 1, 0), transform(sequence(1, greatest({parts} - 1, 1)),"
            f" i -> get(s, cast(i * size(s) / {parts} as int))))"
        ).alias("_cuts")
    )
    # Binary search for the number of cut points at or below the row.
    strides = F.array(*[F.lit(2**i) for i in reversed(range(parts.bit_length()))])

    def further(low, stride):
        reached = F.get("_cuts", low + stride - 1) <= F.col("_place")
        return F.when((low + stride <= F.size("_cuts")) & reached, low + stride).otherwise(low)

    return (
        stored.withColumn("_place", place)
        .crossJoin(F.broadcast(cuts))  # one row, of at most one cut point per part
        .withColumn(_PART, F.aggregate(strides, F.lit(0), further))
        .drop("_place", "_cuts")
    )


def layout_rows(width=None):
    """Rows in a partition of a layout, for rows of ``width`` values."""
    if width is None:
        return LAYOUT_ROWS
    return max(LAYOUT_ROWS, min(NARROW * LAYOUT_ROWS, LAYOUT_VALUES // max(1, width)))


def stable_layout(df, key, width=None, least=None):
    """The same rows in the same order in the same partitions, however ``df`` is stored.

    Seeded algorithms draw per partition, so a seed alone does not make them repeatable.
    ``key`` must be unique.

    The partitions follow the number of rows, up to ``spark.sql.shuffle.partitions``.  A fit runs
    hundreds of jobs over this layout, and every task of each costs the driver a few kilobytes and
    its scheduling: many partitions of few rows cost more than the rows.  With a ``width``, the
    number of values in a row, partitions of narrow rows hold more of them.  A small layout has
    ``least`` partitions; one is best where as many fits as cores run at once.  The rows are counted,
    so pass a stored frame.
    """
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(most, max(least or LEAST_PARTS, -(-df.count() // layout_rows(width))))
    return df.repartition(parts, key).sortWithinPartitions(key)


def running_sums(df, order, sums, totals=None):
    """Add running sums over a global order.

    ``sums`` maps new columns to summed (non-negative integer) columns or expressions, and
    ``totals`` maps new columns to keys of ``sums`` whose grand total is wanted.  ``order`` must be total
    (no two rows equal) for the result to be repeatable.
    """
    totals = totals or {}
    laid = lay_out(df, order)
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(_PART).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    per_part = laid.groupBy(_PART).agg(
        *[F.sum(source).alias(f"_sum_{name}") for name, source in sums.items()]
    )
    carried = per_part.select(
        _PART,
        *[
            F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}")
            for name in sums
        ],
        *[F.sum(f"_sum_{name}").over(everything).alias(new) for new, name in totals.items()],
    )
    within = (
        Window.partitionBy(_PART)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return laid.join(F.broadcast(carried), _PART).select(
        *df.columns,
        *[
            (F.sum(source).over(within) + F.col(f"_before_{name}")).alias(name)
            for name, source in sums.items()
        ],
        *totals,
    )


def previous_value(df, keys, order, value, name):
    """Add the ``value`` of the preceding row with the same ``keys`` as column ``name``.

    Equals ``lag(value) over (partition by keys order by order)``, but one key may hold any
    share of the rows: a key that spans partitions gets its first value of each partition
    from the last row of the partition before.
    """
    laid = lay_out(df, [*keys, *order])
    last = F.max(F.struct(*keys, *order, F.col(value).alias("_value")))
    tails = laid.groupBy(_PART).agg(last.alias("_tail"))
    carried = tails.select(
        _PART, F.lag("_tail").over(Window.orderBy(_PART)).alias("_carried")
    )
    within = Window.partitionBy(_PART, *keys).orderBy(*order)
    same_key = F.lit(True)
    for key in keys:
        same_key = same_key & F.col(f"_carried.{key}").eqNullSafe(F.col(key))
    from_before = F.when(
        (F.row_number().over(within) == 1) & same_key, F.col("_carried._value")
    )
    return laid.join(F.broadcast(carried), _PART).select(
        *df.columns,
        F.coalesce(F.lag(value).over(within), from_before).alias(name),
    )


# Ranks of the sketch that brackets a quantile; a bracket reaches MARGIN of them to both sides.
ACCURACY = 10_000
MARGIN = 10


def exact_quantiles(df, columns, probabilities):
    """Exact, linearly interpolated quantiles of several columns: ``feature, q0..qk``.

    The built-in ``percentile`` keeps all distinct values of a group in one buffer.  Here a
    bounded sketch brackets each quantile, one pass counts what lies below the bracket, and only
    the values inside, about one row in five hundred, are put in order.
    """
    stored = materialise(
        df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "quantile-columns"
    )
    around = [
        min(1.0, max(0.0, p + side * MARGIN / ACCURACY)) for p in probabilities for side in (-1, 1)
    ]
    sketched = stored.agg(
        *[F.percentile_approx(c, around, ACCURACY).alias(f"e{i}") for i, c in enumerate(columns)],
        *[F.struct(F.min(c), F.max(c)).alias(f"m{i}") for i, c in enumerate(columns)],
    )
    edges = sketched.select(F.struct(*sketched.columns).alias("e")).scalar()

    def bracket(i, k):
        low, high = (edges.getField(f"e{i}")[2 * k + side] for side in (0, 1))
        # At the ends the sketch may miss the outermost value.
        low = edges.getField(f"m{i}")["col1"] if around[2 * k] == 0 else low
        return low, edges.getField(f"m{i}")["col2"] if around[2 * k + 1] == 1 else high

    pairs = [(i, k) for i in range(len(columns)) for k in range(len(probabilities))]
    counted = stored.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.count_if(F.col(columns[i]) < bracket(i, k)[0]).alias(f"b{i}_{k}") for i, k in pairs],
        # The neighbours outside: in a short column the bracket may be one value too narrow.
        *[
            F.max(F.when(F.col(columns[i]) < bracket(i, k)[0], F.col(columns[i]))).alias(f"u{i}_{k}")
            for i, k in pairs
        ],
        *[
            F.min(F.when(F.col(columns[i]) > bracket(i, k)[1], F.col(columns[i]))).alias(f"a{i}_{k}")
            for i, k in pairs
        ],
    )
    counts = counted.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("i"), F.lit(k).alias("k"),
                        F.col(f"n{i}").alias("total"), F.col(f"b{i}_{k}").alias("below"),
                        F.col(f"u{i}_{k}").alias("under"), F.col(f"a{i}_{k}").alias("above"),
                    )
                    for i, k in pairs
                ]
            )
        )
    )
    inside = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(columns[i]).between(*bracket(i, k)),
                    F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.col(columns[i]).alias("value")),
                )
                for i, k in pairs
            ]
        )
    )
    values = stored.select(F.inline(inside)).groupBy("i", "k", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    ranked = running_sums(values, [F.col("i"), F.col("k"), F.col("value")], {"upto": "n"})
    starts = ranked.groupBy("i", "k").agg(F.min(F.col("upto") - F.col("n")).alias("start"))
    placed = ranked.join(F.broadcast(starts), ["i", "k"]).join(F.broadcast(counts), ["i", "k"])
    share = F.element_at(F.array(*[F.lit(float(p)) for p in probabilities]), F.col("k") + 1)
    position = share * (F.col("total") - 1)
    rank = F.col("below") + F.col("upto") - F.col("start")


    def value_at(index):
        inside = F.min(F.when(rank > index, F.col("value")))
        return F.when(F.max("below") > F.max(index), F.max("under")).otherwise(
            F.coalesce(inside, F.max("above"))
        )

    found = placed.groupBy("i", "k").agg(
        value_at(F.floor(position)).alias("lo"),
        value_at(F.ceil(position)).alias("hi"),
        F.max(position - F.floor(position)).alias("part"),
    )
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1)
    return found.groupBy(name.alias("feature")).agg(
        *[
            F.max(F.when(F.col("k") == k, at)).alias(f"q{k}") for k in range(len(probabilities))
        ]
    )
