"""Repeatable samples, splits and folds.

The order is a hash of the row key and a seed, so the same rows fall in the same part on any
number of partitions, and each class is cut by exact counts.  No rows are sorted to find a cut:
counts per prefix of the hash say in which prefix a rank lies, a longer prefix narrows that
down, and only the few keys next to a cut are put in order.
"""

from collections import Counter, defaultdict

from pyspark.sql import Window
from pyspark.sql import functions as F

from cartlens.functions.expressions import stable_hash
from cartlens.session import materialise

HASH_BITS = 60
# Each pass narrows the hashes down by this many bits, so it gives at most 2^12 counts per class.
PREFIX_BITS = 12
# A cut is looked up among this many rows, or in fewer if one key has more than that.
FEW_ROWS = 100_000
# Folds are numbered inside 2^16 ranges of the hash.
FOLD_BITS = 16


def _order(key, seed):
    return F.coalesce(stable_hash(key, seed), F.lit(-1))


def _prefix(shift):
    return F.shiftright("_order", shift).alias("_prefix")


def _narrowed(counts, state):
    """The next ``state`` and the largest count in it.

    ``counts`` are rows of class, parent prefix, prefix and number of rows; ``state`` maps
    (class, cut) to the prefix it lies in and its rank there.
    """
    inside = defaultdict(list)
    for label, parent, prefix, n in counts:
        inside[label, parent].append((prefix, n))
    found, largest = {}, 0
    for (label, cut), (parent, rank) in state.items():
        for prefix, n in sorted(inside[label, parent]):
            if rank < n:
                found[label, cut] = (prefix, rank)
                largest = max(largest, n)
                break
            rank -= n
    return found, largest


def cut_places(df, target, key, seed, choose):
    """One row per class, with its places in the order of key hashes: ``_class`` and a struct per cut.

    ``choose(size)`` maps names of cuts to 0-based ranks in a class of that many rows.  A rank
    beyond the class has no place, and a class without any has no row.  Null classes are left
    out.  Classes are few: their counts per prefix, 4,096 each, pass through the driver.
    """
    keys = df.select(
        target.alias("_class"), _order(key, seed).alias("_order"), F.col(key).alias("_key")
    )
    keys = materialise(keys.where("_class is not null"), "keys")
    label = keys.schema["_class"].dataType.simpleString()
    shift = HASH_BITS - PREFIX_BITS
    counts = [
        (r["_class"], None, r["_prefix"], r["count"])
        for r in keys.groupBy("_class", _prefix(shift)).count().collect()
    ]
    sizes = Counter()
    for value, _, _, n in counts:
        sizes[value] += n
    chosen = {value: choose(size) for value, size in sizes.items()}
    state = {
        (value, cut): (None, rank)
        for value, cuts in chosen.items()
        for cut, rank in cuts.items()
        if 0 <= rank < sizes[value]
    }

    def near():
        """The keys in the prefixes of the state, and the state as a table."""
        wanted = keys.sparkSession.createDataFrame(
            [(value, cut, prefix, rank) for (value, cut), (prefix, rank) in state.items()],
            f"_class {label}, _cut string, _prefix bigint, _rank bigint",
        )
        some = F.broadcast(wanted.select("_class", "_prefix").distinct())
        return keys.withColumn("_prefix", _prefix(shift)).join(some, ["_class", "_prefix"]), wanted

    state, largest = _narrowed(counts, state)
    while largest > FEW_ROWS and shift:
        rows, _ = near()
        shift -= PREFIX_BITS
        finer = rows.groupBy("_class", F.col("_prefix").alias("_parent"), _prefix(shift)).count()
        state, largest = _narrowed(
            [(r["_class"], r["_parent"], r["_prefix"], r["count"]) for r in finer.collect()], state
        )
    rows, wanted = near()
    by_place = Window.partitionBy("_class", "_prefix").orderBy("_order", "_key")
    placed = (
        rows.groupBy("_class", "_prefix", "_order", "_key")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(by_place))
        .join(F.broadcast(wanted), ["_class", "_prefix"])
        .where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
    )
    place = F.struct(F.col("_order").alias("o"), F.col("_key").alias("k"))
    names = sorted(choose(0))
    return placed.groupBy("_class").agg(
        *[F.max(F.when(F.col("_cut") == name, place)).alias(f"_{name}") for name in names]
    )


def _own_place(key, seed):
    return F.struct(_order(key, seed).alias("o"), F.col(key).alias("k"))


def hash_sample(df, n, key="row_id", seed=42):
    """``n`` rows, chosen by the smallest key hashes; the rows stay where they are."""
    cuts = cut_places(df, F.lit(0), key, seed, lambda size: {"last": min(n, size) - 1})
    return (
        df.join(F.broadcast(cuts.select("_last")), F.lit(True))
        .where(_own_place(key, seed) <= F.col("_last"))
        .select(*df.columns)
    )


def _half_up(x):
    return int(x + 0.5)


def stratified_split(df, test=0.2, validation=0.25, target="target", key="row_id", seed=42):
    """Add ``split``: ``test`` of each class, then ``validation`` of what is left, then train.

    Counts per class are rounded half up.  The rows stay where they are and are compared with
    the places in the order where their class is cut.
    """

    def choose(size):
        n_test = _half_up(size * test)
        return {"test": n_test, "validation": n_test + _half_up((size - n_test) * validation)}

    cuts = cut_places(df, F.col(target), key, seed, choose).withColumnRenamed("_class", target)
    own = _own_place(key, seed)

    def before(cut):
        return F.col(cut).isNull() | (own < F.col(cut))

    return df.join(F.broadcast(cuts), target, "left").select(
        *df.columns,
        F.when(before("_test"), "test")
        .when(before("_validation"), "validation")
        .otherwise("train")
        .alias("split"),
    )


def stratified_folds(df, k=5, target="target", key="row_id", seed=42):
    """Add ``fold`` 0..k-1: sizes differ by one row at most within a class.

    Rows are numbered inside short ranges of the hash, after the counts of the ranges before,
    so one shuffle of rows does it.  Rows without a class have no fold and are left out.
    """
    part = F.shiftright(_order(key, seed), HASH_BITS - FOLD_BITS)
    sizes = df.groupBy(target, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    up_to = Window.partitionBy(target).orderBy("_part")
    # At most 2^16 rows of three numbers per class.
    offsets = sizes.select(target, "_part", (F.sum("_n").over(up_to) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy(target, "_part").orderBy(_order(key, seed), key)
    numbered = df.withColumn("_part", part).withColumn("_number", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(offsets), [target, "_part"]).select(
        *df.columns, ((F.col("_before") + F.col("_number")) % k).cast("int").alias("fold")
    )
