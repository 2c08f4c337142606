"""Per-row attributions of boosted trees: path-dependent Shapley values.

Every leaf is a product of one yes/no test per feature on its path.  The Shapley value of
such a product has a closed form: with ``o`` the test result of a row and ``z`` the share of
training rows that pass, feature j gets (o_j - z_j) times a weighted sum over the subsets of
the other path features, which is a polynomial of the path length.  Trees are small and are
broadcast; rows stream through in Arrow batches.  A path of d features has 2^d patterns of test
results, so its terms are worked out for the patterns and looked up by the rows.
"""

import sys
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cartlens.functions.expressions import hash_share
from cartlens.functions.ordered import exact_quantiles
from cartlens.plans.training import feature_names
from cartlens.session import materialise

# Executors need not have this package installed: the functions of this module travel along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SCHEMA = "row_id bigint, base double, contributions array<double>, `values` array<double>"
_NAMES = ["row_id", "base", "contributions", "values"]
# Test results of a batch that are kept for the next paths; the paths of a tree share theirs.
KEPT_TESTS = 256


def _leaves(node, path):
    if node.getClass().getSimpleName() == "LeafNode":
        yield node.prediction(), path
        return
    split = node.split()
    total = node.impurityStats().count()
    if split.getClass().getSimpleName() == "ContinuousSplit":
        rule = ("at_most", split.threshold())
    else:
        rule = ("one_of", tuple(split.leftCategories()))
    for child, is_left in ((node.leftChild(), True), (node.rightChild(), False)):
        share = child.impurityStats().count() / total
        yield from _leaves(child, [*path, (split.featureIndex(), rule, is_left, share)])


def tree_paths(model):
    """``[(leaf value, {feature: (share, [(rule, is_left)])})]`` over all trees.

    Leaf values are in log-odds: twice the tree output, times the tree weight.
    """
    found = []
    for tree, weight in zip(model.trees, model.treeWeights):
        for value, steps in _leaves(tree._java_obj.rootNode(), []):
            tests = {}
            for feature, rule, is_left, share in steps:
                before, rules = tests.get(feature, (1.0, []))
                tests[feature] = (before * share, [*rules, (rule, is_left)])
            found.append((2.0 * weight * value, tests))
    return found


def _is_left(column, rule):
    kind, bound = rule
    return column <= bound if kind == "at_most" else np.isin(column, bound)


def _passes(column, rules):
    result = np.ones(len(column), dtype=bool)
    for rule, is_left in rules:
        left = _is_left(column, rule)
        result &= left if is_left else ~left
    return result.astype(float)


def _subset_weights(ones, shares):
    """Sum over subsets S of the given features of |S|!(d-|S|)!/(d+1)! prod(S: o) prod(not S: z)."""
    sums = [np.ones(len(ones[0]))] if ones else None
    for o, z in zip(ones, shares):
        grown = [s * z for s in sums] + [0.0]
        for size, s in enumerate(sums):
            grown[size + 1] = grown[size + 1] + s * o
        sums = grown
    if sums is None:
        return 1.0
    d = len(ones)
    return sum(
        s * (factorial(size) * factorial(d - size) / factorial(d + 1))
        for size, s in enumerate(sums)
    )


def _terms(value, shares, ones):
    """What a path adds to each of its features, for arrays of test results."""
    for j, share in enumerate(shares):
        others = _subset_weights(ones[:j] + ones[j + 1 :], shares[:j] + shares[j + 1 :])
        yield value * (ones[j] - share) * others


def _contributions(x, paths):
    """The base and the contributions, one row per row of ``x``."""
    columns = np.ascontiguousarray(x.T)
    phi = np.zeros_like(columns)
    base = 0.0
    kept = {}

    def passes(feature, rules):
        result = np.ones(len(x), dtype=bool)
        for rule, is_left in rules:
            if (feature, rule) not in kept:
                if len(kept) >= KEPT_TESTS:
                    kept.clear()
                kept[feature, rule] = _is_left(columns[feature], rule)
            left = kept[feature, rule]
            result &= left if is_left else ~left
        return result

    for value, tests in paths:
        features = list(tests)
        shares = [tests[f][0] for f in features]
        base += value * float(np.prod(shares))
        passed = [passes(f, tests[f][1]) for f in features]
        patterns = 2 ** len(features)
        if patterns > len(x):  # a long path and few rows
            for f, term in zip(features, _terms(value, shares, [p.astype(float) for p in passed])):
                phi[f] += term
            continue
        place = np.zeros(len(x), dtype=np.intp)
        for j, p in enumerate(passed):
            place += p.astype(np.intp) << j
        ones = [(np.arange(patterns) >> j & 1).astype(float) for j in range(len(features))]
        for f, term in zip(features, _terms(value, shares, ones)):
            phi[f] += term[place]
    return base, phi.T


def attributions(model, frame):
    """``row_id, base, contributions, values``: base + sum(contributions) is the log-odds.

    ``model`` is the trained pipeline; positions follow ``attribution_names``.
    """
    paths = frame.sparkSession.sparkContext.broadcast(tree_paths(model.stages[-1]))

    def explain(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                base, phi = _contributions(x, paths.value)
                starts = pa.array(np.arange(0, phi.size + 1, phi.shape[1], dtype=np.int32))
                lists = pa.ListArray.from_arrays(starts, pa.array(phi.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(n, base)), lists, batch.column(1)], names=_NAMES
                )

    vectors = model.transform(frame).select("row_id", vector_to_array("features").alias("x"))
    return vectors.mapInArrow(explain, _SCHEMA)


def attribution_names(model, frame):
    return feature_names(model.transform(frame.limit(0)))


def tall_attributions(explained, names):
    """``row_id, feature, value, contribution``."""
    cells = F.arrays_zip(
        F.array(*[F.lit(n) for n in names]).alias("feature"),
        F.col("values").alias("value"),
        F.col("contributions").alias("contribution"),
    )
    return explained.select("row_id", F.inline(cells)).toDF(
        "row_id", "feature", "value", "contribution"
    )


def global_importance(explained, names, k=None):
    """Mean absolute contribution per feature, largest first."""
    wide = explained.agg(
        *[F.avg(F.abs(F.col("contributions")[i])).alias(f"m{i}") for i in range(len(names))]
    )
    rows = [
        F.struct(F.lit(n).alias("feature"), F.col(f"m{i}").alias("importance"))
        for i, n in enumerate(names)
    ]
    table = wide.select(F.inline(F.array(*rows))).orderBy(F.desc("importance"), "feature")
    return table if k is None else table.limit(k)


def beeswarm(explained, names, share=None, seed=42):
    """Value and contribution of every feature, for every row or a repeatable ``share`` of them."""
    rows = explained if share is None else hash_share(explained, share, "row_id", seed)
    return tall_attributions(rows, names)


def row_breakdown(explained, names, row_id):
    """Contributions of one row, the strongest first."""
    return tall_attributions(explained.where(F.col("row_id") == row_id), names).orderBy(
        F.desc(F.abs("contribution")), "feature"
    )


def contribution_quantile(explained, names, feature="price", probability=0.95):
    """Quantile of the contributions of one feature, in log-odds."""
    column = explained.select(
        F.col("contributions")[names.index(feature)].alias(feature)
    )
    return exact_quantiles(column, [feature], [probability]).select(
        "feature", F.col("q0").alias("contribution")
    )


def top_attribution_columns(explained, names, k=10):
    """One column per feature for the ``k`` most important ones, a row per row.

    The attributions are stored, as they are read for the ranking and for the result.
    """
    explained = materialise(explained, "attributions")
    top = [row["feature"] for row in global_importance(explained, names, k).collect()]
    return explained.select(
        *[F.col("contributions")[names.index(f)].alias(f) for f in top]
    )
