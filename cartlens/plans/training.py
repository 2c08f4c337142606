"""Feature pipeline, boosted trees and their parameter search."""

import json
import random
import uuid
from math import sqrt
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import (
    ElementwiseProduct,
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from cartlens.functions.ordered import stable_layout
from cartlens.operators.profiling import class_balance
from cartlens.operators.splits import stratified_folds
from cartlens.schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES, TARGET
from cartlens.session import materialise

WEIGHT = "_weight"

# The default search space, under the names of the Spark parameters, its number
# of random draws and folds, and the rounds without gain that end boosting in cross-validation.
# The 216 settings are work for a cluster; pass a grid of your own for less.
GRID = {
    "stepSize": [0.01, 0.05, 0.1],
    "maxDepth": [3, 5, 7],
    "minInstancesPerNode": [1, 3, 5],
    "subsamplingRate": [0.8, 1.0],
    "featureSubsetStrategy": ["0.8", "all"],
    "maxIter": [100, 200],
}
DRAWS = 20
SEARCH_FOLDS = 3
PATIENCE = 20
DEFAULTS = {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "seed": 42}
# Categories with a slot of their own in the feature vector, and the slots the others share.
FREQUENT = 1_000
SHARED = 256


def frequent_values(train, column, k=FREQUENT):
    """The ``k`` most frequent values of a column as text; ties go to the smaller one."""
    counted = train.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).count()
    return [r["value"] for r in counted.orderBy(F.desc("count"), "value").limit(k).collect()]


def _sql_text(value):
    """A SQL literal; its first underscore is escaped, as the stage replaces ``__THIS__``."""
    value = value.replace("\\", "\\\\").replace("'", "\\'").replace("__THIS__", "\\u005f_THIS__")
    return f"'{value}'"


def level_stage(frequent, shared=SHARED):
    """A stage that adds ``_<column>_level``: a frequent value itself, else a hash slot.

    ``frequent`` maps columns to their frequent values.  A null value stays null.
    """
    levels = []
    for column, values in frequent.items():
        text = f"CAST(`{column}` AS STRING)"
        quoted = ", ".join(_sql_text(v) for v in values)
        own = f"WHEN {text} IN ({quoted}) THEN {text} " if values else ""
        slot = f"concat('rest ', pmod(xxhash64({text}), {shared}))"
        levels.append(
            f"CASE WHEN `{column}` IS NULL THEN NULL {own}ELSE {slot} END AS `_{column}_level`"
        )
    return SQLTransformer(statement=f"SELECT *, {', '.join(levels)} FROM __THIS__")


def feature_stages(n_rows, numeric=NUMERIC_FEATURES, categorical=CATEGORICAL_FEATURES):
    """Stages that scale the numeric columns and one-hot encode the levels of the categorical ones.

    ``StandardScaler`` divides by the sample deviation; the product with sqrt(n / (n - 1))
    turns that into the population deviation.  A category not seen in training gets all
    zeros: the indexer puts it last, and the encoder drops the last one.
    """
    to_population = sqrt(n_rows / (n_rows - 1)) if n_rows > 1 else 1.0
    indexed = [f"_{c}_index" for c in categorical]
    encoded = [f"{c}_is" for c in categorical]
    return [
        VectorAssembler(inputCols=list(numeric), outputCol="_numeric"),
        StandardScaler(inputCol="_numeric", outputCol="_scaled", withMean=True, withStd=True),
        ElementwiseProduct(
            inputCol="_scaled",
            outputCol="_zscores",
            scalingVec=Vectors.dense([to_population] * len(numeric)),
        ),
        StringIndexer(
            inputCols=[f"_{c}_level" for c in categorical],
            outputCols=indexed,
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        VectorAssembler(inputCols=["_zscores", *encoded], outputCol="features"),
    ]


def feature_pipeline(train, numeric=NUMERIC_FEATURES, categorical=CATEGORICAL_FEATURES):
    """The fitted feature stages, for categorical columns of any number of values.

    The most frequent values of a column have a slot each; the others share slots by their
    hash, so the vector, which the driver describes, stays bounded.  A value not seen in
    training gets zeros, or the slot of the rare values whose hash it has.
    """
    stages = feature_stages(train.count(), numeric, categorical)
    if categorical:
        stages.insert(0, level_stage({c: frequent_values(train, c) for c in categorical}))
    return Pipeline(stages=stages).fit(train)


def feature_names(transformed, numeric=NUMERIC_FEATURES):
    """Names of the vector slots, from the column metadata."""
    attributes = transformed.schema["features"].metadata["ml_attr"]["attrs"]
    slots = sorted(
        (a["idx"], a.get("name", "")) for group in attributes.values() for a in group
    )
    numeric = list(numeric)
    return [numeric[i] if i < len(numeric) else name for i, name in slots]


def with_class_weight(train, target=TARGET):
    """Weight positives by the ratio of negatives to positives."""
    weight = class_balance(train, target).select("scale_pos_weight").scalar()
    return train.withColumn(
        WEIGHT, F.when(F.col(target) == 1, weight).otherwise(F.lit(1.0))
    )


def boosted_trees(**params):
    return GBTClassifier(
        featuresCol="features", labelCol=TARGET, weightCol=WEIGHT, **{**DEFAULTS, **params}
    )


def _vectors(prepared, rows):
    """Rows as the trees read them; a row without a weight counts once."""
    if WEIGHT not in rows.columns:
        rows = rows.withColumn(WEIGHT, F.lit(1.0))
    return prepared.transform(rows).select("row_id", "features", TARGET, WEIGHT)


def _laid_out(vectors, least=None):
    """Vectors in the layout of a fit, whose partitions follow their rows and width."""
    width = vectors.schema["features"].metadata["ml_attr"]["num_attrs"]
    return stable_layout(vectors, "row_id", width, least)


def rounds_to_keep(losses, patience):
    """Rounds up to the best loss, when boosting ends after ``patience`` rounds without gain."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def first_trees(model, kept):
    """The model of the first ``kept`` rounds of a fitted one; nothing is fitted.

    Boosting adds one tree after another, so these are the trees that fewer rounds would have
    given.  The constructor is that of the JVM class, as Python has none.
    """
    fitted = model._java_obj
    context = SparkContext.getOrCreate()
    gateway = context._gateway
    trees = gateway.new_array(context._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, kept)
    weights = gateway.new_array(context._jvm.double, kept)
    for i, (tree, weight) in enumerate(zip(model.trees[:kept], model.treeWeights[:kept])):
        trees[i], weights[i] = tree._java_obj, float(weight)
    name = f"GBTClassifier_{uuid.uuid4().hex[:12]}"
    shorter = context._jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        name, trees, weights, fitted.numFeatures(), fitted.numClasses()
    )
    return model._copyValues(GBTClassificationModel(shorter))


def fit_trees(learner, rows, held_out=None, patience=PATIENCE):
    """Boosted trees on laid out vectors; with ``held_out``, cut after ``patience`` rounds without gain.

    All rounds are fitted, the loss on ``held_out`` is taken after each of them, and the trees of
    the rounds to keep are taken from the fitted model.
    """
    model = learner.fit(rows)
    if held_out is None:
        return model
    kept = rounds_to_keep(model.evaluateEachIteration(held_out), patience)
    return model if kept == model.getNumTrees else first_trees(model, kept)


def fit_model(train, validation=None, patience=PATIENCE, **params):
    """Feature pipeline and boosted trees as one ``PipelineModel``.

    ``train`` is read several times: pass a stored frame.  With ``validation``, boosting ends
    after ``patience`` rounds in which the loss on those rows has not fallen; the feature
    pipeline still learns from ``train`` alone.
    """
    prepared = feature_pipeline(train)
    held_out = None if validation is None else _vectors(prepared, validation)
    rows = _laid_out(_vectors(prepared, with_class_weight(train)))
    model = fit_trees(boosted_trees(**params), rows, held_out, patience)
    return PipelineModel(stages=[*prepared.stages, model])


def _param_maps(estimator, grid):
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    return builder.build()


class Journal:
    """What a search has tried, in a folder that outlives its driver.

    Each finished fit is a folder of its own with one JSON row, so that fits that end together
    do not write to one place; Spark moves a row there only once it is whole.  ``run`` names the
    data and all that is fixed in a search: rows of another run are not taken for its own.
    """

    SCHEMA = "run string, setting string, fold int, auc double"

    def __init__(self, spark, path, run):
        self.spark, self.path, self.run = spark, path, run

    def known(self):
        """``{(setting, fold): auc}`` of the fits that were written before."""
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/part-*")
        system = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.globStatus(pattern):
            return {}
        rows = self.spark.read.schema(self.SCHEMA).json(f"{self.path}/*").where(F.col("run") == self.run)
        return {(r["setting"], r["fold"]): r["auc"] for r in rows.collect()}

    def add(self, setting, fold, auc):
        row = self.spark.createDataFrame([(self.run, setting, fold, auc)], self.SCHEMA)
        row.coalesce(1).write.json(f"{self.path}/fit-{uuid.uuid4().hex}")


def _fingerprint(rows):
    """Count and hash sum of the rows, whatever their order and layout."""
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("decimal(38,0)")
    return "-".join(str(v) for v in rows.agg(F.count(F.lit(1)), F.sum(hashed)).first())


def _cost(setting):
    """Longer fits are larger: a tree of one more level has twice the nodes."""
    named = {**DEFAULTS, **setting}
    return named["maxIter"] * 2 ** named["maxDepth"]


def search(
    train, grid=None, n_iter=None, folds=SEARCH_FOLDS, parallelism=8, seed=42, validation=None,
    patience=PATIENCE, journal=None, least_parts=None, **params,
):
    """Cross-validated search by ROC AUC: the whole grid, or ``n_iter`` random settings.

    Returns the best ``PipelineModel`` and the tried settings as ``[(setting, mean_auc)]``;
    the earlier setting wins ties.  Feature pipeline and class weight are fitted anew for each
    fold, on its training rows.  With ``validation`` every fit stops early on those rows.

    Every setting and fold is a fit of its own, and the longest fits start first.  ``journal``
    is a folder in shared storage: each finished fit is written there, and a search with the
    same data and parameters that is started again does only the fits that are missing.
    ``least_parts`` are the partitions that small folds have in the fits that run side by side.
    """
    folded = materialise(stratified_folds(train, folds, seed=seed), "folds")
    spark = folded.sparkSession
    trees = boosted_trees(**params)
    settings = _param_maps(trees, grid or GRID)
    if n_iter is not None and n_iter < len(settings):
        settings = random.Random(seed).sample(settings, n_iter)
    named = [{param.name: value for param, value in setting.items()} for setting in settings]
    names = [json.dumps({**params, **setting}, sort_keys=True) for setting in named]

    written, done = None, {}
    if journal is not None:
        checked = "" if validation is None else f"{_fingerprint(validation)}/{patience}"
        written = Journal(spark, journal, f"{_fingerprint(folded)}/{checked}/{folds}/{seed}")
        done = written.known()
    fits = [(i, fold) for i in range(len(settings)) for fold in range(folds) if (names[i], fold) not in done]
    fits.sort(key=lambda fit: (-_cost({**params, **named[fit[0]]}), fit))

    parts = {}
    for fold in sorted({fold for _, fold in fits}):
        rest = folded.where(F.col("fold") != fold)
        prepared = feature_pipeline(rest)
        checked = None
        if validation is not None:
            checked = materialise(_vectors(prepared, validation), "fold-validation")
        parts[fold] = (
            _laid_out(materialise(_vectors(prepared, with_class_weight(rest)), "fold-train"), least_parts),
            materialise(_vectors(prepared, folded.where(F.col("fold") == fold)), "fold-test"),
            checked,
        )
    # No bins: scores are ranked as they are, however many there are.
    evaluator = BinaryClassificationEvaluator(
        labelCol=TARGET, metricName="areaUnderROC", numBins=0
    )

    def fit(which):
        i, fold = which
        rest, test, checked = parts[fold]
        model = fit_trees(trees.copy(settings[i]), rest, checked, patience)
        auc = float(evaluator.evaluate(model.transform(test)))
        if written is not None:
            written.add(names[i], fold, auc)
        return (names[i], fold), auc

    # Driver threads that only submit jobs, as in CrossValidator, whose fold column costs a
    # Python UDF over all rows in every fold.  Each fit is wrapped on its own: threads with one copy
    # of the local properties overwrite each other's SQL execution.
    if fits:
        tasks = [(inheritable_thread_target(spark)(fit), which) for which in fits]
        with ThreadPool(min(parallelism, len(fits))) as pool:
            done |= dict(pool.map(lambda task: task[0](task[1]), tasks, chunksize=1))
    aucs = [sum(done[name, fold] for fold in range(folds)) / folds for name in names]
    chosen = {**params, **named[aucs.index(max(aucs))]}
    return fit_model(folded.drop("fold"), validation, patience, **chosen), list(zip(named, aucs))


def search_table(spark, tried):
    """One row per tried setting, best first."""
    names = sorted(tried[0][0])
    rows = [(*[str(setting[n]) for n in names], float(auc)) for setting, auc in tried]
    schema = ", ".join([*[f"{n} string" for n in names], "mean_auc double"])
    return spark.createDataFrame(rows, schema).orderBy(F.desc("mean_auc"), *names)


def with_probability(model, rows):
    """Rows with the feature vector and the probability of class 1."""
    return model.transform(rows).withColumn(
        "probability", vector_to_array("probability")[1]
    )


def scored_set(model, frame):
    """``row_id, label, probability, price, hour`` of a labelled frame."""
    return with_probability(model, frame).select(
        "row_id", F.col(TARGET).alias("label"), "probability", "price", "hour"
    )


def feature_importance(model, sample, k=None):
    """``feature, importance`` in falling order; ``sample`` is any frame the model accepts."""
    names = feature_names(model.transform(sample.limit(0)))
    importances = model.stages[-1].featureImportances.toArray().tolist()
    table = sample.sparkSession.createDataFrame(
        list(zip(names, importances)), "feature string, importance double"
    ).orderBy(F.desc("importance"), "feature")
    return table if k is None else table.limit(k)
