"""Cancelled-flight models: features, training, tuning, scoring and explanation."""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators.ranking import ranked
from wayfare.operators.sampling import minority_factor, split_rows, with_folds
from wayfare.operators.skew import GROUP_ROWS
from wayfare.operators.totals import running_total
from wayfare.plans.flights import preprocess
from wayfare.session import cut_lineage
from wayfare.sources.files import read_csv_permissive

# The feature columns.
CATEGORICAL = ["ORIGIN", "DEST", "DayOfWeek", "Month"]
NUMERIC = ["DISTANCE", "CRSDepTime", "CRSArrTime", "CRSElapsedTime"]

INTERCEPT = "(intercept)"

# The columns of scored files.
SCORED_COLUMNS = ["FL_DATE", "UniqueCarrier", "FlightNum", "ORIGIN", "DEST", "prediction"]


def feature_stages(categorical=CATEGORICAL, numeric=NUMERIC) -> list:
    """Index and encode all categories at once and assemble them with the numbers.

    Unseen categories get a place of their own; rows with a missing number are skipped.
    """
    indexed = [f"{c}_indexed" for c in categorical]
    encoded = [f"{c}_encoded" for c in categorical]
    return [
        StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=encoded),
        VectorAssembler(
            inputCols=encoded + list(numeric), outputCol="features", handleInvalid="skip"
        ),
    ]


# Model settings and tuning grids.
def classifiers() -> dict:
    return {
        "LogisticRegression": LogisticRegression(maxIter=100),
        "DecisionTree": DecisionTreeClassifier(maxDepth=10),
        "RandomForest": RandomForestClassifier(numTrees=50, maxDepth=10, seed=42),
        "GBT": GBTClassifier(maxIter=50, maxDepth=5, seed=42),
    }


def elastic_classifiers() -> dict:
    """The same with an elastic-net logistic regression."""
    return classifiers() | {
        "LogisticRegression": LogisticRegression(maxIter=100, elasticNetParam=0.8)
    }


GRIDS = {
    "LogisticRegression": {"regParam": [0.01, 0.1, 1.0]},
    "DecisionTree": {"maxDepth": [5, 10, 15]},
    "RandomForest": {"numTrees": [20, 50, 75]},
    "GBT": {"maxIter": [20, 50]},
}
WIDE_GRIDS = {
    "LogisticRegression": {"regParam": [0.01, 0.1, 1.0]},
    "DecisionTree": {"maxDepth": [5, 10, 15], "minInstancesPerNode": [1, 5, 10]},
    "RandomForest": {"numTrees": [20, 50, 100], "maxDepth": [5, 10, 15]},
    "GBT": {"maxIter": [20, 50], "maxDepth": [3, 5, 7]},
}


def param_grid(estimator, grid: dict[str, list]):
    """Parameter maps bound to this estimator, so that tuning really varies them."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    return builder.build()


WEIGHT = "weight"
RATIO = 0.4


class ClassBalancer(Estimator):
    """Learns how much a row of class 1 weighs, so that together they weigh `ratio` times class 0.

    As a stage in front of a classifier it balances whatever rows that classifier is fitted on, in
    tuning those of the other folds. Rows are weighted, never repeated.
    """

    def __init__(self, ratio: float = RATIO):
        super().__init__()
        self.ratio = ratio

    def _fit(self, dataset: DataFrame) -> BalancedClasses:
        return BalancedClasses(minority_factor(dataset, self.ratio))


class BalancedClasses(Model):
    """Adds the weights of `ClassBalancer`."""

    def __init__(self, factor: float = 1.0):
        super().__init__()
        self.factor = factor

    def _transform(self, dataset: DataFrame) -> DataFrame:
        heavy = F.when(F.col("label") == 1, F.lit(self.factor)).otherwise(F.lit(1.0))
        return dataset.withColumn(WEIGHT, heavy)


def training_sets(df: DataFrame, fraction: float = 0.7, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test), each flight in one of them; equal flights are in the same.

    Training reads its rows many times, so the few columns it needs are written once.
    """
    rows = cut_lineage(df.select(*CATEGORICAL, *NUMERIC, "label").hint("rebalance"))
    return split_rows(rows, fraction, seed)


# Vectors in a task of training: a tree's points, with a place for every feature, some 300 MB.
TASK_ROWS = 500_000


def in_parts(rows: DataFrame, limit: int = TASK_ROWS) -> DataFrame:
    """The rows in parts of about `limit` at most.

    Files of few columns compress well, and their splits follow their bytes. The vectors made of a
    split are many times wider, so that their number has to bound a task. Of the splits of one row
    group all but one are empty, so the largest part is looked at and not the mean.
    """
    sizes = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    total, largest = sizes.agg(F.sum("n"), F.max("n")).first()
    if (largest or 0) <= limit:
        return rows
    return rows.repartition(max(math.ceil(total / limit), rows.rdd.getNumPartitions()))


def _balanced(estimator, ratio: float) -> Pipeline:
    return Pipeline(stages=[ClassBalancer(ratio), estimator.copy({estimator.weightCol: WEIGHT})])


def fit_all(train: DataFrame, estimators: dict, ratio: float = RATIO) -> dict[str, PipelineModel]:
    """Features and model in one fitted object per name, so that scoring needs nothing else.

    All models learn from one set of vectors, which is kept on disk while they do: a fit reads it a few
    times and its own form of the rows at every step, so memory is left to the latter. Cancelled flights
    weigh `ratio` times the others.
    """
    features = Pipeline(stages=feature_stages()).fit(train)
    vectors = features.transform(in_parts(train)).select("features", "label").persist(StorageLevel.DISK_ONLY)
    fitted = {
        name: PipelineModel(stages=[*features.stages, _balanced(estimator, ratio).fit(vectors).stages[-1]])
        for name, estimator in estimators.items()
    }
    vectors.unpersist()
    return fitted


def fit(train: DataFrame, estimator, ratio: float = RATIO) -> PipelineModel:
    return fit_all(train, {"model": estimator}, ratio)["model"]


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The boosted model after its first n iterations, which is what a training of n makes."""
    java, context = model._java_obj, SparkSession.active().sparkContext
    ml, gateway = context._jvm.org.apache.spark.ml, context._gateway
    trees = gateway.new_array(ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    all_trees, all_weights = java.trees(), java.treeWeights()
    for i in range(n):
        trees[i], weights[i] = all_trees[i], all_weights[i]
    cut = ml.classification.GBTClassificationModel(java.uid(), trees, weights)
    return GBTClassificationModel(java.copyValues(cut, java.extractParamMap()))


def first_levels(model: DecisionTreeClassificationModel, depth: int) -> DecisionTreeClassificationModel:
    """The tree down to a depth, which is what a training of that depth makes.

    A split depends on the rows of its node alone. As after a training, a leaf stands for leaves below one
    node that all predict the same.
    """
    java, ml = model._java_obj, SparkSession.active().sparkContext._jvm.org.apache.spark.ml

    def leaf(node):
        stats = node.impurityStats()
        return ml.tree.LeafNode(node.prediction(), stats.calculate(), stats)

    def cut(node, levels: int):
        """The node, and what it predicts if it is a leaf."""
        if node.numDescendants() == 0 and levels:
            return node, node.prediction()
        if not levels:
            return leaf(node), node.prediction()
        (left, guess), (right, other) = cut(node.leftChild(), levels - 1), cut(node.rightChild(), levels - 1)
        if guess is not None and guess == other:
            return leaf(node), guess
        return ml.tree.InternalNode(node.prediction(), node.impurity(), node.gain(), left, right, node.split(),
                                    node.impurityStats()), None

    root, _ = cut(java.rootNode(), depth)
    tree = ml.classification.DecisionTreeClassificationModel(java.uid(), root, java.numFeatures(), java.numClasses())
    values = java.extractParamMap().put(java.maxDepth(), depth)
    return model._copyValues(DecisionTreeClassificationModel(java.copyValues(tree, values)), {model.maxDepth: depth})


# Of these the largest value of a parameter makes the models of the smaller ones, too.
_SHARED = {GBTClassifier: ("maxIter", first_trees), DecisionTreeClassifier: ("maxDepth", first_levels)}


def _fitted_points(train: DataFrame, weighted: Pipeline, points: list[dict]):
    """(number, model) of every point of a grid; boosted points that differ in iterations share a training,
    trees that differ in depth likewise."""
    estimator = weighted.getStages()[-1]
    if type(estimator) not in _SHARED:
        for j, point in enumerate(points):
            yield j, weighted.fit(train, point).stages[-1]
        return
    name, first = _SHARED[type(estimator)]
    size, groups = estimator.getParam(name), {}
    for j, point in enumerate(points):
        others = frozenset((p.name, v) for p, v in point.items() if p != size)
        groups.setdefault(others, []).append((point.get(size, estimator.getOrDefault(size)), j, point))
    for group in groups.values():
        most, _, longest = max(group, key=lambda g: g[0])
        model = weighted.fit(train, longest).stages[-1]
        for n, j, _ in group:
            yield j, model if n == most else first(model, n)


def folds_at_once(train: DataFrame, folds: int = 3, limit: int = TASK_ROWS) -> int:
    """As many folds as can be fitted together with at most one full part of their rows per core."""
    slots = train.sparkSession.sparkContext.defaultParallelism
    return max(1, min(folds, slots * limit * folds // max(1, train.count() * (folds - 1))))


def tune(train: DataFrame, estimator, grid: dict[str, list], folds: int = 3,
         seed: int = 42, ratio: float = RATIO, at_once: int = 1) -> tuple[PipelineModel, list[float]]:
    """The best model of a grid by area under ROC, and the mean area of every grid point.

    Folds are chosen by row content, so no flight is learnt from in one fold and asked for in another.
    Every fit balances the rows it sees; the area counts each row once. The vectors are kept once for
    all folds. Of `at_once` folds a model is fitted at a time, as each keeps its own form of the rows. A fit
    reads the vectors a few times and its own form once per level, so memory is left to the latter.
    """
    features = Pipeline(stages=feature_stages()).fit(train)
    folded = features.transform(with_folds(in_parts(train), folds, seed)).select("features", "label", "fold")
    weighted = _balanced(estimator, ratio)
    points = param_grid(weighted.getStages()[-1], grid)
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="probability", metricName="areaUnderROC")
    vectors = folded.persist(StorageLevel.DISK_ONLY)
    found = [[0.0] * folds for _ in points]

    def ask(i: int) -> None:
        others, asked = vectors.filter(F.col("fold") != i), vectors.filter(F.col("fold") == i)
        for j, model in _fitted_points(others, weighted, points):
            found[j][i] = evaluator.evaluate(model.transform(asked))

    with ThreadPool(at_once) as pool:
        pool.map(inheritable_thread_target(train.sparkSession)(ask), range(folds), 1)
    areas = [sum(of_point) / folds for of_point in found]
    best = weighted.fit(vectors, points[areas.index(max(areas))])
    vectors.unpersist()
    return PipelineModel(stages=[*features.stages, best.stages[-1]]), areas


def tuned_models(train: DataFrame, test: DataFrame, estimators: dict, grids: dict[str, dict[str, list]],
                 folds: int = 3) -> dict[str, dict[str, float]]:
    """Per model the metrics on the test part of the best model of its grid, and its `cv_area`."""
    found = {}
    for name, estimator in estimators.items():
        best, areas = tune(train, estimator, grids[name], folds, at_once=folds_at_once(train, folds))
        found[name] = metrics(best.transform(test)) | {"cv_area": max(areas)}
    return found


def metrics(predictions: DataFrame) -> dict[str, float]:
    """Accuracy, weighted precision and recall, F1, and area under ROC of the probability.

    The raw scores of a decision tree are counts in its leaves and do not rank rows.

    All but the area follow from the few counts of (label, prediction).
    """
    counts = {(int(r["label"]), int(r["prediction"])): r["n"] for r in confusion(predictions).collect()}
    total = sum(counts.values())
    found = {"accuracy": 0.0, "precision": 0.0, "recall": 0.0, "f1": 0.0}
    for c in {label for label, _ in counts}:
        hit = counts.get((c, c), 0)
        guessed = sum(n for (_, p), n in counts.items() if p == c)
        support = sum(n for (label, _), n in counts.items() if label == c)
        share = support / total
        found["accuracy"] += hit / total
        found["precision"] += share * (hit / guessed if guessed else 0.0)
        found["recall"] += share * hit / support
        found["f1"] += share * 2 * hit / (guessed + support)
    area = BinaryClassificationEvaluator(
        labelCol="label", rawPredictionCol="probability", metricName="areaUnderROC"
    )
    return found | {"auc_roc": area.evaluate(predictions)}


def comparison_table(spark: SparkSession, results: dict[str, dict[str, float]]) -> DataFrame:
    """(model, accuracy, precision, recall, f1, auc_roc), one row per model."""
    names = ["accuracy", "precision", "recall", "f1", "auc_roc"]
    rows = [(model, *[float(found[n]) for n in names]) for model, found in results.items()]
    return spark.createDataFrame(rows, "model string, " + ", ".join(f"{n} double" for n in names))


# -- reports from a table of predictions --------------------------------------------------


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def class_report(predictions: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) per class 0 and 1, in one pass."""
    label, guess = F.col("label"), F.col("prediction")
    counts = predictions.agg(
        *[F.count_if((label == c) & (guess == c)).alias(f"hit{c}") for c in (0, 1)],
        *[F.count_if(guess == c).alias(f"guessed{c}") for c in (0, 1)],
        *[F.count_if(label == c).alias(f"support{c}") for c in (0, 1)],
    )
    rows = [
        F.struct(
            F.lit(c).alias("class"),
            F.coalesce(F.try_divide(F.col(f"hit{c}"), F.col(f"guessed{c}")), F.lit(0.0)).alias(
                "precision"
            ),
            F.coalesce(F.try_divide(F.col(f"hit{c}"), F.col(f"support{c}")), F.lit(0.0)).alias(
                "recall"
            ),
            F.coalesce(
                F.try_divide(
                    F.col(f"hit{c}") * 2.0, F.col(f"guessed{c}") + F.col(f"support{c}")
                ),
                F.lit(0.0),
            ).alias("f1"),
            F.col(f"support{c}").alias("support"),
        )
        for c in (0, 1)
    ]
    return counts.select(F.inline(F.array(*rows)))


def roc_area(predictions: DataFrame, score: str, limit: int = GROUP_ROWS) -> DataFrame:
    """Exact area under the ROC curve of a numeric score, as one row `auc`.

    Equal scores are counted first; running counts over the distinct scores are sliced
    when there are very many.
    """
    counted = predictions.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    placed = running_total(counted, [], "score", "neg", "below", "all_neg", limit)
    # twice the area times pairs, in whole numbers: a tie counts half a win
    won = F.sum(F.col("pos") * (2 * F.col("below") + F.col("neg")))
    return placed.agg(
        F.try_divide(won.cast("double"), (2 * F.sum("pos") * F.sum("neg")).cast("double")).alias(
            "auc"
        )
    )


# -- storing and scoring ------------------------------------------------------------------


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


_MODEL_TYPES = {
    "LogisticRegression": LogisticRegressionModel,
    "DecisionTree": DecisionTreeClassificationModel,
    "RandomForest": RandomForestClassificationModel,
    "GBT": GBTClassificationModel,
}


def load_classifier(path: str, model_type: str):
    """A bare classifier by its type name."""
    if model_type not in _MODEL_TYPES:
        raise ValueError(f"unknown model type {model_type!r}")
    return _MODEL_TYPES[model_type].load(path)


def predict(flights: DataFrame, model: PipelineModel) -> DataFrame:
    """Predictions for raw flight rows."""
    return model.transform(preprocess(flights))


def score(flights: DataFrame, model: PipelineModel, path: str) -> DataFrame:
    """Write predictions and return the written table.

    `probability` becomes a plain array, which any reader understands.
    """
    from pyspark.ml.functions import vector_to_array

    scored = predict(flights, model).select(
        *SCORED_COLUMNS, vector_to_array("probability").alias("probability")
    )
    scored.write.mode("overwrite").parquet(path)
    return flights.sparkSession.read.parquet(path)


def score_file(spark: SparkSession, data_path: str, model_path: str, out: str) -> DataFrame:
    """Score a flight CSV with a saved model."""
    from wayfare.schemas import FLIGHT

    rows = read_csv_permissive(spark, data_path, FLIGHT).drop("_corrupt_record")
    return score(rows, load_model(model_path), out)


# -- explanation --------------------------------------------------------------------------


def feature_names(transformed: DataFrame, column: str = "features") -> list[str]:
    """Names of the vector's places, in vector order."""
    attributes = transformed.schema[column].metadata["ml_attr"]["attrs"]
    found = [a for group in attributes.values() for a in group]
    return [a["name"] for a in sorted(found, key=lambda a: a["idx"])]


def importances(spark: SparkSession, name: str, classifier, names: list[str]) -> DataFrame:
    """(model, feature, value, strength, kind): importances, or coefficients and the intercept."""
    linear = isinstance(classifier, LogisticRegressionModel)
    values = (classifier.coefficients if linear else classifier.featureImportances).toArray()
    kind = "coefficient" if linear else "importance"
    rows = [(name, f, float(v), abs(float(v)), kind) for f, v in zip(names, values)]
    if linear:
        constant = float(classifier.intercept)
        rows.append((name, INTERCEPT, constant, abs(constant), "intercept"))
    return spark.createDataFrame(
        rows, "model string, feature string, value double, strength double, kind string"
    )


def top_features(table: DataFrame, k: int = 10) -> DataFrame:
    """The k strongest features of every model, with their rank. The intercept is no feature."""
    return ranked(table.filter(F.col("feature") != INTERCEPT), ["model"], [F.desc("strength"), F.asc("feature")], k)


def feature_ranking(top: DataFrame, models: list[str], absent: int = 99) -> DataFrame:
    """One row per feature: its rank in every model (99 if not among the first) and the mean."""
    wide = (
        top.groupBy("feature").pivot("model", models).agg(F.min("rank")).fillna(absent, models)
    )
    total = sum((F.col(m) for m in models), F.lit(0))
    return wide.withColumn("avg_rank", total / len(models)).orderBy("avg_rank", "feature")


def feature_summary(top: DataFrame, models: list[str]) -> DataFrame:
    """One row per rank: feature and value of every model."""
    return (
        top.groupBy("rank")
        .pivot("model", models)
        .agg(F.first("feature").alias("feature"), F.first("value").alias("value"))
        .orderBy("rank")
    )


def shared_features(top: DataFrame, least: int = 2) -> DataFrame:
    """Features among the first of at least `least` models."""
    return (
        top.groupBy("feature")
        .agg(F.count_distinct("model").alias("models"))
        .filter(F.col("models") >= least)
        .orderBy(F.desc("models"), "feature")
    )
