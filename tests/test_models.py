import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from helpers import rows_of
from wayfare.operators.sampling import class_weights, oversample, split_rows, with_folds
from wayfare.plans import classify as plans
from wayfare.plans.flights import preprocess
from wayfare.session import cut_lineage, scratch_path
from wayfare.sources import derived, files


@pytest.fixture(scope="module")
def flights(spark, tiny):
    return derived.flights(spark, tiny)


@pytest.fixture(scope="module")
def sets(flights):
    train, test = plans.training_sets(preprocess(flights))
    return train, cut_lineage(test)


@pytest.fixture(scope="module")
def tree(sets):
    return plans.fit(sets[0], plans.classifiers()["DecisionTree"])


def test_split(spark):
    df = spark.range(4000).select("id", (F.col("id") % 4 == 0).cast("int").alias("label"))
    train, test = split_rows(df)
    assert train.intersect(test).count() == 0
    assert train.count() + test.count() == 4000
    for label in (0, 1):
        part = train.filter(F.col("label") == label).count() / df.filter(F.col("label") == label).count()
        assert part == pytest.approx(0.7, abs=0.05)
    assert rows_of(train) == rows_of(split_rows(df.repartition(7))[0])


def test_balance(spark):
    df = spark.range(10_000).select((F.col("id") % 10 == 0).cast("int").alias("label"))
    balanced = oversample(df, 0.5)
    assert balanced.filter("label = 0").count() == 9000
    assert balanced.filter("label = 1").count() == pytest.approx(4500, rel=0.1)
    weights = class_weights(df, 0.5).groupBy("label").agg(F.sum("weight")).collect()
    assert dict(weights) == {0: 9000.0, 1: 4500.0}


def test_no_labelled_row_is_removed(spark):
    """Class 1 is as large as class 0 already, at half the ratio: nothing goes, nothing weighs less."""
    df = spark.range(1000).select("id", (F.col("id") % 2).cast("int").alias("label"))
    assert rows_of(oversample(df, 0.5)) == rows_of(df)
    assert {r["weight"] for r in class_weights(df, 0.5).collect()} == {1.0}


def test_equal_rows_share_a_fold(spark):
    df = spark.range(6000).select((F.col("id") % 500).alias("a"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    folded = with_folds(df, 3)
    assert folded.groupBy("a", "label").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    sizes = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}
    assert set(sizes) == {0, 1, 2} and max(sizes.values()) < 1.4 * min(sizes.values())
    assert rows_of(folded) == rows_of(with_folds(df.repartition(5), 3))


def test_weights_do_what_copies_do(spark):
    """A tree on weighted rows is the tree on repeated rows."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = [(float(i % 7), float(i % 11), int(i % 9 == 0 and i % 7 > 2)) for i in range(900)]
    df = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(
        spark.createDataFrame(rows, "x double, y double, label int"))
    n0, n1 = df.filter("label = 0").count(), df.filter("label = 1").count()
    ratio = 3 * n1 / n0 + 1e-9  # every row of class 1 three times
    balanced = plans.ClassBalancer(ratio).fit(df)
    assert balanced.factor == 3.0
    weighed = DecisionTreeClassifier(maxDepth=4, weightCol="weight").fit(balanced.transform(df))
    repeated = df.unionByName(df.filter("label = 1")).unionByName(df.filter("label = 1"))
    copied = DecisionTreeClassifier(maxDepth=4).fit(repeated)
    assert rows_of(weighed.transform(df), "x", "y", "prediction") == rows_of(copied.transform(df), "x", "y", "prediction")


def test_tuned_model_is_scored_on_the_test_part(sets):
    found = plans.tuned_models(*sets, {"DecisionTree": plans.classifiers()["DecisionTree"]},
                               {"DecisionTree": {"maxDepth": [1, 4]}}, folds=2)["DecisionTree"]
    assert 0.5 < found["auc_roc"] <= 1 and 0.5 < found["cv_area"] <= 1


def test_one_class_is_left_as_it_is(spark):
    df = spark.createDataFrame([(0,)] * 5, "label int")
    assert oversample(df).count() == 5


def test_training_part_does_not_leak(sets):
    train, test = sets
    assert train.distinct().intersect(test.distinct()).count() == 0


def test_metrics_equal_the_library(sets, tree):
    predictions = tree.transform(sets[1]).persist()
    found = plans.metrics(predictions)
    for name, metric in [("accuracy", "accuracy"), ("precision", "weightedPrecision"),
                         ("recall", "weightedRecall"), ("f1", "f1")]:
        expected = MulticlassClassificationEvaluator(metricName=metric).evaluate(predictions)
        assert found[name] == pytest.approx(expected), name
    assert 0.5 < found["auc_roc"] <= 1


def test_roc_area(spark):
    scores = [(1, 0.9), (1, 0.8), (0, 0.8), (1, 0.3), (0, 0.2), (0, 0.1), (0, 1.0)]
    df = spark.createDataFrame(scores, "label int, score double")
    pos = [s for label, s in scores if label == 1]
    neg = [s for label, s in scores if label == 0]
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    for limit in (1, 4, 1000):
        assert plans.roc_area(df, "score", limit).first()[0] == pytest.approx(
            wins / len(pos) / len(neg)
        )


def test_class_report(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 0.0), (0, 0.0), (0, 0.0)], "label int, prediction double")
    assert rows_of(plans.class_report(df)) == [
        (0, 2 / 3, 1.0, 0.8, 2), (1, 1.0, 0.5, pytest.approx(2 / 3), 2)
    ]


def test_grid_really_varies(sets):
    _, areas = plans.tune(sets[0], plans.classifiers()["LogisticRegression"],
                          {"regParam": [0.0, 10.0], "elasticNetParam": [1.0]}, folds=2)
    assert areas[0] > areas[1] + 0.05


def test_parts_are_bounded_by_rows(spark):
    rows = spark.createDataFrame([(i % 7, i) for i in range(1000)], "a int, b int").coalesce(2)
    parts = plans.in_parts(rows, 100)
    sizes = parts.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len(sizes) == 10 and max(sizes) <= 110
    assert rows_of(parts) == rows_of(rows)
    assert plans.in_parts(rows, 500).rdd.getNumPartitions() == 2


def test_empty_parts_do_not_hide_a_large_one(spark):
    """As many parts as asked for are there, but two of them hold all rows."""
    rows = spark.createDataFrame([(i % 7, i) for i in range(1000)], "a int, b int").coalesce(2)
    uneven = rows.unionByName(spark.range(0, 18, 1, 18).selectExpr("1 AS a", "1 AS b", "id").filter("id < 0").drop("id"))
    assert uneven.rdd.getNumPartitions() == 20
    parts = plans.in_parts(uneven, 100)
    assert max(parts.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()) <= 110
    assert rows_of(parts) == rows_of(rows)


def test_no_rows_make_parts(spark):
    assert plans.in_parts(spark.range(0), 100).count() == 0


def test_training_keeps_vectors_in_bounded_parts(monkeypatch, sets):
    from pyspark.ml.classification import DecisionTreeClassifier

    seen, whole = [], DecisionTreeClassifier.fit

    def fit(self, rows, params=None):
        seen.append(rows.rdd.getNumPartitions())
        return whole(self, rows, params)

    monkeypatch.setattr(plans.in_parts, "__defaults__", (500,))
    monkeypatch.setattr(DecisionTreeClassifier, "fit", fit)
    n = sets[0].count()
    plans.fit(sets[0], DecisionTreeClassifier(maxDepth=2))
    plans.tune(sets[0], DecisionTreeClassifier(), {"maxDepth": [2]}, folds=2)
    assert len(seen) == 4 and min(seen) >= n / 500 > 1


def test_tuning_leaves_memory_to_the_points_of_the_trees(monkeypatch, spark, sets):
    from pyspark.ml.classification import DecisionTreeClassifier

    def kept():
        return {i: rdd.getStorageLevel() for i, rdd in dict(spark.sparkContext._jsc.getPersistentRDDs()).items()}

    seen, whole, before = [], DecisionTreeClassifier.fit, set(kept())

    def fit(self, rows, params=None):
        rows.count()
        seen.append([level.useMemory() for i, level in kept().items() if i not in before])
        return whole(self, rows, params)

    monkeypatch.setattr(DecisionTreeClassifier, "fit", fit)
    plans.tune(sets[0], DecisionTreeClassifier(), {"maxDepth": [2]}, folds=2)
    assert len(seen) == 3 and all(levels and not any(levels) for levels in seen)


def test_boosted_points_share_a_training(monkeypatch, spark):
    """Areas are those of a training for every point, though only the longest is run."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = [(float(i % 7), float(i % 11), int(i % 9 == 0 or i % 7 > 4), i % 2) for i in range(600)]
    df = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(
        spark.createDataFrame(rows, "x double, y double, label int, fold int"))
    runs, whole = [], GBTClassifier.fit

    def fit(self, rows, params=None):
        runs.append(self.getMaxIter())
        return whole(self, rows, params)

    monkeypatch.setattr(GBTClassifier, "fit", fit)
    weighted = plans._balanced(GBTClassifier(maxDepth=2, seed=42), 0.4)
    points = plans.param_grid(weighted.getStages()[-1], {"maxIter": [2, 5], "maxDepth": [1, 2]})
    found = dict(plans._fitted_points(df, weighted, points))
    assert runs == [5, 5] and sorted(found) == [0, 1, 2, 3]
    for j, point in enumerate(points):
        alone = weighted.fit(df, point).stages[-1]
        assert found[j].toDebugString.split("\n", 1)[1] == alone.toDebugString.split("\n", 1)[1]
        column = ["x", "y", "prediction", "probability"]
        assert rows_of(found[j].transform(df).select(*column[:3], F.col("probability").cast("string"))) == rows_of(
            alone.transform(df).select(*column[:3], F.col("probability").cast("string")))


def test_grids_fit_their_models():
    for grids in (plans.GRIDS, plans.WIDE_GRIDS):
        for name, model in plans.elastic_classifiers().items():
            size = 1
            for values in grids[name].values():
                size *= len(values)
            assert len(plans.param_grid(model, grids[name])) == size


def test_score_from_file(spark, flights, tree):
    model, data = scratch_path(spark, "model"), scratch_path(spark, "flights")
    plans.save_model(tree, model)
    files.write_csv(flights, data)
    scored = plans.score_file(spark, data, model, scratch_path(spark, "scored"))
    assert scored.columns == [*plans.SCORED_COLUMNS, "probability"]
    direct = plans.predict(flights, tree)
    assert rows_of(scored, "FlightNum", "prediction") == rows_of(direct, "FlightNum", "prediction")


def test_bare_classifier(spark, tree):
    path = scratch_path(spark, "classifier")
    plans.save_model(tree.stages[-1], path)
    assert plans.load_classifier(path, "DecisionTree").depth == tree.stages[-1].depth
    with pytest.raises(ValueError):
        plans.load_classifier(path, "Oracle")


def test_feature_names(spark, sets, tree):
    transformed = tree.transform(sets[0])
    names = plans.feature_names(transformed)
    assert len(names) == transformed.first()["features"].size == len(set(names))
    assert names[-4:] == plans.NUMERIC
    table = plans.importances(spark, "tree", tree.stages[-1], names)
    assert table.agg(F.sum("value")).first()[0] == pytest.approx(1.0)
    line = plans.fit(sets[0], plans.classifiers()["LogisticRegression"])
    table = plans.importances(spark, "line", line.stages[-1], names)
    assert rows_of(table.filter("kind = 'intercept'"), "feature", "value") == [
        (plans.INTERCEPT, line.stages[-1].intercept)]
    assert plans.top_features(table, len(names) + 1).filter("kind = 'intercept'").count() == 0


def test_rankings(spark):
    rows = [("a", "x", 3.0), ("a", "y", -2.0), ("a", "z", 1.0), ("b", "y", 9.0), ("b", "q", 8.0)]
    table = spark.createDataFrame(rows, "model string, feature string, value double").withColumn(
        "strength", F.abs("value"))
    top = plans.top_features(table, 2)
    ranking = plans.feature_ranking(top, ["a", "b"])
    assert [tuple(r) for r in ranking.collect()] == [
        ("y", 2, 1, 1.5), ("q", 99, 2, 50.5), ("x", 1, 99, 50.0)
    ] or [r["feature"] for r in ranking.collect()] == ["y", "x", "q"]
    assert rows_of(plans.shared_features(top), "feature", "models") == [("y", 2)]
    assert [r["a_feature"] for r in plans.feature_summary(top, ["a", "b"]).collect()] == ["x", "y"]


def test_depths_of_a_tree_share_a_training(monkeypatch, spark):
    """Every node is that of a training for the depth, though only the deepest is run."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = [(float(i % 7), float(i % 11), float(i * i % 13), int(i % 9 == 0 or i % 7 > 4 or i * i % 13 == 3)) for i in range(900)]
    df = VectorAssembler(inputCols=["x", "y", "z"], outputCol="features").transform(
        spark.createDataFrame(rows, "x double, y double, z double, label int"))
    runs, whole = [], DecisionTreeClassifier.fit

    def fit(self, rows, params=None):
        runs.append(self.getMaxDepth())
        return whole(self, rows, params)

    def nodes(node):
        found = [(node.prediction(), node.impurity(), str(node.impurityStats()), node.numDescendants())]
        if node.numDescendants():
            found += [node.gain(), *nodes(node.leftChild()), *nodes(node.rightChild())]
        return found

    monkeypatch.setattr(DecisionTreeClassifier, "fit", fit)
    weighted = plans._balanced(DecisionTreeClassifier(), 0.4)
    points = plans.param_grid(weighted.getStages()[-1], {"maxDepth": [8, 0, 1, 2, 3, 5], "minInstancesPerNode": [1, 40]})
    found = dict(plans._fitted_points(df, weighted, points))
    assert runs == [8, 8] and sorted(found) == list(range(12))
    for j, point in enumerate(points):
        alone = weighted.fit(df, point).stages[-1]
        assert found[j].toDebugString.split("\n", 1)[1] == alone.toDebugString.split("\n", 1)[1]
        assert nodes(found[j]._java_obj.rootNode()) == nodes(alone._java_obj.rootNode())
        assert found[j].featureImportances == alone.featureImportances
        assert found[j].getMaxDepth() == alone.getMaxDepth()
        assert rows_of(found[j].transform(df).select("x", "y", "z", F.col("probability").cast("string"))) == rows_of(
            alone.transform(df).select("x", "y", "z", F.col("probability").cast("string")))


def test_training_leaves_memory_to_the_models_own_rows(monkeypatch, spark, sets):
    from pyspark.ml.classification import DecisionTreeClassifier

    def kept():
        return {i: rdd.getStorageLevel() for i, rdd in dict(spark.sparkContext._jsc.getPersistentRDDs()).items()}

    seen, whole, before = [], DecisionTreeClassifier.fit, set(kept())

    def fit(self, rows, params=None):
        rows.count()
        seen.extend(level for i, level in kept().items() if i not in before)
        return whole(self, rows, params)

    monkeypatch.setattr(DecisionTreeClassifier, "fit", fit)
    plans.fit(sets[0], DecisionTreeClassifier(maxDepth=2))
    assert seen and all(level.useDisk() and not level.useMemory() for level in seen)
    assert set(kept()) <= before


def test_folds_are_fitted_together_if_their_rows_are_few(monkeypatch, sets):
    """The first fits of two folds wait for each other; areas are those of one after another."""
    from threading import Barrier

    from pyspark.ml.classification import DecisionTreeClassifier

    n, slots, whole = sets[0].count(), sets[0].sparkSession.sparkContext.defaultParallelism, DecisionTreeClassifier.fit
    assert plans.folds_at_once(sets[0], 3) == 3
    assert plans.folds_at_once(sets[0], 3, 1.4 * n / slots) == 2
    assert plans.folds_at_once(sets[0], 3, n // slots // 2) == plans.folds_at_once(sets[0], 3, 0) == 1
    assert plans.folds_at_once(sets[0].limit(0), 3) == 3
    tree, grid, met = DecisionTreeClassifier(), {"maxDepth": [2, 4]}, Barrier(2, timeout=120)
    _, alone = plans.tune(sets[0], tree, grid, folds=2)

    def fit(self, rows, params=None):
        if len(done) < 2:
            done.append(met.wait())
        return whole(self, rows, params)

    done = []
    monkeypatch.setattr(DecisionTreeClassifier, "fit", fit)
    _, together = plans.tune(sets[0], tree, grid, folds=2, at_once=2)
    assert sorted(done) == [0, 1] and together == alone
