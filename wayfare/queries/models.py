"""Sampling, balancing, model and report queries."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from wayfare.functions.measures import id_fraction
from wayfare.operators.sampling import (
    bernoulli,
    class_weights,
    keyed_sample,
    oversample,
    shuffled,
    split_rows,
    with_folds,
)
from wayfare.plans import classify as plans
from wayfare.plans.flights import preprocess
from wayfare.queries.base import FLIGHTS, TRIPS, ctes, query, stable, stable_sql
from wayfare.queries.flights import FILLED, PREPARED, RENAMED
from wayfare.session import scratch_path
from wayfare.sources import derived, files

PREPARED_FLIGHTS = ctes(FLIGHTS, RENAMED, FILLED, PREPARED)
SCORE_FROM = "2000-01-01"


def _prepared(spark, sf_dir):
    return preprocess(derived.flights(spark, sf_dir))


def _past(spark, sf_dir):
    return _prepared(spark, sf_dir).filter(F.col("FL_DATE") < SCORE_FROM)


def _coming(spark, sf_dir):
    return derived.flights(spark, sf_dir).filter(F.col("FL_DATE") >= SCORE_FROM)


# -- samples ------------------------------------------------------------------------------

FRACTION_SQL = ("((trip_id % 2147483648) * 2654435761 % 4294967296) / 4294967296e0")


@query("keyed_sample", ctes(TRIPS) + f"SELECT trip_id FROM trips WHERE {FRACTION_SQL} < 0.04e0")
def keyed(spark, sf_dir):
    return keyed_sample(derived.trips(spark, sf_dir), "trip_id", 0.04).select("trip_id")


@query("keyed_split", ctes(TRIPS) + f"""
    SELECT payment_type, CASE WHEN {FRACTION_SQL} < 0.7e0 THEN 'train' ELSE 'test' END AS part,
        count(*) AS trips FROM trips GROUP BY 1, 2""")
def keyed_split(spark, sf_dir):
    part = F.when(id_fraction("trip_id") < 0.7, F.lit("train")).otherwise(F.lit("test"))
    marked = derived.trips(spark, sf_dir).withColumn("part", part)
    return marked.groupBy("payment_type", "part").agg(F.count(F.lit(1)).alias("trips"))


@query("bernoulli_sample")
def sample(spark, sf_dir):
    return bernoulli(derived.trips(spark, sf_dir), 0.04).select("trip_id", "medallion")


@query("seeded_shuffle", ctes(TRIPS) + "SELECT trip_id, medallion FROM trips")
def shuffle(spark, sf_dir):
    return shuffled(derived.trips(spark, sf_dir).select("trip_id", "medallion"))


@query("random_split", ctes(TRIPS) + "SELECT trip_id, 1::BIGINT AS parts FROM trips")
def random_split(spark, sf_dir):
    """Every trip is in one part."""
    train, test = derived.trips(spark, sf_dir).select("trip_id").randomSplit([0.7, 0.3], 42)
    return train.unionByName(test).groupBy("trip_id").agg(F.count(F.lit(1)).alias("parts"))


@query("class_split", PREPARED_FLIGHTS + """
    SELECT label, count(*) AS flights, true AS even FROM prepared GROUP BY label""")
def class_split(spark, sf_dir):
    """Both parts together are the flights, and keep the share of cancelled ones."""
    train, test = split_rows(_prepared(spark, sf_dir))
    both = train.select("label", F.lit(1).alias("train")).unionByName(
        test.select("label", F.lit(0).alias("train"))
    )
    share = F.avg("train")
    return both.groupBy("label").agg(
        F.count(F.lit(1)).alias("flights"), share.between(0.55, 0.85).alias("even")
    )


@query("oversampled", PREPARED_FLIGHTS + """
    SELECT count(*) FILTER (label = 0) AS others, true AS balanced FROM prepared""")
def oversampled(spark, sf_dir):
    """All other flights, and about half as many cancelled ones."""
    n = F.count_if(F.col("label") == 0)
    share = F.count_if(F.col("label") == 1) / n
    return oversample(_prepared(spark, sf_dir), 0.5).agg(
        n.alias("others"), share.between(0.45, 0.55).alias("balanced")
    )


@query("class_weights", PREPARED_FLIGHTS + """, sizes AS (
    SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM prepared)
    SELECT label, CASE WHEN label = 1
        THEN (SELECT greatest(1e0, floor(n0 * 0.5e0) / CAST(n1 AS DOUBLE)) FROM sizes) ELSE 1e0 END AS weight,
        count(*) AS flights FROM prepared GROUP BY 1, 2""")
def weights(spark, sf_dir):
    weighted = class_weights(_prepared(spark, sf_dir), 0.5)
    return weighted.groupBy("label", "weight").agg(F.count(F.lit(1)).alias("flights"))


# -- features and models ------------------------------------------------------------------


@query("feature_vectors", PREPARED_FLIGHTS + f"""
    SELECT label, (SELECT {' + '.join(f'count(DISTINCT {c})' for c in plans.CATEGORICAL)}
        + {len(plans.NUMERIC)} FROM prepared)::INT AS width, count(*) AS flights FROM prepared
    WHERE {' AND '.join(f'{c} IS NOT NULL' for c in plans.NUMERIC)} GROUP BY label""")
def feature_vectors(spark, sf_dir):
    """Rows and width of the assembled feature vectors, by label."""
    from pyspark.ml.functions import vector_to_array

    rows = _prepared(spark, sf_dir)
    features = Pipeline(stages=plans.feature_stages()).fit(rows).transform(rows)
    width = F.size(vector_to_array("features")).alias("width")
    return features.groupBy("label", width).agg(F.count(F.lit(1)).alias("flights"))


def _fitted(spark, sf_dir, name: str, rows=_prepared):
    train, test = plans.training_sets(rows(spark, sf_dir))
    return plans.fit(train, plans.classifiers()[name]), test


def _chosen(*names: str) -> dict:
    return {name: plans.classifiers()[name] for name in names}


def _model_query(key: str, name: str):
    @query(key)
    def model(spark, sf_dir):
        fitted, test = _fitted(spark, sf_dir, name)
        return plans.comparison_table(spark, {name: plans.metrics(fitted.transform(test))})

    return model


_model_query("cancel_model_logistic", "LogisticRegression")
_model_query("cancel_model_tree", "DecisionTree")
_model_query("cancel_model_forest", "RandomForest")
_model_query("cancel_model_boosted", "GBT")


@query("model_comparison")
def model_comparison(spark, sf_dir):
    """Metrics of two models trained and tested on the same rows."""
    train, test = plans.training_sets(_prepared(spark, sf_dir))
    fitted = plans.fit_all(train, _chosen("LogisticRegression", "DecisionTree"))
    found = {name: plans.metrics(model.transform(test)) for name, model in fitted.items()}
    return plans.comparison_table(spark, found)


def _areas_query(key: str, name: str, column: str, kind: str):
    (parameter, values), = plans.GRIDS[name].items()

    @query(key)
    def areas(spark, sf_dir):
        """Mean area under ROC over the folds, for every point of the model's grid."""
        train, _ = plans.training_sets(_prepared(spark, sf_dir))
        _, found = plans.tune(train, plans.classifiers()[name], {parameter: values}, at_once=plans.folds_at_once(train))
        rows = [(type(values[0])(p), float(a)) for p, a in zip(values, found)]
        return spark.createDataFrame(rows, f"{column} {kind}, auc_roc double")

    return areas


_areas_query("cancel_cv", "LogisticRegression", "reg_param", "double")
_areas_query("cancel_cv_tree", "DecisionTree", "max_depth", "int")
_areas_query("cancel_cv_forest", "RandomForest", "num_trees", "int")
_areas_query("cancel_cv_boosted", "GBT", "max_iter", "int")


@query("cancel_tuned")
def cancel_tuned(spark, sf_dir):
    """Test metrics of the best models of two grids, with their mean area over the folds."""
    train, test = plans.training_sets(_prepared(spark, sf_dir))
    found = plans.tuned_models(train, test, _chosen("LogisticRegression", "DecisionTree"), plans.GRIDS)
    areas = spark.createDataFrame([(m, float(v["cv_area"])) for m, v in found.items()], "model string, cv_area double")
    return plans.comparison_table(spark, found).join(F.broadcast(areas), "model")


# -- what must hold of fitted models, whatever they learn -----------------------------------

KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in plans.NUMERIC)


@query("folds_by_content", PREPARED_FLIGHTS + f"""
    SELECT 3 AS folds, count(*) AS flights, 0::BIGINT AS split_rows, true AS even FROM prepared""")
def folds_by_content(spark, sf_dir):
    """Equal flights are in one fold; the folds hold all flights and are about equal."""
    rows = _prepared(spark, sf_dir).select(*plans.CATEGORICAL, *plans.NUMERIC, "label")
    sizes = with_folds(rows, 3).groupBy(*rows.columns, "fold").agg(F.count(F.lit(1)).alias("n"))
    contents = sizes.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("parts"))
    per_fold = sizes.groupBy("fold").agg(F.sum("n").alias("n"))
    return per_fold.agg(
        F.count(F.lit(1)).cast("int").alias("folds"), F.sum("n").alias("flights"),
        (F.max("n") < 1.2 * F.min("n")).alias("even")).withColumn(
            "split_rows", contents.filter("parts > 1").agg(F.count(F.lit(1))).scalar())


@query("balanced_weights", PREPARED_FLIGHTS + """, sizes AS (
    SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM prepared)
    SELECT n0 AS others, n1 AS cancelled,
        greatest(CAST(floor(n0 * 0.4e0) AS BIGINT), n1) AS cancelled_weight FROM sizes""")
def balanced_weights(spark, sf_dir):
    """Cancelled flights weigh 0.4 times the others in training, without a copy."""
    rows = _prepared(spark, sf_dir)
    weighted = plans.ClassBalancer().fit(rows).transform(rows)
    return weighted.agg(
        F.count_if(F.col("label") == 0).alias("others"), F.count_if(F.col("label") == 1).alias("cancelled"),
        F.round(F.sum(F.when(F.col("label") == 1, F.col(plans.WEIGHT)))).cast("long").alias("cancelled_weight"))


@query("model_invariants", PREPARED_FLIGHTS + f"""
    SELECT m AS model, (SELECT count(*) FROM prepared WHERE {KNOWN}) AS flights,
        true AS accuracy_from_confusion, true AS area_is_roc_area, true AS better_than_chance
    FROM (VALUES ('DecisionTree'), ('LogisticRegression')) v(m)""")
def model_invariants(spark, sf_dir):
    """Metrics of fitted models agree with the tables they can be computed from."""
    from pyspark.ml.functions import vector_to_array

    train, test = plans.training_sets(_prepared(spark, sf_dir))
    rows = []
    for name, model in plans.fit_all(train, _chosen("DecisionTree", "LogisticRegression")).items():
        scored = model.transform(test).select(
            "label", "prediction", "probability", vector_to_array("probability")[1].alias("score")).persist()
        found, n = plans.metrics(scored), model.transform(train).count() + scored.count()
        counts = {(r["label"], r["prediction"]): r["n"] for r in plans.confusion(scored).collect()}
        right = sum(n for (label, guess), n in counts.items() if label == guess) / sum(counts.values())
        area = plans.roc_area(scored, "score").first()["auc"]
        near = abs(area - found["auc_roc"]) < 1e-3  # the library's area is that of 1,000 bins
        rows.append((name, n, abs(right - found["accuracy"]) < 1e-12, near, area > 0.5))
        scored.unpersist()
    return spark.createDataFrame(rows, "model string, flights long, accuracy_from_confusion boolean,"
                                       " area_is_roc_area boolean, better_than_chance boolean")


@query("score_invariants", PREPARED_FLIGHTS + f"""
    SELECT UniqueCarrier, count(*) AS flights, true AS sums_to_one, true AS follows_probability
    FROM prepared WHERE FL_DATE >= '{SCORE_FROM}' AND {KNOWN} GROUP BY 1""")
def score_invariants(spark, sf_dir):
    """Every later flight with all numbers is scored once, from a file, by a saved and loaded model."""
    fitted, _ = _fitted(spark, sf_dir, "DecisionTree", rows=_past)
    place, data = scratch_path(spark, "model"), scratch_path(spark, "coming")
    plans.save_model(fitted, place)
    files.write_csv(_coming(spark, sf_dir), data)
    scored = plans.score_file(spark, data, place, scratch_path(spark, "scored"))
    both = F.get("probability", 0) + F.get("probability", 1)
    side = (F.get("probability", 1) > 0.5).cast("double")
    return scored.groupBy("UniqueCarrier").agg(
        F.count(F.lit(1)).alias("flights"), F.every(F.abs(both - 1) < 1e-9).alias("sums_to_one"),
        F.every(side == F.col("prediction")).alias("follows_probability"))


@query("importance_invariants", PREPARED_FLIGHTS + f"""
    SELECT m AS model, (SELECT {' + '.join(f'count(DISTINCT {c})' for c in plans.CATEGORICAL)}
        + {len(plans.NUMERIC)} FROM prepared) AS features, i AS intercepts, true AS sums_to_one
    FROM (VALUES ('DecisionTree', 0::BIGINT), ('LogisticRegression', 1::BIGINT)) v(m, i)""")
def importance_invariants(spark, sf_dir):
    """A strength for every place of the vector; importances of a tree sum to 1, a line has an intercept."""
    rows = _prepared(spark, sf_dir).select(*plans.CATEGORICAL, *plans.NUMERIC, "label")
    table = _importances(spark, rows, ["DecisionTree", "LogisticRegression"])
    total = F.sum(F.when(F.col("kind") == "importance", F.col("value")))
    return table.groupBy("model").agg(
        F.count_if(F.col("kind") != "intercept").alias("features"),
        F.count_if(F.col("kind") == "intercept").alias("intercepts"),
        F.coalesce(F.abs(total - 1) < 1e-9, F.lit(True)).alias("sums_to_one"))


@query("score")
def score(spark, sf_dir):
    """Train on earlier flights, save, load, score the later ones."""
    fitted, _ = _fitted(spark, sf_dir, "DecisionTree", rows=_past)
    place = scratch_path(spark, "model")
    plans.save_model(fitted, place)
    return plans.score(
        _coming(spark, sf_dir), plans.load_model(place), scratch_path(spark, "scored")
    )


@query("feature_importance")
def feature_importance(spark, sf_dir):
    train, _ = plans.training_sets(_prepared(spark, sf_dir))
    return _importances(spark, train, ["DecisionTree"])


def _importances(spark, train, models):
    tables = []
    for name, fitted in plans.fit_all(train, _chosen(*models)).items():
        names = plans.feature_names(fitted.transform(train))
        tables.append(plans.importances(spark, name, fitted.stages[-1], names))
    return reduce(lambda a, b: a.unionByName(b), tables)


@query("model_feature_rank")
def model_feature_rank(spark, sf_dir):
    """Features by their mean rank in a linear and a tree model."""
    models = ["LogisticRegression", "DecisionTree"]
    train, _ = plans.training_sets(_prepared(spark, sf_dir))
    table = _importances(spark, train, models)
    return plans.feature_ranking(plans.top_features(table, 10), models)


# -- reports over predictions; the "prediction" is a rule, so that SQL can follow ----------

RULE_SQL = PREPARED_FLIGHTS + """, predictions AS (
    SELECT label, CASE WHEN CRSElapsedTime > 240 THEN 1e0 ELSE 0e0 END AS prediction,
        CRSDepTime / 2400e0 AS score FROM prepared WHERE CRSElapsedTime IS NOT NULL)"""


def _predictions(spark, sf_dir):
    known = _prepared(spark, sf_dir).filter(F.col("CRSElapsedTime").isNotNull())
    guess = F.when(F.col("CRSElapsedTime") > 240, F.lit(1.0)).otherwise(F.lit(0.0))
    return known.select(
        "label", guess.alias("prediction"), (F.col("CRSDepTime") / 2400.0).alias("score")
    )


@query("confusion", RULE_SQL + """
    SELECT label, prediction, count(*) AS n FROM predictions GROUP BY label, prediction""")
def confusion(spark, sf_dir):
    return plans.confusion(_predictions(spark, sf_dir))


@query("class_report", RULE_SQL + """, counts AS (
    SELECT c.c AS class, count(*) FILTER (label = c AND prediction = c) AS hit,
        count(*) FILTER (prediction = c) AS guessed, count(*) FILTER (label = c) AS support
    FROM predictions CROSS JOIN (VALUES (0), (1)) AS c(c) GROUP BY c.c)
    SELECT class, coalesce(hit / CAST(nullif(guessed, 0) AS DOUBLE), 0) AS precision,
        coalesce(hit / CAST(nullif(support, 0) AS DOUBLE), 0) AS recall,
        coalesce(hit * 2e0 / nullif(guessed + support, 0), 0) AS f1, support FROM counts""")
def class_report(spark, sf_dir):
    return plans.class_report(_predictions(spark, sf_dir))


@query("roc_area", RULE_SQL + f""", counted AS (
    SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
    FROM predictions GROUP BY score),
    placed AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM counted)
    SELECT {stable_sql("CAST(sum(pos * (2 * below + neg)) AS DOUBLE) / CAST(2 * sum(pos) * sum(neg) AS DOUBLE)", 9)}
        AS auc FROM placed""")
def roc_area(spark, sf_dir):
    return plans.roc_area(_predictions(spark, sf_dir), "score").select(
        stable("auc", 9).alias("auc")
    )


# -- explanation reports over a strength table that SQL can build, too ----------------------

MEASURED = ["DISTANCE", "CRSDepTime", "CRSArrTime", "CRSElapsedTime", "TAXI_OUT", "TAXI_IN",
            "DEP_DELAY", "ARR_DELAY", "NASDelay", "CarrierDelay", "Month", "DayOfWeek"]
# whole-number strengths: the gap between class sums (linear), and distinct values (spread)
_GAP = "abs(sum(CASE WHEN label = 1 THEN {0} ELSE -{0} END))"


def _strength_sql() -> str:
    rows = []
    for c in MEASURED:
        value = f"CAST(floor(coalesce({c}, 0)) AS BIGINT)"
        gap = _GAP.format(value)
        rows.append(f"SELECT 'linear' AS model, '{c}' AS feature, CAST({gap} AS DOUBLE) AS value,"
                    f" CAST({gap} AS DOUBLE) AS strength FROM prepared")
        rows.append(f"SELECT 'spread', '{c}', CAST(count(DISTINCT {value}) AS DOUBLE),"
                    f" CAST(count(DISTINCT {value}) AS DOUBLE) FROM prepared")
    return "strengths AS (" + " UNION ALL ".join(rows) + ")"


TOP_SQL = PREPARED_FLIGHTS + ", " + _strength_sql() + """, top AS (SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY model ORDER BY strength DESC, feature) AS INT)
        AS rank FROM strengths) WHERE rank <= 5)"""


def _top(spark, sf_dir):
    rows = _prepared(spark, sf_dir)
    long = rows.select(
        "label",
        F.inline(F.array(*[
            F.struct(
                F.lit(c).alias("feature"),
                F.floor(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias("v"),
            )
            for c in MEASURED
        ])),
    )
    signed = F.when(F.col("label") == 1, F.col("v")).otherwise(-F.col("v"))
    found = long.groupBy("feature").agg(
        F.abs(F.sum(signed)).cast("double").alias("linear"),
        F.count_distinct("v").cast("double").alias("spread"),
    )
    table = found.unpivot("feature", ["linear", "spread"], "model", "value").withColumn(
        "strength", F.abs("value")
    )
    return plans.top_features(table, 5)


@query("top_features", TOP_SQL + "SELECT * FROM top")
def top_features(spark, sf_dir):
    return _top(spark, sf_dir)


@query("feature_rank", TOP_SQL + """
    SELECT feature, linear, spread, (linear + spread) / 2e0 AS avg_rank FROM (
        SELECT feature, coalesce(min(rank) FILTER (model = 'linear'), 99) AS linear,
            coalesce(min(rank) FILTER (model = 'spread'), 99) AS spread
        FROM top GROUP BY feature)""")
def feature_rank(spark, sf_dir):
    return plans.feature_ranking(_top(spark, sf_dir), ["linear", "spread"])


@query("feature_summary", TOP_SQL + """
    SELECT rank, max(feature) FILTER (model = 'linear') AS linear_feature,
        max(value) FILTER (model = 'linear') AS linear_value,
        max(feature) FILTER (model = 'spread') AS spread_feature,
        max(value) FILTER (model = 'spread') AS spread_value
    FROM top GROUP BY rank""")
def feature_summary(spark, sf_dir):
    return plans.feature_summary(_top(spark, sf_dir), ["linear", "spread"])


@query("shared_features", TOP_SQL + """
    SELECT feature, count(DISTINCT model) AS models FROM top GROUP BY feature
    HAVING count(DISTINCT model) >= 2""")
def shared_features(spark, sf_dir):
    return plans.shared_features(_top(spark, sf_dir))
