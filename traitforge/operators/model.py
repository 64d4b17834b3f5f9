"""Tree ensembles on selected features: fitting, grids, elimination, attribution, scoring.

Rows carry their features either as one 0/1 column each or, for any number of features, as the
names of those they have in an array column ``held``, of which sparse vectors are made.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..plans.storage import shared_dir
from . import evaluate, select

GRID = {"iterations": (500, 1000), "rate": (0.05, 0.1), "depth": (4, 6)}


@dataclass
class Settings:
    task: str = "classification"
    label: str = "interaction"
    weight: str | None = None
    seed: int = 0
    grid: dict = field(default_factory=lambda: dict(GRID))
    #: Which of equally good configurations is kept, and the least score worth keeping.
    tie: str = "last"
    least: float | None = 0.0
    #: Fits that run side by side.
    threads: int = 4


HELD = "held"


def vector_stage(columns: list[str], features: list[str]) -> VectorAssembler | CountVectorizerModel:
    """What makes the vectors ``features`` of a table with these ``columns``."""
    if HELD in columns:
        return CountVectorizerModel.from_vocabulary(features, inputCol=HELD, outputCol="features").setBinary(True)
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")


def names_of(model: PipelineModel) -> list[str]:
    """The features that a fitted ensemble reads, in its order."""
    first = model.stages[0]
    return list(first.vocabulary if isinstance(first, CountVectorizerModel) else first.getInputCols())


def assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    return vector_stage(rows.columns, features).transform(rows)


def fit(rows: DataFrame, features: list[str], s: Settings, iterations: int, rate: float, depth: int, validation: str | None = None) -> PipelineModel:
    """One ensemble; ``validation`` names a boolean column of rows that stop it early."""
    kind = GBTClassifier if s.task == "classification" else GBTRegressor
    trees = kind(labelCol=s.label, featuresCol="features", maxIter=iterations, stepSize=rate, maxDepth=depth, seed=s.seed)
    if s.weight:
        trees = trees.setWeightCol(s.weight)
    if validation:
        trees = trees.setValidationIndicatorCol(validation)
    return Pipeline(stages=[vector_stage(rows.columns, features), trees]).fit(rows)


def score(model: PipelineModel, rows: DataFrame, task: str = "classification") -> DataFrame:
    """``rows`` with ``confidence`` (probability of the positive class) and ``prediction``, or
    only ``prediction`` for regression."""
    out = model.transform(rows)
    if task != "classification":
        return out.drop("features")
    return out.withColumn("confidence", vector_to_array("probability")[1]).withColumn("prediction", M.vote(F.col("confidence"))).drop("features", "rawPrediction", "probability")


def measure(scored: DataFrame, s: Settings) -> dict[str, float]:
    if s.task == "classification":
        row = evaluate.classification_metrics(evaluate.confusion(scored.withColumn("_g", F.lit(1)), ["_g"], s.label, "prediction"), ["_g"]).first()
    else:
        row = evaluate.regression_metrics(scored.withColumn("_g", F.lit(1)), ["_g"], s.label, "prediction").first()
    return {k: v for k, v in row.asDict().items() if k != "_g"}


def better(new: float, old: float | None, tie: str) -> bool:
    return old is None or new > old or (new == old and tie == "last")


def grid_search(train: DataFrame, test: DataFrame, features: list[str], s: Settings) -> tuple[PipelineModel | None, list[dict], DataFrame | None]:
    """The best ensemble of the grid on the test rows, every configuration's metrics, and the best
    one's predictions. Classifiers are ranked by MCC, with none kept below ``s.least``; regressors
    by R squared. Boosting stops early where the test rows gain no more. Fits run side by side."""
    key = "mcc" if s.task == "classification" else "r2"
    both = train.withColumn("_stop", F.lit(False)).unionByName(test.withColumn("_stop", F.lit(True)))
    both = both.persist()

    def one(setting: tuple) -> tuple:
        model = fit(both, features, s, *setting, validation="_stop")
        scored = score(model, test, s.task)
        return setting, model, scored, measure(scored, s)

    try:
        with ThreadPool(max(1, s.threads)) as pool:
            fitted = pool.map(one, list(product(s.grid["iterations"], s.grid["rate"], s.grid["depth"])))
    finally:
        both.unpersist()
    best, best_score, table, predictions = None, None, [], None
    for (iterations, rate, depth), model, scored, found in fitted:
        table.append({"iterations": iterations, "rate": rate, "depth": depth, **found})
        value = found[key]
        if value is not None and (s.task != "classification" or s.least is None or value >= s.least) and better(value, best_score, s.tie):
            best, best_score, predictions = model, value, scored
    return best, table, predictions


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """(feature, importance), largest first; equal ones in order of name."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    if len(values) != len(features):
        raise ValueError(f"{len(values)} importances for {len(features)} features")
    return sorted(zip(features, values, strict=True), key=lambda p: (-p[1], p[0]))


def eliminate(rows: DataFrame, features: list[str], wanted: int, s: Settings, iterations: int = 500, rate: float = 0.1, depth: int = 4, row_id: str | None = None) -> list[str]:
    """Recursive elimination, a tenth of the first surplus at a time: by the trees' importance, or,
    with ``row_id``, by mean absolute attribution."""
    left, step = list(features), select.elimination_step(len(features), wanted)
    while len(left) > wanted:
        ranked = ranked_features(fit(rows, left, s, iterations, rate, depth), rows, left, row_id)
        left = ranked[: max(wanted, len(left) - step)]
    return sorted(left)


def ranked_features(model: PipelineModel, rows: DataFrame, features: list[str], row_id: str | None = None) -> list[str]:
    """All features, the most telling first."""
    if row_id is None:
        return [f for f, _ in importances(model, features)]
    parts = attributions(model, rows, features, row_id)
    # Rows that never meet a feature's split add nothing to its mean.
    sums = {r.feature: r.total for r in parts.groupBy("feature").agg(F.sum(F.abs("attribution")).alias("total")).collect()}
    return sorted(features, key=lambda f: (-sums.get(f, 0.0), f))


def lasso(rows: DataFrame, features: list[str], wanted: int, s: Settings, threshold: float = 1e-5) -> list[str]:
    """Features with the largest absolute weights of an L1 model, of those above ``threshold``."""
    data = assembled(rows, features)
    n = max(1, data.count())
    if s.task == "classification":
        model = LogisticRegression(labelCol=s.label, elasticNetParam=1.0, regParam=1.0 / n, standardization=False).fit(data)
    else:
        model = LinearRegression(labelCol=s.label, elasticNetParam=1.0, regParam=1.0, standardization=False).fit(data)
    ranked = sorted(zip(features, model.coefficients.toArray().tolist(), strict=True), key=lambda p: (-abs(p[1]), p[0]))
    return [f for f, w in ranked[:wanted] if abs(w) > threshold]


def attributions(model: PipelineModel, rows: DataFrame, features: list[str], row_id: str) -> DataFrame:
    """(row_id, feature, value, attribution): each tree's change of prediction at every split of the
    row's path, summed by the feature that splits, with the row's value of that feature; with the
    roots they add up to the raw score.

    The trees are read back as a table of nodes, at most trees x 2^depth of them, and rows walk
    down level by level.
    """
    spark = rows.sparkSession
    trees = model.stages[-1]
    path = f"{shared_dir(spark)}/trees-{trees.uid}"
    trees.write().overwrite().save(path)
    raw = spark.read.parquet(f"{path}/data")
    weights = spark.createDataFrame([(i, float(w)) for i, w in enumerate(trees.treeWeights)], "tree int, weight double")
    nodes = raw.select(F.col("treeID").cast("int").alias("tree"), "nodeData.*").join(weights, "tree")
    nodes = nodes.select("tree", F.col("id").alias("node"), "prediction", "weight", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("split.featureIndex").alias("index"), F.col("split.leftCategoriesOrThreshold")[0].alias("threshold"))
    child = nodes.select("tree", F.col("node").alias("next"), F.col("prediction").alias("after"))
    values = model.stages[0].transform(rows).select(row_id, vector_to_array("features").alias("x"))
    at = values.crossJoin(F.broadcast(nodes.select("tree").distinct())).withColumn("node", F.lit(0))
    steps = None
    for _ in range(trees.getMaxDepth()):
        here = at.join(F.broadcast(nodes), ["tree", "node"]).filter("left >= 0")
        moved = here.withColumn("next", F.when(F.col("x")[F.col("index")] <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))).join(F.broadcast(child), ["tree", "next"])
        step = moved.select(row_id, "index", F.col("x")[F.col("index")].alias("value"), (F.col("weight") * (F.col("after") - F.col("prediction"))).alias("change"))
        steps = step if steps is None else steps.unionByName(step)
        at = moved.select(row_id, "x", "tree", F.col("next").alias("node"))
    names = spark.createDataFrame(list(enumerate(features)), "index int, feature string")
    return steps.groupBy(row_id, "index").agg(F.max("value").alias("value"), F.sum("change").alias("attribution")).join(F.broadcast(names), "index").select(row_id, "feature", "value", "attribution")


def score_all(models: list[tuple[str, PipelineModel]], rows: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions of every run's model, with its ``run``."""
    out = None
    for run, model in models:
        part = score(model, rows).select(*keys, "confidence", "prediction", F.lit(run).alias("run"))
        out = part if out is None else out.unionByName(part)
    return out
