"""Training and scoring on feature tables with ``pyspark.ml``, and the run grid."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftsplit.operators.metrics import binary_report, task_metric
from riftsplit.operators.similarity import nearest
from riftsplit.operators.splitters import stratified_three_way
from riftsplit.plans.durable import durable

# Train, val and test fractions of a training run.
FRACTIONS = (0.72, 0.08, 0.2)
KNN_NEIGHBOURS = 4


# Bytes of training vectors in a partition.  A tree ensemble shuffles the statistics of every node once for each partition of
# its rows, so their number follows the size of the rows and not the layout of the input.
BYTES_PER_PARTITION = 64 << 20


def placed_for_training(df: DataFrame, n_features: int, row_id: str = "id", bytes_per_partition: int = BYTES_PER_PARTITION) -> DataFrame:
    """The same rows in as few partitions as their vectors need, placed and ordered by id."""
    parts = max(1, -(-df.count() * n_features * 8 // bytes_per_partition))
    return df.repartition(parts, row_id).sortWithinPartitions(row_id)


def classifier(name: str, n_features: int, seed: int = 0, **options):
    """Estimator by name; boosted models share one implementation."""
    base = {"featuresCol": "features", "labelCol": "label", "seed": seed}
    if name == "random_forest":
        return RandomForestClassifier(**base, **{"numTrees": 200, "maxDepth": 10, **options})
    if name in ("xgb", "lightgbm", "gbt"):
        return GBTClassifier(**base, **{"maxIter": 50, **options})
    if name == "svm":
        return LinearSVC(featuresCol="features", labelCol="label", **options)
    if name == "mlp":
        return MultilayerPerceptronClassifier(**base, **{"layers": [n_features, 64, 2], **options})
    raise ValueError(f"unknown model {name!r}")


def regressor(name: str, seed: int = 0, **options):
    kind = {"random_forest": RandomForestRegressor, "gbt": GBTRegressor}.get(name)
    if kind is None:
        raise ValueError(f"unknown model {name!r}")
    return kind(featuresCol="features", labelCol="label", seed=seed, **options)


def decided(p, threshold: float = 0.5):
    """0/1 of a probability column."""
    p = F.col(p) if isinstance(p, str) else p
    return (p >= threshold).cast("int").cast("double")


def score(model, df: DataFrame, hard: bool = False, threshold: float = 0.5) -> DataFrame:
    """Add ``y_pred``: probability of class 1 (a squashed margin for a margin model), or 0/1."""
    out = model.transform(df)
    if "probability" in out.columns:
        p = F.get(vector_to_array("probability"), F.lit(1))
    elif "rawPrediction" in out.columns:
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.get(vector_to_array("rawPrediction"), F.lit(1))))
    else:
        p = F.col("prediction")
    return out.select(*df.columns, (decided(p, threshold) if hard else p).alias("y_pred"))


def train_classifier(df: DataFrame, name: str, n_features: int, row_id: str = "id", label: str = "label", seed: int = 0, **options):
    """Fit on the train part of a stratified three-way split; (model, one row of val/test metrics and sizes).

    ``name`` is one of ``classifier`` or ``knn`` (mean label of the nearest train rows; its model is None).
    """
    rows = df.select(F.col(row_id).alias("id"), F.col(label).cast("double").alias("label"), "features")
    parts = durable(stratified_three_way(rows, "id", "label", FRACTIONS, seed)).select("id", "set")
    tagged = rows.join(parts, "id").persist()
    try:
        if name == "knn":  # no model but the train rows themselves
            vectors = tagged.withColumn("vec", vector_to_array("features"))
            near = knn_scores(vectors.filter("set = 'train'"), vectors.filter("set <> 'train'"), **options)
            model, scored = None, tagged.join(near, "id")
        else:
            model = classifier(name, n_features, seed, **options).fit(placed_for_training(tagged.filter("set = 'train'"), n_features))
            scored = score(model, tagged.filter("set <> 'train'"))
        scored = durable(scored.select("set", F.col("label").alias("y_true"), "y_pred"))
        sizes = tagged.groupBy().pivot("set", ["train", "val", "test"]).count()
        report = binary_report(scored, ["set"])
        cols = [c for c in report.columns if c not in ("set", "size")]
        wide = report.agg(
            *[F.max(F.when(F.col("set") == s, F.col(c))).alias(f"{s}_{c}") for s in ("val", "test") for c in cols]
        )
        sizes = sizes.select(F.struct(*[F.col(s).alias(f"{s}_size") for s in ("train", "val", "test")]).alias("s"))
        out = wide.withColumn("_s", sizes.scalar()).withColumn("model", F.lit(name))
        out = durable(out.select("model", "_s.*", *wide.columns))
    finally:
        tagged.unpersist()
    return model, out


def train_regressor(df: DataFrame, name: str, splits: DataFrame, seed: int = 0, **options):
    """Fit on the train set of ``splits``; (model, r2 / mae / rmse per remaining set)."""
    tagged = df.select("id", F.col("label").cast("double").alias("label"), "features").join(splits.select("id", "set"), "id")
    model = regressor(name, seed, **options).fit(tagged.filter("set = 'train'"))
    scored = model.transform(tagged.filter("set in ('val', 'test')"))
    long = durable(scored.select(F.col("set").alias("task"), F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"), F.lit(1).alias("mask")))
    named = [task_metric(long, m).select("task", F.lit(m).alias("metric"), "score") for m in ("r2", "mae", "rmse")]
    return model, reduce(DataFrame.unionByName, named).withColumnRenamed("task", "set")


def knn_scores(train: DataFrame, query: DataFrame, k: int = KNN_NEIGHBOURS, metric: str = "euclidean", n_bits: int | None = None) -> DataFrame:
    """(id, y_pred): mean label of the k nearest train rows; inputs have id, vec (train also label)."""
    near = nearest(query.select("id", "vec"), train.select("id", "vec"), [], k, metric, n_bits)
    labels = train.select(F.col("id").alias("rid"), F.col("label").cast("double").alias("label"))
    votes = near.join(labels, "rid").groupBy(F.col("lid").alias("id"))
    return votes.agg(F.avg("label").alias("y_pred"))


def grid_search(df: DataFrame, name: str, n_features: int, grid: dict[str, list], folds: int = 5, parallelism: int = 4, seed: int = 0) -> DataFrame:
    """Cross-validated score of every parameter combination, best first."""
    estimator = classifier(name, n_features, seed)
    builder = ParamGridBuilder()
    for param, values in grid.items():
        builder = builder.addGrid(estimator.getParam(param), values)
    maps = builder.build()
    cv = CrossValidator(
        estimator=estimator, estimatorParamMaps=maps, evaluator=BinaryClassificationEvaluator(labelCol="label"),
        numFolds=folds, parallelism=parallelism, seed=seed,
    )
    fitted = cv.fit(df)
    rows = [(*[m[estimator.getParam(p)] for p in grid], float(s)) for m, s in zip(maps, fitted.avgMetrics)]
    return df.sparkSession.createDataFrame(rows, [*grid, "score"]).orderBy(F.desc("score"))


def run_grid(cells: list[dict], run_one, parallelism: int = 4) -> DataFrame:
    """Run ``run_one(cell) -> one-row DataFrame`` for every cell and union the rows with its keys.

    A cell names its place on any axes (dataset, split, file, model, seed).  Cells are independent, so
    ``parallelism`` of them submit their jobs at a time.
    """
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        done = list(pool.map(run_one, cells))
    rows = [
        out.select(*[F.lit(v).alias(k) for k, v in cell.items()], *[c for c in out.columns if c not in cell])
        for cell, out in zip(cells, done, strict=True)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
