"""Training and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from riftsplit.operators import train
from riftsplit.operators.features import dense_to_vector
from riftsplit.operators.splitters import random_three_way
from riftsplit.plans.durable import durable
from riftsplit.queries.base import query, r6, rounded, table

_D = "sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE), 2))))"


def _labelled(spark, sf_dir):
    """embeddings with a binary label (class below five)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding", (F.col("label") < 5).cast("int").alias("label"))


@query("m1_train_classifier")
def train_classifier(spark, sf_dir):
    points = dense_to_vector(_labelled(spark, sf_dir), "embedding")
    _, report = train.train_classifier(points, "random_forest", 64)
    return report


@query("m2_score_items")
def score_items(spark, sf_dir):
    points = dense_to_vector(_labelled(spark, sf_dir), "embedding")
    model, _ = train.train_classifier(points, "gbt", 64)
    soft = train.score(model, points.select("id", "features")).select("id", F.col("y_pred").alias("soft"))
    return soft.withColumn("hard", train.decided("soft"))  # scored once


@query(
    "m3_knn_classifier",
    f"""WITH e AS (SELECT vec_id AS id, embedding, CASE WHEN label < 5 THEN 1 ELSE 0 END AS label, label AS c FROM embeddings),
        k AS (SELECT a.id, b.label, row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) AS rk FROM e a, e b WHERE a.c % 2 = 0 AND b.c % 2 = 1)
        SELECT id, {r6("avg(label)")} AS y_pred FROM k WHERE rk <= 4 GROUP BY id""",
)
def knn(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (F.col("label") < 5).cast("int").alias("label"), F.col("label").alias("c")
    )
    return rounded(train.knn_scores(e.filter("c % 2 = 1"), e.filter("c % 2 = 0")), "y_pred")


@query("m4_grid_search")
def grid_search(spark, sf_dir):
    points = dense_to_vector(_labelled(spark, sf_dir), "embedding")
    points = points.select(F.col("label").cast("double").alias("label"), "features")
    return train.grid_search(points, "random_forest", 64, {"numTrees": [50, 100], "maxDepth": [5, 10]}, folds=5)


@query("m5_train_regressor")
def train_regressor(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("double").alias("label"))
    points = dense_to_vector(e, "embedding")
    splits = durable(random_three_way(points, "id"))
    _, report = train.train_regressor(points, "random_forest", splits, numTrees=200, maxDepth=10)
    return report


@query("m6_run_grid")
def run_grid(spark, sf_dir):
    """Every model on two datasets (all items, and those of even ids) with two seeds."""
    points = dense_to_vector(_labelled(spark, sf_dir), "embedding").select("id", "label", "features")
    datasets = {"all": points, "even_ids": points.filter("id % 2 = 0")}
    cells = [
        {"dataset": d, "split": "stratified", "model": m, "repeat": s} for d in datasets for m in ("random_forest", "svm", "knn") for s in (0, 1)
    ]
    return train.run_grid(cells, lambda c: train.train_classifier(datasets[c["dataset"]], c["model"], 64, seed=c["repeat"])[1].drop("model"))
