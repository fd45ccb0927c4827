"""Outputs of training runs: metric files, predictions, per-split result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# .../{dataset}/{split}/{model}/{repeat}/{file}
RUN_PATH = r"([^/]+)/([^/]+)/([^/]+)/([^/]+)/[^/]+$"


def with_run_keys(df: DataFrame, path: Column) -> DataFrame:
    """Dataset, split, model and repeat from the path of a run file."""
    names = ["dataset", "split", "model", "repeat"]
    keys = {n: F.regexp_extract(path, RUN_PATH, i + 1) for i, n in enumerate(names)}
    keys["repeat"] = keys["repeat"].cast("int")
    return df.withColumns(keys)


def parse_run_metrics(lines: DataFrame, path: Column) -> DataFrame:
    """``key: value`` lines as (dataset, split, model, repeat, metric, value)."""
    parts = F.split("value", ":", 2)
    return with_run_keys(lines, path).select(
        "dataset", "split", "model", "repeat",
        F.trim(F.get(parts, F.lit(0))).alias("metric"), F.trim(F.get(parts, F.lit(1))).try_cast("double").alias("value"),
    ).filter(F.col("metric") != "")


def read_run_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Metric lines of every ``eval.txt`` below the root."""
    return parse_run_metrics(spark.read.text(f"{root}/*/*/*/*/eval.txt"), F.col("_metadata.file_path"))


def read_run_predictions(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Every ``prediction.csv`` with its run keys."""
    rows = spark.read.option("header", True).schema(schema).csv(f"{root}/*/*/*/*/prediction.csv")
    return with_run_keys(rows, F.col("_metadata.file_path"))


def read_results(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """Concatenate result tables that may lack columns."""
    reader = spark.read.option("header", True)
    frames = [(reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(p) for p in paths]
    return union_results(frames)


def union_results(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
