"""Reading item tables and stored distances, with the checks that go with them."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riftsplit.operators.clean import require_columns
from riftsplit.plans.blocks import matrix_profile

SEPARATORS = {".csv": ",", ".txt": "\t", ".tsv": "\t"}
DISTANCE_TOLERANCE = 1e-6


def read_items(
    spark: SparkSession, path: str, required: list[str] | None = None, schema: StructType | str | None = None
) -> DataFrame:
    """Item table from Parquet, or from comma / tab text with a header.

    A table of one column needs no particular name: it is taken as the first required
    column.  Without a schema text columns stay strings.
    """
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext in SEPARATORS:
        reader = spark.read.option("header", True).option("sep", SEPARATORS[ext])
        df = (reader.schema(schema).option("enforceSchema", False) if schema else reader).csv(path)
    else:
        df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if required and len(df.columns) == 1 and len(required) == 1:
        df = df.toDF(*required)
    return require_columns(df, required or [])


def drop_missing_items(df: DataFrame, item: str) -> tuple[DataFrame, DataFrame]:
    """Rows with an item, and one row (total, removed); see ``ensure_any``."""
    blank = F.col(item).isNull() | (F.trim(F.col(item)) == "")
    counts = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(blank).alias("removed"))
    return df.filter(~blank), counts


def ensure_any(counts: DataFrame) -> tuple[int, int]:
    total, removed = counts.first()
    if total == removed:
        raise ValueError("no valid item left")
    return total, removed


def distance_profile(pairs: DataFrame, condensed: bool = True) -> DataFrame:
    """Count, range and number of items of a stored pair table (i < j when condensed)."""
    ends = pairs.select(F.explode(F.array("i", "j")).alias("id")).distinct().agg(F.count(F.lit(1)).alias("n_items"))
    stats = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.min("distance").alias("lo"), F.max("distance").alias("hi"))
    n = F.col("n_items")
    wanted = n * (n - 1) / 2 if condensed else n * n
    out = stats.withColumn("n_items", ends.scalar())
    return out.select("n_items", "n_pairs", "lo", "hi", (F.col("n_pairs") == wanted).alias("is_complete"))


def matrix_distance_profile(df: DataFrame, row_id: str, vector: str, metric: str = "euclidean", n_bits: int | None = None) -> DataFrame:
    """``distance_profile`` of the distance matrix of a set: every pair is computed and counted in its block, none becomes a row."""
    blocks = matrix_profile(df, row_id, vector, metric, n_bits)
    stats = blocks.agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    out = stats.withColumn("n_items", df.agg(F.countDistinct(row_id).alias("n")).scalar())
    n = F.col("n_items")
    return out.select("n_items", "n_pairs", "lo", "hi", (F.col("n_pairs") == n * (n - 1) / 2).alias("is_complete"))


def read_distances(spark: SparkSession, source: str | DataFrame, n_items: int) -> DataFrame:
    """Pair table with similarity = 1 - distance, checked for completeness and range."""
    pairs = spark.read.parquet(source) if isinstance(source, str) else source
    if not isinstance(pairs, DataFrame):
        raise TypeError("distances must be a path or a DataFrame")
    require_columns(pairs, ["i", "j", "distance"])
    found = distance_profile(pairs).first()
    if found["n_items"] != n_items or not found["is_complete"]:
        raise ValueError(f"expected all pairs of {n_items} items, found {found['n_pairs']} pairs of {found['n_items']}")
    if found["lo"] < -DISTANCE_TOLERANCE or found["hi"] > 1 + DISTANCE_TOLERANCE:
        warnings.warn(f"distances outside [0, 1]: {found['lo']} .. {found['hi']}", stacklevel=2)
    return pairs.withColumn("similarity", F.lit(1.0) - F.col("distance"))


def alignment(items: DataFrame, index: DataFrame) -> DataFrame:
    """Compare two orderings (pos, item): rows, positions that agree, counts on either side."""
    a, b = items.select("pos", F.col("item").alias("a")), index.select("pos", F.col("item").alias("b"))
    both = a.join(b, "pos", "full_outer")
    return both.agg(
        F.count("a").alias("n_items"),
        F.count("b").alias("n_index"),
        F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("n_agree"),
    )


def aligned_items(items: DataFrame, index: DataFrame) -> tuple[DataFrame, bool]:
    """Items in the order of the distance index, and whether labels may be kept.

    Counts must match; with another order the index decides and labels no longer apply.
    """
    found = alignment(items, index).first()
    if found["n_items"] != found["n_index"]:
        raise ValueError(f"{found['n_items']} items, but the distance index has {found['n_index']}")
    same = found["n_agree"] == found["n_items"]
    return (items if same else index), same
