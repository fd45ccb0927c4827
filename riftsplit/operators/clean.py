"""Cleaning of item tables: keys, conflicting labels, first rows, class balance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftsplit.functions.text import canonical_text
from riftsplit.plans.order import seeded_key, take_by_hash, with_splits


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Raise when a required column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def with_canonical_key(
    df: DataFrame, item: str, key_expr: Column | None = None, extras: dict[str, Column] | None = None
) -> DataFrame:
    """Add ``key`` (null where the item cannot be read) and size columns, rows kept aligned."""
    key = canonical_text(F.col(item)) if key_expr is None else key_expr
    return df.withColumns({"key": key, **(extras or {"key_length": F.length(F.col(item))})})


def drop_without_key(df: DataFrame, key: str = "key") -> DataFrame:
    return df.filter(F.col(key).isNotNull())


def key_digest(key: str) -> dict[str, Column]:
    """Two 64-bit hashes that stand for a long key in shuffles."""
    return {"_h1": F.xxhash64(F.col(key)), "_h2": F.xxhash64(F.col(key), F.lit("key"))}


def drop_conflicting(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keep keys with exactly one distinct non-null label.

    min = max says the same as one distinct value and combines on the map side, so
    a hot key never meets in one task before it is reduced to two numbers.  Digests stand for the keys, and
    the keys to drop, usually few, are the side that is looked up.
    """
    digests = key_digest(key)
    bad = (
        df.select(*[c.alias(n) for n, c in digests.items()], F.col(label).alias("_label"))
        .groupBy(*digests)
        .agg(F.min("_label").alias("_lo"), F.max("_label").alias("_hi"))
        .filter(F.col("_lo").isNull() | (F.col("_lo") != F.col("_hi")))
        .select(*digests)
    )
    kept = df.filter(F.col(key).isNotNull()).withColumns(digests).join(bad, list(digests), "left_anti")
    return kept.select(*df.columns)


def first_per_key(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """First row of each key by id; one partial aggregation, no sort of the group."""
    rest = [c for c in df.columns if c not in (key, row_id)]
    picked = df.groupBy(key).agg(
        F.min(row_id).alias(row_id), F.min_by(F.struct(*[F.col(c) for c in rest]), F.col(row_id)).alias("_row")
    )
    return picked.select(key, row_id, *[F.col("_row")[c].alias(c) for c in rest])


def standardize(df: DataFrame, item: str, label: str, row_id: str, key_expr: Column | None = None) -> DataFrame:
    """Key, drop keyless, drop conflicting, first per key, project to (id, item, label).

    Conflict test and first row come out of one grouping: a key is kept when its
    non-null labels agree.
    """
    require_columns(df, [item, label, row_id])
    keyed = drop_without_key(with_canonical_key(df.select(row_id, item, label), item, key_expr))
    keyed = keyed.select(row_id, "key", label).withColumns(key_digest("key"))
    # only digests, ids and labels are grouped; the text comes back with the rows that stay
    grouped = keyed.groupBy("_h1", "_h2").agg(
        F.min(label).alias("_lo"),
        F.max(label).alias("_hi"),
        F.min(row_id).alias(row_id),
        F.min_by(F.struct(label), F.col(row_id)).alias("_first"),
    )
    stay = grouped.filter(F.col("_lo") == F.col("_hi")).select("_h1", "_h2", row_id, F.col("_first")[label].alias("label"))
    return keyed.select(row_id, "key", "_h1", "_h2").join(stay, [row_id, "_h1", "_h2"]).select(row_id, F.col("key").alias("item"), "label")


def downsample_majority(df: DataFrame, row_id: str, label: str, ratio: float = 1.5, seed: int = 42) -> DataFrame:
    """Reduce class 0 to ``int(ratio * minority)`` rows in seeded order; class 1 whole."""
    require_columns(df, [row_id, label])
    counts = df.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    majority, minority = counts
    if majority <= minority:
        raise ValueError("class 0 must be the majority")
    keep = min(majority, int(ratio * minority))
    keyed = with_splits(df.filter(F.col(label) == 0), 1).withColumn("_key", seeded_key(seed, F.lit(0), F.col(row_id)))
    taken = take_by_hash(keyed, ["split_index"], {"keep": F.lit(keep)}, "rest").filter("set = 'keep'")
    return taken.select(*df.columns).unionByName(df.filter(F.col(label) == 1))


def union_distinct(frames: list[DataFrame], item: str) -> DataFrame:
    """Distinct items of several datasets."""
    return reduce(DataFrame.unionByName, [f.select(item) for f in frames]).distinct()


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows with a null in any of the columns."""
    return df.na.drop(subset=columns)
