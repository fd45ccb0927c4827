"""Feature columns: bit sets, group keys, properties, kernel maps and projections."""

from __future__ import annotations

from pyspark.ml.feature import PCA, CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftsplit.functions.bits import CLUSTER_BITS, shingle_fingerprint
from riftsplit.functions.text import token_properties
from riftsplit.plans.order import seeded_key

def with_fingerprint(df: DataFrame, item: str, q: int = 4, n_bits: int = CLUSTER_BITS, on_invalid="empty") -> DataFrame:
    return df.withColumn("bits", shingle_fingerprint(F.col(item), q, n_bits, on_invalid))


def with_group_key(df: DataFrame, key: Column, coarse: Column | None = None) -> DataFrame:
    """Group key of an item: '' is a key like any other, null means it could not be found."""
    out = df.withColumn("group_key", key)
    return out if coarse is None else out.withColumn("group_key_coarse", coarse)


def property_table(df: DataFrame, row_id: str, properties: dict[str, Column] | None, item: str | None = None):
    """Long (id, property, value) form of the property columns."""
    props = properties or token_properties(F.col(item))
    wide = df.select(F.col(row_id).alias("id"), *[c.cast("double").alias(n) for n, c in props.items()])
    return wide.unpivot("id", list(props), "property", "value")


def distance_column(a: Column, b: Column, metric: str) -> Column:
    """Distance of two dense arrays as a SQL expression."""
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    if metric == "euclidean":
        return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, v: s + v * v))
    if metric == "cityblock":
        return F.aggregate(diff, F.lit(0.0), lambda s, v: s + F.abs(v))
    raise ValueError(f"unknown metric {metric!r}")


def drawn_rows(df: DataFrame, row_id: str, vector: str, n_samples: int, seed: int = 0) -> DataFrame:
    """(draw, vector): ``n_samples`` rows drawn with replacement by hash; draw j takes the row with the least seeded key for j.

    One pass keeps the least 60 bits of the key per draw (whole numbers, combined on the map side in n_samples
    counters); the second keeps the rows that reach them, so ties are settled by the whole key and id on a handful of rows.
    """
    draws = F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("draw")
    keyed = df.select(row_id, vector, draws).withColumn("_key", seeded_key(seed, F.col("draw"), F.col(row_id)))
    keyed = keyed.withColumn("_low", F.conv(F.substring("_key", 1, 15), 16, 10).cast("bigint"))
    least = keyed.groupBy("draw").agg(F.min("_low").alias("_low"))
    best = keyed.join(F.broadcast(least), ["draw", "_low"])  # n_samples rows
    return best.groupBy("draw").agg(F.min_by(vector, F.struct("_key", row_id)).alias(vector))


def kernel_map(
    df: DataFrame, row_id: str, vector: str, n_samples: int, metric: str = "euclidean", seed: int = 0
) -> DataFrame:
    """Replace features by the distances to ``n_samples`` reference rows.

    The drawn rows reach the map as a scalar subquery, so nothing is joined: every task holds n_samples vectors, as
    every row of the result holds n_samples distances.
    """
    if n_samples < 1:
        raise ValueError("n_samples must be at least 1")
    drawn = drawn_rows(df, row_id, vector, n_samples, seed).withColumnRenamed(vector, "_v")
    refs = drawn.agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", "_v"))), lambda r: r["_v"]).alias("refs"))
    mapped = df.select(row_id, vector).withColumn("_refs", refs.scalar())
    return mapped.select(
        row_id,
        F.transform("_refs", lambda r: distance_column(F.col(vector), r, metric)).alias("features"),
    )


def bits_to_vector(df: DataFrame, bits: str, n_bits: int, out: str = "features") -> DataFrame:
    """Sparse 0/1 vector of a bit set for ``pyspark.ml``, built on the JVM side."""
    vocabulary = [str(i) for i in range(n_bits)]
    model = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_tokens", outputCol=out, minTF=1.0)
    model.setBinary(True)
    return model.transform(df.withColumn("_tokens", F.col(bits).cast("array<string>"))).drop("_tokens")


def dense_to_vector(df: DataFrame, vector: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(vector).cast("array<double>")))


def project(df: DataFrame, row_id: str, features: str, k: int = 2) -> DataFrame:
    """k-dimensional PCA coordinates, sign fixed so that the largest loading is positive."""
    model = PCA(k=k, inputCol=features, outputCol="_pc").fit(df)
    loadings = model.pc.toArray()
    signs = [float(1 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1) for j in range(k)]
    coords = model.transform(df).select(row_id, vector_to_array("_pc").alias("_pc"))
    return coords.select(row_id, *[(F.get("_pc", F.lit(j)) * F.lit(signs[j])).alias(f"x{j + 1}") for j in range(k)])
