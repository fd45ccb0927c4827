"""Feature columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from riftsplit.functions.bits import CLUSTER_BITS
from riftsplit.operators import features as ft
from riftsplit.queries.base import query, r6, rounded, seeded_sql, table


@query(
    "c1_shingle_fingerprint",
    f"""WITH c AS (SELECT doc_id, list_transform(string_split(text, ''), lambda x: CAST(unicode(x) AS BIGINT)) AS u FROM documents WHERE length(text) >= 4),
        b AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(u) - 2),
          lambda i: CAST((u[i] * 29791 + u[i+1] * 961 + u[i+2] * 31 + u[i+3]) % {CLUSTER_BITS} AS INTEGER)))) AS bit FROM c)
        SELECT d.doc_id, count(bit) AS n_bits, coalesce(sum(bit), 0)::BIGINT AS bit_sum, coalesce(sum(bit * bit), 0)::BIGINT AS bit_squares
        FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id GROUP BY d.doc_id""",
)
def shingles(spark, sf_dir):
    fp = ft.with_fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    total = lambda f: F.aggregate("bits", F.lit(0).cast("bigint"), f)
    return fp.select(
        "doc_id", F.size("bits").cast("bigint").alias("n_bits"),
        total(lambda a, b: a + b).alias("bit_sum"), total(lambda a, b: a + b.cast("bigint") * b).alias("bit_squares"),
    )


@query("c4_group_key", "SELECT p_brand AS group_key, count(*) AS n FROM part GROUP BY p_brand")
def group_keys(spark, sf_dir):
    keyed = ft.with_group_key(table(spark, sf_dir, "part"), F.col("p_brand"))
    return keyed.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c5_generic_group_key",
    "SELECT p_brand AS group_key, split_part(p_type, ' ', 1) AS group_key_coarse, count(*) AS n FROM part GROUP BY 1, 2",
)
def coarse_keys(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    keyed = ft.with_group_key(part, F.col("p_brand"), F.get(F.split("p_type", " "), F.lit(0)))
    return keyed.groupBy("group_key", "group_key_coarse").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c6_properties",
    r"""WITH p AS (SELECT doc_id AS id, CAST(length(text) AS DOUBLE) AS n_chars,
        CAST(len(regexp_extract_all(text, '[A-Za-z]+')) AS DOUBLE) AS n_words,
        CAST(len(regexp_extract_all(text, '[0-9]')) AS DOUBLE) AS n_digits,
        CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS DOUBLE) AS n_lines FROM documents)
        SELECT id, property, value FROM p UNPIVOT (value FOR property IN (n_chars, n_words, n_digits, n_lines))""",
)
def properties(spark, sf_dir):
    return ft.property_table(table(spark, sf_dir, "documents"), "doc_id", None, "text")


N_REFS = 8
_DRAW = seeded_sql(0, "CAST(j.j AS VARCHAR)", "CAST(vec_id AS VARCHAR)")


@query(
    "c7_kernel_map",
    f"""WITH refs AS (SELECT j.j AS j, arg_min(embedding, {_DRAW}) AS r FROM embeddings, range({N_REFS}) j(j) GROUP BY j.j)
        SELECT e.vec_id, CAST(refs.j AS INTEGER) AS ref_no, {r6(
            "sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(e.embedding[i] AS DOUBLE) - CAST(refs.r[i] AS DOUBLE), 2))))"
        )} AS distance
        FROM embeddings e, refs""",
)
def kernel_features(spark, sf_dir):
    mapped = ft.kernel_map(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", N_REFS)
    long = mapped.select("vec_id", F.posexplode("features").alias("ref_no", "distance"))
    return rounded(long, "distance")


@query("c9_pca_projection")
def pca_map(spark, sf_dir):
    points = ft.dense_to_vector(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    return rounded(ft.project(points, "vec_id", "features", 2), "x1", "x2")
