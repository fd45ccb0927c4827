"""Registry of queries and the shared table views and SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftsplit.plans.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a name, with its SQL twin if there is one."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Round doubles, so that sums taken in another order agree."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), DIGITS) for c in columns})


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), {DIGITS})"


# -- shared views -------------------------------------------------------------------


def predictions(spark, sf_dir) -> DataFrame:
    """events as predictions: purchase is the positive class, the value a squashed score."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 4).cast("int").alias("g"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("y_true"),
        (F.col("value") / (F.col("value") + F.lit(50.0))).alias("y_pred"),
    )


PREDICTIONS = """pred AS (SELECT event_id AS id, CAST(user_id % 4 AS INTEGER) AS g,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y_true,
  value / (value + CAST(50 AS DOUBLE)) AS y_pred FROM events)"""


def results(spark, sf_dir) -> DataFrame:
    """lineitem as the results fact table."""
    li = table(spark, sf_dir, "lineitem")
    m = F.col("l_linenumber")
    return li.select(
        F.col("l_linestatus").alias("dataset"),
        F.col("l_returnflag").alias("split"),
        m.alias("model"),
        (F.col("l_suppkey") % 10).cast("int").alias("repeat"),
        F.when(m <= 3, "classical").when(m <= 5, "graph").otherwise("pretrained").alias("family"),
        F.col("l_discount").alias("ID_test_roc_auc"),
        F.col("l_tax").alias("OOD_test_roc_auc"),
        (F.col("l_quantity") / 50.0).alias("ID_test_accuracy"),
        (F.col("l_extendedprice") / 100000.0).alias("OOD_test_accuracy"),
    )


RESULTS = """res AS (SELECT l_linestatus AS dataset, l_returnflag AS split, l_linenumber AS model,
  CAST(l_suppkey % 10 AS INTEGER) AS repeat,
  CASE WHEN l_linenumber <= 3 THEN 'classical' WHEN l_linenumber <= 5 THEN 'graph' ELSE 'pretrained' END AS family,
  l_discount AS ID_test_roc_auc, l_tax AS OOD_test_roc_auc,
  l_quantity / CAST(50 AS DOUBLE) AS ID_test_accuracy, l_extendedprice / CAST(100000 AS DOUBLE) AS OOD_test_accuracy
  FROM lineitem)"""

DATASETS = ["F", "O"]
FAMILIES = ["classical", "graph", "pretrained"]
BITS = 64


def sign_items(spark, sf_dir) -> DataFrame:
    """embeddings as items with a 64-bit fingerprint (signs of the vector)."""
    from riftsplit.functions.bits import sign_bits

    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), sign_bits(F.col("embedding")).alias("bits"), F.col("label"))


SIGNS = """bits AS (SELECT vec_id AS id, label,
  list_filter(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN i - 1 ELSE NULL END), lambda x: x IS NOT NULL) AS b
  FROM embeddings)"""

# unordered pairs with their set similarity
SIGN_PAIRS = (
    SIGNS
    + """, pairs AS (SELECT x.id AS i, y.id AS j, x.label AS li, y.label AS lj,
  len(list_intersect(x.b, y.b)) / CAST(len(x.b) + len(y.b) - len(list_intersect(x.b, y.b)) AS DOUBLE) AS sim
  FROM bits x JOIN bits y ON x.id < y.id)"""
)


def labelled_documents(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    return d.join(table(spark, sf_dir, "labels"), "doc_id")


def seeded_sql(seed: int, split: str, row_id: str) -> str:
    """md5 order of the seeded shuffle."""
    return f"md5('{seed}:' || {split} || ':' || {row_id})"


def random_sql(source: str, row_id: str, n_splits: int, test: float = 0.2, seed: int = 0) -> str:
    key = seeded_sql(seed, "CAST(s.s AS VARCHAR)", f"CAST({row_id} AS VARCHAR)")
    return f"""SELECT CAST(s.s AS INTEGER) AS split_index, {row_id} AS id,
      CASE WHEN row_number() OVER (PARTITION BY s.s ORDER BY {key})
        <= ceil(CAST({test} AS DOUBLE) * count(*) OVER (PARTITION BY s.s)) THEN 'test' ELSE 'train' END AS "set"
      FROM {source}, range({n_splits}) s(s)"""


def group_sql(source: str, row_id: str, group: str, n_splits: int, test: float = 0.2, seed: int = 0) -> str:
    key = seeded_sql(seed, "CAST(s.s AS VARCHAR)", "g.g")
    return f"""SELECT CAST(r.s AS INTEGER) AS split_index, t.id,
      CASE WHEN r.rk <= ceil(CAST({test} AS DOUBLE) * r.n) THEN 'test' ELSE 'train' END AS "set"
      FROM (SELECT {row_id} AS id, CAST({group} AS VARCHAR) AS g FROM {source}) t JOIN
      (SELECT s.s, g.g, row_number() OVER (PARTITION BY s.s ORDER BY {key}) AS rk, count(*) OVER (PARTITION BY s.s) AS n
       FROM (SELECT DISTINCT CAST({group} AS VARCHAR) AS g FROM {source}) g, range({n_splits}) s(s)) r ON t.g = r.g"""


def sorted_sql(source: str, row_id: str, value: str, larger: bool, n_splits: int = 1, test: float = 0.2) -> str:
    rank = f"row_number() OVER (PARTITION BY s.s ORDER BY {value}, {row_id})"
    n = "count(*) OVER (PARTITION BY s.s)"
    n_test = f"ceil(CAST({test} AS DOUBLE) * {n})"
    cond = f"{rank} > {n} - {n_test}" if larger else f"{rank} <= {n_test}"
    return f"""SELECT CAST(s.s AS INTEGER) AS split_index, {row_id} AS id,
      CASE WHEN {cond} THEN 'test' ELSE 'train' END AS "set" FROM {source}, range({n_splits}) s(s)"""


# -- tails in SQL, by other ways than the engine's: series with lgamma, and finite sums for whole degrees of freedom


def sql_erfc(x: str) -> str:
    """Complement of the error function of a number that is not negative."""
    terms = f"list_sum(list_transform(range(0, 250), lambda i_: exp((2 * i_ + 1) * ln({x}) + i_ * ln(4.0) + lgamma(i_ + 1) - lgamma(2 * i_ + 2))))"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} < 1e-12 THEN 1.0 WHEN {x} > 7 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * exp(-({x}) * ({x})) * {terms} END)"


def sql_normal_p(z: str) -> str:
    return sql_erfc(f"(abs({z}) / sqrt(2.0))")


def sql_student_p(t: str, df: str) -> str:
    """Two-sided p for whole degrees of freedom."""
    angle = f"atan(abs({t}) / sqrt(CAST({df} AS DOUBLE)))"
    even = f"1 - sin({angle}) * list_sum(list_transform(range(0, {df} // 2), lambda k: exp(lgamma(2 * k + 1) - k * ln(4.0) - 2 * lgamma(k + 1) + 2 * k * ln(cos({angle})))))"
    odd = f"coalesce(list_sum(list_transform(range(0, ({df} - 1) // 2), lambda k: exp(k * ln(4.0) + 2 * lgamma(k + 1) - lgamma(2 * k + 2) + (2 * k + 1) * ln(cos({angle}))))), 0)"
    return f"(CASE WHEN {t} IS NULL OR {df} < 1 THEN NULL WHEN {df} % 2 = 0 THEN {even} ELSE 1 - 2 / pi() * ({angle} + sin({angle}) * {odd}) END)"


def sql_fisher_two(f: str, d2: str) -> str:
    """Upper tail for two numerator degrees of freedom."""
    return f"pow(1 + 2 * {f} / {d2}, -{d2} / 2.0)"


# shares of the permutations of k values by their inversions, k up to 33
PERMUTATIONS = """perm AS (SELECT 1 AS k, [CAST(1 AS DOUBLE)] AS c UNION ALL SELECT k + 1,
  list_transform(range(0, len(c) + k), lambda j: list_sum(c[greatest(1, j + 1 - k):least(len(c), j + 1)]) / (k + 1)) FROM perm WHERE k < 33)"""


def sql_kendall_exact(d: str, n: str) -> str:
    """Two-sided p without ties, from a row of ``perm``."""
    low = f"least({d}, {n} * ({n} - 1) // 2 - {d})"
    return f"CASE WHEN 2 * {low} = {n} * ({n} - 1) // 2 THEN 1.0 ELSE least(1.0, 2 * list_sum(perm.c[1:CAST({low} AS INTEGER) + 1])) END"


def sql_kendall_z(s: str, n: str, tx: str, ty: str) -> str:
    """Standardised sum of signs; ``tx`` and ``ty`` are lists of the sizes of groups of equal values."""
    total = lambda t, body: f"list_sum(list_transform({t}, lambda t: CAST({body} AS DOUBLE)))"
    two, three, five = "t * (t - 1) / 2", "t * (t - 1) * (t - 2)", "t * (t - 1) * (2 * t + 5)"
    var = f"""(({n} * ({n} - 1) * (2 * {n} + 5) - {total(tx, five)} - {total(ty, five)}) / 18.0 + 2 * {total(tx, two)} * {total(ty, two)} / ({n} * ({n} - 1))
      + {total(tx, three)} * {total(ty, three)} / (9.0 * {n} * ({n} - 1) * ({n} - 2)))"""
    return f"({s} / nullif(sqrt({var}), 0))"
