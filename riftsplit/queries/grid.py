"""ID/OOD grid analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from riftsplit.operators import grid
from riftsplit.queries.base import (
    DATASETS,
    FAMILIES,
    PERMUTATIONS,
    PREDICTIONS,
    RESULTS,
    predictions,
    query,
    r6,
    results,
    rounded,
    sql_fisher_two,
    sql_normal_p,
    sql_student_p,
    table,
)
from riftsplit.queries.metrics import agreement_sql

_G = "(ID_test_roc_auc - OOD_test_roc_auc)"
_R = f"WITH {RESULTS}"
SPLITS = ["A", "N", "R"]


@query(
    "h1_results_fact",
    f"""WITH {PREDICTIONS}, p AS (SELECT 'all' AS dataset, 'by_user' AS split, m.m AS model, g AS repeat, id, y_true, CASE WHEN m.m = 1 THEN y_pred ELSE 1 - y_pred END AS s FROM pred, (SELECT unnest([1, 2]) AS m) m),
        c AS (SELECT dataset, split, model, repeat, s, sum(y_true) AS p, count(*) AS n FROM p GROUP BY ALL),
        u AS (SELECT *, CAST(sum(p) OVER up AS DOUBLE) AS cp, CAST(sum(n) OVER up AS DOUBLE) AS cn, CAST(sum(p) OVER dn AS DOUBLE) AS tp, CAST(sum(n) OVER dn AS DOUBLE) AS ta, CAST(sum(p) OVER g AS DOUBLE) AS pp, CAST(sum(n) OVER g AS DOUBLE) AS nn
          FROM c WINDOW up AS (PARTITION BY model, repeat ORDER BY s), dn AS (PARTITION BY model, repeat ORDER BY s DESC), g AS (PARTITION BY model, repeat)),
        a AS (SELECT model, repeat, avg(CASE WHEN (s >= 0.5) = (y_true = 1) THEN 1.0 ELSE 0.0 END) AS acc, avg(s) AS ms, count(*) AS n FROM p GROUP BY ALL)
        SELECT dataset, split, u.model, u.repeat, {r6("max(a.ms)")} AS ID_test_roc_auc, {r6("max(a.acc)")} AS OOD_test_accuracy,
        {r6("sum(p * ((cn - cp - (u.n - p)) + (u.n - p) / 2.0)) / (max(pp) * (max(nn) - max(pp)))")} AS OOD_test_roc_auc, {r6("sum(tp / ta * p) / max(pp)")} AS OOD_test_pr_auc, max(a.n) AS test_size
        FROM u JOIN a ON a.model = u.model AND a.repeat = u.repeat GROUP BY dataset, split, u.model, u.repeat""",
)
def results_fact(spark, sf_dir):
    """Two models (a score and its reverse) on the four user groups as repeats."""
    base = predictions(spark, sf_dir).select(
        F.lit("all").alias("dataset"), F.lit("by_user").alias("split"), F.col("g").alias("repeat"), "id", "y_true", "y_pred"
    )
    truths = base.drop("y_pred")
    both = base.drop("y_true").withColumn("model", F.explode(F.lit([1, 2])))
    preds = both.withColumn("y_pred", F.when(F.col("model") == 1, F.col("y_pred")).otherwise(1.0 - F.col("y_pred")))
    id_metrics = preds.groupBy(*grid.RUN).agg(F.avg("y_pred").alias("ID_test_roc_auc"))
    out = grid.results_fact(preds, truths, id_metrics)
    return rounded(out, "ID_test_roc_auc", "OOD_test_accuracy", "OOD_test_roc_auc", "OOD_test_pr_auc")


@query(
    "h2_mean_difference",
    f"{_R} SELECT model, {r6('avg(ID_test_accuracy - OOD_test_accuracy)')} AS diff_accuracy, {r6(f'avg{_G}')} AS diff_roc_auc FROM res GROUP BY model",
)
def mean_difference(spark, sf_dir):
    out = grid.mean_difference(results(spark, sf_dir), "model", ["accuracy", "roc_auc"])
    return rounded(out, "diff_accuracy", "diff_roc_auc")


@query("h3_model_family", f"{_R} SELECT family, count(*) AS n, count(DISTINCT model) AS n_models FROM res GROUP BY family")
def model_family(spark, sf_dir):
    fact = results(spark, sf_dir)
    models = fact.select("model", "family").distinct()
    out = grid.with_family(fact.drop("family"), models).groupBy("family", "model").agg(F.count(F.lit(1)).alias("c"))
    return out.groupBy("family").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_models"))


def _cells(keys: str) -> str:
    cell = lambda c: f"printf('%.2f (%.2f)', avg({c}), stddev_samp({c}))"
    return f"""{_R}, c AS (SELECT {keys}, dataset, {cell("ID_test_roc_auc")} AS m0, {cell("OOD_test_roc_auc")} AS m1, {cell(_G)} AS m2 FROM res GROUP BY {keys}, dataset),
      l AS (SELECT {keys}, dataset, 'Test (ID)' AS performance, m0 AS cell FROM c UNION ALL SELECT {keys}, dataset, 'Test (OOD)', m1 FROM c UNION ALL SELECT {keys}, dataset, 'Gap', m2 FROM c)
      SELECT {keys}, performance, max(cell) FILTER (WHERE dataset = 'F') AS "F", max(cell) FILTER (WHERE dataset = 'O') AS "O" FROM l GROUP BY {keys}, performance"""


@query("h4_gap_table", _cells("split"))
def gap_table(spark, sf_dir):
    return grid.gap_table(results(spark, sf_dir), DATASETS)


@query("h5_gap_table_by_family", _cells("split, family"))
def gap_table_by_family(spark, sf_dir):
    return grid.gap_table(results(spark, sf_dir), DATASETS, keys=["split", "family"])


@query(
    "h5_gap_rollup",
    f"""{_R} SELECT split, dataset, family, {r6(f"avg{_G}")} AS mean_gap, {r6(f"stddev_samp{_G}")} AS std_gap, count(*) AS n, CAST(grouping(family) AS INTEGER) AS is_total
        FROM res GROUP BY GROUPING SETS ((split, dataset, family), (split, dataset))""",
)
def gap_rollup(spark, sf_dir):
    return rounded(grid.gap_rollup(results(spark, sf_dir)), "mean_gap", "std_gap")


def _pivot(row: str, cell: str) -> str:
    cols = ", ".join(f"{r6(cell.replace('@', f'FILTER (WHERE split = {chr(39)}{s}{chr(39)})'))} AS \"{s}\"" for s in SPLITS)
    return f"{_R} SELECT {row}, {cols} FROM res GROUP BY {row}"


_MATRICES = {
    "h6_difference_matrix": ("dataset", "avg(ID_test_roc_auc) @ - avg(OOD_test_roc_auc) @", {"report": "diff"}),
    "h6_difference_matrix_percent": (
        "model",
        "(avg(ID_test_roc_auc) @ - avg(OOD_test_roc_auc) @) / avg(ID_test_roc_auc) @ * 100",
        {"report": "diff", "percent": True},
    ),
    "h6_id_matrix": ("model", "avg(ID_test_roc_auc) @", {"report": "id"}),
    "h6_ood_matrix": ("dataset", "avg(OOD_test_roc_auc) @", {"report": "ood"}),
}


def _matrix_query(name: str, row: str, cell: str, options: dict):
    @query(name, _pivot(row, cell))
    def run(spark, sf_dir):
        return rounded(grid.score_matrix(results(spark, sf_dir), row, "split", SPLITS, **options), *SPLITS)

    return run


for _n, (_row, _cell, _opt) in _MATRICES.items():
    _matrix_query(_n, _row, _cell, _opt)


@query(
    "h7_family_difference",
    f"{_R}, m AS (SELECT family, model, avg{_G} AS d FROM res GROUP BY ALL) SELECT family, {r6('avg(d)')} AS mean_difference, count(*) AS n_models FROM m GROUP BY family",
)
def family_difference(spark, sf_dir):
    return rounded(grid.family_difference(results(spark, sf_dir)), "mean_difference")


@query("h8_difference_by_keys", f"{_R} SELECT split, family, dataset, {r6(f'avg{_G}')} AS difference FROM res GROUP BY ALL")
def difference_by(spark, sf_dir):
    return rounded(grid.difference_by(results(spark, sf_dir), ["split", "family", "dataset"]), "difference")


@query(
    "h9_tidy",
    f"{_R} SELECT dataset, split, model, variable, count(*) AS n, {r6('sum(value)')} AS total FROM res UNPIVOT (value FOR variable IN (ID_test_roc_auc, OOD_test_roc_auc)) GROUP BY ALL",
)
def tidy(spark, sf_dir):
    long = grid.tidy(results(spark, sf_dir), ["dataset", "split", "model"], ["ID_test_roc_auc", "OOD_test_roc_auc"])
    out = long.groupBy("dataset", "split", "model", "variable").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rounded(out, "total")


@query(
    "h10_side_by_side",
    f"""{_R}, m AS (SELECT dataset, split, model, repeat, avg(ID_test_roc_auc) AS x, avg(OOD_test_roc_auc) AS y FROM res GROUP BY ALL)
        SELECT a.model, a.repeat, {r6("a.x")} AS ID_test_roc_auc_A, {r6("a.y")} AS OOD_test_roc_auc_A, {r6("b.x")} AS ID_test_roc_auc_R, {r6("b.y")} AS OOD_test_roc_auc_R
        FROM m a JOIN m b ON a.model = b.model AND a.repeat = b.repeat AND a.dataset = b.dataset WHERE a.split = 'A' AND b.split = 'R' AND a.dataset = 'F'""",
)
def side_by_side(spark, sf_dir):
    runs = results(spark, sf_dir).groupBy("dataset", "split", "model", "repeat").agg(
        F.avg("ID_test_roc_auc").alias("ID_test_roc_auc"), F.avg("OOD_test_roc_auc").alias("OOD_test_roc_auc")
    )
    out = grid.side_by_side(runs, "F", "A", "R", ["ID_test_roc_auc", "OOD_test_roc_auc"])
    return rounded(out, *[c for c in out.columns if c.startswith(("ID", "OOD"))])


_CORR = "corr(ID_test_roc_auc, OOD_test_roc_auc)"


@query(
    "h11_correlation_matrix",
    f"{_R} SELECT split, " + ", ".join(r6(f"{_CORR} FILTER (WHERE family = '{f}')") + f" AS {f}" for f in FAMILIES) + " FROM res GROUP BY split",
)
def correlation_matrix(spark, sf_dir):
    return rounded(grid.correlation_matrix(results(spark, sf_dir), FAMILIES), *FAMILIES)


_FITS = f"""{_R}, l AS (SELECT dataset, split, family, 'accuracy' AS metric, ID_test_accuracy AS x, OOD_test_accuracy AS y FROM res
  UNION ALL SELECT dataset, split, family, 'roc_auc', ID_test_roc_auc, OOD_test_roc_auc FROM res),
  f AS (SELECT dataset, split, family, metric, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r_squared FROM l GROUP BY ALL)"""


@query("h12_slopes", f"{_FITS} SELECT dataset, split, family, metric, {r6('slope')} AS slope, {r6('intercept')} AS intercept, {r6('r_squared')} AS r_squared FROM f")
def slopes(spark, sf_dir):
    return rounded(grid.slopes(results(spark, sf_dir), ["accuracy", "roc_auc"]), "slope", "intercept", "r_squared")


@query(
    "h12_slope_table",
    f"""{_FITS} SELECT split, family, metric, max(printf('%.2f (%.2f)', slope, r_squared)) FILTER (WHERE dataset = 'F') AS "F",
        max(printf('%.2f (%.2f)', slope, r_squared)) FILTER (WHERE dataset = 'O') AS "O" FROM f GROUP BY ALL""",
)
def slope_table(spark, sf_dir):
    return grid.slope_table(grid.slopes(results(spark, sf_dir), ["accuracy", "roc_auc"]), DATASETS)


@query(
    "h12_slope_summary",
    f"""{_FITS} SELECT split, metric, {r6("avg(slope)")} AS slope_mean, {r6("stddev_samp(slope)")} AS slope_std, {r6("avg(r_squared)")} AS r2_mean, {r6("stddev_samp(r_squared)")} AS r2_std FROM f GROUP BY ALL""",
)
def slope_summary(spark, sf_dir):
    out = grid.slope_summary(grid.slopes(results(spark, sf_dir), ["accuracy", "roc_auc"]))
    return rounded(out, "slope_mean", "slope_std", "r2_mean", "r2_std")


_COLS = ["ID_test_roc_auc", "OOD_test_roc_auc"]


@query(
    "h13_describe_by_key",
    f"{_R} SELECT split, " + ", ".join(f"{r6(f'avg({c})')} AS {c}_mean, {r6(f'stddev_samp({c})')} AS {c}_std" for c in _COLS) + " FROM res GROUP BY split",
)
def describe(spark, sf_dir):
    out = grid.describe_by(results(spark, sf_dir), ["split"], _COLS)
    return rounded(out, *[c for c in out.columns if c != "split"])


def _model_sql(fn: str, extra: str = "") -> str:
    return f"""{_R} SELECT split, model, {r6(f"{fn}(ID_test_roc_auc)")} AS id_score, {r6(f"{fn}(OOD_test_roc_auc)")} AS ood_score,
      {r6(f"{fn}(ID_test_roc_auc) - {fn}(OOD_test_roc_auc)")} AS gap {extra} FROM res GROUP BY split, model"""


@query("h14_model_table_mean", _model_sql("avg", f", {r6('stddev_samp(ID_test_roc_auc)')} AS id_std, {r6('stddev_samp(OOD_test_roc_auc)')} AS ood_std"))
def model_table_mean(spark, sf_dir):
    return rounded(grid.model_table(results(spark, sf_dir)), "id_score", "ood_score", "gap", "id_std", "ood_std")


@query("h14_model_table_median", _model_sql("median", ", model AS ord"))
def model_table_median(spark, sf_dir):
    fact = results(spark, sf_dir)
    order = fact.select("model").distinct().withColumn("ord", F.col("model"))
    return rounded(grid.model_table(fact, agg="median", models=order), "id_score", "ood_score", "gap")


def _conditions(spark, sf_dir):
    """Score of each model (category) under each split (condition)."""
    return results(spark, sf_dir).groupBy(F.col("split").alias("condition"), F.col("model").alias("category")).agg(
        F.avg("OOD_test_accuracy").alias("value")
    )


@query(
    "h16_condition_agreement",
    f"""WITH RECURSIVE {PERMUTATIONS}, {RESULTS}, v AS (SELECT split AS condition, model AS category, avg(OOD_test_accuracy) AS value FROM res GROUP BY ALL),
        o AS (SELECT *, rank() OVER (PARTITION BY condition ORDER BY value DESC) + (count(*) OVER (PARTITION BY condition, value) - 1) / 2.0 AS r FROM v),
        p AS (SELECT a.condition AS c1, b.condition AS c2, a.category, a.r AS rank_1, b.r AS rank_2 FROM o a JOIN o b ON a.category = b.category AND a.condition < b.condition),
        {agreement_sql("c1, c2", "p", "category")}""",
)
def condition_agreement(spark, sf_dir):
    out = grid.condition_agreement(_conditions(spark, sf_dir))
    return rounded(out, "spearman", "spearman_p_value", "kendall_tau", "kendall_p_value", "footrule")


@query(
    "h17_shared_item_matrix",
    "SELECT a.p_brand AS d1, b.p_brand AS d2, count(*) AS n_shared FROM part a JOIN (SELECT DISTINCT p_brand, p_name FROM part) b ON a.p_name = b.p_name GROUP BY ALL",
)
def shared_items(spark, sf_dir):
    return grid.shared_items(table(spark, sf_dir, "part"), "p_brand", "p_name")


@query(
    "h18_running_intersection",
    """WITH x AS (SELECT DISTINCT year(o_orderdate) AS y, o_custkey AS c FROM orders), o AS (SELECT y, row_number() OVER (ORDER BY y) AS step FROM (SELECT DISTINCT y FROM x)),
       h AS (SELECT o.step, o.y, p.c FROM o JOIN o q ON q.step <= o.step JOIN x p ON p.y = q.y GROUP BY o.step, o.y, p.c HAVING count(*) = o.step)
       SELECT CAST(step AS INTEGER) AS step, CAST(y AS INTEGER) AS dataset, count(*) AS n_items FROM h GROUP BY ALL""",
)
def running_intersection(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), "o_custkey")
    return grid.running_intersection(o, "y", "o_custkey")


@query("h19_only_in_first", "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def only_in_first(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return grid.only_in_first(table(spark, sf_dir, "part").select("p_partkey", "p_name"), li, "p_partkey")


@query(
    "h20_t_statistics",
    f"""{_R} SELECT dataset, split, {r6(f"avg{_G}")} AS mean_difference, {r6(f"avg{_G} / (stddev_samp{_G} / sqrt(count(*)))")} AS t_statistic, count(*) AS n
        FROM res WHERE split <> 'N' GROUP BY ALL""",
)
def t_statistics(spark, sf_dir):
    out = grid.t_tests(results(spark, sf_dir), left_out="N").select("dataset", "split", "mean_difference", "t_statistic", "n")
    return rounded(out, "mean_difference", "t_statistic")


@query(
    "h20_t_tests",
    f"""{_R}, runs AS (SELECT dataset, split, repeat, model, avg(ID_test_accuracy) - avg(OOD_test_accuracy) AS d FROM res WHERE split <> 'N' GROUP BY ALL),
        s AS (SELECT dataset, split, avg(d) AS mean_difference, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t, count(*) AS n FROM runs GROUP BY ALL),
        p AS (SELECT *, {sql_student_p("t", "(n - 1)")} AS p, count(*) OVER () AS m FROM s)
        SELECT dataset, split, {r6("mean_difference")} AS mean_difference, {r6("t")} AS t_statistic, n, {r6("p")} AS p_value, {r6("p * m")} AS p_value_corrected, p * m < 0.05 AS significant FROM p""",
)
def t_tests(spark, sf_dir):
    runs = results(spark, sf_dir).groupBy("dataset", "split", "repeat", "model").agg(
        F.avg("ID_test_accuracy").alias("ID_test_roc_auc"), F.avg("OOD_test_accuracy").alias("OOD_test_roc_auc")
    )
    return rounded(grid.t_tests(runs, left_out="N"), "mean_difference", "t_statistic", "p_value", "p_value_corrected")


@query(
    "h21_anova_f",
    f"""{_R}, d AS (SELECT split, family, {_G} AS d FROM res), g AS (SELECT split, avg(d) AS gm, count(*) AS nn FROM d GROUP BY split),
        f AS (SELECT split, family, avg(d) AS m, count(*) AS n, var_pop(d) * count(*) AS w FROM d GROUP BY ALL),
        k AS (SELECT split, (sum(n * pow(m - gm, 2)) / (count(*) - 1)) / (sum(w) / (max(nn) - count(*))) AS f FROM f JOIN g USING (split) GROUP BY split)
        SELECT split, round(f, 5) AS f_stat FROM k""",
)
def anova_f(spark, sf_dir):
    return grid.anova(results(spark, sf_dir)).select("split", F.round("f_stat", 5).alias("f_stat"))


@query(
    "h21_anova",
    f"""{_R}, d AS (SELECT split, family, {_G} AS d FROM res), g AS (SELECT split, avg(d) AS gm, count(*) AS nn FROM d GROUP BY split),
        f AS (SELECT split, family, avg(d) AS m, count(*) AS n, var_pop(d) * count(*) AS w FROM d GROUP BY ALL),
        k AS (SELECT split, (sum(n * pow(m - gm, 2)) / (count(*) - 1)) / (sum(w) / (max(nn) - count(*))) AS f, max(nn) - count(*) AS d2, count(*) AS k FROM f JOIN g USING (split) GROUP BY split)
        SELECT split, {r6("f")} AS f_stat, {r6(sql_fisher_two("f", "d2"))} AS p_value, {sql_fisher_two("f", "d2")} < 0.01 AS is_significant FROM k WHERE k = 3""",
)
def anova(spark, sf_dir):
    return rounded(grid.anova(results(spark, sf_dir)), "f_stat", "p_value")


_FISHER = f"{_R}, c AS (SELECT split, family, {_CORR} AS r, count(*) AS n FROM res GROUP BY ALL)"
_EFFECT = "CASE WHEN abs(r) < 0.1 THEN 'Negligible' WHEN abs(r) < 0.3 THEN 'Small' WHEN abs(r) < 0.5 THEN 'Medium' WHEN abs(r) < 0.7 THEN 'Large' ELSE 'Very Large' END"


def _significance(spark, sf_dir):
    return grid.correlation_significance(grid.correlations(results(spark, sf_dir), ["split", "family"]))


@query(
    "h22_correlation_intervals",
    f"""{_FISHER} SELECT split, family, {r6("r")} AS r, n, {r6("atanh(r) * sqrt(n - 3)")} AS z_score, {r6("tanh(atanh(r) - CAST(1.959963984540054 AS DOUBLE) / sqrt(n - 3))")} AS ci_lower,
        {r6("tanh(atanh(r) + CAST(1.959963984540054 AS DOUBLE) / sqrt(n - 3))")} AS ci_upper, {_EFFECT} AS effect_size FROM c""",
)
def correlation_intervals(spark, sf_dir):
    out = _significance(spark, sf_dir).drop("p_value", "significant")
    return rounded(out, "r", "z_score", "ci_lower", "ci_upper")


@query(
    "h22_correlation_significance",
    f"""{_FISHER}, z AS (SELECT split, family, atanh(r) * sqrt(n - 3) AS z FROM c)
        SELECT split, family, {r6("z")} AS z_score, {r6(sql_normal_p("z"))} AS p_value, {sql_normal_p("z")} < 0.05 AS significant FROM z""",
)
def correlation_significance(spark, sf_dir):
    return rounded(_significance(spark, sf_dir).select("split", "family", "z_score", "p_value", "significant"), "z_score", "p_value")


@query(
    "h22_effect_counts",
    f"""{_FISHER} SELECT family, """
    + ", ".join(f"count(*) FILTER (WHERE {_EFFECT} = '{e}') AS \"{e}\"" for e in ["Negligible", "Small", "Medium", "Large", "Very Large"])
    + " FROM c GROUP BY family",
)
def effect_counts(spark, sf_dir):
    return grid.effect_counts(_significance(spark, sf_dir))


@query(
    "h22_compare_correlations",
    f"""{_FISHER} SELECT a.split, a.family AS g1, b.family AS g2, {r6("(atanh(a.r) - atanh(b.r)) / sqrt(1.0 / (a.n - 3) + 1.0 / (b.n - 3))")} AS z_diff FROM c a JOIN c b ON a.split = b.split AND a.family < b.family""",
)
def compare_correlations(spark, sf_dir):
    out = grid.compare_correlations(grid.correlations(results(spark, sf_dir), ["split", "family"]))
    return rounded(out.select("split", "g1", "g2", "z_diff"), "z_diff")


@query(
    "h23_score_hit_correlation",
    f"""{_R}, k AS (SELECT split, ID_test_accuracy AS x, OOD_test_accuracy AS y FROM res),
        r AS (SELECT *, rank() OVER (PARTITION BY split ORDER BY x DESC) + (count(*) OVER (PARTITION BY split, x) - 1) / 2.0 AS rx,
          rank() OVER (PARTITION BY split ORDER BY y DESC) + (count(*) OVER (PARTITION BY split, y) - 1) / 2.0 AS ry FROM k)
        SELECT split, {r6("corr(x, y)")} AS pearson, {r6("corr(rx, ry)")} AS spearman, count(*) AS n FROM r GROUP BY split""",
)
def score_hit_correlation(spark, sf_dir):
    out = grid.score_hit_correlation(results(spark, sf_dir), "split", "ID_test_accuracy", "OOD_test_accuracy")
    return rounded(out, "pearson", "spearman")


@query(
    "h24_drop_against_baseline",
    f"""{_R}, s AS (SELECT dataset, split, avg(ID_test_roc_auc) AS score FROM res GROUP BY ALL), b AS (SELECT dataset, score AS base FROM s WHERE split = 'N')
        SELECT dataset, split, {r6("score")} AS score, {r6("base - score")} AS "drop" FROM s JOIN b USING (dataset) WHERE split <> 'N'""",
)
def drop_against_baseline(spark, sf_dir):
    scores = results(spark, sf_dir).groupBy("dataset", "split").agg(F.avg("ID_test_roc_auc").alias("score"))
    return rounded(grid.drop_against_baseline(scores, "split", "score", "N", ["dataset"]), "score", "drop")


@query(
    "h25_scaled_medians",
    f"""WITH l AS (SELECT p_brand AS dataset, property, value FROM (SELECT p_brand, p_retailprice AS Molecular_Weight, CAST(p_size AS DOUBLE) AS p_size FROM part) UNPIVOT (value FOR property IN (Molecular_Weight, p_size))),
        m AS (SELECT dataset, property, median(value) AS md FROM l GROUP BY ALL),
        s AS (SELECT *, CASE WHEN property = 'Molecular_Weight' THEN (md - 160) / 320.0 ELSE (md - min(md) OVER (PARTITION BY property)) / (max(md) OVER (PARTITION BY property) - min(md) OVER (PARTITION BY property)) END AS sc FROM m)
        SELECT dataset, property, round(CAST(md AS DOUBLE), 9) AS median, round(CAST(sc AS DOUBLE), 9) AS scaled, round(CAST(median(sc) OVER (PARTITION BY property) AS DOUBLE), 9) AS property_median,
        round(CAST(quantile_cont(sc, 0.75) OVER (PARTITION BY property) - quantile_cont(sc, 0.25) OVER (PARTITION BY property) AS DOUBLE), 9) AS property_iqr FROM s""",
)
def scaled_medians(spark, sf_dir):
    wide = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("dataset"), F.col("p_retailprice").alias("Molecular_Weight"), F.col("p_size").cast("double").alias("p_size")
    )
    long = wide.unpivot("dataset", ["Molecular_Weight", "p_size"], "property", "value")
    out = grid.scaled_medians(long)
    return out.withColumns({c: F.round(c, 9) for c in ("median", "scaled", "property_median", "property_iqr")})


@query(
    "h26_sample_per_group",
    """SELECT p_partkey, p_brand FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5('0:0:' || p_partkey)) AS rk, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE n > 78 AND rk <= 12""",
)
def sample_per_group(spark, sf_dir):
    return grid.sample_per_group(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey", "p_brand", 12, 78)


@query("h27_above_threshold", f"{_R} SELECT dataset, split, count(*) AS n, {r6('avg(OOD_test_roc_auc)')} AS ood FROM res WHERE ID_test_roc_auc > 0.05 GROUP BY ALL")
def above_threshold(spark, sf_dir):
    kept = grid.above_threshold(results(spark, sf_dir), threshold=0.05)
    return rounded(kept.groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("n"), F.avg("OOD_test_roc_auc").alias("ood")), "ood")


@query(
    "h28_drops",
    f"""{_R} SELECT dataset, {r6("avg(ID_test_roc_auc)")} AS id_mean, {r6("avg(OOD_test_roc_auc)")} AS ood_mean, {r6("avg(ID_test_roc_auc) - avg(OOD_test_roc_auc)")} AS "drop",
        {r6("(avg(ID_test_roc_auc) - avg(OOD_test_roc_auc)) / avg(ID_test_roc_auc) * 100")} AS drop_percent FROM res GROUP BY dataset""",
)
def drops(spark, sf_dir):
    return rounded(grid.drops(results(spark, sf_dir)), "id_mean", "ood_mean", "drop", "drop_percent")
