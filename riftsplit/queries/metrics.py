"""Prediction metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from riftsplit.operators import metrics as mt
from riftsplit.queries.base import (
    PERMUTATIONS,
    PREDICTIONS,
    predictions,
    query,
    r6,
    rounded,
    sql_erfc,
    sql_kendall_exact,
    sql_kendall_z,
    sql_normal_p,
    sql_student_p,
    table,
)

# Curves per distinct score of group g.
_CURVE = """cnt AS (SELECT g, y_pred AS s, sum(y_true) AS p, count(*) AS n FROM pred GROUP BY g, y_pred),
  cum AS (SELECT *, CAST(sum(p) OVER up AS DOUBLE) AS cp, CAST(sum(n) OVER up AS DOUBLE) AS cn, CAST(sum(p) OVER dn AS DOUBLE) AS tp, CAST(sum(n) OVER dn AS DOUBLE) AS ta,
    CAST(sum(p) OVER g AS DOUBLE) AS pp, CAST(sum(n) OVER g AS DOUBLE) AS nn FROM cnt
    WINDOW up AS (PARTITION BY g ORDER BY s), dn AS (PARTITION BY g ORDER BY s DESC), g AS (PARTITION BY g)),
  cur AS (SELECT g, sum(p * ((cn - cp - (n - p)) + (n - p) / 2.0)) / (max(pp) * (max(nn) - max(pp))) AS roc_auc,
    sum(tp / ta * p) / max(pp) AS avg_precision,
    sum(p * (tp / ta + CASE WHEN ta - n > 0 THEN (tp - p) / (ta - n) ELSE 1 END) / 2) / max(pp) AS pr_auc FROM cum GROUP BY g)"""
_CURVES = f"WITH {PREDICTIONS}, {_CURVE}"


@query(
    "g1_binary_report",
    f"""{_CURVES}, c AS (SELECT g, count(*) AS size, CAST(count_if(y_true = 1 AND y_pred >= 0.5) AS DOUBLE) AS tp, CAST(count_if(y_true = 0 AND y_pred >= 0.5) AS DOUBLE) AS fp,
        CAST(count_if(y_true = 0 AND y_pred < 0.5) AS DOUBLE) AS tn, CAST(count_if(y_true = 1 AND y_pred < 0.5) AS DOUBLE) AS fn FROM pred GROUP BY g)
        SELECT g, size, {r6("(tp + tn) / size")} AS acc, {r6("(tp / (tp + fn) + tn / (tn + fp)) / 2")} AS balanced_acc, {r6("2 * tp / (2 * tp + fp + fn)")} AS f1,
        {r6("tp / (tp + fp)")} AS prec, {r6("tp / (tp + fn)")} AS recall,
        {r6("((tp + tn) / size - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (CAST(size AS DOUBLE) * size)) / (1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (CAST(size AS DOUBLE) * size))")} AS kappa,
        {r6("roc_auc")} AS roc_auc, {r6("avg_precision")} AS avg_precision FROM c JOIN cur USING (g)""",
)
def binary_report(spark, sf_dir):
    out = mt.binary_report(predictions(spark, sf_dir), ["g"])
    return rounded(out, *[c for c in out.columns if c not in ("g", "size")])


@query("g2_roc_auc", f"{_CURVES} SELECT g, {r6('roc_auc')} AS roc_auc FROM cur")
def roc_auc(spark, sf_dir):
    return rounded(mt.roc_auc(predictions(spark, sf_dir), ["g"]), "roc_auc")


@query("g2_roc_auc_overall", f"WITH {PREDICTIONS.replace('CAST(user_id % 4 AS INTEGER)', '0')}, {_CURVE} SELECT {r6('roc_auc')} AS roc_auc FROM cur")
def roc_auc_overall(spark, sf_dir):
    return rounded(mt.roc_auc(predictions(spark, sf_dir), []), "roc_auc")


@query("g3_average_precision", f"{_CURVES} SELECT g, {r6('avg_precision')} AS avg_precision FROM cur")
def average_precision(spark, sf_dir):
    return rounded(mt.average_precision(predictions(spark, sf_dir), ["g"]), "avg_precision")


@query(
    "g4_accuracy",
    f"WITH {PREDICTIONS} SELECT g, {r6('avg(CASE WHEN (y_pred >= 0.5) = (y_true = 1) THEN 1.0 ELSE 0.0 END)')} AS acc FROM pred GROUP BY g",
)
def accuracy(spark, sf_dir):
    return rounded(mt.accuracy(predictions(spark, sf_dir), ["g"]), "acc")


def _tasks(spark, sf_dir):
    """lineitem as multi-task predictions: one task per line number, some cells masked."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("task"),
        (F.col("l_extendedprice") / 10000.0).alias("y_true"),
        (F.col("l_quantity") / 5.0 + F.col("l_discount")).alias("y_pred"),
        F.when(F.col("l_returnflag") == "A", 0).otherwise(1).alias("mask"),
    )


_TASKS = """t AS (SELECT l_linenumber AS task, l_extendedprice / CAST(10000 AS DOUBLE) AS y_true, l_quantity / CAST(5 AS DOUBLE) + l_discount AS y_pred
  FROM lineitem WHERE l_returnflag <> 'A')"""
_TASK_SQL = {"r2": "pow(corr(y_true, y_pred), 2)", "mae": "avg(abs(y_true - y_pred))", "rmse": "sqrt(avg(pow(y_true - y_pred, 2)))"}


def _task_query(metric: str):
    @query(f"g5_task_{metric}", f"WITH {_TASKS} SELECT task, {r6(_TASK_SQL[metric])} AS score FROM t GROUP BY task")
    def run(spark, sf_dir):
        return rounded(mt.task_metric(_tasks(spark, sf_dir), metric), "score")

    return run


for _m in _TASK_SQL:
    _task_query(_m)


@query(
    "g5_task_mae_reduced",
    f"WITH {_TASKS}, s AS (SELECT task, avg(abs(y_true - y_pred)) AS m FROM t GROUP BY task) SELECT 'mean' AS reduction, {r6('avg(m)')} AS score FROM s UNION ALL SELECT 'sum', {r6('sum(m)')} FROM s",
)
def task_reduced(spark, sf_dir):
    tasks = _tasks(spark, sf_dir)
    parts = [mt.task_metric(tasks, "mae", r).withColumn("reduction", F.lit(r)) for r in ("mean", "sum")]
    return rounded(parts[0].unionByName(parts[1]), "score")


def _binary_tasks(spark, sf_dir):
    """Binary tasks: returned or not, scored by the discount; task 7 has one class only."""
    yes = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") < 7)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("task"),
        F.when(yes, 1).otherwise(0).alias("y_true"),
        (F.col("l_discount") * 20.0 - 1.0).alias("y_pred"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("mask"),
    )


_BINARY_TASKS = """pred AS (SELECT l_linenumber AS g, CASE WHEN l_returnflag = 'R' AND l_linenumber < 7 THEN 1 ELSE 0 END AS y_true,
  1 / (1 + exp(-(l_discount * CAST(20 AS DOUBLE) - 1))) AS y_pred FROM lineitem WHERE l_linestatus = 'O'), pos AS (SELECT g FROM pred GROUP BY g HAVING min(y_true) < max(y_true))"""


def _binary_task_query(metric: str, column: str):
    @query(
        f"g5_task_{metric}",
        f"WITH {_BINARY_TASKS}, {_CURVE} SELECT g AS task, {r6(column)} AS score FROM cur WHERE g IN (SELECT g FROM pos)",
    )
    def run(spark, sf_dir):
        return rounded(mt.task_metric(_binary_tasks(spark, sf_dir), metric), "score")

    return run


_binary_task_query("roc_auc_score", "roc_auc")
_binary_task_query("pr_auc_score", "pr_auc")


@query(
    "g5_task_accuracy_score",
    f"WITH {_BINARY_TASKS} SELECT g AS task, {r6('avg(CASE WHEN (y_pred > 0.5) = (y_true = 1) THEN 1.0 ELSE 0.0 END)')} AS score FROM pred WHERE g IN (SELECT g FROM pos) GROUP BY g",
)
def task_accuracy(spark, sf_dir):
    return rounded(mt.task_metric(_binary_tasks(spark, sf_dir), "accuracy_score"), "score")


@query(
    "g6_denormalised_mae",
    """WITH s AS (SELECT l_linenumber AS task, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS sd FROM lineitem GROUP BY l_linenumber)
       SELECT task, round(avg(abs(l_extendedprice - ((l_quantity / CAST(25 AS DOUBLE) - 1) * sd + m))), 3) AS score FROM lineitem JOIN s ON task = l_linenumber GROUP BY task""",
)
def denormalised(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    stats = li.groupBy(F.col("l_linenumber").alias("task")).agg(
        F.avg("l_extendedprice").alias("mean"), F.stddev_samp("l_extendedprice").alias("std")
    )
    rows = li.select(
        F.col("l_linenumber").alias("task"), F.col("l_extendedprice").alias("y_true"),
        (F.col("l_quantity") / 25.0 - 1.0).alias("y_pred"), F.lit(1).alias("mask"),
    )
    return mt.task_metric(mt.denormalise(rows, stats), "mae").withColumn("score", F.round("score", 3))


@query("g7_brier_score", f"WITH {PREDICTIONS} SELECT g, {r6('avg(pow(y_pred - y_true, 2))')} AS brier FROM pred GROUP BY g")
def brier(spark, sf_dir):
    return rounded(mt.brier_score(predictions(spark, sf_dir), ["g"]), "brier")


def _bins(slot: str) -> str:
    return f"""WITH {PREDICTIONS}, b AS (SELECT g, CAST({slot} AS INTEGER) AS bin, avg(y_pred) AS p, avg(y_true) AS t, count(*) AS n FROM pred GROUP BY 1, 2)"""


# edges i * 0.1; [lo, hi) for the error, (lo, hi] for the curve
_STEP = "i * (CAST(1 AS DOUBLE) / 10)"
_ERROR_BINS = _bins(f"CASE WHEN y_pred >= 0 AND y_pred < 1 THEN len(list_filter(range(10), lambda i: {_STEP} <= y_pred)) - 1 END")
_CURVE_BINS = _bins(f"CASE WHEN y_pred BETWEEN 0 AND 1 THEN len(list_filter(range(1, 10), lambda i: {_STEP} < y_pred)) END")


@query("g8_calibration_error", f"{_ERROR_BINS} SELECT g, {r6('sum(CASE WHEN bin IS NULL THEN 0 ELSE abs(p - t) * n END) / sum(n)')} AS ece FROM b GROUP BY g")
def calibration_error(spark, sf_dir):
    return rounded(mt.calibration_error(predictions(spark, sf_dir), ["g"]), "ece")


@query("g9_calibration_curve", f"{_CURVE_BINS} SELECT g, bin, {r6('p')} AS prob_pred, {r6('t')} AS prob_true, n FROM b WHERE bin IS NOT NULL")
def calibration_curve(spark, sf_dir):
    return rounded(mt.calibration_bins(predictions(spark, sf_dir), ["g"]), "prob_pred", "prob_true")


@query(
    "g10_top_k_hit_rate",
    f"""WITH r AS (SELECT toxic AS y, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rk FROM documents JOIN labels USING (doc_id)),
        c AS (SELECT count_if(rk <= 100 AND y = 1) AS tp, count_if(rk <= 100 AND y = 0) AS fp, count_if(rk > 100 AND y = 0) AS tn, count_if(rk > 100 AND y = 1) AS fn, count(*) AS n FROM r)
        SELECT {r6("tp / 100.0")} AS hit_rate, tp AS tp_count, fp AS fp_count, tn AS tn_count, fn AS fn_count, {r6("tp / CAST(tp + fn AS DOUBLE)")} AS tpr,
        {r6("fp / CAST(fp + tn AS DOUBLE)")} AS fpr, {r6("tp / CAST(tp + fp AS DOUBLE)")} AS precision, n AS total_molecules, 100 AS top_k FROM c""",
)
def hit_rate(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return rounded(mt.hit_rate(docs, labels, "doc_id", "n_chars", "toxic", 100), "hit_rate", "tpr", "fpr", "precision")


@query(
    "g10_top_k_hit_rate_by_group",
    f"""WITH r AS (SELECT lang, toxic AS y, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rk FROM documents JOIN labels USING (doc_id)),
        c AS (SELECT lang, count_if(rk <= 20 AND y = 1) AS tp, count_if(rk <= 20 AND y = 0) AS fp, count_if(rk > 20 AND y = 0) AS tn, count_if(rk > 20 AND y = 1) AS fn, count(*) AS n FROM r GROUP BY lang)
        SELECT lang, {r6("tp / 20.0")} AS hit_rate, tp AS tp_count, fp AS fp_count, tn AS tn_count, fn AS fn_count,
        {r6("CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS DOUBLE) END")} AS tpr, {r6("CASE WHEN fp + tn = 0 THEN 0 ELSE fp / CAST(fp + tn AS DOUBLE) END")} AS fpr,
        {r6("CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END")} AS precision, n AS total_molecules, 20 AS top_k FROM c""",
)
def hit_rate_by_group(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return rounded(mt.hit_rate(docs, labels, "doc_id", "n_chars", "toxic", 20, by=["lang"]), "hit_rate", "tpr", "fpr", "precision")


@query("g10_ranked_predictions", "SELECT doc_id, toxic, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents JOIN labels USING (doc_id)")
def ranked_predictions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    ranked = mt.ranked_predictions(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "n_chars")
    return ranked.select("doc_id", "toxic", "rank")


@query(
    "g11_rescale_logit",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount,
        {r6("CASE WHEN l_discount > 0 AND l_discount < 1 THEN ln(l_discount / (1 - l_discount)) END")} AS logit FROM lineitem""",
)
def logit(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount")
    return rounded(li.withColumn("logit", mt.rescale(F.col("l_discount"), "logit")), "logit")


@query(
    "g11_rescale_probit",
    f"""WITH RECURSIVE d AS (SELECT l_discount, count(*) AS n FROM lineitem GROUP BY 1),
        b AS (SELECT l_discount, least(l_discount, 1 - l_discount) AS p, CAST(0 AS DOUBLE) AS lo, CAST(9 AS DOUBLE) AS hi, 0 AS i FROM d WHERE l_discount > 0 AND l_discount < 1
          UNION ALL SELECT l_discount, p, CASE WHEN 0.5 * {sql_erfc("((lo + hi) / 2 / sqrt(2.0))")} > p THEN (lo + hi) / 2 ELSE lo END,
            CASE WHEN 0.5 * {sql_erfc("((lo + hi) / 2 / sqrt(2.0))")} > p THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM b WHERE i < 45)
        SELECT d.l_discount, n, {r6("CASE WHEN d.l_discount > 0.5 THEN lo ELSE -lo END")} AS probit FROM d LEFT JOIN b ON b.l_discount = d.l_discount AND i = 45""",
)
def probit(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_discount").agg(F.count(F.lit(1)).alias("n"))
    return rounded(li.withColumn("probit", mt.rescale(F.col("l_discount"), "probit")), "probit")


@query(
    "g12_linear_fit",
    "SELECT l_returnflag, round(regr_intercept(l_tax, l_discount), 6) AS intercept, round(regr_slope(l_tax, l_discount), 6) AS slope, round(regr_r2(l_tax, l_discount), 6) AS r_squared FROM lineitem GROUP BY l_returnflag",
)
def linear_fit(spark, sf_dir):
    out = mt.linear_fit(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount", "l_tax")
    return rounded(out, "intercept", "slope", "r_squared")


def _nations(spark, sf_dir):
    """Two totals per nation: number of customers and of suppliers."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("v1"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("v2"))
    n = table(spark, sf_dir, "nation").join(c, "n_nationkey").join(s, "n_nationkey")
    return n.select((F.col("n_regionkey") % 2).alias("half"), "n_name", "v1", "v2")


_NATIONS = """nat AS (SELECT n_regionkey % 2 AS half, n_name, v1, v2 FROM nation
  JOIN (SELECT c_nationkey AS k, count(*) AS v1 FROM customer GROUP BY 1) c ON c.k = n_nationkey JOIN (SELECT s_nationkey AS k, count(*) AS v2 FROM supplier GROUP BY 1) s ON s.k = n_nationkey),
  rnk AS (SELECT *, rank() OVER (PARTITION BY half ORDER BY v1 DESC) + (count(*) OVER (PARTITION BY half, v1) - 1) / 2.0 AS rank_1,
    rank() OVER (PARTITION BY half ORDER BY v2 DESC) + (count(*) OVER (PARTITION BY half, v2) - 1) / 2.0 AS rank_2 FROM nat)"""


@query("g13_ranking_table", f"WITH {_NATIONS} SELECT half, n_name, v1, v2, {r6('rank_1')} AS rank_1, {r6('rank_2')} AS rank_2, {r6('abs(rank_1 - rank_2)')} AS rank_diff FROM rnk")
def ranking_table(spark, sf_dir):
    return rounded(mt.ranking_comparison(_nations(spark, sf_dir), ["half"], "n_name", "v1", "v2"), "rank_1", "rank_2", "rank_diff")


_SIGNS = "sign(a.rank_1 - b.rank_1) * sign(a.rank_2 - b.rank_2)"
_SPEARMAN = "CASE WHEN stddev_pop(rank_1) * stddev_pop(rank_2) > 0 THEN corr(rank_1, rank_2) END"


def agreement_sql(keys: str, source: str, category: str) -> str:
    """Rows of ``source`` (keys, category, rank_1, rank_2) to all measures of agreement and their p-values."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    ties = lambda r, name: f"{name} AS (SELECT {keys}, list(c) AS {name} FROM (SELECT {keys}, {r}, count(*) AS c FROM {source} GROUP BY ALL) GROUP BY {keys})"
    t = "CASE WHEN abs(r) < 1 AND n > 2 THEN r / sqrt((1 - r * r) / (n - 2)) END"
    exact = "len(tx) = n AND len(ty) = n AND n <= 33"
    return f"""k AS (SELECT {", ".join("a." + x for x in keys.split(", "))}, CAST(sum({_SIGNS}) AS DOUBLE) AS s, count_if({_SIGNS} < 0) AS d,
          sum({_SIGNS}) / nullif(sqrt(CAST(sum(abs(sign(a.rank_1 - b.rank_1))) * sum(abs(sign(a.rank_2 - b.rank_2))) AS DOUBLE)), 0) AS tau
          FROM {source} a JOIN {source} b ON {same} AND a.{category} < b.{category} GROUP BY ALL),
        sp AS (SELECT {keys}, {_SPEARMAN} AS r, sum(abs(rank_1 - rank_2)) AS footrule, count(*) AS n FROM {source} GROUP BY ALL),
        {ties("rank_1", "tx")}, {ties("rank_2", "ty")},
        met AS (SELECT *, {t} AS t, {sql_kendall_z("s", "n", "tx", "ty")} AS z FROM sp JOIN k USING ({keys}) JOIN tx USING ({keys}) JOIN ty USING ({keys}))
        SELECT {keys}, {r6("r")} AS spearman, {r6(f"CASE WHEN abs(r) >= 1 THEN 0.0 ELSE {sql_student_p('t', '(n - 2)')} END")} AS spearman_p_value,
          {r6("tau")} AS kendall_tau, {r6(f"CASE WHEN {exact} THEN {sql_kendall_exact('d', 'n')} ELSE {sql_normal_p('z')} END")} AS kendall_p_value,
          {r6("footrule")} AS footrule, n FROM met LEFT JOIN perm ON perm.k = n"""


@query("g13_ranking_agreement", f"WITH RECURSIVE {PERMUTATIONS}, {_NATIONS}, {agreement_sql('half', 'rnk', 'n_name')}")
def ranking_agreement(spark, sf_dir):
    ranked = mt.ranking_comparison(_nations(spark, sf_dir), ["half"], "n_name", "v1", "v2")
    return _agreement(mt.ranking_agreement(ranked, ["half"], "n_name"))


def _agreement(df):
    return rounded(df, "spearman", "spearman_p_value", "kendall_tau", "kendall_p_value", "footrule")


_DAYS = """days AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS v1, count(DISTINCT o_custkey % 40) AS v2 FROM orders GROUP BY 1),
  rnk AS (SELECT 0 AS half, day, rank() OVER (ORDER BY v1 DESC) + (count(*) OVER (PARTITION BY v1) - 1) / 2.0 AS rank_1,
    rank() OVER (ORDER BY v2 DESC) + (count(*) OVER (PARTITION BY v2) - 1) / 2.0 AS rank_2 FROM days)"""


@query("g13_ranking_agreement_ties", f"WITH RECURSIVE {PERMUTATIONS}, {_DAYS}, {agreement_sql('half', 'rnk', 'day')}")
def ranking_agreement_ties(spark, sf_dir):
    """Order days ranked by orders and by kinds of customers: a long ranking, full of ties."""
    orders = table(spark, sf_dir, "orders")
    days = orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("v1"), F.countDistinct(F.col("o_custkey") % 40).alias("v2"))
    ranked = mt.ranking_comparison(days.withColumn("half", F.lit(0)), ["half"], "day", "v1", "v2")
    return _agreement(mt.ranking_agreement(ranked, ["half"], "day"))


@query(
    "g14_accuracy_by_bin",
    f"""WITH s AS (SELECT CAST(p_size % 2 AS INTEGER) AS y_true, p_size / CAST(50 AS DOUBLE) AS y_pred, p_retailprice AS v FROM part),
        q AS (SELECT quantile_cont(v, 0.4) AS a, quantile_cont(v, 0.8) AS b FROM s)
        SELECT CASE WHEN v <= a THEN 'low' WHEN v <= b THEN 'medium' ELSE 'high' END AS bin, {r6("avg(CASE WHEN (y_pred > 0.5) = (y_true = 1) THEN 1.0 ELSE 0.0 END)")} AS accuracy, count(*) AS n FROM s, q GROUP BY 1""",
)
def accuracy_by_bin(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        (F.col("p_size") % 2).alias("y_true"), (F.col("p_size") / 50.0).alias("y_pred"), F.col("p_retailprice").alias("v")
    )
    return rounded(mt.accuracy_by_bin(rows, [], "v"), "accuracy")
