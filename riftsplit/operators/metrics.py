"""Prediction metrics as grouped aggregations over any key columns.

Predictions are tables ``(by..., y_true, y_pred)``.  Curve metrics work on counts per
distinct score, with prefix sums that spread one large group over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riftsplit.functions.stats import kendall_p, normal_quantile, pearson, student_two_sided
from riftsplit.plans.durable import durable, join_bounded, stored
from riftsplit.plans.order import global_rank, percentiles, running_totals


def _zero_is(value: float | None, num: Column, den: Column) -> Column:
    ratio = num / F.nullif(den.cast("double"), F.lit(0.0))
    return ratio if value is None else F.coalesce(ratio, F.lit(value))


def score_curve(df: DataFrame, by: list[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Per distinct score: positives ``p``, rows ``n``, both accumulated up to the score, and group totals."""
    counts = df.groupBy(*by, F.col(y_pred).alias("score")).agg(
        F.sum(F.when(F.col(y_true) == 1, 1).otherwise(0)).alias("p"), F.count(F.lit(1)).alias("n")
    )
    return running_totals(counts, by, [F.col("score")], {"cp": "p", "cn": "n"}, {"p_all": "p", "n_all": "n"})


def _attach_one(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Columns of a one-row table as a scalar subquery."""
    packed = one_row.select(F.struct(*one_row.columns).alias("s"))
    with_s = df.withColumn("_s", packed.scalar())
    return with_s.select(*df.columns, *[F.col("_s")[c].alias(c) for c in one_row.columns])


def curve_metrics(curve: DataFrame, by: list[str]) -> DataFrame:
    """ROC-AUC with ties, average precision (steps) and PR-AUC (trapezoid) in one aggregation.

    Null where a group has one class only.
    """
    p, n, cp, cn = (F.col(c).cast("double") for c in ("p", "n", "cp", "cn"))
    pos, all_ = F.col("p_all").cast("double"), F.col("n_all").cast("double")
    neg = n - p
    neg_below = (cn - cp) - neg
    pairs = F.sum(p * (neg_below + neg / 2))
    # seen from the top: hits and rows at or above this score, and strictly above it
    tp, above = pos - (cp - p), all_ - (cn - n)
    tp_before, above_before = pos - cp, all_ - cn
    precision = tp / above
    before = F.when(above_before > 0, tp_before / above_before).otherwise(F.lit(1.0))
    first_p, first_n = F.first("p_all").cast("double"), F.first("n_all").cast("double")
    out = curve.groupBy(*by).agg(
        (pairs / F.nullif(first_p * (first_n - first_p), F.lit(0.0))).alias("roc_auc"),
        (F.sum(precision * p) / F.nullif(first_p, F.lit(0.0))).alias("avg_precision"),
        (F.sum(p * (precision + before) / 2) / F.nullif(first_p, F.lit(0.0))).alias("pr_auc"),
        first_p.alias("_pos"), first_n.alias("_rows"),
    )
    one_class = (F.col("_pos") == 0) | (F.col("_pos") == F.col("_rows"))
    guard = lambda c: F.when(~one_class, F.col(c)).alias(c)
    return out.select(*by, guard("roc_auc"), F.coalesce("avg_precision", F.lit(0.0)).alias("avg_precision"), guard("pr_auc"))


def roc_auc(df: DataFrame, by: list[str]) -> DataFrame:
    return curve_metrics(score_curve(df, by), by).select(*by, "roc_auc")


def average_precision(df: DataFrame, by: list[str]) -> DataFrame:
    return curve_metrics(score_curve(df, by), by).select(*by, "avg_precision")


def accuracy(df: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Share of rows where ``y_pred >= threshold`` agrees with the label."""
    hit = (F.col("y_pred") >= threshold).cast("int") == F.col("y_true")
    return df.groupBy(*by).agg(F.avg(hit.cast("double")).alias("acc"))


def binary_report(df: DataFrame, by: list[str]) -> DataFrame:
    """Size, acc, balanced acc, F1, precision, recall, ROC-AUC, AP and Cohen's kappa per group.

    Threshold 0.5; precision, recall and F1 are 1 on a zero division; ROC-AUC is 0 with one class.
    """
    yes, hit = F.col("y_true") == 1, F.col("y_pred") >= 0.5
    cells = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("size"),
        F.count_if(yes & hit).cast("double").alias("tp"),
        F.count_if(~yes & hit).cast("double").alias("fp"),
        F.count_if(~yes & ~hit).cast("double").alias("tn"),
        F.count_if(yes & ~hit).cast("double").alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    tpr, tnr = _zero_is(None, tp, tp + fn), _zero_is(None, tn, tn + fp)
    expected = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    observed = (tp + tn) / n
    scores = cells.select(
        *by, "size", observed.alias("acc"),
        # with one class only the recall of that class is the balanced accuracy
        F.coalesce((tpr + tnr) / 2, tpr, tnr).alias("balanced_acc"),
        _zero_is(1.0, 2 * tp, 2 * tp + fp + fn).alias("f1"),
        _zero_is(1.0, tp, tp + fp).alias("prec"),
        _zero_is(1.0, tp, tp + fn).alias("recall"),
        ((observed - expected) / F.nullif(1 - expected, F.lit(0.0))).alias("kappa"),
    )
    curves = curve_metrics(score_curve(df, by), by).select(*by, F.coalesce("roc_auc", F.lit(0.0)).alias("roc_auc"), "avg_precision")
    return scores.join(curves, by) if by else _attach_one(scores, curves)


# -- masked multi-task metrics ----------------------------------------------------

TASK_METRICS = ("r2", "mae", "rmse", "accuracy_score", "roc_auc_score", "pr_auc_score")


def denormalise(df: DataFrame, task_stats: DataFrame) -> DataFrame:
    """Undo label normalisation: ``y_pred * std + mean`` with one (task, mean, std) row per task."""
    joined = join_bounded(df, task_stats.select("task", F.col("mean").alias("_m"), F.col("std").alias("_s")), ["task"], "inner")
    return joined.withColumn("y_pred", F.col("y_pred") * F.col("_s") + F.col("_m")).drop("_m", "_s")


def task_metric(df: DataFrame, name: str, reduction: str = "none", threshold: float = 0.5) -> DataFrame:
    """One metric per task over ``(task, y_true, y_pred, mask)``; or its mean or sum over the tasks."""
    if name not in TASK_METRICS:
        raise ValueError(f"metric must be one of {TASK_METRICS}, got {name!r}")
    if reduction not in ("none", "mean", "sum"):
        raise ValueError("reduction must be none, mean or sum")
    rows = df.filter(F.col("mask") != 0)
    diff = F.col("y_true") - F.col("y_pred")
    if name in ("r2", "mae", "rmse"):
        score = {
            "r2": F.pow(pearson("y_true", "y_pred"), 2.0),
            "mae": F.avg(F.abs(diff)),
            "rmse": F.sqrt(F.avg(diff * diff)),
        }[name]
        scores = rows.groupBy("task").agg(score.alias("score"))
    else:
        prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("y_pred")))
        if name == "accuracy_score":
            right = ((prob > threshold).cast("int") == F.col("y_true")).cast("double")
            scores = rows.groupBy("task").agg(
                F.avg(right).alias("score"), F.min("y_true").alias("lo"), F.max("y_true").alias("hi")
            ).filter("lo < hi")
        else:
            column = "roc_auc" if name == "roc_auc_score" else "pr_auc"
            curve = score_curve(rows.withColumn("y_pred", prob), ["task"])
            scores = curve_metrics(curve, ["task"]).select("task", F.col(column).alias("score"))
        scores = scores.filter(F.col("score").isNotNull()).select("task", "score")
    if reduction == "none":
        return scores
    return scores.agg((F.avg if reduction == "mean" else F.sum)("score").alias("score"))


# -- calibration ------------------------------------------------------------------


def brier_score(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col("y_pred") - F.col("y_true"), 2.0)).alias("brier"))


def _below(edges: list[float], closed: bool) -> Column:
    """Number of edges that the score has passed; ``closed``: an edge belongs to the bin on its right."""
    passed = (lambda e: e <= F.col("y_pred")) if closed else (lambda e: e < F.col("y_pred"))
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), passed))


def _edges(n_bins: int) -> list[float]:
    return [i * (1.0 / n_bins) for i in range(n_bins)]


def _bin(n_bins: int, include_one: bool) -> Column:
    """Bin ``[lo, hi)`` by the edges themselves, so a score on an edge is where the comparison says."""
    slot = F.when((F.col("y_pred") >= 0) & (F.col("y_pred") < 1), _below(_edges(n_bins), True) - 1)
    return F.when(F.col("y_pred") == 1, n_bins - 1).otherwise(slot) if include_one else slot


def _curve_bin(n_bins: int) -> Column:
    """Bin ``(lo, hi]``; 0 is in the first and 1 in the last."""
    inside = (F.col("y_pred") >= 0) & (F.col("y_pred") <= 1)
    return F.when(inside, _below(_edges(n_bins)[1:], False))


def calibration_bins(df: DataFrame, by: list[str], n_bins: int = 10) -> DataFrame:
    """Mean score and positive share of each non-empty score bin ``(lo, hi]``."""
    binned = df.withColumn("bin", _curve_bin(n_bins).cast("int"))
    return binned.filter(F.col("bin").isNotNull()).groupBy(*by, "bin").agg(
        F.avg("y_pred").alias("prob_pred"), F.avg("y_true").alias("prob_true"), F.count(F.lit(1)).alias("n")
    )


def calibration_error(df: DataFrame, by: list[str], n_bins: int = 10, include_one: bool = False) -> DataFrame:
    """Expected calibration error; a score of 1 falls in no bin but counts among the rows."""
    binned = df.withColumn("bin", _bin(n_bins, include_one).cast("int"))
    per_bin = binned.groupBy(*by, "bin").agg(
        F.avg("y_pred").alias("p"), F.avg("y_true").alias("t"), F.count(F.lit(1)).alias("n")
    )
    gap = F.sum(F.when(F.col("bin").isNotNull(), F.abs(F.col("p") - F.col("t")) * F.col("n")).otherwise(0.0))
    return per_bin.groupBy(*by).agg((gap / F.sum("n")).alias("ece"))


# -- rankings ---------------------------------------------------------------------


def ranked_predictions(predictions: DataFrame, labels: DataFrame, item: str, score: str) -> DataFrame:
    """Inner join on the item, ranked over the whole table by (score desc, item)."""
    return global_rank(predictions.join(labels, item), [F.desc(score), F.col(item)])


def hit_rate(
    predictions: DataFrame, labels: DataFrame, item: str, score: str, label: str, top_k: int = 100, by: list[str] | None = None
) -> DataFrame:
    """Top-k as predicted positives: confusion counts, hit rate (over k), TPR, FPR, precision; one row per group of ``by``.

    Only the k best rows of each group are ranked (a group limit before the shuffle); the rest is known
    from the totals.
    """
    by = list(by or [])
    for df, cols in ((predictions, (*by, item, score)), (labels, (item, label))):
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise ValueError(f"columns {missing} not found")
    joined = predictions.select(*by, item, score).join(labels.select(item, label), item)
    if by:
        order = Window.partitionBy(*by).orderBy(F.desc(score), F.col(item))
        top = joined.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top_k)
    else:
        top = joined.orderBy(F.desc(score), F.col(item)).limit(top_k)
    counts = {"pos": F.count_if(F.col(label) == 1), "neg": F.count_if(F.col(label) == 0), "all": F.count(F.lit(1))}
    parts = [d.groupBy(*by).agg(*[c.alias(f"{n}_{s}") for n, c in counts.items()]) for d, s in ((top, "top"), (joined, "total"))]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True)
    out = durable(both.groupBy(*by).agg(*[F.coalesce(F.sum(f"{n}_{s}"), F.lit(0)).alias(f"{n}_{s}") for n in counts for s in ("top", "total")]))
    if not out.agg(F.coalesce(F.sum("all_total"), F.lit(0))).first()[0]:
        raise ValueError("no item of the predictions has a label")
    tp, fp = F.col("pos_top"), F.col("neg_top")
    fn, tn = F.col("pos_total") - tp, F.col("neg_total") - fp
    rate = lambda a, b: _zero_is(0.0, a, b)
    return out.select(
        *by,
        (tp / F.lit(float(top_k)) if top_k > 0 else F.lit(0.0)).alias("hit_rate"),
        tp.alias("tp_count"), fp.alias("fp_count"), tn.alias("tn_count"), fn.alias("fn_count"),
        rate(tp, tp + fn).alias("tpr"), rate(fp, fp + tn).alias("fpr"), rate(tp, tp + fp).alias("precision"),
        F.col("all_total").alias("total_molecules"), F.lit(top_k).alias("top_k"),
    )


def rescale(value: Column, scaling: str | None) -> Column:
    """probit, logit or linear scale."""
    if scaling == "probit":
        return normal_quantile(value)
    if scaling == "logit":
        return F.when((value > 0) & (value < 1), F.ln(value / (F.lit(1.0) - value)))
    if scaling in (None, "linear"):
        return value
    raise ValueError(f"unknown scaling {scaling!r}")


def linear_fit(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least squares of y on x: intercept, slope, r-squared."""
    return df.groupBy(*by).agg(
        F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r_squared")
    )


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Descending average rank per group: counts per distinct value and prefix sums, joined back.

    The rows are stored first: a value that is a mean may differ in its last digit when it is computed again, and would not find itself.
    """
    df = stored(df)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    cum = running_totals(counts, by, [F.desc(value)], {"_cum": "_c"})
    rank = F.col("_cum") - (F.col("_c") - 1) / 2.0
    return df.join(cum.select(*by, value, rank.alias(name)), [*by, value])


def ranking_comparison(df: DataFrame, by: list[str], category: str, v1: str, v2: str) -> DataFrame:
    """Category table with both ranks, for the measures of ``ranking_agreement``."""
    first = average_ranks(df.select(*by, category, v1, v2), by, v1, "rank_1")
    both = average_ranks(first, by, v2, "rank_2")
    return both.select(*by, category, v1, v2, "rank_1", "rank_2", F.abs(F.col("rank_1") - F.col("rank_2")).alias("rank_diff"))


def inversions(values: np.ndarray, weights: np.ndarray) -> float:
    """Weighted number of pairs i < j with values[i] > values[j], by merging sorted halves."""
    total, width, n = 0.0, 64, len(values)
    values, weights = values.copy(), weights.astype(np.float64)
    for start in range(0, n, width):  # short stretches pair by pair
        v, w = values[start : start + width], weights[start : start + width]
        total += float((np.triu(v[:, None] > v[None, :], 1) * w[:, None] * w[None, :]).sum())
        order = np.argsort(v, kind="stable")
        values[start : start + width], weights[start : start + width] = v[order], w[order]
    while width < n:
        for start in range(0, n - width, 2 * width):
            mid, end = start + width, min(start + 2 * width, n)
            upto = np.concatenate([[0.0], np.cumsum(weights[start:mid])])
            greater = upto[-1] - upto[np.searchsorted(values[start:mid], values[mid:end], side="right")]
            total += float((greater * weights[mid:end]).sum())
            order = np.argsort(values[start:end], kind="stable")
            values[start:end], weights[start:end] = values[start:end][order], weights[start:end][order]
        width *= 2
    return total


PIECES = 256  # most range partitions of a ranking


def discordant_pairs(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., discordant): pairs that the two ranks of (by..., rank_1, rank_2, c) order differently.

    Rows are range-partitioned by (rank_1, rank_2) into pieces and by (rank_2, rank_1) into buckets.  Pairs in one bucket are
    counted there, pairs in one piece but different buckets in the piece, and pairs that share neither from the table of
    counts per (piece, bucket).  No pair is ever a row, and a group of any size spans many tasks.
    """
    pieces = max(1, min(PIECES, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    placed = counts.select(*by, "rank_1", "rank_2", "c").repartitionByRange(pieces, *by, "rank_1", "rank_2")
    placed = durable(placed.withColumn("piece", F.spark_partition_id())).repartitionByRange(pieces, *by, "rank_2", "rank_1")
    placed = stored(placed.withColumn("bucket", F.spark_partition_id()))
    types = dict(placed.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in by] + ["d double"])

    def one(key: tuple, d: float) -> pd.DataFrame:
        return pd.DataFrame([[*key, d]], columns=[*by, "d"])

    def in_bucket(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank_1", "rank_2"])
        return one(key[:-1], inversions(pdf.rank_2.to_numpy(), pdf.c.to_numpy()))

    def in_piece(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank_1", "rank_2"])
        return one(key[:-1], inversions(pdf.bucket.to_numpy().astype(np.float64), pdf.c.to_numpy()))

    def across(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((pieces + 1, pieces + 1))
        np.add.at(table, (pdf.piece.to_numpy(), pdf.bucket.to_numpy()), pdf.c.to_numpy())
        before = table.cumsum(0)[:-1]  # of the earlier pieces and this one
        later = before[:, ::-1].cumsum(1)[:, ::-1]
        earlier_higher = np.zeros_like(table)
        earlier_higher[1:, :-1] = later[:, 1:]
        return one(key, float((table * earlier_higher).sum()))

    cells = placed.groupBy(*by, "piece", "bucket").agg(F.sum("c").alias("c"))  # pieces x buckets rows a group at most
    parts = [placed.groupBy(*by, "bucket").applyInPandas(in_bucket, schema), placed.groupBy(*by, "piece").applyInPandas(in_piece, schema)]
    parts.append(cells.groupBy(*by).applyInPandas(across, schema))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*by).agg(F.sum("d").alias("discordant"))


def _tie_sums(ranked: DataFrame, by: list[str], rank: str, side: str) -> DataFrame:
    t = F.col("t").cast("double")
    groups = ranked.groupBy(*by, rank).agg(F.count(F.lit(1)).alias("t"))
    return groups.groupBy(*by).agg(
        F.sum(t * (t - 1) / 2).alias(f"{side}2"), F.sum(t * (t - 1) * (t - 2)).alias(f"{side}3"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{side}5")
    )


def ranking_agreement(ranked: DataFrame, by: list[str], category: str) -> DataFrame:
    """Spearman, Kendall tau-b and footrule per group, with p-values (exact for short rankings without ties)."""
    if not by:
        return ranking_agreement(ranked.withColumn("_all", F.lit(0)), ["_all"], category).drop("_all")
    base = ranked.groupBy(*by).agg(
        pearson("rank_1", "rank_2").alias("spearman"), F.sum("rank_diff").alias("footrule"), F.count(F.lit(1)).alias("n")
    )
    counts = stored(ranked.groupBy(*by, "rank_1", "rank_2").agg(F.count(F.lit(1)).alias("c")))
    tied = counts.groupBy(*by).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("both2"))
    joined = base
    for part in (discordant_pairs(counts, by), tied, _tie_sums(ranked, by, "rank_1", "x"), _tie_sums(ranked, by, "rank_2", "y")):
        joined = joined.join(part, by)
    n = F.col("n").cast("double")
    pairs = n * (n - 1) / 2
    s = pairs - F.col("x2") - F.col("y2") + F.col("both2") - 2 * F.col("discordant")
    tau = s / F.nullif(F.sqrt((pairs - F.col("x2")) * (pairs - F.col("y2"))), F.lit(0.0))
    r = F.col("spearman")
    t = r * F.sqrt((n - 2) / F.nullif(1 - r * r, F.lit(0.0)))
    p = F.when(F.abs(r) >= 1, F.when(n > 2, F.lit(0.0))).otherwise(student_two_sided(t, n - 2))
    ties = {c: F.col(c) for c in ("x2", "x3", "x5", "y2", "y3", "y5")}
    return joined.withColumn("_s", s).select(
        *by, "spearman", p.alias("spearman_p_value"),
        tau.alias("kendall_tau"), kendall_p(F.col("_s"), F.col("discordant"), F.col("n"), ties).alias("kendall_p_value"), "footrule", "n",
    )


# Quantiles that cut a property into low, medium and high.
PROPERTY_CUTS = {"q40": 0.4, "q80": 0.8}


def accuracy_by_bin(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Accuracy in the low, medium and high part of a property (right-closed bins)."""
    cuts = percentiles(df, by, value, PROPERTY_CUTS)
    placed = join_bounded(df, cuts, by, "inner") if by else _attach_one(df, cuts)
    v = F.col(value)
    bin_ = F.when(v <= F.col("q40"), "low").when(v <= F.col("q80"), "medium").otherwise("high")
    hit = ((F.col("y_pred") > 0.5).cast("int") == F.col("y_true")).cast("double")
    return placed.filter(v.isNotNull()).groupBy(*by, bin_.alias("bin")).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))
