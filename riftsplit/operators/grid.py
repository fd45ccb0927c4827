"""ID/OOD analytics on the results fact table ``dataset x split x model x repeat``.

Scores are columns ``ID_test_<metric>`` and ``OOD_test_<metric>``.  Dimension tables
(models with family, ordered lists of splits and datasets) are small and joined as such.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riftsplit.functions.stats import Z_95, fisher_upper, normal_two_sided, pearson, student_two_sided
from riftsplit.operators.metrics import accuracy, average_ranks, curve_metrics, ranking_agreement, score_curve
from riftsplit.plans.durable import join_bounded
from riftsplit.plans.order import percentiles, seeded_key, take_by_hash

RUN = ["dataset", "split", "model", "repeat"]
METRICS = ("accuracy", "roc_auc", "pr_auc")
# Fixed scaling ranges of known properties (low, high).
PROPERTY_RANGES = {
    "Molecular_Weight": (160.0, 480.0),
    "LogP": (-2.0, 5.0),
    "TPSA": (0.0, 140.0),
    "HBD": (0.0, 5.0),
    "HBA": (0.0, 10.0),
    "Rotatable_Bonds": (0.0, 10.0),
}
# Upper bounds of the effect-size classes of a correlation.
EFFECT_SIZES = {"Negligible": 0.1, "Small": 0.3, "Medium": 0.5, "Large": 0.7}
LARGEST_EFFECT = "Very Large"
PERFORMANCE = ("Test (ID)", "Test (OOD)", "Gap")


def id_ood(metric: str) -> tuple[Column, Column]:
    return F.col(f"ID_test_{metric}"), F.col(f"OOD_test_{metric}")


def gap(metric: str) -> Column:
    a, b = id_ood(metric)
    return a - b


def results_fact(predictions: DataFrame, truths: DataFrame, id_metrics: DataFrame) -> DataFrame:
    """One row per run: ID metrics as read, OOD metrics from predictions matched to truths by key.

    ``predictions`` (dataset, split, model, repeat, id, y_pred), ``truths`` (dataset, split,
    repeat, id, y_true), ``id_metrics`` (dataset, split, model, repeat, ID_test_*).
    """
    scored = predictions.join(truths, ["dataset", "split", "repeat", "id"])
    sizes = scored.groupBy(*RUN).agg(F.count(F.lit(1)).alias("test_size"))
    curves = curve_metrics(score_curve(scored, RUN), RUN)
    ood = curves.select(*RUN, F.col("roc_auc").alias("OOD_test_roc_auc"), F.col("avg_precision").alias("OOD_test_pr_auc"))
    acc = accuracy(scored, RUN).withColumnRenamed("acc", "OOD_test_accuracy")
    return reduce(lambda a, b: a.join(b, RUN), [id_metrics, acc, ood, sizes])


def mean_difference(results: DataFrame, by: list[str] | str = "model", metrics=METRICS) -> DataFrame:
    """Mean ID - OOD per key and metric."""
    by = [by] if isinstance(by, str) else by
    missing = [c for m in metrics for c in (f"ID_test_{m}", f"OOD_test_{m}") if c not in results.columns]
    missing += [c for c in by if c not in results.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing in the results")
    return results.groupBy(*by).agg(*[F.avg(gap(m)).alias(f"diff_{m}") for m in metrics])


def with_family(results: DataFrame, models: DataFrame) -> DataFrame:
    """Add model family columns from the model dimension (model, family, ...)."""
    return join_bounded(results, models, ["model"])


def mean_std_text(value: Column) -> Column:
    return F.format_string("%.2f (%.2f)", F.avg(value), F.stddev_samp(value))


def gap_table(
    results: DataFrame, datasets: list[str], metric: str = "roc_auc", keys: list[str] | None = None, splits: DataFrame | None = None
) -> DataFrame:
    """Rows key x {Test (ID), Test (OOD), Gap}, one column per dataset, cells ``mean (std)``.

    One aggregation gives all three measures; ``splits`` (split, ord) fixes the row order and
    keeps splits without results as null cells.
    """
    keys = keys or ["split"]
    a, b = id_ood(metric)
    cells = results.groupBy(*keys, "dataset").agg(
        mean_std_text(a).alias("m0"), mean_std_text(b).alias("m1"), mean_std_text(a - b).alias("m2")
    )
    named = F.explode(F.array(*[F.struct(F.lit(p).alias("performance"), F.lit(i).alias("p_ord"), F.col(f"m{i}").alias("cell")) for i, p in enumerate(PERFORMANCE)]))
    long = cells.select(*keys, "dataset", named.alias("_x")).select(*keys, "dataset", "_x.*")
    wide = long.groupBy(*keys, "performance", "p_ord").pivot("dataset", datasets).agg(F.first("cell"))
    if splits is None:
        return wide.drop("p_ord")
    names = F.explode(F.array(*[F.struct(F.lit(p).alias("performance"), F.lit(i).alias("p_ord")) for i, p in enumerate(PERFORMANCE)]))
    frame = splits.select("split", "ord", names.alias("_p")).select("split", "ord", "_p.*")
    return frame.join(wide.drop("p_ord"), ["split", "performance"], "left").orderBy("ord", "p_ord")


def gap_rollup(results: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """Gap statistics by split, dataset and family with the all-family total, in one pass."""
    return results.groupingSets([["split", "dataset", "family"], ["split", "dataset"]], "split", "dataset", "family").agg(
        F.avg(gap(metric)).alias("mean_gap"), F.stddev_samp(gap(metric)).alias("std_gap"), F.count(F.lit(1)).alias("n"),
        F.grouping("family").cast("int").alias("is_total"),
    )


def score_matrix(
    results: DataFrame, row: str, column: str, values: list[str], metric: str = "roc_auc", report: str = "diff", percent: bool = False
) -> DataFrame:
    """Heatmap matrix: mean difference, ID or OOD score per row and column; percent of the ID mean on request."""
    a, b = id_ood(metric)
    if report == "diff":
        cell = (F.avg(a) - F.avg(b)) / F.nullif(F.avg(a), F.lit(0.0)) * 100 if percent else F.avg(a) - F.avg(b)
    elif report in ("id", "ood"):
        cell = F.avg(a if report == "id" else b)
    else:
        raise ValueError("report must be diff, id or ood")
    means = results.groupBy(row, column).agg(cell.alias("cell"))
    return means.groupBy(row).pivot(column, values).agg(F.first("cell"))


def family_difference(results: DataFrame, metric: str = "roc_auc", keys: list[str] | None = None) -> DataFrame:
    """Mean over models of their mean difference, per family."""
    keys = keys or []
    per_model = results.groupBy(*keys, "family", "model").agg(F.avg(gap(metric)).alias("d"))
    return per_model.groupBy(*keys, "family").agg(F.avg("d").alias("mean_difference"), F.count(F.lit(1)).alias("n_models"))


def difference_by(results: DataFrame, keys: list[str], metric: str = "roc_auc") -> DataFrame:
    return results.groupBy(*keys).agg(F.avg(gap(metric)).alias("difference"))


def tidy(results: DataFrame, keys: list[str], columns: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return results.unpivot(keys, columns, name, value)


def side_by_side(results: DataFrame, dataset: str, split_a: str, split_b: str, columns: list[str], keys=("model", "repeat")) -> DataFrame:
    """Two split types of one dataset joined on the run, columns suffixed with the split.

    The runs of both splits are gathered in one grouping instead of a self join.
    """
    one = results.filter((F.col("dataset") == dataset) & F.col("split").isin(split_a, split_b))
    cells = [
        F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{c}_{s}") for s in (split_a, split_b) for c in columns
    ]
    has = [F.count_if(F.col("split") == s) for s in (split_a, split_b)]
    grouped = one.groupBy(*keys).agg(*cells, *[h.alias(f"_h{i}") for i, h in enumerate(has)])
    return grouped.filter("_h0 > 0 and _h1 > 0").drop("_h0", "_h1")


def correlations(results: DataFrame, keys: list[str], metric: str = "roc_auc") -> DataFrame:
    """Pearson r of ID and OOD per key, with the number of runs."""
    a, b = id_ood(metric)
    return results.groupBy(*keys).agg(pearson(f"ID_test_{metric}", f"OOD_test_{metric}").alias("r"), F.count(F.when(a.isNotNull() & b.isNotNull(), 1)).alias("n"))


def correlation_matrix(results: DataFrame, families: list, metric: str = "roc_auc") -> DataFrame:
    return correlations(results, ["split", "family"], metric).groupBy("split").pivot("family", families).agg(F.first("r"))


def slopes(results: DataFrame, metrics: list[str], keys=("dataset", "split", "family")) -> DataFrame:
    """Least squares of OOD on ID per key and metric (rows with a missing score left out)."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"ID_test_{m}").alias("x"), F.col(f"OOD_test_{m}").alias("y")) for m in metrics]))
    needed = [c for m in metrics for c in (f"ID_test_{m}", f"OOD_test_{m}")]
    long = results.na.drop(subset=needed).select(*keys, cells.alias("_m")).select(*keys, "_m.*")
    return long.groupBy(*keys, "metric").agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r_squared")
    )


def slope_table(fits: DataFrame, datasets: list[str]) -> DataFrame:
    """``slope (r2)`` cells, one column per dataset."""
    text = F.format_string("%.2f (%.2f)", F.first("slope"), F.first("r_squared"))
    return fits.groupBy("split", "family", "metric").pivot("dataset", datasets).agg(text)


def slope_summary(fits: DataFrame) -> DataFrame:
    return fits.groupBy("split", "metric").agg(
        F.avg("slope").alias("slope_mean"), F.stddev_samp("slope").alias("slope_std"),
        F.avg("r_squared").alias("r2_mean"), F.stddev_samp("r_squared").alias("r2_std"),
    )


def describe_by(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean and sample deviation of columns per key."""
    aggs = [a for c in columns for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))]
    return df.groupBy(*keys).agg(*aggs)


def model_table(results: DataFrame, metric: str = "roc_auc", agg: str = "mean", models: DataFrame | None = None, keys=("split",)) -> DataFrame:
    """Per split and model: chosen aggregate of ID and OOD and their gap; rows in model order."""
    by = [*keys, "model"]
    a, b = id_ood(metric)
    if agg == "mean":
        out = results.groupBy(*by).agg(
            F.avg(a).alias("id_score"), F.avg(b).alias("ood_score"), F.stddev_samp(a).alias("id_std"), F.stddev_samp(b).alias("ood_std")
        )
    elif agg == "median":
        named = results.select(*by, a.alias("x"), b.alias("y"))
        out = percentiles(named, by, "x", {"id_score": 0.5}).join(percentiles(named, by, "y", {"ood_score": 0.5}), by)
    else:
        raise ValueError("agg must be mean or median")
    out = out.withColumn("gap", F.col("id_score") - F.col("ood_score"))
    return out if models is None else join_bounded(out, models.select("model", "ord"), ["model"]).orderBy(*keys, "ord")


def medians(df: DataFrame, key: str, value: str) -> DataFrame:
    """Exact median of a value per key, largest first."""
    return percentiles(df, [key], value, {"median": 0.5}).orderBy(F.desc("median"), key)


def condition_agreement(long: DataFrame) -> DataFrame:
    """Spearman and Kendall for every pair of conditions of ``(condition, category, value)``."""
    a = long.select(F.col("condition").alias("c1"), "category", F.col("value").alias("v1"))
    b = long.select(F.col("condition").alias("c2"), "category", F.col("value").alias("v2"))
    pairs = a.join(b, "category").filter("c1 < c2")
    ranked = average_ranks(average_ranks(pairs, ["c1", "c2"], "v1", "rank_1"), ["c1", "c2"], "v2", "rank_2")
    ranked = ranked.withColumn("rank_diff", F.abs(F.col("rank_1") - F.col("rank_2")))
    return ranking_agreement(ranked, ["c1", "c2"], "category")


def shared_items(items: DataFrame, dataset: str, item: str, values: list | None = None) -> DataFrame:
    """Matrix cell (d1, d2): rows of d1 whose item occurs in d2.

    Each item is reduced to its dataset counts before the pairs of datasets are formed, so an
    item contributes at most (datasets)^2 small rows however often it occurs.
    """
    per = items.groupBy(item, dataset).agg(F.count(F.lit(1)).alias("n"))
    sets = per.groupBy(item).agg(F.collect_list(F.struct(F.col(dataset).alias("d"), "n")).alias("s"))
    first = sets.select(F.explode("s").alias("a"), "s").select("a", F.explode("s.d").alias("d2"))
    out = first.groupBy(F.col("a.d").alias("d1"), "d2").agg(F.sum("a.n").alias("n_shared"))
    return out if values is None else out.groupBy("d1").pivot("d2", values).agg(F.first("n_shared"))


def running_intersection(items: DataFrame, dataset: str, item: str) -> DataFrame:
    """Number of items present in the first j datasets (datasets in sorted order), for each j.

    An item survives up to the first dataset that lacks it: that position is one number per
    item, so the chain of intersections is a single grouping.
    """
    names = items.select(dataset).distinct()
    ordered = names.agg(F.array_sort(F.collect_set(dataset)).alias("o"))
    per_item = items.groupBy(item).agg(F.collect_set(dataset).alias("d")).withColumn("_o", ordered.scalar())
    miss = F.array_position(F.transform("_o", lambda n: F.array_contains("d", n)), F.lit(False))
    depth = F.when(miss == 0, F.size("_o")).otherwise(miss - 1).cast("int")
    reached = per_item.select(depth.alias("depth"), "_o").filter("depth > 0")
    steps = reached.groupBy("depth", "_o").agg(F.count(F.lit(1)).alias("n"))
    spread = steps.select(F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("step"), "n", "_o")
    out = spread.groupBy("step", "_o").agg(F.sum("n").alias("n_items"))
    return out.select("step", F.get("_o", F.col("step") - 1).alias("dataset"), "n_items")


def only_in_first(a: DataFrame, b: DataFrame, item: str) -> DataFrame:
    """Rows of a whose item is not in b."""
    return a.join(b.select(item), item, "left_anti")


# -- significance -----------------------------------------------------------------


def t_tests(results: DataFrame, keys=("dataset", "split"), metric: str = "roc_auc", left_out: str | None = "random") -> DataFrame:
    """One-sample t-test of the difference per key, Bonferroni-corrected over the keys."""
    rows = results if left_out is None else results.filter(F.col("split") != left_out)
    d = gap(metric)
    stats = rows.groupBy(*keys).agg(F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("_s"), F.count(d).alias("n"))
    t = F.col("mean_difference") / F.nullif(F.col("_s") / F.sqrt(F.col("n").cast("double")), F.lit(0.0))
    tested = stats.select(*keys, "mean_difference", t.alias("t_statistic"), "n")
    tested = tested.withColumn("p_value", student_two_sided(F.col("t_statistic"), F.col("n").cast("double") - 1))
    families = stats.agg(F.count(F.lit(1)).alias("m"))
    out = tested.withColumn("p_value_corrected", F.col("p_value") * families.scalar())
    return out.withColumn("significant", F.col("p_value_corrected") < 0.05)


def anova(results: DataFrame, by: str = "split", group: str = "family", metric: str = "roc_auc", alpha: float = 0.01) -> DataFrame:
    """One-way analysis of variance of the difference over groups, per ``by``."""
    d = gap(metric)
    per = results.groupBy(by, group).agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.var_pop(d).alias("v"))
    # deviations from the grand mean, so that large sums do not cancel
    group_of = Window.partitionBy(by)
    grand = F.sum(F.col("n") * F.col("m")).over(group_of) / F.nullif(F.sum("n").over(group_of).cast("double"), F.lit(0.0))
    tot = per.withColumn("_grand", grand).groupBy(by).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("nn"), F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("_grand"), 2.0)).alias("between"),
    )
    k, nn, between = F.col("k").cast("double"), F.col("nn").cast("double"), F.col("between")
    f = (between / F.nullif(k - 1, F.lit(0.0))) / F.nullif(F.col("within") / F.nullif(nn - k, F.lit(0.0)), F.lit(0.0))
    out = tot.select(by, f.alias("f_stat"), (k - 1).alias("d1"), (nn - k).alias("d2"))
    out = out.withColumn("p_value", fisher_upper("f_stat", "d1", "d2"))
    return out.select(by, "f_stat", "p_value", (F.col("p_value") < alpha).alias("is_significant"))


def correlation_significance(corrs: DataFrame) -> DataFrame:
    """Fisher z of (.., r, n): z score, p, 95 % interval, effect class; null where abs(r) >= 1."""
    r, n = F.col("r"), F.col("n").cast("double")
    ok = (F.abs(r) < 1) & (n > 3)
    z, se = F.atanh(r), F.lit(1.0) / F.nullif(F.sqrt(n - 3), F.lit(0.0))
    out = corrs.withColumns(
        {
            "z_score": F.when(ok, z / se),
            "ci_lower": F.when(ok, F.tanh(z - F.lit(Z_95) * se)),
            "ci_upper": F.when(ok, F.tanh(z + F.lit(Z_95) * se)),
            "effect_size": effect_size(r),
        }
    )
    out = out.withColumn("p_value", normal_two_sided("z_score"))
    return out.withColumn("significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))


def effect_size(r: Column) -> Column:
    out = None
    for name, upper in EFFECT_SIZES.items():
        hit = F.abs(r) < upper
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(LARGEST_EFFECT)


def effect_counts(classified: DataFrame, key: str = "family") -> DataFrame:
    names = [*EFFECT_SIZES, LARGEST_EFFECT]
    return classified.groupBy(key).pivot("effect_size", names).count().na.fill(0, names)


def compare_correlations(corrs: DataFrame, by: str = "split", group: str = "family") -> DataFrame:
    """Difference of two Fisher z per pair of groups; the group list of one key is small by nature."""
    a = corrs.select(by, F.col(group).alias("g1"), F.col("r").alias("r1"), F.col("n").alias("n1"))
    b = corrs.select(by, F.col(group).alias("g2"), F.col("r").alias("r2"), F.col("n").alias("n2"))
    pairs = a.join(b, by).filter("g1 < g2")
    ok = (F.abs("r1") < 1) & (F.abs("r2") < 1) & (F.col("n1") > 3) & (F.col("n2") > 3)
    room = lambda c: F.nullif(F.col(c).cast("double") - 3, F.lit(0.0))
    se = F.sqrt(F.lit(1.0) / room("n1") + F.lit(1.0) / room("n2"))
    out = pairs.withColumn("z_diff", F.when(ok, (F.atanh("r1") - F.atanh("r2")) / se))
    return out.withColumn("p_value", normal_two_sided("z_diff"))


def score_hit_correlation(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Pearson and Spearman of two scores per splitter."""
    ranked = average_ranks(average_ranks(df.select(key, x, y), [key], x, "rx"), [key], y, "ry")
    return ranked.groupBy(key).agg(pearson(x, y).alias("pearson"), pearson("rx", "ry").alias("spearman"), F.count(F.lit(1)).alias("n"))


def drop_against_baseline(scores: DataFrame, key: str, value: str, baseline: str, by: list[str] | None = None) -> DataFrame:
    """Baseline minus own score per key, largest drop first; within ``by`` when given."""
    by = by or []
    base = scores.filter(F.col(key) == baseline).groupBy(*by).agg(F.max(value).alias("_base"))
    if by:
        joined = join_bounded(scores, base, by, "inner")
    else:
        joined = scores.withColumn("_base", base.scalar())
    out = joined.filter(F.col(key) != baseline).select(*by, key, value, (F.col("_base") - F.col(value)).alias("drop"))
    return out.orderBy(*by, F.desc("drop"), key)


def scaled_medians(values: DataFrame, key: str = "dataset") -> DataFrame:
    """Median per dataset and property, scaled by its fixed range (min-max otherwise), with median and IQR.

    ``values`` is long (dataset, property, value).
    """
    med = percentiles(values, [key, "property"], "value", {"median": 0.5})
    span = med.groupBy("property").agg(F.min("median").alias("lo"), F.max("median").alias("hi"))
    fixed_lo = F.create_map(*[x for k, (lo, _) in PROPERTY_RANGES.items() for x in (F.lit(k), F.lit(lo))])
    fixed_hi = F.create_map(*[x for k, (_, hi) in PROPERTY_RANGES.items() for x in (F.lit(k), F.lit(hi))])
    span = span.select(
        "property",
        F.coalesce(F.try_element_at(fixed_lo, F.col("property")), "lo").alias("lo"),
        F.coalesce(F.try_element_at(fixed_hi, F.col("property")), "hi").alias("hi"),
    )
    scaled = join_bounded(med, span, ["property"], "inner")
    scaled = scaled.withColumn("scaled", (F.col("median") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    stats = percentiles(scaled, ["property"], "scaled", {"q1": 0.25, "mid": 0.5, "q3": 0.75})
    out = join_bounded(scaled.select(key, "property", "median", "scaled"), stats, ["property"])
    return out.select(key, "property", "median", "scaled", F.col("mid").alias("property_median"), (F.col("q3") - F.col("q1")).alias("property_iqr"))


def sample_per_group(df: DataFrame, row_id: str, group: str, n: int, more_than: int, seed: int = 0) -> DataFrame:
    """``n`` rows in seeded order from each group with more than ``more_than`` rows.

    The cut key of a group comes from its hash histogram, so a hot group is never sorted.
    """
    keyed = df.withColumn("_key", seeded_key(seed, F.lit(0), F.col(row_id)))
    quota = F.when(F.col("_n") > more_than, F.least(F.lit(n).cast("long"), F.col("_n"))).otherwise(F.lit(0))
    return take_by_hash(keyed, [group], {"keep": quota}, "rest", bounded=False).filter("set = 'keep'").drop("set", "_key")


def above_threshold(results: DataFrame, metric: str = "roc_auc", threshold: float = 0.5) -> DataFrame:
    return results.filter(F.col(f"ID_test_{metric}") > threshold)


def drops(results: DataFrame, key: str = "dataset", metric: str = "roc_auc") -> DataFrame:
    """Absolute and relative drop of the mean per key."""
    a, b = id_ood(metric)
    return results.groupBy(key).agg(
        F.avg(a).alias("id_mean"), F.avg(b).alias("ood_mean"), (F.avg(a) - F.avg(b)).alias("drop"),
        ((F.avg(a) - F.avg(b)) / F.nullif(F.avg(a), F.lit(0.0)) * 100).alias("drop_percent"),
    )
