"""Metrics, audit edge cases and significance: exact values."""

import math

import pytest
from pyspark.sql import functions as F

from riftsplit.functions import stats
from riftsplit.operators import audit, grid, metrics
from riftsplit.plans.order import global_rank, percentiles, running_totals


def scores(spark, y, p):
    return spark.createDataFrame(list(zip(y, p)), "y_true int, y_pred double")


def brute_auc(y, p):
    pos, neg = [b for a, b in zip(y, p) if a], [b for a, b in zip(y, p) if not a]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_curves_by_brute_force(spark):
    y = [1, 0, 1, 1, 0, 0, 1, 0, 0, 1]
    p = [0.9, 0.8, 0.8, 0.4, 0.4, 0.4, 0.3, 0.2, 0.1, 0.05]
    row = metrics.curve_metrics(metrics.score_curve(scores(spark, y, p), []), []).first()
    assert row["roc_auc"] == pytest.approx(brute_auc(y, p))
    ap, area, last = 0.0, 0.0, (0.0, 1.0)
    for t in sorted(set(p), reverse=True):
        hits = [a for a, b in zip(y, p) if b >= t]
        rec, prec = sum(hits) / 5, sum(hits) / len(hits)
        ap += (rec - last[0]) * prec
        area += (rec - last[0]) * (prec + last[1]) / 2
        last = (rec, prec)
    assert row["avg_precision"] == pytest.approx(ap) and row["pr_auc"] == pytest.approx(area)


def test_one_class_and_zero_division(spark):
    row = metrics.binary_report(scores(spark, [0, 0, 0], [0.1, 0.2, 0.3]), []).first()
    assert row["roc_auc"] == 0.0 and row["prec"] == 1.0 and row["recall"] == 1.0 and row["f1"] == 1.0 and row["acc"] == 1.0
    assert row["balanced_acc"] == 1.0 and row["kappa"] is None


def test_calibration_leaves_out_one(spark):
    df = scores(spark, [0, 1, 1, 1], [0.05, 0.95, 1.0, 0.5])
    assert metrics.calibration_error(df, []).first()["ece"] == pytest.approx((0.05 + 0.05 + 0.5) / 4)
    kept = metrics.calibration_error(df, [], include_one=True).first()["ece"]
    assert kept == pytest.approx((0.05 + 2 * (1 - 0.975) + 0.5) / 4)
    assert metrics.brier_score(df, []).first()["brier"] == pytest.approx((0.05**2 * 2 + 0.25) / 4)


def test_hit_rate(spark):
    pred = spark.createDataFrame([("CCO", 7.2), ("CCCO", 6.8), ("CCCC", 5.5)], "smiles string, prediction double")
    lab = spark.createDataFrame([("CCO", 1), ("CCCO", 1), ("CCCC", 0)], "smiles string, label int")
    row = metrics.hit_rate(pred, lab, "smiles", "prediction", "label", 100).first()
    assert (row["hit_rate"], row["tp_count"], row["fp_count"], row["tn_count"], row["fn_count"]) == (0.02, 2, 1, 0, 0)
    one = metrics.hit_rate(pred, lab, "smiles", "prediction", "label", 1).first()
    assert (one["hit_rate"], one["tpr"], one["fpr"], one["precision"]) == (1.0, 0.5, 0.0, 1.0)
    with pytest.raises(ValueError):
        metrics.hit_rate(pred, lab.filter("label > 5"), "smiles", "prediction", "label")
    with pytest.raises(ValueError):
        metrics.hit_rate(pred, lab, "smiles", "score", "label")


def test_task_metrics(spark):
    rows = [(t, float(i % 2), 0.3 * i - t, int(i != 3)) for t in (0, 1) for i in range(6)] + [(2, 1.0, 0.2, 1)] * 3
    df = spark.createDataFrame(rows, "task int, y_true double, y_pred double, mask int")
    assert {r["task"] for r in metrics.task_metric(df, "roc_auc_score").collect()} == {0, 1}
    mae = {r["task"]: r["score"] for r in metrics.task_metric(df, "mae").collect()}
    assert mae[2] == pytest.approx(0.8)
    assert metrics.task_metric(df, "mae", "sum").first()["score"] == pytest.approx(sum(mae.values()))
    with pytest.raises(ValueError):
        metrics.task_metric(df, "pr_auc")
    with pytest.raises(ValueError):
        metrics.task_metric(df, "mae", "median")


def test_rankings(spark):
    df = spark.createDataFrame([("a", 3.0, 1.0), ("b", 2.0, 2.0), ("c", 1.0, 3.0), ("d", 1.0, 0.5)], "c string, x double, y double")
    ranked = metrics.ranking_comparison(df, [], "c", "x", "y")
    assert {r["c"]: (r["rank_1"], r["rank_2"]) for r in ranked.collect()} == {"a": (1, 3), "b": (2, 2), "c": (3.5, 1), "d": (3.5, 4)}
    row = metrics.ranking_agreement(ranked, [], "c").first()
    # pairs: ab -, ac -, ad +, bc -, bd +, cd tie in x
    assert row["kendall_tau"] == pytest.approx(-1 / math.sqrt(5 * 6)) and row["footrule"] == 5.0


def test_rescale(spark):
    df = spark.createDataFrame([(0.5,), (0.975,), (0.0,)], "x double")
    got = df.select(metrics.rescale(F.col("x"), "probit").alias("p"), metrics.rescale(F.col("x"), "logit").alias("l"), metrics.rescale(F.col("x"), "linear").alias("n")).collect()
    assert got[1]["p"] == pytest.approx(stats.Z_95) and got[0]["l"] == pytest.approx(0.0) and got[2]["p"] is None and got[2]["l"] is None
    with pytest.raises(ValueError):
        metrics.rescale(F.col("x"), "cubic")


def test_tail_probabilities(spark):
    row = spark.range(1).select(
        stats.fisher_upper(F.lit(3.0), F.lit(2.0), F.lit(10.0)).alias("f"),
        stats.student_two_sided(F.lit(2.0), F.lit(1.0)).alias("t1"),
        stats.student_two_sided(F.lit(2.0), F.lit(2.0)).alias("t2"),
        stats.normal_two_sided(F.lit(1.959963984540054)).alias("z"),
        stats.kolmogorov_two_sided(F.lit(0.2), F.lit(100), F.lit(100)).alias("k"),
    ).first()
    assert row["f"] == pytest.approx(1.6**-5)  # closed form for two numerator degrees
    assert row["t1"] == pytest.approx(1 - 2 / math.pi * math.atan(2.0))
    assert row["t2"] == pytest.approx(1 - 2 / math.sqrt(6.0))
    assert row["z"] == pytest.approx(0.05)
    lam = 0.2 * math.sqrt(50)
    assert row["k"] == pytest.approx(2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * lam * lam) for j in range(1, 50)))


def test_mean_differences(spark):
    rows = [("m1", 0.9, 0.7, 0.85, 0.7, 0.8, 0.7), ("m1", 0.8, 0.6, 0.8, 0.65, 0.7, 0.7), ("m2", 0.9, 0.7, 0.8, 0.7, 0.9, 0.7), ("m2", 0.8, 0.6, 0.7, 0.6, 0.8, 0.6)]
    cols = ["model"] + [f"{s}_test_{m}" for m in grid.METRICS for s in ("ID", "OOD")]
    got = {r["model"]: r for r in grid.mean_difference(spark.createDataFrame(rows, cols)).collect()}
    assert got["m1"]["diff_accuracy"] == pytest.approx(0.2) and got["m2"]["diff_accuracy"] == pytest.approx(0.2)
    assert got["m1"]["diff_roc_auc"] == pytest.approx(0.15) and got["m2"]["diff_roc_auc"] == pytest.approx(0.1)
    assert got["m1"]["diff_pr_auc"] == pytest.approx(0.05) and got["m2"]["diff_pr_auc"] == pytest.approx(0.2)
    with pytest.raises(ValueError):
        grid.mean_difference(spark.createDataFrame(rows, cols).drop("model"))


def test_gap_table_keeps_missing_cells(spark):
    rows = [("d1", "random", 0.9, 0.8), ("d1", "random", 0.7, 0.6), ("d2", "random", 0.5, 0.5)]
    df = spark.createDataFrame(rows, "dataset string, split string, ID_test_roc_auc double, OOD_test_roc_auc double")
    splits = spark.createDataFrame([("kmeans", 1), ("random", 0)], "split string, ord int")
    out = grid.gap_table(df, ["d1", "d2"], splits=splits).collect()
    assert [(r["split"], r["performance"]) for r in out] == [(s, p) for s in ("random", "kmeans") for p in grid.PERFORMANCE]
    assert out[0]["d1"] == "0.80 (0.14)" and out[3]["d1"] is None


def parts_of(spark, rows):
    return spark.createDataFrame([("s", 0, i, s) for i, s in rows], "splitter string, split_index int, id bigint, set string")


def test_empty_side_has_no_similarity_or_group_row(spark):
    parts = parts_of(spark, [(i, "train") for i in range(4)])
    bits = spark.createDataFrame([(i, [i]) for i in range(4)], "id bigint, bits array<int>")
    groups = spark.createDataFrame([(i, "g") for i in range(4)], "id bigint, group_key string")
    assert audit.similarity_metrics(parts, bits, 8).count() == 0 and audit.group_metrics(parts, groups).count() == 0
    row = audit.size_metrics(parts).first()
    assert row["test_ratio"] == 0.0 and row["train_positive_ratio"] is None


def test_discarded_rows_count_in_the_total_only(spark):
    parts = parts_of(spark, [(0, "train"), (1, "train"), (2, "test"), (3, "discard")])
    row = audit.size_metrics(parts).first()
    assert (row["total_samples"], row["train_size"], row["test_size"]) == (4, 2, 1) and row["train_ratio"] == pytest.approx(2 / 3)


def test_group_metrics_with_missing_keys(spark):
    parts = parts_of(spark, [(0, "train"), (1, "train"), (2, "test"), (3, "test")])
    groups = spark.createDataFrame([(0, "a"), (1, None), (2, "a"), (3, "b")], "id bigint, group_key string")
    row = audit.group_metrics(parts, groups).first()
    assert (row["train_unique_scaffolds"], row["test_unique_scaffolds"], row["shared_scaffolds"]) == (1, 2, 1)
    assert (row["scaffold_overlap_percentage"], row["train_scaffold_coverage"], row["test_scaffold_coverage"]) == (50.0, 50.0, 100.0)


def test_properties_need_two_values_per_side(spark):
    parts = parts_of(spark, [(0, "train"), (1, "train"), (2, "test"), (3, "test")])
    props = spark.createDataFrame([(i, "p", float(i)) for i in range(4)] + [(i, "q", 1.0) for i in range(3)], "id bigint, property string, value double")
    rows = audit.property_metrics(parts, props).collect()
    assert [r["property"] for r in rows] == ["p"] and rows[0]["ks_statistic"] == 1.0 and rows[0]["mean_diff"] == 2.0
    assert audit.property_metrics(parts, props, ["unknown"]).count() == 0


def test_constant_metric_scales_to_half(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 3.0)], "splitter_name string, x double, y double")
    got = {r["splitter_name"]: (r["x"], r["y"]) for r in audit.min_max_scaled(df, ["x", "y"]).collect()}
    assert got == {"a": (0.5, 0.0), "b": (0.5, 1.0)}


@pytest.mark.parametrize("parts", [1, 13])
def test_order_primitives_with_hot_values(spark, parts):
    """A third of the rows shares one value: ranks, prefix sums and percentiles stay exact."""
    df = spark.range(300).withColumn("v", F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") * 17 % 101).cast("double")))
    local = sorted((r["v"], r["id"]) for r in df.collect())
    ranked = {r["id"]: r["rank"] for r in global_rank(df.repartition(parts), [F.col("v"), F.col("id")]).collect()}
    assert ranked == {i: n + 1 for n, (_, i) in enumerate(local)}
    totals = running_totals(df.groupBy("v").agg(F.count("id").alias("c")).repartition(parts), [], [F.col("v")], {"cum": "c"}, {"all": "c"})
    got = {r["v"]: (r["cum"], r["all"]) for r in totals.collect()}
    assert got == {v: (sum(1 for x, _ in local if x <= v), 300) for v in got}
    row = percentiles(df.repartition(parts), [], "v", {"a": 0.05, "m": 0.5, "z": 0.95}).first()
    values = [v for v, _ in local]
    for name, p in (("a", 0.05), ("m", 0.5), ("z", 0.95)):
        h = p * 299
        lo, frac = int(h), h - int(h)
        assert row[name] == pytest.approx(values[lo] + frac * (values[min(lo + 1, 299)] - values[lo]))


def test_constant_columns_give_null_not_an_error(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0)], "k string, x double, y double")
    fit = metrics.linear_fit(df, ["k"], "x", "y").first()
    assert fit["slope"] is None
    assert df.select(stats.pearson("x", "y").alias("r")).first()["r"] is None
    grid_rows = df.selectExpr("k as split", "k as family", "0.0D as ID_test_roc_auc", "0.0D as OOD_test_roc_auc", "k as dataset")
    for out in (
        grid.correlation_significance(grid.correlations(grid_rows, ["split", "family"])),
        grid.compare_correlations(grid.correlations(grid_rows, ["split", "family"])),
        grid.anova(grid_rows),
        grid.t_tests(grid_rows),
        grid.drops(grid_rows),
        grid.score_matrix(grid_rows, "dataset", "split", ["a"], percent=True),
    ):
        out.collect()
    parts = parts_of(spark, [(0, "train"), (1, "test")])
    values = spark.createDataFrame([(0, 1.0), (1, 1.0)], "id bigint, value double")
    assert all(r["density"] is None for r in audit.density_histogram(parts, values).collect())


def test_stored_pairs_are_not_built_in_memory(spark):
    pairs = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.5), (0, 2, 0.25), (2, 0, 0.25), (1, 2, 1.0), (2, 1, 1.0)], "i bigint, j bigint, distance double")
    sets = {0: ("test", "train", "train"), 1: ("train", "test", "test")}
    parts = spark.createDataFrame([("r", s, i, v) for s, row in sets.items() for i, v in enumerate(row)], "splitter string, split_index int, id bigint, `set` string")
    best = audit.best_similarities_stored(parts, pairs)
    assert {(r["split_index"], r["id"]): r["similarity"] for r in best.collect()} == {(0, 0): 0.75, (1, 1): 0.5, (1, 2): 0.75}
    assert "leftHint=(strategy=merge)" in best._jdf.queryExecution().optimizedPlan().toString()
