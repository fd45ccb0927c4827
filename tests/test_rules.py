"""Rules at their edges: values beyond 2^53, scores on bin edges, empty sets, failing splitters."""

import threading
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from riftsplit.functions.bits import shingle_fingerprint
from riftsplit.operators import metrics as mt
from riftsplit.operators.cluster_split import _fill, butina_clusters
from riftsplit.operators.registry import SPLITTERS, register_splitter, run_all_splitters
from riftsplit.operators.splitters import sorted_split


@pytest.mark.parametrize(
    "kind,values",
    [
        ("bigint", [2**60 + i for i in (3, 2, 1, 0)]),
        ("decimal(30,2)", [Decimal(10**20) + i for i in (3, 2, 1, 0)]),
        ("string", ["d", "c", "b", "a"]),
        ("double", [3.5, 2.5, 1.5, None]),
    ],
)
def test_sorted_split_keeps_the_type(spark, kind, values):
    df = spark.createDataFrame(list(enumerate(values)), f"id bigint, v {kind}")
    got = {r["id"]: r["set"] for r in sorted_split(df, "id", "v", larger=True, test_size=0.5).collect()}
    assert {i for i, s in got.items() if s == "test"} == {0, 1}


def test_scores_on_bin_edges(spark):
    scores = [i / 10 for i in range(11)] + [0.05, 0.999]
    df = spark.createDataFrame([(s, 1) for s in scores], "y_pred double, y_true int")
    edges = np.linspace(0, 1, 11)
    left = sum(((np.array(scores) >= a) & (np.array(scores) < b)).sum() > 0 for a, b in zip(edges[:-1], edges[1:]))
    by_bin = {}
    for s in scores:
        by_bin.setdefault(int(np.searchsorted(edges[1:-1], s)), []).append(s)
    got = {r["bin"]: r["n"] for r in mt.calibration_bins(df, []).collect()}
    assert got == {b: len(v) for b, v in by_bin.items()} and left
    ece = 0.0
    for a, b in zip(edges[:-1], edges[1:]):
        inside = [s for s in scores if a <= s < b]
        if inside:
            ece += abs(np.mean(inside) - 1) * len(inside) / len(scores)
    assert abs(mt.calibration_error(df, []).first()["ece"] - ece) < 1e-12


def test_empty_sets_are_alone(spark):
    df = spark.createDataFrame([(0, []), (1, []), (2, [1, 2]), (3, [1, 2])], "id bigint, bits array<int>")
    got = {r["id"]: r["cluster"] for r in butina_clusters(df, "id", "bits", 8, 0.65).collect()}
    assert got[2] == got[3] and len({got[0], got[1], got[2]}) == 3


def test_fingerprints_do_not_span_rows(spark):
    texts = ["abcd", "", None, "abc", "bcdabcd", "éé\U0001f600é"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    got = {r["id"]: r["b"] for r in df.select("id", shingle_fingerprint(F.col("t"), 4, 64).alias("b")).collect()}

    def brute(t):
        codes = [ord(c) for c in t or ""]
        return sorted({sum(31 ** (3 - j) * codes[i + j] for j in range(4)) % 64 for i in range(len(codes) - 3)})

    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_a_splitter_failing_at_run_time_leaves_the_rest(spark):
    def broken(df, row_id, **_):
        return df.select(F.lit(0).alias("split_index"), F.col(row_id).alias("id"), F.raise_error("no").cast("string").alias("set"))

    register_splitter("broken_at_run_time", broken)
    parts, status = run_all_splitters(spark.range(20), "id", {"broken_at_run_time": {}, "random": {"n_splits": 1}})
    assert parts.count() == 20
    assert {r["splitter"]: r["ok"] for r in status.collect()} == {"broken_at_run_time": False, "random": True}


def test_cluster_picks_stay_below_the_quota():
    sizes = np.array([50, 30, 10, 5, 5])
    assert _fill([0, 1, 2, 3, 4], sizes, 20) == [2, 3, 4]
    assert _fill([0, 1], np.array([50, 30]), 10) == [1]


def test_hit_rate_per_group(spark):
    rows = [(g, i, float(i)) for g in ("a", "b", None) for i in range(10)]
    pred = spark.createDataFrame(rows, "g string, item int, score double")
    labels = spark.createDataFrame([(i, int(i >= 8)) for i in range(10)], "item int, y int")
    got = mt.hit_rate(pred, labels, "item", "score", "y", top_k=4, by=["g"]).collect()
    assert {r["g"] for r in got} == {"a", "b", None}
    assert all((r["hit_rate"], r["tp_count"], r["fp_count"], r["total_molecules"]) == (0.5, 2, 2, 10) for r in got)


def test_splitters_run_at_the_same_time(spark):
    """Each of two splitters waits until the other has begun."""
    both = threading.Barrier(2, timeout=30)

    def waits(df, row_id):
        both.wait()
        return df.select(F.lit(0).alias("split_index"), F.col(row_id).alias("id"), F.lit("train").alias("set"))

    register_splitter("waits_a", waits)
    register_splitter("waits_b", waits)
    try:
        parts, status = run_all_splitters(spark.range(5), "id", {"waits_b": {}, "no_such": {}, "waits_a": {}})
        assert [(r["splitter"], r["ok"]) for r in status.collect()] == [("waits_b", True), ("no_such", False), ("waits_a", True)]
        assert parts.groupBy("splitter").count().count() == 2
    finally:
        del SPLITTERS["waits_a"], SPLITTERS["waits_b"]
