"""Tails, quantile and rank agreement against closed forms, enumeration and published values."""

import itertools
import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from riftsplit.functions import stats
from riftsplit.operators import metrics


def test_normal_tail_and_quantile(spark):
    zs = [0.0, 1e-8, 0.3, 1.0, 1.959963984540054, 3.4, 3.6, 5.0, 8.0, -2.0, 30.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", stats.normal_two_sided("z").alias("p")).collect()
    assert all(r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=1e-12) for r in got)
    ps = [1e-12, 1e-5, 0.01, 0.02425, 0.3, 0.5, 0.7, 0.975, 0.99999]
    rows = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, None, float("nan")]], "p double").select("p", stats.normal_quantile("p").alias("z")).collect()
    assert all(r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=1e-9) for r in rows[: len(ps)])
    assert [r["z"] for r in rows[len(ps) :]] == [None] * 4


def student_closed(t, n):
    """Two-sided p for whole degrees of freedom, as a finite sum."""
    angle = math.atan(t / math.sqrt(n))
    c, s, term, total = math.cos(angle), math.sin(angle), 1.0, 0.0
    if n % 2:
        for k in range(1, n - 1, 2):
            term = math.cos(angle) if k == 1 else term * c * c * (k - 1) / k
            total += term
        return 1 - 2 / math.pi * (angle + s * total)
    for k in range(0, n - 1, 2):
        term = 1.0 if k == 0 else term * c * c * (k - 1) / k
        total += term
    return 1 - s * total


def test_student_and_fisher_closed_forms(spark):
    cases = [(t, n) for t in (0.1, 0.9, 2.0, 6.0) for n in (1, 2, 3, 7, 30, 201)]
    got = spark.createDataFrame(cases, "t double, n int").select("t", "n", stats.student_two_sided("t", "n").alias("p"), stats.fisher_upper(F.col("t") * F.col("t"), F.lit(1), "n").alias("f")).collect()
    for r in got:
        assert r["p"] == pytest.approx(student_closed(r["t"], r["n"]), rel=1e-9, abs=1e-14) and r["f"] == pytest.approx(r["p"], rel=1e-9)
    # published upper five per cent points
    table = [(4.96, 1, 10), (3.89, 2, 12), (2.87, 4, 20), (18.51, 1, 2), (1.84, 30, 30)]
    got = spark.createDataFrame(table, "f double, a int, b int").select(stats.fisher_upper("f", "a", "b").alias("p")).collect()
    assert all(r["p"] == pytest.approx(0.05, abs=5e-4) for r in got)
    assert spark.range(1).select(stats.student_two_sided(F.lit(1.0), F.lit(0))).first()[0] is None


@pytest.mark.parametrize("n", [1, 63, 64, 65, 500, 1000])
def test_inversions(n):
    rng = np.random.default_rng(n)
    v, w = rng.integers(0, 20, n).astype(float), rng.integers(1, 4, n)
    assert metrics.inversions(v, w) == (np.triu(v[:, None] > v[None, :], 1) * w[:, None] * w[None, :]).sum()


def brute_kendall(x, y):
    """(tau-b, p) from all pairs, all permutations of small tie-free data, or the variance of ties."""
    n, pairs = len(x), list(itertools.combinations(range(len(x)), 2))
    sign = lambda v: (v > 0) - (v < 0)
    s = sum(sign(x[i] - x[j]) * sign(y[i] - y[j]) for i, j in pairs)
    a, b = (sum(v[i] != v[j] for i, j in pairs) for v in (x, y))
    ties = [[v.count(t) for t in set(v)] for v in (x, y)]
    if a == b == len(pairs) and n <= 7:
        order = sorted(range(n), key=lambda i: x[i])
        ranks = [sorted(y).index(y[i]) for i in order]
        inv = lambda p: sum(p[i] > p[j] for i, j in pairs)
        low = min(inv(ranks), len(pairs) - inv(ranks))
        every = [inv(p) for p in itertools.permutations(range(n))]
        p = min(1.0, 2 * sum(e <= low for e in every) / len(every))
    else:
        f2, f3, f5 = ([sum(g(t) for t in side) for side in ties] for g in (lambda t: t * (t - 1) / 2, lambda t: t * (t - 1) * (t - 2), lambda t: t * (t - 1) * (2 * t + 5)))
        var = (n * (n - 1) * (2 * n + 5) - sum(f5)) / 18 + 2 * f2[0] * f2[1] / (n * (n - 1)) + f3[0] * f3[1] / (9 * n * (n - 1) * (n - 2))
        p = math.erfc(abs(s / math.sqrt(var)) / math.sqrt(2))
    return s / math.sqrt(a * b), p


def test_kendall_with_and_without_ties(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for g, (n, top) in enumerate([(5, None), (7, None), (6, 3), (40, None), (150, 9), (300, 1000)]):
        x = rng.sample(range(10_000), n) if top is None else [rng.randrange(top) for _ in range(n)]
        y = rng.sample(range(10_000), n) if top is None else [rng.randrange(top) + v // 2 for v in x]
        rows += [(g, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
        want[g] = brute_kendall(x, y)
    df = spark.createDataFrame(rows, "g int, c int, x double, y double")
    got = metrics.ranking_agreement(metrics.ranking_comparison(df, ["g"], "c", "x", "y"), ["g"], "c").collect()
    assert len(got) == len(want)
    for r in got:
        assert (r["kendall_tau"], r["kendall_p_value"]) == (pytest.approx(want[r["g"]][0]), pytest.approx(want[r["g"]][1], rel=1e-9))


def test_exact_ks_equals_enumeration(spark):
    def enumerated(a, b, gap):
        orders = list(itertools.combinations(range(a + b), a))
        hit = 0
        for firsts in orders:
            x, far = 0, 0
            for i in range(a + b):
                x += i in firsts
                far = max(far, abs(x * b - (i + 1 - x) * a))
            hit += far >= gap
        return hit / len(orders)

    cases = [(a, b, gap) for a in range(1, 6) for b in range(1, 7) for gap in range(a * b + 1)]
    rows = spark.createDataFrame([(g / (a * b), a, b, g) for a, b, g in cases] + [(None, 3, 3, -1)], "d double, n1 bigint, n2 bigint, gap int")
    p = stats.kolmogorov_two_sided(F.col("d"), F.col("n1"), F.col("n2")).alias("p")
    for r in rows.select("*", p).collect():
        if r["d"] is None:
            assert r["p"] is None
        else:
            assert r["p"] == pytest.approx(enumerated(r["n1"], r["n2"], r["gap"]), abs=1e-12)
    # long sides agree with the limit
    far = rows.limit(1).select(F.lit(0.03).alias("d"), F.lit(9000).alias("n1"), F.lit(8000).alias("n2"))
    both = far.select(p, stats.kolmogorov_asymptotic(F.col("d"), F.col("n1"), F.col("n2")).alias("q")).first()
    assert both["p"] == pytest.approx(both["q"], rel=0.05)
    beyond = far.select(stats.kolmogorov_two_sided(F.col("d"), F.lit(10_001), F.col("n2")).alias("p"), stats.kolmogorov_asymptotic(F.col("d"), F.lit(10_001), F.col("n2")).alias("q")).first()
    assert beyond["p"] == beyond["q"]


def test_ranks_of_values_that_change_when_computed_again(spark):
    again = F.udf(lambda i: random.random(), "double").asNondeterministic()
    drawn = spark.range(60).select((F.col("id") % 2).alias("g"), "id", again("id").alias("v"))
    rows = metrics.average_ranks(drawn, ["g"], "v", "r").collect()
    for g in (0, 1):
        ordered = sorted((r for r in rows if r["g"] == g), key=lambda r: -r["v"])
        assert [r["r"] for r in ordered] == list(range(1, 31))
