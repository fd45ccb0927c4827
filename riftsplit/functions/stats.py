"""Tail probabilities and the normal quantile as Spark expressions, usable on rows as well as on aggregates.

Spark SQL has no erf, log-gamma, Student, Fisher or inverse normal.  Series and continued fractions are folds over
short sequences, so everything stays in the JVM.  Only the exact p-values of a small ranking (`kendall_exact`) and of the
two-sample KS test (`kolmogorov_exact`) count permutations and paths on Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Two-sided 95 % point of the standard normal.
Z_95 = 1.959963984540054


def pearson(x: str, y: str) -> Column:
    """Correlation; null where a side is constant (the builtin raises there in ANSI mode).

    Rows with a null on either side are left out, as in the builtin.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y)))
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))


def _let(value: Column, body) -> Column:
    """``body(x)`` with x evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _number(x: Column | str) -> Column:
    """As a double; NaN counts as null."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    return F.when(~F.isnan(x), x)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number: Stirling's series, eight steps up."""

    def body(x: Column) -> Column:
        z = x + 8.0
        shift = F.ln(x)
        for i in range(1, 8):
            shift = shift + F.ln(x + float(i))
        series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3.0))) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0)))
        return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - shift

    return _let(x, body)


FRACTION_STEPS = 400  # of a continued fraction
TINY = 1e-300


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function (modified Lentz), as a fold."""
    safe = lambda v: F.when(F.abs(v) > TINY, v).otherwise(F.lit(TINY))

    def step(s: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        num = F.when(k % 2 == 0, even).otherwise(odd)
        fresh = F.struct((1 / safe(1 + num * s["d"])).alias("d"), safe(1 + num / s["c"]).alias("c"), s["h"].alias("h"))
        return _let(fresh, lambda f: F.struct(f["c"].alias("c"), f["d"].alias("d"), (f["h"] * f["c"] * f["d"]).alias("h")))

    first = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(2), F.lit(FRACTION_STEPS)), start, step, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function."""
    swap = x >= (a + 1) / (a + b + 2)
    sides = F.struct(F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b"), F.when(swap, 1 - x).otherwise(x).alias("x"), swap.alias("swap"))

    def body(s: Column) -> Column:
        a, b, x = s["a"], s["b"], s["x"]
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.log1p(-x))
        part = front * _beta_fraction(a, b, x) / a
        return F.when(s["swap"], 1 - part).otherwise(part)

    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(_let(sides, body))


def erfc(x: Column) -> Column:
    """Complement of the error function of a number that is not negative."""
    square = x * x
    # erf = 2 / sqrt(pi) * exp(-x^2) * (x + 2 x^3 / 3 + 4 x^5 / 15 + ...)
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(x.alias("t"), x.alias("s")),
        lambda s, n: _let(s["t"] * 2 * square / (2 * n + 1), lambda t: F.struct(t.alias("t"), (s["s"] + t).alias("s"))),
        lambda s: s["s"],
    )
    series = 1 - 2 / math.sqrt(math.pi) * F.exp(-square) * terms
    fraction = F.exp(-square) / math.sqrt(math.pi) / F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), x, lambda t, k: x + k / 2.0 / t)
    return F.when(x < 2.5, series).otherwise(fraction)


def normal_two_sided(z: Column | str) -> Column:
    """P(|Z| > |z|)."""
    return _let(F.abs(_number(z)) / math.sqrt(2.0), erfc)


def student_two_sided(t: Column | str, df: Column | str) -> Column:
    """P(|T| > |t|) with df degrees of freedom; null without any."""
    pair = F.struct(_number(t).alias("t"), _number(df).alias("d"))
    return _let(pair, lambda p: F.when(p["d"] > 0, incomplete_beta(p["d"] / 2, F.lit(0.5), p["d"] / (p["d"] + p["t"] * p["t"]))))


def fisher_upper(f: Column | str, d1: Column | str, d2: Column | str) -> Column:
    """P(F > f) with (d1, d2) degrees of freedom; null without any."""
    three = F.struct(_number(f).alias("f"), _number(d1).alias("a"), _number(d2).alias("b"))
    body = lambda s: incomplete_beta(s["b"] / 2, s["a"] / 2, s["b"] / (s["b"] + s["a"] * s["f"]))
    return _let(three, lambda s: F.when(F.least(s["a"], s["b"]) > 0, body(s)))


# Published coefficients of a rational approximation of the normal quantile (relative error 1e-9).
CENTRE_TOP = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
CENTRE_BASE = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
TAIL_TOP = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
TAIL_BASE = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
TAIL_FROM = 0.02425


def _polynomial(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column | str) -> Column:
    """Inverse normal distribution function, a rational approximation and one Halley step; null outside (0, 1)."""

    def body(p: Column) -> Column:
        small = F.least(p, 1 - p)  # the lower half; the sign is put back at the end
        tail = _let(F.sqrt(-2 * F.ln(small)), lambda q: _polynomial(TAIL_TOP, q) / _polynomial(TAIL_BASE, q))
        middle = _let(small - 0.5, lambda q: q * _polynomial(CENTRE_TOP, q * q) / _polynomial(CENTRE_BASE, q * q))
        guess = F.when(small < TAIL_FROM, tail).otherwise(middle)

        def better(x: Column) -> Column:
            u = (0.5 * erfc(F.abs(x) / math.sqrt(2.0)) - small) * math.sqrt(2 * math.pi) * F.exp(x * x / 2)
            return _let(u, lambda u: x - u / (1 + x * u / 2))

        return _let(guess, lambda x: better(x) * F.when(p > 0.5, -1.0).otherwise(1.0))

    return _let(_number(p), lambda p: F.when((p > 0) & (p < 1), body(p)))


EXACT_RANKING = 33  # longest ranking whose permutations are counted


@F.pandas_udf(DoubleType())
def _kendall_exact(discordant: pd.Series, n: pd.Series) -> pd.Series:
    out = []
    for d, m in zip(discordant, n, strict=True):
        if d is None or m is None or d != d or m != m or m < 2:
            out.append(None)
            continue
        m, most = int(m), int(m) * (int(m) - 1) // 2
        counts = np.ones(1)  # permutations of k values by their inversions, as shares
        for k in range(2, m + 1):
            counts = np.convolve(counts, np.full(k, 1.0 / k))
        low = min(int(d), most - int(d))
        out.append(1.0 if 2 * low == most else min(1.0, 2.0 * float(counts[: low + 1].sum())))
    return pd.Series(out, dtype="float64")


def kendall_p(s: Column, discordant: Column, n: Column, ties: dict[str, Column]) -> Column:
    """Two-sided p of a sum of pair signs: exact for up to 33 values without ties, else normal with the variance of ties.

    ``ties`` are, for each side x and y, sums over groups of t equal values: ``x2`` of t(t-1)/2, ``x3`` of t(t-1)(t-2) and
    ``x5`` of t(t-1)(2t+5).
    """
    m = n.cast("double")
    var = (m * (m - 1) * (2 * m + 5) - ties["x5"] - ties["y5"]) / 18 + 2 * ties["x2"] * ties["y2"] / F.nullif(m * (m - 1), F.lit(0.0))
    var = var + F.coalesce(ties["x3"] * ties["y3"] / F.nullif(9 * m * (m - 1) * (m - 2), F.lit(0.0)), F.lit(0.0))
    normal = normal_two_sided(s / F.nullif(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(0.0)))
    exact = (ties["x2"] == 0) & (ties["y2"] == 0) & (n <= EXACT_RANKING)
    # a Python function runs on every row, so the others are sent as nulls
    return F.when(exact, _kendall_exact(F.when(exact, discordant), n)).otherwise(normal)


EXACT_SIDE = 10_000  # longest side for which the paths of the two-sample KS test are counted


def ks_paths(n1: int, n2: int, gap: int) -> float:
    """Share of the orders of two samples whose distribution functions differ by ``gap`` / (n1 * n2) or more somewhere.

    An order is a lattice path from (0, 0) to (n1, n2).  The paths that stay inside the band are followed by their
    diagonals: a path at (x, y) came from (x - 1, y) with probability x / (x + y), from (x, y - 1) with y / (x + y).
    Memory is one diagonal; the work is that of the band, at most n1 * n2.
    """
    inside = np.zeros(n1 + 2)  # by x + 1, for the current diagonal
    inside[1] = 1.0
    for s in range(1, n1 + n2 + 1):
        # |x * n2 - (s - x) * n1| < gap, cut to the rectangle
        low = max(0, s - n2, (s * n1 - gap) // (n1 + n2) + 1)
        high = min(n1, s, -((-s * n1 - gap) // (n1 + n2)) - 1)
        if low > high:
            return 1.0
        x = np.arange(low, high + 1)
        step = (inside[low : high + 1] * x + inside[low + 1 : high + 2] * (s - x)) / s
        inside[max(0, low - 1) : high + 3] = 0.0
        inside[low + 1 : high + 2] = step
    return 1.0 - float(inside[n1 + 1])


@F.pandas_udf(DoubleType())
def _kolmogorov_exact(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    out = []
    for gap, a, b in zip(d, n1, n2, strict=True):
        if gap is None or gap != gap or a != a or b != b:
            out.append(None)
            continue
        a, b = sorted((int(a), int(b)))
        steps = round(gap * a * b)
        out.append(1.0 if steps <= 0 else min(1.0, max(0.0, ks_paths(a, b, steps))))
    return pd.Series(out, dtype="float64")


def kolmogorov_two_sided(d: Column, n1: Column, n2: Column) -> Column:
    """p-value of the two-sample KS statistic: exact while both sides have at most 10,000 rows, else asymptotic."""
    exact = F.greatest(n1, n2) <= EXACT_SIDE
    # a Python function runs on every row, so the others are sent as nulls
    return F.when(exact, _kolmogorov_exact(F.when(exact, d), n1, n2)).otherwise(kolmogorov_asymptotic(d, n1, n2))


def kolmogorov_asymptotic(d: Column, n1: Column, n2: Column) -> Column:
    """The limit for large sides, as a SQL series of 20 terms."""
    en = F.sqrt(n1.cast("double") * n2 / (n1 + n2))
    lam = en * d
    terms = None
    for j in range(1, 21):
        t = F.lit(2.0 * (-1.0) ** (j - 1)) * F.exp(F.lit(-2.0 * j * j) * lam * lam)
        terms = t if terms is None else terms + t
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), terms)))
