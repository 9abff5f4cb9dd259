"""Log-gamma, its derivatives, and the beta distribution's tail and quantile as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def ln_gamma(x: Column) -> Column:
    """Stirling series after shifting the argument up by eight; constant cost, about 1e-12 exact."""
    product = x
    for k in range(1, 8):
        product = product * (x + float(k))
    z = x + 8.0
    z2 = z * z
    series = (1.0 / 12 - (1.0 / 360 - (1.0 / 1260 - 1.0 / 1680 / z2) / z2) / z2) / z
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - F.ln(product)


def ln_beta(a: Column, b: Column) -> Column:
    return ln_gamma(a) + ln_gamma(b) - ln_gamma(a + b)


def digamma(x: Column) -> Column:
    """Derivative of the log-gamma: its series after shifting the argument up by eight."""
    z = x + 8.0
    z2 = z * z
    shift = sum((1.0 / (x + float(k)) for k in range(1, 8)), 1.0 / x)
    return F.ln(z) - 0.5 / z - (1.0 / 12 - (1.0 / 120 - (1.0 / 252 - 1.0 / 240 / z2) / z2) / z2) / z2 - shift


def trigamma(x: Column) -> Column:
    """Derivative of the digamma, as above."""
    z = x + 8.0
    z2 = z * z
    shift = sum((1.0 / ((x + float(k)) * (x + float(k))) for k in range(1, 8)), 1.0 / (x * x))
    return (1.0 + 0.5 / z + (1.0 / 6 - (1.0 / 30 - (1.0 / 42 - 1.0 / 30 / z2) / z2) / z2) / z2) / z + shift


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """use(value) with the value worked out once; inside a lambda each mention would be a new evaluation."""
    return F.transform(F.array(value), use)[0]


def _sure(v: Column) -> Column:
    """Not too near to zero to divide by."""
    return F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """Continued fraction of the incomplete beta function, left of its turning point.

    Terms are folded from the front with running ratios; their number follows the square root of the parameters, after
    which they change nothing.
    """
    terms = F.sequence(F.lit(1), (20 + 6 * F.ceil(F.sqrt(F.greatest(a, b, F.lit(1.0))))).cast("int"))

    def link(at: Column, term: Column) -> Column:
        both_ = F.struct(_sure(1.0 + term / at["c"]).alias("c"), (1.0 / _sure(1.0 + term * at["d"])).alias("d"))
        return _let(both_, lambda v: F.struct(v["c"].alias("c"), v["d"].alias("d"), (at["h"] * v["c"] * v["d"]).alias("h")))

    def both(at: Column, k: Column) -> Column:
        m = k.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.aggregate(F.array(even, odd), at, link)

    d = 1.0 / _sure(1.0 - (a + b) * x / (a + 1.0))
    return F.aggregate(terms, F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h")), both, lambda at: at["h"])


def beta_cdf(x: Column, a: Column, b: Column, ln_b: Column) -> Column:
    """Regularised incomplete beta function; `ln_b` is the log of the complete one (`ln_beta`)."""
    inside = F.least(F.greatest(x, F.lit(1e-300)), F.lit(1 - 1e-16))
    front = F.exp(a * F.ln(inside) + b * F.log1p(-inside) - ln_b)
    swap = inside > (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), F.when(swap, 1.0 - inside).otherwise(inside)
    value = front * _fraction(xx, aa, bb) / aa
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(swap, 1.0 - value).otherwise(value)


def beta_quantile(p: float, a: Column, b: Column, ln_b: Column, steps: int = 24) -> Column:
    """Inverse of the above: Newton steps on the log of the argument, kept in a bracket that closes with every step."""
    def step(at: Column, _: Column) -> Column:
        x = at["x"]
        slope = F.exp(a * F.ln(x) + (b - 1.0) * F.log1p(-x) - ln_b)  # of the cdf against ln x

        def bracket(over: Column) -> Column:
            new = x * F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), -over / _sure(slope))))
            ends = F.struct(F.when(over < 0, x).otherwise(at["low"]).alias("low"), F.when(over < 0, at["high"]).otherwise(x).alias("high"), new.alias("new"))
            return _let(ends, chosen)

        def chosen(v: Column) -> Column:
            between = F.when(v["low"] > 0, F.sqrt(v["low"] * v["high"])).otherwise(v["high"] / 16)
            fits = (v["new"] >= v["low"]) & (v["new"] <= v["high"]) & (v["new"] > 0) & (v["new"] < 1)
            return F.struct(v["low"].alias("low"), v["high"].alias("high"), F.when(fits, v["new"]).otherwise(between).alias("x"))

        return _let(beta_cdf(x, a, b, ln_b) - p, bracket)

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), F.least(a / (a + b), F.lit(1 - 1e-9)).alias("x"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda at: at["x"])
