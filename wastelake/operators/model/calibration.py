"""Monotone map from demand pressure to fullness percent."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from wastelake.operators.quantiles import exact_quantiles

# Target shares of the five ratings, rating error, ceiling, knot levels.
TARGET_SHARES = (0.10, 0.20, 0.40, 0.20, 0.10)
RATING_ERROR = 0.10
MAX_FILL = 120.0
KNOT_LEVELS = (20.0, 50.0, 80.0, 100.0)
LEVEL_OFFSET = 1.5
ZERO_CEILING = 0.95
ZERO_MARGIN = 0.005


def true_shares(observed: tuple[float, ...] = TARGET_SHARES, error: float = RATING_ERROR) -> np.ndarray:
    """Shares of the ratings before errors, when a rating slips to its neighbours with probability `error`.

    Every rating is seen as often as it is kept plus as often as a neighbour slips to it; the shares before errors are those
    that make this add up to the observed ones.
    """
    seen = np.array(observed, float)
    ways = np.full(len(seen), 2.0)
    ways[[0, -1]] = 1.0
    shares = seen
    for _ in range(100):
        slip = error * shares / ways
        received = np.pad(slip[1:], (0, 1)) + np.pad(slip[:-1], (1, 0))
        shares = (seen - received) / (1 - error)
    return shares


def knot_fractions(zero_share: float) -> list[float]:
    """Quantile positions of the four knots. A zero atom above the first moves the positions towards 1, in proportion."""
    at = np.cumsum(true_shares())[:-1]
    if zero_share >= at[0]:
        first = min(ZERO_CEILING, zero_share + ZERO_MARGIN)
        at = 1 - (1 - at) * (1 - first) / (1 - at[0])
    return at.tolist()


def quantile_knots(pressures: DataFrame, column: str = "pressure") -> DataFrame:
    """One row with the four knots of the observed pressures.

    Needs as many values as knots, all finite and not negative; else a ValueError tells the counts.
    """
    p = F.col(column)
    wrong = p.isNotNull() & ~(p.between(0.0, np.finfo(float).max))
    seen = pressures.agg(F.avg((p == 0).cast("double")).alias("zero"), F.count(p).alias("n"), F.count_if(wrong | F.isnan(p)).alias("wrong")).first()
    if seen["n"] < len(KNOT_LEVELS) or seen["wrong"]:
        raise ValueError(f"calibration needs {len(KNOT_LEVELS)} finite pressures of 0 or more: {seen['n']} values, {seen['wrong']} unusable")
    fractions = {f"knot_{i + 1}": q for i, q in enumerate(knot_fractions(seen["zero"]))}
    return exact_quantiles(pressures.withColumn("all", F.lit("all")), ["all"], column, fractions).drop("all")


def rising_knots(knots: DataFrame) -> list[float]:
    """The knots as numbers; equal or falling knots cannot carry a monotone map."""
    values = list(knots.first())
    if any(b <= a for a, b in zip(values, values[1:])):
        raise ValueError(f"knots must rise: {values}")
    return values


def fullness(pressure: Column, residue: Column, knots: list[float]) -> Column:
    """Percent filled: what a bin has room for above its residue, less the part of it that the pressure leaves empty.

    Each stretch between knots fills its share of the room evenly. The share that all of them leave shrinks by a factor e for
    every further width of the last stretch. No pressure, no answer.
    """
    room = MAX_FILL - LEVEL_OFFSET
    shares = np.diff([0.0, *((level - LEVEL_OFFSET) / room for level in KNOT_LEVELS)]).tolist()
    widths = np.diff([0.0, *knots]).tolist()
    empty = (1.0 - sum(shares)) * F.exp(F.least((knots[-1] - pressure) / widths[-1], F.lit(0.0)))
    for end, width, share in zip(knots, widths, shares):
        empty = empty + share * F.least(F.greatest((end - pressure) / width, F.lit(0.0)), F.lit(1.0))
    level = residue + (MAX_FILL - residue) * (1.0 - empty)
    return F.when(pressure.isNotNull(), F.least(F.greatest(level, F.lit(0.0)), F.lit(MAX_FILL)))
