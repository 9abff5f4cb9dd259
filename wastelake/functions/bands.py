"""Bands, classes and shares as pure column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Waste streams, statuses, group names and class limits of the domain.
WASTE_TYPES = ("Mixed municipal waste", "Paper/plastic waste", "Glass waste")
ALL_WASTE_TYPES = WASTE_TYPES + ("Food/organic waste", "Textiles")
SUCCESS = ("collected", "retry_collected")
STATUSES = ("none", "collected", "retry_collected", "failed", "missed")
RESIDENTIAL_GROUPS = (
    "Daugiabučiai namai",
    "Dvibučiai",
    "Daugiabučių/garažų bendrijos",
    "Sodų bendrijos",
    "Sodų/garažų bendrijos",
)
OTHER_GROUPS = (
    "Viešosios vietos",
    "Garažų bendrijos",
    "Viešosios įstaigos",
    "Juridiniai asmenys",
    "Komercinė paskirtis",
)
EXCLUDED_GROUP = "individualios valdos"
FILL_LIMITS = (20.0, 50.0, 80.0)
FILL_SHARES = {0: "0.2", 1: "0.5", 2: "0.8", 3: "1.0", 4: "1.5"}
MISSING = "__MISSING__"
AMBIGUOUS = "__AMBIGUOUS__"


def is_finite(c: Column) -> Column:
    """False for NULL, NaN and the infinities."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False))


def known_capacity(c: Column) -> Column:
    """Capacity with special numeric values taken out, so sums and means stay meaningful."""
    return F.when(is_finite(c), c)


def capacity_quality(c: Column) -> Column:
    return (
        F.when(c.isNull(), "missing").when(~is_finite(c), "invalid_source_value").otherwise("known")
    )


def _upper_bands(c: Column, limits: list[tuple[float, str]], last: str, missing: str) -> Column:
    start = F.when(c.isNull() | F.isnan(c), missing)
    return reduce(lambda acc, b: acc.when(c <= b[0], b[1]), limits, start).otherwise(last)


def capacity_band(c: Column) -> Column:
    """Right-closed capacity ranges in cubic metres."""
    d = c.cast("double")
    limits = [(0.0, "invalid"), (0.24, "small"), (1.1, "medium"), (3.0, "large"), (5.0, "very_large")]
    return F.when(d.isin(float("inf"), float("-inf")), "missing").otherwise(
        _upper_bands(d, limits, "extra_large", "missing")
    )


def qr_band(c: Column) -> Column:
    limits = [(0.0, "zero"), (1.0, "one"), (5.0, "2-5"), (20.0, "6-20"), (100.0, "21-100")]
    return _upper_bands(c.cast("double"), limits, "101+", "missing")


def density_band(density: Column, suppressed: Column) -> Column:
    return (
        F.when(F.coalesce(suppressed, F.lit(False)), "suppressed (assumed density)")
        .when(density.isNull(), "unavailable")
        .when(density < 11, "<11")
        .when(density < 50, "11–49")
        .when(density < 100, "50–99")
        .when(density < 200, "100–199")
        .otherwise("200+")
    )


def bin_category(waste_type: Column) -> Column:
    return (
        F.when(waste_type == WASTE_TYPES[0], "mixed")
        .when(waste_type == WASTE_TYPES[1], "paper_plastic")
        .when(waste_type == WASTE_TYPES[2], "glass")
        .otherwise("other")
    )


def fill_class(percent: Column) -> Column:
    """Fullness percent to class 0..4; the last limit is strict, the others inclusive."""
    steps = [(percent >= limit).cast("int") for limit in FILL_LIMITS] + [(percent > 100.0).cast("int")]
    return reduce(lambda a, b: a + b, steps)


def fill_share(level: Column) -> Column:
    """Assumed share of the capacity a predicted level stands for."""
    acc = None
    for value, share in FILL_SHARES.items():
        lit = F.lit(share).cast("decimal(3,1)")
        acc = F.when(level == value, lit) if acc is None else acc.when(level == value, lit)
    return acc


def is_success(status: Column) -> Column:
    return status.isin(*SUCCESS)
