"""Joins with the rules of the domain: keys checked, facts reduced before they fan out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from wastelake.operators.registry import checked_unique


def inner_by_bin(facts: DataFrame, bins: DataFrame) -> DataFrame:
    """Facts of known bins with the bin's stream and carrier."""
    return facts.join(bins.select(F.col("id").alias("bin_id"), "waste_type", "waste_carrier"), "bin_id")


def left_pre_aggregated(bins: DataFrame, **facts: DataFrame) -> DataFrame:
    """Counts of several facts per bin, each aggregated before its join, so rows never multiply."""
    out = bins
    for name, df in facts.items():
        out = out.join(df.groupBy(F.col("bin_id").alias("id")).agg(F.count("*").alias(name)), "id", "left")
    return out.withColumns({name: F.coalesce(name, F.lit(0)) for name in facts})


def null_safe(left: DataFrame, right: DataFrame, column: str, others: list[str]) -> DataFrame:
    """Equi join where a missing value of `column` matches a missing value."""
    r = right.withColumnsRenamed({c: f"r_{c}" for c in [column, *others]})
    cond = F.col(column).eqNullSafe(F.col(f"r_{column}"))
    for c in others:
        cond = cond & (F.col(c) == F.col(f"r_{c}"))
    return left.join(r, cond).drop(*[f"r_{c}" for c in [column, *others]])


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails when a lookup key repeats."""
    return left.join(checked_unique(right, keys), keys, "left")


def asof_prior(rows: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """Latest known value strictly before each row of a per-day frame."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(w))


def grid(left: DataFrame, values: list, name: str) -> DataFrame:
    """Every row for every value of a short fixed list."""
    return left.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
