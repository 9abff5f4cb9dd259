"""Profiles, audits and drift tables of daily data."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wastelake.functions import bands as B, dates as D
from wastelake.session import materialize


def _pairs(columns: list[str], missing: str | None) -> Column:
    value = lambda c: F.col(c).cast("string") if missing is None else F.coalesce(F.col(c).cast("string"), F.lit(missing))
    return F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), value(c).alias("value")) for c in columns]))


def value_counts(rows: DataFrame, columns: list[str], by: list[str] = [], missing: str | None = None) -> DataFrame:
    """Rows per (by, feature, value): one shuffle of combined counts for all columns together."""
    return rows.select(*by, _pairs(columns, missing).alias("f")).groupBy(*by, "f.feature", "f.value").agg(F.count("*").alias("rows"))


#: Examples a column profile shows.
EXAMPLES = 3


def column_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Type, rows, missing, distinct, smallest and largest text value and the most frequent examples of each column."""
    n = materialize(value_counts(rows, columns), "value-counts")
    out = n.groupBy("feature").agg(
        F.sum("rows").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("rows"))), F.lit(0)).alias("missing"),
        F.count("value").alias("distinct"), F.min("value").alias("smallest"), F.max("value").alias("largest"),
    )
    place = F.row_number().over(W.partitionBy("feature").orderBy(F.col("rows").desc(), "value"))
    top = n.where("value is not null").withColumn("place", place).where(F.col("place") <= EXAMPLES)
    examples = top.groupBy("feature").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("examples"))
    kinds = F.create_map(*[F.lit(v) for c, kind in rows.dtypes if c in columns for v in (c, kind)])
    out = out.join(examples, "feature", "left").withColumn("type", kinds[F.col("feature")])
    return out.withColumn("missing_pct", 100.0 * F.col("missing") / F.col("rows"))


@dataclass(frozen=True)
class Expected:
    """What a daily table has to hold: rows and bins in all, bins of the registry, and the days of every bin."""

    rows: int
    daily_bins: int
    registry_bins: int
    start: date
    end: date


def range_audit(days: DataFrame, registry: DataFrame, expected: Expected, attributes: list[str]) -> DataFrame:
    """Violation counters of the daily table as a whole and against the registry (id and the attributes).

    Days are folded to a row per bin first: rows, first and last day, and the attributes of the last day.
    """
    last = F.max_by(F.struct(*attributes), "date").alias("own")
    bins = materialize(days.groupBy("bin_id").agg(F.count("*").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"), last), "bin-ranges")
    known = registry.select(F.col("id").alias("bin_id"), F.struct(*attributes).alias("registered"))
    both = bins.join(known, "bin_id", "left")
    held = F.col("registered").isNotNull()
    span = (expected.end - expected.start).days + 1
    differs = sum((held & ~F.col(f"own.{c}").eqNullSafe(F.col(f"registered.{c}"))).cast("long") for c in attributes)
    wrong = lambda found, want: (F.coalesce(found, F.lit(0)) != want).cast("long")
    rules = {
        "wrong_total_rows": wrong(F.sum("rows"), expected.rows),
        "wrong_daily_bin_count": wrong(F.count("*"), expected.daily_bins),
        "outside_registry": F.count_if(~held),
        "incomplete_bin_ranges": F.count_if((F.col("first") != F.lit(expected.start)) | (F.col("last") != F.lit(expected.end))),
        "wrong_rows_per_bin": F.count_if(F.col("rows") != span),
        "registry_attribute_mismatches": F.coalesce(F.sum(differs), F.lit(0)),
    }
    flat = both.agg(*[test.cast("bigint").alias(name) for name, test in rules.items()])
    out = flat.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("rows")) for r in rules])).alias("r")).select("r.*")
    return out.unionByName(registry.agg(wrong(F.count("*"), expected.registry_bins).alias("rows")).select(F.lit("wrong_registry_count").alias("rule"), "rows"))


def domain_audit(days: DataFrame) -> DataFrame:
    """Violation counters of the daily table in one pass."""
    s, y, day = F.col("collection_status"), F.col("fill_level"), F.col("date")
    c28, m28, qr = F.col("collections_last_28d"), F.col("missed_collections_28d"), F.col("qr_alerts")
    cap = F.col("capacity_m3")
    rules = {
        "invalid_targets": y.isNotNull() & ~y.between(0, 4),
        "labels_on_unsuccessful_days": y.isNotNull() & ~B.is_success(s),
        "unknown_statuses": ~s.isin(*B.STATUSES),
        "infinite_numeric": F.isnan(cap) | (F.abs(cap) == F.lit(float("inf"))),
        "negative_exposure": F.col("resident_factor") < 0,
        "negative_qr": qr < 0,
        "noninteger_qr": qr % 1 != 0,
        "negative_holidays": F.col("holidays_since_last_collection") < 0,
        "collections_last_28d_invalid": ~c28.between(0, 28) | (c28 % 1 != 0),
        "missed_collections_28d_invalid": ~m28.between(0, 28) | (m28 % 1 != 0),
        "counter_sum_over_28": (c28 + m28) > 28,
        "invalid_calendar": (F.col("day_of_week") != D.iso_day_of_week(day)) | (F.col("week_of_year") != F.weekofyear(day)) | (F.col("month") != F.month(day)) | (F.col("season") != D.season(day)),
    }
    flat = days.agg(*[F.count_if(test).alias(name) for name, test in rules.items()])
    return flat.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("rows")) for r in rules])).alias("r")).select("r.*")


def split_profile(rows: DataFrame, registry_bins: int) -> DataFrame:
    """Per split: rows, labels, bins, sites, bins and sites unseen in train, registry coverage."""
    per_bin = rows.groupBy("split", "bin_id").agg(F.count("*").alias("n"), F.count("fill_level").alias("labels"), F.min("site_id").alias("site_id"))
    train_bins = per_bin.where(F.col("split") == "train").select("bin_id").withColumn("known_bin", F.lit(True))
    per_site = per_bin.groupBy("split", "site_id").agg(F.count("*").alias("bins"))
    train_sites = per_site.where(F.col("split") == "train").select("site_id").withColumn("known_site", F.lit(True))
    a = per_bin.join(train_bins, "bin_id", "left").groupBy("split").agg(
        F.sum("n").alias("rows"), F.sum("labels").alias("labeled_rows"), F.count("*").alias("bins"), F.count_if(F.col("labels") > 0).alias("labeled_bins"), F.count_if(F.col("known_bin").isNull()).alias("unseen_bins")
    )
    b = per_site.join(train_sites, "site_id", "left").groupBy("split").agg(F.count("*").alias("sites"), F.count_if(F.col("known_site").isNull()).alias("unseen_sites"))
    return a.join(b, "split").withColumn("registry_coverage_pct", 100.0 * F.col("bins") / F.lit(registry_bins))


def target_distribution(days: DataFrame) -> DataFrame:
    """Rows per label (missing is -1) by date and five dimensions."""
    banded = days.withColumns(
        {"capacity_range": B.capacity_band(F.col("capacity_m3")), "qr_range": B.qr_band(F.col("qr_alerts")), "target": F.coalesce(F.col("fill_level"), F.lit(-1))}
    )
    return value_counts(banded, ["date", "waste_type", "capacity_range", "sub_district", "object_group", "qr_range"], ["target"], "nan")


def label_availability(days: DataFrame) -> DataFrame:
    return days.groupBy("date").agg(F.count("*").alias("rows"), (F.count("fill_level") / F.count("*")).alias("labeled_share"))


def category_drift(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per split and feature: distinct values, values unseen in train and rows that carry them."""
    n = value_counts(rows, columns, ["split"], B.MISSING)
    train = n.where(F.col("split") == "train").select("feature", "value", F.lit(True).alias("known"))
    unseen = F.col("known").isNull()
    return n.join(train, ["feature", "value"], "left").groupBy("split", "feature").agg(
        F.count("*").alias("distinct_values"), F.count_if(unseen).alias("unseen_values"), F.sum(F.when(unseen, F.col("rows")).otherwise(0)).alias("unseen_rows")
    )


def numeric_drift(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Known rows, missing percent, mean and population deviation per split and feature."""
    stats = [F.struct(F.lit(c).alias("feature"), F.count(F.col(c)).alias("known_rows"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std_population")).alias(c) for c in columns]
    flat = rows.groupBy("split").agg(F.count("*").alias("labeled_rows"), *stats)
    long = flat.select("split", "labeled_rows", F.explode(F.array(*columns)).alias("s")).select("split", "labeled_rows", "s.*")
    return long.withColumn("missing_pct", 100.0 * (1 - F.col("known_rows") / F.col("labeled_rows")))


def label_coverage(bins: DataFrame, days: DataFrame) -> DataFrame:
    """Every registry bin with its history rows, labels and issues; expects canonical_district and contradictory."""
    n = days.groupBy(F.col("bin_id").alias("id")).agg(F.count("*").alias("rows"), F.count("fill_level").alias("labeled_rows"))
    rows = bins.join(n, "id", "left")
    return rows.select(
        "id", F.col("rows").isNotNull().alias("has_daily_history"), F.coalesce("labeled_rows", F.lit(0)).alias("labeled_rows"),
        F.col("object_group").isNull().alias("missing_object_group"), F.col("canonical_district").isNull().alias("ambiguous_district"),
        (~B.is_finite(F.col("capacity_m3")) | (F.coalesce("capacity_m3", F.lit(0.0)) <= 0)).alias("invalid_capacity"), F.col("contradictory").alias("contradictory_site_districts"),
    )


def correlated_features(rows: DataFrame, columns: list[str], limit: float = 0.8) -> DataFrame:
    """Pairs with a strong linear correlation, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    flat = rows.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    long = F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"`{a}|{b}`").alias("correlation")) for a, b in pairs]))
    return flat.select(long.alias("r")).select("r.*").where(F.abs("correlation") >= limit)


def importance_rollup(importances: DataFrame, names: DataFrame) -> DataFrame:
    """Encoded-column importances summed to their original feature; names: encoded, feature."""
    return importances.join(names, "encoded").groupBy("feature").agg(F.sum("importance").alias("importance"), F.count("*").alias("columns"))


def monotone_audit(days: DataFrame, value: str, upper: float) -> DataFrame:
    """Falls of a value between resets, and values outside 0..upper; a success resets the next day."""
    w = W.partitionBy("bin_id").orderBy("date")
    rows = days.withColumns({"prev": F.lag(value).over(w), "reset": F.coalesce(F.lag(B.is_success(F.col("collection_status"))).over(w), F.lit(True))})
    v = F.col(value)
    return rows.agg(F.count(v).alias("known_rows"), F.count_if(~F.col("reset") & (v < F.col("prev") - 1e-9)).alias("falls"), F.count_if((v < 0) | (v > upper)).alias("out_of_bounds"))


def row_equality(source: DataFrame, enriched: DataFrame, keys: list[str]) -> DataFrame:
    """Rows lost, added or changed by an enrichment; only new columns may differ."""
    columns = [c for c in source.columns if c not in keys]
    left = source.select(*keys, F.struct(*columns).alias("l"), F.lit(True).alias("in_l"))
    right = enriched.select(*keys, F.struct(*columns).alias("r"), F.lit(True).alias("in_r"))
    both = left.join(right, keys, "full")
    present = F.col("in_l").isNotNull() & F.col("in_r").isNotNull()
    return both.agg(
        F.count("*").alias("rows"), F.count_if(F.col("in_r").isNull()).alias("lost"), F.count_if(F.col("in_l").isNull()).alias("added"), F.count_if(present & ~F.col("l").eqNullSafe(F.col("r"))).alias("changed")
    ).withColumn("new_columns", F.lit(",".join(sorted(set(enriched.columns) - set(source.columns)))))
