"""Bin-by-day calendars and look-back features.

Windows run over (bin, day) rows, so a partition holds at most one row per calendar day;
event logs are reduced to days before they get here.
"""

from __future__ import annotations

from calendar import monthrange
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wastelake.functions import bands as B, dates as D
from wastelake.operators import registry as R

CYCLES = (1, 7, 14, 21, 28)
SINGLE_DATE_CYCLE = 28
STATUS_CODES = {s: i for i, s in enumerate(B.STATUSES)}


def _upto_yesterday():
    return W.partitionBy("bin_id").orderBy("date").rowsBetween(W.unboundedPreceding, -1)


def _upto_today():
    return W.partitionBy("bin_id").orderBy("date").rowsBetween(W.unboundedPreceding, 0)


def _by_day():
    return W.partitionBy("bin_id").orderBy("date")


def _last_before(value: Column) -> Column:
    """Latest known value strictly before the row's day."""
    return F.last(value, ignorenulls=True).over(_upto_yesterday())


# --- calendar ------------------------------------------------------------------

def bin_day_grid(bins: DataFrame, schedule: DataFrame, population: DataFrame, start: date, end: date) -> DataFrame:
    """One row per day and bin that has a district, a planned date and an allocation."""
    planned = schedule.select(F.col("bin_id").alias("id")).distinct()
    base = bins.where(F.col("sub_district").isNotNull()).join(planned, "id", "left_semi")
    base = base.select(F.col("id").alias("bin_id"), "site_id", "waste_type", "capacity_m3", "sub_district", "object_group")
    joined = base.join(population.select("bin_id", "population_cell_id", "resident_factor"), "bin_id")
    days = joined.withColumn("date", F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))))
    return D.with_calendar(days)


def excluded_bin_counts(bins: DataFrame, schedule: DataFrame, population: DataFrame) -> DataFrame:
    """Bins the grid leaves out, by reason."""
    planned = schedule.select(F.col("bin_id").alias("id")).distinct().withColumn("planned", F.lit(True))
    known = population.select(F.col("bin_id").alias("id")).withColumn("allocated", F.lit(True))
    rows = bins.select("id", "sub_district").join(planned, "id", "left").join(known, "id", "left")
    here = F.col("sub_district").isNotNull()
    return rows.agg(
        F.count_if(~here).alias("without_district"),
        F.count_if(here & F.col("planned").isNull()).alias("without_schedule"),
        F.count_if(here & F.col("planned").isNotNull() & F.col("allocated").isNull()).alias("without_population"),
    )


def years_back(end: date, years: int) -> tuple[date, date]:
    """Inclusive range of whole years up to `end`; Feb 29 falls back to Feb 28."""
    year = end.year - years
    last = monthrange(year, end.month)[1]
    return date(year, end.month, min(end.day, last)) + timedelta(days=1), end


def range_by_years(ends: DataFrame, years: int) -> DataFrame:
    """The same range for a column of end dates."""
    return ends.withColumn("start", F.date_add(F.add_months(F.col("end"), -12 * years), 1))


def detect_cycles(schedule: DataFrame) -> DataFrame:
    """Per bin the shortest cycle whose residues give exactly the planned dates, else 28.

    The days a residue covers in the spanned whole months are counted in closed form, so no
    day of the span is materialised.
    """
    dates = schedule.select("bin_id", "date").distinct()
    span = dates.groupBy("bin_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count("*").alias("planned"))
    o = D.ordinal(F.col("date"))
    residues = dates.select("bin_id", o.alias("o"), F.explode(F.array(*[F.lit(c) for c in CYCLES])).alias("cycle")).groupBy("bin_id", "cycle").agg(
        F.sort_array(F.collect_set(F.col("o") % F.col("cycle"))).alias("residues")  # at most 28 values
    )
    first, last = D.ordinal(F.trunc("lo", "month")), D.ordinal(F.last_day("hi"))
    covered = F.aggregate(
        F.col("residues"),
        F.lit(0).cast("bigint"),
        lambda acc, r: acc + F.floor((last - r) / F.col("cycle")) - F.floor((first - 1 - r) / F.col("cycle")),
    )
    tested = residues.join(span, "bin_id").withColumn("fits", (covered == F.col("planned")) & (F.col("planned") > 1))
    rank = F.when(F.col("fits"), F.col("cycle")).when(F.col("cycle") == SINGLE_DATE_CYCLE, 1000)
    return (
        tested.withColumn("rank", rank)
        .where(F.col("rank").isNotNull())
        .groupBy("bin_id")
        .agg(F.min_by(F.struct("cycle", "residues"), "rank").alias("best"), F.max("planned").alias("planned"))
        .select("bin_id", "best.cycle", "best.residues", "planned")
    )


def project_schedule(cycles: DataFrame, start: date, end: date) -> DataFrame:
    """Planned dates of any range by repeating each bin's cycle."""
    days = cycles.withColumn("date", F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))))
    return days.where(F.array_contains("residues", (D.ordinal(F.col("date")) % F.col("cycle")).cast("int"))).select("bin_id", "date")


def holidays_since_success(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Holidays after the last success before the day, through the day before."""
    h = holidays.select("date", F.lit(1).alias("is_holiday"))
    rows = days.join(h, "date", "left").withColumn("is_holiday", F.coalesce("is_holiday", F.lit(0)))
    seen = F.sum("is_holiday").over(_upto_today())
    rows = rows.withColumn("seen", seen)
    before = F.coalesce(F.sum("is_holiday").over(_upto_yesterday()), F.lit(0))
    at_success = F.coalesce(_last_before(F.when(B.is_success(F.col("collection_status")), F.col("seen"))), F.lit(0))
    return rows.withColumn("holidays_since_last_collection", before - at_success).drop("seen", "is_holiday")


def trailing(event: Column, window: int, full: bool) -> Column:
    """Events in the `window` rows before the day; NULL until the window is full when asked."""
    w = _by_day().rowsBetween(-window, -1)
    n = F.coalesce(F.sum(event.cast("int")).over(w), F.lit(0))
    return F.when(F.count(F.lit(1)).over(w) == window, n) if full else n


def with_28_day_counters(days: DataFrame) -> DataFrame:
    s = F.col("collection_status")
    return days.withColumns(
        {"collections_last_28d": trailing(B.is_success(s), 28, False), "missed_collections_28d": trailing(s == "missed", 28, False)}
    )


def days_since_events(days: DataFrame) -> DataFrame:
    s, day = F.col("collection_status"), F.col("date")
    since = lambda test: F.datediff(day, _last_before(F.when(test, day)))
    return days.withColumns(
        {
            "days_since_last_successful_collection": since(B.is_success(s)),
            "days_since_last_collection_attempt": since(s != "none"),
            "days_since_previous_worker_rating": since(F.col("fill_level").isNotNull()),
        }
    )


def previous_values(days: DataFrame) -> DataFrame:
    return days.withColumns(
        {"previous_collection_status": F.lag("collection_status").over(_by_day()), "previous_worker_rating": _last_before(F.col("fill_level"))}
    )


def history_label_count(days: DataFrame) -> DataFrame:
    return days.withColumn("history_label_count", F.coalesce(F.count("fill_level").over(_upto_yesterday()), F.lit(0)))


def lagged_reports(days: DataFrame, reports: str = "reports") -> DataFrame:
    """Reports since the last success, today's excluded; NULL until the first success."""
    rows = days.withColumn("total", F.sum(reports).over(_upto_today()))
    before = F.col("total") - F.col(reports)
    at_success = _last_before(F.when(B.is_success(F.col("collection_status")), F.col("total")))
    return rows.withColumn("qr_alerts", before - at_success).drop("total")


def accumulate_since_reset(days: DataFrame, inflow: str, residue: str, capacity: str) -> DataFrame:
    """Inflow since the last success, with the residue left then, excess and pressure in percent."""
    rows = days.withColumn("total", F.sum(inflow).over(_upto_today()))
    ok = B.is_success(F.col("collection_status"))
    added = F.greatest(F.col("total") - _last_before(F.when(ok, F.col("total"))), F.lit(0.0))
    rows = rows.withColumns({"added": added, "residue_pct": 100 * _last_before(F.when(ok, F.col(residue)))})
    demand = F.col("added") + F.col(capacity) * F.col("residue_pct") / 100
    return rows.withColumns(
        {
            "added": F.when(F.col("residue_pct").isNotNull(), F.col("added")),
            "demand": demand,
            "excess": F.greatest(demand - F.col(capacity), F.lit(0.0)),
            "pressure": F.when(F.col("residue_pct").isNotNull(), 100 * F.col("added") / F.col(capacity)),
        }
    ).drop("total")


def attempt_chain_status(days: DataFrame) -> DataFrame:
    """Classify recorded attempts (bin_id, date, planned, ok or NULL) along their retry chain."""
    rows = days.withColumns(
        {"chain": F.sum(F.col("planned").cast("int")).over(_upto_today()), "next_planned": F.coalesce(F.lead("planned").over(_by_day()), F.lit(False))}
    )
    chain = W.partitionBy("bin_id", "chain").orderBy("date")
    rows = rows.withColumns(
        {
            "attempt": F.row_number().over(chain) - 1,
            "broken": F.coalesce(F.sum((~F.coalesce(~F.col("ok"), F.lit(False))).cast("int")).over(chain.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) > 0,
        }
    )
    in_chain = (F.col("chain") > 0) & (F.col("attempt") <= 2) & ~F.col("broken") & F.col("ok").isNotNull()
    status = (
        F.when(~in_chain, "none")
        .when(F.col("ok") & (F.col("attempt") == 0), "collected")
        .when(F.col("ok"), "retry_collected")
        .when((F.col("attempt") < 2) & ~F.col("next_planned"), "failed")
        .otherwise("missed")
    )
    return rows.withColumn("status", status).drop("chain", "broken", "next_planned")


# --- features --------------------------------------------------------------------

def look_back_features(days: DataFrame) -> DataFrame:
    """All look-back columns of a gap-free daily frame, each strictly before its day."""
    s = F.col("collection_status")
    rows = history_label_count(previous_values(days_since_events(days)))
    return rows.withColumns(
        {
            "collections_last_7d": trailing(B.is_success(s), 7, True),
            "collections_last_90d": trailing(B.is_success(s), 90, True),
            "missed_collections_last_90d": trailing(s == "missed", 90, True),
            "has_daily_history": F.lit(True),
        }
    )


NUMERIC_FEATURES = [
    "day_of_week", "week_of_year", "month", "capacity_m3", "resident_factor", "holidays_since_last_collection", "collections_last_28d",
    "missed_collections_28d", "qr_alerts", "days_since_last_successful_collection", "days_since_last_collection_attempt",
    "days_since_previous_worker_rating", "previous_worker_rating", "collections_last_7d", "collections_last_90d", "missed_collections_last_90d",
]
CATEGORICAL_FEATURES = ["season", "waste_type", "sub_district", "object_group", "previous_collection_status"]


def enriched_days(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Daily rows with all supplied counters: holidays, 28-day counts and reports."""
    return lagged_reports(with_28_day_counters(holidays_since_success(days, holidays)))


def feature_matrix(days: DataFrame, bins: DataFrame, aliases: DataFrame) -> DataFrame:
    """The 16 numeric and 5 categorical model inputs of every bin-day, plus keys, label and flag."""
    district = R.ambiguous_districts(bins, aliases).select(F.col("id").alias("bin_id"), F.col("sub_district").alias("district"))
    rows = look_back_features(days).join(district, "bin_id").withColumn("sub_district", F.col("district"))
    return normalize_features(rows)


def normalize_features(rows: DataFrame) -> DataFrame:
    """Clean inputs: trimmed groups, finite numbers, capacity band and quality flag."""
    group = F.nullif(F.trim("object_group"), F.lit(""))
    rows = rows.withColumns({"object_group": group, "capacity_range": B.capacity_band(F.col("capacity_m3"))})
    rows = R.quality_flag(rows)
    keep = ["bin_id", "site_id", "date", "fill_level", "capacity_range", "history_label_count", "has_daily_history", "input_quality_flag"]
    return R.clean_non_finite(rows, NUMERIC_FEATURES, CATEGORICAL_FEATURES).select(*keep, *NUMERIC_FEATURES, *CATEGORICAL_FEATURES)


def next_day_features(
    history: DataFrame, bins: DataFrame, today: date, aliases: DataFrame, holidays: DataFrame,
    population: DataFrame | None = None, day_counters: DataFrame | None = None,
) -> DataFrame:
    """Model inputs of every registry bin for the day after `today`, from history up to `today`.

    One grouped pass over the history: the newest status and rating travel as a packed
    (day, code) number, so the aggregate stays a hash aggregate with map-side combine.
    """
    day = today + timedelta(days=1)
    d, s = F.lit(day), F.col("collection_status")
    past = history.where(F.col("date") < d).select("bin_id", "date", "collection_status", "fill_level")
    code = F.element_at(F.create_map(*[F.lit(v) for kv in STATUS_CODES.items() for v in kv]), s)
    num = F.datediff("date", F.lit(date(1970, 1, 1)))
    within = lambda n: F.col("date") >= F.lit(day - timedelta(days=n))
    ok, missed, known = B.is_success(s), s == "missed", F.col("fill_level").isNotNull()
    agg = past.groupBy("bin_id").agg(
        F.count("*").alias("h_rows"),
        F.max(num * 8 + code).alias("h_last"),
        F.max(F.when(known, num * 8 + F.col("fill_level"))).alias("h_rating"),
        F.max(F.when(ok, F.col("date"))).alias("h_success"),
        F.max(F.when(s != "none", F.col("date"))).alias("h_attempt"),
        F.count("fill_level").alias("h_labels"),
        F.count_if(within(28)).alias("h_28"),
        F.count_if(within(28) & ok).alias("h_ok28"),
        F.count_if(within(28) & missed).alias("h_miss28"),
        F.count_if(within(7) & ok).alias("h_ok7"),
        F.count_if(within(90) & ok).alias("h_ok90"),
        F.count_if(within(90) & missed).alias("h_miss90"),
    )
    named = R.ambiguous_districts(bins, aliases).select(F.col("id").alias("bin_id"), "site_id", "waste_type", "capacity_m3", "sub_district", "object_group")
    rows = named.join(agg, "bin_id", "left")
    if population is not None:
        rows = rows.join(population.select("bin_id", "population_cell_id", "resident_factor"), "bin_id", "left")
    else:
        rows = rows.withColumns({"population_cell_id": F.lit(None).cast("int"), "resident_factor": F.lit(None).cast("double")})
    safe = ["holidays_since_last_collection", "collections_last_28d", "missed_collections_28d", "qr_alerts"]
    if day_counters is not None:
        supplied = day_counters.where(F.col("date") == d).select("bin_id", *[F.col(c).cast("double").alias(f"d_{c}") for c in safe])
        rows = rows.join(supplied, "bin_id", "left")
    else:
        rows = rows.withColumns({f"d_{c}": F.lit(None).cast("double") for c in safe})
    yesterday = F.lit((day - timedelta(days=1) - date(1970, 1, 1)).days)
    fresh = F.coalesce(F.floor(F.col("h_last") / 8) == yesterday, F.lit(False))
    status = F.element_at(F.array(*[F.lit(x) for x in B.STATUSES]), (F.col("h_last") % 8 + 1).cast("int"))
    calendar = holidays.where(F.col("date") < d).agg(F.collect_list("date").alias("calendar"))  # a few hundred dates
    rows = rows.join(calendar, F.lit(True)).withColumns({"fresh": fresh, "last_status": status})
    passed = F.size(F.filter("calendar", lambda h: h > F.col("h_success")))
    full = lambda n, c: F.when(F.col("fresh") & (F.col("h_rows") >= n), F.col(c))
    since = lambda c: F.datediff(d, F.col(c))
    rating_day = F.date_add(F.lit(date(1970, 1, 1)), F.floor(F.col("h_rating") / 8).cast("int"))
    rows = rows.withColumns(
        {
            "holidays_since_last_collection": F.coalesce("d_holidays_since_last_collection", F.when(F.col("fresh") & F.col("h_success").isNotNull(), passed)),
            "collections_last_28d": F.coalesce("d_collections_last_28d", F.when(F.col("h_28") == 28, F.col("h_ok28"))),
            "missed_collections_28d": F.coalesce("d_missed_collections_28d", F.when(F.col("h_28") == 28, F.col("h_miss28"))),
            "qr_alerts": F.coalesce("d_qr_alerts", F.when(F.col("fresh") & B.is_success(F.col("last_status")), 0.0)),
            "days_since_last_successful_collection": since("h_success"),
            "days_since_last_collection_attempt": since("h_attempt"),
            "days_since_previous_worker_rating": F.datediff(d, rating_day),
            "previous_worker_rating": F.col("h_rating") % 8,
            "collections_last_7d": full(7, "h_ok7"),
            "collections_last_90d": full(90, "h_ok90"),
            "missed_collections_last_90d": full(90, "h_miss90"),
            "previous_collection_status": F.when(F.col("fresh"), F.col("last_status")),
            "history_label_count": F.coalesce("h_labels", F.lit(0)),
            "has_daily_history": F.col("h_rows").isNotNull(),
            "date": d,
            "fill_level": F.lit(None).cast("int"),
        }
    )
    return normalize_features(D.with_calendar(rows))


# --- audits ------------------------------------------------------------------------

def sequence_audit(days: DataFrame) -> DataFrame:
    """Per bin: rows, first and last day, duplicate days and gaps.

    Days are counted per (bin, day) first, so repeated rows of one day never meet in a window.
    """
    per_day = days.groupBy("bin_id", "date").agg(F.count("*").alias("n"))
    gap = F.datediff("date", F.lag("date").over(_by_day())) > 1
    marked = per_day.withColumn("gap", F.coalesce(gap, F.lit(False)))
    return marked.groupBy("bin_id").agg(
        F.sum("n").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.sum(F.col("n") - 1).alias("duplicate_days"), F.count_if("gap").alias("gaps"),
    )


def counter_audit(days: DataFrame) -> DataFrame:
    """Supplied 28-day counters against recomputed ones, and the report counter after a success."""
    s = F.col("collection_status")
    rows = days.withColumns(
        {
            "c28": trailing(B.is_success(s), 28, True),
            "m28": trailing(s == "missed", 28, True),
            "after_success": F.coalesce(F.lag(B.is_success(s)).over(_by_day()), F.lit(False)),
        }
    )
    return rows.agg(
        F.count_if(F.col("c28").isNotNull()).alias("checked_rows"),
        F.count_if(F.col("c28") != F.col("collections_last_28d")).alias("collections_mismatch"),
        F.count_if(F.col("m28") != F.col("missed_collections_28d")).alias("missed_mismatch"),
        F.count_if(F.col("after_success") & (F.col("qr_alerts") != 0)).alias("reset_mismatch"),
    )


def static_change_audit(days: DataFrame, bins: DataFrame, columns: list[str]) -> DataFrame:
    """Bins whose static attributes vary over the days or differ from the registry, per attribute."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
    agg = [f(text(c)).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    per_bin = days.groupBy("bin_id").agg(*agg)
    reg = bins.select(F.col("id").alias("bin_id"), *[text(c).alias(f"{c}_reg") for c in columns])
    joined = per_bin.join(reg, "bin_id", "left")
    counts = [
        F.struct(
            F.lit(c).alias("attribute"),
            F.count_if(F.col(f"{c}_lo") != F.col(f"{c}_hi")).alias("changed_bins"),
            F.count_if((F.col(f"{c}_lo") != F.col(f"{c}_reg")) | (F.col(f"{c}_hi") != F.col(f"{c}_reg"))).alias("registry_mismatches"),
        ).alias(c)
        for c in columns
    ]
    return joined.agg(*counts).select(F.explode(F.array(*columns)).alias("r")).select("r.*")


# --- splits and completeness ---------------------------------------------------------

def validate_periods(periods: dict[str, tuple[date, date]], order: list[str]) -> None:
    """Named inclusive periods must be well formed, ordered and without overlap."""
    for name, (start, end) in periods.items():
        if start > end:
            raise ValueError(f"period {name} ends before it starts")
    for a, b in zip(order, order[1:]):
        if periods[a][1] >= periods[b][0]:
            raise ValueError(f"periods {a} and {b} overlap or are out of order")


def temporal_split(rows: DataFrame, periods: dict[str, tuple[date, date]]) -> DataFrame:
    """Adds the split name; a fixed handful of periods is a chain of range tests, not a join."""
    expr = None
    for name, (start, end) in periods.items():
        test = F.col("date").between(F.lit(start), F.lit(end))
        expr = F.when(test, name) if expr is None else expr.when(test, name)
    return rows.withColumn("split", expr).where(F.col("split").isNotNull())


def _bin_months(days: DataFrame) -> DataFrame:
    flag = F.expr("shiftleft(1L, day(date) - 1)")
    return days.groupBy(F.trunc("date", "month").alias("month"), "bin_id").agg(F.bit_or(flag).alias("mask"), F.count("*").alias("n"))


def month_completeness(days: DataFrame) -> DataFrame:
    """Per month: cohort, present and complete bins, calendar rows and the complete flag."""
    masks = _bin_months(days)
    cohort = masks.select("bin_id").distinct().agg(F.count("*").alias("cohort_bins"))
    full = F.expr("shiftleft(1L, day(last_day(month))) - 1")
    per = masks.groupBy("month").agg(
        F.count("*").alias("bins_present"), F.count_if(F.col("mask") == full).alias("bins_with_full_calendar"), F.sum(F.bit_count("mask")).alias("calendar_rows")
    )
    return per.join(cohort, F.lit(True)).withColumn("complete", F.col("bins_with_full_calendar") == F.col("cohort_bins"))


def cohort_by_first_day(days: DataFrame, month: date) -> DataFrame:
    """For every cutoff of the month: cohort (bins of day 1), missing and extra bins, valid flag."""
    masks = _bin_months(days.where(F.trunc("date", "month") == F.lit(month))).withColumn("in_cohort", F.col("mask").bitwiseAND(F.lit(1)) == 1)
    spread = masks.withColumn("cutoff", F.explode(F.sequence(F.lit(1), F.dayofmonth(F.last_day("month")))))
    prefix = F.expr("mask & (shiftleft(1L, cutoff) - 1)")
    full = F.expr("shiftleft(1L, cutoff) - 1")
    return (
        spread.groupBy("month", "cutoff")
        .agg(
            F.count_if("in_cohort").alias("cohort_bins"),
            F.count_if(F.col("in_cohort") & (prefix != full)).alias("missing_bins"),
            F.count_if(~F.col("in_cohort") & (prefix != 0)).alias("extra_bins"),
        )
        .withColumn("valid", (F.col("missing_bins") == 0) & (F.col("extra_bins") == 0) & (F.col("cohort_bins") > 0))
    )


def cumulative_cutoffs(labels: DataFrame, month: date, last_day: int) -> DataFrame:
    """Evidence per point at every inclusive cutoff day, from days up to it only.

    labels: waste_type, point_id, bin_id, date, fill_level. Days are aggregated once; a bin
    counts on the first day it is seen, so distinct bins become a running sum too.
    """
    rows = labels.where((F.trunc("date", "month") == F.lit(month)) & F.col("fill_level").isNotNull()).withColumn("day", F.dayofmonth("date"))
    key = ["waste_type", "point_id"]
    per_bin = rows.groupBy(*key, "bin_id", "day").agg(F.count("*").alias("n"), F.count_if(F.col("fill_level") == 4).alias("n4"))
    per_day = per_bin.groupBy(*key, "day").agg(F.sum("n").alias("labels"), F.sum("n4").alias("level4"), F.lit(1).alias("days"), F.lit(0).alias("bins"))
    first = per_bin.groupBy(*key, "bin_id").agg(F.min("day").alias("day")).groupBy(*key, "day").agg(
        F.lit(0).alias("labels"), F.lit(0).alias("level4"), F.lit(0).alias("days"), F.count("*").alias("bins")
    )
    merged = per_day.unionByName(first).groupBy(*key, "day").agg(*[F.sum(c).alias(c) for c in ("labels", "level4", "days", "bins")])
    w = W.partitionBy(*key).orderBy("day")  # at most 31 rows
    running = merged.select(*key, "day", *[F.sum(c).over(w).alias(c) for c in ("labels", "level4", "days", "bins")], F.coalesce(F.lead("day").over(w), F.lit(last_day + 1)).alias("until"))
    spread = running.where(F.col("day") <= last_day).withColumn("cutoff", F.explode(F.sequence(F.col("day"), F.least(F.col("until") - 1, F.lit(last_day)))))
    return spread.select(
        "cutoff", *key, F.col("labels").alias("assessments"), F.col("level4").alias("level4_count"), F.col("days").alias("assessed_days"), F.col("bins").alias("assessed_bins")
    )


def interval_distribution(rows: DataFrame, features: list[str]) -> DataFrame:
    """Rows per (split, feature, days); an unknown interval counts as -1."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c), F.lit(-1)).alias("days")) for c in features]))
    return rows.select("split", pairs.alias("p")).groupBy("split", "p.feature", "p.days").agg(F.count("*").alias("rows"))
