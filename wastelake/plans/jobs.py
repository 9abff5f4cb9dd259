"""Jobs that chain operators and write shared intermediate tables once."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, functions as F

from wastelake.operators import adequacy as AD, allocation as AL, planning as P, series as SE
from wastelake.session import materialize


def allocate(cells: DataFrame, bins: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells, serving points per polygon and points with residents.

    The nearest-point search is the dear step and every reader needs it, so its result is
    written once instead of being planned into each branch.
    """
    points = AL.collection_points(bins)
    serving = materialize(AL.serving_points(cells, points), "serving")
    return cells, serving, AL.point_residents(points, serving)


def next_day_plan(predictions: DataFrame, bins: DataFrame, today: date, threshold: int = P.DEFAULT_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Stops and stop bins for the day after `today`."""
    fills = P.due_bins(predictions, bins, threshold)
    stops = P.collection_stops(fills, today + timedelta(days=1))
    return stops, P.stop_bins(fills, stops)


def adequacy_run(cells: DataFrame, bins: DataFrame, days: DataFrame, policy: AD.Policy = AD.Policy()) -> DataFrame:
    """Adequacy features of every complete month of the daily rows.

    Nothing is published from daily rows that break a rule, or from a fit that ended at the edge of its range:
    both are a ValueError that tells what was found. A month counts when every bin has all of its days.
    """
    rejected = {r["rule"]: r["rows"] for r in AD.assessment_rejects(days, bins).collect() if r["rows"]}
    if rejected:
        raise ValueError(f"daily rows rejected: {rejected}")
    months = materialize(SE.month_completeness(days).where("complete").select("month"), "months")
    days = days.withColumn("month", F.trunc("date", "month")).join(months, "month", "left_semi").drop("month")
    cells, serving, points = allocate(cells, bins)
    grid = AD.area_type_grid(cells, points, serving, AD.pressure_thresholds(points, {"threshold": policy.pressure_quantile}), policy)
    counts = materialize(AD.assessment_counts(days, AD.bin_points(bins, points)), "assessments")
    priors = AD.beta_binomial_prior(counts)
    stuck = [(str(r["month"]), r["waste_type"]) for r in priors.where("at_bound").collect()]
    if stuck:
        raise ValueError(f"prior fits ended at a bound: {stuck}")
    estimates = AD.posterior_estimates(counts, points, priors, policy)
    return AD.adequacy_features(grid, estimates, months, policy)
