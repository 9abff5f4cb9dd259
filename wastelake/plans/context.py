"""The frame of a question: map rectangle, reference time, scope and period."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from wastelake.functions import geo as G


#: Modes of a period, and whether the mode takes dates.
MODES = {"recent": False, "explicit": True, "all_history": False}
RECENT_DAYS = 30


@dataclass(frozen=True)
class Period:
    """recent (last 30 local dates), explicit (end exclusive) or all_history."""

    mode: str = "recent"
    start: date | None = None
    end: date | None = None

    def __post_init__(self) -> None:
        given = [d for d in (self.start, self.end) if d is not None]
        takes_dates = MODES.get(self.mode)
        fits = takes_dates is not None and (len(given) == 2 and given[0] < given[1] if takes_dates else not given)
        if not fits:
            raise ValueError(f"a period is one of {', '.join(MODES)}; explicit alone has dates, start before end: got {self}")

    def dates(self, today: date) -> tuple[date | None, date]:
        """First date (None: since the first fact) and the date after the last."""
        tomorrow = today + timedelta(days=1)
        if MODES[self.mode]:
            return self.start, self.end
        return (tomorrow - timedelta(days=RECENT_DAYS) if self.mode == "recent" else None), tomorrow


ALL_HISTORY = Period("all_history")


@dataclass(frozen=True)
class Area:
    """bbox is (west, south, east, north); as_of replaces the wall clock."""

    bbox: tuple[float, float, float, float]
    as_of: datetime

    def __post_init__(self) -> None:
        west, south, east, north = self.bbox
        if west >= east or south >= north:
            raise ValueError("bounds must have positive spans")

    def bounds(self, period: Period | None = None, future: bool = False) -> tuple[datetime | None, datetime, date]:
        """Start, exclusive end for timestamps, exclusive end for dates; facts end with the reference time."""
        period, today = period or Period(), self.as_of.date()
        first, after = period.dates(today)
        planned = future and MODES[period.mode]
        if not planned and max(first or today, after - timedelta(days=1)) > today:
            raise ValueError(f"facts end on {today}; only schedules and plans reach further")
        stop = datetime.combine(after, time.min)
        return first and datetime.combine(first, time.min), stop if planned else min(stop, self.as_of), after


def in_period(column: Column, area: Area, period: Period | None = None, future: bool = False, calendar: bool = False) -> Column:
    """Half-open [start, end) on a wall-clock timestamp, or on a date with date bounds."""
    start, end, date_end = area.bounds(period, future)
    if calendar:
        low = F.lit(start.date()) if start else None
        high = F.lit(date_end)
    else:
        low = F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz") if start else None
        high = F.lit(end.isoformat(sep=" ")).cast("timestamp_ntz")
    test = column < high
    return test if low is None else (column >= low) & test


def in_area(df: DataFrame, area: Area) -> DataFrame:
    return df.where(G.in_bbox(F.col("latitude"), F.col("longitude"), area.bbox))


def in_scope(bins: DataFrame, area: Area, scope: str = "area", selection: DataFrame | None = None) -> DataFrame:
    """area: rectangle; global: every bin with usable coordinates; a selection narrows the area."""
    if scope == "global":
        return bins.where(G.valid_coords(F.col("latitude"), F.col("longitude")))
    rows = in_area(bins, area)
    if selection is None:
        return rows
    return rows.join(selection.select(F.col("bin_id").alias("id")).distinct(), "id", "left_semi")


def group_column(grouping: str | None) -> Column:
    allowed = (None, "none", "waste_type", "waste_carrier", "object_group", "site_id")
    if grouping not in allowed:
        raise ValueError(f"grouping must be one of {allowed}")
    return F.lit("all") if grouping in (None, "none") else F.col(grouping).cast("string")


def page(df: DataFrame, *order: Column, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page under a total order; the last column of `order` must be unique."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_total(df: DataFrame, *order: Column, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page whose rows carry the total of the whole listing and whether more rows follow."""
    total = df.agg(F.count("*").alias("total"))
    rows = page(df, *order, limit=limit, offset=offset)
    # one-row frame: the total is a scalar, so the join multiplies nothing
    return rows.join(total, F.lit(True)).withColumn("has_more", F.col("total") > F.lit(offset + limit))
