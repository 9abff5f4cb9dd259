"""Text normalisation shared by registry rules and searches."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def squeeze(c: Column) -> Column:
    """Trim and collapse any whitespace run to one space."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_address(c: Column) -> Column:
    return F.lower(squeeze(c))


def contains_ignore_case(c: Column, search: str | None) -> Column:
    """Substring match where %, _ and the escape sign stand for themselves; blank matches all."""
    wanted = (search or "").strip()
    if not wanted:
        return F.lit(True)
    escaped = wanted.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return c.ilike(f"%{escaped}%")


def null_if_blank(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)
