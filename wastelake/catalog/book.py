"""Collects queries next to their SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType

from wastelake.catalog.views import sql


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating columns and turn decimals to double, so two engines can be compared."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType, DecimalType)):
            c = F.round(c.cast("double"), digits)
            c = F.when(c == 0.0, F.lit(0.0)).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


class Book:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, twin: str | None = None, digits: int = 6, **views: str):
        """Register a query; `twin` is its SQL over the views."""

        def wrap(fn):
            self.queries[name] = lambda spark, sf: tidy(fn(spark, sf), digits)
            if twin is not None:
                self.oracles[name] = sql(twin, **views)
            return fn

        return wrap
