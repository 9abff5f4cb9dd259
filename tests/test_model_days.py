"""The daily rows that every day of a forecast reads are worked out once."""

import pytest

from wastelake.catalog import calendar as CC, modeling as MO


def test_forecasts_share_the_daily_rows(spark, monkeypatch):
    made, asked = [], []
    monkeypatch.setattr(MO.S, "bin_days", lambda *_: made.append(1) or spark.createDataFrame([(1, "2024-06-01")], "bin_id long, date string"))
    monkeypatch.setattr(MO, "fitted", lambda *_, **__: (None, None))
    monkeypatch.setattr(CC, "next_day", lambda *_, end, days=None: asked.append((end, days)) or spark.createDataFrame([], "bin_id long"))
    monkeypatch.setattr(MO.T, "predict", lambda *_: (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        MO.BOOK.queries["predict_registry_days"](spark, "")
    assert len(made) == 1 and len(asked) == MO.FORECAST_DAYS and len({end for end, _ in asked}) == MO.FORECAST_DAYS
    assert all(days.inputFiles() and days.first() for _, days in asked)
