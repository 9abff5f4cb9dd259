"""Radix quantiles over any range of doubles, and additive fingerprints."""

import numpy as np
from pyspark.sql import functions as F

from wastelake.operators.quantiles import exact_quantiles, image
from wastelake.sources import sinks as K

FRACTIONS = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p999": 0.999, "p100": 1.0}


def test_image_keeps_the_order_of_doubles(spark):
    rng = np.random.default_rng(2)
    values = [0.0, -0.0, 5e-324, 1e-320, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), 1.0, np.nextafter(1.0, 2), np.nextafter(1.0, 0), 8.0, np.nextafter(8.0, 0)]
    values += [float(v) for v in 10.0 ** rng.uniform(-300, 300, 500)]
    values = [float(v) for v in [*values, *(-v for v in values)]]
    got = {r["v"]: r["i"] for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", image(F.col("v")).alias("i")).collect()}
    bits = lambda v: int(np.float64(abs(v)).view("i8")) * (-1 if v < 0 else 1)
    assert all(got[v] == bits(v) for v in values)


def test_quantiles_over_300_decades_and_one_value(spark):
    rng = np.random.default_rng(3)
    groups = {"wide": 10.0 ** rng.uniform(-150, 150, 4001) * rng.choice([-1, 1], 4001), "same": np.full(1000, 7.25), "one": np.array([3.5]), "close": 1e9 + rng.integers(0, 3, 2000) * 1e-7, "ties": rng.integers(0, 4, 999).astype(float)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("one", None), ("none", None), ("one", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", FRACTIONS).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        ordered = np.sort(vs)
        for name, q in FRACTIONS.items():
            place = q * (len(vs) - 1)
            low = int(np.floor(place))
            high = min(low + 1, len(vs) - 1)
            assert got[g][name] == ordered[low] + (ordered[high] - ordered[low]) * (place - low)


def test_fingerprints_count_equal_rows_and_add_up(spark):
    rows = [(1, "a"), (2, "b"), (2, "b"), (3, None), (3, "")]
    of = lambda r: K.identity(K.fingerprint(spark.createDataFrame(r, "i int, t string"), ["i", "t"])).first()
    assert of(rows) == of(rows[::-1])
    swapped = [(1, "a"), (1, "a"), (2, "b"), (3, None), (3, "")]  # as many rows, other ones twice
    assert of(swapped) != of(rows) and of(rows + [(4, "x"), (4, "x")]) != of(rows + [(5, "y"), (5, "y")])
    assert of(rows[:3] + [(3, ""), (3, "")]) != of(rows)
    parts = K.fingerprint(spark.createDataFrame(rows, "i int, t string"), ["i", "t"], by=["i"])
    assert parts.count() == 3 and K.identity(K.merged(parts)).first() == of(rows)
    assert of([(9, "z")])["rows"] == 1 and K.identity(K.merged(parts.limit(0))).first()["rows"] == 0
