"""Hand-checked cases and properties."""

import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wastelake.functions import bands as B, beta as BE, dates as D, geo as G
from wastelake.operators import adequacy as AD, allocation as AL, area as AR, planning as P, series as SE, spatial as SP
from wastelake.operators.model import calibration as CA, metrics as M, sampling as SA, training as T
from wastelake.operators.quantiles import exact_quantiles
from wastelake.session import materialize
from wastelake.plans.context import Area, Period, page
from wastelake.sources import files as FI
from wastelake.streaming import logs as L

ALIASES = [("Verkių sen.", "Verkiai"), ("Naujosios Vilnios sen.", "Naujoji Vilnia")]


def column(df, name):
    return [r[name] for r in df.collect()]


def test_fill_class_limits(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 19.999, 20.0, 49.999, 50.0, 79.999, 80.0, 100.0, 100.001)], "p double")
    assert column(df.select(B.fill_class(F.col("p")).alias("c")), "c") == [0, 0, 1, 1, 2, 2, 3, 3, 4]


def test_capacity_bands(spark):
    df = spark.createDataFrame([(v,) for v in (None, float("nan"), -1.0, 0.0, 0.24, 1.1, 3.0, 5.0, 5.1)], "c double")
    got = column(df.select(B.capacity_band(F.col("c")).alias("b")), "b")
    assert got == ["missing", "missing", "invalid", "invalid", "small", "medium", "large", "very_large", "extra_large"]


def test_district_aliases(spark):
    from wastelake.operators.registry import canonical_districts

    rows = spark.createDataFrame([(1, " Verkių  sen. "), (2, "Naujoji  Vilnia"), (3, "Vilniaus")], "id long, sub_district string")
    out = canonical_districts(rows, spark.createDataFrame(ALIASES, "input string, canonical string")).orderBy("id")
    assert column(out, "canonical_district") == ["Verkiai", "Naujoji Vilnia", None]


def test_shared_exposure_by_capacity(spark):
    from wastelake.operators.registry import shared_exposure

    rows = [(1, 7, "Glass waste", "Viešosios vietos", 1.0, 0.0, []), (2, 7, "Glass waste", "Viešosios vietos", 3.0, 0.0, [])]
    df = spark.createDataFrame(rows, "id long, site_id long, waste_type string, object_group string, capacity_m3 double, resident_factor double, reasons array<string>")
    assert sorted(column(shared_exposure(df), "exposure")) == [25.0, 75.0]


def days_frame(spark, statuses, reports=None, levels=None, start=date(2024, 1, 1)):
    n = len(statuses)
    reports, levels = reports or [0] * n, levels or [None] * n
    rows = [(1, start + timedelta(days=i), statuses[i], levels[i], reports[i]) for i in range(n)]
    return spark.createDataFrame(rows, "bin_id long, date date, collection_status string, fill_level int, reports long")


def test_lagged_reports(spark):
    df = days_frame(spark, ["collected", "none", "none", "collected", "none"], [0, 1, 2, 4, 0])
    assert column(SE.lagged_reports(df).orderBy("date"), "qr_alerts") == [None, 0, 1, 3, 0]
    df = days_frame(spark, ["collected", "none", "none", "none", "none"], [0, 1, 2, 4, 0])
    assert column(SE.lagged_reports(df).orderBy("date"), "qr_alerts") == [None, 0, 1, 3, 7]


def cycle_days(spark, n=120, change_from=None):
    rows = []
    label = -1
    for i in range(n):
        status, level = "none", None
        if i % 3 == 1:
            status, label = "collected", label + 1
            level = None if label == 0 else (label - 1) % 5
        if change_from is not None and i >= change_from:
            status, level = "missed", None
        rows.append((status, level))
    return days_frame(spark, [r[0] for r in rows], None, [r[1] for r in rows])


def test_look_back_excludes_today(spark):
    rows = SE.look_back_features(cycle_days(spark)).orderBy("date").collect()
    assert rows[4]["previous_worker_rating"] is None
    assert rows[5]["previous_worker_rating"] == rows[4]["fill_level"]
    assert rows[5]["days_since_last_successful_collection"] == 1
    assert rows[6]["collections_last_7d"] is None and rows[7]["collections_last_7d"] == 2
    assert rows[89]["collections_last_90d"] is None and rows[90]["collections_last_90d"] == 30


def test_no_future_leakage(spark):
    names = ["previous_collection_status", "previous_worker_rating", "collections_last_7d", "history_label_count", "days_since_last_collection_attempt"]
    a = SE.look_back_features(cycle_days(spark)).orderBy("date").select(*names).collect()
    b = SE.look_back_features(cycle_days(spark, change_from=60)).orderBy("date").select(*names).collect()
    assert a[:61] == b[:61] and a[61:] != b[61:]


def test_order_independence(spark):
    df = cycle_days(spark)
    a = SE.look_back_features(df).orderBy("date").collect()
    b = SE.look_back_features(df.repartition(5)).orderBy("date").collect()
    assert a == b


def test_detect_cycle_forms(spark):
    start = date(2024, 3, 1)
    every = [(1, start + timedelta(days=i)) for i in range(31)]
    weekly = [(2, date(2024, 3, 4) + timedelta(days=7 * i)) for i in range(4)]
    single = [(3, date(2024, 3, 9))]
    odd = [(4, date(2024, 3, 9)), (4, date(2024, 3, 11))]
    df = spark.createDataFrame(every + weekly + single + odd, "bin_id long, date date")
    assert {r["bin_id"]: r["cycle"] for r in SE.detect_cycles(df).collect()} == {1: 1, 2: 7, 3: 28, 4: 28}


def test_years_back_leap_day():
    assert SE.years_back(date(2024, 2, 29), 1) == (date(2023, 3, 1), date(2024, 2, 29))


def test_holidays(spark):
    got = set(column(D.holiday_calendar(spark, 2024, 2024), "date"))
    assert {date(2024, 3, 31), date(2024, 4, 1), date(2024, 5, 5), date(2024, 6, 2), date(2024, 2, 16)} <= got and len(got) == 16


def test_failure_rate_and_fill_mean(spark):
    bins = spark.createDataFrame([(1, 1, "Glass waste", None, None, 1.0, 54.7, 25.2)], "id long, site_id long, waste_type string, waste_carrier string, object_group string, capacity_m3 double, latitude double, longitude double")
    levels = [0, 2, None, None, None, None, None, None, None, None]
    rows = [(i, 1, datetime(2024, 6, 10, i), i < 8, None, levels[i]) for i in range(10)]
    visits = spark.createDataFrame(rows, "id long, bin_id long, date timestamp_ntz, was_serviced boolean, non_serviced_reason string, fill_level int")
    area = Area((25.0, 54.0, 26.0, 55.0), datetime(2024, 6, 25))
    r = AR.service_summary(visits, bins, area).first()
    assert (r["successes"], r["attempts"], r["success_rate"]) == (8, 10, 0.8)
    f = AR.fill_summary(visits, bins, area).first()
    assert (f["observed"], f["missing"], f["ordinal_category_mean"]) == (2, 8, 1.0)
    none = AR.service_summary(visits, bins, area, period=Period("explicit", date(2024, 1, 1), date(2024, 1, 2)))
    assert none.count() == 0


def test_pages_cover_the_listing(spark):
    df = spark.range(0, 57).withColumn("k", F.col("id") % 5)
    got = [r["id"] for o in (0, 20, 40) for r in page(df, F.col("k"), F.col("id"), limit=20, offset=o).collect()]
    assert sorted(got) == list(range(57)) and len(set(got)) == 57


def square(x, y, s):
    return [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]


def test_hole_and_shared_boundary(spark):
    polys = [(1, [square(0.0, 0.0, 1.0), square(0.4, 0.4, 0.2)]), (2, [square(1.0, 0.0, 1.0)]), (3, [[[5.0, 5.0], [6.0, 6.0], [6.0, 5.0], [5.0, 6.5], [5.0, 5.0]]])]
    polygons = spark.createDataFrame(polys, "id long, rings array<array<array<double>>>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 0.5), (3, 0.4, 0.5), (4, 9.0, 9.0)], "id long, longitude double, latitude double")
    cover = {r["id"]: (r["polygon_id"], r["matches"]) for r in SP.membership(points, polygons, boundary=True).collect()}
    assert cover == {1: (None, 0), 2: (1, 2), 3: (1, 1), 4: (None, 0)}
    cast = {r["id"]: r["polygon_id"] for r in SP.membership(points, polygons).collect()}
    assert cast[2] == 2 and cast[4] is None
    assert column(SP.intersecting(polygons, (0.45, 0.45, 0.55, 0.55)), "id") == []
    assert sorted(column(SP.intersecting(polygons, (0.9, 0.2, 1.0, 0.3)), "id")) == [1, 2]
    assert {r["id"]: r["problem"] for r in SP.polygon_problems(polygons).collect()}[3] == "self_crossing"


def test_crowded_cell_is_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(SP, "HOT_CELL", 10)
    points = spark.range(0, 300).select("id", (F.col("id") * 0.00001).alias("longitude"), F.lit(0.001).alias("latitude"))
    polygons = spark.createDataFrame([(7, [square(0.0, 0.0, 0.002)])], "id long, rings array<array<array<double>>>")
    found = SP.membership(points, polygons)
    assert found.where("matches = 1").count() == 200 and found.count() == 300


def test_nearest_point_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = np.concatenate([rng.normal(0, 5, (200, 2)), rng.uniform(-30000, 30000, (60, 2)), [[9e6, 9e6]]])
    src = np.concatenate([rng.uniform(-40000, 40000, (80, 2)), [[0.0, 0.0], [-1.2e7, 8e6]]])
    points = spark.createDataFrame([(i, "a", float(x), float(y)) for i, (x, y) in enumerate(pts)], "point_id long, kind string, x double, y double")
    sources = spark.createDataFrame([(i, "a", float(x), float(y)) for i, (x, y) in enumerate(src)], "source_id long, kind string, x double, y double")
    got = {r["source_id"]: (r["point_id"], r["distance_m"]) for r in SP.nearest_point(sources, points).collect()}
    for i, s in enumerate(src):
        d = np.hypot(pts[:, 0] - s[0], pts[:, 1] - s[1])
        assert got[i][0] == int(np.argmin(d)) and math.isclose(got[i][1], d.min(), rel_tol=1e-9)


def test_nearest_point_of_crowded_boxes(spark, monkeypatch):
    monkeypatch.setattr(SP, "HOT_BOX", 20)
    monkeypatch.setattr(SP, "POINT_CHUNK", 3)
    rng = np.random.default_rng(4)
    pts = np.concatenate([rng.normal(0, 0.5, (60, 2)), [[300.0, 0.0], [300.0, 0.0], [0.0, 300.0]], rng.uniform(-900, 900, (40, 2))])
    src = np.concatenate([rng.normal(0, 0.5, (100, 2)), [[150.0, 150.0]] * 60, rng.uniform(-900, 900, (100, 2)), [[300.0, 1.0]]])
    points = spark.createDataFrame([(i, "a", float(x), float(y)) for i, (x, y) in enumerate(pts)] + [(999, "b", None, 1.0)], "point_id long, kind string, x double, y double")
    rows = [(i, "a", float(x), float(y)) for i, (x, y) in enumerate(src)]
    sources = spark.createDataFrame([*rows, rows[0], (None, "a", 300.0, 0.0), (5000, "a", None, 0.0), (5001, "b", 0.0, 0.0)], "source_id long, kind string, x double, y double")
    got = SP.nearest_point(sources, points).collect()
    found = {r["source_id"]: (r["point_id"], r["distance_m"]) for r in got}
    assert len(got) == len(found) == len(src) + 1 and found[None][0] == 60
    for i, s in enumerate(src):
        d2 = (pts[:, 0] - s[0]) ** 2 + (pts[:, 1] - s[1]) ** 2
        assert found[i] == (int(np.argmin(d2)), math.sqrt(d2.min()))


def nearest_by_hand(src, pts):
    return {(i, k): min((math.sqrt((p[0] - x) ** 2 + (p[1] - y) ** 2), j) for j, (q, p) in enumerate(pts) if q == k) for i, (k, (x, y)) in enumerate(src)}


def nearest_of(spark, src, pts):
    points = spark.createDataFrame([(i, k, float(x), float(y)) for i, (k, (x, y)) in enumerate(pts)], "point_id long, kind string, x double, y double")
    sources = spark.createDataFrame([(i, k, float(x), float(y)) for i, (k, (x, y)) in enumerate(src)], "source_id long, kind string, x double, y double")
    rows = SP.nearest_point(sources, points).collect()
    assert len(rows) == len(src)
    return {(r["source_id"], r["kind"]): (r["distance_m"], r["point_id"]) for r in rows}


def test_nearest_point_meets_sources_in_their_own_cells(spark, monkeypatch):
    """Sources among points need no pyramid, whatever the density: each moves with the points of one cell of a grid."""

    def refused(*_):
        raise AssertionError("walked the pyramid")

    monkeypatch.setattr(SP, "_by_boxes", refused)
    monkeypatch.setattr(SP, "HOT_BOX", 20)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # cells run over several batches
    rng = np.random.default_rng(6)
    place = lambda n, w: [tuple(p) for p in np.round(rng.uniform(-w, w, (n, 2)), 1)]
    pts = [("a", p) for p in place(300, 1500)] + [("a", p) for p in place(200, 20)] + [("b", p) for p in place(6, 30000)] + [("a", (5.0, 5.0))] * 3
    src = [("a", p) for p in place(150, 2500)] + [("b", p) for p in place(30, 30000)] + [("a", (5.0, 5.0))] * 50
    try:
        assert nearest_of(spark, src, pts) == nearest_by_hand(src, pts)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_nearest_point_does_not_search_for_kinds_without_points(spark, monkeypatch):
    seen, by_cells = [], SP._by_cells
    monkeypatch.setattr(SP, "_by_cells", lambda left, *a: seen.append(left.count()) or by_cells(left, *a))
    points = spark.createDataFrame([(1, "a", 0.0, 0.0)], "point_id long, kind string, x double, y double")
    sources = spark.createDataFrame([(1, "a", 3.0, 4.0), (1, "b", 3.0, 4.0), (2, None, 3.0, 4.0)], "source_id long, kind string, x double, y double")
    assert [tuple(r) for r in SP.nearest_point(sources, points).collect()] == [(1, "a", 1, 5.0)] and seen == [1]


@pytest.mark.parametrize("grids", [[], [(500.0, 16, 1)], [(10.0, 1, 30), (5_000.0, 2, 4)]])
def test_nearest_point_is_the_same_by_any_grids(spark, monkeypatch, grids):
    monkeypatch.setattr(SP, "GRIDS", grids)
    rng = np.random.default_rng(7)
    pts = [("a", tuple(p)) for p in np.round(np.concatenate([rng.normal(0, 3, (60, 2)), rng.uniform(-4000, 4000, (40, 2))]), 1)]
    src = [("a", tuple(p)) for p in np.round(np.concatenate([rng.normal(0, 30, (40, 2)), rng.uniform(-9000, 9000, (20, 2))]), 1)]
    assert nearest_of(spark, src, pts) == nearest_by_hand(src, pts)


def test_exact_quantiles_on_skewed_values(spark):
    rng = np.random.default_rng(5)
    values = list(np.concatenate([np.exp(rng.normal(0, 6, 500)), np.zeros(300)]))
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 4.0)], "g string, v double")
    rows = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", {"p10": 0.1, "p80": 0.8, "p99": 0.99, "top": 1.0}).collect()}
    for name, q in {"p10": 0.1, "p80": 0.8, "p99": 0.99, "top": 1.0}.items():
        assert math.isclose(rows["a"][name], np.percentile(values, 100 * q), rel_tol=1e-12, abs_tol=1e-12)
        assert rows["b"][name] == 4.0


def test_shared_point_pressure(spark):
    cells = spark.createDataFrame([(1, 100.0), (2, 200.0)], "id long, residents double").withColumns(
        {"suppressed": F.lit(False), "area_ha": F.lit(1.0), "population_known": F.lit(True)}
    )
    points = spark.createDataFrame([("Glass waste", 9, 3.0, 300.0, 2)], "waste_type string, point_id long, capacity_m3 double, point_residents double, bin_count long")
    serving = spark.createDataFrame([(1, "Glass waste", 9, 10.0), (2, "Glass waste", 9, 400.0)], "cell_id long, waste_type string, point_id long, distance_m double")
    thr = spark.createDataFrame([("Glass waste", 100.0)], "waste_type string, threshold double")
    g = {r["cell_id"]: r for r in AD.area_type_grid(cells, points, serving, thr).where("waste_type = 'Glass waste'").collect()}
    assert (g[1]["attributed_capacity_m3"], g[2]["attributed_capacity_m3"], g[1]["pressure"]) == (1.0, 2.0, 100.0)
    assert list(g[2]["reasons"]) == ["high_pressure", "long_access"]


def test_density_codes(spark):
    df = spark.createDataFrame([(1, "<11", 20000.0), (2, "30", 10000.0), (3, None, 10000.0), (4, "x", 10000.0)], "id long, density_text string, area_m2 double")
    rows = AL.parse_density(df).orderBy("id").collect()
    assert [r["residents"] for r in rows] == [10.0, 30.0, 0.0, 0.0]
    assert [r["population_known"] for r in rows] == [True, True, False, False] and rows[3]["error"] == "bad_density"


def test_beta_functions(spark):
    def cdf(values, a, b):
        df = spark.createDataFrame([(float(v), float(a), float(b)) for v in values], "x double, a double, b double")
        return column(df.select(BE.beta_cdf(F.col("x"), F.col("a"), F.col("b"), BE.ln_beta(F.col("a"), F.col("b"))).alias("v")), "v")

    x = np.array([0.1, 0.5, 0.9])
    assert np.allclose(cdf(x, 3.0, 1.0), x**3, atol=1e-12)
    assert np.allclose(cdf(x, 1.0, 4.0), 1 - (1 - x) ** 4, atol=1e-12)
    a, b = 4, 7
    binomial = [sum(math.comb(a + b - 1, j) * v**j * (1 - v) ** (a + b - 1 - j) for j in range(a, a + b)) for v in x]
    assert np.allclose(cdf(x, a, b), binomial, atol=1e-12)
    assert cdf([0.0, 1.0, -1.0, 2.0], 2.0, 3.0) == [0.0, 1.0, 0.0, 1.0]


def test_beta_quantile_meets_its_cdf(spark):
    pairs = [(2.5, 9.0), (0.2, 3.0), (0.01, 0.5), (300.0, 700.0), (5e3, 1e4), (1.0, 1.0), (0.7, 200.0), (30.0, 0.4)]
    df = spark.createDataFrame(pairs, "a double, b double")
    a, b = F.col("a"), F.col("b")
    for p in (0.05, 0.5, 0.95):
        found = df.select("a", "b", BE.beta_quantile(p, a, b, BE.ln_beta(a, b)).alias("q")).collect()
        q = spark.createDataFrame(found, "a double, b double, q double")
        got = column(q.select(BE.beta_cdf(F.col("q"), a, b, BE.ln_beta(a, b)).alias("v")), "v")
        assert np.allclose(got, p, atol=1e-8), (p, got)


def test_digamma_and_trigamma(spark):
    values = [1e-4, 0.3, 1.0, 2.5, 40.0, 1e6]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(BE.digamma(F.col("v")).alias("d"), BE.trigamma(F.col("v")).alias("t"))
    at = lambda v, n: sum(1.0 / (v + k) ** n for k in range(60))  # noqa: E731  down from a far argument with an ample series
    far = [v + 60 for v in values]
    digamma = [math.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - at(v, 1) for v, z in zip(values, far)]
    trigamma = [1 / z + 1 / (2 * z**2) + 1 / (6 * z**3) - 1 / (30 * z**5) + at(v, 2) for v, z in zip(values, far)]
    assert np.allclose(column(df, "d"), digamma, rtol=1e-10, atol=1e-10) and np.allclose(column(df, "t"), trigamma, rtol=1e-10)


def test_ln_gamma_column(spark):
    values = [1e-4, 0.3, 1.0, 2.5, 40.0, 1e6]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(BE.ln_gamma(F.col("v")).alias("g"))
    assert np.allclose(column(df, "g"), [math.lgamma(v) for v in values], rtol=1e-11, atol=1e-10)


def test_prior_recovers_the_rate(spark):
    rng = np.random.default_rng(1)
    rates = rng.beta(2.0, 8.0, 400)
    rows = [(date(2024, 6, 1), "Glass waste", i, 30, int(rng.binomial(30, r))) for i, r in enumerate(rates)]
    counts = spark.createDataFrame(rows, "month date, waste_type string, point_id long, assessments long, level4_count long")
    p = AD.beta_binomial_prior(counts).first()
    assert abs(p["mean"] - 0.2) < 0.03 and 5 < p["concentration"] < 18 and p["points"] == 400


def test_two_trips_for_a_small_truck(spark):
    stops = spark.createDataFrame([("c", i, 54.7 + i * 0.00899, 25.2, 4.0) for i in range(1, 5)], "plan_id string, site_id long, latitude double, longitude double, load_m3 double")
    trucks = spark.createDataFrame([("c", 1, 10.0, 54.7, 25.2)], "plan_id string, truck_id long, max_volume_m3 double, depot_lat double, depot_lon double")
    visits, unserved = P.nearest_neighbour_trips(stops, trucks)
    assert sorted((r["trip"], r["site_id"]) for r in visits.collect()) == [(1, 3), (1, 4), (2, 1), (2, 2)]
    assert unserved.count() == 0


@pytest.mark.parametrize("n", [10, 4_000])
def test_route_plan_accounts_for_every_stop(spark, n):
    rng = np.random.default_rng(n)
    rows = [("c", i, 54.6 + float(rng.random()) / 5, 25.1 + float(rng.random()) / 3, float(rng.choice([0.0, 0.3, 1.1, 2.5, 6.0, 9.0]))) for i in range(n)]
    rows += [("c", n, 54.7, 25.2, 50.0), ("none", n + 1, 54.7, 25.2, 1.0), (None, n + 2, 54.7, 25.2, 1.0), ("c", n + 3, None, 25.2, 1.0)]
    stops = spark.createDataFrame(rows, "plan_id string, site_id long, latitude double, longitude double, load_m3 double")
    trucks = spark.createDataFrame([("c", t, 8.0 + t % 3 * 4, 54.65 + t % 2 / 10, 25.2) for t in range(7)], "plan_id string, truck_id long, max_volume_m3 double, depot_lat double, depot_lon double")
    visits, unserved = P.nearest_neighbour_trips(stops, trucks)
    visits = materialize(visits)
    assert {(r["site_id"], r["reason"]) for r in unserved.collect()} == {(n, "too_large"), (n + 1, "no_fleet"), (n + 2, "no_fleet"), (n + 3, "no_place")}
    assert sorted(column(visits, "site_id")) == list(range(n))
    trips = P.trip_metrics(visits)
    bad = P.plan_invariants(visits, trips, trucks, stops.where("plan_id is not null"), unserved, P.plan_figures(trips))
    assert {r["violations"] for r in bad.collect()} == {0}
    assert trips.agg(F.min("stops")).first()[0] >= 1 and visits.select("truck_id").distinct().count() == min(7, n) or n == 10


def test_missing_and_empty_carrier_are_two_stops(spark):
    b = spark.createDataFrame([(1, 7, None, "Glass waste", 1.0), (2, 7, "", "Glass waste", 1.0)], "id long, site_id long, waste_carrier string, waste_type string, capacity_m3 double")
    f = P.due_bins(spark.createDataFrame([(1, 4), (2, 4)], "bin_id long, predicted_fill int"), b)
    stops = P.collection_stops(f, date(2024, 7, 1))
    assert sorted(column(stops, "stop_id")) == ["c:/7", "n/7"]
    assert sorted((r["stop_id"], r["bin_id"]) for r in P.stop_bins(f, stops).collect()) == [("c:/7", 2), ("n/7", 1)]


def test_litres_of_unusable_volumes(spark):
    df = spark.createDataFrame([(1.2345,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [tuple(r) for r in df.select(P.litres_up(F.col("v")), P.litres_down(F.col("v"))).collect()] == [(1235, 1234), (None, None), (None, None), (None, None)]


def test_fill_volume(spark):
    b = spark.createDataFrame([(1, 1, None, "Glass waste", 0.6)], "id long, site_id long, waste_carrier string, waste_type string, capacity_m3 double")
    p = spark.createDataFrame([(1, 2)], "bin_id long, predicted_fill int")
    stops = P.collection_stops(P.due_bins(p, b, threshold=1), date(2024, 7, 1)).first()
    assert stops["overall_predicted_fill_m3"] == pytest.approx(0.48)


def test_metrics_by_hand(spark):
    y, p = [0, 1, 2, 3, 4, 4], [0, 2, 2, 4, 4, 1]
    probs = [[0.6 if i == q else 0.1 for i in range(5)] for q in p]
    cells = M.counts(spark.createDataFrame(list(zip(y, probs)), "fill_level int, probabilities array<double>"))
    s, o = M.class_summary(cells).first(), M.ordinal_metrics(cells).first()
    assert s["macro_f1"] == pytest.approx((1 + 0 + 2 / 3 + 0 + 0.5) / 5) and s["accuracy"] == 0.5
    assert o["mean_absolute_class_error"] == pytest.approx(5 / 6) and o["severe_error_rate"] == pytest.approx(1 / 6)


def test_threshold_choice(spark):
    rows = [(3, [0.1, 0.1, 0.1, 0.6, 0.1]), (4, [0.1, 0.1, 0.1, 0.1, 0.6]), (2, [0.1, 0.2, 0.4, 0.2, 0.1]), (0, [0.7, 0.1, 0.1, 0.05, 0.05])]
    curve = M.threshold_curve(spark.createDataFrame(rows, "fill_level int, probabilities array<double>"))
    assert curve.count() == 19 and M.best_threshold(curve).first()["threshold"] == 0.5


def test_sample_is_stable(spark):
    df = spark.range(0, 500).select((F.col("id") % 50).alias("bin_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 50).cast("int")).alias("date"))
    a, b = SA.bottom_k(df, 20).collect(), SA.bottom_k(df.repartition(7), 20).collect()
    assert a == b and len(a) == 20


def test_permuted_column_keeps_its_values(spark):
    df = spark.range(0, 400).select((F.col("id") % 40).alias("bin_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 40).cast("int")).alias("date"), F.when(F.col("id") % 3 != 0, F.col("id")).alias("v"))
    df = df.withColumn("w", F.col("v") * 2)
    key = lambda v: (v is None, v or 0)
    for block in (50, 1000):
        out = T.permuted(df, ["v", "w"], 0, block)
        own = {(r["bin_id"], r["date"]): r for r in df.collect()}
        for moved, still in (("v", "w"), ("w", "v")):
            rows = out.where(F.col("feature") == moved).collect()
            assert sorted((r[moved] for r in rows), key=key) == sorted(column(df, moved), key=key)
            assert all(r[still] == own[r["bin_id"], r["date"]][still] for r in rows) and any(r[moved] != own[r["bin_id"], r["date"]][moved] for r in rows)


def test_preparation_keeps_every_input(spark):
    rows = [(i, 1.0 if i % 3 else None, None, "a" if i < 95 else f"r{i}", i % 5) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, x double, y double, c string, fill_level int")
    prep = T.prepare(df, ["x", "y"], ["c"])
    assert prep.medians == {"x": 1.0, "y": 0.0} and prep.common == {"c": ["a"]}
    assert {r[0] for r in prep.apply(df.withColumn("c", F.lit("new"))).select("c_text").collect()} == {"__RARE__"}
    with pytest.raises(ValueError):
        T.fit("logistic", df.where("fill_level < 4"), ["x", "y"], ["c"])


def test_fullness_is_monotone(spark):
    knots = [10.0, 25.0, 60.0, 90.0]
    df = spark.range(0, 300).select(CA.fullness(F.col("id").cast("double"), F.lit(1.5), knots).alias("f"))
    values = column(df, "f")
    assert all(a <= b for a, b in zip(values, values[1:])) and max(values) <= 120
    at = spark.createDataFrame([(k,) for k in knots], "k double").select(CA.fullness(F.col("k"), F.lit(1.5), knots).alias("f"))
    assert np.allclose(column(at, "f"), [20, 50, 80, 100])


def test_knots_keep_a_zero_atom():
    base, atom = CA.knot_fractions(0.0), CA.knot_fractions(0.3)
    assert atom[0] == pytest.approx(0.305) and base[0] < atom[0] and all(a < b for a, b in zip(atom, atom[1:]))


def test_true_shares_give_the_observed_ones_back():
    shares = CA.true_shares()
    e = CA.RATING_ERROR
    seen = [(1 - e) * s for s in shares]
    for k, s in enumerate(shares):
        near = [j for j in (k - 1, k + 1) if 0 <= j < len(shares)]
        for j in near:
            seen[j] += e * s / len(near)
    assert seen == pytest.approx(CA.TARGET_SHARES, abs=1e-12)


def test_knots_refuse_what_carries_no_map(spark):
    frame = lambda values: spark.createDataFrame([(v,) for v in values], "pressure double")
    for values in ([1.0, 2.0, 3.0], [1.0, 2.0, 3.0, -1.0], [1.0, 2.0, 3.0, float("nan")], [1.0, 2.0, 3.0, float("inf")]):
        with pytest.raises(ValueError):
            CA.quantile_knots(frame(values))
    with pytest.raises(ValueError):
        CA.rising_knots(CA.quantile_knots(frame([5.0] * 9)))
    assert len(CA.rising_knots(CA.quantile_knots(frame(range(9) and [float(v) for v in range(9)])))) == 4


def test_history_errors(spark):
    payload = '{"data":[{"service_date":"2024-01-02T10:00:00","is_serviced":true},{"service_date":"2024-01-02T10:00:00","is_serviced":1,"non_serviced_reason":"x"},{"service_date":"2024-01-02T10:00:00+02:00","is_serviced":true},{"is_serviced":true}]}'
    parsed = FI.parse_history(spark.createDataFrame([(1, 1, payload)], "bin_id long, page int, payload string"))
    assert [r["error"] for r in parsed.orderBy("index").collect()] == [None, None, "offset_timestamp", "missing_timestamp"]
    assert column(FI.dedup_history(parsed), "non_serviced_reason") == ["x"]


def test_since_success_out_of_order_and_over_restarts(spark, tmp_path):
    at = lambda h: datetime(2024, 6, 1, h)
    schema = "bin_id long, at timestamp_ntz, kind string"
    source, root, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    spark.createDataFrame([], schema).write.parquet(source)

    def drain(rows):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        out = L.run_since_success(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), root, checkpoint)
        return {r["bin_id"]: (r["latest_success"], r["submissions_since_success"], r["total_submissions"]) for r in out.collect()}

    assert drain([]) == {}
    assert drain([(1, at(1), "success"), (1, at(2), "request"), (2, at(1), "request"), (2, at(1), "request")]) == {1: (at(1), 1, 1), 2: (None, None, 2)}
    # a late request before the success, a late success between two requests, a first success after old requests
    late = {1: (at(1), 1, 2), 2: (at(6), 1, 5)}
    assert drain([(1, at(0), "request"), (2, at(6), "success"), (2, at(7), "request"), (2, at(5), "request"), (2, at(3), "request")]) == late | {2: (at(6), 1, 5)}
    assert drain([(2, at(4), "success"), (1, at(5), "request")]) == {1: (at(1), 2, 3), 2: (at(6), 1, 5)}
    assert drain([(1, at(3), "success")]) == {1: (at(3), 1, 3), 2: (at(6), 1, 5)}
    assert drain([]) == {1: (at(3), 1, 3), 2: (at(6), 1, 5)}


def test_period_rules():
    area = Area((25.0, 54.0, 26.0, 55.0), datetime(2024, 6, 25, 12))
    assert area.bounds()[0] == datetime(2024, 5, 27)
    with pytest.raises(ValueError):
        area.bounds(Period("explicit", date(2024, 7, 1), date(2024, 7, 5)))
    with pytest.raises(ValueError):
        Period("explicit", date(2024, 7, 5), date(2024, 7, 5))


def test_duplicate_lookup_fails(spark):
    from wastelake.operators.joins import many_to_one

    left = spark.createDataFrame([(1,)], "k long")
    with pytest.raises(Exception, match="duplicate key"):
        many_to_one(left, spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string"), ["k"]).collect()


def test_tile_and_projection(spark):
    df = spark.createDataFrame([(54.7, 25.2)], "latitude double, longitude double")
    r = SP.with_tile(df, 12).select("tile_x", "tile_y", G.project_x(F.col("longitude")).alias("x")).first()
    n = 2**12
    assert r["tile_x"] == int((25.2 + 180) / 360 * n)
    assert r["tile_y"] == int((1 - math.asinh(math.tan(math.radians(54.7))) / math.pi) / 2 * n)
    assert r["x"] == pytest.approx(25.2 * math.cos(math.radians(54.7)) * 111320)


def test_history_pages_lose_nothing(spark):
    pages = [
        (1, 1, "not json"), (1, 2, '{"meta":{}}'), (1, 3, '{"data":{}}'), (1, 4, '{"data":[]}'), (1, 5, None), (1, 6, "[1]"),
        (2, 1, '{"data":[7,{"service_date":"2024-01-02T10:00:00","is_serviced":true,"non_serviced_reason":7},{"service_date":"2024-01-02T11:00:00","is_serviced":"1","non_serviced_reason":"x"},null,"text"]}'),
    ]
    out = FI.parse_history(spark.createDataFrame(pages, "bin_id long, page int, payload string"))
    got = sorted((r["bin_id"], r["page"], -1 if r["index"] is None else r["index"], r["error"]) for r in out.collect())
    assert got == [
        (1, 1, -1, "bad_page"), (1, 2, -1, "missing_data"), (1, 3, -1, "missing_data"), (1, 5, -1, "bad_page"), (1, 6, -1, "bad_page"),
        (2, 1, 0, "bad_entry"), (2, 1, 1, "bad_reason"), (2, 1, 2, None), (2, 1, 3, "bad_entry"), (2, 1, 4, "bad_entry"),
    ]
    assert [tuple(r) for r in FI.dedup_history(out).collect()] == [(2, datetime(2024, 1, 2, 11), True, "x")]


def test_geojson_rows_without_polygon_have_a_reason(spark, tmp_path):
    from pyspark.sql.types import StringType, StructField, StructType

    (tmp_path / "f.json").write_text(
        '{"type":"Feature","id":1,"geometry":{"type":"Polygon","coordinates":[[[1.0,2.0],[3.0,2.0],[1.0,4.0],[1.0,2.0]]]},"properties":{"a":"x"}}\n'
        '{"type":"Feature","id":2,"geometry":null,"properties":{"a":"y"}}\n{"type":"Feature","id":3,"geom\n'
        '{"type":"Feature","id":4,"geometry":{"type":"Polygon","coordinates":[]},"properties":{}}\n{"type":"Feature","id":5,"geometry":{"type":"Polygon"},"properties":{}}\n'
    )
    rows = FI.read_geojson(spark, str(tmp_path / "f.json"), StructType([StructField("a", StringType())])).collect()
    assert sorted(r["error"] or "" for r in rows) == ["", "corrupt_record", "missing_geometry", "missing_rings", "missing_rings"]


def test_broken_polygons_are_counted_and_summary_keeps_to_its_geography(spark):
    ring = lambda x, y, w: [[[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]]
    bow = [[[25.1, 54.7], [25.2, 54.8], [25.2, 54.7], [25.1, 54.8], [25.1, 54.7]]]
    polygons = spark.createDataFrame([(1, "a", ring(25.1, 54.6, 0.1)), (2, "b", ring(25.15, 54.6, 0.1)), (3, "bow", bow), (4, "far", ring(10.0, 10.0, 1.0))], "id long, name string, rings array<array<array<double>>>")
    bins = spark.createDataFrame([(1, 54.65, 25.12), (2, 54.65, 25.17), (3, 54.65, 25.22), (4, 10.5, 10.5)], "id long, latitude double, longitude double").withColumns({c: F.lit(None).cast("string") for c in ("site_id", "waste_type", "waste_carrier", "object_group")}).withColumn("capacity_m3", F.lit(1.0))
    area = Area((25.0, 54.5, 25.3, 54.9), datetime(2024, 6, 26))
    rows = AR.geographic_context(bins, polygons, area).collect()
    assert {r["id"]: (r["selected_bin_count"], r["invalid_polygons"]) for r in rows} == {1: (2, 1), 2: (1, 1)}
    visits = spark.createDataFrame([(1, datetime(2024, 6, 20), True), (3, datetime(2024, 6, 20), False), (4, datetime(2024, 6, 20), True)], "bin_id long, date timestamp_ntz, was_serviced boolean")
    requests = spark.createDataFrame([], "bin_id long, timestamp timestamp_ntz")
    got = {i: {r["part"]: (r["bins"], r["attempts"]) for r in AR.geographic_summary(bins, polygons, visits, requests, area, i).collect()} for i in (1, 2, 3, 4)}
    assert got[1] == {"whole_geography": (2, 1), "selected_intersection": (2, 1)} and got[2] == {"whole_geography": (1, 1), "selected_intersection": (1, 1)}
    assert got[3] == {} and got[4] == {"whole_geography": (1, 1)}


def test_adequacy_job_refuses_broken_days(spark):
    from wastelake.plans.jobs import adequacy_run

    bins = spark.createDataFrame([(1, 5, "Glass waste", "x")], "id long, site_id long, waste_type string, object_group string")
    days = spark.createDataFrame([(1, date(2024, 6, 1), 2, 5, "Glass waste", "x")] * 2 + [(9, date(2024, 6, 1), 7, 5, "Glass waste", "x")], "bin_id long, date date, fill_level int, site_id long, waste_type string, object_group string")
    with pytest.raises(ValueError, match="duplicate_day.*unknown_bin.*invalid_label"):
        adequacy_run(None, bins, days)


def test_prior_at_a_bound_is_marked(spark):
    rows = [(date(2024, 6, 1), "Glass waste", i, 30, 0) for i in range(50)]
    p = AD.beta_binomial_prior(spark.createDataFrame(rows, "month date, waste_type string, point_id long, assessments long, level4_count long")).first()
    assert p["at_bound"]
