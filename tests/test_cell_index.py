"""The cell index of polygons against the full ray cast over whole rings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wastelake.functions import geo as G
from wastelake.operators import spatial as SP

RINGS = "id long, rings array<array<array<double>>>"


def star(rng, lon, lat, radius, n):
    turn = sorted(rng.uniform(0, 2 * math.pi, n))
    ring = [[lon + radius * rng.uniform(0.3, 1) * math.cos(t), lat + radius * rng.uniform(0.3, 1) * math.sin(t)] for t in turn]
    return [*ring, ring[0]]


def shapes():
    rng = np.random.default_rng(5)
    out = [(i, [star(rng, 25 + rng.uniform(-0.05, 0.05), 54.7 + rng.uniform(-0.05, 0.05), rng.uniform(0.002, 0.06), int(n))]) for i, n in enumerate(rng.integers(3, 60, 25))]
    out += [(100 + i, [star(rng, 25, 54.7, 0.05, 200), star(rng, 25.01, 54.7, 0.012, 30), star(rng, 24.99, 54.71, 0.02, 9)]) for i in range(5)]
    out.append((200, [[[24.97, 54.67], [25.03, 54.67], [25.03, 54.73], [24.97, 54.73], [24.97, 54.67]], [[24.99, 54.69], [25.01, 54.69], [25.01, 54.71], [24.99, 54.71], [24.99, 54.69]]]))
    out.append((201, [[[25.0, 54.66], [25.04, 54.7], [25.0, 54.74], [24.96, 54.7], [25.0, 54.66]]]))  # corners on cell corners
    out.append((202, [[[24.95, 54.651], [25.05, 54.652], [25.05, 54.653], [24.95, 54.6535], [24.95, 54.651]]]))  # thin, within one row
    return out


def spots(polygons):
    rng = np.random.default_rng(6)
    at = [(float(rng.uniform(24.92, 25.08)), float(rng.uniform(54.62, 54.78))) for _ in range(1500)]
    at += [(round(x, 2), round(y, 2)) for x, y in at[:200]] + [(x, round(y, 2)) for x, y in at[200:300]] + [(round(x, 2), y) for x, y in at[300:400]]
    for _, rings in polygons[-12:]:
        for ring in rings:
            for a, b in zip(ring[:8], ring[1:9]):
                at += [tuple(a), ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2), (a[0], b[1])]
    return [(i, float(x), float(y)) for i, (x, y) in enumerate(at)]


@pytest.mark.parametrize("boundary", [False, True])
def test_same_as_whole_rings(spark, boundary):
    polygons = shapes()
    points = spark.createDataFrame(spots(polygons), "id long, longitude double, latitude double")
    shapes_ = spark.createDataFrame(polygons, RINGS)
    test = G.covers if boundary else G.in_polygon
    plain = points.crossJoin(shapes_.withColumnRenamed("id", "polygon_id")).where(test(F.col("longitude"), F.col("latitude"), F.col("rings")))
    want = {r["id"]: (r["p"], r["n"]) for r in plain.groupBy("id").agg(F.min("polygon_id").alias("p"), F.count("*").alias("n")).collect()}
    for polygons_ in (shapes_, SP.cell_index(shapes_)):
        got = {r["id"]: (r["polygon_id"], r["matches"]) for r in SP.membership(points, polygons_, boundary).collect()}
        assert len(got) == points.count() and {k: v for k, v in got.items() if v[1]} == want


def test_no_row_carries_a_whole_ring(spark):
    n = 20_000
    turn = np.linspace(0, 2 * math.pi, n, endpoint=False)
    ring = [[25 + 0.5 * (1 + 0.1 * math.sin(40 * t)) * math.cos(t), 54.7 + 0.3 * (1 + 0.1 * math.sin(40 * t)) * math.sin(t)] for t in turn]
    index = SP.cell_index(spark.createDataFrame([(1, [[*ring, ring[0]]])], RINGS))
    most, edges, inner = index.agg(F.max(F.size("edges")), F.sum(F.size("edges")), F.count_if(F.size("edges") == 0)).first()
    assert most < n / 50 and edges < 1.2 * n and inner > 1000


def test_rings_without_area_and_empty_tables(spark):
    shapes_ = spark.createDataFrame([(1, []), (2, [[]]), (3, [[[25.0, 54.0]]]), (4, None), (5, [[[25.0, 54.0], [25.01, 54.0], [25.0, 54.01]]])], RINGS)
    points = spark.createDataFrame([(1, 25.001, 54.001), (2, None, 54.0)], "id long, longitude double, latitude double")
    assert sorted(map(tuple, SP.membership(points, shapes_).collect())) == [(1, 5, 1), (2, None, 0)]  # the open ring is closed
    assert sorted(map(tuple, SP.membership(points, shapes_.limit(0)).collect())) == [(1, None, 0), (2, None, 0)]
    assert SP.membership(points.limit(0), shapes_).collect() == []


def test_pairs_are_counted_where_they_meet(spark, monkeypatch):
    monkeypatch.setattr(SP, "HOT_CELL", 50)
    box = lambda x, s: [[x, 0.0], [x + s, 0.0], [x + s, s], [x, s], [x, 0.0]]
    polygons = [(None, [box(0.0, 0.02)])] + [(i, [box(0.00001 * i, 0.009), box(0.004, 0.001)]) for i in range(120)]
    at = [(i, 0.0001 * i, 0.0004) for i in range(150)] + [(1, 0.0001, 0.0004), (7, 0.0155, 0.001), (None, 0.002, 0.002), (900, None, 0.001)]
    points = spark.createDataFrame(at, "id long, longitude double, latitude double")
    shapes_ = spark.createDataFrame(polygons, RINGS)
    plain = points.crossJoin(shapes_.withColumnRenamed("id", "polygon_id")).where(G.in_polygon(F.col("longitude"), F.col("latitude"), F.col("rings"))).select("id", "polygon_id").distinct()
    want = {r["id"]: (r["p"], r["n"]) for r in plain.where("id is not null").groupBy("id").agg(F.min("polygon_id").alias("p"), F.count("*").alias("n")).collect()}
    previous = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # rows of a polygon and positions of a piece go over batches
    try:
        found = SP.membership(points, shapes_)
        got = [tuple(r) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", previous)
    assert len(got) == len(at) and {i: (p, n) for i, p, n in got if n} == want and (None, None, 0) in got
    assert "MapInArrow" in found._jdf.queryExecution().toString()  # no row per pair of a point and a polygon leaves a task
