"""Crossing edges of large rings by grid cells."""

import math
import time

import pytest
from pyspark.sql import functions as F

from wastelake.functions import geo as G
from wastelake.operators import spatial as SP

RINGS = "id long, rings array<array<array<double>>>"


def round_ring(n, wobble=0.0):
    ring = [[25 + (0.3 + wobble * math.sin(7 * i)) * math.cos(2 * math.pi * i / n), 54.7 + 0.2 * math.sin(2 * math.pi * i / n)] for i in range(n)]
    return [*ring, ring[0]]


def swapped(ring, i, j):
    out = [list(p) for p in ring]
    out[i], out[j] = out[j], out[i]
    return out


def test_same_as_all_edges_with_all(spark):
    rows = [(1, [round_ring(200)]), (2, [swapped(round_ring(200), 20, 21)]), (3, [swapped(round_ring(200), 10, 120)]), (4, [round_ring(80, 0.02)]), (5, [round_ring(70), swapped(round_ring(90), 5, 50)]),
            (6, [[[25.0, 54.0], [25.1, 54.1], [25.1, 54.0], [25.0, 54.1], [25.0, 54.0]]]), (7, [round_ring(100)[:-1]]), (8, None)]
    shapes = spark.createDataFrame(rows, RINGS)
    want = {r["id"]: r["p"] for r in shapes.select("id", G.polygon_problem(F.col("rings")).alias("p")).collect()}
    done = SP.checked(shapes)
    assert {r["id"]: r["problem"] for r in done.collect()} == want and want[2] == want[3] == want[5] == "self_crossing" and want[1] is None
    assert SP.polygon_problems(done) is done


@pytest.mark.parametrize("crossed", [False, True])
def test_a_ring_of_100_000_positions(spark, crossed):
    ring = round_ring(100_000)
    shapes = spark.createDataFrame([(1, [swapped(ring, 500, 501) if crossed else ring])], RINGS)
    start = time.time()
    assert SP.checked(shapes).first()["problem"] == ("self_crossing" if crossed else None)
    assert time.time() - start < 60
