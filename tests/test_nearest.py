"""Nearest points: against brute force, ties as in SQL, and work that follows the rows where all points lie within the limit."""

import threading

import numpy as np

from celldays.operators.spatial import nearest_within


def brute(left, right, limit):
    out = {}
    for i, a, x, y in left:
        near = [(d, p, q, s) for b, s, p, q in right if None not in (x, y, p, q) and a == b and (d := float(np.sqrt((x - p) * (x - p) + (y - q) * (y - q)))) <= limit]
        out[i] = min(near, default=None)
    return {i: (m[3], m[0]) if m else (None, None) for i, m in out.items()}


def test_against_brute_force(spark):
    """A dense cluster, a few points far apart, repeated places, distances of just the limit and missing coordinates."""
    rng = np.random.default_rng(5)
    spot = lambda n, wide, at: [tuple(np.round(rng.uniform(at, at + wide, 2), 3).tolist()) for _ in range(n)]
    places = [*spot(150, 0.05, 0.4), *spot(20, 30, -10), (8.0, 8.0), (8.0, 8.0), (None, 1.0), (float("nan"), 0.4), (float("inf"), 0.4)]
    right = [("ab"[i % 2], i, *p) for i, p in enumerate(places)]
    left = [(i, "ab"[i % 3 % 2], *p) for i, p in enumerate([*spot(80, 0.05, 0.4), *spot(150, 32, -11), (8.0, 10.0), (8.0, 10.1), (1.0, None), (float("nan"), 0.4)])]
    r = spark.createDataFrame(right, "a string, station int, x double, y double")
    got = {t["id"]: (t["station"], t["distance"]) for t in nearest_within(spark.createDataFrame(left, "id int, a string, x double, y double"), r, "x", "y", 2.0, ["station"], ["a"]).collect()}
    assert got == brute(left, right, 2.0) and {v[0] is None for v in got.values()} == {True, False}
    empty = nearest_within(spark.createDataFrame(left, "id int, a string, x double, y double"), r.limit(0), "x", "y", 2.0, ["station"], ["a"]).collect()
    assert len(empty) == len(left) and {t["station"] for t in empty} == {None}


def test_distances_as_in_sql(spark):
    """Distances that are equal on paper are told apart, or not, by the square root of the sum of squares."""
    k = np.arange(0, 1500)
    lattice = lambda a, m, b, n: list(zip(k.tolist(), (k * a % m / 100.0).tolist(), (k * b % n / 100.0).tolist(), strict=True))
    left, right = [(i, x, y) for i, x, y in lattice(37, 109, 61, 97)], [(i, x, y) for i, x, y in lattice(53, 113, 71, 91) if i % 40 == 0]
    got = {t["id"]: (t["station"], t["distance"]) for t in nearest_within(spark.createDataFrame(left, "id long, x double, y double"), spark.createDataFrame(right, "station long, x double, y double"), "x", "y", 0.8, ["station"]).collect()}
    assert got == brute([(i, 0, x, y) for i, x, y in left], [(0, i, x, y) for i, x, y in right], 0.8)


def test_all_within_the_limit(spark):
    """40,000 points and 40,000 stations, each within the limit of each: 1.6e9 pairs, of which few have to be made."""
    points = lambda a, b: spark.range(40_000).selectExpr("id", f"id * {a} % 10007 / 10007.0D as x", f"id * {b} % 9973 / 9973.0D as y")
    late = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = nearest_within(points(37, 61), points(53, 71).withColumnRenamed("id", "station"), "x", "y", 10.0, ["station"]).selectExpr("count(*)", "count(station)", "max(distance)").first()
    finally:
        late.cancel()
    assert got[0] == got[1] == 40_000 and got[2] < 0.1
