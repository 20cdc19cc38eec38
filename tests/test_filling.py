from datetime import date, timedelta

from celldays.operators.filling import fill

SCHEMA = "feat_id long, aoi_id int, target_date date, row int, col int, window_id int, aet float, fwi float, s_aet int, day string"


def run(spark, rows):
    catalog = spark.createDataFrame([("aet", 0.0, 100.0), ("fwi", 0.0, 50.0)], "feature string, valid_min double, valid_max double")
    return {(r[0], r[1]): (r[2], r[3], r[4]) for r in fill(spark.createDataFrame(rows, SCHEMA), catalog, ["aet", "fwi"]).collect()}


def row(i, day, aet, fwi=1.0, window=1, aoi=1, r=1):
    return (i, aoi, day, r, 1, window, aet, fwi, 7, "x")


def test_methods(spark):
    d = [date(2020, 5, k) for k in (1, 5, 11, 20)]
    got = run(spark, [row(1, d[0], 10.0), row(2, d[1], None), row(3, d[2], 20.0), row(4, d[3], 400.0), row(5, d[2], float("nan")), row(6, d[0], float("inf"), r=2), row(7, None, None)])
    assert got[2, "aet"] == (14.0, "interpolated", 4)
    assert got[4, "aet"] == (20.0, "carried", 9)
    assert got[5, "aet"] == (20.0, "same_time", 0)
    assert got[6, "aet"][1] == "area_month" and got[6, "aet"][0] == 15.0
    assert got[7, "aet"][1] == "area"
    assert set(got) == {(2, "aet"), (4, "aet"), (5, "aet"), (6, "aet"), (7, "aet")}


def test_windows(spark):
    d = date(2020, 5, 1)
    rows = [row(1, d, 1.0, window=1), row(2, d, 1.0, window=3), row(3, d, 1.0, window=None), row(4, d, 1.0, window=-99), row(5, d, 1.0, window=0), row(6, None, 1.0, window=None), row(7, None, 1.0, window=None, aoi=9)]
    rows += [row(8, d, 1.0, window=3, r=5), row(9, d, 1.0, window=3, aoi=2)]
    got = run(spark, rows)
    assert got == {(3, "window_id"): (2.0, "absent", 0), (4, "window_id"): (4.0, "absent", 0), (5, "window_id"): (1.0, "carry", 0), (6, "window_id"): (3.0, "area", None), (7, "window_id"): (3.0, "all", None)}


def test_windows_are_carried_in_time_within_the_gap(spark):
    day = lambda k: date(2020, 1, 1) + timedelta(k)
    lost = lambda i, k: [row(10 * i + j, day(k), 1.0, window=None) for j in range(5)]
    rows = [row(1, day(100), 1.0, window=3), row(2, day(100), 1.0, window=2), row(3, day(200), 1.0, window=4), row(4, day(0), 1.0, window=1, r=2), *[row(5 + i, day(0), 1.0, window=1, r=2 + i) for i in range(3)]]
    rows += lost(2, 110) + lost(3, 164) + lost(4, 165) + lost(5, 40) + lost(6, 30) + lost(7, 265)
    got = run(spark, rows)
    assert [got[i, "window_id"] for i in (20, 21, 22, 23)] == [(1.0, "absent", 0), (2.0, "absent", 0), (3.0, "absent", 0), (4.0, "absent", 0)]
    # the fifth row of each sample has no absent window left: the last sample before, else the next, at most 64 days away
    assert [got[10 * i + 4, "window_id"] for i in (2, 3, 4, 5, 6, 7)] == [(2.0, "carry", 10), (2.0, "carry", 64), (4.0, "carry", 35), (2.0, "carry", 60), (1.0, "area", None), (1.0, "area", None)]


def test_nothing_usable_and_empty(spark):
    assert run(spark, [row(1, date(2020, 1, 1), None, None)]) == {(1, "aet"): (None, "none", None), (1, "fwi"): (None, "none", None)}
    assert run(spark, []) == {}
