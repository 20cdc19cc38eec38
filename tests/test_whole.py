"""Whole jobs against brute force: nothing is cut by date, distance, rounds or split."""

import math
from collections import Counter, defaultdict
from datetime import date, timedelta

import __spark_entry__ as entry
from celldays.operators.patterns import balanced_negatives
from celldays.operators.spatial import ORDER, impute, nearest_event_distance, propagate


def lines(spark, folder, rows):
    """A lineitem table of (cell row, cell col, day, fire)."""
    data = [(i, r * 10 + c, 1, 1, 10.0, 0.05, 0.02, "R" if fire else "N", d) for i, (r, c, d, fire) in enumerate(rows)]
    schema = "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_shipdate date"
    spark.createDataFrame(data, schema).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def grid(spark, folder):
    """30 x 10 cells from 1995-01-01 to 1997-12-31, fires on few days far apart."""
    first, last = date(1995, 1, 1), date(1997, 12, 31)
    fires = {(r, c, d) for d in (date(1995, 4, 20), date(1996, 3, 15), date(1997, 7, 1)) for r, c in ((0, 0), (2, 7), (4, 3))} | {(1, 1, date(1995, 4, 10)), (9, 2, date(1997, 6, 1)), (1, 1, date(1995, 1, 20))}
    seen = [(r, c, first, 0) for r in range(30) for c in range(10)] + [(0, 0, last, 0)]
    return lines(spark, folder, seen + [(*f, 1) for f in sorted(fires)]), first, fires


def brute_negatives(first, fires):
    """(day, row, col) to (distance, class) by scanning every fire."""
    out = {}
    for d in {f[2] for f in fires}:
        if d - timedelta(64) < first:
            continue
        here = [f[:2] for f in fires if f[2] == d]
        for r in range(30):
            for c in range(10):
                if (r, c) in here:
                    continue
                dist = min(math.hypot(r - a, c - b) for a, b in here)
                past = any((r, c, d - timedelta(k)) in fires for k in range(1, 65))
                name = "0D" if dist > 10 else ("0B" if past else "0A") if 1 < dist <= 5 else "0C" if 5 < dist <= 10 and past else None
                if name:
                    out[d, r, c] = (dist, name)
    return out


def test_negatives_of_all_days(spark, tmp_path):
    folder, first, fires = grid(spark, tmp_path)
    want = brute_negatives(first, fires)
    got = {(r["day"], r["row"], r["col"]): r["class_name"] for r in entry.queries()["c02_negative_classes"](spark, folder).collect()}
    assert got == {k: v[1] for k, v in want.items()}
    assert {k[0] for k in got} == {date(1995, 4, 10), date(1995, 4, 20), date(1996, 3, 15), date(1997, 6, 1), date(1997, 7, 1)}
    shares = {r["class_name"]: r["n"] for r in entry.queries()["c02_class_shares"](spark, folder).collect()}
    assert shares == Counter(v[1] for v in want.values())


def test_balanced_totals_follow_the_fires(spark, tmp_path):
    folder, first, fires = grid(spark, tmp_path)
    n = Counter(r["month"] for r in entry.queries()["c03_balanced_negatives"](spark, folder).collect())
    # the fire of January has no whole history on its day, so no negatives
    assert n == {m: k for m, k in Counter(f[2].month for f in fires).items() if m != 1}


def test_balanced_repeats_where_rows_are_short(spark):
    rows = [(m, i, name) for m, name, k in ((1, "0A", 3), (1, "0D", 2), (2, "0A", 40), (2, "0B", 40), (2, "0C", 40), (2, "0D", 40), (None, "0B", 1)) for i in range(k)]
    t = spark.createDataFrame([(m, i + 100 * int(name[1], 16), name) for m, i, name in rows], "month int, id int, class_name string")
    got = balanced_negatives(t, {(1,): 15, (2,): 25, (None,): 4}, ["month"], ["id"]).collect()
    count = defaultdict(Counter)
    for r in got:
        count[r["month"]][r["class_name"]] += 1
    # 5 unique rows and 10 draws in the ratio 1 : 1 of the classes at hand
    assert count == {1: {"0A": 8, "0D": 7}, 2: {"0A": 5, "0B": 5, "0C": 10, "0D": 5}, None: {"0B": 4}}
    assert len({r["id"] for r in got if r["month"] == 1}) == 5 and len({r["id"] for r in got if r["month"] == 2}) == 25


def test_distance_beyond_the_first_buckets(spark):
    days = [date(2020, 1, 1), date(2020, 1, 2), date(2020, 1, 3)]
    fires = {days[0]: [(0, 0), (300, 41)], days[1]: [(-7, 12)]}
    cells = [(d, r, c) for d in days for r in range(-20, 400, 9) for c in range(0, 60, 7)]
    t = spark.createDataFrame([*cells, (days[0], None, 3)], "day date, row int, col int")
    e = spark.createDataFrame([(d, *f) for d, fs in fires.items() for f in fs * 2], "day date, row int, col int")
    got = {tuple(r[:3]): r["distance"] for r in nearest_event_distance(t, e, 10).collect()}
    want = {k: min((math.dist(k[1:], f) for f in fires.get(k[0], [])), default=None) for k in cells}
    assert got.pop((days[0], None, 3)) is None and got.keys() == want.keys()
    assert all(got[k] is None if v is None else math.isclose(got[k], v) for k, v in want.items())


def test_far_negatives_keep_their_distance(spark, tmp_path):
    folder, first, fires = grid(spark, tmp_path)
    far = {k: v[0] for k, v in brute_negatives(first, fires).items() if v[1] == "0D"}
    got = {(r["day"], r["row"], r["col"]): r for r in entry.queries()["c02_negative_classes"](spark, folder).where("class_name = '0D'").collect()}
    assert far and got.keys() == far.keys()
    assert all(math.isclose(got[k]["distance"], v, abs_tol=1e-8) and math.isclose(got[k]["distance_km"], 4 * v, abs_tol=1e-8) for k, v in far.items())


def spread_out(known, cells):
    """Nearest propagation until stable, on dicts of places."""
    known = dict(known)
    while True:
        new = {}
        for r, c in cells - known.keys():
            near = [known[r + a, c + b] for a, b in ORDER if (r + a, c + b) in known]
            if near:
                new[r, c] = near[0]
        if not new:
            return known
        known |= new


def test_propagation_until_stable(spark):
    cells = {(r, c) for r in range(12) for c in range(3)} | {(30, 0)}
    known = {(0, 0): 1.0, (0, 2): 2.0, (11, 1): 5.0}
    t = spark.createDataFrame([(1, *k, known.get(k)) for k in cells], "g int, row int, col int, value double")
    got = {(r["row"], r["col"]): r["value"] for r in propagate(t, "value", ["g"]).collect()}
    assert got == {k: spread_out(known, cells).get(k) for k in cells} and got[30, 0] is None and got[5, 0] is not None


def test_imputation_runs_every_stage(spark):
    cells = {(r, 0) for r in range(20)} | {(90, 0)}
    known = {(r, 0): float(r) for r in range(3)}
    t = spark.createDataFrame([(1, *k, known.get(k)) for k in cells], "g int, row int, col int, value double")
    got = {r["row"]: (r["stage"], r["value"]) for r in impute(t, "value", ["g"], reach=4).collect()}
    assert [got[r][0] for r in (0, 3, 4, 7, 8, 19, 90)] == ["observed", "kernel", "distance", "distance", "nearest", "nearest", "mean"]
    four = {0: 0.0, 1: 1.0, 2: 2.0, 3: 2.0}
    assert math.isclose(got[5][1], sum(v / (5 - k) ** 2 for k, v in four.items() if 5 - k <= 4) / sum(1 / (5 - k) ** 2 for k in four if 5 - k <= 4))
    assert got[19][1] == got[7][1] == 2.0
    assert {"distance"} == {r["stage"] for r in impute(t.where("row < 20"), "value", ["g"]).collect() if r["row"] > 3}


def test_registered_chain_reaches_every_stage(spark):
    got = {r["stage"] for r in entry.queries()["w10_imputation_chain"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {"observed", "kernel", "distance", "nearest", "mean"}


def test_rebalanced_in_each_split(spark, tmp_path):
    weights = {"FireType-1": 10, "FireType-5": 15, "FireType-2": 10, "NoFire-0A": 7, "NoFire-0B": 7, "NoFire-0C": 14, "NoFire-0D": 7}
    rows = [(split, c) for split, k in ((" Train", 2), ("val", 1)) for c, w in weights.items() for _ in range(w * k + 3)]
    rows += [("TEST", "NoFire-0A")] * 5 + [("test", "Fire Type 1")] * 2 + [("test", None), ("other", "NoFire-0A"), (None, "NoFire-0B")]
    data = [(i, c, split, date(2020, 1 + i % 12, 1)) for i, (split, c) in enumerate(rows)]
    spark.createDataFrame(data, "label_id long, type_class string, split string, target_date date").write.parquet(f"{tmp_path}/labels_combined.parquet")
    got = entry.queries()["c06_rebalanced"](spark, str(tmp_path)).collect()
    name = lambda c: c and c.upper().replace("-", "").replace(" ", "")
    count = Counter((r["split"], r["class_name"]) for r in got)
    want = {(split, name(c)): w * k for split, k in (("train", 2), ("val", 1)) for c, w in weights.items()}
    assert count == want | {("test", "NOFIRE0A"): 5, ("test", "FIRETYPE1"): 2, ("test", None): 1}
    assert len({r["label_id"] for r in got}) == len(got)


def test_joins_over_all_rows(spark, tmp_path):
    day = lambda k: date(1998, 3, 1) + timedelta(k)
    folder = lines(spark, tmp_path, [(0, 0, day(0), 1), (0, 3, day(0), 0), (40, 0, day(0), 0), (0, 0, day(-1), 0), (0, 0, day(-17), 0), (0, 0, day(-64), 0), (0, 0, day(-65), 0)])
    got = {(r["row"], r["col"], r["day"]): r["distance"] for r in entry.queries()["j05_event_distance"](spark, folder).collect()}
    assert got == {(0, 3, day(0)): 3.0, (40, 0, day(0)): 40.0} | {(0, 0, day(-k)): None for k in (1, 17, 64, 65)}
    w = {(r["target_date"], r["window_id"]): r["n"] for r in entry.queries()["j12_interval"](spark, folder).collect()}
    assert w == {(day(0), 1): 1, (day(0), 2): 1, (day(0), 4): 1}
    key = (1, day(0), 2, 3)
    labels = [(1, *key, 1, "labels_redelivery.csv"), (2, *key, 1, None), (3, *key, 1, "labels.csv"), (4, *key, 0, "labels.csv")]
    spark.createDataFrame(labels, "label_id long, aoi_id int, target_date date, row int, col int, label int, source_file string").write.parquet(f"{folder}/labels_combined.parquet")
    spark.createDataFrame([(7, *key), (8, *key), (9, 2, *key[1:])], "feat_id long, aoi_id int, target_date date, row int, col int").write.parquet(f"{folder}/features_train.parquet")
    assert {tuple(r) for r in entry.queries()["j11_one_to_many"](spark, folder).collect()} == {(f, y) for f in (7, 8) for y in (1, 2, 3)}
