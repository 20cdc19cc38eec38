"""Scans, draws, fills and quantiles against plain loops."""

import random
from datetime import date, datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from celldays.functions import fwi
from celldays.functions.backends import NumpyMath
from celldays.operators.forecast import paths
from celldays.operators.metrics import quantile
from celldays.operators.sampling import first_by_hash, redistribute
from celldays.operators.scan import hourly_codes, weather_codes
from celldays.operators.windows import as_of, forward_fill
from celldays.session import checkpoint_dir
from celldays.streaming.online import online_codes

WX = "cell string, day date, lat double, temp double, rh double, wind double, precip double"


def weather(n, cells, seed):
    rng = random.Random(seed)
    return [(c, date(2020, 3, 1) + timedelta(k), 45.0, rng.uniform(0, 30), rng.uniform(20, 95), rng.uniform(0, 30), rng.choice([0.0, 0.0, 4.0])) for k in range(n) for c in cells if rng.random() < 0.8]


def test_online_equals_scan(spark):
    df = spark.createDataFrame(weather(40, ["a", "b", "c"], 1), WX)
    order = ["cell", "day"]
    batch = weather_codes(df).orderBy(*order).collect()
    online = online_codes(spark, df, checkpoint_dir(spark)).orderBy(*order).collect()
    assert len(batch) == len(online) and all(x["cell"] == y["cell"] and x["day"] == y["day"] and abs(x[c] - y[c]) < 1e-9 for x, y in zip(batch, online) for c in ("ffmc", "dmc", "dc", "fwi"))


def test_late_and_repeated_days_have_no_codes(spark):
    from celldays.streaming import online

    class Held:
        exists, get = False, None

        def update(self, v):
            self.exists, self.get = True, v

    import pandas as pd

    rows = weather(3, ["a"], 4)
    while len(rows) < 3:
        rows = weather(3, ["a"], random.randint(5, 99))
    frame = lambda xs: pd.DataFrame(xs, columns=[c.split()[0] for c in WX.split(", ")])
    state = Held()
    first = next(online._advance((0,), iter([frame(rows[1:])]), state))
    late = next(online._advance((0,), iter([frame([rows[0], rows[2]])]), state))
    assert first[["ffmc", "fwi"]].notna().all().all() and late[["ffmc", "fwi"]].isna().all().all()


def test_hours_against_a_loop(spark):
    rng = random.Random(2)
    t0 = datetime(2020, 5, 1)
    rows = [(c, t0 + timedelta(hours=h), rng.uniform(5, 30), rng.uniform(20, 90), rng.uniform(0, 20), rng.choice([0.0, 1.0]), 80.0 if h % 6 == 5 else None) for h in range(30) for c in ("a", "b")]
    df = spark.createDataFrame(rows, "cell string, ts timestamp, temp double, rh double, wind double, precip double, start double")
    got = {(r["cell"], r["ts"]): r["hffmc"] for r in hourly_codes(df).collect()}
    held = {}
    for c, ts, *x, start in rows:
        if c in held:
            held[c] = float(fwi.hourly_ffmc(np.array([held[c]]), *(np.array([v]) for v in x), 1.0, False, NumpyMath)[0])
        elif start:
            held[c] = start
        assert (got[c, ts] is None) == (c not in held) and (c not in held or abs(got[c, ts] - held[c]) < 1e-9)


def test_redistribution_against_a_loop():
    rng = random.Random(3)
    for _ in range(300):
        order = rng.sample("abcd", 4)
        want, have = {k: rng.randint(0, 9) for k in "abcd"}, {k: rng.randint(0, 12) for k in "abcd" if rng.random() < 0.8}
        take = {k: min(n, have.get(k, 0)) for k, n in want.items()}
        lack = sum(want.values()) - sum(take.values())
        while lack and any(have.get(k, 0) > take[k] for k in order):
            for k in order:
                if lack and have.get(k, 0) > take[k]:
                    take[k] += 1
                    lack -= 1
        again, able = dict.fromkeys(want, 0), [k for k in order if have.get(k, 0)]
        for i in range(lack if able else 0):
            again[able[i % len(able)]] += 1
        assert redistribute(want, have, order) == (take, again)


def test_draw_with_and_without_places(spark):
    rows = [(i, None if i % 3 == 2 else i % 3, i % 5) for i in range(900)] + [(1, 1, 1)] * 2
    df = spark.createDataFrame(rows, "id int, g int, n int").withColumn("want", F.when(F.col("g") == 0, 7).when(F.col("g") == 1, 0).otherwise(5000))
    a = first_by_hash(df, ["g"], F.col("want"), ["id"])
    b = first_by_hash(df, ["g"], F.col("want"), ["id"], place="k")
    assert sorted(a.select("id").collect()) == sorted(b.select("id").collect())
    count = {r["g"]: r["count"] for r in a.groupBy("g").count().collect()}
    assert count == {0: 7, None: 300} and a.columns == df.columns


def test_fills_by_block(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, None, float(i)])) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    key = lambda r: (r["t"], r["v"])
    want = sorted(map(key, forward_fill(df, "v", ["k"], "t").collect()), key=str)
    assert sorted(map(key, forward_fill(df, "v", ["k"], "t", block=F.floor(F.col("t") / 7)).collect()), key=str) == want
    d = lambda i: datetime(2020, 1, 1) + timedelta(hours=i)
    left = spark.createDataFrame([("a", d(i), i) for i in range(0, 90, 4)], "k string, at timestamp, id int")
    right = spark.createDataFrame([("a", d(i), float(i)) for i in range(10, 90, 30)], "k string, since timestamp, v double")
    get = lambda block: {r["id"]: r["v"] for r in as_of(left, right, ["k"], "at", "since", "v", block).collect()}
    assert get("day") == get(None) == {i: max((float(x) for x in range(10, 90, 30) if x <= i), default=None) for i in range(0, 90, 4)}


def test_paths_end_in_the_walk(spark):
    cur = spark.createDataFrame([(1, 5.0, 1.0, 0.0), (2, 0.0, -2.0, 0.0)], "id int, value double, mu double, sigma double")
    got = {(r["id"], r["sample"], r["step"]): r["path"] for r in paths(cur, ["id"], 2, 3).collect()}
    assert len(got) == 16 and got[1, 2, 3] == 8.0 and got[2, 1, 0] == 0.0 and got[2, 1, 2] == -4.0


def test_quantile(spark):
    rng = np.random.default_rng(5)
    x = {"a": rng.normal(0, 1, 500), "b": np.full(7, 3.0), "c": rng.integers(0, 4, 60).astype(float)}
    df = spark.createDataFrame([(g, float(v)) for g, xs in x.items() for v in xs] + [("a", None), ("a", float("nan")), ("d", None)], "g string, v double")
    for p in (0.0, 0.3, 0.995, 1.0):
        got = {r["g"]: r["q"] for r in quantile(df, "g", "v", p, "q", 16).collect()}
        assert got.keys() == x.keys() and all(np.isclose(got[g], np.quantile(v, p)) for g, v in x.items())
