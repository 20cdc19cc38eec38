from datetime import date

import numpy as np

from celldays.operators import profile
from celldays.operators.profile import findings, mask_of, profile_loads
from pyspark.sql import functions as F

FEATURES = "load_id int, aoi_id int, target_date date, row int, col int, window_id int, sample_key string, aet float, fwi float"
D = date(2020, 1, 2)


def tables(spark, rows):
    log = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "load_id int, baseline_load_id int")
    catalog = spark.createDataFrame([("aet", 0.0, 100.0), ("fwi", 0.0, 50.0)], "feature string, valid_min double, valid_max double")
    return profile_loads(spark.createDataFrame(rows, FEATURES), log, catalog)


def row(load, aet, fwi, key="2020-01-02_3_4"):
    return (load, 1, D, 3, 4, 1, key, aet, fwi)


def test_masks(spark):
    df = spark.createDataFrame([("2020-01-02_3_44",), ("abC9",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(mask_of(F.col("s"))).collect()] == ["9-9-9_9_9", "aA9", "", None]


def test_exact_quartiles_and_findings(spark):
    rng = np.random.default_rng(3)
    base = [float(np.float32(x)) for x in rng.uniform(0, 100, 101)]
    moved = [float(np.float32(x)) for x in rng.uniform(60, 100, 101)]
    rows = [row(1, x, 5.0) for x in base] + [row(2, x, None if i % 5 == 0 else 5.0, "bad" if i % 10 == 0 else "2020-01-02_3_4") for i, x in enumerate(moved)]
    rows += [row(3, float("nan"), 900.0), row(3, float("inf"), 1.0), row(None, 1.0, 1.0)]
    p = {(r["load_id"], r["column_name"]): r for r in tables(spark, rows).collect()}
    want = np.percentile(np.array(base, dtype=np.float32).astype(float), [25, 50, 75])
    assert np.allclose([p[1, "aet"][k] for k in ("p25", "p50", "p75")], want, rtol=1e-12)
    assert p[3, "aet"]["n_missing"] == 1 and p[3, "aet"]["outside_share"] == 1.0 and p[3, "aet"]["p50"] is None
    got = {tuple(r) for r in findings(tables(spark, rows)).collect()}
    assert got == {(2, "aet", "shift"), (2, "fwi", "missing"), (2, "sample_key", "pattern"), (3, "aet", "range"), (3, "fwi", "range")}


def test_empty(spark):
    assert tables(spark, []).collect() == []


def test_null_keys_are_violations(spark):
    rows = [row(1, 1.0, 1.0, None), (1, 1, None, 3, 4, 1, "2020-01-02_3_4", 1.0, 1.0)]
    p = {r["column_name"]: r for r in tables(spark, rows).collect()}
    assert p["sample_key"]["bad_share"] == 1.0


def test_fine_masks_are_intervals(spark):
    x = sorted({round(s * m * 10.0**e, 9) for s in (1, -1) for m in (0, 1, 1.004, 1.01, 1.2, 3.14159, 9.99, 9.996) for e in range(-7, 5)} | {199999.0, 200000.0, float("inf"), float("-inf")})
    df = spark.createDataFrame([(v,) for v in [*x, None]], "v double")
    got = {r[0]: r[1] for r in df.select("v", profile.number_mask(F.col("v"), F.lit(-1e5), F.lit(2e5))).collect()}
    assert got[None] is None and got[float("inf")] == ">"
    assert got[200000.0] == "200999.999999" and got[-9.99] == "-9.999999" and got[0.00314159] == "0.003149" and got[float("-inf")] == "<"
    inside = [got[v] for v in x if -1e5 <= v <= 2e5]
    runs = [m for i, m in enumerate(inside) if not i or inside[i - 1] != m]
    assert len(runs) == len(set(runs))  # a mask never comes back: the masks are ordered as their values


def test_key_masks_name_the_own_parts(spark):
    rows = [("2020-01-02_3_4", D, 3, 4), ("2020-01-03_3_4", D, 3, 4), ("2020-01-02_03_4", D, 3, 4), ("2020-01-02_3_4_", D, 3, 4), ("D_R_C", D, 3, 4), ("2020-01-02_3_4", D, None, 4), ("2020-01-02_-3_4", D, -3, 4), (None, D, 3, 4)]
    df = spark.createDataFrame(rows, "k string, target_date date, row int, col int")
    assert [r[0] for r in df.select(profile.key_mask(F.col("k"))).collect()] == ["D_R_C", "9-9-9_R_C", "D_9_C", "9-9-9_9_9_", "A_A_A", "D_9_C", "D_R_C", None]


def test_findings_come_from_the_masks(spark, monkeypatch):
    rows = [row(1, float(x), 5.0) for x in range(100)] + [row(2, float(x + 60) if x % 5 else None, 5.0, "bad" if x % 10 == 0 else "2020-01-02_3_4") for x in range(40)]
    full = {("aet", "missing"), ("aet", "shift"), ("sample_key", "pattern")}
    found = lambda: {tuple(r)[1:] for r in findings(tables(spark, rows)).collect()}
    assert found() == full
    plan = findings(tables(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "log2" in plan.lower() and "translate(" in plan and "regexp_replace" in plan
    with monkeypatch.context() as m:  # masks that tell nothing
        m.setattr(profile, "key_mask", lambda k: F.lit("D_R_C"))
        assert found() == full - {("sample_key", "pattern")}
    with monkeypatch.context() as m:
        m.setattr(profile, "divergences", lambda masks, base: masks.select("load_id", "column_name").distinct().withColumn("mask_divergence", F.lit(0.0)))
        assert found() == full - {("aet", "missing")}
    with monkeypatch.context() as m:
        m.setattr(profile, "number_mask", lambda v, low, high: F.when(v.isNotNull(), F.lit("<")))
        assert ("aet", "shift") not in found() and ("aet", "range") in found()
