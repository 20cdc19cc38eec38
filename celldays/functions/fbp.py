"""Canadian Forest Fire Behaviour Prediction System (1992, revised 2009), one column expression per quantity.

behaviour() adds all quantities of a row in the order in which they depend on each other; the parameters of the 20 fuel
types come from one small table (a broadcast join of 20 rows). A null input gives null results; negative wind, codes and
slopes count as 0, a negative aspect as 270, an unknown fuel as non-fuel (19).
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from celldays.functions.backends import SparkMath as M
from celldays.functions.fwi import moisture_function, moisture_of, wind_function

# Fixed values of the system: code, name, a, b, c, q, bui0, be_max, canopy base height, canopy fuel load
FUELS = [
    (1, "C1", 90.0, 0.0649, 4.5, 0.9, 72.0, 1.076, 2.0, 0.75),
    (2, "C2", 110.0, 0.0282, 1.5, 0.7, 64.0, 1.321, 3.0, 0.8),
    (3, "C3", 110.0, 0.0444, 3.0, 0.75, 62.0, 1.261, 8.0, 1.15),
    (4, "C4", 110.0, 0.0293, 1.5, 0.8, 66.0, 1.184, 4.0, 1.2),
    (5, "C5", 30.0, 0.0697, 4.0, 0.8, 56.0, 1.220, 18.0, 1.2),
    (6, "C6", 30.0, 0.08, 3.0, 0.8, 62.0, 1.197, 7.0, 1.8),
    (7, "C7", 45.0, 0.0305, 2.0, 0.85, 106.0, 1.134, 10.0, 0.5),
    (8, "D1", 30.0, 0.0232, 1.6, 0.9, 32.0, 1.179, 0.0, 0.0),
    (9, "D2", 30.0, 0.0232, 1.6, 0.9, 32.0, 1.179, 0.0, 0.0),
    (10, "M1", None, None, None, 0.8, 50.0, 1.250, 6.0, 0.8),
    (11, "M2", None, None, None, 0.8, 50.0, 1.250, 6.0, 0.8),
    (12, "M3", 120.0, 0.0572, 1.4, 0.8, 50.0, 1.250, 6.0, 0.8),
    (13, "M4", 100.0, 0.0404, 1.48, 0.8, 50.0, 1.250, 6.0, 0.8),
    (14, "O1a", 190.0, 0.0310, 1.4, 1.0, None, 1.0, 0.0, 0.0),
    (15, "O1b", 250.0, 0.0350, 1.7, 1.0, None, 1.0, 0.0, 0.0),
    (16, "S1", 75.0, 0.0297, 1.3, 0.75, 38.0, 1.460, 0.0, 0.0),
    (17, "S2", 40.0, 0.0438, 1.7, 0.75, 63.0, 1.256, 0.0, 0.0),
    (18, "S3", 55.0, 0.0829, 3.2, 0.75, 31.0, 1.590, 0.0, 0.0),
    (19, "NF", None, None, None, None, None, None, None, None),
    (20, "WA", None, None, None, None, None, None, None, None),
]
FUEL_SCHEMA = "fuel_type int, fuel string, a double, b double, c double, q double, bui0 double, be_max double, cbh double, cfl double"
C2, D1 = FUELS[1][2:5], FUELS[7][2:5]
NO_CROWN, OPEN = [8, 9, 14, 15, 16, 17, 18], [1, 7, 9, 14, 15, 16, 17, 18]
DEFAULTS = {"pc": 50.0, "pdf": 35.0, "gfl": 0.35, "gcf": 80.0}
#: fixed values: spread-growth factors of surface and crown fires by fuel code
GROWTH = {1: (-1.0, 0.95), 2: (0.84, 1.82), 3: (0.62, 1.78), 4: (0.74, 1.38), 5: (0.8, -1.0), 6: (0.66, 1.54), 7: (1.22, 1.0), 8: (0.716, -1.0), 12: (0.551, -1.0)}
#: fixed values: codes of the R package's grids to codes of this table
GRID_CODES = {9: 10, 10: 11, 11: 12, 12: 13, 13: 19, 19: 20}
#: fixed values: default grass curing (%) by province, subregion and season
CURING = [("AB", None, 75, 40, 60, 100), ("BC", "southeast", 100, 90, 90, 100), ("BC", None, 100, 60, 85, 100)]
SEASONS = ["spring", "summer", "fall", "winter"]


def convert_grid_codes(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in GRID_CODES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, code), code)


def grass_curing(season: Column, province: Column, subregion: Column) -> Column:
    """Default curing per cent; null for an unknown season or province."""
    out = F.lit(None).cast("int")
    for p, sub, *values in reversed(CURING):
        pick = F.try_element_at(F.create_map(*(F.lit(x) for kv in zip(SEASONS, values, strict=True) for x in kv)), F.lower(season))
        here = (province == p) & (F.lit(True) if sub is None else F.coalesce(subregion == sub, F.lit(False)))
        out = F.when(here, pick).otherwise(out)
    return out


def inputs(df: DataFrame) -> DataFrame:
    """Clamped and defaulted inputs (fuel_type, wx_date, lat, long, elevation, slope, aspect, ws, wd, ffmc, bui and optional pc, pdf, gfl, gcf, d0, dj)."""
    zero = lambda c: F.when(F.col(c) < 0, 0.0).otherwise(F.col(c).cast("double"))
    new = {c: zero(c) for c in ("slope", "ws", "ffmc", "bui")}
    for c, value in DEFAULTS.items():
        given = F.coalesce(F.col(c).cast("double"), F.lit(value)) if c in df.columns else F.lit(value)
        new[c] = F.when(given < 0, 0.0).otherwise(given) if c != "gcf" else F.when(given == 0, 0.1).otherwise(given)
    new["aspect"] = F.when(F.col("aspect") < 0, 270.0).otherwise(F.col("aspect").cast("double"))
    for c in ("wd", "lat", "long", "elevation"):
        new[c] = F.col(c).cast("double")
    new["fuel_type"] = F.when(F.col("fuel_type").isNull() | F.col("fuel_type").between(1, 20), F.col("fuel_type")).otherwise(19).cast("int")
    for c in ("d0", "dj"):
        new[c] = F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
    return df.withColumns(new)


def turned(angle: Column) -> Column:
    return F.when(angle > 180, angle - 180).otherwise(angle + 180)


def spread(a, b, c, isi: Column) -> Column:
    """Basic rate of spread a(1 - exp(-b isi))^c."""
    return M.num(a) * F.pow(1 - F.exp(-M.num(b) * isi), M.num(c))


def blended(own: Column, c2: Column, d1: Column) -> Column:
    """Rate of spread of mixedwood by conifer or dead-fir per cent, and of grass by curing."""
    ft, pc, pdf = F.col("fuel_type"), F.col("pc") / 100, F.col("pdf") / 100
    return F.when(ft == 10, pc * c2 + (1 - pc) * d1).when(ft == 11, pc * c2 + 0.2 * (1 - pc) * d1).when(ft == 12, pdf * own + (1 - pdf) * d1).when(ft == 13, pdf * own + 0.2 * (1 - pdf) * d1).when(ft.isin(14, 15), own * F.col("cf")).otherwise(own)


def reverse_isi(rate: Column, a, b, c) -> Column:
    """ISI that gives a rate of spread, its logarithm bounded at 0.01."""
    rest = 1 - F.pow(M.div(rate, M.num(a)), M.div(1.0, M.num(c)))
    return F.ln(F.when(rest >= 0.01, rest).otherwise(0.01)) / -M.num(b)


def slope_factor() -> Column:
    return F.when(F.col("slope") < 70, F.exp(3.533 * F.pow(F.col("slope") / 100, 1.2))).otherwise(10.0)


def foliar_moisture() -> list[dict[str, Column]]:
    high = F.coalesce(F.col("elevation") > 0, F.lit(False))
    away = 150 - F.abs("long")
    latn = F.when(high, 43 + 33.7 * F.exp(-0.0351 * away)).otherwise(46 + 23.4 * F.exp(-0.036 * away))
    d0 = F.coalesce("d0", F.rint(F.when(high, 142.1 * (F.col("lat") / F.col("latn")) + 0.0172 * F.col("elevation")).otherwise(151 * (F.col("lat") / F.col("latn")))))
    day = F.coalesce("dj", F.dayofyear(F.to_date(F.col("wx_date").cast("string"), "yyyyMMdd")).cast("double"))
    nd = F.col("nd")
    fmc = F.when(nd < 30, 85 + 0.0189 * nd * nd).when(nd < 50, 32.9 + 3.17 * nd - 0.0288 * nd * nd).when(nd.isNotNull(), 120.0)
    return [{"latn": latn}, {"d0": d0, "dj": day}, {"nd": F.abs(F.col("dj") - F.col("d0"))}, {"fmc": fmc}, {"fme": 1000 * F.pow(1.5 - 0.00275 * F.col("fmc"), 4.0) / (460 + 25.9 * F.col("fmc"))}]


def slope_wind() -> list[dict[str, Column]]:
    """Slope-equivalent wind, the vector sum with the wind, and the ISI of head and back."""
    ff, isf = F.col("ff"), F.col("isf")
    first = F.ln(M.div(isf, 0.208 * ff)) / 0.05039
    inside = F.when(isf < 0.999 * 2.496 * ff, 1 - isf / (2.496 * ff)).otherwise(1.0)
    second = F.when(isf < 0.999 * 2.496 * ff, 28 - F.ln(inside) / 0.0818).otherwise(112.45)
    along = lambda f: F.col("ws") * f(F.radians("wd")) + F.col("wse") * f(F.radians("aspect"))
    angle = F.degrees(F.acos(M.clip(M.div(F.col("wsy"), F.col("wsv")), -1, 1)))
    return [
        {"wse": F.when(first <= 40, first).when(first.isNotNull(), second)}, {"wsx": along(F.sin), "wsy": along(F.cos)}, {"wsv": F.hypot("wsx", "wsy")},
        {"raz": F.when(F.col("wsx") < 0, 360 - angle).otherwise(angle)}, {"isi": 0.208 * ff * wind_function(F.col("wsv"), True, M), "bisi": 0.208 * ff * F.exp(-0.05039 * F.col("wsv"))},
    ]


def buildup() -> Column:
    bui, bui0 = F.col("bui"), F.col("bui0")
    raw = F.when(bui == 0, 0.0).when(bui0.isNull(), 1.0).otherwise(F.exp(50 * F.ln("q") * (M.div(1.0, bui) - M.div(1.0, bui0))))
    return F.when(F.col("be_max").isNotNull() & bui.isNotNull(), F.greatest(F.lit(0.0), F.least(raw, F.col("be_max"))))


def surface_consumption() -> Column:
    bui, ffmc = F.col("bui"), F.col("ffmc")
    burn = lambda most, rate, power=1.0: most * F.pow(1 - F.exp(-rate * bui), power)
    c1 = F.when(ffmc > 84, 0.75 + 0.75 * F.sqrt(1 - F.exp(-0.23 * (ffmc - 84)))).otherwise(0.75 - 0.75 * F.sqrt(1 - F.exp(0.23 * (ffmc - 84))))
    c2, d1 = burn(5.0, 0.0115), burn(1.5, 0.0183)
    by = {
        (1,): c1, (2,): c2, (3, 4): burn(5.0, 0.0164, 2.24), (5, 6): burn(5.0, 0.0149, 2.48), (7,): F.greatest(F.lit(0.0), 2 * (1 - F.exp(-0.104 * (ffmc - 70)))) + burn(1.5, 0.0201), (8, 9): d1,
        (10, 11): F.col("pc") / 100 * c2 + (100 - F.col("pc")) / 100 * d1, (12, 13): c2, (14, 15): F.col("gfl"), (16,): burn(4.0, 0.025) + burn(4.0, 0.034), (17,): burn(10.0, 0.013) + burn(6.0, 0.06), (18,): burn(12.0, 0.0166) + burn(20.0, 0.021),
    }
    out = F.lit(None).cast("double")
    for codes, value in by.items():
        out = F.when(F.col("fuel_type").isin(*codes), value).otherwise(out)
    return out


def crown_fraction() -> Column:
    ft, rso = F.col("fuel_type"), F.col("rso")
    over = F.when(ft == 6, F.col("sros")).otherwise(F.col("hros")) - rso
    raw = F.when(over < -3086, 0.0).otherwise(1 - F.exp(-0.23 * over))
    return F.when(ft.isin(*NO_CROWN) | (ft > 18), 0.0).otherwise(M.clip(F.coalesce(F.nanvl(raw, F.lit(0.0)), F.lit(0.0)), 0, 1))


def percentile_growth(ros: str, percentile: float) -> Column:
    """Rate of spread at another percentile than the median; unchanged at 50."""
    if percentile == 50:
        return F.col(ros)
    z = NormalDist().inv_cdf(percentile / 100)
    out, x = F.col(ros), F.col(ros)
    for code, (surface, crown) in GROWTH.items():
        grown = F.pow(F.greatest(F.pow(x, 0.6) + z * crown, F.lit(0.0)), 1 / 0.6)
        crowned = x if crown < 0 else F.when(F.lit(-z * crown) > F.pow(x, 0.6), math.exp(z) * x).otherwise(grown)
        out = F.when(F.col("fuel_type") == code, F.when(F.col("cfb") < 0.1, x if surface < 0 else math.exp(z) * x).otherwise(crowned)).otherwise(out)
    return out


def intensity_class(hfi: Column) -> Column:
    return F.when(hfi > 10000, 6).when(hfi > 4000, 5).when(hfi > 2000, 4).when(hfi > 500, 3).when(hfi > 10, 2).when(hfi > 0, 1).otherwise(-99)


def behaviour(df: DataFrame, percentile: float = 50.0, want: list[str] | None = None) -> DataFrame:
    """The rows with every quantity of the system, or with those wanted only."""
    fuels = df.sparkSession.createDataFrame(FUELS, FUEL_SCHEMA)
    x = inputs(df).join(F.broadcast(fuels), "fuel_type", "left")  # 20 rows
    ft, isz, isi, bisi = F.col("fuel_type"), F.col("isz"), F.col("isi"), F.col("bisi")
    own = (F.col("a"), F.col("b"), F.col("c"))
    rate = lambda i: blended(spread(*own, i), spread(*C2, i), spread(*D1, i))
    pc, pdf = F.col("pc") / 100, F.col("pdf") / 100
    # at no wind the dead-fir types spread as their own curve alone
    still = F.when(ft.isin(12, 13), spread(*own, isz)).otherwise(rate(isz))
    isf_d1 = reverse_isi(spread(*D1, isz) * F.col("sf"), *D1)
    isf_own = reverse_isi(F.col("rsf"), F.when(ft.isin(14, 15), own[0] * F.col("cf")).otherwise(own[0]), own[1], own[2])
    isf = F.when(ft.isin(10, 11), pc * reverse_isi(spread(*C2, isz) * F.col("sf"), *C2) + (1 - pc) * isf_d1).when(ft.isin(12, 13), pdf * isf_own + (1 - pdf) * isf_d1).otherwise(isf_own)
    gcf, d2 = F.col("gcf"), ft == 9
    held = lambda r: F.when(d2, F.when(F.col("bui") < 70, 0.0).otherwise(0.2 * r)).otherwise(r)
    crowning = 60 * (1 - F.exp(-0.0497 * isi)) * (F.col("fme") / 0.778237)
    canopy = F.col("cfb") * F.col("cfl")
    steps = [
        {"wd": turned(F.col("wd")), "aspect": turned(F.col("aspect")), "sf": slope_factor(), "ff": moisture_function(moisture_of(F.col("ffmc")), M)}, {"isz": 0.208 * F.col("ff")}, *foliar_moisture(),
        {"cf": F.when(gcf < 58.8, 0.005 * (F.exp(0.061 * gcf) - 1)).otherwise(0.176 + 0.02 * (gcf - 58.8))}, {"rsz": still}, {"rsf": F.col("rsz") * F.col("sf")}, {"isf": isf}, *slope_wind(),
        {"rsi": rate(isi), "brsi": rate(bisi), "be": buildup()}, {"hros": held(F.col("rsi") * F.col("be")), "bros": held(F.col("brsi") * F.col("be")), "sros": F.when(ft == 6, F.col("rsi") * F.col("be"))},
        {"sfc": surface_consumption(), "csfi": F.when(ft < 14, F.pow(0.01 * F.col("cbh") * (460 + 25.9 * F.col("fmc")), 1.5)).otherwise(0.0)}, {"rso": F.when(F.col("sfc") > 0, F.col("csfi") / (300.0 * F.col("sfc"))).when(F.col("sfc").isNotNull(), 0.0)}, {"cfb": crown_fraction()},
        {"hros": percentile_growth("hros", percentile), "bros": percentile_growth("bros", percentile)},
        {"accel": F.when(ft.isin(*OPEN), 0.115).when(ft < 19, 0.115 - 18.8 * F.pow("cfb", 2.5) * F.exp(-8 * F.col("cfb"))), "fire_type": F.when(ft < 19, F.when(F.col("cfb") <= 0.1, 1).when(F.col("cfb") < 0.9, 2).otherwise(3)).otherwise(0)},
        {"cfc": F.when(ft.isin(10, 11), canopy * pc).when(ft.isin(12, 13), canopy * pdf).otherwise(canopy)}, {"cros": F.when(ft == 6, F.when(F.col("cfc") == 0, 0.0).otherwise(crowning))},
        {"hros": F.when(ft == 6, F.col("sros") + F.col("cfb") * (F.col("cros") - F.col("sros"))).otherwise(F.col("hros")), "tfc": F.col("sfc") + F.col("cfc")}, {"hfi": 300 * F.col("hros") * F.col("tfc")}, {"fi_class": intensity_class(F.col("hfi"))},
    ]
    for s in steps:
        x = x.withColumns(s)
    return x.select(*want) if want else x
