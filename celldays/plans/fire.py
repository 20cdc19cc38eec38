"""Queries of the fire-weather (fw) and fire-behaviour (fb) functions and of the daily state scan."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from celldays.functions import fbp, fwi
from celldays.functions.lawson import Tables, diurnal_ffmc
from celldays.plans.base import CELL_DAYS, OBS, Registry, obs
from celldays.plans.windows import codes

q = Registry()
R = lambda c, n=6: F.round(c, n)


def weather(s, d):
    """Distinct weather of the lines with codes of the day before."""
    o = obs(s, d).select("temp", "rh", "wind", "precip", F.month("day").alias("m"), (F.col("row") * 9 - 40).cast("double").alias("lat")).distinct()
    return o.withColumns({"f0": F.col("rh") + 25, "d0": F.col("temp") * 3, "c0": F.col("temp") * 12 + 3})


WX = f'{OBS}, wx as (select distinct temp, rh, wind, precip, month(day)::int as m, ("row" * 9 - 40)::double as lat, rh + 25 as f0, temp * 3 as d0, temp * 12 + 3 as c0 from obs)'
ID = "temp, rh, wind, precip, m, lat"
IDS = ID.split(", ")
SC = "(250.0 * 59.5 / 101.0)"


def ffmc_sql(src: str, f0: str = "f0") -> str:
    """A chain of CTEs over src that ends in ff(.., ffmc)."""
    return f"""
 m1 as (select *, {SC} * (101 - {f0}) / (59.5 + {f0}) as mo0, case when precip > 0.5 then precip - 0.5 else precip end as rf from {src}),
 m2 as (select *, case when precip > 0 then least(greatest(mo0 + case when rf = 0 then 0 else 42.5 * rf * exp(-100 / (251 - mo0)) * (1 - exp(-6.93 / nullif(rf, 0))) end + case when mo0 > 150 then 0.0015 * (mo0 - 150) ** 2 * sqrt(rf) else 0 end, 0), 250) else mo0 end as mo,
  0.942 * rh ** 0.679 + 11 * exp((rh - 100) / 10) + 0.18 * (21.1 - temp) * (1 - exp(-0.115 * rh)) as ed, 0.618 * rh ** 0.753 + 10 * exp((rh - 100) / 10) + 0.18 * (21.1 - temp) * (1 - exp(-0.115 * rh)) as ew,
  (0.424 * (1 - ((100 - rh) / 100) ** 1.7) + 0.0694 * sqrt(wind) * (1 - ((100 - rh) / 100) ** 8)) * 0.581 * exp(0.0365 * temp) as kw, (0.424 * (1 - (rh / 100) ** 1.7) + 0.0694 * sqrt(wind) * (1 - (rh / 100) ** 8)) * 0.581 * exp(0.0365 * temp) as kd from m1),
 m3 as (select *, least(greatest(case when mo < ed and mo < ew then ew - (ew - mo) / 10 ** kw when mo > ed then ed + (mo - ed) / 10 ** kd else mo end, 0), 250) as mm from m2),
 ff as (select *, least(greatest(59.5 * (250 - mm) / ({SC} + mm), 0), 101) as ffmc from m3)"""


_T = lambda xs: f"([{', '.join(map(str, xs))}])[m]"
DMC_LE = f"case when lat >= 10 and lat < 30 then {_T(fwi.DMC_10N)} when lat >= -10 and lat < 10 then 9 when lat >= -30 and lat < -10 then {_T(fwi.DMC_10S)} when lat < -30 then {_T(fwi.DMC_SOUTH)} else {_T(fwi.DMC_NORTH)} end"
DC_LF = f"case when lat >= -20 and lat < 20 then 1.4 when lat < -20 then {_T(fwi.DC_SOUTH)} else {_T(fwi.DC_NORTH)} end"
DMC_B = "case when {d} <= 33 then 100 / (0.5 + 0.3 * {d}) when {d} <= 65 then 14 - 1.3 * ln(greatest({d}, 1)) else 6.2 * ln(greatest({d}, 1)) - 17.2 end"


def dmc_sql(d0: str = "d0") -> str:
    b = DMC_B.format(d=d0)
    wet = f"20 + 280 / exp(0.023 * {d0}) + 1000 * (0.92 * precip - 1.27) / (48.77 + {b} * (0.92 * precip - 1.27))"
    return f"greatest(case when precip > 1.5 then 244.72 - 43.43 * ln(case when precip > 1.5 then {wet} - 20 else 1 end) else {d0} end + 1.894 * (greatest(temp, -1.1) + 1.1) * (100 - rh) * ({DMC_LE}) * 1e-4, 0)"


def dc_sql(c0: str = "c0") -> str:
    return f"greatest(case when precip > 2.8 then 400 * ln(800 / (800 / exp({c0} / 400) + 3.937 * (0.83 * precip - 1.27))) else {c0} end + 0.5 * (0.36 * (temp + 2.8) + ({DC_LF})), 0)"


def isi_sql(f: str) -> str:
    m = f"(147.2 * (101 - {f}) / (59.5 + {f}))"
    return f"0.208 * exp(0.05039 * wind) * 91.9 * exp(-0.1386 * {m}) * (1 + {m} ** 5.31 / 49300000)"


def bui_sql(d: str, c: str) -> str:
    return f"greatest(case when {d} = 0 then 0 when {d} <= 0.4 * {c} then 0.8 * {d} * {c} / ({d} + 0.4 * {c}) else {d} - (1 - 0.8 * {c} / ({d} + 0.4 * {c})) * (0.92 + (0.0114 * {d}) ** 1.7) end, 0)"


def fwi_sql(i: str, u: str) -> str:
    b = f"(0.1 * {i} * case when {u} <= 80 then 0.626 * {u} ** 0.809 + 2 else 1000 / (25 + 108.64 * exp(-0.023 * {u})) end)"
    return f"case when {b} > 1 then exp(2.72 * (0.434 * ln(greatest({b}, 1))) ** 0.647) else {b} end"


@q("fw1_daily_ffmc", f"with {WX}, {ffmc_sql('wx')} select {ID}, round(ffmc, 6) as ffmc from ff")
def _(s, d):
    return weather(s, d).select(*IDS, R(fwi.daily_ffmc(*map(F.col, ("f0", "temp", "rh", "wind", "precip")))).alias("ffmc"))


@q("fw2_daily_dmc", f"with {WX} select {ID}, round({dmc_sql()}, 4) as dmc from wx")
def _(s, d):
    return weather(s, d).select(*IDS, R(fwi.daily_dmc(*map(F.col, ("d0", "temp", "rh", "precip", "m", "lat"))), 4).alias("dmc"))


@q("fw3_daily_dc", f"with {WX} select {ID}, round({dc_sql()}, 6) as dc from wx")
def _(s, d):
    return weather(s, d).select(*IDS, R(fwi.daily_dc(*map(F.col, ("c0", "temp", "precip", "m", "lat")))).alias("dc"))


@q("fw4_isi", f"with {WX} select {ID}, round({isi_sql('f0')}, 6) as isi from wx")
def _(s, d):
    return weather(s, d).select(*IDS, R(fwi.daily_isi(F.col("wind"), F.col("f0"))).alias("isi"))


@q("fw5_bui", f"with {WX} select {ID}, round({bui_sql('d0', 'c0')}, 6) as bui from wx")
def _(s, d):
    return weather(s, d).select(*IDS, R(fwi.daily_bui(F.col("d0"), F.col("c0"))).alias("bui"))


@q("fw6_fw7_fwi_dsr", f"with {WX}, x as (select *, {fwi_sql('wind', 'd0')} as v from wx) select {ID}, round(v, 6) as fwi, round(0.0272 * v ** 1.77, 6) as dsr from x")
def _(s, d):
    v = fwi.daily_fwi(F.col("wind"), F.col("d0"))
    return weather(s, d).select(*IDS, R(v).alias("fwi"), R(fwi.daily_dsr(v)).alias("dsr"))


@q("fw8_startup_dc", f"with {WX} select {ID}, round(greatest(400 * ln(800 / (800 * exp(-c0 / 400) + case when rh < 40 then 0 else (rh - 40) / 40 end * 3.937 * precip * 9)) + 0.5 * (0.36 * (temp + 2.8) + ({DC_LF})), 0), 6) as dc from wx")
def _(s, d):
    v = fwi.startup_dc(F.col("c0"), F.lit(40.0), F.col("rh"), F.col("precip") * 9, F.col("temp"), F.col("m"), F.col("lat"))
    return weather(s, d).select(*IDS, R(v).alias("dc"))


@q("fw9_hourly_ffmc", f"""with {WX},
 m1 as (select *, 147.2 * (101 - f0) / (59.5 + f0) as mo0 from wx),
 m2 as (select *, case when precip > 0 then least(greatest(mo0 + 42.5 * precip * exp(-100 / (251 - mo0)) * (1 - exp(-6.93 / nullif(precip, 0))) + case when mo0 > 150 then 0.0015 * (mo0 - 150) ** 2 * sqrt(precip) else 0 end, 0), 250) else mo0 end as mo,
  0.942 * rh ** 0.679 + 11 * exp((rh - 100) / 10) + 0.18 * (21.1 - temp) * (1 - exp(-0.115 * rh)) as ed, 0.618 * rh ** 0.753 + 10 * exp((rh - 100) / 10) + 0.18 * (21.1 - temp) * (1 - exp(-0.115 * rh)) as ew,
  (0.424 * (1 - ((100 - rh) / 100) ** 1.7) + 0.0694 * sqrt(wind) * (1 - ((100 - rh) / 100) ** 8)) * 0.0579 * exp(0.0365 * temp) as kw, (0.424 * (1 - (rh / 100) ** 1.7) + 0.0694 * sqrt(wind) * (1 - (rh / 100) ** 8)) * 0.0579 * exp(0.0365 * temp) as kd from m1),
 m3 as (select *, least(greatest(case when mo > ed then ed + (mo - ed) * exp(-2.303 * kd) when mo < ew then ew - (ew - mo) * exp(-2.303 * kw) else mo end, 0), 250) as mm from m2)
 select {ID}, round(least(greatest(59.5 * (250 - mm) / (147.2 + mm), 0), 101), 6) as ffmc from m3""")
def _(s, d):
    return weather(s, d).select(*IDS, R(fwi.hourly_ffmc(*map(F.col, ("f0", "temp", "rh", "wind", "precip")))).alias("ffmc"))


def stand_in_tables(step: float = 5.0) -> Tables:
    """Tables of the published shape but not the published values, which are not restated here: a daily cosine around 17:00 whose swing shrinks with the code, lifted or lowered by humidity class."""
    axis = [17.5, *(20 + step * i for i in range(int(80 / step) + 1)), 101.0]

    def rows(hours, lift: float) -> dict[int, list[float]]:
        swing = lambda h: (1 - math.cos(2 * math.pi * (h - 17) / 24)) / 2
        return {h: [max(0.0, min(101.0, f + lift - swing(h) * (101 - f) * 0.45)) for f in axis] for h in hours}

    morning = range(6, 13)
    limits = {h: (90 - 6 * (h - 6), 98 - 4 * (h - 6)) for h in morning}
    return Tables(axis, rows([*range(12, 25), *range(1, 6)], 0.0), rows(morning, 4.0), rows(morning, 0.0), rows(morning, -4.0), limits)


@q("fw10_diurnal_ffmc")
def _(s, d):
    w = weather(s, d).withColumn("hour", (F.col("m") * 2 + 1).cast("int")).withColumn("minute", (F.col("m") * 5 % 60).cast("int"))
    return diurnal_ffmc(w.withColumn("ffmc", F.col("f0")), stand_in_tables())


_STEP = f"""{ffmc_sql("(select o.cell, o.k, o.day, o.m, o.lat, o.temp, o.rh, o.wind, o.precip, p.f as f0, p.dm as d0, p.dr as c0 from o join st p on p.cell = o.cell and o.k = p.k + 1)")}"""


@q("w3_daily_scan", f"""with recursive {CELL_DAYS}, o as (select "row" || '_' || col as cell, row_number() over (partition by "row", col order by day) as k, day, month(day)::int as m, "row" * 4 + 20.0::double as lat, temp, rh, wind, precip from cd),
 st as (select cell, 0::bigint as k, null::date as day, 85.0::double as f, 6.0::double as dm, 15.0::double as dr, 0.0::double as wind from (select distinct cell from o)
  union all (with {_STEP} select cell, k, day, ffmc, {dmc_sql()}, {dc_sql()}, wind from ff)),
 r as (select cell, day, f as ffmc, dm as dmc, dr as dc, {isi_sql('f')} as isi, {bui_sql('dm', 'dr')} as bui from st where k > 0)
 select cell, day, round(ffmc, 4) as ffmc, round(dmc, 4) as dmc, round(dc, 4) as dc, round(isi, 4) as isi, round(bui, 4) as bui, round({fwi_sql('isi', 'bui')}, 4) as fwi from r""")
def _(s, d):
    return codes(s, d).withColumns({c: R(c, 4) for c in ("ffmc", "dmc", "dc", "isi", "bui", "fwi")})


def stands(s, d):
    """Fire-behaviour cases: every fuel under weather taken from the lines."""
    o = obs(s, d).select((F.col("part") % 20 + 1).cast("int").alias("fuel_type"), F.date_format("day", "yyyyMMdd").cast("int").alias("wx_date"), (45.0 + F.col("row") % 15).alias("lat"), (-115.0 - F.col("col")).alias("long"),
        (F.col("part") % 900).cast("double").alias("elevation"), F.col("rh").alias("slope"), (F.col("temp") * 9).alias("aspect"), "wind", "temp", "rh", "n")
    return o.select("fuel_type", "wx_date", "lat", "long", "elevation", (F.col("slope") - 10).alias("slope"), "aspect", F.col("wind").alias("ws"), (F.col("temp") * 10 - 20).alias("wd"), (F.col("rh") / 4 + 75).alias("ffmc"), (F.col("temp") * 4 - 25).alias("bui")).distinct()


CASE = ["fuel_type", "wx_date", "lat", "long", "elevation", "slope", "aspect", "ws", "wd", "ffmc", "bui"]
OUT = ["sf", "isz", "fmc", "fme", "rsz", "isf", "wse", "wsv", "raz", "isi", "rsi", "brsi", "be", "hros", "bros", "sfc", "csfi", "rso", "cfb", "accel", "fire_type", "cfc", "tfc", "hfi", "fi_class"]


def behaved(s, d, want):
    keys = stands(s, d).withColumns({f"i_{c}": F.col(c) for c in CASE})
    out = fbp.behaviour(keys, 50.0, [*(f"i_{c}" for c in CASE), *want])
    return out.select(*(F.col(f"i_{c}").alias(c) if c not in want else F.col(f"i_{c}").alias(f"in_{c}") for c in CASE), *(R(c, 5).alias(c) if c not in ("fire_type", "fi_class") else F.col(c) for c in want))


_S = lambda a, b, c, i: f"{a} * (1 - exp(-{b} * {i})) ** {c}"
_RATE = lambda i: f"case fuel_type when 10 then pc * {_S(110, 0.0282, 1.5, i)} + (1 - pc) * {_S(30, 0.0232, 1.6, i)} when 11 then pc * {_S(110, 0.0282, 1.5, i)} + 0.2 * (1 - pc) * {_S(30, 0.0232, 1.6, i)} when 12 then pdf * {_S('a', 'b', 'c', i)} + (1 - pdf) * {_S(30, 0.0232, 1.6, i)} when 13 then pdf * {_S('a', 'b', 'c', i)} + 0.2 * (1 - pdf) * {_S(30, 0.0232, 1.6, i)} when 14 then {_S('a', 'b', 'c', i)} * cf when 15 then {_S('a', 'b', 'c', i)} * cf else {_S('a', 'b', 'c', i)} end"
_BACK = lambda r, a, b, c: f"ln(greatest(1 - ({r} / {a}) ** (1.0 / {c}), 0.01)) / -{b}"
_FUELS = ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in f) + ")" for f in fbp.FUELS)
FBP = f"""{OBS}, fuels(fuel_type, fuel, a, b, c, q, bui0, be_max, cbh, cfl) as (values {_FUELS}),
 k as (select distinct (part % 20 + 1)::int as fuel_type, strftime(day, '%Y%m%d')::int as wx_date, dayofyear(day) as dj, 45.0::double + "row" % 15 as lat, -115.0::double - col as long, (part % 900)::double as elevation, rh - 10 as slope, temp * 9 as aspect, wind as ws, temp * 10 - 20 as wd, rh / 4 + 75 as ffmc, temp * 4 - 25 as bui from obs),
 k1 as (select k.*, fuels.* exclude (fuel_type), greatest(slope, 0) as sl, greatest(bui, 0) as bu, case when wd > 180 then wd - 180 else wd + 180 end as wdi, case when (case when aspect < 0 then 270 else aspect end) > 180 then aspect - 180 else (case when aspect < 0 then 270 else aspect end) + 180 end as asp, 0.5 as pc, 0.35 as pdf, 0.35 as gfl, 0.176 + 0.02 * (80 - 58.8) as cf, {SC} * (101 - ffmc) / (59.5 + ffmc) as m from k left join fuels using (fuel_type)),
 k2 as (select *, case when sl < 70 then exp(3.533 * (sl / 100) ** 1.2) else 10 end as sf, 91.9 * exp(-0.1386 * m) * (1 + m ** 5.31 / 4.93e7) as ff, case when elevation > 0 then 43 + 33.7 * exp(-0.0351 * (150 - abs(long))) else 46 + 23.4 * exp(-0.036 * (150 - abs(long))) end as latn from k1),
 k3 as (select *, 0.208 * ff as isz, abs(dj - round_even(case when elevation > 0 then 142.1 * (lat / latn) + 0.0172 * elevation else 151 * (lat / latn) end, 0)) as nd from k2),
 k4 as (select *, case when nd < 30 then 85 + 0.0189 * nd * nd when nd < 50 then 32.9 + 3.17 * nd - 0.0288 * nd * nd else 120 end as fmc, case when fuel_type in (12, 13) then {_S('a', 'b', 'c', 'isz')} else {_RATE('isz')} end as rsz from k3),
 k5 as (select *, 1000 * (1.5 - 0.00275 * fmc) ** 4 / (460 + 25.9 * fmc) as fme, rsz * sf as rsf, {_BACK(_S(110, 0.0282, 1.5, 'isz') + ' * sf', 110, 0.0282, 1.5)} as i_c2, {_BACK(_S(30, 0.0232, 1.6, 'isz') + ' * sf', 30, 0.0232, 1.6)} as i_d1 from k4),
 k6 as (select *, case when fuel_type in (10, 11) then pc * i_c2 + (1 - pc) * i_d1 when fuel_type in (12, 13) then pdf * ({_BACK('rsf', 'a', 'b', 'c')}) + (1 - pdf) * i_d1 when fuel_type in (14, 15) then {_BACK('rsf', '(a * cf)', 'b', 'c')} else {_BACK('rsf', 'a', 'b', 'c')} end as isf from k5),
 k7 as (select *, case when ln(isf / (0.208 * ff)) / 0.05039 <= 40 then ln(isf / (0.208 * ff)) / 0.05039 when isf < 0.999 * 2.496 * ff then 28 - ln(greatest(1 - isf / (2.496 * ff), 1e-9)) / 0.0818 when isf is not null then 112.45 end as wse from k6),
 k8 as (select *, ws * sin(radians(wdi)) + wse * sin(radians(asp)) as wsx, ws * cos(radians(wdi)) + wse * cos(radians(asp)) as wsy from k7),
 k9 as (select *, sqrt(wsx * wsx + wsy * wsy) as wsv from k8),
 k10 as (select *, case when wsx is null then null when wsx < 0 then 360 - degrees(acos(least(greatest(wsy / wsv, -1), 1))) else degrees(acos(least(greatest(wsy / wsv, -1), 1))) end as raz, 0.208 * ff * case when wsv > 40 then 12 * (1 - exp(-0.0818 * (wsv - 28))) else exp(0.05039 * wsv) end as isi, 0.208 * ff * exp(-0.05039 * wsv) as bisi from k9),
 k11 as (select *, {_RATE('isi')} as rsi, {_RATE('bisi')} as brsi, case when be_max is not null then greatest(0, least(case when bu = 0 then 0 when bui0 is null then 1 else exp(50 * ln(q) * (1 / nullif(bu, 0) - 1 / bui0)) end, be_max)) end as be from k10),
 k12 as (select *, case when fuel_type = 9 then case when bu < 70 then 0 else 0.2 * rsi * be end else rsi * be end as h0, case when fuel_type = 9 then case when bu < 70 then 0 else 0.2 * brsi * be end else brsi * be end as bros,
  case when fuel_type = 1 then case when ffmc > 84 then 0.75 + 0.75 * sqrt(1 - exp(-0.23 * (ffmc - 84))) else 0.75 - 0.75 * sqrt(1 - exp(0.23 * (ffmc - 84))) end when fuel_type in (2, 12, 13) then 5 * (1 - exp(-0.0115 * bu)) when fuel_type in (3, 4) then 5 * (1 - exp(-0.0164 * bu)) ** 2.24 when fuel_type in (5, 6) then 5 * (1 - exp(-0.0149 * bu)) ** 2.48
   when fuel_type = 7 then greatest(0, 2 * (1 - exp(-0.104 * (ffmc - 70)))) + 1.5 * (1 - exp(-0.0201 * bu)) when fuel_type in (8, 9) then 1.5 * (1 - exp(-0.0183 * bu)) when fuel_type in (10, 11) then pc * 5 * (1 - exp(-0.0115 * bu)) + (1 - pc) * 1.5 * (1 - exp(-0.0183 * bu)) when fuel_type in (14, 15) then gfl
   when fuel_type = 16 then 4 * (1 - exp(-0.025 * bu)) + 4 * (1 - exp(-0.034 * bu)) when fuel_type = 17 then 10 * (1 - exp(-0.013 * bu)) + 6 * (1 - exp(-0.06 * bu)) when fuel_type = 18 then 12 * (1 - exp(-0.0166 * bu)) + 20 * (1 - exp(-0.021 * bu)) end as sfc,
  case when fuel_type < 14 then (0.01 * cbh * (460 + 25.9 * fmc)) ** 1.5 else 0 end as csfi from k11),
 k13 as (select *, case when sfc > 0 then csfi / (300 * sfc) when sfc is not null then 0 end as rso from k12),
 k14 as (select *, case when fuel_type in (8, 9, 14, 15, 16, 17, 18) or fuel_type > 18 then 0 else least(greatest(coalesce(1 - exp(-0.23 * ((case when fuel_type = 6 then rsi * be else h0 end) - rso)), 0), 0), 1) end as cfb from k13),
 k15 as (select *, cfb * cfl * case when fuel_type in (10, 11) then pc when fuel_type in (12, 13) then pdf else 1 end as cfc, case when fuel_type in (1, 7, 9, 14, 15, 16, 17, 18) then 0.115 when fuel_type < 19 then 0.115 - 18.8 * cfb ** 2.5 * exp(-8 * cfb) end as accel, case when fuel_type < 19 then case when cfb <= 0.1 then 1 when cfb < 0.9 then 2 else 3 end else 0 end as fire_type from k14),
 k16 as (select *, sfc + cfc as tfc, case when fuel_type = 6 then rsi * be + cfb * (case when cfc = 0 then 0 else 60 * (1 - exp(-0.0497 * isi)) * (fme / 0.778237) end - rsi * be) else h0 end as hros from k15),
 k17 as (select *, 300 * hros * tfc as hfi from k16), k18 as (select *, case when hfi > 10000 then 6 when hfi > 4000 then 5 when hfi > 2000 then 4 when hfi > 500 then 3 when hfi > 10 then 2 when hfi > 0 then 1 else -99 end as fi_class from k17)"""
_SEL = lambda want: ", ".join([*CASE, *(f"round({c}, 5) as {c}" if c not in ("fire_type", "fi_class") else c for c in want)])
GROUPS = {
    "fb02_fb04_slope_moisture": ["sf", "isz", "fmc", "fme"], "fb05_slope_wind": ["isf", "wse", "wsv", "raz", "isi"], "fb06_spread_index": ["rsz", "rsi", "brsi", "be"], "fb07_rate_of_spread": ["hros", "bros"],
    "fb08_surface_consumption": ["sfc"], "fb09_fb11_crown": ["csfi", "rso", "cfb"], "fb13_fb14_acceleration_type": ["accel", "fire_type"], "fb15_fb16_intensity": ["cfc", "tfc", "hfi", "fi_class"],
}
for _name, _want in GROUPS.items():
    q(_name, f"with {FBP} select {_SEL(_want)} from k18")(lambda s, d, want=_want: behaved(s, d, want))


@q("fb01_inverted_angles", f"with {FBP} select distinct wd, wdi as wd_inverted, aspect, asp as aspect_inverted from k1")
def _(s, d):
    x = stands(s, d)
    return x.select("wd", fbp.turned(F.col("wd")).alias("wd_inverted"), "aspect", fbp.turned(F.when(F.col("aspect") < 0, 270.0).otherwise(F.col("aspect"))).alias("aspect_inverted")).distinct()


@q("fb12_percentile_growth")
def _(s, d):
    x = fbp.behaviour(stands(s, d), 90.0)
    return x.groupBy("fuel").agg(R(F.avg("hros"), 6).alias("hros"), R(F.avg("bros"), 6).alias("bros"), F.count(F.lit(1)).alias("n"))


QUERIES, SQL = q.queries, q.sql
