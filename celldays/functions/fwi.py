"""Canadian Fire Weather Index System (Van Wagner 1987), as expressions over a backend of backends.py.

A missing input gives a missing result. Daily codes take the previous day's code first; month is 1 to 12.
"""

from __future__ import annotations

from celldays.functions.backends import SparkMath

SCALE = 250.0 * 59.5 / 101.0
START = {"ffmc": 85.0, "dmc": 6.0, "dc": 15.0}
# fixed values: effective day lengths of the duff moisture code by latitude band
DMC_NORTH = [6.5, 7.5, 9, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8, 7, 6]
DMC_10N = [7.9, 8.4, 8.9, 9.5, 9.9, 10.2, 10.1, 9.7, 9.1, 8.6, 8.1, 7.8]
DMC_10S = [10.1, 9.6, 9.1, 8.5, 8.1, 7.8, 7.9, 8.3, 8.9, 9.4, 9.9, 10.2]
DMC_SOUTH = [11.5, 10.5, 9.2, 7.9, 6.8, 6.2, 6.5, 7.4, 8.7, 10, 11.2, 11.8]
# fixed values: day-length factors of the drought code
DC_NORTH = [-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5, 2.4, 0.4, -1.6, -1.6]
DC_SOUTH = [6.4, 5, 2.4, 0.4, -1.6, -1.6, -1.6, -1.6, -1.6, 0.9, 3.8, 5.8]


def moisture_of(ffmc, scale: float = SCALE):
    return scale * (101 - ffmc) / (59.5 + ffmc)


def _wetted(mo, rain, m):
    """Moisture after rain on litter of moisture mo."""
    gain = m.where(rain == 0, m.num(0.0), 42.5 * rain * m.exp(m.div(-100.0, 251 - mo)) * (1 - m.exp(m.div(-6.93, rain))))
    extra = m.where(mo > 150, 0.0015 * m.power(mo - 150, 2) * m.sqrt(rain), m.num(0.0))
    return m.clip(mo + gain + extra, 0, 250)


def _equilibria(temp, rh, m):
    common = 0.18 * (21.1 - temp) * (1 - m.exp(-0.115 * rh))
    wet = m.exp((rh - 100) / 10)
    return 0.942 * m.power(rh, 0.679) + 11 * wet + common, 0.618 * m.power(rh, 0.753) + 10 * wet + common


def _rate(share, wind, temp, m, factor: float):
    return (0.424 * (1 - m.power(share, 1.7)) + 0.0694 * m.sqrt(wind) * (1 - m.power(share, 8))) * factor * m.exp(0.0365 * temp)


def daily_ffmc(ffmc0, temp, rh, wind, precip, m=SparkMath):
    ffmc0, temp, rh, wind, precip = map(m.num, (ffmc0, temp, rh, wind, precip))
    mo = moisture_of(ffmc0)
    mo = m.where(precip > 0, _wetted(mo, m.where(precip > 0.5, precip - 0.5, precip), m), mo)
    ed, ew = _equilibria(temp, rh, m)
    kw, kd = _rate((100 - rh) / 100, wind, temp, m, 0.581), _rate(rh / 100, wind, temp, m, 0.581)
    wetting, drying = ew - (ew - mo) / m.power(m.num(10.0), kw), ed + (mo - ed) / m.power(m.num(10.0), kd)
    out = m.where((mo < ed) & (mo < ew), wetting, m.where(mo > ed, drying, mo))
    out = m.clip(out, 0, 250)
    return m.guard(m.clip(59.5 * (250 - out) / (SCALE + out), 0, 101), ffmc0, temp, rh, wind, precip)


def hourly_ffmc(ffmc0, temp, rh, wind, precip, hours: float = 1.0, precise: bool = False, m=SparkMath):
    ffmc0, temp, rh, wind, precip = map(m.num, (ffmc0, temp, rh, wind, precip))
    scale = SCALE if precise else 147.2
    mo = moisture_of(ffmc0, scale)
    mo = m.where(precip > 0, _wetted(mo, precip, m), mo)
    ed, ew = _equilibria(temp, rh, m)
    kd, kw = _rate(rh / 100, wind, temp, m, 0.0579), _rate((100 - rh) / 100, wind, temp, m, 0.0579)
    fall = (lambda k: m.power(m.num(10.0), -k * hours)) if precise else (lambda k: m.exp(-2.303 * k * hours))
    out = m.where(mo > ed, ed + (mo - ed) * fall(kd), ew - (ew - mo) * fall(kw))
    out = m.clip(m.where((ed >= mo) & (mo >= ew), mo, out), 0, 250)
    return m.guard(m.clip(59.5 * (250 - out) / (scale + out), 0, 101), ffmc0, temp, rh, wind, precip)


def _by_latitude(lat, month, bands: list, default: list, m):
    """Table value of the month: bands are (from, below, table)."""
    out = m.pick(default, month)
    for low, high, table in bands:
        out = m.where((lat >= low) & (lat < high), m.pick(table, month), out)
    return out


def daily_dmc(dmc0, temp, rh, precip, month, lat, lat_adjust: bool = True, m=SparkMath):
    dmc0, temp, rh, precip, lat = map(m.num, (dmc0, temp, rh, precip, lat))
    temp = m.clip(temp, -1.1)
    bands = [(10, 30, DMC_10N), (-10, 10, [9] * 12), (-30, -10, DMC_10S), (-91, -30, DMC_SOUTH)] if lat_adjust else []
    gain = 1.894 * (temp + 1.1) * (100 - rh) * _by_latitude(lat, month, bands, DMC_NORTH, m) * 1e-4
    mo = 20 + 280 / m.exp(0.023 * dmc0)
    # logarithms and quotients are taken of values inside their domains only
    safe = m.where(dmc0 > 33, dmc0, m.num(34.0))
    b = m.where(dmc0 <= 33, m.div(100.0, 0.5 + 0.3 * dmc0), m.where(dmc0 <= 65, 14 - 1.3 * m.log(safe), 6.2 * m.log(safe) - 17.2))
    rain = 0.92 * precip - 1.27
    wet = m.clip(mo + m.div(1000 * rain, 48.77 + b * rain), 0)
    out = m.where(precip > 1.5, 244.72 - 43.43 * m.log(m.where(precip > 1.5, wet - 20, m.num(1.0))), dmc0)
    return m.guard(m.clip(out + gain, 0), dmc0, temp, rh, precip, lat)


def _dc_gain(temp, month, lat, lat_adjust: bool, m):
    bands = [(-20, 20, [1.4] * 12), (-91, -20, DC_SOUTH)] if lat_adjust else []
    return 0.36 * (temp + 2.8) + _by_latitude(lat, month, bands, DC_NORTH, m)


def daily_dc(dc0, temp, precip, month, lat, lat_adjust: bool = True, m=SparkMath):
    dc0, temp, precip, lat = map(m.num, (dc0, temp, precip, lat))
    gain = _dc_gain(temp, month, lat, lat_adjust, m)
    stored = 800 / m.exp(dc0 / 400) + 3.937 * (0.83 * precip - 1.27)
    out = m.where(precip > 2.8, 400 * m.log(m.div(800.0, stored)), dc0) + 0.5 * gain
    return m.guard(m.clip(out, 0), dc0, temp, precip, lat)


def startup_dc(dc_stop, moist_stop, moist_start, precip_winter, temp, month, lat, lat_adjust: bool = True, m=SparkMath):
    dc_stop, moist_stop, moist_start, precip_winter, temp, lat = map(m.num, (dc_stop, moist_stop, moist_start, precip_winter, temp, lat))
    share = m.where(moist_start < moist_stop, m.num(0.0), m.div(moist_start - moist_stop, moist_stop))
    spring = 800 * m.exp(-dc_stop / 400) + share * 3.937 * precip_winter
    out = 400 * m.log(m.div(800.0, spring)) + 0.5 * _dc_gain(temp, month, lat, lat_adjust, m)
    return m.guard(m.clip(out, 0), dc_stop, moist_stop, moist_start, precip_winter, temp, lat)


def wind_function(wind, fbp_mod: bool, m):
    plain = m.exp(0.05039 * wind)
    return m.where(wind > 40, 12 * (1 - m.exp(-0.0818 * (wind - 28))), plain) if fbp_mod else plain


def moisture_function(mo, m):
    return 91.9 * m.exp(-0.1386 * mo) * (1 + m.power(mo, 5.31) / 49300000)


def daily_isi(wind, ffmc, fbp_mod: bool = False, m=SparkMath):
    wind, ffmc = m.num(wind), m.num(ffmc)
    return m.guard(m.clip(0.208 * wind_function(wind, fbp_mod, m) * moisture_function(moisture_of(ffmc, 147.2), m), 0), wind, ffmc)


def daily_bui(dmc, dc, m=SparkMath):
    dmc, dc = m.num(dmc), m.num(dc)
    ratio = m.div(0.8 * dc, dmc + 0.4 * dc)
    out = m.where(dmc == 0, m.num(0.0), m.where(dmc <= 0.4 * dc, dmc * ratio, dmc - (1 - ratio) * (0.92 + m.power(0.0114 * dmc, 1.7))))
    return m.guard(m.clip(out, 0), dmc, dc)


def daily_fwi(isi, bui, m=SparkMath):
    isi, bui = m.num(isi), m.num(bui)
    b = 0.1 * isi * m.where(bui <= 80, 0.626 * m.power(bui, 0.809) + 2, 1000 / (25 + 108.64 * m.exp(-0.023 * bui)))
    out = m.where(b > 1, m.exp(2.72 * m.power(0.434 * m.log(m.where(b > 1, b, m.num(1.0))), 0.647)), b)
    return m.guard(m.clip(out, 0), isi, bui)


def daily_dsr(fwi, m=SparkMath):
    fwi = m.num(fwi)
    return m.guard(m.clip(0.0272 * m.power(fwi, 1.77), 0), fwi)
