"""Queries of projections, scalar functions (x) and predicates (f)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from celldays.functions import scalars as S
from celldays.functions.fbp import convert_grid_codes, grass_curing
from celldays.functions.reading import label_fits, split_of
from celldays.functions.time import cyclic, day_floor_seconds, is_summer
from celldays.operators import relational as RL
from celldays.operators.grid import Grid, albers, flat, place, unflat
from celldays.operators.metrics import focal_loss, sanitised
from celldays.operators.quality import all_missing, any_missing, complete_keys, gone
from celldays.plans.base import CELL_DAYS, OBS, POINTS, Registry, cell_days, features, obs, points
from celldays.session import table

q = Registry()
E_ = "epoch_ms(ts) // 1000"


@q("x01_x02_day_floor", f"select event_id, ts::date as day, ({E_} // 86400 * 86400)::bigint as day_s, ({E_} // 86400 * 86400 + 7 * 86400)::bigint as week_later_s from events")
def _(s, d):
    t = table(s, d, "events")
    sec = day_floor_seconds(F.col("ts"))
    return t.select("event_id", F.to_date("ts").alias("day"), sec.alias("day_s"), (sec + 7 * 86400).alias("week_later_s"))


@q("x03_x05_date_parts", "select o_orderkey, year(o_orderdate)::int as y, month(o_orderdate)::int as m, dayofyear(o_orderdate)::int as doy, month(o_orderdate) between 6 and 9 as summer, make_date(year(o_orderdate), 6, 1) as summer_start, last_day(make_date(year(o_orderdate), 9, 1)) as summer_end, (o_orderdate::date - 64) as history_start from orders")
def _(s, d):
    day = F.to_date("o_orderdate")
    y = F.year(day)
    return table(s, d, "orders").select("o_orderkey", y.alias("y"), F.month(day).alias("m"), F.dayofyear(day).alias("doy"), is_summer(day).alias("summer"), F.make_date(y, F.lit(6), F.lit(1)).alias("summer_start"), F.last_day(F.make_date(y, F.lit(9), F.lit(1))).alias("summer_end"), F.date_sub(day, 64).alias("history_start"))


@q("x06_x07_half_even", "select c_custkey, round_even(c_acctbal / 0.1, 0) * 0.1 as bin, round_even(c_acctbal / 7, 4) as r4 from customer")
def _(s, d):
    v = F.col("c_acctbal")
    return table(s, d, "customer").select("c_custkey", S.bin_half_even(v).alias("bin"), F.bround(v / 7, 4).alias("r4"))


@q("x08_units", 'select feat_id, tmax::double - 273.15 as tmax_c, wind_speed::double * 3.6 as wind_kmh, least(greatest(rh_max::double, 0), 100) as rh from features_train where tmax is not null and not isnan(tmax) and wind_speed is not null and not isnan(wind_speed) and rh_max is not null and not isnan(rh_max)')
def _(s, d):
    ok = ~(gone("tmax", False) | gone("wind_speed", False) | gone("rh_max", False))
    return features(s, d).where(ok).select("feat_id", S.celsius(F.col("tmax").cast("double")).alias("tmax_c"), (F.col("wind_speed").cast("double") * 3.6).alias("wind_kmh"), S.clipped(F.col("rh_max").cast("double"), 0.0, 100.0).alias("rh"))


@q("x09_wind_vector", f"with {OBS} select line, n, part, round(sqrt((temp - 20) ** 2 + (wind - 10) ** 2), 6) as speed, round(mod(mod(degrees(atan2(-(temp - 20), -(wind - 10))), 360) + 360, 360), 6) as direction from obs")
def _(s, d):
    u, v = F.col("temp") - 20, F.col("wind") - 10
    return obs(s, d).select("line", "n", "part", F.round(S.wind_speed(u, v), 6).alias("speed"), F.round(S.wind_from(u, v), 6).alias("direction"))


@q("x10_x11_spectral", "select l_orderkey, l_linenumber, l_partkey, round((l_discount - l_tax) / nullif(l_discount + l_tax, 0), 9) as ndvi, round(2.5 * (l_discount - l_tax) / nullif(l_discount + 6 * l_tax - 7.5 * l_quantity / 1000 + 1, 0), 9) as evi from lineitem")
def _(s, d):
    red, nir, blue = F.col("l_tax"), F.col("l_discount"), F.col("l_quantity") / 1000
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(S.ndvi(red, nir), 9).alias("ndvi"), F.round(F.try_divide(2.5 * (nir - red), nir + 6 * red - 7.5 * F.col("l_quantity") / 1000 + 1), 9).alias("evi"))


@q("x13_x14_affine", "select id, round(111320.0 * cos(radians(y)), 6) as m_lon, 196000 + x * 4000 as east, 2200000 - y * 4000 as north from (select c_custkey as id, (c_custkey * 37) % 1009 / 100.0::double as x, (c_custkey * 61) % 997 / 100.0::double as y from customer)")
def _(s, d):
    return points(s, d).select("id", F.round(S.metres_per_degree(F.col("y"))[1], 6).alias("m_lon"), (196000 + F.col("x") * 4000).alias("east"), (2200000 - F.col("y") * 4000).alias("north"))


GRID = Grid(1.0, 9.0, 0.5, 14, 15)


@q("x15_x17_place", f'with {POINTS}, g as (select id, floor((9.0 - y) / 0.5)::int as "row", floor((x - 1.0) / 0.5)::int as col from pts) select *, "row" * 15 + col as cell, ("row" * 15 + col) // 15 as row_again from g where "row" between 0 and 13 and col between 0 and 14')
def _(s, d):
    i = flat(F.col("row"), F.col("col"), GRID.cols)
    return place(points(s, d), "x", "y", GRID).select("id", "row", "col", i.alias("cell"), unflat(i, GRID.cols)[0].alias("row_again"))


@q("x15_albers", """with p as (select c_custkey as id, radians(-120 + (c_custkey * 37) % 1009 / 100.0::double - -115) as dlon, radians(35 + (c_custkey * 61) % 997 / 100.0::double) as lat from customer),
 k as (select (sin(radians(34)) + sin(radians(43))) / 2 as n), c as (select n, cos(radians(34)) ** 2 + 2 * n * sin(radians(34)) as c from k)
 select id, round(6371007.0 * sqrt(c - 2 * n * sin(lat)) / n * sin(n * dlon), 3) as px, round(6371007.0 * sqrt(c - 2 * n * sin(radians(38))) / n - 6371007.0 * sqrt(c - 2 * n * sin(lat)) / n * cos(n * dlon), 3) as py from p, c""")
def _(s, d):
    x, y = albers(F.col("x") - 120, F.col("y") + 35, 34, 43, 38, -115)
    return points(s, d).select("id", F.round(x, 3).alias("px"), F.round(y, 3).alias("py"))


COVER = {1: "forest", 2: "water", 12: "shrub", 14: "grass"}


@q("x16_code_lookup", "select lat, lon, coalesce(case land_cover_class when 1 then 'forest' when 2 then 'water' when 12 then 'shrub' when 14 then 'grass' end, 'unknown') as kind, count(*) as n from land_cover group by all")
def _(s, d):
    return table(s, d, "land_cover").select("lat", "lon", S.lookup(F.col("land_cover_class"), COVER, "unknown").alias("kind")).groupBy("lat", "lon", "kind").agg(F.count(F.lit(1)).alias("n"))


@q("x18_x28_cyclic", "select label_id, round(sin(2 * pi() * dayofyear(target_date) / 365), 9) as s, round(cos(2 * pi() * dayofyear(target_date) / 365), 9) as c from labels_combined")
def _(s, d):
    a, b = cyclic(F.col("target_date"))
    return table(s, d, "labels_combined").select("label_id", F.round(a, 9).alias("s"), F.round(b, 9).alias("c"))


@q("x19_sample_key", "select label_id, strftime(target_date, '%Y-%m-%d') || '_' || \"row\" || '_' || col as k from labels_combined where target_date is not null and \"row\" is not null and col is not null")
def _(s, d):
    t = table(s, d, "labels_combined").dropna(subset=["target_date", "row", "col"])
    return t.select("label_id", F.concat_ws("_", F.date_format("target_date", "yyyy-MM-dd"), F.col("row").cast("string"), F.col("col").cast("string")).alias("k"))


@q("x20_coercion", "select event_id, try_cast(json_extract_string(props, '$.page') as double) as v, try_cast(event_type as double) as t from events")
def _(s, d):
    return table(s, d, "events").select("event_id", S.number(F.get_json_object("props", "$.page")).alias("v"), S.number(F.col("event_type")).alias("t"))


@q("x21_normalised_text", "select label_id, lower(trim(source_file)) as f from labels_combined")
def _(s, d):
    return table(s, d, "labels_combined").select("label_id", F.lower(F.trim("source_file")).alias("f"))


@q("x22_x23_sigmoid", "select vec_id, round(1 / (1 + exp(-embedding[1]::double)), 9) as p, least(greatest(coalesce(embedding[2]::double, 0), 0), 1) as c from embeddings")
def _(s, d):
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(s, d, "embeddings").select("vec_id", F.round(S.sigmoid(e(0)), 9).alias("p"), S.clipped(F.coalesce(e(1), F.lit(0.0)), 0.0, 1.0).alias("c"))


@q("x24_standardise", "with t as (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as s from orders where year(o_orderdate) < 2000) select o_orderkey, round((o_totalprice - m) / s, 6) as z from orders, t")
def _(s, d):
    from celldays.operators.features import scaled

    t = table(s, d, "orders").withColumn("z", F.col("o_totalprice"))
    return scaled(t, ["z"], F.year("o_orderdate") < 2000).select("o_orderkey", F.round("z", 6).alias("z"))


@q("x25_class_label", "select label_id, case when c like 'FIRE%' then 1 when c like 'NOFIRE%' then 0 end as want, coalesce(label = case when c like 'FIRE%' then 1 when c like 'NOFIRE%' then 0 end, false) as fits from (select label_id, label, regexp_replace(upper(type_class), '[^A-Z0-9]', '', 'g') as c from labels_combined)")
def _(s, d):
    c = F.regexp_replace(F.upper("type_class"), "[^A-Z0-9]", "")
    return table(s, d, "labels_combined").select("label_id", F.when(c.startswith("FIRE"), 1).when(c.startswith("NOFIRE"), 0).alias("want"), label_fits(c, F.col("label")).alias("fits"))


@q("x27_focal_loss", "with z as (select vec_id, embedding[1]::double * 4 as z, (label % 2)::double as y from embeddings), b as (select vec_id, 2 * y * ln(1 + exp(-z)) + (1 - y) * ln(1 + exp(z)) as bce from z) select vec_id, round((1 - exp(-bce)) ** 2 * bce, 9) as loss from b")
def _(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(focal_loss(F.col("embedding")[0].cast("double") * 4, (F.col("label") % 2).cast("double"), 2.0, 2.0), 9).alias("loss"))


@q("x29_grid_codes", "select p_partkey, p_size, case p_size when 19 then 20 when 13 then 19 when 12 then 13 when 11 then 12 when 10 then 11 when 9 then 10 else p_size end as code from part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", "p_size", convert_grid_codes(F.col("p_size")).alias("code"))


@q("x30_grass_curing", """with p as (select p_partkey, (['Spring','summer','FALL','winter','monsoon'])[(p_partkey % 5 + 1)::int] as season, (['AB','BC','BC','ON'])[(p_partkey % 4 + 1)::int] as province, (['southeast','other'])[(p_partkey % 2 + 1)::int] as sub from part)
 select p_partkey, case when province = 'AB' then case lower(season) when 'spring' then 75 when 'summer' then 40 when 'fall' then 60 when 'winter' then 100 end
  when province = 'BC' and sub = 'southeast' then case lower(season) when 'spring' then 100 when 'summer' then 90 when 'fall' then 90 when 'winter' then 100 end
  when province = 'BC' then case lower(season) when 'spring' then 100 when 'summer' then 60 when 'fall' then 85 when 'winter' then 100 end end as curing from p""")
def _(s, d):
    at = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("p_partkey") % len(xs) + 1).cast("int"))
    return table(s, d, "part").select("p_partkey", grass_curing(at(["Spring", "summer", "FALL", "winter", "monsoon"]), at(["AB", "BC", "BC", "ON"]), at(["southeast", "other"])).alias("curing"))


@q("x31_month_names", "with p as (select p_partkey, (['January','feb','03','12','Sept','x','13'])[(p_partkey % 7 + 1)::int] as m from part) select p_partkey, case m when 'January' then 1 when 'feb' then 2 when '03' then 3 when '12' then 12 when 'Sept' then 9 end as month from p")
def _(s, d):
    xs = ["January", "feb", "03", "12", "Sept", "x", "13"]
    return table(s, d, "part").select("p_partkey", S.month_number(F.element_at(F.array(*map(F.lit, xs)), (F.col("p_partkey") % 7 + 1).cast("int"))).alias("month"))


@q("x32_model_input", "select feat_id, [coalesce(case when not isnan(fwi) and not isinf(fwi) then fwi::double end, 0), coalesce(case when not isnan(aet) and not isinf(aet) then aet::double end, 0), round(sin(2 * pi() * dayofyear(target_date) / 365), 9), round(cos(2 * pi() * dayofyear(target_date) / 365), 9)] as x from features_train where target_date is not null")
def _(s, d):
    a, b = cyclic(F.col("target_date"))
    zero = lambda c: F.when(gone(c), 0.0).otherwise(F.col(c).cast("double"))
    return features(s, d).where("target_date is not null").select("feat_id", F.array(zero("fwi"), zero("aet"), F.round(a, 9), F.round(b, 9)).alias("x"))


@q("x33_sanitised_scores", "select (label % 2 > 0.5)::int as y, least(greatest(embedding[1]::double, 0), 1) as p from embeddings where embedding[1] is not null and label is not null")
def _(s, d):
    return sanitised(table(s, d, "embeddings").select((F.col("label") % 2).alias("y_true"), F.col("embedding")[0].alias("y_prob")))


@q("f01_f02_drop_null", 'select count(*) as n_any, count(*) filter (where "row" is not null and col is not null) as n_keys from (select * from labels_combined where label is not null and split is not null and type_class is not null and "row" is not null and col is not null) union all select count(*), count(*) from labels_combined where "row" is not null and col is not null')
def _(s, d):
    t = table(s, d, "labels_combined")
    n = F.count(F.lit(1))
    whole = t.dropna("any", subset=["label", "split", "type_class", "row", "col"]).agg(n.alias("n_any"), n.alias("n_keys"))
    return whole.union(t.dropna(subset=["row", "col"]).agg(n.alias("n_any"), n.alias("n_keys")))


@q("f03_bbox", f"with {POINTS} select id from pts where x between 2 and 6 and y between 1 and 7.5")
def _(s, d):
    return points(s, d).where(RL.in_box(F.col("x"), F.col("y"), (2, 1, 6, 7.5))).select("id")


@q("f04_type_filter", "select l_returnflag, l_linestatus, count(*) as n from lineitem where l_linestatus = 'F' and l_returnflag in ('A', 'R') group by all")
def _(s, d):
    return table(s, d, "lineitem").where((F.col("l_linestatus") == "F") & F.col("l_returnflag").isin("A", "R")).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@q("f05_group_completeness", "select ts::date as day, count(distinct event_type) as kinds from events group by 1 having count(distinct event_type) >= 5")
def _(s, d):
    return RL.complete_groups(table(s, d, "events"), [F.to_date("ts").alias("day")], "event_type", 5)


@q("f06_f11_missing_masks", "with f as (select feat_id, (aet is null or isnan(aet) or isinf(aet)) as a, (fwi is null or isnan(fwi) or isinf(fwi)) as b, (dc is null or isnan(dc) or isinf(dc)) as c from features_train) select feat_id, a or b or c as some_missing, a and b and c as all_missing, not a as finite_aet from f")
def _(s, d):
    cols = ["aet", "fwi", "dc"]
    return features(s, d).select("feat_id", any_missing(cols).alias("some_missing"), all_missing(cols).alias("all_missing"), (~gone("aet")).alias("finite_aet"))


@q("f07_membership", f'with {CELL_DAYS} select "row", col, day from cd where fire = 0 and day in (select day from cd where fire = 1 and temp > 30)')
def _(s, d):
    c = cell_days(s, d)
    hot = c.where("fire = 1 and temp > 30").select("day").distinct()
    return RL.with_and_without(c.where("fire = 0"), hot, ["day"])[0].select("row", "col", "day")


@q("f08_f09_date_slices", "select count(*) as n, count(*) filter (where o_orderdate::date between date '1997-03-01' and date '1997-06-30') as n_slice from orders where o_orderdate::date between date '1997-03-01' - 14 and date '1997-06-30'")
def _(s, d):
    day = F.to_date("o_orderdate")
    t = table(s, d, "orders").where(RL.with_prehistory(day, date(1997, 3, 1), date(1997, 6, 30), 14))
    return t.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(day >= F.lit("1997-03-01").cast("date"), 1)).alias("n_slice"))


@q("f10_complete_windows", 'select aoi_id, target_date, "row", col from features_train group by all having count(distinct window_id) = 4 and min(window_id) = 1 and max(window_id) = 4')
def _(s, d):
    return complete_keys(features(s, d), ["aoi_id", "target_date", "row", "col"])


@q("f12_f14_range_checks", "select count(*) filter (where label not in (0, 1)) as bad_labels, round(avg(label), 9) as coverage, min(\"row\") as min_row, max(\"row\") as max_row, count(*) filter (where split is null) as no_split from labels_combined")
def _(s, d):
    return table(s, d, "labels_combined").agg(F.count(F.when(~F.col("label").isin(0, 1), 1)).alias("bad_labels"), F.round(F.avg("label"), 9).alias("coverage"), F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.count(F.when(F.col("split").isNull(), 1)).alias("no_split"))


@q("f13_key_query", 'select feat_id from features_train where "row" = 89 and col = 40 and aoi_id = 5')
def _(s, d):
    return features(s, d).where((F.col("row") == 89) & (F.col("col") == 40) & (F.col("aoi_id") == 5)).select("feat_id")


@q("s14_split_of_name", "select label_id, case substr(ltrim(lower(split), chr(32) || chr(9)), 1, 2) when 'tr' then 'train' when 'va' then 'val' when 'te' then 'test' end as split from labels_combined")
def _(s, d):
    return table(s, d, "labels_combined").select("label_id", split_of("split").alias("split"))


QUERIES, SQL = q.queries, q.sql
