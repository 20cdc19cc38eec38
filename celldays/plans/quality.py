"""Queries of the general data problems: load profiles (p2) and filled values (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celldays.operators.filling import fill
from celldays.operators.profile import OTHER_COLUMNS, findings, profile_loads
from celldays.session import table

FEATURES = "precip wind_speed tmax tmin rh_max rh_min vpd solar_rad spec_humidity aet pdsi fm100 ffmc dmc dc isi bui fwi erc burn_idx ignition_prob_clim elevation slope aspect_sin aspect_cos".split()


def _profile(spark: SparkSession, d: str, others: list[str] | None = None) -> DataFrame:
    return profile_loads(table(spark, d, "features_train"), table(spark, d, "load_log"), table(spark, d, "feature_catalog"), others)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return findings(_profile(spark, d))


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    p = _profile(spark, d, OTHER_COLUMNS)
    return p.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in p.dtypes))


def _fill(spark: SparkSession, d: str) -> DataFrame:
    return fill(table(spark, d, "features_train"), table(spark, d, "feature_catalog"), ["aet", "fwi"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _fill(spark, d).select("feat_id", "column_name")


def p5_filled(spark: SparkSession, d: str) -> DataFrame:
    return _fill(spark, d).withColumn("filled", F.round("filled", 5))


def p5_methods(spark: SparkSession, d: str) -> DataFrame:
    return _fill(spark, d).groupBy("column_name", "method").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("max_distance"))


QUERIES = {f.__name__: f for f in (p2_found, p2_profile, p5_found, p5_filled, p5_methods)}

_LONG = " union all ".join(f"select load_id, '{c}' as column_name, {c}::double as v from features_train" for c in FEATURES)
_TEXT = " union all ".join(f"select load_id, '{c}' as column_name, {c}::varchar as v from features_train where load_id is not null" for c in ("aoi_id", "target_date", '"row"', "col", "window_id", "split", "source_file", "loaded_at", "sample_key")).replace("'\"row\"'", "'row'")


def _coarse(x: str) -> str:
    for a, b in (("[A-Z]", "A"), ("[a-z]", "a"), ("[0-9]", "9"), ("A+", "A"), ("a+", "a"), ("9+", "9")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


_HEAD = r"regexp_extract(try_cast(v as decimal(38, 6))::varchar, '^-?[0.]*(?:[0-9]\.?){0,3}')"
_FINE = f"case when gone then null when ok then {_HEAD} || regexp_replace(substr(try_cast(v as decimal(38, 6))::varchar, length({_HEAD}) + 1), '[0-9]', '9', 'g') when v < lo then '<' else '>' end"
def _good(c: str) -> str:
    return f"case when not isnan({c}) and not isinf({c}) and {c} >= (select valid_min from feature_catalog where feature = '{c}') and {c} <= (select valid_max from feature_catalog where feature = '{c}') then {c}::double end"


_KEY = "aoi_id, target_date, r, c"


def _beside(c: str) -> str:
    before, after = "rows between unbounded preceding and 1 preceding", "rows between 1 following and unbounded following"
    over = lambda f, v, rows: f"{f}({v} ignore nulls) over (partition by aoi_id, r, c order by day {rows})"
    day = f"case when {c} is not null then day end"
    return f"{over('last_value', c, before)} as p_{c}, day - {over('last_value', day, before)} as dp_{c}, {over('first_value', c, after)} as n_{c}, {over('first_value', day, after)} - day as dn_{c}"


def _one(c: str) -> str:
    line = f"p_{c} + (n_{c} - p_{c}) * dp_{c} / (dp_{c} + dn_{c})"
    steps = (("same_time", f"b.{c}", "0"), ("interpolated", line, f"least(dp_{c}, dn_{c})"), ("carried", f"case when dp_{c} <= 64 then p_{c} end", f"dp_{c}"), ("carried", f"case when dn_{c} <= 64 then n_{c} end", f"dn_{c}"), ("area_month", f"am_{c}", "null"), ("area", f"a_{c}", "null"), ("month", f"m_{c}", "null"), ("all", f"t_{c}", "null"))
    pick = lambda k: "case " + " ".join(f"when {s[1]} is not null then {s[k] if k else chr(39) + s[0] + chr(39)}" for s in steps)
    return f"select feat_id, '{c}' as column_name, {pick(1)} end as filled, {pick(0)} else 'none' end as method, ({pick(2)} end)::int as distance from j b where no_{c}"


_FILLED = f"""with f0 as (select feat_id, aoi_id, target_date, "row" as r, col as c, window_id, {_good('aet')} as aet, {_good('fwi')} as fwi, aoi_id is not null and target_date is not null and "row" is not null and col is not null as whole from features_train),
 sm as (select {_KEY}, list(distinct window_id) filter (where window_id between 1 and 4) as seen, min(window_id) filter (where window_id between 1 and 4) as own from f0 where whole group by all),
 sb as (select *, last_value(own ignore nulls) over b as pw, target_date - last_value(case when own is not null then target_date end ignore nulls) over b as dp, first_value(own ignore nulls) over a as nw, first_value(case when own is not null then target_date end ignore nulls) over a - target_date as dn
   from sm window b as (partition by aoi_id, r, c order by target_date rows between unbounded preceding and 1 preceding), a as (partition by aoi_id, r, c order by target_date rows between 1 following and unbounded following)),
 wn as (select aoi_id, window_id, count(*) as n from f0 where window_id between 1 and 4 group by all),
 wa as (select aoi_id, arg_max(window_id, (n, -window_id)) as w from wn group by all),
 we as (select arg_max(window_id, (n, -window_id)) as w from (select window_id, sum(n) as n from wn group by all)),
 lost as (select *, case when whole then row_number() over (partition by {_KEY}, whole order by feat_id) end as k from f0 where (window_id is null or window_id < 1) and feat_id is not null),
 la as (select l.*, list_filter([1, 2, 3, 4], lambda x: not list_contains(coalesce(s.seen, []), x)) as absent, own, pw, dp, nw, dn, wa.w as aw, we.w as ew
   from lost l left join sb s using ({_KEY}) left join wa on wa.aoi_id = l.aoi_id cross join we),
 win as (select feat_id, case when whole and k <= len(absent) then absent[k] when own is not null then own when dp <= 64 then pw when dn <= 64 then nw when aw is not null then aw else ew end as w,
   case when whole and k <= len(absent) then 'absent' when coalesce(own, case when dp <= 64 then pw end, case when dn <= 64 then nw end) is not null then 'carry' when aw is not null then 'area' when ew is not null then 'all' else 'none' end as method,
   case when whole and k <= len(absent) or own is not null then 0 when dp <= 64 then dp when dn <= 64 then dn end::int as distance from la),
 rw as (select f0.*, case when window_id >= 1 then least(window_id, 4) end as w from f0),
 td as (select rw.* exclude (w), coalesce(rw.w, win.w) as w from rw left join win using (feat_id) where feat_id is not null and (aet is null or fwi is null)),
 t as (select *, aet is null as no_aet, fwi is null as no_fwi, (target_date - 16 * (coalesce(w, 1) - 1))::date as day from td),
 d0 as (select aoi_id, r, c, (target_date - 16 * (w - 1))::date as day, avg(aet) as aet, avg(fwi) as fwi from rw where whole and w is not null group by all
   union all by name select distinct aoi_id, r, c, day from t anti join (select distinct aoi_id, r, c, (target_date - 16 * (w - 1))::date as day from rw where whole and w is not null) o using (aoi_id, r, c, day) where whole),
 s as (select *, {_beside('aet')}, {_beside('fwi')} from d0),
 x as (select aoi_id, month(target_date - 16 * (coalesce(w, 1) - 1)) as m, aet, fwi from rw),
 am as (select aoi_id, m, avg(aet) as am_aet, avg(fwi) as am_fwi from x group by all), ar as (select aoi_id, avg(aet) as a_aet, avg(fwi) as a_fwi from x group by all),
 mm as (select m, avg(aet) as m_aet, avg(fwi) as m_fwi from x group by all), tt as (select avg(aet) as t_aet, avg(fwi) as t_fwi from x),
 j as (select t.feat_id, t.no_aet, t.no_fwi, s.* exclude (aoi_id, r, c, day), am_aet, am_fwi, a_aet, a_fwi, m_aet, m_fwi, t_aet, t_fwi from t left join s using (aoi_id, r, c, day)
   left join am on am.aoi_id is not distinct from t.aoi_id and am.m is not distinct from month(t.day) left join ar on ar.aoi_id is not distinct from t.aoi_id left join mm on mm.m is not distinct from month(t.day) cross join tt),
 filled as (select feat_id, 'window_id' as column_name, w::double as filled, method, distance from win union all {_one('aet')} union all {_one('fwi')})"""
SQL = {
    "p5_filled": _FILLED + " select feat_id, column_name, round(filled, 5) as filled, method, distance from filled",
    "p5_methods": _FILLED + " select column_name, method, count(*) as n, max(distance) as max_distance from filled group by all",
    "p2_profile": f"""
with long as ({_LONG}),
 v as (select l.load_id, l.column_name, case when isnan(l.v) then null else l.v end as v, c.valid_min as lo, (v is null or isnan(v)) as gone,
   coalesce(not isnan(v) and not isinf(v) and v >= c.valid_min and v <= c.valid_max, false) as ok
   from long l join feature_catalog c on c.feature = l.column_name where l.load_id is not null),
 nc as (select load_id, column_name, v, {_FINE} as mask, gone, ok, count(*) as n from v group by all),
 num as (select load_id, column_name, sum(n) as n_rows, sum(n) filter (where not gone) as n_values, coalesce(sum(n) filter (where ok), 0) as n_inside, max(n) filter (where ok) as n_mode, count(v) as distinct_values, min(v) as min_number, max(v) as max_number from nc group by all),
 qu as (select load_id, column_name, quantile_cont(v, 0.25) filter (where ok) as p25, quantile_cont(v, 0.5) filter (where ok) as p50, quantile_cont(v, 0.75) filter (where ok) as p75 from v group by all),
 text as ({_TEXT}),
 k as (select load_id, sample_key as v, sample_key is not distinct from (strftime(target_date, '%Y-%m-%d') || '_' || "row" || '_' || col) as usual,
   list_transform(string_split(sample_key, '_'), lambda x, i: case when i = 1 and x = strftime(target_date, '%Y-%m-%d') then 'D' when i = 2 and x = "row"::varchar then 'R' when i = 3 and x = col::varchar then 'C' else {_coarse('x')} end) as parts from features_train where load_id is not null),
 tx as (select load_id, column_name, count(*) as n_rows, count(v) as n_values, count(distinct v) as distinct_values, min(v) as min_value, max(v) as max_value from text group by all),
 bad as (select load_id, 'sample_key' as column_name, count(*) filter (where not usual) as n_bad from k group by all),
 m as (select load_id, column_name, mask, sum(n) as n from nc group by all
   union all select load_id, 'sample_key', case when v is not null then case when len(parts) = 3 then array_to_string(parts, '_') else {_coarse('v')} end end, count(*) from k group by all
   union all select load_id, column_name, {_coarse('v')}, count(*) from text where column_name <> 'sample_key' group by all),
 co as (select load_id, column_name, {_coarse('mask')} as mask, sum(n) as n from m where mask is not null group by all),
 cs as (select *, n / sum(n) over (partition by load_id, column_name) as share from co),
 pt as (select load_id, column_name, arg_max(mask, (n, mask)) as top_mask, coalesce(sum(share) filter (where share < 0.05), 0) as rare_mask_share from cs group by all),
 sh as (select load_id, column_name, coalesce(mask, 'null') as mask, n / sum(n) over (partition by load_id, column_name) as s from m),
 b as (select load_id, min(baseline_load_id) as baseline_load_id from load_log group by all),
 every as (select l.load_id, l.column_name, l.mask, l.s as p, 0.0 as q from sh l join b using (load_id) where baseline_load_id is not null
   union all select o.load_id, o.column_name, r.mask, 0.0, r.s from (select distinct load_id, column_name from sh) o join b on b.load_id = o.load_id join sh r on r.load_id = b.baseline_load_id and r.column_name = o.column_name),
 pq as (select load_id, column_name, mask, sum(p) as p, sum(q) as q from every group by all),
 dv as (select load_id, column_name, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end / 2 + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end / 2) as mask_divergence from pq group by all),
 a as (select load_id, column_name, n_rows, n_values, n_inside, n_mode, distinct_values, min_number, max_number, p25, p50, p75, null::varchar as min_value, null::varchar as max_value, null::bigint as n_bad from num join qu using (load_id, column_name)
   union all select load_id, column_name, n_rows, n_values, null, null, distinct_values, null, null, null, null, null, min_value, max_value, n_bad from tx left join bad using (load_id, column_name))
select load_id, column_name, baseline_load_id, n_rows::bigint as n_rows, round(1 - n_values / n_rows, 6) as missing_share, distinct_values, round(min_number, 6) as min_number, round(max_number, 6) as max_number, min_value, max_value,
 round(p25, 6) as p25, round(p50, 6) as p50, round(p75, 6) as p75, round((n_values - n_inside) / nullif(n_values, 0), 6) as outside_share, round(n_mode / nullif(n_inside, 0), 6) as mode_share, round(n_bad / n_rows, 6) as bad_share,
 top_mask, round(rare_mask_share, 6) as rare_mask_share, round(mask_divergence, 6) as mask_divergence, (n_rows - n_values)::bigint as n_missing
from a left join pt using (load_id, column_name) left join dv using (load_id, column_name) left join b using (load_id)
""",
    "p2_found": f"""
with long as ({_LONG}),
 v as (select l.load_id, l.column_name, l.v, (v is null or isnan(v)) as gone,
   coalesce(not isnan(v) and not isinf(v) and v >= c.valid_min and v <= c.valid_max, false) as ok
   from long l join feature_catalog c on c.feature = l.column_name where l.load_id is not null),
 m as (select load_id, column_name, max(n) as n_mode from (select load_id, column_name, v, count(*) as n from v where ok group by all) group by all),
 s as (select load_id, column_name, avg(gone::int) as missing, sum((not gone)::int) as n_values, sum(ok::int) as n_ok,
   quantile_cont(v, 0.25) filter (where ok) as p25, quantile_cont(v, 0.5) filter (where ok) as p50, quantile_cont(v, 0.75) filter (where ok) as p75 from v group by all),
 p as (select s.*, m.n_mode / nullif(s.n_ok, 0) as mode_share, g.baseline_load_id from s left join m using (load_id, column_name) left join load_log g using (load_id)),
 j as (select p.*, b.missing as b_missing, b.p25 as b25, b.p50 as b50, b.p75 as b75, b.mode_share as b_mode from p left join p b on b.load_id = p.baseline_load_id and b.column_name = p.column_name)
select load_id, column_name, 'missing' as finding from j where missing - b_missing > 0.10
union all select load_id, column_name, 'range' from j where (n_values - n_ok) / n_values > 0.02
union all select load_id, column_name, 'shift' from j where abs(p50 - b50) > 0.5 * (b75 - b25)
union all select load_id, column_name, 'constant' from j where mode_share - b_mode > 0.15
union all select load_id, 'sample_key', 'pattern' from features_train where load_id is not null group by load_id
 having avg((sample_key is distinct from (strftime(target_date, '%Y-%m-%d') || '_' || "row" || '_' || col))::int) > 0.02
""",
    "p5_found": """
with f as (select feat_id, window_id, aet::double as aet, fwi::double as fwi from features_train),
 c as (select feature, valid_min, valid_max from feature_catalog)
select feat_id, 'aet' as column_name from f, c where feature = 'aet' and (aet is null or isnan(aet) or isinf(aet) or aet < valid_min or aet > valid_max)
union all select feat_id, 'fwi' from f, c where feature = 'fwi' and (fwi is null or isnan(fwi) or isinf(fwi) or fwi < valid_min or fwi > valid_max)
union all select feat_id, 'window_id' from f where window_id is null or window_id < 1
""",
}
