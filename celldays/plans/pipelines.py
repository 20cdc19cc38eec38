"""Queries of the composite jobs (c)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from celldays.functions.reading import split_of
from celldays.operators import forecast as FC
from celldays.operators.features import scaled, xy
from celldays.operators.patterns import balanced_negatives, history_patterns, negatives
from celldays.operators.quality import clean, complete_keys, nulls_for_gaps
from celldays.operators.relational import shared_places
from celldays.operators.sampling import ratio_units, required_per_unit, weighted_sample
from celldays.operators.splits import assign_summers, choose_val_years, ratio_splits
from celldays.plans.base import Registry, cell_days, features
from celldays.plans.sampling import H, K, KEY, _U
from celldays.plans.windows import CUBE, CURRENT, PATTERN, TRAIL, cube, current, trailing
from celldays.session import cut, table

q = Registry()


@q("c01_fire_history_patterns", f'with {CUBE}, {TRAIL(2)} select "row", col, day, w1, w2, w3, w4, {PATTERN} as pattern_type from tr where fire = 1 and w1 + w2 + w3 + w4 is not null')
def _(s, d):
    return history_patterns(cube(s, d), 16, 2).select("row", "col", "day", "w1", "w2", "w3", "w4", "pattern_type")


_NEG = f"""with {CUBE}, {TRAIL(1)}, z as (select day, "row", col, greatest(w1, w2, w3, w4) as history from tr where fire = 0 and w1 + w2 + w3 + w4 is not null),
 f as (select day, "row" as er, col as ec from cd where fire = 1), dm as (select z.day, z."row", z.col, any_value(history) as history, sqrt(min((z."row" - er) ** 2 + (z.col - ec) ** 2)::double) as distance from z join f using (day) group by all),
 ng as (select day, "row", col, distance, case when distance > 10 then '0D' when distance > 1 and distance <= 5 then case when history = 0 then '0A' else '0B' end when distance > 5 and history = 1 then '0C' end as class_name from dm)"""


def negative_rows(s, d):
    t = trailing(cube(s, d), "fire", ["row", "col"], "day", 16).where("w1 + w2 + w3 + w4 is not null")
    z = t.where("fire = 0").select("day", "row", "col", F.greatest("w1", "w2", "w3", "w4").alias("history"))
    return negatives(z, cell_days(s, d).where("fire = 1").select("day", "row", "col"))


@q("c02_negative_classes", _NEG + ' select day, "row", col, round(distance, 9) as distance, round(distance * 4, 9) as distance_km, class_name from ng where class_name is not null')
def _(s, d):
    n = negative_rows(s, d)
    return n.select("day", "row", "col", F.round("distance", 9).alias("distance"), F.round("distance_km", 9).alias("distance_km"), "class_name")


@q("c03_balanced_negatives")
def _(s, d):
    n = cut(negative_rows(s, d).withColumn("month", F.month("day")))
    fires = cell_days(s, d).where("fire = 1").groupBy(F.month("day").alias("month")).count().collect()
    return balanced_negatives(n, {(r["month"],): r["count"] for r in fires}, ["month"], ["day", "row", "col"]).select("month", "day", "row", "col", "class_name")


RANGES = {"train": (date(2012, 1, 1), date(2019, 12, 31)), "val": (date(2020, 1, 1), date(2021, 12, 31)), "test": (date(2022, 1, 1), date(2024, 12, 31))}
_CASE = "case when target_date between date '2012-01-01' and date '2019-12-31' then 'train' when target_date between date '2020-01-01' and date '2021-12-31' then 'val' when target_date between date '2022-01-01' and date '2024-12-31' then 'test' end"


def pattern_table(s, d):
    """One row per key and class of the pattern table."""
    return table(s, d, "pattern_rows").where("pattern_type in ('Fire-1', 'Fire-5', 'Fre-2')").dropna(subset=KEY).groupBy(*KEY).agg(F.min("pattern_type").alias("pattern_type"))


@q("c04_ratio_splits", f"""with p as (select {K}, min(pattern_type) as pattern_type from pattern_rows where pattern_type in ('Fire-1', 'Fire-5', 'Fre-2') and aoi_id is not null and target_date is not null and "row" is not null and col is not null group by all),
 s as (select *, {_CASE} as split, case pattern_type when 'Fire-1' then 1 when 'Fire-5' then 3 else 2 end as r from p where {_CASE} is not null), n as (select split, pattern_type, any_value(r) as r, count(*) as n from s group by 1, 2),
 u as (select split, case when count(*) = 3 then min(n // r) else 0 end as k from n group by 1), o as (select s.*, row_number() over (partition by s.split, pattern_type order by {H(K)}, {K}) as place, u.k from s join u using (split))
 select split, pattern_type, {K} from o where place <= r * k""")
def _(s, d):
    return ratio_splits(pattern_table(s, d), "target_date", "pattern_type", KEY, {"Fire-1": 1, "Fire-5": 3, "Fre-2": 2}, RANGES).select("split", "pattern_type", *KEY)


@q("c04_disjoint_days", """with r as (select target_date, case substr(ltrim(lower(split), chr(32) || chr(9)), 1, 2) when 'tr' then 'train' when 'va' then 'val' when 'te' then 'test' end as split from labels_combined)
 select target_date, count(distinct split) as parts from r where split is not null group by 1 having count(distinct split) > 1""")
def _(s, d):
    return shared_places(table(s, d, "labels_combined").select("target_date", split_of("split").alias("split")), "target_date", "split")


def _summer(y):
    return f"date '{y}-06-01'", f"date '{y}-09-30'"


_TOUCH = " or ".join(f"(target_date >= {_summer(y)[0]} and target_date - 64 <= {_summer(y)[1]})" for y in (2020, 2021, 2022))
_IN = lambda y: f"target_date between {_summer(y)[0]} and {_summer(y)[1]}"


@q("c05_summer_guard", f"select case when {_IN(2022)} then 'test' when {_IN(2020)} or {_IN(2021)} then 'val' when {_TOUCH} then null when target_date is not null then 'train' end as split, count(*) as n, min(target_date) as first, max(target_date) as last from labels_combined group by 1")
def _(s, d):
    t = assign_summers(table(s, d, "labels_combined"), "target_date", [2020, 2021], 2022)
    return t.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("target_date").alias("first"), F.max("target_date").alias("last"))


@q("c05_val_years", "with y as (select year(target_date)::int as y, count(*) as n from labels_combined where month(target_date) between 6 and 9 group by 1), c as (select *, sum(n) over (order by y desc) as run, row_number() over (order by y desc) as k from y where y < 2022), b as (select k from c order by abs(run / (select sum(n) from y) - 0.15), k limit 1) select y as val_year from c where k <= (select k from b)")
def _(s, d):
    y = table(s, d, "labels_combined").where("month(target_date) between 6 and 9").groupBy(F.year("target_date")).count().collect()
    years = choose_val_years({r[0]: r[1] for r in y if r[0] is not None}, 2022, 0.15)
    return s.createDataFrame([(v,) for v in years], "val_year int")


@q("c06_rebalanced", f"""with r as (select label_id, case substr(ltrim(lower(split), chr(32) || chr(9)), 1, 2) when 'tr' then 'train' when 'va' then 'val' when 'te' then 'test' end as split, regexp_replace(upper(type_class), '[^A-Z0-9]', '', 'g') as c, target_date from labels_combined where target_date is not null),
 w as (select * from (values ('FIRETYPE1', 10), ('FIRETYPE5', 15), ('FIRETYPE2', 10), ('NOFIRE0A', 7), ('NOFIRE0B', 7), ('NOFIRE0C', 14), ('NOFIRE0D', 7)) v(c, w)),
 u as (select split, case when count(*) = 7 then min(n // w) else 0 end as k from (select split, c, count(*) as n from r where split is not null group by all) join w using (c) group by 1),
 k as (select split, coalesce(k, 0) as k from (select distinct split from r where split is not null) left join u using (split)),
 o as (select label_id, split, c, w, row_number() over (partition by split, c order by ln({_U.format(h=H('label_id'))}) / case when split = 'train' and month(target_date) between 6 and 9 then 2.0 else 1.0 end desc, {H('label_id')}, label_id) as place from r join w using (c) where split is not null)
 select split, label_id, c as class_name from r join k using (split) where k = 0 union all select split, label_id, c from o join k using (split) where k > 0 and place <= w * k""")
def _(s, d):
    unit = required_per_unit({"fire": {"FIRETYPE1": 2, "FIRETYPE5": 3, "FIRETYPE2": 2}, "nofire": {"NOFIRE0A": 1, "NOFIRE0B": 1, "NOFIRE0C": 2, "NOFIRE0D": 1}})
    r = table(s, d, "labels_combined").where("target_date is not null").select("label_id", split_of("split").alias("split"), F.regexp_replace(F.upper("type_class"), "[^A-Z0-9]", "").alias("class_name"), "target_date").where("split is not null")
    have: dict[str, dict[str, int]] = {}
    for x in r.groupBy("split", "class_name").count().collect():
        have.setdefault(x["split"], {})[x["class_name"]] = x["count"]
    k = {split: ratio_units(counts, unit) for split, counts in have.items()}
    # a split that lacks a class keeps its rows unbalanced
    out = r.where(F.col("split").isin([split for split, n in k.items() if not n]))
    take = {(split, c): w * n for split, n in k.items() if n for c, w in unit.items()}
    if take:
        n = F.coalesce(*(F.when((F.col("split") == split) & (F.col("class_name") == c), F.lit(m)) for (split, c), m in take.items()))
        weight = F.when((F.col("split") == "train") & F.month("target_date").between(6, 9), 2.0).otherwise(1.0)  # summers count in train only
        balanced = weighted_sample(r.withColumn("_n", n).where("_n is not null"), ["split", "class_name"], F.col("_n"), weight, ["label_id"])
        out = out.unionByName(balanced.drop("_n"))
    return out.select("split", "label_id", "class_name")


_G = lambda c: f"({c} is null or isnan({c}) or isinf({c}))"


@q("c07_cleaning", f"""with ft as (select feat_id, {K}, case when aet between 0 and 250 then aet end as aet, case when fwi between 0 and 150 then fwi end as fwi, case when dc between 0 and 1500 then dc end as dc from features_train), b as (select distinct {K} from ft where {_G('aet')} and {_G('fwi')} and {_G('dc')}), k as (select * from ft f where not exists (select 1 from b where b.aoi_id = f.aoi_id and b.target_date = f.target_date and b."row" = f."row" and b.col = f.col)),
 m as (select avg(aet::double) filter (where not {_G('aet')}) as a, avg(fwi::double) filter (where not {_G('fwi')}) as f, avg(dc::double) filter (where not {_G('dc')}) as c from k)
 select feat_id, round(case when {_G('aet')} then a else aet::double end, 5) as aet, round(case when {_G('fwi')} then f else fwi::double end, 5) as fwi, round(case when {_G('dc')} then c else dc::double end, 5) as dc from k, m""")
def _(s, d):
    cols = ["aet", "fwi", "dc"]
    limits = {"aet": 250, "fwi": 150, "dc": 1500}
    f = features(s, d).select("feat_id", *KEY, *(F.when(F.col(c).between(0, limits[c]), F.col(c)).alias(c) for c in cols))
    rows, _ = clean(f, cols, KEY)
    return rows.select("feat_id", *(F.round(c, 5).alias(c) for c in cols))


_WIDE = ", ".join(f"round(avg({c}::double) filter (where window_id = {k} and not {_G(c)}), 5) as w{k}_{c}" for k in range(1, 5) for c in ("aet", "fwi"))


@q("c11_model_table", f"""with c as (select {K} from features_train group by all having count(distinct window_id) = 4 and min(window_id) = 1 and max(window_id) = 4), x as (select {K}, {_WIDE} from features_train join c using ({K}) group by all), y as (select {K}, max(label) as label from labels_combined group by all)
 select * from x join y using ({K})""")
def _(s, d):
    f = nulls_for_gaps(features(s, d).select(*KEY, "window_id", "aet", "fwi"), ["aet", "fwi"])
    y = table(s, d, "labels_combined").groupBy(*KEY).agg(F.max("label").alias("label"))
    t = xy(f, y, KEY, ["aet", "fwi"])
    return t.select(*KEY, *(F.round(f"w{k}_{c}", 5).alias(f"w{k}_{c}") for k in range(1, 5) for c in ("aet", "fwi")), "label")


@q("c13_forecast", f'with {CURRENT} select aoi_id, "row", col, s::int as h, round(value + s * mu, 5) as projected, round(sigma * sqrt(s), 5) as sd from cur, range(1, 8) r(s)')
def _(s, d):
    p = FC.project(current(s, d), 7)
    return p.select("aoi_id", "row", "col", "h", F.round("projected", 5).alias("projected"), F.round(F.col("sigma") * F.sqrt(F.col("h").cast("double")), 5).alias("sd"))


@q("c14_shape_checks", f'select count(*) as samples, count(*) filter (where n <> 4) as wrong_windows, max(n) as most from (select {K}, count(distinct window_id) filter (where window_id between 1 and 4) as n from features_train group by all)')
def _(s, d):
    n = features(s, d).groupBy(*KEY).agg(F.count_distinct(F.when(F.col("window_id").between(1, 4), F.col("window_id"))).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("samples"), F.count(F.when(F.col("n") != 4, 1)).alias("wrong_windows"), F.max("n").alias("most"))


@q("c15_training_records", f"""with c as (select {K}, avg(fwi::double) filter (where not {_G('fwi')}) as fwi from features_train where target_date is not null group by all)
 select strftime(target_date, '%Y-%m-%d') || '_' || "row" || '_' || col as key, target_date - 7 as anchor_date, target_date, i::int as mc_id, [round(coalesce(fwi, 0), 5), round(sin(2 * pi() * dayofyear(target_date) / 365), 5)] as x, dayofyear(target_date)::int as doy from c, range(1, 4) r(i) where "row" is not null and col is not null""")
def _(s, d):
    f = nulls_for_gaps(features(s, d).where("target_date is not null"), ["fwi"]).groupBy(*KEY).agg(F.avg(F.col("fwi").cast("double")).alias("fwi")).dropna(subset=["row", "col"])
    key = F.concat_ws("_", F.date_format("target_date", "yyyy-MM-dd"), F.col("row").cast("string"), F.col("col").cast("string"))
    angle = 2 * F.pi() * F.dayofyear("target_date") / 365
    return f.select(key.alias("key"), F.date_sub("target_date", 7).alias("anchor_date"), "target_date", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("mc_id"), F.array(F.round(F.coalesce("fwi", F.lit(0.0)), 5), F.round(F.sin(angle), 5)).alias("x"), F.dayofyear("target_date").alias("doy"))


@q("c12_scaled_points", f"""with f as (select feat_id, case when not {_G('fwi')} then fwi::double end as v, split from features_train), t as (select avg(v) as m, stddev_pop(v) as sd from f where lower(split) like 'tr%') select feat_id, round(coalesce((v - m) / sd, 0), 5) as fwi from f, t""")
def _(s, d):
    f = nulls_for_gaps(features(s, d).select("feat_id", "fwi", "split"), ["fwi"])
    return scaled(f, ["fwi"], F.lower("split").startswith("tr")).select("feat_id", F.round("fwi", 5).alias("fwi"))


@q("c02_class_shares", _NEG + " select class_name, count(*) as n from ng where class_name is not null group by 1")
def _(s, d):
    return negative_rows(s, d).groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))


@q("f10_semi_join_rows", f"select feat_id from features_train join (select {K} from features_train group by all having count(distinct window_id) = 4 and min(window_id) = 1 and max(window_id) = 4) using ({K})")
def _(s, d):
    f = features(s, d)
    return f.join(complete_keys(f, KEY), KEY, "left_semi").select("feat_id")


QUERIES, SQL = q.queries, q.sql
