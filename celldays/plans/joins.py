"""Queries of joins (j)."""

from __future__ import annotations

from pyspark.sql import functions as F

from celldays.functions.scalars import lookup
from celldays.operators.grid import Grid, expand_months, full_grid, spine
from celldays.operators import relational as RL
from celldays.operators.quality import keys_in_both
from celldays.operators.spatial import nearest_event_distance, nearest_within
from celldays.operators.windows import as_of, window_ids
from celldays.plans.base import CELL_DAYS, OBS, POINTS, STATIONS, Registry, cell_days, features, obs, points, stations
from celldays.session import table

q = Registry()
KEY = ["aoi_id", "target_date", "row", "col"]
K = 'aoi_id, target_date, "row", col'


@q("j01_surrogate_cell", f'with {OBS}, c as (select distinct "row", col from obs), i as (select *, "row" * 1000 + col as cell from c) select cell, count(*) as n from obs join i using ("row", col) group by 1')
def _(s, d):
    o = obs(s, d)
    return o.join(RL.surrogate_cells(o, 1000), ["row", "col"]).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@q("j02_full_outer_chain", f"""with {CELL_DAYS}, a as (select "row", col, day, temp from cd where temp > 30), b as (select "row", col, day, wind from cd where wind > 12), c as (select "row", col, day, rh from cd where rh > 60)
 select "row", col, day, round(temp, 6) as temp, round(wind, 6) as wind, round(rh, 6) as rh from a full join b using ("row", col, day) full join c using ("row", col, day)""")
def _(s, d):
    c = cell_days(s, d)
    parts = [c.where(f"{x} > {v}").select("row", "col", "day", F.round(x, 6).alias(x)) for x, v in (("temp", 30), ("wind", 12), ("rh", 60))]
    return RL.full_outer(parts, ["row", "col", "day"])


@q("j03_rounded_coordinates", f"with {POINTS}, {STATIONS}, s as (select round_even(x, 1) as rx, round_even(y, 1) as ry, min(station) as station from st group by all) select id, station from (select id, round_even(x, 1) as rx, round_even(y, 1) as ry from pts) left join s using (rx, ry)")
def _(s, d):
    return RL.on_rounded(points(s, d), stations(s, d), 1, "station").select("id", "station")


@q("j04_nearest_within", f"""with {POINTS}, {STATIONS}, c as (select id, station, st.x as sx, st.y as sy, sqrt((pts.x - st.x) ** 2 + (pts.y - st.y) ** 2) as dist from pts join st on abs(pts.x - st.x) <= 0.8 and abs(pts.y - st.y) <= 0.8),
 r as (select *, row_number() over (partition by id order by dist, sx, sy, station) as k from c where dist <= 0.8) select pts.id, station, round(dist, 9) as distance from pts left join r on r.id = pts.id and k = 1""")
def _(s, d):
    return nearest_within(points(s, d), stations(s, d), "x", "y", 0.8, ["station"]).select("id", "station", F.round("distance", 9).alias("distance"))


@q("j05_event_distance", f"""with {CELL_DAYS}, z as (select * from cd where fire = 0), f as (select day, "row" as er, col as ec from cd where fire = 1),
 m as (select z.day, z."row", z.col, sqrt(min((z."row" - er) ** 2 + (z.col - ec) ** 2)::double) as dist from z join f using (day) group by all)
 select z."row", z.col, z.day, round(dist, 9) as distance from z left join m using (day, "row", col)""")
def _(s, d):
    c = cell_days(s, d)
    z = c.where("fire = 0").select("day", "row", "col")
    return nearest_event_distance(z, c.where("fire = 1"), 10).select("row", "col", "day", F.round("distance", 9).alias("distance"))


@q("j06_j07_anti_semi", f"with bad as (select distinct {K} from features_train where window_id is null or window_id < 1) select 'kept' as part, count(*) as n from features_train f where not exists (select 1 from bad b where b.aoi_id = f.aoi_id and b.target_date = f.target_date and b.\"row\" = f.\"row\" and b.col = f.col) union all select 'bad', count(*) from features_train f where exists (select 1 from bad b where b.aoi_id = f.aoi_id and b.target_date = f.target_date and b.\"row\" = f.\"row\" and b.col = f.col)")
def _(s, d):
    f = features(s, d)
    bad, kept = RL.with_and_without(f, f.where("window_id is null or window_id < 1"), KEY)
    n = lambda t, p: t.agg(F.lit(p).alias("part"), F.count(F.lit(1)).alias("n"))
    return n(kept, "kept").union(n(bad, "bad"))


@q("j08_key_intersection", f"select count(*) as n from (select {K} from labels_combined intersect select {K} from features_train)")
def _(s, d):
    return keys_in_both(table(s, d, "labels_combined"), features(s, d), KEY).agg(F.count(F.lit(1)).alias("n"))


@q("j09_j10_validated_left", f"""with l as (select {K}, min(label_id) as label_id, max(label) as label from labels_combined where label is not null group by all), f as (select {K}, min(feat_id) as feat_id from features_train where window_id = 1 group by all)
 select l.label_id, l.label, f.feat_id as right_feat_id from l left join f using ({K})""")
def _(s, d):
    left = table(s, d, "labels_combined").where("label is not null").groupBy(*KEY).agg(F.min("label_id").alias("label_id"), F.max("label").alias("label"))
    right = features(s, d).where("window_id = 1").groupBy(*KEY).agg(F.min("feat_id").alias("label_id"))
    return RL.validated_left(left, right, KEY, "_feat").select("label_id", "label", F.col("label_id_feat").alias("right_feat_id"))


@q("j11_one_to_many", f"select f.feat_id, l.label_id from labels_combined l join features_train f using ({K}) where l.label = 1")
def _(s, d):
    y = table(s, d, "labels_combined").where("label = 1").select("label_id", *KEY)
    return features(s, d).select("feat_id", *KEY).join(y, KEY).select("feat_id", "label_id")


@q("j12_interval", f"""with {CELL_DAYS}, sa as (select "row", col, day as target_date from cd where fire = 1)
 select sa."row", sa.col, target_date, ((target_date - day - 1) // 16 + 1)::int as window_id, count(*) as n, round(avg(temp), 6) as temp from sa join cd on cd."row" = sa."row" and cd.col = sa.col and target_date - day between 1 and 64 group by all""")
def _(s, d):
    c = cell_days(s, d)
    sa = c.where("fire = 1").select("row", "col", F.col("day").alias("target_date"))
    w = window_ids(sa, c.select("row", "col", "day", "temp"), ["row", "col"], 16)
    return w.groupBy("row", "col", "target_date", "window_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("temp"), 6).alias("temp"))


@q("j13_axis_alignment", "select o_orderkey from orders where o_orderdate::date in (select distinct l_shipdate::date from lineitem)")
def _(s, d):
    axis = table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    return table(s, d, "orders").withColumn("day", F.to_date("o_orderdate")).join(axis, "day", "left_semi").select("o_orderkey")


@q("j14_month_climatology", f"with {OBS}, m as (select month(day) as month, round(avg(temp), 6) as clim from obs group by 1), days as (select unnest(generate_series(date '1996-01-01', date '1996-12-31', interval 1 day))::date as day) select day, month(day)::int as month, clim from days join m on m.month = month(day)")
def _(s, d):
    m = obs(s, d).groupBy(F.month("day").alias("month")).agg(F.round(F.avg("temp"), 6).alias("clim"))
    days = s.range(1).select(F.explode(F.sequence(F.lit("1996-01-01").cast("date"), F.lit("1996-12-31").cast("date"))).alias("day"))
    return expand_months(m, days).select("day", "month", "clim")


@q("j15_lookup", "select p_partkey, coalesce(case p_size % 5 when 1 then 'low' when 2 then 'mid' when 3 then 'high' end, 'none') as band, n_name from part join nation on n_nationkey = p_size % 25")
def _(s, d):
    p = table(s, d, "part").select("p_partkey", lookup(F.col("p_size") % 5, {1: "low", 2: "mid", 3: "high"}, "none").alias("band"), (F.col("p_size") % 25).alias("n_nationkey"))
    return p.join(table(s, d, "nation"), "n_nationkey").select("p_partkey", "band", "n_name")


@q("j16_as_of", "with e as (select event_id, user_id, ts, value from events where event_type <> 'purchase'), p as (select user_id, ts, max(value) as v from events where event_type = 'purchase' group by all), j as (select e.event_id, p.v, row_number() over (partition by e.event_id order by p.ts desc) as k from e left join p on p.user_id = e.user_id and p.ts <= e.ts) select event_id, v as last_value from j where k = 1")
def _(s, d):
    e = table(s, d, "events")
    p = e.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("pts")).agg(F.max("value").alias("last_value"))
    return as_of(e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), p, ["user_id"], "ts", "pts", "last_value").select("event_id", "last_value")


@q("j17_spine", f"""with {CELL_DAYS}, c as (select distinct "row", col from obs), days as (select unnest(generate_series(date '1996-05-01', date '1996-05-31', interval 1 day))::date as day)
 select c."row", c.col, days.day, round(temp, 6) as temp from c cross join days left join cd using ("row", col, day)""")
def _(s, d):
    c = cell_days(s, d)
    cells = obs(s, d).select("row", "col").distinct()
    return spine(cells, "1996-05-01", "1996-05-31").join(c.select("row", "col", "day", F.round("temp", 6).alias("temp")), ["row", "col", "day"], "left")


@q("j18_full_cells", 'with days as (select distinct ts::date as day from events) select day, (i // 15)::int as "row", (i % 15)::int as col from days cross join range(0, 210) r(i)')
def _(s, d):
    return full_grid(table(s, d, "events").select(F.to_date("ts").alias("day")).distinct(), Grid(0, 0, 1, 14, 15))


@q("j19_aligned_mask", "select a.day, a.n, b.v from (select ts::date as day, count(*) as n from events group by 1) a join (select o_orderdate::date as day, count(*) as v from orders group by 1) b on b.day = a.day - 9000 where a.n > 100")
def _(s, d):
    a = table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).where("n > 100")
    b = table(s, d, "orders").groupBy(F.date_add(F.to_date("o_orderdate"), 9000).alias("day")).agg(F.count(F.lit(1)).alias("v"))
    return a.join(b, "day")


QUERIES, SQL = q.queries, q.sql
