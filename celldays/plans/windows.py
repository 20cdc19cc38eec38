"""Queries of ordered, windowed and stencil operators (w)."""

from __future__ import annotations

from pyspark.sql import functions as F

from celldays.operators import forecast as FC
from celldays.operators import relational as RL
from celldays.operators import spatial as SP
from celldays.operators.quality import repeated
from celldays.operators.scan import hourly_codes, weather_codes
from celldays.operators.windows import forward_fill, history_tensor, pattern_class, trailing
from celldays.plans.aggregates import HISTORY, history
from celldays.plans.base import CELL_DAYS, OBS, Registry, features, obs
from celldays.session import table

q = Registry()
CUBE_CELLS = ["aoi_id", "row", "col"]


def cube(s, d):
    """Fire of every cell on every day of the observed period: the dense label cube."""
    from celldays.operators.grid import spine

    o = obs(s, d)
    first, last = o.agg(F.min("day"), F.max("day")).first()
    cells = o.select("row", "col").distinct()
    c = o.groupBy("row", "col", "day").agg(F.max("fire").alias("fire"))
    return spine(cells, str(first), str(last)).join(c, ["row", "col", "day"], "left").fillna(0, ["fire"])


CUBE = CELL_DAYS + """, b as (select min(day) as a, max(day) as z from cd), cells as (select distinct "row", col from cd),
 cube as (select c."row", c.col, t.day, coalesce(cd.fire, 0) as fire from cells c cross join (select unnest(generate_series(a, z, interval 1 day))::date as day from b) t left join cd using ("row", col, day))"""
_FRAME = lambda k, least: f"case when count(*) over w{k} = 16 then (sum(fire) over w{k} >= {least})::int end as w{k}"
_WINDOWS = ", ".join(f'w{k} as (partition by "row", col order by day range between interval {16 * k} days preceding and interval {16 * (k - 1) + 1} days preceding)' for k in range(1, 5))
TRAIL = lambda least: f"tr as (select \"row\", col, day, fire, {', '.join(_FRAME(k, least) for k in range(1, 5))} from cube window {_WINDOWS})"
PATTERN = "case when fire = 1 then case when w1 + w2 + w3 + w4 = 0 then 'Fire-1' when w1 + w2 + w3 + w4 = 4 then 'Fire-5' when w1 = 1 and w2 + w3 + w4 = 0 then 'Fre-2' end end"


@q("w1_trailing_windows", f'with {CUBE}, {TRAIL(1)} select "row", col, day, fire, w1, w2, w3, w4 from tr where w4 is not null')
def _(s, d):
    return trailing(cube(s, d), "fire", ["row", "col"], "day", 16).where("w4 is not null").select("row", "col", "day", "fire", "w1", "w2", "w3", "w4")


def patterns(s, d, least):
    t = trailing(cube(s, d), "fire", ["row", "col"], "day", 16, 4, least).where("w1 is not null and w2 is not null and w3 is not null and w4 is not null")
    return t.withColumn("pattern", pattern_class(F.col("fire"), [F.col(f"w{k}") for k in range(1, 5)]))


@q("w2_pattern_counts", f"with {CUBE}, {TRAIL(3)} select {PATTERN} as pattern, count(*) as n from tr where w1 + w2 + w3 + w4 is not null and fire = 1 group by 1")
def _(s, d):
    return patterns(s, d, 3).where("fire = 1").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@q("w3_weather_codes")
def _(s, d):
    return codes(s, d)


def codes(s, d):
    o = obs(s, d).select(F.concat_ws("_", "row", "col").alias("cell"), "day", (F.col("row") * 4 + 20.0).alias("lat"), "temp", "rh", "wind", "precip")
    return weather_codes(o)


@q("w4_hourly_codes")
def _(s, d):
    e = table(s, d, "events").select(F.col("user_id").cast("string").alias("cell"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), "value")
    v = F.pmod(F.col("value") * 7, F.lit(30.0))
    h = e.groupBy("cell", "ts").agg(F.avg("value").alias("value")).select("cell", "ts", v.alias("temp"), (v * 2 + 20).alias("rh"), (v / 2).alias("wind"), F.when(v > 25, v / 10).otherwise(0.0).alias("precip"), F.when(F.hour("ts") == 12, F.lit(80.0)).alias("start"))
    return hourly_codes(h)


_TERRAIN = f'{OBS}, z as (select "row", col, round(avg(temp), 6) as value from obs group by all)'


def terrain(s, d):
    return obs(s, d).groupBy("row", "col").agg(F.round(F.avg("temp"), 6).alias("value"))


@q("w5_gradient", f"""with {_TERRAIN}, n as (select *, lag(value) over r as pr, lead(value) over r as nr, lag(value) over c as pc, lead(value) over c as nc from z window r as (partition by col order by "row"), c as (partition by "row" order by col)),
 g as (select "row", col, coalesce((nr - pr) / 2, nr - value, value - pr) as gy, coalesce((nc - pc) / 2, nc - value, value - pc) as gx from n)
 select "row", col, round(gy, 6) as gy, round(gx, 6) as gx, round(degrees(atan(sqrt(gx * gx + gy * gy))), 5) as slope, round(mod(mod(degrees(atan2(-gx, gy)), 360) + 360, 360), 5) as aspect from g""")
def _(s, d):
    g = SP.slope_aspect(SP.gradient(terrain(s, d).withColumn("g", F.lit(0)), "value", ["g"]))
    return g.select("row", "col", F.round("gy", 6).alias("gy"), F.round("gx", 6).alias("gx"), F.round("slope", 5).alias("slope"), F.round("aspect", 5).alias("aspect"))


_HOLES = f"""{OBS}, h0 as (select month(day)::int as m, "row", col, round(avg(temp), 6) as v from obs group by all), h as (select m, "row", col, case when ("row" * 7 + col * 3 + m) % 5 > 1 then v end as value from h0)"""


def holes(s, d):
    """Monthly means with two cells in five taken out."""
    v = F.when((F.col("row") * 7 + F.col("col") * 3 + F.col("m")) % 5 > 1, F.round(F.avg("temp"), 6))
    return obs(s, d).withColumn("m", F.month("day")).groupBy("m", "row", "col").agg(v.alias("value"))


_NEAR = "from h a, range(-1, 2) x(dr), range(-1, 2) y(dc), h b where b.m = a.m and b.\"row\" = a.\"row\" + dr and b.col = a.col + dc and b.value is not null and a.value is null and (dr <> 0 or dc <> 0)"


@q("w6_focal_mean", f'with {_HOLES}, k as (select a.m, a."row", a.col, avg(b.value) as mean {_NEAR} group by all) select m, "row", col, round(coalesce(value, mean), 4) as value from h left join k using (m, "row", col)')
def _(s, d):
    return SP.focal_fill(holes(s, d), "value", ["m"]).select("m", "row", "col", F.round("value", 4).alias("value"))


_RANK = "case when dr = 0 and dc = -1 then 0 when dr = -1 and dc = 0 then 1 when dr = 0 and dc = 1 then 2 when dr = 1 and dc = 0 then 3 when dr = -1 and dc = -1 then 4 when dr = -1 and dc = 1 then 5 when dr = 1 and dc = -1 then 6 else 7 end"


@q("w7_nearest_round", f'with {_HOLES}, k as (select a.m, a."row", a.col, arg_min(b.value, {_RANK}) as near {_NEAR} group by all) select m, "row", col, coalesce(value, near) as value from h left join k using (m, "row", col)')
def _(s, d):
    return SP.propagate(holes(s, d), "value", ["m"], 1)


def _spread(first: str, rounds: int, value: str = "value") -> str:
    """Rounds of nearest propagation as a chain of tables p0 .. p<rounds>; more rounds than a table needs change nothing."""
    step = lambda i: f"""p{i} as materialized (select a.m, a."row", a.col, coalesce(a.value, k.near) as value from p{i - 1} a left join (
   select a.m, a."row", a.col, arg_min(b.value, {_RANK}) as near from p{i - 1} a cross join (select * from range(-1, 2) x(dr), range(-1, 2) y(dc) where dr <> 0 or dc <> 0) o
   join p{i - 1} b on b.m = a.m and b."row" = a."row" + dr and b.col = a.col + dc where a.value is null and b.value is not null group by all) k using (m, "row", col))"""  # noqa: E731
    return f"p0 as materialized ({first}), " + ", ".join(map(step, range(1, rounds + 1)))


@q("w7_nearest_propagation", f"""with {_HOLES}, {_spread('select m, "row", col, case when "row" % 4 = 0 then value end as value from h', 12)} select m, "row", col, value from p12""")
def _(s, d):
    return SP.propagate(holes(s, d).withColumn("value", F.when(F.col("row") % 4 == 0, F.col("value"))), "value", ["m"])


@q("w8_inverse_distance", f"""with {_HOLES}, k as (select a.m, a."row", a.col, sum(b.value / (dr * dr + dc * dc)) / sum(1.0 / (dr * dr + dc * dc)) as idw
 from h a, range(-3, 4) x(dr), range(-3, 4) y(dc), h b where b.m = a.m and b."row" = a."row" + dr and b.col = a.col + dc and b.value is not null and a.value is null and dr * dr + dc * dc between 1 and 9 group by all)
 select m, "row", col, round(coalesce(value, idw), 4) as value from h left join k using (m, "row", col)""")
def _(s, d):
    return SP.inverse_distance_fill(holes(s, d), "value", ["m"], 3).select("m", "row", "col", F.round("value", 4).alias("value"))


@q("w9_mean_fallback", f'with {_HOLES} select m, "row", col, round(coalesce(value, avg(value) over (partition by m), 0), 6) as value from h')
def _(s, d):
    return SP.mean_fill(holes(s, d), "value", ["m"]).select("m", "row", "col", F.round("value", 6).alias("value"))


def gaps(s, d):
    """Mean temperatures of ten columns on every day of the period, by line group: scattered holes, 211 days without any value, one group without."""
    o = obs(s, d)
    first, last = o.agg(F.min("day"), F.max("day")).first()
    days = (last - first).days + 1
    o = o.groupBy((F.col("n") % 3).alias("m"), F.datediff("day", F.lit(first)).alias("row"), "col").agg(F.avg("temp").alias("temp"))
    cells = s.range(3 * days * 10).select((F.col("id") % 3).cast("int").alias("m"), F.expr("id div 30").cast("int").alias("row"), (F.expr("id div 3") % 10).cast("int").alias("col"))
    known = (F.col("m") > 0) & ~F.col("row").between(1000, 1210) & ((F.col("row") * 7 + F.col("col") * 3) % 5 > 1)
    return cells.join(o, ["m", "row", "col"], "left").select("m", "row", "col", F.when(known, F.col("temp")).alias("value"))


_CHAIN = f"""with {OBS}, ends as (select min(day) as a, max(day) as z from obs), t0 as (select n % 3 as m, (day - a)::int as "row", col, avg(temp) as temp from obs, ends group by all),
 g as materialized (select c.m::int as m, r."row"::int as "row", k.col::int as col, case when c.m > 0 and r."row" not between 1000 and 1210 and (r."row" * 7 + k.col * 3) % 5 > 1 then temp end as value
   from range(0, 3) c(m) cross join (select unnest(range(0, (select (z - a)::int + 1 from ends))) as "row") r cross join range(0, 10) k(col) left join t0 on t0.m = c.m and t0."row" = r."row" and t0.col = k.col),
 k1 as materialized (select a.m, a."row", a.col, coalesce(any_value(a.value), avg(b.value)) as value from g a left join g b on b.m = a.m and b."row" between a."row" - 1 and a."row" + 1 and b.col between a.col - 1 and a.col + 1 and a.value is null and b.value is not null group by a.m, a."row", a.col),
 hole as (select * from k1 where value is null),
 idw as materialized (select a.m, a."row", a.col, sum(b.value / ((a."row" - b."row") ** 2 + (a.col - b.col) ** 2)) / sum(1.0 / ((a."row" - b."row") ** 2 + (a.col - b.col) ** 2)) as v
   from hole a join k1 b on b.m = a.m and b."row" between a."row" - 100 and a."row" + 100 and b.value is not null and (a."row" - b."row") ** 2 + (a.col - b.col) ** 2 <= 10000 group by all),
 {_spread('select m, "row", col, coalesce(value, v) as value from k1 left join idw using (m, "row", col)', 12)},
 e as (select m, "row", col, g.value as v0, k1.value as v1, p0.value as v2, p12.value as v3 from g join k1 using (m, "row", col) join p0 using (m, "row", col) join p12 using (m, "row", col)),
 f as (select m, coalesce(v3, avg(v3) over (partition by m), 0) as value, case when v0 is not null then 'observed' when v1 is not null then 'kernel' when v2 is not null then 'distance' when v3 is not null then 'nearest' else 'mean' end as stage from e)
select m, stage, count(*) as n, round(avg(value), 5) as mean from f group by all"""


@q("w10_imputation_chain", _CHAIN)
def _(s, d):
    t = SP.impute(gaps(s, d), "value", ["m"])
    return t.groupBy("m", "stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 5).alias("mean"))


@q("w11_pseudo_daily", f'with {HISTORY} select aoi_id, "row", col, i::int as i, round(value, 6) as value from h')
def _(s, d):
    return history(s, d).select("aoi_id", "row", "col", "i", F.round("value", 6).alias("value"))


@q("w12_differences", f'with {HISTORY} select aoi_id, "row", col, i::int as i, round(delta, 6) as delta from de')
def _(s, d):
    return FC.deltas(history(s, d), CUBE_CELLS).select(*CUBE_CELLS, "i", F.round("delta", 6).alias("delta"))


def current(s, d):
    """Newest value of each cell's history with its mean change and the pooled noise."""
    h = history(s, d)
    return FC.noise(h, CUBE_CELLS).join(h.where("i = 63").select(*CUBE_CELLS, F.coalesce("value", F.lit(0.0)).alias("value")), CUBE_CELLS)


CURRENT = HISTORY + """, sg as (select greatest(stddev_pop(delta), 1e-6) as sigma from de), mu as (select aoi_id, "row", col, avg(delta) as mu from de group by all),
 cur as materialized (select aoi_id, "row", col, coalesce(value, 0) as value, mu, (select sigma from sg) as sigma from (select * from h where i = 63) join mu using (aoi_id, "row", col))"""


@q("w13_recursion", f'with {CURRENT} select aoi_id, "row", col, s::int as h, round(value + s * mu, 6) as projected from cur, range(1, 8) r(s)')
def _(s, d):
    return FC.project(current(s, d), 7).select(*CUBE_CELLS, "h", F.round("projected", 6).alias("projected"))


@q("a18_closed_form_moments", f'with {CURRENT} select aoi_id, "row", col, round(value + 7 * mu, 6) as mc_mean, round(sigma * sqrt(7), 6) as mc_std from cur')
def _(s, d):
    c = FC.closed_form(current(s, d), 7)
    return c.select(*CUBE_CELLS, F.round("mc_mean", 6).alias("mc_mean"), F.round("mc_std", 6).alias("mc_std"))


@q("w14_random_walk")
def _(s, d):
    c = current(s, d).withColumns({"low": F.lit(0.0), "high": F.lit(150.0)})
    return FC.moments(FC.walk(c, CUBE_CELLS, 64, 7, "low", "high"), CUBE_CELLS)


@q("w15_paths")
def _(s, d):
    c = current(s, d)
    return FC.paths(c, CUBE_CELLS, 16, 7).groupBy("step").agg(F.avg("path").alias("mean"), F.stddev_pop("path").alias("sd"), F.count(F.lit(1)).alias("n"))


@q("w16_forward_fill", "with e as (select event_id, user_id, ts, case when event_type = 'click' then value end as v from events) select event_id, last_value(v ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as filled from e")
def _(s, d):
    e = table(s, d, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("o"), F.when(F.col("event_type") == "click", F.col("value")).alias("v"))
    return forward_fill(e, "v", ["user_id"], "o", "filled", F.to_date("o.ts")).select("event_id", "filled")


@q("w17_first_valid", "with f as (select user_id, min(ts) as first from events where event_type = 'click' group by 1) select event_id from events join f using (user_id) where ts >= first")
def _(s, d):
    return RL.from_first_valid(table(s, d, "events"), ["user_id"], "ts", F.col("event_type") == "click").select("event_id")


@q("w18_history_tensor", "with dly as (select user_id, ts::date as day, round(sum(value), 4) as v from events group by all), t as (select user_id, day, list(v) over (partition by user_id order by day rows between 14 preceding and current row) as history from dly) select user_id, day, history from t where len(history) = 15")
def _(s, d):
    dly = table(s, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("v"))
    return history_tensor(dly, ["user_id"], "day", "v", 15).select("user_id", "day", "history")


@q("w19_repeated_keys", 'select aoi_id, target_date, "row", col, window_id, count(*) as n from features_train group by all having count(*) > 1')
def _(s, d):
    return repeated(features(s, d), ["aoi_id", "target_date", "row", "col", "window_id"])


QUERIES, SQL = q.queries, q.sql
