"""Queries of sorting, distinct, sampling (t) and set operations and validators (u)."""

from __future__ import annotations

from pyspark.sql import functions as F

from celldays.operators import relational as RL
from celldays.operators import sampling as SA
from celldays.operators.metrics import best_threshold, sweep
from celldays.operators.quality import keep_first, keys_in_both, validate_windows
from celldays.operators.splits import shared_days, without_conflicts
from celldays.plans.aggregates import METRICS, SCORES, scores
from celldays.plans.base import CELL_DAYS, Registry, cell_days, features, obs
from celldays.session import table

q = Registry()
KEY = ["aoi_id", "target_date", "row", "col"]
K = 'aoi_id, target_date, "row", col'
H = lambda keys, seed=42: f"md5(concat_ws('|', {keys}, '{seed}'))"


@q("t01_sorted_rank", "select c_custkey, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as place from customer")
def _(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(s, d, "customer").select("c_custkey", F.row_number().over(w).alias("place"))


@q("t02_keep_first", f"select {K}, label_id, type_class from (select *, row_number() over (partition by {K} order by label_id) as k from labels_combined) where k = 1")
def _(s, d):
    return keep_first(table(s, d, "labels_combined").select(*KEY, "label_id", "type_class"), KEY, ["label_id"])


@q("t03_keep_last", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def _(s, d):
    return keep_first(table(s, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], last=True).select("user_id", "event_id", "event_type")


@q("t04_top_k", "select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 20")
def _(s, d):
    return table(s, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)


@q("t05_t12_exact_sample", f"select label_id, source_file from (select *, row_number() over (partition by source_file order by {H('label_id')}, label_id) as k from labels_combined) where k <= 25")
def _(s, d):
    return SA.first_by_hash(table(s, d, "labels_combined").select("label_id", "source_file"), ["source_file"], 25, ["label_id"])


_U = "((('0x' || substr({h}, 1, 8))::bigint + 0.5) / 4294967296)"


@q("t05_with_replacement", f"""with o as (select event_id, row_number() over (order by {H('event_id')}, event_id) - 1 as place from events), n as (select count(*) as n from events),
 dr as (select i as draw, ('0x' || substr(md5(concat_ws('|', i, '42')), 1, 8))::bigint % (select n from n) as place from range(0, 500) r(i)) select draw, event_id from dr join o using (place)""")
def _(s, d):
    return SA.with_replacement(table(s, d, "events").select("event_id"), 500, ["event_id"]).select("draw", "event_id")


@q("t06_weighted_sample", f"select o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_orderpriority order by ln({_U.format(h=H('o_orderkey'))}) / case when month(o_orderdate) between 6 and 9 then 2.0 else 1.0 end desc, {H('o_orderkey')}, o_orderkey) as k from orders) where k <= 40")
def _(s, d):
    w = F.when(F.month("o_orderdate").between(6, 9), 2.0).otherwise(1.0)
    return SA.weighted_sample(table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate"), ["o_orderpriority"], 40, w, ["o_orderkey"]).select("o_orderkey", "o_orderpriority")


@q("t07_shuffle", f"select c_custkey, row_number() over (order by {H('c_custkey', 7)}, c_custkey) as place from customer")
def _(s, d):
    from pyspark.sql import Window

    # places are counted per hash range, so that the order is global without one task that sorts all
    h = table(s, d, "customer").select("c_custkey", SA.order_hash(["c_custkey"], 7).alias("h")).withColumn("r", F.substring("h", 1, 3))
    n = h.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    t = h.join(F.broadcast(n.select("r", before.alias("before"))), "r")
    return t.select("c_custkey", (F.col("before") + F.row_number().over(Window.partitionBy("r").orderBy("h", "c_custkey"))).alias("place"))


_QUOTA = """with w as (select * from (values ('0A', 1), ('0B', 1), ('0C', 2), ('0D', 1)) v(c, w)), n as (select count(*) // 7 as n from customer),
 e as (select c, n * w / 5.0 as exact, floor(n * w / 5.0)::bigint as low, n from w, n), r as (select *, row_number() over (order by exact - low desc, c) as k, n - sum(low) over () as rest from e)"""


@q("t08_quotas", _QUOTA + " select c as class_name, (low + (k <= rest)::int)::bigint as quota from r")
def _(s, d):
    n = table(s, d, "customer").count() // 7
    return s.createDataFrame(list(SA.quotas(n, {"0A": 1, "0B": 1, "0C": 2, "0D": 1}).items()), "class_name string, quota long")


@q("t09_redistribution", """with c as (select event_type, count(*) as n, row_number() over (order by event_type) as k from events group by 1), t as (select count(*) as m, greatest(1, sum(n) // 4)::bigint as w, sum(n)::bigint as s from c)
 select event_type as class_name, w as wanted, n as available, n as taken, (m * w - s) // m + (k <= (m * w - s) % m)::bigint as repeated from c, t""")
def _(s, d):
    have = {r[0]: r[1] for r in table(s, d, "events").groupBy("event_type").count().collect()}
    want = {k: max(1, sum(have.values()) // 4) for k in sorted(have)}
    take, again = SA.redistribute(want, have, sorted(have))
    return s.createDataFrame([(k, want[k], have[k], take[k], again[k]) for k in want], "class_name string, wanted long, available long, taken long, repeated long")


@q("t10_ratio_units", "select min(n // r) as units from (select pattern_type, count(*) as n from pattern_rows group by 1) join (values ('Fire-1', 1), ('Fire-5', 3), ('Fre-2', 2)) v(pattern_type, r) using (pattern_type)")
def _(s, d):
    have = {r[0]: r[1] for r in table(s, d, "pattern_rows").groupBy("pattern_type").count().collect()}
    return s.createDataFrame([(SA.ratio_units(have, {"Fire-1": 1, "Fire-5": 3, "Fre-2": 2}),)], "units long")


@q("t11_required_per_unit", "select * from (values ('FIRE1', 10::bigint), ('FIRE5', 15), ('FIRE2', 10), ('0A', 7), ('0B', 7), ('0C', 14), ('0D', 7)) v(class_name, n)")
def _(s, d):
    r = SA.required_per_unit({"fire": {"FIRE1": 2, "FIRE5": 3, "FIRE2": 2}, "nofire": {"0A": 1, "0B": 1, "0C": 2, "0D": 1}})
    return s.createDataFrame(list(r.items()), "class_name string, n long")


@q("t13_fire_first", f"select label_id from (select label_id, row_number() over (order by label desc nulls last, label_id) as k from labels_combined) where k <= 300")
def _(s, d):
    return RL.marked_first(table(s, d, "labels_combined"), "label", "label_id", 300).select("label_id")


_SWEEP = f"""with {SCORES}, g as (select i, i / 100 as threshold from range(0, 101) r(i)), b as (select floor(p * 100 + 1e-9)::int as bin, y from sc),
 c as (select threshold, count(*) filter (where y = 1 and bin >= i) as tp, count(*) filter (where y = 0 and bin >= i) as fp, count(*) filter (where y = 0 and bin < i) as tn, count(*) filter (where y = 1 and bin < i) as fn from g, b group by all)"""
NUM = ("precision", "recall", "f1", "iou", "specificity", "accuracy")


@q("t14_best_threshold", f"{_SWEEP}, m as (select threshold, {METRICS} from c) select * from m order by f1 desc, recall desc, precision desc, threshold limit 1")
def _(s, d):
    return best_threshold(sweep(scores(s, d))).withColumns({c: F.round(c, 9) for c in NUM})


@q("c16_threshold_sweep", f"{_SWEEP} select threshold, {METRICS} from c")
def _(s, d):
    return sweep(scores(s, d)).withColumns({c: F.round(c, 9) for c in NUM})


@q("u01_u02_unions", f"select 'all' as part, count(*) as n from (select {K} from labels_combined union all select {K} from features_train) union all select 'distinct', count(*) from (select {K} from labels_combined union select {K} from features_train)")
def _(s, d):
    a, b = table(s, d, "labels_combined").select(*KEY), features(s, d).select(*KEY)
    n = lambda t, p: t.agg(F.lit(p).alias("part"), F.count(F.lit(1)).alias("n"))
    return n(RL.united([a, b], KEY), "all").union(n(RL.united([a, b], KEY, True), "distinct"))


@q("u03_set_operations", f"select 'both' as part, count(*) as n from (select {K} from labels_combined intersect select {K} from features_train) union all select 'left', count(*) from (select {K} from labels_combined except select {K} from features_train)")
def _(s, d):
    a, b = table(s, d, "labels_combined"), features(s, d)
    n = lambda t, p: t.agg(F.lit(p).alias("part"), F.count(F.lit(1)).alias("n"))
    return n(keys_in_both(a, b, KEY), "both").union(n(a.select(*KEY).subtract(b.select(*KEY)), "left"))


@q("u04_shared_days", "select target_date, count(distinct source_file) as splits from labels_combined where source_file is not null group by 1 having count(distinct source_file) > 1")
def _(s, d):
    return shared_days(table(s, d, "labels_combined").withColumn("split", F.col("source_file")), "target_date")


@q("u05_conflict_removal", f"select {K}, min(type_class) as type_class, min(label) as label from labels_combined group by all having count(distinct label) <= 1 and count(distinct type_class) <= 1")
def _(s, d):
    return without_conflicts(table(s, d, "labels_combined"), KEY, "label", "type_class")


@q("u06_window_report", f"""with p as (select {K}, count(*) as n, count(distinct window_id) as k, count(*) filter (where not coalesce(window_id between 1 and 4, false)) as bad from features_train group by all)
 select sum(n)::bigint as n_rows, count(*) as n_samples, sum(n - k)::bigint as n_repeated, sum(bad)::bigint as n_bad_windows, count(*) filter (where k <> 4) as n_incomplete, sum(n) = count(*) * 4 as whole from p""")
def _(s, d):
    return validate_windows(features(s, d), KEY)


@q("u08_split_attached", "select 'train' as split, coalesce(lower(trim(split)) <> 'train', false) as clash, count(*) as n from labels_combined group by all")
def _(s, d):
    return RL.with_split(table(s, d, "labels_combined"), "train").groupBy("split", "clash").agg(F.count(F.lit(1)).alias("n"))


@q("u09_cube_agreement", f"""with {CELL_DAYS}, a as (select "row", col, day, count(*) as a from obs group by all), b as (select "row", col, day, count(*) as b from cd where wind > 5 group by all)
 select count(*) filter (where a is not null and b is not null) as both, count(*) filter (where b is null) as left_only, count(*) filter (where a is null) as right_only, count(*) filter (where a > 1 or b > 1) as repeated from a full join b using ("row", col, day)""")
def _(s, d):
    return RL.agreement(obs(s, d), cell_days(s, d).where("wind > 5"), ["row", "col", "day"])


QUERIES, SQL = q.queries, q.sql
