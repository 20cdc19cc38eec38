"""Queries of aggregations (a)."""

from __future__ import annotations

from pyspark.sql import functions as F

from celldays.operators import metrics as M
from celldays.operators.features import tensor_stats, wide
from celldays.operators.forecast import noise, window_means
from celldays.operators.grid import mean_per
from celldays.operators.quality import any_missing, missing_per_feature, missing_per_window, nulls_for_gaps, pairwise_shares, share_of_all
from celldays.operators.relational import masked_scores
from celldays.operators.splits import by_ranges, conflicts
from celldays.operators.windows import pseudo_daily, window_features, window_ids
from celldays.plans.base import CELL_DAYS, OBS, Registry, cell_days, features, obs
from celldays.plans.quality import FEATURES
from celldays.session import table

q = Registry()
KEY = ["aoi_id", "target_date", "row", "col"]
K = 'aoi_id, target_date, "row", col'


@q("a01_fire_year_frequency", f"""with {OBS}, y as (select count(distinct year(day)) as n from obs where fire = 1), g as (select "row", col, month(day)::int as month, count(distinct year(day)) as years from obs where fire = 1 group by all)
 select "row", col, month, round(years / n, 9) as ignition_prob from g, y""")
def _(s, d):
    o = obs(s, d).where("fire = 1")
    years = o.agg(F.count_distinct(F.year("day"))).first()[0]
    per = o.groupBy("row", "col", F.month("day").alias("month"), F.year("day").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("row", "col", "month").agg(F.round(F.count(F.lit(1)) / max(1, years), 9).alias("ignition_prob"))


@q("a02_mean_per_cell_day", f'with {OBS} select "row", col, day, round(avg(temp), 6) as value from obs group by all')
def _(s, d):
    return mean_per(obs(s, d), ["row", "col", "day"], "temp").withColumn("value", F.round("value", 6))


@q("a03_mean_per_cell", f'with {OBS} select "row", col, round(avg(temp), 6) as value from obs group by all')
def _(s, d):
    return mean_per(obs(s, d), ["row", "col"], "temp").withColumn("value", F.round("value", 6))


@q("a04_mean_per_cell_month", f'with {OBS} select "row", col, month(day)::int as month, round(avg(temp), 6) as value from obs group by all')
def _(s, d):
    return mean_per(obs(s, d).withColumn("month", F.month("day")), ["row", "col", "month"], "temp").withColumn("value", F.round("value", 6))


@q("a05_a06_window_counts", f"""with {CELL_DAYS} select "row", col, day, (coalesce(sum(fire) over w, 0) >= 3)::int as three, coalesce(max(fire) over w, 0) as some_fire from cd
 window w as (partition by "row", col order by day range between interval 16 days preceding and interval 1 day preceding)""")
def _(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("row", "col").orderBy(F.unix_date("day")).rangeBetween(-16, -1)
    z = lambda c: F.coalesce(c.over(w), F.lit(0))
    return cell_days(s, d).select("row", "col", "day", (z(F.sum("fire")) >= 3).cast("int").alias("three"), z(F.max("fire")).alias("some_fire"))


@q("a07_missing_per_feature", " union all ".join(f"select '{c}' as feature, count(*) filter (where {c} is null or isnan({c}) or isinf({c})) as n_missing, round(count(*) filter (where {c} is null or isnan({c}) or isinf({c})) / count(*), 9) as ratio from features_train" for c in FEATURES))
def _(s, d):
    return missing_per_feature(features(s, d), FEATURES).withColumn("ratio", F.round("ratio", 9))


_BAD = " or ".join(f"{c} is null or isnan({c}) or isinf({c})" for c in FEATURES)


@q("a08_missing_per_window", f"select window_id, count(*) as n_rows, count(*) filter (where {_BAD}) as n_any_missing from features_train group by 1")
def _(s, d):
    return missing_per_window(features(s, d), FEATURES)


@q("a09_distinct_keys", f"select count(distinct ({K})) as keys, count(distinct (aoi_id, \"row\", col)) as cells from features_train where aoi_id is not null and target_date is not null and \"row\" is not null and col is not null")
def _(s, d):
    f = features(s, d).dropna(subset=KEY).select(*KEY).distinct()
    return f.agg(F.count(F.lit(1)).alias("keys"), F.count_distinct("aoi_id", "row", "col").alias("cells"))


@q("a10_mean_imputation", f"with m as (select avg(fwi::double) filter (where fwi is not null and not isnan(fwi) and not isinf(fwi)) as m from features_train) select feat_id, round(case when fwi is null or isnan(fwi) or isinf(fwi) then m else fwi::double end, 6) as fwi from features_train, m")
def _(s, d):
    from celldays.operators.quality import mean_imputed

    return mean_imputed(features(s, d).select("feat_id", "fwi"), ["fwi"]).withColumn("fwi", F.round("fwi", 6))


@q("a11_split_class_table", """with r as (select source_file as f, label from labels_combined), t as (select f, count(*) filter (where label = 0) as "0", count(*) filter (where label = 1) as "1" from r group by 1)
 select f as source_file, "0", "1", "0" + "1" as total, round("0" * 100.0 / nullif("0" + "1", 0), 4) as "0_pct", round("1" * 100.0 / nullif("0" + "1", 0), 4) as "1_pct" from t""")
def _(s, d):
    t = table(s, d, "labels_combined").select("source_file", F.col("label").cast("string").alias("label"))
    return pairwise_shares(t, "source_file", "label", ["0", "1"])


@q("a11_value_counts", "select pattern_type, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as share from pattern_rows group by 1")
def _(s, d):
    return share_of_all(table(s, d, "pattern_rows"), ["pattern_type"]).withColumn("share", F.round("share", 9))


@q("a12_conflicts", f"select {K}, count(distinct label) as labels, count(distinct type_class) as kinds from labels_combined group by all having count(distinct label) > 1 or count(distinct type_class) > 1")
def _(s, d):
    return conflicts(table(s, d, "labels_combined"), KEY, "label", "type_class")


@q("a13_windows_per_key", f"select n, count(*) as samples from (select {K}, count(distinct window_id) as n from features_train group by all) group by 1")
def _(s, d):
    return features(s, d).groupBy(*KEY).agg(F.count_distinct("window_id").alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("samples"))


@q("a14_window_aggregates", f"""with {CELL_DAYS}, sa as (select "row", col, day as target_date from cd where fire = 1),
 j as (select sa."row", sa.col, target_date, ((target_date - day - 1) // 16 + 1)::int as window_id, day, temp, precip, wind, rh from sa join cd on cd."row" = sa."row" and cd.col = sa.col and target_date - day between 1 and 64)
 select "row", col, target_date, window_id, case when count(*) >= 3 then round(avg(temp) + 1e-9, 6) end as temp, case when count(*) >= 3 then round(sum(precip) + 1e-9, 6) end as precip, case when count(*) >= 3 then round(max(wind) + 1e-9, 6) end as wind,
  case when count(*) >= 3 then round(list_reduce(list(rh order by day), lambda a, x: 0.3 * x + (1 - 0.3) * a) + 1e-9, 6) end as rh from j group by all""")
def _(s, d):
    c = cell_days(s, d)
    sa = c.where("fire = 1").select("row", "col", F.col("day").alias("target_date"))
    keys = ["row", "col", "target_date"]
    w = window_features(window_ids(sa, c.drop("fire"), ["row", "col"], 16), keys, {"temp": "mean", "precip": "sum", "wind": "max", "rh": "ema"}, alpha=0.3, least=3)
    return w.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("temp", "precip", "wind", "rh")})  # exact halves round alike in every order of the sums


_W = ", ".join(f"avg({c}::double) filter (where window_id = {k} and {c} is not null and not isnan({c}) and not isinf({c})) as w{k}_{c}" for c in ("aet", "fwi") for k in range(1, 5))
_S = ", ".join(
    f"round((w1_{c} + w2_{c} + w3_{c} + w4_{c}) / 4, 4) as {c}_mean, round(least(w1_{c}, w2_{c}, w3_{c}, w4_{c}), 4) as {c}_min, round(greatest(w1_{c}, w2_{c}, w3_{c}, w4_{c}), 4) as {c}_max, round(w4_{c}, 4) as {c}_last, round(w4_{c} - w1_{c}, 4) as {c}_trend, round(w4_{c} - w3_{c}, 4) as {c}_recent_delta, round(w4_{c} - w3_{c} - (w3_{c} - w2_{c}), 4) as {c}_accel"
    for c in ("aet", "fwi")
)


@q("a15_a16_tensor_stats", f"with w as (select {K}, {_W} from features_train group by all) select {K}, {_S} from w where w1_aet + w2_aet + w3_aet + w4_aet + w1_fwi + w2_fwi + w3_fwi + w4_fwi is not null")
def _(s, d):
    f = nulls_for_gaps(features(s, d).select(*KEY, "window_id", "aet", "fwi"), ["aet", "fwi"])
    w = wide(f, KEY, ["aet", "fwi"]).dropna(subset=[f"w{k}_{c}" for k in range(1, 5) for c in ("aet", "fwi")])
    t = tensor_stats(w, KEY, ["aet", "fwi"]).drop("aet_std", "fwi_std")
    return t.select(*KEY, *(F.round(c, 4).alias(c) for c in t.columns if c not in KEY))


@q("a17_train_statistics", "select round(avg(fwi::double), 6) as mean, round(stddev_pop(fwi::double), 6) as sd from features_train where lower(split) like 'tr%' and fwi is not null and not isnan(fwi) and not isinf(fwi)")
def _(s, d):
    f = nulls_for_gaps(features(s, d), ["fwi"]).where(F.lower("split").startswith("tr"))
    v = F.col("fwi").cast("double")
    return f.agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("sd"))


def history(s, d):
    """The fwi windows of complete samples as pseudo-daily series of 64 days."""
    f = nulls_for_gaps(features(s, d).select("aoi_id", "row", "col", "window_id", "fwi"), ["fwi"]).where("window_id between 1 and 4")
    w = f.groupBy("aoi_id", "row", "col", "window_id").agg(F.avg(F.when(F.col("fwi").between(0, 150), F.col("fwi").cast("double"))).alias("value"))
    return pseudo_daily(w).withColumn("feature", F.lit("fwi"))


HISTORY = """hw as materialized (select aoi_id, "row", col, window_id, avg(fwi::double) filter (where fwi between 0 and 150) as value from features_train where window_id between 1 and 4 group by all),
 h as materialized (select aoi_id, "row", col, (4 - window_id) * 16 + i as i, 'fwi' as feature, value from hw, range(0, 16) r(i)),
 de as materialized (select * from (select *, coalesce(value, 0) - lag(coalesce(value, 0)) over (partition by aoi_id, "row", col order by i) as delta from h) where delta is not null)"""


@q("a19_history_noise", f'with {HISTORY}, sg as (select greatest(stddev_pop(delta), 1e-6) as sigma from de) select aoi_id, "row", col, feature, round(avg(delta), 6) as mu, round(any_value(sigma), 6) as sigma from de, sg group by all')
def _(s, d):
    n = noise(history(s, d), ["aoi_id", "row", "col"])
    return n.select("aoi_id", "row", "col", "feature", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


@q("a20_window_means", f'with {HISTORY} select aoi_id, "row", col, feature, (i // 16)::int as "window", round(avg(value), 6) as mean from h group by all')
def _(s, d):
    return window_means(history(s, d), ["aoi_id", "row", "col"]).withColumn("mean", F.round("mean", 6))


def scores(s, d):
    """Labels and scores of the vectors: a rounded sigmoid, so that ties occur."""
    return M.sanitised(table(s, d, "embeddings").select((F.col("label") % 2).alias("y_true"), F.round(1 / (1 + F.exp(-F.col("embedding")[0].cast("double") * 6)), 2).alias("y_prob")))


SCORES = "sc as (select (label % 2)::int as y, round(1 / (1 + exp(-embedding[1]::double * 6)), 2) as p from embeddings)"
_R = lambda a, b: f"coalesce(round({a} / nullif({b}, 0), 9), 0)"
METRICS = f"tp, fp, tn, fn, {_R('tp', '(tp + fp)')} as precision, {_R('tp', '(tp + fn)')} as recall, {_R('2 * tp', '(2 * tp + fp + fn)')} as f1, {_R('tp', '(tp + fp + fn)')} as iou, {_R('tn', '(tn + fp)')} as specificity, {_R('(tp + tn)', '(tp + fp + tn + fn)')} as accuracy"
ROUNDED = ("precision", "recall", "f1", "iou", "specificity", "accuracy")


@q("a21_confusion", f"with {SCORES}, c as (select count(*) filter (where y = 1 and p >= 0.5) as tp, count(*) filter (where y = 0 and p >= 0.5) as fp, count(*) filter (where y = 0 and p < 0.5) as tn, count(*) filter (where y = 1 and p < 0.5) as fn from sc) select {METRICS} from c")
def _(s, d):
    return M.confusion(scores(s, d)).withColumns({c: F.round(c, 9) for c in ROUNDED})


@q("a22_average_precision", f"""with {SCORES}, g as (select p, sum(y) as pos, count(*) as n from sc group by 1), c as (select *, sum(pos) over w as tp, sum(n) over w as k, sum(pos) over () as np, sum(n) over () as nn from g window w as (order by p desc))
 select max(np)::bigint as n_pos, (max(nn) - max(np))::bigint as n_neg, round(sum(pos / np * tp / k), 9) as average_precision from c""")
def _(s, d):
    return M.average_precision(scores(s, d)).withColumn("average_precision", F.round("average_precision", 9))


@q("a23_a24_channel_moments", "select i::int as channel, round(avg(embedding[i + 1]), 6) as mean, round(var_pop(embedding[i + 1]), 6) as variance, round(quantile_cont(embedding[i + 1]::double, 0.995), 6) as q995 from embeddings, range(0, 64) r(i) group by all")
def _(s, d):
    e = table(s, d, "embeddings").select(F.posexplode("embedding").alias("channel", "v")).withColumn("v", F.col("v").cast("double"))
    m = e.groupBy("channel").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.var_pop("v"), 6).alias("variance"))
    return m.join(M.quantile(e, "channel", "v", 0.995, "q995"), "channel", "left").withColumn("q995", F.round("q995", 6))


@q("a25_daily_means_and_snapshot", f'with {CELL_DAYS} select col, round(avg(temp) filter (where "row" = 0), 6) as r0, round(avg(temp) filter (where "row" = 1), 6) as r1, round(avg(temp) filter (where "row" = 2), 6) as r2 from cd where day between date \'1996-01-01\' and date \'1996-01-31\' group by 1')
def _(s, d):
    c = cell_days(s, d).where("day between date'1996-01-01' and date'1996-01-31'")
    p = c.groupBy("col").pivot("row", [0, 1, 2]).agg(F.avg("temp"))
    return p.select("col", *(F.round(F.col(str(k)), 6).alias(f"r{k}") for k in range(3)))


@q("a26_gap_diagnostics", "select target_date, count(*) as n_rows, count(*) filter (where aet is null or isnan(aet) or isinf(aet) or fwi is null or isnan(fwi) or isinf(fwi)) as n_gaps from features_train group by 1")
def _(s, d):
    return features(s, d).groupBy("target_date").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(any_missing(["aet", "fwi"]), 1)).alias("n_gaps"))


@q("a27_mean_absolute_effect", "select window_id, round(avg(abs(fwi::double)), 6) as fwi, round(avg(abs(pdsi::double)), 6) as pdsi from features_train where fwi is not null and pdsi is not null and not isnan(fwi) and not isnan(pdsi) and not isinf(fwi) and not isinf(pdsi) group by 1")
def _(s, d):
    f = nulls_for_gaps(features(s, d), ["fwi", "pdsi"]).dropna(subset=["fwi", "pdsi"])
    return f.groupBy("window_id").agg(*(F.round(F.avg(F.abs(F.col(c).cast("double"))), 6).alias(c) for c in ("fwi", "pdsi")))


@q("a28_masked_scores", "select vec_id, i::int as pixel, round(embedding[i + 1]::double, 6) as p from embeddings, range(0, 64) r(i) where embedding[i + 1] > 0")
def _(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding", F.transform("embedding", lambda v: v > 0).alias("mask"))
    return masked_scores(e, ["vec_id"], "embedding", "mask").withColumn("p", F.round(F.col("p").cast("double"), 6))


@q("a29_rows_per_range", "select case when o_orderdate::date between date '1995-01-01' and date '1997-12-31' then 'train' when o_orderdate::date between date '1998-01-01' and date '1999-06-30' then 'val' else 'test' end as split, count(*) as n from orders where o_orderdate::date between date '1995-01-01' and date '2000-12-31' group by 1")
def _(s, d):
    from datetime import date

    t = table(s, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    r = {"train": (date(1995, 1, 1), date(1997, 12, 31)), "val": (date(1998, 1, 1), date(1999, 6, 30)), "test": (date(1999, 7, 1), date(2000, 12, 31))}
    return by_ranges(t, "day", r).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


QUERIES, SQL = q.queries, q.sql
