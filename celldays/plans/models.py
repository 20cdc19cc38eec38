"""Queries of learned operators (m), nested cubes and column sniffing (s), sinks (k) and streams."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from celldays.operators import models as ML
from celldays.operators.features import wide
from celldays.operators.metrics import average_precision
from celldays.operators.quality import complete_keys, nulls_for_gaps
from celldays.plans.base import Registry, features, obs
from celldays.session import checkpoint_dir, cut, table
from celldays.sources import readers as RD
from celldays.sources import sinks as SK
from celldays.streaming.online import minute_counts, online_codes

q = Registry()
KEY = ["aoi_id", "target_date", "row", "col"]
COLS = [f"w{k}_{c}" for k in range(1, 5) for c in ("aet", "fwi", "ffmc", "pdsi")]


def samples(s, d):
    f = nulls_for_gaps(features(s, d).select(*KEY, "window_id", "aet", "fwi", "ffmc", "pdsi"), ["aet", "fwi", "ffmc", "pdsi"])
    y = table(s, d, "labels_combined").where("label is not null").groupBy(*KEY).agg(F.max("label").cast("double").alias("label"))
    x = wide(f.join(complete_keys(f, KEY), KEY, "left_semi"), KEY, ["aet", "fwi", "ffmc", "pdsi"])
    return x.join(y, KEY).na.fill(0.0, COLS)


_LAYERS = ML.fixed_layers([64, 6, 1])


def _layer_sql(src: list[str], i: int) -> list[str]:
    w, b = _LAYERS[i]
    return [f"({b[r]!r} + " + " + ".join(f"{src[c]} * {w[r][c]!r}" for c in range(len(src))) + ")" for r in range(len(w))]


_X = [f"embedding[{i}]::double" for i in range(1, 65)]
_HIDDEN = ", ".join(f"{e} as h{i}" for i, e in enumerate(_layer_sql(_X, 0)))
_GELU = ", ".join(f"0.5 * h{i} * (1 + tanh(0.7978845608028654 * (h{i} + 0.044715 * h{i} * h{i} * h{i}))) as g{i}" for i in range(6))


@q("m05_mlp_forward", f"with a as (select vec_id, {_HIDDEN} from embeddings), g as (select vec_id, {_GELU} from a) select vec_id, round(1 / (1 + exp(-{_layer_sql([f'g{i}' for i in range(6)], 1)[0]})), 8) as probability from g")
def _(s, d):
    x = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return ML.mlp(x, "x", _LAYERS).select("vec_id", F.round("probability", 8).alias("probability"))


@q("m04_stacked_trees")
def _(s, d):
    t = samples(s, d).withColumn("part", F.pmod(F.xxhash64(*KEY), F.lit(4)))
    top, models = ML.stacked(t.where("part > 0"), COLS)
    scored = ML.score(t.where("part = 0"), COLS, top, models)
    return average_precision(scored.select(F.col("label").cast("int").alias("y"), F.col("y_prob").alias("p")))


@q("m01_m06_perceptron")
def _(s, d):
    t = samples(s, d)
    model = ML.perceptron(t.where(F.pmod(F.xxhash64(*KEY), F.lit(4)) > 0), COLS)
    scored = model.transform(t.where(F.pmod(F.xxhash64(*KEY), F.lit(4)) == 0))
    return scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


@q("m08_permutation_importance")
def _(s, d):
    t = cut(samples(s, d))
    model = ML.perceptron(t, COLS)
    predict = lambda x: model.transform(x.na.fill(0.0, COLS)).withColumn("y_prob", vector_to_array("probability")[1])
    return ML.permutation_importance(t.withColumn("y", F.col("label").cast("int")), COLS, predict, "y", KEY)


@q("s04_s05_band_columns", "select user_id, (event_type || '_' || strftime(day, '%Y%m%d')) as band, event_type as suffix, day, v from (select user_id, event_type, ts::date as day, round(avg(value), 6) as v from events group by all) where event_type in ('view', 'click')")
def _(s, d):
    e = table(s, d, "events").where("event_type in ('view', 'click')").groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))
    named = e.withColumn("band", F.concat_ws("_", "event_type", F.date_format("day", "yyyyMMdd")))
    return RD.band_parts(named, "band").select("user_id", "band", "suffix", "day", "v")


@q("s07_aliases_and_first_step", "select o_custkey, coalesce(min_by(o_totalprice, o_orderkey), 0) as first_price from orders group by 1")
def _(s, d):
    t = RD.with_aliases(table(s, d, "orders").withColumnRenamed("o_totalprice", "price_v2"), {"price": ["price", "price_v2", "o_totalprice"]})
    return RD.first_level(t, ["o_custkey"], "o_orderkey").select("o_custkey", F.coalesce("price", F.lit(0.0)).alias("first_price"))


@q("s12_s13_label_reader", "select label_id, coalesce(nullif(lower(trim(split)), ''), 'all') as split, coalesce(type_class, '') as type_class, label::double as label from labels_combined where target_date is not null and \"row\" is not null and col is not null")
def _(s, d):
    return RD.label_samples(table(s, d, "labels_combined").select("label_id", "target_date", "row", "col", "split", "type_class", "label")).select("label_id", "split", "type_class", "label")


@q("s08_s11_csv_round_trip", "select n_nationkey, n_name, n_regionkey from nation where n_nationkey < 20")
def _(s, d):
    out = f"{checkpoint_dir(s)}/csv-{s.sparkContext.applicationId}"
    SK.to_csv(table(s, d, "nation"), out)
    return RD.read_csv(s, [out], {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}).where("n_nationkey < 20")


@q("s09_s10_projected_scan", "select l_returnflag, sum(l_quantity)::double as q from lineitem where l_shipdate < date '1997-01-01' group by 1")
def _(s, d):
    return RD.read_parquet(s, f"{d}/lineitem.parquet", ["l_returnflag", "l_quantity", "l_shipdate"], "l_shipdate < date'1997-01-01'").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("q"))


@q("s20_nested_cube", "select vec_id, (i // 16)::int as \"row\", (i // 4 % 4)::int as col, (i % 4)::int as channel, round(embedding[i + 1]::double, 6) as value from embeddings, range(0, 64) r(i)")
def _(s, d):
    cube = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.slice("embedding", r * 16 + c * 4 + 1, 4)))
    t = RD.flatten_cube(table(s, d, "embeddings").select("vec_id", cube.alias("feature_map")), ["vec_id"], "feature_map")
    return t.withColumn("value", F.round(F.col("value").cast("double"), 6))


@q("s26_synthetic_points")
def _(s, d):
    return RD.synthetic_points(s, 1000, 4)


@q("k01_k04_partitioned_sink", "select month(o_orderdate)::int as month, count(*) as n from orders where month(o_orderdate) in (3, 4) group by 1")
def _(s, d):
    out = f"{checkpoint_dir(s)}/months-{s.sparkContext.applicationId}"
    t = table(s, d, "orders").withColumn("month", F.month("o_orderdate"))
    SK.to_partitions(t.where("month in (3, 4)"), out, ["month"])
    SK.to_partitions(t.where("month = 4"), out, ["month"])  # a second run replaces its own month only
    return s.read.parquet(out).groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@q("k02_k03_compaction", "select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as price from orders group by 1")
def _(s, d):
    out = f"{checkpoint_dir(s)}/compact-{s.sparkContext.applicationId}"
    SK.once(table(s, d, "orders").repartition(24), out)
    SK.once(table(s, d, "orders").where("o_orderkey < 0"), out)  # the output exists, so nothing is written
    return SK.compacted(s, out, f"{out}-one").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))


@q("k10_pixel_export", "select vec_id, i::int as pixel, (label % 2)::int as y_true, round(embedding[i + 1]::double, 6) as prob from embeddings, range(0, 64) r(i)")
def _(s, d):
    t = table(s, d, "embeddings").select("vec_id", (F.col("label") % 2).cast("int").alias("y_true"), F.posexplode("embedding").alias("pixel", "prob"))
    return t.select("vec_id", "pixel", "y_true", F.round(F.col("prob").cast("double"), 6).alias("prob"))


@q("k09_json_report", "select 'events' as name, count(*) as n, min(ts)::date as first, max(ts)::date as last from events")
def _(s, d):
    r = table(s, d, "events").agg(F.lit("events").alias("name"), F.count(F.lit(1)).alias("n"), F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last"))
    out = f"{checkpoint_dir(s)}/report-{s.sparkContext.applicationId}"
    SK.to_json(r, out)
    return s.read.schema("name string, n bigint, first date, last date").json(out)


@q("st01_stream_windows", "select time_bucket(interval 1 day, ts)::timestamp as start, event_type, count(*) as n from events group by all")
def _(s, d):
    return minute_counts(s, f"{d}/events.parquet", checkpoint_dir(s), "1 day")


@q("st02_online_codes")
def _(s, d):
    o = obs(s, d).groupBy(F.concat_ws("_", "row", "col").alias("cell"), "day").agg(*(F.avg(c).alias(c) for c in ("temp", "rh", "wind", "precip")), F.lit(45.0).alias("lat"))
    return online_codes(s, o, checkpoint_dir(s))


QUERIES, SQL = q.queries, q.sql
