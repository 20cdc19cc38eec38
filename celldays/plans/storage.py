"""Queries of further readers and writers (s, k), model storage and search (m), and small remaining operators."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import functions as F

from celldays.functions.reading import alnum_upper, split_of
from celldays.operators.grid import Grid, full_grid
from celldays.operators.relational import aspect_parts, head_sizes, key_tuples
from celldays.plans.base import Registry, features
from celldays.plans.models import COLS, samples
from celldays.session import checkpoint_dir, table
from celldays.sources import readers as RD
from celldays.sources import sinks as SK

q = Registry()


def folder(s, name):
    return f"{checkpoint_dir(s)}/{name}-{s.sparkContext.applicationId}"


_SPLIT = "case substr(ltrim(lower(split), chr(32) || chr(9)), 1, 2) when 'tr' then 'train' when 'va' then 'val' when 'te' then 'test' end"


@q("s15_six_way_labels", f"select split, kind, count(*) as n from (select {_SPLIT} as split, case when label = 1 then 'FIRE' when label = 0 then 'NOFIRE' end as kind from labels_combined) where split is not null and kind is not null group by all")
def _(s, d):
    rows = table(s, d, "labels_combined").select(split_of("split").alias("split"), F.when(F.col("label") == 1, "FIRE").when(F.col("label") == 0, "NOFIRE").alias("kind"))
    out = folder(s, "six")
    SK.to_partitions(rows.where("split is not null and kind is not null").withColumn("one", F.lit(1)), out, ["kind", "split"])
    parts = [s.read.parquet(f"{out}/kind={k}/split={p}").withColumns({"kind": F.lit(k), "split": F.lit(p)}) for k in ("FIRE", "NOFIRE") for p in ("train", "val", "test")]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("split", "kind").agg(F.count(F.lit(1)).alias("n"))


@q("s18_store_discovery", "select feature, count(*) as n from (select 'aet' as feature, aet as v from features_train union all select 'fwi', fwi from features_train union all select 'dc', dc from features_train) where v is not null and not isnan(v) group by 1")
def _(s, d):
    t = features(s, d).select("feat_id", "aet", "fwi", "dc", F.col("bui").alias("_bui"), "isi")
    t = RD.discovered(RD.unpivot_bands(t, ["feat_id"]), "band", include=["aet", "fwi", "dc", "_bui", "isi"], exclude=["isi"])
    return t.where("value is not null and not isnan(value)").groupBy(F.col("band").alias("feature")).agg(F.count(F.lit(1)).alias("n"))


@q("s19_manifest", 'select aoi_id, "rows" as n_rows, cols as n_cols, x_min, y_max from grid_meta where "rows" is not null')
def _(s, d):
    out = folder(s, "manifest")
    SK.to_json(table(s, d, "grid_meta").where("rows is not null"), out)
    m = RD.read_json(s, out, "aoi_id int, rows int, cols int, x_min double, y_max double")
    return m.select("aoi_id", F.col("rows").alias("n_rows"), F.col("cols").alias("n_cols"), "x_min", "y_max")


@q("s27_constant_raster", 'select f.i::int as fuel_type, (c.i // 6)::int as "row", (c.i % 6)::int as col, 24.0::double as ws, 92.0::double as ffmc from range(1, 21) f(i), range(0, 24) c(i)')
def _(s, d):
    fuels = s.range(1, 21).select(F.col("id").cast("int").alias("fuel_type"))
    return full_grid(fuels, Grid(0, 0, 1, 4, 6)).withColumns({"ws": F.lit(24.0), "ffmc": F.lit(92.0)})


@q("k05_k06_k08_csv_by_class", "select c as class_name, count(*) as n, min(label_id) as first_id from (select label_id, nullif(regexp_replace(upper(type_class), '[^A-Z0-9]', '', 'g'), '') as c from labels_combined) where c is not null group by 1")
def _(s, d):
    out = folder(s, "classes")
    SK.to_csv(table(s, d, "labels_combined").select("label_id", alnum_upper("type_class").alias("class_name")).where("class_name is not null"), out, ["class_name"])
    t = s.read.schema("label_id bigint, class_name string").option("header", True).csv(out)
    return t.groupBy("class_name").agg(F.count(F.lit(1)).alias("n"), F.min("label_id").alias("first_id"))


@q("k07_k09_zero_filled_map", "select feat_id, case when fwi is null or isnan(fwi) then 0 else fwi::double end as fwi from features_train")
def _(s, d):
    return SK.zero_filled(features(s, d).select("feat_id", "fwi"), ["fwi"])


def _logistic() -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=COLS, outputCol="features"), LogisticRegression(labelCol="label")])


@q("k11_model_round_trip")
def _(s, d):
    t = samples(s, d)
    out = folder(s, "model")
    _logistic().fit(t).write().overwrite().save(out)
    return PipelineModel.load(out).transform(t).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


@q("m03_m07_parameter_search")
def _(s, d):
    p = _logistic()
    lr = p.getStages()[1]
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.001, 0.1]).addGrid(lr.elasticNetParam, [0.0, 0.5]).build()
    found = TrainValidationSplit(estimator=p, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(metricName="areaUnderPR"), trainRatio=0.75, seed=42).fit(samples(s, d))
    rows = [(float(g[lr.regParam]), float(g[lr.elasticNetParam]), float(m)) for g, m in zip(grid, found.validationMetrics, strict=True)]
    return s.createDataFrame(rows, "reg double, elastic double, score double")


@q("x26_head_sizes", "select p_partkey, case when p_partkey % 3 < 2 then p_size end::int as width, case when p_partkey % 3 < 2 then p_partkey end::int as heads from part")
def _(s, d):
    width, heads = head_sizes(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, " X ").when(F.col("p_partkey") % 3 == 1, "x").otherwise("/"), F.col("p_partkey").cast("string")))
    return table(s, d, "part").select("p_partkey", width.alias("width"), heads.alias("heads"))


@q("x28_aspect_parts", "with a as (select feat_id, case when aspect_sin = 0 and aspect_cos = 0 then -1 else round(degrees(atan2(aspect_sin::double, aspect_cos::double)), 6) end as a from features_train where not isnan(aspect_sin) and not isnan(aspect_cos) and aspect_sin between -1 and 1 and aspect_cos between -1 and 1) select feat_id, case when a < 0 then 0.0 else round(sin(radians(a)), 7) end::double as s, case when a < 0 then 0.0 else round(cos(radians(a)), 7) end::double as c from a")
def _(s, d):
    f = features(s, d).where("not isnan(aspect_sin) and not isnan(aspect_cos) and aspect_sin between -1 and 1 and aspect_cos between -1 and 1")
    a = F.when((F.col("aspect_sin") == 0) & (F.col("aspect_cos") == 0), -1.0).otherwise(F.round(F.degrees(F.atan2(F.col("aspect_sin").cast("double"), F.col("aspect_cos").cast("double"))), 6))
    x, y = aspect_parts(F.col("a"))
    return f.select("feat_id", a.alias("a")).select("feat_id", F.round(x, 7).alias("s"), F.round(y, 7).alias("c"))


@q("u07_u10_carried_columns", "select aoi_id || '_' || \"row\" || '_' || col as key_text, feat_id, sample_key from features_train where aoi_id is not null and \"row\" is not null and col is not null")
def _(s, d):
    return key_tuples(features(s, d), ["aoi_id", "row", "col"], carry=["feat_id", "sample_key"]).drop("key")


QUERIES, SQL = q.queries, q.sql
