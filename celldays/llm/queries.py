"""Queries of the training-data operators: p1, p3, p4, p6, p7, p8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celldays.llm.mixture import counted, mix
from celldays.llm.overlap import overlap_report, overlaps
from celldays.llm.proportions import sample_by_proportion
from celldays.llm.sentences import sentence_units
from celldays.llm.splits import assigned, broken_groups, grouped_split, with_components
from celldays.llm.tokens import encode
from celldays.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[1].where("unmet").select("split", "type_class")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[1]


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d)[0].drop("perm")


def _sample(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return sample_by_proportion(table(spark, d, "labels_combined"), table(spark, d, "class_targets"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return broken_groups(assigned(with_components(table(spark, d, "labels_combined")), table(spark, d, "split_targets")))


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return grouped_split(with_components(table(spark, d, "labels_combined")), table(spark, d, "split_targets"))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d)[0]


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d)[1]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlaps(table(spark, d, "labels_combined"))
    return pairs.select(F.least("eval_id", "train_id").alias("label_id_1"), F.greatest("eval_id", "train_id").alias("label_id_2"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap_report(table(spark, d, "labels_combined"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    targets = table(spark, d, "mixture_targets")
    topics = [r[0] for r in table(spark, d, "feature_catalog").select("feature").distinct().collect()]
    return mix(counted(table(spark, d, "documents"), targets, topics), targets)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1].where("unreachable").select("source")


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p7_margins(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[2]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentence_units(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_sample, p3_found, p3_splits, p3_report, p4_found, p4_report, p6_ids, p7_found, p7_mixture, p7_report, p7_margins, p8_found)}

_READ = """
with r as (select label_id, aoi_id, target_date, "row" as r, col as c, label, source_file,
  case substr(ltrim(lower(split), chr(32) || chr(9)), 1, 2) when 'tr' then 'train' when 'va' then 'val' when 'te' then 'test' end as split,
  nullif(regexp_replace(upper(type_class), '[^A-Z0-9]', '', 'g'), '') as type_class,
  nullif(regexp_replace(upper(fire_event_id), '[^A-Z0-9]', '', 'g'), '') as event from labels_combined)"""
_PAIRS = """, e as (select * from r where split in ('val', 'test') and aoi_id is not null and target_date is not null and r is not null and c is not null),
 t as (select * from r where split = 'train' and aoi_id is not null and target_date is not null and r is not null and c is not null),
 p as (select e.label_id as eval_id, t.label_id as train_id, e.split, e.source_file,
   e.target_date = t.target_date and e.r = t.r and e.c = t.c as same
   from e, range(-1, 2) x(dd), range(-1, 2) y(dr), range(-1, 2) z(dc), t
   where t.aoi_id = e.aoi_id and t.target_date = e.target_date + dd::int and t.r = e.r + dr and t.c = e.c + dc)"""
SQL = {
    "p1_found": _READ + """,
 k as (select split, type_class, count(distinct (aoi_id, target_date, r, c)) as n from r
   where aoi_id is not null and target_date is not null and r is not null and c is not null
   and label = case when type_class like 'FIRE%' then 1 when type_class like 'NOFIRE%' then 0 end group by all)
select t.split, t.type_class from class_targets t left join k using (split, type_class)
where coalesce(n, 0) < target_share * sample_size or coalesce(n, 0) < min_rows""",
    "p3_found": _READ + """
select 'cell' as group_kind, aoi_id || '_' || r || '_' || c as group_key from r where split is not null and aoi_id is not null and r is not null and c is not null
 group by aoi_id, r, c having count(distinct split) > 1
union all select 'event', event from r where split is not null and event is not null group by event having count(distinct split) > 1""",
    "p4_found": _READ + _PAIRS + " select least(eval_id, train_id) as label_id_1, greatest(eval_id, train_id) as label_id_2 from p",
    "p4_report": _READ + _PAIRS + """,
 b as (select eval_id, split, source_file, count(*) as n, bool_or(same) as same from p group by all),
 h as (select split, source_file, count(*) as overlapping_rows, count(*) filter (where same) as equal_rows, sum(n)::bigint as pairs from b group by all),
 a as (select split, source_file, count(*) as eval_rows from e group by all)
select a.split, a.source_file, eval_rows, coalesce(overlapping_rows, 0) as overlapping_rows, coalesce(equal_rows, 0) as equal_rows, coalesce(pairs, 0) as pairs
from a left join h on a.split = h.split and a.source_file is not distinct from h.source_file""",
}
