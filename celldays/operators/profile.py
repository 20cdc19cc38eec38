"""Column-level data quality profile of loads, and what changed against each load's baseline.

Values are generalised to character-class masks, in two steps. The fine mask of a number is its fixed-point text with the
sign, the leading zeros and the first three significant digits kept and all later digits read as 9, so that every mask is an interval of
values; a value out of its column's range has the mask < or >. The fine mask of a sample key names the parts that equal the row's own
fields (D, R, C) and gives the character classes of the others, so D_R_C is the usual form and nothing else is. The coarse mask has
letters and digits only as classes, runs collapsed. Coarse masks that hold at least ``common`` of a load's values are that column's
patterns; all others are rare. The fine mask distributions of a load and of its baseline, a missing value being a mask of its own, are compared
by Jensen-Shannon divergence (base 2, 0 to 1).

Columns are first reduced to value counts, so that masks are made of distinct values. All figures but the quartiles come from the
table of masks; exact quartiles are located in the cumulated masks and read from the values of the one or two masks
that hold each rank, so that no column of no load is ever sorted in one task.

Nulls: a null or NaN is missing; an infinity is a value out of range. Rows without load_id belong to no load and are
left out. A load without a row in the log has no baseline, so it gets no finding that needs one. Empty tables give no
rows; extra columns are ignored; repeated rows count as delivered.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from celldays.functions.reading import in_range
from celldays.session import cut

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (UPPER + UPPER.lower() + "0123456789", "A" * 26 + "a" * 26 + "9" * 10)
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
OTHER_COLUMNS = ["aoi_id", "target_date", "row", "col", "window_id", "split", "source_file", "loaded_at"]
KEY_FORM = "D_R_C"
GROUP = ["load_id", "column_name"]


def mask_of(c: Column) -> Column:
    """Coarse character-class mask: A-Z to A, a-z to a, digits to 9, runs of one class collapsed."""
    return F.regexp_replace(F.translate(c.cast("string"), *CLASSES), r"([Aa9])\1+", "$1")


def number_mask(v: Column, low: Column, high: Column, digits: int = 3) -> Column:
    """Fine mask of a number: an interval of in-range values, < or > for the rest, null for a missing value."""
    d = v.cast("double")
    text = d.try_cast("decimal(38,6)").cast("string")
    head = F.regexp_extract(text, rf"^-?[0.]*(?:[0-9]\.?){{0,{digits}}}", 0)
    inside = F.coalesce(F.concat(head, F.translate(F.substring(text, F.length(head) + 1, F.lit(99)), "012345678", "9" * 9)), F.when(d < 0, "-E").otherwise("E"))
    return F.when(v.isNotNull(), F.when(in_range(v, low, high), inside).when(d < low, "<").otherwise(">"))


def key_mask(key: Column) -> Column:
    """Fine mask of a sample key: D, R and C for the parts that are the row's own date, row and col, the coarse mask of all others."""
    part = F.split(key, "_", -1)
    own = (("D", F.date_format("target_date", "yyyy-MM-dd")), ("R", F.col("row").cast("string")), ("C", F.col("col").cast("string")))
    named = F.concat_ws("_", *(F.when(F.get(part, F.lit(i)) == value, name).otherwise(mask_of(F.get(part, F.lit(i)))) for i, (name, value) in enumerate(own)))
    return F.when(key.isNotNull(), F.when(F.size(part) == 3, named).otherwise(mask_of(key)))


def value_counts(features: DataFrame, columns: list[str]) -> DataFrame:
    """(load_id, column_name, value, n) of numeric columns: combined on the map side, so a hot load shuffles its distinct values only."""
    clean = features.where(F.col("load_id").isNotNull()).select("load_id", *(F.nanvl(F.col(c).cast("float"), F.lit(None).cast("float")).alias(c) for c in columns))
    return clean.unpivot(["load_id"], columns, "column_name", "value").groupBy(*GROUP, "value").agg(F.count(F.lit(1)).alias("n"))


def text_values(features: DataFrame, columns: list[str]) -> DataFrame:
    """(load_id, column_name, value) of text columns, sample_key among them, one row per row and column."""
    names = ["sample_key", *columns]
    return features.where(F.col("load_id").isNotNull()).select("load_id", *(F.col(c).cast("string").alias(c) for c in names)).unpivot(["load_id"], names, "column_name", "value")


def key_masks(features: DataFrame) -> DataFrame:
    """(load_id, column_name, mask, n) of sample_key, whose fine mask depends on its row."""
    return features.where(F.col("load_id").isNotNull()).groupBy("load_id", F.lit("sample_key").alias("column_name"), key_mask(F.col("sample_key")).alias("mask")).agg(F.count(F.lit(1)).alias("n"))


def number_masks(counts: DataFrame) -> DataFrame:
    """The mask table of numeric columns: rows, most frequent value's rows, distinct values and bounds of every mask.

    counts: value_counts with the fine mask of each value.
    """
    v = F.col("value").cast("double")
    return counts.groupBy(*GROUP, "mask").agg(F.sum("n").alias("n"), F.max("n").alias("n_mode"), F.count("value").alias("distinct"), F.min(v).alias("low"), F.max(v).alias("high"))


def quartiles(counts: DataFrame, masks: DataFrame) -> DataFrame:
    """Exact, linearly interpolated quartiles of the in-range values of (load_id, column_name).

    Masks are intervals, so cumulating them by their least value tells which masks hold the ranks asked for; only the values of those are ranked.
    """
    over = Window.partitionBy(*GROUP)
    hist = masks.where(_inside()).select(*GROUP, "mask", "low", F.col("n").alias("in_mask"))
    hist = hist.withColumn("total", F.sum("in_mask").over(over)).withColumn("before", F.sum("in_mask").over(over.orderBy("low").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_mask"))
    at = {q: (F.col("total") - 1) * F.lit(p) for q, p in QUARTILES.items()}
    ranks = [f(h) for h in at.values() for f in (F.floor, F.ceil)]
    holds = reduce(lambda a, b: a | b, [(r >= F.col("before")) & (r < F.col("before") + F.col("in_mask")) for r in ranks])
    near = counts.select(*GROUP, "mask", F.col("value").cast("double").alias("value"), "n").join(hist.where(holds), [*GROUP, "mask"])
    end = F.col("before") + F.sum("n").over(Window.partitionBy(*GROUP, "mask").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("end", end).withColumn("begin", F.col("end") - F.col("n"))

    def value_at(r: Column) -> Column:
        return F.max(F.when((r >= F.col("begin")) & (r < F.col("end")), F.col("value")))

    parts = [x for q, h in at.items() for x in (value_at(F.floor(h)).alias(f"{q}_lo"), value_at(F.ceil(h)).alias(f"{q}_hi"), F.max(h - F.floor(h)).alias(f"{q}_f"))]
    out = near.groupBy(*GROUP).agg(*parts)
    return out.select(*GROUP, *((F.col(f"{q}_lo") + (F.col(f"{q}_hi") - F.col(f"{q}_lo")) * F.col(f"{q}_f")).alias(q) for q in QUARTILES))


def _inside() -> Column:
    return F.col("mask").isNotNull() & ~F.col("mask").isin("<", ">")


def number_profile(counts: DataFrame, masks: DataFrame) -> DataFrame:
    """Shares, distinct values, range and quartiles of every load and numeric column."""
    n, some = F.col("n"), F.col("mask").isNotNull()
    stats = masks.groupBy(*GROUP).agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(some, n).otherwise(0)).alias("n_values"), F.sum(F.when(_inside(), n).otherwise(0)).alias("n_inside"), F.max(F.when(_inside(), F.col("n_mode"))).alias("n_mode"),
        F.sum("distinct").alias("distinct_values"), F.min("low").alias("min_number"), F.max("high").alias("max_number"),
    )
    return stats.join(quartiles(counts, masks), GROUP, "left")


def text_profile(masks: DataFrame, values: DataFrame) -> DataFrame:
    """Shares, distinct values and range of text columns; n_bad counts the sample keys whose mask is not the usual form's, nulls included."""
    n = F.col("n")
    bad = F.when(F.col("column_name") == "sample_key", F.when(F.col("mask") == KEY_FORM, 0).otherwise(n))
    shares = masks.groupBy(*GROUP).agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("mask").isNotNull(), n).otherwise(0)).alias("n_values"), F.sum(bad).alias("n_bad"))
    return shares.join(values.groupBy(*GROUP).agg(F.count("value").alias("distinct_values"), F.min("value").alias("min_value"), F.max("value").alias("max_value")), GROUP, "left")


def patterns(masks: DataFrame, common: float) -> DataFrame:
    """masks: (load_id, column_name, mask, n). Most frequent coarse mask of each column, and the share of its values whose coarse mask is rare."""
    # a missing value has no pattern; the missing share covers it
    coarse = masks.where(F.col("mask").isNotNull()).groupBy(*GROUP, mask_of(F.col("mask")).alias("mask")).agg(F.sum("n").alias("n"))
    m = coarse.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*GROUP)))
    return m.groupBy(*GROUP).agg(F.max_by("mask", F.struct("n", "mask")).alias("top_mask"), F.sum(F.when(F.col("share") < common, F.col("share")).otherwise(0.0)).alias("rare_mask_share"))


def divergences(masks: DataFrame, base: DataFrame) -> DataFrame:
    """(load_id, column_name, mask_divergence): Jensen-Shannon divergence of the fine masks from the baseline's; none for a load without a baseline row."""
    m = masks.select(*GROUP, F.coalesce("mask", F.lit("null")).alias("mask"), (F.col("n") / F.sum("n").over(Window.partitionBy(*GROUP))).alias("share"))
    on = ["load_id", "baseline_load_id", "column_name", "mask"]
    left = m.join(base, "load_id").select(*on, F.col("share").alias("p"))
    columns = left.select(*on[:3]).distinct()
    right = m.select(F.col("load_id").alias("baseline_load_id"), "column_name", "mask", F.col("share").alias("q")).join(columns, ["baseline_load_id", "column_name"]).select(*on, "q")
    both = left.join(right, on, "full").fillna(0.0, ["p", "q"])
    mid = (F.col("p") + F.col("q")) / 2
    half = lambda x: F.when(x > 0, x * F.log2(x / mid)).otherwise(0.0) / 2
    return both.groupBy(*GROUP).agg(F.sum(half(F.col("p")) + half(F.col("q"))).alias("mask_divergence"))


def profile_loads(features: DataFrame, log: DataFrame, catalog: DataFrame, others: list[str] | None = None, common: float = 0.05) -> DataFrame:
    """One row per load and column: shares, counts, range, quartiles, masks and their divergence from the baseline.

    catalog names the numeric columns and their valid ranges (a fixed small table); others adds further columns, read as text. sample_key
    is always profiled, and its violations are the rows whose fine mask is not the usual form's.
    """
    limits = catalog.dropDuplicates(["feature"]).select(F.col("feature").alias("column_name"), F.col("valid_min").cast("double"), F.col("valid_max").cast("double"))
    columns = [r[0] for r in limits.select("column_name").collect() if r[0] in features.columns]
    # limits has one row per numeric column of the table
    counts = cut(value_counts(features, columns).join(F.broadcast(limits), "column_name").select(*GROUP, "value", "n", number_mask(F.col("value"), F.col("valid_min"), F.col("valid_max")).alias("mask")))
    masks = number_masks(counts)
    values = text_values(features, others or []).groupBy(*GROUP, "value").agg(F.count(F.lit(1)).alias("n"))
    texts = key_masks(features)
    if others:
        texts = texts.unionByName(values.where("column_name <> 'sample_key'").groupBy(*GROUP, mask_of(F.col("value")).alias("mask")).agg(F.sum("n").alias("n")))
    rest = number_profile(counts, masks).unionByName(text_profile(texts, values), allowMissingColumns=True)
    every = masks.select(*GROUP, "mask", "n").unionByName(texts)
    base = log.where("load_id is not null").groupBy("load_id").agg(F.min("baseline_load_id").alias("baseline_load_id"))
    far = divergences(every, base.where("baseline_load_id is not null"))
    out = rest.join(patterns(every, common), GROUP, "left").join(far, GROUP, "left").join(base, "load_id", "left")
    return out.select(
        *GROUP, "baseline_load_id", "n_rows", (1 - F.col("n_values") / F.col("n_rows")).alias("missing_share"), "distinct_values", "min_number", "max_number", "min_value", "max_value", *QUARTILES,
        F.try_divide(F.col("n_values") - F.col("n_inside"), F.col("n_values")).alias("outside_share"), F.try_divide(F.col("n_mode"), F.col("n_inside")).alias("mode_share"),
        F.try_divide(F.col("n_bad"), F.col("n_rows")).alias("bad_share"), "top_mask", "rare_mask_share", "mask_divergence", (F.col("n_rows") - F.col("n_values")).alias("n_missing"),
    )


def findings(profile: DataFrame, missing: float = 0.10, outside: float = 0.02, shift: float = 0.5, constant: float = 0.15, pattern: float = 0.02) -> DataFrame:
    """(load_id, column_name, finding) of each load against its baseline; a null on either side gives no finding.

    A missing share grows by more than d only where the masks diverge by at least d^2 / (2 ln 2) (Pinsker's inequality, a missing value
    being a mask), so the divergence selects the columns and the shares confirm.
    """
    base = profile.select(F.col("load_id").alias("baseline_load_id"), "column_name", *(F.col(c).alias(f"b_{c}") for c in ("n_missing", "n_rows", "p25", "p50", "p75", "mode_share")))
    both = profile.join(base, ["baseline_load_id", "column_name"], "left")
    numeric = F.col("column_name") != "sample_key"
    gap = F.col("n_missing") / F.col("n_rows") - F.col("b_n_missing") / F.col("b_n_rows")
    far = F.col("mask_divergence") >= missing**2 / (2 * math.log(2)) * (1 - 1e-6)
    rules = {
        "missing": numeric & far & (gap > missing),
        "range": numeric & (F.col("outside_share") > outside),
        "shift": numeric & (F.abs(F.col("p50") - F.col("b_p50")) > shift * (F.col("b_p75") - F.col("b_p25"))),
        "constant": numeric & (F.col("mode_share") - F.col("b_mode_share") > constant),
        "pattern": ~numeric & (F.col("bad_share") > pattern),
    }
    found = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return both.select("load_id", "column_name", F.explode(found).alias("finding"))
