"""Records of evaluation splits that turn up again, exactly or almost, in the training split.

A record's text is its key. Its words in one dimension are the adjacent pairs of values (x-1, x) and (x, x+1), so records
whose values differ by at most 1 share a word; an n-gram joins the area with one word of each of the three dimensions, a record
has 8, and containment is the share of the evaluation record's n-grams that the training record has: 1 for equal keys,
halved by every dimension that is off by one.

For the search, words are hashed by pairs of values (2k, 2k+1): a training record has one such n-gram hash, an evaluation
record the 8 that its own words touch. The evaluation hashes are partitioned, training is scanned once for hits, and each
pair meets in exactly one hash. For every hit the n-gram hashes of both records are intersected; a pair that shares none is no overlap,
and what is left is verified on the keys, so collisions add nothing. Every pair that shares an n-gram is among the hits.

Both sides are reduced to distinct keys before the join, so a hash meets at most 8 training and 64 evaluation keys however
often a key is repeated; pairs of keys are expanded to pairs of rows last. Rows are salted on both sides, and a key carries the salts that its own rows
have (at most SALTS), so a key of one row is one row of the expansion. The report needs no pairs of rows: it multiplies the numbers of rows of both keys.

Rows of no split, without label_id or with a null key part don't count. Repeated rows give one pair each. Empty tables give no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celldays.functions.reading import KEY, split_of

DIMS = ["day", "row", "col"]
SALTS = 16


def records(labels: DataFrame) -> DataFrame:
    """label_id, source_file, split and the key as integers of the rows that count."""
    rows = labels.select("label_id", "source_file", split_of("split").alias("split"), *KEY).where("split is not null").dropna(subset=["label_id", *KEY])
    return rows.select("label_id", "source_file", "split", "aoi_id", F.unix_date("target_date").alias("day"), "row", "col")


def _block(c, move: int = 0):
    return F.floor((F.col(c).cast("long") + move) / 2)


def scanned(keys: DataFrame) -> DataFrame:
    """The one n-gram hash of each training key."""
    return keys.select("aoi_id", F.struct(*DIMS).alias("t"), F.xxhash64("aoi_id", *(_block(c) for c in DIMS)).alias("gram"), *(c for c in keys.columns if c[:2] == "t_"))


def probing(keys: DataFrame) -> DataFrame:
    """The 8 n-gram hashes that the words of each evaluation key touch."""
    w = [F.array(_block(c, -1), _block(c, 1)) for c in DIMS]
    g = F.flatten(F.transform(w[0], lambda d: F.flatten(F.transform(w[1], lambda r: F.transform(w[2], lambda c: F.xxhash64(F.col("aoi_id"), d, r, c))))))
    return keys.select("aoi_id", F.struct(*DIMS).alias("e"), F.explode(g).alias("gram"), *(c for c in keys.columns if c[:2] == "e_"))


def grams(x: str):
    """The 8 n-gram hashes of a key: the area with one word, the lower or the upper pair of adjacent values, of each dimension."""
    words = [F.array(F.col(f"{x}.{c}").cast("long") - 1, F.col(f"{x}.{c}").cast("long")) for c in DIMS]
    return F.flatten(F.transform(words[0], lambda d: F.flatten(F.transform(words[1], lambda r: F.transform(words[2], lambda c: F.xxhash64(F.col("aoi_id"), d, r, c))))))


def key_pairs(evaluation: DataFrame, training: DataFrame) -> DataFrame:
    """(aoi_id, e, t, containment) of keys, both sides distinct; further columns of both sides are kept as e_... and t_..."""
    more = [c for c in (*evaluation.columns, *training.columns) if c[:2] in ("e_", "t_")]
    hits = probing(evaluation).join(scanned(training), ["aoi_id", "gram"])
    shared = F.size(F.array_intersect(grams("e"), grams("t"))) / 8
    near = F.lit(True)
    for c in DIMS:
        near = near & (F.abs(F.col(f"e.{c}").cast("long") - F.col(f"t.{c}").cast("long")) <= 1)
    return hits.withColumn("containment", shared).where((F.col("containment") > 0) & near).select("aoi_id", "e", "t", "containment", *more)


def overlaps(labels: DataFrame) -> DataFrame:
    """(eval_id, train_id, split, source_file, containment): every evaluation row with every training row it overlaps."""
    rows = records(labels).withColumn("salt", F.pmod(F.xxhash64("label_id"), F.lit(SALTS)).cast("int"))
    ev, tr = rows.where("split <> 'train'"), rows.where("split = 'train'")
    keys = ["aoi_id", *DIMS]
    pairs = key_pairs(ev.groupBy(*keys).agg(F.collect_set("salt").alias("e_salts")), tr.groupBy(*keys).agg(F.collect_set("salt").alias("t_salts")))
    salted = pairs.withColumn("e_salt", F.explode("e_salts")).withColumn("t_salt", F.explode("t_salts")).drop("e_salts", "t_salts")
    ev = ev.select("aoi_id", F.struct(*DIMS).alias("e"), F.col("salt").alias("e_salt"), F.col("label_id").alias("eval_id"), "split", "source_file")
    tr = tr.select("aoi_id", F.struct(*DIMS).alias("t"), F.col("salt").alias("t_salt"), F.col("label_id").alias("train_id"))
    return salted.join(ev, ["aoi_id", "e", "e_salt"]).join(tr, ["aoi_id", "t", "t_salt"]).select("eval_id", "train_id", "split", "source_file", "containment")


def overlap_report(labels: DataFrame) -> DataFrame:
    """Per evaluation split and source file: rows, rows that overlap training, equal keys among them, and pairs."""
    rows = records(labels)
    keys, n = ["aoi_id", *DIMS], F.count(F.lit(1))
    ev, tr = rows.where("split <> 'train'"), rows.where("split = 'train'").groupBy(*keys).agg(n.alias("t_n"))
    own = ev.groupBy(*keys, "split", "source_file").agg(n.alias("n"))
    # per evaluation key: training rows that overlap it, and whether one has the same key
    best = key_pairs(own.select(*keys).distinct(), tr).groupBy("aoi_id", "e").agg(F.sum("t_n").alias("found"), F.max("containment").alias("best"))
    hit = own.join(best.select("aoi_id", *(F.col(f"e.{c}").alias(c) for c in DIMS), "found", "best"), keys, "left")
    some = F.col("found").isNotNull()
    total = lambda x, name: F.sum(F.coalesce(x, F.lit(0))).alias(name)
    return hit.groupBy("split", "source_file").agg(F.sum("n").alias("eval_rows"), total(F.when(some, F.col("n")), "overlapping_rows"), total(F.when(F.col("best") == 1, F.col("n")), "equal_rows"), total(F.col("n") * F.col("found"), "pairs"))
