"""Samples whose category shares match given targets.

Quotas are allocated top-down over a category tree (split, family, class): what a class can't supply goes first to its
siblings (same family), then to its cousins (other families of the split), in proportion to their own targets; what
remains is reported as shortfall. Rows are drawn at the leaves by permuted dense rank: distinct sample keys are ranked
by a seeded md5 and the first ``quota`` of them are taken.

The rank is exact but distributed: a histogram over 4,096 hash ranges per leaf locates the one range that holds the
cutoff, lower ranges are taken whole and only the cutoff range is ranked, so a leaf with a third of all rows is never
sorted in one task. Only counts per leaf (as many as targets) reach the driver.

Whether a target can be met is found by the same draw: as many keys as the target demands are drawn from the leaf, and where fewer
come out it can't.

A row counts if its key has no null part and its label fits the class. Repeated rows and ties of one key are one draw
(the row with the least label_id stands for it); a key delivered in two classes is available in both. Targets with a
null share or minimum count as 0; minima that exceed the sample size together share it in proportion. Empty tables give no sample and a report with available 0.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from celldays.functions.reading import KEY, alnum_upper, label_fits, split_of
from celldays.session import cut

LEAF = ["split", "type_class"]
RANGES = 4096
MAX_LEAVES = 10_000
REPORT = "split string, type_class string, target_share double, min_rows int, sample_size int, available long, demand long, reached long, quota long, drawn long, to_siblings long, to_cousins long, shortfall long, unmet boolean"


def family(type_class: str) -> str:
    """Inner node of the tree: the letters in front of the class number."""
    return "NOFIRE" if type_class.startswith("NOFIRE") else "FIRE" if type_class.startswith("FIRE") else type_class


def leaf_keys(labels: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """One row per leaf and distinct sample key: least label_id, seeded hash and its range."""
    rows = labels.select("label_id", *KEY, "label", split_of("split").alias("split"), alnum_upper("type_class").alias("type_class"))
    rows = rows.where(F.col("split").isNotNull() & label_fits(F.col("type_class"), F.col("label"))).dropna(subset=KEY)
    # leaves are the targets' categories, at most MAX_LEAVES rows as checked
    keys = rows.join(F.broadcast(leaves), LEAF, "left_semi").groupBy(*LEAF, *KEY).agg(F.min("label_id").alias("label_id"))
    hashed = keys.withColumn("perm", F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in KEY))))
    return hashed.withColumn("range", F.conv(F.substring("perm", 1, 3), 16, 10).cast("int"))


def apportion(total: int, weights: list[float]) -> list[int]:
    """Largest-remainder shares of total; ties go to the earlier place."""
    whole = math.fsum(weights)
    if total <= 0 or whole <= 0:
        return [0] * len(weights)
    exact = [total * w / whole for w in weights]
    out = [math.floor(x) for x in exact]
    for i in sorted(range(len(out)), key=lambda i: (out[i] - exact[i], i))[: total - sum(out)]:
        out[i] += 1
    return out


def pour(amount: int, room: list[int], weights: list[float]) -> list[int]:
    """Gives amount to places with room, by weight, again and again until it is gone or no room is left."""
    given = [0] * len(room)
    while amount > 0 and (open_ := [i for i, r in enumerate(room) if r > given[i]]):
        w = [weights[i] if any(weights[j] > 0 for j in open_) else 1.0 for i in open_]
        shares = apportion(amount, w)
        step = [min(s, room[i] - given[i]) for i, s in zip(open_, shares, strict=True)]
        for i, s in zip(open_, step, strict=True):
            given[i] += s
        amount -= sum(step)
        if not sum(step):
            break
    return given


def allocate(targets: list[dict], available: dict[tuple, int]) -> list[dict]:
    """Quota, draw and shortfall of each leaf of one category tree; targets have the columns of class_targets."""
    out, splits = [], defaultdict(list)
    for t in targets:
        splits[t["split"]].append(t)
    for split, leaves in splits.items():
        size = max((t["sample_size"] or 0) for t in leaves)
        have = [available.get((split, t["type_class"]), 0) for t in leaves]
        share = [t["target_share"] or 0.0 for t in leaves]
        least = [t["min_rows"] or 0 for t in leaves]
        groups = defaultdict(list)
        for i, t in enumerate(leaves):
            groups[family(t["type_class"])].append(i)
        # top-down: the split's size to families, then to classes; minima first, the rest by share
        quota = [0] * len(leaves)
        floors = least if sum(least) <= size else apportion(size, least)
        for node, part in zip(groups.values(), apportion(size, [math.fsum(share[i] for i in g) for g in groups.values()]), strict=True):
            for i, n in zip(node, apportion(part, [share[i] for i in node]), strict=True):
                quota[i] = n
        lack = [max(0, f - q) for f, q in zip(floors, quota, strict=True)]
        if any(lack):  # raised minima are paid by classes above their own minimum
            pay = pour(sum(lack), [max(0, q - f) for f, q in zip(floors, quota, strict=True)], [max(0, q - f) for f, q in zip(floors, quota, strict=True)])
            quota = [q + a - b for q, a, b in zip(quota, lack, pay, strict=True)]
        drawn = [min(q, h) for q, h in zip(quota, have, strict=True)]
        sent = {"siblings": [0] * len(leaves), "cousins": [0] * len(leaves)}
        unmet = [q - d for q, d in zip(quota, drawn, strict=True)]
        for kind, pools in (("siblings", list(groups.values())), ("cousins", [list(range(len(leaves)))])):
            for pool in pools:
                given = pour(sum(unmet[i] for i in pool), [have[i] - drawn[i] for i in pool], [share[i] for i in pool])
                left = sum(given)
                for i, g in zip(pool, given, strict=True):
                    drawn[i] += g
                for i in pool:  # what was placed is taken off the classes that lacked it, in tree order
                    moved = min(unmet[i], left)
                    unmet[i] -= moved
                    sent[kind][i] += moved
                    left -= moved
        for i, t in enumerate(leaves):
            demand = max(math.ceil(share[i] * (t["sample_size"] or 0)), least[i])
            out.append({**{k: t[k] for k in (*LEAF, "target_share", "min_rows", "sample_size")}, "available": have[i], "quota": quota[i], "drawn": drawn[i], "to_siblings": sent["siblings"][i], "to_cousins": sent["cousins"][i], "shortfall": unmet[i], "demand": demand})
    return out


def draw(keys: DataFrame, hist: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first n keys of each leaf by permuted dense rank, all where it has fewer; keys: leaf_keys(), hist: their numbers by leaf and range, wanted: (split, type_class, n), a row per leaf."""
    over = Window.partitionBy(*LEAF).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    # wanted and edges have at most one row per leaf, MAX_LEAVES as checked
    ends = hist.withColumn("end", F.sum("n").over(over)).withColumn("before", F.col("end") - F.col("n")).drop("n").join(F.broadcast(wanted), LEAF)
    edge = ends.where((F.col("end") >= F.col("n")) & (F.col("before") < F.col("n"))).select(*LEAF, F.col("range").alias("edge"), "before")
    lines = wanted.where("n > 0").join(edge, LEAF, "left").select(*LEAF, "n", F.coalesce("edge", F.lit(RANGES)).alias("edge"), "before")
    marked = keys.join(F.broadcast(lines), LEAF)
    low = marked.where(F.col("range") < F.col("edge"))
    rank = F.col("before") + F.dense_rank().over(Window.partitionBy(*LEAF).orderBy("perm", *KEY))
    last = marked.where(F.col("range") == F.col("edge")).withColumn("rank", rank).where(F.col("rank") <= F.col("n")).drop("rank")
    return low.unionByName(last).select(*LEAF, *KEY, "label_id", "perm")


def sample_by_proportion(labels: DataFrame, targets: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The drawn rows (split, type_class, key, label_id, perm) and the report of every target; unmet: a draw of the demand reaches fewer keys."""
    spark = labels.sparkSession
    wanted = [r.asDict() for r in targets.dropDuplicates(LEAF).orderBy(*LEAF).limit(MAX_LEAVES + 1).collect()]
    if len(wanted) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} categories; use a coarser tree")
    leaves = spark.createDataFrame([(t["split"], t["type_class"]) for t in wanted], "split string, type_class string")
    keys = cut(leaf_keys(labels, leaves, seed))
    hist = keys.groupBy(*LEAF, "range").agg(F.count(F.lit(1)).alias("n"))
    available = {(r[0], r[1]): r[2] for r in hist.groupBy(*LEAF).agg(F.sum("n")).collect()}
    plan = [{**p, "reached": None, "unmet": None} for p in allocate(wanted, available)]
    report = spark.createDataFrame([tuple(p[c.split()[0]] for c in REPORT.split(", ")) for p in plan], REPORT)
    reached = draw(keys, hist, report.select(*LEAF, F.col("demand").alias("n"))).groupBy(*LEAF).agg(F.count(F.lit(1)).alias("got"))
    got = F.coalesce("got", F.lit(0))
    report = report.join(reached, LEAF, "left").withColumn("reached", got).withColumn("unmet", got < F.col("demand")).select(*(c.split()[0] for c in REPORT.split(", ")))
    return draw(keys, hist, report.select(*LEAF, F.col("drawn").alias("n"))), report
