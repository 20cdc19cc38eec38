"""Splits that keep related records together.

Records are related through their cell (area, row and column) and their fire event. Components of that bipartite graph are found by union-find within each
partition of the edges, then by alternating large-star and small-star steps over what is left, each cut by a checkpoint; nothing of the graph reaches the
driver. Nodes are 64-bit hashes: should two ever be equal, two components become one, which keeps related records together all the same.

Components of identical size and label profile are bundled, and only the bundles (profile, number of components) reach the driver. There the bundles are
allocated to the splits by min-cost flow, one size of component after the other, the largest first, so that smaller ones make up for what larger ones leave.
Components of one size are interchangeable in rows, so their allocation is a flow: bundles send their components over arcs to the splits and these to the
sink, at a convex cost on each arc (squared deviation from the rows of each label that the split still lacks) and on each split (squared deviation from the rows
that it still lacks). The flow starts at the rounded proportional allocation, and negative cycles of its residual network are cancelled until none is left,
which makes it optimal for that size. Over all sizes together the problem holds number partitioning and is NP-hard; single components are then moved or exchanged
between two splits as long as that lowers the deviation of all sizes together. Members get their split by the rank of their hash within the bundle, computed over hash ranges as
the bundles may be large.

Rows without a whole cell key and without an event are components of their own (those without label_id together one). Null labels form a third label kind.
Repeated rows stay with their key. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from celldays.functions.reading import alnum_upper, split_of
from celldays.session import cut

#: bundles are read by the driver; beyond this number the call fails instead of leaving any out
MAX_BUNDLES = 1_000_000
KINDS = ["fire", "nofire", "none"]


def keyed(labels: DataFrame) -> DataFrame:
    """label_id, delivered split, label kind, and the keys of the groups a row belongs to (null where it has none)."""
    whole = F.col("aoi_id").isNotNull() & F.col("row").isNotNull() & F.col("col").isNotNull()
    return labels.select(
        "label_id", split_of("split").alias("delivered"), F.when(F.col("label") == 1, "fire").when(F.col("label") == 0, "nofire").otherwise("none").alias("kind"),
        F.when(whole, F.concat_ws("_", *(F.col(c).cast("string") for c in ("aoi_id", "row", "col")))).alias("cell"), alnum_upper("fire_event_id").alias("event"),
    )


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition: every node but the least of its local component gets one edge to that."""
    parent: dict = {}

    def find(x):
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [n for n in parent if find(n) != n]
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(n) for n in part], pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of an undirected edge list (a, b) of longs; root is the least node of the component.

    After the contraction, alternating large-star and small-star until no edge changes: O(log^2 n) rounds whatever the diameter, and each
    round is two aggregations over at most as many edges as before.
    """
    now, mark = cut(edges.select("a", "b").where("a <> b").mapInArrow(_contract, "a long, b long").distinct()), None
    while True:
        both = now.select("a", "b").union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        root = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(root, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(root.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = cut(small)
        sign = now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sign == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = sign


def with_components(labels: DataFrame) -> DataFrame:
    """keyed() and the component of each record."""
    rows = cut(keyed(labels))
    cell, event = F.xxhash64(F.lit("c"), "cell"), F.xxhash64(F.lit("e"), "event")
    roots = components(rows.where("cell is not null and event is not null").select(cell.alias("a"), event.alias("b")).distinct())
    # a hot cell or event is one node: rows are reduced to nodes before the join, and AQE splits the probe side
    own = F.when(F.col("cell").isNotNull(), cell).when(F.col("event").isNotNull(), event).otherwise(F.xxhash64(F.lit("r"), "label_id"))
    node = rows.withColumn("node", own)
    return node.join(roots, "node", "left").select("label_id", "delivered", "kind", "cell", "event", F.coalesce("root", "node").alias("component"))


def class_cost(y: np.ndarray, size: int, want: np.ndarray, target: np.ndarray, quota: np.ndarray) -> float:
    """Cost of a flow y (bundles x splits) of components of one size: deviation of each split's rows and of each arc's."""
    return float((((y.sum(0) * size - want) ** 2) / quota).sum() + (((y - target) * size) ** 2 / quota).sum())


def class_flow(count: np.ndarray, size: int, want: np.ndarray, target: np.ndarray, quota: np.ndarray) -> np.ndarray:
    """Integral flow of the components of one size from bundles to splits of the least class_cost.

    count: components of each bundle; want: rows each split should get; target: components each arc should carry; quota: weights of the splits.
    Costs are convex and separate over the arcs, so a flow without a negative cycle in its residual network is optimal. A cycle leads over the splits only: from
    split s to t by the bundle whose component is moved at the least cost.
    """
    k = len(want)
    y, carry = np.zeros(target.shape, dtype=np.int64), np.zeros(k)
    for i, n in enumerate(count):  # largest remainders, what is rounded off being handed on
        goal = np.maximum(target[i] + carry, 0)
        goal = goal * (n / goal.sum()) if goal.sum() > 0 else np.full(k, n / k)
        y[i] = np.floor(goal)
        y[i, np.argsort(y[i] - goal, kind="stable")[: n - y[i].sum()]] += 1
        carry += target[i] - y[i]
    unit = size * size / quota
    while True:
        total = y.sum(0)
        more = unit * (2 * (y - target) + 1)  # cost of one component more on each arc
        less = unit * (1 - 2 * (y - target))
        into, out = (unit * (2 * total + 1) - 2 * size * want / quota), (unit * (1 - 2 * total) + 2 * size * want / quota)
        arc, by = np.full((k, k), np.inf), np.zeros((k, k), dtype=np.int64)
        for s in range(k):
            held = np.flatnonzero(y[:, s])
            for t in range(k):
                if s != t and len(held):
                    move = less[held, s] + more[held, t]
                    by[s, t] = held[move.argmin()]
                    arc[s, t] = move.min()
        cycle = _negative_cycle(arc, into, out)
        if not cycle:
            return y
        for s, t in cycle:
            y[by[s, t], s] -= 1
            y[by[s, t], t] += 1


def _negative_cycle(arc: np.ndarray, into: np.ndarray, out: np.ndarray) -> list[tuple[int, int]]:
    """Arcs of a cycle of negative cost among the splits (nodes 0..k-1) and the sink (node k), without the arcs at the sink; empty if there is none."""
    k = len(into)
    cost = np.full((k + 1, k + 1), np.inf)
    cost[:k, :k] = arc
    cost[k, :k], cost[:k, k] = out, into  # a path that begins at s and ends at t changes the rows of both
    cost[np.arange(k + 1), np.arange(k + 1)] = np.inf
    far, before = np.zeros(k + 1), np.full(k + 1, -1)
    last = -1
    for _ in range(k + 1):
        last = -1
        for a in range(k + 1):
            for b in range(k + 1):
                if far[a] + cost[a, b] < far[b] - 1e-9:
                    far[b], before[b], last = far[a] + cost[a, b], a, b
        if last < 0:
            return []
    for _ in range(k + 1):
        last = before[last]
    nodes, x = [last], before[last]
    while x != last:
        nodes.append(x)
        x = before[x]
    nodes = nodes[::-1]
    return [(a, b) for a, b in zip(nodes, [*nodes[1:], nodes[0]], strict=True) if a < k and b < k]


def deviation(out: np.ndarray, bundles: np.ndarray, shares: list[float]) -> float:
    """Squared deviation of each split's rows and of its rows of each label kind from its quota, divided by the quota."""
    vec = np.column_stack([bundles[:, :3].sum(1), bundles[:, :3]]).astype(float)
    quota = np.outer(shares, vec.T @ bundles[:, 3])
    return float(((out.T @ vec - quota) ** 2 / np.maximum(1.0, quota)).sum())


def _exchange(out: np.ndarray, vec: np.ndarray, over: np.ndarray, weight: np.ndarray, chunk: int = 1024) -> None:
    """Exchanges single components between two splits, or moves one, as long as that lowers the deviation of all sizes together; changes out and over.

    Exchanging v of split s for u of split t changes the deviation by (u - v) W (u - v) + 2 g (u - v), W and g the sums of both splits' weights and gradients;
    a zero vector stands for no component, so moves are exchanges too.
    """
    k = out.shape[1]
    vec0 = np.vstack([vec, np.zeros(4)])
    changed = True
    while changed:
        changed = False
        for s in range(k):
            for t in range(s + 1, k):
                w = weight[s] + weight[t]
                at = 0
                while True:
                    give = np.append(np.flatnonzero(out[:, s]), len(vec))
                    take = np.append(np.flatnonzero(out[:, t]), len(vec))
                    if at >= len(give):
                        break
                    part = give[at : at + chunk]
                    v, u, g = vec0[part], vec0[take], 2 * (weight[s] * over[s] - weight[t] * over[t])
                    step = (v * v @ w - v @ g)[:, None] + (u * u @ w + u @ g)[None] - 2 * (v * w) @ u.T
                    a, b = divmod(int(step.argmin()), len(take))
                    # the expansion rounds, so the gain is computed anew before it counts
                    d = u[b] - v[a]
                    if (d * d) @ w + d @ g >= -1e-9:
                        at += chunk
                        continue
                    for x, c, r in ((part[a], s, t), (take[b], t, s)):
                        if x < len(vec):
                            out[x, c] -= 1
                            out[x, r] += 1
                    over[s] += d
                    over[t] -= d
                    changed = True


def flow(bundles: list[tuple[int, int, int, int]], shares: list[float]) -> list[list[int]]:
    """How many components of each bundle (fire, nofire, none, count) go to each split."""
    b, p = np.array(bundles, dtype=np.int64).reshape(-1, 4), np.array(shares)
    size = b[:, :3].sum(1)
    vec = np.column_stack([size, b[:, :3]]).astype(float)
    quota = np.outer(p, vec.T @ b[:, 3])
    lack, out = quota.copy(), np.zeros((len(b), len(p)), dtype=np.int64)
    for z in sorted(set(size.tolist()), reverse=True):
        own = np.flatnonzero(size == z)
        room = np.maximum(lack, 0)
        shares_of = np.where(room.sum(0) > 0, room / np.maximum(room.sum(0), 1e-300), p[:, None])  # of the rows, of each kind
        mix = b[own, :3] @ shares_of[:, 1:].T
        mix = mix / np.maximum(mix.sum(1, keepdims=True), 1e-300) if z else np.tile(p, (len(own), 1))
        out[own] = class_flow(b[own, 3], max(z, 1), shares_of[:, 0] * z * b[own, 3].sum(), mix * b[own, 3][:, None], np.maximum(1.0, quota[:, 0]))
        lack -= out[own].T @ vec[own]
    _exchange(out, vec, -lack, 1 / np.maximum(1.0, quota))
    return out.tolist()


def assigned(rows: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """The rows of with_components() with their split; targets: split, target_share (a few rows, shares are scaled to 1)."""
    spark = rows.sparkSession
    names, shares = wanted_shares(targets)
    sizes = rows.groupBy("component").agg(*(F.count(F.when(F.col("kind") == x, 1)).alias(x) for x in KINDS))
    perm = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("component").cast("string")))
    sizes = cut(sizes.withColumn("perm", perm).withColumn("range", F.conv(F.substring("perm", 1, 3), 16, 10).cast("int")))
    bundles = sizes.groupBy(*KINDS).agg(F.count(F.lit(1)).alias("n")).orderBy(*KINDS).limit(MAX_BUNDLES + 1).collect()
    if len(bundles) > MAX_BUNDLES:
        raise ValueError(f"more than {MAX_BUNDLES} distinct component profiles")
    counts = flow([tuple(b) for b in bundles], shares) if bundles and names else []
    plan = []
    for b, given in zip(bundles, counts, strict=True):
        at = 0
        for s, n in zip(names, given, strict=True):
            if n:
                plan.append((*b[:3], s, at, at + n))
            at += n
    plan = spark.createDataFrame(plan, "fire long, nofire long, none long, split string, begin long, end long")
    hist = sizes.groupBy(*KINDS, "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*KINDS).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    place = F.col("before") + F.row_number().over(Window.partitionBy(*KINDS, "range").orderBy("perm", "component")) - 1
    placed = sizes.join(hist.withColumn("before", before).drop("n"), [*KINDS, "range"]).withColumn("place", place)
    chosen = placed.join(plan, KINDS).where("place >= begin and place < end").select("component", "split")
    return rows.join(chosen, "component")


def wanted_shares(targets: DataFrame) -> tuple[list[str], list[float]]:
    """Names of the splits in order and their shares, scaled to 1."""
    wanted = [(r[0], float(r[1])) for r in targets.where("target_share > 0").groupBy("split").agg(F.max("target_share")).orderBy("split").collect()]
    whole = sum(w[1] for w in wanted)
    return [w[0] for w in wanted], [w[1] / whole for w in wanted]


def grouped_split(rows: DataFrame, targets: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(label_id, component, split) of each record and the report (split, target, reached shares of rows and labels).

    rows: with_components(); targets: split, target_share.
    """
    names, shares = wanted_shares(targets)
    out = assigned(rows, targets, seed).select("label_id", "component", "split", "kind")
    n = F.count(F.lit(1))
    got = out.groupBy("split").agg(n.alias("n_rows"), F.count(F.when(F.col("kind") == "fire", 1)).alias("n_fire"), F.countDistinct("component").alias("n_components"))
    goal = rows.sparkSession.createDataFrame(list(zip(names, shares, strict=True)), "split string, target_share double")
    all_ = Window.partitionBy(F.lit(0))  # one row per split
    report = goal.join(got, "split", "left").fillna(0, ["n_rows", "n_fire", "n_components"]).withColumn("share", F.try_divide("n_rows", F.sum("n_rows").over(all_))).withColumn("fire_share", F.try_divide("n_fire", "n_rows"))
    return out.drop("kind"), report


def broken_groups(rows: DataFrame) -> DataFrame:
    """(group_kind, group_key) of the groups whose rows lie in more than one delivered split.

    rows: assigned(). The allocation puts a group into one split, so every broken group has a row that the allocation moves out of its delivered split;
    the groups with such a row are the candidates, and their delivered splits are then compared exactly.
    """
    some = rows.where("delivered is not null").withColumn("moved", F.col("delivered") != F.col("split"))
    groups = F.array_compact(F.array(*(F.when(F.col(g).isNotNull(), F.struct(F.lit(g).alias("group_kind"), F.col(g).alias("group_key"))) for g in ("cell", "event"))))
    # max, min and max combine on the map side, so a hot group shuffles one row per task
    spans = some.select(F.explode(groups).alias("g"), "delivered", "moved").groupBy("g.group_kind", "g.group_key").agg(F.max("moved").alias("moved"), F.min("delivered").alias("x"), F.max("delivered").alias("y"))
    return spans.where("moved and x <> y").select("group_kind", "group_key")
