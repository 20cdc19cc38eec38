"""Mixing sources to target weights by iterative proportional fitting.

Every source should give its weight of a total number of tokens, no document being used more often than its source's
cap. Token masses of (source, language, topic) cells are raked: cell multipliers are scaled in turn to the corpus's own
language and topic shares and, last and exactly, to the source targets; a multiplier never exceeds the source's cap, and
what a capped cell can't give is taken from the source's other cells. A source whose cells the fit has all at the cap may be unreachable; its
whole token counts confirm it. The report of margins gives the shares of languages and topics that were fitted and reached. A document's multiplier is its expected number of
uses: the whole part is certain, the fraction is drawn by a seeded hash, and one threshold per source, found in a histogram
of 4,096 bins, brings the drawn tokens as near to the target as the bins allow.

Languages are two-letter codes or und, topics the names of a fixed catalog or other, so the number of cells is bounded by
sources x 677 x (topics + 1) whatever the data; only cells and histograms reach the driver.

Sources are read without outer spaces and case. Documents of null or untargeted sources, and null or empty texts (0 tokens),
are never used. Repeated rows count and are drawn as delivered. Targets with null weight, cap or total count as 0.
A source without documents reaches 0. Empty tables give no documents and a report of what can't be reached.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from celldays.functions.reading import source_of
from celldays.llm.tokens import LEAF, encode
from celldays.session import cut

BINS = 4096
MAX_SOURCES = 10_000
#: fixed values: three-letter language codes and their two-letter forms
THREE = "eng en deu de ger de fra fr fre fr spa es zho zh chi zh jpn ja kor ko rus ru hin hi tha th ara ar amh am ell el gre el por pt ita it nld nl pol pl tur tr vie vi".split()
REPORT = "source string, target_weight double, max_repeat int, target_tokens double, available_tokens long, reachable_tokens long, fitted_tokens double, used_tokens long, used_share double, reached_share double, unreachable boolean"


def language_of(c: Column) -> Column:
    """Two-letter code of a language tag in any case and form (de, DE, de_AT, deu); und for everything else."""
    tag = F.lower(F.regexp_extract(F.trim(c), r"^([A-Za-z]{2,3})(?:$|[-_])", 1))
    known = F.create_map(*(F.lit(x) for x in THREE))
    return F.coalesce(F.when(F.length(tag) == 2, tag).when(F.length(tag) == 3, F.try_element_at(known, tag)), F.lit("und"))


def topic_of(path: Column, topics: list[str]) -> Column:
    """The catalog name at the start of a notebook's file name (nb/erc_179.ipynb: erc), else other."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:_\d+)?(?:\.\w+)?$", 1)
    return F.when(stem.isin(topics), stem).otherwise(F.lit("other"))


def level(m: np.ndarray, mass: np.ndarray, cap: float, target: float) -> np.ndarray:
    """The multipliers min(x m, cap) with the x at which they give the target, or the cap everywhere where that can't give it."""
    if target >= cap * mass.sum() or not (m * mass).sum():
        return np.full_like(m, cap)
    turn = np.where(m > 0, cap / np.where(m > 0, m, 1.0), np.inf)  # x at which a cell reaches the cap
    order = np.argsort(turn)
    held = np.concatenate([[0.0], np.cumsum(cap * mass[order])])  # of the cells at the cap
    rest = (m * mass).sum() - np.concatenate([[0.0], np.cumsum((m * mass)[order])])
    # the first number of capped cells whose x stays below the next cell's turn
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (target - held) / rest
    fits = np.flatnonzero(x[:-1] <= turn[order])
    return np.minimum(x[fits[0]] * m, cap) if len(fits) else np.full_like(m, cap)


def rake(cells: list[tuple[int, int, int]], mass: np.ndarray, source: np.ndarray, cap: np.ndarray, language: np.ndarray, topic: np.ndarray, rounds: int = 100, tol: float = 1e-9) -> np.ndarray:
    """Multipliers of the cells (places of source, language and topic) with 0 <= m <= cap of the source; ends when none changes by more than tol, or after ``rounds``.

    source: target tokens, met exactly where the cap allows; language, topic: target shares, met as far as the caps and
    the source targets allow.
    """
    s, by = np.array([c[0] for c in cells], dtype=np.int64), {k: np.array([c[k] for c in cells], dtype=np.int64) for k in (1, 2)}
    m = np.ones(len(cells))
    own = [np.flatnonzero(s == i) for i in range(len(source))]
    for _ in range(rounds):
        old = m.copy()
        for axis, share in ((1, language), (2, topic)):
            now = np.bincount(by[axis], m * mass, len(share)).astype(float)
            f = np.divide(share * now.sum(), now, out=np.ones_like(now), where=now > 0)
            m = np.minimum(m * np.clip(f, 1e-6, 1e6)[by[axis]], cap[s])
        for i, at in enumerate(own):
            if len(at):
                m[at] = level(m[at], mass[at], cap[i], source[i])
        if np.abs(m - old).max(initial=0) < tol:
            break
    return m


def counted(docs: DataFrame, targets: DataFrame, topics: list[str], path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """(doc_id, source, language, topic, n_tokens) of the documents of targeted sources, checkpointed: texts are encoded once."""
    named = docs.withColumn("_source", source_of("source")).join(F.broadcast(targets.select(source_of("source").alias("_source")).distinct()), "_source", "left_semi")
    packed = F.struct("doc_id", F.col("_source").alias("source"), language_of(F.col("lang")).alias("language"), topic_of(F.col("path"), topics).alias("topic"))
    rows = named.select(F.to_json(packed).alias("about"), "text")
    out = encode(rows, "about", "text", path, leaf, count=True)
    about = F.from_json("about", "doc_id bigint, source string, language string, topic string")
    return cut(out.select(about.alias("x"), "n_tokens").select("x.*", "n_tokens"))


def mix(tokens: DataFrame, targets: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, source, language, topic, n_tokens, copies) of the used documents, the report of every target, and that of every language and topic.

    tokens: counted(); targets: source, target_weight, max_repeat, total_tokens (at most MAX_SOURCES rows, as checked).
    """
    spark = tokens.sparkSession
    wanted = targets.withColumn("key", source_of("source")).dropDuplicates(["key"]).orderBy("key").limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    place = {w["key"]: i for i, w in enumerate(wanted)}
    rows = [c for c in tokens.groupBy("source", "language", "topic").agg(F.sum("n_tokens").alias("n")).orderBy("source", "language", "topic").collect() if c["n"]]
    langs, tops = ({x: i for i, x in enumerate(sorted({c[k] for c in rows}))} for k in ("language", "topic"))
    cells = [(place[c["source"]], langs[c["language"]], tops[c["topic"]]) for c in rows]
    exact = [0] * len(wanted)
    for c in rows:
        exact[place[c["source"]]] += c["n"]
    mass, whole = np.array([float(c["n"]) for c in rows]), sum(exact)
    share = {k: np.bincount([c[k] for c in cells], mass, n) / max(1, whole) if cells else np.zeros(n) for k, n in ((1, len(langs)), (2, len(tops)))}
    goal = [(w["target_weight"] or 0.0) * (w["total_tokens"] or 0) for w in wanted]
    cap = np.array([float(w["max_repeat"] or 0) for w in wanted])
    m = rake(cells, mass, np.minimum(np.array(goal), np.array(exact) * cap), cap, share[1], share[2])
    fitted = np.bincount([c[0] for c in cells], m * mass, len(wanted)) if cells else np.zeros(len(wanted))
    plan = spark.createDataFrame([(c["source"], c["language"], c["topic"], float(x), int(cap[place[c["source"]]])) for c, x in zip(rows, m, strict=True)], "source string, language string, topic string, m double, cap int")
    lot = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), "source")), 1, 13), 16, 10).cast("double") / float(16**13)
    sure = F.floor(F.col("m") + 1e-9)
    fate = lot - (F.col("m") - sure)
    # the plan has one row per cell, sources x 677 languages x topics at most
    lots = tokens.where("n_tokens > 0").join(F.broadcast(plan), ["source", "language", "topic"]).withColumn("whole", sure).withColumn("fate", fate).withColumn("bin", F.floor((F.col("fate") + 1) / 2 * BINS))
    hist = lots.groupBy("source", "bin").agg(F.sum(F.col("n_tokens") * F.col("whole")).alias("sure"), F.sum(F.when(F.col("whole") < F.col("cap"), F.col("n_tokens")).otherwise(0)).alias("more")).orderBy("source", "bin").collect()
    edges = {}
    for key, own in groupby(hist, lambda h: h["source"]):
        own = list(own)
        got, target = sum(h["sure"] for h in own), goal[place[key]]
        best = (abs(got - target), -1, got)
        for h in own:
            got += h["more"]
            best = min(best, (abs(got - target), h["bin"], got))
        edges[key] = best[1:]
    line = spark.createDataFrame([(k, e[0]) for k, e in edges.items()], "source string, edge long")
    copies = (F.col("whole") + F.when((F.col("bin") <= F.col("edge")) & (F.col("whole") < F.col("cap")), 1).otherwise(0)).cast("int")
    chosen = lots.join(F.broadcast(line), "source").withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "language", "topic", "n_tokens", "copies")
    used = [int(edges.get(w["key"], (0, 0))[1]) for w in wanted]
    report = []
    for s, w in enumerate(wanted):
        # the fit shows where the caps bind in every cell; the whole numbers of tokens confirm
        bound = fitted[s] >= exact[s] * cap[s] * (1 - 1e-9)
        bad = bool(bound and exact[s] * int(cap[s]) < goal[s])
        reached = used[s] / w["total_tokens"] if w["total_tokens"] else 0.0
        report.append((w["source"], w["target_weight"], w["max_repeat"], float(goal[s]), exact[s], exact[s] * int(cap[s]), float(fitted[s]), used[s], used[s] / max(1, sum(used)), reached, bad))
    total = max(1e-300, float((m * mass).sum()))
    fit = [(kind, name, float(share[k][i]), float(sum(x * y for c, x, y in zip(cells, m, mass, strict=True) if c[k] == i) / total)) for k, kind, names in ((1, "language", langs), (2, "topic", tops)) for name, i in names.items()]
    margins = spark.createDataFrame(fit, "kind string, name string, target_share double, fitted_share double")
    n = F.sum(F.col("n_tokens") * F.col("copies"))
    got = chosen.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in ("language", "topic")))).alias("x"), "n_tokens", "copies").groupBy("x.kind", "x.name").agg(n.alias("used_tokens"))
    margins = margins.join(got, ["kind", "name"], "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0))).withColumn("used_share", F.col("used_tokens") / max(1, sum(used)))
    return chosen, spark.createDataFrame(report, REPORT), margins
