"""Sweeps of re-ranking settings: every setting's scores as one array per row of candidates, and the gold's rank by each in one pass.

A row's candidates (a list of bounded length) are gathered once. For every setting (beta, weight, gamma) their support e - beta * d - gamma * x is scaled to 0..1 within the row and blended with the prior of the
old place, which sorts them anew; the gold's place and the first candidate are read from that. So what leaves a row is two numbers for a setting, and rows are
never multiplied by settings.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import KEY, TOP_K


def grid(betas, weights, gammas) -> list[tuple[float, float, float]]:
    return list(product(betas, weights, gammas))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _scored(c: Column, setting: Column, k: int) -> Column:
    """The candidates of a row (cand, pos, e, d, x) as (final, support, pos, cand) in a form whose order is the new one: least first."""
    support = F.transform(c, lambda y: y["e"] - setting["beta"] * y["d"] - setting["gamma"] * y["x"])
    norm = lambda s, m: F.when(F.abs(m["hi"] - m["lo"]) < 1e-12, F.lit(0.5)).otherwise((s - m["lo"]) / (m["hi"] - m["lo"]))
    final = lambda y, s, m: setting["weight"] * ((F.lit(float(k)) - y["pos"] + 1) / F.lit(float(k))) + (F.lit(1.0) - setting["weight"]) * norm(s, m)
    one = lambda y, s, m: F.struct((-F.round(final(y, s, m), 9)).alias("f"), (-F.round(s, 9)).alias("s"), y["pos"].alias("pos"), y["cand"].alias("cand"))
    ends = lambda v: F.struct(F.array_min(v).alias("lo"), F.array_max(v).alias("hi"))
    return _let(support, lambda v: _let(ends(v), lambda m: F.zip_with(c, v, lambda y, s: one(y, s, m))))


def swept(cands: DataFrame, settings: list[tuple], k: int = TOP_K) -> DataFrame:
    """(KEY, gold_id, setting, rank, top): by each setting (its number) the gold's rank, k + 1 where it is no candidate, and the candidate that comes first. cands: KEY, gold_id, pos, cand, e, d, x."""
    rows = cands.groupBy(*KEY, "gold_id").agg(F.array_sort(F.collect_list(F.struct("pos", "cand", "e", "d", "x"))).alias("c"))
    # Rows are few bytes but much work, so they are dealt out, and not put together by their size.
    rows = rows.repartition(int(cands.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY)
    each = F.array(*[F.struct(F.lit(n).alias("setting"), F.lit(float(b)).alias("beta"), F.lit(float(w)).alias("weight"), F.lit(float(g)).alias("gamma")) for n, (b, w, g) in enumerate(settings)])
    # Of one setting's new order the gold's place and the first candidate are read; the order itself is worked out once.
    place = lambda y: F.struct(F.array_position(F.transform(y, lambda v: v["cand"]), F.col("gold_id")).alias("rank"), F.get(y, F.lit(0))["cand"].alias("top"))
    placed = rows.select(*KEY, "gold_id", F.transform(each, lambda s: F.struct(s["setting"].alias("setting"), _let(F.sort_array(_scored(F.col("c"), s, k)), place).alias("at"))).alias("p"))
    return placed.select(*KEY, "gold_id", F.explode("p").alias("v")).select(*KEY, "gold_id", "v.setting", F.when(F.col("v.at.rank") > 0, F.col("v.at.rank").cast("int")).otherwise(k + 1).alias("rank"), F.col("v.at.top").alias("top"))


def metrics(ranks: DataFrame, by: list[str], k: int = TOP_K) -> DataFrame:
    """mrr, hits_10 and dominance (the share of the commonest first candidate) for each value of by."""
    hit = F.col("rank") <= k
    m = ranks.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.when(hit, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"), F.avg((F.col("rank") <= 10).cast("double")).alias("hits_10"))
    tops = ranks.groupBy(*by, "top").agg(F.count("*").alias("t")).groupBy(*by).agg((F.max("t") / F.sum("t")).alias("dominance"))
    return m.join(tops, by)


def choose(swept_metrics: DataFrame, raw: DataFrame, top1: float, ratio: float, by: list[str]) -> DataFrame:
    """For each value of by the setting of best mrr (then hits_10, least dominance, first setting) among those of dominance at most top1 and mrr at least ratio times the raw one; among all, balanced false, where none is."""
    m = swept_metrics.join(raw.select(*by, F.col("mrr").alias("raw_mrr")), by)
    m = m.withColumn("balanced", (F.col("dominance") <= top1) & (F.col("mrr") >= F.col("raw_mrr") * ratio))
    r = lambda c: F.round(c, 9)
    w = Window.partitionBy(*by).orderBy(F.desc("balanced"), F.desc(r("mrr")), F.desc(r("hits_10")), r("dominance"), "setting")
    return m.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
