"""Ranks, bands, blends and ranking metrics over long candidate tables.

A candidate table has a row for each (split, row_index, pos); KEY names a query. Every function adds columns or aggregates; none collects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["split", "row_index"]
TOP_K, ABSENT_RANK = 20, 21
BANDS = (("top", 5, 1.0), ("mid", 10, 0.6), ("tail", None, 0.25))


def rank_by(df: DataFrame, *order: Column, name: str = "rank", key=None) -> DataFrame:
    """Row number within each query in the given order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(key or KEY)).orderBy(*order)))


def band(rank: Column) -> Column:
    return F.when(rank <= BANDS[0][1], BANDS[0][0]).when(rank <= BANDS[1][1], BANDS[1][0]).otherwise(BANDS[2][0])


def band_weight(rank: Column) -> Column:
    return F.when(rank <= BANDS[0][1], BANDS[0][2]).when(rank <= BANDS[1][1], BANDS[1][2]).otherwise(BANDS[2][2])


def minmax(value: Column, key=None) -> Column:
    """Value scaled to 0..1 within its query; 0.5 where all are equal."""
    w = Window.partitionBy(*(key or KEY))
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(F.abs(hi - lo) < 1e-12, F.lit(0.5)).otherwise((value - lo) / (hi - lo))


def rank_prior(rank: Column, k: int = TOP_K) -> Column:
    return (F.lit(float(k)) - rank + 1) / F.lit(float(k))


def gold_ranks(cands: DataFrame, queries: DataFrame, rank: str = "pos") -> DataFrame:
    """Each query with its gold's rank: the first place in the list, ABSENT_RANK where it isn't in the first TOP_K."""
    hit = cands.where((F.col("cand") == F.col("gold_id")) & (F.col(rank) <= TOP_K)).groupBy(*KEY).agg(F.min(rank).alias("hit"))
    return queries.join(hit, KEY, "left").withColumn("gold_rank", F.coalesce("hit", F.lit(ABSENT_RANK)).cast("int")).withColumn("present", F.col("hit").isNotNull()).drop("hit")


def reciprocal(rank: Column, present: Column, absent: str = "zero") -> Column:
    """Reciprocal rank. absent: zero (an absent gold counts 0), sentinel (1 / ABSENT_RANK) or raw (1 / rank whatever it is)."""
    return {"zero": F.when(present, 1.0 / rank).otherwise(0.0), "sentinel": F.when(present, 1.0 / rank).otherwise(1.0 / ABSENT_RANK), "raw": 1.0 / rank}[absent]


def ranking_metrics(ranked: DataFrame, by=("split",), absent: str = "zero") -> DataFrame:
    """Metrics of a table with gold_rank and present."""
    hit = lambda k: F.avg((F.col("present") & (F.col("gold_rank") <= k)).cast("double")).alias(f"hits_{k}")
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n_queries"),
        F.avg(F.col("present").cast("double")).alias("gold_at_20"),
        F.avg(reciprocal(F.col("gold_rank"), F.col("present"), absent)).alias("mrr"),
        F.avg(F.when(F.col("present"), 1.0 / F.col("gold_rank"))).alias("mrr_present"),
        hit(1), hit(3), hit(10), hit(20),
        F.avg(F.col("gold_rank").cast("double")).alias("avg_rank"),
        F.sum((F.col("gold_rank") == ABSENT_RANK).cast("long")).alias("rank21"),
    )


def top1_dominance(cands: DataFrame, rank: str = "pos", by=("split",)) -> DataFrame:
    """How many answers come first, and the share of the commonest of them."""
    n = cands.where(F.col(rank) == 1).groupBy(*by, "cand").agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.count("*").alias("unique_top1"), (F.max("n") / F.sum("n")).alias("dominance"))


def flags_at(df: DataFrame, flag: str, ks, rank: str = "pos", by=("split",)) -> DataFrame:
    """For each k: the share of flagged candidates in the first k, of queries with one, and their mean number."""
    per = df.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col(rank) <= F.col("k")).groupBy(*dict.fromkeys([*by, *KEY, "k"])).agg(F.sum(F.col(flag).cast("int")).alias("bad"), F.count("*").alias("n"))
    return per.groupBy(*by, "k").agg((F.sum("bad") / F.sum("n")).alias("rate"), F.avg((F.col("bad") > 0).cast("double")).alias("any_rate"), F.avg(F.col("bad").cast("double")).alias("mean_count"))


def order_match(a: DataFrame, b: DataFrame, k: int = TOP_K) -> DataFrame:
    """Queries of two ranked tables (KEY, cand, rank): do they agree wholly, in the first 5, in the first?"""
    both = a.select(*KEY, F.col("rank").alias("rank"), F.col("cand").alias("ca")).join(b.select(*KEY, F.col("rank"), F.col("cand").alias("cb")), [*KEY, "rank"], "full").where(F.col("rank") <= k)
    same = F.col("ca").eqNullSafe(F.col("cb"))
    return both.groupBy(*KEY).agg(F.min(same.cast("int")).alias("exact"), F.min(F.when(F.col("rank") <= 5, same.cast("int"))).alias("top5"), F.min(F.when(F.col("rank") == 1, same.cast("int"))).alias("top1"))


def best_of(df: DataFrame, *order: Column, by=()) -> DataFrame:
    """The first row of each group in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order))).where("_n = 1").drop("_n")
