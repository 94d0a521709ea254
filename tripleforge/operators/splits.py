"""Samples, draws and dense ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

def dense_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """Numbers from 0 in the order of a column of distinct values: ranges are sorted apart, and numbers within ranges move by the sizes of those before. The ranges are drawn once, and written."""
    parts = written(df.repartitionByRange(column).withColumn("_p", F.spark_partition_id()), "ranges")
    within = F.row_number().over(Window.partitionBy("_p").orderBy(column))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"), F.min(column).alias("_first"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    return parts.withColumn("_k", within).join(F.broadcast(before), "_p").withColumn(name, F.col("_k") + F.col("_before") - 1).drop("_p", "_k", "_before")


def drawn(seed: int, *key: Column) -> Column:
    """A number of 52 bits for a key: the head of its MD5, so that other engines draw the same."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def drawn_sql(seed: int, *key: str) -> str:
    """drawn() in DuckDB's SQL."""
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(key)})), 1, 13))::BIGINT"


def fixed_sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """The n rows of least draw, or all."""
    return df.orderBy(drawn(seed, *[F.col(c) for c in df.columns]), *df.columns).limit(n)


def negatives(positives: DataFrame, candidates: DataFrame, entities: DataFrame, target: str, seed: int) -> DataFrame:
    """One corrupted triple for each positive (h, r, t): of the target relation always the head, of others the head or the tail by the toss of a draw. A head comes from the candidates (h), a tail from all entities (t), each numbered in order."""
    hs = dense_ids(candidates.distinct(), "h", "i").withColumnRenamed("h", "new_h")
    ts = dense_ids(entities.distinct(), "t", "j").withColumnRenamed("t", "new_t")
    sizes = hs.agg(F.count("*").alias("nh")).crossJoin(ts.agg(F.count("*").alias("nt")))
    key = [F.col("h"), F.col("r"), F.col("t")]
    head = (F.col("r") == target) | (drawn(seed, *key) % 2 == 0)
    p = positives.select("h", "r", "t", head.alias("head")).crossJoin(F.broadcast(sizes))
    p = p.withColumn("i", F.when(F.col("head"), drawn(seed + 1, *key) % F.col("nh"))).withColumn("j", F.when(~F.col("head"), drawn(seed + 2, *key) % F.col("nt")))
    j = p.join(hs, "i", "left").join(ts, "j", "left")
    return j.select(F.coalesce("new_h", "h").alias("h"), "r", F.coalesce("new_t", "t").alias("t"), F.col("h").alias("from_h"), F.col("t").alias("from_t"))


def balanced(triples: DataFrame, condition: Column, n: int, seed: int) -> DataFrame:
    """n draws with replacement from the triples (h, r, t) for which the condition holds, and n from the others: (draw, is_target, h, r, t)."""
    out = None
    for side, rows in ((True, triples.where(condition)), (False, triples.where(~condition))):
        numbered = dense_ids(rows.select(F.struct("h", "r", "t").alias("key")), "key", "i")
        size = numbered.agg(F.count("*").alias("n"))
        draws = rows.sparkSession.range(n).crossJoin(size).where("n > 0").select(F.col("id").alias("draw"), (drawn(seed + int(side), F.col("id")) % F.col("n")).alias("i"))
        got = draws.join(numbered, "i").select("draw", F.lit(side).alias("is_target"), "key.h", "key.r", "key.t")
        out = got if out is None else out.unionByName(got)
    return out
