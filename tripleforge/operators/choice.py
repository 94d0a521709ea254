"""Choices among variants, comparisons of metric tables, and case buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_eligible(variants: DataFrame, eligible: Column, order, strict: bool = True) -> DataFrame:
    """The first eligible variant in an order. Without any: an error, or with strict off the first of all."""
    v = variants.withColumn("eligible", F.coalesce(eligible, F.lit(False)))
    best = v.orderBy(F.desc("eligible"), *order).limit(1)
    if not strict:
        return best
    fine = F.when(F.col("eligible"), F.col("variant")).otherwise(F.raise_error(F.lit("no variant is eligible")))
    return best.withColumn("variant", fine)


def versus(metrics: DataFrame, row: str, reference: str, by, columns) -> DataFrame:
    """metrics with the difference of each column from the reference row of the same group."""
    w = Window.partitionBy(*by)
    base = lambda c: F.max(F.when(F.col(row) == reference, F.col(c))).over(w)
    return metrics.select("*", *[(F.col(c) - base(c)).alias(f"delta_{c}") for c in columns])


def equal_metrics(a: DataFrame, b: DataFrame, keys, columns, within: float = 1e-12) -> DataFrame:
    """For each key whether all columns of two metric tables agree; a row that one lacks does not."""
    j = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns]).join(b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns]), keys, "full")
    same = F.lit(True)
    for c in columns:
        same = same & F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) < within, F.col(f"a_{c}").isNull() & F.col(f"b_{c}").isNull())
    return j.select(*keys, same.alias("equal"))


def bucketed(rows: DataFrame, buckets: dict[str, Column], order, cap: int) -> DataFrame:
    """Rows under each bucket whose condition they meet, the first `cap` of a bucket in its order, with their place."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in buckets.items()]), lambda x: x.isNotNull())
    w = Window.partitionBy("bucket").orderBy(*order)
    return rows.withColumn("bucket", F.explode(names)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)
