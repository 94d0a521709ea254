"""An index of edges by node: every edge from either end, in buckets by node and sorted within them.

What meets the edges on a node (neighbours, bridges, steps of paths) is moved to the buckets; the edges are read where they are and never shuffled. Changes are tables of their own in the same
buckets, met when the edges are read: taken edges by an anti join within buckets, new ones by a union of equal buckets; compact() writes them into the index.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

COLUMNS = ["src", "dst", "h", "r", "t"]


def _ends(edges: DataFrame) -> DataFrame:
    """Every edge from either end; a self-loop once."""
    there = edges.select(F.col("h").alias("src"), F.col("t").alias("dst"), "h", "r", "t")
    return there.unionByName(edges.where("h <> t").select(F.col("t").alias("src"), F.col("h").alias("dst"), "h", "r", "t"))


class Adjacency:
    """Rows (src, dst, h, r, t) by src."""

    def __init__(self, spark: SparkSession, tables: list[str], taken: list[str], buckets: int):
        self.spark, self.tables, self.taken, self.buckets = spark, tables, taken, buckets

    @classmethod
    def of(cls, edges: DataFrame, buckets: int | None = None) -> Adjacency:
        """The index of edges (h, r, t). buckets: as many as shuffles have partitions, where it is not given."""
        spark = edges.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        return cls(spark, [_bucketed(_ends(edges), buckets)], [], buckets)

    def rows(self) -> DataFrame:
        """All edges as they are now."""
        out = None
        for name in self.tables:
            t = self.spark.table(name)
            out = t if out is None else out.unionByName(t)
        for name in self.taken:
            out = out.join(self.spark.table(name), COLUMNS, "left_anti")
        return out

    def changed(self, added: DataFrame, removed: DataFrame) -> Adjacency:
        """The index after edges (h, r, t) went and came; an edge in both stays once. Nothing but the changes is written."""
        spark = self.spark
        out = _bucketed(_ends(removed.unionByName(added)).distinct(), self.buckets)
        here = Adjacency(spark, self.tables, [*self.taken, out], self.buckets)
        # What came is no older than what went, so it is read beside the rest, not through the anti joins.
        return _Grown(here, [_bucketed(_ends(added.distinct()), self.buckets)])

    def compact(self) -> Adjacency:
        """The same edges in one table."""
        return Adjacency(self.spark, [_bucketed(self.rows(), self.buckets)], [], self.buckets)

    def drop(self) -> None:
        for name in [*self.tables, *self.taken]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


class _Grown(Adjacency):
    """An index with edges that came after others went."""

    def __init__(self, base: Adjacency, tables: list[str]):
        super().__init__(base.spark, tables, [], base.buckets)
        self.base = base

    def rows(self) -> DataFrame:
        return self.base.rows().unionByName(super().rows())

    def changed(self, added: DataFrame, removed: DataFrame) -> Adjacency:
        return self.compact().changed(added, removed)


def _bucketed(rows: DataFrame, buckets: int) -> str:
    """Writes rows by src to the shared folder; the table's name."""
    name = f"adjacency_{uuid.uuid4().hex}"
    by = rows.select(*COLUMNS).repartition(buckets, "src")
    by.write.bucketBy(buckets, "src").sortBy("src", "dst", "r").option("path", store.scratch(rows.sparkSession, name)).format("parquet").saveAsTable(name)
    return name
