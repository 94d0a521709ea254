"""A knowledge graph over the star-schema tables, with the pieces that the ranking operators need.

Entities are numbers: 3 k + kind for key k, kind 0 a compound (supplier), 1 a gene (part), 2 a disease (customer). Edges are (h, r, t).
Each view is a plain DataFrame; nothing is collected, and Catalyst prunes what a query does not use.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.splits import dense_ids
from . import store
from .adjacency import Adjacency

TOP_K, ABSENT_RANK, NEXT_PARTS = 20, 21, 4
KINDS = ("Compound", "Gene", "Disease")


def view(build):
    """A method whose table is written once for each input folder."""
    @functools.wraps(build)
    def get(self, *args):
        return store.once(self.spark, self.sf_dir, "-".join([build.__name__.strip("_"), *map(str, args)]), lambda: build(self, *args))

    return get


def _compound_gene(lines: DataFrame) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "A", "CbG").when(F.col("l_returnflag") == "R", "CdG").otherwise("CuG")
    return lines.select(F.col("c").alias("h"), flag.alias("r"), F.col("g").alias("t")).distinct()


def _disease_gene(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("d").alias("h"), F.when(F.col("l_linestatus") == "F", "DaG").otherwise("DdG").alias("r"), F.col("g").alias("t")).distinct()


class Graph:
    """Views over one folder of tables. Edges, splits, queries and candidates are written at their first use, as the later steps of a run all start from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @view
    def lines(self) -> DataFrame:
        """Order lines with the three entities they touch; all views of two or three kinds start from them."""
        return self._lines()

    def _lines(self, of_line=lambda x: x, of_order=lambda x: x) -> DataFrame:
        """lines() from those of the lines and orders only that are asked for: no others are moved, and nothing is written."""
        line = self.table("lineitem").select("l_orderkey", (F.col("l_suppkey") * 3).alias("c"), (F.col("l_partkey") * 3 + 1).alias("g"), "l_returnflag", "l_linestatus", "l_discount")
        order = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") * 3 + 2).alias("d"), "o_orderpriority")
        return of_line(line).join(of_order(order), "l_orderkey")

    @view
    def compound_gene(self) -> DataFrame:
        return _compound_gene(self.lines())

    @view
    def disease_gene(self) -> DataFrame:
        return _disease_gene(self.lines())

    def compound_gene_at(self, compounds: DataFrame) -> DataFrame:
        """compound_gene() of some compounds (h). Where the whole table is not written yet, other compounds' lines are not moved."""
        if store.has(self.spark, self.sf_dir, "compound_gene"):
            return self.compound_gene().join(compounds, "h", "left_semi")
        return _compound_gene(self._lines(of_line=lambda x: x.join(compounds.withColumnRenamed("h", "c"), "c", "left_semi")))

    def disease_gene_at(self, diseases: DataFrame) -> DataFrame:
        """disease_gene() of some diseases (h). Where the whole table is not written yet, other diseases' orders are not moved."""
        if store.has(self.spark, self.sf_dir, "disease_gene"):
            return self.disease_gene().join(diseases, "h", "left_semi")
        return _disease_gene(self._lines(of_order=lambda x: x.join(diseases.withColumnRenamed("h", "d"), "d", "left_semi")))

    @view
    def gene_gene(self) -> DataFrame:
        """Every part with the next NEXT_PARTS parts of its brand and size, so edges grow with the parts."""
        part = self.table("part").select((F.col("p_partkey") * 3 + 1).alias("h"), "p_brand", "p_size")
        w = Window.partitionBy("p_brand", "p_size").orderBy("h")
        part = part.select("h", F.array(*[F.lead("h", k).over(w) for k in range(1, NEXT_PARTS + 1)]).alias("next"))
        return part.select("h", F.explode("next").alias("t")).where("t is not null").select("h", F.lit("GiG").alias("r"), "t")

    @view
    def cliques(self) -> DataFrame:
        """(gene, p_brand, p_size): all parts of one brand and size are linked with each other. Their links grow with the square of a group, so they are counted by groups and never listed."""
        return self.table("part").select((F.col("p_partkey") * 3 + 1).alias("gene"), "p_brand", "p_size").where("p_brand is not null and p_size is not null")

    def lone_edges(self) -> DataFrame:
        """The training graph but for its gene-gene edges."""
        return self.compound_gene().unionByName(self.disease_gene()).unionByName(self.auxiliary()).unionByName(self.train())

    @view
    def _pairs(self) -> DataFrame:
        """Compounds and diseases of discounted lines: flag A of priority 1 are failed (CfD), flag R treat (CtD) or palliate (CpD) by priority 1 or 2."""
        # What no kind is made of is left out before lines meet orders.
        lines = self._lines(lambda x: x.where((F.col("l_discount") >= 0.09) & F.col("l_returnflag").isin("A", "R")), lambda x: x.where(F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2")))
        kind = F.when(F.col("l_returnflag") == "A", F.when(F.col("o_orderpriority").startswith("1"), "CfD")).when(F.col("l_returnflag") == "R", F.when(F.col("o_orderpriority").startswith("1"), "CtD").when(F.col("o_orderpriority").startswith("2"), "CpD"))
        return lines.select(F.col("c").alias("h"), kind.alias("r"), F.col("d").alias("t")).where("r is not null").distinct()

    @view
    def target(self) -> DataFrame:
        """Target triples with their split."""
        fold = ((F.col("h") / 3).cast("long") * 31 + (F.col("t") / 3).cast("long")) % 10
        return self._pairs().where("r = 'CtD'").withColumn("split", F.when(fold == 0, "test").when(fold == 1, "valid").otherwise("train"))

    def auxiliary(self) -> DataFrame:
        return self._pairs().where("r = 'CpD'")

    def failed(self) -> DataFrame:
        """Pairs that failed: diagnostics, no part of edges()."""
        return self._pairs().where("r = 'CfD'")

    def train(self) -> DataFrame:
        return self.target().where("split = 'train'").select("h", "r", "t")

    def edges(self) -> DataFrame:
        """The training graph: all relations, of the target only its training triples."""
        return self.compound_gene().unionByName(self.disease_gene()).unionByName(self.gene_gene()).unionByName(self.auxiliary()).unionByName(self.train())

    def edges_of(self, name: str) -> DataFrame:
        """The edges of a graph by its name, as in adjacency()."""
        return self.edges() if name == "train" else self.train().unionByName(self.failed()).unionByName(self.compound_gene()).unionByName(self.gene_gene())

    def adjacency(self, name: str = "train") -> Adjacency:
        """A graph by node, written once: train, the training graph, or status, its compounds with approved and failed pairs."""
        return store.kept(self.spark, self.sf_dir, f"adjacency-{name}", lambda: Adjacency.of(self.edges_of(name)))

    def nodes(self) -> DataFrame:
        each = [self.table(t).select((F.col(key) * 3 + k).alias("id"), F.lit(KINDS[k]).alias("kind"), F.col(name).alias("name")) for k, (t, key, name) in enumerate((("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("customer", "c_custkey", "c_name")))]
        return each[0].unionByName(each[1]).unionByName(each[2])

    @view
    def queries(self) -> DataFrame:
        """One row for each held-out triple: split, row_index (in the order of t, h), query_id (the disease), gold_id (the compound)."""
        out = None
        for split in ("test", "valid"):
            held = self.target().where(F.col("split") == split).select("split", F.struct("t", "h").alias("place"))
            rows = dense_ids(held, "place", "row_index").select("split", F.col("row_index").cast("long").alias("row_index"), F.col("place.t").alias("query_id"), F.col("place.h").alias("gold_id"))
            out = rows if out is None else out.unionByName(rows)
        return out

    @view
    def popularity(self) -> DataFrame:
        """Compounds by their number of training triples. The candidate universe: its size is that of the compounds in the target relation."""
        return self.train().groupBy(F.col("h").alias("cand")).agg(F.count("*").alias("score"))

    @view
    def ranked(self) -> DataFrame:
        """The universe with its place (from 1) by popularity."""
        keyed = self.popularity().select("cand", "score", F.struct((-F.col("score")).alias("m"), "cand").alias("by"))
        return dense_ids(keyed, "by", "n").select("cand", "score", (F.col("n") + 1).cast("long").alias("place"))

    @view
    def candidates(self, k: int = TOP_K) -> DataFrame:
        """The k most popular compounds for each query that are not its training answers: (split, row_index, query_id, gold_id, pos, cand, score).

        A query with n training answers finds its k among the first k + n places, so it meets no more than these.
        """
        q, known = self.queries(), self.train().select(F.col("t").alias("query_id"), F.col("h").alias("cand"))
        n = known.groupBy("query_id").agg(F.count("*").alias("n"))
        places = q.join(n, "query_id", "left").withColumn("place", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("n", F.lit(0)) + k)))
        open_ = places.join(self.ranked(), "place").join(known, ["query_id", "cand"], "left_anti")
        w = Window.partitionBy("split", "row_index").orderBy("place")
        return open_.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).select("split", "row_index", "query_id", "gold_id", "pos", "cand", "score")


#: The same views in DuckDB's SQL, for queries that begin with WITH.
SQL = f"""
li AS MATERIALIZED (SELECT l_suppkey*3 AS c, l_partkey*3+1 AS g, o_custkey*3+2 AS d, l_returnflag, l_linestatus, l_discount, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cg AS (SELECT DISTINCT c AS h, CASE l_returnflag WHEN 'A' THEN 'CbG' WHEN 'R' THEN 'CdG' ELSE 'CuG' END AS r, g AS t FROM li),
dg AS (SELECT DISTINCT d AS h, CASE l_linestatus WHEN 'F' THEN 'DaG' ELSE 'DdG' END AS r, g AS t FROM li),
pn AS (SELECT p_partkey*3+1 AS g, p_brand, p_size, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS n FROM part),
gg AS (SELECT a.g AS h, 'GiG' AS r, b.g AS t FROM pn a JOIN pn b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND b.n - a.n BETWEEN 1 AND {NEXT_PARTS}),
target AS MATERIALIZED (SELECT h, r, t, CASE (h//3*31 + t//3) % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END AS split FROM (SELECT DISTINCT c AS h, 'CtD' AS r, d AS t FROM li WHERE l_returnflag = 'R' AND o_orderpriority LIKE '1%' AND l_discount >= 0.09)),
aux AS (SELECT DISTINCT c AS h, 'CpD' AS r, d AS t FROM li WHERE l_returnflag = 'R' AND o_orderpriority LIKE '2%' AND l_discount >= 0.09),
failed AS (SELECT DISTINCT c AS h, 'CfD' AS r, d AS t FROM li WHERE l_returnflag = 'A' AND o_orderpriority LIKE '1%' AND l_discount >= 0.09),
train AS (SELECT h, r, t FROM target WHERE split = 'train'),
edges AS MATERIALIZED (SELECT * FROM cg UNION ALL SELECT * FROM dg UNION ALL SELECT * FROM gg UNION ALL SELECT * FROM aux UNION ALL SELECT * FROM train),
nodes AS (SELECT s_suppkey*3 AS id, 'Compound' AS kind, s_name AS name FROM supplier UNION ALL SELECT p_partkey*3+1, 'Gene', p_name FROM part UNION ALL SELECT c_custkey*3+2, 'Disease', c_name FROM customer),
q AS MATERIALIZED (SELECT split, row_number() OVER (PARTITION BY split ORDER BY t, h) - 1 AS row_index, t AS query_id, h AS gold_id FROM target WHERE split <> 'train'),
pop AS (SELECT h AS cand, count(*) AS score FROM train GROUP BY h),
cand AS MATERIALIZED (SELECT * FROM (SELECT q.*, row_number() OVER (PARTITION BY split, row_index ORDER BY score DESC, cand) AS pos, cand, score FROM q, pop WHERE NOT EXISTS (SELECT 1 FROM train WHERE train.h = cand AND train.t = q.query_id)) WHERE pos <= 20)
"""

_LINKS = SQL[SQL.index("pn AS (") : SQL.index("target AS ")]
#: The views with all gene-gene edges: every two parts of one brand and size.
WHOLE_SQL = SQL.replace(_LINKS, "gg AS (SELECT a.p_partkey*3+1 AS h, 'GiG' AS r, b.p_partkey*3+1 AS t FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey),\n")
