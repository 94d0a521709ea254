"""Support features of candidates, and the SQL that gives the same, shared by several queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import ranking as k
from ..sources import store
from ..sources.derived import SQL, WHOLE_SQL, Graph

CAND_GENES, BRIDGE_GENES, QUERY_GENES, BRIDGE_CAP = 120, 80, 300, 30
#: Genes of a candidate, those of them that bridges start from, genes of a query, bridges that count, and the bridges that count in full.
SETTINGS = {"D": (CAND_GENES, BRIDGE_GENES, QUERY_GENES, BRIDGE_CAP, 5), "E": (120, 120, 240, 40, 6)}


def gene_sets(kg: Graph, cand_genes: int = CAND_GENES, query_genes: int = QUERY_GENES, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Genes of compounds and of diseases; with pairs (a, b), of the a and the b only, written, as several steps start from them."""
    c, d = (x.select(F.col("h").alias("node"), F.col("t").alias("near")) for x in (kg.compound_gene(), kg.disease_gene()))
    if pairs is None:
        return g.neighbours(c, cand_genes), g.neighbours(d, query_genes)
    of = lambda x, end: x.join(pairs.select(F.col(end).alias("node")).distinct(), "node", "left_semi")
    return store.written(g.neighbours(of(c, "a"), cand_genes), "genes"), store.written(g.neighbours(of(d, "b"), query_genes), "genes")


def direct_degrees(kg: Graph) -> DataFrame:
    """(node, degree): distinct diseases of each compound over the training target and the auxiliary relation."""
    return kg.train().unionByName(kg.auxiliary()).groupBy(F.col("h").alias("node")).agg(F.countDistinct("t").alias("degree"))


def support_of(kg: Graph, cands: DataFrame, setting: tuple = SETTINGS["D"], whole: bool = False) -> DataFrame:
    """cands with shared, bridges, genes of either side, direct edge, degree share, evidence, penalty and support. whole: over all gene-gene edges."""
    cand_genes, bridge_genes, query_genes, bridge_cap, full = setting
    pairs = store.written(cands.select(F.col("cand").alias("a"), F.col("query_id").alias("b")).distinct(), "pairs")
    cg, dg = gene_sets(kg, cand_genes, query_genes, pairs)
    shared = g.shared(cg, dg, pairs)
    some = cg.where(F.col("place") <= bridge_genes)
    bridges = g.bridges_in_groups(some, dg, kg.cliques(), pairs, bridge_cap) if whole else g.bridges(some, dg, kg.gene_gene(), pairs, bridge_cap)
    direct = kg.auxiliary().select(F.col("h").alias("a"), F.col("t").alias("b"), F.lit(1).alias("direct"))
    n_c = cg.groupBy(F.col("node").alias("a")).agg(F.count("*").alias("cand_genes"))
    n_d = dg.groupBy(F.col("node").alias("b")).agg(F.count("*").alias("query_genes"))
    degrees = direct_degrees(kg)
    f = pairs.join(shared, ["a", "b"], "left").join(bridges, ["a", "b"], "left").join(direct, ["a", "b"], "left").join(n_c, "a", "left").join(n_d, "b", "left")
    f = f.join(degrees.withColumnRenamed("node", "a"), "a", "left").crossJoin(F.broadcast(g.degree_p95(degrees))).fillna(0)
    one = lambda x, by: F.least(F.lit(1.0), F.col(x) / F.lit(float(by)))
    evidence = 0.7 * one("shared", 2) + 0.2 * one("bridges", full) + 0.05 * (F.col("cand_genes") > 0).cast("int") + 0.05 * (F.col("query_genes") > 0).cast("int")
    penalty = F.greatest(F.col("direct").cast("double"), F.least(F.lit(1.0), F.col("degree") / F.col("p95")))
    f = f.withColumn("evidence", evidence).withColumn("penalty", penalty).withColumn("support", F.col("evidence") - 0.5 * F.col("penalty"))
    f = f.select(F.col("a").alias("cand"), F.col("b").alias("query_id"), "shared", "bridges", "cand_genes", "query_genes", "direct", "degree", "evidence", "penalty", "support")
    return cands.join(f, ["cand", "query_id"])


def soft_ranked(kg: Graph, whole: bool = False) -> DataFrame:
    """The candidates with their support and soft_rank: support, evidence, least penalty, place. Written once, as most later steps start from it. whole: over all gene-gene edges."""
    def build():
        return k.rank_by(support_of(kg, kg.candidates(), whole=whole), F.desc(F.round("support", 9)), F.desc(F.round("evidence", 9)), F.round("penalty", 9), "pos", name="soft_rank")

    return store.once(kg.spark, kg.sf_dir, "soft-whole" if whole else "soft", build)


def features_sql(setting: str = "D", sql: str = SQL) -> str:
    """The support features in SQL, by the constants of a setting, over the views that sql has."""
    cand_genes, bridge_genes, query_genes, bridge_cap, full = SETTINGS[setting]
    return sql + f""",
cgn AS (SELECT node, near, row_number() OVER (PARTITION BY node ORDER BY near) AS place FROM (SELECT DISTINCT h AS node, t AS near FROM cg) QUALIFY place <= {cand_genes}),
dgn AS (SELECT node, near, row_number() OVER (PARTITION BY node ORDER BY near) AS place FROM (SELECT DISTINCT h AS node, t AS near FROM dg) QUALIFY place <= {query_genes}),
pairs AS (SELECT DISTINCT cand AS a, query_id AS b FROM cand),
sh AS (SELECT a, b, count(*) AS shared FROM pairs JOIN cgn ON cgn.node = a JOIN dgn ON dgn.node = b AND dgn.near = cgn.near GROUP BY a, b),
gw AS (SELECT h AS x, t AS y FROM gg UNION ALL SELECT t, h FROM gg),
reach AS (SELECT node AS a, y, count(*) AS n FROM cgn JOIN gw ON x = near WHERE place <= {bridge_genes} GROUP BY node, y),
br AS (SELECT pairs.a, b, least(sum(n), {bridge_cap}) AS bridges FROM pairs JOIN dgn ON dgn.node = b JOIN reach ON reach.a = pairs.a AND reach.y = dgn.near GROUP BY pairs.a, b),
deg AS (SELECT h AS node, count(DISTINCT t) AS degree FROM (SELECT h, t FROM train UNION ALL SELECT h, t FROM aux) GROUP BY h),
p95 AS (SELECT greatest(coalesce(quantile_cont(degree, 0.95), 1.0), 1.0) AS p95 FROM deg WHERE degree > 0),
f0 AS (SELECT pairs.a AS cand, pairs.b AS query_id, coalesce(shared, 0) AS shared, coalesce(bridges, 0) AS bridges, coalesce(nc, 0) AS cand_genes, coalesce(nd, 0) AS query_genes, CASE WHEN aux.h IS NULL THEN 0 ELSE 1 END AS direct, coalesce(degree, 0) AS degree, p95
  FROM pairs LEFT JOIN sh ON sh.a = pairs.a AND sh.b = pairs.b LEFT JOIN br ON br.a = pairs.a AND br.b = pairs.b LEFT JOIN aux ON aux.h = pairs.a AND aux.t = pairs.b
  LEFT JOIN (SELECT node, count(*) AS nc FROM cgn GROUP BY node) n1 ON n1.node = pairs.a LEFT JOIN (SELECT node, count(*) AS nd FROM dgn GROUP BY node) n2 ON n2.node = pairs.b LEFT JOIN deg ON deg.node = pairs.a CROSS JOIN p95),
f1 AS (SELECT *, 0.7::DOUBLE * least(1.0::DOUBLE, shared / 2.0::DOUBLE) + 0.2::DOUBLE * least(1.0::DOUBLE, bridges / {full}.0::DOUBLE) + 0.05::DOUBLE * (cand_genes > 0)::INT + 0.05::DOUBLE * (query_genes > 0)::INT AS evidence, greatest(direct::DOUBLE, least(1.0::DOUBLE, degree / p95::DOUBLE)) AS penalty FROM f0),
f AS (SELECT *, evidence - 0.5::DOUBLE * penalty AS support FROM f1),
soft AS MATERIALIZED (SELECT cand.*, shared, bridges, cand_genes, query_genes, direct, degree, evidence, penalty, support, row_number() OVER (PARTITION BY split, row_index ORDER BY round(support, 9) DESC, round(evidence, 9) DESC, round(penalty, 9), pos) AS soft_rank FROM cand JOIN f USING (cand, query_id))
"""


FEATURES = features_sql()
WHOLE_FEATURES = features_sql(sql=WHOLE_SQL)
