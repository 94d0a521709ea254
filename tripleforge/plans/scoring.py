"""Candidates by a model's scores: the universe of compounds scored for each query by the vectors of both, exactly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search
from ..operators.ranking import KEY
from ..sources import store
from ..sources.derived import SQL, TOP_K, Graph
from .learned import BASE, relations, vectors
from .registry import query

#: Rows of a block of vectors.
ROWS = 512


def node_vectors(kg: Graph, nodes):
    """(id, vec) of nodes (id): the vector whose number is the node's, modulo all vectors."""
    v = vectors(kg)
    n = v.agg(F.count("*").alias("n"))
    return nodes.crossJoin(F.broadcast(n)).withColumn("i", F.col("id") % F.col("n")).join(v.select("i", "vec"), "i").select("id", "vec")


def sides(kg: Graph):
    """Vectors of the universe; those of the queries, times the target relation's; and what training knows of each query."""
    def build():
        rel = F.broadcast(relations(kg).where("r = 0").select(F.col("vec").alias("rel")))
        q = node_vectors(kg, kg.queries().select(F.col("query_id").alias("id")).distinct())
        return q.crossJoin(rel).select("id", F.zip_with("vec", "rel", lambda a, b: a * b).alias("vec"))

    universe = store.once(kg.spark, kg.sf_dir, "universe-vectors", lambda: node_vectors(kg, kg.popularity().select(F.col("cand").alias("id"))))
    return universe, store.once(kg.spark, kg.sf_dir, "query-vectors", build), kg.train().select(F.col("t").alias("q"), F.col("h").alias("id"))


MODEL = f"""{SQL}, {BASE}, nv AS (SELECT nodes.id, v.vec FROM nodes, n JOIN v ON v.i = nodes.id % n.n), dq AS (SELECT DISTINCT query_id FROM q),
ms AS MATERIALIZED (SELECT query_id, cand, round(list_sum(list_transform(range(1, 65), lambda i: c.vec[i] * rv.vec[i] * d.vec[i])), 5) + 0.0::DOUBLE AS s FROM dq JOIN nv d ON d.id = query_id, pop JOIN nv c ON c.id = cand, rv WHERE rv.r = 0),
mo AS (SELECT * FROM ms WHERE NOT EXISTS (SELECT 1 FROM train WHERE train.h = cand AND train.t = query_id))"""


@query("topk01_model_candidates", f"WITH {MODEL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, cand) AS pos FROM mo QUALIFY pos <= {TOP_K}) SELECT split, row_index, pos, cand, s AS score FROM q JOIN r USING (query_id)")
def _(spark, sf):
    """The 20 compounds of best model score for each query, its training answers left out."""
    kg = Graph(spark, sf)
    universe, queries, known = sides(kg)
    best, _ = search.top_products(queries, universe, known, TOP_K, ROWS, ROWS)
    return kg.queries().join(best.withColumnRenamed("q", "query_id"), "query_id").select(*KEY, "pos", F.col("id").alias("cand"), "score")


@query("jn15_model_scores", f"WITH {MODEL}, u AS (SELECT query_id, count(*) AS n, max(s) AS best FROM mo GROUP BY query_id), gs AS (SELECT split, row_index, q.query_id, gold_id, s AS gold_score FROM q LEFT JOIN ms ON ms.query_id = q.query_id AND ms.cand = gold_id) SELECT gs.split, gs.row_index, coalesce(u.n, 0) AS n, u.best, gold_score, CASE WHEN gold_score IS NOT NULL THEN 1 + (SELECT count(*) FROM mo WHERE mo.query_id = gs.query_id AND (s > gold_score OR (s = gold_score AND mo.cand < gold_id))) END AS gold_place FROM gs LEFT JOIN u ON u.query_id = gs.query_id")
def _(spark, sf):
    """Each query's whole universe scored by the model: its size without training answers, the best score, the gold's score and its place among all; nulls for a gold outside."""
    kg = Graph(spark, sf)
    universe, queries, known = sides(kg)
    best, _ = search.top_products(queries, universe, known, 1, ROWS, ROWS)
    gone = known.join(universe.select("id"), "id", "left_semi").distinct().groupBy(F.col("q").alias("query_id")).agg(F.count("*").alias("gone"))
    size = universe.agg(F.count("*").alias("all"))
    rows = kg.queries().join(gone, "query_id", "left").crossJoin(F.broadcast(size)).join(best.select(F.col("q").alias("query_id"), F.col("score").alias("best")), "query_id", "left")
    rows = rows.join(queries.select(F.col("id").alias("query_id"), F.col("vec").alias("qv")), "query_id").join(universe.select(F.col("id").alias("gold_id"), F.col("vec").alias("gv")), "gold_id", "left")
    product = F.aggregate(F.zip_with("qv", "gv", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("gold_score", F.round(product, 5) + 0.0).withColumn("key", F.col("row_index") * 2 + F.when(F.col("split") == "test", 0).otherwise(1))
    golds = store.written(rows.where("gold_score is not null").select(F.col("key").cast("long").alias("key"), F.col("gold_id").alias("gold"), F.col("qv").alias("vec"), F.col("gold_score").alias("score"), "query_id"), "golds")
    out = golds.join(known.withColumnRenamed("q", "query_id"), "query_id").where("id <> gold").select("key", "id")
    found = search.places(golds.drop("query_id"), universe, out, ROWS, ROWS)
    return rows.join(found, "key", "left").select(*KEY, (F.col("all") - F.coalesce("gone", F.lit(0))).alias("n"), "best", "gold_score", F.col("place").alias("gold_place"))
