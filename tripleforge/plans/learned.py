"""Embedding scores, top-k by score over the whole table, and message passing over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embed as e
from ..operators import ranking as k
from ..sources import store
from ..sources.derived import SQL, Graph
from .features import FEATURES, soft_ranked
from .registry import query

R = lambda c: F.round(c, 6)
KEY = k.KEY
DIM = 64

#: Vectors as doubles; relation r's vector is the mean of those with label mod 3 = r; each vector is the head of one triple, its relation and tail by rule.
BASE = """n AS (SELECT count(*) AS n FROM embeddings), v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS i, list_transform(embedding, lambda x: x::DOUBLE) AS vec, label FROM embeddings),
rm AS (SELECT label % 3 AS r, k, avg(vec[k + 1]) AS x FROM v, range(64) t(k) GROUP BY ALL), rv AS (SELECT r, list(round(x, 9) ORDER BY k) AS vec FROM rm GROUP BY r),
tr AS (SELECT h.id AS h, h.label % 3 AS r, t.id AS t FROM v h, n, v t WHERE t.i = (h.i * 7 + 3) % n), p AS (SELECT tr.*, h.vec AS hv, rv.vec AS rv, t.vec AS tv FROM tr JOIN v h ON h.id = tr.h JOIN rv ON rv.r = tr.r JOIN v t ON t.id = tr.t)"""
L = lambda f: f"list_sum(list_transform(range(1, 65), lambda i: {f}))"
LH = lambda f: f"list_sum(list_transform(range(1, 33), lambda i: {f}))"
SCORES = {
    "transe": "-" + L("abs(hv[i] + rv[i] - tv[i])"),
    "distmult": L("hv[i] * rv[i] * tv[i]"),
    "complex": LH("hv[i]*rv[i]*tv[i] + hv[i+32]*rv[i]*tv[i+32] + hv[i]*rv[i+32]*tv[i+32] - hv[i+32]*rv[i+32]*tv[i]"),
    "rotate": "-" + LH("sqrt((hv[i]*cos(rv[i]) - hv[i+32]*sin(rv[i]) - tv[i])**2 + (hv[i]*sin(rv[i]) + hv[i+32]*cos(rv[i]) - tv[i+32])**2)"),
}


def vectors(kg: Graph):
    """(id, i, vec, label): i numbers the vectors from 0 in the order of their ids."""
    def build():
        v = kg.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
        return e.numbered(v, "id", "i")

    return store.once(kg.spark, kg.sf_dir, "vectors", build)


def relations(kg: Graph):
    """(r, vec): the mean vector of each relation; three rows."""
    x = vectors(kg).select((F.col("label") % 3).alias("r"), F.posexplode("vec").alias("k", "x")).groupBy("r", "k").agg(F.round(F.avg("x"), 9).alias("x"))
    return x.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v")).select("r", F.col("v.x").alias("vec"))


def partner(v, factor: int, shift: int):
    """(src, dst) by rule: every vector with the one whose number is its own times factor plus shift, modulo all."""
    n = v.agg(F.count("*").alias("n"))
    a = v.select(F.col("id").alias("src"), "label", "i").crossJoin(F.broadcast(n)).withColumn("i", (F.col("i") * factor + shift) % F.col("n"))
    return a.join(v.select(F.col("id").alias("dst"), "i"), "i").select("src", "dst", "label")


def scored_triples(kg: Graph):
    v = vectors(kg)
    t = partner(v, 7, 3).select(F.col("src").alias("h"), (F.col("label") % 3).alias("r"), F.col("dst").alias("t"))
    side = lambda name, vec: v.select(F.col("id").alias(name), F.col("vec").alias(vec))
    return t.join(side("h", "hv"), "h").join(side("t", "tv"), "t").join(F.broadcast(relations(kg).withColumnRenamed("vec", "rv")), "r")


def score(name: str):
    h, r, t = F.col("hv"), F.col("rv"), F.col("tv")
    return {"transe": lambda: e.transe(h, r, t), "distmult": lambda: e.distmult(h, r, t), "complex": lambda: e.complex_(h, r, t, DIM), "rotate": lambda: e.rotate(h, r, t, DIM)}[name]()


def _register(name: str):
    @query(f"ml01_{name}", f"WITH {BASE} SELECT h, r, t, round({SCORES[name]}, 5) + 0.0::DOUBLE AS score FROM p")
    def _(spark, sf):
        """The score of every triple: each vector of the table is a head once."""
        return scored_triples(Graph(spark, sf)).select("h", "r", "t", (F.round(score(name), 5) + 0.0).alias("score"))


for _name in SCORES:
    _register(_name)


@query("ml06_top20", f"WITH {BASE}, s AS (SELECT h.id AS h, rv.r, t.id AS t, round({L('h.vec[i] * rv.vec[i] * t.vec[i]')}, 5) AS score FROM v h, rv, v t WHERE h.id % 50 = 0 AND t.id <> h.id) SELECT h, r, t, row_number() OVER (PARTITION BY h, r ORDER BY score DESC, t) AS pos FROM s QUALIFY pos <= 20")
def _(spark, sf):
    """The 20 best tails of all rows for each head whose id is divisible by 50 and each relation, by blocks of heads and tails."""
    kg = Graph(spark, sf)
    return e.top_tails(vectors(kg).where("id % 50 = 0").select("id", "vec"), vectors(kg).select("id", "vec"), relations(kg), 20).select("h", "r", "t", "pos")


@query("ml05_pair_loss", f"WITH {BASE}, s AS (SELECT h, r, {SCORES['distmult']} AS pos, lag({SCORES['distmult']}, 1, 0.0) OVER (ORDER BY h) AS neg FROM p) SELECT r, round(avg(ln(1 + exp(-(pos - neg)))), 6) AS loss FROM s GROUP BY r")
def _(spark, sf):
    """Softplus loss of pairs of scores; a triple's negative is the score of the head before it."""
    kg = Graph(spark, sf)
    s = scored_triples(kg).select("h", "r", score("distmult").alias("pos")).join(vectors(kg).select(F.col("id").alias("h"), "i"), "h")
    neg = s.select((F.col("i") + 1).alias("i"), F.col("pos").alias("neg"))
    return s.join(neg, "i", "left").groupBy("r").agg(R(F.avg(e.pair_loss(F.col("pos"), F.coalesce("neg", F.lit(0.0))))).alias("loss"))


@query("ml09_raw_source", f"WITH {FEATURES} SELECT q.split, q.row_index, q.query_id, q.gold_id, count(s.cand) AS n, coalesce(min(soft_rank) FILTER (s.cand = q.gold_id), 21) AS rank, round(CASE WHEN bool_or(s.cand = q.gold_id) THEN 1.0 / min(soft_rank) FILTER (s.cand = q.gold_id) ELSE 0 END, 6) AS rr, sum(21 - soft_rank)::BIGINT AS scores FROM q JOIN soft s ON s.split = q.split AND s.row_index = q.row_index GROUP BY ALL")
def _(spark, sf):
    """A baseline's list as source rows of the next stage: descending scores by place, the gold's rank, its reciprocal."""
    s = soft_ranked(Graph(spark, sf))
    gold = F.min(F.when(F.col("cand") == F.col("gold_id"), F.col("soft_rank")))
    return s.groupBy(*KEY, "query_id", "gold_id").agg(F.count("*").alias("n"), F.coalesce(gold, F.lit(21)).alias("rank"), R(F.coalesce(1.0 / gold, F.lit(0.0))).alias("rr"), F.sum(21 - F.col("soft_rank")).cast("long").alias("scores"))


EDGES = """ed AS (SELECT a.id AS src, 'near' AS r, b.id AS dst FROM v a, n, v b WHERE b.i = (a.i * 7 + 3) % n UNION ALL SELECT a.id, 'far', b.id FROM v a, n, v b WHERE b.i = (a.i * 11 + 5) % n),
al AS (SELECT * FROM ed UNION ALL SELECT dst, r || '_back', src FROM ed), gt(r, g) AS (VALUES ('near', 0.5), ('far', 0.25), ('near_back', 0.75), ('far_back', -0.5))"""
GATES = {"near": 0.5, "far": 0.25, "near_back": 0.75, "far_back": -0.5}


def edges(kg: Graph):
    """Two edges from every vector, by rule, and each of them backwards under a relation of its own."""
    v = vectors(kg)
    one = partner(v, 7, 3).select("src", F.lit("near").alias("r"), "dst").unionByName(partner(v, 11, 5).select("src", F.lit("far").alias("r"), "dst"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.concat("r", F.lit("_back")).alias("r"), F.col("src").alias("dst")))


def plain(kg: Graph):
    return vectors(kg).select("id", "vec")


@query("ml03_mean_layer", f"WITH {BASE}, {EDGES}, m AS (SELECT dst AS id, k, avg(v.vec[k + 1] * g::DOUBLE) AS m FROM al JOIN gt USING (r) JOIN v ON v.id = src, range(64) t(k) GROUP BY ALL) SELECT v.id, t.k, round(greatest(v.vec[t.k + 1] + coalesce(m, 0), 0), 6) AS x FROM v, range(64) t(k) LEFT JOIN m ON m.id = v.id AND m.k = t.k")
def _(spark, sf):
    kg = Graph(spark, sf)
    gates = spark.createDataFrame([(r, [g] * DIM) for r, g in GATES.items()], "r string, gate array<double>")
    return e.mean_messages(edges(kg), plain(kg), gates).select("id", F.col("k").cast("long").alias("k"), R("x").alias("x"))


@query("ml04_attention_layer", f"WITH {BASE}, {EDGES}, d AS (SELECT src, dst, s.vec AS sv, {L('s.vec[i] * t.vec[i]')} AS d FROM al JOIN v s ON s.id = src JOIN v t ON t.id = dst), w AS (SELECT *, 1 / (1 + exp(-CASE WHEN d > 0 THEN d ELSE 0.2::DOUBLE * d END)) AS w FROM d), x AS (SELECT dst AS id, k, sum(w * sv[k + 1]) / sum(w) AS x FROM w, range(64) t(k) GROUP BY ALL) SELECT id, k, round(CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END, 6) AS x FROM x")
def _(spark, sf):
    kg = Graph(spark, sf)
    return e.attention_messages(edges(kg), plain(kg)).select("id", F.col("k").cast("long").alias("k"), R("x").alias("x"))
