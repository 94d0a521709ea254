"""Embedding scores and one round of message passing, on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from .splits import dense_ids

ZERO = lambda: F.lit(0.0).cast("double")


def _sum(values: Column) -> Column:
    return F.aggregate(values, ZERO(), lambda a, v: a + v)


def _mul(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p * q)


def halves(v: Column, dim: int) -> tuple[Column, Column]:
    return F.slice(v, 1, dim // 2), F.slice(v, dim // 2 + 1, dim // 2)


def transe(h: Column, r: Column, t: Column, norm: int = 1) -> Column:
    gap = F.zip_with(F.zip_with(h, r, lambda a, b: a + b), t, lambda a, b: a - b)
    return -_sum(F.transform(gap, F.abs)) if norm == 1 else -F.sqrt(_sum(F.transform(gap, lambda x: x * x)))


def distmult(h: Column, r: Column, t: Column) -> Column:
    return _sum(_mul(_mul(h, r), t))


def complex_(h: Column, r: Column, t: Column, dim: int) -> Column:
    (hr, hi), (rr, ri), (tr, ti) = (halves(v, dim) for v in (h, r, t))
    return _sum(_mul(_mul(hr, rr), tr)) + _sum(_mul(_mul(hi, rr), ti)) + _sum(_mul(_mul(hr, ri), ti)) - _sum(_mul(_mul(hi, ri), tr))


def rotate(h: Column, r: Column, t: Column, dim: int) -> Column:
    """r's first half are phases."""
    (hr, hi), (phase, _), (tr, ti) = (halves(v, dim) for v in (h, r, t))
    c, s = F.transform(phase, F.cos), F.transform(phase, F.sin)
    re = F.zip_with(F.zip_with(_mul(hr, c), _mul(hi, s), lambda a, b: a - b), tr, lambda a, b: a - b)
    im = F.zip_with(F.zip_with(_mul(hr, s), _mul(hi, c), lambda a, b: a + b), ti, lambda a, b: a - b)
    return -_sum(F.zip_with(re, im, lambda a, b: F.sqrt(a * a + b * b)))


def mean_messages(edges: DataFrame, vectors: DataFrame, gates: DataFrame) -> DataFrame:
    """One layer: each node's mean over incoming edges (src, r, dst) of the source's vector times the relation's gate, plus its own vector, cut at 0. (id, k, x)."""
    src = vectors.select(F.col("id").alias("src"), "vec")
    msg = edges.join(src, "src").join(gates, "r").select("dst", F.posexplode(_mul(F.col("vec"), F.col("gate"))).alias("k", "m"))
    mean = msg.groupBy(F.col("dst").alias("id"), "k").agg(F.avg("m").alias("m"))
    own = vectors.select("id", F.posexplode("vec").alias("k", "v"))
    return own.join(mean, ["id", "k"], "left").select("id", "k", F.greatest(F.col("v") + F.coalesce("m", F.lit(0.0)), F.lit(0.0)).alias("x"))


def attention_messages(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """As mean_messages, with sigmoid weights of the leaky dot product of both ends, normalised by their sum, and ELU."""
    a = vectors.select(F.col("id").alias("src"), F.col("vec").alias("sv"))
    b = vectors.select(F.col("id").alias("dst"), F.col("vec").alias("dv"))
    e = edges.join(a, "src").join(b, "dst").withColumn("d", _sum(_mul(F.col("sv"), F.col("dv"))))
    w = 1 / (1 + F.exp(-F.when(F.col("d") > 0, F.col("d")).otherwise(0.2 * F.col("d"))))
    msg = e.select("dst", w.alias("w"), F.posexplode("sv").alias("k", "m"))
    x = msg.groupBy(F.col("dst").alias("id"), "k").agg((F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("x"))
    return x.select("id", "k", F.when(F.col("x") > 0, F.col("x")).otherwise(F.exp("x") - 1).alias("x"))


def numbered(vectors: DataFrame, column: str, name: str) -> DataFrame:
    return dense_ids(vectors, column, name)


def pair_loss(positive: Column, negative: Column) -> Column:
    """Softplus of the negative margin, for large margins too."""
    x = negative - positive
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def blocks(vectors: DataFrame, rows: int, total: int) -> DataFrame:
    """(block, ids, vecs): about `rows` vectors in each."""
    n = max(1, -(-total // rows))
    return vectors.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("id", "vec")).alias("x")).select("block", F.col("x.id").alias("ids"), F.col("x.vec").alias("vecs"))


def top_tails(heads: DataFrame, tails: DataFrame, relations: DataFrame, k: int, rows: int = 1024) -> DataFrame:
    """(h, r, t, score, pos): for each head and relation the k tails (other than the head) of best product score, rounded to 5 places, of equal ones the least id.

    Heads and tails meet as blocks of about `rows` vectors; a pair of blocks returns k tails for each head and relation, so what is sent on grows with the
    heads and the number of tail blocks, never with all pairs. relations has a few rows and is collected.
    """
    import numpy as np
    import pandas as pd

    rel = sorted((r["r"], r["vec"]) for r in relations.limit(10_001).collect())
    if len(rel) > 10_000:
        raise ValueError("more than 10000 relations")
    a = written(blocks(heads, rows, heads.count()), "head-blocks")
    b = written(blocks(tails, rows, tails.count()), "tail-blocks")
    pairs = a.select(F.col("ids").alias("hi"), F.col("vecs").alias("hv")).crossJoin(b.select(F.col("ids").alias("ti"), F.col("vecs").alias("tv")))

    def best(batches):
        for pdf in batches:
            for hi, hv, ti, tv in pdf.itertuples(index=False):
                h, t, hid, tid = np.stack(hv), np.stack(tv), np.asarray(hi), np.asarray(ti)
                for r, vec in rel:
                    s = np.round((h * np.asarray(vec)) @ t.T, 5)
                    s[hid[:, None] == tid[None, :]] = -np.inf
                    order = np.lexsort((np.broadcast_to(tid, s.shape), -s), axis=1)[:, :k]
                    got = np.take_along_axis(s, order, axis=1)
                    out = pd.DataFrame({"h": np.repeat(hid, order.shape[1]), "r": r, "t": tid[order].ravel(), "score": got.ravel()})
                    yield out[np.isfinite(out["score"])]

    kind = relations.schema["r"].dataType.simpleString()
    some = pairs.mapInPandas(best, f"h long, r {kind}, t long, score double")
    return some.withColumn("pos", F.row_number().over(Window.partitionBy("h", "r").orderBy(F.desc("score"), "t"))).where(F.col("pos") <= k)
