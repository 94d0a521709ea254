"""Exact search for the largest inner products: blocks of sorted norms, and a running threshold that skips blocks.

A vector's product with a query is at most the product of their lengths. The universe is sorted by length, longest first, and cut into blocks; queries are cut into blocks of their own. Blocks are met in tiers of 1, 2,
4, .. blocks. After each tier every query knows its k-th best score, and a pair of blocks is met only while some query of the one can still reach its own by the longest vector of the other; a query block that no later
block can serve is done. Pairs are numbers until then; vectors are moved for pairs of panels of PANEL blocks, and only for panels with a pair that is left, so a vector moves once for a panel of the other side and not for every
block of it. What is skipped is not multiplied. Scores are rounded before ranks, equal ones rank by the least id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from .splits import dense_ids

ROWS, DIGITS = 1024, 5
#: Blocks of a panel: a task holds two panels at a time.
PANEL = 32


class Blocks:
    """(block, ids, vecs, norms): vectors (id, vec) by length, longest first; and (id, block)."""

    def __init__(self, vectors: DataFrame, rows: int, name: str):
        norm = F.sqrt(F.aggregate(F.transform("vec", lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
        keyed = vectors.select("id", "vec", norm.alias("norm")).withColumn("by", F.struct((-F.col("norm")).alias("m"), "id"))
        placed = written(dense_ids(keyed, "by", "n").select("id", "vec", "norm", F.expr(f"n div {rows}").cast("long").alias("block")), f"{name}-places")
        x = F.array_sort(F.collect_list(F.struct((-F.col("norm")).alias("m"), "id", "vec"))).alias("x")
        self.of = placed.select("id", "block")
        self.table = written(placed.groupBy("block").agg(x).select("block", F.col("x.id").alias("ids"), F.col("x.vec").alias("vecs"), F.transform("x.m", lambda m: -m).alias("norms")), f"{name}-blocks")
        self.n = self.table.count()


def _needs(best: DataFrame | None, queries: Blocks, k: int) -> DataFrame:
    """(q_block, need, floors): the least length by which a block's longest vector can still serve some query, and the score each query has to reach, in the order of the block."""
    rows = queries.table.select(F.col("block").alias("q_block"), F.posexplode(F.arrays_zip("ids", "norms")).alias("at", "x")).select("q_block", "at", F.col("x.ids").alias("q"), F.col("x.norms").alias("norm"))
    none = F.lit(float("-inf"))
    if best is None:
        rows = rows.withColumn("floor", none)
    else:
        kth = best.where(F.col("pos") == k).select("q", F.col("score").alias("floor"))
        rows = rows.join(kth, "q", "left").withColumn("floor", F.coalesce("floor", none))
    low = F.col("floor") - 10.0**-DIGITS
    need = F.when(F.col("norm") > 0, low / F.col("norm")).when(low <= 0, none).otherwise(F.lit(float("inf")))
    return rows.groupBy("q_block").agg(F.min(need).alias("need"), F.array_sort(F.collect_list(F.struct("at", "floor"))).alias("f")).select("q_block", "need", F.col("f.floor").alias("floors"))


def _panels(pairs: DataFrame, left: DataFrame, right: DataFrame, gone: DataFrame):
    """Groups of the panels that some pair (q_block, block) meets: rows of left by q_block with the pairs' excluded vectors (gone_q, gone_id; block is null in other rows) on the one side, rows of right by block on the other."""
    panel = lambda c: F.expr(f"{c} div {PANEL}").cast("long")
    met = pairs.select(panel("q_block").alias("q_panel"), panel("block").alias("panel")).distinct()
    one = left.withColumn("block", F.lit(None).cast("long")).unionByName(gone, allowMissingColumns=True)
    one = one.withColumn("q_panel", panel("q_block")).join(met, "q_panel").where((F.col("block").isNull()) | (panel("block") == F.col("panel")))
    two = right.withColumn("panel", panel("block")).join(met, "panel")
    return one.groupBy("q_panel", "panel").cogroup(two.groupBy("q_panel", "panel"))


def _blocks(one: pd.DataFrame, two: pd.DataFrame):
    """(row of left, its vectors, row of right, its vectors, excluded (gone_q, gone_id) or None) for each pair of blocks of two panels that is to be met."""
    gone = {(r.q_block, int(r.block)): (r.gone_q, r.gone_id) for r in one[one["block"].notna()].itertuples(index=False)}
    others = [(x, np.stack(x.vecs)) for x in two.itertuples(index=False)]
    for r in one[one["block"].isna()].itertuples(index=False):
        w = np.stack(r.q_vecs)
        for x, v in others:
            if x.longest >= r.need:
                yield r, w, x, v, gone.get((r.q_block, x.block))


def top_products(queries: DataFrame, universe: DataFrame, excluded: DataFrame, k: int, rows: int = ROWS, query_rows: int = ROWS) -> tuple[DataFrame, dict]:
    """(q, id, score, pos): for each query (id, vec) the k vectors (id, vec) of the universe of the largest product, without those that excluded (q, id) lists for it; and how many pairs of blocks there are and were met.

    A query with fewer than k vectors left has fewer rows. Equal ids must not occur twice in queries, nor in the universe.
    """
    u, q = Blocks(universe, rows, "universe"), Blocks(queries, query_rows, "queries")
    gone = excluded.select("q", "id").distinct().join(q.of.select(F.col("id").alias("q"), F.col("block").alias("q_block")), "q").join(u.of, "id")
    gone = written(gone.groupBy("q_block", "block").agg(F.collect_list("q").alias("gone_q"), F.collect_list("id").alias("gone_id")), "excluded")
    longest = u.table.select("block", F.get("norms", F.lit(0)).alias("longest"))

    def score(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        outs = [pd.DataFrame({"q": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        for r, w, x, v, gone in _blocks(one, two):
            wid, vid, floors = np.asarray(r.q_ids), np.asarray(x.ids), np.asarray(r.floors)
            live = np.flatnonzero(np.asarray(r.q_norms) * x.longest + 10.0**-DIGITS >= floors)
            if not len(live):
                continue
            s = np.round(w[live] @ v.T, DIGITS)
            if gone is not None:
                at, col = {q: i for i, q in enumerate(wid[live].tolist())}, {y: i for i, y in enumerate(vid.tolist())}
                for a, b in zip(*gone, strict=True):
                    if a in at:
                        s[at[a], col[b]] = -np.inf
            least = floors[live]
            if k < len(vid):
                least = np.maximum(least, np.partition(s, len(vid) - k, axis=1)[:, len(vid) - k])
            row, col = np.nonzero((s >= least[:, None]) & np.isfinite(s))
            # Equal scores can make more than k: the least ids are taken.
            order = np.lexsort((vid[col], -s[row, col], row))
            row, col = row[order], col[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            outs.append(pd.DataFrame({"q": wid[live][row[keep]], "id": vid[col[keep]], "score": s[row[keep], col[keep]] + 0.0}))
        return pd.concat(outs, ignore_index=True)

    best, met, start, size = None, 0, 0, 1
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    while start < u.n and q.n:
        needs = written(_needs(best, q, k), "needs")
        end = min(start + size, u.n)
        pairs = needs.select("q_block", "need", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(end - 1).cast("long"))).alias("block")).join(longest, "block").where(F.col("longest") >= F.col("need")).select("q_block", "block", "longest")
        pairs = written(pairs, "pairs")
        n = pairs.count()
        if not n:
            break  # no later block is longer
        met += n
        mine = q.table.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), F.col("norms").alias("q_norms")).join(needs, "q_block")
        theirs = u.table.where(F.col("block").between(start, end - 1)).select("block", "ids", "vecs").join(longest, "block")
        new = _panels(pairs, mine, theirs, gone.where(F.col("block").between(start, end - 1))).applyInPandas(score, "q long, id long, score double")
        best = new if best is None else new.unionByName(best.select("q", "id", "score"))
        best = written(best.withColumn("pos", rank).where(F.col("pos") <= k), "best")
        start, size = end, size * 2
    if best is None:
        best = queries.select(F.col("id").cast("long").alias("q"), F.col("id").cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("pos")).limit(0)
    return best, {"pairs": u.n * q.n, "met": met}


def places(golds: DataFrame, universe: DataFrame, excluded: DataFrame, rows: int = ROWS, query_rows: int = ROWS) -> DataFrame:
    """(key, place): the place, from 1, that vector `gold` takes among the universe by its product with vec, for golds (key, gold, vec, score: that product, rounded). excluded (key, id) don't count.

    Only blocks whose longest vector can reach the gold's score are met.
    """
    u, q = Blocks(universe, rows, "universe"), Blocks(golds.select(F.col("key").alias("id"), "vec"), query_rows, "golds")
    longest = u.table.select("block", F.get("norms", F.lit(0)).alias("longest"))
    mine = q.table.select(F.col("block").alias("q_block"), F.posexplode(F.arrays_zip("ids", "norms")).alias("at", "x")).select("q_block", "at", F.col("x.ids").alias("key"), F.col("x.norms").alias("norm")).join(golds.select("key", "gold", "score"), "key")
    low = F.col("score") - 10.0**-DIGITS
    need = F.when(F.col("norm") > 0, low / F.col("norm")).when(low <= 0, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    needs = mine.groupBy("q_block").agg(F.min(need).alias("need"), F.array_sort(F.collect_list(F.struct("at", "gold", "score"))).alias("f")).select("q_block", "need", F.col("f.gold").alias("golds"), F.col("f.score").alias("floors"))
    needs = written(needs, "needs")
    pairs = needs.select("q_block", "need").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, u.n - 1)).cast("long")))).join(longest, "block").where(F.col("longest") >= F.col("need"))
    gone = excluded.select(F.col("key"), "id").distinct().join(q.of.select(F.col("id").alias("key"), F.col("block").alias("q_block")), "key").join(u.of, "id")
    gone = gone.groupBy("q_block", "block").agg(F.collect_list("key").alias("gone_q"), F.collect_list("id").alias("gone_id"))
    left = q.table.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs")).join(needs, "q_block")
    groups = _panels(pairs, left, u.table.select("block", "ids", "vecs").join(longest, "block"), gone)

    def count(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        outs = [pd.DataFrame({"key": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})]
        for r, w, x, v, gone in _blocks(one, two):
            wid, vid, floors, gold = np.asarray(r.q_ids), np.asarray(x.ids), np.asarray(r.floors), np.asarray(r.golds)
            s = np.round(w @ v.T, DIGITS)
            before = ((s > floors[:, None]) & (vid[None, :] != gold[:, None])) | ((s == floors[:, None]) & (vid[None, :] < gold[:, None]))
            if gone is not None:
                at, col = {q: i for i, q in enumerate(wid.tolist())}, {y: i for i, y in enumerate(vid.tolist())}
                for a, b in zip(*gone, strict=True):
                    before[at[a], col[b]] = False
            outs.append(pd.DataFrame({"key": wid, "n": before.sum(axis=1)}))
        return pd.concat(outs, ignore_index=True).groupby("key", as_index=False)["n"].sum()

    n = groups.applyInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return golds.select("key").join(n, "key", "left").select("key", (F.coalesce("n", F.lit(0)) + 1).alias("place"))
