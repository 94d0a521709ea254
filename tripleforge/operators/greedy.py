"""Splits and other greedy choices of edges in an order, under caps of their ends, by rounds over all edges at once.

Taken one after another, an edge is kept while both its ends have room. Without going through them one by one: an edge is sure to be kept if, at each end, the edges before it that are still open are fewer than the room
left there, whatever becomes of these; and it is sure to go once an end has no room. Each round decides all such edges, the first open one always among them, so the rounds end with the very edges of the loop. Random orders
need about as many rounds as the logarithm of the edges. Rounds are written; a node's edges beyond its cap do not leave their partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from .splits import dense_ids, drawn

#: Orders that a split tries.
ATTEMPTS = 500


def _ends(edges: DataFrame, shared: bool) -> DataFrame:
    """(ord, side, node) for both ends of each edge; one side only where heads and tails count together."""
    end = lambda side, c: F.struct(F.lit(side).alias("side"), F.col(c).alias("node"))
    return edges.select("ord", F.explode(F.array(end(0, "h"), end(0 if shared else 1, "t"))).alias("e")).select("ord", "e.side", "e.node")


def ordered(edges: DataFrame, order: list) -> DataFrame:
    """edges with ord, their number from 0 in the order of columns."""
    by = F.struct(*[F.col(c).alias(f"o{i}") if isinstance(c, str) else c.alias(f"o{i}") for i, c in enumerate(order)])
    return written(dense_ids(edges.withColumn("_by", by), "_by", "ord").drop("_by"), "ordered")


def kept(edges: DataFrame, caps: DataFrame, shared: bool = False, most: int | None = None) -> DataFrame:
    """The rows of edges (ord, h, t, ..) that the loop in the order of ord keeps, with caps (side, node, cap): side 0 heads, 1 tails, or 0 for both where they are shared. most: the largest cap, if it is known to be small."""
    columns = edges.columns
    open_, left, out = edges, written(caps.where("cap > 0").select("side", "node", F.col("cap").cast("long").alias("cap")), "caps"), None
    open_ = written(_with_room(open_, left, shared), "open")
    while not open_.isEmpty():
        ends = _ends(open_, shared)
        place = F.rank().over(Window.partitionBy("side", "node").orderBy("ord"))
        first = ends.withColumn("place", place)
        first = (first.where(F.col("place") <= most) if most else first).join(left, ["side", "node"]).where("place <= cap").groupBy("ord").agg(F.count("*").alias("n")).where("n = 2").select("ord")
        taken = written(open_.join(first, "ord", "left_semi").select(*columns), "taken")
        out = taken if out is None else out.unionByName(taken)
        used = _ends(taken, shared).groupBy("side", "node").agg(F.count("*").alias("used"))
        left = written(left.join(used, ["side", "node"], "left").select("side", "node", (F.col("cap") - F.coalesce("used", F.lit(0))).alias("cap")).where("cap > 0"), "caps")
        open_ = written(_with_room(open_.join(taken.select("ord"), "ord", "left_anti"), left, shared), "open")
    return out if out is not None else edges.limit(0)


def _with_room(edges: DataFrame, left: DataFrame, shared: bool) -> DataFrame:
    side = lambda s, c: left.where(F.col("side") == s).select(F.col("node").alias(c))
    return edges.join(side(0, "h"), "h", "left_semi").join(side(0 if shared else 1, "t"), "t", "left_semi").select(*edges.columns)


def first_of(edges: DataFrame, n: int) -> DataFrame:
    """The n rows of least ord."""
    return dense_ids(edges, "ord", "_n").where(F.col("_n") < n).drop("_n")


def joint_caps(edges: DataFrame, order: list, head_cap: int, tail_cap: int, total: int | None = None, shared: bool = False) -> DataFrame:
    """Edges (h, r, t), taken in an order while their head has fewer than head_cap and their tail fewer than tail_cap, `total` in all. With shared an end counts whether it is head or tail, and the caps must be one."""
    if shared and head_cap != tail_cap:
        raise ValueError("ends that count together have one cap")
    e = ordered(edges.select("h", "r", "t"), order)
    ends = _ends(e, shared).select("side", "node").distinct()
    caps = ends.withColumn("cap", F.when(F.col("side") == 0, head_cap).otherwise(tail_cap))
    out = kept(e, caps, shared, max(head_cap, tail_cap))
    return (out if total is None else first_of(out, total)).select("h", "r", "t")


def spare(edges: DataFrame) -> DataFrame:
    """caps of edges (h, t) that leave every end an edge: its number of edges less one."""
    return _ends(edges.withColumn("ord", F.lit(0)), False).groupBy("side", "node").agg((F.count("*") - 1).alias("cap"))


def spared(edges: DataFrame, seed: int) -> DataFrame:
    """Edges (h, t) that can be held out, with ord: taken in the order of their draws while both ends keep another edge."""
    e = ordered(edges.select("h", "t"), [drawn(seed, F.col("h"), F.col("t")), "h", "t"])
    return kept(e, spare(e))


def _most(edges: DataFrame) -> int:
    """Edges that can be held out at most: each head and each tail keeps one."""
    n = edges.agg(F.count("*").alias("n"), F.count_distinct("h").alias("h"), F.count_distinct("t").alias("t")).first()
    return min(n["n"] - n["h"], n["n"] - n["t"])


def coverage_safe_split(edges: DataFrame, valid: int, test: int, seed: int, attempts: int = ATTEMPTS) -> DataFrame:
    """edges (h, t), no two equal, with split: in the order of draws by seed, seed + 1, .. edges are held out while their ends keep another one, first valid, then test, until both are full.

    An error where no order of `attempts` reaches the sizes.
    """
    edges = written(edges.select("h", "t"), "to-split")
    for attempt in range(attempts if _most(edges) >= valid + test else 0):
        out = written(dense_ids(spared(edges, seed + attempt).select("h", "t", "ord"), "ord", "n").where(F.col("n") < valid + test), "held-out")
        if out.count() == valid + test:
            split = F.when(F.col("n").isNull(), "train").when(F.col("n") < valid, "valid").otherwise("test")
            return edges.join(out, ["h", "t"], "left").select("h", "t", split.alias("split"))
    raise ValueError(f"no order of {attempts} leaves {valid} valid and {test} test edges whose ends stay in train")


def split_ladder(edges: DataFrame, sizes, seed: int, attempts: int = ATTEMPTS) -> DataFrame:
    """(n_edges, size): the first size for which as many valid and test edges can be held out, each size tried with as many orders as a split is; 0 without any."""
    edges = written(edges.select("h", "t"), "to-split")
    n, most, can = edges.count(), _most(edges), []
    for size in sizes:
        if 2 * size >= n or 2 * size > most:
            continue
        # What an order can spare does not depend on the size, so orders are counted once.
        for attempt in range(attempts):
            if attempt == len(can):
                can.append(spared(edges, seed + attempt).count())
            if can[attempt] >= 2 * size:
                return edges.sparkSession.createDataFrame([(n, size)], "n_edges long, size int")
    return edges.sparkSession.createDataFrame([(n, 0)], "n_edges long, size int")


def loop_sql(name: str, edges: str, order: str, head_room: str, tail_room: str, total: int | str | None = None, shared: bool = False) -> str:
    """CTEs of DuckDB's SQL that go through edges (h, r, t, ..) one by one, in an order: {name} has those that are kept, with n, their number among them. head_room and tail_room: how many edges an end may have, of columns of edges e."""
    count = lambda ends, c: f"len(list_filter({ends}, lambda x: x = e.{c}))"
    ends = ("l.hs", "l.hs") if shared else ("l.hs", "l.ts")
    ok = f"{count(ends[0], 'h')} < {head_room} AND {count(ends[1], 't')} < {tail_room}" + (f" AND len(l.kept) < {total}" if total else "")
    heads = "list_append(list_append(l.hs, e.h), e.t)" if shared else "list_append(l.hs, e.h)"
    return f"""{name}_e AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS i FROM ({edges})),
{name}_l AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS hs, []::BIGINT[] AS ts, []::BIGINT[] AS kept
UNION ALL SELECT l.i + 1, CASE WHEN {ok} THEN {heads} ELSE l.hs END, CASE WHEN {ok} THEN list_append(l.ts, e.t) ELSE l.ts END, CASE WHEN {ok} THEN list_append(l.kept, e.i) ELSE l.kept END FROM {name}_l l JOIN {name}_e e ON e.i = l.i),
{name}_k AS MATERIALIZED (SELECT unnest(kept) AS i, generate_subscripts(kept, 1) - 1 AS n FROM (SELECT kept FROM {name}_l ORDER BY i DESC LIMIT 1)),
{name} AS (SELECT e.*, n FROM {name}_e e JOIN {name}_k USING (i))"""
