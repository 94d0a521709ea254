"""Graph views and features: incident edges, capped neighbours, shared neighbours, bridges, degrees, bounded paths, rules.

Edges are (h, r, t). Joins are equi-joins on nodes; an edge that touches a node at either end is met by listing its ends, never by an OR.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written


def both_ways(edges: DataFrame, key=()) -> DataFrame:
    """(key.., src, dst, h, r, t): every edge from either end; a self-loop once."""
    out = edges.select(*key, F.col("h").alias("src"), F.col("t").alias("dst"), "h", "r", "t")
    return out.unionByName(edges.where("h <> t").select(*key, F.col("t").alias("src"), F.col("h").alias("dst"), "h", "r", "t"))


def first_per(df: DataFrame, by, order, cap: int, name: str = "place") -> DataFrame:
    """The first cap rows of each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= cap)


def neighbours(pairs: DataFrame, cap: int) -> DataFrame:
    """Distinct (node, near), of each node the first cap by near."""
    return first_per(pairs.select("node", "near").distinct(), ["node"], ["near"], cap)


def shared(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Number of neighbours that a and b of each pair share; pairs without any are missing."""
    a, b = left.select(F.col("node").alias("a"), "near"), right.select(F.col("node").alias("b"), "near")
    # Pairs meet no neighbour of b but those that some a has too.
    b = b.join(a.select("near").distinct(), "near", "left_semi")
    return pairs.join(b, "b").join(a, ["a", "near"]).groupBy("a", "b").agg(F.count("*").alias("shared"))


def bridges(left: DataFrame, right: DataFrame, links: DataFrame, pairs: DataFrame, cap: int) -> DataFrame:
    """Number of links between a neighbour of a and one of b, at most cap."""
    a, b = left.select(F.col("node").alias("a"), F.col("near").alias("x")), right.select(F.col("node").alias("b"), F.col("near").alias("y"))
    steps = both_ways(links).select(F.col("src").alias("x"), F.col("dst").alias("y"))
    # Steps are counted for each a and far end first, so that the pairs meet counts instead of single steps.
    reach = written(a.join(steps, "x").groupBy("a", "y").agg(F.count("*").alias("n")), "reach")
    b = b.join(reach.select("y").distinct(), "y", "left_semi")
    return pairs.join(b, "b").join(reach, ["a", "y"]).groupBy("a", "b").agg(F.least(F.sum("n"), F.lit(cap)).alias("bridges"))


def bridges_in_groups(left: DataFrame, right: DataFrame, groups: DataFrame, pairs: DataFrame, cap: int) -> DataFrame:
    """bridges() where links are those between any two different members of a group: groups has (gene, and what names its group).

    Members of a's and of b's neighbours in each group are counted and the counts multiplied, less the neighbours that a and b share; no link is listed.
    """
    by = [c for c in groups.columns if c != "gene"]
    a = left.select(F.col("node").alias("a"), F.col("near").alias("gene")).join(groups, "gene").groupBy("a", *by).agg(F.count("*").alias("n"))
    b = right.select(F.col("node").alias("b"), F.col("near").alias("gene")).join(groups, "gene").groupBy("b", *by).agg(F.count("*").alias("m"))
    links = pairs.join(b, "b").join(a, ["a", *by]).groupBy("a", "b").agg(F.sum(F.col("n") * F.col("m")).alias("all"))
    same = shared(left.select("node", F.col("near").alias("gene")).join(groups.select("gene"), "gene").select("node", F.col("gene").alias("near")), right, pairs)
    n = F.col("all") - F.coalesce("shared", F.lit(0))
    return links.join(same, ["a", "b"], "left").where(n > 0).select("a", "b", F.least(n, F.lit(cap)).alias("bridges"))


def degree_p95(degrees: DataFrame, column: str = "degree") -> DataFrame:
    """One row: the exact 95th percentile of positive degrees with linear interpolation, 1 at least."""
    return degrees.where(F.col(column) > 0).agg(F.greatest(F.coalesce(F.percentile(column, F.lit(0.95)), F.lit(1.0)), F.lit(1.0)).alias("p95"))


def within(frontier: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Shortest path lengths from each start: (key.., start, node, dist) for dist up to depth. frontier has (start); edges may carry the same keys."""
    keys = [c for c in frontier.columns if c != "start"]
    steps = both_ways(edges).select(*keys, F.col("src").alias("node"), "dst").distinct() if keys else both_ways(edges).select(F.col("src").alias("node"), "dst").distinct()
    seen = frontier.select(*keys, "start", F.col("start").alias("node"), F.lit(0).alias("dist"))
    last = seen
    for d in range(1, depth + 1):
        new = last.join(steps, [*keys, "node"]).select(*keys, "start", F.col("dst").alias("node")).distinct().join(seen, [*keys, "start", "node"], "left_anti").withColumn("dist", F.lit(d))
        seen, last = seen.unionByName(new), new
    return seen


def follow(starts: DataFrame, edges: DataFrame, rule: list[str]) -> DataFrame:
    """Greedy walk along a chain of relations: at each step the first neighbour over an edge of that relation, no going back. (start, end)."""
    at = starts.select("start", F.col("start").alias("node"))
    for relation in rule:
        step = both_ways(edges.where(F.col("r") == relation)).groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("next"))
        at = at.join(step, "node").select("start", F.col("next").alias("node"))
    return at.select("start", F.col("node").alias("end"))


def jaccard(a: DataFrame, b: DataFrame, key) -> DataFrame:
    """Jaccard similarity of two edge sets for each key; 1 where both are empty (not listed), 0 where one is."""
    cols = [*key, "h", "r", "t"]
    both = a.select(*cols).distinct().withColumn("_a", F.lit(1)).join(b.select(*cols).distinct().withColumn("_b", F.lit(1)), cols, "full")
    return both.groupBy(*key).agg((F.sum(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1).otherwise(0)) / F.count("*")).alias("jaccard"))


def keep_first(df: DataFrame, by, *order) -> DataFrame:
    """One row for each value of by: the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def ordered(edges: DataFrame) -> DataFrame:
    """Every edge from either end with its place at that end: (src, dst, h, r, t, place), in the order of relation, far end, head."""
    return both_ways(edges).withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("r", "dst", "h")))


def first_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, place, r, h, t): of parallel edges the one that comes first at src."""
    return ordered(edges).groupBy("src", "dst").agg(F.min(F.struct("place", "r", "h", "t")).alias("e")).select("src", "dst", "e.*")


def short_paths(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths of at most three edges from a to b of each pair, as a breadth-first search finds them that goes through a node's edges in their order: (a, b, step, h, r, t).

    Of the shortest paths that is the one whose edges, from a on, come first; an edge's relation, far end and head stand for its place, so that no node's edges are numbered.
    Only edges at the starts, at the nodes next to them and at the ends are moved. Two steps from each a are reduced to their first way before the pairs meet them.
    """
    ends = both_ways(edges)

    def at(nodes: DataFrame) -> DataFrame:
        """(src, dst, e) for nodes (src): of parallel edges the first."""
        return ends.join(nodes.distinct(), "src", "left_semi").groupBy("src", "dst").agg(F.min(F.struct("r", "h", "t")).alias("e"))

    key = lambda far: F.struct("e.r", F.col(far).alias("far"), "e.h", "e.t")
    edge = lambda k: F.struct(f"{k}.h", f"{k}.r", f"{k}.t")
    near = written(at(pairs.select(F.col("a").alias("src"))).select(F.col("src").alias("a"), F.col("dst").alias("v"), key("dst").alias("k1")), "first-edges")
    # What is first among parallel edges at one end is first at the other.
    into = written(at(pairs.select(F.col("b").alias("src"))).select(F.col("dst").alias("w"), F.col("src").alias("b"), key("src").alias("last")), "last-edges")
    first = lambda *columns: F.min(F.struct(*columns))
    one = pairs.join(near.withColumnRenamed("v", "b"), ["a", "b"]).select("a", "b", F.array(edge("k1")).alias("path"))
    left = written(pairs.join(near.select("a", F.col("v").alias("b")), ["a", "b"], "left_anti"), "no-edge")
    reach = near.where("v <> a")
    two = left.join(into.join(reach.select(F.col("v").alias("w")).distinct(), "w", "left_semi"), "b").join(reach.withColumnRenamed("v", "w"), ["a", "w"])
    two = written(two.groupBy("a", "b").agg(first("k1", "last").alias("x")).select("a", "b", F.array(edge("x.k1"), edge("x.last")).alias("path")), "two-steps")
    left = left.join(two, ["a", "b"], "left_anti")
    reach = reach.join(left.select("a").distinct(), "a", "left_semi")
    steps = at(reach.select(F.col("v").alias("src"))).select(F.col("src").alias("v"), F.col("dst").alias("w"), key("dst").alias("k2"))
    # No way goes on but to a node next to some end.
    steps = steps.join(into.select("w").distinct(), "w", "left_semi")
    far = written(reach.join(steps, "v").where("w <> a").groupBy("a", "w").agg(first("k1", "k2").alias("x")), "two-steps-on")
    three = left.join(into.join(far.select("w").distinct(), "w", "left_semi"), "b").join(far, ["a", "w"])
    three = three.groupBy("a", "b").agg(first("x", "last").alias("y")).select("a", "b", F.array(edge("y.x.k1"), edge("y.x.k2"), edge("y.last")).alias("path"))
    return one.unionByName(two).unionByName(three).select("a", "b", F.posexplode("path").alias("step", "e")).select("a", "b", "step", "e.h", "e.r", "e.t")


def shortest_paths(pairs: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(a, b, step, src, r, dst) of a shortest path between a and b, of any length or of at most `most` edges, each edge with the first of its parallel relations. Of equally short ways
    that whose nodes, read from b, come first.

    Searches go out from all starts and from all ends by turns, one edge in each round, and meet half way: what is reached grows with half the length. Pairs leave when they have met or when either
    side finds nothing new. Paths are read from b over those nodes of its side that lead to where both met, then from there to a.
    """
    steps = written(both_ways(edges.where("h <> t")).groupBy("src", "dst").agg(F.min("r").alias("r")), "steps")
    to = steps.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    open_ = written(pairs.where("a <> b").select("a", "b").distinct(), "open")
    sides = {x: [written(open_.select(F.col(x).alias("of"), F.col(x).alias("node")).distinct().withColumn("before", F.lit(None).cast("long")), "side")] for x in "ab"}
    met: dict[int, DataFrame] = {}
    for d in itertools.count(1) if most is None else range(1, most + 1):
        end = "a" if d % 2 else "b"
        side = sides[end]
        live = side[-1].join(open_.select(F.col(end).alias("of")).distinct(), "of", "left_semi")
        new = live.join(to, "node").groupBy("of", F.col("next").alias("node")).agg(F.min("node").alias("before"))
        # An edge leads a level back, across or on, so the last two levels are all that can come again.
        for level in side[-2:]:
            new = new.join(level.select("of", "node"), ["of", "node"], "left_anti")
        side.append(written(new, "side"))
        here = open_.join(sides["a"][-1].select(F.col("of").alias("a"), "node"), "a").join(sides["b"][-1].select(F.col("of").alias("b"), "node"), ["b", "node"])
        met[d] = written(here.select("a", "b", "node", F.lit(d).alias("d")), "met")
        open_ = open_.join(met[d].select("a", "b").distinct(), ["a", "b"], "left_anti").join(side[-1].select(F.col("of").alias(end)).distinct(), end, "left_semi")
        open_ = written(open_, "open")
        if open_.isEmpty():
            break
    # Of every pair that met at distance d, (d + 1) // 2 edges are a's and d // 2 are b's.
    leads: dict[int, DataFrame] = {}
    for t in range(max(met, default=0) // 2, 0, -1):
        good = [met[d] for d in (2 * t, 2 * t + 1) if d in met]
        if t + 1 in leads:
            good.append(leads[t + 1].join(to, "node").join(sides["b"][t].select(F.col("of").alias("b"), F.col("node").alias("next")), ["b", "next"]).select("a", "b", F.col("next").alias("node"), "d").distinct())
        leads[t] = written(reduce(DataFrame.unionByName, good), "leads")
    at, halves, out = reduce(DataFrame.unionByName, [x.select("a", "b", "d").distinct() for x in met.values()]).withColumn("node", F.col("b")) if met else None, {}, []
    for t in range(max(leads, default=0) + 1):
        if t:
            way = at.join(to, "node").join(leads[t].select("a", "b", F.col("node").alias("next")), ["a", "b", "next"]).groupBy("a", "b", "d", "node").agg(F.min("next").alias("next"))
            way = written(way, "way")
            out.append(way.select("a", "b", (F.col("d") - t).alias("step"), F.col("next").alias("src"), F.col("node").alias("dst")))
            at = way.select("a", "b", "d", F.col("next").alias("node"))
        halves[t] = at
    rest = None
    for s in range(len(sides["a"]) - 1, 0, -1) if met else ():
        here = [halves[d // 2].where(F.col("d") == d).select("a", "b", "node") for d in (2 * s - 1, 2 * s) if d in met] + ([] if rest is None else [rest])
        way = reduce(DataFrame.unionByName, here).join(sides["a"][s].select(F.col("of").alias("a"), "node", "before"), ["a", "node"])
        way = written(way.select("a", "b", "node", "before"), "way")
        out.append(way.select("a", "b", F.lit(s - 1).alias("step"), F.col("before").alias("src"), F.col("node").alias("dst")))
        rest = way.select("a", "b", F.col("before").alias("node"))
    if not out:
        return pairs.limit(0).select("a", "b", F.lit(0).alias("step"), F.col("a").alias("src"), F.lit("").alias("r"), F.col("b").alias("dst"))
    return reduce(DataFrame.unionByName, out).join(steps, ["src", "dst"]).select("a", "b", "step", "src", "r", "dst")


def rule_walks(starts: DataFrame, edges: DataFrame, rules: list[list[str]]) -> DataFrame:
    """(start, rule, step, src, r, dst): for each rule the walk that takes, at every step, the least neighbour over an edge of the step's relation; only walks that reach the rule's end."""
    out = None
    for n, rule in enumerate(rules):
        at = starts.select("start", F.col("start").alias("node"), F.array().cast("array<struct<src:bigint,r:string,dst:bigint>>").alias("path"))
        for relation in rule:
            step = both_ways(edges.where(F.col("r") == relation)).groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("next"))
            at = at.join(step, "node").select("start", F.col("next").alias("node"), F.concat("path", F.array(F.struct(F.col("node").alias("src"), F.lit(relation).alias("r"), F.col("next").alias("dst")))).alias("path"))
        rows = at.select("start", F.lit(n).alias("rule"), F.col("node").alias("end"), F.posexplode("path").alias("step", "e")).select("start", "rule", "end", "step", "e.*")
        out = rows if out is None else out.unionByName(rows)
    return out
