"""Evidence for a model's input, assembled in passes under one budget: shortest paths, rule walks, edges among the row's own entities.

Where several ways are equally good the first in a stated order counts, so results do not depend on how the data lie: of shortest paths between a and b the one whose nodes, read from b on,
come first; of parallel edges the one of the least relation; of the neighbours over a relation the least.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adjacency import Adjacency
from ..sources.store import written
from .splits import dense_ids

EDGE = ["src", "r", "dst"]


#: Starts whose search is one: each has a bit of a whole number.
BITS = 63


def meeting_paths(pairs: DataFrame, steps: DataFrame, most: int | None = None) -> DataFrame:
    """(a, b, path, rels): the nodes and relations of the first shortest path from a to b, of any length or of at most `most` edges, of each pair (a, b) that is so connected. steps (src, dst, r), both ways; without r, rels are null.

    Searches from all a go on together, level by level: a level has a row for each node, with a bit for each start that comes there for the first time, so it grows with the nodes and not with the pairs. Starts whose pairs are all found
    stop, as do those with nothing new. Paths are read back from b over the levels; what comes before a node depends on its start only, so pairs share it. steps are best in buckets by src: they stay where they are.
    """
    if "r" not in steps.columns:
        steps = steps.withColumn("r", F.lit(None).cast("string"))
    steps = steps.where("src <> dst").select("src", "dst", "r")
    own, has = F.expr("shiftleft(1L, bit)"), lambda c: F.expr(f"({c} & shiftleft(1L, bit)) <> 0")
    starts = dense_ids(pairs.select(F.col("a").cast("long").alias("a")).distinct(), "a", "n").select("a", F.expr(f"cast(n div {BITS} as long)").alias("g"), F.expr(f"cast(n % {BITS} as int)").alias("bit"))
    starts = written(starts, "starts")
    open_ = written(pairs.select("a", "b").distinct().join(starts, "a"), "open-pairs")
    levels, found = [written(starts.select("g", F.col("a").alias("node"), own.alias("mask")), "level")], []
    while True:
        last = levels[-1]
        met = open_.join(last.select("g", F.col("node").alias("b"), "mask"), ["g", "b"]).where(has("mask"))
        found.append(written(met.select("a", "b", "g", "bit"), "met"))
        alive = last.groupBy("g").agg(F.bit_or("mask").alias("alive"))
        open_ = open_.join(found[-1].select("a", "b"), ["a", "b"], "left_anti").join(alive, "g").where(has("alive")).drop("alive")
        open_ = written(open_, "open-pairs")
        if len(levels) - 1 == most or open_.isEmpty():
            break
        live = open_.groupBy("g").agg(F.bit_or(own).alias("live"))
        front = last.join(live, "g").select("g", "node", F.expr("mask & live").alias("mask")).where("mask <> 0")
        new = front.hint("shuffle_hash").join(steps.select("src", "dst"), F.col("node") == F.col("src")).select("g", F.col("dst").alias("node"), "mask")
        if len(levels) == most:
            # On the last level nothing counts but ends that are not found yet.
            new = new.join(open_.select("g", F.col("b").alias("node")).distinct(), ["g", "node"], "left_semi")
        new = new.groupBy("g", "node").agg(F.bit_or("mask").alias("mask"))
        # An edge leads a level back, across or on, so the last two levels are all that can come again.
        for level in levels[-2:]:
            new = new.join(level.select("g", "node", F.col("mask").alias("old")), ["g", "node"], "left").select("g", "node", F.expr("mask & ~coalesce(old, 0L)").alias("mask")).where("mask <> 0")
        levels.append(written(new, "level"))
    at = None
    for t in range(len(levels) - 1, 0, -1):
        here = found[t].select("*", F.col("b").alias("node"), F.array("b").alias("path"), F.array().cast("array<string>").alias("rels"))
        here = here if at is None else at.unionByName(here)
        want = here.groupBy("g", "node").agg(F.bit_or(own).alias("want"))
        ways = want.hint("shuffle_hash").join(steps, F.col("node") == F.col("src")).join(levels[t - 1].select("g", F.col("node").alias("dst"), "mask"), ["g", "dst"])
        ways = ways.select("g", "node", "dst", "r", F.expr("want & mask").alias("both")).where("both <> 0")
        each = ways.select("g", "node", "dst", "r", F.explode(F.expr(f"filter(sequence(0, {BITS - 1}), i -> (shiftright(both, i) & 1L) = 1L)")).alias("bit"))
        before = each.groupBy("g", "node", "bit").agg(F.min(F.struct("dst", "r")).alias("e"))
        at = here.join(before, ["g", "node", "bit"]).select("a", "b", "g", "bit", F.col("e.dst").alias("node"), F.concat(F.array("e.dst"), "path").alias("path"), F.concat(F.array("e.r"), "rels").alias("rels"))
        at = written(at, "back")
    none = found[0].select("a", "b", F.array("b").alias("path"), F.array().cast("array<string>").alias("rels"))
    return none if at is None else none.unionByName(at.select("a", "b", "path", "rels"))


def path_edges(paths: DataFrame) -> DataFrame:
    """(a, b, step, src, r, dst) of paths (a, b, path, rels)."""
    n = F.size("path") - 1
    each = F.arrays_zip(F.slice("path", F.lit(1), n).alias("src"), F.col("rels").alias("r"), F.slice("path", F.lit(2), F.size("path")).alias("dst"))
    return paths.where(n > 0).select("a", "b", F.posexplode(each).alias("step", "e")).select("a", "b", "step", "e.src", "e.r", "e.dst")


def walks(starts: DataFrame, index: Adjacency, rules: list[list[str]]) -> DataFrame:
    """(start, rule, end, step, src, r, dst): by each rule the walk that takes, for every relation in turn, the least neighbour over an edge of it; walks that can't go on are left out.

    Rules with the same beginning share its steps.
    """
    first = index.rows().groupBy("src", "r").agg(F.min("dst").alias("dst"))
    hop = F.struct("src", "r", "dst")
    at = {(): starts.select("start", F.col("start").alias("node"), F.array().cast("array<struct<src:bigint,r:string,dst:bigint>>").alias("path")).distinct()}
    for rule in rules:
        for n in range(1, len(rule) + 1):
            if (head := tuple(rule[:n])) not in at:
                step = at[head[:-1]].join(first.where(F.col("r") == head[-1]), F.col("node") == F.col("src"))
                at[head] = written(step.select("start", F.col("dst").alias("node"), F.concat("path", F.array(hop)).alias("path")), "walk")
    each = [at[tuple(rule)].select("start", F.lit(n).alias("rule"), F.col("node").alias("end"), F.posexplode("path").alias("step", "e")) for n, rule in enumerate(rules)]
    if not each:
        return starts.sparkSession.createDataFrame([], "start long, rule int, `end` long, step int, src long, r string, dst long")
    return reduce(DataFrame.unionByName, each).select("start", "rule", "end", "step", "e.*")


def among(members: DataFrame, index: Adjacency, key: list[str]) -> DataFrame:
    """(key.., o1, o2, src, r, dst): edges, read from either end, between two members (key.., pos, node) of a group; o1 and o2 are their places.

    Edges between members of any groups are few and taken first; groups then meet these on the one end and themselves on the other.
    """
    nodes = members.select("node").distinct()
    few = index.rows().where("src <> dst").join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "r")
    one = members.select(*key, F.col("pos").alias("o1"), F.col("node").alias("src")).join(written(few, "edges-among"), "src")
    return one.join(members.select(*key, F.col("pos").alias("o2"), F.col("node").alias("dst")), [*key, "dst"]).select(*key, "o1", "o2", *EDGE)


def assemble(cands: DataFrame, index: Adjacency, rules: list[list[str]], size: int, key: list[str], most: int | None = None) -> DataFrame:
    """(key.., place, stage, src, r, dst): the edges of each row of candidates (key.., query_id, pos, cand), in order.

    Stage 1: the shortest path (of at most `most` edges, if given) from every candidate to the query, all of them, whatever the size. While there are fewer than `size` edges: 2, rule walks from the query that end at a
    candidate, by candidate and rule; 3, rule walks from the query and then from each candidate, wherever they end; 4, edges between the query and the candidates that are not there yet. An edge
    can come in several of the first three stages, as often as it is met. Nodes without edges have no paths and no walks.
    """
    cands = cands.select(*key, "query_id", "pos", F.col("cand").cast("long").alias("cand"))
    rows = written(cands, "assembled-candidates")
    pairs = rows.select(F.col("cand").alias("a"), F.col("query_id").alias("b")).distinct()
    paths = written(path_edges(meeting_paths(pairs, index.rows(), most)), "path-edges")
    on = lambda stage, *order: [F.lit(stage).alias("stage"), *[o.alias(f"o{i + 1}") for i, o in enumerate(order)], *EDGE]
    one = rows.join(paths, (F.col("cand") == F.col("a")) & (F.col("query_id") == F.col("b"))).select(*key, *on(1, F.col("pos"), F.lit(0), F.col("step")))
    members = rows.select(*key, F.lit(0).alias("pos"), F.col("query_id").alias("node")).distinct().unionByName(rows.select(*key, "pos", F.col("cand").alias("node")))
    ways = written(walks(members.select(F.col("node").alias("start")).distinct(), index, rules), "walks")
    two = rows.join(ways, (F.col("query_id") == F.col("start")) & (F.col("cand") == F.col("end"))).select(*key, *on(2, F.col("pos"), F.col("rule"), F.col("step")))
    three = members.join(ways, F.col("node") == F.col("start")).select(*key, *on(3, F.col("pos"), F.col("rule"), F.col("step")))
    before = written(one.unionByName(two).unionByName(three), "passes")
    four = among(members, index, key).join(before.select(*key, *EDGE).distinct(), [*key, *EDGE], "left_anti").select(*key, *on(4, F.col("o1"), F.col("o2"), F.lit(0)))
    order = Window.partitionBy(*key).orderBy("stage", "o1", "o2", "o3", "r")
    placed = before.unionByName(four).withColumn("place", F.row_number().over(order))
    return placed.where((F.col("stage") == 1) | (F.col("place") <= size)).select(*key, "place", "stage", *EDGE)
