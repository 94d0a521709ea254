"""Typed path templates as one state table that is joined with the graph level by level.

A template is (name, kind, steps) with steps (kind of the near end, relations, kind of the far end); an edge may be gone either way. Templates that begin alike share their states, so a graph is searched once for all
of them: a row of the table leads from a state over one relation between two kinds to the next state, and says which templates end there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Step = tuple[str, tuple[str, ...], str]
#: Templates of one table; it is broadcast.
MOST = 10_000


def state_table(spark: SparkSession, templates: list[tuple[str, str, list[Step]]]) -> DataFrame:
    """(state, near_kind, r, far_kind, next, ends: names of the templates that end with this step); states count from 0, the start."""
    if sum(len(steps) for _, _, steps in templates) > MOST:
        raise ValueError(f"templates of more than {MOST} steps")
    # A state is the set of (template, steps gone) that a path so far can be in, so no path is in two states.
    start = frozenset((i, 0) for i in range(len(templates)))
    states, todo, rows = {start: 0}, [start], []
    for state in todo:
        moves: dict[tuple, set] = {}
        for i, n in state:
            if n < len(templates[i][2]):
                near, relations, far = templates[i][2][n]
                for r in relations:
                    moves.setdefault((near, r, far), set()).add((i, n + 1))
        for (near, r, far), items in sorted(moves.items()):
            after = frozenset(items)
            if after not in states:
                states[after] = len(states)
                todo.append(after)
            rows.append((states[state], near, r, far, states[after], sorted(templates[i][0] for i, n in after if n == len(templates[i][2]))))
    return spark.createDataFrame(rows, "state int, near_kind string, r string, far_kind string, next int, ends array<string>")


def depth(templates: list) -> int:
    return max((len(steps) for _, _, steps in templates), default=0)


def matched(pairs: DataFrame, edges: DataFrame, kinds: DataFrame, templates: list, key: list[str]) -> DataFrame:
    """(key.., a, b, template): the templates along which edges (key.., src, r, dst; both ways) lead from a to b, for pairs (key.., a, b). kinds: (id, kind).

    A level moves all (a, node, state) on at once, equal ones as one; steps that end a template are met with the pairs and need not go on.
    """
    table = F.broadcast(state_table(pairs.sparkSession, templates))
    far = edges.where("src <> dst").join(kinds.select(F.col("id").alias("dst"), F.col("kind").alias("far_kind")), "dst")
    at = pairs.select(*key, "a").distinct().join(kinds.select(F.col("id").alias("a"), F.col("kind").alias("near_kind")), "a").select(*key, "a", F.col("a").alias("node"), F.lit(0).alias("state"), "near_kind")
    out = None
    for _ in range(depth(templates)):
        gone = at.join(far.withColumnRenamed("src", "node"), [*key, "node"]).where("dst <> a").join(table, ["state", "near_kind", "r", "far_kind"])
        found = gone.where(F.size("ends") > 0).select(*key, "a", F.col("dst").alias("b"), F.explode("ends").alias("template")).join(pairs.select(*key, "a", "b").distinct(), [*key, "a", "b"])
        out = found if out is None else out.unionByName(found)
        at = gone.select(*key, "a", F.col("dst").alias("node"), F.col("next").alias("state"), F.col("far_kind").alias("near_kind")).distinct()
    empty = pairs.select(*key, "a", "b", F.lit("").alias("template")).limit(0)
    return out.distinct() if out is not None else empty


def kept(cands: DataFrame, found: DataFrame, templates: list, key: list[str], good=("direct", "valid")) -> DataFrame:
    """cands (key.., query_id, cand, ..) with support (the first of `good` that a matched template is of, null without any), kept, and fallback: a row none of whose candidates has support keeps all."""
    kind = {name: what for name, what, _ in templates}
    order = F.coalesce(*[F.when(F.col("template").isin([n for n in kind if kind[n] == what]), F.lit(i)) for i, what in enumerate(good)])
    best = found.groupBy(*key, F.col("a").alias("cand")).agg(F.min(order).alias("best")).where("best is not null")
    some = best.select(*key).distinct().withColumn("some", F.lit(True))
    support = F.element_at(F.array(*[F.lit(x) for x in good]), F.col("best") + 1)
    out = cands.join(best, [*key, "cand"], "left").join(some, key, "left").withColumn("fallback", F.col("some").isNull())
    return out.withColumn("support", F.when(F.col("best").isNotNull(), support)).withColumn("kept", F.col("best").isNotNull() | F.col("fallback")).drop("best", "some")


def sequences(pairs: DataFrame, edges: DataFrame, key: list[str], most: int = 3) -> DataFrame:
    """(key.., a, b, rels, nodes): every path of at most `most` edges (key.., src, r, dst; both ways) from a to b that meets no node twice; parallel edges make paths of their own."""
    e = edges.where("src <> dst").select(*key, F.col("src").alias("node"), "r", "dst")
    # Only nodes from which b is near enough are gone to, so a level never holds paths that lead nowhere.
    back = pairs.select(*key, "b", F.col("b").alias("node"), F.lit(0).alias("left")).distinct()
    near = back
    for d in range(1, most):
        back = back.join(e, [*key, "node"]).select(*key, "b", F.col("dst").alias("node"), F.lit(d).alias("left")).distinct()
        near = near.unionByName(back)
    near = near.groupBy(*key, "b", F.col("node").alias("dst")).agg(F.min("left").alias("left"))
    at = pairs.select(*key, "a", "b", F.col("a").alias("node"), F.array().cast("array<string>").alias("rels"), F.array("a").alias("nodes")).distinct()
    out = None
    for d in range(1, most + 1):
        at = at.join(e, [*key, "node"]).where(~F.array_contains("nodes", F.col("dst"))).join(near.where(F.col("left") <= most - d), [*key, "b", "dst"])
        at = at.select(*key, "a", "b", F.col("dst").alias("node"), F.concat("rels", F.array("r")).alias("rels"), F.concat("nodes", F.array("dst")).alias("nodes"))
        done = at.where("node = b").drop("node")
        out = done if out is None else out.unionByName(done)
        at = at.where("node <> b")
    return out


def classified(paths: DataFrame, kinds: list[Column], templates: list, kind_order=("direct", "valid", "invalid")) -> DataFrame:
    """paths (rels, ..) with verdict: the first of kind_order that a template they follow is of, else unsupported. kinds: the kind of each node along a path, from the start."""
    table = state_table(paths.sparkSession, templates)
    of = {name: what for name, what, _ in templates}
    at = paths.withColumn("_state", F.lit(0)).withColumn("_ends", F.array().cast("array<string>"))
    for i in range(depth(templates)):
        step = F.broadcast(table.select(F.col("state").alias("_s"), F.col("near_kind").alias("_a"), F.col("r").alias("_r"), F.col("far_kind").alias("_b"), F.col("next").alias("_next"), F.col("ends").alias("_e")))
        on = (F.col("_state") == F.col("_s")) & (F.get("rels", F.lit(i)) == F.col("_r")) & (kinds[i] == F.col("_a")) & (kinds[i + 1] == F.col("_b"))
        last = F.size("rels") == i + 1
        at = at.join(step, on, "left").withColumn("_ends", F.when(last, F.col("_e")).otherwise(F.col("_ends"))).withColumn("_state", F.when(F.size("rels") > i, F.coalesce("_next", F.lit(-1))).otherwise(F.col("_state"))).drop("_s", "_a", "_r", "_b", "_next", "_e")
    names = lambda what: F.array(*[F.lit(n) for n in of if of[n] == what]).cast("array<string>")
    verdict = F.coalesce(*[F.when(F.arrays_overlap(F.coalesce("_ends", F.array().cast("array<string>")), names(what)), F.lit(what)) for what in kind_order], F.lit("unsupported"))
    return at.withColumn("verdict", verdict).drop("_state", "_ends")
