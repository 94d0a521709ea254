"""Paths, walks, assembled subgraphs and the index of edges against plain loops."""

import random
from collections import Counter, deque

import pytest

from tripleforge.operators import assembly
from tripleforge.sources.adjacency import Adjacency


def some_graph(seed, nodes=30, edges=45):
    rnd = random.Random(seed)
    return [(rnd.randrange(nodes), rnd.choice("xyz"), rnd.randrange(nodes)) for _ in range(edges)]


def near(edges):
    out = {}
    for h, r, t in edges:
        out.setdefault(h, set()).add((r, t))
        out.setdefault(t, set()).add((r, h))
    return out


def first_path(around, a, b):
    """Nodes from a to b: distances from a, then back from b over the least node each time."""
    dist, todo = {a: 0}, deque([a])
    while todo:
        u = todo.popleft()
        for _, v in around.get(u, ()):
            if v not in dist:
                dist[v] = dist[u] + 1
                todo.append(v)
    if b not in dist:
        return None
    path = [b]
    while path[-1] != a:
        path.append(min(v for _, v in around[path[-1]] if dist.get(v) == dist[path[-1]] - 1))
    return path[::-1]


def walk(around, start, rule):
    out, u = [], start
    for r in rule:
        ends = [v for x, v in around.get(u, ()) if x == r]
        if not ends:
            return None
        out.append((u, r, min(ends)))
        u = min(ends)
    return out


def assembled(edges, query, cands, rules, size):
    around = near(edges)
    label = lambda u, v: (u, min(r for r, w in around[u] if w == v), v)
    out = []
    for c in cands:
        path = first_path(around, c, query)
        out += [(1, *label(u, v)) for u, v in zip(path or [], (path or [])[1:], strict=False)]
    if len(out) < size:
        for c in cands:
            for rule in rules:
                way = walk(around, query, rule)
                if way is not None and (way[-1][2] if way else query) == c:
                    for e in way:
                        if len(out) < size:
                            out.append((2, *e))
    if len(out) < size:
        for u in [query, *cands]:
            for rule in rules:
                for e in walk(around, u, rule) or []:
                    if len(out) < size:
                        out.append((3, *e))
    if len(out) < size:
        have, members = {x[1:] for x in out}, [query, *cands]
        for i, u in enumerate(members):
            for j, v in enumerate(members):
                for _, r in sorted((j, r) for h, r, t in edges for x, y in ([(h, t), (t, h)]) if (x, y) == (u, v) and u != v):
                    if (u, r, v) not in have and len(out) < size:
                        out.append((4, u, r, v))
    return [(k + 1, *x) for k, x in enumerate(out)]


def test_meeting_paths(spark):
    """All pairs of a sparse graph, its parts not connected with each other, against breadth-first search; a long chain too."""
    edges = [*some_graph(1, 40, 38), *[(100 + k, "x", 101 + k) for k in range(17)]]
    around = near(edges)
    nodes = [*range(0, 40, 3), 100, 117, 109, 999]
    pairs = [(a, b) for a in nodes for b in nodes]
    df = spark.createDataFrame(pairs, "a long, b long")
    steps = Adjacency.of(spark.createDataFrame(edges, "h long, r string, t long"), 4).rows().select("src", "dst").distinct()
    got = {(r.a, r.b): list(r.path) for r in assembly.meeting_paths(df, steps).collect()}
    want = {(a, b): p for a, b in pairs if (p := first_path(around, a, b))}
    assert got == want and len(got[100, 117]) == 18
    assert assembly.meeting_paths(df.limit(0), steps).collect() == []


@pytest.mark.parametrize("size", [3, 12, 200])
def test_assembled_subgraphs(spark, size):
    rules = [["x", "y"], ["x"], ["x", "y", "z"], ["z", "z"], ["w"]]
    edges = [*some_graph(2, 18, 40), (3, "x", 4), (4, "x", 3)]
    rnd = random.Random(5)
    rows = [("valid" if k % 2 else "test", k, rnd.randrange(18), rnd.sample([*range(18), 77], 5)) for k in range(14)]
    cands = spark.createDataFrame([(s, k, q, i + 1, c) for s, k, q, cs in rows for i, c in enumerate(cs)], "split string, row_index long, query_id long, pos int, cand long")
    index = Adjacency.of(spark.createDataFrame(edges, "h long, r string, t long"), 4)
    got = {}
    for r in assembly.assemble(cands, index, rules, size, ["split", "row_index"]).collect():
        got.setdefault((r.split, r.row_index), []).append((r.place, r.stage, r.src, r.r, r.dst))
    want = {(s, k): assembled(edges, q, cs, rules, size) for s, k, q, cs in rows}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert size < 200 or {x[1] for v in got.values() for x in v} == {1, 2, 3, 4}
    assert assembly.assemble(cands.limit(0), index, rules, size, ["split", "row_index"]).count() == 0


def test_index_of_edges(spark):
    edges = sorted(set(some_graph(3, 50, 300)))
    frame = lambda x: spark.createDataFrame(x, "h long, r string, t long")
    rows = lambda index: Counter(map(tuple, index.rows().collect()))
    both = lambda x: Counter([(h, t, h, r, t) for h, r, t in x] + [(t, h, h, r, t) for h, r, t in x if h != t])
    index = Adjacency.of(frame(edges), 4)
    assert rows(index) == both(edges)
    fresh = [(1, "new", 2), (60, "new", 61), edges[0]]
    changed = index.changed(frame(fresh), frame(edges[:40]))
    now = {*edges[40:], *fresh}
    assert rows(changed) == both(now) and rows(index) == both(edges)
    again = changed.changed(frame([(7, "x", 7)]), frame([(1, "new", 2)]))
    now = now - {(1, "new", 2)} | {(7, "x", 7)}
    assert rows(again) == both(now) == rows(again.compact())
    index.drop()


def test_index_is_not_shuffled(spark):
    """Steps from nodes, and first edges of each node, read the index in its buckets: the only exchange is on the nodes' side."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = Adjacency.of(spark.createDataFrame(some_graph(4, 50, 300), "h long, r string, t long"), 4)
        nodes = spark.range(500).withColumnRenamed("id", "src")
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert plan(nodes.join(index.rows(), "src")).count("Exchange hashpartitioning") <= 1
        assert "Exchange" not in plan(index.rows().groupBy("src", "r").agg({"dst": "min"}))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
