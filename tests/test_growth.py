"""Steps that move no more than their pairs need, and still all of that."""

import random

import pytest

from tripleforge.operators import assembly
from tripleforge.operators import graph as g
from tripleforge.plans import features
from tripleforge.sources.derived import Graph

SF = "/root/testdata/sf0.001"


def test_gene_sets_of_pairs(spark):
    kg = Graph(spark, SF)
    pairs = kg.candidates().selectExpr("cand as a", "query_id as b").distinct()
    rows = lambda df: sorted(map(tuple, df.select("node", "near", "place").collect()))
    for got, whole, end in zip(features.gene_sets(kg, 7, 9, pairs), features.gene_sets(kg, 7, 9), "ab", strict=True):
        ends = {r[0] for r in pairs.select(end).collect()}
        assert rows(got) == [r for r in rows(whole) if r[0] in ends] != []


def test_paths_of_many_starts(spark):
    """More starts than one whole number has bits, paths of at most so many edges, and the first relation of parallel edges."""
    edges = [(k, "y" if k % 2 else "x", k + 1) for k in range(99)] + [(0, "b", 1), (0, "a", 1)]
    steps = spark.createDataFrame([*edges, *[(t, r, h) for h, r, t in edges]], "src long, r string, dst long")
    pairs = spark.createDataFrame([(a, b) for a in range(100) for b in (0, 50)], "a long, b long")
    got = {(r.a, r.b): (list(r.path), list(r.rels)) for r in assembly.meeting_paths(pairs, steps, 6).collect()}
    assert set(got) == {(a, b) for a in range(100) for b in (0, 50) if abs(a - b) <= 6}
    assert got[3, 0] == ([3, 2, 1, 0], ["x", "y", "a"]) and got[0, 0] == ([0], []) and got[51, 50] == ([51, 50], ["x"])


def brute_path(pairs, edges, most):
    """{(a, b): nodes} by breadth-first search from a and the least node back from b at every step."""
    near = {}
    for h, _, t in edges:
        near.setdefault(h, set()).add(t)
        near.setdefault(t, set()).add(h)
    out = {}
    for a, b in pairs:
        dist, last = {a: 0}, {a}
        for d in range(1, most + 1):
            last = {y for x in last for y in near.get(x, ()) if y not in dist}
            dist |= dict.fromkeys(last, d)
        if a != b and b in dist:
            path = [b]
            while path[0] != a:
                path.insert(0, min(x for x in near[path[0]] if dist.get(x) == dist[path[0]] - 1))
            out[a, b] = path
    return out


@pytest.mark.parametrize("most", [1, 4, 7])
def test_shortest_paths_that_meet_half_way(spark, most):
    """Odd and even lengths, equally short ways, parallel edges, self-loops, nodes without edges."""
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.choice("xy"), rnd.randrange(60)) for _ in range(85)] + [(5, "x", 5)]
    pairs = [(rnd.randrange(70), rnd.randrange(70)) for _ in range(60)] + [(5, 5), edges[0][::2]]
    got = {}
    for x in g.shortest_paths(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(edges, "h long, r string, t long"), most).collect():
        got.setdefault((x.a, x.b), {})[x.step] = (x.src, x.r, x.dst)
        assert x.r == min(r for h, r, t in edges if {h, t} == {x.src, x.dst})
    assert {k: [v[0][0], *[v[s][2] for s in range(len(v))]] for k, v in got.items()} == brute_path(pairs, edges, most)


def test_shortest_paths_reach_half_of_the_length_only(spark, monkeypatch):
    """From the root of a tree to a node seven edges away: neither side goes on to all leaves."""
    sizes, kept = [], g.written
    monkeypatch.setattr(g, "written", lambda df, name="table": (out := kept(df, name), name == "steps" or sizes.append(out.count()))[0])
    edges = [(k, "x", 3 * k + j) for k in range(1, 1100) for j in (0, 1, 2)]
    leaf = 1
    for _ in range(7):
        leaf = 3 * leaf + 1
    assert g.shortest_paths(spark.createDataFrame([(1, leaf)], "a long, b long"), spark.createDataFrame(edges, "h long, r string, t long"), 9).count() == 7
    assert max(sizes) < 300
