"""Retrieval under a budget: only what can be among the first triples is moved."""

from tripleforge.operators import graph as g
from tripleforge.operators import retrieval as r
from tripleforge.sources.store import written


def test_filled_moves_no_more_than_the_budget(spark):
    nodes = spark.createDataFrame([("t", q, q * 100 + p, p) for q in range(3) for p in range(6)], "split string, row_index long, node long, o1 int")
    edges = spark.createDataFrame([(q * 100 + p, q * 100 + p, "x", 1000 + e, e) for q in range(3) for p in range(6) for e in range(1, 8 - q)], "node long, h long, r string, t long, place int")
    got = r.filled(nodes, edges, "o1", 10).groupBy("row_index").count().collect()
    assert {x["row_index"]: x["count"] for x in got} == {0: 10, 1: 10, 2: 10}


def test_stages_after_those_known(spark):
    """Evidence in two goes is the evidence of all stages at once; triples that come again keep their first place."""
    stage = lambda rows: spark.createDataFrame([("t", q, h, "x", h + 1, o) for q, h, o in rows], "split string, row_index long, h long, r string, t long, o1 int")
    stages = [stage([(0, 5, 2), (0, 3, 1), (1, 9, 1)]), stage([(0, 3, 0), (0, 7, 0), (1, 1, 0)]), stage([(0, 8, 0), (1, 9, 0), (1, 2, 1)])]
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    first = written(r.evidence(stages[:1], 4))
    assert rows(r.evidence(stages[1:], 4, first, 1)) == rows(r.evidence(stages, 4))


def test_shortest_paths_end_at_the_longest_length(spark):
    edges = spark.createDataFrame([(k, "x", k + 1) for k in range(12)], "h long, r string, t long")
    pairs = spark.createDataFrame([(0, 9), (0, 11), (2, 12)], "a long, b long")
    lengths = lambda most: {(x["a"], x["b"]): x["count"] for x in g.shortest_paths(pairs, edges, most).groupBy("a", "b").count().collect()}
    assert lengths(9) == {(0, 9): 9}
    assert lengths(None) == {(0, 9): 9, (0, 11): 11, (2, 12): 10}
