"""Search by inner product against full scoring."""

import numpy as np
import pytest

from tripleforge.operators import search


def frame(spark, ids, vecs):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vecs, strict=True)], "id long, vec array<double>")


@pytest.mark.parametrize(("k", "spread"), [(5, 3.0), (1, 0.0), (50, 1.0)])
def test_top_products(spark, k, spread):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(160, 8)) * np.exp(rng.normal(size=(160, 1)) * spread)
    v[10:20] = v[0]  # equal scores
    w = rng.normal(size=(23, 8))
    w[3] = 0
    ids, qs = rng.permutation(1000)[:160], rng.permutation(1000)[:23]
    s = np.round(w @ v.T, search.DIGITS)
    drop = {(int(qs[a]), int(ids[b])) for a in range(23) for b in np.argsort(-s[a])[: a % 4]}
    gone = spark.createDataFrame([*drop, (5000, 1)], "q long, id long")
    got, stats = search.top_products(frame(spark, qs, w), frame(spark, ids, v), gone, k, rows=8, query_rows=4)
    want = set()
    for a, q in enumerate(qs.tolist()):
        order = sorted((-s[a, b], int(ids[b])) for b in range(160) if (q, int(ids[b])) not in drop)[:k]
        want |= {(q, i, round(-x, 5) + 0.0, p) for p, (x, i) in enumerate(order, 1)}
    assert {(r.q, r.id, round(r.score, 5), r.pos) for r in got.collect()} == want
    assert stats["pairs"] == 20 * 6 and (spread < 3 or stats["met"] < stats["pairs"] / 2)

    keys = list(range(23))
    golds = [(a, int(ids[(a * 7) % 160]), [float(x) for x in w[a]], float(s[a, (a * 7) % 160])) for a in keys]
    out = [(int(a), int(i)) for a, q in enumerate(qs.tolist()) for i in ids if (q, int(i)) in drop and int(i) != golds[a][1]]
    found = search.places(spark.createDataFrame(golds, "key long, gold long, vec array<double>, score double"), frame(spark, ids, v), spark.createDataFrame(out, "key long, id long"), rows=8, query_rows=4)
    places = {a: 1 + sum((s[a, b] > x or (s[a, b] == x and ids[b] < g)) and (a, int(ids[b])) not in set(out) for b in range(160)) for a, g, _, x in golds}
    assert {r.key: r.place for r in found.collect()} == places


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "q long, id long")
    some, empty = frame(spark, [1, 2], [[1.0, 0.0], [0.0, 2.0]]), frame(spark, [], [])
    assert search.top_products(empty, some, none, 3)[0].count() == search.top_products(some, empty, none, 3)[0].count() == 0
    got, stats = search.top_products(some, some, spark.createDataFrame([(1, 1), (1, 2)], "q long, id long"), 3)
    assert [(r.q, r.id, r.score) for r in got.orderBy("q", "pos").collect()] == [(2, 2, 4.0), (2, 1, 0.0)] and stats == {"pairs": 1, "met": 1}


def test_vectors_move_for_panels(spark, monkeypatch):
    """Several panels and excluded vectors in each; a vector is moved once for a panel of the other side."""
    monkeypatch.setattr(search, "PANEL", 3)
    test_top_products(spark, 5, 0.5)
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(9)], "q_block long, block long")
    left = spark.createDataFrame([(a, [1]) for a in range(6)], "q_block long, q_ids array<long>")
    right = spark.createDataFrame([(b, [1]) for b in range(9)], "block long, ids array<long>")
    gone = spark.createDataFrame([(4, 7, [1], [1])], "q_block long, block long, gone_q array<long>, gone_id array<long>")
    import pandas as pd

    sizes = search._panels(pairs, left, right, gone).applyInPandas(lambda x, y: pd.DataFrame({"a": [len(x)], "b": [len(y)]}), "a long, b long").collect()
    assert sorted((r.a, r.b) for r in sizes) == [(3, 3)] * 5 + [(4, 3)]
