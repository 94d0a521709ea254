"""Annotation flags, annotated triples and path templates against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tripleforge.operators import annotations, templates
from tripleforge.plans import annotated
from tripleforge.sources.derived import Graph

SF = "/root/testdata/sf0.001"
KEY = ["split", "row_index"]


def test_flags_are_read(spark):
    texts = ["1", " Yes ", "y", "TRUE", "0", "2", "no", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "f string")
    assert [r[0] for r in df.select(annotations.truth(F.col("f"), "string")).collect()] == [True, True, True, True, False, False, False, False, False]
    df = spark.createDataFrame([(0.0,), (2.0,), (None,)], "f double")
    assert [r[0] for r in df.select(annotations.truth(F.col("f"), "double")).collect()] == [False, True, False]


def test_alignment_modes(spark):
    cands = spark.createDataFrame([("v", r, p, f"n{p}") for r in (0, 1, 2) for p in (1, 2, 3)], "split string, row_index long, pos int, name string")
    notes = [("v", 0, 1, "n3", "yes"), ("v", 0, 2, "n2", "no"), ("v", 0, 3, "n1", "no"), ("v", 1, 1, "n2", "yes"), ("v", 1, 2, "n2", "no"), ("v", 1, 3, "x", "yes"), ("v", 1, 4, "n1", "1")]
    notes = spark.createDataFrame(notes, "split string, row_index long, pos int, name string, flag string")
    flags = lambda **kw: {(r.row_index, r.pos) for r in annotations.aligned(cands, notes, **kw).collect() if r.contra}
    assert flags() == {(0, 3), (1, 1)}  # the last note of a name counts
    assert flags(mode="position") == {(0, 1)}
    assert flags(mode="position", fallback=F.col("pos") == 2) == {(0, 1), (1, 2), (2, 2)}
    with pytest.raises(ValueError, match="mode"):
        annotations.aligned(cands, notes, "other")


@pytest.mark.parametrize("twice", [False, True])
def test_annotated_triples(spark, twice):
    rnd = random.Random(3)
    cands, triples, info = [], [], {}
    for row in range(6):
        ids = rnd.sample(range(12), 5)
        ranks = rnd.sample(range(1, 20), 5)
        info[row] = {c: (p, rk, rnd.random() < 0.4) for p, (c, rk) in enumerate(zip(ids, ranks, strict=True), 1)}
        cands += [("v", row, c, *info[row][c]) for c in ids]
        triples += [("v", row, 99, i, rnd.choice([*range(12), 99]), rnd.choice("abc"), rnd.choice([*range(12), 99])) for i in range(25)]
        triples.append(("v", row, 99, 25, ids[0], "a", ids[0]))
    rules = [("a", "C", "D"), ("b", "C", None)]
    t = spark.createDataFrame(triples, "split string, row_index long, query_id long, idx int, h long, r string, t long")
    c = spark.createDataFrame(cands, "split string, row_index long, cand long, pos int, rank int, contra boolean")
    out = annotations.annotate(t, c, spark.createDataFrame(rules, "r string, domain string, range string"), "D", "C", twice).withColumn("score", annotations.score())
    got = {(r.row_index, r.idx): r for r in out.collect()}
    assert len(got) == len(triples)
    best = {}
    for _, row, q, i, h, r, tail in triples:
        own = info[row]
        ends = [x for x in (h, tail) if x in own]
        at = [own[x][0] for x in ends]
        at = at[:1] if h == tail and not twice else at
        kind = lambda x: "D" if x == 99 else "C" if x in own else None  # noqa: B023, E731
        rule = dict((a, (b, d)) for a, b, d in rules).get(r)
        known = rule and None not in rule and kind(h) and kind(tail)
        degree = Counter(x for _, rw, _, _, a, _, b in triples if rw == row for x in (a, b))
        query, contra, top = q in (h, tail), any(own[x][2] for x in ends), min((own[x][1] for x in ends), default=99)
        x = got[row, i]
        assert list(x.positions) == at and x.touches_query == query and x.touches_candidate == bool(ends) and x.direct == (query and bool(ends))
        assert x.contra == contra and x.top_band == (top <= 5) and x.ontology == ((kind(h), kind(tail)) == rule if known else None)
        assert x.frequency == sum((a, b, d) == (h, r, tail) for _, rw, _, _, a, b, d in triples if rw == row) and x.density == degree[h] + degree[tail]
        band = 0 if not ends else 1 if top <= 5 else 0.6 if top <= 10 else 0.25
        score = round(band + 0.35 * bool(ends) + 0.05 * query - 0.8 * (query and bool(ends)) - 0.1 * contra + 0.05 * min(x.density, 10) / 10, 6)
        assert x.score == pytest.approx(score, abs=1e-9)
        for p in at:
            best.setdefault((row, p), []).append((score, query and bool(ends)))
    tops = {row: max(got[row, i].score for i in range(26)) for row in range(6)}
    bonus = {(r.row_index, r.pos): (r.bonus, r.direct) for r in annotations.touched(out).collect()}
    assert bonus == {k: (pytest.approx(max(0, max(s for s, _ in v) / (tops[k[0]] if tops[k[0]] > 0 else 1))), any(d for _, d in v)) for k, v in best.items()}


TEMPLATES = [("d", "direct", [("A", ("x",), "B")]), ("v1", "valid", [("A", ("x", "y"), "B"), ("B", ("z",), "A")]), ("v2", "valid", [("A", ("x", "y"), "B"), ("B", ("y",), "B"), ("B", ("z",), "A")]), ("no", "invalid", [("A", ("z",), "A")])]


def test_state_table_shares_beginnings(spark):
    rows = templates.state_table(spark, TEMPLATES).collect()
    starts = {(r.near_kind, r.far_kind, r.next) for r in rows if r.state == 0 and r.r == "y"}
    assert len(starts) == 1 and len({(r.state, r.near_kind, r.r, r.far_kind) for r in rows}) == len(rows)
    steps = [r for r in rows if r.state == 0 and r.r == "x"]
    assert len(steps) == 1 and list(steps[0].ends) == ["d"]  # one step for the three templates that begin with it
    assert {n for r in rows for n in r.ends} == {"d", "v1", "v2", "no"}


def test_templates_equal_brute_force(spark):
    rnd = random.Random(6)
    kind = lambda n: "A" if n % 2 else "B"
    edges = [(row, rnd.randrange(12), rnd.choice("xyz"), rnd.randrange(12)) for row in range(5) for _ in range(26)]
    both = [("v", row, a, r, b) for row, h, r, t in edges for a, b in {(h, t), (t, h)}]
    pairs = [("v", row, a, b) for row in range(5) for a in (1, 3, 5) for b in (7, 2, 4)]
    e = spark.createDataFrame(both, "split string, row_index long, src long, r string, dst long")
    p = spark.createDataFrame(pairs, "split string, row_index long, a long, b long")
    kinds = spark.createDataFrame([(n, kind(n)) for n in range(12)], "id long, kind string")

    def paths(row, at, b, most, seen, rels):
        for _, w, u, r, v in both:
            if w == row and u == at and v not in seen:
                if v == b:
                    yield (*rels, r), (*seen, v)
                elif most > 1:
                    yield from paths(row, v, b, most - 1, (*seen, v), (*rels, r))

    def names(rels, nodes):
        return {n for n, _, steps in TEMPLATES if len(steps) == len(rels) and all(kind(nodes[i]) == k and rels[i] in rs and kind(nodes[i + 1]) == f for i, (k, rs, f) in enumerate(steps))}

    every = [(row, a, b, rels, nodes) for _, row, a, b in pairs for rels, nodes in paths(row, a, b, 3, (a,), ())]
    found = templates.matched(p, e, kinds, TEMPLATES, KEY)
    want = {(row, a, b, n) for row, a, b, rels, nodes in every for n in names(rels, nodes)}
    assert {(r.row_index, r.a, r.b, r.template) for r in found.collect()} == want and len({w[3] for w in want}) == 4

    s = templates.sequences(p, e, KEY)
    got = templates.classified(s, [F.when(F.get("nodes", F.lit(i)) % 2 == 1, "A").when(F.get("nodes", F.lit(i)).isNotNull(), "B") for i in range(4)], TEMPLATES).collect()
    assert Counter((r.row_index, r.a, r.b, tuple(r.rels), tuple(r.nodes)) for r in got) == Counter(every)
    of = {n: k for n, k, _ in TEMPLATES}
    for r in got:
        verdicts = {of[n] for n in names(tuple(r.rels), tuple(r.nodes))}
        assert r.verdict == next((v for v in ("direct", "valid", "invalid") if v in verdicts), "unsupported")

    cands = p.select(*KEY, F.col("b").alias("query_id"), F.col("a").alias("cand")).where("query_id = 7")
    some = found.where("b = 7")
    kept = templates.kept(cands, some, TEMPLATES, KEY).collect()
    support = {(row, a): min((0 if of[n] == "direct" else 1 for w, x, b, n in want if (w, x, b) == (row, a, 7) and of[n] != "invalid"), default=None) for row in range(5) for a in (1, 3, 5)}
    for r in kept:
        none = all(support[r.row_index, a] is None for a in (1, 3, 5))
        at = support[r.row_index, r.cand]
        assert (r.support, r.kept, r.fallback) == (None if at is None else ("direct", "valid")[at], at is not None or none, none)


def test_annotations_of_the_graph_say_something(spark):
    """The derived annotations have contra flags, in either mode, and they differ."""
    kg = Graph(spark, "/root/testdata/sf0.01")
    by = {m: {(r.split, r.row_index, r.cand) for r in annotated.annotated_candidates(kg, m).where("contra").collect()} for m in ("name", "position")}
    assert by["name"] and by["position"] and by["name"] != by["position"]
