"""Sweeps, seeded noise, aliases and the inventory against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tripleforge.operators import aliases, inventory, sweep
from tripleforge.plans import registry
from tripleforge.plans.features import soft_ranked
from tripleforge.sources import files
from tripleforge.sources.derived import Graph

SF = "/root/testdata/sf0.001"
KEY = "split string, row_index long, gold_id long, "


def reranked(cands, beta, weight, gamma):
    """Candidates (pos, cand, e, d, x) in the order of a setting."""
    s = [e - beta * d - gamma * x for _, _, e, d, x in cands]
    lo, hi = min(s), max(s)
    norm = [0.5 if abs(hi - lo) < 1e-12 else (v - lo) / (hi - lo) for v in s]
    final = [weight * ((20 - c[0] + 1) / 20) + (1 - weight) * n for c, n in zip(cands, norm, strict=True)]
    return [c[1] for _, _, _, c in sorted((-round(f, 9), -round(v, 9), c[0], c) for f, v, c in zip(final, s, cands, strict=True))]


def test_sweep_equals_the_loop(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(25):
        n = rnd.choice([1, 5, 20])
        cands = [(p, c, rnd.choice([0.1, 0.5, 0.9]), rnd.choice([0.0, 0.5, 1.0]), float(rnd.random() < 0.3)) for p, c in enumerate(rnd.sample(range(30), n), 1)]
        rows.append(("valid" if i % 2 else "test", i, rnd.randrange(30), [c if i else (c[0], c[1], 0.5, 0.5, 0.0) for c in cands]))
    df = spark.createDataFrame([(s, i, g, *c) for s, i, g, cs in rows for c in cs], KEY + "pos int, cand long, e double, d double, x double")
    settings = sweep.grid((0.0, 0.5), (0.3, 0.9, 1.0), (0.0, 0.2))
    got = sweep.swept(df, settings)
    want = {}
    for s, i, g, cs in rows:
        for n, setting in enumerate(settings):
            order = reranked(cs, *setting)
            want[s, i, n] = (order.index(g) + 1 if g in order else 21, order[0])
    assert {(r.split, r.row_index, r.setting): (r.rank, r.top) for r in got.collect()} == want

    raw = {s: sum((1 / (p if (p := next((c[0] for c in cs if c[1] == g), 21)) <= 20 else float("inf"))) for t, _, g, cs in rows if t == s) / sum(t == s for t, *_ in rows) for s in ("valid", "test")}
    base = spark.createDataFrame(list(raw.items()), "split string, mrr double")
    m = sweep.metrics(got, ["split", "setting"])
    for top1, ratio in ((0.5, 0.5), (0.0, 0.5), (1.0, 99.0)):
        for r in sweep.choose(m, base, top1, ratio, ["split"]).collect():
            of = {}
            for n in range(len(settings)):
                ranks = [v for (s, _, k), v in want.items() if (s, k) == (r.split, n)]
                tops = [t for _, t in ranks]
                of[n] = (sum(1 / x for x, _ in ranks if x <= 20) / len(ranks), sum(x <= 10 for x, _ in ranks) / len(ranks), max(tops.count(t) for t in tops) / len(tops))
            fits = [n for n, (mrr, _, dom) in of.items() if dom <= top1 and mrr >= ratio * raw[r.split]]
            best = min(fits or of, key=lambda n: (-round(of[n][0], 9), -round(of[n][1], 9), round(of[n][2], 9), n))
            assert (r.setting, r.balanced) == (best, bool(fits))


def test_seeded_noise_is_the_standard_generators(spark):
    rows = {}
    for r in soft_ranked(Graph(spark, SF)).collect():
        rows.setdefault((r.split, r.row_index), []).append((r.pos, r.cand, r.support))
    got = {(r.split, r.row_index, r.cand): (r.noise, r.rank) for r in registry.QUERIES["sens01_seeded_noise"](spark, SF).collect()}
    for (split, row), cands in rows.items():
        draw = random.Random(2026 + {"valid": 100_000, "test": 200_000}[split] + row)
        noise = [draw.gauss(0.0, 0.05) for _ in cands]
        noisy = [(-(s + e), p, c, e) for (p, c, s), e in zip(sorted(cands), noise, strict=True)]
        for rank, (_, _, c, e) in enumerate(sorted(noisy), 1):
            assert got[split, row, c] == (e, rank)
    assert len(got) == sum(map(len, rows.values()))


def test_aliases(spark):
    entities = ["A::U:1", "A::1", "2", "A::3", "A::U:3", "x", "X "]
    forms = lambda c: [("full", F.col(c)), ("short", F.concat(F.lit("A::"), F.element_at(F.split(F.col(c), ":"), -1))), ("bare", F.element_at(F.split(F.col(c), ":"), -1)), ("low", F.lower(F.trim(F.col(c))))]
    known = aliases.index(spark.createDataFrame([(e,) for e in [*entities, "x"]], "entity string"), [("whole", F.col("entity")), ("low", F.lower(F.trim(F.col("entity"))))])
    names = spark.createDataFrame([("A::U:1",), ("A::U:2",), ("A::U:3",), ("A::U:4",), ("X",), ("A::U:1",), ("",)], "name string")
    got = {r.name: tuple(r)[1:] for r in aliases.resolve(names, forms("name"), known).collect()}
    assert got == {
        "A::U:1": ("A::U:1", "full", 3, False, True),  # the short form finds another entity
        "A::U:2": ("2", "bare", 1, False, False),
        "A::U:3": ("A::U:3", "full", 3, False, True),
        "A::U:4": (None, None, 0, False, False),
        "X": ("X ", "low", 1, True, False),  # two entities have that form; the least counts
        "": (None, None, 0, False, False),
    }


def test_inventory(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(f"DB{rnd.randrange(300):05d}", rnd.choice(["Approved", "Terminated (x)", " ", None]), rnd.choice(["1", "-2.5e3", "a", ".5"]), [1, 2]) for _ in range(4000)]
    spark.createDataFrame(rows, "`DrugBank ID` string, `Trial.Status` string, val string, list array<int>").write.parquet(f"{tmp_path}/trials.parquet")
    spark.createDataFrame([(1, None)], "cui int, `Disease` string").write.parquet(f"{tmp_path}/few.parquet")
    (tmp_path / "notes.txt").write_text("no table")
    names = files.tables_in(spark, f"file://{tmp_path}")
    assert names == ["few", "trials"]
    p = [inventory.profiles(spark.read.parquet(f"{tmp_path}/{n}.parquet"), n) for n in names]
    p = p[0].unionByName(p[1])
    got = {(r.tab, r.col): r for r in inventory.roles(p).collect()}
    status = [r[1] for r in rows]
    x = got["trials", "Trial.Status"]
    assert (x.n_rows, x.blanks, x.approved, x.failed) == (4000, sum(not (s or "").strip() for s in status), status.count("Approved"), status.count("Terminated (x)")) and list(x.roles) == ["status"]
    x = got["trials", "DrugBank ID"]
    assert x.drug_ids == 4000 and x.longest == 7 and x.distinct == pytest.approx(len({r[0] for r in rows}), rel=0.05) and list(x.roles) == ["drugbank_id", "drug_name"]
    assert got["trials", "val"].numbers == sum(r[2] != "a" for r in rows) and list(got["few", "cui"].roles) == ["umls"]
    t = {r.tab: r for r in inventory.tables(p).collect()}
    assert t["trials"].score == pytest.approx(4 + 0.4 + 10 + 8 + 4) and t["few"].score == pytest.approx(0.001 + 0.2 + 8 + 4)
    assert t["trials"].best and not t["few"].best
