"""Passages of op10: all of 50 words are found wherever they stand, and nothing that shares fewer than the words of a run."""

import random

import pytest

from tripleforge.llm import linededup, queries


def test_every_passage_is_found(spark, tmp_path):
    rnd = random.Random(11)
    some = lambda n: [f"w{rnd.randrange(10**7)}" for _ in range(n)]
    texts = []
    for k in range(120):
        # Even pairs share 50 words, odd ones fewer than a run; their lines end elsewhere.
        passage = some(50 if k % 2 == 0 else linededup.RUN - 1)
        for _ in range(2):
            words = [*some(rnd.randrange(60)), *passage, *some(rnd.randrange(60))]
            texts.append("".join(w.upper() + rnd.choice([" ", "  ", "\n", "\t"]) for w in words))
    texts += ["again " * 200, "x " + "again " * 90, None, "", "one"]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op10_repeated_lines(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {i for i in range(240) if i % 4 < 2} | {240, 241}
    for r in got:
        assert linededup.RUN <= r.words <= 50 and len(texts[r.doc_id][r.start : r.end].split()) == r.words and r.kept == (r.doc_id % 2 == 0) and r.kept_doc_id == r.doc_id // 2 * 2


def test_parts_of_passages(spark):
    """A copy of two passages and a text of its own: parts don't overlap, equal rows are one document."""
    rnd = random.Random(12)
    some = lambda n: " ".join(f"w{rnd.randrange(10**7)}" for _ in range(n))
    a, b = some(90), some(80)
    d = spark.createDataFrame([(1, a), (2, f"{b} {some(20)}"), (3, f"{a} {b}"), (4, f"{some(9)}"), (5, some(100)), (5, None), (6, f"{b}"), (6, f"{b}")], "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.end, r.kept, r.kept_doc_id) for r in linededup.shared_passages(d).collect())
    assert {g[0] for g in got} == {1, 2, 3, 6} and {(g[0], g[3], g[4]) for g in got} >= {(1, True, 1), (2, True, 2), (3, False, 1)}
    assert all(x[2] <= y[1] for x, y in zip(got, got[1:]) if x[0] == y[0] != 6)
    alone = spark.createDataFrame([(6, b), (6, b)], "doc_id long, text string")
    assert linededup.shared_passages(alone).count() == 0
    with pytest.raises(ValueError):
        linededup.shared_passages(d, 51)
