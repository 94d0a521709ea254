"""Text operators against brute force and on awkward rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import json
import random
import re
import subprocess
import sys
import tempfile
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleforge.llm import common, decontaminate, editprint, hmm, licences, linededup, mixing, neardup, privacy, quality, toolcalls
from tripleforge.llm.common import components, word_count

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, root string"
W = "alpha beta gamma delta omega kappa sigma theta lambda epsilon".split()


def rows(extra=()):
    rnd = random.Random(1)
    base = [" ".join(rnd.choice(W) + str(rnd.randrange(40)) for _ in range(60)) for _ in range(12)]
    near = [" ".join(w if k % 30 else "edited" for k, w in enumerate(t.split())) for t in base[:6]]
    texts = [*base, *near, base[0], base[0], "", None, " \n\t ", "word", "Line one two three four five.\n" * 3, "x " * 5000, *extra]
    out = [(i, t, "en", ["a", "b", None][i % 3], len(t or ""), 0.5, 7, "r") for i, t in enumerate(texts)]
    return [*out, out[0], (None, base[1], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def test_word_count(docs):
    assert all(r.n == len(words(r.text)) for r in docs.select("text", word_count(F.col("text")).alias("n")).collect())


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)], "a long, b long")
    assert {r.v: r.root for r in components(e).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


@pytest.mark.parametrize("small", [0, 48])
def test_near_duplicates(docs, none, small, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_GROUP", small)
    got = neardup.near_duplicates(docs, width=2).collect()
    assert len(got) == docs.count() and neardup.near_duplicates(none, width=2).count() == 0
    sets = {}
    for i, t, *_ in rows():
        w = words(t)
        sets[i] = {tuple(w)} if len(w) == 1 else set(zip(w, w[1:]))
    least = {i: i for i in sets}
    order = lambda i: (i is None, i or 0)
    for _ in range(len(sets)):
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and order(least[j]) < order(least[i]):
                    least[i] = least[j]
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id]) and r.component_id == least[r.doc_id] and r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize("rest", [0, 499_999, 999_999_500_000, 10**12 - 1])
def test_near_duplicates_of_any_digest(spark, monkeypatch, rest):
    """Vertices hold a remainder of the digest beside the id; the largest ones must not become the next id."""
    def digests(sizes, sets):
        hi, lo = real(sizes, sets)
        return hi - np.mod(hi, neardup.SPAN) + rest, lo

    real = neardup.set_digests
    monkeypatch.setattr(neardup, "set_digests", digests)
    d = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i}") for i in (-3, 0, 7, 8, 9)] + [(12, "alpha7 beta7 gamma7")], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(d, width=2).collect()}
    assert got == {i: (i, True) for i in (-3, 0, 7, 8, 9)} | {12: (7, False)}


def test_mix(docs, none):
    got = mixing.mix(docs, block_words=16)["documents"]
    a, b = (sorted(map(tuple, mixing.mix(docs, block_words=16)["documents"].collect()), key=repr) for _ in range(2))
    assert a == b and len(a) == docs.count() and mixing.mix(none)["documents"].count() == 0
    assert all(r.taken <= 3 * r.size for r in got.collect())
    per = got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 16 for r in per)
    x = mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 5, np.uint64))
    assert sorted(x) == list(range(1000))
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == pytest.approx([30, 120, 60])


def passages(texts, min_words, piece_words, unit="line"):
    """Brute force over (id, text): the parts of passages, from the units alone; ids ascend."""
    units, seen = [], {}
    for i, t in texts:
        with np.errstate(over="ignore"):
            u = linededup.units_of([(t or "").encode()], piece_words, unit)
        units.append([(i, int(a), int(b), " ".join(words(t[a:b]))) for a, b in zip(u["start"], u["end"])])
        for x in units[-1]:
            seen.setdefault(x[3], []).append((i, x[1]))
    out = set()
    for own in units:
        run = []
        for x in [*own, None]:
            if x and len(seen[x[3]]) > 1:
                run.append(x)
                continue
            if sum(len(w.split()) for w in {y[3] for y in run}) >= min_words:
                part = []
                for y in [*run, None]:
                    kept = y and seen[y[3]][0] == (y[0], y[1])
                    if part and (y is None or kept != part[0][1]):
                        out.add((part[0][0][0], part[0][0][1], part[-1][0][2], part[0][1], *seen[part[0][0][3]][0]))
                        part = []
                    part.append((y, kept))
            run = []
    return out


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_repeated_lines(spark, none, unit):
    rnd = random.Random(5)
    some = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    passage, line, more = some(60), some(7), [some(12), some(9)]
    texts = [f"{some(30)} {passage} {some(30)}", f"{some(9)}\n{some(20)} {passage.upper()}\t {some(11)}\n{some(6)}", f"{line}\n" * 30, f"{line}\n{some(50)}\n{line}", "\n".join([*more, passage, some(8)]) + "\n\n" + some(20), "\u00e9 \U0001f600 " + "\n".join([*more, passage]), "", " \n ", "x", passage, passage]
    d = spark.createDataFrame([*enumerate(texts), (99, None), (9, passage)], "doc_id long, text string")
    got = [(r.doc_id, r.start, r.end, r.kept, r.kept_doc_id, r.kept_start) for r in linededup.repeats(d, linededup.MIN_WORDS, linededup.PIECE_WORDS, unit).collect()]
    assert sorted(got) == sorted(passages(list(enumerate(texts)), linededup.MIN_WORDS, linededup.PIECE_WORDS, unit)) and {1, 4, 5, 9, 10} <= {g[0] for g in got} <= {0, 1, 4, 5, 9, 10}
    assert linededup.repeats(none).count() == linededup.without_repeats(none).count() == 0


def test_without_repeated_lines(spark):
    rnd = random.Random(6)
    some = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    passage = some(60)
    texts = [f"{some(30)} {passage} {some(30)}", f"{some(9)}\n{some(20)} {passage} {some(11)}\n{some(6)}", f"first\n{passage}\nlast", None]
    d = spark.createDataFrame([(i, t, i, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, _id int, spans string, id string")
    got = {r.doc_id: r for r in linededup.without_repeats(d, linededup.MIN_WORDS, linededup.PIECE_WORDS).collect()}
    assert got[0].text == texts[0] and not got[0].removed and got[3].text is None
    assert len(set(passage.split()) & set(got[1].text.split())) <= 20 and set(got[1].text.split()) >= set(texts[1].split()) - set(passage.split())
    assert got[1].text.count("\n") == 2 and got[2].text.split("\n")[0] == "first" and got[2].text.endswith("last")
    assert all((r._id, r.spans, r.id) == (i, "x", "y") for i, r in got.items())
    for r in got.values():
        assert not r.removed or len(texts[r.doc_id]) - len(r.text) == sum(s.end - s.start + 1 for s in r.removed)
    with pytest.raises(ValueError):
        linededup.without_repeats(d.withColumnRenamed("_id", "removed"))


def test_repeated_lines_of_null_ids(spark):
    line = " ".join(f"one{k}" for k in range(45))
    d = spark.createDataFrame([(None, f"{line}\nfirst of them"), (None, f"{line}\nsecond of them")], "doc_id long, text string")
    got = linededup.repeats(d).collect()
    assert [r.kept for r in sorted(got, key=lambda r: r.kept)] == [False, True] and all(r.kept_doc_id is None for r in got)
    assert sorted(r.text for r in linededup.without_repeats(d).collect()) in ([f"{line}\nfirst of them", "second of them"], ["first of them", f"{line}\nsecond of them"])


def lines_of(t, unit):
    """(start, end, normalised) of each line, or paragraph, that has a word, by plain string work."""
    out, at, held = [], 0, None
    for line in (t or "").split("\n"):
        bare = line.strip(" \t\n\x0b\x0c\r")
        if bare:
            a = at + line.index(bare[0] if bare[0] not in " \t" else bare)
            held = (held[0] if held and unit == "paragraph" else a, a + len(bare))
        if held and (unit == "line" or not bare):
            out.append(held)
            held = None
        at += len(line) + 1
    out += [held] if held else []
    return [(a, b, " ".join(words(t[a:b]))) for a, b in out]


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_plain_lines(spark, unit):
    """Lines as they are, of any length: what repeats, which occurrence stays, and what is left of the texts."""
    rnd = random.Random(7)
    stock = ["Yes.", "a b", "A  b", "\t a b \r", "one two three four", "\u00e9 \U0001f600 x", "x" * 500] + [f"only {k}" for k in range(40)]
    texts = ["\n".join(rnd.choice(stock if rnd.random() < 0.8 else ["", "  "]) for _ in range(rnd.randrange(1, 9))) for _ in range(60)] + ["", None, "Yes.", " yes.\n"]
    d = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string").withColumn("start", F.lit(1))
    seen = {}
    for i, t in enumerate(texts):
        for a, b, x in lines_of(t, unit):
            seen.setdefault(x, []).append((i, a, b))
    want = [(i, a, b, len(x.split()), (i, a) == places[0][:2], *places[0][:2]) for x, places in seen.items() for i, a, b in places if len(places) > 1]
    # The repeated row's units count twice in copies, as rows; whether a unit repeats at all doesn't depend on it.
    got = linededup.occurrences(d, unit=unit).collect()
    assert sorted((r.doc_id, r.start, r.end, r.words, r.kept, r.kept_doc_id, r.kept_start) for r in got) == sorted(want)
    gone = {i: {a for j, a, *_, in ((w[0], w[1]) for w in want if not w[4]) if j == i} for i in range(len(texts))}
    left = {r.doc_id: r for r in linededup.without_repeats(d, unit=unit).collect()}
    for i, t in enumerate(texts):
        assert [x for _, _, x in lines_of(left[i].text, unit)] == [x for a, _, x in lines_of(t, unit) if a not in gone[i]]
        assert (left[i].text == t) == (not gone[i])


def test_texts_of_one_id_stay_apart(spark, monkeypatch):
    """Two texts of null ids whose numbers agree: the cuts of one are no cuts of the other."""
    monkeypatch.setattr(linededup, "TEXTS", 1)
    texts = ["the same line\nabc", "something else entirely", "more\nthe same line", "more again"]
    d = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    assert sorted(r.text for r in linededup.without_repeats(d).collect()) in (sorted(["abc", *texts[1:]]), sorted([*texts[:2], "more\n", texts[3]]), sorted([*texts[:2], "more", texts[3]]))


def test_plain_lines_equal_sql(spark):
    con = duckdb.connect()
    con.sql("create view documents as from '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(linededup.occurrences_sql())
    got = linededup.occurrences(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_personal_data(spark, none):
    texts = ["a@b.c_d@e.f x..y@z.w.. 1.2.3.4.5 999.1.1.1 +1 (017) 555-7713", "4111 1111 1111 1111 4111-1111-1111-1112 001.002.003.004 \U0001f600 q@w.e  1.1.1.1", None, "", "a@b" + ".c" * 3000 + "1 " * 3000 + "+1" + "(" * 3000]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, m):
        n = re.sub("[^0-9]", "", m)
        luhn = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(n))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m.split(".")), "card": 16 <= len(n) <= 19 and luhn, "phone": 8 <= len(n) <= 15}[kind]

    for r in privacy.spans(d).collect():
        want = [f"{k}:{m.start()}:{m.end()}" for k, p in plain.items() for m in re.finditer(p, texts[r.doc_id] or "") if good(k, m.group())]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and r.spans.startswith(",".join(want))
    assert privacy.spans(none).count() == 0
    clash = d.withColumn("_id", F.lit(1)).withColumn("cuts", F.lit("x")).withColumn("digest", F.lit(None).cast("string")).withColumn("row", F.lit(2))
    out = {r.doc_id: r for r in privacy.sanitised(clash).collect()}
    assert out[0].text == "[EMAIL][EMAIL] [EMAIL].. [IP].5 999.1.1.1 [PHONE]" and privacy.sanitised(none).count() == 0
    # The two card numbers are one match of over 19 digits, so neither goes.
    assert out[1].text == texts[1].replace("001.002.003.004", "[IP]").replace("q@w.e", "[EMAIL]").replace("1.1.1.1", "[IP]") and out[2].text is None and out[3].text == ""
    assert all((r._id, r.cuts, r.digest, r.row) == (1, "x", None, 2) for r in out.values())


def test_disclosing_terms(spark):
    near = "mister quixotic bob1@mail.example calls windmill daily"
    d = spark.createDataFrame([(i, near) for i in range(3)] + [(i, f"daily mister calls common{i} words") for i in range(3, 200)], "doc_id long, text string")
    got = privacy.spans(d).where("n_email > 0").collect()
    terms = {near[int(a) : int(b)] for k, a, b in (s.split(":") for s in got[0].spans.split(",")) if k == "term"}
    assert terms == {"quixotic", "windmill"}


def test_terms_of_an_entity_in_one_document(spark):
    filler = "daily mister calls common words " * 30
    text = f"Zebulon wrote. {filler} \u0130 mail zoe@mail.example now. {filler} {filler} asked zebulon daily"
    d = spark.createDataFrame([(0, text)] + [(i, f"asked wrote mail {filler}") for i in range(1, 300)], "doc_id long, text string")
    got = privacy.spans(d).where("doc_id = 0").first()
    cuts = [(int(a), int(b)) for k, a, b in (s.split(":") for s in got.spans.split(",")) if k == "term"]
    assert [text[a:b] for a, b in cuts] == ["Zebulon", "zebulon"]
    assert "ebulon" not in privacy.sanitised(d).where("doc_id = 0").first().text


def test_edit_fingerprints(docs, none):
    src = sorted(((i is None, i or 0, t or "") for i, t, *_ in rows()))
    got = editprint.fingerprinted(docs).collect()
    assert len(got) == len(src) and editprint.fingerprinted(none).count() == 0
    want = sorted((s[0], s[1], len(s[2]), hashlib.sha256(editprint.edited(s[2], src[(k + 1) % len(src)][2]).encode()).hexdigest()) for k, s in enumerate(src))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got) == want
    text = {i: t or "" for i, t, *_ in rows()}
    prints = {}
    for r in got:
        assert prints.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    first = [t for _, t, *_ in rows()[:12]]
    some = editprint.fingerprints(first)
    # A substituted character here and there: the walks part and meet again, sooner or later.
    other = editprint.fingerprints(["".join("#" if k % 97 == 50 else c for k, c in enumerate(t)) for t in first])
    alike, unlike = [editprint.likeness(a, b) for a, b in zip(some, other)], [editprint.likeness(a, b) for a, b in zip(some, some[1:])]
    assert np.mean(alike) > 0.5 > 0.3 > np.mean(unlike)
    assert editprint.edit_distance("kitten", "sitting", 5) == 3 and editprint.edit_distance("abc", "xyz", 2) is None


def test_near_texts(spark, none, monkeypatch):
    rnd = random.Random(8)
    base = [" ".join(rnd.choice(W) + str(rnd.randrange(40)) for _ in range(40)) for _ in range(6)]
    edit = lambda t, n: "".join(c for k, c in enumerate(t) if k not in {len(t) // (n + 1) * (j + 1) for j in range(n)})
    texts = [*base, *[edit(t, 1) for t in base], *[edit(t, 2) for t in base], base[0], "", None, base[1]]
    ids = [*range(len(texts) - 1), None]
    d = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(texts), strict=True)), "doc_id long, text string, v string")
    monkeypatch.setattr(editprint, "BLOCK_TEXTS", 2)
    got = {r.doc_id: r for r in editprint.near_texts(d).collect()}
    sure = [(i, j) for i in range(18) for j in range(i) if editprint._near(texts[i], texts[j], 0.05)]
    together = sum(got[i].class_id == got[j].class_id for i, j in sure)
    assert len(got) == len(texts) and together >= 0.9 * len(sure) and len(sure) >= 18
    assert all(got[i].class_id in (i % 6, i, i % 6 + 6) for i in range(18)) and got[18].class_id == got[0].class_id and got[None].class_id == got[1].class_id
    assert (got[19].class_id, got[19].class_texts, got[20].class_id, got[20].class_texts) == (19, 1, 20, 1)
    members = {}
    for i, t in zip(ids, texts, strict=True):
        members.setdefault(got[i].class_id, set()).add(t)
    assert all(got[i].class_texts == len(members[got[i].class_id]) for i in ids) and editprint.near_texts(none).count() == 0


def test_bags_bound_the_edits():
    rnd = random.Random(2)
    for _ in range(200):
        a = "".join(rnd.choice("abc\u00e9") for _ in range(rnd.randrange(1, 12)))
        b = "".join(rnd.choice("abc\u00e9") for _ in range(rnd.randrange(1, 12)))
        gap = editprint.bag(a) - editprint.bag(b)
        assert max(gap.clip(0).sum(), (-gap).clip(0).sum()) <= editprint.edit_distance(a, b, 24)


def test_benchmark_leaks(spark, none):
    rnd = random.Random(4)
    item = " ".join(f"{rnd.choice(W)}{k}" for k in range(40))
    edited = " ".join(w if k % 6 else "other" for k, w in enumerate(item.split()))
    filler = " ".join(rnd.choice(W) for _ in range(300))
    d = spark.createDataFrame([(1, f"{filler} {item.upper()}, {filler}"), (2, f"{filler} {edited} {filler}"), (3, filler), (4, None), (5, ""), (6, " ".join(item.split()[:8]))], "doc_id long, text string")
    b = spark.createDataFrame([(10, item), (11, None), (12, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(d, b).collect()}
    assert set(got) == {(1, 10), (2, 10)} and got[1, 10].likeness == 1.0 and got[1, 10].start == len(filler) + 1
    assert {r.doc_id for r in decontaminate.clean(d, b).collect()} == {3, 4, 5, 6}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b, part_words=41).collect()} == set(got)
    assert decontaminate.leaks(none, b).count() == 0 and decontaminate.leaks(d, b.limit(0)).count() == 0


def test_leak_of_a_half(spark):
    """A run of 8 of an item's 15 words: most of the item's n-grams are in no text, and none of those is a seed."""
    item = [f"word{k}" for k in range(15)]
    copies = [(i, " ".join(["before", *item[:8], "after"])) for i in range(3)]
    d = spark.createDataFrame([*copies, *((i, f"filler {i}") for i in range(3, 900))], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for rare in (1000, 10**9):
        assert sorted(r.doc_id for r in decontaminate.leaks(d, b, rare=rare).collect()) == [0, 1, 2]
    assert decontaminate.leaks(d.where("doc_id > 2"), b).count() == 0


def test_benchmark_leaks_equal_brute_force(spark):
    """Every item against every whole text, without seeds: what the query finds is what alignment finds."""
    rnd = random.Random(9)
    vocabulary = [f"{w}{k}" for w in W for k in range(60)]
    some = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [some(rnd.randrange(12, 40)) for _ in range(12)]
    texts = []
    for k in range(60):
        t = some(rnd.randrange(5, 200))
        if k % 2:
            item = [w for w in rnd.choice(items) if rnd.random() > 0.1 * (k % 7)]
            at = rnd.randrange(len(t))
            t[at:at] = item
        texts.append(" ".join(t))
    d = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("likeness", F.lit(2))
    b = spark.createDataFrame([*enumerate(" ".join(i) for i in items), (0, " ".join(items[0]))], "item_id long, text string").withColumn("doc_id", F.lit(5))
    number = {w: k for k, w in enumerate(vocabulary)}
    ids = [np.array([number[w] for w in t.split()]) for t in texts]
    want = {(i, k): decontaminate.align(np.array([number[w] for w in item]), t)[0] / (2 * len(item)) for i, t in enumerate(ids) for k, item in enumerate(items)}
    got = decontaminate.leaks(d, b).collect()
    assert {(r.doc_id, r.item_id): r.likeness for r in got} == pytest.approx({x: v for x, v in want.items() if v >= 0.5})
    assert len(got) == len(set(got)) + sum(r.doc_id == 3 for r in set(got))
    assert sorted(r.doc_id for r in decontaminate.clean(d, b).collect()) == sorted(i for i in [*range(60), 3] if all(want[i, k] < 0.5 for k in range(12)))


def test_alignment_equals_the_table():
    rnd = np.random.default_rng(2)
    for _ in range(50):
        a, b = rnd.integers(0, 4, rnd.integers(1, 9)), rnd.integers(0, 4, rnd.integers(1, 12))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


def test_quality(spark, none):
    good = ["The line of plain words goes on and on.\nAnother plain line follows here." for _ in range(60)]
    bad = ["BUY NOW!!! $$$ | | | ###\nCLICK!!! &&& %%% |||" for _ in range(60)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(d, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).collect()}
    assert all(got[i].predicted == int(i < 60) for i in range(120)) and all(0 <= r.score <= 1 for r in got.values())
    twice = {(r.doc_id, r.score) for r in quality.classify(d.unionAll(d).withColumn("score", F.lit(9)), labels.unionAll(labels), F.lit(True)).collect()}
    assert len(twice) == d.count()
    model, share = quality.train(d, labels, F.lit(True), sample_chars=400)
    assert 0 < share < 1 and quality.train(d, labels, F.lit(True), sample_chars=1)[0] is None
    assert {r.score for r in quality.classify(d, labels.limit(0), F.lit(True)).collect()} == {0.5} and quality.classify(none, labels, F.lit(True)).count() == 0


def test_marginals_equal_enumeration():
    rnd = np.random.default_rng(0)
    odds, pair = rnd.normal(size=5), rnd.normal(size=(2, 2))
    total, one = 0.0, np.zeros(5)
    for s in range(32):
        y = [s >> k & 1 for k in range(5)]
        p = np.exp(sum(odds[k] * y[k] for k in range(5)) + sum(pair[y[k], y[k + 1]] for k in range(4)))
        total += p
        one += p * np.array(y)
    assert np.allclose(quality.marginals(np.array([5]), odds, pair)[0], one / total)


@pytest.mark.parametrize("key_rows", [1000, 2])
def test_hidden_markov(docs, none, key_rows, monkeypatch):
    monkeypatch.setattr(common, "KEY_ROWS", key_rows)
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0
    small = hmm.Config(states=2, head=50, classes=8, rounds=1, warm_rounds=2)
    got = hmm.fit_and_score(docs, train, small).collect()
    from collections import Counter

    c = Counter()
    for i, t, *_ in rows():
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    text = {i: t for i, t, *_ in rows()}
    for r in got:
        w = [*words(text[r.doc_id]), None]
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(w), n, sum(c[x] > 0 for x in w))
        assert r.base_score == pytest.approx(sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    assert len(got) == docs.count() and hmm.fit_and_score(none, train, small).count() == 0


def test_forward_equals_enumeration():
    rnd = np.random.default_rng(1)
    start, step, emit = rnd.dirichlet([1, 1]), rnd.dirichlet([1, 1], 2), rnd.dirichlet([1] * 3, 2).T
    seq = np.array([0, 2, 1, 1])
    want = sum(np.prod([start[s[0]] * emit[seq[0], s[0]], *[step[s[k - 1], s[k]] * emit[seq[k], s[k]] for k in range(1, 4)]]) for s in np.ndindex(2, 2, 2, 2))
    assert hmm.forward(seq[:, None], np.array([4]), start, step, emit)[0][0] == pytest.approx(np.log(want))


def test_licences(spark, docs, none):
    mit = licences.TEMPLATES["MIT"].split()
    wrapped = "\n".join(" # " + " ".join(mit[i : i + 10]) for i in range(0, len(mit), 10))
    code = "\n".join(f"x{i} = f(y{i})" for i in range(300))
    edited = " ".join(w if k % 40 else f"put in {w}" for k, w in enumerate(mit))
    texts = [None, "", "word", f"{wrapped}\n{code}", "foo bar\nLicensed under the Apache License, version 2.0!\nbaz", "this file was Released under the MIT License, and goes on. " * 2, edited, "// " + licences.TEMPLATES["BSD-3-Clause"] + "\n" + licences.TEMPLATES["Zlib"] + code, "All rights reserved.", licences.TEMPLATES["MIT"] * 3]
    d = spark.createDataFrame([*enumerate(texts), (4, texts[4])], "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("w", F.lit("x"))
    got = licences.scan(d).collect()
    found = sorted((r.doc_id, r.template, r.first_word) for r in got)
    zlib = len(licences.words_of(licences.TEMPLATES["BSD-3-Clause"]))
    n = len(licences.words_of(licences.TEMPLATES["MIT"]))
    assert found == [(3, "MIT", 0), (4, "Apache-2.0 notice", 2), (4, "Apache-2.0 notice", 2), (5, "MIT notice", 3), (5, "MIT notice", 14), (6, "MIT", 2), (7, "BSD-3-Clause", 0), (7, "Zlib", zlib), (8, "All rights reserved", 0), (9, "MIT", 0), (9, "MIT", n), (9, "MIT", 2 * n)]
    for r in got:
        w = licences.words_of(texts[r.doc_id])[r.first_word : r.first_word + r.n_words]
        x, y = set(licences.bigrams(w)), set(licences.bigrams(licences.words_of(licences.TEMPLATES[r.template])))
        assert r.shared == len(x & y) and r.dice == pytest.approx(2 * len(x & y) / (len(x) + len(y))) and r.dice >= 0.8
    assert licences.scan(docs).count() == licences.scan(none).count() == licences.scan(d, {}).count() == 0


def test_licences_from_files(spark, tmp_path, monkeypatch):
    """Long licences, of some thousand words, with a few words changed and text around."""
    rnd = random.Random(14)
    stock = [f"{a}{b}" for a in ("lic", "grant", "work", "copy", "term", "right") for b in ("", "ed", "s", "or", "ing", "able", "ion")]
    full = {f"Long-{k}": "\n".join(" ".join(rnd.choice(stock) for _ in range(12)) for _ in range(n)) for k, n in (("A", 250), ("B", 90))}
    for name, text in full.items():
        (tmp_path / f"{name}.txt").write_text(text)
    got = licences.read_templates(spark, str(tmp_path))
    assert got == full
    changed = " ".join(w if k % 50 else "changed" for k, w in enumerate(full["Long-A"].split()))
    texts = [f"x = 1;\n/* {changed} */\nmore code", full["Long-B"].upper(), " ".join(full["Long-B"].split()[: 12 * 40]), full["Long-A"] + "\n" + full["Long-B"]]
    found = licences.scan(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), licences.TEMPLATES | got).collect()
    assert sorted((r.doc_id, r.template, r.first_word) for r in found) == [(0, "Long-A", 2), (1, "Long-B", 0), (3, "Long-A", 0), (3, "Long-B", 3000)]
    monkeypatch.setattr(licences, "TEMPLATE_BYTES", 100)
    with pytest.raises(ValueError, match="at most"):
        licences.read_templates(spark, str(tmp_path))


def test_licence_seeds():
    rnd = random.Random(2)
    sets = {k: set(licences.bigrams(licences.words_of(t))) for k, t in licences.TEMPLATES.items()}
    chosen = licences.seeds(sets, 0.8)
    found = re.compile(licences.pattern_of(chosen).replace("++", "+"))
    for grams in sets.values():
        for _ in range(20):
            some = rnd.sample(sorted(grams), licences.needed(len(grams), 0.8))
            assert set(some) & set(chosen)
    assert all(found.search(f"a, {g.replace(' ', ' (')}.") and not found.search(f"zz{g}") and not found.search(f"{g}zz") for g in chosen)


def test_tool_calls(spark):
    e = [(1, 0, "system", '<tools>[{"name":"f","parameters":{"properties":{"x":{"type":"integer"}},"required":["x"]}}]</tools>'), (1, 1, "assistant", 'ok <tool_call>{"name":"f","id":"a","arguments":{"x":1}}</tool_call><tool_call>{"id":"b","name":"f","arguments":{"x":"1"}}</tool_call>'), (1, 2, "tool", '<tool_result>{"id":"a","content":{"z":1,"b":2}}</tool_result>'), (1, 0, "tool", '<tool_result>{"id":"b","content":1}</tool_result>'), (1, 3, "tool", '<tool_result>{"id":"zz"}</tool_result><tool_call>oops</tool_call>'), (None, None, None, None)]
    got = toolcalls.formatted(spark.createDataFrame(e, "conv_id long, turn long, role string, text string")).collect()
    by = {(r.kind, r.call_id): r for r in got if r.call_id}
    assert by["call", "a"].status == "ok" and by["call", "b"].status == "invalid" and by["result", "zz"].status == "orphan"
    assert by["result", "b"].order_turn == 1 and by["result", "a"].json == '{"content":{"b":2,"z":1},"id":"a","role":"tool"}'
    assert any(r.status == "malformed" for r in got)


KINDS = {"string": str, "integer": int, "boolean": bool, "array": list, "object": dict, "null": type(None)}


def meets(schema, v):
    """Brute force: does a value meet a schema?"""
    def of(kind):
        if kind == "number":
            return isinstance(v, (int, float)) and not isinstance(v, bool)
        return isinstance(v, KINDS[kind]) and (kind != "integer" or not isinstance(v, bool))

    types = schema.get("type")
    if types is not None and not any(map(of, types if isinstance(types, list) else [types])):
        return False
    if "enum" in schema and not any(type(x) is type(v) and x == v for x in schema["enum"]):
        return False
    closed, props = "properties" in schema or "items" in schema, schema.get("properties", {})
    if isinstance(v, dict):
        return all(k in v for k in schema.get("required", [])) and all(meets(props[k], x) if k in props else not closed for k, x in v.items())
    if isinstance(v, list):
        return all(meets(schema["items"], x) if "items" in schema else not closed for x in v)
    return True


def test_tools_of_several_blocks(spark):
    """Every block of a turn declares tools, one that is no JSON takes none from the others."""
    tool = lambda n: json.dumps([{"name": n, "parameters": {"properties": {"x": {"type": "integer"}}, "required": ["x"]}}])
    call = lambda i, n, x: f'<tool_call>{{"id": "{i}", "name": "{n}", "arguments": {{"x": {x}}}}}</tool_call>'
    turns = [(1, 0, "system", f"<tools>{tool('a')}</tools> and <tools>nothing</tools><tools>{tool('b')}</tools>"), (1, 1, "assistant", call("1", "a", 1) + call("2", "b", 2) + call("3", "b", '"no"') + call("4", "c", 1))]
    got = toolcalls.formatted(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).where("kind = 'call'").collect()
    assert {r.call_id: r.status for r in got} == {"1": "unanswered", "2": "unanswered", "3": "invalid", "4": "undeclared"}


def test_tool_calls_equal_brute_force(spark):
    rnd = random.Random(11)
    keys = ["a", "b/c", "d~", "*"]

    def schema(depth):
        kind = rnd.choice(["string", "integer", "number", "boolean", ["string", "null"], "object", "object", "array"])
        out = {"type": kind} if rnd.random() < 0.9 else {}
        if kind == "object" and rnd.random() < 0.8:
            out["properties"] = {k: schema(depth - 1) if depth else {} for k in rnd.sample(keys, 2)}
            out["required"] = rnd.sample(sorted(out["properties"]), rnd.randrange(2))
        if kind == "array" and rnd.random() < 0.8:
            out["items"] = schema(depth - 1) if depth else {}
        if kind in ("string", "integer") and rnd.random() < 0.3:
            out["enum"] = ["x", 1]
        return out

    def value(s, depth=4):
        if rnd.random() < 0.1 or depth == 0:
            return rnd.choice(["x", "y", 1, 2, 1.5, True, None, [], {}, [1], {"a": 1}])
        kind = s.get("type") or rnd.choice(sorted(KINDS))
        kind = rnd.choice(kind) if isinstance(kind, list) else kind
        if kind == "object":
            return {k: value(s.get("properties", {}).get(k, {}), depth - 1) for k in [*s.get("properties", keys[:1]), *rnd.sample(keys, int(rnd.random() < 0.15))] if rnd.random() < 0.9}
        if kind == "array":
            return [value(s.get("items", {}), depth - 1) for _ in range(rnd.randrange(3))]
        return {"string": "x", "integer": 1, "number": 1.5, "boolean": True, "null": None}[kind]

    turns, want = [], {}
    for c in range(40):
        s = {"type": "object", "properties": {k: schema(2) for k in rnd.sample(keys, 2)}, "required": []}
        turns.append((c, 0, "system", f'<tools>{json.dumps([{"name": "f", "parameters": s}, {"name": "open"}])}</tools>', "x"))
        for k in range(6):
            args, name = value(s) if k else value({}), rnd.choice(["f", "f", "f", "open", "none"])
            if rnd.random() < 0.05:
                args = "text"
            turns.append((c, k + 1, "assistant", f'<tool_call>{json.dumps({"name": name, "id": str(k), "arguments": args})}</tool_call>', "y"))
            answered = rnd.random() < 0.7
            if answered:
                turns.append((c, 20, "tool", f'<tool_result>{json.dumps({"id": str(k), "content": k})}</tool_result>', "z"))
            fine = isinstance(args, dict) and (name == "open" or meets(s, args))
            want[c, str(k)] = "undeclared" if name == "none" else "invalid" if not fine else "ok" if answered else "unanswered"
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, path string")
    got = {(r.conv_id, r.call_id): r.status for r in toolcalls.formatted(df).where("kind = 'call'").collect()}
    assert got == want and {"ok", "invalid", "unanswered", "undeclared"} == set(want.values())
    assert toolcalls.formatted(df.limit(0)).count() == 0
    twice = toolcalls.formatted(df.where("conv_id = 0").unionAll(df.where("conv_id = 0"))).where("kind = 'call'").collect()
    assert len(twice) == 12 and sum(r.status == "duplicate" for r in twice) == 6


def test_pipeline_stages_on_awkward_rows(spark, docs, none):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        if name != "mix":
            assert got.columns == docs.columns
        assert got.count() <= docs.count() and stage(spark, none, sf).count() == 0
        if name in ("quality", "decontamination"):
            assert {(r.score, r.id, r.root) for r in got.select("score", "id", "root").collect()} <= {(0.5, 7, "r"), (None, None, None)}
    kept = [r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, sf).collect()]
    classes = {}
    for r in neardup.near_duplicates(docs).where("doc_id is not null").collect():
        classes.setdefault(r.component_id, set()).add(r.doc_id)
    assert all(len(c & set(kept)) == 1 for c in classes.values()) and len(kept) == len(set(kept))


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near-duplicates", "decontamination", "personal data", "mix"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, sf)
    near = neardup.near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in near.where("kept").collect())
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_small_enough_counts_bytes(spark):
    d = spark.createDataFrame([(i, "x" * 1000) for i in range(50)], "id long, t string")
    assert common.small_enough(d, 50) and not common.small_enough(d, 49) and not common.small_enough(d, 50, 20_000)
    assert common.small_enough(d.select("id"), 50, 1) and common.small_enough(d.limit(0), 0)


def test_close_deletes_what_was_kept():
    """In a process of its own, as all tests share a session."""
    code = (
        "import os, sys; from pyspark.sql import SparkSession; sys.path.insert(0, os.getcwd())\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://' + sys.argv[1]).getOrCreate()\n"
        "from tripleforge.llm import common; from tripleforge.sources import store\n"
        "common.Kept(s.range(3), 'x'); store.written(s.range(3)); store.once(s, 'a', 'b', lambda: s.range(2))\n"
        "there = lambda: sorted(n.split('-')[0] for n in os.listdir(sys.argv[1]) if n[:2] in ('x-', 'ta', 'b-'))\n"
        "assert there() == ['b', 'table', 'x'], os.listdir(sys.argv[1])\n"
        "common.close(s); store.close(s); assert there() == []\n"
    )
    with tempfile.TemporaryDirectory() as folder:
        subprocess.run([sys.executable, "-c", code, folder], check=True, cwd=Path(__file__).resolve().parents[2])
