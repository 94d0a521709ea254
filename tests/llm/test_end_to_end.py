"""Whole results of the text operators that SQL cannot give, against plain loops written from their definitions; and very long texts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleforge.llm import decontaminate, editprint, hmm, lexical, licences, linededup, mixing, neardup, privacy, quality, sharding, toolcalls
from tripleforge.llm.common import fold

SF = "/root/testdata/sf0.01"


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def test_quality_of_held_out_documents(spark):
    """Learned from three quarters of the documents, judged on the rest."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(docs, labels, fold(F.col("doc_id"), 4) != 2).where("held_out").join(labels, "doc_id").collect()
    good, bad = sorted(r.score for r in got if r.quality == 1), sorted(r.score for r in got if r.quality == 0)
    assert len(good) > 10 and len(bad) > 10 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.97
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) >= 0.99


def baum_welch(seqs, start, step, emit):
    """Expected counts of one round, by plain forward and backward sums."""
    k = len(start)
    starts, steps, emits = np.zeros(k), np.zeros((k, k)), np.zeros_like(emit)
    for s in seqs:
        a = [[start[i] * emit[s[0]][i] for i in range(k)]]
        for x in s[1:]:
            a.append([sum(a[-1][i] * step[i][j] for i in range(k)) * emit[x][j] for j in range(k)])
        b = [[1.0] * k]
        for x in reversed(s[1:]):
            b.insert(0, [sum(step[i][j] * emit[x][j] * b[0][j] for j in range(k)) for i in range(k)])
        total = sum(a[-1])
        for t, x in enumerate(s):
            for i in range(k):
                g = a[t][i] * b[t][i] / total
                emits[x][i] += g
                starts[i] += g if t == 0 else 0
                for j in range(k if t + 1 < len(s) else 0):
                    steps[i][j] += a[t][i] * step[i][j] * emit[s[t + 1]][j] * b[t + 1][j] / total
    return starts, steps, emits


def test_hidden_markov_scores_equal_plain_sums(spark, monkeypatch):
    rnd = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "abcd" for b in ("one", "two", "xyz")]
    texts = [" ".join(rnd.choice(vocabulary[:6] if i % 2 else vocabulary) for _ in range(rnd.randrange(0, 9))) for i in range(60)] + ["never seen", "Aone AONE", None]
    cfg = hmm.Config(states=3, head=4, classes=3, rounds=2, smooth=2.0)
    rng = np.random.default_rng(5)

    def first(seqs, unigram, cfg):
        return rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * len(unigram), 3).T

    model = []
    monkeypatch.setattr(hmm, "_first", lambda *a: model.append(first(*a)) or model[-1])
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in hmm.fit_and_score(df, F.col("doc_id") % 5 != 0, cfg).collect()}

    train = [words(t) for i, t in enumerate(texts) if i % 5]
    count = Counter(w for t in train for w in t)
    level = lambda c: math.floor(math.log(c) * hmm.LEVELS)
    head = []
    for lv in sorted({level(c) for c in count.values()}, reverse=True):
        own = [w for w, c in count.items() if level(c) == lv]
        if len(head) + len(own) > cfg.head:
            break
        head += own
    head.sort(key=lambda w: (-count[w], w))
    assert 0 < len(head) < len(count)
    cls = lambda w: zlib.crc32(w[-3:].encode()) % 3
    symbol = lambda w: head.index(w) if w in head else len(head) + 1 + cls(w)
    tail = {w: c for w, c in count.items() if w not in head}
    n_in, v_in = [sum(c for w, c in tail.items() if cls(w) == k) for k in range(3)], [sum(cls(w) == k for w in tail) for k in range(3)]
    totals = [count[w] for w in head] + [len(train)] + n_in
    unigram = [(c + 0.1) / (sum(totals) + 0.1 * len(totals)) for c in totals]
    start, step, emit = (np.array(x, float) for x in model[0])
    coded = [[*map(symbol, t), len(head)] for t in train]
    for _ in range(cfg.rounds):
        s, a, e = baum_welch(coded, start, step, emit)
        start = (s + 1) / sum(s + 1)
        step = (a + 1) / (a + 1).sum(axis=1, keepdims=True)
        emit = (e + cfg.smooth * np.array(unigram)[:, None]) / (e.sum(axis=0) + cfg.smooth)
    for i, t in enumerate(texts):
        ws = words(t)
        seq = [*map(symbol, ws), len(head)]
        a = [start[j] * emit[seq[0]][j] for j in range(3)]
        for x in seq[1:]:
            a = [sum(a[m] * step[m][j] for m in range(3)) * emit[x][j] for j in range(3)]
        by_class = sum(math.log10((count[w] + 0.1) / (n_in[cls(w)] + 0.1 * (v_in[cls(w)] + 1))) for w in ws if w not in head)
        assert got[i] == pytest.approx(math.log10(sum(a)) + by_class, abs=2e-3)


def test_fingerprints_equal_a_plain_walk():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abc dé\U0001f600") for _ in range(n)) for n in (0, 1, 2, 3, 17, 64, 65, 700)]
    for walk in (0, 2):
        for t, got in zip(texts, editprint.fingerprints(texts, 128, walk), strict=True):
            level = 0
            while len(t) > 1 << level:
                level += 1
            kinds = [ord(c) if ord(c) < 128 else 128 + ((ord(c) * 2654435761 % 2**32) >> 9) % 127 for c in t]
            bits, seen, at = editprint._bits(0, walk), [], 0
            for j in range(4 << level):
                seen.append(kinds[at] if at < len(kinds) else None)
                at += int(at < len(kinds) and bits[j][kinds[at]])
            steps = [*editprint.steps_of(level), *editprint.steps_of(level + 1)]
            mark = lambda j: "-" if seen[j] is None else "0123456789abcdef"[(seen[j] * 0x9E3779B97F4A7C15 + j * 0xC2B2AE3D27D4EB4F) * 0xD6E8FEB86659FD93 % 2**64 >> 60]  # noqa: B023, E731
            assert got == f"{level}:" + "".join(mark(int(j)) for j in steps)


def test_personal_data_equals_plain_counts(spark):
    """Spans of entities and of telling terms, from the counts of a small corpus."""
    rnd = random.Random(4)
    common, rare = ["daily", "mister", "calls", "words", "windmill", "abc"], [f"secret{c}" for c in "abcdefgh"]
    texts = []
    for i in range(160):
        t = [rnd.choice(common) for _ in range(rnd.randrange(3, 12))]
        if i % 4 == 0:
            p = rnd.randrange(8)
            t[1:1] = [f"{rare[p]} bob{p}@mail.example", rnd.choice(["+1 (555) 123-4567", "10.20.30.40", "4111 1111 1111 1111", "x"])]
        if i % 9 == 0:
            t.append(rnd.choice(rare).upper())
        texts.append(" ".join(t))
    df = spark.createDataFrame([*enumerate(texts), (500, None)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in privacy.spans(df).collect()}

    def luhn(m):
        d = [int(c) for c in reversed(re.sub("[^0-9]", "", m))]
        return 16 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", luhn),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    n = len(texts) + 1
    base, terms, anywhere = {}, {}, Counter()
    for i, t in enumerate(texts):
        base[i] = [(k, m.start(), m.end(), m.group()) for k, p, ok in kinds for m in re.finditer(p, t) if ok(m.group())]
        terms[i] = [(m.group().lower(), m.start(), m.end()) for m in re.finditer("[A-Za-z]{4,}", t) if not any(a < m.end() and b > m.start() for _, a, b, _ in base[i])]
        anywhere.update({m.lower() for m in re.findall("[A-Za-z]{4,}", t)})
    with_entity, both = Counter(), Counter()
    for i in base:
        for e in {(k, v) for k, _, _, v in base[i]}:
            with_entity[e] += 1
            both.update((e, w) for w in {x for x, _, _ in terms[i]})
    some = 0
    for i in base:
        cuts = []
        for w, a, b in terms[i]:
            for e in {(k, v) for k, _, _, v in base[i]}:
                rate = with_entity[e] / n
                told = math.log2((both[e, w] + rate) / (anywhere[w] + 1) / rate) / -math.log2(rate)
                if told >= privacy.GENERAL:
                    cuts.append((a, b))
                    break
        some += len(cuts)
        want = [f"{k}:{a}:{b}" for k, a, b, _ in base[i]] + [f"term:{a}:{b}" for a, b in cuts]
        assert got[i].spans == ",".join(want) and (got[i].n_email, got[i].n_term) == (sum(k == "email" for k, *_ in base[i]), len(cuts))
    assert some > 10 and got[500].spans == ""


def test_mix_is_what_its_slots_and_blocks_say(spark):
    """Blocks cut every source's words into runs of one length, slots draw blocks, and what a document gives is what the slots' blocks hold of it."""
    rnd = random.Random(8)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 3, 40, 333])), rnd.choice(["a", "b", "b", "c", None])) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), block_words=16, shard_slots=32)
    docs = {r.doc_id: r for r in got["documents"].collect()}
    blocks, slots = got["blocks"].collect(), got["slots"].collect()
    size = {i: len(words(t)) for i, t, _ in rows}
    covered, held = {}, Counter()
    for r in blocks:
        covered.setdefault(r.doc_id, []).append((r.first_word, r.first_word + r.n_words))
        held[r.source, r.block] += r.n_words
    for i, n in size.items():
        parts = sorted(covered.get(i, []))
        assert [a for a, _ in parts] == [0, *[b for _, b in parts[:-1]]][: len(parts)] and (parts[-1][1] if parts else 0) == n
    for s in {r[2] for r in rows}:
        own = sorted((b, n) for (x, b), n in held.items() if x == s)
        total = sum(size[r[0]] for r in rows if r[2] == s)
        assert [b for b, _ in own] == list(range(-(-total // 16))) and all(n == 16 for _, n in own[:-1]) and sum(n for _, n in own) == total
        drawn = Counter(r.block for r in slots if r.source == s)
        assert max(drawn.values()) - min(drawn[b] for b, _ in own) <= 1  # a block comes again only after all the others
        n_blocks, target = len(own), next(d.target for d in docs.values() if dict((i, x) for i, _, x in rows)[d.doc_id] == s)
        assert sum(drawn.values()) == min(round(target * n_blocks / total), 3 * n_blocks)
    places = Counter((r.shard, r.slot) for r in slots)
    assert max(places.values()) == 1 and all({r.slot for r in slots if r.shard == s} == set(range(sum(r.shard == s for r in slots))) for s in {r.shard for r in slots})
    draws = Counter((r.source, r.block) for r in slots)
    taken = Counter()
    for r in blocks:
        taken[r.doc_id] += r.n_words * draws[r.source, r.block]
    assert all((d.size, d.taken) == (size[i], taken[i]) for i, d in docs.items()) and len(docs) == 300


def test_pipeline_on_fifty_documents(spark, tmp_path):
    """Every stage on its own input, against plain loops: what is kept, and what becomes of it."""
    import corpus_pipeline

    rnd = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "le", "mi", "to") for b in ("rin", "sol", "ta") for c in ("", "s", "n")]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n)).capitalize() + "."
    item = [rnd.choice(vocabulary) + str(k) for k in range(30)]
    texts = ["\n".join(prose(rnd.randrange(20, 40)) for _ in range(4)) for _ in range(26)]
    texts += [texts[k] for k in (0, 0, 1)] + [texts[2] + " Once more.", texts[3].replace(texts[3].split()[10], "changed", 1)]
    texts += [f"{prose(40)} {' '.join(item)} {prose(40)}", f"{prose(40)} {' '.join(w for k, w in enumerate(item) if k % 8)} {prose(20)}"]
    texts += [f"{prose(60)} mail anna{k}@mail.example or call +1 (555) 123-456{k}" for k in range(4)]
    texts += ["BUY NOW!!! $$$ | | | ###\nCLICK!!! &&& %%% |||\n" * 4 for _ in range(12)]
    texts += [None, ""]
    texts = texts[:50] + [prose(30)] * max(0, 50 - len(texts))
    docs = spark.createDataFrame([(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int("BUY" not in (t or "")), 0) for i, t in enumerate(texts) if t], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    for name, t in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    sf = f"file://{tmp_path}"
    stage = dict(corpus_pipeline.STAGES)
    held = lambda df: {r.doc_id: r.text for r in df.collect()}

    good = stage["quality"](spark, docs, sf)
    assert {i for i, t in enumerate(texts) if t and "BUY" not in t} <= set(held(good)) and not any("BUY" in (t or "") for t in held(good).values())

    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for i, t in held(good).items()}
    least = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                    least[i] = min(least[i], least[j])
    one = stage["near-duplicates"](spark, good, sf)
    assert held(one) == {i: held(good)[i] for i in sets if least[i] == i} and len(held(one)) < len(sets) - 3

    number = {}
    code = lambda t: np.array([number.setdefault(w, len(number)) for w in decontaminate.words_of(t or "")], np.int64)
    leaky = {i for i, t in held(one).items() if decontaminate.align(code(" ".join(item)), code(t))[0] >= 0.5 * 2 * 30}
    clean = stage["decontamination"](spark, one, sf)
    assert held(clean) == {i: t for i, t in held(one).items() if i not in leaky} and len(leaky) == 2

    safe = held(stage["personal data"](spark, clean, sf))
    assert set(safe) == set(held(clean)) and sum("[EMAIL]" in (t or "") and "[PHONE]" in t for t in safe.values()) == 4 and not any("@" in (t or "") for t in safe.values())
    assert all(safe[i] == t for i, t in held(clean).items() if "@" not in (t or ""))

    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.size for r in got} == {i: len(words(t)) for i, t in safe.items()} and all(r.taken <= 3 * r.size for r in got)


def test_very_long_texts(spark):
    """One text of ten million characters among short ones; of one million for the walks over characters."""
    rnd = random.Random(6)
    line = " ".join(f"w{rnd.randrange(10**5)}" for _ in range(400))
    long = "\n".join(line[k % 900 :] + f" {k}" for k in range(4300))
    assert len(long) > 10_000_000
    texts = ["short text of a few words here", long, None, "", line, line]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(2).cache()
    bench = spark.createDataFrame([(1, " ".join(line.split()[100:140]))], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1), (4, 0)], "doc_id long, quality int")
    n = len(words(long))
    assert {r.doc_id for r in quality.classify(df, labels, F.lit(True)).collect()} == set(range(6))
    assert {r.doc_id: r.n_tokens for r in hmm.fit_and_score(df, F.col("doc_id") != 0, hmm.Config(states=2, rounds=1, warm_rounds=1, warm_tokens=2000)).collect()}[1] == n + 1
    some = df.withColumn("text", F.substring("text", 1, 1_000_000))
    assert {r.doc_id: r.n_chars for r in editprint.fingerprinted(some).collect()}[1] == 1_000_000
    assert {r.doc_id for r in decontaminate.leaks(df, bench).collect()} == {1, 4, 5}
    assert licences.scan(df).count() == 0
    assert len(privacy.spans(df).collect()) == 6
    got = {r.doc_id: r for r in neardup.near_duplicates(df, width=2).collect()}
    assert got[5].component_id == 4 and got[1].n_shingles == len({*zip(words(long), words(long)[1:], strict=False)})
    mixed = {r.doc_id: r for r in mixing.mix(df)["documents"].collect()}
    assert mixed[1].size == n and mixed[1].taken <= 3 * n
    turns = df.select(F.lit(1).cast("long").alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text")
    assert toolcalls.formatted(turns).where("turn = 1").select(F.length("json").alias("n")).first().n > len(long)
    assert {r.doc_id for r in linededup.repeats(df, linededup.MIN_WORDS, linededup.PIECE_WORDS).collect()} >= {1, 4, 5}
    assert {r.doc_id: r["size"] for r in sharding.digests(df).collect()}[1] == len(long.encode()) + 16
    assert {r.doc_id for r in lexical.search(df, bench).collect()} == {1, 4, 5}
