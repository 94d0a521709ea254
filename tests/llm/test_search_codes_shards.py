"""Sharding, ranked search and vector codes against plain loops, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tripleforge.llm import common, lexical, sharding, vectorcodes

DOCS = "doc_id long, text string, shard int, row long, bucket string"


def texts():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Äpfel", "ÄPFEL", "naïve", "x1"]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 40))) for _ in range(300)]
    rows = [(i * 7 % 311, t) for i, t in enumerate(base)] + [(5, base[0])] * 150 + [(None, base[1])] * 40
    return [*rows, (400, None), (401, ""), (402, " .,-\n"), (403, "W1,w2;W1_w3" * 3000), (404, "Äpfel äpfel W1"), (405, base[2]), (406, base[2])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2, "b") for r in texts()], DOCS).repartition(5)


@pytest.mark.parametrize("bucket_bytes", [1 << 24, 700])
def test_shards(spark, docs, bucket_bytes):
    shuffled = sharding.shuffled(docs, shards=7, bucket_bytes=bucket_bytes)
    assert shuffled.columns == [*docs.columns, "_shard", "slot", "_bucket"]
    got = shuffled.collect()
    assert Counter((r.doc_id, r.text, r.shard, r.row, r.bucket) for r in got) == Counter((*r, 1, 2, "b") for r in texts())
    sizes = Counter(r._shard for r in got)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(7):
        assert sorted(r.slot for r in got if r._shard == s) == list(range(sizes[s]))
    plain = lambda rows: sorted(((r._shard, r.slot, r.doc_id, r.text) for r in rows), key=repr)
    assert plain(got) == plain(sharding.shuffled(docs.repartition(3), shards=7, bucket_bytes=bucket_bytes).collect())
    other = sharding.shuffled(docs, shards=7, bucket_bytes=bucket_bytes, seed=9).collect()
    assert plain(got) != plain(other)
    if bucket_bytes == 700:  # the 150 equal rows are spread over the buckets
        assert max(Counter(r._bucket for r in got if r.doc_id == 5).values()) < 20
        order = [r._bucket for r in sorted(got, key=lambda r: (r._shard, r.slot))]
        assert order == sorted(order)  # buckets follow one another


def test_shards_are_uniform(spark):
    """Every place is about as likely for each row: quarters of the order against quarters of the ids, and neighbours are no neighbours."""
    n = 8000
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"))
    got = sorted((r.shard, r.slot, r.doc_id) for r in sharding.shuffled(d, shards=4, bucket_bytes=4000).collect())
    cells = Counter((s, i * 4 // n) for s, _, i in got)
    assert sum((c - n / 16) ** 2 / (n / 16) for c in cells.values()) < 35  # 9 degrees of freedom
    ids = [i for _, _, i in got]
    assert sum(abs(a - b) == 1 for a, b in zip(ids, ids[1:], strict=False)) < 10


def test_permutations_are_fisher_yates_of_each_bucket(spark):
    """All orders of a bucket of three come up, and each bucket is permuted on its own places."""
    counts = spark.range(1200).select(F.col("id").alias("bucket"), F.lit(3).cast("long").alias("n"))
    got = {}
    for r in sharding.permutations(counts, 1200).collect():
        got.setdefault(r.bucket, {})[r.position] = r["rank"]
    assert all(sorted(p) == [3 * b, 3 * b + 1, 3 * b + 2] and sorted(p.values()) == [1, 2, 3] for b, p in got.items())
    orders = Counter(tuple(p[x] for x in sorted(p)) for p in got.values())
    assert len(orders) == 6 and all(140 < c < 260 for c in orders.values())


def test_shard_digests(spark, docs, tmp_path):
    got = sharding.digests(docs).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "rows", None) for i, t in texts())
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in got) == want
    assert sharding.digests(docs.limit(0)).collect() == []
    assert sharding.digests(docs.where("doc_id = 404")).select("shard", "slot").collect() == [(0, 0)]
    sharding.write_shards(docs.select("doc_id", "text"), f"{tmp_path}/out", shards=3, bucket_bytes=4000)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(texts()) and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2}


def found(rows, items, k=10):
    """Brute force: (item_id, rank, doc_id, score), all documents scored for each item."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    own = [(i, Counter(terms(t))) for i, t in rows]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n, total, out = len(own), sum(x[2] for x in own), []
    df = Counter(t for _, c, _ in own for t in c)
    for item, text in sorted(set(items), key=repr):
        scores = []
        for i, c, size in own:
            m = 10 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            scores += [(-s, i is None, i or 0, i)] * (s > 0)
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"window": 16, "part_terms": 9}, {"window": 64, "window_postings": 50}])
def test_search(spark, docs, options):
    rnd = random.Random(4)
    items = [(i, " ".join(f"W{rnd.randrange(60)}" for _ in range(n))) for i, n in enumerate([1, 3, 8, 20, 2, 5])]
    items += [items[1], (1, "other w5"), (None, "äpfel Äpfel"), (20, None), (21, ""), (22, "nowhere"), (23, " ".join(f"w{i}" for i in range(60)))]
    asked = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = lexical.search(docs, asked, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == found(texts(), items)


def test_search_of_nothing(spark, docs):
    asked = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical.search(docs.limit(0), asked).collect() == [] and lexical.search(docs, asked.limit(0)).collect() == []
    assert lexical.search(docs.where("doc_id in (400, 401, 402)"), asked).collect() == []


def coded(rows):
    """Brute force over (vec_id, vector, label): codes, errors and codebooks, every part on its own."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0))
    width = len(kept[0][1]) // 8
    books = [[v[p * width : (p + 1) * width] for _, v, _ in kept[:16]] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(6):
        for p in range(8):
            groups = {}
            for _, v, _ in kept:
                x = v[p * width : (p + 1) * width]
                groups.setdefault(near(x, books[p])[1], []).append(x)
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    last = [[near(v[p * width : (p + 1) * width], books[p]) for p in range(8)] for _, v, _ in kept]
    sums = Counter()
    for (_, _, label), own in zip(kept, last, strict=True):
        sums[label] += sum(d for d, _ in own)
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return Counter((i, label, "".join(f"{k:02x}" for _, k in own), sum(d for d, _ in own), sums[label], sha) for (i, _, label), own in zip(kept, last, strict=True))


def vectors(n, seed=0):
    rnd = random.Random(seed)
    some = [[round(rnd.uniform(-1, 1), 1) for _ in range(24)] for _ in range(max(2, n // 3))]
    rows = [(i * 5 % 997, rnd.choice(some), rnd.choice([1, 2, None])) for i in range(n)]
    bad = [(1, None, 1), (2, [None] * 24, 1), (0, [float("nan")] * 24, 2), (0, [1.0] * 23 + [float("inf")], 2)]
    return [*rows, *rows[:3], (None, some[0], 1), *bad]


@pytest.mark.parametrize(("n", "hot"), [(200, 1000), (200, 5), (9, 1000)])
def test_vector_codes(spark, n, hot, monkeypatch):
    monkeypatch.setattr(common, "KEY_ROWS", hot)
    rows = vectors(n)
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "vec_id long, embedding array<double>, label int, row int, pos int").repartition(4)
    got = vectorcodes.encode(df)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == coded(rows)


def test_vector_codes_refuse_and_empty(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    assert vectorcodes.encode(make([])).collect() == [] and vectorcodes.encode(make([None, [None]])).collect() == []
    for wrong in ([[0.5] * 12], [[0.5] * 8, [0.5] * 16], [[3e30] * 8]):
        with pytest.raises(ValueError, match="parts|large"):
            vectorcodes.encode(make(wrong))


@pytest.mark.parametrize("name", ["documents", "embeddings"])
def test_same_rows_as_sql(spark, name):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"create view {t} as from '{sf}/{t}.parquet'")
    if name == "documents":
        df, sql = lexical.search(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")), lexical.search_sql()
    else:
        df, sql = vectorcodes.encode(spark.read.parquet(f"{sf}/embeddings.parquet")), vectorcodes.encode_sql()
    want = con.sql(sql)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
