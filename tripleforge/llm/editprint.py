"""Fingerprints by randomised edit embedding.

A text is embedded by a walk over its characters: step j emits the character under the pointer, and moves the pointer on
if bit (j, character) of a table of random bits, shared by all texts, is set; past the end it emits padding. Texts a few edits apart meet again
after each edit, so their walks differ in few steps: edit distance becomes Hamming distance. A text of n characters is sampled at `samples`
fixed random steps below 2 * 2**level, for the levels ceil(log2 n) and one more; so texts up to twice as long as each other
share a level. A sample is 4 bits of its character and step as a hex digit, or '-' for padding. Likeness of two fingerprints is the share
of equal samples at the levels they share, not counting those where both are padding; 0 without a common level.

Near texts (near_texts): samples of several walks are cut into bands, texts with an equal band of one level meet in a bucket, and links within buckets are verified by edit distance.

A very long text is walked in time that grows with its length, alone if no other is as long. Null texts count as empty; all empty texts have one fingerprint, and likeness 1 to each other. Documents are ordered by doc_id (null last), then text. Repeated rows follow one another. A
single document is its own next one. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, components, lean, meet, regrouped

SAMPLES, SEED, BLOCK, PAD = 128, 77, 4096, 255
#: Samples of a band, and walks that near_texts bands.
BAND, WALKS = 8, 3
#: Texts of a block in a bucket whose texts are not all linked.
BLOCK_TEXTS = 128
#: Characters of the stretches that bound edit distances from below.
GRAM = 8
#: Vertices are the least doc_id of a text's rows times this, plus a remainder of the text's digest.
SPAN = 10**12
LAST = 2**63 - 1
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _kinds(text: str) -> np.ndarray:
    """Characters as numbers below PAD: ASCII as it is, the others by a hash."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(cp < 128, cp, 128 + (cp * np.uint32(2654435761) >> np.uint32(9)) % np.uint32(127)).astype(np.uint8)


def _bits(block: int, walk: int = 0) -> np.ndarray:
    """Random bits of BLOCK steps for each kind of character; padding never moves. Walks of other numbers have bits of their own."""
    raw = np.random.Generator(np.random.Philox(key=SEED + 1000 * walk, counter=[0, 0, 0, block])).bytes(BLOCK * 32)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(BLOCK, 256)
    bits[:, PAD] = 0
    return bits.astype(np.int64)


def steps_of(level: int, samples: int = SAMPLES) -> np.ndarray:
    """The steps sampled at a level, in order."""
    return np.sort(np.random.Generator(np.random.Philox(key=SEED + 1, counter=[0, 0, 0, level])).integers(0, 2 << level, samples))


def level_of(n: int) -> int:
    return max(0, int(n - 1).bit_length()) if n > 0 else 0


def _walk(texts: list[np.ndarray], level: int, samples: int, walk: int = 0) -> np.ndarray:
    """Samples of texts of one level, as ASCII, at that level and the next."""
    sizes = np.array([len(t) + 1 for t in texts])
    flat = np.full(sizes.sum(), PAD, np.uint8)
    start = np.cumsum(sizes) - sizes
    for s, t in zip(start, texts, strict=True):
        flat[s : s + len(t)] = t
    at = np.concatenate((steps_of(level, samples), steps_of(level + 1, samples)))
    order = np.argsort(at, kind="stable")
    out = np.full((len(texts), 2 * samples), ord("-"), np.uint8)
    pointer, now = start.copy(), np.empty(len(texts), np.uint8)
    move, k = np.empty(len(texts), np.int64), 0
    for block in range(int(at.max()) // BLOCK + 1):
        bits = _bits(block, walk)
        for j in range(BLOCK):
            flat.take(pointer, out=now, mode="clip")
            step = block * BLOCK + j
            while k < len(order) and at[order[k]] == step:
                with np.errstate(over="ignore"):
                    digit = _HEX[((now.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(60)]
                out[:, order[k]] = np.where(now == PAD, ord("-"), digit)
                k += 1
            if k == len(order) or (j % 256 == 0 and (now == PAD).all()):
                return out
            bits[j].take(now, out=move, mode="clip")
            pointer += move
    return out


def fingerprints(texts: list[str], samples: int = SAMPLES, walk: int = 0) -> list[str]:
    kinds = [_kinds(t) for t in texts]
    by_level: dict = {}
    for i, t in enumerate(kinds):
        by_level.setdefault(level_of(len(t)), []).append(i)
    out = [""] * len(texts)
    for level, group in by_level.items():
        for i, row in zip(group, _walk([kinds[i] for i in group], level, samples, walk), strict=True):
            out[i] = f"{level}:{row.tobytes().decode()}"
    return out


def likeness(a: str, b: str) -> float:
    (la, xa), (lb, xb) = a.split(":"), b.split(":")
    gap, half = int(lb) - int(la), len(xa) // 2
    if abs(gap) > 1:
        return 0.0
    x, y = (np.frombuffer(s.encode(), np.uint8) for s in (xa, xb))
    if gap:  # the level both have: the upper one of the shorter text, the lower one of the longer
        x, y = (x[half:], y[:half]) if gap == 1 else (x[:half], y[half:])
    real = (x != ord("-")) | (y != ord("-"))
    return float((x == y)[real].mean()) if real.any() else 1.0


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) characters replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bucketed(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (bucket, tail, id, text): ranges of ids, each with the first rows of the next range after it as its tail."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("id", [k / n for k in range(1, n)] or [0.5], 10_000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    group = max(1, int(len(cuts) ** 0.5))
    coarse = cuts[group - 1 :: group]
    below = lambda values: F.size(F.filter(values, lambda c: c <= F.col("id")))
    longs = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<bigint>")
    jump = below(longs(coarse)) * group
    rows = rows.withColumn("bucket", jump + below(F.slice(longs(cuts), jump + 1, F.lit(group))) if cuts else F.lit(0))
    # One row for each range: its first id, and the range before it.
    firsts = sorted((r["bucket"], r["first"]) for r in rows.groupBy("bucket").agg(F.min("id").alias("first")).collect())
    before = spark.createDataFrame([(b, first, firsts[k - 1][0]) for k, (b, first) in enumerate(firsts)], "bucket int, first long, before int")
    rows = rows.join(F.broadcast(before), "bucket")
    own, tail = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("tail")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("tail"))
    to = F.explode(F.when(F.col("id") == F.col("first"), F.array(own, tail)).otherwise(F.array(own)))
    return rows.select("id", "text", to.alias("to")).select("to.bucket", "to.tail", "id", "text"), n


def fingerprinted(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """A row per row of docs: its fingerprint, that of its edited text, and how like they and the next document's are."""
    lean(docs.sparkSession)
    rows, n = _bucketed(docs)
    dealt = rows.repartitionById(n, F.col("bucket")) if hasattr(rows, "repartitionById") else rows.repartition(n, "bucket")

    def run(batches):
        held: list = []
        for pdf in regrouped(batches, lambda p: int(p["text"].str.len().sum()), 16_000_000):
            new = list(zip(pdf["bucket"].tolist(), pdf["tail"].tolist(), pdf["id"].tolist(), pdf["text"].tolist(), fingerprints(pdf["text"].tolist(), samples), strict=True))
            all_ = held + new
            held = all_[-1:]
            pairs = [(x, y) for x, y in zip(all_, all_[1:]) if x[1] == 0 and x[0] == y[0]]
            other = [edited(x[3], y[3]) for x, y in pairs]
            prints = fingerprints(other, samples)
            yield pd.DataFrame(
                {
                    "id": [x[2] for x, _ in pairs],
                    "n_chars": [len(x[3]) for x, _ in pairs],
                    "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in other],
                    "fingerprint": [x[4] for x, _ in pairs],
                    "edited_fingerprint": prints,
                    "near_edited": [likeness(x[4], p) for (x, _), p in zip(pairs, prints, strict=True)],
                    "near_next": [likeness(x[4], y[4]) for x, y in pairs],
                }
            )

    out = dealt.sortWithinPartitions("bucket", "tail", "id", "text").mapInPandas(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.select(F.when(F.col("id") == LAST, None).otherwise(F.col("id")).alias("doc_id"), *out.columns[1:])


def _words(t: np.ndarray, width: int, pad: int) -> np.ndarray:
    """For each place the next 8 / width characters in one number, and one place more, past the end."""
    per = 8 // width
    long = np.concatenate((t, np.full(per, pad))).astype(np.uint64)
    out = np.zeros(len(t) + 1, np.uint64)
    for j in range(per):
        out |= long[j : j + len(out)] << np.uint64(8 * width * j)
    return out


def edit_distance(a: str, b: str, most: int) -> int | None:
    """Edit distance if at most `most`, by diagonals: the furthest place in a that d edits reach on each. All diagonals that can still lead to the end within `most` go together."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    if a == b:
        return 0
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    kinds, number = np.unique(np.concatenate((x, y)), return_inverse=True)
    width = 1 if len(kinds) < 255 else 2 if len(kinds) < 65535 else 4
    # No character is 0 or the last number, so equal stretches stop where either text ends.
    wa, wb = _words(number[:n] + 1, width, 0), _words(number[n:] + 1, width, len(kinds) + 1)
    reach, zero, end = np.full(2 * most + 5, -(2**40)), most + 2, m - n
    reach[zero] = _run(a, b, 0, 0)
    for d in range(1, most + 1):
        lo, hi = max(-d, end - (most - d)), min(d, end + (most - d))
        if lo > hi:
            return None
        k, at = np.arange(lo, hi + 1), slice(zero + lo, zero + hi + 1)
        i = np.maximum(np.maximum(reach[at] + 1, reach[zero + lo - 1 : zero + hi]), reach[zero + lo + 1 : zero + hi + 2] + 1)
        i = np.minimum(np.minimum(i, n), m - k)
        ok = np.flatnonzero((i >= 0) & (i + k >= 0))
        for _ in range(4):
            apart = wa[i[ok]] ^ wb[i[ok] + k[ok]]
            same = apart == 0
            i[ok] += np.where(same, 8 // width, np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)) // (8 * width))
            ok = ok[same]
        for z in ok:
            i[z] = _run(a, b, int(i[z]), int(i[z] + k[z]))
        reach[at] = np.where((i >= 0) & (i + k >= 0), i, -(2**40))
        if lo <= end <= hi and reach[zero + end] >= n:
            return d
    return None


def _run(a: str, b: str, i: int, j: int) -> int:
    """End in a of the equal stretch from a[i] and b[j]."""
    size = 64
    while i < len(a) and j < len(b):
        x, y = a[i : i + size], b[j : j + size]
        if x == y:
            i, j, size = i + len(x), j + len(y), size * 2
            continue
        m = min(len(x), len(y))
        lo = 0
        while lo < m and x[lo] == y[lo]:
            lo += 1
        return i + lo
    return i


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the stretches of GRAM characters of a text, sorted, and how often each occurs."""
    t = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(t) < GRAM:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(len(t) - GRAM + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(GRAM):
            h = (h + t[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return np.unique(h, return_counts=True)


def least_edits(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> int:
    """A bound from below on the edit distance of two texts, from their grams: no edit takes away more than GRAM of them. Equal hashes of different grams only lower it."""
    if not len(x[0]) or not len(y[0]):
        return 0
    at = np.minimum(np.searchsorted(y[0], x[0]), len(y[0]) - 1)
    common = int(np.minimum(x[1], y[1][at])[y[0][at] == x[0]].sum())
    return -(-(max(int(x[1].sum()), int(y[1].sum())) - common) // GRAM)


def bag(text: str) -> np.ndarray:
    """How often each kind of character occurs. No edit changes these counts by more than one up and one down."""
    return np.bincount(_kinds(text), minlength=PAD).astype(np.int32)


def _near(a: str, b: str, share: float, x: tuple | None = None, y: tuple | None = None) -> bool:
    """Whether the edit distance is at most that share of the longer text; x and y are their grams, where known."""
    most = int(share * max(len(a), len(b)))
    if abs(len(a) - len(b)) > most or least_edits(x or grams(a), y or grams(b)) > most:
        return False
    return edit_distance(a, b, most) is not None


def _placed(docs: DataFrame, samples: int, band: int) -> tuple[DataFrame, DataFrame]:
    """(id, v) of every row with a text, v its text's vertex; and (v, key, print) of the buckets of each vertex that more than one falls into. Equal texts are one vertex."""
    def sign(batches):
        for pdf in regrouped(batches, lambda p: int(p["text"].str.len().sum()), 16_000_000):
            for walk in range(WALKS):
                yield pd.DataFrame({"v": pdf["v"], "walk": walk, "print": fingerprints(pdf["text"].tolist(), samples, walk)})

    d38 = "decimal(38,0)"
    rows = docs.where("text <> ''").select(F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("id"), F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    own = Kept(rows.groupBy("digest").agg(F.min("id").alias("least")).select("digest", (F.col("least").cast("decimal(19,0)") * F.lit(SPAN).cast("decimal(13,0)") + F.pmod(F.xxhash64("digest"), F.lit(SPAN)).cast("decimal(12,0)")).cast(d38).alias("v")), "texts").df
    vertex = Kept(rows.select("id", "digest").join(own, "digest").select("id", "digest", "v"), "vertices").df
    one = rows.join(own, "digest").groupBy("v").agg(F.first("text").alias("text"))
    signed = Kept(one.select(F.col("v").cast("string").alias("v"), "text").mapInPandas(sign, "v string, walk int, print string").select(F.col("v").cast(d38).alias("v"), "walk", "print"), "prints").df
    level, body = F.split("print", ":")[0].cast("int"), F.split("print", ":")[1]
    bands = F.array(*[F.when(F.substring(body, 1 + k * band, band) != "-" * band, F.xxhash64("walk", level + int(k * band >= samples), F.lit(k % (samples // band)), F.substring(body, 1 + k * band, band))) for k in range(2 * samples // band)])
    placed = signed.select("v", "print", F.explode(F.array_compact(bands)).alias("key"))
    mark = F.xxhash64("v")
    shared = placed.groupBy("key").agg(F.min(mark).alias("x"), F.max(mark).alias("y")).where("x <> y").select("key")
    return vertex, Kept(placed.join(shared, "key"), "print-bands").df


def near_texts(docs: DataFrame, share: float = 0.05, samples: int = SAMPLES, band: int = BAND) -> DataFrame:
    """doc_id, class_id (least doc_id reachable over links, null last), class_texts (different texts of the class) for each row of docs.

    Two texts are linked if they share a bucket of a band and their edit distance is at most `share` of the longer one. Each bucket first links its members to its
    least one; where members stay in different components, all pairs between these are compared too, by blocks within tasks: those whose counts of characters allow so few edits
    are verified. Only links leave a task. Links within a component are not looked for, so none are counted. Empty and null texts are classes of their own row, of one text.
    """
    lean(docs.sparkSession)
    vertex, placed = _placed(docs, samples, band)
    text = docs.where("text <> ''").select(F.md5(F.col("text").cast("binary")).alias("digest"), "text").join(vertex.groupBy("digest").agg(F.first("v").alias("v")), "digest").groupBy("v").agg(F.first("text").alias("text"))
    ends = placed.select("v").distinct()
    text = Kept(text.join(ends, "v", "left_semi"), "near-texts").df
    stars = Kept(placed.join(placed.groupBy("key").agg(F.min("v").alias("a")), "key").where("v <> a").select("a", F.col("v").alias("b")).distinct(), "print-stars").df

    def verify(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_near(p, q, share) for p, q in zip(x, y, strict=True)], dtype=bool)

    both = stars.join(text.select(F.col("v").alias("b"), F.col("text").alias("tb")), "b").join(text.select(F.col("v").alias("a"), F.col("text").alias("ta")), "a")
    links = Kept(both.where(F.pandas_udf(verify, "boolean")("ta", "tb")).select("a", "b"), "print-links").df
    found = components(links, "print-parts")

    rooted = Kept(placed.join(found, "v", "left").select("key", "v", F.coalesce("root", "v").alias("root")), "print-rooted").df
    open_ = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x <> y").select("key", "n")
    # Members of an open bucket are dealt into blocks; each pair of blocks is one task's.
    dealt = rooted.join(open_, "key").withColumn("of", F.ceil(F.col("n") / BLOCK_TEXTS).cast("int")).withColumn("at", F.pmod(F.xxhash64("v"), F.col("of")).cast("int"))
    left = dealt.select("key", F.col("at").alias("i"), F.explode(F.sequence(F.col("at"), F.col("of") - 1)).alias("j"), F.lit(0).alias("side"), "v", "root")
    right = dealt.select("key", F.explode(F.sequence(F.lit(0), F.col("at"))).alias("i"), F.col("at").alias("j"), F.lit(1).alias("side"), "v", "root")
    met = left.unionByName(right).join(text, "v").withColumn("v", F.col("v").cast("string")).withColumn("root", F.col("root").cast("string"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf["side"] == k].reset_index(drop=True) for k in (0, 1))
        out, same, bags = [], pdf["i"].iloc[0] == pdf["j"].iloc[0], np.array([bag(t) for t in b["text"]])
        size, known = b["text"].str.len().to_numpy(), {}
        for v, root, t in zip(a["v"], a["root"], a["text"], strict=True):
            gap = bags - bag(t)
            edits = np.maximum(np.maximum(gap, 0).sum(axis=1), np.maximum(-gap, 0).sum(axis=1))
            own = None
            for k in np.flatnonzero((b["root"] != root).to_numpy() & (edits <= share * np.maximum(size, len(t)))):
                if same and v >= b["v"][k]:
                    continue
                own = own or grams(t)
                if k not in known:
                    known[k] = grams(b["text"][k])
                if _near(t, b["text"][k], share, own, known[k]):
                    out.append((v, b["v"][k]))
        return pd.DataFrame(out, columns=["a", "b"])

    more = met.groupBy("key", "i", "j").applyInPandas(compare, "a string, b string").select(F.col("a").cast("decimal(38,0)").alias("a"), F.col("b").cast("decimal(38,0)").alias("b"))
    links = Kept(links.unionByName(more).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "print-all-links").df
    found = components(links, "print-classes")
    one = Kept(vertex.select("digest", "v").distinct().join(found, "v", "left").select("digest", F.coalesce("root", "v").alias("x")), "print-members").df
    one = meet(one, one.groupBy("x").agg(F.count("*").alias("class_texts")), ["x"], "class_texts", F.col("digest"))
    part = F.expr(f"(x - pmod(x, cast({SPAN} as decimal(13,0)))) div cast({SPAN} as decimal(13,0))")
    one = one.select("digest", part.alias("part"), "class_texts")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text") != "", F.md5(F.col("text").cast("binary"))).alias("digest"))
    out = rows.join(one, "digest", "left")
    return out.select("doc_id", F.when(F.coalesce("part", "doc_id") != LAST, F.coalesce("part", "doc_id")).alias("class_id"), F.coalesce("class_texts", F.lit(1)).cast("long").alias("class_texts"))
